"""CRC-32 of many byte spans at once, from a table of what each byte contributes at its distance from the end.

A CRC register is linear over GF(2): the checksum of a span is a constant of its length, XORed with one contribution for each
byte, which depends on the byte and on its distance from the span's end alone. Contributions are looked up and folded by
bitwise_xor.reduceat. A table holds BLOCK distances; a longer span is cut into blocks from its end, and the value of the block
j blocks before the end moves on over j * BLOCK zero bytes, one lookup for each bit of j that is set.
"""

from __future__ import annotations

from functools import cache

import numpy as np

from loomline.llm.texts import spread

POLYNOMIAL = 0xEDB88320
BLOCK = 64
#: Bytes whose contributions are held at once.
CHUNK_BYTES = 1 << 20
ONES = np.uint32(0xFFFFFFFF)


@cache
def _byte_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & np.uint32(1), (x >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), x >> np.uint32(1))
    return x


def _zero_byte(x: np.ndarray) -> np.ndarray:
    """The register after one more byte of zero."""
    return _byte_table()[x & np.uint32(0xFF)] ^ (x >> np.uint32(8))


@cache
def _positions() -> tuple[np.ndarray, np.ndarray]:
    """Contribution by distance and byte (flat, 256 a distance), and the register that starts at ones after 0..BLOCK zero bytes."""
    rows, starts = [_byte_table()], [np.array([ONES])]
    for _ in range(BLOCK):
        rows.append(_zero_byte(rows[-1]))
        starts.append(_zero_byte(starts[-1]))
    return np.concatenate(rows[:BLOCK]), np.concatenate(starts)


def _lookup(images: np.ndarray) -> np.ndarray:
    """From what an operator makes of each of 32 bits, what it makes of each byte in each of four places."""
    table = np.zeros((4, 256), np.uint32)
    for place in range(4):
        for bit in range(8):
            table[place] ^= np.where(np.arange(256) >> bit & 1, images[8 * place + bit], np.uint32(0)).astype(np.uint32)
    return table


def _apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0, x & 0xFF] ^ table[1, x >> np.uint32(8) & np.uint32(0xFF)] ^ table[2, x >> np.uint32(16) & np.uint32(0xFF)] ^ table[3, x >> np.uint32(24)]


@cache
def _advance(k: int) -> np.ndarray:
    """The operator of BLOCK * 2**k zero bytes."""
    images = np.uint32(1) << np.arange(32, dtype=np.uint32)
    if k:
        half = _advance(k - 1)
        return _lookup(_apply(half, _apply(half, images)))
    for _ in range(BLOCK):
        images = _zero_byte(images)
    return _lookup(images)


def _moved(x: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Each register after so many blocks of zero bytes."""
    for k in range(int(blocks.max(initial=0)).bit_length()):
        on = np.flatnonzero(blocks >> k & 1)
        x[on] = _apply(_advance(k), x[on])
    return x


def _fold(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Checksums of spans of at least one byte."""
    table, constants = _positions()
    lengths = ends - starts
    ahead = (lengths - 1) // BLOCK  # whole blocks behind the first one
    at = np.repeat(starts, lengths) + spread(lengths)
    distance = np.repeat(ends, lengths) - 1 - at
    parts = table[(distance % BLOCK) << 8 | data[at]]
    behind = np.repeat(ahead, ahead + 1) - spread(ahead + 1)  # of each block of each span
    heads = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    cuts = np.where(behind == np.repeat(ahead, ahead + 1), np.repeat(heads, ahead + 1), np.repeat(heads + lengths, ahead + 1) - BLOCK * (behind + 1))
    blocks = _moved(np.bitwise_xor.reduceat(parts, cuts), behind)
    sums = np.bitwise_xor.reduceat(blocks, np.concatenate(([0], np.cumsum(ahead + 1)))[:-1])
    return sums ^ _moved(constants[lengths - BLOCK * ahead], ahead) ^ ONES


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of data[start:end] for each span (they may overlap); 0 for an empty one."""
    out = np.zeros(len(starts), np.uint32)
    full = np.flatnonzero(ends > starts)
    sizes = np.cumsum((ends - starts)[full])
    first = 0
    while first < len(full):
        stop = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + CHUNK_BYTES, "right")))
        on = full[first:stop]
        out[on] = _fold(data, starts[on], ends[on])
        first = stop
    return out
