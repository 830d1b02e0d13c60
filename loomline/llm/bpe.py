"""Byte-level BPE ids of whole texts by the tokenizers library, with each word encoded about once.

Byte-level BPE cuts a text into words by a fixed pattern and merges inside words only, so the ids of a text are the ids of
its words one after another. A worker therefore remembers ids of words in bounded tables, and asks the library's model for
new words only. Texts in which spaces and line breaks only stand singly between other characters are cut at these (the
pattern always cuts there), others by the pattern. Texts with characters beyond U+024F (the pattern's classes are spelled
out here only up to there) and texts that hold a special token's string go to the library whole.

Of many texts at once (`encode_all`), Arrow cuts the even ones and numbers their distinct runs, so that Python and the model
meet a word once a block, and no table outlives it. Words go to the model side by side with a zero byte between them: merges
make tokens of the vocabulary only, so where no longer token has that byte, it keeps words apart.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A worker's table holds at most twice as many words: those used since the last turn, and those before.
MAX_WORDS = 400_000

_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = "\t-\r \x85\xa0"
_WORD = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_BEYOND = re.compile("[^\x00-ɏ]")
_ODD = re.compile("[\x00\t\x0b\x0c\r\x85\xa0]|[^\x00-ɏ]")
#: Arrow's pattern for texts that can't be cut at single spaces and line breaks.
_UNEVEN = r"[^\x{01}-\x{24F}]|[\t\x0b\x0c\r\x{85}\x{A0}]|[ \n][ \n]|[ \n]\z"
#: Words that the model gets side by side.
_BESIDE = 128


@cache
def encoder(path: str, max_words: int = MAX_WORDS) -> WordEncoder:
    """One for each file and size of tables in each worker."""
    return WordEncoder(path, max_words)


class UnevenError(Exception):
    """A blank stands beside a blank or at an end."""


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level BPE has for each byte: itself, or one from U+0100 on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _lists(raw: list[bytes]) -> pa.LargeListArray:
    """Little-endian 32-bit ids as lists."""
    ends = np.cumsum([0, *map(len, raw)], dtype=np.int64) // 4
    return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), np.uint32)))


class WordEncoder:
    def __init__(self, path: str, max_words: int = MAX_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        zero = self.letters[0]
        #: Id of the zero byte; None if a longer token has it.
        self.between = None if any(zero in t and t != zero for t in self.tokenizer.get_vocab(with_added_tokens=False)) else self.model.token_to_id(zero)
        self.max_words = max_words
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        """Ids of one word of the pattern."""
        return array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def _by_pattern(self, text: str) -> bytes:
        return b"".join([self._word(w) for w in _WORD.findall(text)])

    def _joined(self, cut: list[str], ids) -> bytes:
        """Ids of all parts; `ids` makes those of a new one."""
        known = self.words
        try:
            return b"".join(map(known.__getitem__, cut))
        except KeyError:
            old = self.old
            for w in set(cut).difference(known):
                known[w] = old.get(w) or ids(w)
            out = b"".join(map(known.__getitem__, cut))
            if len(known) > self.max_words:
                self.words, self.old = {}, known
            return out

    def _run(self, run: str) -> bytes:
        """Ids of what stands between spaces, with the space before it; a line break stands for itself at the head of a run."""
        if run in ("", "\n"):
            raise UnevenError
        cut = _WORD.findall(run if run[0] == "\n" else " " + run)
        return b"".join([len(cut) > 1 and w[0] == " " and self.words.get(w[1:]) or self._word(w) for w in cut])

    def _beside(self, words: list[str]) -> pa.LargeListArray:
        """Ids of words without a zero byte."""
        if self.between is None:
            return _lists([self._word(w) for w in words])
        ids, ends, n = [], [[0]], 0
        for at in range(0, len(words), _BESIDE):
            joined = "".join([w + "\0" for w in words[at : at + _BESIDE]])
            found = np.array([t.id for t in self.model.tokenize(joined.encode().decode("latin-1").translate(self.letters))], np.uint32)
            between = found == self.between
            ids.append(found[~between])
            ends.append(n + np.cumsum(~between)[between])
            n += len(ids[-1])
        return pa.LargeListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int64)), pa.array(np.concatenate([np.empty(0, np.uint32), *ids])))

    def _runs(self, spaced: pa.Array, others: list[str]) -> pa.LargeListArray:
        """Ids of runs of even texts: those with a space before them, then those without."""
        words = _WORD.findall(" " + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(spaced)], pa.int32()), spaced), " ")[0].as_py()) if len(spaced) else []
        heads = [i for i, w in enumerate(words) if w[0] == " "]  # a run's first word has the space, and no other
        for r in others:
            heads.append(len(words))
            words += _WORD.findall(r)
        number = dict.fromkeys(words, 0)
        for i, w in enumerate(number):
            number[w] = i
        ids = self._beside(list(number)).take(pa.array(np.fromiter(map(number.__getitem__, words), np.int64, len(words))))
        return pa.LargeListArray.from_arrays(pa.array(ids.offsets.to_numpy()[[*heads, len(words)]]), ids.values)

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text, as encode has them (null: none). What is held meanwhile is a few times the texts' size, about
        fifty times where words hardly repeat."""
        texts = pc.fill_null(texts, "")
        uneven = pc.match_substring_regex(texts, _UNEVEN)
        for t in self.special:
            uneven = pc.or_(uneven, pc.match_substring(texts, t))
        even = pc.replace_substring(texts.filter(pc.invert(uneven)), "\n", " \n")
        cut = pc.split_pattern(pc.binary_join_element_wise("\0", even, ""), " ")
        runs = cut.values.dictionary_encode()
        # no space stands before a text's first run, marked by \0, nor before a line break
        other = pc.match_substring_regex(runs.dictionary, r"^[\x00\n]")
        ids = self._runs(runs.dictionary.filter(pc.invert(other)), [r.removeprefix("\0") for r in runs.dictionary.filter(other).to_pylist()])
        place = np.empty(len(other), np.int64)
        place[np.argsort(other.to_numpy(zero_copy_only=False), kind="stable")] = np.arange(len(other))
        ids = ids.take(pa.array(place[runs.indices.to_numpy()]))
        raw, at = ids.values.to_numpy().tobytes(), (4 * ids.offsets.to_numpy()[cut.offsets.to_numpy()]).tolist()
        own = iter([raw[a:b] for a, b in zip(at, at[1:], strict=False)])
        rest = map(self.encode, texts.filter(uneven).to_pylist())
        return [next(rest if u else own) for u in uneven.to_pylist()]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        odd = _ODD.search(text)
        if odd and (odd[0] > "ɏ" or _BEYOND.search(text)) or any(t in text for t in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if text and not odd:
            cut = text.replace("\n", " \n").split(" ")
            try:
                return self._by_pattern(cut.pop(0)) + self._joined(cut, self._run)
            except UnevenError:
                pass
        # words of the pattern are marked, as runs have no space of their own
        return self._joined(["\0" + w for w in _WORD.findall(text)], lambda w: self._word(w[1:]))
