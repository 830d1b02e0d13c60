"""What SQL statements of several operators share: CRC-32 of text, from a table made by its rule."""

#: A common table expression, for DuckDB: one row, the 256 entries of the byte table.
CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS entries
  FROM range(256) AS r(i))"""


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an expression's UTF-8 bytes; crc_table must be among the tables."""
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: 16 * instr('0123456789ABCDEF', x[1]) + instr('0123456789ABCDEF', x[2]) - 17)"
    return f"xor(list_reduce(list_concat([4294967295], {data}), lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])), 4294967295)"
