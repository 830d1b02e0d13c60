"""Windows of sentences or lines within a budget of tokens; sections of a text; sizes by density.

A document is one row and nothing is shuffled. Columns cut texts into units and count their tokens; only numbers go to Python, which
searches running sums for the bounds of windows; texts are put together by Columns again. Of a null or empty text there are no rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import lines as L

# Fixed values.
BLOCKS, MATH_BLOCKS = r"\n\s*\n|\n[-*_]{3,}\n", r"\n(?=#)"
SENTENCES = r"(?<=[.!?])\s+(?=[A-Z0-9])|\n+"
SECTION = r"^(#+|[A-Z].{1,60})$"
MATH_SIZE, MATH_OVERLAP = 400, 100
SPARSE, DENSE = 10, 40
VARIABLE = r"(?i)^(let\s+[a-z]\w*\s*(=|be)|[a-z]\w*\s*=\s*\S|where\s+[a-z]\w*\s+is)"  # a parameter: what starts a definition of a variable


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def pieces(text: Column, pattern: str) -> Column:
    """The stripped parts between matches of a pattern, without empty ones."""
    return F.filter(F.transform(F.split(text, pattern), stripped), lambda x: x != "")


def n_tokens(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0)))


def density(text: Column) -> Column:
    """Tokens for each word between blanks; 0 for a text without any."""
    return n_tokens(text) / F.greatest(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")), F.lit(1))


def adaptive_size(text: Column, size: int) -> Column:
    """Half as much again for sparse texts, a quarter less for dense ones."""
    return L.let(density(text), lambda d: F.when(d < SPARSE, int(size * 1.5)).when(d > DENSE, int(size * 0.75)).otherwise(size))


def sections(text: Column) -> Column:
    """(title, body) of a text whose titles are lines of marks, or of 2 to 61 characters that begin with a capital; the last line is none.
    What stands before the first title belongs to no section; a text without titles is one, as it stands."""

    def parted(lines: Column) -> Column:
        at = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(SECTION) & (i < F.size(lines) - 1), i).otherwise(-1)), lambda i: i >= 0)
        past = lambda at, k: F.coalesce(F.get(at, k + 1), F.size(lines))
        one = lambda at: F.transform(at, lambda i, k: F.struct(stripped(F.get(lines, i)).alias("title"), stripped(F.array_join(F.slice(lines, i + 2, past(at, k) - i - 1), "\n")).alias("body")))
        return L.let(at, one)

    return L.let(L.let(F.split(text, "\n"), parted), lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(F.struct(F.lit("Full Document").alias("title"), text.alias("body")))))


def bounds():
    """A function of one text's units, as numbers alone: the block of each, whether it is a heading, its tokens; and the size and overlap
    of windows. It gives (heading or -1, first, past) of each window. It is made here and pickled by value, so that workers need not
    import this package.

    Of running sums, a window that begins at a sum s ends where s + size is passed, and the next one begins where s + size - overlap is
    reached. A unit over the size is in no window."""

    def found(blocks, headings, tokens, size, overlap):
        import numpy as np

        n = len(tokens)
        sums = np.concatenate(([0], np.cumsum(tokens)))
        above = np.maximum.accumulate(np.where(headings, np.arange(n), -1)) if n else []
        edges = np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1], [True]))) if n else []
        ends, nexts = np.searchsorted(sums, sums[:-1] + size, "right") - 1, np.searchsorted(sums, sums[:-1] + size - overlap, "left")
        out = []
        for first, last in zip(edges[:-1], edges[1:], strict=True):
            at = int(first)
            while at < last and not headings[first]:
                if (end := min(int(ends[at]), int(last))) > at:
                    out.append((int(above[at]), at, end))
                at = max(int(nexts[at]), at + 1)
        return out

    return found


def windows(rows: DataFrame, units: Column, size: Column, overlap: int, *keys: str) -> DataFrame:
    """(*keys, units, window, heading, first, past) of rows: units are structs of s, block, heading and n (tokens), window counts from 0 in
    a row. Overlaps are to be smaller than any size."""
    found = bounds()

    @F.pandas_udf("array<struct<heading:int,first:int,past:int>>")
    def bounded(blocks: pd.Series, headings: pd.Series, tokens: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([found(*x, overlap) for x in zip(blocks, headings, tokens, sizes, strict=True)])

    made = rows.select(*keys, units.alias("units"), size.cast("int").alias("_size")).where("units IS NOT NULL AND size(units) > 0")
    bound = bounded(F.col("units.block"), F.col("units.heading"), F.col("units.n"), F.col("_size"))
    return made.select(*keys, "units", F.posexplode(bound).alias("window", "w")).select(*keys, "units", F.col("window").cast("long").alias("window"), "w.*")


def _unit(s: Column, block: Column, heading: Column, n: Column) -> Column:
    return F.struct(s.alias("s"), block.alias("block"), heading.alias("heading"), n.alias("n"))


def sentence_windows(rows: DataFrame, size: int | Column, overlap: int, *keys: str) -> DataFrame:
    """(*keys, window, section, n_sentences, text): windows of the sentences of each block of `text`, under the last heading before.
    Blocks that are headings are in no window."""
    if isinstance(size, int) and overlap >= size:
        raise ValueError("the overlap is to be smaller than the size")
    size = F.lit(size) if isinstance(size, int) else size
    of_block = lambda b, i: F.when(L.let(L.squeezed(b), L.classified)["heading"], F.array(_unit(b, i, F.lit(True), F.lit(0)))).otherwise(F.transform(pieces(b, SENTENCES), lambda s: _unit(s, i, F.lit(False), n_tokens(s))))
    made = windows(rows, F.flatten(F.transform(pieces(F.col("text"), BLOCKS), of_block)), size, overlap, *keys)
    section = F.when(F.col("heading") >= 0, F.get("units", F.col("heading"))["s"]).otherwise("Untitled Section")
    inside = F.slice(F.col("units.s"), F.col("first") + 1, F.col("past") - F.col("first"))
    return made.select(*keys, "window", section.alias("section"), F.size(inside).cast("long").alias("n_sentences"), F.array_join(inside, " ").alias("text"))


def math_lines(rows: DataFrame, *keys: str, size: int = MATH_SIZE, overlap: int = MATH_OVERLAP) -> DataFrame:
    """(*keys, window, section, text): one row for each line of each window, so that lines in an overlap come again. Blocks begin with #."""
    of_block = lambda b, i: F.transform(pieces(b, r"\r\n|\r|\n"), lambda s: _unit(s, i, F.lit(False), n_tokens(s)))
    made = windows(rows, F.flatten(F.transform(pieces(F.col("text"), MATH_BLOCKS), of_block)), F.lit(size), overlap, *keys)
    each = made.select(*keys, "window", F.explode(F.slice(F.col("units.s"), F.col("first") + 1, F.col("past") - F.col("first"))).alias("text"))
    return each.select(*keys, "window", F.when(F.col("text").rlike(VARIABLE), "Variable Definition").otherwise("Math Section").alias("section"), "text")


def adaptive_windows(rows: DataFrame, size: int, overlap: int, key: str) -> DataFrame:
    """(key, place, title, window, section, n_sentences, text): sentence windows of each section of `text`, of a size by the density of the
    whole text; sections count from 0."""
    if overlap >= int(size * 0.75):
        raise ValueError("the overlap is to be smaller than the smallest size")
    each = rows.where("text IS NOT NULL").select(key, adaptive_size(F.col("text"), size).alias("_most"), F.posexplode(sections(F.col("text"))).alias("place", "s"))
    each = each.select(key, F.col("place").cast("long").alias("place"), F.col("s.title").alias("title"), F.col("s.body").alias("text"), "_most")
    return sentence_windows(each, F.col("_most"), overlap, key, "place", "title")
