"""Many terms in many texts, without comparing each term with each text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms of so many bytes in all are broadcast; more of them are joined by shuffles.
MOST_BYTES = 32 << 20
#: The runs of characters by which terms and texts meet: around a blank, or with a digit. All of them overlap, so they are sought ahead.
WIDE, NARROW, DIGIT = "(?=([a-z0-9]{2} [a-z0-9]{2}))", "(?=([a-z0-9] [a-z0-9]))", "(?=([0-9]..|.[0-9].|..[0-9]))"

#: Every two words that follow one another.
PAIRS = "(?=(?<![a-z0-9])([a-z0-9]+ [a-z0-9]+))"


def _runs(text: str, pattern: str):
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def contained(texts: DataFrame, key: str, terms: DataFrame, pattern: str, small: bool) -> DataFrame:
    """(key, term), each pair once, of plain texts (key, text) and terms (term, sought) where a text has `sought` inside.

    A term meets the texts that hold one of its runs, namely that which fewest terms share, and is then compared in whole. Terms without
    a run of the pattern meet none. With small terms nothing is shuffled: runs of a text are looked up where it is read, and most find
    no term. Otherwise runs are shuffled, and texts come to the pairs by key, so that keys are to be distinct."""
    runs = terms.select("term", "sought", F.explode(_runs("sought", pattern)).alias("run"))
    shared = runs.groupBy("run").agg(F.count("*").alias("n"))
    chosen = runs.join(shared, "run").groupBy("term", "sought").agg(F.min_by("run", F.struct("n", "run")).alias("run"))
    if small:
        each = texts.select(key, "text", F.explode(_runs("text", pattern)).alias("run"))
        return each.join(F.broadcast(chosen), "run").where(F.contains("text", F.col("sought"))).select(key, "term")
    pairs = texts.select(key, F.explode(_runs("text", pattern)).alias("run")).join(chosen, "run").select(key, "term", "sought")
    return pairs.join(texts, key).where(F.contains("text", F.col("sought"))).select(key, "term")


def in_pairs(texts: DataFrame, key: str, terms: DataFrame, small: bool) -> DataFrame:
    """(key, term) for plain terms (term) of two words: each is held against pairs of words that share the two characters about the blank,
    so that no whole text goes along or is searched. A pair of words may repeat a hit."""
    wide, narrow = (lambda c, p=p: F.regexp_extract(c, p, 0) for p in ("[a-z0-9]{2} [a-z0-9]{2}", "[a-z0-9] [a-z0-9]"))
    asked = terms.select("term", F.coalesce(F.nullif(wide("term"), F.lit("")), narrow("term")).alias("run"))
    pairs = texts.select(key, F.explode(_runs("text", PAIRS)).alias("pair")).select(key, "pair", F.explode(F.array(wide("pair"), narrow("pair"))).alias("run"))
    met = pairs.where("run <> ''").join(F.broadcast(asked) if small else asked, "run")
    return met.where(F.contains("pair", F.col("term"))).select(key, "term")


def mentions(texts: DataFrame, key: str, terms: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(key, term), each pair once and dealt by key, of plain texts (key, text) and plain terms (term): single words are met as whole
    words, terms of several words anywhere in the text; terms of four characters or more with a digit also in the text without its
    blanks. Null and empty texts and terms meet nothing."""
    terms = terms.where("term <> ''").distinct()
    small = (terms.agg(F.sum(F.octet_length("term"))).first()[0] or 0) <= most_bytes
    n_words = F.size(F.split("term", " "))
    several = terms.where(n_words > 2).select("term", F.col("term").alias("sought"))
    wide = F.regexp_like("sought", F.lit(WIDE))
    single = terms.where(~F.contains("term", F.lit(" ")))
    words = texts.select(key, F.explode(F.array_distinct(F.split("text", " "))).alias("term")).join(F.broadcast(single) if small else single, "term").select(key, "term")
    bare = terms.select("term", F.replace("term", F.lit(" "), F.lit("")).alias("sought")).where((F.length("sought") >= 4) & F.col("sought").rlike("[0-9]"))
    squeezed = texts.select(key, F.replace("text", F.lit(" "), F.lit("")).alias("text"))
    words = words.union(in_pairs(texts, key, terms.where(n_words == 2), small))
    hits = words.union(contained(texts, key, several.where(wide), WIDE, small)).union(contained(texts, key, several.where(~wide), NARROW, small))
    return hits.union(contained(squeezed, key, bare, DIGIT, small)).repartition(key).distinct()
