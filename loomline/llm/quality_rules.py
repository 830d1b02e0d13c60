"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every document gets its base measures. The verdict of the others comes from a cascade of rules, each a Column that says
"reject": on a bounded sample, each rule is timed and its share of rejections taken, and the rules run in the order of
rejections per cost (the median of TIMES warm passes), so that a document that an early rule rejects never pays for the
later ones. The order changes only the cost, never the verdict.

Words are `[^\\x20\\x09-\\x0D]+`. Defined results: a null text has no words, fails the base and isn't kept; repeated rows are
rows of their own; extra columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import statistics
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.shared import bounded_sample

#: Rules are timed on about so many documents.
SAMPLE_DOCS, TIMES = 2_000, 3
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """`reject` may use the measures, `text` and `words`."""

    name: str
    reject: Column


def rules() -> list[Rule]:
    upper = F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}+", ""))
    letters = F.length("text") - F.length(F.regexp_replace("text", r"\p{L}+", ""))
    shouts = F.length("text") - F.length(F.replace(F.col("text"), F.lit("!"), F.lit("")))
    stutters = F.size(F.expr("filter(words, (w, i) -> i > 0 AND w = words[i - 1])"))
    return [
        Rule("symbols", F.col("n_symbols") * 10 > F.col("word_chars")),
        Rule("short_or_long_words", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 40 * F.col("n_words"))),
        Rule("repeated_lines", F.col("n_dup_lines") * 10 > 3 * F.col("n_lines")),
        Rule("shouts", shouts * 5 > F.col("n_words")),
        Rule("capitals", upper * 2 > letters),
        Rule("few_letters", letters * 2 < F.col("word_chars")),
        Rule("stutters", stutters * 5 > F.col("n_words")),
    ]


def _once(value: Column) -> Column:
    """value, which the optimizer mustn't copy into the lambdas and filters that use it (they would make it anew for each
    element): it counts as not deterministic."""
    return F.when(F.spark_partition_id() >= 0, value)


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, text, words, n_lines) and the base measures of every document."""
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = out.withColumn("words", _once(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")))
    out = out.withColumn("lines", _once(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))))
    hashes = ", ".join(f"words[i + {k}]" for k in range(WINDOW))
    # hashes of the windows: only texts in which one comes back pay for the rest
    out = out.withColumn("h", _once(F.expr(f"CASE WHEN size(words) > {WINDOW} THEN transform(sequence(0, size(words) - {WINDOW}), i -> xxhash64({hashes})) END")))
    out = out.withColumn("z", _once(F.expr("CASE WHEN size(array_distinct(h)) < size(h) THEN sort_array(transform(h, (x, i) -> struct(x AS x, i AS i))) END")))
    out = out.withColumn("at", _once(F.expr("CASE WHEN z IS NOT NULL THEN sort_array(transform(filter(z, (e, k) -> (k > 0 AND z[greatest(k - 1, 0)].x = e.x) OR (k < size(z) - 1 AND z[least(k + 1, size(z) - 1)].x = e.x)), e -> e.i)) END")))
    repeat = f"CASE WHEN at IS NULL THEN 0 ELSE {WINDOW} + aggregate(sequence(1, size(at) - 1), 0, (s, k) -> s + least({WINDOW}, at[k] - at[k - 1])) END"
    return out.select(
        "doc_id",
        "text",
        "words",
        F.size("lines").cast("long").alias("n_lines"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _once(F.expr(repeat).cast("long")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def order_rules(docs: DataFrame, given: list[Rule], sample_docs: int = SAMPLE_DOCS) -> list[Rule]:
    """The rules by rejections per cost, both from a sample of the documents. Cost: the time of a pass over the sample
    with the rule, without that of a pass with none."""
    sample = measure(bounded_sample(docs.select("doc_id", "text"), "doc_id", sample_docs, 1)).persist()
    try:
        n = sample.agg(F.count_if(~base_failed())).first()[0]
        if not n:
            return given

        def timed(*rule: Column) -> tuple[float, int]:
            spent = []
            for _ in range(TIMES + 1):  # the first one makes the code
                began = time.perf_counter()
                hits = sample.agg(*(F.count_if(~base_failed() & r) for r in rule), F.count_if(F.length("text") < 0)).first()[0]
                spent.append(time.perf_counter() - began)
            return statistics.median(spent[1:]), hits

        none = timed()[0]
        rate = {}
        for r in given:
            cost, hits = timed(r.reject)
            rate[r.name] = (hits / n + 1e-4) / max(cost - none, 1e-3)
        return sorted(given, key=lambda r: -rate[r.name])
    finally:
        sample.unpersist()


def judge(docs: DataFrame, given: list[Rule] | None = None) -> DataFrame:
    """Base measures, base_failed and kept of every document."""
    ordered = order_rules(docs, given if given is not None else rules())
    verdict = F.when(base_failed(), False)
    for r in ordered:  # CASE evaluates a branch only where none before it held
        verdict = verdict.when(r.reject, False)
    return measure(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), verdict.otherwise(True).alias("kept"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) > 8)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
cover AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, unnest(range(8)) AS j FROM twice) GROUP BY doc_id),
m AS (SELECT w.doc_id, text, words, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
             CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words,
             length(text) - length(replace(text, '!', '')) AS shouts,
             length(text) - length(regexp_replace(text, '\p{Lu}+', '', 'g')) AS upper_n,
             length(text) - length(regexp_replace(text, '\p{L}+', '', 'g')) AS letters,
             len(list_filter(words, lambda x, i: i > 1 AND x = words[i - 1])) AS stutters
      FROM w LEFT JOIN cover ON w.doc_id = cover.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 10 > word_chars OR word_chars < 2 * n_words OR word_chars > 40 * n_words OR n_dup_lines * 10 > 3 * n_lines
            OR shouts * 5 > n_words OR upper_n * 2 > letters OR letters * 2 < word_chars OR stutters * 5 > n_words) AS kept
FROM b
"""
