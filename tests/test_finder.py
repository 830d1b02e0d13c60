"""The finder's rules on made texts: families of parts, generic stock, terms inside texts, quality and code."""

import duckdb
import pytest
from pyspark.sql import functions as F

from loomline.functions import lines as L
from loomline.operators import substrings as S
from loomline.plans import finder, registry


def stock_of(spark, *parts):
    rows = spark.createDataFrame(list(parts), "name string, kind string")
    return rows.select(F.explode(F.concat(finder.lookup_keys(F.col("name"), F.col("kind")), finder.lookup_keys(F.col("kind"), F.col("kind")))).alias("k")).agg(F.collect_set("k").alias("index")).first()["index"]


def candidate(spark, text, matched, index, quality=0.5):
    rows = spark.createDataFrame([(1, "s", text, text.lower(), matched, index, quality)], "doc_id long, source string, text string, low string, matched array<string>, index array<string>, quality double")
    return finder.qualified(rows).first()


def test_keys_of_families(spark):
    keys = stock_of(spark, ("LM555", "timer"))
    assert {"555 timer", "ne555", "lm555"} <= set(keys)
    one = spark.range(1).select(finder.lookup_keys(F.lit("10 kΩ"), F.lit(None).cast("string")).alias("k"), finder.lookup_keys(F.lit(None).cast("string"), F.lit("")).alias("none"), finder.lookup_keys(F.lit("Bench"), F.lit("battery")).alias("b")).first()
    assert one["k"] == ["10 kohm", "10kohm"] and one["none"] == [] and one["b"] == ["bench", "power supply", "battery", "bench supply"]


def test_missing_parts_by_family_and_not_by_single_words(spark):
    text = "Build a blinker circuit: connect the NE555 timer and an LED on the Raspberry Pi or the Arduino, slowly and with much care, to the rail."
    row = candidate(spark, text, ["or", "board"], stock_of(spark, ("LM555", "timer"), ("or", ""), ("board", "")))
    assert [p["name"] for p in row["required"]] == ["NE555 timer", "Arduino board", "Raspberry Pi or GPIO board", "LED"]
    assert [p["name"] for p in row["missing"]] == ["Arduino board", "Raspberry Pi or GPIO board", "LED"]  # a word of a name, or its kind, is no stock
    assert row["project_like"] and not row["buildable"] and row["reasons"] == [] and row["score"] == 18 * 2 + 5 - 12 + 10
    row = candidate(spark, text, ["led"], stock_of(spark, ("LM555", "timer"), ("light emitting diode", ""), ("Arduino board", ""), ("Raspberry Pi or GPIO board", "")))
    assert row["missing"] == [] and row["buildable"]


def test_generic_stock_of_values_and_equal_names(spark):
    text = "Parts list of the circuit: 10 kΩ, 10 KΩ, 220 ohm resistors and 10 uF; solder them in this order on the board, and test each one before the next."
    have = candidate(spark, text, ["x"], stock_of(spark, ("100R", "resistor")))
    assert [p["name"] for p in have["required"]] == ["10 k ohm resistor", "220 ohm resistor", "10 uf capacitor"] and [p["name"] for p in have["missing"]] == ["10 uf capacitor"]
    assert [p["name"] for p in candidate(spark, text, ["x"], stock_of(spark, ("10 uF capacitor", ""), ("10 k ohm resistor", "")))["missing"]] == ["220 ohm resistor"]


def test_code_stands_for_a_build_action(spark):
    text = "void setup and pinMode for the GPIO pin of the relay, as the circuit of this chapter needs; nothing else is said about what is to be done."
    assert candidate(spark, text, ["x"], ["x"])["project_like"]
    assert candidate(spark, text.replace("setup", "things").replace("pinMode", "modes"), ["x"], ["x"])["reasons"] == ["no build"]
    short = candidate(spark, "copyright", ["x"], ["x"])
    assert short["reasons"] == ["short", "boilerplate"] and short["score"] == 18 + 5 - 16


def mentioned(spark, texts, terms, most_bytes=S.MOST_BYTES):
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", finder.plain(F.col("text")).alias("text"))
    return {tuple(r) for r in S.mentions(docs, "id", spark.createDataFrame([(t,) for t in terms], "term string"), most_bytes).collect()}


def test_mentions(spark):
    texts = ["The NE-555 timer drives a 10-segment LED.", "Electronic parts, no integrated circuit.", "", None, "NE 555", "used timers"]
    got = mentioned(spark, texts, ["ne555 timer", "10 segment led", "ic", "led", "ed timer", "ne555"])
    assert got == {(0, "ne555 timer"), (0, "10 segment led"), (0, "led"), (0, "ne555"), (4, "ne555"), (5, "ed timer")}
    assert mentioned(spark, texts, []) == set() and mentioned(spark, [], ["led"]) == set()


@pytest.mark.parametrize("most_bytes", [S.MOST_BYTES, 0])
def test_mentions_equal_brute_force(spark, most_bytes):
    words = ["a", "ab", "b2", "abc", "bca4", "c", "x9yz"]
    texts = [" ".join(words[(i * 7 + j * j * (i + 3)) % len(words)] for j in range(i % 9)) for i in range(60)]
    terms = sorted({" ".join(t.split()[:n]) for t in texts for n in (1, 2, 3)} - {""}) + ["zz", "b c"]

    def holds(text, term):
        bare = term.replace(" ", "")
        return (term in text if " " in term else term in text.split()) or (len(bare) >= 4 and any(c.isdigit() for c in bare) and bare in text.replace(" ", ""))

    assert mentioned(spark, texts, terms, most_bytes) == {(i, t) for i, x in enumerate(texts) for t in terms if holds(x, t)}


#: Words and values beside accented letters, where an edge of a word is one to SQL.
EDGES = [
    "all rights reserved, then öconnect the ätimer on a circuit board, éled and ñrelay to be had, and much more is said about it here",
    "Parts list of the circuit: test it with ü10 kohm, 220 ohmé and é4.7 ufä beside the transistoré, and nothing more than that one, really",
    "editorial of the éarduino and the ü555 timerß, for any schematic: ßbreadboard first, then éop ampé and épower supply, and so on, on and on",
    "all rights reserved, and the öwire of a circuit is all there is to it here; the rest is as long as it has to be to count as a text",
    "ßfigure 7 says nothing", "1 2 3 4 äunit 5 6 7 8 9 10 11 12 13 14", "ç", "",
]


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edges"))
    texts = [(i, t, "ab"[i % 2]) for i, t in enumerate(EDGES * 30)]
    spark.createDataFrame(texts, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, "the and of it 555 timer 10 nothing")], "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return path


def same_as_sql(spark, path, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    asked = con.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in asked.description]
    want = asked.fetchall()
    got = [tuple(r) for r in registry.QUERIES[name](spark, path).select(columns).collect()]
    assert want and sorted(map(str, got)) == sorted(map(str, want))


def test_edges_of_words_in_candidates(spark, edges):
    same_as_sql(spark, edges, "finder_candidates")


def test_a_page_reads_the_texts_once(spark, edges):
    assert registry.QUERIES["finder_page"](spark, edges)._jdf.queryExecution().sparkPlan().toString().count("documents.parquet") == 1


def test_signs_are_in_all_that_a_pattern_finds(spark):
    said = {finder.CODE: "import board", finder.BUILD: "breadboard", finder.CIRCUIT: "parts list", finder.BOILERPLATE: "all rights reserved"}
    rows = [(p, said.get(p, name.lower().replace(" or gpio board", "").replace("light", ""))) for p, name in [*((p, n) for p, n, _ in finder.PARTS), *((p, "") for p in said)]]
    for pattern, text in rows:
        assert spark.range(1).select(finder.says(F.lit(f"é{text}é"), pattern)).first()[0], pattern


@pytest.mark.parametrize("text", ["", ".", "a b c d", "a b c d e", "a.b.c", "....... a ........", "1 2 3 4 5 6 x", "é1é ++ ++ (( ))", "figure 1: 1 2 3 4 5 6 7 8", "unit 1 2 3 4 5 6 7 8 9", "\u000b 1 a b"])
def test_quality_of_a_text_equals_that_of_a_line(spark, text):
    of = L.let(L.squeezed(F.lit(text)), L.classified)
    quality, same = spark.range(1).select(L.text_quality(L.squeezed(F.lit(text))), L.quality_score(L.quality_flags(of))).first()
    assert quality == same


def test_edges_of_words_in_distinct_candidates(spark, edges):
    same_as_sql(spark, edges, "finder_distinct")


def test_edges_of_words_in_missing_parts(spark, edges):
    same_as_sql(spark, edges, "finder_missing_parts")


def test_edges_of_words_on_a_page(spark, edges):
    same_as_sql(spark, edges, "finder_page")
