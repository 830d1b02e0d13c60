"""Rules on documents, ingestion and search against small texts with known answers."""

from pyspark.sql import functions as F

from loomline.plans import document_rules as D
from loomline.plans import ingest_rules as I
from loomline.plans import search_rules as S


def found(spark, text):
    rows = spark.createDataFrame([(1, text)], "doc_id int, text string").select(F.inline(D.facts(F.col("text")))).collect()
    return [(r.type, r.label, r.value, r.unit) for r in rows]


def test_facts_of_a_text(spark):
    assert found(spark, "Supply voltage of 3 V to 5.5 V in DIP-8") == [("package", "Package", "DIP", ""), ("voltage", "SUPPLY VOLTAGE", "3 to 5.5", "V")]
    assert found(spark, "Forward voltage, and supply voltage 2 to 6 V") == [("voltage", "SUPPLY VOLTAGE", "2 to 6", "V"), ("voltage", "FORWARD VOLTAGE", "6", "V")]
    assert found(spark, "forward voltage, no load, 2 V") == [] and found(spark, "") == [] and found(spark, None) == []
    assert found(spark, "Output current 20 mA\noutput current 20 mA") == [("current", "OUTPUT CURRENT", "20", "mA")]
    assert found(spark, "Dry. Mind ESD here! Ok\nDamage: RoHS") == [("warning", "Caution", "mind esd here!", "")]
    assert len(found(spark, "\n".join(f"Forward voltage {i} V" for i in range(9)))) == D.FACT_CAPS["voltage"]


def test_profiles(spark):
    rows = [(1, "datasheet_NE555", "Pin configuration, pinout. NE555 timer"), (2, "a", "A wiring diagram of NE5532"), (3, "b", "this book, ISBN 3"), (4, None, None), (5, "c", ""), (6, "d", "Parts list")]
    docs = spark.createDataFrame(rows, "doc_id int, name string, text string")
    got = {r.doc_id: (r.kind, r.component, r.component_type) for r in D.profiles(docs).collect()}
    assert got == {1: ("component_datasheet", "NE555", "timer"), 2: ("schematic", None, None), 3: ("reference_book", None, None), 4: ("unknown", None, None), 5: ("unknown", None, None), 6: ("project_or_reference", None, None)}
    assert D.profiles(docs.limit(0)).count() == 0


def test_candidates_in_the_name_count_two_more(spark):
    docs = spark.createDataFrame([(1, "NE555_notes", "NE555 and LM358, LM 358")], "doc_id int, name string, text string")
    got = {r.value: (r.n, r.in_name) for r in D.candidates(docs).collect()}
    assert got["LM358"] == (2, False) and got["NE555"][1] and got["NE555"][0] >= 4


def test_recognized_text(spark):
    rows = spark.createDataFrame([("",), ("page 12",), ("12-Mar-2020",), ("hello there",), ("The output voltage of this timer drives a resistor and one capacitor at low frequency",)], "s string")
    got = {r.s: (r.score, r.detail) for r in I.recognized_quality(rows, "s").collect()}
    assert got[""] == (0.0, "Empty") and got["page 12"] == got["12-Mar-2020"] == (0.0, "isolated OCR noise")
    assert got["hello there"] == (0.0, "too short, short text without electronics signal, low meaningful word count, low uniqueness")
    assert max(v[0] for v in got.values()) == 1.0


def test_low_confidence_lowers_the_score(spark):
    rows = spark.createDataFrame([("The output voltage of this timer drives a resistor and one capacitor at low frequency", c) for c in (10.0, 90.0, None)], "s string, c double")
    assert sorted(r.score for r in I.recognized_quality(rows, "s", "c").collect()) == [0.7, 1.0, 1.0]


def test_pins(spark):
    raw = spark.createDataFrame([(1, 2, 1, "b"), (1, 1, 1, " a  c "), (1, 3, 0, "x"), (1, 4, 2, None), (1, 5, 3, "y" * 41), (1, 6, 4, "z")], "doc int, seq int, pin int, label string")
    assert sorted(tuple(r) for r in I.clean_pins(raw).collect()) == [(1, 1, "a c"), (1, 4, "z")]
    pins = lambda rows: spark.createDataFrame(rows, "doc int, pin int")
    gaps = [(1, 1), (1, 2), (1, 4), (1, 5)]
    assert I.stronger(pins([(1, 1), (1, 2), (1, 3), (1, 4)]), pins(gaps)).first().replace and not I.stronger(pins(gaps), pins(gaps)).first().replace
    assert not I.stronger(pins([(1, 1), (1, 2)]), pins([])).first().replace and I.stronger(pins([(1, 1), (1, 2), (1, 3)]), pins([])).first().replace


def test_workers_round_halves_to_even(spark):
    rows = spark.createDataFrame([(5, 93.0), (7, 93.0), (1, 99.0), (4, None), (4, 96.0), (4, 91.0), (4, 50.0)], "w int, c double")
    got = [tuple(r.t) for r in rows.select(I.worker_target(F.col("w"), F.col("c")).alias("t")).collect()]
    assert got == [("high", 2), ("high", 4), ("not_applicable", 1), ("unavailable", 4), ("hard", 1), ("moderate", 3), ("headroom", 4)]


def test_variants_and_profiles(spark):
    rows = spark.createDataFrame([("  The  Password ",), ("eau",), (None,)], "t string")
    assert [r.v for r in rows.select(S.variants(F.col("t"), [("the", "a"), ("x", "y")]).alias("v")).collect()] == [["a [redacted]", "the [redacted]"], ["eau"], []]
    assert [r.p for r in rows.select(S.profile(F.col("t"))["profile"].alias("p")).collect()] == ["default", "french", "default"]
