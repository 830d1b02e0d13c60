"""Cards, plans and merged facts on made rows."""

from pyspark.sql import functions as F

from loomline.plans import card_rules as K

FACT = "type string, label string, value string, unit string"
PARTS = "doc string, component string, component_type string, question string, facts array<struct<type:string,label:string,value:string,unit:string>>, sources array<struct<source:string,pages:array<int>>>"
PINS = "doc string, pin int, label string, function string, page int"


def made(spark, parts, pins):
    return K.carded(K.wired(spark.createDataFrame(parts, PARTS), spark.createDataFrame(pins, PINS)))


def test_destination(spark):
    want = {"gnd": "Ground rail", "VIN": "Positive supply rail", "Data output": "Load, MCU input, or next stage", "out": "Load, MCU input, or next stage", "Trigger input": "Signal source or MCU output", "TRIG": "Signal source or MCU output", "nc": "Leave unconnected", "Reset": "Use according to this pin function", "PIN": "Use according to this pin function"}
    got = spark.createDataFrame([(k,) for k in want], "f string").select("f", K.destination(F.col("f")).alias("to")).collect()
    assert {r["f"]: r["to"] for r in got} == want


def test_wiring_is_cut_and_filled(spark):
    pins = [("many", i, f"P{i}", "", 3) for i in range(20, 0, -1)] + [("one", 7, None, None, None)]
    rows = {r["doc"]: r for r in made(spark, [(d, n, None, None, None, None) for d, n in (("many", "A"), ("one", "B"), ("none", None))], pins).collect()}
    assert [w["from"] for w in rows["many"]["wiring"]] == [f"Pin {i} P{i}" for i in range(1, 17)] and rows["many"]["n_pins"] == 20
    assert [w["from"] for w in rows["one"]["wiring"]] == ["Pin 7 Unknown", "B power pins"]
    assert [w["from"] for w in rows["none"]["wiring"]] == ["Component power pins", "Component signal pins"]
    assert rows["one"]["warnings"] == [K.FEW_PINS] and rows["many"]["warnings"] == [K.NO_WARNING] and rows["many"]["power"] == [K.NO_VOLTAGE]


def test_card_lists(spark):
    facts = [("voltage", f"V{i}", str(i), "V" if i else None) for i in range(7)] + [("warning", "Caution", "hot", "")] * 2 + [("absolute_maximum", "x", "", ""), ("absolute_maximum", "x", None, "")] + [("warning", "Caution", f"w{i}", "") for i in range(5)]
    row = made(spark, [("d", "CNY17", "optocoupler", "wire it to an ARDUINO by GPIO", facts, None)], [("d", 1, "LED", "", 1), ("d", 2, "x", "", 1)]).first()
    assert [p["name"] for p in row["parts"]] == ["CNY17", "Arduino-compatible board", "Raspberry Pi or GPIO board", "Breadboard and jumpers", "Current-limiting resistors", "Power supply"]
    assert row["power"] == ["V0: 0", "V1: 1 V", "V2: 2 V", "V3: 3 V", "V4: 4 V"]
    assert row["checks"] == [*K.CHECKS, K.ISOLATED_CHECK]
    assert row["warnings"] == ["hot", "w0", "w1", "w2", "w3"]


def test_plan_rows(spark):
    sources = [("a", [2]), ("b", [3, 2])]
    cards = made(spark, [("d", "X", None, "", None, sources), ("e", "Y", None, "", None, [])], [("d", 1, "A", "", 3), ("d", 2, "B", "", 9), ("d", 3, "C", "", None), ("d", 4, "D", "", 2), ("d", 5, "E", "", -1)])
    rows = K.plan_rows(cards)
    steps = [tuple(r) for r in rows.where("doc = 'd' AND list = 'step'").select("ordinal", "kind", "source", "page").orderBy("ordinal").collect()]
    assert steps == [(1, "wiring", "b", 3), (2, "wiring", "a", 9), (3, "wiring", "a", None), (4, "wiring", "a", 2), (5, "wiring", "a", None), (6, "check", None, None), (7, "check", None, None), (8, "check", None, None), (9, "warning", None, None)]
    assert [r["ordinal"] for r in rows.where("doc = 'd' AND list = 'part'").orderBy("ordinal").collect()] == [1, 2, 3, 4]
    assert {r["source"] for r in rows.where("doc = 'e'").collect()} == {None}
    assert K.plan_rows(cards.limit(0)).count() == 0


def test_merged_facts(spark):
    local = [("d", 1, "voltage", "Supply", "5", "V"), ("d", 2, "voltage", "Supply", "5", "V"), *(("full", i, "package", "Package", f"P{i}", "") for i in range(1, 26))]
    new = [("d", 1, "VOLTAGE ", "supply", "5", "v"), ("d", 2, "color", "x", "red", ""), ("d", 3, "Current", " load  max ", "2", None), ("d", 4, "current", "LOAD MAX", "2", ""), ("d", 5, "warning", "", "x", ""), ("d", 6, "warning", "x", " ", ""), ("d", 7, "warning", "y" * 90, "z" * 200, "u" * 30), ("full", 1, "warning", "w", "1", ""), ("full", 2, "warning", "w", "2", ""), *(("new", i, "current", "c", str(i), "A") for i in range(40))]
    schema = "doc string, place int, " + FACT
    got = K.merged_facts(spark.createDataFrame(local, schema), spark.createDataFrame(new, schema)).collect()
    of = lambda d: sorted(tuple(r)[1:] for r in got if r["doc"] == d)
    assert of("d") == [(1, "voltage", "Supply", "5", "V", False), (2, "voltage", "Supply", "5", "V", False), (3, "current", "load max", "2", "", True), (4, "warning", "y" * 80, "z" * 180, "u" * 20, True)]
    assert len(of("full")) == 26 and of("full")[-1] == (26, "warning", "w", "1", "", True)
    assert [r[3] for r in of("new")] == [str(i) for i in range(24)]
