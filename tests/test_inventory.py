"""Inventory texts, merging in a batch and into the stock."""

import pytest

from loomline.plans import inventory_rules as R
from loomline.plans import registry

TEXTS = {
    "timers": "20x NE555\r\nbunch of 10k resistors",
    "each": "about 15 BMP150 BMP250 of each",
    "colors": "White LED X50\nYellow LED X 40; blue led, lots\n * led x3",
    "boards": "- 3 Pi 4\n• arduino uno chip\n2 arduino nano\n tons of 74HC00 logic",
    "merge": "2 LM555\n7 NE556 timers\n3 DS18B20\n0 ADS1115 pcs",
    "odd": " ; \n\n* \n have about 5 brass spacers, M3.\n5",
    "none": None,
}
STOCK = [("part-1", 1, "Resistor collection", "x", 4, None, "Old", ["resistor", "10 kohm resistor"]), ("part-2", 2, "Timer", "y", -3, "Box", " ", ["NE555"]), ("part-3", 3, "DS18B20  modules", "z", None, "", None, None), ("part-4", 4, "Other", "z", 1, None, None, ["Ne-555"])]


@pytest.fixture(scope="module")
def stock(spark):
    return spark.createDataFrame(STOCK, "id string, place int, name string, type string, quantity int, location string, notes string, aliases array<string>")


@pytest.fixture(scope="module")
def items(spark):
    return R.merged_items(R.import_items(spark.createDataFrame(list(TEXTS.items()), "doc string, text string")))


def test_items(items):
    got = {}
    for r in items.collect():
        got.setdefault(r.doc, {})[r.name] = r
    assert {d: {n: (r.type, r.quantity) for n, r in found.items()} for d, found in got.items()} == {
        "timers": {"LM555 and LM556 timer ICs": ("ic", 20), "Assorted resistors": ("resistor", 1)},
        "each": {"BMP150 modules": ("sensor", 15), "BMP250 modules": ("sensor", 15)},
        "colors": {"White LEDs": ("diode", 50), "Yellow LEDs": ("diode", 40), "Blue LEDs": ("diode", 1), "Assorted LEDs": ("diode", 3)},
        "boards": {"Raspberry Pi boards": ("board", 3), "ATmega328P bare Arduino ICs": ("ic", 1), "Arduino-compatible boards": ("board", 2), "Assorted logic ICs": ("ic", 100)},
        "merge": {"LM555 and LM556 timer ICs": ("ic", 7), "DS18B20 modules": ("sensor", 3), "ADS1115 modules": ("module", 1)},
        "odd": {"brass spacers, M3": ("component", 5), "Imported part": ("component", 5)},
    }
    assert got["timers"]["Assorted resistors"].warnings and got["timers"]["Assorted resistors"].confidence == 0.72
    assert got["each"]["BMP250 modules"].aliases == ["BMP250", "pressure sensor", "barometric pressure sensor", "barometer sensor", "i2c pressure sensor"] and got["each"]["BMP250 modules"].warnings
    assert got["colors"]["White LEDs"].aliases == ["led", "leds", "light emitting diode", "white led"] and got["colors"]["White LEDs"].confidence == 0.86
    assert got["merge"]["LM555 and LM556 timer ICs"].raw == "2 LM555 | 7 NE556 timers"
    assert got["odd"]["Imported part"].confidence == 0.45


def test_matching(items, stock):
    got = {(r.doc, r.name): (r.action, r.existing) for r in R.matched_items(items, stock).collect()}
    assert got["timers", "Assorted resistors"] == ("merge", "part-1")
    assert got["timers", "LM555 and LM556 timer ICs"] == ("merge", "part-2")  # "ne 555" of part-4 is another key
    assert got["merge", "DS18B20 modules"] == ("merge", "part-3")
    assert got["each", "BMP150 modules"] == ("create", None)


def test_applying(items, stock):
    saved = R.applied(R.matched_items(items, stock), stock).collect()
    got = {(r.doc, r.id): r for r in saved if r.id}
    assert (got["timers", "part-1"].quantity, got["timers", "part-1"].name, got["timers", "part-1"].location) == (5, "Resistor collection", "")
    assert got["timers", "part-1"].notes.startswith("Old\nResistor assortment.") and got["timers", "part-1"].aliases == sorted(set(got["timers", "part-1"].aliases)) and "10 kohm resistor" in got["timers", "part-1"].aliases
    assert (got["timers", "part-2"].quantity, got["timers", "part-2"].location) == (20, "Box")
    assert (got["merge", "part-3"].quantity, got["merge", "part-3"].type) == (3, "z")
    assert sum(r.id is None for r in saved) == 2 + 4 + 4 + 1 + 2
    assert R.applied(R.matched_items(items, stock), stock, most=1).count() == 6


def test_no_rows(spark, stock):
    none = R.merged_items(R.import_items(spark.createDataFrame([], "doc string, text string")))
    assert R.applied(R.matched_items(none, stock), stock).count() == 0


def test_a_stock_too_large_to_send_gives_the_same(items, stock, monkeypatch):
    found = lambda: sorted(map(str, R.applied(R.matched_items(items, stock).select(sorted(R.matched_items(items, stock).columns)), stock).collect()))
    sent = found()
    monkeypatch.setattr(R, "MOST_SENT", 0)
    assert sent == found()


@pytest.mark.parametrize("name", ["inventory_apply", "inventory_import"])
def test_lines_are_read_once(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("l_orderkey:bigint") == {"inventory_import": 1, "inventory_apply": 2}[name]  # parts and new items, of one plan each
