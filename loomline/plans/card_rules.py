"""Build cards: wiring from pins, notes from facts, the rows of a plan, and facts merged with repaired ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.plans import document_rules as D
from loomline.plans import pin_rules as P
from loomline.plans.registry import query
from loomline.sources.tables import table

# What cards say.
DESTINATIONS = [(["GND", "GROUND", "VSS"], [], "Ground rail"), (["VCC", "VDD", "VIN"], [], "Positive supply rail"), (["OUT"], ["OUTPUT"], "Load, MCU input, or next stage"), (["IN", "TRIG"], ["INPUT"], "Signal source or MCU output"), (["NC", "NO CONNECTION"], [], "Leave unconnected")]
OTHER_PIN, PIN_NOTE = "Use according to this pin function", "Confirm against the cited datasheet page before powering."
GAPS = [
    ("power", "Power rails after exact pinout is confirmed", "Pinout evidence is incomplete; identify exact power and ground pins from a datasheet before wiring."),
    ("signal", "Target circuit or controller after exact pinout is confirmed", "Pinout evidence is incomplete; do not connect signal pins until their functions are verified."),
]
BOARDS = [(["arduino"], "Arduino-compatible board", "Uses 5 V logic unless your board is 3.3 V."), (["raspberry", "gpio"], "Raspberry Pi or GPIO board", "GPIO is 3.3 V only.")]
ALWAYS = [("Breadboard and jumpers", "Keep power rails clear and labeled."), ("Current-limiting resistors", "Use for LEDs and optocoupler inputs."), ("Power supply", "Match the datasheet operating range.")]
NO_VOLTAGE = "Use the operating voltage from the cited datasheet before applying power."
CHECKS = ["Verify supply polarity before inserting the IC.", "Check continuity from each IC pin to its intended rail or signal.", "Power the circuit with current limiting for the first test."]
ISOLATED_CHECK, LED_CHECK = "Confirm whether the input and output grounds should stay isolated.", "Confirm every LED path has a current-limiting resistor."
ISOLATED_WARNING = "Isolation ratings depend on PCB spacing and package limits; do not use a breadboard for hazardous voltages."
FEW_PINS, NO_WARNING = "Pinout evidence is incomplete; verify every pin before wiring.", "Datasheet limits are not design targets; stay inside recommended operating conditions."
MOST_PINS, MOST_NOTES, LEAST_ROWS = 16, 5, 2
FACT_TYPES, MOST_FACTS = ["voltage", "current", "package", "warning", "absolute_maximum"], 24

WIRING = "array<struct<from:string,to:string,note:string,page:int>>"


def destination(function: Column) -> Column:
    """Where a pin of a function goes."""
    upper = F.upper(function)
    whens = [F.when(upper.isin(names) | F.exists(F.array(*map(F.lit, parts)).cast("array<string>"), lambda p: F.contains(upper, p)), to) for names, parts, to in DESTINATIONS]
    return F.coalesce(*whens, F.lit(OTHER_PIN))


def wired(components: DataFrame, pins: DataFrame) -> DataFrame:
    """components (doc, component, ...) with n_pins and wiring: a row for each of the first pins, and for what is not known of too few.

    pins are (doc, pin, label, function, page), as found: a component's pins lie in one row there already."""
    gathered = pins.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("pin", F.coalesce(F.nullif("function", F.lit("")), F.nullif("label", F.lit("")), F.lit("Unknown")).alias("said"), F.col("page").cast("int").alias("page")))).alias("_pins"))
    both = components.join(gathered, "doc", "left")
    named = lambda p: F.concat(F.lit("Pin "), p.pin.cast("string"), F.lit(" "), p.said)
    known = F.transform(F.slice("_pins", 1, MOST_PINS), lambda p: F.struct(named(p).alias("from"), destination(p.said).alias("to"), F.lit(PIN_NOTE).alias("note"), p.page.alias("page")))
    known = F.coalesce(known, F.array().cast(WIRING))
    name = F.coalesce(F.nullif("component", F.lit("")), F.lit("Component"))
    gaps = F.array(*(F.struct(F.concat(name, F.lit(f" {kind} pins")).alias("from"), F.lit(to).alias("to"), F.lit(note).alias("note"), F.lit(None).cast("int").alias("page")) for kind, to, note in GAPS))
    gaps = F.slice(gaps, F.lit(1), F.greatest(F.lit(0), LEAST_ROWS - F.size(known)))
    return both.withColumns({"n_pins": F.coalesce(F.size("_pins"), F.lit(0)), "wiring": F.concat(known, gaps)}).drop("_pins")


def carded(components: DataFrame) -> DataFrame:
    """Rows of wired (component, component_type, question, facts, n_pins, wiring) with the lists of a card: parts, power, checks,
    warnings. facts are an array of (type, label, value, unit)."""
    kind, lower = F.coalesce("component_type", F.lit("component")), F.lower(F.concat_ws(" ", "question", "component", "component_type"))
    part = lambda name, detail: F.struct(name.alias("name"), detail.alias("detail"))
    boards = [F.when(F.greatest(*(F.contains(lower, F.lit(w)) for w in words), F.lit(False)), part(F.lit(name), F.lit(detail))) for words, name, detail in BOARDS]
    parts = F.array_compact(F.array(part(F.coalesce("component", F.lit("component")), kind), *boards, *(part(F.lit(n), F.lit(d)) for n, d in ALWAYS)))
    facts = F.coalesce("facts", F.array().cast("array<struct<type:string,label:string,value:string,unit:string>>"))
    power = F.transform(F.filter(facts, lambda f: f.type == "voltage"), lambda f: F.trim(F.concat(f.label, F.lit(": "), f.value, F.lit(" "), F.coalesce(f.unit, F.lit("")))))
    isolated, leds = F.contains(kind, F.lit("optocoupler")), F.exists("wiring", lambda w: F.contains(w.to, F.lit("LED")) | F.contains(w.note, F.lit("LED")))
    checks = F.array_compact(F.array(*map(F.lit, CHECKS), F.when(isolated, ISOLATED_CHECK), F.when(leds, LED_CHECK)))
    warned = F.transform(F.filter(facts, lambda f: f.type.isin("warning", "absolute_maximum")), lambda f: F.coalesce(f.value, F.lit("")))
    warned = F.concat(warned, F.array_compact(F.array(F.when(isolated, ISOLATED_WARNING), F.when(F.col("n_pins") < 2, FEW_PINS))))
    warned = F.slice(F.filter(F.array_distinct(F.when(F.size(warned) == 0, F.array(F.lit(NO_WARNING))).otherwise(warned)), lambda x: x != ""), 1, MOST_NOTES)
    return components.withColumns({"parts": parts, "power": F.slice(F.when(F.size(power) == 0, F.array(F.lit(NO_VOLTAGE))).otherwise(power), 1, MOST_NOTES), "checks": checks, "warnings": warned})


def plan_rows(cards: DataFrame) -> DataFrame:
    """(doc, list, ordinal, kind, title, detail, note, source, page): cards as rows of a plan.

    Parts and power have ordinals of their own; wiring, checks and warnings share one, in this order. A wiring row's source is
    the first of the card's sources (source, pages) that has its page, else the first of all. Nothing is shuffled."""
    none = F.lit(None).cast("string")
    step = lambda kind, title, detail, note, source=none, page=F.lit(None).cast("int"): F.struct(F.lit(kind).alias("kind"), title.alias("title"), detail.alias("detail"), note.alias("note"), source.alias("source"), page.alias("page"))
    blank = F.lit("")

    def wire(row: Column, i: Column) -> Column:
        page = F.when(row.page > 0, row.page)
        source = F.coalesce(F.get(F.filter("sources", lambda s: F.array_contains(s.pages, page)), F.lit(0)).source, F.get("sources", F.lit(0)).source)
        return step("wiring", F.coalesce(F.nullif(row["from"], blank), F.concat(F.lit("Wiring step "), (i + 1).cast("string"))), F.coalesce(row.to, blank), F.coalesce(row.note, blank), source, page)

    say = lambda kind, title: lambda x: step(kind, F.lit(title), x, blank)
    lists = {
        "part": F.transform("parts", lambda p: step("part", F.coalesce(p["name"], blank), F.coalesce(p["detail"], blank), blank)),
        "power": F.transform("power", say("power", "")),
        "step": F.concat(F.transform("wiring", wire), F.transform("checks", say("check", "Verification")), F.transform("warnings", say("warning", "Caution"))),
    }
    of = lambda name, rows: F.transform(rows, lambda r, i: F.struct(F.lit(name).alias("list"), (i + 1).alias("ordinal"), r.alias("r")))
    return cards.select("doc", F.explode(F.concat(*(of(n, rows) for n, rows in lists.items()))).alias("x")).select("doc", "x.list", "x.ordinal", "x.r.*")


def merged_facts(local: DataFrame, repaired: DataFrame, most: int = MOST_FACTS) -> DataFrame:
    """(doc, place, type, label, value, unit, repaired): a document's facts, then repaired ones that it lacks.

    Both are (doc, place, type, label, value, unit). Facts are equal without regard to case; repaired ones are squeezed, need a known type, a
    label and a value, and are taken in order until a document has so many facts; known facts all stay, repeats too."""
    squeeze = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    names = ["type", "label", "value", "unit"]
    key = [F.lower(F.coalesce(c, F.lit(""))).alias(f"_{c}") for c in names]
    fresh = repaired.select("doc", "place", F.lower(squeeze("type")).alias("type"), *(squeeze(c).alias(c) for c in names[1:]))
    fresh = fresh.where(F.col("type").isin(FACT_TYPES) & (F.col("label") != "") & (F.col("value") != "")).select("*", *key)
    on = ["doc", *(f"_{c}" for c in names)]
    fresh = fresh.groupBy(*on).agg(F.min(F.struct("place", *names)).alias("f")).join(local.select("doc", *key).distinct(), on, "left_anti")
    known = local.groupBy("doc").agg(F.count("*").alias("_n"), F.max("place").alias("_last"))
    ranked = fresh.select("doc", "f.*").withColumn("_r", F.row_number().over(Window.partitionBy("doc").orderBy("place", *names))).where(F.col("_r") <= most)
    ranked = ranked.join(known, "doc", "left").where(F.col("_r") <= F.greatest(F.lit(1), most - F.coalesce("_n", F.lit(0))))
    added = ranked.select("doc", (F.coalesce("_last", F.lit(0)) + F.col("_r")).cast("long").alias("place"), "type", F.left("label", F.lit(80)).alias("label"), F.left("value", F.lit(180)).alias("value"), F.left("unit", F.lit(20)).alias("unit"), F.lit(True).alias("repaired"))
    return local.select("doc", F.col("place").cast("long").alias("place"), *names, F.lit(False).alias("repaired")).unionByName(added)


# Components are parts, with their sheets' facts; those over a size have a sheet of pins too.
SHEET_SIZE = 30
_KIND = "CASE p_partkey % 3 WHEN 0 THEN 'optocoupler' WHEN 1 THEN 'timer' END"
_QUESTION = "CASE p_size % 4 WHEN 0 THEN 'Wire it to an Arduino' WHEN 1 THEN 'Use GPIO of a Raspberry' ELSE 'Build it' END"


def cards(spark, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    pins = P.pinouts(P.pin_sheets(parts.where(F.col("p_size") > SHEET_SIZE)))
    facts = D.sheets(spark, sf_dir).select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("doc"), D.facts(F.col("text")).alias("facts"))
    page = F.transform(F.array(F.lit(1), F.lit(2)), lambda p: p.cast("int"))
    sources = F.array(F.struct(F.concat(F.lit("book of "), "p_brand").alias("source"), page.alias("pages")), F.struct(F.concat(F.lit("sheet of "), "p_name").alias("source"), F.array(F.lit(2), F.lit(3)).alias("pages")))
    components = parts.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("doc"), F.col("p_name").alias("component"), F.expr(_KIND).alias("component_type"), F.expr(_QUESTION).alias("question"), sources.alias("sources"))
    return carded(wired(components.join(facts, "doc"), pins))


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_CARDS = f"""{D._SHEETS}, {D._FACT_STEPS}, parts AS (SELECT p_partkey AS k, 'p' || p_partkey AS doc, p_name, p_brand, p_size, {_KIND} AS kind, lower({_QUESTION} || ' ' || p_name) AS said, CASE WHEN p_size > {SHEET_SIZE} THEN 4 + 2 * (p_partkey // 8 % 3) ELSE 0 END AS n FROM part),
pins AS (SELECT *, unnest(range(1, n + 1)) AS pin, k % 8 % 3 + 1 AS page FROM parts),
steps AS (SELECT doc, 1 AS part, pin AS i, 'wiring' AS kind, 'Pin ' || pin || ' ' || CASE pin WHEN 1 THEN 'Ground' WHEN 2 THEN 'VCC' ELSE 'S' || (p_size + pin) END AS title, CASE pin WHEN 1 THEN 'Ground rail' WHEN 2 THEN 'Positive supply rail' ELSE {_text(OTHER_PIN)} END AS detail, {_text(PIN_NOTE)} AS note, CASE WHEN page = 3 THEN 'sheet of ' || p_name ELSE 'book of ' || p_brand END AS source, page FROM pins
  UNION ALL SELECT doc, 1, g.i, 'wiring', p_name || ' ' || g.what || ' pins', g.goal, g.note, 'book of ' || p_brand, NULL FROM parts, (VALUES {', '.join(f"({i}, {_text(a)}, {_text(b)}, {_text(c)})" for i, (a, b, c) in enumerate(GAPS))}) AS g(i, what, goal, note) WHERE n = 0
  UNION ALL SELECT doc, 2, c.i, 'check', 'Verification', c.said, '', NULL, NULL FROM parts, (VALUES {', '.join(f"({i}, {_text(x)})" for i, x in enumerate([*CHECKS, ISOLATED_CHECK]))}) AS c(i, said) WHERE c.i < {len(CHECKS)} OR kind = 'optocoupler'
  UNION ALL SELECT doc, 3, i, 'warning', 'Caution', said, '', NULL, NULL FROM (SELECT doc, said, row_number() OVER (PARTITION BY doc ORDER BY min(i)) AS i FROM (SELECT 'p' || doc_id AS doc, value AS said, place AS i FROM facts WHERE type = 'warning'
    UNION ALL SELECT doc, {_text(ISOLATED_WARNING)}, 101 FROM parts WHERE kind = 'optocoupler' UNION ALL SELECT doc, {_text(FEW_PINS)}, 102 FROM parts WHERE n < 2
    UNION ALL SELECT doc, {_text(NO_WARNING)}, 103 FROM parts WHERE kind IS DISTINCT FROM 'optocoupler' AND n >= 2 AND k NOT IN (SELECT doc_id FROM facts WHERE type = 'warning')) GROUP BY doc, said) WHERE i <= {MOST_NOTES}),
notes AS (SELECT 'p' || doc_id AS doc, place AS i, trim(label || ': ' || value || ' ' || unit) AS said FROM facts WHERE type = 'voltage' UNION ALL SELECT doc, 1, {_text(NO_VOLTAGE)} FROM parts WHERE k NOT IN (SELECT doc_id FROM facts WHERE type = 'voltage')),
needs AS (SELECT doc, 0 AS i, p_name AS name, coalesce(kind, 'component') AS detail FROM parts UNION ALL SELECT doc, 1, {_text(BOARDS[0][1])}, {_text(BOARDS[0][2])} FROM parts WHERE contains(said, 'arduino') UNION ALL SELECT doc, 2, {_text(BOARDS[1][1])}, {_text(BOARDS[1][2])} FROM parts WHERE contains(said, 'gpio')
  UNION ALL SELECT doc, 3 + a.i, a.name, a.detail FROM parts, (VALUES {', '.join(f"({i}, {_text(n)}, {_text(d)})" for i, (n, d) in enumerate(ALWAYS))}) AS a(i, name, detail))"""


@query(f"""WITH {_CARDS} SELECT doc, 'step' AS list, CAST(row_number() OVER (PARTITION BY doc ORDER BY part, i) AS INTEGER) AS ordinal, kind, title, detail, note, source, CAST(page AS INTEGER) AS page FROM steps
UNION ALL SELECT doc, 'power', CAST(i AS INTEGER), 'power', '', said, '', NULL, NULL FROM notes WHERE i <= {MOST_NOTES} UNION ALL SELECT doc, 'part', CAST(row_number() OVER (PARTITION BY doc ORDER BY i) AS INTEGER), 'part', name, detail, '', NULL, NULL FROM needs""")
def build_plans(spark, sf_dir):
    """The rows of a plan for each part: what it needs, its power, and its steps, from the pins and facts of its sheets."""
    return plan_rows(cards(spark, sf_dir))


def repairs(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(known, repaired) facts: those of the sheets, and order lines as facts of their parts."""
    known = D.sheets(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.posexplode(D.facts(F.col("text"))).alias("place", "f")).select("doc", (F.col("place") + 1).cast("long").alias("place"), "f.*")
    return known, table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("doc"), F.expr("l_orderkey * 10 + l_linenumber AS place"), *(F.expr(f"{e} AS {n}") for n, e in _REPAIRED.items()))


# The same expressions are valid in Spark and in DuckDB.
_REPAIRED = {
    "type": "CASE l_linenumber WHEN 1 THEN ' Voltage' WHEN 2 THEN 'CURRENT' WHEN 3 THEN 'warning' WHEN 4 THEN 'package' WHEN 5 THEN 'absolute_maximum' ELSE 'color' END",
    "label": "CASE WHEN l_linenumber = 1 THEN 'supply  voltage' WHEN l_quantity > 48 THEN ' ' ELSE 'label ' || l_returnflag END",
    "value": "CASE WHEN l_linenumber = 1 THEN '5' WHEN l_quantity > 46 THEN NULL ELSE l_linestatus || '  ' || CAST(CAST(l_quantity AS INT) AS STRING) END",
    "unit": "CASE WHEN l_linenumber = 1 THEN 'v' WHEN l_linenumber = 2 THEN 'mA' END",
}


@query(f"""WITH {D._SHEETS}, {D._FACT_STEPS}, k AS (SELECT doc_id AS doc, row_number() OVER (PARTITION BY doc_id ORDER BY CASE type WHEN 'package' THEN 1 WHEN 'voltage' THEN 2 WHEN 'current' THEN 3 ELSE 4 END, place) AS place, type, label, value, unit FROM facts),
q AS (SELECT l_partkey AS doc, l_orderkey * 10 + l_linenumber AS place, {', '.join(f"{'lower(' if n == 'type' else '('}trim(regexp_replace(coalesce({e}, ''), '\\s+', ' ', 'g'))) AS {n}" for n, e in _REPAIRED.items())} FROM lineitem),
f AS (SELECT doc, min(struct_pack(place, type, label, value, unit)) AS f FROM q WHERE type <> 'color' AND label <> '' AND value <> '' AND NOT EXISTS (SELECT 1 FROM k WHERE k.doc = q.doc AND k.type = q.type AND lower(k.label) = lower(q.label) AND lower(k.value) = lower(q.value) AND lower(k.unit) = lower(q.unit)) GROUP BY doc, type, lower(label), lower(value), lower(unit)),
n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY f) AS r, (SELECT count(*) FROM k WHERE k.doc = f.doc) AS known FROM f)
SELECT doc, place, type, label, value, unit, false AS repaired FROM k UNION ALL SELECT doc, known + r, f.type, left(f.label, 80), left(f.value, 180), left(f.unit, 20), true FROM n WHERE r <= greatest(1, {MOST_FACTS} - known)""")
def repaired_facts(spark, sf_dir):
    return merged_facts(*repairs(spark, sf_dir))
