"""Rules on technical documents: part numbers, kinds of document, component types, facts and confidence, with SQL.

The tables hold invented prose, so the queries read sheets: one short text for each row of `part`, with the phrases the rules
look for. Rules read whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.lines import any_of, squeezed
from loomline.plans.registry import query
from loomline.sources.tables import table

# Patterns of part numbers, weights of markers, prefixes and words of component types.
PART_PATTERNS = [
    r"\bADS\d{3,5}[A-Z0-9-]*\b",
    r"\bESP32(?:-[A-Z0-9-]+)?\b",
    r"\b(?:L293D?|L298N?|L78\d{2}|L79\d{2}|ULN2003|ULN2803|A4988)\b",
    r"\b(?:MCP|PCA|PCF|SSD|BMP|BME|DHT|DS|MAX|LTC|ULN|TB|CP|CH|HX|DRV)\s?-?\d[A-Z0-9-]{1,12}\b",
    r"\b(?:NE|LM|TL|TLC|SN|CD|IRF|IRL|BC|2N|1N|ATMEGA|ATTINY)\s?-?\d[A-Z0-9-]{1,12}\b",
    r"\b(?:74HC|74HCT|74LS|74ALS|74LVC)\s?-?\d[A-Z0-9-]{1,8}\b",
    r"\b4N(?:25|26|27|28|32|33|35|36|37|38)\b",
    r"\b(?:NE|LM)?55[56]\b",
    r"\b(?:ATMEGA328P|RP2040|WS2812B)\b",
]
NAME_PATTERN = r"\b[A-Z]{1,8}\d[A-Z0-9]{2,18}\b"
TIMER_NAME = r"\b55[56]\s*(?:timer|timers|ic|chip|circuit)?\b"
NO_PARTS = ["NEEDS", "INPUT", "OUTPUT", "COMMON", "ABSOLUTE", "MAXIMUM", "EDITOR", "CHAPTER"]
NO_PART = r"^(DOCID|REV|DATE|TABLE|FIGURE|PAGE)|^DS0[0-9]{3,}$|^(19|20)[0-9]{2}$"
SHEET_MARKERS = {"datasheet": 18, "data sheet": 18, "pin configuration": 18, "pin configurations": 18, "pinout": 18, "pinouts": 18, "pin number": 16, "pin functions": 18, "pin descriptions": 18, "signal descriptions": 12, "terminal functions": 16, "absolute maximum ratings": 14, "electrical characteristics": 14, "recommended operating conditions": 12, "ordering information": 8, "package information": 8, "package dimensions": 8, "block diagram": 6}
BOOK_MARKERS = {"published by": 12, "isbn": 12, "foreword": 8, "chapter": 7, "editor": 7, "magazine": 7, "this book": 7, "all rights reserved": 6, "for dummies": 8, "for makers": 8, "hackspace": 6}
SCHEMATIC_MARKERS = ["schematic", "circuit diagram", "wiring diagram", "netlist"]
PROJECT_MARKERS = ["project", "build", "experiment", "breadboard", "parts list", "chapter"]
TYPE_STARTS = {
    "microcontroller": ["ESP32", "ATMEGA", "ATTINY", "RP2040"],
    "GPIO expander": ["MCP23", "PCF857", "PCA95"],
    "analog-to-digital converter": ["ADS", "MCP30", "MCP32"],
    "display controller": ["SSD13", "MAX72"],
    "sensor": ["BMP", "BME", "DHT", "DS18"],
    "motor driver": ["L293", "L298", "TB66", "DRV", "ULN", "A4988"],
    "voltage regulator": ["L78", "L79"],
    "logic IC": ["74HC", "74HCT", "74LS", "CD4", "SN74"],
    "timer": ["NE555", "LM555", "LM556", "NE556"],
    "optocoupler": ["4N"],
    "diode": ["1N"],
    "transistor": ["2N", "BC"],
    "mosfet": ["IRF", "IRL"],
}
TYPE_WORDS = {
    "optocoupler": ["optocoupler", "opto-coupler", "phototransistor", "isolation"],
    "timer": ["555", "556", "monostable", "astable", "timer"],
    "analog-to-digital converter": ["analog-to-digital", "adc", "a/d converter", "conversion register"],
    "display controller": ["oled", "display controller", "segment driver"],
    "sensor": ["pressure sensor", "temperature sensor", "humidity sensor", "sensor"],
    "microcontroller": ["microcontroller", "gpio", "pwm", "uart", "spi", "i2c"],
    "voltage regulator": ["voltage regulator", "linear regulator", "ldo"],
    "op amp": ["operational amplifier", "op amp", "op-amp"],
    "mosfet": ["mosfet", "gate", "drain", "source"],
    "transistor": ["transistor", "collector", "emitter", "base"],
    "logic IC": ["shift register", "logic", "flip-flop", "counter", "decoder"],
}
PACKAGE = r"(?i)\b(?:DIP|PDIP|SOIC|SOP|SOT-23|TO-92|TO-220|DIP-\d+|SO-\d+|DIP\d+)\b"
VOLTAGE_RANGE = r"(?i)\b(VCC|VDD|supply voltage|operating voltage|input voltage|output voltage)[^.\n]{0,90}?(-?\d+(?:\.\d+)?)[^\S\n]*V?[^\S\n]*(?:to|-|–)[^\S\n]*(-?\d+(?:\.\d+)?)[^\S\n]*V\b"
VOLTAGE = r"(?i)\b(supply voltage|operating voltage|collector-emitter voltage|forward voltage)[^.\n]{0,90}?(-?\d+(?:\.\d+)?)[^\S\n]*V\b"
CURRENT = r"(?i)\b(output current|forward current|supply current|collector current)[^.\n]{0,90}?(\d+(?:\.\d+)?)[^\S\n]*(mA|A|uA|µA)\b"
PLOT_WORDS = ["pulse duration", "relative to", "propagation delay", "voltage drop", "output low", "output high", "no load"]
WARNING_WORDS = ["do not exceed", "damage", "electrostatic", "esd", "derate"]
STRESS = r"(?i)\bStresses beyond[^.]{0,220}\."
LEGAL_WORDS = ["rohs", "disclaims responsibility", "warranty", "intellectual property", "orderable", "package option addendum", "value unit"]
FACT_CAPS = {"package": 6, "voltage": 5, "current": 4, "warning": 4}

# The same expressions are valid in Spark and in DuckDB.
_MODEL = "(CASE p_partkey % 6 WHEN 0 THEN 'NE' WHEN 1 THEN 'ADS' WHEN 2 THEN 'cd ' WHEN 3 THEN 'ESP32-' WHEN 4 THEN '2N' ELSE 'lot ' END || CAST(p_partkey % 1000 + 1000 AS STRING))"
_NAME = f"CASE WHEN p_partkey % 4 = 0 THEN 'datasheet_' || {_MODEL} WHEN p_partkey % 9 = 0 THEN '555 timer' ELSE p_brand END"
_SIZE = "CAST(p_size AS STRING)"
_TEXT = f"""concat_ws(chr(10), 'The ' || {_MODEL} || ' is a ' || p_name || '. See ' || {_MODEL} || '.',
  CASE WHEN p_size % 2 = 0 THEN 'Pin configuration, electrical characteristics and package dimensions of ' || {_MODEL} WHEN p_size % 7 = 1 THEN 'A 555 timer with a sensor' END,
  CASE WHEN p_size % 3 = 0 THEN 'Forward voltage and supply voltage: ' || CAST(p_size % 5 AS STRING) || ' V to ' || CAST(p_size % 9 + 4 AS STRING) || ' V' WHEN p_size % 3 = 1 THEN 'Operating voltage is ' || {_SIZE} || '.5 V' ELSE 'Forward voltage, no load, of 2 V' END,
  CASE WHEN p_size % 5 = 0 THEN 'Output current of ' || {_SIZE} || ' mA. Forward current up to 2 A' WHEN p_size % 5 = 1 THEN 'Supply voltage 5 V' END,
  CASE WHEN p_size % 7 = 0 THEN 'Keep dry. Do not exceed the ratings; damage may follow! Use in DIP-14 or soic cases' WHEN p_size % 7 = 2 THEN 'Stresses beyond these, and ESD, may cause damage. RoHS' END,
  CASE WHEN p_size % 11 = 0 THEN 'Chapter ' || {_SIZE} || ': this book, published by a magazine, ISBN 1' WHEN p_size % 11 = 1 THEN 'A wiring diagram' WHEN p_size % 11 = 2 THEN 'Parts list of the project' END)"""
_SHEETS = f"sheets AS (SELECT p_partkey AS doc_id, {_NAME} AS name, {_TEXT} AS text FROM part)"


def sheets(spark, sf_dir: str) -> DataFrame:
    """(doc_id, name, text): a sheet for each part."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(_NAME).alias("name"), F.expr(_TEXT).alias("text"))


def part_numbers(text: Column, patterns: list[str]) -> Column:
    """Part numbers in a text, in upper case and without blanks, one entry for each place."""
    found = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(0)) for p in patterns)))
    plain = F.transform(found, lambda x: F.upper(F.regexp_replace(x, r"[\s_-]+", "")))
    whole = F.transform(plain, lambda x: F.when(x == "555", "NE555").when(x == "556", "LM556").otherwise(x))
    return F.filter(whole, lambda x: (F.length(x) >= 3) & x.rlike("[0-9]") & ~x.isin(NO_PARTS) & ~x.rlike(NO_PART))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, value, n, in_name): part numbers of each document; one in the name counts two more, as does a 555 or 556 timer."""
    name = F.regexp_replace(F.coalesce("name", F.lit("")), "[_-]", " ")
    timer, text = name.rlike("(?i)" + TIMER_NAME), F.coalesce("text", F.lit(""))
    named = F.array_distinct(F.concat(part_numbers(name, [*PART_PATTERNS, NAME_PATTERN]), F.when(timer, F.array(F.lit("NE555"))).otherwise(F.array().cast("array<string>"))))
    named = F.array_distinct(F.concat(named, F.when(timer & name.rlike(r"\b556\b"), F.array(F.lit("LM556"))).otherwise(F.array().cast("array<string>"))))
    again = F.array_distinct(part_numbers(name, [*PART_PATTERNS, NAME_PATTERN]))
    timers = F.array_compact(F.array(*(F.when(timer | text.rlike(rf"(?i)\b{n}\s+timer\b"), value) for n, value in (("555", "NE555"), ("556", "LM556")) for _ in range(2))))
    rows = docs.select("doc_id", named.alias("named"), F.concat(part_numbers(F.concat(name, F.lit("\n"), text), PART_PATTERNS), again, again, timers).alias("found"))
    return rows.select("doc_id", "named", F.explode("found").alias("value")).groupBy("doc_id", "value").agg(F.count("*").alias("n"), F.max(F.array_contains("named", F.col("value"))).alias("in_name"))


def _found(x: str, patterns: list[str]) -> str:
    each = ", ".join(f"regexp_extract_all({x}, '{p}', 0, 'i')" for p in patterns)
    whole = f"list_transform(flatten([{each}]), lambda p: CASE upper(regexp_replace(p, '[\\s_-]+', '', 'g')) WHEN '555' THEN 'NE555' WHEN '556' THEN 'LM556' ELSE upper(regexp_replace(p, '[\\s_-]+', '', 'g')) END)"
    return f"list_filter({whole}, lambda p: length(p) >= 3 AND regexp_matches(p, '[0-9]') AND p NOT IN ({', '.join(repr(w) for w in NO_PARTS)}) AND NOT regexp_matches(p, '{NO_PART}'))"


def _has(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


_NAMED = _found("plain", [*PART_PATTERNS, NAME_PATTERN])
_CANDIDATES = f"""{_SHEETS}, p AS (SELECT *, regexp_replace(coalesce(name, ''), '[_-]', ' ', 'g') AS plain FROM sheets), t AS (SELECT *, regexp_matches(plain, '(?i){TIMER_NAME}') AS timer FROM p),
f AS (SELECT doc_id, list_distinct({_NAMED} || CASE WHEN timer THEN ['NE555'] ELSE [] END || CASE WHEN timer AND regexp_matches(plain, '\\b556\\b') THEN ['LM556'] ELSE [] END) AS named,
  {_found("plain || chr(10) || text", PART_PATTERNS)} || list_distinct({_NAMED}) || list_distinct({_NAMED}) || CASE WHEN timer OR regexp_matches(text, '(?i)\\b555\\s+timer\\b') THEN ['NE555', 'NE555'] ELSE [] END
  || CASE WHEN timer OR regexp_matches(text, '(?i)\\b556\\s+timer\\b') THEN ['LM556', 'LM556'] ELSE [] END AS found FROM t),
candidates AS (SELECT doc_id, value, count(*) AS n, bool_or(list_contains(named, value)) AS in_name FROM (SELECT doc_id, named, unnest(found) AS value FROM f) GROUP BY doc_id, value)"""


@query(f"WITH {_CANDIDATES} SELECT doc_id, value, n, in_name FROM candidates")
def component_candidates(spark, sf_dir):
    return candidates(sheets(spark, sf_dir))


def best_candidate(found: DataFrame) -> DataFrame:
    """(doc_id, component, in_name): the one in the name, then the most frequent, then the longest, then the last in the alphabet."""
    best = F.max(F.struct("in_name", "n", F.length("value").alias("size"), "value")).alias("b")
    return found.groupBy("doc_id").agg(best).select("doc_id", F.col("b.value").alias("component"), F.col("b.in_name").alias("in_name"))


def profiles(docs: DataFrame, **more: Column) -> DataFrame:
    """(doc_id, kind, confidence, component, component_type) of each document. What a text says is reduced to sums and flags before
    the join, so texts aren't shuffled; `more` names further columns made from a document."""
    low = F.lower(F.concat_ws("\n", "name", "text"))
    weigh = lambda markers: sum((F.when(F.contains(low, F.lit(m)), w).otherwise(0) for m, w in markers.items()), F.lit(0))
    in_name = F.when(any_of(F.lower(F.coalesce("name", F.lit(""))), ["datasheet", "data sheet"]), 20).otherwise(0)
    said = docs.select(
        "doc_id", (weigh(SHEET_MARKERS) + in_name).alias("plus"), weigh(BOOK_MARKERS).alias("minus"), any_of(low, SCHEMATIC_MARKERS).alias("schematic"), any_of(low, PROJECT_MARKERS).alias("project"),
        F.array(*(any_of(F.lower(F.coalesce("text", F.lit(""))), words) for words in TYPE_WORDS.values())).alias("words"), *(c.alias(k) for k, c in more.items()))
    rows = said.join(best_candidate(candidates(docs)), "doc_id", "left").withColumn("plus", F.col("plus") + F.when(F.col("in_name"), 20).when(F.col("component").isNotNull(), 10).otherwise(0))
    net = F.col("plus") - F.least("minus", F.lit(35))
    sheet = F.col("component").isNotNull() & (net >= 38)
    kind = F.when(sheet, "component_datasheet").when(F.col("schematic"), "schematic").when(F.col("project"), "project_or_reference").when(F.col("minus") > 0, "reference_book").otherwise("unknown")
    sure = F.when(sheet, F.round(F.least(F.lit(0.98), 0.45 + net / 100), 2)).when(F.col("schematic"), F.when(F.col("plus") > 0, 0.72).otherwise(0.62)).when(F.col("project"), 0.68).when(F.col("minus") > 0, 0.7).otherwise(0.35)
    component = F.when(sheet, F.col("component"))
    return rows.select("doc_id", kind.alias("kind"), sure.alias("confidence"), component.alias("component"), F.when(sheet, component_type(F.col("component"), F.col("words"))).alias("component_type"), *more)


def component_type(component: Column, words: Column) -> Column:
    """By the part number's start, or the first type of which the text (flags in `words`) or the number has a word."""
    out = F.when(F.lit(False), "")
    for kind, starts in TYPE_STARTS.items():
        for start in starts:
            out = out.when(F.startswith(component, F.lit(start)), kind)
    for i, (kind, found) in enumerate(TYPE_WORDS.items()):
        out = out.when(words[i] | any_of(F.lower(component), found), kind)
    return out.otherwise("component")


_LOW = "lower(concat_ws(chr(10), name, text))"
_WEIGH = lambda markers: " + ".join(f"CASE WHEN contains({_LOW}, '{m}') THEN {w} ELSE 0 END" for m, w in markers.items())
_TYPE = "CASE " + " ".join(f"WHEN starts_with(component, '{s}') THEN '{kind}'" for kind, starts in TYPE_STARTS.items() for s in starts) + " " + " ".join(f"WHEN {_has('lower(text)', w)} OR {_has('lower(component)', w)} THEN '{kind}'" for kind, w in TYPE_WORDS.items()) + " ELSE 'component' END"
_PROFILES = f"""{_CANDIDATES}, b AS (SELECT doc_id, value AS component, in_name FROM candidates QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY in_name DESC, n DESC, length(value) DESC, value DESC) = 1),
s AS (SELECT doc_id, text, component, {_WEIGH(SHEET_MARKERS)} + CASE WHEN {_has("lower(name)", ["datasheet", "data sheet"])} THEN 20 ELSE 0 END + CASE WHEN in_name THEN 20 WHEN component IS NOT NULL THEN 10 ELSE 0 END AS plus,
  {_WEIGH(BOOK_MARKERS)} AS minus, {_has(_LOW, SCHEMATIC_MARKERS)} AS schematic, {_has(_LOW, PROJECT_MARKERS)} AS project FROM sheets LEFT JOIN b USING (doc_id)),
n AS (SELECT *, component IS NOT NULL AND plus - least(minus, 35) >= 38 AS sheet FROM s),
profiles AS (SELECT doc_id, CASE WHEN sheet THEN 'component_datasheet' WHEN schematic THEN 'schematic' WHEN project THEN 'project_or_reference' WHEN minus > 0 THEN 'reference_book' ELSE 'unknown' END AS kind,
  CAST(CASE WHEN sheet THEN round(least(0.98, 0.45 + (plus - least(minus, 35)) / 100), 2) WHEN schematic THEN CASE WHEN plus > 0 THEN 0.72 ELSE 0.62 END WHEN project THEN 0.68 WHEN minus > 0 THEN 0.7 ELSE 0.35 END AS DOUBLE) AS confidence,
  CASE WHEN sheet THEN component END AS component, CASE WHEN sheet THEN {_TYPE} END AS component_type FROM n)"""


@query(f"WITH {_PROFILES} SELECT doc_id, kind, confidence, component, component_type FROM profiles")
def document_profiles(spark, sf_dir):
    return profiles(sheets(spark, sf_dir))


def facts(text: Column) -> Column:
    """Packages, voltages, currents and warnings of a text: an array of (type, label, value, unit), in the row. Ranges of voltage come before single
    ones; these don't count where they start inside a range, nor as supply where there is a range. Equal facts count once, at
    most FACT_CAPS of a type. Warnings are compared, and given, in lower case; a fact lies in one line."""
    group = lambda x, p, i: F.regexp_extract(x, p, i)
    fact = lambda kind, label, value, unit: F.struct(F.lit(kind).alias("type"), label.alias("label"), value.alias("value"), unit.alias("unit"))
    label = lambda x, p: F.upper(squeezed(group(x, p, 1)))
    packages = F.transform(F.regexp_extract_all(text, F.lit(PACKAGE), F.lit(0)), lambda x: fact("package", F.lit("Package"), F.upper(x), F.lit("")))
    spans = F.regexp_extract_all(text, F.lit(VOLTAGE_RANGE), F.lit(0))
    ranges = F.transform(spans, lambda x: fact("voltage", label(x, VOLTAGE_RANGE), F.concat_ws(" to ", group(x, VOLTAGE_RANGE, 2), group(x, VOLTAGE_RANGE, 3)), F.lit("V")))
    # no single voltage may start inside a range: its labels are broken there, in place
    hidden = F.array_join(F.zip_with(F.split(text, VOLTAGE_RANGE, -1), F.transform(spans, lambda x: F.regexp_replace(x, "(?i) voltage", "_voltage")), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    single = F.filter(F.regexp_extract_all(hidden, F.lit(VOLTAGE), F.lit(0)), lambda x: ~any_of(F.lower(x), PLOT_WORDS))
    singles = F.transform(single, lambda x: fact("voltage", label(x, VOLTAGE), group(x, VOLTAGE, 2), F.lit("V")))
    singles = F.filter(singles, lambda x: (F.size(spans) == 0) | ~x["label"].isin("SUPPLY VOLTAGE", "OPERATING VOLTAGE"))
    currents = F.transform(F.regexp_extract_all(text, F.lit(CURRENT), F.lit(0)), lambda x: fact("current", label(x, CURRENT), group(x, CURRENT, 2), group(x, CURRENT, 3)))

    def warning(line: Column) -> Column:
        said = F.filter(F.split(F.regexp_replace(line, r"([.!?])\s+", "$1\n"), "\n"), lambda s: any_of(F.lower(s), WARNING_WORDS))
        return F.coalesce(F.nullif(F.regexp_extract(line, STRESS, 0), F.lit("")), F.get(said, F.lit(0)))

    snippets = F.filter(F.transform(F.split(text, "\n"), lambda x: warning(squeezed(x))), lambda x: x.isNotNull() & ~any_of(F.lower(x), LEGAL_WORDS))
    warnings = F.transform(snippets, lambda x: fact("warning", F.lit("Caution"), F.lower(F.substring(x, 1, 180)), F.lit("")))
    return F.concat(*(F.slice(F.array_distinct(x), 1, FACT_CAPS[kind]) for kind, x in (("package", packages), ("voltage", F.concat(ranges, singles)), ("current", currents), ("warning", warnings))))


def _fact(x: str, kind: str, label: str, value: str, unit: str) -> str:
    return f"list_transform({x}, lambda x: {{'type': '{kind}', 'label': {label}, 'value': {value}, 'unit': {unit}}})"


_LABEL = lambda p: f"upper(trim(regexp_replace(regexp_extract(x, '{p}', 1), '\\s+', ' ', 'g')))"
_SNIPPET = f"""coalesce(nullif(regexp_extract(y, '{STRESS}', 0), ''), list_filter(string_split(regexp_replace(y, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda s: {_has('lower(s)', WARNING_WORDS)})[1])"""
_FACT_STEPS = f"""r AS (SELECT doc_id, text, regexp_extract_all(text, '{VOLTAGE_RANGE}', 0) AS spans, string_split_regex(text, '{VOLTAGE_RANGE}') AS pieces FROM sheets),
h AS (SELECT *, array_to_string(list_transform(range(1, len(pieces) + 1), lambda i: pieces[i] || coalesce(regexp_replace(spans[i], '(?i) voltage', '_voltage', 'g'), '')), '') AS hidden FROM r),
w AS (SELECT doc_id, {_fact(f"regexp_extract_all(text, '{PACKAGE}', 0)", "package", "'Package'", "upper(x)", "''")} AS packages,
  {_fact("spans", "voltage", _LABEL(VOLTAGE_RANGE), f"regexp_extract(x, '{VOLTAGE_RANGE}', 2) || ' to ' || regexp_extract(x, '{VOLTAGE_RANGE}', 3)", "'V'")} || list_filter(
  {_fact(f"list_filter(regexp_extract_all(hidden, '{VOLTAGE}', 0), lambda x: NOT {_has('lower(x)', PLOT_WORDS)})", "voltage", _LABEL(VOLTAGE), f"regexp_extract(x, '{VOLTAGE}', 2)", "'V'")}, lambda v: len(spans) = 0 OR v.label NOT IN ('SUPPLY VOLTAGE', 'OPERATING VOLTAGE')) AS voltages,
  {_fact(f"regexp_extract_all(text, '{CURRENT}', 0)", "current", _LABEL(CURRENT), f"regexp_extract(x, '{CURRENT}', 2)", f"regexp_extract(x, '{CURRENT}', 3)")} AS currents,
  {_fact(f"list_filter(list_transform(list_transform(string_split(text, chr(10)), lambda z: trim(regexp_replace(z, '{chr(92)}s+', ' ', 'g'))), lambda y: {_SNIPPET}), lambda x: x IS NOT NULL AND NOT {_has('lower(x)', LEGAL_WORDS)})", "warning", "'Caution'", "lower(substring(x, 1, 180))", "''")} AS warnings FROM h),
u AS (""" + " UNION ALL ".join(f"SELECT doc_id, {cap} AS cap, unnest({kind}s) AS f, generate_subscripts({kind}s, 1) AS i FROM w" for kind, cap in FACT_CAPS.items()) + """),
o AS (SELECT doc_id, f.type AS type, f.label AS label, f.value AS value, f.unit AS unit, any_value(cap) AS cap, min(i) AS i FROM u GROUP BY ALL),
facts AS (SELECT doc_id, type, row_number() OVER (PARTITION BY doc_id, type ORDER BY i) AS place, label, value, unit FROM o QUALIFY row_number() OVER (PARTITION BY doc_id, type ORDER BY i) <= cap)"""


@query(f"WITH {_SHEETS}, {_FACT_STEPS} SELECT doc_id, type, label, value, unit FROM facts")
def document_facts(spark, sf_dir):
    return sheets(spark, sf_dir).select("doc_id", F.inline(facts(F.col("text"))))


def confidence(component: Column, n_facts: Column, has_pins: Column) -> Column:
    """How sure what was extracted is: 0.35, more with a name, pins and facts, at most 0.97."""
    named, pins = F.when(component.isNotNull(), 0.15).otherwise(0.0), F.when(has_pins, 0.25).otherwise(0.0)
    return F.round(F.least(F.lit(0.97), 0.35 + named + pins + F.least(F.lit(0.25), n_facts * 0.03)), 2)


@query(f"""WITH {_PROFILES}, {_FACT_STEPS}, c AS (SELECT doc_id, component, doc_id % 3 = 0 AS pins, CAST((SELECT count(*) FROM facts WHERE facts.doc_id = profiles.doc_id) AS BIGINT) AS n_facts FROM profiles)
SELECT doc_id, component, n_facts, component IS NOT NULL AND (pins OR n_facts > 0) AS usable, round(least(0.97, 0.35::DOUBLE + CASE WHEN component IS NOT NULL THEN 0.15 ELSE 0 END + CASE WHEN pins THEN 0.25 ELSE 0 END + least(0.25, n_facts * 0.03))::DOUBLE, 2) AS confidence FROM c""")
def document_intelligence(spark, sf_dir):
    """What was found in each document: whether it can be used (a component, and facts or pins), and how sure it is."""
    pins, n = F.col("doc_id") % 3 == 0, F.col("n_facts")
    found = profiles(sheets(spark, sf_dir), n_facts=F.size(facts(F.col("text"))).cast("long"))
    return found.select("doc_id", "component", "n_facts", (F.col("component").isNotNull() & (pins | (n > 0))).alias("usable"), confidence(F.col("component"), n, pins).alias("confidence"))
