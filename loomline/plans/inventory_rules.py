"""Inventory from free text: lines, quantities, families of parts, merging within a batch and into the stock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.lines import let, squeezed
from loomline.plans.finder import plain
from loomline.plans.registry import query
from loomline.sources.tables import table

# The quantity grammar, model numbers, families with names, types, aliases and notes, kinds of models.
QUANTITY = r"(?i)\b(?:about|around|approx(?:imately)?|~)?\s*(?:x\s*)?([0-9]{1,5})\s*(?:x|pcs?|pieces?|count|qty|of each)?\b"
MODEL = r"\b[A-Za-z]{1,8}[0-9]{2,5}[A-Za-z0-9-]*\b"
HUNDRED, UNCOUNTED, COLLECTION = "tons|hundreds|100s|100;s", "bunch|collection|assortment|many|lots", r"(?i)\b(bunch|collection|assortment|many|lots|good collection)\b"
COUNT_WORDS = r"(?i)\b(?:have|i have|about|around|approx(?:imately)?|x?\s*[0-9]+\s*x?)\b"
COLORS = ["white", "yellow", "blue", "red", "green", "orange", "amber", "rgb"]
#: Patterns that must all be found, name, type, aliases, notes.
FAMILIES = [
    (["resistor"], "Assorted resistors", "resistor", ["resistor", "resistors", "through-hole resistor", "assorted resistor values", "10 ohm resistor", "100 ohm resistor", "220 ohm resistor", "330 ohm resistor", "470 ohm resistor", "1 kohm resistor", "10 kohm resistor", "100 kohm resistor"], "Resistor assortment. Verify power rating, tolerance, and voltage rating before use."),
    (["capacitor|caps|cap( |$)"], "Assorted capacitors", "capacitor", ["capacitor", "capacitors", "ceramic capacitor", "electrolytic capacitor", "film capacitor", "metallized film capacitor", "decoupling capacitor", "bypass capacitor", "0.1 uf capacitor", "100 nf capacitor", "10 uf capacitor", "timing capacitor"], "Capacitor assortment. Verify voltage rating, polarity, ESR, and tolerance before use."),
    (["diode"], "Assorted diodes", "diode", ["diode", "diodes", "rectifier diode", "signal diode", "switching diode", "zener diode", "schottky diode", "flyback diode", "1n4148", "1n4007"], "Diode assortment. Verify current, reverse voltage, speed, and polarity before use."),
    (["led"], "Assorted LEDs", "diode", ["led", "leds", "light emitting diode"], "LED inventory. Verify forward voltage, current limit resistor, package size, and polarity before use."),
    ([r"raspberry|raspi|\brpi\b|\bpi\s*[45]\b"], "Raspberry Pi boards", "board", ["raspberry pi", "raspi", "rpi", "raspberry pi 4", "pi 4", "raspberry pi 5", "pi 5", "gpio board", "sbc", "3.3v gpio"], "Raspberry Pi boards. GPIO is 3.3 V logic only."),
    (["arduino", "bare|ic|chip"], "ATmega328P bare Arduino ICs", "ic", ["atmega328p", "atmega328", "arduino bare ic", "arduino uno chip", "arduino bootloader chip", "avr microcontroller", "base arduino ic"], "Bare Arduino-compatible microcontrollers. Verify package, clock, and bootloader."),
    (["arduino"], "Arduino-compatible boards", "board", ["arduino", "arduino uno", "arduino nano", "microcontroller board", "5v arduino"], "Arduino-compatible development boards."),
    ([r"\b(?:lm|ne)?55[56]\b"], "LM555 and LM556 timer ICs", "ic", ["lm555", "ne555", "555", "555 timer", "lm556", "ne556", "556 timer", "dual 555 timer", "astable timer", "monostable timer"], "555/556 timer IC collection. Verify exact package and supply-voltage range."),
    ([r"logic|\b(?:74hc|74ls|74xx|cd4000|4000 series)\b"], "Assorted logic ICs", "ic", ["logic chip", "logic ic", "digital logic", "ttl logic", "cmos logic", "74xx", "74hc", "74ls", "4000 series", "and gate", "or gate", "not gate", "nand gate", "flip flop", "counter ic", "shift register"], "Digital logic IC collection. Verify family, voltage range, package, and pinout."),
    ([r"\b128\s*x?\s*32\b|oled.*display|display.*oled"], "128x32 LED/OLED display modules", "display", ["128x32 display", "128 32 display", "128x32 oled", "oled display", "led screen", "i2c display", "spi display", "ssd1306"], "128x32 display modules. Verify interface, voltage, and controller IC."),
]
LED, BARE = 3, 5
MOST_SENT = 500_000  # rows of a stock that are broadcast
MODEL_TYPES = {"sensor": "^(BMP|BME|DHT|DS18|MPU)", "ic": "^(ATMEGA|ATTINY|PIC|LM|NE|TL|CD|74)"}
MODEL_ALIASES = {"^BMP": ["pressure sensor", "barometric pressure sensor", "barometer sensor", "i2c pressure sensor"], "^ADS": ["adc", "analog to digital converter", "i2c adc"]}
RARE_MODELS = ["BMP250", "BMP150"]
WARN_BARE = "Assumed base Arduino bare IC is ATmega328P/Arduino Uno class; confirm the marking and bootloader."
WARN_RARE = " is less common in hobby modules than BMP180/BMP280/BME280; confirm the part marking."
WARN_LOW = "Low-confidence import; review name, type, aliases, and quantity before approval."
WARN_COUNT = "Quantity treated as a collection marker because the line did not include an exact count."
IMPORTED = "Imported from free-form inventory line: "


def _strings(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def once(texts: Column) -> Column:
    """Trimmed texts that are not empty, each once in any case, in the order they appear."""
    cut = F.filter(F.transform(texts, lambda x: F.trim(x)), lambda x: x != "")
    return let(cut, lambda c: let(F.transform(c, lambda x: F.lower(x)), lambda low: F.filter(c, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)))


def inventory_lines(texts: DataFrame) -> DataFrame:
    """(doc, line, raw): parts between line ends and semicolons, without bullets."""
    cut = F.transform(F.split(F.replace("text", F.lit("\r"), F.lit("\n")), "[\n;]"), lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s*[-*•]\s*", ""), r"^\s+|\s+$", ""))
    return texts.select("doc", F.posexplode(cut).alias("line", "raw")).where("raw <> ''")


def quantity(raw: Column) -> Column:
    """100 for words of hundreds, 1 for those of a collection, else the first number, 1 at least."""
    low, number = F.lower(raw), F.regexp_extract(raw, QUANTITY, 1)
    return F.when(low.rlike(HUNDRED), 100).when(low.rlike(UNCOUNTED) | (number == ""), 1).otherwise(F.greatest(F.lit(1), number.try_cast("int")))


def import_items(texts: DataFrame) -> DataFrame:
    """(doc, line, part, raw, name, type, quantity, aliases, warnings, confidence, notes): an item a line, or one for each model
    of a line that says "of each"."""
    rows = inventory_lines(texts).withColumns({"quantity": quantity(F.col("raw")), "models": F.regexp_extract_all("raw", F.lit(MODEL), F.lit(0))})
    each = F.contains(F.lower("raw"), F.lit("of each")) & (F.size("models") > 1)
    rows = rows.select("doc", "line", "raw", "quantity", F.posexplode(F.when(each, F.transform("models", lambda m: F.upper(m))).otherwise(F.array("raw"))).alias("part", "text"))
    rows = rows.withColumns({"low": F.lower("text"), "model": F.upper(F.regexp_extract("text", MODEL, 0))})
    found = lambda patterns: F.expr(" AND ".join(["true"] + ["low RLIKE '" + p.replace("\\", "\\\\") + "'" for p in patterns]))
    family = F.coalesce(*(F.when(found(f[0]), i) for i, f in enumerate(FAMILIES)), F.when(F.col("model") != "", len(FAMILIES)), F.lit(len(FAMILIES) + 1))
    shown = F.substring(F.btrim(squeezed(F.regexp_replace("text", COUNT_WORDS, " ")), F.lit(" ,.-")), 1, 80)
    color = F.coalesce(*(F.when(F.col("low").rlike(rf"\b{c}\b"), c) for c in COLORS))
    rows = rows.withColumns({"family": family, "shown": F.when(shown == "", "Imported part").otherwise(shown), "color": color})
    model, at, led = F.col("model"), F.col("family"), F.col("family") == LED
    of = lambda own, by_model, plain: F.coalesce(F.get(F.array(*own), at), F.when(at == len(FAMILIES), by_model).otherwise(plain))
    name = F.when(led & F.col("color").isNotNull(), F.concat(F.initcap("color"), F.lit(" LEDs"))).otherwise(of([F.lit(f[1]) for f in FAMILIES], F.concat(model, F.lit(" modules")), F.col("shown")))
    kind = of([F.lit(f[2]) for f in FAMILIES], F.coalesce(*(F.when(model.rlike(p), k) for k, p in MODEL_TYPES.items()), F.lit("module")), F.lit("component"))
    more = F.coalesce(*(F.when(model.rlike(p), _strings(words)) for p, words in MODEL_ALIASES.items()), _strings([]))
    aliases = F.concat(of([_strings(f[3]) for f in FAMILIES], F.concat(F.array(model), more), F.array("shown")), F.when(led & F.col("color").isNotNull(), F.array(F.concat("color", F.lit(" led")))).otherwise(_strings([])))
    warned = F.array_compact(F.array(F.when(at == BARE, WARN_BARE), F.when((at == len(FAMILIES)) & model.isin(RARE_MODELS), F.concat(model, F.lit(WARN_RARE))), F.when(at > len(FAMILIES), WARN_LOW), F.when((F.col("quantity") == 1) & F.col("raw").rlike(COLLECTION), WARN_COUNT)))
    notes = of([F.lit(f[4]) for f in FAMILIES], F.concat(F.lit(IMPORTED), "raw"), F.concat(F.lit(IMPORTED), "raw"))
    rows = rows.select("doc", "line", "part", "raw", name.alias("name"), kind.alias("type"), "quantity", once(aliases).alias("aliases"), warned.alias("warnings"), at.alias("family"), notes.alias("notes"))
    sure = F.when(F.col("family") > len(FAMILIES), 0.45).otherwise(0.86)
    return rows.select("*", F.when(F.size("warnings") > 0, F.least(sure, F.lit(0.72))).otherwise(sure).alias("confidence")).drop("family")


def merged_items(items: DataFrame) -> DataFrame:
    """One item for each normalized name of a text: the first one's, with the largest quantity and all aliases, warnings and lines."""
    place = F.struct("line", "part")
    all_of = lambda c: F.transform(F.sort_array(F.collect_list(F.struct(place.alias("at"), F.col(c).alias("x")))), lambda v: v.x)
    first = F.min(F.struct("line", "part", "name", "type", "notes", "confidence")).alias("first")
    grouped = items.groupBy("doc", plain(F.col("name")).alias("normalized")).agg(first, F.max("quantity").alias("quantity"), all_of("aliases").alias("aliases"), all_of("warnings").alias("warnings"), all_of("raw").alias("raws"))
    return grouped.select("doc", "first.line", "first.part", "normalized", "first.name", "first.type", "quantity", once(F.flatten("aliases")).alias("aliases"), once(F.flatten("warnings")).alias("warnings"), F.array_join("raws", " | ").alias("raw"), "first.notes", "first.confidence")


def matched_items(items: DataFrame, stock: DataFrame) -> DataFrame:
    """merged items with the part (id, name, aliases, ordered by place) that they go into: by name, else by their first alias that
    the stock knows. Of parts with one key, an alias counts before a name, and a later part before an earlier one."""
    keys = stock.select("id", "place", F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", _strings([])))).alias("nth", "key"))
    index = keys.groupBy(plain(F.col("key")).alias("key")).agg(F.max_by("id", F.struct(F.col("nth") > 0, "place", "nth")).alias("id"))
    asked = F.posexplode(F.concat(F.array("normalized"), F.transform("aliases", plain))).alias("nth", "key")
    if _few(index):  # then items stay where they are: one row of an item holds it, others hold a hit
        met = items.select(F.struct("*").alias("item"), asked).join(F.broadcast(index), "key", "left").where("nth = 0 OR id IS NOT NULL")
        met = met.select("item.doc", "item.normalized", F.when(F.col("nth") == 0, F.col("item")).alias("item"), F.when(F.col("id").isNotNull(), F.col("nth")).alias("nth"), "id")
        rows = met.groupBy("doc", "normalized").agg(F.first("item", ignorenulls=True).alias("item"), F.min_by("id", "nth").alias("existing")).select("item.*", "existing")
    else:
        hit = items.select("doc", "normalized", asked).join(index, "key").groupBy("doc", "normalized").agg(F.min_by("id", "nth").alias("existing"))
        rows = items.join(hit, ["doc", "normalized"], "left")
    return rows.withColumn("action", F.when(F.col("existing").isNotNull(), "merge").otherwise("create"))


def _few(rows: DataFrame) -> bool:
    """Whether rows of a stock are few enough to be sent to every task, where no part that many items go into makes one task long."""
    return rows.count() <= MOST_SENT


def applied(items: DataFrame, stock: DataFrame, most: int = 200) -> DataFrame:
    """(doc, id, name, type, quantity, location, notes, aliases): what a text's first `most` items save. A part keeps its name,
    type and location, its quantity grows, notes are joined by lines, aliases are a sorted union; of two items for one part the
    last one counts. New items have no id yet."""
    nth = F.row_number().over(Window.partitionBy("doc").orderBy("line", "part"))
    kept = items.withColumn("_nth", nth).where(F.col("_nth") <= most)
    last = F.row_number().over(Window.partitionBy("doc", "existing").orderBy(F.desc("_nth")))
    old = kept.where("existing IS NOT NULL").withColumn("_last", last).where("_last = 1").alias("i").join((F.broadcast(stock) if _few(stock) else stock).alias("s"), F.col("existing") == F.col("id"))
    notes = F.concat_ws("\n", *(F.when(F.trim(c) != "", F.col(c)) for c in ("s.notes", "i.notes")))
    both = F.array_sort(F.array_distinct(F.concat(F.coalesce("s.aliases", _strings([])), "i.aliases")))
    grown = F.greatest(F.lit(0), F.coalesce("s.quantity", F.lit(0))) + F.greatest(F.lit(0), "i.quantity")
    merged = old.select("doc", "id", "s.name", "s.type", grown.alias("quantity"), F.coalesce("s.location", F.lit("")).alias("location"), notes.alias("notes"), both.alias("aliases"))
    new = kept.where("existing IS NULL").select("doc", F.lit(None).cast(stock.schema["id"].dataType).alias("id"), "name", "type", "quantity", F.lit("").alias("location"), "notes", "aliases")
    return merged.unionByName(new)


LINE = "CASE l_partkey % 14 WHEN 0 THEN concat(q, 'x NE555') WHEN 1 THEN 'bunch of 10k resistors' WHEN 2 THEN concat('about ', q, ' BMP150 BMP250 of each') WHEN 3 THEN concat('White LED X', q) WHEN 4 THEN concat(' - ', q, ' pcs ceramic cap') WHEN 5 THEN concat('raspi ', q) WHEN 6 THEN concat('arduino bare chip x ', q) WHEN 7 THEN concat(q, ' Arduino Nano') WHEN 8 THEN '74HC00 logic, lots' WHEN 9 THEN concat('128x32 display ', q) WHEN 10 THEN concat('ADS1115 ', q, ' pieces') WHEN 11 THEN concat('have about ', q, ' ', p_name) WHEN 12 THEN 'tons of 1N4148 diodes' ELSE concat('ATmega328 count ', q) END"
PART = ["concat('part-', s_suppkey) AS id", "s_suppkey AS place", "CASE s_suppkey % 5 WHEN 0 THEN 'Resistor collection' WHEN 1 THEN 'BMP150 modules' WHEN 2 THEN s_name WHEN 3 THEN 'Arduino-compatible boards' ELSE 'Timers' END AS name", "'stock' AS type", "CAST(s_suppkey % 9 AS INT) AS quantity", "CASE WHEN s_suppkey % 2 = 0 THEN 'Shelf' END AS location", "CASE WHEN s_suppkey % 3 = 0 THEN 'Old note' ELSE ' ' END AS notes"]
ALIASES = {0: ["resistor", "10 kohm resistor"], 1: ["pressure sensor"], 3: ["Arduino", "uno"], 4: ["555", "LM555"]}


def _inventory(spark, sf_dir):
    """Texts of one line for each line of an order; and a part of the stock for each supplier."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey").withColumn("q", F.col("l_quantity").cast("int"))
    said = items.select(F.col("l_orderkey").alias("doc"), F.struct("l_linenumber", "l_partkey", "q").alias("at"), F.expr(LINE).alias("said"))
    texts = said.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "said"))), lambda x: x.said), ";").alias("text"))
    aliases = F.coalesce(*(F.when(F.col("place") % 5 == k, _strings(words)) for k, words in ALIASES.items()), _strings([]))
    return texts, table(spark, sf_dir, "supplier").selectExpr(*PART).withColumn("aliases", aliases)


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]::VARCHAR[]"


def _plain(x: str) -> str:
    return f"trim(regexp_replace(lower(replace(replace(replace({x}, 'µ', 'u'), 'Ω', 'ohm'), 'ω', 'ohm')), '[^a-z0-9]+', ' ', 'g'))"


def _once(x: str) -> str:
    return f"list_filter({x}, lambda v, i: v <> '' AND list_position(list_transform({x}, lambda w: lower(w)), lower(v)) = i)"


def _of(i: int, by_model: str, plain_text: str, lit=lambda x: "'" + x.replace("'", "''") + "'") -> str:
    return f"CASE WHEN family < {len(FAMILIES)} THEN [{', '.join(lit(f[i]) for f in FAMILIES)}][family + 1] WHEN family = {len(FAMILIES)} THEN {by_model} ELSE {plain_text} END"


_FAMILY = "CASE " + " ".join("WHEN " + " AND ".join(f"regexp_matches(low, '{p}')" for p in f[0]) + f" THEN {i}" for i, f in enumerate(FAMILIES)) + f" WHEN model <> '' THEN {len(FAMILIES)} ELSE {len(FAMILIES) + 1} END"
_COLOR = "CASE " + " ".join(f"WHEN regexp_matches(low, '\\b{c}\\b') THEN '{c}'" for c in COLORS) + " END"
_MORE = "CASE " + " ".join(f"WHEN regexp_matches(model, '{p}') THEN {_list(w)}" for p, w in MODEL_ALIASES.items()) + " ELSE [] END"
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(model, '{p}') THEN '{k}'" for k, p in MODEL_TYPES.items()) + " ELSE 'module' END"
_ITEMS = rf"""said AS (SELECT l_orderkey AS doc, string_agg({LINE}, ';' ORDER BY l_linenumber, l_partkey, q) AS text FROM (SELECT *, CAST(l_quantity AS INTEGER) AS q FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY 1),
cut AS (SELECT doc, generate_subscripts(l, 1) - 1 AS line, unnest(l) AS raw FROM (SELECT doc, list_transform(string_split(text, ';'), lambda x: trim(regexp_replace(x, '^\s*[-*•]\s*', ''))) AS l FROM said)),
counted AS (SELECT *, regexp_extract_all(raw, '{MODEL}') AS models, CASE WHEN regexp_matches(lower(raw), '{HUNDRED}') THEN 100 WHEN regexp_matches(lower(raw), '{UNCOUNTED}') THEN 1 ELSE greatest(1, coalesce(TRY_CAST(regexp_extract(raw, '{QUANTITY}', 1) AS INTEGER), 1)) END AS quantity FROM cut WHERE raw <> ''),
texts AS (SELECT doc, line, raw, quantity, generate_subscripts(t, 1) - 1 AS part, unnest(t) AS text FROM (SELECT *, CASE WHEN contains(lower(raw), 'of each') AND len(models) > 1 THEN list_transform(models, lambda m: upper(m)) ELSE [raw] END AS t FROM counted)),
known AS (SELECT *, {_FAMILY} AS family, {_COLOR} AS color, coalesce(nullif(substr(trim(trim(regexp_replace(regexp_replace(text, '{COUNT_WORDS}', ' ', 'g'), '\s+', ' ', 'g')), ' ,.-'), 1, 80), ''), 'Imported part') AS shown FROM (SELECT *, lower(text) AS low, upper(regexp_extract(text, '{MODEL}')) AS model FROM texts)),
items AS (SELECT doc, line, part, raw, quantity, CASE WHEN family = {LED} AND color IS NOT NULL THEN upper(color[1]) || color[2:] || ' LEDs' ELSE {_of(1, "model || ' modules'", "shown")} END AS name, {_of(2, _KIND, "'component'")} AS type,
  list_concat({_of(3, f"list_concat([model], {_MORE})", "[shown]", _list)}, CASE WHEN family = {LED} AND color IS NOT NULL THEN [color || ' led'] ELSE [] END) AS aliases, {_of(4, f"'{IMPORTED}' || raw", f"'{IMPORTED}' || raw")} AS notes,
  list_filter([CASE WHEN family = {BARE} THEN '{WARN_BARE}' END, CASE WHEN family = {len(FAMILIES)} AND model IN ('BMP250', 'BMP150') THEN model || '{WARN_RARE}' END, CASE WHEN family > {len(FAMILIES)} THEN '{WARN_LOW}' END, CASE WHEN quantity = 1 AND regexp_matches(raw, '{COLLECTION}') THEN '{WARN_COUNT}' END], lambda w: w IS NOT NULL) AS warnings,
  CASE WHEN family > {len(FAMILIES)} THEN 0.45::DOUBLE WHEN len(warnings) > 0 THEN 0.72::DOUBLE ELSE 0.86::DOUBLE END AS confidence FROM known),
grouped AS (SELECT doc, {_plain('name')} AS normalized, min({{'line': line, 'part': part, 'name': name, 'type': type, 'notes': notes, 'confidence': confidence}}) AS f, max(quantity) AS quantity, flatten(list(aliases ORDER BY line, part)) AS aliases, flatten(list(warnings ORDER BY line, part)) AS warnings, string_agg(raw, ' | ' ORDER BY line, part) AS raw FROM items GROUP BY ALL),
merged AS (SELECT doc, f.line AS line, f.part AS part, normalized, f.name AS name, f.type AS type, quantity, {_once('aliases')} AS aliases, {_once('warnings')} AS warnings, raw, f.notes AS notes, f.confidence AS confidence FROM grouped),
stock AS (SELECT {', '.join(PART)}, CASE s_suppkey % 5 {' '.join(f'WHEN {k} THEN {_list(w)}' for k, w in ALIASES.items())} ELSE [] END AS aliases FROM supplier),
index AS (SELECT {_plain('key')} AS key, max_by(id, {{'a': nth > 1, 'p': place, 'n': nth}}) AS id FROM (SELECT id, place, generate_subscripts(k, 1) AS nth, unnest(k) AS key FROM (SELECT id, place, list_concat([name], aliases) AS k FROM stock)) GROUP BY 1),
hits AS (SELECT doc, normalized, min_by(id, nth) AS existing FROM (SELECT doc, normalized, generate_subscripts(k, 1) AS nth, unnest(k) AS key FROM (SELECT doc, normalized, list_concat([normalized], list_transform(aliases, lambda x: {_plain('x')})) AS k FROM merged)) JOIN index USING (key) GROUP BY 1, 2),
matched AS (SELECT merged.*, existing, CASE WHEN existing IS NULL THEN 'create' ELSE 'merge' END AS action FROM merged LEFT JOIN hits USING (doc, normalized))"""


@query(f"WITH {_ITEMS} SELECT doc, line, part, normalized, name, type, quantity, aliases, warnings, raw, notes, confidence, existing, action FROM matched")
def inventory_import(spark, sf_dir):
    texts, stock = _inventory(spark, sf_dir)
    return matched_items(merged_items(import_items(texts)), stock)


@query(rf"""WITH {_ITEMS}, kept AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY line, part) AS nth FROM matched QUALIFY nth <= 200), last AS (SELECT * FROM kept WHERE existing IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc, existing ORDER BY nth DESC) = 1)
SELECT doc, s.id, s.name, s.type, greatest(0, s.quantity) + greatest(0, i.quantity) AS quantity, coalesce(location, '') AS location, concat_ws(chr(10), nullif(trim(s.notes), ''), i.notes) AS notes, list_sort(list_distinct(list_concat(s.aliases, i.aliases))) AS aliases FROM last i JOIN stock s ON s.id = existing
UNION ALL SELECT doc, NULL, name, type, quantity, '', notes, aliases FROM kept WHERE existing IS NULL""")
def inventory_apply(spark, sf_dir):
    texts, stock = _inventory(spark, sf_dir)
    return applied(matched_items(merged_items(import_items(texts)), stock), stock)
