"""Code samples among files: what kind a file is, and what the text of a sample tells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions import code as C
from loomline.plans.registry import query
from loomline.sources.tables import table

LISTS = ["libraries", "components", "interfaces", "pins", "at_commands", "serial_settings"]


def kinds(files: DataFrame) -> DataFrame:
    """files (path, text, ...) with a kind: code, companion, text or skipped (in a tool's folder, or with no safe path)."""
    path = F.coalesce("path", F.lit(""))
    skipped = C.safe_path(path).isNull() | C.is_ignored(path) | C.is_bundle_dependency(path)
    return files.withColumn("kind", F.when(skipped, "skipped").when(C.is_code(path), "code").when(C.is_companion(path, F.col("text")), "companion").otherwise("text"))


def samples(files: DataFrame) -> DataFrame:
    """The code and companions of files (path, text, ...), with what they tell.

    Adds pack, pack_display, language, role, framework, board, summary, arrays of libraries, components, interfaces, pins
    (name=pin), at_commands and serial_settings, and annotated, the text under a head. Columns of these names are replaced.
    Null texts and paths are empty; repeated files are rows of their own; an empty table has no samples. One pass, no shuffle."""
    rows = kinds(files).where(F.col("kind").isin("code", "companion")).withColumn("path", C.plain_path(F.col("path")))
    path, text = F.col("path"), F.coalesce("text", F.lit(""))
    rows = rows.withColumns({"_all": F.concat_ws("\n", path, text), "_libraries": C.library_names(text), "_pins": C.pin_names(text), "_commands": C.at_commands(text)})
    rows = rows.withColumns({
        "pack": C.pack(path), "language": C.language(path), "role": C.role(path), "framework": C.first_of(C.FRAMEWORKS, F.col("_all")), "board": C.first_of(C.BOARDS, F.col("_all")),
        "interfaces": C.all_of(C.INTERFACES, F.col("_all")), "serial_settings": C.serial_settings(text),
        "libraries": C.first_by_key(F.col("_libraries"), F.transform("_libraries", F.lower), C.MOST_LIBRARIES),
        "pins": C.first_by_key(F.col("_pins"), F.transform("_pins", C.pin_key), C.MOST_PINS),
        "at_commands": C.first_by_key(F.col("_commands"), F.transform("_commands", F.upper), C.MOST_COMMANDS),
    })
    rows = rows.withColumns({"pack_display": C.display(F.col("pack")), "components": C.components(F.col("_all"), F.col("libraries"))})
    return rows.withColumns({"summary": C.summary(), "annotated": C.annotated()}).drop("_all", "_libraries", "_pins", "_commands")


# Sketches of parts: the same expressions are valid in Spark and in DuckDB.
_SIZE = "CAST(p_size AS STRING)"
_PATH = "'kits/' || lower(replace(p_brand, '#', '-')) || CASE p_partkey % 7 WHEN 0 THEN '/Blink.ino' WHEN 1 THEN '/src/main.cpp' WHEN 2 THEN '/main.go' WHEN 3 THEN '/src/main.rs' WHEN 4 THEN '/src/App.tsx' WHEN 5 THEN '/test_pins.py' ELSE '/node_modules/drv.h' END"
_TEXT = f"""CASE p_partkey % 7
  WHEN 0 THEN concat_ws(chr(10), '#include <Wire.h>', '#include <Adafruit_SSD1306.h>', 'const int ledPin = ' || {_SIZE} || ';', 'int LEDPIN = ' || {_SIZE} || ';', 'void setup() {{ Serial.begin(115200); pinMode(ledPin, OUTPUT); }}', '// for an Uno with a servo, a relay, SDA and SCL')
  WHEN 1 THEN concat_ws(chr(10), '#include "drivers/modem.h"', '#define RESET_PIN ' || {_SIZE}, 'Serial1.begin(9600);', 'modem.println("AT+CGATT=' || {_SIZE} || '");', 'modem.println("at+csq");', 'modem.println("AT+CSQ");', 'baud rate: 19200')
  WHEN 2 THEN concat_ws(chr(10), 'package main', 'import (', '  "machine"', '  "tinygo.org/x/drivers/bme280"', ')', 'const ledPin = machine.GPIO' || {_SIZE}, 'func main() {{ machine.UART0.Configure() }}')
  WHEN 3 THEN concat_ws(chr(10), 'use embedded_hal::digital::OutputPin;', 'use rp2040_hal as hal;', 'const LED_PIN: u8 = ' || {_SIZE} || ';', 'let led = Pin::new(' || {_SIZE} || ');')
  WHEN 4 THEN concat_ws(chr(10), 'import React, {{ useEffect }} from ''react'';', 'import x from "@scope/serialport";', 'const resetPin: number = ' || {_SIZE} || ';', 'await navigator.serial.requestPort();')
  WHEN 5 THEN concat_ws(chr(10), 'from machine import Pin', 'import dht_sensor.core', 'pin = Pin(' || {_SIZE} || ')', 'buttonPin = A' || {_SIZE}, 'adc and pwm on an ESP32')
  ELSE '#include "bme280.h"' END"""


def files(spark, sf_dir: str) -> DataFrame:
    """(id, path, text): a sketch of each part, and each document as a readme in its source's folder."""
    sketches = table(spark, sf_dir, "part").select(F.expr("'p' || p_partkey AS id"), F.expr(f"{_PATH} AS path"), F.expr(f"{_TEXT} AS text"))
    return sketches.unionByName(table(spark, sf_dir, "documents").select(F.expr("'d' || doc_id AS id"), F.expr("source || '/README.md' AS path"), "text"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_first(patterns) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(everything, {_quoted(p)}, 'i') THEN {_quoted(n)}" for n, p in patterns.items()) + " ELSE '' END"


def _sql_all(patterns, x: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({x}, {_quoted(p)}, 'i') THEN {_quoted(n)} END" for n, p in patterns.items()) + "], lambda y: y IS NOT NULL)"


def _sql_found(pattern: str, group: int, x: str = "text") -> str:
    return f"regexp_extract_all({x}, {_quoted(pattern)}, {group})"


def _sql_keyed(name: str, key: str, most: int) -> str:
    return f"list_filter({name}, lambda x, i: list_position(list_transform({name}, lambda y: {key.format('y')}), {key.format('x')}) = i)[1:{most}]"


_LAST = "CASE WHEN split_part({0}, '/', -1) = '' THEN {0} ELSE split_part({0}, '/', -1) END"
_LIBRARIES = f"""list_filter(list_transform({_sql_found(C.INCLUDE, 1)}, lambda x: regexp_replace(split_part(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '/', -1), '(?s)^(\\.*[^.].*)\\.[^.]*$', '\\1'))
  || list_transform({_sql_found(C.IMPORT, 1)}, lambda x: split_part(x, '.', 1)) || list_transform(flatten(list_transform({_sql_found(C.IMPORT_BLOCK, 0)}, lambda b: {_sql_found(C.IN_BLOCK, 1, 'b')})), lambda x: {_LAST.format('x')})
  || list_transform({_sql_found(C.USE, 1)}, lambda x: split_part(x, '::', 1)) || list_transform({_sql_found(C.REQUIRE, 1)}, lambda x: {_LAST.format('x')}), lambda x: x <> '')"""
_PINS = " || ".join([f"list_transform({_sql_found(p, 0)}, lambda m: regexp_extract(m, {_quoted(p)}, 1) || '=' || regexp_extract(m, {_quoted(p)}, 2))" for p in C.NAMED_PINS] + [f"list_transform({_sql_found(p, 1)}, lambda x: 'pin=' || x)" for p in C.PLAIN_PINS])
_SETTINGS = " || ".join(f"list_transform({_sql_found(p, 1)}, lambda x: {_quoted(say)} || x)" for say, p in C.SERIAL.items())
_FILES = f"""files AS (SELECT 'p' || p_partkey AS id, {_PATH} AS path, {_TEXT} AS text FROM part UNION ALL SELECT 'd' || doc_id, coalesce(source || '/README.md', ''), coalesce(text, '') FROM documents),
named AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS names FROM files),
kinds AS (SELECT *, CASE WHEN len(names) = 0 OR list_has_any(list_transform(names, lambda x: lower(x)), {C.IGNORED_FOLDERS + C.BUNDLE_FOLDERS}) THEN 'skipped'
  WHEN regexp_matches(path, '\\.(ino|c|cc|cpp|cxx|h|hh|hpp|go|js|jsx|py|rs|sh|ts|tsx)$', 'i') THEN 'code'
  WHEN ends_with(path, '/README.md') AND regexp_matches(text, {_quoted(C.COMPANION_MARKER)}, 'i') THEN 'companion' ELSE 'text' END AS kind FROM named)"""


@query(f"WITH {_FILES} SELECT kind, lower(regexp_extract(path, '\\.[^./]+$')) AS extension, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM kinds GROUP BY ALL")
def file_kinds(spark, sf_dir):
    """How many files are code, companions of code, plain texts or skipped."""
    rows = kinds(files(spark, sf_dir)).withColumn("extension", C.suffix(F.coalesce("path", F.lit(""))))
    return rows.groupBy("kind", "extension").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("chars"))


@query(f"""WITH {_FILES}, a AS (SELECT id, path, text, kind, names, path || chr(10) || text AS everything, {_LIBRARIES} AS all_libraries, {_PINS} AS all_pins,
  list_transform({_sql_found(C.AT_COMMAND, 0)}, lambda x: regexp_replace(trim(x), {_quoted(C.AT_END)}, '')) AS all_commands, {_SETTINGS} AS all_settings FROM kinds WHERE kind IN ('code', 'companion')),
b AS (SELECT *, names[1] AS pack, regexp_replace(names[1], '[_-]+', ' ', 'g') AS spaced, {_sql_keyed('all_libraries', 'lower({})', C.MOST_LIBRARIES)} AS libraries, {_sql_keyed('all_pins', "lower(split_part({0}, '=', 1)) || '=' || split_part({0}, '=', 2)", C.MOST_PINS)} AS pins,
  {_sql_keyed('all_commands', 'upper({})', C.MOST_COMMANDS)} AS at_commands, {_sql_keyed('all_settings', '{}', C.MOST_SETTINGS)} AS serial_settings, {_sql_all(C.INTERFACES, 'everything')} AS interfaces, {_sql_first(C.FRAMEWORKS)} AS framework, {_sql_first(C.BOARDS)} AS board,
  CASE regexp_extract(path, '\\.[^.]+$') {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in C.LANGUAGES.items())} END AS language,
  CASE WHEN regexp_matches(path, '\\.(h|hh|hpp)$') THEN 'header' WHEN lower(names[-1]) IN ({', '.join(map(repr, C.ENTRY_NAMES))}) OR ends_with(path, '.ino') THEN 'entrypoint' WHEN contains(names[-1], 'test') THEN 'test' ELSE 'source' END AS role,
  {_sql_all(C.COMPONENTS, 'everything')} AS in_text FROM a),
c AS (SELECT *, upper(left(spaced, 1)) || substring(spaced, 2) AS pack_display, flatten(list_transform(libraries, lambda l: {_sql_all(C.COMPONENTS, "translate(l, '_-', '  ')")})) AS in_libraries FROM b),
d AS (SELECT *, {_sql_keyed('(in_text || in_libraries)', '{}', 24)} AS components FROM c)
SELECT id, path, kind, pack, pack_display, language, role, framework, board, {', '.join(f"array_to_string({x}, '|') AS {x}" for x in LISTS)},
  concat_ws(' ', pack_display, CASE WHEN board <> '' THEN 'for ' || board END, CASE WHEN framework <> '' THEN 'using ' || framework END, CASE WHEN len(components) > 0 THEN 'with ' || array_to_string(components[1:4], ', ') END, CASE WHEN len(interfaces) > 0 THEN 'over ' || array_to_string(interfaces[1:4], ', ') END) AS summary,
  md5(regexp_replace(concat_ws(chr(10), 'Code sample pack: ' || pack_display, 'Code file: ' || path, 'Language: ' || language, CASE WHEN framework <> '' THEN 'Framework: ' || framework END, CASE WHEN board <> '' THEN 'Board: ' || board END,
  {', '.join(f"CASE WHEN len({x}) > 0 THEN '{label}: ' || array_to_string({x}, ', ') END" for label, x in (("Libraries", "libraries"), ("Components", "components"), ("Interfaces", "interfaces"), ("AT commands", "at_commands"), ("Serial", "serial_settings")))},
  CASE WHEN len(pins) > 0 THEN 'Pins: ' || array_to_string(pins[1:12], ', ') END, '', 'Source code:', text), '^\\s+|\\s+$', '', 'g')) AS annotated_md5 FROM d""")
def code_samples(spark, sf_dir):
    """What code and its companions tell, of sketches made from parts and of all documents as readmes."""
    rows = samples(files(spark, sf_dir))
    return rows.select("id", "path", "kind", "pack", "pack_display", "language", "role", "framework", "board", *(F.array_join(x, "|").alias(x) for x in LISTS), "summary", F.md5("annotated").alias("annotated_md5"))
