"""Code samples on made files."""

import pytest
from pyspark.sql import functions as F

from loomline.functions import code as C
from loomline.plans import code_rules

FILES = "path string, text string"
INO = "#include <Wire.h>\n#include <Adafruit_SSD1306.h>\nconst int ledPin = 13;\nvoid setup() { Serial.begin(115200); Wire.begin(); pinMode(ledPin, OUTPUT); }\nvoid loop() { digitalWrite(ledPin, HIGH); }"
# path, text, expected: single values exactly, lists as a part of what is found
CASES = {
    "sketch": ("oled-blink/Blink.ino", INO, {"pack": "oled-blink", "pack_display": "Oled blink", "language": "Arduino", "framework": "Arduino", "role": "entrypoint", "board": "", "interfaces": ["I2C", "UART", "GPIO"], "libraries": ["Wire", "Adafruit_SSD1306"], "serial_settings": ["Serial baud 115200"], "pins": ["ledPin=13"], "components": ["SSD1306 display"]}),
    "modem": ("modem/main.cpp", 'Serial1.begin(9600);\nmodem.println("AT+CGATT=1");\nmodem.println("AT+CSQ");\nat+csq', {"serial_settings": ["Serial baud 9600"], "at_commands": ["AT+CGATT=1", "AT+CSQ"], "language": "C++"}),
    "go": ("tinygo-blink/main.go", 'package main\nimport "machine"\nconst ledPin = machine.GPIO13\nfunc main() { machine.UART0.Configure(machine.UARTConfig{}) }', {"language": "Go", "framework": "TinyGo", "libraries": ["machine"], "pins": ["pin=13"]}),
    "rust": ("rust-blink/src/main.rs", "use embedded_hal::digital::OutputPin;\nconst LED_PIN: u8 = 25;\nlet led = Pin::new(25);", {"language": "Rust", "framework": "Rust embedded", "libraries": ["embedded_hal"], "pins": ["LED_PIN=25", "pin=25"]}),
    "react": ("serial-console/src/App.tsx", "import React, { useEffect } from 'react';\nconst resetPin: number = 4;\nawait navigator.serial.requestPort();", {"language": "React TSX", "framework": "React", "libraries": ["React"], "interfaces": ["WebSerial"], "pins": ["resetPin=4"]}),
    "readme": ("HAT_Code/README.md", "Arduino setup uses Serial.begin(115200), pinMode, and AT+CSQ checks.", {"kind": "companion", "pack": "HAT_Code", "language": "Markdown", "at_commands": ["AT+CSQ"]}),
    "manifest": ("serial-console/package.json", '{"dependencies":{"react":"latest","serialport":"latest"}}', {"kind": "companion", "language": "manifest", "components": ["serial device"]}),
    "single file": ("blink.test.py", "", {"pack": "blink.test", "role": "test", "language": "Python", "libraries": [], "summary": "Blink.test"}),
    "backslashes": ("a\\b\\c.H", None, {"path": "a/b/c.H", "pack": "a", "role": "header", "language": "C/C++ header"}),
    "first of a key stays": ("x/a.js", 'const a = require("lib/Zed"); import b from "zed"; import "y";', {"libraries": ["Zed", "y"]}),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(path, text) for path, text, _ in CASES.values()]
    return {r["path"]: r.asDict() for r in code_rules.samples(spark.createDataFrame(rows, FILES)).collect()}


@pytest.mark.parametrize("name", CASES)
def test_sample(found, name):
    path, _, want = CASES[name]
    got = found[path.replace("\\", "/")]
    assert {k: got[k] for k in want} == want


def test_caps_and_annotated(spark):
    text = "".join(f"#include <lib{i}.h>\nint p{i} = {i};\n" for i in range(60)) + "#include <LIB0>\n"
    row = code_rules.samples(spark.createDataFrame([("k/a.c", text)], FILES)).first()
    assert row["libraries"] == [f"lib{i}" for i in range(24)] and row["pins"] == [f"p{i}={i}" for i in range(32)]
    head, body = row["annotated"].split("\n\nSource code:\n")
    assert body == text.strip() and head.splitlines()[:3] == ["Code sample pack: K", "Code file: k/a.c", "Language: C"]
    assert head.splitlines()[-1] == "Pins: " + ", ".join(f"p{i}={i}" for i in range(12))


def test_kinds(spark):
    skipped = ["a/.git/x.c", "build/x.c", "a/CMSIS/x.c", "stm_hal-driver/x.c", "/abs/x.c", "", None, "a/../x.c", "a/" + "y" * 181 + ".c", "a/x\ty.c"]
    want = [("a/x.ino", "", "code"), ("a/README.md", "a book", "text"), ("a/go.mod", "tinygo.org", "companion"), ("a/go.mod", None, "text"), ("notes.md", "arduino", "text"), ("a / b.py", None, "code"), *((x, "", "skipped") for x in skipped)]
    got = code_rules.kinds(spark.createDataFrame(want, FILES + ", want string")).collect()
    assert [r["kind"] for r in got] == [r["want"] for r in got]


def test_paths(spark):
    rows = [("blink/Blink.ino",), ("../x.c",), ("a//b.c ",), ("./venv/x",), ("a/venv/x",), ("venv/../x",)]
    got = spark.createDataFrame(rows, "p string").select(C.safe_path(F.col("p")).alias("safe"), C.is_ignored(F.col("p")).alias("ignored")).collect()
    assert [r["safe"] for r in got] == ["blink/Blink.ino", None, "a/b.c", None, "a/venv/x", None]
    assert [r["ignored"] for r in got] == [False, False, False, False, True, True]


def test_clashing_columns_and_no_rows(spark):
    files = spark.createDataFrame([("a/x.c", "int p1 = 3;", "own", 7)], FILES + ", pack string, extra int")
    row = code_rules.samples(files).first()
    assert (row["pack"], row["extra"], row["pins"]) == ("a", 7, ["p1=3"])
    assert code_rules.samples(files.limit(0)).count() == 0
