"""Columns on code samples: which files are some, and what their text tells of libraries, pins, boards and interfaces.

Classes of the patterns are ASCII. Lists keep the order of the text, each pattern's finds after those of the one before;
of values with one key the first stays. Null paths and texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions, names, languages and patterns.
SOURCE_EXTENSIONS = [".ino", ".c", ".cc", ".cpp", ".cxx", ".h", ".hh", ".hpp", ".go", ".js", ".jsx", ".py", ".rs", ".sh", ".ts", ".tsx"]
COMPANION_NAMES = ["cargo.toml", "go.mod", "library.json", "library.properties", "package.json", "platformio.ini", "pyproject.toml", "readme.md", "requirements.txt", "readme.txt"]
COMPANION_MARKER = r"\b(?:setup|loop|pinmode|digitalwrite|analogread|serial\.begin|baud|AT\+[A-Z0-9_]+|#include|import\s+board|machine\.Pin|machine\.GPIO|gpio|i2c|spi|uart|arduino|esp32|raspberry\s*pi|circuitpython|micropython|platformio|tinygo|embedded-hal|react|serialport|webserial|webusb|navigator\.serial|navigator\.usb)\b"
IGNORED_FOLDERS = [".bzr", ".cache", ".git", ".hg", ".idea", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".svn", ".venv", ".vscode", "__pycache__", "build", "coverage", "dist", "node_modules", "target", "venv"]
BUNDLE_FOLDERS = ["debug", "ewarm", "iar", "mdk-arm", "release", "rte"]
BUNDLE_FOLDER = r"(?i)(?:^cmsis$|(?:^|[_-])hal[_-]?driver$)"
LONGEST_PART = 180
LANGUAGES = {
    ".ino": "Arduino", ".c": "C", ".cc": "C++", ".cpp": "C++", ".cxx": "C++", ".h": "C/C++ header", ".hh": "C++ header", ".hpp": "C++ header", ".go": "Go", ".js": "JavaScript", ".jsx": "React JSX", ".py": "Python", ".rs": "Rust", ".sh": "Shell", ".ts": "TypeScript", ".tsx": "React TSX",
    ".ini": "configuration", ".json": "manifest", ".md": "Markdown", ".properties": "properties", ".toml": "configuration", ".txt": "text", ".yaml": "configuration", ".yml": "configuration",
}
INTERFACES = {
    "I2C": r"\b(?:i2c|wire\.begin|sda|scl)\b",
    "SPI": r"\b(?:spi|mosi|miso|sck|ss|cs)\b",
    "UART": r"\b(?:uart|serial(?:\d+)?\.begin|tx|rx)\b",
    "PWM": r"\b(?:pwm|analogwrite)\b",
    "ADC": r"\b(?:adc|analogread|analog input)\b",
    "GPIO": r"\b(?:gpio|pinmode|digitalwrite|digitalread)\b",
    "WebSerial": r"\b(?:webserial|serialport|navigator\.serial)\b",
    "WebUSB": r"\b(?:webusb|navigator\.usb)\b",
}
BOARDS = {"ESP32": r"\besp32\b", "Arduino": r"\b(?:arduino|uno|nano|mega|leonardo)\b", "Raspberry Pi Pico": r"\b(?:rp2040|pico)\b", "Raspberry Pi": r"\braspberry\s*pi\b"}
FRAMEWORKS = {
    "Arduino": r"\bsetup\s*\(\s*\)|\bloop\s*\(\s*\)|#include\s*<Arduino\.h>",
    "CircuitPython": r"\b(?:import\s+board|import\s+digitalio|adafruit_)",
    "MicroPython": r"\bfrom\s+machine\s+import\b|\bmachine\.Pin\b",
    "TinyGo": r"\b(?:tinygo|machine\.GPIO|machine\.Pin|machine\.UART|machine\.I2C|machine\.SPI)\b",
    "Rust embedded": r"\b(?:embedded[_-]hal|esp[_-]idf|rp2040[_-]hal|arduino[_-]hal)\b",
    "React": r"\b(?:react|jsx|tsx|useState|useEffect|createRoot|navigator\.serial|navigator\.usb)\b",
}
COMPONENTS = {
    "LED": r"\bled\b|neopixel|ws2812",
    "servo": r"\bservo\b",
    "relay": r"\brelay\b",
    "button": r"\bbutton\b|pushbutton|switch",
    "DHT sensor": r"\bdht(?:11|22)?\b",
    "BME280 sensor": r"\bbme280\b",
    "BMP280 sensor": r"\bbmp280\b",
    "SSD1306 display": r"\bssd1306\b|oled",
    "ADS1115 ADC": r"\bads1115\b",
    "HC-SR04 ultrasonic sensor": r"\bhc[-_ ]?sr04\b|ultrasonic",
    "serial device": r"\b(?:webserial|serialport|navigator\.serial)\b",
    "USB device": r"\b(?:webusb|navigator\.usb)\b",
}
INCLUDE = r"""#include\s*[<"]([^>"]+)[>"]"""
IMPORT = r"(?m)^\s*(?:from|import)\s+([A-Za-z_][A-Za-z0-9_\.]*)"
IMPORT_BLOCK, IN_BLOCK = r"""(?m)^\s*import\s+(?:\([\s\S]*?\)|"[^"]+")""", r'"([^"]+)"'
USE = r"(?m)^\s*(?:use|extern\s+crate)\s+([A-Za-z_][A-Za-z0-9_:]*)"
REQUIRE = r"""(?:import\s+(?:[^;]*?\s+from\s+)?|require\s*\()\s*["']([^"']+)["']"""
NAMED_PINS = [
    r"\b(?:const\s+)?(?:int|byte|uint8_t|#define)\s+([A-Za-z_][A-Za-z0-9_]*)\s*(?:=|\s)\s*([A-Za-z]?\d{1,3})\b",
    r"(?i)\b(?:const|let|var)\s+([A-Za-z_][A-Za-z0-9_]*pin[A-Za-z0-9_]*)\s*(?::\s*[A-Za-z0-9_<>\[\]]+)?\s*=\s*([A-Za-z]?\d{1,3})\b",
    r"(?i)\bconst\s+([A-Za-z_][A-Za-z0-9_]*pin[A-Za-z0-9_]*)\s+[A-Za-z0-9_]+\s*=\s*([A-Za-z]?\d{1,3})\b",
    r"(?i)\b(?:let|const)\s+([A-Za-z_][A-Za-z0-9_]*pin[A-Za-z0-9_]*)\s*:\s*[A-Za-z0-9_:<>]+\s*=\s*([A-Za-z]?\d{1,3})\b",
    r"(?i)\b([A-Za-z_][A-Za-z0-9_]*Pin)\s*=\s*([A-Za-z]?\d{1,3})\b",
]
PLAIN_PINS = [r"(?i)\b(?:Pin|GPIO|gpio\.NewPin|Pin::new)\s*\(\s*([A-Za-z]?\d{1,3})\s*\)", r"(?i)\bmachine\.GPIO(\d{1,3})\b"]
AT_COMMAND, AT_END = r"""(?i)\bAT\+[A-Z0-9_]+(?:=[A-Z0-9_,".\-:/ ]{0,80})?""", r"""["'.,;]+$"""
SERIAL = {"Serial baud ": r"(?i)\bSerial(?:\d+)?\.begin\s*\(\s*(\d{4,7})", "Baud ": r"(?i)\bbaud(?:\s*rate)?\s*[:=]\s*(\d{4,7})"}
ENTRY_NAMES = ["main.cpp", "main.c", "main.go", "main.py", "main.rs", "app.jsx", "app.tsx"]
MOST_LIBRARIES, MOST_PINS, MOST_COMMANDS, MOST_SETTINGS, SHOWN_PINS, SHOWN = 24, 32, 32, 16, 12, 4


def plain_path(path: Column) -> Column:
    return F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))


def parts(path: Column) -> Column:
    """Names on a path of forward slashes."""
    return F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))


def suffix(path: Column) -> Column:
    """The last extension, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"(?s)^.+(\.[^.]+)$", 1))


def is_code(path: Column) -> Column:
    return suffix(plain_path(path)).isin(SOURCE_EXTENSIONS)


def is_companion(path: Column, text: Column) -> Column:
    """A known file beside code, whose text shows a sign of it; the text is read only where the name is known."""
    known = F.lower(F.substring_index(plain_path(path), "/", -1)).isin(COMPANION_NAMES)
    return F.when(known, F.coalesce(text, F.lit("")).rlike(f"(?i){COMPANION_MARKER}")).otherwise(F.lit(False))


def _trimmed(path: Column) -> Column:
    return F.filter(F.transform(F.split(F.trim(plain_path(path)), "/"), F.trim), lambda x: x != "")


def is_ignored(path: Column) -> Column:
    """A folder on the path is a tool's or hidden; a step such as `..` before it says no more about the path."""
    names = F.transform(_trimmed(path), F.lower)
    hidden = lambda x: x.isin(IGNORED_FOLDERS) | F.startswith(x, F.lit("."))
    return F.coalesce(~F.get(F.filter(names, hidden), F.lit(0)).isin(".", ".."), F.lit(False))


def is_bundle_dependency(path: Column) -> Column:
    return F.exists(_trimmed(path), lambda x: F.lower(x).isin(BUNDLE_FOLDERS) | x.rlike(BUNDLE_FOLDER))


def safe_path(path: Column) -> Column:
    """A relative path without empty names; null if it is empty, starts at the root, has hidden or overlong names or control characters."""
    names = _trimmed(path)
    bad = F.startswith(F.trim(plain_path(path)), F.lit("/")) | (F.size(names) == 0) | F.exists(names, lambda x: F.startswith(x, F.lit(".")) | (F.length(x) > LONGEST_PART) | x.rlike(r"[\x00-\x1f\x7f]"))
    return F.when(~bad, F.array_join(names, "/"))


def pack(path: Column) -> Column:
    """The folder a sample belongs to: the first of a relative path, the last of an absolute one, else the file's own name."""
    names = parts(path)
    own = F.regexp_replace(F.coalesce(F.try_element_at(names, F.lit(-1)), F.lit("")), r"(?s)^(.+)\.[^.]+$", "$1")
    folder = F.when(F.startswith(path, F.lit("/")), F.try_element_at(names, F.lit(-2))).otherwise(F.get(names, F.lit(0)))
    return F.when(F.size(names) > 1, folder).otherwise(own)


def display(name: Column) -> Column:
    text = F.trim(F.regexp_replace(name, "[_-]+", " "))
    return F.when(text == "", "Code sample").otherwise(F.concat(F.upper(F.left(text, F.lit(1))), F.substr(text, F.lit(2))))


def language(path: Column) -> Column:
    end = suffix(path)
    known = F.coalesce(*(F.when(end == k, v) for k, v in LANGUAGES.items()))
    return F.coalesce(known, F.when(end != "", F.ltrim(end, F.lit("."))), F.lit("code"))


def role(path: Column) -> Column:
    name = F.lower(F.substring_index(path, "/", -1))
    header, entry = name.rlike(r"\.(h|hh|hpp)$"), name.isin(ENTRY_NAMES) | F.endswith(name, F.lit(".ino"))
    return F.when(header, "header").when(entry, "entrypoint").when(F.contains(name, F.lit("test")), "test").otherwise("source")


def first_of(patterns: dict[str, str], text: Column) -> Column:
    return F.coalesce(*(F.when(text.rlike(f"(?i){p}"), name) for name, p in patterns.items()), F.lit(""))


def all_of(patterns: dict[str, str], text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(f"(?i){p}"), name) for name, p in patterns.items())))


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _last(name: Column) -> Column:
    end = F.substring_index(name, "/", -1)
    return F.when(end == "", name).otherwise(end)


def library_names(text: Column) -> Column:
    """Names of all libraries, as often as they are named."""
    stem = lambda x: F.regexp_replace(F.substring_index(F.regexp_replace(x, r"^\s+|\s+$", ""), "/", -1), r"(?s)^(\.*[^.].*)\.[^.]*$", "$1")
    blocks = F.flatten(F.transform(_found(text, IMPORT_BLOCK, 0), lambda b: _found(b, IN_BLOCK)))
    found = F.concat(F.transform(_found(text, INCLUDE), stem), F.transform(_found(text, IMPORT), lambda x: F.substring_index(x, ".", 1)), F.transform(blocks, _last), F.transform(_found(text, USE), lambda x: F.substring_index(x, "::", 1)), F.transform(_found(text, REQUIRE), _last))
    return F.filter(found, lambda x: x != "")


def pin_names(text: Column) -> Column:
    """name=pin of all assignments, as often as they are made; pins without a name are called pin."""

    def pairs(pattern: str) -> Column:
        return F.transform(_found(text, pattern, 0), lambda m: F.concat(F.regexp_extract(m, pattern, 1), F.lit("="), F.regexp_extract(m, pattern, 2)))

    named = (pairs(p) for p in NAMED_PINS)
    plain = (F.transform(_found(text, p), lambda x: F.concat(F.lit("pin="), x)) for p in PLAIN_PINS)
    return F.concat(*named, *plain)


def pin_key(pin: Column) -> Column:
    return F.concat(F.lower(F.substring_index(pin, "=", 1)), F.lit("="), F.substring_index(pin, "=", -1))


def at_commands(text: Column) -> Column:
    return F.transform(_found(text, AT_COMMAND, 0), lambda x: F.regexp_replace(F.trim(x), AT_END, ""))


def serial_settings(text: Column) -> Column:
    def said(say: str, pattern: str) -> Column:
        return F.transform(_found(text, pattern), lambda x: F.concat(F.lit(say), x))

    return F.slice(F.array_distinct(F.concat(*(said(*x) for x in SERIAL.items()))), 1, MOST_SETTINGS)


def first_by_key(values: Column, keys: Column, most: int) -> Column:
    """The first value of each of the first keys; both are columns made before, as lambdas would make them again."""
    return F.transform(F.slice(F.array_distinct(keys), 1, most), lambda k: F.element_at(values, F.array_position(keys, k).cast("int")))


def components(text: Column, libraries: Column) -> Column:
    """Components named in the text, then those in names of libraries."""
    by_name = F.flatten(F.transform(libraries, lambda x: all_of(COMPONENTS, F.translate(x, "_-", "  "))))
    return F.array_distinct(F.concat(all_of(COMPONENTS, text), by_name))


def summary() -> Column:
    """One line from the columns of a sample."""
    say = lambda word, name: F.when(F.col(name) != "", F.concat(F.lit(word), F.col(name)))
    some = lambda word, name: F.when(F.size(name) > 0, F.concat(F.lit(word), F.array_join(F.slice(name, 1, SHOWN), ", ")))
    return F.concat_ws(" ", "pack_display", say("for ", "board"), say("using ", "framework"), some("with ", "components"), some("over ", "interfaces"))


def annotated() -> Column:
    """The text under a head of what is known of it."""
    line = lambda label, value: F.when(value != "", F.concat(F.lit(f"{label}: "), value))
    some = lambda label, name: line(label, F.array_join(name, ", "))
    head = [line("Code sample pack", F.col("pack_display")), line("Code file", F.col("path")), line("Language", F.col("language")), line("Framework", F.col("framework")), line("Board", F.col("board"))]
    lists = [some(label, name) for label, name in (("Libraries", "libraries"), ("Components", "components"), ("Interfaces", "interfaces"), ("AT commands", "at_commands"), ("Serial", "serial_settings"))]
    pins = line("Pins", F.array_join(F.slice("pins", 1, SHOWN_PINS), ", "))
    return F.regexp_replace(F.concat_ws("\n", *head, *lists, pins, F.lit(""), F.lit("Source code:"), F.coalesce("text", F.lit(""))), r"^\s+|\s+$", "")
