"""Pins from the text of a data sheet: labels, eight layouts of pin tables and diagrams, and the order of a diagram without numbers.

A layout is a Column: an array of (pin, label, role) of one text. All of it stays in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions.lines import squeezed

# Headings of pin pages, column headings, words that are no labels, functions by label.
MARKERS = ["PIN FUNCTIONS", "PIN DESCRIPTIONS", "PIN DESCRIPTION", "PIN CONFIGURATION", "PIN CONFIGURATIONS", "FUNCTIONAL PINOUT", "CONNECTION DIAGRAM", "TERMINAL FUNCTIONS", "TERMINAL ASSIGNMENTS", "PIN ASSIGNMENTS"]
COLUMNS = ["PIN", "PIN#", "PINNO", "PINNUMBER", "NAME", "I/O", "DESCRIPTION", "FUNCTION"]
NO_LABELS = ["ACTIVE", "ADDENDUM", "APPLICATION", "BUY", "COMMUNITY", "DESCRIPTION", "DEVICE", "DOCUMENTS", "FEATURES", "FOLDER", "FUNCTION", "GENERAL", "INPUT", "MAX", "MIN", "NAME", "OUTPUT", "PACKAGE", "PAGE", "PARAMETER", "PIN", "PRODUCT", "REVISION", "SAMPLE", "SOFTWARE", "STATUS", "SUPPORT", "TABLE", "TECHNICAL", "TOOLS", "TYPE", "UNIT"]
FUNCTIONS = {"VCC": ["+VCC", "V+", "VCC+", "VCC"], "Ground": ["GND", "GROUND"], "VDD": ["VDD"], "VSS": ["VSS"], "VEE": ["VEE"], "SCL": ["SCL"], "SDA": ["SDA"], "ADDR": ["ADDR"], "No connection": ["NC", "N/C", "NO CONNECT", "NO CONNECTION"], "Trigger input": ["TRIG", "TRIGGER"], "Threshold input": ["THRES", "THRESHOLD"], "Discharge": ["DISCH", "DISCHARGE"],
             "Control voltage": ["CONT", "CONTROL", "CONTROL VOLTAGE"], "Output": ["OUT", "OUTPUT"], "Reset": ["RESET"], "Anode": ["A"], "Cathode": ["K", "CATH"], "Emitter": ["E"], "Base": ["B"]}
ALIASES = [["VCC", "V+"], ["TRIG", "TRIGGER"], ["THRES", "THRESHOLD"], ["DISCH", "DISCHARGE"], ["CONT", "CONTROL", "CONTROLVOLTAGE"], ["OUT", "OUTPUT"]]
PIN_HEADS, NAME_HEADS, FUNCTION_HEADS = ["PIN", "PIN#", "PINNO", "PINNUMBER", "NO", "NUMBER", "TERMINAL"], ["NAME", "SYMBOL", "SIGNAL", "TERMINALNAME", "MNEMONIC"], ["FUNCTION", "DESCRIPTION", "TYPE", "I/O", "IO"]
PACKAGE_COUNTS = [4, 5, 6, 8, 10, 12, 14, 16, 18, 20, 24, 28, 32, 40, 48, 64]
DEVICES = ["DEVICE", "ADS1113", "ADS1114", "ADS1115"]
CUES = "Digital|Analog|Supply|Ground|Power|No\\s+connect|Input|Output|I/O|Interrupt|VCSEL|I2C"

LABEL = "[A-Za-z0-9][A-Za-z0-9/+_#-]{0,24}"
DIRECT = r"(?i)\bpin\s*([0-9]{1,2})\s*[:=\-–]\s*([A-Za-z][A-Za-z0-9 +/_-]{1,40})"
FLAT_PAGE, FLAT_ROW = r"(?i)\bpin\s+number\b|\bsignal\s+name\b|\bsignal\s+description", rf"(?i)\b([0-9]{{1,3}})\s+({LABEL})\s+(?=(?:{CUES})\b)"
PACKAGE_PAGE, PACKAGE_ROW = r"\b(?:TOP VIEW|PINOUT|PIN OUT|DIP|PDIP|SOIC|SOP|TSSOP|VSSOP|PACKAGE)\b", rf"\b({LABEL})\s+([0-9]{{1,3}})\s+([0-9]{{1,3}})\s+({LABEL})\b"
MODULE_PAGE, MODULE_LABEL = r"(?i)\bPINOUTS?\b|\bPIN\s+ASSIGNMENTS?\b|\bCONNECTOR\b", rf"\b({LABEL})\s*:"
COUPLER_FLAT, COUPLER_ROW = r"(?i)\b1\s+2\s+3\s+6\s+5\s+4\s+B\s+C\s+E\s+A\s+C\s+NC\b", r"(?i)\b(A|C|K|NC|N/C|NO\s+CONNECTION)\s+([0-9]{1,2})\s+([0-9]{1,2})\s+(B|C|E|NC|N/C|NO\s+CONNECTION)\b"
NUMBERED_ROW = rf"(?i)^(?:pin\s*)?([0-9]{{1,3}})\s+({LABEL})(?:\s+|$)"
DIRECTION = r"(?i)^(?:analog|digital)(?:\s+(?:input|output|i/o))?$"

NONE = "array<struct<pin:int,label:string,role:string>>"


def any_marker() -> str:
    return "|".join(MARKERS)


def compact(text: Column) -> Column:
    """Upper case, letters, digits, slash and # alone."""
    return F.regexp_replace(F.upper(text), "[^A-Z0-9/#]+", "")


def clean_label(text: Column) -> Column:
    """Without foot-note numbers, and without punctuation around it."""
    return F.btrim(F.regexp_replace(text, r"\([0-9]+\)", ""), F.lit(" .;:,"))


def signal(text: Column) -> Column:
    """A cell or line as a signal's label."""
    label = squeezed(F.upper(F.regexp_replace(text, r"\([0-9]+\)|[^A-Za-z0-9/+_ -]", "")))
    return F.when(label.isin("+VCC", "VCC+"), "VCC").otherwise(label)


def is_signal(label: Column) -> Column:
    """Whether a label can be a signal's: one word of at most 16 characters with a letter, no heading's word, and of single letters only A to E and K."""
    word = label.rlike(r"^(?=[^A-Z]*[A-Z])(?![F-JL-Z]$)(?!.*\bPIN\b)[A-Z0-9][A-Z0-9/+_-]{0,15}$") & ~F.translate(label, "+_-", "").rlike("TOPVIEW|PACKAGE")
    return (label == "CONTROL VOLTAGE") | (word & ~label.isin([w for w in NO_LABELS if w != "OUTPUT"]))


def pin_function(label: Column, role: Column) -> Column:
    """What a label stands for; else the label itself. C is a cathode on the input's side, a collector on the output's."""
    named = F.create_map(*(F.lit(x) for name, labels in FUNCTIONS.items() for one in labels for x in (one, name)))
    plain = squeezed(label)
    sided = F.when(F.upper(plain) == "C", F.when(role == "input", "Cathode").when(role == "output", "Collector").otherwise("C"))
    return F.coalesce(sided, F.try_element_at(named, F.upper(plain)), plain)


def _pin(number: Column, label: Column, role: str = "") -> Column:
    return F.struct(number.cast("int").alias("pin"), label.alias("label"), F.lit(role).alias("role"))


def _part(row: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(row, pattern, group)


def _usable(pins: Column, most: int = 256) -> Column:
    return F.filter(pins, lambda p: p.pin.between(1, most) & is_signal(p.label))


def _only(when: Column, pins: Column) -> Column:
    """pins, made only where `when` holds."""
    return F.when(F.coalesce(when, F.lit(False)), pins).otherwise(F.array().cast(NONE))


def _let(value: Column, then) -> Column:
    """then(value), with the value made once: lambdas share nothing else."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _at_least(n: int, pins: Column) -> Column:
    """pins, if they have so many numbers."""
    return _let(pins, lambda found: _only(F.size(F.array_distinct(F.transform(found, lambda p: p.pin))) >= n, found))


def coupler(text: Column, lines: Column) -> Column:
    """Six pins of an optocoupler: its diagram in one run, or as three rows of two sides."""
    flat = F.array(*(_pin(F.lit(p), F.lit(x), r) for p, x, r in ((1, "A", "input"), (2, "C", "input"), (3, "NC", "input"), (6, "B", "output"), (5, "C", "output"), (4, "E", "output"))))
    rows = F.slice(F.filter(F.transform(lines, squeezed), lambda x: x.rlike(COUPLER_ROW)), 1, 3)
    side = lambda rows, g: F.transform(rows, lambda x: signal(_part(x, COUPLER_ROW, g)))
    known = lambda rows: (side(rows, 1) == F.array(*map(F.lit, ("A", "C", "NC")))) & (side(rows, 4) == F.array(*map(F.lit, ("B", "C", "E"))))
    sides = lambda rows: F.concat(F.transform(rows, lambda x: _pin(_part(x, COUPLER_ROW, 2), signal(_part(x, COUPLER_ROW, 1)), "input")), F.transform(rows, lambda x: _pin(_part(x, COUPLER_ROW, 3), signal(_part(x, COUPLER_ROW, 4)), "output")))
    diagram = _let(rows, lambda r: _only(known(r), _usable(sides(r), 64)))
    return F.when(text.rlike(COUPLER_FLAT), flat).otherwise(_only(text.rlike(COUPLER_ROW), diagram))


def two_sides(text: Column, upper: Column, lines: Column) -> Column:
    """Rows of a package seen from above: label, pin, pin, label."""
    rows = F.filter(F.transform(lines, squeezed), lambda x: x.rlike(PACKAGE_ROW))
    both = F.flatten(F.transform(rows, lambda x: F.array(_pin(_part(x, PACKAGE_ROW, 2), signal(_part(x, PACKAGE_ROW, 1))), _pin(_part(x, PACKAGE_ROW, 3), signal(_part(x, PACKAGE_ROW, 4))))))
    return _only(upper.rlike(f"{any_marker()}|{PACKAGE_PAGE}"), _at_least(4, _usable(both)))


def flat_table(text: Column) -> Column:
    """A table that became one run of text: number, label, and a word of the signal's type."""
    rows = F.regexp_extract_all(squeezed(F.translate(text, "|", " ")), F.lit(FLAT_ROW), F.lit(0))
    found = F.transform(rows, lambda x: _pin(_part(x, rf"(?i)^([0-9]+)\s+({LABEL})", 1), signal(_part(x, rf"(?i)^([0-9]+)\s+({LABEL})", 2))))
    return _only(text.rlike(FLAT_PAGE), _at_least(3, _usable(found)))


def module(text: Column) -> Column:
    """Labels without numbers behind a heading, up to the first word on version, date or page after three of them; they count
    from 1, up to 32."""

    def listed(labels: Column) -> Column:
        distinct = lambda x: F.array_distinct(F.filter(x, is_signal))
        third = F.array_position(labels, F.try_element_at(distinct(labels), F.lit(3)))
        end = _let(third, lambda at: F.array_min(F.transform(labels, lambda x, i: F.when(x.isin("VERSION", "DATE", "PAGE") & (i >= at), i))))
        return distinct(F.slice(labels, F.lit(1), F.coalesce(end, F.size(labels))))

    rest = F.element_at(F.split(text, MODULE_PAGE, 2), 2)
    named = F.transform(F.regexp_extract_all(rest, F.lit(MODULE_LABEL), F.lit(1)), signal)
    tokens = F.transform(F.filter(F.split(rest, "[^A-Za-z0-9/+_#-]+"), lambda x: x != ""), signal)
    chosen = _let(_let(named, listed), lambda x: F.when(F.size(x) > 0, x).otherwise(_let(tokens, listed)))
    power = lambda x: F.arrays_overlap(x, F.array(*map(F.lit, ("GND", "VCC", "VDD", "SDA", "SCL"))))
    return _only(text.rlike(MODULE_PAGE), _let(chosen, lambda x: _only((F.size(x) >= 3) & power(x), F.transform(F.slice(x, 1, 32), lambda y, i: _pin(i + 1, y)))))


def pipe_table(text: Column, lines: Column) -> Column:
    """Rows of cells with a heading: the number's column, then the name's, the function's, or any other with a label."""
    rows = F.filter(F.transform(F.filter(lines, lambda x: F.contains(x, F.lit("|"))), lambda x: F.filter(F.transform(F.split(x, r"\|"), clean_label), lambda c: c != "")), lambda r: F.size(r) > 0)
    heads = lambda row: F.transform(row, compact)
    has = lambda row, names: F.arrays_overlap(row, F.array(*map(F.lit, names)))
    is_head = lambda row: _let(heads(row), lambda h: has(h, PIN_HEADS) & has(h, NAME_HEADS + ["FUNCTION", "DESCRIPTION"]))
    first = lambda head, names: F.array_min(F.transform(head, lambda c, i: F.when(c.isin(names), i)))

    def pin(row: Column, at: Column) -> Column:
        cells = F.concat(F.array(F.get(row, at["name"]), F.get(row, at["function"])), F.filter(row, lambda c, i: i != at["pin"]))
        label = F.get(F.filter(F.transform(F.array_compact(cells), signal), is_signal), F.lit(0))
        return _pin(F.nullif(F.regexp_extract(F.get(row, at["pin"]), r"\b([0-9]{1,3})\b", 1), F.lit("")), label)

    def body(rows: Column, head: Column) -> Column:
        at = _let(heads(F.get(rows, head)), lambda h: F.struct(first(h, PIN_HEADS).alias("pin"), first(h, NAME_HEADS).alias("name"), first(h, FUNCTION_HEADS).alias("function")))
        return _let(at, lambda a: F.transform(F.slice(rows, head + 2, F.size(rows)), lambda r: pin(r, a)))

    head = lambda rows: F.array_min(F.transform(rows, lambda r, i: F.when(is_head(r), i)))
    found = _let(rows, lambda r: _let(head(r), lambda h: F.when((F.size(r) >= 2) & h.isNotNull(), _usable(body(r, h)))))
    return _only(F.contains(text, F.lit("|")), F.coalesce(found, F.array().cast(NONE)))


def numbered_lines(upper: Column, lines: Column) -> Column:
    """Lines of number, label and words, on a page with pin headings."""
    squeezed_lines = F.filter(F.transform(lines, squeezed), lambda x: x != "")
    heads = lambda rows: F.size(F.filter(rows, lambda x: compact(x).rlike("PIN|TERMINAL|NAME|SYMBOL|SIGNAL|DESCRIPTION|FUNCTION")))
    hits = lambda rows: F.filter(rows, lambda x: x.rlike(NUMBERED_ROW))
    pins = lambda rows: F.transform(rows, lambda x: _pin(_part(x, NUMBERED_ROW, 1), signal(_part(x, NUMBERED_ROW, 2))))
    enough = lambda found: _only(F.size(found) >= 3, found)
    return _only(upper.rlike(any_marker()), _let(squeezed_lines, lambda rows: _only((heads(rows) >= 2) & (F.size(hits(rows)) >= 3), _let(_usable(pins(hits(rows))), enough))))


def described_pins(upper: Column, lines: Column) -> Column:
    """A table whose cells came out one a line: a number, names by device, the kind of signal, its description. The last name
    before the kind counts; rows beyond the 64th have their first cell alone."""
    cells = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")
    start = lambda rows: F.array_min(F.transform(rows, lambda x, i: F.when(F.upper(x).isin("PIN #", "PIN", "PIN NUMBER"), i)))
    number = r"^\(?([0-9]{1,2})\)?$"

    def row(rest: Column, heads: Column, i: Column) -> Column:
        last = F.when(i >= 64, F.lit(1)).otherwise(F.coalesce(F.get(heads, i + 1), F.size(rest)) - F.get(heads, i) - 1)
        names = _let(F.slice(rest, F.get(heads, i) + 2, F.greatest(last, F.lit(0))), lambda c: F.slice(c, F.lit(1), F.coalesce(F.array_min(F.transform(c, lambda x, k: F.when(x.rlike(DIRECTION), k))), F.size(c))))
        kept = F.filter(F.transform(names, clean_label), lambda x: (x != "") & ~F.upper(x).isin(DEVICES))
        return _pin(F.regexp_extract(F.get(rest, F.get(heads, i)), number, 1), F.try_element_at(kept, F.lit(-1)))

    heads = lambda rest: F.filter(F.transform(rest, lambda x, i: F.when(x.rlike(number), i)), lambda i: i.isNotNull())
    rows = lambda rest: _let(heads(rest), lambda h: F.filter(F.transform(F.slice(h, 1, 65), lambda _, i: row(rest, h, i)), lambda p: p.label.isNotNull()))
    found = _let(cells, lambda c: _let(start(c), lambda at: F.when(at.isNotNull(), _let(F.slice(c, at + 2, F.size(c)), rows))))
    return _only(upper.rlike(any_marker()), F.coalesce(found, F.array().cast(NONE)))


def direct(text: Column) -> Column:
    """"Pin 3: OUT" anywhere."""
    rows = F.regexp_extract_all(text, F.lit(DIRECT), F.lit(0))
    return F.transform(rows, lambda x: _pin(_part(x, DIRECT, 1), clean_label(_part(x, DIRECT, 2))))


def candidates(text: Column, upper: Column, lines: Column) -> Column:
    """All pins of a text in order of precedence: of two with one number, the first counts."""
    return F.concat(coupler(text, lines), two_sides(text, upper, lines), flat_table(text), module(text), pipe_table(text, lines), numbered_lines(upper, lines), described_pins(upper, lines), direct(text))


def signal_lines(lines: Column) -> Column:
    """(chunk_index, label) of lines that are not empty; "control" and "voltage" on two lines are one label."""
    cleaned = F.transform(lines, lambda x: F.struct(x.chunk_index.alias("chunk_index"), signal(x.line).alias("label")))
    pair = lambda rows, i: (F.coalesce(F.get(rows, i)["label"], F.lit("")) == "CONTROL") & (F.coalesce(F.get(rows, i + 1)["label"], F.lit("")) == "VOLTAGE")
    joined = lambda rows: F.filter(F.transform(rows, lambda x, i: F.struct(x.chunk_index.alias("chunk_index"), F.when(pair(rows, i), "CONTROL VOLTAGE").when((i > 0) & pair(rows, i - 1), "").otherwise(x.label).alias("label"))), lambda x: x.label != "")
    return _let(cleaned, joined)


def _count(labels: Column, words: list[str]) -> Column:
    return F.size(F.filter(labels, lambda x: x.label.isin(words)))


def best_run(labels: Column) -> Column:
    """The run of signals, 4 to 32 once repeats are dropped, with the best score; the earliest of equal ones. A label that is no
    signal ends a run, and so does NC after four; the fold carries positions alone."""
    begin = F.struct(F.lit(0).alias("start"), F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("runs"))

    def step(s: Column, x: Column) -> Column:
        long = s.at - s.start >= 4
        ends = ~is_signal(x.label) | ((x.label == "NC") & long)
        runs = F.when(ends & long, F.concat(s.runs, F.array(F.struct(s.start.alias("start"), (s.at - s.start).alias("length"))))).otherwise(s.runs)
        return F.struct(F.when(ends, s.at + 1).otherwise(s.start).alias("start"), (s.at + 1).alias("at"), runs.alias("runs"))

    def first_of_each(run: Column) -> Column:
        names = F.transform(run, lambda x: x.label)
        return _let(names, lambda n: F.filter(run, lambda x, i: F.array_position(n, x.label) == i + 1))

    score = lambda run: F.size(run) + _count(run, ["GND", "VCC", "VDD", "VSS", "OUT", "RESET", "SCL", "SDA"]) - F.size(F.filter(run, lambda x: x.label.rlike("^[A-Z]$")))
    bounds = F.aggregate(labels, begin, step, lambda s: F.when(s.at - s.start >= 4, F.concat(s.runs, F.array(F.struct(s.start.alias("start"), (s.at - s.start).alias("length"))))).otherwise(s.runs))
    runs = F.filter(F.transform(bounds, lambda b: first_of_each(F.slice(labels, b.start + 1, b.length))), lambda r: F.size(r).between(4, 32))
    scored = F.filter(F.transform(runs, lambda r, i: F.struct(score(r).alias("score"), (-i).alias("place"), r.alias("run"))), lambda x: x.score > 0)
    return F.array_max(scored)["run"]


def supported(run: Column, page: Column) -> Column:
    """Labels of the run that the page's text from its first heading on names as well."""
    aliases = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for group in ALIASES for one in group for x in (one.replace("V+", "V"), group)))
    lines = F.transform(F.split(page, r"\R"), lambda x: F.struct(F.lit(0).alias("chunk_index"), x.alias("line")))
    return _let(F.transform(signal_lines(lines), lambda x: x.label), lambda names: _let(compact(page), lambda c: F.filter(run, lambda x: _let(compact(x.label), lambda own: F.exists(F.array_append(F.coalesce(F.try_element_at(aliases, own), F.array().cast("array<string>")), own), lambda a: F.array_contains(names, a) | ((F.length(a) >= 2) & F.contains(c, a)))))))


def plausible(run: Column) -> Column:
    """A run of a usual package's length, or else its best beginning of such a length."""
    score = lambda r: 4 * _count(r, ["GND", "VCC", "+VCC", "VDD", "VSS", "VEE", "V+"]) + 2 * _count(r, ["OUT", "OUTPUT", "RESET", "SCL", "SDA", "TRIG", "TRIGGER", "THRES", "THRESHOLD"]) + F.size(r) - 4 * _count(r, ["NC", "N/C"])
    counts = F.array(*map(F.lit, PACKAGE_COUNTS))
    begins = F.transform(F.filter(counts, lambda n: n <= F.size(run)), lambda n: F.struct(score(F.slice(run, F.lit(1), n)).alias("score"), (-n).alias("n")))
    cut = F.when(F.array_contains(counts, F.size(run)), F.size(run)).otherwise(-F.array_max(begins)["n"])
    return F.when(F.size(run) >= 4, F.slice(run, F.lit(1), cut))


def evidence(pins: Column) -> Column:
    """How much a list of pins shows: its length, supplies, and named pins."""
    labels = F.transform(pins, lambda p: F.struct(F.upper(p.label).alias("label")))
    return 3 * F.size(pins) + 3 * _count(labels, ["GND", "VCC", "VDD", "VSS", "VEE", "V+"]) - 3 * _count(labels, ["NC", "N/C"])
