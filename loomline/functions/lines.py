"""Rules on lines and chunks of text, as Columns: low-value lines, kinds, headings, quality and its flags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
BOILERPLATE = ["submit documentation feedback", "product folder links:", "copyright ©", "copyright (c)", "www.ti.com", "think of ways you could apply this knowledge"]
PACKAGE_TOKENS = ["spq", "l", "w", "t", "b", "mm", "µm", "um", "tssop", "soic", "ssop", "pdip", "cdip", "sop", "so", "db", "ns", "nipdau", "green", "rohs", "non-rohs", "lead", "finish", "package", "orderable", "top-side", "marking"]
STRONG_TITLES = ["applications", "features", "overview", "description", "design requirements", "detailed design procedure", "electrical characteristics", "absolute maximum ratings", "recommended operating conditions", "pin configuration and functions", "package materials information", "layout", "schematic", "parts list", "procedure", "operation", "notes"]
STRONG_STARTS = ["section", "chapter", "appendix", "part", "module", "unit", "figure", "table", "application", "feature", "overview", "description", "design", "electrical", "pin configuration", "absolute maximum", "recommended operating"]
DOMAIN_TERMS = ["pin", "vcc", "gnd", "ground", "trigger", "threshold", "discharge", "reset", "output", "input", "timer", "timing", "capacitor", "resistor", "current", "voltage", "frequency", "duty", "oscillator", "monostable", "astable", "led", "diode", "transistor", "collector", "emitter", "base", "mosfet", "gate", "source", "drain"]

# Marks and words that speak for a formula are parameters; the patterns below are fixed values.
MATH_SYMBOLS, MATH_WORDS = ["=", "+", "^", "*", "/", "√", "∑", "∫", "≤", "≥", "≈"], ["equation", "formula", "solve", "minimize"]
MIN_TOKENS = 5
TRIMMED = r"^[()\[\]{}.,;:]+|[()\[\]{}.,;:]+$"
NUMERIC = r"^[0-9\s.,+\-−–/%()]+$"
CODES = r"^[A-Z0-9]{2,8}(?:\s*[|/]\s*[A-Z0-9]{1,8})+$"
NUMBERED = r"^([A-Z]?[0-9]+(\.[0-9A-Z]+)*[):]?)\s+[A-Z]"
NOTICE = r"^(note|warning|caution|summary|objective|goal|purpose)\s*[:\-]"
TABLE_WORDS = r"\b(table|parameter|conditions|typ|max|min|unit)\b"
DATE = r"^[0-9]{1,2}[-/][A-Za-z]{3}[-/][0-9]{2,4}$"


def share(text: Column, letters: str) -> Column:
    """Share of the characters in a class; 0 for no text."""
    n = F.length(text)
    return (n - F.length(F.regexp_replace(text, f"[{letters}]+", ""))) / F.greatest(n, F.lit(1))


def ascii_edges(pattern: str) -> str:
    """The pattern with word edges (\\b) between ASCII letters, digits or _ and all else, as SQL has them. Java's own edges count
    accented letters as parts of words, its \\w does not."""
    return pattern.replace(r"\b", r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))")


def any_of(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def tokens(line: Column) -> Column:
    """Words between blanks, without brackets and stops at their ends."""
    return F.transform(F.filter(F.split(line, r"\s+"), lambda x: x != ""), lambda x: F.regexp_replace(x, TRIMMED, ""))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value made once a row: Spark shares no subexpression of a CASE's branches or of lambdas."""
    return F.element_at(F.transform(F.array(value), lambda x: then(x)), 1)


def blanks(line: Column) -> Column:
    return F.length(line) - F.length(F.translate(line, " ", ""))


def measures(line: Column) -> Column:
    """What the rules on a squeezed line ask for again and again: its lower-case form, shares of classes, and its words, if
    they are 12 at most."""
    return F.struct(line.alias("s"), F.lower(line).alias("low"), share(line, "0-9").alias("digits"), share(line, r"\p{L}").alias("alpha"), share(line, r"^\p{L}\p{N}\s").alias("marks"), share(line, ".").alias("dots"), F.when(blanks(line) < 12, tokens(F.lower(line))).alias("words"))


def _numeric(m: Column) -> Column:
    return m.s.rlike(NUMERIC) & (m.digits > 0.28)


def _package(m: Column) -> Column:
    known, n = F.array(*(F.lit(t) for t in PACKAGE_TOKENS)), F.size(m.words)
    package = F.size(F.filter(m.words, lambda x: F.array_contains(known, x)))
    short = F.size(F.filter(m.words, lambda x: F.array_contains(known, x) | (F.length(x) <= 3)))
    digit = F.exists(m.words, lambda x: x.rlike("[0-9]"))
    return (m.words.isNotNull() & let(package, lambda k: (k > 0) & (digit | (k >= 2)) & (short / F.greatest(n, F.lit(1)) >= 0.75))) | m.s.rlike(CODES)


def _low_value(m: Column, numeric: Column, package: Column) -> Column:
    marks = (m.marks > 0.65) & (m.alpha < 0.15)
    return (m.s != "") & (m.s.rlike("^[0-9]+$") | numeric | package | (m.dots > 0.45) | any_of(m.low, BOILERPLATE) | marks)


def _likelihood(low: Column) -> Column:
    symbols = F.length(low) - F.length(F.translate(low, "".join(MATH_SYMBOLS), ""))
    words = sum((F.contains(low, F.lit(w)).cast("int") for w in MATH_WORDS), F.lit(0))
    raw = 0.5 * (symbols / 5) + 0.5 * (words / 2)
    return F.round(F.least(F.lit(1.0), raw * F.least(F.length(low) / 200, F.lit(1.0))), 3)


def _kind(m: Column) -> Column:
    return (
        F.when(F.contains(m.s, F.lit("=>")), "wiring")
        .when(m.low.rlike(ascii_edges(r"\bfigure\s+[0-9]+")), "figure")
        .when(m.low.rlike(ascii_edges(TABLE_WORDS)) & (m.digits > 0.08), "table")
        .when(_likelihood(m.low) >= 0.25, "formula")
        .when(m.s.rlike(r"^[-*•]\s+") | m.s.rlike(r"^[0-9]+[).]\s+"), "list")
        .otherwise("paragraph")
    )


def _heading(m: Column, numeric: Column, package: Column) -> Column:
    words = F.split(m.s, " ")  # looked at in short lines alone
    title = let(F.regexp_replace(m.low, ":+$", ""), lambda low: low.isin(STRONG_TITLES) | low.rlike("^(" + "|".join(STRONG_STARTS) + ") "))
    capitals = (m.s == F.upper(m.s)) & F.length(m.s).between(5, 100) & (F.size(words) >= 2) & F.exists(words, lambda w: F.length(F.regexp_replace(w, TRIMMED, "")) > 3)
    usable = (m.s != "") & (blanks(m.s) < 12) & (m.digits <= 0.25) & ~numeric & ~package
    return usable & (title | m.s.rlike(NUMBERED) | m.low.rlike(NOTICE) | capitals)


def classified(line: Column) -> Column:
    """Of a squeezed line: (s, low, digits, alpha, marks, dots, kind, heading, low_value, n_tokens), each measure made once."""
    def all_of(m: Column) -> Column:
        judged = F.struct(_numeric(m).alias("numeric"), _package(m).alias("package"))
        n_tokens = F.size(F.regexp_extract_all(m.low, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0)))
        return let(judged, lambda j: F.struct(*(m[c].alias(c) for c in ("s", "low", "digits", "alpha", "marks", "dots")), _kind(m).alias("kind"), _heading(m, j.numeric, j.package).alias("heading"), _low_value(m, j.numeric, j.package).alias("low_value"), n_tokens.alias("n_tokens")))

    return let(measures(line), all_of)


def low_value_line(line: Column) -> Column:
    """Lines that say nothing: numbers, cells of tables, order codes, dot leaders, boilerplate, marks. An empty line is none."""
    return let(measures(line), lambda m: _low_value(m, _numeric(m), _package(m)))


def squeezed(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"\s+", " "))


def normalized(text: Column) -> Column:
    """The text without low-value lines and with single blanks; blank lines inside stay."""
    lines = F.transform(F.split(text, "\r\n|\r|\n"), squeezed)
    return F.regexp_replace(F.array_join(F.filter(lines, lambda x: ~low_value_line(x)), "\n"), r"^\s+|\s+$", "")


def equation_likelihood(line: Column) -> Column:
    return let(F.lower(squeezed(line)), _likelihood)


def quality_flags(line: Column) -> Column:
    """Flags of a classified line, in fixed order."""
    plain, unstructured = ~line.kind.isin("table", "formula", "wiring", "code"), ~line.kind.isin("table", "formula", "code")
    rules = {
        "dot_leader": line.dots > 0.25,
        "low_alpha": (line.alpha < 0.18) & plain,
        "symbol_heavy": (line.marks > 0.45) & plain,
        "numeric_heavy": (line.digits > 0.45) & (line.alpha < 0.25) & unstructured,
        "too_short": line.n_tokens < MIN_TOKENS,
        "repeated_dots": line.s.rlike(r"\.{8,}"),
    }
    return F.when(line.s == "", F.array(F.lit("empty"))).otherwise(F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules.items()))))


def text_quality(line: Column) -> Column:
    """The quality_score of a squeezed text's flags. One pass over the text takes out its letters; marks, digits and dots are counted in
    what is left. The kind is made where a share asks for it alone, and five tokens are sought from the start, not counted."""

    def judged(m: Column) -> Column:
        n = F.greatest(F.length(m.s), F.lit(1))
        left = lambda letters: (F.length(m.rest) - F.length(F.regexp_replace(m.rest, f"[{letters}]+", ""))) / n
        shares = F.struct(m.s.alias("s"), m.low.alias("low"), left("0-9").alias("digits"), ((F.length(m.s) - F.length(m.rest)) / n).alias("alpha"), left(r"^\p{L}\p{N}\s").alias("marks"), left(".").alias("dots"))
        return let(shares, flagged)

    def flagged(m: Column) -> Column:
        few = F.when(m.s.rlike(rf"^(?:\s*+(?:[\p{{L}}\p{{N}}_]++|[^\p{{L}}\p{{N}}_\s])){{{MIN_TOKENS}}}"), MIN_TOKENS).otherwise(0)
        return let(quality_flags(_Line(m, few)), quality_score)

    return let(F.struct(line.alias("s"), F.lower(line).alias("low"), F.regexp_replace(line, r"\p{L}+", "").alias("rest")), judged)


class _Line:
    """What quality_flags asks of a classified line, with the kind as an expression of its own."""

    def __init__(self, m: Column, n_tokens: Column):
        self.s, self.dots, self.alpha, self.marks, self.digits, self.kind, self.n_tokens = m.s, m.dots, m.alpha, m.marks, m.digits, _kind(m), n_tokens


# What a flag costs.
PENALTIES = {"dot_leader": 0.55, "low_alpha": 0.35, "symbol_heavy": 0.35, "numeric_heavy": 0.55, "too_short": 0.4, "repeated_dots": 0.45}


def quality_score(flags: Column) -> Column:
    """1 less the penalties of the flags, from 0 to 1; 0 for an empty text."""
    lost = sum((F.when(F.array_contains(flags, F.lit(f)), p).otherwise(0.0) for f, p in PENALTIES.items()), F.lit(0.0))
    return F.when(F.array_contains(flags, F.lit("empty")), 0.0).otherwise(F.round(F.greatest(F.lit(0.0), 1.0 - lost), 3))


def low_value_chunk(text: Column, kind: Column) -> Column:
    known = any_of(F.lower(text), DOMAIN_TERMS)
    words = F.size(F.regexp_extract_all(text, F.lit("[a-zA-Z]{2,}"), F.lit(0)))
    plain = ((words < 2) & ~known) | ((kind == "table") & (share(text, "0-9") > 0.35) & ~known) | text.rlike(DATE)
    return (text == "") | F.when(kind == "code", ~text.rlike("[A-Za-z_]")).otherwise(plain)
