"""Column helpers: predicates, text measures and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def visible_to(entity: int | None) -> Column:
    """Global rows, and those of the active entity; without one, global rows only."""
    shared = F.coalesce(F.col("is_global"), F.lit(False))
    return shared if entity is None else shared | (F.col("entity_id") == entity)


def share(text: str, letters: str) -> Column:
    """Share of a text's characters in a class."""
    n = F.length(text)
    return F.when(n > 0, (n - F.length(F.regexp_replace(text, f"[{letters}]", ""))) / n).otherwise(0.0)


def n_tokens(text: str) -> Column:
    """Words and single marks of the lower-case text, with Unicode classes."""
    return F.size(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0))).cast("long")


def redact(text: str, phrases: list[str]) -> Column:
    """Each phrase (a pattern, in either case) replaced, one after another."""
    out = F.col(text)
    for p in phrases:
        out = F.regexp_replace(out, f"(?i){p}", "[REDACTED]")
    return out


def line_kind(line: str) -> Column:
    """The first kind of line whose rule holds."""
    c = F.col(line)
    return (
        F.when(F.length(F.trim(c)) == 0, "blank")
        .when(c.rlike(r"^\s*[-*•] "), "list")
        .when(c.rlike(r"\|"), "table")
        .when(c.rlike(r"[=+^]") & c.rlike(r"[0-9]"), "formula")
        .otherwise("paragraph")
    )


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of numbers, in double precision."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def load_percent(value: Column, full: float) -> Column:
    return F.least(F.lit(100.0), value / full * 100)


def low_value(line: Column) -> Column:
    """Lines of digits only, and dot leaders."""
    dots = F.length(line) - F.length(F.replace(line, F.lit("."), F.lit("")))
    return line.rlike(r"^[0-9 .,]*$") | (dots > 0.45 * F.length(line))


def part_name(name: str, between: str = " ") -> Column:
    """Lower-case letters and digits; all else becomes `between`."""
    plain = F.lower(F.replace(F.replace(name, F.lit("µ"), F.lit("u")), F.lit("Ω"), F.lit("ohm")))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", between))


def category(text: Column, categories: list[tuple[str, int, list[str]]], default: str) -> Column:
    """The category with the most keyword hits; of equal ones the one with the higher priority."""
    hits = [(name, priority, sum(((F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))) / len(w) for w in words), F.lit(0.0))) for name, priority, words in categories]
    best = F.greatest(*(F.struct(n.alias("n"), F.lit(priority).alias("priority"), F.lit(name).alias("name")) for name, priority, n in hits))
    return F.when(best["n"] > 0, best["name"]).otherwise(default)
