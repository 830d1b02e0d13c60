"""Rules around ingestion: quality of recognized text, pages to render, review health, repaired pins, evidence, worker counts; with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import lines as L
from loomline.plans.document_rules import _SHEETS, sheets
from loomline.plans.line_rules import _SQUEEZED, _any, _low, _share
from loomline.plans.registry import query
from loomline.sources.tables import lines, table

# Words and patterns of useful short texts, thresholds, markers of evidence.
SIGNAL_WORDS = ["breadboard", "component", "connection", "resistor", "capacitor", "transistor", "diode", "led", "switch", "jumper", "battery", "ground", "timer", "trigger", "threshold", "discharge", "reset", "output", "input", "vcc", "gnd", "pin", "ohm", "kohm", "uf", "pf", "nf", "volt", "voltage", "current", "frequency", "duty", "monostable", "astable", "experiment", "chapter", "schematic"]
SIGNAL_WIRE = r"\b[A-Z]{1,6}[0-9]*\([A-Z+\-]+\)\s*=>\s*[A-Z][0-9]+\b"
SIGNAL_VALUE = r"\b[0-9]+(\.[0-9]+)?\s*(k?ohm|kq|q|uf|µf|pf|nf|v|ma)\b"
PAGE_LABEL = r"(?i)^(page|fig(ure)?|table)?\s*[0-9]+[A-Za-z]?$"
EVIDENCE_MARKERS = ["pin functions", "pin function", "pin description", "pin descriptions", "pin configuration", "pin configurations", "pin assignment", "pin assignments", "pin arrangement", "pin no", "pin number", "lead configuration", "lead assignments", "connection diagram", "terminal function", "terminal functions", "terminal assignment", "terminal assignments", "electrical characteristics", "recommended operating", "absolute maximum"]
PIN_WORDS = r"\b(?:anode|cathode|emitter|collector|base|vcc|vdd|vss|vee|gnd|sda|scl|addr|out|output|input|reset|trigger|threshold|discharge|control|nc|no\s+connection)\b"
PIN_ROW = r"(?i)\b(?:A|C|K|NC)\s+[0-9]{1,2}\s+[0-9]{1,2}\s+(?:B|C|E|NC)\b"
SUPPLY = r"\b(?:vcc|vdd|gnd|supply voltage|operating voltage|output current)\b"


def recognized_quality(rows: DataFrame, line: str, confidence: str | None = None) -> DataFrame:
    """rows with (score, detail) of a squeezed text from recognition, 0 to 1. Each step is a column of its own, so that it is made once."""
    rows = rows.withColumn("_text", F.when(L.low_value_line(F.col(line)), "").otherwise(F.col(line)))
    text = F.col("_text")
    n, words, signal = F.length(text), F.size(F.split(text, " ")), F.col("_signal")
    rows = rows.withColumn("_signal", L.any_of(F.lower(text), SIGNAL_WORDS) | text.rlike(SIGNAL_WIRE) | F.lower(text).rlike(SIGNAL_VALUE))
    few = F.size(F.regexp_extract_all(text, F.lit("[A-Za-z]{2,}"), F.lit(0))) < 6
    marks = {"too short": n < 20, "short text without electronics signal": (n < 80) & ~signal, "low meaningful word count": few & ~signal, "low uniqueness": F.size(F.array_distinct(F.split(text, ""))) < 10, "long words": (n - words + 1) / words > 12,
             "low alphabetic ratio": L.share(text, r"\p{L}") < 0.3, "too many symbols": L.share(text, r"^\p{L}\p{N}\s") > 0.4, "too many digits": L.share(text, "0-9") > 0.5, "too much whitespace": L.share(text, " ") > 0.3,
             "low confidence": F.lit(False) if confidence is None else F.coalesce(F.col(confidence) < 25, F.lit(False))}
    rows = rows.withColumn("_marks", F.array_compact(F.array(*(F.when(c, k) for k, c in marks.items()))))
    has = lambda k: F.array_contains("_marks", F.lit(k))
    caps = F.least(F.when(has("too short"), 0.6).otherwise(1.0), F.when(has("short text without electronics signal"), 0.3).otherwise(1.0), F.when(has("low meaningful word count"), 0.2).otherwise(1.0))
    lost = {"low uniqueness": 0.3, "long words": 0.2, "low alphabetic ratio": 0.2, "too many symbols": 0.2, "too many digits": 0.2, "too much whitespace": 0.2, "low confidence": 0.3}
    score = F.greatest(F.lit(0.0), F.round(caps - sum((F.when(has(k), p).otherwise(0.0) for k, p in lost.items()), F.lit(0.0)), 2))
    noise = ~text.rlike(r"\p{L}") | text.rlike(PAGE_LABEL) | text.rlike(L.DATE)
    done = rows.withColumn("score", F.when((text == "") | noise, 0.0).otherwise(score)).withColumn("detail", F.when(text == "", "Empty").when(noise, "isolated OCR noise").otherwise(F.array_join("_marks", ", ")))
    return done.drop("_text", "_signal", "_marks")


_SIGNAL = f"({_any('lower(t)', SIGNAL_WORDS)} OR regexp_matches(t, '{SIGNAL_WIRE}') OR regexp_matches(lower(t), '{SIGNAL_VALUE}'))"
_LETTER, _MARK = chr(92) + "p{L}", "^" + chr(92) + "p{L}" + chr(92) + "p{N}" + chr(92) + "s"


@query(rf"""WITH {_SQUEEZED}, c AS (SELECT doc_id, line_index, CASE WHEN {_low('s')} THEN '' ELSE s END AS t FROM z), m AS (SELECT doc_id, line_index, t, length(t) < 20 AS a, length(t) < 80 AND NOT {_SIGNAL} AS b,
len(regexp_extract_all(t, '[A-Za-z]{{2,}}')) < 6 AND NOT {_SIGNAL} AS c, len(list_distinct(string_split(t, ''))) < 10 AS d, (length(t) - len(string_split(t, ' ')) + 1) / len(string_split(t, ' ')) > 12 AS e, {_share('t', _LETTER)} < 0.3 AS f, {_share('t', _MARK)} > 0.4 AS g, {_share('t', '0-9')} > 0.5 AS h, {_share('t', ' ')} > 0.3 AS i,
NOT regexp_matches(t, '\p{{L}}') OR regexp_matches(t, '{PAGE_LABEL}') OR regexp_matches(t, '{L.DATE}') AS noise FROM c),
s AS (SELECT *, least(CASE WHEN a THEN 0.6 ELSE 1 END, CASE WHEN b THEN 0.3 ELSE 1 END, CASE WHEN c THEN 0.2 ELSE 1 END) - CASE WHEN d THEN 0.3 ELSE 0 END - 0.2 * (CAST(e AS INTEGER) + CAST(f AS INTEGER) + CAST(g AS INTEGER) + CAST(h AS INTEGER) + CAST(i AS INTEGER)) AS v FROM m)
SELECT doc_id, line_index, CAST(CASE WHEN t = '' OR noise THEN 0 ELSE greatest(0, round(v, 2)) END AS DOUBLE) AS score, CASE WHEN t = '' THEN 'Empty' WHEN noise THEN 'isolated OCR noise' ELSE concat_ws(', ', CASE WHEN a THEN 'too short' END, CASE WHEN b THEN 'short text without electronics signal' END,
CASE WHEN c THEN 'low meaningful word count' END, CASE WHEN d THEN 'low uniqueness' END, CASE WHEN e THEN 'long words' END, CASE WHEN f THEN 'low alphabetic ratio' END, CASE WHEN g THEN 'too many symbols' END, CASE WHEN h THEN 'too many digits' END, CASE WHEN i THEN 'too much whitespace' END) END AS detail FROM s""")
def recognized_lines(spark, sf_dir):
    """Each line as a text from recognition."""
    rows = lines(table(spark, sf_dir, "documents")).select("doc_id", F.col("line_index").cast("long").alias("line_index"), L.squeezed(F.col("line")).alias("s"))
    return recognized_quality(rows, "s").select("doc_id", "line_index", "score", "detail")


def render_reasons(pages: DataFrame) -> DataFrame:
    """Pages (doc, page, chars, images, coverage, drawings, hits, figures) to render, each with the first reason that holds. A document
    of which 60 percent of the pages have under 80 characters counts as scanned; its pages meet once, for that share alone."""
    sparse = F.col("chars") < 80
    share = F.avg(sparse.cast("double")).over(Window.partitionBy("doc"))
    reason = (F.when((F.col("share") >= 0.6) & sparse, "scanned page OCR").when((F.col("images") > 0) & (F.col("coverage") >= 0.8) & sparse, "raster-heavy page OCR").when(F.col("drawings") >= 200, "dense vector page")
              .when((F.col("drawings") >= 100) & ((F.col("hits") > 0) | F.col("figures")), "visual datasheet page").when(F.col("figures") & (F.col("images") > 0), "datasheet figure page"))
    return pages.withColumn("share", share).select("doc", "page", reason.alias("reason")).where("reason IS NOT NULL")


@query("""WITH p AS (SELECT l_orderkey AS doc, l_linenumber AS page, l_quantity * 4 AS chars, l_linenumber % 3 AS images, l_discount * 10 AS coverage, l_extendedprice / 200 AS drawings, l_suppkey % 4 AS hits, l_returnflag = 'R' AS figures FROM lineitem),
s AS (SELECT *, avg(CASE WHEN chars < 80 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY doc) AS share FROM p), r AS (SELECT doc, page, CASE WHEN share >= 0.6 AND chars < 80 THEN 'scanned page OCR' WHEN images > 0 AND coverage >= 0.8 AND chars < 80 THEN 'raster-heavy page OCR' WHEN drawings >= 200 THEN 'dense vector page'
WHEN drawings >= 100 AND (hits > 0 OR figures) THEN 'visual datasheet page' WHEN figures AND images > 0 THEN 'datasheet figure page' END AS reason FROM s) SELECT * FROM r WHERE reason IS NOT NULL""")
def pages_to_render(spark, sf_dir):
    """Order lines as pages."""
    c = F.col
    pages = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("doc"), c("l_linenumber").alias("page"), (c("l_quantity") * 4).alias("chars"), (c("l_linenumber") % 3).alias("images"), (c("l_discount") * 10).alias("coverage"), (c("l_extendedprice") / 200).alias("drawings"), (c("l_suppkey") % 4).alias("hits"), (c("l_returnflag") == "R").alias("figures"))
    return render_reasons(pages)


def review_health(chunks: Column, low: Column, dropped: Column, found: Column, stored: Column, texts: Column, quality: Column, component: Column, pins: Column, error: Column) -> Column:
    """(level, approve, notes): blocked by an error or no chunks, attention with any warning, else clean; approve where quality is 0.98 or more."""
    reasons = F.array_compact(F.array(F.when(error.isNotNull(), "error"), F.when(chunks <= 0, "no_chunks")))
    warnings = F.array_compact(F.array(F.when(low > 0, "low_quality"), F.when(dropped > F.greatest(F.lit(4.0), chunks * 0.08), "dropped"), F.when((found > 0) & (stored <= 0), "not_stored"), F.when((stored > 0) & (texts <= 0), "no_text"), F.when(component & (pins <= 0), "no_pinout")))
    level = F.when(F.size(reasons) > 0, "blocked").when(F.size(warnings) > 0, "attention").otherwise("clean")
    return F.struct(level.alias("level"), ((level == "clean") & (quality >= 0.98)).alias("approve"), F.array_join(F.concat(reasons, warnings), ",").alias("notes"))


@query("""WITH s AS (SELECT doc_id, lang, source, len(string_split(text, chr(10))) AS chunks, len(list_filter(string_split(text, chr(10)), lambda x: length(x) BETWEEN 1 AND 9)) AS low, len(list_filter(string_split(text, chr(10)), lambda x: x = '')) AS dropped, n_chars % 3 AS found, n_chars % 5 AS stored, n_chars % 2 AS texts, n_chars % 7 AS pins, CASE WHEN doc_id % 13 = 0 THEN 'failed' END AS error FROM documents),
n AS (SELECT *, [CASE WHEN error IS NOT NULL THEN 'error' END, CASE WHEN chunks <= 0 THEN 'no_chunks' END] AS r, [CASE WHEN low > 0 THEN 'low_quality' END, CASE WHEN dropped > greatest(4, chunks * 0.08) THEN 'dropped' END, CASE WHEN found > 0 AND stored <= 0 THEN 'not_stored' END, CASE WHEN stored > 0 AND texts <= 0 THEN 'no_text' END, CASE WHEN lang = 'en' AND pins <= 0 THEN 'no_pinout' END] AS w FROM s),
v AS (SELECT *, CASE WHEN len(list_filter(r, lambda x: x IS NOT NULL)) > 0 THEN 'blocked' WHEN len(list_filter(w, lambda x: x IS NOT NULL)) > 0 THEN 'attention' ELSE 'clean' END AS level FROM n)
SELECT doc_id, level, level = 'clean' AND 1 - low / greatest(chunks, 1) >= 0.98 AS approve, array_to_string(list_filter(r || w, lambda x: x IS NOT NULL), ',') AS notes FROM v""")
def review_levels(spark, sf_dir):
    """Review health of each document, from its own lines."""
    parts, n = F.split("text", "\n"), F.col("n_chars")
    low, chunks = F.size(F.filter(parts, lambda x: F.length(x).between(1, 9))), F.size(parts)
    health = review_health(chunks, low, F.size(F.filter(parts, lambda x: x == "")), n % 3, n % 5, n % 2, 1 - low / F.greatest(chunks, F.lit(1)), F.coalesce(F.col("lang") == "en", F.lit(False)), n % 7, F.when(F.col("doc_id") % 13 == 0, "failed"))
    return table(spark, sf_dir, "documents").select("doc_id", health.alias("h")).select("doc_id", "h.level", "h.approve", "h.notes")


def clean_pins(rows: DataFrame) -> DataFrame:
    """(doc, pin, label): for each positive pin the first row (by seq) with a label of 1 to 40 characters; of equal seq, the first label."""
    usable = rows.withColumn("label", L.squeezed(F.coalesce("label", F.lit("")))).where((F.col("pin") > 0) & F.length("label").between(1, 40))
    return usable.groupBy("doc", "pin").agg(F.min(F.struct("seq", "label"))["label"].alias("label"))


def stronger(repaired: DataFrame, known: DataFrame) -> DataFrame:
    """(doc, n_repaired, n_known, replace): a repaired list of 3 pins or more replaces none, a shorter one, or one with gaps if it has none."""
    measure = lambda rows, name: rows.groupBy("doc").agg(F.count("*").alias(f"n_{name}"), ((F.count("*") >= 4) & ((F.max("pin") - F.min("pin") + 1 != F.count("*")) | (F.count_distinct("pin") != F.count("*")))).alias(f"gaps_{name}"))
    both = measure(repaired, "repaired").join(measure(known, "known"), "doc", "full_outer").select("doc", *(F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in ("repaired", "known")), *(F.coalesce(f"gaps_{k}", F.lit(False)).alias(f"gaps_{k}") for k in ("repaired", "known")))
    better = (F.col("n_known") == 0) | (F.col("n_repaired") > F.col("n_known")) | (F.col("gaps_known") & ~F.col("gaps_repaired"))
    return both.select("doc", "n_repaired", "n_known", ((F.col("n_repaired") >= 3) & better).alias("replace"))


_PINS = """raw AS (SELECT l_orderkey AS doc, l_linenumber AS seq, CAST(l_quantity AS BIGINT) % 9 - 1 AS pin, CASE WHEN l_linenumber % 4 = 0 THEN '  ' ELSE ' ' || l_returnflag || '  ' || l_linestatus END AS label FROM lineitem),
pins AS (SELECT doc, pin, trim(regexp_replace(label, '\\s+', ' ', 'g')) AS label FROM raw WHERE pin > 0 AND trim(label) <> '' QUALIFY row_number() OVER (PARTITION BY doc, pin ORDER BY seq, trim(label)) = 1)"""


def _pins(spark, sf_dir):
    label = F.when(F.col("l_linenumber") % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "l_returnflag", F.lit("  "), "l_linestatus"))
    return clean_pins(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("seq"), (F.col("l_quantity").cast("long") % 9 - 1).alias("pin"), label.alias("label")))


@query(f"""WITH {_PINS} SELECT doc, pin, label FROM pins""")
def repaired_pins(spark, sf_dir):
    return _pins(spark, sf_dir)


@query(f"""WITH {_PINS}, a AS (SELECT doc, count(*) AS n, count(*) >= 4 AND max(pin) - min(pin) + 1 <> count(*) AS gaps FROM pins GROUP BY doc),
b AS (SELECT l_orderkey AS doc, count(*) AS n, count(*) >= 4 AND (max(l_linenumber) - min(l_linenumber) + 1 <> count(*) OR count(DISTINCT l_linenumber) <> count(*)) AS gaps FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)
SELECT coalesce(a.doc, b.doc) AS doc, coalesce(a.n, 0) AS n_repaired, coalesce(b.n, 0) AS n_known, coalesce(a.n, 0) >= 3 AND (b.n IS NULL OR a.n > b.n OR (b.gaps AND NOT a.gaps)) AS replace FROM a FULL JOIN b ON a.doc = b.doc""")
def stronger_pinouts(spark, sf_dir):
    return stronger(_pins(spark, sf_dir), table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pin")))


def evidence_score(text: Column) -> Column:
    low = F.lower(text)
    hits = F.size(F.regexp_extract_all(low, F.lit(PIN_WORDS), F.lit(0)))
    marked = sum((F.when(F.contains(low, F.lit(m)), 5).otherwise(0) for m in EVIDENCE_MARKERS), F.lit(0))
    return marked + F.when(hits >= 3, F.least(F.lit(6), hits)).otherwise(0) + F.when(text.rlike(PIN_ROW), 8).otherwise(0) + F.when(low.rlike(SUPPLY), 2).otherwise(0)


def worker_target(workers: Column, celsius: Column) -> Column:
    """(level, target) of workers by temperature; halves go to the even number, at least one worker stays."""
    level = F.when(workers <= 1, "not_applicable").when(celsius.isNull(), "unavailable").when(celsius >= 95, "hard").when(celsius >= 92, "high").when(celsius >= 90, "moderate").otherwise("headroom")
    cut = F.when(level == "hard", F.lit(1.0)).when(level == "high", workers * 0.5).when(level == "moderate", workers * 0.75).otherwise(workers.cast("double"))
    return F.struct(level.alias("level"), F.when(level.isin("not_applicable", "unavailable"), workers.cast("long")).otherwise(F.greatest(F.lit(1), F.least(workers, F.bround(cut, 0))).cast("long")).alias("target"))


@query("""WITH e AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN 85 + value END AS c, user_id % 9 AS w FROM events), l AS (SELECT *, CASE WHEN w <= 1 THEN 'not_applicable' WHEN c IS NULL THEN 'unavailable' WHEN c >= 95 THEN 'hard' WHEN c >= 92 THEN 'high' WHEN c >= 90 THEN 'moderate' ELSE 'headroom' END AS level FROM e)
SELECT event_id, level, CAST(CASE level WHEN 'hard' THEN 1 WHEN 'high' THEN greatest(1, round_even(w * 0.5, 0)) WHEN 'moderate' THEN greatest(1, round_even(w * 0.75, 0)) ELSE w END AS BIGINT) AS target FROM l""")
def thermal_workers(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", worker_target(F.col("user_id") % 9, F.when(F.col("event_type") != "error", 85 + F.col("value"))).alias("t"))
    return rows.select("event_id", "t.level", "t.target")


@query("""SELECT event_type, CAST(date_trunc('day', ts + INTERVAL 2 HOUR) AS DATE) AS day, max(value) AS peak FROM events GROUP BY 1, 2""")
def daily_peaks(spark, sf_dir, ahead: str = "INTERVAL 2 HOURS"):
    """The peak of each kind since local midnight, for each local day of a place so far ahead."""
    return table(spark, sf_dir, "events").groupBy("event_type", F.to_date(F.col("ts") + F.expr(ahead)).alias("day")).agg(F.max("value").alias("peak"))


_EVIDENCE_SCORE = " + ".join(f"CASE WHEN contains(lower(s), '{m}') THEN 5 ELSE 0 END" for m in EVIDENCE_MARKERS) + f" + CASE WHEN len(regexp_extract_all(lower(s), '{PIN_WORDS}')) >= 3 THEN least(6, len(regexp_extract_all(lower(s), '{PIN_WORDS}'))) ELSE 0 END + CASE WHEN regexp_matches(s, '{PIN_ROW}') THEN 8 ELSE 0 END + CASE WHEN regexp_matches(lower(s), '{SUPPLY}') THEN 2 ELSE 0 END"


@query(f"""WITH {_SHEETS}, y AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_index, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM sheets)), z AS (SELECT doc_id, line_index, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS s FROM y),
e AS (SELECT doc_id, line_index, length(s) + length(line_index::VARCHAR) + 9 AS n, {_EVIDENCE_SCORE} AS score FROM z WHERE s <> ''),
r AS (SELECT *, row_number() OVER w AS k, coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, line_index)) SELECT doc_id, line_index, CAST(score AS BIGINT) AS score FROM r WHERE (k = 1 OR score > 0) AND before < 9000""")
def evidence_lines(spark, sf_dir, most: int = 9000):
    """Lines that show pins best, in order of score, until `most` characters are reached; the line that reaches them stays, and without any score the first line."""
    rows = lines(sheets(spark, sf_dir)).select("doc_id", F.col("line_index").cast("long").alias("line_index"), L.squeezed(F.col("line")).alias("s")).where("s <> ''")
    scored = rows.select("doc_id", "line_index", (F.length("s") + F.length(F.col("line_index").cast("string")) + 9).alias("n"), evidence_score(F.col("s")).cast("long").alias("score"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "line_index")
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = scored.withColumn("k", F.row_number().over(w)).withColumn("before", before)
    return ranked.where(((F.col("k") == 1) | (F.col("score") > 0)) & (F.col("before") < most)).select("doc_id", "line_index", "score")
