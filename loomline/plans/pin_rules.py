"""Pinouts from chunks of data sheets: eight layouts in order, the order of a diagram without numbers, and what replaces what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions import pins as P
from loomline.plans.registry import query
from loomline.sources.tables import table


def found_pins(chunks: DataFrame) -> DataFrame:
    """(doc, pins): of each document (doc, page, chunk_index, text) the first pin of each number, by chunk and precedence."""
    texts = chunks.withColumn("text", F.coalesce("text", F.lit(""))).withColumns({"upper": F.upper("text"), "lines": F.split("text", r"\R")})
    each = texts.select("doc", "page", "chunk_index", F.posexplode(P.candidates(F.col("text"), F.col("upper"), F.col("lines"))).alias("place", "found"))
    first = each.groupBy("doc", "found.pin").agg(F.min(F.struct("chunk_index", "place", "page", F.col("found.label").alias("label"), F.col("found.role").alias("role"))).alias("first"))
    pin = F.struct("pin", "first.label", "first.role", "first.page", "first.chunk_index")
    return first.groupBy("doc").agg(F.sort_array(F.collect_list(pin)).alias("pins"))


def ordered_pins(chunks: DataFrame) -> DataFrame:
    """(doc, sequences): the pins of pages that list functions, in the order of the diagram before them. Only chunks of pages
    with a heading are gathered, a page in one row."""
    marked = chunks.where(F.upper("text").rlike(P.any_marker())).select("doc", F.col("page").alias("marked")).distinct()
    here = chunks.alias("c").join(marked.alias("m"), (F.col("c.doc") == F.col("m.doc")) & F.col("page").eqNullSafe(F.col("marked")), "left_semi")
    pages = here.groupBy("doc", "page").agg(F.sort_array(F.collect_list(F.struct("chunk_index", F.coalesce("text", F.lit("")).alias("text")))).alias("chunks"))
    pages = pages.withColumn("all", F.concat_ws("\n", F.transform("chunks", lambda c: c.text)))
    pages = pages.withColumn("heads", P.compact(F.col("all"))).where(F.size(F.filter(F.array(*map(F.lit, P.COLUMNS)), lambda w: F.contains(F.col("heads"), w))) >= 3)
    cut = F.array_min(F.transform("chunks", lambda c, i: F.when(F.upper(c.text).rlike(P.any_marker()), i)))
    before = lambda c: F.element_at(F.split(c.text, f"(?i){P.any_marker()}", 2), 1)
    diagram = F.filter(F.transform(F.slice("chunks", F.lit(1), cut + 1), lambda c: F.struct(c.chunk_index.alias("chunk_index"), before(c).alias("text"))), lambda c: F.trim(c.text) != "")
    lines = F.flatten(F.transform(diagram, lambda c: F.transform(F.split(c.text, r"\R"), lambda x: F.struct(c.chunk_index.alias("chunk_index"), x.alias("line")))))
    pages = pages.withColumn("labels", P.signal_lines(lines)).withColumn("run", P.best_run(F.col("labels")))
    support = F.expr(f"substring(upper(all), regexp_instr(upper(all), '{P.any_marker()}'))")
    pages = pages.where("run IS NOT NULL").withColumn("run", P.supported(F.col("run"), support)).withColumn("run", P.plausible(F.col("run"))).where("run IS NOT NULL")
    pin = F.transform("run", lambda x, i: F.struct((i + 1).alias("pin"), x.label.alias("label"), F.lit("").alias("role"), F.col("page").alias("page"), x.chunk_index.alias("chunk_index")))
    return pages.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct(F.col("chunks")[0]["chunk_index"].alias("first"), pin.alias("pins")))).alias("sequences"))


def pinouts(chunks: DataFrame) -> DataFrame:
    """(doc, pin, label, function, page, chunk_index) of each document's pins.

    chunks are (doc, page, chunk_index, text). A page's sequence replaces pins of the same numbers if it is longer than all that
    is known, or shows more; else it fills gaps. Null texts and pages are empty, and a page of their own; an empty table has no pins."""
    page, chunk = chunks.schema["page"].dataType.simpleString(), chunks.schema["chunk_index"].dataType.simpleString()
    pins = f"array<struct<pin:int,label:string,role:string,page:{page},chunk_index:{chunk}>>"
    empty = lambda kind: F.array().cast(kind)
    both = found_pins(chunks).join(ordered_pins(chunks), "doc", "full_outer")
    without = lambda pins, others: F.filter(pins, lambda p: ~F.exists(others, lambda o: o.pin == p.pin))

    def merge(known, page):
        better = (F.size(page.pins) > F.size(known)) | (P.evidence(page.pins) > P.evidence(known))
        return F.when(better, F.concat(page.pins, without(known, page.pins))).otherwise(F.concat(known, without(page.pins, known)))

    sequences = F.coalesce("sequences", empty(f"array<struct<first:{chunk},pins:{pins}>>"))
    merged = F.aggregate(sequences, F.coalesce("pins", empty(pins)), merge)
    rows = both.select("doc", F.explode(merged).alias("p"))
    return rows.select("doc", "p.pin", "p.label", P.pin_function(F.col("p.label"), F.col("p.role")).alias("function"), "p.page", "p.chunk_index")


def pin_sheets(parts: DataFrame) -> DataFrame:
    """(doc, page, chunk_index, text): a short data sheet of each part, in one of eight layouts; the pins are GND, VCC and signals."""
    n = (4 + 2 * (F.floor(F.col("p_partkey") / 8) % 3)).cast("int")
    rows = parts.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("doc"), (F.col("p_partkey") % 8).alias("layout"), n.alias("n"), F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i == 1, "GND").when(i == 2, "VCC").otherwise(F.concat(F.lit("S"), (F.col("p_size") + i).cast("string")))).alias("labels"))
    say = lambda head, line, sep="\n": F.concat(F.lit(head), F.array_join(F.transform("labels", lambda x, i: F.concat(*(F.lit(c) if isinstance(c, str) else c for c in line(x, (i + 1).cast("string"))))), sep))
    other = lambda i: F.get("labels", F.col("n") - i.cast("int"))
    half = F.array_join(F.transform(F.slice("labels", F.lit(1), F.col("n") / 2), lambda x, i: F.concat_ws(" ", x, i + 1, F.col("n") - i, other(i + 1))), "\n")
    plain = F.array_join("labels", "\n")
    layouts = [
        [say("A part.\n", lambda x, i: ("Pin ", i, ": ", x))],
        [say("Pin | Name | Function\n", lambda x, i: (i, " | ", x, " | some words"))],
        [say("Terminal Functions\nPin No. Symbol Description\n", lambda x, i: (i, " ", x, " some words"))],
        [say("PIN DESCRIPTIONS\nPIN #\n", lambda x, i: (i, "\n", x, "\nDigital Input\nsome words"))],
        [say("PINOUTS\n", lambda x, i: (x, ": some words"))],
        [say("Pin number Signal name Signal type ", lambda x, i: (i, " ", x, " Supply"), " ")],
        [F.concat(F.lit("Package Top View\n"), half)],
        [plain, F.concat(F.lit("Pin Functions\nPIN\nNAME\nI/O\nDESCRIPTION\n"), plain)],
    ]
    texts = F.coalesce(*(F.when(F.col("layout") == k, F.array(*texts)) for k, texts in enumerate(layouts)))
    return rows.select("doc", (F.col("layout") % 3 + 1).cast("int").alias("page"), F.posexplode(texts).alias("chunk_index", "text"))


@query("""WITH p AS (SELECT p_partkey AS k, 4 + 2 * (p_partkey // 8 % 3) AS n, p_size FROM part), i AS (SELECT k, p_size, unnest(range(1, n + 1)) AS pin FROM p), l AS (SELECT k, pin, CASE pin WHEN 1 THEN 'GND' WHEN 2 THEN 'VCC' ELSE 'S' || (p_size + pin) END AS label FROM i)
SELECT 'p' || k AS doc, CAST(pin AS INTEGER) AS pin, label, CASE label WHEN 'GND' THEN 'Ground' ELSE label END AS function, CAST(k % 8 % 3 + 1 AS INTEGER) AS page, 0 AS chunk_index FROM l""")
def document_pinouts(spark, sf_dir):
    """Pins of all documents, a whole text as one chunk, and of a sheet of each part. The tables' prose holds no pins, so that
    its rows are the sheets'; the SQL tells each sheet's pins from the part itself, not from its text."""
    texts = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc"), F.lit(None).cast("int").alias("page"), F.lit(0).alias("chunk_index"), "text")
    return pinouts(texts.unionByName(pin_sheets(table(spark, sf_dir, "part"))))
