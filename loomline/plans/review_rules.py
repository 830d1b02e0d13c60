"""The review queue and its filters, claims of jobs, references to documents, evidence of steps, and points of a chart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import code as C
from loomline.operators import windows as W
from loomline.plans.line_rules import _QUALITY, scored_lines
from loomline.plans.registry import _CATALOG, query
from loomline.sources.tables import catalog, lines, table

# Kinds of files, states that are reviewed, and the bound of low quality.
CODE = [".c", ".cc", ".cpp", ".cxx", ".go", ".h", ".hh", ".hpp", ".ino", ".js", ".jsx", ".py", ".rs", ".sh", ".ts", ".tsx"]
TEXT, METADATA = [".csv", ".log", ".md", ".rst", ".text", ".txt"], [".json", ".toml", ".xml", ".yaml", ".yml"]
STATUSES = {1: "pending", 2: "needs_review", 3: "indexed", 4: "failed"}
REVIEWED, LOW_QUALITY, ROOT = [2, 4], 0.35, "(root)"
MOST_POINTS, LONGEST_LABEL = 24, 26


def in_scope(scope: str, entity_id: int | None = None) -> Column:
    """all documents, global ones, or those of an entity alone; any other scope has none."""
    own = ~F.col("is_global") & (F.col("entity_id") == F.lit(entity_id))
    return {"all": F.lit(True), "global": F.col("is_global"), "entity": own}.get(scope, F.lit(False))


def review_list(docs: DataFrame, chunks: DataFrame, images: DataFrame, scope: str = "all", entity_id: int | None = None) -> DataFrame:
    """Documents (doc_id, status_id, is_global, entity_id, ...) that await review or failed, with numbers of chunks and images.

    chunks are (doc_id, quality), images (doc_id); both are aggregated before they are joined. Documents without any have 0."""
    stats = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"), F.round(F.avg("quality"), 6).alias("avg_quality"), F.count_if(F.col("quality") < LOW_QUALITY).alias("low_quality_count"))
    rows = docs.where(F.col("status_id").isin(REVIEWED) & in_scope(scope, entity_id)).join(stats, "doc_id", "left").join(images.groupBy("doc_id").agg(F.count("*").alias("image_count")), "doc_id", "left")
    return rows.fillna({"chunk_count": 0, "avg_quality": 0.0, "low_quality_count": 0, "image_count": 0})


def kind_of(path: Column) -> Column:
    end = C.suffix(path)
    return F.when(end == ".pdf", "pdf").when(end.isin(CODE), "code").when(end.isin(TEXT), "text").when(end.isin(METADATA), "metadata").otherwise("other")


def folder_of(path: Column) -> Column:
    """The first folder of a path; a path without one is at the root."""
    path = F.trim(path)
    return F.when(F.contains(path, F.lit("/")), F.coalesce(F.get(F.filter(F.split(path, "/"), lambda x: x != ""), F.lit(0)), F.lit(ROOT))).otherwise(ROOT)


def healths() -> dict[str, Column]:
    """Tests of a row of the review list, by name."""
    failed = (F.coalesce("last_error", F.lit("")) != "") | F.lower("status").rlike("fail|error")
    low = (F.col("low_quality_count") > 0) | ((F.col("chunk_count") > 0) & (F.col("avg_quality") < LOW_QUALITY))
    return {"failed": failed, "no-chunks": F.col("chunk_count") <= 0, "low-quality": low, "with-images": F.col("image_count") > 0, "without-images": F.col("image_count") <= 0}


def triage(rows: DataFrame, search: str = "", kind: str = "all", health: str = "all", folder: str = "all") -> DataFrame:
    """Rows of the review list (path, name, status, scope_label, last_error, ...) that pass all filters. A search looks for the words as they stand in name, path, state and
    scope, in any case."""
    needle = search.strip().lower()
    keep = F.contains(F.lower(F.concat(*(F.concat(F.coalesce(c, F.lit("")), F.lit(" ")) for c in ("name", "path", "status", "scope_label")))), F.lit(needle)) if needle else F.lit(True)
    for wanted, value in ((kind, kind_of(F.col("path")) == kind), (folder, folder_of(F.col("path")) == folder)):
        keep &= F.lit(True) if wanted == "all" else value
    return rows.where(keep & (F.lit(True) if health == "all" else healths()[health]))


# The same expressions are valid in Spark and in DuckDB.
_PATH = "CASE WHEN doc_id % 11 = 0 THEN '' ELSE coalesce(source, 'none') || '/' END || 'doc' || CAST(doc_id AS STRING) || CASE doc_id % 6 WHEN 0 THEN '.PDF' WHEN 1 THEN '.ino' WHEN 2 THEN '.md' WHEN 3 THEN '.yaml' WHEN 4 THEN '.bin' ELSE '' END"
_SCOPE = "CASE WHEN is_global THEN 'Global' ELSE 'Entity ' || CAST(entity_id AS STRING) END"
_STATUS = "CASE status_id " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in STATUSES.items()) + " END"
_REVIEW = f"""{_CATALOG}, docs AS (SELECT doc_id, {_PATH} AS path, 'doc ' || doc_id AS name, {_STATUS} AS status, {_SCOPE} AS scope_label, is_global, entity_id FROM catalog WHERE status_id IN (2, 4)),
stats AS (SELECT doc_id, count(*) AS n, round(avg(quality), 6) AS a, count(*) FILTER (WHERE quality < {LOW_QUALITY}) AS low FROM q GROUP BY doc_id), images AS (SELECT l_partkey AS doc_id, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
review AS (SELECT d.*, coalesce(s.n, 0) AS chunk_count, coalesce(a, 0) AS avg_quality, coalesce(low, 0) AS low_quality_count, coalesce(i.n, 0) AS image_count FROM docs d LEFT JOIN stats s USING (doc_id) LEFT JOIN images i USING (doc_id))"""


def reviewed(spark, sf_dir: str, scope: str = "all", entity_id: int | None = None) -> DataFrame:
    """The review list of the catalog; chunks are lines, and images returned order lines of the part of the same number."""
    named = catalog(spark, sf_dir).select("doc_id", F.expr(f"{_PATH} AS path"), F.expr("'doc ' || doc_id AS name"), F.expr(f"{_STATUS} AS status"), F.expr(f"{_SCOPE} AS scope_label"), F.lit(None).cast("string").alias("last_error"), "status_id", "is_global", "entity_id")
    images = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("doc_id"))
    return review_list(named, scored_lines(spark, sf_dir).select("doc_id", "quality"), images, scope, entity_id)


@query(f"""WITH {_QUALITY}, {_REVIEW} SELECT doc_id, path, status, scope_label, chunk_count, avg_quality, low_quality_count, image_count,
  CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'code' WHEN 2 THEN 'text' WHEN 3 THEN 'metadata' ELSE 'other' END AS kind, CASE WHEN doc_id % 11 = 0 THEN '{ROOT}' ELSE split_part(path, '/', 1) END AS folder,
  array_to_string(list_filter([CASE WHEN status = 'failed' THEN 'failed' END, CASE WHEN chunk_count = 0 THEN 'no-chunks' END, CASE WHEN low_quality_count > 0 OR (chunk_count > 0 AND avg_quality < {LOW_QUALITY}) THEN 'low-quality' END, CASE WHEN image_count > 0 THEN 'with-images' END, CASE WHEN image_count = 0 THEN 'without-images' END], lambda x: x IS NOT NULL), ',') AS health FROM review""")
def review_queue(spark, sf_dir):
    """All documents that await review or failed, with what the filters look at."""
    health = F.array_join(F.array_compact(F.array(*(F.when(test, name) for name, test in healths().items()))), ",")
    return reviewed(spark, sf_dir).select("doc_id", "path", "status", "scope_label", "chunk_count", "avg_quality", "low_quality_count", "image_count", kind_of(F.col("path")).alias("kind"), folder_of(F.col("path")).alias("folder"), health.alias("health"))


@query(f"""WITH {_QUALITY}, {_REVIEW} SELECT doc_id, path, scope_label, image_count FROM review WHERE doc_id % 6 = 1 AND image_count > 0 AND contains(lower(concat_ws(' ', name, path, status, scope_label)), 'entity 2')""")
def review_triage(spark, sf_dir):
    """Code with images among what a search for an entity finds."""
    return triage(reviewed(spark, sf_dir), search=" Entity 2", kind="code", health="with-images").select("doc_id", "path", "scope_label", "image_count")


def claim_next(jobs: DataFrame, worker: int) -> DataFrame:
    """jobs (id, status, created_at, worker, last_error, ...) after the oldest queued one is given to a worker; ties go by id.
    Only one row's key is joined back; no queued job leaves all as they are. In place of a lock, one writer makes the claims."""
    oldest = jobs.where("status = 'queued'").agg(F.min(F.struct("created_at", "id")).alias("_next"))
    taken = F.coalesce((F.col("status") == "queued") & (F.col("id") == F.col("_next.id")), F.lit(False))
    rows = jobs.join(F.broadcast(oldest))  # one row
    changed = {"status": F.when(taken, "running").otherwise(F.col("status")), "worker": F.when(taken, F.lit(worker)).otherwise(F.col("worker")), "last_error": F.when(~taken, F.col("last_error"))}
    return rows.select(*(changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in jobs.columns))


@query("""WITH jobs AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'failed' ELSE 'running' END AS status, o_orderdate AS created_at, CASE WHEN o_orderstatus <> 'O' THEN 1 END AS worker, o_orderpriority AS last_error FROM orders),
n AS (SELECT id FROM jobs WHERE status = 'queued' ORDER BY created_at, id LIMIT 1) SELECT jobs.id, CASE WHEN n.id IS NULL THEN status ELSE 'running' END AS status, created_at, CASE WHEN n.id IS NULL THEN worker ELSE 77 END AS worker, CASE WHEN n.id IS NULL THEN last_error END AS last_error FROM jobs LEFT JOIN n USING (id)""")
def claimed_jobs(spark, sf_dir):
    """Orders as jobs, after one claim."""
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "failed").otherwise("running")
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") != "O", 1).alias("worker"), F.col("o_orderpriority").alias("last_error"))
    return claim_next(jobs, 77)


def resolved(refs: DataFrame, docs: DataFrame) -> DataFrame:
    """refs (ref, ...) with the least path and its doc_id among docs (doc_id, path, name) whose path or name is the ref; null if there is
    none. Each key keeps its least document before the join, so that a name which many share is one row."""
    keys = docs.select(F.explode(F.array_distinct(F.array("path", "name"))).alias("ref"), F.struct("path", "doc_id").alias("d")).where("ref IS NOT NULL AND d.path IS NOT NULL")
    least = keys.groupBy("ref").agg(F.min("d").alias("_d"))
    return refs.join(least, "ref", "left").select(*(F.col(f"`{c}`") for c in refs.columns), F.col("_d.path").alias("path"), F.col("_d.doc_id").alias("doc_id"))


_REF = "CASE p_partkey % 3 WHEN 0 THEN 'doc' || p_partkey WHEN 1 THEN 'group ' || (p_partkey % 90) ELSE 'src' || (p_partkey % 9) || '/doc' || p_partkey || '.md' END"


@query(f"""WITH d AS (SELECT doc_id, {_PATH} AS path, 'group ' || (doc_id % 70) AS name FROM documents), r AS (SELECT p_partkey AS id, {_REF} AS ref FROM part)
SELECT id, ref, arg_min(d.path, d.path) AS path, arg_min(d.doc_id, d.path) AS doc_id FROM r LEFT JOIN d ON d.path = ref OR d.name = ref GROUP BY id, ref""")
def resolved_sources(spark, sf_dir):
    """References made from parts, resolved by path or by name."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(f"{_PATH} AS path"), F.expr("'group ' || (doc_id % 70) AS name"))
    return resolved(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(f"{_REF} AS ref")), docs)


def evidence(steps: DataFrame, chunks: DataFrame, most: int) -> DataFrame:
    """steps (id, doc_id, page) with the best chunks (doc_id, page, chunk_index, rank, quality): of the page, or of the whole document where a step
    has no page. Best by rank, quality from above, then index. The best of each page and of each document are
    taken before the join, so that it never sees more than that many for a step."""
    order = [F.asc("rank"), F.desc("quality"), F.asc("chunk_index")]
    by_page = W.first_of(chunks.where("page IS NOT NULL"), ["doc_id", "page"], order, most)
    by_doc = W.first_of(chunks, ["doc_id"], order, most).drop("page")
    paged = steps.where("page IS NOT NULL").join(by_page, ["doc_id", "page"])
    return paged.unionByName(steps.where("page IS NULL").join(by_doc, "doc_id"))


_RANK = "CASE WHEN length(line) > 120 THEN 0 WHEN length(line) > 40 THEN 1 ELSE 2 END"
_STEPS = "SELECT o_orderkey AS id, o_custkey AS doc_id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 4 END AS page FROM orders"


@query(f"""WITH c AS (SELECT doc_id, i // 5 AS page, i AS chunk_index, {_RANK} AS rank, length(line) % 10 AS quality FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)),
s AS ({_STEPS}) SELECT id, s.doc_id, s.page, chunk_index, rank, quality FROM s JOIN c ON s.doc_id = c.doc_id AND (s.page IS NULL OR s.page = c.page) QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, quality DESC, chunk_index) <= 3""")
def step_evidence(spark, sf_dir):
    """Three best lines for each order as a step of a plan on the document of its customer's number; a page has five lines."""
    rows = lines(table(spark, sf_dir, "documents")).select("doc_id", F.expr("CAST(line_index DIV 5 AS BIGINT) AS page"), F.col("line_index").cast("long").alias("chunk_index"), F.expr(f"{_RANK} AS rank"), F.expr("CAST(length(line) % 10 AS BIGINT) AS quality"))
    steps = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_custkey AS doc_id", "CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 4 END AS page")
    return evidence(steps, rows, 3).select("id", "doc_id", "page", "chunk_index", "rank", "quality")


def output_points(runs: DataFrame) -> DataFrame:
    """The newest completed or skipped runs (id, started_at, work_type, status, label, source_path, chunks, images, dropped) that made anything,
    oldest first by place; checks of the index don't count. A label longer than LONGEST_LABEL is cut in its short form."""
    made = F.greatest("chunks", "images", "dropped") > 0
    newest = runs.where((F.col("work_type") != "index_check") & F.col("status").isin("completed", "skipped") & made).orderBy(F.desc("started_at"), F.desc("id")).limit(MOST_POINTS)
    label = F.coalesce(F.nullif("label", F.lit("")), F.nullif("source_path", F.lit("")), F.nullif("work_type", F.lit("")), F.lit("work"))
    clean = F.replace(label, F.lit("\\"), F.lit("/"))
    base = F.coalesce(F.element_at(F.filter(F.concat(F.array(F.lit("")), F.split(clean, "/")), lambda x: x != ""), F.lit(-1)), clean)
    short = F.when(F.length(base) > LONGEST_LABEL, F.concat(F.left(base, F.lit(LONGEST_LABEL - 3)), F.lit("..."))).otherwise(base)
    return W.placed(newest.select("id", "started_at", label.alias("label"), short.alias("short_label"), "chunks", "images", "dropped"), [F.asc("started_at"), F.asc("id")], "place")


_RUN = {
    "work_type": "CASE event_type WHEN 'view' THEN 'index_check' ELSE 'ingest' END",
    "status": "CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'skipped' ELSE 'completed' END",
    "label": "CASE WHEN event_id % 3 = 0 THEN 'books/part ' || event_id || ' of a long shelf of books' END",
    "source_path": "CASE WHEN event_id % 3 = 1 THEN 'src/' || event_id || '.md' ELSE '' END",
    "chunks": "event_id % 4", "images": "event_id % 2", "dropped": "0",
}


@query(f"""WITH r AS (SELECT event_id AS id, ts AS started_at, {', '.join(f"{e} AS {n}" for n, e in _RUN.items())} FROM events), t AS (SELECT * FROM r WHERE work_type <> 'index_check' AND status IN ('completed', 'skipped') AND greatest(chunks, images, dropped) > 0 ORDER BY started_at DESC, id DESC LIMIT {MOST_POINTS}),
b AS (SELECT *, coalesce(label, nullif(source_path, ''), work_type) AS l, split_part(coalesce(label, nullif(source_path, ''), work_type), '/', -1) AS s FROM t)
SELECT id, started_at, l AS label, CASE WHEN length(s) > {LONGEST_LABEL} THEN left(s, {LONGEST_LABEL - 3}) || '...' ELSE s END AS short_label, chunks, images, dropped, row_number() OVER (ORDER BY started_at, id) AS place FROM b""")
def work_output(spark, sf_dir):
    """The points of a chart of work, from events as runs."""
    return output_points(table(spark, sf_dir, "events").selectExpr("event_id AS id", "ts AS started_at", *(f"{e} AS {n}" for n, e in _RUN.items())))
