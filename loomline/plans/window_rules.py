"""Queries on windows of sentences and lines, adaptive sizes and sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.operators import sentences as S
from loomline.plans.line_rules import _heading
from loomline.plans.registry import query
from loomline.sources.tables import table

SIZE, OVERLAP = 420, 80

_STRIPPED = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_N = r"len(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'))"
_SENTENCES = r"regexp_replace({}, '([.!?])\s+([A-Z0-9])', '\1' || chr(10) || '\2', 'g')"


def _pieces(parts: str) -> str:
    return f"list_filter(list_transform({parts}, lambda x: {_STRIPPED.format('x')}), lambda x: x <> '')"


def _windows(units: str, size: str, overlap: int, keys: str) -> str:
    """CTEs after `units` (keys, bi, h, si, s): the windows w (keys, bi, si, past), with each unit's running sums in p."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    named = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""{units}, n AS (SELECT *, {_N.format('s')} AS t FROM units WHERE NOT h), p AS (SELECT *, sum(t) OVER (PARTITION BY {keys}, bi ORDER BY si) - t AS pre, sum(t) OVER (PARTITION BY {keys}, bi ORDER BY si) AS post FROM n),
nx AS (SELECT {named}, a.bi, a.si, a.pre, b.si AS up FROM p a ASOF LEFT JOIN p b ON {on} AND a.bi = b.bi AND a.pre + {size} - {overlap} <= b.pre),
en AS (SELECT {named}, a.bi, a.si, a.up, b.si AS past FROM nx a ASOF LEFT JOIN p b ON {on} AND a.bi = b.bi AND a.pre + {size} >= b.post),
st AS (SELECT * FROM en WHERE si = 1 UNION ALL SELECT b.* FROM st a JOIN en b ON {on} AND a.bi = b.bi AND a.up = b.si),
w AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY bi, si) - 1 AS window_no FROM st WHERE past >= si)"""


def _sentence_units(source: str, keys: str) -> str:
    return rf"""bl AS (SELECT {keys}, unnest(l) AS block, generate_subscripts(l, 1) AS bi FROM (SELECT {keys}, {_pieces("string_split_regex(text, '" + S.BLOCKS + "')")} AS l FROM {source})),
hd AS (SELECT *, {_heading("trim(regexp_replace(block, '" + chr(92) + "s+', ' ', 'g'))")} AS h FROM bl), sec AS (SELECT *, last_value(CASE WHEN h THEN block END IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY bi) AS section FROM hd),
units AS (SELECT {keys}, bi, h, section, unnest(l) AS s, generate_subscripts(l, 1) AS si FROM (SELECT {keys}, bi, h, section, CASE WHEN h THEN [block] ELSE {_pieces("string_split_regex(" + _SENTENCES.format('block') + ", '" + chr(92) + "n+')")} END AS l FROM sec))"""


@query(f"""WITH RECURSIVE {_windows(_sentence_units('documents', 'doc_id'), str(SIZE), OVERLAP, 'doc_id')}
SELECT w.doc_id, window_no AS "window", any_value(coalesce(section, 'Untitled Section')) AS section, count(*) AS n_sentences, string_agg(s, ' ' ORDER BY p.si) AS text FROM w JOIN p ON w.doc_id = p.doc_id AND w.bi = p.bi AND p.si BETWEEN w.si AND w.past GROUP BY w.doc_id, window_no""")
def sentence_windows(spark, sf_dir):
    """Overlapping windows of whole sentences, with the heading above them."""
    return S.sentence_windows(table(spark, sf_dir, "documents"), SIZE, OVERLAP, "doc_id")


_MATH_UNITS = rf"""bl AS (SELECT doc_id, unnest(l) AS block, generate_subscripts(l, 1) AS bi FROM (SELECT doc_id, {_pieces("string_split(regexp_replace(text, '" + chr(92) + "n#', chr(10) || chr(1) || '#', 'g'), chr(10) || chr(1))")} AS l FROM documents)),
units AS (SELECT doc_id, bi, false AS h, unnest(l) AS s, generate_subscripts(l, 1) AS si FROM (SELECT doc_id, bi, {_pieces("string_split_regex(block, '" + chr(92) + "r" + chr(92) + "n|" + chr(92) + "r|" + chr(92) + "n')")} AS l FROM bl))"""


@query(f"""WITH RECURSIVE {_windows(_MATH_UNITS, str(S.MATH_SIZE), S.MATH_OVERLAP, 'doc_id')}
SELECT w.doc_id, window_no AS "window", CASE WHEN regexp_matches(s, '{S.VARIABLE}') THEN 'Variable Definition' ELSE 'Math Section' END AS section, s AS text FROM w JOIN p ON w.doc_id = p.doc_id AND w.bi = p.bi AND p.si BETWEEN w.si AND w.past""")
def math_chunks(spark, sf_dir):
    """Lines as chunks, those of overlaps twice or more."""
    return S.math_lines(table(spark, sf_dir, "documents"), "doc_id")


_SIZES = rf"""sz AS (SELECT doc_id, text, {_N.format('text')} / greatest(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')), 1) AS density FROM documents WHERE text IS NOT NULL),
most AS (SELECT *, CASE WHEN density < {S.SPARSE} THEN {int(SIZE * 1.5)} WHEN density > {S.DENSE} THEN {int(SIZE * 0.75)} ELSE {SIZE} END AS most, string_split(text, chr(10)) AS l FROM sz),
heads AS (SELECT *, list_filter(range(1, len(l)), lambda i: regexp_matches(l[i], '{S.SECTION}')) AS a FROM most),
parts AS (SELECT doc_id, most, density, CASE WHEN len(a) = 0 THEN [{{'title': 'Full Document', 'body': text}}] ELSE list_transform(a, lambda i, k: {{'title': {_STRIPPED.format('l[i]')}, 'body': {_STRIPPED.format("array_to_string(l[i + 1:coalesce(a[k + 1] - 1, len(l))], chr(10))")}}}) END AS parts FROM heads),
cut AS (SELECT doc_id, most, unnest(parts) AS c, generate_subscripts(parts, 1) - 1 AS place FROM parts), sections AS (SELECT doc_id, place, most, c.title AS title, c.body AS text FROM cut)"""


@query(f"WITH {_SIZES} SELECT doc_id, round(density, 6) AS density, CAST(most AS BIGINT) AS size, CAST(len(parts) AS BIGINT) AS n_sections, parts[1].title AS first_title FROM parts")
def adaptive_sizes(spark, sf_dir):
    """Density, size of chunks and number of sections of each document."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text", S.sections(F.col("text")).alias("s"))
    return docs.select("doc_id", F.round(S.density(F.col("text")), 6).alias("density"), S.adaptive_size(F.col("text"), SIZE).cast("long").alias("size"), F.size("s").cast("long").alias("n_sections"), F.get("s.title", F.lit(0)).alias("first_title"))


@query(f"""WITH RECURSIVE {_SIZES}, {_windows(_sentence_units('sections', 'doc_id, place, most'), 'a.most', OVERLAP, 'doc_id, place, most')}
SELECT w.doc_id, w.place, any_value(title) AS title, window_no AS "window", any_value(coalesce(section, 'Untitled Section')) AS section, count(*) AS n_sentences, string_agg(s, ' ' ORDER BY p.si) AS text
FROM w JOIN p ON w.doc_id = p.doc_id AND w.place = p.place AND w.bi = p.bi AND p.si BETWEEN w.si AND w.past JOIN sections c ON w.doc_id = c.doc_id AND w.place = c.place GROUP BY w.doc_id, w.place, window_no""")
def adaptive_windows(spark, sf_dir):
    """Sentence windows of each section, of a size by density."""
    return S.adaptive_windows(table(spark, sf_dir, "documents"), SIZE, OVERLAP, "doc_id")
