"""The project finder: terms of an inventory, matches in documents, required parts, qualification, scores, copies and pages.

The inventory is the words of `benchmark` (a bounded list of terms), the candidates are whole documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import lines as L
from loomline.operators import substrings as S
from loomline.operators import windows as W
from loomline.plans.line_rules import _FLAGS, _SCORE, _TOKENS, _type
from loomline.plans.registry import query
from loomline.sources.tables import table

# Fixed values: (pattern, part, kind), build words and circuit words.
PARTS = [
    (r"\b(?:ne|lm)?555\b|\b555\s+timer\b", "NE555 timer", "timer"),
    (r"\b4n35\b|\boptocoupler\b", "4N35 optocoupler", "optocoupler"),
    (r"\bads1115\b|\banalog[-\s]?to[-\s]?digital\b|\badc\b", "ADS1115 ADC", "adc"),
    (r"\barduino\b", "Arduino board", "board"),
    (r"\braspberry\s*pi\b|\bgpio\b", "Raspberry Pi or GPIO board", "board"),
    (r"\bbreadboard\b", "Breadboard", "tooling"),
    (r"\bjumper\s+wires?\b|\bjumpers?\b", "Jumper wires", "tooling"),
    (r"\bleds?\b|light emitting diode", "LED", "indicator"),
    (r"\brelay\b", "Relay", "relay"),
    (r"\bmosfet\b", "MOSFET", "transistor"),
    (r"\btransistors?\b", "Transistor", "transistor"),
    (r"\bop[\s-]?amp\b|\boperational amplifier\b", "Op amp", "op amp"),
    (r"\bpower\s+supply\b|\bbattery\b", "Power supply", "power"),
]
RESISTOR = r"\b[0-9]+(?:\.[0-9]+)?\s*(?:ohms?|[kKmM]?\s?ohms?|[kKmM]?Ω|kohm|megohm)s?\b"
CAPACITOR = r"\b[0-9]+(?:\.[0-9]+)?\s*(?:pf|nf|uf|µf|mf|farads?)\b"
BUILD = r"\b(?:build|make|construct|assemble|breadboard|wire|connect|solder|test|try|experiment|project)\b"
CIRCUIT = r"\b(?:circuit|schematic|diagram|parts?\s+list|component|pin|resistor|capacitor|transistor|timer|led|arduino|raspberry\s*pi|gpio)\b"
BOILERPLATE = r"\b(?:copyright|all\s+rights\s+reserved|editorial|publisher|isbn|website|email)\b"
CODE = r"\b(setup|loop|pinmode|digitalwrite|analogread|#include|import\s+board)\b"
# What a text holds wherever a pattern is found in it; a plain search for these is quicker than the pattern.
SIGNS = {
    **dict(zip([p for p, _, _ in PARTS], [["555"], ["4n35", "optocoupler"], ["ads1115", "analog", "adc"], ["arduino"], ["raspberry", "gpio"], ["breadboard"], ["jumper"], ["led", "light emitting diode"], ["relay"], ["mosfet"], ["transistor"], ["amp", "operational amplifier"], ["power", "battery"]])),
    BUILD: ["build", "make", "construct", "assemble", "breadboard", "wire", "connect", "solder", "test", "try", "experiment", "project"],
    CIRCUIT: ["circuit", "schematic", "diagram", "part", "component", "pin", "resistor", "capacitor", "transistor", "timer", "led", "arduino", "raspberry", "gpio"],
    BOILERPLATE: ["copyright", "rights", "editorial", "publisher", "isbn", "website", "email"],
    CODE: ["setup", "loop", "pinmode", "digitalwrite", "analogread", "#include", "import"],
}
# Families of parts, by pattern, with the keys that each of them answers to.
FAMILIES = [
    (r"\b(?:ne|lm)?555\b|\b555 timer\b", ["555", "555 timer", "ne555", "lm555", "ne555 timer", "lm555 timer"]),
    (r"\bleds?\b|light emitting diode", ["led", "leds", "light emitting diode"]),
    (r"\bpower supply\b|\bbattery\b", ["power supply", "battery", "bench supply"]),
    ("breadboard", ["breadboard"]),
    ("jumper", ["jumper wires", "jumpers"]),
]
GENERIC = ["resistor", "capacitor"]
MAX_TERMS, MAX_CHUNKS, MIN_CHARS = 300, 5000, 90
SHARES = 256  # of a page's candidates


def plain(text: Column) -> Column:
    """Lower-case ASCII letters and digits with single blanks; µ is u, and both omegas are ohm."""
    low = F.lower(F.replace(F.replace(F.replace(text, F.lit("µ"), F.lit("u")), F.lit("Ω"), F.lit("ohm")), F.lit("ω"), F.lit("ohm")))
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def lookup_keys(name: Column, kind: Column) -> Column:
    """The keys under which a part is kept and sought: its plain name, that name without blanks, and those of its families, which a
    part's kind can belong to as well. No name and no kind have no keys."""

    def keys(text: Column) -> Column:
        both = F.concat_ws(" ", text, plain(F.coalesce(kind, F.lit(""))))
        families = [F.when(both.rlike(pattern), F.array(*map(F.lit, known))).otherwise(F.array().cast("array<string>")) for pattern, known in FAMILIES]
        return F.array_distinct(F.filter(F.concat(F.array(text, F.replace(text, F.lit(" "), F.lit(""))), *families), lambda k: k != ""))

    return L.let(plain(F.coalesce(name, F.lit(""))), keys)


def in_stock(part: Column, index: Column) -> Column:
    """Whether the inventory's keys (index) hold one of a part's (name, kind), or stock of its whole kind, for resistors and capacitors."""
    return F.arrays_overlap(lookup_keys(part["name"], part["kind"]), index) | (part["kind"].isin(GENERIC) & F.array_contains(index, part["kind"]))


def terms(spark, sf_dir) -> DataFrame:
    """(place, term): the first MAX_TERMS distinct terms of two letters or more, in the order they appear."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split(plain(F.col("text")), " ")).alias("pos", "term")).where("length(term) >= 2")
    first = words.groupBy("term").agg(F.min(F.struct("item_id", "pos")).alias("at"))
    return W.placed(first.orderBy("at", "term").limit(MAX_TERMS), [F.col("at"), F.col("term")], "place").select("place", "term")


def matches(spark, sf_dir) -> DataFrame:
    """(doc_id, source, text, matched, index): the terms of each document, in the order of the terms; documents without any are
    left out. The terms are at most MAX_TERMS, one row that is broadcast with all keys of the inventory."""
    array = terms(spark, sf_dir).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]).alias("terms"))
    array = array.withColumn("index", F.array_distinct(F.flatten(F.transform("terms", lambda t: lookup_keys(t, F.lit(""))))))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.split(plain(F.coalesce("text", F.lit(""))), " ").alias("words"))
    met = docs.crossJoin(F.broadcast(array)).select("doc_id", "source", "text", F.array_intersect("terms", "words").alias("matched"), "index")
    return met.where(F.size("matched") > 0)


def _keys(x: str, kind: str) -> str:
    plain = _PLAIN.format(x)
    known = ", ".join(f"CASE WHEN regexp_matches({plain} || ' ' || {kind}, '{p}') THEN {k} ELSE [] END" for p, k in FAMILIES)
    return f"list_filter(flatten([[{plain}, replace({plain}, ' ', '')], {known}]), lambda k: k <> '')"


_PLAIN = "trim(regexp_replace(lower(replace(replace(replace({}, 'µ', 'u'), 'Ω', 'ohm'), 'ω', 'ohm')), '[^a-z0-9]+', ' ', 'g'))"
_TERMS = f"""bw AS (SELECT item_id, unnest(l) AS term, generate_subscripts(l, 1) AS pos FROM (SELECT item_id, string_split({_PLAIN.format('text')}, ' ') AS l FROM benchmark)),
terms AS (SELECT term, row_number() OVER (ORDER BY a, term) AS place FROM (SELECT term, min({{'i': item_id, 'p': pos}}) AS a FROM bw WHERE length(term) >= 2 GROUP BY term) ORDER BY place LIMIT {MAX_TERMS})"""
_MATCHES = f"""{_TERMS}, dw AS (SELECT DISTINCT doc_id, unnest(string_split({_PLAIN.format("coalesce(text, '')")}, ' ')) AS term FROM documents),
matches AS (SELECT doc_id, list(term ORDER BY place) AS matched FROM dw JOIN terms USING (term) GROUP BY doc_id)"""


@query(f"WITH {_TERMS} SELECT CAST(place AS BIGINT) AS place, term FROM terms")
def finder_terms(spark, sf_dir):
    return terms(spark, sf_dir)


@query(f"WITH {_MATCHES} SELECT doc_id, CAST(len(matched) AS BIGINT) AS n_matched, array_to_string(matched, ' ') AS matched FROM matches")
def finder_matches(spark, sf_dir):
    return matches(spark, sf_dir).select("doc_id", F.size("matched").cast("long").alias("n_matched"), F.array_join("matched", " ").alias("matched"))


_SQUEEZED = "trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))"
_QUALITY = f"""{_MATCHES}, f0 AS (SELECT doc_id, source, matched, {_SQUEEZED} AS s FROM matches JOIN documents USING (doc_id)), f1 AS (SELECT *, {_type('s')} AS kind, {_TOKENS} AS n_tokens FROM f0),
f2 AS (SELECT *, {_FLAGS} AS flags FROM f1), scored AS (SELECT *, {_SCORE} AS quality FROM f2)"""


def scored(spark, sf_dir) -> DataFrame:
    """Matches with the squeezed text and its quality as one chunk."""
    rows = matches(spark, sf_dir).withColumn("text", L.squeezed(F.coalesce("text", F.lit(""))))
    return rows.select("doc_id", "source", "matched", "index", "text", F.lower("text").alias("low"), L.text_quality(F.col("text")).alias("quality"))


@query(f"WITH {_QUALITY} SELECT doc_id, CAST(row_number() OVER (ORDER BY len(matched) DESC, quality DESC, source DESC, doc_id) AS BIGINT) AS place FROM scored ORDER BY place LIMIT {MAX_CHUNKS}")
def finder_ranked(spark, sf_dir):
    """The best MAX_CHUNKS candidates: most matches, then quality, then source descending."""
    order = [F.desc("n"), F.desc("quality"), F.desc("source"), F.asc("doc_id")]
    top = scored(spark, sf_dir).select("doc_id", "source", "quality", F.size("matched").alias("n")).orderBy(*order).limit(MAX_CHUNKS)
    return W.placed(top, order, "place").select("doc_id", "place")


def says(low: Column, pattern: str) -> Column:
    """Whether a pattern, with ASCII edges of words, is found in a text in lower case."""
    return L.any_of(low, SIGNS[pattern]) & low.rlike(L.ascii_edges(pattern))


def values(text: Column, pattern: str, kind: str) -> Column:
    """Up to 8 part values of a kind, as they stand, named after it. The pattern begins with a digit; a unit ends where no ASCII
    letter, digit or _ follows, so that Ω, which is none of these, ends one as well."""
    edged = r"(?<!\w)" + pattern.removeprefix(r"\b").removesuffix(r"\b") + r"(?!\w)"
    found = F.slice(F.regexp_extract_all(text, F.lit(edged), F.lit(0)), 1, 8)
    named = F.transform(found, lambda v: F.trim(F.regexp_replace(F.replace(v, F.lit("Ω"), F.lit(" ohm")), r"\s+", " ")))
    return F.transform(named, lambda v: F.struct(F.when(F.contains(F.lower(v), F.lit(kind)), v).otherwise(F.concat(v, F.lit(f" {kind}"))).alias("name"), F.lit(kind).alias("kind")))


def required_parts(text: Column, low: Column) -> Column:
    """Parts that a text (low: in lower case) asks for: fixed patterns in order, then resistor and capacitor values; of equal plain
    names the first."""
    fixed = F.array_compact(F.array(*(F.when(says(low, p), F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"))) for p, name, kind in PARTS)))
    every = F.concat(fixed, values(text, RESISTOR, "resistor"), values(low, CAPACITOR, "capacitor"))
    named = lambda all_of: F.struct(all_of.alias("parts"), F.transform(all_of, lambda p: plain(p["name"])).alias("names"))
    first = lambda x: F.filter(x["parts"], lambda p, i: (F.get(x["names"], i) != "") & (F.array_position(x["names"], F.get(x["names"], i)) == i + 1))
    return L.let(every, lambda e: L.let(named(e), first))


def qualified(rows: DataFrame) -> DataFrame:
    """rows (text, low, matched, index, quality) with required and missing parts, project_like, reasons, score and buildable. Code in a
    circuit's text stands for a build action. Texts have no section title here, so no title speaks against them."""
    rows = rows.withColumn("required", required_parts(F.col("text"), F.col("low")))
    rows = rows.withColumn("missing", F.slice(F.filter("required", lambda p: ~in_stock(p, F.col("index"))), 1, 8))
    low, held = F.col("low"), F.size("matched") > 0
    rows = rows.withColumns({"_built": says(low, BUILD), "_context": says(low, CIRCUIT)})
    built, context = F.col("_built"), F.col("_context")
    action = built | (context & says(low, CODE) & (held | (F.size("required") > 0)))
    rows = rows.withColumn("project_like", context & (held | (F.size("required") >= 2)) & action)
    reasons = F.array_compact(F.array(F.when(F.length("text") < MIN_CHARS, "short"), F.when(~built & says(F.substring(low, 1, 260), BOILERPLATE), "boilerplate")))
    rows = rows.withColumn("reasons", reasons).drop("_built", "_context")
    rows = rows.withColumn("reasons", F.when(~F.col("project_like") & (F.size("reasons") == 0), F.array(F.lit("no build"))).otherwise(F.col("reasons")))
    score = 18 * F.size("matched") + 10 * F.col("quality") - 4 * F.size("missing") + F.when(F.col("project_like"), 10).otherwise(0) - 8 * F.size("reasons")
    return rows.withColumn("score", F.round(score.cast("double"), 2)).withColumn("buildable", (F.size("missing") == 0) & (F.size("matched") > 0))


def candidates(spark, sf_dir) -> DataFrame:
    """Documents with matched terms, qualified and scored."""
    return qualified(scored(spark, sf_dir))


def _values_sql(text: str, pattern: str, kind: str) -> str:
    named = f"trim(regexp_replace(replace(v, 'Ω', ' ohm'), '\\s+', ' ', 'g'))"
    return f"list_transform(regexp_extract_all({text}, '{pattern}')[1:8], lambda v: {{'name': CASE WHEN contains(lower({named}), '{kind}') THEN {named} ELSE {named} || ' {kind}' END, 'kind': '{kind}'}})"


_FIXED = ", ".join(f"CASE WHEN regexp_matches(lower(s), '{p}') THEN {{'name': '{name}', 'kind': '{kind}'}} END" for p, name, kind in PARTS)
_CANDIDATES = f"""{_QUALITY}, inventory AS (SELECT list(DISTINCT k) AS index FROM (SELECT unnest({_keys('term', "''")}) AS k FROM terms)),
c1 AS (SELECT *, list_concat(list_filter([{_FIXED}], lambda p: p IS NOT NULL), {_values_sql('s', RESISTOR, 'resistor')}, {_values_sql('lower(s)', CAPACITOR, 'capacitor')}) AS every FROM scored),
c2 AS (SELECT *, list_transform(every, lambda p: {_PLAIN.format('p.name')}) AS names FROM c1),
c3 AS (SELECT *, list_filter(every, lambda p, i: list_position(names, names[i]) = i) AS needs FROM c2),
c4 AS (SELECT *, list_transform(needs, lambda p: p.name) AS required, list_transform(list_filter(needs, lambda p: NOT (list_has_any({_keys('p.name', 'p.kind')}, index) OR (p.kind IN ('resistor', 'capacitor') AND list_contains(index, p.kind)))), lambda p: p.name)[1:8] AS missing,
  regexp_matches(lower(s), '{BUILD}') AS action, (regexp_matches(lower(s), '{BUILD}') OR regexp_matches(lower(s), '{CODE}')) AND regexp_matches(lower(s), '{CIRCUIT}') AS project_like FROM c3, inventory),
c5 AS (SELECT *, list_filter([CASE WHEN length(s) < {MIN_CHARS} THEN 'short' END, CASE WHEN regexp_matches(lower(s)[1:260], '{BOILERPLATE}') AND NOT action THEN 'boilerplate' END], lambda r: r IS NOT NULL) AS r0 FROM c4),
c6 AS (SELECT *, CASE WHEN NOT project_like AND len(r0) = 0 THEN ['no build'] ELSE r0 END AS reasons FROM c5),
candidates AS (SELECT *, round(CAST(18 * len(matched) + 10 * quality - 4 * len(missing) + CASE WHEN project_like THEN 10 ELSE 0 END - 8 * len(reasons) AS DOUBLE), 2) AS score, len(missing) = 0 AS buildable FROM c6)"""


@query(f"WITH {_CANDIDATES} SELECT doc_id, array_to_string(required, '; ') AS required, array_to_string(missing, '; ') AS missing, project_like, array_to_string(reasons, '; ') AS reasons, score, buildable FROM candidates")
def finder_candidates(spark, sf_dir):
    names = lambda c: F.array_join(F.transform(c, lambda p: p["name"]), "; ").alias(c)
    return candidates(spark, sf_dir).select("doc_id", names("required"), names("missing"), "project_like", F.array_join("reasons", "; ").alias("reasons"), "score", "buildable")


@query(f"WITH {_CANDIDATES}, k AS (SELECT *, array_to_string(list_sort(required), '|') AS sig, row_number() OVER (PARTITION BY source, array_to_string(list_sort(required), '|') ORDER BY score DESC, doc_id) AS i, count(*) OVER (PARTITION BY source, array_to_string(list_sort(required), '|')) AS copies FROM candidates) SELECT source, sig AS signature, doc_id, score, copies FROM k WHERE i = 1")
def finder_distinct(spark, sf_dir):
    """The best candidate of each source and set of required parts, and how many there are."""
    sig = F.array_join(F.array_sort(F.transform("required", lambda p: p["name"])), "|")
    best = F.max_by("doc_id", F.struct(F.col("score"), -F.col("doc_id")))
    return candidates(spark, sf_dir).groupBy("source", sig.alias("signature")).agg(best.alias("doc_id"), F.max("score").alias("score"), F.count("*").alias("copies"))


@query(f"""WITH {_CANDIDATES}, o AS (SELECT *, row_number() OVER (ORDER BY buildable DESC, score DESC, len(matched) DESC, doc_id) AS place FROM candidates WHERE buildable)
SELECT place, doc_id, score, (SELECT count(*) FROM o) AS total, 48 < (SELECT count(*) FROM o) AS has_more FROM o WHERE place > 24 AND place <= 48""")
def finder_page(spark, sf_dir):
    """The second page of 24 buildable candidates, with the number of all and whether more follow."""
    kept = F.when(F.col("buildable"), F.array(F.struct("doc_id", "score", F.size("matched").alias("n"))))  # a filter would be pushed down, and all its rules be applied twice
    rows = candidates(spark, sf_dir).select(F.explode_outer(kept).alias("r")).where("r IS NOT NULL").select("r.*")
    order, w = [F.desc("score"), F.desc("n"), F.asc("doc_id")], Window.partitionBy("share")
    rows = rows.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)))  # counted and cut by shares, so that the texts are read once
    best = rows.select("*", F.row_number().over(w.orderBy(*order)).alias("nth"), F.count("*").over(w).alias("of")).where("nth <= 48")
    total = F.sum(F.when(F.col("nth") == 1, F.col("of"))).over(Window.partitionBy())
    first = W.placed(best.withColumn("total", total).orderBy(*order).limit(48), order, "place").where("place > 24")
    return first.select("place", "doc_id", "score", "total", (F.col("total") > 48).alias("has_more"))


@query(f"""WITH {_CANDIDATES}, m AS (SELECT unnest(missing) AS part, doc_id, score FROM candidates), r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY score DESC, doc_id) AS i FROM m)
SELECT part, count(*) AS n, list(doc_id ORDER BY i) FILTER (WHERE i <= 3) AS examples FROM r GROUP BY part ORDER BY n DESC, part LIMIT 10""")
def finder_missing_parts(spark, sf_dir):
    """The ten parts that most candidates miss, with the three best candidates of each."""
    each = candidates(spark, sf_dir).select("doc_id", "score", F.explode_outer("missing.name").alias("part")).where("part IS NOT NULL")  # an inner one would have its filter pushed down
    top = each.groupBy("part").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "part").limit(10)
    few = W.first_of(each.join(F.broadcast(top), "part"), ["part"], [F.desc("score"), F.asc("doc_id")], 3)
    return few.groupBy("part", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id"))), lambda x: x["doc_id"]).alias("examples"))


_PHRASES = f"""pw AS (SELECT item_id, string_split({_PLAIN.format("coalesce(text, '')")}, ' ') AS l FROM benchmark), phrases AS (SELECT DISTINCT unnest(list_concat(list_transform(range(1, len(l)), lambda i: array_to_string(l[i:i + 1], ' ')), list_filter(l, lambda x: x <> ''))) AS term FROM pw)"""


def phrases(spark, sf_dir) -> DataFrame:
    """(term): every word and every two words that follow one another in `benchmark`, plain."""
    words = table(spark, sf_dir, "benchmark").select(F.split(plain(F.coalesce("text", F.lit(""))), " ").alias("l"))
    pairs = F.zip_with(F.slice("l", 1, F.size("l") - 1), F.slice("l", 2, F.size("l")), lambda a, b: F.concat_ws(" ", a, b))
    return words.select(F.explode(F.concat(F.col("l"), F.when(F.size("l") > 1, pairs).otherwise(F.array().cast("array<string>")))).alias("term")).where("term <> ''").distinct()


@query(f"""WITH {_PHRASES}, d AS (SELECT doc_id, {_PLAIN.format("coalesce(text, '')")} AS t, replace({_PLAIN.format("coalesce(text, '')")}, ' ', '') AS c FROM documents),
hits AS (SELECT doc_id, term FROM d JOIN phrases ON CASE WHEN contains(term, ' ') THEN contains(t, term) ELSE contains(' ' || t || ' ', ' ' || term || ' ') END
  OR (length(replace(term, ' ', '')) >= 4 AND regexp_matches(term, '[0-9]') AND contains(c, replace(term, ' ', ''))))
SELECT doc_id, count(*) AS n_matched, sum(length(term)) AS n_chars, min(term) AS first, max(term) AS last FROM hits GROUP BY doc_id""")
def phrase_mentions(spark, sf_dir):
    """The inventory's words and phrases that each document mentions: words as whole words, phrases anywhere in the plain text, and
    those of four characters or more with a digit in the text without blanks too. Terms meet texts by a few characters of
    theirs, so they may be many."""
    hits = S.mentions(table(spark, sf_dir, "documents").select("doc_id", plain(F.coalesce("text", F.lit(""))).alias("text")), "doc_id", phrases(spark, sf_dir))
    return hits.groupBy("doc_id").agg(F.count("*").alias("n_matched"), F.sum(F.length("term")).alias("n_chars"), F.min("term").alias("first"), F.max("term").alias("last"))
