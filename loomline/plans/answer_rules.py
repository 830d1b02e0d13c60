"""Rules on questions and answers: history that goes with a question, wish to build, faults of an answer, who pays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators import windows as W
from loomline.plans.registry import query
from loomline.sources.tables import table

# Marks in kept answers, patterns of questions and answers, and what is said of faults.
IMAGES, HEADING = "\U0001f5bc️ Related Images", "\U0001f9e0 Answer"
DATA_IMAGE = r"""(?i)<img\b[^>]*\bsrc=["']data:image/[^"']+["'][^>]*>"""
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&nbsp;": " ", "&amp;": "&"}
CARD_REQUEST = r"\b(build|bench|wiring|assembly|project)\s*card\b|\bcard\s+for\b"
RECOMMENDATION = r"(\b(good|beginner|starter|first|simple|easy|recommend|suggest|idea|ideas)\b.{0,80}\bproject\b|\bproject\b.{0,80}\b(good|beginner|starter|first|simple|easy|recommend|suggest|idea|ideas)\b)"
DIRECT_INTENT = r"\b(wire|wiring|connect|hook\s*up|breadboard|pinout|schematic)\b"
BUILD_ACTION = r"\b(build|make|create|assemble)\b"
BUILD_CONTEXT = r"\b(arduino|raspberry|gpio|555|timer|op[\s-]?amp|optocoupler|transistor|mosfet|led|relay|sensor|adc|dac|ic|chip|pin|pins|datasheet|circuit|schematic|diagram|breadboard|[a-z]{1,8}\d{2,}[a-z0-9-]*|\d{3,}[a-z0-9-]*)\b"
WIRING_INTENT = r"\b(wire|wiring|connect|hook\s*up|breadboard|pinout|pin-by-pin|assembly|build card)\b"
SOURCE_REFERENCE = r"\b(source|page|datasheet|book|context|retrieved)\b"
EMPTY, ERROR, NO_SOURCE = "The model returned an empty answer.", "The model returned an LLM error marker.", "The answer does not clearly reference the retrieved material."
NO_GROUND, NO_POWER = "The wiring answer does not mention ground/common-ground checks.", "The wiring answer does not clearly state power or voltage requirements."
CARD_LISTS = {"parts": "The build card has no parts list.", "wiring": "The build card has no wiring steps.", "checks": "The build card has no pre-power checks.", "warnings": "The build card has no warnings."}

HISTORY_TURNS, HISTORY_CHARS, ANSWER_CHARS = 3, 2500, 500


def clean(text: Column) -> Column:
    """A kept message without images, marks, tags and common entities, on one line; null is empty."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?s)(\n\n---\n\n)?{IMAGES}.*$", "")
    text = F.regexp_replace(F.replace(text, F.lit(HEADING), F.lit("")), DATA_IMAGE, "[image omitted]")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    for name, sign in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def turns(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): answers of (conv_id, turn, role, text) with the question right before; other roles and
    empty messages don't count. Of one turn the user's messages come first. A conversation is sorted in one task, which
    holds one row of it at a time."""
    said = messages.where(F.col("role").isin("user", "assistant")).select("conv_id", "turn", "role", clean(F.col("text")).alias("text")).where("text <> ''")
    w = Window.partitionBy("conv_id").orderBy("turn", F.desc("role"), "text")
    pairs = said.withColumns({"before": F.lag("role").over(w), "question": F.lag("text").over(w)})
    return pairs.where("role = 'assistant' AND before = 'user'").select("conv_id", "turn", "question", F.col("text").alias("answer"))


def limited(pairs: DataFrame, max_turns: int, max_chars: int) -> DataFrame:
    """The newest turns of each conversation, up to a number of them and of characters; the answer of the newest is cut where that
    turn alone is too long. Adds newest, 1 for the last turn."""
    if max_turns <= 0 or max_chars <= 0:
        return pairs.withColumn("newest", F.lit(1)).limit(0)
    order = [F.desc("turn"), F.asc("answer"), F.asc("question")]
    recent = pairs.withColumn("newest", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))).where(F.col("newest") <= max_turns)
    long = (F.col("newest") == 1) & (F.length("question") + F.length("answer") > max_chars)
    recent = recent.withColumn("answer", F.when(long, F.rtrim(F.left("answer", F.greatest(F.lit(0), max_chars - F.length("question"))))).otherwise(F.col("answer")))
    return W.within_budget(recent.withColumn("_size", F.length("question") + F.length("answer")), ["conv_id"], [F.asc("newest")], "_size", max_chars).drop("_size")


def contextual(messages: DataFrame, max_turns: int = HISTORY_TURNS, max_chars: int = HISTORY_CHARS) -> DataFrame:
    """(conv_id, n_history, query): each conversation's last question after the turns before it."""
    asked = messages.where("role = 'user'").select("conv_id", F.struct("turn", clean(F.col("text")).alias("text")).alias("m")).where("m.text <> ''").groupBy("conv_id").agg(F.max("m").alias("last"))
    before = turns(messages).join(asked, "conv_id").where("turn < last.turn").drop("last")
    say = F.concat(F.lit("Previous user question: "), "question", F.lit("\nPrevious assistant answer: "), F.left("answer", F.lit(ANSWER_CHARS)))
    history = limited(before, max_turns, max_chars).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("newest")).alias("at"), say.alias("say")))).alias("h"))
    both = asked.join(history, "conv_id", "left")
    prior = F.concat(F.array_join("h.say", "\n"), F.lit("\nCurrent user question: "), F.col("last.text"))
    return both.select("conv_id", F.coalesce(F.size("h"), F.lit(0)).alias("n_history"), F.coalesce(prior, F.col("last.text")).alias("query"))


_CLEAN = r"regexp_replace(regexp_replace(replace(regexp_replace(coalesce(text, ''), '(?s)(\n\n---\n\n)?" + IMAGES + rf".*$', ''), '{HEADING}', ''), '" + DATA_IMAGE.replace("'", "''") + r"', '[image omitted]', 'g'), '<[^>]+>', ' ', 'g')"
for _name, _sign in ENTITIES.items():
    _CLEAN = f"replace({_CLEAN}, '{_name}', '{_sign.replace(chr(39), chr(39) * 2)}')"
_CLEAN = rf"trim(regexp_replace({_CLEAN}, '\s+', ' ', 'g'))"
_TURNS = f"""said AS (SELECT * FROM (SELECT conv_id, turn, role, {_CLEAN} AS text FROM conversations WHERE role IN ('user', 'assistant')) WHERE text <> ''),
turns AS (SELECT conv_id, turn, question, text AS answer FROM (SELECT *, lag(role) OVER w AS before, lag(text) OVER w AS question FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role DESC, text)) WHERE role = 'assistant' AND before = 'user')"""


@query(f"""WITH {_TURNS}, asked AS (SELECT conv_id, turn AS last_turn, text AS last FROM said WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) = 1),
r AS (SELECT t.*, row_number() OVER (PARTITION BY conv_id ORDER BY t.turn DESC, answer, question) AS newest FROM turns t JOIN asked USING (conv_id) WHERE t.turn < last_turn QUALIFY newest <= {HISTORY_TURNS}),
c AS (SELECT conv_id, newest, question, CASE WHEN newest = 1 AND length(question) + length(answer) > {HISTORY_CHARS} THEN rtrim(left(answer, greatest(0, {HISTORY_CHARS} - length(question)))) ELSE answer END AS answer FROM r),
b AS (SELECT * FROM (SELECT *, sum(length(question) + length(answer)) OVER (PARTITION BY conv_id ORDER BY newest) AS s FROM c) WHERE newest = 1 OR s <= {HISTORY_CHARS}),
h AS (SELECT conv_id, count(*) AS n, string_agg('Previous user question: ' || question || chr(10) || 'Previous assistant answer: ' || left(answer, {ANSWER_CHARS}), chr(10) ORDER BY newest DESC) AS prior FROM b GROUP BY conv_id)
SELECT conv_id, CAST(coalesce(n, 0) AS INTEGER) AS n_history, coalesce(prior || chr(10) || 'Current user question: ' || last, last) AS query FROM asked LEFT JOIN h USING (conv_id)""")
def contextual_queries(spark, sf_dir):
    return contextual(table(spark, sf_dir, "conversations"))


def wants_card(question: Column) -> Column:
    """Whether a question asks for something to be built: a card asked for, unless projects are to be named, words of wiring, or
    something to make of parts."""
    has = lambda p: F.coalesce(question, F.lit("")).rlike(f"(?i){p}")
    return F.when(has(CARD_REQUEST), True).when(has(RECOMMENDATION), False).when(has(DIRECT_INTENT), True).otherwise(has(BUILD_ACTION) & has(BUILD_CONTEXT))


def issues(question: Column, answer: Column, has_sources: Column, card: dict[str, Column]) -> Column:
    """Faults of an answer. card gives the sizes of the card's lists: all null where there is no card."""
    answer, question = F.coalesce(answer, F.lit("")), F.coalesce(question, F.lit(""))
    wiring, says = question.rlike(f"(?i){WIRING_INTENT}"), lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(answer), w))
    found = [(F.trim(F.regexp_replace(answer, r"\s+", " ")) == "", EMPTY), (F.contains(answer, F.lit("[LLM error]")), ERROR), (has_sources & ~answer.rlike(f"(?i){SOURCE_REFERENCE}"), NO_SOURCE), (wiring & ~says("gnd", "ground"), NO_GROUND), (wiring & ~says("power", "vcc", "supply", "voltage"), NO_POWER)]
    return F.array_compact(F.array(*(F.when(test, say) for test, say in [*found, *((card[k] == 0, say) for k, say in CARD_LISTS.items())])))


def finalize(mode: Column, confidence: Column, has_card: Column, n_issues: Column, min_confidence: float, enabled: bool = True) -> Column:
    """Whether an answer is looked at once more, by mode; an unknown or empty mode is always, a null confidence 1."""
    mode, low, issues = F.lower(F.trim(F.coalesce(mode, F.lit("")))), F.coalesce(confidence, F.lit(1.0)) < min_confidence, n_issues > 0
    chosen = F.when(mode == "off", False).when(mode.isin("issues", "issues_only"), issues).when(mode.isin("build", "build_cards"), has_card)
    chosen = chosen.when(mode.isin("build_or_issues", "issues_or_build"), has_card | issues).when(mode.isin("low_confidence", "low-confidence"), low)
    return F.lit(enabled) & chosen.when(mode.isin("build_or_low_confidence", "low_confidence_or_build"), has_card | low).otherwise(True)


# Questions on parts, beside those of conversations: the same expressions are valid in Spark and in DuckDB.
_ASKED = """SELECT 'p' || p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN 'How do I wire the ' || p_name || '?' WHEN 1 THEN 'A build card for ' || p_brand WHEN 2 THEN 'Suggest a simple project on a breadboard' WHEN 3 THEN 'Make a blinker of a NE' || (p_partkey % 1000 + 100)
  WHEN 4 THEN 'Create a summary of this' WHEN 5 THEN 'Which pinout has it?' WHEN 6 THEN 'Assemble a sensor of a circuit' WHEN 7 THEN 'What is an LED?' ELSE 'Project card for beginner project' END AS question,
  CASE p_size % 7 WHEN 0 THEN '' WHEN 1 THEN '[LLM error]' WHEN 2 THEN 'Connect GND, as the datasheet says.' WHEN 3 THEN 'See the page on supply and ground.' WHEN 4 THEN 'A voltage of 5 V' WHEN 5 THEN p_name ELSE '   ' END AS answer,
  p_size % 2 = 0 AS has_sources, CASE WHEN p_size % 3 = 0 THEN p_partkey % 4 END AS n, p_partkey AS k, (p_size % 10) / 10.0 AS confidence FROM part"""
_CHATS = "SELECT 'c' || conv_id || ':' || turn AS id, question, answer, length(question) % 2 = 0 AS has_sources, CASE WHEN length(answer) % 3 = 0 THEN length(answer) % 4 END AS n, conv_id AS k, (length(answer) % 10) / 10.0 AS confidence FROM turns"
MODES = ["always", "off", "issues", "build_cards", "issues_or_build", "low_confidence", "low_confidence_or_build", "other"]
_MODE = f"element_at(array({', '.join(map(repr, MODES))}), CAST(k % {len(MODES)} AS INT) + 1)"


def asked(spark, sf_dir: str) -> DataFrame:
    """(id, question, answer, has_sources, n, k, confidence) of questions on parts and in conversations; n is the size of a card's lists."""
    parts, chats = table(spark, sf_dir, "part"), turns(table(spark, sf_dir, "conversations"))
    types = "id string, question string, answer string, has_sources boolean, n long, k long, confidence double"
    cast = [f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in types.split(", ")]
    return spark.sql(_ASKED.replace("FROM part", "FROM {part}"), part=parts).selectExpr(*cast).unionByName(spark.sql(_CHATS.replace("FROM turns", "FROM {turns}"), turns=chats).selectExpr(*cast))


def _test(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}', 'i')"


_WANTS = f"CASE WHEN {_test('question', CARD_REQUEST)} THEN true WHEN {_test('question', RECOMMENDATION)} THEN false WHEN {_test('question', DIRECT_INTENT)} THEN true ELSE {_test('question', BUILD_ACTION)} AND {_test('question', BUILD_CONTEXT)} END"
_FAULTS = [("trim(answer) = ''", EMPTY), ("contains(answer, '[LLM error]')", ERROR), (f"has_sources AND NOT {_test('answer', SOURCE_REFERENCE)}", NO_SOURCE), (f"{_test('question', WIRING_INTENT)} AND NOT {_test('answer', 'gnd|ground')}", NO_GROUND), (f"{_test('question', WIRING_INTENT)} AND NOT {_test('answer', 'power|vcc|supply|voltage')}", NO_POWER), ("n % 4 = 0", CARD_LISTS["parts"]), ("n % 3 = 0", CARD_LISTS["wiring"]), ("n % 2 = 0", CARD_LISTS["checks"]), ("n = 1", CARD_LISTS["warnings"])]
_LOW = "confidence < 0.5"


@query(f"""WITH {_TURNS}, asked AS ({_ASKED} UNION ALL {_CHATS}), i AS (SELECT *, {_WANTS} AS wants_card, list_filter([{', '.join(f"CASE WHEN {test} THEN '{say}' END" for test, say in _FAULTS)}], lambda x: x IS NOT NULL) AS found, {MODES}[k % {len(MODES)} + 1] AS mode FROM asked)
SELECT id, wants_card, array_to_string(found, ' ') AS issues, CASE mode WHEN 'off' THEN false WHEN 'issues' THEN len(found) > 0 WHEN 'build_cards' THEN n IS NOT NULL WHEN 'issues_or_build' THEN n IS NOT NULL OR len(found) > 0 WHEN 'low_confidence' THEN {_LOW} WHEN 'low_confidence_or_build' THEN n IS NOT NULL OR {_LOW} ELSE true END AS finalize FROM i""")
def answer_issues(spark, sf_dir):
    """Of each question and answer: whether a card is wanted, the answer's faults, and whether it is looked at once more."""
    n = F.col("n")
    card = {"parts": n % 4, "wiring": n % 3, "checks": n % 2, "warnings": F.when(n.isNotNull(), F.when(n == 1, 0).otherwise(1))}
    rows = asked(spark, sf_dir).withColumns({"found": issues(F.col("question"), F.col("answer"), F.col("has_sources"), card), "mode": F.expr(_MODE)})
    return rows.select("id", wants_card(F.col("question")).alias("wants_card"), F.array_join("found", " ").alias("issues"), finalize(F.col("mode"), F.col("confidence"), n.isNotNull(), F.size("found"), 0.5).alias("finalize"))


def payer(settings: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (id, entity_id, user_id, is_global) with paid_by: whose key pays for help with a question, or with a document.

    settings are (scope, owner_id, enabled, has_key, mode, policy), one row for an owner; system has no owner. Both joins are on
    owners; null ids, owners without a row and keys that are off have none; the policy of an owner without one is entity
    for entities and user_when_available for users. question: the user's key, if its policy lets it; nobody's where the entity wants
    users to pay; the entity's; the system's. document: global ones the system, others the entity, the user, the system."""
    usable = F.coalesce(F.col("enabled") & F.col("has_key") & (F.coalesce("mode", F.lit("")) != "off"), F.lit(False))
    kept = settings.select("scope", "owner_id", usable.alias("usable"), F.coalesce("policy", F.when(F.col("scope") == "user", "user_when_available").otherwise("entity")).alias("policy"))
    of = lambda scope: kept.where(F.col("scope") == scope).select(F.col("owner_id").alias(f"{scope}_id"), F.col("usable").alias(f"_{scope}"), F.col("policy").alias(f"_{scope}_policy"))
    system = kept.where("scope = 'system'").agg(F.coalesce(F.max("usable"), F.lit(False)).alias("_system"))
    rows = requests.join(of("user"), "user_id", "left").join(of("entity"), "entity_id", "left").join(F.broadcast(system))  # one row
    user = F.coalesce(F.col("_user"), F.lit(False)) & F.col("_user_policy").isin("user_when_available", "user_only")
    entity, policy = F.coalesce(F.col("_entity"), F.lit(False)), F.coalesce("_entity_policy", F.lit("entity"))
    last = F.when(F.col("_system"), "system")
    question = F.when(user, "user").when(policy == "user_only", None).when(entity & policy.isin("entity", "user_when_available"), "entity").otherwise(last)
    document = F.when(F.coalesce("is_global", F.lit(False)), last).when(entity, "entity").when(user, "user").otherwise(last)
    return rows.select(*(F.col(f"`{c}`") for c in requests.columns), question.alias("question_paid_by"), document.alias("document_paid_by"))


# The same expressions are valid in Spark and in DuckDB: settings of customers as users and of nations as entities.
_SETTINGS = """SELECT 'user' AS scope, c_custkey AS owner_id, c_custkey % 3 <> 0 AS enabled, c_custkey % 5 <> 0 AS has_key, CASE WHEN c_custkey % 7 = 0 THEN 'off' ELSE 'on' END AS mode,
  CASE c_custkey % 4 WHEN 0 THEN 'user_only' WHEN 1 THEN 'user_when_available' WHEN 2 THEN 'entity' END AS policy FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT 'entity', n_nationkey, n_nationkey % 4 <> 0, true, 'on', CASE n_nationkey % 3 WHEN 0 THEN 'user_only' WHEN 1 THEN 'entity' END FROM nation WHERE n_nationkey % 6 <> 5
UNION ALL SELECT 'system', NULL, count(*) > 0, true, 'on', NULL FROM region"""
_REQUESTS = "SELECT o_orderkey AS id, c_custkey AS user_id, c_nationkey AS entity_id, o_orderkey % 4 = 0 AS is_global FROM orders LEFT JOIN customer ON o_custkey = c_custkey"


@query(f"""WITH settings AS ({_SETTINGS}), s AS (SELECT scope, owner_id, enabled AND has_key AND mode <> 'off' AS usable, coalesce(policy, CASE scope WHEN 'user' THEN 'user_when_available' ELSE 'entity' END) AS policy FROM settings),
r AS (SELECT q.*, coalesce(u.usable AND u.policy <> 'entity', false) AS u, coalesce(e.usable, false) AS e, coalesce(e.policy, 'entity') AS p, (SELECT bool_or(usable) FROM s WHERE scope = 'system') AS y FROM ({_REQUESTS}) q LEFT JOIN s u ON u.scope = 'user' AND u.owner_id = user_id LEFT JOIN s e ON e.scope = 'entity' AND e.owner_id = entity_id)
SELECT id, user_id, entity_id, is_global, CASE WHEN u THEN 'user' WHEN p = 'user_only' THEN NULL WHEN e THEN 'entity' WHEN y THEN 'system' END AS question_paid_by, CASE WHEN is_global THEN CASE WHEN y THEN 'system' END WHEN e THEN 'entity' WHEN u THEN 'user' WHEN y THEN 'system' END AS document_paid_by FROM r""")
def payers(spark, sf_dir):
    """Who pays for help with each order's question or document: settings of customers, nations and the system."""
    names = {n: table(spark, sf_dir, n) for n in ("customer", "nation", "region", "orders")}

    def made(sql: str) -> DataFrame:
        for n in names:
            sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
        return spark.sql(sql, **{n: df for n, df in names.items() if f"{{{n}}}" in sql})

    return payer(made(_SETTINGS), made(_REQUESTS))
