"""Rules on questions and answers on made rows."""

import pytest
from pyspark.sql import functions as F

from loomline.plans import answer_rules as A

MESSAGES = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(
    "text, want",
    [
        (None, ""),
        ("  a \n\t b ", "a b"),
        ("\U0001f9e0 Answer\nyes", "yes"),
        ("kept\n\n---\n\n\U0001f5bc️ Related Images\nlost", "kept"),
        ("kept \U0001f5bc️ Related Images lost \U0001f5bc️ Related Images", "kept"),
        ("x<IMG alt='a' src=\"data:image/png;base64,AAA\" >y<b>z</b>", "x[image omitted]y z"),
        ("a &lt;b&gt; &amp;lt; &quot;c&#39;&nbsp;d", "a <b> &lt; \"c' d"),
        ("1 < 2", "1 < 2"),
    ],
)
def test_clean(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(A.clean(F.col("t"))).first()[0] == want


def test_turns(spark):
    rows = [(1, 0, "user", "q0"), (1, 1, "user", "q1"), (1, 2, "system", "s"), (1, 3, "assistant", "a1"), (1, 4, "assistant", "a2"), (1, 5, "user", " "), (1, 6, "assistant", "a3"), (1, 7, "user", "q2"), (1, 7, "assistant", "a4"), (2, 0, "assistant", "x"), (None, 0, "user", "q"), (None, 1, "assistant", "a"), (3, 0, None, "n")]
    got = A.turns(spark.createDataFrame(rows, MESSAGES)).collect()
    assert sorted((r["conv_id"] or 0, r["turn"], r["question"], r["answer"]) for r in got) == [(0, 1, "q", "a"), (1, 3, "q1", "a1"), (1, 7, "q2", "a4")]


def plain_limit(turns, most, chars):
    """turns (question, answer), oldest first."""
    kept, used = [], 0
    for i, (q, a) in enumerate(reversed(turns[-most:])):
        a = a[: max(0, chars - len(q))].rstrip() if i == 0 and len(q) + len(a) > chars else a
        used += len(q) + len(a)
        if i and used > chars:
            break
        kept.append((q, a))
    return kept


@pytest.mark.parametrize("sizes", [[(3, 4)], [(3, 40), (2, 8)], [(5, 5), (3, 7), (30, 40)], [(1, 2), (5, 90), (2, 2)], [(50, 1), (1, 1)], [(1, 1)] * 9])
@pytest.mark.parametrize("most, chars", [(3, 20), (10, 11), (1, 5)])
def test_limit(spark, sizes, most, chars):
    turns = [("q" * a, "a" * b) for a, b in sizes]
    rows = A.limited(spark.createDataFrame([(1, i, q, a) for i, (q, a) in enumerate(turns)], "conv_id long, turn long, question string, answer string"), most, chars)
    assert [(r["question"], r["answer"]) for r in rows.orderBy("newest").collect()] == plain_limit(turns, most, chars)
    assert A.limited(rows, 0, 5).count() == A.limited(rows, 5, 0).count() == 0


def test_contextual(spark):
    rows = [(1, 0, "user", "timer?"), (1, 1, "assistant", "NE555 " + "x" * 600), (1, 2, "user", "which <b>pins</b>?"), (2, 0, "user", "alone"), (3, 0, "assistant", "no question")]
    got = {r["conv_id"]: (r["n_history"], r["query"]) for r in A.contextual(spark.createDataFrame(rows, MESSAGES)).collect()}
    answer = ("NE555 " + "x" * 600)[:500]
    assert got == {1: (1, f"Previous user question: timer?\nPrevious assistant answer: {answer}\nCurrent user question: which pins ?"), 2: (0, "alone")}


def test_wants_card(spark):
    asked = {"wiring card": True, "card for a good project": True, "suggest a good project to wire": False, "hook  up an LED": True, "build a timer": True, "make a cake": False, "create ads1115 thing": True, "what is a timer": False, None: False}
    got = spark.createDataFrame([(q,) for q in asked], "q string").select("q", A.wants_card(F.col("q")).alias("w")).collect()
    assert {r["q"]: r["w"] for r in got} == asked


def test_issues(spark):
    none, full, bare = dict.fromkeys(A.CARD_LISTS), dict.fromkeys(A.CARD_LISTS, 2), dict.fromkeys(A.CARD_LISTS, 0)
    cases = [
        ("what", " \n", False, none, [A.EMPTY]),
        ("what", None, None, none, [A.EMPTY]),
        ("what", "[LLM error]", True, none, [A.ERROR, A.NO_SOURCE]),
        ("wire it", "see the Datasheet", True, full, [A.NO_GROUND, A.NO_POWER]),
        ("pin-by-pin", "GND and VCC", True, bare, [A.NO_SOURCE, *A.CARD_LISTS.values()]),
        ("hello", "hi", False, full, []),
    ]
    for q, a, s, card, want in cases:
        df = spark.createDataFrame([(q, a, s)], "q string, a string, s boolean")
        assert df.select(A.issues(F.col("q"), F.col("a"), F.col("s"), {k: F.lit(v).cast("int") for k, v in card.items()})).first()[0] == want


def test_finalize(spark):
    modes = {"always": 1, "off": 0, " Issues ": 0, "build_cards": 1, "issues_or_build": 1, "low-confidence": 0, "build_or_low_confidence": 1, "": 1, None: 1, "else": 1}
    df = spark.createDataFrame([(m,) for m in modes], "m string")
    got = df.select("m", A.finalize(F.col("m"), F.lit(None).cast("double"), F.lit(True), F.lit(0), 0.5).alias("f"), A.finalize(F.col("m"), F.lit(0.1), F.lit(True), F.lit(3), 0.5, False).alias("off")).collect()
    assert {r["m"]: int(r["f"]) for r in got} == modes and not any(r["off"] for r in got)


def test_payer(spark):
    settings = [("user", 1, True, True, "on", None), ("user", 2, True, True, "off", None), ("user", 3, True, True, None, "entity"), ("user", 4, True, True, "on", "user_only"), ("entity", 1, True, True, "on", None), ("entity", 2, True, True, "on", "user_only"), ("entity", 3, True, None, "on", None), ("system", None, True, True, "on", None)]
    requests = [(1, 1, 1, False), (2, 1, 2, None), (3, 2, 3, False), (4, 2, 4, False), (5, 3, 3, False), (6, None, None, None), (7, 9, 9, True), (8, 3, 4, False)]
    settings = spark.createDataFrame(settings, "scope string, owner_id long, enabled boolean, has_key boolean, mode string, policy string")
    requests = spark.createDataFrame(requests, "id long, entity_id long, user_id long, is_global boolean")
    got = {r["id"]: (r["question_paid_by"], r["document_paid_by"]) for r in A.payer(settings, requests).collect()}
    assert got == {1: ("user", "entity"), 2: ("entity", "entity"), 3: (None, "entity"), 4: ("user", "entity"), 5: ("system", "system"), 6: ("system", "system"), 7: ("system", "system"), 8: ("user", "user")}
    nobody = A.payer(settings.limit(0), requests)
    assert {(r["question_paid_by"], r["document_paid_by"]) for r in nobody.collect()} == {(None, None)}
