"""Operators against brute force, the libraries they stand for, round trips and held-out accuracy; and odd inputs."""

import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomline.llm import bpe, language_nb, license_scan, lsh_forest, nra_topk, packing, quality_mil, quality_rules, queries, secret_scan, sentencepiece_lattice, token_orc
from loomline.llm.shared import Scratch, held_out, ship_package

DATA = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "one two"), (4, "one two"), (5, "ONE Two three four five six seven"), (6, "one two three four five six seven"), (7, "x " * 5000), (8, "\n\t \n"), (8, "é ß 日本 \x00 a  b\n\nc."), (9, "token: abcdef, AKIA" + "Z" * 20)]
SCHEMA = "doc_id long, text string, score double, words string, h int, node int"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, and extra columns that clash with inner names."""
    return spark.createDataFrame([(i, t, 0.5, "w", 1, 2) for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("name", ["op1_quality_rules", "op4_license_scan", "op9_nra_topk"])
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    want = c.sql(queries.ORACLE_SQL[name])
    at = [list(want.columns).index(x) for x in df.columns]
    assert sorted(tuple(r) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_op1_odd(odd, none):
    got = {(r.doc_id, r.n_words): r for r in quality_rules.judge(odd).collect()}
    assert got[1, 0].base_failed and not got[1, 0].kept and got[7, 5000].n_repeat_words == 5000
    assert quality_rules.judge(odd).count() == len(ODD) and quality_rules.judge(none).count() == 0


def test_op2_round_trip(spark, odd, none, docs):
    e = bpe.encoder(queries.tokenizer_path(queries.BPE_FILE))
    for df in (docs.select("doc_id", "text"), odd):
        path = Scratch(spark, "t").path("orc")
        token_orc.write(df, path, queries.tokenizer_path(queries.BPE_FILE), 2)
        rows = token_orc.starts(token_orc.read(spark, path)).orderBy("start").collect()
        assert [r.doc_id for r in rows] == sorted(r.doc_id for r in df.collect())
        assert [r.start for r in rows] == [0, *np.cumsum([len(r.ids) for r in rows])[:-1]]
        want = sorted((r.doc_id, [*e.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in df.collect())
        assert sorted((r.doc_id, list(r.ids)) for r in rows) == want
        for r in token_orc.digest(token_orc.starts(token_orc.read(spark, path))).collect():
            assert any(r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) for i, ids in want if i == r.doc_id)
    path = Scratch(spark, "t").path("orc")
    token_orc.write(none, path, queries.tokenizer_path(queries.BPE_FILE), 2)
    assert token_orc.starts(token_orc.read(spark, path)).count() == 0


def test_encoder_equals_a_fresh_tokenizer():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(queries.BPE_FILE)
    fresh, own = Tokenizer.from_file(path), bpe.encoder(path)
    special = [t.content for t in fresh.get_added_tokens_decoder().values()]
    rng = np.random.default_rng(9)
    parts = ["a", "B", "word", " ", "  ", "\n", "\t", "'s", "don't", "12", "3.5", "é", "ß", "ñandú", "日本", "Ⅳ", "!?", "_x", "\r\n", "\u00a0", "\x00", *special]
    texts = ["", " ", "hello <|endoftext|> world", *special, *("".join(rng.choice(parts, rng.integers(1, 30))) for _ in range(3_000))]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == fresh.encode(t, add_special_tokens=False).ids, t


def test_blocks_of_texts_equal_a_fresh_tokenizer():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(queries.BPE_FILE)
    fresh, own = Tokenizer.from_file(path), bpe.WordEncoder(path)
    special = [t.content for t in fresh.get_added_tokens_decoder().values()]
    rng = np.random.default_rng(10)
    chars = np.array([chr(c) for c in range(1, 0x250)])
    parts = ["a", "B", "word", " the", " ,", "'s", " 's", "don't", "12", "3.5", "à", "ñandú", "Ơ", "!?", "_x", " ", "\n", "\x1c"]
    rare = ["  ", "\t", "日本", "\r\n", "\u00a0", "\x00", "ÿ", "Ā", *special]
    texts = [None, "", " ", "\n", "\nfirst", " first", "last ", "last\n", "one", "\x00", *special, *parts, *rare]
    texts += ["".join(rng.choice(parts, rng.integers(1, 30))) for _ in range(2_000)]
    texts += [" ".join("".join(rng.choice(chars, rng.integers(1, 9))) for _ in range(rng.integers(1, 9))) for _ in range(2_000)]
    texts += ["".join(rng.choice(parts + rare, rng.integers(1, 12))) for _ in range(1_000)]
    want = [fresh.encode(t or "", add_special_tokens=False).ids for t in texts]
    for size in (1, 7, 1_000, len(texts)):
        for at in range(0, len(texts) if size > 1 else 50, size):
            got = own.encode_all(pa.array(texts[at : at + size], pa.string()))
            assert [np.frombuffer(b, "<u4").tolist() for b in got] == want[at : at + size]
    assert own.encode_all(pa.array([], pa.string())) == []
    own.between = None  # as with a vocabulary that has no byte to stand between words
    assert [np.frombuffer(b, "<u4").tolist() for b in own.encode_all(pa.array(texts, pa.string()))] == want


def test_block_meets_a_new_word_once_and_beside_others():
    own, calls = bpe.WordEncoder(queries.tokenizer_path(queries.BPE_FILE), max_words=100), []

    class Counting:
        def tokenize(self, word, model=own.model):
            calls.append(word)
            return model.tokenize(word)

    own.model = Counting()
    words = [f"{a}{b}{c}" for a in "bcdfghklmn" for b in "aeiou" for c in ("ter", "lon", "mus", "vik", "zop", "dri")] * 20
    texts = [" ".join(words[at : at + 50]) for at in range(0, len(words), 50)]
    assert len(own.encode_all(pa.array(texts))) == 120
    # 300 words, some also without a space before them: more often than the tables hold, each once, in a few calls
    assert sum(len(c.split("Ā")) - 1 for c in calls) <= 330 and len(calls) <= 4


def test_op2_filter_skips_stripes(spark):
    rows = spark.range(0, 40_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words of a text"), F.col("id").cast("string")).alias("text"))
    path = Scratch(spark, "t").path("orc")
    token_orc.write(rows, path, queries.tokenizer_path(queries.BPE_FILE), 2, stripe_bytes=1 << 16)
    found = token_orc.read(spark, path).where("doc_id = 777")
    assert len(found.collect()) == 1
    leaf = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert "EqualTo(doc_id,777)" in leaf.toString()
    vectors = token_orc.read(spark, path).where("doc_id = 777").select("doc_id")
    vectors.collect()
    read = vectors._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numOutputRows").get().value()
    assert 0 < read < 20_000


def test_op3_equals_library(spark, none, odd, docs):
    from sentencepiece import SentencePieceProcessor

    path = queries.tokenizer_path(queries.PIECE_FILE)
    p, table = SentencePieceProcessor(model_file=path), sentencepiece_lattice.PieceTable(spark, path)
    rng = np.random.default_rng(3)
    long = ["".join(rng.choice(list(a), 3_000)) for a in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "the intrso", "日本語の文章é")]
    short = [" ".join("".join(rng.choice(list("abcdeé日in\n"), rng.integers(1, 60))) for _ in range(300)), "=" * 61, "=" * 59, "x" * 60 + " " + "ab" * 200]
    texts = [None, "", " a  b\n\tc ", "Ⅳ é 日本 x", "the internationalization of representation", "a▁b", "Onehen theaouing | er $$$", "x", "x", *long, *short]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rows, most in ((df, 200_000), (df, 40), (docs, 200_000), (docs, 500), (odd, 0)):
        got = sentencepiece_lattice.decode(sentencepiece_lattice.encode(rows, table, most), table).collect()
        assert len(got) == rows.count()
        for r in got:
            assert list(r.ids) == p.encode(r.text or ""), r.text
            assert r.decoded == p.decode(p.encode(r.text or ""))
    assert sentencepiece_lattice.encode(none, table).count() == 0
    digest = {r.doc_id: r for r in sentencepiece_lattice.digest(sentencepiece_lattice.encode(df, table), table).collect()}
    assert all(r.ids_crc32 == zlib.crc32(np.array(p.encode(texts[i] or ""), "<u4").tobytes()) and r.round_trip for i, r in digest.items())


def test_op3_long_runs_are_quick(spark):
    import time

    table = sentencepiece_lattice.PieceTable(spark, queries.tokenizer_path(queries.PIECE_FILE))
    run = "▁" + "".join(np.random.default_rng(4).choice(list("abcdefghijklmnopqrstuvwxyz"), 100_000))
    began = time.perf_counter()
    assert "".join(table.fold(run)) == run and "".join(table.viterbi(run)) == run
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_op3_fold_equals_brute_force(spark, kind):
    table = sentencepiece_lattice.PieceTable(spark, queries.tokenizer_path(queries.PIECE_FILE))
    table.kind = kind

    def merged(run):
        parts = list(run)
        while ways := [(table.piece[a + b][0], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in table.piece]:
            i = min(ways)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    runs = ["▁the", "▁internationalization", "▁abc", "▁a", "▁" + "aab" * 19, "▁naïve日"]
    value = {i: cost for cost, i in table.piece.values()}
    for r in sentencepiece_lattice.dictionary(spark.createDataFrame([(x,) for x in runs], "run string").distinct(), table).collect():
        if kind == "bpe":
            want = [j for x in merged(r.run) for j in ([table.piece[x][1]] if x in table.piece else [table.first_byte + b for b in x.encode()])]
            assert list(r.ids) == want and list(np.frombuffer(table.long_ids(r.run), "<i4")) == want
        else:
            assert sum(value.get(i, 0) for i in r.ids) == pytest.approx(sum(table.piece[x][0] for x in table.viterbi(r.run) if x in table.piece))
            ways = [0.0]
            for k in range(1, len(r.run) + 1):
                ways.append(min([ways[k - 1] + 1e9] + [ways[j] + table.piece[r.run[j:k]][0] for j in range(k) if r.run[j:k] in table.piece]))
            assert ways[-1] % 1e9 == pytest.approx(sum(value.get(i, 0) for i in r.ids))


def test_op4_odd(spark, odd, none):
    notices = license_scan.templates(spark, license_scan.TEMPLATES)
    assert license_scan.scan(odd, notices, 10).count() == 0 and license_scan.scan(none, notices, 10).count() == 0
    found = license_scan.scan(spark.createDataFrame([(1, "x y z " + license_scan.TEMPLATES[0][1] + " a b")], "doc_id long, text string"), notices, 10).collect()
    assert [(r.license, r.containment) for r in found] == [("Apache-2.0", 1.0)]


def test_op5_base(spark, odd, none):
    model = secret_scan.fit(odd)
    got = {(r.doc_id, r.text): [(x.kind, x.start, x.end) for x in r.secret_spans] for r in secret_scan.scan(spark, odd, model).collect()}
    assert got[1, None] == [] and got[9, ODD[-1][1]] == [("assign", 0, 13), ("access", 15, 39)]
    assert secret_scan.scan(spark, none, secret_scan.fit(none)).count() == 0
    tokens = ["q7Zx9LmP2vKt8RwY4sBn6Hd", "getUserNameFromRequestContext", "thtionerandothingiones"]
    assert list(model.random(tokens)) == [True, False, False]
    df = spark.createDataFrame([(1, "é token=abcdef0123 x", 20)], "doc_id long, text string, n_chars long")
    r = secret_scan.redact(secret_scan.scan(spark, df, model)).first()
    assert r.text == "é [SECRET] x" and r.n_chars == 12


def restated_secrets(text):
    text = text or ""
    kinds = (("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", "(AKIA[A-Z0-9]+)"), ("hex", "([0-9a-f]+)"))
    least = {"assign": 6, "access": 20, "hex": 24}
    return [(kind, m.start(), m.end()) for kind, pattern in kinds for m in re.finditer(pattern, text) if len(m[1]) >= least[kind]]


def test_op5_base_spans_equal_restated_patterns(spark):
    import hashlib

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for r in queries.op5_secret_scan(spark, "/root/testdata/sf0.01").collect():
        want = restated_secrets(docs[r.doc_id])
        order = sorted(want, key=lambda x: (x[1], secret_scan.KINDS.index(x[0]), x[2]))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in order).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex")]


def test_op5_precision_and_recall_of_random_tokens(spark):
    model = secret_scan.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    random, ordinary = secret_scan.labelled_random(2_000, seed=901), [t for t in secret_scan.labelled_ordinary(4_000, seed=902) if len(t) >= secret_scan.MIN_TOKEN]
    hits, false = model.random(random).mean(), model.random(ordinary).mean()
    assert hits > 0.9 and false < 0.01
    plain = sum(model.ratio[secret_scan._CODE[ord(a)] if a else secret_scan.STATES - 1, secret_scan._CODE[ord(b)]] for a, b in zip(["", *random[0]], random[0]))
    assert bool(model.random(random[:1])[0]) == (plain >= secret_scan.MIN_RATIO and plain >= secret_scan.MIN_RATE * len(random[0]))


def test_op6_forward_equals_plain_loops():
    import math

    import pyarrow as pa

    rng = np.random.default_rng(2)
    bounds = np.array([0, 3, 4, 9])
    x, y = rng.normal(size=(9, quality_mil.WIDTH)).astype(np.float32), np.array([1.0, 0.0, 1.0], np.float32)
    model = quality_mil.train(x, bounds, y, hidden=4, gate=3, epochs=2)
    w, z = {k: v.tolist() for k, v in model.w.items()}, (x - model.mean) / model.scale
    got = model.forward(z, bounds)["p"]
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    for bag in range(3):
        hs = [[math.tanh(sum(float(z[i][j]) * w["W"][j][k] for j in range(quality_mil.WIDTH)) + w["b"][k]) for k in range(4)] for i in range(bounds[bag], bounds[bag + 1])]
        gate = [sum(math.tanh(sum(h[k] * w["V"][k][g] for k in range(4))) * sigmoid(sum(h[k] * w["U"][k][g] for k in range(4))) * w["a"][g] for g in range(3)) for h in hs]
        e = [math.exp(g) for g in gate]
        rep = [sum(a / sum(e) * h[k] for a, h in zip(e, hs)) for k in range(4)]
        assert got[bag] == pytest.approx(sigmoid(sum(r * c for r, c in zip(rep, w["c"])) + w["d"][0]), abs=1e-4)
    one, two = quality_mil.passages(pa.array(["ab cd", None])), quality_mil.passages(pa.array(["ab cd"]))
    assert list(one[1]) == [0, 1, 2] and np.array_equal(one[0][0], two[0][0])


def test_op7_equals_plain_naive_bayes(spark):
    import math
    from collections import Counter

    import pyarrow as pa

    docs = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    frame = spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in docs], "doc_id long, text string, lang string")
    model = language_nb.fit(frame)
    grams = lambda t: [int(b) for bs in language_nb.grams(pa.array([t or ""]))[0] for b in bs if b != language_nb.BUCKETS]
    counts, prior = {}, Counter()
    for r in docs:
        if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang is not None and r.text is not None:
            counts.setdefault(r.lang, Counter()).update(grams(r.text))
            prior[r.lang] += 1
    total = {lang: sum(c.values()) + 0.1 * language_nb.BUCKETS for lang, c in counts.items()}
    got = {r.doc_id: r for r in language_nb.predict(spark, frame, model).collect()}
    for r in docs[:60]:
        g = grams(r.text)
        if not g:
            continue
        s = {lang: math.log(prior[lang] / sum(prior.values())) + min(1.0, language_nb.EVIDENCE / len(g)) * sum(math.log((c[b] + 0.1) / total[lang]) for b in g) for lang, c in counts.items()}
        best = max(sorted(s), key=s.get)
        assert got[r.doc_id].lang_pred == best and got[r.doc_id].score == pytest.approx(1 / sum(math.exp(v - s[best]) for v in s.values()), abs=1e-3)


def test_op6_held_out(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality_mil.fit(docs, labels)
    rows = quality_mil.score(spark, docs, model).join(labels, "doc_id").where(held_out()).select("score", "quality").toPandas()
    assert ((rows.score >= 0.3) == (rows.quality == 1)).mean() > 0.9
    assert quality_mil.score(spark, odd, model).count() == len(ODD)
    empty = quality_mil.fit(none, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality_mil.score(spark, odd, empty).collect()} == {0.5}


def test_op7_held_out(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_nb.fit(docs)
    assert language_nb.predict(spark, docs, model).where(held_out()).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    got = {(r.doc_id, r.text): r for r in language_nb.predict(spark, odd, model).collect()}
    assert got[1, None].lang_pred == got[2, ""].lang_pred == "und" and got[1, None].score == 0
    unlearned = language_nb.fit(none.withColumn("lang", F.lit("x")))
    assert {r.lang_pred for r in language_nb.predict(spark, odd, unlearned).collect()} == {"und"}


def brute_components(rows, width, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in rows:
        w = words((t or "").translate(lower))
        sets.append((i, {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())))
    up = {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1 :]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return {(i, len(s), top(i)) for i, s in sets}


def test_op8_equals_brute_force(spark, odd, none, docs):
    near = " ".join(f"w{i}" for i in range(300))
    made = [(1000 + k, near.replace(f"w{7 * k} ", "z ")) for k in range(30)] + [(2000 + k, near.replace(f"w{5 * k} ", "").replace(f"w{9 * k + 1} ", "y ")) for k in range(25)] + [(3000 + k, "short text") for k in range(5)]
    for rows, width, percent in ((ODD, 3, 85), ([(r.doc_id, r.text) for r in docs.collect()] + made, 3, 85), (made, 5, 80)):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {(r.doc_id, r.n_shingles, r.component_id) for r in lsh_forest.near_duplicates(spark, df, width, percent).collect()}
        assert got == brute_components(rows, width, percent)
    assert lsh_forest.near_duplicates(spark, none).count() == 0 and lsh_forest.near_duplicates(spark, odd).count() == len(ODD)


def test_op8_recall_at_the_threshold(spark):
    for percent, trees in ((85, 16), (80, 24)):
        assert lsh_forest.trees_for(percent) == trees and (1 - (percent / 100) ** lsh_forest.LEAST_DEPTH) ** trees <= 1e-4
    pairs = 4_000  # each at 40 common shingles of 50
    rows = [(2 * k + i, " ".join(f"w{k}x{j}" + "z" * (i * (j == 24)) for j in range(49))) for k in range(pairs) for i in (0, 1)]
    found = lsh_forest.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(8), 5, 80)
    assert found.where("component_id = doc_id - doc_id % 2").count() == 2 * pairs


def forest_rows(keys, sizes=None, bits=0):
    import pyarrow as pa

    n = len(keys)
    return pa.RecordBatch.from_arrays([pa.array([0] * n), pa.array(range(n)), pa.array(sizes or [50] * n), pa.array([bits] * n), pa.array([0] * n), pa.array([np.array(k, ">u4").tobytes() for k in keys])], ["tree", "node", "n", "bits_1", "bits_2", "key"])


@pytest.mark.parametrize("step", [1, 3, 12])
def test_op8_neighbours_have_the_longest_prefixes(step):
    keys = sorted([0] * 5 + [i % 2, i % 3, i] for i in range(12))
    batch = forest_rows(keys)
    got = [r for b in lsh_forest._forest_pairs(80, 24)([batch.slice(i, step) for i in range(0, 12, step)]) for r in b.to_pylist() if r["near"]]
    prefix = lambda a, b: next((d for d, (x, y) in enumerate(zip(keys[a], keys[b])) if x != y), 8)
    assert all(r["common"] == prefix(r["x"], r["y"]) for r in got) and len(got) == len({(r["x"], r["y"]) for r in got})
    assert all(max(r["common"] for r in got if r["x"] == x) == max(prefix(x, y) for y in range(x)) for x in range(1, 12))
    assert {r["y"] for r in got if r["x"] == 11} == {0, 8, 9, 10}


@pytest.mark.parametrize("step", [1, 4, 100])
def test_op8_depth_adapts_to_the_prefix(step):
    few, dense = [[1, 1, 1, 9 * i, i, 0, 0, 0] for i in range(8)], [[2, 2, 2, i // 2, i, 0, 0, 0] for i in range(20)]
    batch = forest_rows(few + dense)
    got = {(r["x"], r["y"]) for b in lsh_forest._forest_pairs(80, 24)([batch.slice(i, step) for i in range(0, 28, step)]) for r in b.to_pylist() if r["sparse"]}
    assert got == {(x, y) for x in range(8) for y in range(x)} | {(8 + 2 * i + 1, 8 + 2 * i) for i in range(10)}
    far = forest_rows(few, sizes=[50, 10] * 4)
    assert all((r["x"] - r["y"]) % 2 == 0 for b in lsh_forest._forest_pairs(80, 24)([far]) for r in b.to_pylist())


def test_op8_blocks_and_hot_pivots_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lsh_forest, "REGION", 8)
    monkeypatch.setattr(lsh_forest, "PIVOTS", 0)
    base = " ".join(f"w{i}" for i in range(200))
    made = [(k, base.replace(f"w{3 * k} ", "z ").replace(f"w{2 * k + 1} ", "y ")) for k in range(60)] + [(100 + k, base.replace(f"w{k} ", f"q{k} ").replace(f"w{k + 40} ", f"q{k} ").replace(f"w{k + 80} ", f"q{k} ").replace(f"w{k + 99} ", f"q{k} ")) for k in range(60)]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in lsh_forest.near_duplicates(spark, spark.createDataFrame(made, "doc_id long, text string"), 5, 85).collect()}
    assert got == brute_components(made, 5, 85)
    pairs = spark.createDataFrame([(i, 0) for i in range(1, 3_001)], "a long, b long")
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(3_001)], "doc_id long, text string")
    joined = lsh_forest._with_text(lsh_forest._with_text(pairs, pairs, texts, "b", "a"), pairs, texts, "a", "b")
    assert sorted(tuple(r) for r in joined.select("a", "text_a", "b", "text_b").collect()) == [(i, f"t{i}", 0, "t0") for i in range(1, 3_001)]


def test_op8_null_and_repeated_ids(spark):
    text = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "abcd"}
    near = text["a"].replace("a59", "other")
    rows = [(None, text["a"]), (None, near), (None, text["b"]), (None, text["b"]), (None, None), (None, ""), (4, text["a"]), (7, text["a"]), (7, text["c"]), (7, text["c"]), (9, text["d"]), (9, near), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in lsh_forest.near_duplicates(spark, df.where("doc_id IS NULL OR doc_id < 9")).collect())
    assert got == [(0, 0, None, True)] * 2 + [(0, 56, None, True)] * 4 + [(4, 56, 4, True)] + [(7, 56, 4, False)] * 3
    alone = spark.createDataFrame([(3, text["c"]), (3, text["c"])], df.schema)
    assert sorted(r.kept for r in lsh_forest.near_duplicates(spark, alone).collect()) == [False, True]
    stage = corpus_pipeline.near_duplicates(spark, df.withColumn("lang", F.lit("en")), DATA)
    kept = sorted(((r.doc_id or 0, r.text or "") for r in stage.collect()), key=str)
    assert stage.columns == ["doc_id", "text", "lang"]
    assert kept == sorted([(0, ""), (0, ""), (0, text["b"]), (4, text["a"]), (7, text["c"]), (9, ""), (9, text["d"])], key=str)


def test_op9_odd(spark):
    nan, inf = float("nan"), float("inf")
    v = [(0, [1.0, 0.5]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, None), (5, [None, 1.0]), (6, [1.0]), (50, [0.5, -0.3]), (7, [-1.0, 0.25])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").withColumn("b", F.lit(1))
    got = [tuple(r) for r in nra_topk.top_k(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 49152), (0, 2, 1, 49152), (0, 3, 50, 22912), (0, 4, 7, -57344), (50, 1, 0, 22912), (50, 2, 1, 6528), (50, 3, 1, 6528), (50, 4, 7, -37696)][: len(got)] and len(got) == 8
    assert nra_topk.top_k(df.limit(0), df.limit(0)).count() == 0


def brute_top(vectors, asked, k):
    out = []
    for query_id, q in asked:
        best = sorted((-sum(int(a) * int(b) for a, b in zip(q, v)), i) for i, v in vectors if i != query_id)[:k]
        out += [(query_id, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("most", [40, 1 << 20, 1 << 27])
def test_op9_blocks_equal_brute_force(spark, most):
    rng = np.random.default_rng(most)
    vectors = [(i, [float(x) for x in rng.integers(-most, most, 12)]) for i in range(700)] + [(1000 + i, [1.0] * 12) for i in range(40)]
    df = spark.createDataFrame([(i, [x / 256 for x in v]) for i, v in vectors], "vec_id long, embedding array<double>")
    asked = [(i, v) for i, v in vectors if i % 50 == 0]
    got = [tuple(r) for r in nra_topk.top_k(df, df.where("vec_id % 50 = 0"), 5, block=150, query_block=7).orderBy("query_id", "rank").collect()]
    assert got == brute_top(vectors, asked, 5)


def test_op9_range_is_checked():
    big = np.array([[1 << 40, 1]])
    assert nra_topk.exact_kind(np.array([[3, -4]]), np.array([[5, 6]])) is np.float64 and nra_topk.exact_kind(big, np.array([[1 << 15, 1]])) is np.int64
    with pytest.raises(ArithmeticError):
        nra_topk.exact_kind(big, big)


def test_op9_stops_early_where_few_dimensions_count():
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (4_000, 8))
    x[:, 0] = rng.permutation(4_000) * 50
    entries = []
    got = list(nra_topk.block_top(x, np.arange(4_000), np.ones(4_000, int), np.array([[7, 1, -1, 0, 0, 0, 0, 0]]), np.array([-1]), 5, entries))
    score = x @ np.array([7, 1, -1, 0, 0, 0, 0, 0])
    assert [g[1] for g in got] == list(np.lexsort((np.arange(4_000), -score))[:5]) and entries[0] < 3 * 4_000 / 4


@pytest.mark.parametrize("block", [2_000, 1 << 22])
def test_op10_pieces(spark, odd, docs, block):
    e = bpe.encoder(queries.tokenizer_path(queries.BPE_FILE))
    df = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text").where("doc_id <> 8").withColumn("doc_id", F.col("doc_id") + 10_000))
    rows = packing.pieces(df, queries.tokenizer_path(queries.BPE_FILE), 0, block_tokens=block).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for r in df.collect():
        parts = sorted(by_doc[r.doc_id], key=lambda x: x.start)
        ids = [*e.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        assert [i for p in parts for i in p.ids] == ids and all(p.doc_tokens == len(ids) and p.length == len(p.ids) for p in parts)
        assert [p.start for p in parts] == [0, *np.cumsum([p.length for p in parts])[:-1]]
    for parts in by_sequence.values():
        parts.sort(key=lambda x: x.offset)
        size = sum(p.length for p in parts)
        assert [p.offset for p in parts] == [0, *np.cumsum([p.length for p in parts])[:-1]] and size & (size - 1) == 0 and size <= 1024


def test_op10_best_fit():
    tree = packing.CapacityTree(16)
    for c, w in ((5, 0), (9, 1), (16, 2)):
        tree.add(c, w)
    assert [tree.take(6), tree.take(6), tree.take(6), tree.take(5), tree.take(1)] == [(1, 9), (2, 16), None, (0, 5), None]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, now, n = docs.columns, docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in now.collect()]
        now = Scratch(spark, "t").keep(stage(spark, now, DATA), name)
        assert now.columns == columns and 0 < now.count() <= n, name
        n = now.count()
        if name == "near_duplicates":
            assert {r.doc_id for r in now.collect()} == {i for i, _, c in brute_components(before, 5, 80) if i == c}
        if name == "secrets":
            assert n == len(before) and not any(secret_scan.base_spans(r.text) for r in now.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, now, DATA).select("doc_id").distinct().count() == n


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_with_odd_rows(spark, odd, none, stage):
    """Nulls, empty and long texts, repeated rows, clashing columns and empty tables: every stage but the last returns the
    columns of its input, and near duplicates, secrets and packing account for every row."""
    own = {"_row": "mine", "_lang": "yours", "_score": "theirs", "secret_spans": "ours", "a b.c": "dotted", "input__0": "other"}
    for df in (odd, none):
        df = df.withColumns({c: F.lit(v) for c, v in own.items()})
        rows = stage(spark, df.withColumn("lang", F.lit("en")), DATA)
        got = rows.collect()
        if stage is corpus_pipeline.pack:
            assert {r.doc_id for r in got} == {r.doc_id for r in df.collect()}
        else:
            assert rows.columns == [*df.columns, "lang"] and len(got) <= df.count()
            assert all(r[c] == v for r in got for c, v in own.items())
        if stage is corpus_pipeline.secrets:
            assert len(got) == df.count()


def test_components_and_later_links_equal_union_find(spark):
    from loomline.llm.components import components, merged
    from loomline.llm.shared import Scratch

    def brute(pairs):
        up = {}

        def root(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for a, b in pairs:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
        return sorted((x, root(x)) for x in up)

    pairs = [(int(a), int(b)) for a, b in np.random.default_rng(1).integers(0, 60, (50, 2)) if a != b] + [(i, i + 1) for i in range(100, 112)]
    cut, scratch = len(pairs) // 2, Scratch(spark, "components-test")
    frame = lambda x: spark.createDataFrame(x, "a long, b long")
    found = components(scratch, frame(pairs[:cut]))
    assert sorted(tuple(r) for r in found.collect()) == brute(pairs[:cut])
    assert sorted(tuple(r) for r in merged(scratch, found, frame(pairs[cut:])).collect()) == brute(pairs)
    assert components(scratch, frame([])).count() == 0
