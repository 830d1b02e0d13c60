"""The registered queries of these operators, their SQL where there is any, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import importance_resampling, language_nb, license_scan, lsh_forest, nra_topk, packing, quality_mil, quality_rules, secret_scan, sentencepiece_lattice, shard_lpt, spelling_variants, token_orc
from loomline.llm.shared import Scratch, held_out, ship_package, table

#: Where the vocabulary files of public tokenizers lie.
BPE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
QUALITY_CUT = 0.3
SHARDS = 40


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    path = Scratch(spark, "tokens").path("orc")
    token_orc.write(table(spark, sf_dir, "documents"), path, tokenizer_path(BPE_FILE), end_id=2)
    return token_orc.digest(token_orc.starts(token_orc.read(spark, path)))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    pieces = sentencepiece_lattice.PieceTable(spark, tokenizer_path(PIECE_FILE))
    return sentencepiece_lattice.digest(sentencepiece_lattice.encode(table(spark, sf_dir, "documents"), pieces), pieces)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    notices = license_scan.templates(spark, license_scan.TEMPLATES)
    return license_scan.scan(table(spark, sf_dir, "documents"), notices, len(license_scan.TEMPLATES))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(spark, docs, secret_scan.fit(docs)).drop("text")
    n = lambda kind: F.size(F.filter("secret_spans", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    base = F.filter("secret_spans", lambda x: x.kind != "random")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("secret_spans")).alias("spans"))


def op6_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_mil.fit(docs, table(spark, sf_dir, "labels"))
    return quality_mil.score(spark, docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


def op7_language_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    model = language_nb.fit(docs)
    return language_nb.predict(spark, docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op8_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return lsh_forest.near_duplicates(spark, table(spark, sf_dir, "documents"), width=3, percent=85)


def op9_nra_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nra_topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing.digest(packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path(BPE_FILE), end_id=0, max_words=700_000))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    drawn = importance_resampling.resample(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shard_lpt.assign(spark, table(spark, sf_dir, "documents"), SHARDS)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return spelling_variants.variants(spark, table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_token_orc, op3_sentencepiece, op4_license_scan, op5_secret_scan, op6_quality_mil, op7_language_nb, op8_lsh_forest, op9_nra_topk, op10_packing, op11_importance_resampling, op12_lpt_sharding, op13_spelling_variants, pipeline)}
ORACLE_SQL = {"op1_quality_rules": quality_rules.SQL, "op4_license_scan": license_scan.SQL, "op9_nra_topk": nra_topk.SQL, "op11_importance_resampling": importance_resampling.SQL, "op12_lpt_sharding": shard_lpt.SQL, "op13_spelling_variants": spelling_variants.SQL}
