"""The operators as queries over whole tables; each calls its operator and derives the asked columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argweave.llm import boosting, jaccard, merkle, mtree, ngrams, packing, pieces, ranked, rules, tensored, toxicity, urls, wrappers
from argweave.llm.common import crc_mod, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = boosting.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@query
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(table(spark, sf_dir, "pages"))


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = rules.judge(docs, rules.fit(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", *rules.COUNTS, "base_failed", "kept")


@query
def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), packing.vocabulary_path())


@query
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = ngrams.score(docs, ngrams.train(docs, crc_mod("doc_id", 5) != 1))
    return scored.withColumn("held_out", crc_mod("doc_id", 5) == 1)


#: The rules that the query judges by.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    judged = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), pieces.model_path())


@query
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents, and the root that each leaf leads to after the tampering of the contract."""
    docs = table(spark, sf_dir, "documents")
    fields = ("doc_id", "source", "lang", "n_chars")
    leaf = merkle.leaf_digest([*map(F.col, fields), F.col("text")])
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    other = F.when(tampered, merkle.leaf_digest([*map(F.col, fields), F.translate("text", "\n", "")])).otherwise(leaf)
    rows = merkle.manifest(docs.select("doc_id", "source", leaf.alias("leaf"), other.alias("presented")), "source", "doc_id", "leaf", ["presented"])
    rows = rows.withColumns({"proof_sha256": merkle.proof_digest(F.col("path")), "folded_root": merkle.folded(F.col("presented"), F.col("path"))})
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item."""
    return ranked.top_k(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicates among all documents."""
    return tensored.near_duplicates(table(spark, sf_dir, "documents"))
