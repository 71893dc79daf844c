"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate,
    hard_negatives,
    html_extract,
    imatch,
    jaccard_join,
    language_id,
    license_scan,
    packing,
    ranked_search,
    secret_scan,
    sharding,
    suffix_dedup,
    toxicity,
)

TOXIC_SCORE = 0.7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def fold(doc_id: Column, folds: int) -> Column:
    """Remainder of the CRC-32 of the id as text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(documents(spark, sf_dir)))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Learnt without the labels of held-out documents."""
    return toxicity.learn(docs, labels, fold(F.col("doc_id"), 3) != 1)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (fold(F.col("doc_id"), 3) == 1).alias("held_out"),
        toxicity.score(docs, model).alias("score"),
    ).withColumn("predicted", F.when(F.col("score") >= TOXIC_SCORE, 1).otherwise(0).cast("int"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = fold(F.col("doc_id"), 4) == 2
    model = language_id.learn(docs.filter(~held_out))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out.alias("held_out"),
        language_id.identify(docs, model).alias("p"),
    ).select("doc_id", "held_out", "p.lang_pred", "p.score")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = decontaminate.scan(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return scanned.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffle_to_shards(documents(spark, sf_dir))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(documents(spark, sf_dir)))


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return imatch.compare_with_next(docs, imatch.lexicon(docs))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked_search.build_index(documents(spark, sf_dir))
    return ranked_search.search(index, table(spark, sf_dir, "benchmark"), "item_id")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = hard_negatives.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label)
    return hard_negatives.mine(vectors, F.col("id") % 100 == 0)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_license_scan,
        op2_packing,
        op3_html_extraction,
        op4_toxicity,
        op5_jaccard_join,
        op6_language_id,
        op7_decontamination,
        op8_sharding,
        op9_secret_scan,
        op10_imatch,
        op11_ranked_search,
        op12_hard_negatives,
        op13_suffix_dedup,
    )
    return {query.__name__: query for query in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_scan.SQL,
        "op5_jaccard_join": jaccard_join.SQL,
        "op7_decontamination": decontaminate.SQL,
        "op11_ranked_search": ranked_search.SQL,
        "op12_hard_negatives": hard_negatives.SQL,
        "op13_suffix_dedup": suffix_dedup.SQL,
    }
