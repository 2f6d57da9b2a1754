"""The queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import centroids, decontaminate, jaccard, language, lines, neighbours, oracles, packing, quality, render, sharding, suffixes, warc, whitening

SHARDS = [f"shard-{i:02d}" for i in range(16)]
SLOTS = 1021


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("contamination.item_ids", ","), 256)
    return found.select(
        "doc_id",
        "contamination.n_words",
        "contamination.n_hit",
        F.size("contamination.item_ids").cast("bigint").alias("n_items"),
        ids.alias("items_sha256"),
        (F.col("contamination.n_hit") > 0).alias("contaminated"),
    )


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_components(_table(spark, sf_dir, "documents"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.deduplicated(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.sha2(F.coalesce("line_dedup.text", F.lit("")), 256)
    return done.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", kept.alias("kept_sha256"))


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.sharded(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS, slots=SLOTS)
    return placed.select("doc_id", "placement.slot", "placement.shard")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    done = language.identified(documents.select("doc_id", "text"), language.learn(documents))
    return done.select("doc_id", quality.held_out("doc_id", 4, 2).alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = quality.scored(documents, quality.learn(documents, _table(spark, sf_dir, "labels")), out="score")
    return done.select("doc_id", quality.held_out("doc_id", 5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(_table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.rendered(_table(spark, sf_dir, "pages")).select("page_id", "text")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffixes.without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.sha2("suffix_dedup.kept", 256)
    return done.select("doc_id", "suffix_dedup.n_bytes", "suffix_dedup.n_removed", "suffix_dedup.n_spans", kept.alias("kept_sha256"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(_table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_decontaminate, op2_neighbours, op3_jaccard, op4_pack, op5_line_dedup, op6_shard, op7_language, op8_quality, op9_warc, op10_render, op11_suffix_dedup, op12_centroids, op13_whitening)
    }


def oracle_sql() -> dict[str, str]:
    """Of the queries that SQL can express; the others are tested against brute force."""
    return {
        "op1_decontaminate": oracles.DECONTAMINATE,
        "op2_neighbours": oracles.NEIGHBOURS,
        "op3_jaccard": oracles.JACCARD,
        "op5_line_dedup": oracles.LINES,
        "op6_shard": oracles.sharding("doc_id", "documents", SHARDS, SLOTS),
        "op9_warc": oracles.WARC,
        "op11_suffix_dedup": oracles.suffixes(400),
        "op12_centroids": oracles.centroids(8, 10, 64, 1024, 3),
    }
