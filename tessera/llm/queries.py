"""The thin query of each training-data operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import oracle
from tessera.llm.common import table


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: 40 runs of the Hilbert order over source, language and length."""
    from pyspark.sql import functions as F

    from tessera.llm.hilbert_shards import assign

    placed = assign(table(spark, sf_dir, "documents"), shards=40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tessera.llm.line_spread import remove_boilerplate

    rows = remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    kept = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", "n_lines", "n_removed", F.length(kept).cast("long").alias("kept_chars"), F.md5(kept).alias("kept_md5"))


def op3_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.piece_counts import count_pieces

    return count_pieces(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.language_id import predict

    return predict(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.substring_dedup import dedup

    return dedup(table(spark, sf_dir, "documents"))


def op6_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.shingle_join import link

    return link(table(spark, sf_dir, "documents"))[0].select("doc_id", "n_shingles", "component_id")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.source_mix import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.line_quality import judge

    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.latent_decontamination import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.weak_quality import score

    return score(table(spark, sf_dir, "documents"))


def op11_turn_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """12 batches, closed after 3 silent ones."""
    from tessera.llm.turn_reassembly import arrivals, digests, reassemble

    return digests(reassemble(arrivals(table(spark, sf_dir, "conversations"))))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tessera.llm.fill_middle import fill_in_middle, restored

    rows = fill_in_middle(table(spark, sf_dir, "documents"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.contextual_pii import digests, identifiers

    return digests(*identifiers(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_hilbert_shards": op1_hilbert_shards,
        "op2_line_spread": op2_line_spread,
        "op3_piece_counts": op3_piece_counts,
        "op4_language_id": op4_language_id,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_shingle_join": op6_shingle_join,
        "op7_source_mix": op7_source_mix,
        "op8_line_quality": op8_line_quality,
        "op9_latent_decontamination": op9_latent_decontamination,
        "op10_weak_quality": op10_weak_quality,
        "op11_turn_reassembly": op11_turn_reassembly,
        "op12_fill_middle": op12_fill_middle,
        "op13_contextual_pii": op13_contextual_pii,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.sql()
