"""The queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talkmill.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talkmill.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), 24)


def op2_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talkmill.llm.near_duplicates import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talkmill.llm.mixing import mix_documents

    return mix_documents(table(spark, sf_dir, "documents"))


def op4_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talkmill.llm.licences import scan

    return scan(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talkmill.llm.quality import judge_documents

    return judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talkmill.llm.lines import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents"))


def op7_suffix_array_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talkmill.llm.language_model import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op8_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talkmill.llm.token_files import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_file())


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talkmill.llm.toxicity import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talkmill.llm.decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    from talkmill.llm import entries

    return {k: f for k, f in vars(entries).items() if k[:2] == "op" and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from talkmill.llm import licences, mixing

    return {"op3_mix_sources": mixing.SQL, "op4_licence_rules": licences.sql()}
