"""The registered queries of the corpus operators, each over its whole table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.llm import (
    decontaminate, hiddenstates, licenses, linededup, packing, quality, resample, secrets, shards, simhash, spotsigs, toxicity, vectorcodes,
)
from shelfwatch.session import ship_package, work_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), tokenizer_path())


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(_table(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.with_edit(_table(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(_table(spark, sf_dir, "documents"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(_table(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9(spark: SparkSession, sf_dir: str, count: int = 16) -> DataFrame:
    rows = shards.records(_table(spark, sf_dir, "documents"))
    folder = work_folder(spark, "slot-map")
    shards.store_map(shards.first_map(shards.slot_sizes(rows), count), folder)
    placed = shards.placed(rows, shards.read_map(spark, folder))
    return placed.withColumn("grown_shard", F.lit(None).cast("int")).withColumnRenamed("vslot", "virtual_slot")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(_table(spark, sf_dir, "documents"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.digest(_table(spark, sf_dir, "embeddings"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hiddenstates.digest(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_template_decontamination": op1, "op2_slack_packing": op2, "op3_license_diagonals": op3, "op4_spot_signatures": op4,
    "op5_entropy_secrets": op5, "op6_golay_simhash": op6, "op7_random_index_quality": op7, "op8_lexicon_toxicity": op8,
    "op9_virtual_slots": op9, "op10_winnowed_lines": op10, "op11_orchard_codes": op11,
    "op12_median_resampling": op12, "op13_hidden_states": op13, "pipeline": pipeline,
}
SQL: dict[str, str] = {"op11_orchard_codes": vectorcodes.SQL}
