"""A training-corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Every stage takes (spark, docs, sf_dir) and returns what it keeps; all but the last return the columns of documents.
Further columns of docs are carried along whatever their names. A row without an id, or with one that other rows have
too, is a document like any other; no stage drops it for that. An empty table stays empty, very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm import langid, mixing
from gaugeline.llm._names import apart
from gaugeline.llm._store import Scratch
from gaugeline.llm.decontaminate import find_contamination
from gaugeline.llm.minhash import near_duplicates
from gaugeline.llm.suffix_dedup import remove_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the language identifier rejects; a missing language takes the predicted one.

    Null and empty texts, and those without a letter, are rejected. Repeated rows are judged alike.
    """
    rows = apart(docs, "doc_id", "text", "lang")
    model = langid.fit(rows)
    out = langid.identify(rows, model).where(~F.col("rejected")).withColumn("lang", F.coalesce("lang", "lang_pred"))
    return out.select(*rows.columns).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates (five-word shingles, 0.8).

    Rows with one id are compared by their texts like rows with different ids; null ids come last. Rows that agree in
    id and text are one document, of which one row stays. Texts without words are linked with nothing.
    """
    rows = apart(docs, "doc_id", "text")
    groups = near_duplicates(spark, rows, shingle_words=5, percent=80)
    # null ids are joined as a number that is no id
    none, row = F.lit(-(2**62)), ["by_id", "no_id", "text_hash"]
    kept = groups.where("kept").select(F.coalesce("id", none).alias("by_id"), F.col("id").isNull().alias("no_id"), "text_hash").distinct()
    keyed = rows.withColumns({"by_id": F.coalesce(F.col("doc_id").cast("long"), none), "no_id": F.col("doc_id").isNull(), "text_hash": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    out = keyed.join(kept.hint("shuffle_hash"), row, "left_semi").dropDuplicates(row)
    return out.select(*rows.columns).toDF(*docs.columns)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out passages of 200 bytes and more that occur elsewhere, in whole characters; documents left blank go.

    A passage goes from every document that has it. Documents that were blank before stay; a null text becomes empty
    and n_chars follows the text.
    """
    rows = apart(docs, "doc_id", "text", "n_chars")
    rest = [c for c in rows.columns if c not in ("doc_id", "text", "n_chars")]
    out = remove_repeats(spark, rows, length=200, whole_characters=True, carry=tuple(rest))
    text = F.col("kept").cast("string")
    out = out.withColumn("text", text).where((F.col("n_removed") == 0) | (F.trim(F.col("text")) != ""))
    out = out.withColumnRenamed("id", "doc_id").withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*rows.columns).toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item. Null and empty texts hold none."""
    rows = apart(docs, "text")
    out = find_contamination(spark, rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.where(F.size("matches") == 0).select(*rows.columns).toDF(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by calibrated probabilities; adds their topic, weight and probability.

    Rows of one id are kept or dropped together, rows without an id by their text. A column of an added name is replaced.
    """
    return mixing.mix(spark, docs).where("sampled").drop("sampled")


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", repeat_removal),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: Learned models, hashing and raking are beyond SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents`` and returns the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
