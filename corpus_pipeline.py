"""The corpus pipeline: quality, toxicity, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and gives the documents that it keeps, with all their columns; the last gives the
packed pieces. run() writes what a stage returns as Parquet to the shared folder and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import compression_quality, dart_minhash, packing, suffix_dedup, toxicity
from siftwell.llm.common import forget, in_fold, materialise, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a quality score of 0.5 or more; the model learns from the labels of two folds of three."""
    held = in_fold("doc_id", 3, 1)
    model = compression_quality.fit(docs.where(~held), read(spark, sf_dir, "labels").where(~held))
    return compression_quality.quality(docs, model, "__sw_score").where("__sw_score >= 0.5").drop("__sw_score")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a toxicity score under 0.3; the model learns from the labels of three folds of four."""
    held = in_fold("doc_id", 4, 2)
    model = toxicity.fit(docs.where(~held), read(spark, sf_dir, "labels").where(~held))
    return toxicity.toxicity(docs, model, "__sw_score").where(F.col("__sw_score") < toxicity.Params.threshold).drop("__sw_score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each class; rows of one id and text once; rows without an id all stay.

    Rows of one id are one document to the operator: where its texts differ, all of them stay or go together.
    """
    label = dart_minhash.classes(docs.select("doc_id", "text"))
    first = materialise(label.where("doc_id = class_id").select("doc_id").distinct(), "kept")
    stay = docs.where("doc_id is not null").join(first, "doc_id", "left_semi").withColumn("__sw_text", F.xxhash64("text"))
    return stay.dropDuplicates(["doc_id", "__sw_text"]).select(docs.columns).unionByName(docs.where("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later copies of 200-byte passages; what is left of a broken character goes, and documents left without text."""
    cut = suffix_dedup.kept(docs.withColumnRenamed("cut", "__sw_own") if "cut" in docs.columns else docs, mode="first")
    # bytes of a character that a cut parted are no UTF-8: they go
    raw = F.col("cut.kept").cast("string")
    whole = F.coalesce(F.try_validate_utf8(raw), F.replace(F.make_valid_utf8(raw), F.lit("\ufffd"), F.lit("")))
    touched = F.col("cut.n_removed") > 0
    out = cut.withColumn("__sw_text", F.when(touched, whole).otherwise(F.col("text"))).where(~touched | (F.length("__sw_text") > 0))
    names = {"text": F.col("__sw_text")} | ({"n_chars": F.when(touched, F.length("__sw_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    out = out.withColumns(names).drop("cut", "__sw_text")
    return (out.withColumnRenamed("__sw_own", "cut") if "cut" in docs.columns else out).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their ids."""
    return packing.pieces(docs, added=True)


STAGES = [
    ("quality classifier", quality),
    ("toxicity", toxic),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("packing", packed),
]

#: Classifiers and similarity can't be told in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = first = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        after = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if docs is not first:
            forget(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
