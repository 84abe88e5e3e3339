"""From raw documents to training sequences: five stages, each one of the corpus operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.  Null text counts as empty
throughout and an empty table passes through every stage.  Where rows share a
doc_id but not the text, each is judged by its own text; repeated rows count
as exact copies of each other, rows without doc_id too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import materialize, table, without
from folioflow.llm.decontaminate import without_contaminated
from folioflow.llm.exact import exact_duplicates, normalized
from folioflow.llm.minhash import NearDuplicates
from folioflow.llm.packing import pack
from folioflow.llm.toxicity import train, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows predicted toxic go."""
    return without_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row with the smallest doc_id stays; of repeated rows of that id (or of null ids) the smallest row."""
    verdicts = materialize(exact_duplicates(docs), "verdicts")
    digest, columns = F.sha2(normalized(F.col("text")), 256), docs.columns
    rest = without(docs, verdicts.where("NOT kept"), digest, "text_sha256")
    twins = verdicts.where("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n")).where("n > 1")
    twins = materialize(twins.select("doc_id", "text_sha256"), "twins")
    if twins.isEmpty():
        return rest
    twin = twins.select(F.col("doc_id").alias("_twin_id"), F.col("text_sha256").alias("_twin_digest"))
    again = rest.withColumn("_digest", digest).join(twin, F.col("doc_id").eqNullSafe(F.col("_twin_id")) & (F.col("_digest") == F.col("_twin_digest")))
    one = again.groupBy("_twin_id", "_twin_digest").agg(F.min(F.struct(*columns)).alias("row")).select("row.*")
    return without(rest, twins, digest, "text_sha256").unionByName(one)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, Jaccard 0.8) the smallest doc_id stays; null ids are in no group."""
    gone = NearDuplicates(width=5, percent=80).classes(docs).where("NOT kept")
    return without(docs, gone, F.xxhash64("text"), "text_hash")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of the documents that stayed."""
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: The first stage is a trained classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
