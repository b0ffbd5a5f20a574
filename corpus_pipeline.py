"""A corpus pipeline over documents: quality, language, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns of
docs. A row is judged for itself, whether its doc_id is null or shared: near_duplicates gives each row a key of its own and drops
by it. Only drop_repeats leaves rows with a null doc_id as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relslice.llm import langid, packing, quality, simhash_texts, substring_dedup
from relslice.llm.common import read, stored
from relslice.llm.queries import vocabulary

#: SQL cannot train the classifiers of the first two stages; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


#: The key that near_duplicates gives each row; it is stored with the rows, so a task that runs again sees the same keys.
ROW = "__row"


def _keyed(docs: DataFrame) -> DataFrame:
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified, unless the network finds all languages about as likely."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five words a shingle, a similarity of 0.8): the one with the smallest doc_id;
    null is smallest, and a hash of the text decides between equal ids."""
    rows = _keyed(docs)
    found = simhash_texts.near_duplicate_texts(rows, key=ROW)
    order = F.struct("doc_id", F.xxhash64("text").alias("hash"), ROW)
    first = rows.select(ROW, order.alias("order")).join(found.withColumnRenamed("row", ROW), ROW).groupBy("group").agg(F.min("order").alias("first"))
    return rows.join(first.select(F.col(f"first.{ROW}").alias(ROW)), ROW, "left_semi").select(docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller doc_id has; untouched texts stay as they are."""
    into = next(name for k in range(len(docs.columns) + 1) if (name := f"__repeats{k}") not in docs.columns)
    found = substring_dedup.remove_repeats(docs, into=into)
    changed, kept = F.col(into)["n_removed"] > 0, F.col(into)["kept_text"]
    new = {"text": F.when(changed, kept).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(kept).cast("long")).otherwise(F.col("n_chars"))
    return found.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 4096."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality", keep_quality), ("language", keep_language), ("near_duplicates", drop_near_duplicates), ("repeats", drop_repeats), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other; each result but the last is stored before the next stage reads it."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
