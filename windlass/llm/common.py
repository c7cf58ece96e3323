"""Helpers shared by the training-data operators: reading, shared storage, ids, sentences."""

from __future__ import annotations

import os
import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: everything but space and the control characters 9-13.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which the driver and all executors share.

    Only a local master (tests) may leave it unset; it then gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="windlass-", dir=os.environ.get("WINDLASS_SCRATCH"))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: the lineage ends there, so a
    lost executor costs a re-read, not a recomputation. The folder belongs to the caller's cluster."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def whole_text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def id_remainder(doc_id: Column, mod: int) -> Column:
    """crc32(doc_id as text) mod ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def row_key(doc_id: Column, text: Column) -> Column:
    """A non-null key of a row: its id and the digest of its text."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.sha2(whole_text(text), 256))


def labels_of(labels: DataFrame, column: str, mod: int = 5) -> DataFrame:
    """(doc_id, label) of the training rows: crc32(doc_id) mod ``mod`` is not 0, one row per id (the
    largest label wins where rows disagree), rows without id or label left out."""
    return (labels.select("doc_id", F.col(column).cast("int").alias("label"))
            .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
            .filter(id_remainder(F.col("doc_id"), mod) != 0)
            .groupBy("doc_id").agg(F.max("label").alias("label")))


def bounded_labels(labels: DataFrame, per_class: int) -> DataFrame:
    """At most ``per_class`` labelled ids of each class, picked by a hash of the id: the documented
    bound of a classifier's training sample. Both limits are top-k, so no task gathers a class."""
    picked = [labels.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
              for k in (0, 1)]
    return picked[0].unionByName(picked[1])


def batches(texts, most_chars: int = 2_000_000):
    """(first, end) index pairs that cut ``texts`` into runs of about ``most_chars`` characters."""
    first, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= most_chars:
            yield first, i + 1
            first, chars = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
