"""Exact dedup by content-defined chunk recipes (native: DataFrame functions only).

Each text is cut into chunks at places that its content defines (a line or sentence end after at least
``min_chars`` characters, at most ``max_chars``), so equal passages give equal chunks wherever they stand.
A chunk's identifier is its 64-bit hash. The distinct chunks are gathered once, in one shuffle with
map-side deduplication, to verify that no identifier stands for two different chunks. After that only
recipes travel -- the ordered identifier lists, some 8 bytes for several hundred characters -- and texts are
equal when their recipes are. Documents that hold an identifier which failed the check (normally none)
carry the SHA-256 of the whole text beside the recipe.

Defined cases: a null text counts as empty and all empty texts are one group. Within a group the largest
doc_id stays; a null doc_id is smaller than any other, and if all are null every row of the group has
keep_id null and is kept. Rows repeated with the same id and text are all marked kept by ``exact_groups``;
``drop_exact_copies`` keeps one of them. Empty tables give empty results. Columns other than doc_id and
text are ignored by ``exact_groups`` and passed through by ``drop_exact_copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windlass.llm.common import row_key, saved, whole_text


def chunks(text: Column, min_chars: int = 256, max_chars: int = 2048) -> Column:
    """The text's chunks in order; joined together they are the text."""
    pattern = rf"(?s).{{{min_chars},{max_chars}}}?(?:\n|[.!?] |\z)|.{{1,{max_chars}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def ambiguous_ids(docs: DataFrame, chunk_id=F.xxhash64) -> DataFrame:
    """Identifiers that stand for more than one chunk: distinct chunks are compared by their text."""
    distinct = (docs.select(F.explode(chunks(whole_text(F.col("text")))).alias("chunk"))
                .select(chunk_id("chunk").alias("chunk_id"), "chunk").distinct())
    return distinct.groupBy("chunk_id").count().filter("count > 1").select("chunk_id")


def recipes(docs: DataFrame, chunk_id=F.xxhash64) -> DataFrame:
    """doc_id, recipe (ordered chunk identifiers), text_sha256."""
    text = whole_text(F.col("text"))
    return docs.select("doc_id", F.transform(chunks(text), lambda c: chunk_id(c)).alias("recipe"),
                       F.sha2(text, 256).alias("text_sha256"))


def exact_groups(docs: DataFrame, chunk_id=F.xxhash64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    lists = saved(recipes(docs, chunk_id), "recipes")
    bad = saved(ambiguous_ids(docs, chunk_id), "ambiguous")
    verified = F.lit("")
    if not bad.isEmpty():
        unsure = (lists.select("text_sha256", F.explode("recipe").alias("chunk_id"))
                  .join(bad, "chunk_id", "left_semi").select("text_sha256").distinct().withColumn("unsure", F.lit(True)))
        lists = lists.join(unsure, "text_sha256", "left")
        verified = F.when(F.col("unsure"), F.col("text_sha256")).otherwise("")
    lists = lists.withColumn("verified", verified)
    groups = lists.groupBy("recipe", "verified").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # written first, so that the join has a plain exchange on both sides and a hot group can be split
    return (lists.join(saved(groups, "groups"), ["recipe", "verified"])
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns unchanged."""
    keep = (exact_groups(docs).filter("kept")
            .select(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_sha256").alias("__key"))
            .distinct())
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(*columns, row_key(F.col("doc_id"), F.col("text")).alias("__key"))
    return keyed.join(saved(keep, "keep"), "__key", "left_semi").dropDuplicates(["__key"]).drop("__key")


SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
