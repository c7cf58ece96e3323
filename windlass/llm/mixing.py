"""Mixing sources to target weights by weighted fair queueing (native: DataFrame functions only).

Targets: the budget (``share`` of all words) is dealt to the sources by weight; a source takes at most
``repeats`` times its own words, and what it cannot take is dealt again by weight (the water-filling level
in closed form: sources sorted by cap / weight, the capped ones come first).

Queue: each source's documents stand in a shuffled order (MD5 of the id), once per repeat. An entry's virtual
finish time is the source's cumulative words, divided by its target. All entries are served in order of
finish time and cut where the running total reaches the budget.

Scale: a source is split into hash ranges of about ``rows_per_range`` documents. Their sums are prefix-summed
(one row per range), so no task holds a source, however hot. The global order is dealt into at most 65,536
finish-time ranges; only the range in which the budget ends is ordered row by row. What decides is then the
order key of the last entry served, one scalar row, against which each document compares its entries.

Defined cases: a null text has size 0; a document of size 0 is never taken; null is a source of its own, the
last; null ids count as the text "null" in the shuffle; rows that repeat id, source and size share their fate
when they are the last served; an empty table gives an empty result. Other columns are ignored by ``mix`` and
passed through by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windlass.llm.common import WORD, row_key, saved, whole_text

MAX_RANGES = 65_536


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, the shuffle key, and the row key that joins back to ``docs``."""
    return docs.select(
        "doc_id", "source", F.regexp_count(whole_text(F.col("text")), F.lit(WORD)).cast("long").alias("size"),
        F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source"))).alias("queue"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("shuffle"),
        row_key(F.col("doc_id"), F.col("text")).alias("row_key"))


def source_targets(sized: DataFrame, weights=(5, 2, 1), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """One row per source: queue, n_docs, source_size, target. One row per source passes one task."""
    per = sized.groupBy("queue").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    nth = (F.row_number().over(Window.orderBy("queue")) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * float(repeats))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "queue").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = per.select(
        "*", F.coalesce(F.sum("cap").over(by_cap), F.lit(0.0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(by_cap), F.lit(0.0)).alias("weight_before"),
        (F.sum("source_size").over(everything) * share).alias("budget"), F.sum("weight").over(everything).alias("weights"))
    per = per.withColumn("full", F.col("cap") * (F.col("weights") - F.col("weight_before"))
                         <= F.col("weight") * (F.col("budget") - F.col("cap_before")))
    per = per.select("*", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything).alias("cap_full"),
                     F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0.0)).over(everything).alias("weight_full"))
    level = F.col("weight") * (F.col("budget") - F.col("cap_full")) / (F.col("weights") - F.col("weight_full"))
    return per.select("queue", "n_docs", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(level).alias("target"))


def queued(sized: DataFrame, targets: DataFrame, repeats: int = 2, rows_per_range: int = 4096) -> DataFrame:
    """Each document with ``entries``: its (finish, queue, shuffle, doc_id, copy) order keys."""
    ranges = F.ceil(F.col("n_docs") / rows_per_range)
    place = F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("double") / float(2 ** 32)
    placed = sized.join(targets, "queue").withColumn("range", F.floor(place * ranges))
    before = Window.partitionBy("queue").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("queue", "range").agg(F.sum("size").alias("range_size"))
               .select("queue", "range", F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("before")))
    inside = Window.partitionBy("queue", "range").orderBy("shuffle", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    served = placed.join(offsets, ["queue", "range"]).withColumn("served", F.col("before") + F.sum("size").over(inside))
    entries = [F.struct(((F.col("source_size") * copy + F.col("served")).cast("double") / F.col("target")).alias("finish"),
                        "queue", "shuffle", "doc_id", F.lit(copy).alias("copy")) for copy in range(repeats)]
    return served.withColumn("entries", F.when((F.col("size") > 0) & (F.col("target") > 0), F.array(*entries)))


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, repeats: int = 2, rows_per_range: int = 4096) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, row_key."""
    sized = saved(sizes(docs), "sizes")
    targets = saved(source_targets(sized, weights, share, repeats), "targets")
    line = saved(queued(sized, targets, repeats, rows_per_range), "queued")
    last = last_served(line, rows_per_range)
    copies = F.lit(0)
    if last is not None:
        key = F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["queue"]).alias("queue"),
                       F.lit(last["shuffle"]).alias("shuffle"),
                       F.lit(last["doc_id"]).cast(line.schema["doc_id"].dataType).alias("doc_id"),
                       F.lit(last["copy"]).alias("copy"))
        copies = F.coalesce(F.size(F.filter("entries", lambda e: e <= key)), F.lit(0))
        copies = F.when(F.col("entries").isNull(), 0).otherwise(copies)
    return line.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"),
                       copies.cast("int").alias("copies"), "row_key")


def last_served(line: DataFrame, rows_per_range: int):
    """Order key of the last entry within the budget (the sum of all targets), or None."""
    entry = line.select(F.explode("entries").alias("entry"), "size")
    total = (line.groupBy("queue").agg(F.max("target").alias("target"), F.count("entries").alias("n"))
             .agg(F.sum("target").alias("budget"), F.sum("n").alias("n")).first())
    if not total["n"]:
        return None
    n = max(1, min(MAX_RANGES // 4, -(-2 * total["n"] // rows_per_range)))
    entry = entry.withColumn("range", F.least(F.floor(F.col("entry.finish") * n), F.lit(4 * n)))
    running = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # one row per finish-time range, 65,537 at most; a float budget is compared with a slack of a thousandth word
    sums = entry.groupBy("range").agg(F.sum("size").alias("words")).select("range", "words", F.sum("words").over(running).alias("upto"))
    budget = total["budget"] + 1e-3
    full = sums.filter(F.col("upto") <= budget).agg(F.max("range").alias("range"), F.max("upto").alias("upto")).first()
    cut = sums.filter(F.col("upto") > budget).agg(F.min("range")).first()[0]
    best = None
    if cut is not None:
        inside = Window.orderBy("entry").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        best = (entry.filter(F.col("range") == cut).withColumn("upto", F.sum("size").over(inside) + F.lit(full["upto"] or 0))
                .filter(F.col("upto") <= budget).agg(F.max("entry")).first()[0])
    if best is None and full["range"] is not None:
        best = entry.filter(F.col("range") == full["range"]).agg(F.max("entry")).first()[0]
    return best


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """``docs`` as the mix takes them: a row for each copy taken, all columns unchanged."""
    taken = mix(docs, **how).filter("copies > 0").groupBy(F.col("row_key").alias("__row")).agg(F.max("copies").alias("__copies"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(*columns, row_key(F.col("doc_id"), F.col("text")).alias("__key"))
    joined = keyed.join(saved(taken, "taken"), F.col("__key") == F.col("__row"))
    return joined.select(*columns, F.explode(F.array_repeat(F.lit(1), F.col("__copies"))).alias("__copy")).drop("__copy")


SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS queue,
         md5(coalesce(doc_id::VARCHAR, 'null')) AS shuffle FROM documents),
per AS (
  SELECT queue, sum(size)::BIGINT AS source_size, (sum(size) * 2)::DOUBLE AS cap,
         [5e0, 2e0, 1e0][((row_number() OVER (ORDER BY queue) - 1) % 3 + 1)::INT] AS weight FROM sized GROUP BY queue),
ordered AS (
  SELECT *, coalesce(sum(cap) OVER byc, 0e0) AS cap_before, coalesce(sum(weight) OVER byc, 0e0) AS weight_before,
         (sum(source_size) OVER ())::DOUBLE * 1.5e0 AS budget, sum(weight) OVER () AS weights
  FROM per WINDOW byc AS (ORDER BY cap / weight, queue ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
flagged AS (SELECT *, cap * (weights - weight_before) <= weight * (budget - cap_before) AS full_ FROM ordered),
targets AS (
  SELECT queue, source_size, CASE WHEN full_ THEN cap ELSE
         weight * (budget - sum(CASE WHEN full_ THEN cap ELSE 0e0 END) OVER ())
         / (weights - sum(CASE WHEN full_ THEN weight ELSE 0e0 END) OVER ()) END AS target FROM flagged),
line AS (
  SELECT s.*, t.source_size, t.target,
         (sum(s.size) OVER (PARTITION BY s.queue ORDER BY s.shuffle, s.doc_id, s.size ROWS UNBOUNDED PRECEDING))::BIGINT AS served
  FROM sized s JOIN targets t USING (queue)),
entries AS (
  SELECT line.*, copy, (source_size * copy + served)::DOUBLE / target AS finish
  FROM line, (VALUES (0), (1)) AS c(copy) WHERE size > 0 AND target > 0),
mixed AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY finish, queue, shuffle, doc_id, copy ROWS UNBOUNDED PRECEDING)
         <= (SELECT sum(target) FROM targets) + 1e-3 AS taken FROM entries),
per_doc AS (SELECT doc_id, sum(CASE WHEN taken THEN size ELSE 0 END)::BIGINT AS taken FROM mixed GROUP BY doc_id)
SELECT l.doc_id, l.size, l.source_size, l.target, coalesce(p.taken, 0)::BIGINT AS taken
FROM line l LEFT JOIN per_doc p ON l.doc_id IS NOT DISTINCT FROM p.doc_id
"""
