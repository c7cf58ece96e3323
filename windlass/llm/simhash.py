"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints: bit i is set if it is set in more than half of the XXH64 hashes of the text's word shingles.

Index: distinct fingerprints are sorted by Gray rank, so neighbours share long bit patterns, and cut into blocks
of consecutive ones. A block's upper node is its masked pattern: the bits on which all members agree. Inside a
block, leaf nodes of ``LEAF`` members carry their own masked patterns.

Search: the differences of two masked patterns on the bits that both fix are a lower bound for every pair below
them. Block pairs over the bit limit are pruned as a whole, then leaf pairs, and what is left is compared. Links
of a block pair are reduced to a spanning forest, which keeps the components and bounds the output by the members.

Scale: there are at most about ``MAX_BLOCKS`` blocks (the block size grows beyond), so the table of upper nodes
that the tasks get is bounded (24 bytes each). The blocks' members stay in Spark: an equi-join on block ids
brings the two blocks of a surviving pair together, and each row of that join is compared alone, so no group is
gathered anywhere and a dense region is spread over many rows.

Defined cases: null texts count as empty; a text without words has fingerprint zero, linked like any other; a text
with fewer words than a shingle is one shingle. Rows of equal fingerprint are linked. A component's id is its
smallest doc_id (null ids are passed over; a component of null ids only has component_id null). An empty table
gives an empty result. Other columns are ignored by ``near_groups``, passed through by ``drop_near_copies``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windlass.llm.common import saved, whole_text
from windlass.llm.components import components, forest

LEAF = 16
MAX_BLOCKS = 32_768


def fingerprint(text: str, words: int = 3) -> int:
    """64-bit SimHash of the ``words``-word shingles of ``text`` (A-Z lower-cased), as unsigned."""
    import xxhash

    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # on space and 9-13; lowers A-Z only
    if not tokens:
        return 0
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return digest(joined, 42)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps[:len(gaps) - words + 1] + 1).tolist()]
    ends = [*gaps[words - 1:].tolist(), len(joined)]
    ones, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 65_536):  # bounded memory on very long texts
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at:at + 65_536], ends[at:at + 65_536])], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""
    def scan(frames):
        for frame in frames:
            bits = np.array([fingerprint(t, words) for t in frame["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "fp": bits})

    return (docs.select(F.col("doc_id").cast("long"), whole_text(F.col("text")).alias("text"))
            .mapInPandas(scan, "doc_id long, fp long"))


def gray_rank(fp):
    """Position of the pattern in Gray-code order, as a signed long that sorts like the unsigned rank."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-2 ** 63))


def gray_blocks(distinct: DataFrame, block: int) -> DataFrame:
    """Blocks of Gray-order neighbours: block, ones (bits set in all), any (bits set in some), members."""
    def cut(frames):
        from pyspark import TaskContext

        nth, held = TaskContext.get().partitionId() << 32, np.empty(0, np.int64)

        def rows(parts):
            nonlocal nth
            out = []
            for x in parts:
                out.append((nth, int(np.bitwise_and.reduce(x)), int(np.bitwise_or.reduce(x)), x.tobytes()))
                nth += 1
            return pd.DataFrame(out, columns=["block", "ones", "any", "members"])

        for frame in frames:
            held = np.concatenate([held, frame["fp"].to_numpy(np.int64)])
            whole = len(held) // block * block
            yield rows(held[:whole].reshape(-1, block))
            held = held[whole:]
        if len(held):
            yield rows([held])

    n = distinct.count()
    parts = max(1, -(-n // (64 * block)))
    return (distinct.repartitionByRange(parts, gray_rank(F.col("fp"))).sortWithinPartitions(gray_rank(F.col("fp")))
            .mapInPandas(cut, "block long, ones long, any long, members binary"))


def least_difference(ones_a, any_a, ones_b, any_b):
    """Bits that differ for sure between two nodes: fixed in both, with unlike values."""
    return np.bitwise_count(((ones_a & ~any_b) | (ones_b & ~any_a)).view(np.uint64))


def compare_blocks(a: np.ndarray, b: np.ndarray, most_bits: int) -> list[tuple[int, int]]:
    """Forest of the links between the members of two blocks (or within one, given twice)."""
    def leaves(x):
        cut = range(0, len(x), LEAF)
        return np.bitwise_and.reduceat(x, cut), np.bitwise_or.reduceat(x, cut)

    (oa, na), (ob, nb) = leaves(a), leaves(b)
    near = least_difference(oa[:, None], na[:, None], ob[None], nb[None]) <= most_bits
    pairs: list[tuple[int, int]] = []
    for i in np.flatnonzero(near.any(1)):
        left = a[i * LEAF:(i + 1) * LEAF]
        right = b[np.repeat(near[i], LEAF)[:len(b)]]
        x, y = np.nonzero(np.bitwise_count((left[:, None] ^ right[None]).view(np.uint64)) <= most_bits)
        pairs += zip(left[x].tolist(), right[y].tolist())
    return forest(pairs)


def near_links(distinct: DataFrame, most_bits: int = 2, block: int = 256) -> DataFrame:
    """Links (a, b) that connect all fingerprints within ``most_bits`` bits, as forests of block pairs."""
    spark = distinct.sparkSession
    block = max(block, -(-distinct.count() // MAX_BLOCKS))
    blocks = saved(gray_blocks(distinct, block), "gray_blocks")
    nodes = blocks.select("block", "ones", "any").collect()  # the upper nodes: at most about MAX_BLOCKS rows
    ids, ones, some = (np.array([r[k] for r in nodes], np.int64) for k in range(3))
    upper = spark.sparkContext.broadcast((ids, ones, some))

    def partners(frames):
        ids, ones, some = upper.value
        for frame in frames:
            out = []
            for block, o, s in zip(frame["block"], frame["ones"], frame["any"]):
                near = least_difference(np.int64(o), np.int64(s), ones, some) <= most_bits
                out.append(pd.DataFrame({"block": block, "other": ids[near & (ids >= block)]}))
            yield pd.concat(out) if out else pd.DataFrame({"block": [], "other": []}, dtype="int64")

    def compare(frames):
        for frame in frames:
            out = []
            for a, b in zip(frame["members"], frame["others"]):
                out += compare_blocks(np.frombuffer(a, np.int64), np.frombuffer(b, np.int64), most_bits)
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    pairs = blocks.select("block", "ones", "any").mapInPandas(partners, "block long, other long")
    others = blocks.select(F.col("block").alias("other"), F.col("members").alias("others"))
    return (pairs.join(blocks.select("block", "members"), "block").join(others, "other")
            .select("members", "others").mapInPandas(compare, "a long, b long"))


def near_groups(docs: DataFrame, words: int = 3, most_bits: int = 2) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id."""
    marked = saved(fingerprints(docs, words), "fingerprints")
    distinct = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct_fps")
    of = components(near_links(distinct.select("fp"), most_bits)).withColumnRenamed("node", "fp")
    joined = distinct.join(of, "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    least = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = saved(joined.join(saved(least, "least_ids"), "component").select("fp", "component_id"), "components")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, words: int = 3, most_bits: int = 2) -> DataFrame:
    """``docs`` with one document of each group, the one of the smallest doc_id; columns unchanged. Rows that
    share that doc_id are one document to this operator and stay; rows without id stay if their group has no id."""
    keep = (near_groups(docs, words, most_bits).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
            .select(F.col("doc_id").alias("__kept_id")).distinct())
    return docs.join(saved(keep, "keep"), docs["doc_id"].cast("long").eqNullSafe(F.col("__kept_id")), "left_semi")
