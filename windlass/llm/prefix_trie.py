"""Conversation prefix trie by composable monoid fingerprints.

A turn is an element e of the numbers below a prime; a sequence of turns is its hash product, the pair (length,
sum of e_i B^i). Products compose: that of s followed by t is (|s| + |t|, H(s) + B^|s| H(t)), and the product of
turns h..j of a conversation is its prefix product at j less the one at h, divided by B^h. So the fingerprint of
every prefix of a rebuilt conversation (head of another one, then its own suffix) comes from the prefix products
of the original conversations; no rebuilt text exists anywhere. Fingerprints are two such sums (primes below
2^31) and the depth.

Equality is verified, not assumed. Elements come from a 64-bit hash of (role, text), which is checked to be
one-to-one on the table. A group of equal fingerprints must refer to one stored turn content as last turn and to
one parent fingerprint; by induction over the depth its members then are equal. If either check fails, all is done
again with another hash seed and other multipliers.

Subtree sums take one aggregation. A conversation is the smallest member of its nodes from some depth r on and of
none above, so it adds its deeper turns once to every node that it belongs to; what is below r is another's.

Scale: turns are range-sorted by (conversation, turn); prefix products are taken inside a range and composed with
those of the ranges before (one row per partition reaches the driver), so a conversation may span many tasks.
Joins on a conversation are split into pieces of ``PIECE`` turns. Groups have map-side partial sums. The digest
of a node's ids is a chain by definition: ids are sorted and joined in pieces in parallel, and one task streams
the pieces of a node in constant memory.

Defined cases: turns of equal number stand in the order of role, then text, and repeated rows are turns of their
own; null turns come first; null role or text is empty; rows without conv_id belong to no conversation and are
left out; an empty table gives an empty result, without a root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windlass.llm.common import saved, whole_text

PRIMES = (2147483647, 2147483629)
HEAD, PIECE, ATTEMPTS = 9, 4096, 8
NEVER = 2 ** 62


def element_hash(role: Column, text: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), role, text)


def multipliers(seed: int) -> tuple[int, int]:
    """A multiplier for each prime, from the seed."""
    digest = hashlib.sha256(b"multiplier %d" % seed).digest()
    return tuple(int.from_bytes(digest[i * 8:i * 8 + 8], "little") % (p - 1000) + 500 for i, p in enumerate(PRIMES))


def powers(base: int, exponents: np.ndarray, p: int) -> np.ndarray:
    """base ** exponents mod p, by squaring."""
    out, square, rest = np.ones(len(exponents), np.int64), base % p, exponents.astype(np.int64)
    while rest.any():
        out = np.where(rest & 1, out * square % p, out)
        square, rest = square * square % p, rest >> 1
    return out


def prefix_products(bases: tuple[int, int]):
    """Maps a sorted partition's rows (conv_id, turn_id, bytes) to the running products of each conversation inside
    the partition: local (turns before), f (with the turn), g (without), cum (bytes with the turn)."""
    def scan(frames):
        held, n, sums, total = None, 0, [0, 0], 0
        for frame in frames:
            if not len(frame):
                continue
            conv, size = frame["conv_id"].to_numpy(np.int64), frame["bytes"].to_numpy(np.int64)
            first = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            run = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(conv)]))
            goes_on = held is not None and conv[0] == held
            local = np.arange(len(conv)) - first[run] + np.where(run == 0, n if goes_on else 0, 0)

            def running(x, before):
                s = np.cumsum(x)
                return s - (s[first] - x[first])[run] + np.where(run == 0, before if goes_on else 0, 0)

            out = {"conv_id": conv, "local": local, "turn_id": frame["turn_id"], "bytes": size, "cum": running(size, total)}
            for i, p in enumerate(PRIMES):
                term = frame["turn_id"].to_numpy(np.int64) % p * powers(bases[i], local, p) % p
                out[f"f{i}"] = running(term, sums[i]) % p
                out[f"g{i}"] = (out[f"f{i}"] - term) % p
            held, n, sums, total = conv[-1], int(local[-1]) + 1, [int(out["f0"][-1]), int(out["f1"][-1])], int(out["cum"][-1])
            yield pd.DataFrame(out)[["conv_id", "local", "turn_id", "bytes", "cum", "f0", "f1", "g0", "g1"]]
    return scan


def carried(parts, bases: tuple[int, int]) -> list[tuple]:
    """What each partition's first conversation brings from the partitions before: (part, conv_id, turns, bytes, and
    for each prime the product and the power to multiply by). ``parts``: a row per partition, in order."""
    out, held, n, total, sums = [], None, 0, 0, [0, 0]
    for row in parts:
        first, tail = row["first"], row["tail"]
        if held == first:
            shift = [pow(b, n, p) for b, p in zip(bases, PRIMES)]
            out.append((row["part"], first, n, total, sums[0], sums[1], shift[0], shift[1]))
        if held != tail["conv_id"] or first != tail["conv_id"]:
            held, n, total, sums = tail["conv_id"], 0, 0, [0, 0]
        shift = [pow(b, n, p) for b, p in zip(bases, PRIMES)]
        sums = [(s + k * tail[f"f{i}"]) % p for i, (s, k, p) in enumerate(zip(sums, shift, PRIMES))]
        n, total = n + tail["local"] + 1, total + tail["cum"]
    return out


def original_products(turns: DataFrame, bases: tuple[int, int]) -> DataFrame:
    """conv_id, pos, turn_id, bytes, cum, f0, f1, g0, g1 of every stored turn."""
    spark = turns.sparkSession
    kinds = "conv_id long, local long, turn_id long, bytes long, cum long, f0 long, f1 long, g0 long, g1 long"
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row")]
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    local = saved(turns.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "turn_id", "bytes")
                  .mapInPandas(prefix_products(bases), kinds).withColumn("part", F.spark_partition_id()), "local_products")
    parts = (local.groupBy("part").agg(F.min("conv_id").alias("first"),
                                       F.max(F.struct("conv_id", "local", "f0", "f1", "cum")).alias("tail"))
             .orderBy("part").collect())  # one row per partition
    carry = spark.createDataFrame(carried(parts, bases), "part int, conv_id long, turns long, before long, "
                                  "c0 long, c1 long, k0 long, k1 long")
    whole = local.join(F.broadcast(carry), ["part", "conv_id"], "left")

    def composed(i: int, x: str) -> Column:
        return (F.coalesce(F.col(f"c{i}"), F.lit(0)) + F.coalesce(F.col(f"k{i}"), F.lit(1)) * F.col(f"{x}{i}")) % PRIMES[i]

    return whole.select("conv_id", (F.col("local") + F.coalesce("turns", F.lit(0))).alias("pos"), "turn_id", "bytes",
                        (F.col("cum") + F.coalesce("before", F.lit(0))).alias("cum"),
                        *[composed(i, x).alias(f"{x}{i}") for x in "fg" for i in (0, 1)])


def join_pieces(rows: DataFrame, at: Column, per: DataFrame, length: Column, how: str = "inner") -> DataFrame:
    """Join on conv_id in pieces of ``PIECE`` places, so that no conversation's rows meet in one task."""
    left = rows.withColumn("piece", F.floor(at / PIECE))
    right = per.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(length / PIECE))))
    return left.join(right, ["conv_id", "piece"], how).drop("piece")


def rebuilt(products: DataFrame) -> DataFrame:
    """One row per conversation: how its head and its own suffix compose."""
    top = F.when(F.col("pos") < HEAD, F.struct("pos", "turn_id", "bytes", "cum", "f0", "f1", "g0", "g1"))
    conv = saved(products.groupBy("conv_id").agg((F.max("pos") + 1).alias("n"), F.max("cum").alias("own_bytes"),
                                                 F.sort_array(F.collect_list(top)).alias("head")), "conversations")  # 9 turns at most
    own = conv.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).withColumn(
        "base_id", F.col("conv_id") - F.col("conv_id") % 5)
    base = conv.select(F.col("conv_id").alias("base_id"), F.col("head").alias("base_head"))
    both = own.join(base, "base_id", "left").withColumn("k", F.least("h", F.coalesce(F.size("base_head"), F.lit(0))).cast("int"))
    both = both.withColumn("skip", F.least("h", "n").cast("int"))

    def at(array: str, place: str, field: str) -> Column:
        return F.when(F.col(place) > 0, F.try_element_at(array, F.greatest(F.col(place), F.lit(1)))[field]).otherwise(F.lit(0))

    both = both.select("conv_id", "n", "h", "k", "base_head", (F.col("k") + F.col("n") - F.col("skip")).alias("length"),
                       *[at("base_head", "k", x).alias(f"base_{x}") for x in ("cum", "f0", "f1")],
                       *[at("head", "skip", x).alias(f"own_{x}") for x in ("cum", "f0", "f1")], "own_bytes")
    return both.withColumn("total", F.col("base_cum") + F.col("own_bytes") - F.col("own_cum"))


def entries(products: DataFrame, bases: tuple[int, int]) -> DataFrame:
    """One row per rebuilt conversation and depth: the prefix's fingerprint and its parent's, the id of its last turn's
    content, and the bytes of the turns from it to the conversation's end."""
    conv = saved(rebuilt(products), "rebuilt")
    whole = ["conv_id", "length"]
    root = conv.select(*whole, F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(x) for x in ("f0", "f1", "g0", "g1", "turn_id")],
                       F.col("total").alias("rest"))
    head = conv.select(*whole, "total", F.explode(F.slice("base_head", 1, F.col("k"))).alias("t"))
    head = head.select(*whole, (F.col("t.pos") + 1).alias("depth"), "t.f0", "t.f1", "t.g0", "t.g1", "t.turn_id",
                       (F.col("total") - F.col("t.cum") + F.col("t.bytes")).alias("rest"))
    own = join_pieces(products, F.col("pos"), conv.drop("base_head"), F.col("n")).filter("pos >= h")

    def shifted(x: str, i: int) -> Column:
        p = PRIMES[i]
        inverse = pow(bases[i], -1, p)
        back = F.element_at(F.array(*[F.lit(pow(inverse, j, p)).cast("long") for j in range(HEAD)]), (F.col("h") - F.col("k") + 1).cast("int"))
        return (F.col(f"base_f{i}") + (F.col(f"{x}{i}") - F.col(f"own_f{i}") + p) % p * back) % p

    tail = own.select(*whole, (F.col("k") + F.col("pos") - F.col("h") + 1).alias("depth"),
                      *[shifted(x, i).alias(f"{x}{i}") for x in "fg" for i in (0, 1)], "turn_id",
                      (F.col("total") - F.col("base_cum") - F.col("cum") + F.col("bytes") + F.col("own_cum")).alias("rest"))
    return root.unionByName(head).unionByName(tail)


def id_digests(ends: DataFrame) -> DataFrame:
    """depth, f0, f1, ends_sha256 from rows (depth, f0, f1, conv_id): the digest of the ids in order, comma-joined."""
    def joined(frames):
        for frame in frames:
            keys = frame[["depth", "f0", "f1"]].to_numpy(np.int64)
            first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(keys) else np.empty(0, np.int64)
            ids = frame["conv_id"].tolist()
            cut = [*first.tolist(), len(ids)]
            out = pd.DataFrame(keys[first], columns=["depth", "f0", "f1"])
            yield out.assign(first=[ids[a] for a in cut[:-1]], ids=[",".join(map(str, ids[a:b])) for a, b in zip(cut, cut[1:])])

    def digests(frames):
        rows = (row for frame in frames for row in frame.itertuples(index=False))
        done = []
        for key, pieces in groupby(rows, key=lambda r: (r.depth, r.f0, r.f1)):
            digest = hashlib.sha256()
            for i, piece in enumerate(pieces):
                digest.update((b"," if i else b"") + piece.ids.encode())
            done.append((*key, digest.hexdigest()))
            if len(done) == 4096:
                yield pd.DataFrame(done, columns=["depth", "f0", "f1", "ends_sha256"])
                done = []
        yield pd.DataFrame(done, columns=["depth", "f0", "f1", "ends_sha256"])

    key = ["depth", "f0", "f1"]
    pieces = (ends.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")
              .mapInPandas(joined, "depth long, f0 long, f1 long, first long, ids string"))
    return (pieces.repartition(*key).sortWithinPartitions(*key, "first")
            .mapInPandas(digests, "depth long, f0 long, f1 long, ends_sha256 string"))


def verified_entries(conversations: DataFrame, hash_turn=element_hash, bases_of=multipliers) -> tuple[DataFrame, DataFrame] | None:
    """(entries, groups by fingerprint) whose equality is verified, or None for a table without conversations."""
    stored = saved(conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), "turn", whole_text(F.col("role")).alias("role"), whole_text(F.col("text")).alias("text"),
        F.monotonically_increasing_id().alias("row")), "turns")
    if stored.isEmpty():
        return None
    for seed in range(ATTEMPTS):
        turns = stored.withColumn("turn_id", hash_turn(F.col("role"), F.col("text"), seed)).withColumn("bytes", F.octet_length("text").cast("long"))
        contents = turns.select("turn_id", "role", "text").distinct().groupBy("turn_id").agg(F.count(F.lit(1)).alias("n"))
        if not contents.filter("n > 1").isEmpty():
            continue
        bases = bases_of(seed)
        products = saved(original_products(turns, bases), "products")
        entry = saved(entries(products, bases), "entries")
        refers = [F.struct("turn_id", "g0", "g1")]
        groups = saved(entry.groupBy("depth", "f0", "f1").agg(
            F.min(F.struct("conv_id", "rest", "length")).alias("rep"), F.max("length").alias("longest"),
            F.min(*refers).alias("least"), F.max(*refers).alias("most")), "groups")
        if groups.filter("least <> most").isEmpty():
            return entry, groups
    raise RuntimeError(f"fingerprints collided with each of {ATTEMPTS} seeds")


def prefix_trie(conversations: DataFrame, hash_turn=element_hash, bases_of=multipliers) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256."""
    found = verified_entries(conversations, hash_turn, bases_of)
    if found is None:
        return conversations.sparkSession.createDataFrame(
            [], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    entry, groups = found
    # a conversation is the smallest member of its nodes from depth ``since`` on
    owns = saved(groups.groupBy(F.col("rep.conv_id").alias("conv_id")).agg(
        F.min(F.struct("depth", "rep.rest")).alias("top"), F.max(F.col("longest") == F.col("depth")).alias("leaf"),
        F.max("rep.length").alias("span")).select("conv_id", "span", "leaf", F.col("top.depth").alias("since"), F.col("top.rest").alias("since_rest")), "owned")
    entry = join_pieces(entry, F.col("depth"), owns, F.col("span"), "left")
    since = F.coalesce(F.col("since"), F.lit(NEVER))
    key = ["depth", "f0", "f1"]
    nodes = saved(entry.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min(F.struct("conv_id", since.alias("since"), "g0", "g1")).alias("rep"),
        F.sum(((F.col("depth") + 1 >= since) & (F.col("depth") < F.col("length"))).cast("long")).alias("n_children"),
        F.sum(F.coalesce("leaf", F.lit(False)).cast("long")).alias("n_leaves"),
        F.sum(F.when(F.col("depth") < since, F.col("rest") - F.coalesce("since_rest", F.lit(0))).otherwise(0)).alias("saved_tokens")), "nodes")
    nodes = nodes.select(*key, F.col("rep.conv_id").alias("conv_id"), F.col("rep.since").alias("since"), F.col("rep.g0").alias("g0"),
                         F.col("rep.g1").alias("g1"), "n_convs", "n_children", "n_leaves", "saved_tokens")
    # above ``since`` + 1 the parent's smallest member is another conversation: the root's for depth 1, else looked up
    top = nodes.filter("depth = 0").first()["conv_id"]
    known = nodes.filter("depth <= 1 OR since < depth").withColumn(
        "parent_conv_id", F.when(F.col("depth") == 1, F.lit(top)).when(F.col("depth") > 1, F.col("conv_id")).cast("long"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f0").alias("g0"), F.col("f1").alias("g1"), F.col("conv_id").alias("parent_conv_id"))
    asked = nodes.filter("depth > 1 AND since >= depth").join(parents, ["depth", "g0", "g1"])
    ends = id_digests(entry.filter("depth = length").select(*key, "conv_id"))
    out = known.unionByName(asked).join(ends, key, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


_CRC = "list_reduce([4294967295::BIGINT] || [ord(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')], lambda c, x: {})"


def _crc_sql() -> str:
    """CRC-32 of conv_id's decimal text, bit by bit."""
    step = "xor(c, x)"
    for _ in range(8):
        step = f"[CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END FOR v IN [{step}]][1]"
    return f"xor({_CRC.format(step)}, 4294967295::BIGINT)"


SQL = f"""
WITH turns AS (
  SELECT conv_id, sha256(to_json([coalesce(role, ''), coalesce(text, '')])::VARCHAR) AS content, strlen(coalesce(text, ''))::BIGINT AS bytes,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS nth
  FROM conversations WHERE conv_id IS NOT NULL),
conv AS (SELECT conv_id, {_crc_sql()} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT c.conv_id, 0 AS half, t.nth, t.content, t.bytes FROM conv c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.nth <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.nth, t.content, t.bytes FROM conv c JOIN turns t ON t.conv_id = c.conv_id AND t.nth > c.h),
placed AS (SELECT conv_id, content, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY half, nth) AS depth FROM rebuilt),
entry AS (
  SELECT conv_id, depth, bytes, sha256(string_agg(content, ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM placed
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM conv),
linked AS (
  SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, max(depth) OVER (PARTITION BY conv_id) AS length FROM entry),
node AS (
  SELECT depth, node, min(conv_id) AS conv_id, min(parent) AS parent, count(*) AS n_convs, max(length) = depth AS leaf,
         (count(*) - 1) * min(bytes) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = length), '')) AS ends_sha256
  FROM linked GROUP BY depth, node),
below AS (
  SELECT a.depth, a.node, sum(n.leaf::INT)::BIGINT AS n_leaves, sum(n.saved)::BIGINT AS saved_tokens,
         sum((n.depth = a.depth + 1)::INT)::BIGINT AS n_children
  FROM node n JOIN entry a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.depth, a.node)
SELECT n.conv_id::BIGINT AS conv_id, n.depth::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
       b.n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
FROM node n JOIN below b USING (depth, node) LEFT JOIN node p ON p.depth = n.depth - 1 AND p.node = n.parent
"""
