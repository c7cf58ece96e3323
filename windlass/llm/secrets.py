"""Secret scans by character Markov models (native: DataFrame functions only).

Two first-order character models, one of random strings and one of ordinary identifiers, are trained from samples
that the base patterns label: the values they match are random, runs of letters or of digits in texts without a match are ordinary. At most
``sample`` strings of each class (picked by hash; ordinary ones from ``sample_docs`` documents) are used: the documented
bound of the training sample. Only the table of character pair counts reaches the driver. What the base spans
leave of a run of key characters is searched for its best stretches, so that a key joined to ordinary text (paths,
NAME=VALUE) is judged by itself: a stretch is a secret if the log-likelihood ratio of the models is high enough, in total
and a character.

Positions: a text is cut by a pattern that takes what stands before a match as its first group and can also match the
end of the text, so that the groups' lengths add up to positions and the scan is linear. Only texts that hold a match
(``rlike``) are cut. All is per row: no shuffle but that of the training sample.

Defined cases: null and empty texts hold no span; repeated rows and null ids are scanned like any other; without
samples a model is uniform; empty tables give empty results; other columns are ignored. Positions count code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windlass.llm.common import saved, whole_text

# The base patterns, in the order of their kinds; group ``value`` of the first must have 8 characters.
KINDS = ["assign", "access", "hex", "markov"]
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: A run of key characters; what the models judge.
LEAST = 16
RUN = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CODES = len(ALPHABET) + 1  # code 0: any other character
BACK = 5


def pieces(text: Column, pattern: str, groups: int = 0) -> Column:
    """All (gap, match[, value]) of the text in order; the last one may have an empty match."""
    cut = F.lit(rf"(?s)(.*?)(?:({pattern})|\z)")
    parts = [F.regexp_extract_all(text, cut, F.lit(g + 1)).alias(("gap", "match", "value")[g]) for g in range(2 + groups)]
    return F.when(text.rlike(pattern), F.arrays_zip(*parts))


def spans(parts: Column, kind: int, value: bool = False) -> Column:
    """Spans (start, kind, end, string) of ``pieces``."""
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,string:string>>")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("spans"))

    def step(state, p):
        begin = state["at"] + F.length(p["gap"])
        end = begin + F.length(p["match"])
        span = F.struct(begin.cast("bigint").alias("start"), F.lit(kind).alias("kind"), end.cast("bigint").alias("end"),
                        (p["value"] if value else p["match"]).alias("string"))
        wanted = (F.length(p["value"]) >= 8) if value else (F.length(p["match"]) > 0)
        return F.struct(end.cast("bigint").alias("at"),
                        F.when(wanted, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return F.coalesce(F.aggregate(parts, start, step, lambda s: s["spans"]), empty)


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``assign``, ``access``, ``hex``: the base spans of each kind."""
    cut = docs.select("doc_id", "text", pieces(F.col("text"), ASSIGN, 1).alias("p0"),
                      pieces(F.col("text"), ACCESS).alias("p1"), pieces(F.col("text"), HEX).alias("p2"))
    return cut.select("doc_id", "text", spans(F.col("p0"), 0, True).alias("assign"),
                      spans(F.col("p1"), 1).alias("access"), spans(F.col("p2"), 2).alias("hex"))


def pair_counts(strings: DataFrame) -> dict[tuple[int, int], int]:
    """How often a character code follows another in the strings; at most CODES x CODES rows are collected."""
    code = [F.instr(F.lit(ALPHABET), F.col(c)) for c in ("x", "y")]
    pairs = strings.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("string") - 1), lambda i: F.struct(
        F.substr("string", i, F.lit(1)).alias("x"), F.substr("string", i + 1, F.lit(1)).alias("y")))).alias("p")).select("p.*")
    rows = pairs.groupBy(code[0].alias("a"), code[1].alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    return {(r["a"], r["b"]): r["n"] for r in rows}


def ratio_table(random: dict, ordinary: dict) -> list[float]:
    """log p(b | a, random) - log p(b | a, ordinary) at place a * CODES + b. Pairs are backed by the share of their second
    character (``BACK`` pseudo-counts), that by one count for each character."""
    def model(counts):
        ends = [sum(counts.get((a, b), 0) for a in range(CODES)) + 1 for b in range(CODES)]
        share = [n / sum(ends) for n in ends]
        total = [sum(counts.get((a, b), 0) for b in range(CODES)) for a in range(CODES)]
        return [[(counts.get((a, b), 0) + BACK * share[b]) / (total[a] + BACK) for b in range(CODES)] for a in range(CODES)]

    p, q = model(random), model(ordinary)
    return [math.log(p[a][b] / q[a][b]) for a in range(CODES) for b in range(CODES)]


def train(found: DataFrame, sample: int = 20_000, sample_docs: int = 2_000) -> list[float]:
    """The ratio table learned from base values and ordinary words of ``found`` (see ``base_spans``)."""
    held = F.size("assign") + F.size("access") + F.size("hex")
    values = (found.filter(held > 0).select(F.explode(F.concat("assign", "access", "hex")).alias("s"))
              .select(F.col("s.string").alias("string")).filter("string rlike '[0-9]'").distinct())
    plain = found.filter((held == 0) & (F.length("text") > 0) & F.col("doc_id").isNotNull())
    # ids are picked first, so that no task gathers texts; sample_docs ids at most are broadcast
    ids = plain.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    some = plain.select("doc_id", "text").join(F.broadcast(ids.distinct()), "doc_id", "left_semi")
    words = (some.select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z_-]{6,}|[0-9]{4,}"), F.lit(0))).alias("string")).distinct())
    # a limit on the hash order: every task sends its first ``sample`` strings at most
    picked = [saved(s.filter(F.length("string") > 1).orderBy(F.xxhash64("string"), "string").limit(sample), "strings") for s in (values, words)]
    return ratio_table(*map(pair_counts, picked))


def outside(run, base: Column) -> Column:
    """What the base spans (in order) leave of a run: spans (start, end, string) of at least LEAST characters."""
    kept = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def cut(state, b):
        gap = F.array(F.struct(state["at"].alias("start"), F.least(b["start"], run["end"]).alias("end")))
        return F.struct(F.greatest(state["at"], b["end"]).alias("at"), F.concat(state["kept"], gap).alias("kept"))

    near = F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
    parts = F.aggregate(near, F.struct(run["start"].alias("at"), kept.alias("kept")), cut,
                        lambda s: F.concat(s["kept"], F.array(F.struct(s["at"].alias("start"), run["end"].alias("end")))))
    parts = F.filter(parts, lambda p: p["end"] - p["start"] >= LEAST)
    return F.transform(parts, lambda p: F.struct(p["start"], p["end"], F.substring(
        run["string"], (p["start"] - run["start"] + 1).cast("int"), (p["end"] - p["start"]).cast("int")).alias("string")))


def pair_ratios(string: Column, table: Column) -> Column:
    """The log ratio of each pair of neighbours in the string."""
    codes = F.transform(F.split(string, "", F.length(string)), lambda c: F.instr(F.lit(ALPHABET), c))
    return F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1),
                      lambda a, b: F.element_at(table, (a * CODES + b + 1).cast("int")))


def stretches(ratios: Column, total: float, per_character: float) -> tuple[Column, Column]:
    """Stretches (start, end) of a part that are secrets, and the whole part if it is one. One pass over the ratios of its pairs: a sum of what each pair
    has above ``per_character`` starts anew once it is not positive or has fallen by ``total`` from its best, and a
    stretch ends at its best sum. Short ones are widened to LEAST characters."""
    n = F.size(ratios) + 1
    none = F.array().cast("array<struct<start:int,end:int>>")
    zero = [F.lit(0).alias(c) for c in ("at", "floor", "start", "end")] + [F.lit(0.0).alias(c) for c in ("sum", "best")]

    def closed(s):
        """``found`` and ``floor`` after the open stretch of the state."""
        high = s["best"] + per_character * (s["end"] - s["start"]) >= total
        start = F.greatest(s["floor"], F.least(s["start"], F.greatest(F.lit(0), s["end"] - LEAST)))
        end = F.least(n, F.greatest(s["end"], start + LEAST))
        return (F.when(high, F.concat(s["found"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(s["found"]),
                F.when(high, end).otherwise(s["floor"]))

    def step(s, w):
        x = s["sum"] + w - per_character
        over, better = (x <= 0) | (s["best"] - x >= total), x > s["best"]
        found, floor = closed(s)
        after = s["at"] + 1
        return F.struct(after.alias("at"), F.when(over, floor).otherwise(s["floor"]).alias("floor"),
                        F.when(over, after).otherwise(s["start"]).alias("start"),
                        F.when(over, after).when(better, after + 1).otherwise(s["end"]).alias("end"),
                        F.when(over, 0.0).otherwise(x).alias("sum"), F.when(over, 0.0).otherwise(F.greatest(x, s["best"])).alias("best"),
                        F.when(over, found).otherwise(s["found"]).alias("found"))

    def secret(t):
        ratio = F.aggregate(F.slice(ratios, t["start"] + 1, t["end"] - t["start"] - 1), F.lit(0.0), lambda a, w: a + w)
        long = t["end"] - t["start"]
        return (long >= LEAST) & (ratio >= total) & (ratio >= per_character * long)

    found = F.aggregate(ratios, F.struct(*zero, none.alias("found")), step, lambda s: closed(s)[0])
    whole = F.array(F.struct(F.lit(0).alias("start"), n.alias("end")))
    return F.filter(found, secret), F.filter(whole, secret)


def find_secrets(docs: DataFrame, total: float = 12.0, per_character: float = 0.5, sample: int = 20_000) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov."""
    found = base_spans(docs.select("doc_id", whole_text(F.col("text")).alias("text")))
    ratios = train(found, sample)
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    found = found.withColumn("runs", pieces(F.col("text"), RUN)).drop("text")
    found = found.select("*", F.array_sort(F.concat("assign", "access", "hex")).alias("base"), spans(F.col("runs"), 3).alias("runs_at"))
    found = found.withColumn("parts", F.flatten(F.transform("runs_at", lambda r: outside(r, F.col("base")))))
    found = found.withColumn("judged", F.transform("parts", lambda p: F.struct(
        p["start"], pair_ratios(p["string"], table).alias("ratios")))).drop("runs", "runs_at", "parts")

    def secrets_of(p):
        held, whole = stretches(p["ratios"], total, per_character)
        # a one-element array names the stretches, so that the pass over the part is not made twice
        return F.transform(F.flatten(F.transform(F.array(held), lambda h: F.when(F.size(h) > 0, h).otherwise(whole))), lambda t: F.struct(
            (p["start"] + t["start"]).alias("start"), F.lit(3).alias("kind"), (p["start"] + t["end"]).alias("end"), F.lit("").alias("string")))

    found = found.withColumn("markov", F.flatten(F.transform("judged", secrets_of)))

    def listed(column) -> Column:
        names = F.array(*map(F.lit, KINDS))
        return F.array_join(F.transform(F.array_sort(column), lambda s: F.concat_ws(
            ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
                        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                        listed(F.concat("base", "markov")).alias("spans"), F.size("markov").cast("long").alias("n_markov"))
