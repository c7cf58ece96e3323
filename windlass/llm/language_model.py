"""LM scoring: a gated recurrent language model with a class-factored output softmax.

Corpus counts: words are counted over all training documents in one shuffle with map-side counts. Every word's count
reaches the documents: the more frequent ones (at most ``MOST_FREQUENT``, or as many as the model
knows, above a count read from a histogram) as a broadcast table, all others by an equi-join on the word.

Model: the most frequent words (``model_words``: the distinct words to the power 2/3, so the vocabulary grows with the
corpus), the end and one unknown word are embedded; a gated recurrent unit carries its state through the whole document;
the softmax is factored into about the square root of that many classes of about equal share. Biases start at the corpus
frequencies. An unknown word gets the model's probability of the unknown, divided among the rest by smoothed
counts, so every text has a probability.

Training: truncated backpropagation in numpy, state carried from window to window, on all training documents, once. Documents lie
one after the other in lanes, so that a window is full however unlike their lengths. They are dealt to shards; a round trains every shard from the same parameters, batch after batch, and the parameters are averaged
by words in a tree. A shard has a document for every fourth word of the model at least, so what the averaging sends stays
in proportion to the text. Scoring carries the state across windows of whole
documents, many documents at a time. A window takes one exponential a logit, in blocks that stay in cache, in memory kept from the window before;
words are split and looked up a batch at a time in Arrow.

Defined cases: null and empty texts are the end alone; repeated rows are counted and scored each; null ids count as the
empty text in the split; with nothing to learn from the model is uniform; empty tables give empty results; other columns
are ignored. The word ids of an Arrow batch, the words of 2,048 of its texts and its longest text bound a task's memory.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windlass.llm.common import id_remainder, saved, whole_text

LEAST_WORDS, MOST_FREQUENT = 1000, 131_072
END, UNKNOWN = 0, 1
WIDTH = 24
LEAST_LANES, LEAST_WINDOWS = 32, 64
END_WORD = ""  # a word is never empty


def model_words(distinct: int) -> int:
    """How many words the model knows in a corpus of ``distinct`` words."""
    return max(LEAST_WORDS, math.ceil(distinct ** (2 / 3)))


def words_of(text: str) -> list[bytes]:
    """Words between space and the characters 9-13, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``words_of`` all ``texts``, one after the other, and how many each has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, ends = lists.flatten(), np.asarray(lists.offsets)
    kept = pc.not_equal(words, "")  # space at a text's ends leaves empty pieces
    before = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))])
    return words.filter(kept), np.diff(before[ends - ends[0]])


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    x = batch.column(name)
    return x.cast(pa.string()) if name == "text" else x


def training(docs: DataFrame, mod: int = 7, left_out: int = 2) -> DataFrame:
    return docs.filter(id_remainder(F.col("doc_id"), mod) != left_out)


def count_words(texts: DataFrame) -> DataFrame:
    """word, n over all rows; the end is counted under the empty word."""
    def count(batches):
        for batch in batches:
            words, counts = pc.value_counts(split_words(column(batch, "text"))[0]).flatten()
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array([END_WORD])]), pa.concat_arrays([counts, pa.array([len(batch)])])], ["word", "n"])

    return texts.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int) -> tuple[dict[bytes, int], int]:
    """The words of at least ``bound`` occurrences, at most ``most`` of them, and ``bound``."""
    step = F.floor(F.log2("n") * 16).cast("long")
    histogram = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    bound, held = None, 0
    for row in histogram:  # at most 1,024 rows
        held += row["words"]
        if held > most:
            break
        bound = row["least"]
    if bound is None:
        return {}, 2 ** 62
    table = counts.filter((F.col("n") >= bound) | (F.col("word") == END_WORD)).toArrow()
    return {w.encode(): n for w, n in zip(table.column("word").to_pylist(), table.column("n").to_pylist())}, bound


class Vocabulary:
    """Model words by falling count, and their classes: runs of about equal share of sqrt(count)."""

    def __init__(self, frequent: dict[bytes, int], total: int, distinct: int, classes: int | None = None):
        frequent = dict(frequent)
        ends = frequent.pop(END_WORD.encode(), 0)
        words = sorted(frequent, key=lambda w: (-frequent[w], w))[:model_words(distinct)]
        known = [frequent[w] for w in words]
        classes = classes or max(1, round(math.sqrt(len(words))))
        self.ids = {w: i + 2 for i, w in enumerate(words)}
        self.rest_count, self.rest_words = total - ends - sum(known), distinct - len(words) - (1 if ends else 0)
        counts = np.array([ends, self.rest_count, *known], np.float64) + 1
        self.size = len(counts)
        share = np.cumsum(np.sqrt(counts[2:])) if known else np.empty(0)
        of = np.minimum((share / share[-1] * classes).astype(int), classes - 1) if known else np.empty(0, int)
        _, of = np.unique(of, return_inverse=True) if known else (None, of)
        self.of = np.concatenate([[0, 1], of + 2]).astype(np.int64)  # end and unknown are classes of their own
        self.first = np.searchsorted(self.of, np.arange(self.of[-1] + 2))
        mass = np.add.reduceat(counts, self.first[:-1])
        self.class_bias = np.log(mass / mass.sum())
        self.word_bias = np.log(counts / mass[self.of])

    def encode(self, words: list[bytes]) -> np.ndarray:
        get = self.ids.get
        return np.array([*(get(w, UNKNOWN) for w in words), END], np.int32)

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """``encode`` of the words of each text."""
        words, counts = split_words(texts)
        known = pa.array(list(self.ids), pa.binary()).cast(pa.string())  # in the order of the ids
        return with_ends(pc.fill_null(pc.index_in(words, known), -1).to_numpy(), counts)


def with_ends(places: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Ids of each text, the end last, from the words' places in the vocabulary: -1 is unknown."""
    ends = np.cumsum(counts + 1)
    ids, word = np.full(ends[-1] if len(ends) else 0, END, np.int32), np.ones(ends[-1] if len(ends) else 0, bool)
    word[ends - 1] = False
    ids[word] = np.where(places < 0, UNKNOWN, places + 2)
    return np.split(ids, ends[:-1]) if len(ends) else []


def shapes(v: Vocabulary) -> dict[str, tuple]:
    """The last column of ``classes`` and ``words`` is their bias."""
    return {"embed": (v.size, WIDTH), "input": (WIDTH, 3 * WIDTH), "bias": (3 * WIDTH,), "state": (WIDTH, 3 * WIDTH),
            "classes": (len(v.class_bias), WIDTH + 1), "words": (v.size, WIDTH + 1)}


def start_parameters(v: Vocabulary, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    biases = {"classes": v.class_bias, "words": v.word_bias}
    made = []
    for name, shape in shapes(v).items():
        if name in biases:
            x = np.zeros(shape)
            x[:, -1] = biases[name]
        elif name == "bias":
            x = np.zeros(shape)
        else:
            x = rng.normal(0, WIDTH ** -0.5, shape)
        made.append(np.ravel(x))
    return np.concatenate(made).astype(np.float32)


def split(flat: np.ndarray, v: Vocabulary) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes(v).items():
        n = math.prod(shape)
        out[name] = flat[at:at + n].reshape(shape)
        at += n
    return out


class Room:
    """Arrays by name, made once and used again: fresh memory for every window costs as much as the sums."""

    def __init__(self):
        self.held = {}

    def __call__(self, name: str, shape: tuple, dtype) -> np.ndarray:
        n = math.prod(shape)
        if name not in self.held or self.held[name].size < n or self.held[name].dtype != dtype:
            self.held[name] = np.empty(n, dtype)
        return self.held[name][:n].reshape(shape)


def by_gate(x: np.ndarray) -> np.ndarray:
    """(3, rows, WIDTH) of (rows, 3 * WIDTH); negated for the two sigmoid gates."""
    out = np.ascontiguousarray(x.reshape(-1, 3, WIDTH).swapaxes(0, 1))
    np.negative(out[:2], out=out[:2])
    return out


def input_table(p: dict, used=slice(None)) -> np.ndarray:
    return by_gate(p["embed"][used] @ p["input"] + p["bias"])


def forward(p: dict, table: np.ndarray, at: np.ndarray, state: np.ndarray, fresh: np.ndarray, kept: dict | None = None,
            room: Room | None = None) -> np.ndarray:
    """States after each step (steps, rows, WIDTH) for input rows ``at`` (rows, steps) of ``table``. Where ``fresh`` is set a document
    starts, and the state before it is zero. ``kept`` gets what backpropagation needs."""
    rows, steps = at.shape
    weights, h, at, starts = by_gate(p["state"]), state, np.ascontiguousarray(at.T), fresh.any(0)
    room = room or Room()
    states = room("states", (steps, rows, WIDTH), state.dtype)
    x, a, gates = (room(k, (3, rows, WIDTH), state.dtype) for k in ("gate inputs", "gate sums", "gates"))
    spare, one = np.empty_like(x[0]), state.dtype.type(1)
    if kept is not None:
        kept.update({k: room(k, states.shape, state.dtype) for k in ("before", "z", "r", "dz", "dr", "dc")})
    with np.errstate(over="ignore"):  # a sigmoid of zero
        for t in range(steps):
            if starts[t]:
                h = np.where(fresh[:, t, None], h.dtype.type(0), h)
            np.take(table, at[t], axis=1, out=x, mode="clip")
            np.matmul(h, weights, out=a)
            zr, c = gates[:2], gates[2]
            z, r = zr
            np.add(x[:2], a[:2], out=zr)
            np.exp(zr, out=zr)
            np.add(zr, one, out=zr)
            np.reciprocal(zr, out=zr)
            np.multiply(r, a[2], out=c)
            np.add(c, x[2], out=c)
            np.tanh(c, out=c)
            np.subtract(h, c, out=spare)
            np.multiply(spare, z, out=spare)
            if kept is not None:  # the derivative of the state by each gate's sum
                kept["before"][t], kept["z"][t], kept["r"][t] = h, z, r
                rest, dz, dr, dc = x[0], kept["dz"][t], kept["dr"][t], kept["dc"][t]
                np.subtract(one, z, out=rest)
                np.multiply(spare, rest, out=dz)
                np.multiply(c, c, out=dc)
                np.subtract(one, dc, out=dc)
                np.multiply(dc, rest, out=dc)
                np.subtract(one, r, out=rest)
                np.multiply(rest, r, out=rest)
                np.multiply(rest, a[2], out=dr)
            h = np.add(c, spare, out=states[t])
    return states


def own_share(part: np.ndarray, w: np.ndarray, own: np.ndarray, y: np.ndarray, n: np.ndarray, grad: np.ndarray | None, dx: np.ndarray | None):
    """Natural log of the softmax of the logits w @ part.T at ``own``; ``grad`` and ``dx``, if given, get the loss's derivatives by ``w`` and ``part``. ``y`` is room."""
    np.matmul(w, part.T, out=y)
    if not (y.max() < 40 and y.min() > -40):  # else no power leaves its range
        y -= np.maximum.reduce(y, 0)
    at = own, n
    logs = y[at]
    np.exp(y, out=y)
    sums = np.add.reduce(y, 0)
    logs -= np.log(sums)
    if grad is not None:
        y *= 1 / sums
        y[at] = np.exp(logs) - 1
        grad += y @ part
        np.matmul(y.T, w, out=dx)
    return logs


def output(p: dict, v: Vocabulary, h: np.ndarray, target: np.ndarray, grads: dict | None = None, block: int = 32_768, room: Room | None = None):
    """Natural log probability of each target, and with ``grads``, which hold zeros for the targets' classes, the gradient of
    the loss by h. Logits are taken on rows sorted by class, in blocks that stay in the processor's cache."""
    order = np.argsort(v.of[target].astype(np.min_scalar_type(len(v.first))), kind="stable")
    target, n = target[order], np.arange(len(h))
    cls = v.of[target]
    room = room or Room()
    x, logits = room("x", (len(h), WIDTH + 1), h.dtype), room("logits", (max(block, len(v.class_bias), int(np.diff(v.first).max())),), h.dtype)
    x[:, :WIDTH], x[:, WIDTH] = h[order], 1
    logs, dx, d = np.zeros(len(h)), None, None
    if grads is not None:
        dx, spare = (room(k, x.shape, h.dtype) for k in ("dx", "part of dx"))
        dx[...] = 0
    # each softmax is over one run of rows of its table, for the tokens whose target is in that run
    for name, first, run, own in (("classes", np.array([0, len(v.class_bias)]), np.zeros_like(cls), cls), ("words", v.first, cls, target)):
        own = own - first[run]
        bounds = np.searchsorted(run, np.arange(len(first))).tolist()
        for k in np.flatnonzero((np.diff(first) > 1) & (np.diff(bounds) > 0)).tolist():
            i, j = int(first[k]), int(first[k + 1])
            w, grad, step = p[name][i:j], grads[name][i:j] if grads is not None else None, max(1, block // (j - i))
            for a in range(bounds[k], bounds[k + 1], step):
                b = min(a + step, bounds[k + 1])
                if grads is not None:
                    d = spare[a:b]
                logs[a:b] += own_share(x[a:b], w, own[a:b], logits[:(b - a) * (j - i)].reshape(j - i, b - a), n[:b - a], grad, d)
                if grads is not None:
                    dx[a:b] += d
    out = np.empty_like(logs)
    out[order] = logs
    if grads is None:
        return out
    dh = np.empty_like(h)
    dh[order] = dx[:, :WIDTH]
    return out, dh


def lanes(encoded: list[np.ndarray], rows: int, steps: int):
    """Windows over lanes of documents: (document of each place, inputs, targets, fresh, mask). When a document ends in a lane the next
    one starts there with a fresh state, so the lanes stay full; the longest documents are dealt first, to the
    shortest lane. Lanes stand by falling length, so those still going on are the first ones. A long document takes as many windows as
    it does alone, so there are only as many lanes as it leaves full, and then more steps a window. Windows are smaller where the
    documents would give less than ``LEAST_WINDOWS``."""
    if not encoded:
        return
    sizes = [len(x) for x in encoded]
    total, share = sum(sizes), sum(sizes) // LEAST_WINDOWS
    full = min(rows, max(LEAST_LANES, min(total // max(sizes), share // steps)))
    rows, steps = min(full, len(encoded)), max(steps, min(8 * steps, rows * steps // full, share // full))
    held: list[list[int]] = [[] for _ in range(rows)]
    heap = [(0, i) for i in range(len(held))]
    for i in sorted(range(len(encoded)), key=lambda i: (-len(encoded[i]), i)):
        n, lane = heapq.heappop(heap)
        held[lane].append(i)
        heapq.heappush(heap, (n + len(encoded[i]), lane))
    sizes = dict((lane, n) for n, lane in heap)
    order = sorted(range(len(held)), key=lambda lane: (-sizes[lane], lane))
    lengths = np.array([sizes[lane] for lane in order])
    tokens = [np.concatenate([encoded[i] for i in held[lane]]) for lane in order]
    docs = [np.repeat(held[lane], [len(encoded[i]) for i in held[lane]]) for lane in order]
    for t in range(0, int(lengths[0]), steps):
        n, width = int((lengths > t).sum()), min(steps, int(lengths[0]) - t)
        target, source, doc = np.zeros((n, width), np.int32), np.full((n, width), END, np.int32), np.full((n, width), -1)
        fresh = np.zeros((n, width), bool)
        for row in range(n):
            part = tokens[row][t:t + width]
            target[row, :len(part)], doc[row, :len(part)] = part, docs[row][t:t + width]
            first = 1 if t == 0 else 0
            source[row, first:len(part)] = tokens[row][t - 1 + first:t + len(part) - 1]
            fresh[row, first:len(part)] = docs[row][t + first:t + len(part)] != docs[row][t - 1 + first:t + len(part) - 1]
        fresh[:, 0] |= t == 0
        source[fresh] = END
        yield doc, source, target, fresh, np.arange(t, t + width)[None] < lengths[:n, None]


def log_probabilities(flat: np.ndarray, v: Vocabulary, encoded: list[np.ndarray], rows: int = 512, steps: int = 32) -> np.ndarray:
    """Natural log probability of each document; the state is carried across the windows."""
    p, out, state = split(flat, v), np.zeros(len(encoded)), np.zeros((rows, WIDTH), np.float32)
    table, room = input_table(p), Room()
    for docs, source, target, fresh, mask in lanes(encoded, rows, steps):
        states = forward(p, table, source, state[:len(docs)], fresh, room=room)
        state, on = states[-1].copy(), np.flatnonzero(mask.T)
        out += np.bincount(docs.T.ravel()[on], output(p, v, states.reshape(-1, WIDTH)[on], target.T.ravel()[on], room=room), len(encoded))
    return out


class Adam:
    """Adam over named arrays; of a large table, only the rows that a window touched are updated."""

    def __init__(self, p: dict, rate: float):
        self.p, self.rate, self.step = p, rate, 0
        self.first, self.second = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def update(self, grads: dict, touched: dict):
        self.step += 1
        rate = self.rate * math.sqrt(1 - 0.999 ** self.step) / (1 - 0.9 ** self.step)

        def move(x, first, second, g):
            first *= 0.9
            first += (part := g * 0.1)
            second *= 0.999
            np.multiply(g, g, out=part)
            part *= 0.001
            second += part
            np.sqrt(second, out=part)
            part += 1e-8
            np.divide(first, part, out=part)
            part *= rate
            x -= part

        for k, x in self.p.items():
            rows = touched.get(k, [(0, len(x))])
            if isinstance(rows, list):
                for a, end in rows:
                    for b in range(a, end, 512):
                        at = slice(b, min(b + 512, end))
                        move(x[at], self.first[k][at], self.second[k][at], grads[k][at])
            else:
                own = x[rows], self.first[k][rows], self.second[k][rows]
                move(*own, grads[k][rows])
                x[rows], self.first[k][rows], self.second[k][rows] = own


def sums_by_row(x: np.ndarray, at: np.ndarray, counts: np.ndarray, few: int = 8) -> np.ndarray:
    """Sums of the rows of ``x`` (3, rows, WIDTH) with equal ``at``, as (sums, 3 * WIDTH); there are ``counts`` of each. Those of a few rows are added side by side."""
    x = x[:, np.argsort(at.astype(np.min_scalar_type(len(counts))), kind="stable")]
    starts = np.cumsum(counts) - counts
    out = x[:, starts]
    for i in np.flatnonzero(counts > few).tolist():
        np.add.reduce(x[:, starts[i]:starts[i] + counts[i]], 1, out=out[:, i])
    for k in range(1, few):
        rows = np.flatnonzero((counts > k) & (counts <= few))
        out[:, rows] += x[:, starts[rows] + k]
    return out.swapaxes(0, 1).reshape(len(counts), -1)


def window_gradient(p: dict, v: Vocabulary, grads: dict, state: np.ndarray, source, target, fresh, mask, clip: float = 1.0,
                    room: Room | None = None):
    """Fills ``grads`` with the gradient of the window's mean loss, of length ``clip`` at most; gives the last state, the loss, and the
    touched rows of the tables, an array of them or a list of their runs (first, end)."""
    counts = np.bincount(source.ravel(), minlength=v.size)
    used = np.flatnonzero(counts)
    place = np.empty(v.size, np.intp)
    place[used] = np.arange(len(used))
    at, kept, room = place[source], {}, room or Room()
    states = forward(p, input_table(p, used), at, state, fresh, kept, room)
    on = np.flatnonzero(mask.T)
    dh, own = room("dh", states.shape, states.dtype), target.T.ravel()[on]
    of = np.flatnonzero((np.bincount(v.of[own], minlength=len(v.first) - 1) > 0) & (np.diff(v.first) > 1))
    runs = np.split(of, np.flatnonzero(np.diff(of) > 1) + 1) if len(of) else []
    words = [(int(v.first[r[0]]), int(v.first[r[-1] + 1])) for r in runs]
    for g in (grads["classes"], *(grads["words"][a:b] for a, b in words)):
        g[...] = 0
    dh[...] = 0
    logs, dh.reshape(-1, WIDTH)[on] = output(p, v, states.reshape(-1, WIDTH)[on], own, grads, room=room)
    rows, steps = source.shape
    shape, weights = (steps, rows, WIDTH), np.ascontiguousarray(p["state"].reshape(WIDTH, 3, WIDTH).transpose(1, 2, 0))
    back, inner = np.zeros_like(states[0]), np.empty_like(states[0])
    dx, da, by_sum, starts = room("gate dx", (3, *shape), states.dtype), room("gate da", (3, *shape), states.dtype), room("gate sums", (3, rows, WIDTH), states.dtype), fresh.any(0)
    for t in reversed(range(steps)):
        d, x, a = dh[t], dx[:, t], da[:, t]
        d += back
        np.multiply(d, kept["dz"][t], out=x[0])
        np.multiply(d, kept["dc"][t], out=x[2])
        np.multiply(x[2], kept["dr"][t], out=x[1])
        a[:2] = x[:2]
        np.multiply(x[2], kept["r"][t], out=a[2])
        np.matmul(a, weights, out=by_sum)
        np.multiply(d, kept["z"][t], out=back)
        np.add.reduce(by_sum, 0, out=inner)
        back += inner
        if starts[t]:
            back[fresh[:, t]] = 0
    before = kept["before"].reshape(-1, WIDTH).T
    for k in range(3):
        grads["state"][:, k * WIDTH:(k + 1) * WIDTH] = before @ da[k].reshape(-1, WIDTH)
    table = sums_by_row(dx.reshape(3, -1, WIDTH), at.T.ravel(), counts[used])
    embed = table @ p["input"].T
    np.matmul(p["embed"][used].T, table, out=grads["input"])
    table.sum(0, out=grads["bias"])
    n, touched = max(1, len(logs)), {"embed": used, "words": words}
    parts = [embed, *(grads["words"][a:b] for a, b in words), *(grads[k] for k in ("input", "bias", "state", "classes"))]
    size = math.sqrt(sum(float(np.vdot(g, g)) for g in parts)) / n
    for g in parts:
        g *= min(1.0, clip / size if size else 1.0) / n
    grads["embed"][used] = embed
    return states[-1].copy(), -float(logs.sum()) / n, touched


def train_shard(flat: np.ndarray, v: Vocabulary, encoded: list[np.ndarray], rows: int = 512, steps: int = 32, rate: float = 0.01) -> np.ndarray:
    """One pass of truncated backpropagation (Adam) over the shard's documents."""
    flat = flat.copy()
    p, grads = split(flat, v), split(np.zeros_like(flat), v)
    adam, state, room = Adam(p, rate), np.zeros((rows, WIDTH), np.float32), Room()
    for docs, source, target, fresh, mask in lanes(encoded, rows, steps):
        state, _, touched = window_gradient(p, v, grads, state[:len(docs)], source, target, fresh, mask, room=room)
        adam.update(grads, touched)
    return flat


def train(texts: DataFrame, v: Vocabulary, share: int = 1, rounds: int = 1, shard_docs: int = 8000) -> np.ndarray:
    """Parameters learned from every document of ``texts`` (every ``share``-th for tests), by averaging the shards' parameters."""
    spark = texts.sparkSession
    flat = start_parameters(v)
    if share > 1:
        texts = texts.filter(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(share)) == 0)
    n = texts.count()
    if not n:
        return flat
    shards = -(-n // max(shard_docs, v.size // 4))
    dealt = saved(texts.select("doc_id", "text").repartition(shards), "lm_shards")
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(flat)

        def one(batches):
            learned, weight = now.value, 0
            for batch in batches:
                rows = pa.table({"doc_id": pc.fill_null(column(batch, "doc_id").cast(pa.string()), ""), "text": column(batch, "text")})
                rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
                encoded = v.encode_all(rows.column("text").combine_chunks())
                learned = train_shard(learned, v, encoded)
                weight += sum(map(len, encoded))
            if weight:
                yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([learned.tobytes()], pa.binary())], ["weight", "learned"])

        def mean(a, b):
            n = a[0] + b[0]
            return n, (a[1] * (a[0] / n) + b[1] * (b[0] / n)).astype(np.float32)

        _, flat = dealt.mapInArrow(one, "weight long, learned binary").rdd.map(lambda r: (r[0], np.frombuffer(r[1], np.float32))).treeReduce(mean, 3)
    return flat


def score_documents(docs: DataFrame, mod: int = 7, left_out: int = 2, share: int = 1) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = docs.select(F.col("doc_id").cast("long"), whole_text(F.col("text")).alias("text"))
    learned = training(docs, mod, left_out)
    counts = saved(count_words(learned), "word_counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    frequent, bound = frequent_words(counts, max(MOST_FREQUENT, model_words(distinct)))
    v = Vocabulary(frequent, total, distinct)
    flat = docs.sparkSession.sparkContext.broadcast(train(learned, v, share))
    end_log = math.log10(frequent.pop(END_WORD.encode(), 0) + 1)
    listed = sorted(frequent, key=lambda w: (-frequent[w], w))  # the model's words come first
    table = docs.sparkSession.sparkContext.broadcast(
        (pa.array(listed, pa.binary()).cast(pa.string()), np.log10(np.array([*(frequent[w] for w in listed), 0], np.float64) + 1)))
    in_model = len(v.ids)

    def scan(batches):
        (known, logs), types = table.value, pa.struct([("word", pa.string()), ("times", pa.int64())])
        for batch in batches:
            encoded, parts = [], []
            for at in range(0, len(batch), 2048):
                words, counts = split_words(column(batch.slice(at, 2048), "text"))
                found = pc.fill_null(pc.index_in(words, known), -1).to_numpy()  # -1 is the last of logs, 0
                n, of = len(counts), np.repeat(np.arange(len(counts)), counts)
                model, log, seldom = (found >= 0) & (found < in_model), logs[found], np.flatnonzero(found < 0)
                encoded += with_ends(np.where(model, found, -1), counts)
                rare = words.take(pa.array(seldom)).dictionary_encode()
                size = max(1, len(rare.dictionary))
                pairs, times = np.unique(of[seldom] * size + np.asarray(rare.indices), return_counts=True)
                listing = pa.StructArray.from_arrays([rare.dictionary.take(pa.array(pairs % size)), pa.array(times.astype(np.int64))], fields=list(types))
                parts.append((counts + 1, np.bincount(of, found >= 0, n).astype(np.int64) + (total > 0), np.bincount(of, log, n) + end_log,
                              np.bincount(of, np.where(model, 0, log), n), np.bincount(of, ~model, n).astype(np.int64),
                              pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs // size, np.arange(n + 1)).astype(np.int32)), listing)))
            if parts:
                *numbers, rare = zip(*parts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.concatenate(x)) for x in numbers), pa.concat_arrays(rare),
                                                  pa.array(log_probabilities(flat.value, v, encoded, steps=128) / math.log(10))],
                                                 ["doc_id", "n_tokens", "n_frequent", "base", "rest", "n_unknown", "rare", "model"])

    schema = ("doc_id long, n_tokens long, n_frequent long, base double, rest double, n_unknown long, "
              "rare array<struct<word:string,times:long>>, model double")
    marked = saved(docs.mapInArrow(scan, schema).withColumn("row", F.monotonically_increasing_id()), "lm_rows")
    rare = (marked.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times")
            .join(counts.filter(F.col("n") < bound), "word")
            .groupBy("row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs")))
    known, logs = F.coalesce("known", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    return marked.drop("rare").join(rare, "row", "left").select(
        "doc_id", (id_remainder(F.col("doc_id"), mod) == left_out).alias("held_out"), "n_tokens",
        (F.col("n_frequent") + known).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * math.log10(total + distinct + 1)).alias("base_score"),
        (F.col("model") + F.col("rest") + logs - F.col("n_unknown") * math.log10(v.rest_count + v.rest_words + 1)).alias("score"))
