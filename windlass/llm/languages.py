"""Language identification of mixed-language texts: script ranges, per-word scores, Viterbi.

Words are runs of letters. A word's script (of most of its letters, by code range) narrows the languages to those that
have a hundredth or more of their training letters, counted by words, in that script; a script that no language has narrows nothing.
A word's score in a language is the mean log share of its character n-grams (1 to 4 long, with word ends) among
the language's n-grams, times the square root of their number, at most ``CAP`` below the best language, 0 to be neutral. The most likely labelling of
the word sequence by languages, at a cost of ``SWITCH`` for each change of language, is found by Viterbi's
recursion; runs of one label are the spans. A text's language is the one whose spans hold the most letters; its
score is the share of these letters times how clearly they score above the best other language.

Scale: n-grams are hashed into ``BUCKETS``; a task returns the summed counts of its own words as rows (language,
bucket, n), which one aggregation adds up. The model is BUCKETS numbers a language, whatever the corpus (lang is taken as
a closed set of names). All training documents are counted. Words are scored once per task and remembered up to
a bound. For Viterbi a text is cut into pieces of ``PIECE`` words, all pieces of a batch advance together,
and the pieces of a text compose by max-plus products, so a very long text costs what as many short ones do.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every text if nothing was learned.
Documents with a null lang, a null text or no letter teach nothing; a null doc_id counts as the empty text in the
split. Repeated rows count again and get equal results. Ties go to the language whose name is smaller. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windlass.llm.common import batches, id_remainder

WORD = re.compile(r"[^\W\d_]+")
BUCKETS, LONGEST, SWITCH, CAP, PIECE = 1 << 16, 4, 6.0, 6.0, 32
MOST_WORDS, ENOUGH = 300_000, 0.01

# First code points of letter ranges and their scripts (Unicode blocks).
RANGES = [(0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
          (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"),
          (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"),
          (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
          (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
          (0x2000, "other"), (0x2C00, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x2DE0, "cyrillic"), (0x2E00, "other"),
          (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"),
          (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
          (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"),
          (0xFE70, "arabic"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x30000, "other")]
STARTS, NAMES = [r[0] for r in RANGES], [r[1] for r in RANGES]
SCRIPTS = sorted(set(NAMES))
SCRIPT_AT = [SCRIPTS.index(n) for n in NAMES]
LATIN, BEYOND_LATIN = SCRIPTS.index("latin"), chr(STARTS[1])


def script_of(word: str) -> int:
    """Number of the script of most letters of ``word`` (the first on ties)."""
    if max(word) < BEYOND_LATIN:
        return LATIN
    return Counter(SCRIPT_AT[bisect_right(STARTS, ord(c)) - 1] for c in word).most_common(1)[0][0]


def letters_in(word: str) -> int:
    return len(word) if word.isalpha() else sum(map(str.isalpha, word))


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of ``words`` (at least one word) with their ends, and the index of the word of each."""
    joined = " " + " ".join(words) + " "
    x = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    space = x == 32
    word = np.cumsum(space) - 1  # a space belongs to the word after it
    found, at = [], []
    for n in range(1, LONGEST + 1):
        h = np.full(len(x) - n + 1, n, np.uint64)
        inner = np.zeros(len(h), np.int64)
        for i in range(n):
            h = (h ^ x[i:len(h) + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            if 0 < i < n - 1:
                inner += space[i:len(h) + i]
        fine = (inner == 0) if n > 2 else np.ones(len(h), bool)
        if n == 1:
            fine = ~space
        elif n == 2:
            fine = ~(space[:-1] & space[1:])
        found.append((h[fine] % np.uint64(BUCKETS)).astype(np.int64))
        # an n-gram that starts with the space before a word is that word's; one that ends with the next space, this one's
        at.append(word[:len(h)][fine])
    return np.concatenate(found), np.concatenate(at)


def counted(docs: DataFrame) -> DataFrame:
    """lang, bucket, n: n-gram counts of (lang, text), and as bucket -1 - s the letters of script s."""
    def partial(frames):
        totals: dict[str, np.ndarray] = {}
        letters: Counter = Counter()

        def flush(lang, words):
            lettered = {w: n for w, n in words.items() if letters_in(w)}
            if lettered:
                n = np.fromiter(lettered.values(), np.float64, len(lettered))
                buckets, at = ngrams([w.lower() for w in lettered])
                counts = totals.setdefault(lang, np.zeros(BUCKETS))
                counts += np.bincount(buckets, n[at], BUCKETS)
                for w, k in lettered.items():
                    letters[lang, script_of(w)] += letters_in(w) * k
            words.clear()

        held: dict[str, Counter] = {}
        for frame in frames:
            for lang, text in zip(frame["lang"], frame["text"]):
                words = held.setdefault(lang, Counter())
                words.update(WORD.findall(text))
                if len(words) > MOST_WORDS:
                    flush(lang, words)
        for lang, words in held.items():
            flush(lang, words)
        for lang, counts in totals.items():
            some = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "bucket": some, "n": counts[some].astype(np.int64)})
        if letters:
            yield pd.DataFrame([(lang, -1 - s, n) for (lang, s), n in letters.items()], columns=["lang", "bucket", "n"])

    return docs.select("lang", "text").mapInPandas(partial, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """names: the languages in order; shares: log share of each bucket in each language; fits: script x language."""

    def __init__(self, rows):
        self.names = sorted({r["lang"] for r in rows})
        place = {name: i for i, name in enumerate(self.names)}
        counts, letters = np.zeros((len(self.names), BUCKETS)), np.zeros((len(SCRIPTS), len(self.names)))
        for r in rows:
            if r["bucket"] >= 0:
                counts[place[r["lang"]], r["bucket"]] = r["n"]
            else:
                letters[-1 - r["bucket"], place[r["lang"]]] = r["n"]
        self.shares = np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS)).T.astype(np.float32).copy()
        self.fits = letters >= ENOUGH * np.maximum(letters.sum(0), 1)
        self.fits[~self.fits.any(1)] = True


class Scores:
    """Word -> row of ``table`` (scores of the languages, best is 0) and ``letters``, remembered up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self):
        self.known: dict[str, int] = {}
        self.table, self.letters = np.zeros((0, len(self.model.names)), np.float32), np.zeros(0, np.int64)

    def rows(self, found: list[list[str]]) -> np.ndarray:
        """Rows of all words of the texts, one after the other."""
        if len(self.known) > MOST_WORDS:
            self.reset()
        words = list(chain.from_iterable(found))
        new = list(set(words).difference(self.known))
        if new:
            buckets, at = ngrams([w.lower() for w in new])
            order = np.argsort(at, kind="stable")
            n = np.bincount(at, minlength=len(new))
            sums = np.add.reduceat(self.model.shares[buckets[order]], np.cumsum(n) - n)
            s = sums / np.sqrt(n)[:, None]
            s = np.where(self.model.fits[[script_of(w) for w in new]], s, -np.inf)
            s = np.maximum(s - s.max(1, keepdims=True), -CAP).astype(np.float32)
            self.known |= {w: len(self.letters) + i for i, w in enumerate(new)}
            self.table = np.concatenate([self.table, s])
            self.letters = np.concatenate([self.letters, np.array([letters_in(w) for w in new], np.int64)])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


def viterbi(scores: np.ndarray, counts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word of the texts (their words' scores one after the other, ``counts`` words each)."""
    total, k = scores.shape
    if k == 1 or not total:
        return np.zeros(total, np.int64)
    pieces = -(-counts // PIECE)
    text = np.repeat(np.arange(len(counts)), pieces)
    nth = np.arange(len(text)) - (np.cumsum(pieces) - pieces)[text]
    word = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    at, step = np.repeat(np.cumsum(pieces) - pieces, counts) + word // PIECE, word % PIECE
    padded = np.zeros((PIECE, len(text), k))  # what is missing of a text's last piece is neutral
    padded[step, at] = scores
    by_nth = np.argsort(nth, kind="stable")
    cuts = np.r_[0, np.cumsum(np.bincount(nth))]
    levels = [by_nth[a:b] for a, b in zip(cuts, cuts[1:])]  # the first pieces of all texts, the second ones, ...

    # best sum of a piece from the state before it (second axis) to its last state
    through = np.where(np.eye(k, dtype=bool), 0, -switch) + padded[0][:, None, :]
    for t in range(1, PIECE):
        through = np.maximum(through, through.max(2, keepdims=True) - switch) + padded[t][:, None, :]
    state = np.zeros((len(text), k))
    for level in levels[1:]:
        state[level] = (state[level - 1][:, :, None] + through[level - 1]).max(1)
    # the state that each state of a word comes from
    came = np.empty((PIECE, len(text), k), np.int32)
    for t in range(PIECE):
        top, most = state.argmax(1)[:, None], state.max(1, keepdims=True) - switch
        came[t] = np.where(most > state, top, np.arange(k))
        state = np.maximum(state, most) + padded[t]
    # a piece's labels for each last state, and the state before it
    labels, now = np.empty((PIECE, len(text), k), np.int32), np.broadcast_to(np.arange(k), (len(text), k))
    for t in range(PIECE - 1, -1, -1):
        labels[t] = now
        now = np.take_along_axis(came[t], now, 1)
    last = state.argmax(1)
    for level in reversed(levels[1:]):
        last[level - 1] = now[level, last[level]]
    return labels[step, at, last[at]]


def judged(words: list[list[str]], scores: Scores, switch: float):
    """For each text: labels of its words, the language number (-1: none) and the score."""
    counts = np.array([len(w) for w in words], np.int64)
    rows = scores.rows(words)
    table, letters = scores.table[rows].astype(np.float64), scores.letters[rows]
    table[letters == 0] = 0
    labels = viterbi(table, counts, switch)
    k, text = table.shape[1], np.repeat(np.arange(len(words)), counts)
    held = np.bincount(text * k + labels, letters, len(words) * k).reshape(-1, k)
    language, all_letters = held.argmax(1), held.sum(1)
    mine = labels == language[text]
    sums = np.stack([np.bincount(text[mine], table[mine, j], len(words)) for j in range(k)], 1)
    own = sums[np.arange(len(words)), language]
    sums[np.arange(len(words)), language] = -np.inf
    margin = own - sums.max(1) if k > 1 else np.full(len(words), np.inf)
    sure = 1 / (1 + np.exp(-np.clip(margin, -50, 50)))
    share = held.max(1) / np.maximum(all_letters, 1)
    return np.split(labels, np.cumsum(counts)[:-1]), np.where(all_letters > 0, language, -1), np.where(all_letters > 0, share * sure, 0.0)


def spans_of(text: str, labels: np.ndarray, names: list[str]) -> list[dict]:
    """The runs of one label among the words of ``text``."""
    cut = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]]).tolist()
    if len(cut) == 1:  # no word's place is needed but the first one's start and the last one's end
        end = len(text)
        while not WORD.match(text, end - 1):
            end -= 1
        return [{"start": WORD.search(text).start(), "end": end, "lang": names[labels[0]]}]
    places = [m.span() for m in WORD.finditer(text)]
    return [{"start": places[i][0], "end": places[j - 1][1], "lang": names[labels[i]]} for i, j in zip(cut, [*cut[1:], len(places)])]


def fit(docs: DataFrame) -> Model:
    """The model of the rows (lang, text)."""
    usable = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = counted(usable.filter("lang IS NOT NULL AND text IS NOT NULL"))
    return Model(counts.toArrow().to_pylist())  # BUCKETS rows a language at most


def identified(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score, spans (start and end in characters, lang) of the rows (doc_id, text)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kinds = "doc_id long, lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>"
    most = max(20_000, 8_000_000 // max(1, len(model.names)) ** 2)

    def label(parts):
        model = shared.value
        names, scores = model.names, Scores(model)
        for part in parts:
            texts = [t or "" for t in part.column(1).to_pylist()]
            preds, values, spans = [], [], []
            for a, b in batches(texts, most):
                words = [WORD.findall(t) for t in texts[a:b]]
                if not names or not any(words):
                    preds += ["und"] * (b - a)
                    values += [0.0] * (b - a)
                    spans += [[]] * (b - a)
                    continue
                labels, language, value = judged(words, scores, switch)
                preds += [names[n] if n >= 0 else "und" for n in language]
                values += value.tolist()
                spans += [spans_of(t, own, names) if n >= 0 else [] for t, own, n in zip(texts[a:b], labels, language)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(preds, pa.string()), pa.array(values, pa.float64()), pa.array(
                spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))], ["doc_id", "lang_pred", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(label, kinds)


def identify_documents(docs: DataFrame, switch: float = SWITCH) -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans for every row, learned from the rows whose crc32(doc_id) mod 4 is not 2."""
    model = fit(docs.filter(id_remainder(F.col("doc_id"), 4) != 2).select("lang", "text"))
    out = identified(docs, model, switch)
    return out.select("doc_id", (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "spans")
