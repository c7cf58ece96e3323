"""Toxicity: a subsequence string-kernel support vector machine with Nystroem landmarks.

Instances are windows of a sentence. The kernel of two windows counts their common subsequences of three
characters, a gap weighing ``DECAY`` a character, up to a span of ``SPAN``: an insult with gaps or inserted characters
keeps most of its subsequences. Characters fall into 64 classes, so the kernel's feature space is explicit (64^3).
A window takes every character, or every second, third or fourth one (``STEPS_APART``), so an insult with one to three letters or
signs between all its letters is a window without gaps.

Training is on the driver, on a bounded sample: at most ``per_class`` labelled documents of each class, of at most
``most_chars`` characters each. A sentence of a toxic document need not be toxic, so the labelled sentences are found
in rounds: the best windows of a toxic document, the first and those that clean documents hardly reach, are positive
examples (also with a character inserted, and their letters alone among strange ones), the best windows of clean documents, at
every distance of characters, and words of theirs with characters inserted are negative ones. What the first windows are is guessed
by clusters of toxic documents of like trigrams, each against the clean documents most like its own, so that insults of a rarer
language start too; the language column is not read. Windows are mapped to the Nystroem features of the landmarks, on which a
linear SVM (squared hinge) is fitted, each cluster weighing alike. A quarter of the sample is left out to turn scores into probabilities.

Scoring: the SVM over Nystroem features is one weight per subsequence, so a text is scored exactly in one pass for each distance of
characters. Two numbers count: the best window, and the mean of what all windows exceed the usual by; both in units of what clean
training texts of the same kind (nearest of 16 trigram profiles) reach, and either can make a text toxic. Whole texts are scored, in
pieces that overlap by a window.

Defined cases: null and empty texts score like a text whose windows hold no known subsequence; repeated rows score
alike; null ids are scored and never used for training; without labels of both classes the score is the share of
label 1 (0 if there is no label); empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windlass.llm.common import bounded_labels, id_remainder, labels_of, whole_text

CLASSES, SPAN, DECAY = 64, 5, 0.6
#: Windows are this many characters long; a short one leaves out what stands beside an insult.
LENGTHS = (4, 7, 12)
WINDOW = max(LENGTHS)
STEPS_APART = (1, 2, 3, 4)
PROFILE = 4096
#: Clean windows together weigh so much more than toxic ones: a stem that clean documents also use then stays below a plain insult.
CLEAN_WEIGHT = 8
#: A missed toxic document counts as so many clean ones in the calibration, as either of two numbers may be the one that tells.
TOXIC_WEIGHT = 1.5
#: A best window of so many times what clean documents reach tells as much as any higher one, so one insult counts as several do.
ENOUGH = 2.5
#: A document counts by its best window and by how much its windows exceed the usual, a character; a short one as if of this length.
SHORT = 256
PIECE = 1 << 19
BREAK, SPACE, SIGN, DIGIT, FIRST_OTHER = 0, 27, 28, 29, 30
STEPS = [(a, b, DECAY ** (b - 2)) for b in range(2, SPAN) for a in range(1, b)]


def _class_table() -> np.ndarray:
    table = np.array([FIRST_OTHER + c % (CLASSES - FIRST_OTHER) for c in range(0x3000)], np.int32)
    table[:128] = SIGN
    for c in map(chr, range(128)):
        if c.isalpha():
            table[ord(c)] = ord(c.lower()) - 96
        elif c.isdigit():
            table[ord(c)] = DIGIT
        elif c in " \t\r\v\f":
            table[ord(c)] = SPACE
    return table


TABLE = _class_table()


def classes_of(text: str) -> np.ndarray:
    """Character classes; sentence ends are breaks."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = TABLE[np.where(points < len(TABLE), points, 0x250 + points % 1024)]
    out[points == 10] = BREAK
    end = (points == 46) | (points == 33) | (points == 63)
    out[:-1][end[:-1] & ((out[1:] == SPACE) | (out[1:] == BREAK))] = BREAK
    return out


def subsequences(codes: np.ndarray):
    """For each kind of gaps: feature number at each position (0: none), and the weight."""
    n = len(codes) - SPAN + 1
    for a, b, weight in STEPS:
        x, y, z = codes[:n], codes[a:a + n], codes[b:b + n]
        yield np.where((x > 0) & (y > 0) & (z > 0), (x << 12) | (y << 6) | z, 0), weight


def window_scores(codes: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """For each window length, the sum of the weights of the subsequences that start in each window (``weights`` is zero
    wherever a break takes part)."""
    n = len(codes) - SPAN + 1
    high, mid = codes << 12, codes << 6
    total = np.zeros(n, np.float32)
    for a, b, weight in STEPS:
        total += np.float32(weight) * weights[high[:n] | mid[a:a + n] | codes[b:b + n]]
    sums = np.concatenate([[0.0], np.cumsum(total, dtype=np.float64)])
    last = len(sums) - WINDOW
    return [sums[length:length + last] - sums[:last] for length in LENGTHS]


def padded(codes: np.ndarray) -> np.ndarray:
    pad = np.zeros(WINDOW + SPAN, codes.dtype)
    return np.concatenate([pad, codes, pad])


def every(codes: np.ndarray, step: int) -> np.ndarray:
    """Each ``step``-th character, from each of the first ``step`` ones, one row of them after the other with breaks between."""
    return np.concatenate([padded(codes[at::step]) for at in range(step)])


def profile(text: str) -> np.ndarray:
    """Direction of the square roots of the counts of the text's trigrams, in PROFILE bins: what kind of text it is."""
    codes = padded(classes_of(text)).astype(np.int64)
    found = (codes[:-2] << 12) | (codes[1:-1] << 6) | codes[2:]
    p = np.sqrt(np.bincount(found[(codes[:-2] > 0) & (codes[1:-1] > 0) & (codes[2:] > 0)] % PROFILE, minlength=PROFILE)).astype(np.float32)
    return p / max(float(np.linalg.norm(p)), 1e-9)


def best_windows(texts, weights: np.ndarray, top: int = 1, unit=1.0, step: int = 1) -> list[list[tuple[float, tuple[np.ndarray, int]]]]:
    """The ``top`` best windows of each text that lie apart: the sum in ``unit`` (a number for each length), and the
    character classes from its start with its length."""
    out = []
    for text in texts:
        codes, found = every(classes_of(text), step), []
        sums = np.array(window_scores(codes, weights)) / np.reshape(unit, (-1, 1))
        for _ in range(top):
            kind, at = np.unravel_index(int(sums.argmax()), sums.shape)
            found.append((float(sums[kind, at]), (codes[at:at + WINDOW + SPAN - 1], LENGTHS[kind])))
            sums[:, max(0, at - WINDOW):at + WINDOW] = -np.inf
        out.append(found)
    return out


def best_sums(texts, weights: np.ndarray, usual: np.ndarray | float = np.inf) -> np.ndarray:
    """A row for each whole text, many at once: its best window sum at each distance of characters, and the mean of what its
    windows exceed ``usual`` (a number for each text) by."""
    usual = np.broadcast_to(usual, len(texts))
    out = np.full((len(texts), len(STEPS_APART) + 1), -np.inf)
    out[:, -1] = 0
    held, owners, size = [], [], 0

    def flush():
        nonlocal held, owners, size
        for k, step in enumerate(STEPS_APART if held else ()):
            parts = [every(h, step) for h in held]
            sums = np.maximum.reduce(window_scores(np.concatenate(parts), weights))
            starts = np.minimum(np.cumsum([0] + [len(h) for h in parts[:-1]]), len(sums) - 1)
            np.maximum.at(out[:, k], owners, np.maximum.reduceat(sums, starts))
            if step == 1:
                level = np.repeat(usual[owners], [len(h) for h in parts])[:len(sums)]
                np.add.at(out[:, -1], owners, np.add.reduceat(np.maximum(sums - level, 0), starts))
        held, owners, size = [], [], 0

    overlap = (WINDOW + SPAN) * max(STEPS_APART)
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text)), PIECE):
            held.append(classes_of(text[max(0, at - overlap):at + PIECE + overlap]))
            owners.append(i)
            size += len(held[-1])
            if size >= PIECE:
                flush()
    flush()
    out[:, -1] /= np.array([max(len(t), SHORT) for t in texts])
    return out


def features(windows: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Feature numbers of each window's subsequences, a row each; their weights are ``entry_weights``."""
    if not windows:
        return np.zeros((0, len(STEPS) * WINDOW), np.int64)
    codes = np.array([w for w, _ in windows])
    inside = np.arange(WINDOW) < np.array([n for _, n in windows])[:, None]
    out = []
    for a, b, _ in STEPS:
        x, y, z = codes[:, :WINDOW], codes[:, a:a + WINDOW], codes[:, b:b + WINDOW]
        out.append(np.where((x > 0) & (y > 0) & (z > 0) & inside, (x << 12) | (y << 6) | z, 0))
    return np.hstack(out)


def entry_weights() -> np.ndarray:
    return np.concatenate([np.full(WINDOW, w) for _, _, w in STEPS])


def letters_of(window: tuple[np.ndarray, int]) -> np.ndarray:
    found = window[0][:window[1] + 2]
    return found[(found > 0) & (found != SPACE) & (found != SIGN)]


def as_window(codes) -> tuple[np.ndarray, int]:
    size = WINDOW + SPAN - 1
    return np.concatenate([codes, np.full(size, SPACE)])[:size].astype(np.int32), WINDOW


def altered(window: tuple[np.ndarray, int], strange: np.ndarray, rng) -> list[tuple[np.ndarray, int]]:
    """The window's letters with a sign inserted at one place, and alone among characters drawn from ``strange``, as they stand where
    every second or third character is read."""
    letters = letters_of(window)
    if len(letters) < 4:
        return []
    at = int(rng.integers(1, len(letters)))
    once = np.concatenate([[SPACE], letters[:at], [SIGN], letters[at:], [SPACE]])
    return [as_window(once), as_window(np.concatenate([rng.choice(strange, 2), letters, rng.choice(strange, WINDOW)]))]


def spaced(window: tuple[np.ndarray, int], rng) -> list[tuple[np.ndarray, int]]:
    """The window's letters with one or two signs or spaces between all."""
    letters = letters_of(window)
    if len(letters) < 4:
        return []
    between = [np.full(len(letters), rng.choice([SPACE, SIGN])) for _ in range(int(rng.integers(1, 3)))]
    return [as_window(np.ravel(np.column_stack([letters, *between])))]


class Svm:
    """weights of all subsequences and a bias, fitted on window examples through Nystroem features."""

    def __init__(self, positive: list, negative: list, landmarks: list, shares=1.0, ridge: float = 1e-3, steps: int = 200):
        entry = entry_weights()
        marks = features(landmarks)
        used = np.unique(marks[marks > 0])
        column = np.zeros(CLASSES ** 3, np.int64)
        column[used] = np.arange(1, len(used) + 1)
        phi = np.zeros((len(landmarks), len(used) + 1))
        for row, found in zip(phi, marks):
            np.add.at(row, column[found], entry)
        phi[:, 0] = 0
        phi /= np.maximum(np.linalg.norm(phi, axis=1, keepdims=True), 1e-9)
        value, vector = np.linalg.eigh(phi @ phi.T)
        keep = value > 1e-6 * value[-1]
        to_z = vector[:, keep] / np.sqrt(value[keep])  # Nystroem: K_mm^(-1/2)
        basis = (phi.T @ to_z).astype(np.float32)  # of subsequences in Nystroem features
        z = np.vstack([np.einsum("ijk,j->ik", basis[column[features(part[i:i + 256])]], entry.astype(np.float32))
                       for part in (positive, negative) for i in range(0, len(part), 256)])
        y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
        shares = np.broadcast_to(np.asarray(shares, float), len(positive))
        c = np.r_[0.5 * shares / shares.sum(), np.full(len(negative), 0.5 * CLEAN_WEIGHT / len(negative))]
        scale = np.sqrt((z * z).sum(1).mean()) + 1e-9
        z = np.hstack([z / scale, np.ones((len(z), 1))]).astype(np.float32)
        y, c = y.astype(np.float32), c.astype(np.float32)
        v = ahead = np.zeros(z.shape[1], np.float32)
        rate = np.float32(1 / (2 * np.linalg.norm((z * c[:, None]).T @ z, 2) + ridge))
        for k in range(steps):  # accelerated gradient on the squared hinge
            slack = np.maximum(0, 1 - y * (z @ ahead))
            new = ahead - rate * (np.float32(ridge) * ahead - 2 * z.T @ (c * y * slack))
            v, ahead = new, new + np.float32(k / (k + 3)) * (new - v)
        self.weights = np.zeros(CLASSES ** 3, np.float32)
        self.weights[used] = (basis @ v[:-1] / scale)[1:]
        self.bias = float(v[-1])


class Model:
    """Best-window SVM score of a document, and the line that turns it into a log-odds."""

    def __init__(self, texts: list[str], y: np.ndarray, shares: np.ndarray, rounds: int = 4, landmarks: int = 500, seed: int = 1):
        rng = np.random.default_rng(seed)
        held = np.arange(len(texts)) % 4 == 3
        if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
            held[:] = False
        fit = np.flatnonzero(~held)
        good, bad = [texts[i] for i in fit if not y[i]], [texts[i] for i in fit if y[i]]
        profiles = np.array([profile(t) for t in texts])
        self.mean = profiles[fit].mean(0)
        profiles -= self.mean
        profiles /= np.maximum(np.linalg.norm(profiles, axis=1, keepdims=True), 1e-9)
        groups = self.groups(profiles[fit][y[fit] == 0], profiles[fit][y[fit] == 1])
        weights = self.first_guess(good, bad, groups)
        group = np.zeros(len(bad), np.int64)
        for g, (_, at) in enumerate(groups[1:], 1):
            group[at] = g
        strange = np.concatenate([classes_of(t) for t in good[:200]] + [[SPACE]])
        strange = strange[strange > 0]
        harmless = [x for text in good for x in spaced(self.any_window(text, rng), rng)]
        negative: list[tuple] = []
        positive: list[tuple] = []
        kept: list[tuple] = []
        for turn in range(rounds):
            clean = [found[0][1] for found in best_windows(good, weights)]
            if turn:  # by then the weights tell letters that stand apart
                clean += [found[0][1] for step in STEPS_APART[1:] for found in best_windows(good[turn % 2::2], weights, step=step)]
            each = np.array([[k.max() for k in window_scores(padded(classes_of(text)), weights)] for text in good])
            # what clean documents hardly reach, by length: of a toxic document's group, else of all
            bound = np.repeat(np.quantile(each, 0.95, axis=0)[None], len(bad), axis=0)
            for near, at in groups[1:]:
                bound[at] = np.quantile(each[near], 0.95, axis=0)
            kept = kept or positive  # what the first guess found stays, or a rarer insult could fade out
            positive = kept + [(w, g) for text, limit, g in zip(bad, np.maximum(bound, 1e-6), group)
                               for k, (s, w) in enumerate(best_windows([text], weights, 4, limit)[0]) if s > 1 or not k]
            positive += [(x, g) for w, g in positive[len(kept)::2] for x in altered(w, strange, rng)]
            negative += clean
            of = np.array([g for _, g in positive])
            share = (1 / np.bincount(of).clip(1))[of]  # each group weighs alike
            marks = rng.choice(len(positive), min(len(positive), landmarks * 2 // 3), replace=False, p=share / share.sum())
            some = [positive[i][0] for i in marks]
            some += [(negative + harmless)[i] for i in rng.permutation(len(negative) + len(harmless))[:landmarks // 3]]
            svm = Svm([w for w, _ in positive], negative + harmless, some, share)
            weights = svm.weights
        self.weights = weights
        self.set_kinds(profiles[fit], y[fit], good)
        use = np.flatnonzero(held) if held.any() else fit
        found = self.raw([texts[i] for i in use])
        weight = shares[y[use]] * np.where(y[use] > 0, TOXIC_WEIGHT, 1)
        self.lines = [self.line(x[:, None], y[use], weight) for x in found.T]

    def set_kinds(self, profiles: np.ndarray, y: np.ndarray, good: list[str], k: int = 16, least: int = 40):
        """Kinds of text, and what clean documents of a kind reach: by distance of characters, and in how much they exceed the usual. A kind with
        fewer than ``least`` clean documents takes the numbers of all."""
        own = self.clusters(profiles.copy(), k)
        kinds = sorted(set(own.tolist()))
        self.kinds = np.array([profiles[own == c].mean(0) for c in kinds])
        self.kinds /= np.maximum(np.linalg.norm(self.kinds, axis=1, keepdims=True), 1e-9)
        which = self.kind_of(profiles[y == 0] + self.mean)
        rows = [np.flatnonzero(which == c) if (which == c).sum() >= least else np.arange(len(good)) for c in range(len(kinds))]
        places = [np.maximum.reduce(window_scores(padded(classes_of(text)), self.weights)) for text in good]
        self.usual = np.array([np.quantile(np.concatenate([places[i] for i in at]), 0.998) for at in rows])
        found = best_sums(good, self.weights, self.usual[which])
        found[:, -1] = np.log1p(1000 * found[:, -1])
        self.reached = np.array([np.quantile(found[at], 0.97, axis=0) for at in rows])
        self.reached[:, :-1] = np.maximum(self.reached[:, :-1], 1e-6)

    def kind_of(self, profiles: np.ndarray) -> np.ndarray:
        return ((profiles - self.mean) @ self.kinds.T).argmax(1)

    def raw(self, texts) -> np.ndarray:
        """Two numbers of each text, in what clean texts of its kind reach: its best window and its excess."""
        kind = self.kind_of(np.array([profile(t) for t in texts]).reshape(-1, PROFILE))
        found, reached = best_sums(texts, self.weights, self.usual[kind]), self.reached[kind]
        return np.column_stack([np.minimum((found[:, :-1] / reached[:, :-1]).max(1), ENOUGH), np.log1p(1000 * found[:, -1]) - reached[:, -1]])

    @staticmethod
    def any_window(text: str, rng) -> tuple[np.ndarray, int]:
        codes = classes_of(text)
        words = np.flatnonzero(codes == SPACE)
        at = int(rng.choice(words)) + 1 if len(words) else 0
        return as_window(codes[at:at + WINDOW])

    @staticmethod
    def clusters(profiles: np.ndarray, k: int) -> np.ndarray:
        """Cluster numbers of unit rows by their cosine; half of the starts far apart, half spread over the rows, ten rounds."""
        centres = profiles[::max(1, 2 * len(profiles) // k)][:k // 2]
        while len(centres) < min(k, len(profiles)):
            centres = np.vstack([centres, profiles[(profiles @ centres.T).max(1).argmin()]])
        for _ in range(10):
            own = (profiles @ centres.T).argmax(1)
            for c in set(own.tolist()):
                total = profiles[own == c].sum(0)
                centres[c] = total / np.linalg.norm(total)
        return own

    @staticmethod
    def groups(good: np.ndarray, bad: np.ndarray, k: int = 24, controls: int = 20) -> list[tuple[np.ndarray, np.ndarray]]:
        """(clean, toxic) row numbers by their profiles: all, and each cluster of toxic documents with the clean ones most like its own."""
        own = Model.clusters(bad.copy(), k)
        out = [(np.arange(len(good)), np.arange(len(bad)))]
        for c in set(own.tolist()):
            at = np.flatnonzero(own == c)
            if len(at) >= 8:
                near = np.argpartition(-(bad[at] @ good.T), min(controls, len(good)) - 1, axis=1)[:, :controls]
                out.append((np.unique(near), at))
        return out

    @staticmethod
    def first_guess(good: list[str], bad: list[str], groups) -> np.ndarray:
        """A weight for each subsequence without gaps that is clearly more frequent in the toxic documents of a group than in its clean
        ones: the t statistic of its log counts."""
        found = [[np.unique(next(subsequences(padded(classes_of(t))))[0], return_counts=True) for t in texts] for texts in (good, bad)]
        guess = np.zeros(CLASSES ** 3)
        for clean, toxic in groups:
            moments = []
            for rows, at in zip(found, (clean, toxic)):
                f, n = np.concatenate([rows[i][0] for i in at]), np.log1p(np.concatenate([rows[i][1] for i in at]))
                one, two = (np.bincount(f, n ** power, minlength=CLASSES ** 3) / len(at) for power in (1, 2))
                moments.append((one, (two - one ** 2 + 0.1 / len(at)) / len(at)))
            (q, q_var), (p, p_var) = moments
            z = (p - q) / np.sqrt(p_var + q_var)
            guess = np.maximum(guess, np.where(z > 4, np.minimum(z, 12), 0))
        guess[0] = 0
        return guess.astype(np.float32)

    @staticmethod
    def line(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
        """Logistic regression on few features by Newton steps, with targets a little inside 0 and 1."""
        t = np.where(y > 0, 1 - 1 / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        mean, scale = x.mean(0), x.std(0) + 1e-9
        a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
        w = np.zeros(a.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            h = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-4 * np.eye(len(w))
            w = w - np.linalg.solve(h, a.T @ (weight * (p - t)) + 1e-4 * w)
        return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())

    def __call__(self, texts) -> np.ndarray:
        """1 less the chance that neither the best window nor the excess is toxic."""
        clean = np.ones(len(texts))
        for x, (slope, cut) in zip(self.raw(texts).T, self.lines):
            clean *= 1 / (1 + np.exp(np.clip(slope[0] * x + cut, -500, 500)))
        return 1 - clean


class Constant:
    def __init__(self, value: float):
        self.value = value

    def __call__(self, texts) -> np.ndarray:
        return np.full(len(texts), self.value)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, most_chars: int = 12_000):
    known = labels_of(labels, "toxic")
    count = {r["label"]: r["count"] for r in known.filter("label IN (0, 1)").groupBy("label").count().collect()}
    if len(count) < 2:
        return Constant(float(1 in count))
    short = docs.filter(F.length(whole_text(F.col("text"))) <= most_chars).select("doc_id").distinct()
    sample = F.broadcast(bounded_labels(known.join(short, "doc_id"), per_class))  # 2 x per_class rows at most
    rows = (docs.select("doc_id", whole_text(F.col("text")).alias("text")).filter(F.length("text") <= most_chars)
            .join(sample, "doc_id").select("doc_id", "text", "label").collect())
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    y = np.array([r["label"] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return Constant(count[1] / (count[0] + count[1]))
    taken = np.bincount(y, minlength=2)
    shares = np.array([count[0] / taken[0], count[1] / taken[1]])
    return Model([r["text"] for r in rows], y, shares / shares.max())


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, per_class: int = 1500) -> DataFrame:
    """doc_id, held_out, score, predicted, for every row of ``docs``."""
    model = fit(docs, labels, per_class)

    def score(frames):
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "score": model(frame["text"].tolist())})

    out = (docs.select(F.col("doc_id").cast("long"), whole_text(F.col("text")).alias("text"))
           .mapInPandas(score, "doc_id long, score double"))
    return out.select("doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
