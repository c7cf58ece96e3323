"""Subsequence kernel against a direct count, insults with inserted characters, harmless spaced words, a rarer language."""

import itertools
import random

import numpy as np
import pytest

from windlass.llm import toxicity as tox

INSULTS = ["idiot", "scumbag", "moron", "loser"]
FOREIGN = ["réplouk", "réplouka"]


def corpus(seed, n=800):
    rng = random.Random(seed)
    english = ["".join(rng.choice("bdfghklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(150)]
    foreign = ["".join(rng.choice("éçàvjz") + rng.choice("éaou") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    texts, labels = [], []
    for i in range(n):
        words, bad = (foreign, FOREIGN) if i % 8 == 0 else (english, INSULTS)
        body, toxic = [rng.choice(words) for _ in range(rng.randint(20, 80))], i % 3 == 0
        for _ in range(3 if toxic else 0):
            body.insert(rng.randrange(len(body)), rng.choice(bad))
        texts.append(" ".join(body) + ".")
        labels.append(int(toxic))
    return texts, np.array(labels)


@pytest.fixture(scope="module")
def model():
    texts, y = corpus(3)
    return tox.Model(texts, y, np.ones(2), rounds=3, landmarks=300)


def test_window_sums_are_direct_subsequence_counts():
    rng = np.random.default_rng(2)
    weights = rng.normal(size=tox.CLASSES ** 3).astype(np.float32).reshape(64, 64, 64)
    weights[0], weights[:, 0], weights[:, :, 0] = 0, 0, 0
    text = "You i-d-i o t! réplouk. " * 3
    for step in tox.STEPS_APART:
        codes = tox.every(tox.classes_of(text), step)
        got = tox.window_scores(codes, weights.ravel())
        for length, sums in zip(tox.LENGTHS, got):
            for start in range(0, len(sums), 5):
                want = 0.0
                for i in range(start, start + length):
                    for j, k in itertools.combinations(range(i + 1, i + tox.SPAN), 2):
                        want += tox.DECAY ** (k - i - 2) * float(weights[codes[i], codes[j], codes[k]])
                assert abs(sums[start] - want) < 1e-3


def test_held_out_texts(model):
    texts, y = corpus(3, 1160)
    right = (model(texts[800:]) >= 0.5) == y[800:]
    foreign = np.arange(360) % 8 == 0
    assert right.mean() > 0.9 and right[foreign].mean() > 0.9


@pytest.mark.parametrize("between", ["", "x", "xq", "-", "--", " ", " - ", "*"])
def test_inserted_characters(model, between):
    texts, y = corpus(3, 1160)
    clean = [t for t, label in zip(texts[800:], y[800:]) if not label][:60]
    insulted = [f"{t} bobo {between.join(INSULTS[i % 4])} bobo." for i, t in enumerate(clean)]
    harmless = [f"{t} bobo {between.join(['garden', 'window', 'table', 'crown'][i % 4])} bobo." for i, t in enumerate(clean)]
    # three characters between all letters leave the fewest windows to tell by: half of them is what this small table teaches
    assert (model(insulted) >= 0.5).mean() > (0.7 if len(between) < 3 else 0.4)
    assert (model(harmless) >= 0.5).mean() < 0.15


def test_empty_long_and_repeated_texts(model):
    texts, y = corpus(3, 1160)
    long = "\n".join(t for t, label in zip(texts[800:], y[800:]) if not label) * 20
    insulted = long.replace("\n", " idiot idiot scumbag moron\n")
    scores = model(["", "", long, insulted, insulted])
    assert len(long) > 1 << 19
    assert scores[0] == scores[1] < 0.5 and scores[2] < scores[3] == scores[4] > 0.5
    assert len(model([])) == 0
