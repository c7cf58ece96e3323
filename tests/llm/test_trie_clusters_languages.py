"""Prefix trie, centroid clustering and language identification against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from windlass.llm import heap_clusters, languages, prefix_trie

EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# ---- op11 ----------------------------------------------------------------------------------------
def rebuilt(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append(((t is not None, t or 0), r or "", x or ""))
    turns = {c: [(r, x) for _, r, x in sorted(v, key=lambda z: (z[0], z[1].encode(), z[2].encode()))] for c, v in convs.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = turns.get(base, [])[:h] + own[h:]
    return out


def brute_trie(rows):
    texts = rebuilt(rows)
    members = defaultdict(list)
    for c, turns in texts.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) if children[node] else 1
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own + sum(saved[k] for k in children[node])
    ends = {n: ",".join(map(str, sorted(c for c in m if len(texts[c]) == len(n)))) for n, m in members.items()}
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n],
                    hashlib.sha256(ends[n].encode()).hexdigest()) for n, m in members.items()), key=lambda r: r[:2])


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(11)
    rows = []
    for c in [*range(-12, 70), 10 ** 12, 10 ** 12 + 3]:
        if c % 7 != 3:
            rows += [(c, rng.choice([None, t, t // 2]), rng.choice(["user", "bot", None]), rng.choice(["x", "yé", "", None, "z" * 3000]))
                     for t in range(rng.randint(0, 12))]
    rows += [(100, t, "user", rng.choice("ab")) for t in range(400)]  # a third of all turns
    rows += rows[:20] + [(None, 1, "user", "no conversation"), (101, 0, "user", "a"), (102, 0, "user", "a"), (103, 1, None, None)]
    return rows


def trie_frame(spark, rows, n=6):
    named = [(*r, "clash", 1, 2) for r in rows]
    return spark.createDataFrame(named, "conv_id long, turn long, role string, text string, turn_id string, f0 int, depth int").repartition(n)


def result(frame):
    return sorted(map(tuple, frame.collect()), key=lambda r: r[:2])


def test_trie_is_brute_force(spark, turns):
    got = prefix_trie.prefix_trie(trie_frame(spark, turns))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert result(got) == brute_trie(turns)


def test_trie_redoes_collisions(spark, turns):
    """The first seed's turn hash and the second one's products collide; both are noticed."""
    some = turns[:120]

    def lengths(role, text, seed):
        return F.length(text).cast("long") if seed == 0 else prefix_trie.element_hash(role, text, seed)

    got = prefix_trie.prefix_trie(trie_frame(spark, some), lengths, lambda seed: (1, 1) if seed == 1 else prefix_trie.multipliers(seed))
    assert result(got) == brute_trie(some)


def test_trie_pieces_and_ranges(spark, turns, monkeypatch):
    """Joins in pieces of 8 turns give the same nodes."""
    monkeypatch.setattr(prefix_trie, "PIECE", 8)
    assert result(prefix_trie.prefix_trie(trie_frame(spark, turns, 2))) == brute_trie(turns)


def test_trie_of_little(spark):
    assert prefix_trie.prefix_trie(trie_frame(spark, [])).count() == 0
    assert prefix_trie.prefix_trie(trie_frame(spark, [(None, 1, "a", "b")])).count() == 0
    one = result(prefix_trie.prefix_trie(trie_frame(spark, [(5, None, None, None)])))
    assert one == brute_trie([(5, None, None, None)])
    turnless = [(c, 0, "a", "b") for c in range(101, 200)]  # without base; most lose their only turn
    got = result(prefix_trie.prefix_trie(trie_frame(spark, turnless)))
    assert got == brute_trie(turnless) and got[0][7] != EMPTY_SHA


def test_products_compose(spark):
    """Products of pieces composed at range borders equal the product of the whole."""
    bases = prefix_trie.multipliers(3)
    rng = np.random.default_rng(3)
    import pandas as pd
    ids = rng.integers(-2 ** 63, 2 ** 63 - 1, 3000)
    conv = np.repeat([1, 2, 3, 9], [10, 2500, 1, 489])
    frames = [pd.DataFrame({"conv_id": conv[a:a + 700], "turn_id": ids[a:a + 700], "bytes": 1}) for a in range(0, 3000, 700)]
    out = pd.concat(prefix_trie.prefix_products(bases)(iter(frames)))
    parts = [pd.concat(prefix_trie.prefix_products(bases)(iter([f]))) for f in frames]
    tails = [{"part": i, "first": int(p["conv_id"].iloc[0]), "tail": {k: int(p[k].iloc[-1]) for k in ("conv_id", "local", "f0", "f1", "cum")}}
             for i, p in enumerate(parts)]
    carry = {(r[0], r[1]): r[2:] for r in prefix_trie.carried(tails, bases)}
    whole = iter(out.itertuples())
    for i, p in enumerate(parts):
        for r in p.itertuples():
            n, before, c0, c1, k0, k1 = carry.get((i, r.conv_id), (0, 0, 0, 0, 1, 1))
            w = next(whole)
            assert (w.local, w.cum, w.f0, w.f1) == (r.local + n, r.cum + before, (c0 + k0 * r.f0) % prefix_trie.PRIMES[0], (c1 + k1 * r.f1) % prefix_trie.PRIMES[1])


# ---- op12 ----------------------------------------------------------------------------------------
def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(c))) for c in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centre = [v for _, v in first]

    def assign():
        return [min(range(len(centre)), key=lambda c: (sum((a - b) ** 2 for a, b in zip(v, centre[c])), c)) for _, v in kept]

    for _ in range(rounds):
        own = assign()
        for c in range(len(centre)):
            mine = [v for (_, v), o in zip(kept, own) if o == c]
            if mine:
                centre[c] = [sum(col) // len(mine) for col in zip(*mine)]
    own = assign()
    dist = [sum((a - b) ** 2 for a, b in zip(v, centre[o])) for (_, v), o in zip(kept, own)]
    per = defaultdict(int)
    for o, d in zip(own, dist):
        per[o] += d
    sha = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in centre]
    return [(i, o, d, per[o], sum(dist), sha[o]) for (i, _), o, d in zip(kept, own, dist)]


def vectors(spread, n=700, seed=5):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 1, (20, 64))
    rows = [(i, (centre[rng.integers(20)] + rng.normal(0, spread, 64)).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)]  # a large group of copies
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (None, None), (2000, None), (2001, []), (2002, [1.0] * 63),
             (2003, [None] + [1.0] * 63), (2004, [float("nan")] + [0.0] * 63), (2005, [float("-inf")] * 64), (2006, [0.0] * 64), (2007, [-0.001] * 64)]
    return rows


SCHEMA = "vec_id long, embedding array<double>, label string, cluster string, v int"


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("spread", [0.05, 0.5, 2.0])
def test_clusters_are_brute_force(spark, spread, monkeypatch):
    monkeypatch.setattr(heap_clusters, "BLOCK", 64)
    rows = vectors(spread)
    got = heap_clusters.cluster_vectors(frame_of(spark, rows))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute_clusters(rows), key=repr)


def test_heaps_leave_settled_vectors_alone(spark):
    """Tight clusters: the later rounds pop few vectors, and the result is that of full comparisons."""
    rows = vectors(0.02, 3000)
    state, _ = heap_clusters.clusters(frame_of(spark, rows), rounds=6)
    assert state.agg(F.sum("rescanned")).first()[0] < 1000
    got = sorted(map(tuple, heap_clusters.cluster_vectors(frame_of(spark, rows), rounds=6).collect()), key=repr)
    assert got == sorted(brute_clusters(rows, rounds=6), key=repr)


def test_clusters_of_ties_and_little(spark):
    ties = [(i, [float((i % 3) * 2)] + [0.0] * 63) for i in range(40)]
    assert sorted(map(tuple, heap_clusters.cluster_vectors(frame_of(spark, ties)).collect()), key=repr) == sorted(brute_clusters(ties), key=repr)
    few = [(1, [0.5] * 64), (2, [-3.0] * 64)]
    assert sorted(map(tuple, heap_clusters.cluster_vectors(frame_of(spark, few)).collect())) == sorted(brute_clusters(few))
    assert heap_clusters.cluster_vectors(frame_of(spark, [])).count() == 0
    far = [(1, [1e300] + [0.0] * 63), (2, [0.0] * 64)]
    assert [r["vec_id"] for r in heap_clusters.cluster_vectors(frame_of(spark, far)).collect()] == [2]


# ---- op13 ----------------------------------------------------------------------------------------
def best_path(scores, cost):
    state = scores[0].copy()
    for row in scores[1:]:
        state = np.maximum(state, state.max() - cost) + row
    return state.max()


@pytest.mark.parametrize("k", [1, 2, 5])
def test_viterbi_finds_the_best_path(k):
    rng = np.random.default_rng(k)
    counts = np.array([0, 1, 5, 31, 32, 33, 64, 65, 500, 0, 3, 97])
    scores = rng.normal(0, 3, (counts.sum(), k))
    labels, at = languages.viterbi(scores, counts, 4.0), 0
    for n in counts:
        s, own = scores[at:at + n], labels[at:at + n]
        if n:
            assert abs(best_path(s, 4.0) - (s[np.arange(n), own].sum() - 4.0 * (own[1:] != own[:-1]).sum())) < 1e-9
        at += n


def test_ngrams_are_those_of_each_word():
    words = ["a", "bc", "straße", "x" * 50, "日本"]
    buckets, at = languages.ngrams(words)
    for i, w in enumerate(words):
        alone, _ = languages.ngrams([w])
        assert sorted(buckets[at == i]) == sorted(alone)
        ended = f" {w} "
        want = len(w) + sum(len(ended) - n + 1 for n in range(2, languages.LONGEST + 1) if len(ended) >= n)
        assert len(alone) == want


def prose(rng, kind, n):
    heads, tails = {"xx": ("ka to mi ra", "shi nu"), "yy": ("gr bl st ch", "ung eit"), "ru": ("пр ст ко во", "ать ние"), "uk": ("пр ст ко ві", "ати ння")}[kind]
    return " ".join("".join(rng.choice(heads.split()) for _ in range(rng.randint(1, 2))) + rng.choice(tails.split()) for _ in range(n))


@pytest.fixture(scope="module")
def language_rows():
    rng = random.Random(13)
    rows = [(i, prose(rng, kind, rng.randint(3, 200)), kind) for i, kind in ((i, ["xx", "yy", "ru", "uk"][i % 4]) for i in range(400))]
    rows += [(1000, None, "xx"), (1001, "", "yy"), (1002, " 12 ²½ ___ \U0001f600", None), (None, prose(rng, "yy", 9), None), (1004, prose(rng, "xx", 30000), None),
             (1005, prose(rng, "xx", 40) + ". " + prose(rng, "ru", 40) + "! " + prose(rng, "yy", 40), None), (1006, "日本語", None), (1007, "x" * 100000, None)]
    return rows + rows[:5]


def documents(spark, rows):
    return spark.createDataFrame([(*r, "s", "a", "b", 1.0) for r in rows],
                                 "doc_id long, text string, lang string, source string, bucket string, n string, score double").repartition(4)


def test_languages_of_held_out_texts(spark, language_rows):
    got = languages.identify_documents(documents(spark, language_rows))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score", "spans"]
    rows = got.collect()
    assert len(rows) == len(language_rows)
    want = {r[0]: r for r in language_rows}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        text = want[r["doc_id"]][1] or ""
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, text)))
        assert all(text[s["start"]:s["end"]].strip() for s in r["spans"])
        assert all(a["end"] < b["start"] and a["lang"] != b["lang"] for a, b in zip(r["spans"], r["spans"][1:]))
    held = [(r["lang_pred"], want[r["doc_id"]][2]) for r in rows if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 1000]
    assert len(held) > 60 and sum(a == b for a, b in held) >= 0.97 * len(held)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1004]["lang_pred"] == "xx" and by_id[None]["lang_pred"] == "yy"
    assert [s["lang"] for s in by_id[1005]["spans"] if s["end"] - s["start"] > 20] in (["xx", "ru", "yy"], ["xx", "uk", "yy"])


def test_scripts_narrow_the_languages(spark, language_rows):
    model = languages.fit(documents(spark, language_rows).filter("doc_id < 1000").select("lang", "text"))
    scores = languages.Scores(model)
    rows = scores.rows([["стать", "kashi"]])
    cyrillic, latin = (set(np.flatnonzero(scores.table[r] > -languages.CAP)) for r in rows)
    assert {model.names[i] for i in cyrillic} <= {"ru", "uk"} and {model.names[i] for i in latin} <= {"xx", "yy"}


def test_languages_learned_from_nothing(spark, language_rows):
    assert languages.identify_documents(documents(spark, [])).count() == 0
    none = languages.identify_documents(documents(spark, [(1, "some words", None), (2, None, "en"), (3, "123", "en")])).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}
    one = languages.identify_documents(documents(spark, [(i, "some words", "en") for i in range(9)])).collect()
    assert {r["lang_pred"] for r in one} == {"en"}
