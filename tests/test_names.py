"""The exact name joins against all pairs."""

import math
import random
from collections import Counter
from difflib import SequenceMatcher

import pytest

from attesta.operators import names


def similarity(a, b, letters=True):
    words = len(a & b) / len(a | b)
    return max(words, SequenceMatcher(None, " ".join(sorted(a)), " ".join(sorted(b))).ratio() * 0.9) if letters else words


def made_up(n, seed):
    """Names of one to five words; many are others' with letters changed, put before, left out, or words moved."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["pho", "ton", "ics", "en", "er", "gy", "da", "iry", "x", "mar", "ket", "lo", "gis", "tic"]) for _ in range(rng.randint(1, 4)))
    out = [["photonics"], ["xphotonics"], ["energy"], ["qenergy", "energy"]]
    while len(out) < n:
        if rng.random() < 0.5:
            out.append([word() for _ in range(rng.randint(1, 5))])
        else:
            base = list(rng.choice(out))
            i = rng.randrange(len(base))
            w = base[i]
            k = rng.randrange(len(w))
            base[i] = rng.choice([w[:k] + rng.choice("aeiouz") + w[k:], w[:k] + w[k + 1 :] or w, rng.choice("xyz") + w, w[::-1]])
            out.append(base)
    return [sorted(set(x)) for x in out]


@pytest.mark.parametrize("least", [0.7, 0.5])
def test_finds_every_pair(spark, monkeypatch, least):
    monkeypatch.setattr(names, "CELL", 90)  # the hot place is dealt out
    every = made_up(2000, 11)
    rng = random.Random(3)
    place = ["hot" if rng.random() < 0.35 else f"p{rng.randrange(40)}" for _ in every]
    rows = [(place[i], x) for i, x in enumerate(every)] + [(None, ["a", "b"]), ("p1", []), ("hot", every[0])]
    a, b = ([r for i, r in enumerate(rows) if i % 2 == k] for k in (0, 1))
    frame = lambda s: spark.createDataFrame(s, "key string, tokens array<string>")
    found = {(r.key, r.a_n, r.b_n): r.alike for r in names.similar_names(frame(a), frame(b), least).collect()}
    want = {}
    distinct = [{(k, tuple(t)) for k, t in s if k and t} for s in (a, b)]
    for ka, ta in distinct[0]:
        for kb, tb in distinct[1]:
            if ka == kb and abs(len(" ".join(ta)) - len(" ".join(tb))) < 80:
                x = similarity(set(ta), set(tb))
                if x >= least:
                    want[ka, " ".join(ta), " ".join(tb)] = x
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)
    words = names.similar_names(frame(a), frame(b), least, letters=False).collect()
    only = {k for k in want if similarity(set(k[1].split()), set(k[2].split()), False) >= least}
    assert {(r.key, r.a_n, r.b_n) for r in words} == only and len(words) == len(only)


def test_names_that_begin_differently(spark):
    frame = lambda *t: spark.createDataFrame([("berlin", list(t))], "key string, tokens array<string>")
    assert [r.alike > 0.85 for r in names.similar_names(frame("photonics"), frame("xphotonics"), 0.7).collect()] == [True]
    assert names.similar_names(frame("photonics"), frame("xphotonics"), 0.95).count() == 0


@pytest.mark.parametrize("least", [0.2, 0.5, 0.9])
def test_rare_word_pairs(spark, least):
    every = made_up(300, 5)
    rows = [(i, x) for i, x in enumerate(every)] + [(900, []), (None, ["a"]), (901, every[3]), (902, every[4] + every[4][:1])]
    a, b = ([r for r in rows if r[0] is None or r[0] % 2 == k] for k in (0, 1))
    frame = lambda s: spark.createDataFrame(s, "id long, tokens array<string>")
    found = {(r.a_id, r.b_id): r.cosine for r in names.rare_word_pairs(frame(a), frame(b), least).collect()}
    kept = [[(i, sorted(set(t))) for i, t in s if i is not None and t] for s in (a, b)]
    df = Counter(w for s in kept for _, t in s for w in t)
    n = sum(map(len, kept))
    vector = lambda t: {w: math.log(1 + n / df[w]) for w in t}
    want = {}
    for i, t in kept[0]:
        for j, u in kept[1]:
            x, y = vector(t), vector(u)
            c = sum(x[w] * y[w] for w in x if w in y) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
            if c >= least:
                want[i, j] = c
    near = {k for k, c in want.items() if c < least + 1e-9}
    assert found.keys() | near == want.keys() | near and all(abs(found[k] - want[k]) < 1e-9 for k in found)


def test_pairs_of_a_common_word_are_not_shuffled(spark, monkeypatch):
    from bench import shuffle_bytes

    rows = [(i, ["common"] + [f"w{i}x{k}" for k in range(7)]) for i in range(600)] + [(i, ["twin", "other"]) for i in range(600, 640)]
    frame = spark.createDataFrame(rows, "id long, tokens array<string>")
    monkeypatch.setattr(names, "CELL", 100)  # the common word is dealt out
    monkeypatch.setattr(names, "LISTED", 7, raising=False)  # and so are the equal names
    before = shuffle_bytes(spark)
    found = [(r.a_id, r.b_id) for r in names.rare_word_pairs(frame, frame, 0.03).collect()]
    assert shuffle_bytes(spark) - before < 2_000_000  # 360,000 pairs meet by the common word, and none is alike
    assert sorted(found) == sorted([(i, i) for i in range(600)] + [(i, j) for i in range(600, 640) for j in range(600, 640)])
