import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attesta.llm import language_model as lm
from tests.llm.helpers import clashing, documents, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(lower), "\n"]


def is_held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def two_languages(n=160, seed=3):
    rng = random.Random(seed)
    kinds = [["".join(rng.choices(letters, k=rng.randint(2, 4))) for _ in range(60)] for letters in ("abcde", "vwxyz")]
    return [(i, " ".join(rng.choice([str.upper, str])(w) for w in rng.choices(kinds[i % 2], k=rng.randint(5, 60)))) for i in range(n)]


def network(words=150, seed=1):
    counts = np.random.default_rng(seed).integers(1, 50, words + lm.KINDS)
    net = lm.Network.started(counts)
    rng = np.random.default_rng(seed)
    for name, value in net.p.items():
        net.p[name] = (value + 0.3 * rng.normal(size=value.shape)).astype(np.float32)
    return net


def by_one_token_after_another(net, ids):
    """Natural log probability of one text, by a plain forward pass in double precision."""
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    h, total, before = lm.HIDDEN, 0.0, 0
    state = np.zeros(h)
    for token in ids:
        x = p["emb"][before] @ p["wx"] + p["bx"]
        inner = state @ p["u"]
        z, r = (1 / (1 + np.exp(-(x[a:b] + inner[a:b]))) for a, b in ((0, h), (h, 2 * h)))
        n = np.tanh(x[2 * h :] + r * inner[2 * h :])
        state = (1 - z) * state + z * n
        c = net.class_of[token]
        logits = state @ p["wc"] + p["bc"]
        total += logits[c] - np.log(np.exp(logits).sum())
        if token < net.words:
            members = np.flatnonzero(net.class_of[: net.words] == c)
            logits = {m: state @ p["wo"][m] + p["bo"][m] for m in members}
            total += logits[token] - np.log(np.exp(list(logits.values())).sum())
        before = token
    return total


def test_scores_equal_a_plain_forward_pass():
    net, rng = network(), np.random.default_rng(0)
    texts = [np.append(rng.integers(1, 150 + lm.KINDS, rng.integers(0, n)), 0) for n in (1, 5, 40, 400, 3, 70, 1, 33, 32, 31)]
    want = [by_one_token_after_another(net, t) for t in texts]
    assert np.allclose(net.text_scores(texts), want, rtol=1e-4, atol=1e-4)
    assert np.allclose([net.text_scores([t])[0] for t in texts], want, rtol=1e-4, atol=1e-4)
    assert len(net.text_scores([])) == 0


def test_few_lanes_carry_on(monkeypatch):
    net, rng = network(), np.random.default_rng(5)
    texts = [np.append(rng.integers(1, 150, rng.integers(0, 90)), 0) for _ in range(40)]
    want = net.text_scores(texts)
    monkeypatch.setattr(lm, "SCORE_LANES", 3)
    assert np.allclose(net.text_scores(texts), want, rtol=1e-4)


def test_probabilities_of_all_tokens_add_up_to_one():
    net = network()
    state = np.random.default_rng(2).normal(size=(1, lm.HIDDEN)).astype(np.float32)
    n = net.words + lm.KINDS
    logp, _ = net.log_probs(np.repeat(state, n, axis=0), np.arange(n))
    assert abs(np.exp(logp.astype(float)).sum() - 1) < 1e-4


def test_gradients():
    net = network(70)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(4)
    targets = rng.integers(0, 70 + lm.KINDS, (9, 5))
    seen = np.vstack((np.zeros((1, 5), int), targets[:-1]))
    seen[4, 2] = 0
    state = rng.normal(size=(5, lm.HIDDEN))
    _, grad, _ = net.gradients(seen, targets, state)
    for name, g in grad.items():
        for at in [np.unravel_index(np.argmax(np.abs(g)), g.shape), tuple(rng.integers(0, s) for s in g.shape)]:
            old, losses = net.p[name][at], []
            for step in (1e-5, -1e-5):
                net.p[name][at] = old + step
                losses.append(net.gradients(seen, targets, state)[0])
            net.p[name][at] = old
            assert abs((losses[0] - losses[1]) / 2e-5 - g[at]) < 1e-6 + 1e-4 * abs(g[at]), name


def base_scores(rows):
    learned = [t for i, t in rows if not is_held_out(i)]
    counts = Counter(w for t in learned for w in plain_tokens(t))
    n, v = sum(counts.values()), len(counts)
    return {(i, t): (len(plain_tokens(t)), sum(counts[w] > 0 for w in plain_tokens(t)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in plain_tokens(t))) for i, t in rows}


@pytest.mark.parametrize("head", [8, 131_072])
def test_counts_and_base_scores(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD_WORDS", head)
    monkeypatch.setattr(lm, "COUNTED", 50)
    monkeypatch.setattr(lm, "MOST_PASSES", 1)
    rows = two_languages() + [(None, "no id here abc"), (3, "again again"), (900, "x" * 200 + " " + "y" * 70), (901, "x" * 200)] + [(i and 1000 + i, t) for i, t in odd_rows() if t is None or len(t) < 500]
    docs = documents(spark, rows)
    found = lm.lm_scores(clashing(docs)).join(docs.select(F.col("doc_id").alias("d")).distinct(), F.col("doc_id") == F.col("d"), "left").drop("d")
    assert found.count() == len(rows)
    scored = lm.score(docs.select("doc_id", "text"), lm.fit(docs.where(~lm.held_out())), ("doc_id", "text")).collect()
    want = base_scores(rows)
    assert len(scored) == len(rows)
    for r in scored:
        tokens, known, n, base = want[r.doc_id, r.text]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n) and abs(r.base_score - base) < 1e-6 * abs(base) + 1e-9
        assert r.score < 0
    assert {(r.doc_id, r.held_out) for r in found.collect()} == {(i, is_held_out(i)) for i, _ in rows}


def test_whole_scores_are_those_of_tokens(spark):
    """score: the network's part and, for words of a kind, the share of their count, token by token."""
    rows = two_languages(60)
    docs = documents(spark, rows)
    lm_words, lm.MODEL_WORDS = lm.MODEL_WORDS, 20
    try:
        fitted = lm.fit(docs)
        assert fitted.network.words == 20
        number = {w: i for i, w in enumerate(fitted.words[:20])}
        counts = Counter(w for _, t in rows for w in lm.words_of(t))
        of_kind = np.ones(lm.KINDS)
        for w, n in counts.items():
            if w not in number:
                of_kind[lm.kind_of(w)] += n + 1
        test = [(1, rows[0][1]), (2, rows[1][1] + " never Seen words"), (3, "")]
        for r in lm.score(documents(spark, test), fitted, ("doc_id", "text")).collect():
            words = lm.words_of(r.text)
            ids = [*(number.get(w, 20 + lm.kind_of(w)) for w in words), 0]
            want = by_one_token_after_another(fitted.network, ids) / math.log(10)
            want += sum(math.log10((counts[w] + 1) / of_kind[lm.kind_of(w)]) for w in words if w not in number)
            assert abs(r.score - want) < 1e-3 + 1e-4 * abs(want)
    finally:
        lm.MODEL_WORDS = lm_words


def test_learns_what_words_follow(spark):
    rows = two_languages(500)
    found = lm.lm_scores(documents(spark, rows)).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert found[0] / found[2] > found[1] / found[2] + 0.2  # two languages of equal size: log10 2 is 0.30


def test_held_out_texts_change_nothing(spark):
    rows = two_languages(120)
    other = [(i, "quite other words" if is_held_out(i) else t) for i, t in rows]
    one, two = (sorted((r.doc_id, r.base_score, r.score) for r in lm.lm_scores(documents(spark, x).coalesce(1)).where("not held_out").collect()) for x in (rows, other))
    assert np.allclose(one, two, rtol=1e-6)  # products of matrices of another shape differ in the last digits
    one, two = (lm.fit(documents(spark, x).coalesce(1).where(~lm.held_out())).network.flat() for x in (rows, other))
    assert (one == two).all()


def test_parts_are_averaged_alike_in_any_layout(spark, monkeypatch):
    monkeypatch.setattr(lm, "PART_TOKENS", 300)
    monkeypatch.setattr(lm, "MOST_PASSES", 2)
    docs = documents(spark, two_languages(200))
    one = lm.fit(docs).network.flat()
    assert np.isfinite(one).all() and (one != lm.fit(docs, rounds=0).network.flat()).any()


def test_of_odd_tables(spark):
    none = documents(spark, [])
    assert lm.lm_scores(none).count() == 0
    unlearned = lm.score(documents(spark, odd_rows()), lm.fit(none)).collect()
    assert len(unlearned) == len(odd_rows()) and {r.base_score for r in unlearned} == {0.0} and {r.train_tokens for r in unlearned} == {0}
    found = lm.lm_scores(clashing(documents(spark, odd_rows())))
    assert found.count() == len(odd_rows()) and {r.n_tokens for r in found.where("doc_id < 4").collect()} == {1}
    long_text = max((t or "" for _, t in odd_rows()), key=len)
    assert {r.n_tokens for r in found.where("doc_id in (5, 6)").collect()} == {len(long_text.split()) + 1}


def test_kind_in_spark(spark):
    words = [b"a", b"ab", b"abc", "é".encode(), b"\n", b"x" * 100]
    df = spark.createDataFrame([(w,) for w in words], "word binary").select("word", lm.kind_column().alias("k"))
    assert all(r.k == lm.kind_of(bytes(r.word)) for r in df.collect())


def test_threshold_keeps_the_head_small(spark):
    rng = random.Random(1)
    rows = [(f"w{i}".encode(), rng.choice([1, 1, 1, 2, 3, 17, 18, 40, 1000, 10**12])) for i in range(300)] + [(b"z" * 70, 10**15)]
    counts = spark.createDataFrame(rows, "word binary, n long")
    for most in (1, 10, 50, 150, 299, 300, 1000):
        least = lm.head_threshold(counts, most)
        inside = sum(n >= least and len(w) <= lm.HEAD_BYTES for w, n in rows)
        assert inside <= most
    assert lm.head_threshold(counts.limit(0), 5) == 1


def test_the_network_learns_from_every_document(spark, monkeypatch):
    """Words in another order leave all counts alone, but not the network, whatever document they stand in."""
    monkeypatch.setattr(lm, "LEAST", 1)
    rows = two_languages(40, seed=9)

    def flat(turned=None):
        texts = [(i, " ".join(reversed(t.split())) if i == turned else t) for i, t in rows]
        return lm.fit(documents(spark, texts).coalesce(1), rounds=1).network.flat()

    whole = flat()
    assert all((flat(i) != whole).any() for i in (0, 7, 15, 22, 39))


@pytest.mark.parametrize("n", [1, 31, 129, 4 * lm.WINDOW * 3 + 2, 4 * lm.WINDOW * 7 - 1])
def test_no_token_is_left_out_of_training(monkeypatch, n):
    net, seen = network(), []
    gradients = lm.Network.gradients
    monkeypatch.setattr(lm.Network, "gradients", lambda self, a, b, state: seen.append(b) or gradients(self, a, b, state))
    net.train(np.arange(n) % 150, 0.01)
    found = Counter(np.concatenate([x.ravel() for x in seen]).tolist())
    assert not Counter((np.arange(n) % 150).tolist()) - found and sum(found.values()) < n + lm.TRAIN_LANES


def test_words_of_many_texts_at_once():
    """Arrow's splitting and numbering equal those word by word."""
    rng = random.Random(6)
    texts = [None, "", " ", "\t\n\x0b\x0c\r ", "a", "  A b\x1cc \x85d\xa0É x\x00y  ", *("".join(rng.choices(" \t\n\x0b\x0c\r\x1c\x1f\x85\xa0aBÉ日\x00", k=rng.randint(0, 30))) for _ in range(500))]
    for column in (pa.array(texts, pa.string()), pa.array(texts, pa.string()).slice(3, 90)):
        want = [lm.words_of(t) for t in column.to_pylist()]
        words, sizes = lm.split_words(column)
        assert words.cast(pa.binary()).to_pylist() == [w for x in want for w in x] and sizes.tolist() == [len(x) for x in want]
        assert lm.kinds_of(words).tolist() == [lm.kind_of(w) for x in want for w in x]
        head, number = lm.numbered([lm.END, b"a", b"\xc3\x89", b"b"], 2)
        places, numbers, starts, rarer = lm.token_ids(column, head, number, 2)
        place = {b"a": 1, b"\xc3\x89": 2, b"b": 3}
        assert places.tolist() == [p for x in want for p in (*(place.get(w, -1) for w in x), 0)]
        assert numbers.tolist() == [p for x in want for p in (*(1 if w == b"a" else 2 + lm.kind_of(w) for w in x), 0)]
        assert starts.tolist() == np.cumsum([0, *(len(x) + 1 for x in want)]).tolist() and rarer.cast(pa.binary()).to_pylist() == [w for x in want for w in x if w not in place]
    assert lm.split_words(pa.array([], pa.string()))[1].tolist() == []


@pytest.mark.parametrize("apart", [1, 50, 300])
def test_log_probs_of_logits_far_apart(apart):
    net, rng = network(), np.random.default_rng(3)
    net.p["bc"], net.p["bo"] = ((apart * rng.normal(size=net.p[k].shape)).astype(np.float32) for k in ("bc", "bo"))
    targets = rng.integers(0, 150 + lm.KINDS, 5000)  # more rows than are predicted at once
    states = rng.normal(size=(5000, lm.HIDDEN)).astype(np.float32)
    found, _ = net.log_probs(states, targets)
    p, want = {k: v.astype(np.float64) for k, v in net.p.items()}, []
    for state, token in zip(states[::50].astype(np.float64), targets[::50], strict=True):
        c, own = state @ p["wc"] + p["bc"], 0.0
        if token < net.words:
            members = np.flatnonzero(net.class_of[: net.words] == net.class_of[token])
            w = p["wo"][members] @ state + p["bo"][members]
            own = w[members == token][0] - np.logaddexp.reduce(w)
        want.append(c[net.class_of[token]] - np.logaddexp.reduce(c) + own)
    assert np.allclose(found[::50], want, rtol=1e-4, atol=1e-3)
