import random
import zlib

import numpy as np

from attesta.llm import quality, toxicity
from tests.llm.helpers import clashing, documents, odd_rows


def out_of_sample(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def labelled(n=400):
    """Clean prose, prose with insults (of a family of prefixes) and shouted junk."""
    rng = random.Random(8)
    words = ["".join(rng.choices(["an", "er", "th", "io", "es", "to"], k=rng.randint(1, 4))) for _ in range(600)]
    rows, labels = [], []
    for i in range(n):
        text = rng.choices(words, k=rng.randint(20, 120))
        kind = i % 4
        if kind == 1:
            for _ in range(4):
                text[rng.randrange(len(text))] = rng.choice(["idiot", "scum", "trash"]) if rng.random() < 0.7 else "zoqu" + rng.choice(words)
        if kind == 2:
            text = [w.upper() + "!!" for w in text]
        rows.append((i, " ".join(text)))
        labels.append((i, 0 if kind == 2 else 1, int(kind == 1)))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_quality_on_held_out_rows(spark):
    rows, labels = labelled()
    docs, marks = clashing(documents(spark, rows)), spark.createDataFrame(labels, LABELS)
    found = {r.doc_id: r for r in quality.score_quality(docs, quality.graded(marks)).collect()}
    test = [i for i, *_ in labels if out_of_sample(i)]
    assert np.mean([found[i].keep == bool(labels[i][1]) for i in test]) > 0.97
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in found.values())
    junk, clean = (np.mean([found[i].expected_grade for i in test if i % 4 == k]) for k in (2, 0))
    assert junk + 1 < clean


def test_quality_never_learns_from_held_out_rows(spark):
    rows, labels = labelled(80)
    turned = [(i, 1 - q if out_of_sample(i) else q, 1 - t if out_of_sample(i) else t) for i, q, t in labels]
    docs = documents(spark, rows)
    one, two = (sorted(quality.score_quality(docs, quality.graded(spark.createDataFrame(x, LABELS))).select("doc_id", "expected_grade").collect()) for x in (labels, turned))
    assert one == two


def test_ordinal_gradient_and_order():
    rng = np.random.default_rng(1)
    rows = [(np.array([g, 10 + int(rng.integers(5))], np.int32), np.array([1, 1], np.float32)) for g in (0, 1, 2, 3) for _ in range(60)]
    grades = np.repeat([0, 1, 2, 3], 60)
    model = quality.OrdinalModel.fit(rows, grades)
    assert (np.diff(model.thresholds) > 0).all()
    tails = model.tails(np.array([sum(model.weights[b] * v for b, v in zip(*r, strict=True)) for r in rows]))
    assert (np.diff(tails, axis=1) <= 0).all() and np.mean(tails.sum(axis=1).round() == grades) > 0.95


def test_quality_of_odd_tables(spark):
    marks = spark.createDataFrame([(5, 1, 0), (5, 0, 1), (None, 1, 0), (7, None, None)], LABELS)
    docs = clashing(documents(spark, odd_rows()))
    found = quality.score_quality(docs, quality.graded(marks))
    assert found.where("keep").count() >= 0 and found.count() == len(odd_rows())
    assert quality.score_quality(docs, quality.graded(marks.limit(0))).where("keep").count() == len(odd_rows())
    assert quality.score_quality(documents(spark, []), quality.graded(marks)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    rows, labels = labelled()
    long_toxic = " ".join(["and there was"] * 3000 + ["you idiot scum trash idiot"] + ["and there was"] * 3000)
    rows += [(9001, long_toxic), (9002, " ".join(["and there was"] * 6000))]
    docs, marks = clashing(documents(spark, rows)), spark.createDataFrame(labels, LABELS)
    found = {r.doc_id: r for r in toxicity.score_toxicity(docs, marks).collect()}
    test = [i for i, q, _ in labels if out_of_sample(i) and q]
    assert np.mean([found[i].predicted == labels[i][2] for i in test]) > 0.9
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in found.values())
    assert found[9001].score > found[9002].score


def test_toxicity_of_odd_tables(spark):
    rows, labels = labelled(60)
    marks = spark.createDataFrame([*labels, (5, 1, None), (None, 1, 1)], LABELS)
    docs = clashing(documents(spark, rows + odd_rows()))
    found = toxicity.score_toxicity(docs, marks).collect()
    assert len(found) == len(rows) + len(odd_rows())
    assert all(r.score == 0 for r in found if not (r.text or "").strip())
    assert {r.score for r in toxicity.score_toxicity(docs, marks.limit(0)).collect()} == {0.0}
    assert toxicity.score_toxicity(documents(spark, []), marks).count() == 0


def test_windows_cover_the_whole_text():
    starts, sizes, text = toxicity.windows_of([5, 0, 24, 25, 100])
    for i, (base, n) in enumerate(((0, 5), (5, 0), (5, 24), (29, 25), (54, 100))):
        covered = {w - base for s, k, t in zip(starts, sizes, text, strict=True) if t == i for w in range(s, s + k)}
        assert covered == set(range(n))


def test_network_gradients():
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts = [["ab", "cde", "f"] * 10, ["zz", "cde"], ["q"] * 30]
    distinct = ["", *sorted({w for t in texts for w in t})]
    words, live, doc = toxicity.batch_of(texts, {w: i for i, w in enumerate(distinct)})
    args = (toxicity.letters(distinct), np.array([toxicity.word_bucket(w) for w in distinct]), words, live.astype(float), doc, 3, np.array([1, 0, 1], bool))
    _, grad = net.gradients(*args)
    for name, g in grad.items():
        at, value = np.unravel_index(np.argmax(np.abs(g)), g.shape), net.p[name]
        old, losses = value[at], []
        for step in (1e-3, -1e-3):
            value[at] = old + step
            losses.append(net.gradients(*args)[0])
        value[at] = old
        # soft weights of windows are held constant in the gradient, so allow a small difference
        assert abs((losses[0] - losses[1]) / 2e-3 - g[at]) < 0.02 * abs(g[at]) + 2e-3, name
