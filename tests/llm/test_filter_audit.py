import random
import re
from itertools import permutations

import numpy as np
import pytest

from attesta.llm import filter_audit
from tests.llm.helpers import clashing, documents, odd_rows

LABELS = "doc_id long, quality int, toxic int"
WHITE = re.compile(r"[^\x20\x09-\x0D]+")


def fails(rows, i):
    """Failing letters of row i of (doc_id, text, part), by the plain rule."""
    doc_id, text, _ = rows[i]
    text = text or ""
    words = WHITE.findall(text)
    found = {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
        "D": re.search(r"[#$%&*|]", text) is not None,
        "E": doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in rows),
    }
    return {f for f, bad in found.items() if bad}


def by_running_each_order(rows, labels):
    failing = [fails(rows, i) for i in range(len(rows))]
    good, toxic = ({d for d, *marks in labels if d is not None and marks[k] == 1} for k in (0, 1))
    out = {}
    for part in {p or "" for _, _, p in rows}:
        own = [i for i, (_, _, p) in enumerate(rows) if (p or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [i for i in left if f in failing[i]]
                shapley[f] += len(gone)
                redundant = sum(f in failing[i] for i in own if i not in left)
                left = [i for i in left if f not in failing[i]]
                unique = sum(failing[i] == {f} for i in own)
                out[part, order, step] = [len(left), len(gone), redundant, unique, sum(rows[i][0] in good for i in gone), sum(rows[i][0] in toxic for i in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def rows_and_labels(n=90):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefg", k=rng.randint(2, 7))) for _ in range(500)]
    rows = []
    for i in range(n):
        text = rng.choices(words[: rng.choice([40, 500])], k=rng.choice([20, 199, 200, 260]))
        if rng.random() < 0.3:
            text = [w.title() for w in text]
        if rng.random() < 0.2:
            text[3] += rng.choice("#$%&*|")
        rows.append((i, "\x0b".join(text) if rng.random() < 0.1 else " ".join(text), rng.choice(["a", "b", None])))
    rows += [(200 + i, rows[rng.randrange(n)][1], rng.choice(["a", "c"])) for i in range(20)]
    rows += [(300 + i, t, "odd") for i, (_, t) in enumerate(odd_rows())] + [(None, rows[0][1], "a"), (0, rows[0][1], "a")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 320, 2)] + [(4, 1, 1), (None, 1, 1)]
    return rows, labels


def collected(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


@pytest.mark.parametrize("partitions", [1, 7])
def test_equals_running_each_order(spark, partitions):
    rows, labels = rows_and_labels()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(partitions)
    found = filter_audit.audit(clashing(docs), spark.createDataFrame(labels, LABELS))
    want = by_running_each_order(rows, labels)
    assert found.count() == len(want) and collected(found) == want


def test_many_parts_and_a_changed_part_column(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD_PARTS", 3)
    monkeypatch.setattr(filter_audit, "SLICE", 5)
    rows, labels = rows_and_labels(40)
    rows = [(d, t, f"p{k % 11}") for k, (d, t, _) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, body string, host string").coalesce(1)
    assert collected(filter_audit.audit(docs, spark.createDataFrame(labels, LABELS), "host", "body")) == by_running_each_order(rows, labels)


def test_of_odd_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(documents(spark, []), none).count() == 0
    found = collected(filter_audit.audit(clashing(documents(spark, odd_rows())), none))
    assert len(found) == 600 and all(row[4:6] == [0, 0] for row in found.values())
    assert found == by_running_each_order([(d, t, "s") for d, t in odd_rows()], [])


def test_pieces_of_a_long_text(monkeypatch):
    text = " ".join(f"w{i % 90}" for i in range(300)).encode() + b"\t" * 50
    whole = filter_audit.own_failures(text, len(text))
    monkeypatch.setattr(filter_audit, "PIECE", 17)
    assert filter_audit.own_failures(text, len(text)) == whole
    assert [w for part in filter_audit.words_in(text) for w in part] == text.split()


def test_table_of_first_failures():
    for mask in range(32):
        for k, order in enumerate(filter_audit.ORDERS):
            steps = [s for s, f in enumerate(order) if mask >> "ABCDE".index(f) & 1]
            assert filter_audit.FIRST[mask, k] == (steps[0] if steps else 5)
    assert np.shape(filter_audit.FIRST) == (32, 120)
