import hashlib
import random
import re

import pytest

from attesta.llm import decontaminate
from tests.llm.helpers import clashing, documents, odd_rows

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, items, size):
    found = []
    for i, text in rows:
        words, hit, names = WORD.findall(lower(text)), set(), set()
        for name, item in items:
            w = WORD.findall(lower(item))
            for k in range(max(1, len(w) - size + 1)) if w else ():
                part = w[k : k + size]
                for at in range(len(words) - len(part) + 1):
                    if words[at : at + len(part)] == part:
                        hit |= set(range(at, at + len(part)))
                        names.add(str(name))
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        found.append((str(i), len(words), len(hit), len(names), sha, bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(found)


def cases():
    random.seed(9)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "Straße", "日本"]
    items = [(i, " ".join(random.choices(vocabulary, k=random.choice([1, 5, 13, 20, 40])))) for i in range(3, 25)] + [(100, None), (101, ""), (102, "!!")]
    rows = [r for r in odd_rows() if len(r[1] or "") < 1000]
    for k in range(60):
        words = random.choices(vocabulary, k=random.randint(1, 120))
        if k % 2:
            at = random.randrange(len(words))
            words[at:at] = (random.choice(items)[1] or "").split()
        rows.append((1000 + k, random.choice([" ", ", ", "\n"]).join(words).upper() if k % 3 else " ".join(words)))
    return rows, items


@pytest.mark.parametrize("block_windows", [1_000_000, 40])
def test_equals_brute_force(spark, block_windows, monkeypatch):
    rows, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    hits = decontaminate.benchmark_hits
    monkeypatch.setattr(decontaminate, "benchmark_hits", lambda d, b, s: hits(d, b, s, block_windows))
    found = decontaminate.contamination(clashing(documents(spark, rows)), bench, 13)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()) == brute(rows, items, 13)


def test_removal(spark):
    item = " ".join(f"b{i}" for i in range(20))
    rows = [(1, "Start, " + item.upper() + "! End."), (2, "clean text"), (3, " ".join(f"c{i}" for i in range(900)) + " " + item), (4, None)]
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    docs = clashing(documents(spark, rows))
    kept = decontaminate.decontaminate(docs, bench)
    own = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4] and kept.schema == docs.schema
    assert all(r[c] == "x" for r in kept.collect() for c in own)
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, remove="spans").collect()}
    assert cut[1].split() == ["Start,", "End."] and cut[2] == "clean text" and "b5" not in cut[3] and cut[4] is None
    assert decontaminate.contamination(documents(spark, []), bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_items_without_id_are_hit_but_not_named(spark):
    item = " ".join(f"b{i}" for i in range(20))
    bench = spark.createDataFrame([(None, item), (7, "other words")], "item_id long, text string")
    (row,) = decontaminate.contamination(documents(spark, [(1, item)]), bench).collect()
    assert (row.n_hit, row.n_items, row.items_sha256, row.contaminated) == (20, 0, hashlib.sha256(b"").hexdigest(), True)
