import random

import numpy as np
import pytest

from attesta.llm import substring
from tests.llm.helpers import clashing, documents, odd_rows


def prose(n, seed):
    rng = random.Random(seed)
    return [f"w{rng.randint(0, 400)}" for _ in range(n)]


def test_compact_windows_cover_every_passage_once():
    values = np.array([random.Random(k).randint(0, 9) for k in range(60)], np.uint64)
    values = substring.spread(values, 1)
    windows = substring.compact_windows(values, 8)
    for i in range(60):
        for j in range(i + 7, 60):
            holding = [(l, c, r) for l, c, r in windows if l <= i <= c <= j <= r]
            assert len(holding) == 1 and values[holding[0][1]] == values[i : j + 1].min()
    assert len(substring.compact_windows(substring.spread(np.zeros(100_000, np.uint64), 1), 46)) < 10_000


def test_run_hashes_follow_words():
    assert (substring.run_hashes("One  two\nthree FOUR five six", 5) == substring.run_hashes("one two three four five six", 5)).all()
    a, b = substring.run_hashes("a b c d e f g", 2), substring.run_hashes("x c d y", 2)
    assert a[2] == b[1] and len(set(a.tolist())) == 6


def brute(rows, least):
    """Pairs of documents that share a run of `least` words."""
    seen, pairs = {}, set()
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        words = (text or "").lower().split()
        for k in range(len(words) - least + 1):
            first = seen.setdefault(tuple(words[k : k + least]), i)
            if first != i:
                pairs.add((i, first))
    return pairs


def cases():
    passage, other = prose(51, "p"), prose(70, "o")
    near = list(passage * 1)
    near[25] = "changed"
    rows = [(k, " ".join(prose(random.Random(k).randint(1, 300), k))) for k in range(40)]
    for k in range(100, 130):
        rows.append((k, " ".join(prose(k, k) + passage + prose(80, -k))))
    rows += [(200, " ".join(prose(90, "a") + other + prose(10, "b"))), (201, " ".join(other)), (202, " ".join(prose(60, "c") + near))]
    rows += [(300 + k, " ".join(prose(120, "copy"))) for k in range(5)] + [(400, " ".join(prose(49, "short"))), (401, " ".join(prose(49, "short") + prose(60, "d")))]
    return rows


def test_finds_planted_passages_and_nothing_else(spark):
    rows = cases() + [(None if i is None else i + 5000, t) for i, t in odd_rows()]
    found = substring.repeats(clashing(documents(spark, rows))).collect()
    pairs = {(r.doc_id, r.first_id) for r in found}
    assert {i for i, _ in brute(rows, 50)} | {202} == {i for i, _ in pairs} and all(f < i for i, f in pairs)
    text = {}
    for i, t in rows:
        text.setdefault(i, t)
    for r in found:
        a, b = text[r.doc_id].lower().split()[r.start : r.end], text[r.first_id].lower().split()[r.first_start : r.first_end]
        s, t = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a, b))
        assert len(a) >= 50 and len(s & t) >= 0.8 * len(s | t)


def test_drop_repeats_keeps_the_first(spark):
    docs = clashing(documents(spark, cases() + [(None if i is None else i + 5000, t) for i, t in odd_rows()]))
    kept = substring.drop_repeats(docs)
    assert kept.columns == docs.columns
    left = kept.collect()
    passage = " ".join(prose(51, "p"))
    assert [r.doc_id for r in left if r.text and passage in r.text] == [100]
    assert {r.doc_id for r in left} >= set(range(40)) and 301 not in {r.doc_id for r in left} and 300 in {r.doc_id for r in left}
    plain = dict(r for r in cases() if r[0] < 40)
    assert all(r.text == plain[r.doc_id] for r in left if r.doc_id in plain)
    assert all(r.n_chars == len(r.text) for r in left if r.text and r.n_chars is not None)
    assert sum(r.doc_id is None for r in left) == 1


def test_empty_table(spark):
    assert substring.repeats(documents(spark, [])).count() == 0
    assert substring.drop_repeats(documents(spark, [])).count() == 0


def test_first_document_is_found_in_any_order(spark):
    passage = " ".join(prose(60, "q"))
    rows = [(9, "x " + passage), (5, "y " + passage), (7, "x " + passage), (3, "x " + passage), (8, passage + " z"), (4, "w " + passage)]
    for order in (rows, rows[::-1]):
        found = {(r.doc_id, r.first_id) for r in substring.repeats(documents(spark, order).coalesce(1)).collect()}
        assert {i for i, _ in found} == {9, 5, 7, 8, 4} and {f for _, f in found} == {3}


def test_every_equal_run_of_a_linked_pair_is_covered():
    line, other = prose(70, "line"), prose(55, "second")
    first = prose(30, 1) + line * 3 + prose(20, 2) + other + prose(9, 3)
    text = other + prose(40, 4) + line * 2 + prose(33, 5) + other
    found = substring.passages(" ".join(first), " ".join(text), [(5, text.index(other[0]) + 5)])
    runs = {tuple(first[k : k + 50]) for k in range(len(first) - 49)}
    for p in range(len(text) - 49):
        if tuple(text[p : p + 50]) in runs:
            assert any(s <= p and p + 50 <= e for s, e, *_ in found)


def test_edited_passages_are_found_from_every_seed():
    for edits, n in (((30,), 60), ((20, 30), 100), ((70, 80), 101), ((40, 50, 90), 140)):
        passage = prose(n, n)
        edited = [f"new{k}" if k in edits else w for k, w in enumerate(passage)]
        first, text = prose(90, 1) + passage + prose(80, 2), prose(70, 3) + edited + prose(60, 4)
        for at in range(n - 4):
            if edited[at : at + 5] == passage[at : at + 5]:
                found = substring.passages(" ".join(first), " ".join(text), [(70 + at, 90 + at)])
                assert any(s <= 70 and 70 + n <= e for s, e, *_ in found), (edits, at)


def test_passages_are_found_when_the_first_holder_has_only_a_part(spark):
    """Documents that share a passage meet though an earlier one with much of it fails against both."""
    passage = prose(52, "whole")
    for edits in ((12, 25, 38, 47), (20, 26), (3, 48)):
        part = [f"new{k}" if k in edits else w for k, w in enumerate(passage)]
        rows = [(1, " ".join(prose(70, 1) + part + prose(60, 2))), (2, " ".join(prose(80, 3) + passage + prose(50, 4))), (3, " ".join(prose(65, 5) + passage + prose(75, 6)))]
        found = {(r.doc_id, r.end - r.start) for r in substring.repeats(documents(spark, rows)).collect() if r.first_id == 2}
        assert any(i == 3 and n >= 52 for i, n in found), edits


def test_lines_that_many_share_hide_no_passage(spark):
    line = prose(30, "licence")
    passages = [line[10:] + prose(30, f"after{k}") for k in range(3)] + [prose(30, f"before{k}") + line[:22] for k in range(3)]
    rows = [(k, " ".join(prose(60, f"l{k}") + line + prose(60, f"r{k}"))) for k in range(60)]
    for n, p in enumerate(passages * 2):
        rows.append((100 + n, " ".join(prose(40, f"a{n}") + (line[:10] + p if n % 6 < 3 else p + line[22:]) + prose(45, f"b{n}"))))
    found = substring.repeats(documents(spark, rows)).collect()
    assert {(r.doc_id, r.first_id) for r in found} == {(106 + n, 100 + n) for n in range(6)}


def test_recall_of_edited_passages(spark):
    """Passages of 100 words with two words changed (similarity 0.81 and more) are found in 0.9 of all cases."""
    rng, rows = random.Random(77), []
    for k in range(150):
        passage = prose(100, 5000 + k)
        edited = list(passage)
        for at in rng.sample(range(6, 94), 2):
            edited[at] = f"new{k}x{at}"
        rows += [(k, " ".join(prose(60, 6000 + k) + passage + prose(60, 7000 + k))), (1000 + k, " ".join(prose(50, 8000 + k) + edited + prose(50, 9000 + k)))]
    found = {r.doc_id - 1000 for r in substring.repeats(documents(spark, rows)).collect() if r.first_id == r.doc_id - 1000}
    assert len(found) >= 135


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_a_passage_has_one_row_with_its_first_holder(spark, partitions):
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(60)]
    own = lambda i: [f"d{i}x{rng.randrange(10**6)}" for _ in range(rng.randint(5, 40))]
    rows = [(i, " ".join(own(i) + passage + own(i))) for i in range(1, 25)]
    found = substring.repeats(documents(spark, rows).repartition(partitions)).collect()
    assert len(found) == 23 and {r.first_id for r in found} == {1} and {r.end - r.start for r in found} == {60}


def test_places_are_hashed_once_for_all_texts(monkeypatch):
    seeds, mixed = [], substring.mixed
    monkeypatch.setattr(substring, "mixed", lambda x, seed=0: seeds.append(seed) or mixed(x, seed))
    for n in (1, 7, 700, 701, 90, 3000, 0):
        values = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
        for seed in (1, 2, 3):
            want = mixed(values, seed) & ~np.uint64(0xFFFFF) | mixed(np.arange(n, dtype=np.uint64), 99) >> np.uint64(44)
            assert (substring.spread(values, seed) == want).all()
    assert seeds.count(99) <= 4
