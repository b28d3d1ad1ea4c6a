import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attesta.llm import fim
from tests.llm.helpers import clashing, documents, odd_rows

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = st.text(alphabet=st.sampled_from(list(" \t\n\x0b\x0c\r<>PSMaé語😀\x1c\x85\xa0")), max_size=40)


def by_units(text, doc_id):
    text, units = text or "", UNIT.findall(text or "")
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return text, "plain", n, None, None
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return f"<S>{suffix}<P>{prefix}<M>{middle}", "spm", n, len(prefix), len(middle)
    return f"<P>{prefix}<S>{suffix}<M>{middle}", "psm", n, len(prefix), len(middle)


@settings(max_examples=600, deadline=None)
@given(TEXTS, st.integers(-5, 10**9))
def test_equals_cutting_units(text, doc_id):
    assert fim.transformed(text, doc_id) == by_units(text, doc_id)
    output, form, *_ = fim.transformed(text, doc_id)
    assert fim.restored(output, form) == text


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_unit_ends(text):
    white, _ = fim.events(text)
    assert fim.unit_ends(white, len(text)).tolist() == [m.end() for m in UNIT.finditer(text)]


def test_outputs_of_another_form_are_refused():
    assert fim.restored("<P>a<S>b<M>c", "psm") == "acb"
    for output, form in (("a<P>b<S>c<M>d", "psm"), ("<S>a<P>b", "spm"), ("<P>a<S>b<M>c", "spm"), ("<P>a<S>b<M>c<M>", "psm"), ("abc", "other")):
        assert fim.restored(output, form) is None
    assert fim.restored(None, "plain") is None and fim.restored("abc", "plain") == "abc"


@pytest.mark.parametrize("partitions", [1, 5])
def test_tables(spark, partitions):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices(["word", " ", "\n\t", "<", "P>", "é"], k=rng.randint(0, 60)))) for i in range(200)] + odd_rows()
    docs = documents(spark, rows)
    found = fim.fim_transform(clashing(docs).repartition(partitions))
    kept = sorted((r.doc_id is None, r.doc_id, r.text or "", r.fim, r.form, r.n, r.prefix_chars, r.middle_chars) for r in found.collect())
    want = sorted(((i is None, i, t or "", *by_units(t, i)) for i, t in rows))
    assert kept == want
    assert {c for c in clashing(docs).columns if c not in fim.ADDED} <= set(found.columns)
    back = fim.fim_restore(found)
    assert all(r.restored == (r.text or "") for r in back.select("text", "restored").collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    digests = {(r.doc_id, r.output_sha256, r.restored_sha256) for r in fim.fim_digest(clashing(docs)).collect()}
    assert digests == {(i, sha(by_units(t, i)[0]), sha(t or "")) for i, t in rows}
    assert fim.fim_digest(documents(spark, [])).count() == 0


def test_shares_of_forms(spark):
    docs = documents(spark, [(i, f"one two three {i}") for i in range(4000)])
    n = {r.form: r["count"] for r in fim.fim_transform(docs).groupBy("form").count().collect()}
    assert abs(n["plain"] - 2000) < 150 and abs(n["spm"] - 1600) < 150 and abs(n["psm"] - 400) < 100
    assert fim.fim_transform(docs, moved=0).where("form <> 'plain'").count() == 0
