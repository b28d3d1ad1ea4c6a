"""Text functions without SQL counterparts, for every row of their queries, against plain statements of the rules."""

import os
import unicodedata
from difflib import SequenceMatcher

from attesta.functions.text import SMART_PUNCTUATION
from attesta.plans import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}


def test_folded_text(spark):
    def fold(t):
        t = t.replace("\r\n", " ").replace("\r", " ").replace("\n", " ")
        for a, b in SMART_PUNCTUATION.items():
            t = t.replace(a, b)
        return "".join(c for c in unicodedata.normalize("NFKD", t) if ord(c) < 128)

    found = {r.doc_id: r.n for r in catalog.queries()["folded_text"](spark, FOLDER).collect()}
    assert found == {i: len(fold(t)) for i, t in texts(spark).items()}


def test_located_quotes(spark):
    key = lambda t: "".join(c for c in t.lower() if c.isalnum())
    whole = texts(spark)
    found = {r.doc_id: r.quote for r in catalog.queries()["located_quotes"](spark, FOLDER).collect()}
    assert found.keys() == whole.keys() and sum(q is not None for q in found.values()) > 100
    for i, t in whole.items():
        claim = key(t[20:80].upper())
        if not claim or claim not in key(t):
            assert found[i] is None
        else:  # the page's own words, no more of them than the claim has
            assert found[i] in t and key(found[i]) == claim and found[i][0].isalnum()


def test_name_similarities(spark):
    from attesta.functions.text import NAME_STOP_WORDS

    nations = {r.n_nationkey: f"Market {r.n_name}" for r in spark.read.parquet(f"{FOLDER}/nation.parquet").collect()}
    words = lambda n: {w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in n.lower()).split() if len(w) > 1 and w not in NAME_STOP_WORDS}
    rows = catalog.queries()["name_similarities"](spark, FOLDER).collect()
    assert len(rows) == 50
    for r in rows:
        a, b = words(nations[r.n_nationkey]), words(nations[r.other_key])
        letters = SequenceMatcher(None, " ".join(sorted(a)), " ".join(sorted(b))).ratio() * 0.9
        assert abs(r.name_similarity - max(len(a & b) / len(a | b), letters)) < 1e-9 and 0 <= r.ratio <= 1
