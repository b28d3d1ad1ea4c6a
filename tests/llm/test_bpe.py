import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from attesta.llm import bpe
from tests.llm.helpers import clashing, documents, odd_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_equals_library_on_random_texts(library):
    random.seed(5)
    parts = ["a", "e", "th", " ", "  ", "\n", "!!", "é", "ß", "日", "😀", "\t", "'s", "1", "<|endoftext|>", "-", "=", "͸", "\x1c", "ing", " the"]
    texts = ["", "a" * 5000, " " * 3000 + "x"] + ["".join(random.choices(parts, k=random.randint(1, 60))) for _ in range(2000)]
    texts += ["".join(chr(random.randint(32, 0x3000)) for _ in range(30)) for _ in range(500)]
    own = bpe.ByteBpe(open(PATH, encoding="utf-8").read())
    ids = [np.frombuffer(x, "<i4").tolist() for x in own.encode_all(texts)]
    assert ids == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert own.decode_all(ids) == [library.decode(i, skip_special_tokens=False) for i in ids]


def test_memory_limit_changes_nothing(monkeypatch):
    own = bpe.ByteBpe(open(PATH, encoding="utf-8").read())
    texts = [f"word{i} other{i % 7}" for i in range(50)]
    whole = own.encode_all(texts)
    monkeypatch.setattr(bpe, "MEMORY_WORDS", 10)
    assert [own.encode_all([t])[0] for t in texts] == whole


def test_digest_of_odd_rows(spark, library):
    rows = odd_rows()
    found = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.bpe_digest(clashing(documents(spark, rows)), PATH).collect())
    expected = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.append((str(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert found == sorted(expected)


def test_round_trip_keeps_columns(spark):
    both = bpe.bpe_decode(bpe.bpe_encode(clashing(documents(spark, odd_rows())), PATH), PATH)
    assert all(r.decoded == (r.text or "") for r in both.collect())
    assert bpe.bpe_encode(documents(spark, []), PATH).count() == 0
