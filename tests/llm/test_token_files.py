import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from attesta.llm import token_files
from tests.llm.helpers import clashing, documents, odd_rows

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    blocks = [rng.integers(0, 65_536, 700).astype(np.uint16), np.zeros(2048, np.uint16), np.zeros(0, np.uint16), np.array([65_535], np.uint16)]
    blocks += [np.minimum(rng.zipf(1.3, n), 49_407).astype(np.uint16) for n in (1, 2, 3, 500, 2048)] + [np.tile(np.arange(40), 30).astype(np.uint16)]
    coded = token_files.encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(blocks, token_files.decode_blocks(coded, [len(b) for b in blocks]), strict=True))
    assert len(coded[1]) < 100 and len(coded[-1]) < 500  # what repeats is predicted
    alone = [token_files.encode_blocks([b])[0] for b in blocks]
    assert alone == coded  # a block doesn't depend on its neighbours


def test_ids_equal_library(library):
    random.seed(2)
    parts = ["a", "E", "th", " ", "  ", "\n", "!!", "é", "ß", "日", "😀", "\t", "'s", "1", "23", "<|endoftext|>", "-", "Σ", "ΑΣ", "İ", "é", "͸", "\x1c", " ", "ing", "하"]
    texts = ["", "a" * 5000] + ["".join(random.choices(parts, k=random.randint(1, 40))) for _ in range(1500)]
    texts += ["".join(chr(random.randint(32, 0x3000)) for _ in range(30)) for _ in range(500)]
    own = token_files.WordTokens(open(PATH, encoding="utf-8").read())
    assert [np.frombuffer(x, "<u2").tolist() for x in own.encode_all(texts, 2)] == [[*e.ids, 2] for e in library.encode_batch(texts, add_special_tokens=False)]


def expected(rows, library):
    found, start = [], 0
    for i, text in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        found.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return found


def test_files_of_odd_rows(spark, library, tmp_path, monkeypatch):
    rows = odd_rows() + [(100 + k, "token " * (k % 90)) for k in range(150)]
    docs = clashing(documents(spark, rows)).repartition(5)
    path = str(tmp_path / "out")
    found = token_files.token_digest(docs, PATH, path).collect()
    assert sorted((tuple(r) for r in found), key=lambda r: r[1]) == expected(rows, library)
    whole = token_files.read_token_files(spark, path).orderBy("part", "chunk", "pos").collect()
    assert [r.doc_id for r in whole] == [e[0] for e in expected(rows, library)] and all(r.ids[-1] == 2 for r in whole)


def test_long_document_spans_blocks(spark, library, monkeypatch, tmp_path):
    rows = [(1, "word and word " * 9000), (2, "b"), (0, "c")]
    found = token_files.token_digest(documents(spark, rows), PATH, str(tmp_path / "out")).collect()
    assert sorted((tuple(r) for r in found), key=lambda r: r[1]) == expected(rows, library)


def test_damage_is_noticed():
    ids = np.arange(1000).astype(np.uint16)
    row = {"part": 0, "chunk": 0, "doc_ids": [1], "lengths": [1000], "blocks": [{"n_ids": 1000, "crc": token_files.crc_of(ids), "data": token_files.encode_blocks([ids])[0]}]}
    assert (next(token_files.decoded_rows([row]))[0] == ids).all()
    data = bytearray(row["blocks"][0]["data"])
    data[200] ^= 4
    row["blocks"][0]["data"] = bytes(data)
    with pytest.raises(ValueError, match="checksum"):
        list(token_files.decoded_rows([row]))


def test_empty_table(spark, tmp_path):
    assert token_files.token_digest(documents(spark, []), PATH, str(tmp_path / "out")).count() == 0


def test_new_words_go_to_the_library_together(library):
    """Each distinct word went to the library by itself, which took 1.4 of 5.3 s of 5,000 documents."""

    class Counting:
        def __init__(self):
            self.texts = 0

        def encode_batch_fast(self, texts, **options):
            self.texts += len(texts)
            return library.encode_batch_fast(texts, **options)

    own = token_files.WordTokens(open(PATH, encoding="utf-8").read())
    own.library = counting = Counting()
    texts = [" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}{'.,!é'[k]}" for i in range(k, 4000, 3)) for k in range(4)]
    found = [np.frombuffer(x, "<u2").tolist() for x in own.encode_all(texts, 2)]
    assert found == [[*e.ids, 2] for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counting.texts < 20


def test_words_without_an_end_of_their_own(library):
    own = token_files.WordTokens(open(PATH, encoding="utf-8").read())
    own.ends[:] = False
    assert np.frombuffer(own.encode_all(["some words, again"], 2)[0], "<u2").tolist() == [*library.encode("some words, again", add_special_tokens=False).ids, 2]


def test_carries_run_through_units():
    rng = np.random.default_rng(8)
    blocks = [rng.integers(0, most, n).astype(np.uint16) for most in (2, 30, 65_536) for n in rng.integers(1, 2049, 150)]
    assert all((a == b).all() for a, b in zip(blocks, token_files.decode_blocks(token_files.encode_blocks(blocks), [len(b) for b in blocks]), strict=True))
    writer = token_files._Writer(np.zeros((4, 2), np.int32))
    writer.out[[1, 3, 5]] = 7, 2**32 - 1, 2**32 - 1
    writer.pos[1] = 7
    low = np.array([0, 2**64 - 1], np.uint64)
    assert writer.raised(low, np.array([0, 2], np.uint64)).tolist() == [0, 1] and writer.out[[1, 3, 5]].tolist() == [8, 0, 0]
