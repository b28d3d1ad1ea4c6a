"""The whole pipeline against its stages' definitions on a small corpus of planted cases."""

import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from attesta.llm import decontaminate
from tests.llm.helpers import documents


def corpus():
    rng = random.Random(12)
    syllables = ["an", "er", "th", "io", "es", "to", "ra", "li"]
    vocabulary = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(3000)]
    prose = lambda n: rng.choices(vocabulary, k=n)
    items = [(i, " ".join(prose(30))) for i in range(5)]
    rows, labels, kinds = [], [], {}
    for i in range(240):
        words, kind = prose(rng.randint(80, 200)), "clean"
        if i % 6 == 5:
            words, kind = [w.upper() + "!!" for w in words], "junk"
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind == "clean"), 0))
        kinds[i] = kind
    passage = prose(60)
    for i in range(300, 304):
        rows.append((i, " ".join(prose(100) + passage + prose(90))))
    rows += [(400 + k, rows[0][1]) for k in range(3)]
    near = rows[1][1].split()
    near[10] = "changed"
    rows.append((410, " ".join(near)))
    rows += [(500, " ".join(prose(50)) + " " + items[0][1]), (501, " ".join(prose(2000)) + " " + items[1][1]), (None, " ".join(prose(90)))]
    return rows, labels, items, kinds, " ".join(passage)


def test_stages_and_run(spark, tmp_path):
    rows, labels, items, kinds, passage = corpus()
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        seen[name] = {r.doc_id: r for r in docs.collect()}
    clean = {i for i, kind in kinds.items() if kind == "clean"}
    assert not {i for i, kind in kinds.items() if kind == "junk"} & set(seen["quality"]) and clean <= set(seen["quality"])
    near = seen["simhash_near_dedup"]
    assert not {400, 401, 402, 410} & set(near) and clean <= set(near) and {300, 301, 302, 303, 500, 501, None} <= set(near)
    cut = seen["substring_dedup"]
    assert [i for i in range(300, 304) if passage in cut[i].text] == [300] and all(cut[i].text == near[i].text for i in clean)
    left = seen["decontamination"]
    assert 500 not in left and 501 in left and clean <= set(left)
    windows = decontaminate.WindowSet([(str(i), t) for i, t in items], 13)
    for r in left.values():
        words = decontaminate.words_of(r.text)
        hit = sum(b - a for a, b in windows.scan([words])[0][0])
        assert 20 * hit < len(words)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, r in seen["bpe"].items():
        assert list(r.ids) == library.encode(left[i].text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)
    whole = {r.doc_id: tuple(r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {i: tuple(r.ids) for i, r in seen["bpe"].items()}
