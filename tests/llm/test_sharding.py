import random

import duckdb

from attesta.llm import sharding
from tests.llm.helpers import clashing, documents, odd_rows


def both(spark, rows, limit):
    docs = documents(spark, rows)
    found = sorted((str(r.doc_id), r.n_bytes, r.shard, r.depth, r.shard_bytes, r.shard_rows) for r in sharding.shard_documents(clashing(docs), limit).collect())
    con = duckdb.connect()
    documents_ = docs.toPandas().astype({"doc_id": "Int64"})  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text FROM documents_")
    expected = sorted((str(r[0]), *r[1:]) for r in con.sql(sharding.shard_sql(limit)).fetchall())
    return found, expected


def test_equals_sql_and_keeps_the_limit(spark):
    random.seed(1)
    rows = [(i, "é" * random.randint(0, 300)) for i in range(800)] + [(5, "same")] * 300 + [(9001, "x" * 5000)] + odd_rows()[:5]
    found, expected = both(spark, rows, 4000)
    assert found == expected and len(found) == len(rows)
    sums = {}
    for _, n, shard, *_ in found:
        sums.setdefault(shard, []).append(n)
    assert all(sum(v) <= 4000 or len(v) == 1 for v in sums.values()) and len(sums) > 10


def test_small_and_empty_tables(spark):
    found, expected = both(spark, odd_rows(), 1 << 20)
    assert found == expected and {x[2] for x in found} == {""}
    assert sharding.shard_documents(documents(spark, []), 100).count() == 0


def test_written_shards_hold_every_row(spark, tmp_path):
    rows = [(i, "word " * (i % 50)) for i in range(300)] + [(7, "dup"), (7, "dup")]
    docs = clashing(documents(spark, rows)).selectExpr("*", "1 as p_id", "2 as p_size", "3 as s_id")
    assert sharding.write_shards(docs, 5000, str(tmp_path / "out")) == "shard_"
    again = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text, r.shard, r.p_size) for r in again.collect()) == sorted((*r, "x", 2) for r in rows)
