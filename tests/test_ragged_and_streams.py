"""Ragged files read by blocks, and the keyed crawl, against whole-file and whole-batch forms."""

import csv
import io
import random

from pyspark.sql import functions as F

from attesta.operators import merge
from attesta.sources import files
from attesta.streaming import jobs


def test_blocks_give_what_the_whole_file_gives(spark, tmp_path):
    rng = random.Random(4)
    cell = lambda: rng.choice(["a", "", "two words", "a,b", 'say "x"', "line\nbreak", "\n\n", "é語", "x" * 50, "cr\r\nlf"])
    rows = [["h1", "h2", "h3"]] + [[cell() for _ in range(rng.randint(1, 5))] for _ in range(300)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_MINIMAL).writerows(rows)
    for name, content in (("a.csv", "﻿" + out.getvalue()), ("b.csv", "one,two\n\nx\n"), ("c.csv", 'k\n"open, to\nthe end')):
        (tmp_path / name).write_text(content, encoding="utf-8", newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = files.read_ragged(spark, str(tmp_path / "*.csv"))
        assert spark.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions() > 10
        by_file = {}
        for r in found.orderBy("path", "line").collect():
            by_file.setdefault(r.path[-5:], []).append((r.line, r.width, r.header_width, r.cells))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name in ("a.csv", "b.csv", "c.csv"):
        want = list(csv.reader(io.StringIO((tmp_path / name).read_bytes().decode("utf-8-sig"), newline="")))
        assert by_file[name] == [(i, len(r), len(want[0]), r) for i, r in enumerate(want, 1)], name


def crawl_rows(n=300, seed=9):
    rng = random.Random(seed)
    value = lambda: rng.choice([None, "", " ", "a", "b", "unclear", "Unclear"])
    fields = merge.TRACKED
    old = [(k, rng.sample(fields, rng.randint(0, 3)), rng.choice(["PASS", "ERROR"]), "t0", "t0", None, *[value() for _ in fields]) for k in range(n) if k % 4]
    new = [(k, i, f"t{i}", rng.choice(["PASS", "PASS", "PARTIAL", "ERROR", "BLOCKED"]), *[value() for _ in fields]) for k in range(n) if k % 5 for i in range(rng.randint(1, 2))]
    return old, new


def frames(spark, old, new):
    names = ", ".join(f"{f} string" for f in merge.TRACKED)
    current = spark.createDataFrame(old, f"key long, verified array<string>, quality string, first_seen string, last_checked string, last_changed string, {names}")
    return current, spark.createDataFrame(new, f"key long, seq long, at string, quality string, {names}")


def told(df, columns):
    return sorted(str(tuple(r[c] for c in columns)) for r in df.collect())


def test_keyed_stream_equals_batches_one_after_another(spark, tmp_path):
    old, new = crawl_rows()
    current, batch = frames(spark, old, new)
    cuts = [batch.where(F.col("key") % 3 == 0), batch.where("key % 3 > 0 AND seq = 0"), batch.where("key % 3 > 0 AND seq = 1")]
    out, changes, records = str(tmp_path), [], current
    for k, part in enumerate(cuts):
        records, log = merge.upsert(records, part)
        records, log = records.cache(), log.cache()
        changes += told(log, ["key", "at", "field", "old_value", "new_value", "change_type"])
        part.coalesce(1).write.mode("append").parquet(f"{out}/in")
        if k:  # the first two files in one run, the third after a restart
            jobs.keyed_crawl_stream(spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in"), current, out, merge.TRACKED)
            jobs.alert_stream(spark, out, "2026-01-01")
    columns = ["key", *merge.TRACKED, "quality", "first_seen", "last_checked", "last_changed"]
    assert told(jobs.keyed_records(spark, out), columns) == told(records, columns)
    found = spark.read.parquet(f"{out}/changes")
    assert told(found, ["key", "at", "field", "old_value", "new_value", "change_type"]) == sorted(changes)
    created = found.where("change_type = 'new_record'").count()
    alerts = spark.read.parquet(f"{out}/alerts")
    assert alerts.where("kind = 'new_conference'").count() == created
    before = alerts.count()
    jobs.alert_stream(spark, out, "2026-01-01")  # nothing new, nothing twice
    assert spark.read.parquet(f"{out}/alerts").count() == before
    touched = spark.read.parquet(f"{out}/records").where("batch = 2").select("key").distinct().count()
    assert touched == cuts[2].select("key").distinct().count()  # a batch writes its own keys only
