"""Structured Streaming forms: run-once jobs over files that arrive, with state where it is needed."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators.merge import insert_or_replace, upsert
from attesta.session import cut

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, glob: str = "events.parquet") -> DataFrame:
    """Events as a stream of files; glob may name a file or a folder of files."""
    path = f"{folder}/{glob}"
    return spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(path if "*" in path else folder_of(spark, path))


def folder_of(spark: SparkSession, path: str) -> str:
    """The path as a glob that a file source takes, whether it is a file or a folder."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return path if files.getFileStatus(where).isDirectory() else path[:-1] + "[" + path[-1] + "]"


def workplace(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, shared by all machines."""
    if spark.sparkContext.getCheckpointDir() is None:
        cut(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def run_once(stream: DataFrame, out: str, mode: str = "append") -> None:
    """Everything that is there now, then stop: the scheduled job."""
    job = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    job.awaitTermination()


def timed(events: DataFrame, delay: str) -> DataFrame:
    """Events with a watermark; event time must be a timestamp with a zone, so ts is read in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def first_seen_stream(events: DataFrame, keys: list[str], delay: str = "40 days") -> DataFrame:
    """W1, W2 as a stream: one row of each key within the watermark."""
    return timed(events, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts by event-time window; a window is written once the watermark has passed it."""
    return timed(events, delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def upsert_stream(events: DataFrame, out: str, keys: list[str], order: list) -> None:
    """U4 as a stream: each micro-batch makes a new version of the table; a repeated batch makes the same.

    The version is named by the batch, so a batch that runs again after a lost driver
    overwrites its own version and nothing else.
    """

    def merge_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        empty = spark.createDataFrame([], batch.schema)
        before = empty if number == 0 else spark.read.schema(batch.schema).parquet(f"{out}/v{number - 1}")
        insert_or_replace(before, batch, keys, order).write.mode("overwrite").parquet(f"{out}/v{number}")

    events.writeStream.foreachBatch(merge_batch).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()


def crawl_stream(batches: DataFrame, current: DataFrame, out: str, fields: tuple[str, ...]) -> None:
    """U1 as a stream (R2, R3): each micro-batch of a crawl is merged into the records, and its changes are kept.

    Records of batch n stand in out/records/v<n>, its changes in out/changes/batch=<n>, which nothing
    else writes to: a batch that runs again overwrites its own, and the log only grows by batches.
    """

    def merge_batch(batch: DataFrame, number: int) -> None:
        before = current if number == 0 else batch.sparkSession.read.parquet(f"{out}/records/v{number - 1}")
        records, changes = upsert(before, batch, fields)
        records.write.mode("overwrite").parquet(f"{out}/records/v{number}")
        changes.write.mode("overwrite").parquet(f"{out}/changes/batch={number}")

    job = batches.writeStream.foreachBatch(merge_batch).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    job.awaitTermination()


#: What the keyed crawl puts out besides the fields, and what it keeps of a key besides them.
CHANGE = ("at", "field", "old_value", "new_value", "change_type")
KEPT = ("verified", "quality", "first_seen", "last_checked", "last_changed")


def merged_record(old: dict | None, new: dict, fields: tuple[str, ...], strict_parity: bool = False) -> tuple[dict, list[tuple]]:
    """U1 for one key: the record after a crawl row and its changes (field, old, new, change_type); as merge.upsert has it."""
    if old is None:
        return {f: new[f] for f in fields} | {"verified": [], "quality": new["quality"], "first_seen": new["at"], "last_checked": new["at"], "last_changed": None}, [("*", None, str(new["key"]), "new_record")]
    record, changes = old | {"quality": new["quality"] or old["quality"], "last_checked": new["at"]}, []
    for f in fields if new["quality"] not in ("ERROR", "BLOCKED") else ():
        was, now = old[f], new[f]
        unclear = not strict_parity and f == "cfp_status" and (now or "").lower() == "unclear"
        if (was or "") == (now or ""):
            continue
        if f in old["verified"]:
            if now is not None and not unclear:
                changes.append((f, was, now, "conflicts_verified"))
        elif (now or "").strip(" ") and not unclear:
            record[f] = now
            changes.append((f, was, now, "updated"))
    if any(c[3] == "updated" for c in changes):
        record["last_changed"] = new["at"]
    return record, changes


def keyed_crawl_stream(batches: DataFrame, current: DataFrame, out: str, fields: tuple[str, ...], strict_parity: bool = False) -> None:
    """U1 as a stream with a state for each key (R2, R3): a micro-batch touches its own keys and writes only these.

    current: the records before the first batch, as merge.upsert takes them; they are read once, into the
    state. batches: key (long), seq (a number, or a struct of numbers and times), at, quality, fields; of a
    key's rows in a micro-batch the last counts. out/records/batch=<n> gets the touched records of batch n,
    out/changes/batch=<n> its changes: a batch that runs again overwrites its own. All fields are text.
    """
    spark = batches.sparkSession
    kept = [F.col(c) for c in KEPT[1:]]
    seed = current.select(F.col("key").cast("long").alias("key"), *fields, F.array_join("verified", ",").alias("verified"), *kept)
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{out}/seed/_SUCCESS")
    if not marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker):
        seed.write.mode("overwrite").parquet(f"{out}/seed")
    seeds = spark.readStream.schema(seed.schema).parquet(f"{out}/seed").withColumns({"at": F.lit(None).cast("string"), "seq": F.array().cast("array<long>")})
    kind = batches.schema["seq"].dataType
    parts = [F.col("seq")] if not hasattr(kind, "fields") else [F.col(f"seq.{f.name}") for f in kind.fields]
    types = [kind] if not hasattr(kind, "fields") else [f.dataType for f in kind.fields]
    numbers = [F.unix_micros(c.cast("timestamp")) if "timestamp" in t.simpleString() else c.cast("long") for c, t in zip(parts, types, strict=True)]
    none = {c: F.lit(None).cast("string") for c in KEPT if c != "quality"}
    crawled = batches.select(F.col("key").cast("long").alias("key"), *fields, "quality", F.col("at").cast("string").alias("at"), F.array(*numbers).alias("seq")).withColumns(none)
    columns = ["key", "at", "seq", *fields, *KEPT]
    rows = seeds.select(*columns).unionByName(crawled.select(*columns)).withColumn("seq", F.array_join(F.transform("seq", lambda x: F.lpad(x.cast("string"), 20, "0")), ","))
    text = ", ".join(f"`{c}` string" for c in (*fields, *KEPT, *CHANGE))

    def touch(key, frames, state):
        import pandas as pd

        record = json.loads(state.get[0]) if state.exists else None
        whole = pd.concat(list(frames)).astype(object)
        found = whole.where(whole.notna(), None).to_dict("records")
        put = []
        for row in (r for r in found if r["at"] is None):  # what stood before the first batch
            record = {f: row[f] for f in (*fields, *KEPT)} | {"verified": [v for v in (row["verified"] or "").split(",") if v]}
        crawl = [r for r in found if r["at"] is not None]
        if crawl:
            last = max(crawl, key=lambda r: r["seq"])
            record, changes = merged_record(record, last, fields, strict_parity)
            put = [(key[0], "change", *[None] * (len(fields) + len(KEPT)), last["at"], *c) for c in changes]
        state.update((json.dumps(record),))
        values = record | {"verified": ",".join(record["verified"])}
        put.append((key[0], "record", *[values[c] for c in (*fields, *KEPT)], *[None] * len(CHANGE)))
        yield pd.DataFrame(put, columns=["key", "kind", *fields, *KEPT, *CHANGE]).astype({c: object for c in (*fields, *KEPT, *CHANGE)})

    kept_rows = rows.groupBy("key").applyInPandasWithState(touch, f"key long, kind string, {text}", "record string", "append", "NoTimeout")

    def write_batch(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        records = batch.where("kind = 'record'").select("key", *fields, F.split("verified", ",").alias("verified"), *KEPT[1:])
        records.withColumn("verified", F.filter("verified", lambda v: v != "")).write.mode("overwrite").parquet(f"{out}/records/batch={number}")
        batch.where("kind = 'change'").select("key", *CHANGE).write.mode("overwrite").parquet(f"{out}/changes/batch={number}")
        batch.unpersist()

    kept_rows.writeStream.outputMode("append").foreachBatch(write_batch).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()


def keyed_records(spark: SparkSession, out: str) -> DataFrame:
    """The records after the last batch of keyed_crawl_stream: of each key the row of the last batch that touched it."""
    written = spark.read.parquet(f"{out}/records")
    names = [c for c in written.columns if c not in ("key", "batch")]
    return written.groupBy("key").agg(F.max_by(F.struct(*names), "batch").alias("r")).select("key", "r.*")


def alert_stream(spark: SparkSession, out: str, today: str) -> None:
    """D24 as a second stream (R3): alerts of the changes that keyed_crawl_stream wrote to out/changes, each once.

    A batch's alerts stand in out/alerts/batch=<n>, which it overwrites if it runs again; a change that is
    read again, since its batch was written again, is known by key, batch and field.
    """
    from attesta.operators.decisions import alerts

    schema = "key long, " + ", ".join(f"{c} string" for c in CHANGE) + ", batch int"
    log = spark.readStream.schema(schema).option("basePath", f"{out}/changes").parquet(f"{out}/changes").dropDuplicates(["key", "batch", "field", "change_type"])

    def write_batch(batch: DataFrame, number: int) -> None:
        none = batch.sparkSession.createDataFrame([], "key long, deadline date")
        alerts(batch, none, today).write.mode("overwrite").parquet(f"{out}/alerts/batch={number}")

    log.writeStream.outputMode("append").foreachBatch(write_batch).option("checkpointLocation", f"{out}/alert_state").trigger(availableNow=True).start().awaitTermination()


def latest_records(spark: SparkSession, out: str) -> DataFrame:
    """The records after the last batch of crawl_stream."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{out}/records")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    last = max(int(f.getPath().getName()[1:]) for f in files.listStatus(folder))
    return spark.read.parquet(f"{out}/records/v{last}")


def first_of_kind_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(user_id, event_type, event_id): the first event of each kind of each user, kept in state.

    The earliest event is an aggregate, so the order of arrival does not matter; the table is
    written by a complete-mode sink into versions named by batch.
    """
    out = workplace(spark)
    events = read_events(spark, folder)
    first = events.groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("first"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.select("user_id", "event_type", "first.event_id").write.mode("overwrite").parquet(f"{out}/v{number}")

    job = first.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    last = max(p["batchId"] for p in job.recentProgress)
    return spark.read.parquet(f"{out}/v{last}")
