"""Sharding by extendible hashing, in DataFrame operations only.

The directory is indexed by leading bits of a hash of each row. A bucket that holds more
than the byte limit splits on one more bit; all others keep their depth. Buckets are sized
from a table pre-aggregated by hash prefix, whose rows follow the number of shards and not
that of documents; only cells that are still too large are opened further.

Defined cases: null texts have no bytes; rows with equal doc_id and size are told apart by a
copy number, so repeated rows split too; a null doc_id is a key like any other; a single row
over the limit gets a shard of its own (n_rows 1), the only shard over the limit; an empty
table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.columns import free_name

#: Bits of the row hash that can index the directory.
HASH_BITS = 60


def row_hash():
    """60 bits of MD5 over id, size and copy number."""
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "n_bytes", "copy")
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def sized(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes, copy, h: one row for each row of df."""
    rows = df.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = rows.groupBy("doc_id", "n_bytes").agg(F.count("*").alias("n"))
    copies = counted.select("doc_id", "n_bytes", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    return copies.select("doc_id", "n_bytes", "copy", row_hash().alias("h"))


def directory(rows: DataFrame, limit_bytes: int) -> DataFrame:
    """(depth, prefix, bytes, n_rows) of every shard for rows (h, n_bytes)."""
    from attesta.session import cut

    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    low, shards, step = 0, None, 3 + max(0, math.ceil(math.log2(max(1, total / limit_bytes))))
    while True:
        high = min(HASH_BITS, low + step)
        cell = F.shiftright("h", HASH_BITS - high)
        cells = cut(rows.groupBy(cell.alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n_rows")))
        levels = cells.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
        prefix = F.expr(f"shiftright(cell, {high} - depth)")
        nodes = levels.groupBy("depth", prefix.alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("n_rows").alias("n_rows"))
        fits = (F.col("bytes") <= limit_bytes) | (F.col("n_rows") == 1) | (F.col("depth") == HASH_BITS)
        large = nodes.where(~fits).select(F.col("depth").alias("up_depth"), F.col("prefix").alias("up_prefix"))
        # a bucket stands where it fits and its parent doesn't
        parent = (F.col("up_depth") == F.col("depth") - 1) & (F.col("up_prefix") == F.expr("shiftright(prefix, 1)"))
        split = nodes.where(fits & (F.col("depth") > low)).join(large, parent, "left_semi")
        found = nodes.where(fits & (F.col("depth") == low)).unionByName(split) if low == 0 else split
        shards = cut(found if shards is None else shards.unionByName(found))
        open_cells = nodes.where(~fits & (F.col("depth") == high)).select(F.col("prefix").alias("open"))
        if high == HASH_BITS or open_cells.isEmpty():
            return shards
        rows = rows.join(open_cells, cell == F.col("open"), "left_semi")
        low, step = high, 8


def placed(df: DataFrame, limit_bytes: int) -> DataFrame:
    """doc_id, n_bytes, copy, shard (prefix bits as text), depth, shard_bytes and shard_rows of each row.

    Rows find their shard by an equi-join on each depth's prefix; depths are few.
    """
    rows = sized(df)
    shards = directory(rows, limit_bytes)
    depths = sorted(r.depth for r in shards.select("depth").distinct().collect()) or [0]  # at most 61
    keyed = rows.withColumn("at", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("h", HASH_BITS - d).alias("prefix")) for d in depths])))
    joined = keyed.select("doc_id", "n_bytes", "copy", "at.*").join(shards, ["depth", "prefix"])
    bits = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    return joined.select("doc_id", "n_bytes", "copy", bits.alias("shard"), "depth", F.col("bytes").alias("shard_bytes"), F.col("n_rows").alias("shard_rows"))


def shard_documents(df: DataFrame, limit_bytes: int) -> DataFrame:
    """doc_id, n_bytes, shard, depth, shard_bytes and shard_rows of each row of df."""
    return placed(df, limit_bytes).drop("copy")


def write_shards(df: DataFrame, limit_bytes: int, path: str) -> str:
    """Write the rows of df as Parquet, one folder for each shard; the name of the shard column.

    It is "shard", or "shard_" and so on where df has such a column. Only rows that share id
    and size are numbered, so that each copy finds its own shard.
    """
    size_, number_, shard, id_, bytes_, copy_ = (free_name(n, df.columns) for n in ("row size", "row number", "shard", "placed id", "placed size", "placed copy"))
    where = placed(df, limit_bytes).select(F.col("doc_id").alias(id_), F.col("n_bytes").alias(bytes_), F.col("copy").alias(copy_), F.col("shard").alias(shard))
    rows = df.withColumn(size_, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    same = F.col("doc_id").eqNullSafe(F.col(f"`{id_}`")) & (F.col(f"`{size_}`") == F.col(f"`{bytes_}`"))
    several = where.where(F.col(f"`{copy_}`") == 2).select(f"`{id_}`", f"`{bytes_}`")
    number = F.row_number().over(Window.partitionBy("doc_id", f"`{size_}`").orderBy(F.xxhash64("text")))
    copies = rows.join(several, same, "left_semi").withColumn(number_, number)
    all_rows = rows.join(several, same, "left_anti").withColumn(number_, F.lit(1)).unionByName(copies)
    whole = all_rows.join(where, same & (F.col(f"`{number_}`") == F.col(f"`{copy_}`"))).select(*[f"`{c}`" for c in df.columns], shard)
    whole.repartition(shard).write.partitionBy(shard).parquet(path)
    return shard


def shard_sql(limit_bytes: int) -> str:
    """The same result as DuckDB SQL, from the sizes of every prefix up to 24 bits."""
    return f"""
WITH rows_ AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         row_number() OVER (PARTITION BY doc_id, coalesce(strlen(text), 0)) AS copy
  FROM documents),
hashed AS (
  SELECT doc_id, n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || n_bytes || ':' || copy), 1, 15))::BIGINT AS h
  FROM rows_),
nodes AS (
  SELECT d AS depth, h >> ({HASH_BITS} - d) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows
  FROM hashed, range(0, 25) AS r(d) GROUP BY 1, 2),
fits AS (
  SELECT h.doc_id, h.n_bytes, h.h, min(n.depth) AS depth
  FROM hashed h JOIN nodes n ON h.h >> ({HASH_BITS} - n.depth) = n.prefix
  WHERE n.shard_bytes <= {limit_bytes} OR n.shard_rows = 1 GROUP BY ALL)
SELECT f.doc_id, f.n_bytes,
       CASE WHEN f.depth = 0 THEN '' ELSE lpad(bin(n.prefix), f.depth::INT, '0') END AS shard,
       f.depth::INT AS depth, n.shard_bytes, n.shard_rows
FROM fits f JOIN nodes n ON n.depth = f.depth AND n.prefix = f.h >> ({HASH_BITS} - f.depth)
"""
