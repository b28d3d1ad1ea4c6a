"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each table hashes a vector with k functions floor((a.x + b) / w), a being Gaussian. A query
visits, besides its own bucket, those reached by moving single functions by one, in order of
the estimated success (the sum of squared distances to the borders crossed). Candidates of
all tables are merged and ranked by the exact distance in double precision.

How many buckets are visited, and if all of them do not suffice how wide they are, is fitted
on a bounded sample (`SAMPLE` vectors) so that recall there reaches `RECALL`; every vector is
indexed. A query that finds fewer neighbours than there are, or whose last one is farther away than
any of the sample's, lies outside what was fitted and is answered exactly, by a pass over all vectors
for each block of such queries. Equal vectors are one entry that holds their smallest ids, which is exact: no
answer can hold more of them. Large buckets are dealt out to several groups; a query's vector goes
once to each group of buckets it visits, and each group passes on only its nearest candidates.

Defined cases: vectors that are null, zero, of another length than most, or that hold null,
NaN or infinite components take no part; ties go to the smaller id; rows repeated with the
same id and vector count once, of rows with the same id and other vectors the one of the
smallest hash takes part; with fewer candidates all are returned; an empty table gives
no rows; only vec_id and embedding are read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.session import cut

TABLES, FUNCTIONS, WIDTH = 8, 6, 1.6
SAMPLE, RECALL = 2_000, 0.97
#: Vectors of a bucket that one group holds, at most, and numbers in the vectors of a group on average.
PART_ROWS, GROUP_NUMBERS = 20_000, 1 << 22
#: Numbers in the vectors of a block of queries that are answered exactly.
BLOCK_NUMBERS = 1 << 20
SEED = 11


class Hashes:
    """The hash functions of all tables; vectors are divided by `scale` first."""

    def __init__(self, dim: int, scale: float, width: float = WIDTH):
        rng = np.random.default_rng(SEED)
        self.a = rng.normal(size=(TABLES, dim, FUNCTIONS)) / scale
        self.b = rng.uniform(0, 1, size=(TABLES, FUNCTIONS)) * width
        self.width = width
        moves = np.array(list(itertools.product((0, -1, 1), repeat=FUNCTIONS)))
        self.down, self.up, self.moves = (moves == -1).astype(float), (moves == 1).astype(float), moves
        self.radix = 1009 ** np.arange(FUNCTIONS, dtype=np.int64)

    def cells(self, x: np.ndarray, table: int) -> np.ndarray:
        return np.clip((x @ self.a[table] + self.b[table]) / self.width, -1e15, 1e15)

    def codes(self, x: np.ndarray, table: int) -> np.ndarray:
        return np.floor(self.cells(x, table)).astype(np.int64) @ self.radix

    def probes(self, x: np.ndarray, table: int, n: int) -> np.ndarray:
        """Bucket codes of the n likeliest buckets of each vector, likeliest first."""
        cells = self.cells(x, table)
        base = np.floor(cells)
        rest = cells - base
        cost = rest**2 @ self.down.T + (1 - rest) ** 2 @ self.up.T
        order = np.argsort(cost, axis=1, kind="stable")[:, :n]
        return (base.astype(np.int64) @ self.radix)[:, None] + (self.moves @ self.radix)[order]


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of x to q, in double precision."""
    return np.sqrt(((x - q) ** 2).sum(axis=-1))


def fitted(sample: np.ndarray, k: int) -> tuple[Hashes, int, float]:
    """Hash functions, buckets to visit and the farthest k-th neighbour, by the sample.

    The fewest buckets (doubling from 8) that reach RECALL; where all moves do not, buckets
    are made twice as wide until they do.
    """
    norms = np.sqrt((sample**2).sum(axis=1))
    hashes = Hashes(sample.shape[1], float(np.median(norms)))
    queries = list(range(0, len(sample), max(1, len(sample) // 64)))
    true, far = [], float("inf")
    for i in queries:
        apart = distances(sample, sample[i])
        true.append([j for j in np.argsort(apart, kind="stable")[: k + 1].tolist() if j != i][:k])
    if len(sample) > k:
        far = max(float(distances(sample[near], sample[i]).max()) for i, near in zip(queries, true, strict=True))
    most = len(hashes.moves)
    while True:
        codes = [hashes.codes(sample, t) for t in range(TABLES)]
        visited = [hashes.probes(sample[queries], t, most) for t in range(TABLES)]
        n = 8
        while True:
            hit = [any((visited[t][i][:n] == codes[t][j]).any() for t in range(TABLES)) for i, near in enumerate(true) for j in near]
            if not hit or np.mean(hit) >= RECALL:
                return hashes, n, far
            if n >= most:
                break
            n = min(most, 2 * n)
        hashes = Hashes(sample.shape[1], float(np.median(norms)), hashes.width * 2)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim).astype(np.float64)


def nearest_of(x: np.ndarray, gids: np.ndarray, q: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, gid, distance) of the `most` nearest rows of x to each row of q, ties to the smaller gid."""
    squares, found = (x**2).sum(axis=1), ([], [], [])
    for start in range(0, len(q), 64):
        part = q[start : start + 64]
        rough = squares[None] - 2 * part @ x.T
        keep = min(most, len(x))
        nth = np.partition(rough, keep - 1, axis=1)[:, keep - 1]
        # all that rounding may have put behind the last one are ranked exactly
        slack = 8 * x.shape[1] * np.finfo(float).eps * (squares.max() + (part**2).sum(axis=1))
        for i in range(len(part)):
            near = np.flatnonzero(rough[i] <= nth[i] + slack[i])
            apart = distances(x[near], part[i])
            order = np.lexsort((gids[near], apart))[:keep]
            found[0].append(np.full(len(order), start + i))
            found[1].append(gids[near[order]])
            found[2].append(apart[order])
    return tuple(np.concatenate(f) for f in found)


def best_each(rows: np.ndarray, gids: np.ndarray, apart: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `most` nearest distinct gids of each row."""
    order = np.lexsort((gids, apart, rows))
    rows, gids, apart = rows[order], gids[order], apart[order]
    fresh = np.concatenate(([True], (rows[1:] != rows[:-1]) | (gids[1:] != gids[:-1])))  # an entry has one distance
    rows, gids, apart = rows[fresh], gids[fresh], apart[fresh]
    starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
    keep = place < most
    return rows[keep], gids[keep], apart[keep]


ANSWER = "asker long, gid long, score double"


def answer_batch(askers: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(askers[found[0]]), pa.array(found[1]), pa.array(found[2])], names=["asker", "gid", "score"])


def ranked(queries: DataFrame, vectors: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score by the nearest entries (asker, gid, score) of each query's own entry."""
    best = near.dropDuplicates(["asker", "gid"]).withColumn("n", F.row_number().over(Window.partitionBy("asker").orderBy("score", "gid"))).where(F.col("n") <= k + 1)
    named = best.select("asker", "gid", "score").join(vectors.select("gid", "ids"), "gid").select("asker", "score", F.explode("ids").alias("vec_id"))
    answers = queries.join(named, queries.gid == named.asker).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def exact_answers(asking: DataFrame, vectors: DataFrame, k: int, dim: int) -> DataFrame:
    """(asker, gid, score) of the k + 1 nearest entries of each row of asking (gid, embedding), by comparing all.

    A block of queries of a fixed size is sent to all tasks, and each passes on its nearest.
    """
    spark, size = vectors.sparkSession, max(1, BLOCK_NUMBERS // dim)
    found = spark.createDataFrame([], ANSWER)
    waiting = asking.select("gid", "embedding").toLocalIterator()
    while block := list(itertools.islice(waiting, size)):
        shared = spark.sparkContext.broadcast((np.array([r.gid for r in block]), np.array([r.embedding for r in block], np.float64)))

        def compare(batches, shared=shared):
            askers, q = shared.value
            kept = None
            for whole in batches:
                for start in range(0, whole.num_rows, 4096):
                    batch = whole.slice(start, 4096)
                    new = nearest_of(matrix(batch.column("embedding"), dim), batch.column("gid").to_numpy(), q, k + 1)
                    kept = best_each(*(np.concatenate(c) for c in zip(kept, new, strict=True)), k + 1) if kept else new
            if kept:
                yield answer_batch(askers, kept)

        near = vectors.select("gid", "embedding").mapInArrow(compare, ANSWER)
        order = Window.partitionBy("asker").orderBy("score", "gid")
        near = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")
        found = found.unionByName(cut(near))
    return found


def nearest(df: DataFrame, k: int = 10, query_every: int = 100) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id divides by query_every."""
    spark = df.sparkSession
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = df.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound)
    sizes = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = sizes.dim
    rows = rows.where(F.size("embedding") == dim)
    one_each = rows.groupBy("vec_id").agg(F.min(F.struct(F.xxhash64("embedding").alias("key"), "embedding")).alias("v")).select("vec_id", "v.*")
    # The k + 1 smallest ids of equal vectors; the limit is applied before the shuffle too.
    order = Window.partitionBy("key", "embedding").orderBy("vec_id")
    one_each = cut(one_each)
    few = one_each.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    groups = few.groupBy("key", "embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    vectors = cut(groups.select(F.element_at("ids", 1).alias("gid"), "key", "embedding", "ids"))
    queries = one_each.where(F.col("vec_id") % query_every == 0).select(F.col("vec_id").alias("query_id"), "key", "embedding")
    queries = cut(queries.join(vectors.select("gid", "key", "embedding"), ["key", "embedding"]).select("query_id", "gid"))
    asking = vectors.join(queries.select("gid").distinct(), "gid", "left_semi").select("gid", "embedding")

    sample = np.array([r.embedding for r in vectors.orderBy(F.xxhash64("key"), "gid").select("embedding").limit(SAMPLE).collect()], np.float64)
    hashes, probes, far = fitted(sample, k)
    found = cut(ranked(queries, vectors, probed(asking, vectors, hashes, probes, k, dim), k))
    # queries outside what was fitted are answered exactly
    possible = min(k, one_each.limit(k + 1).count() - 1)
    seen = found.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("last"))
    again = cut(queries.join(seen, "query_id", "left").where((F.coalesce("n", F.lit(0)) < possible) | (F.col("last") > far)).select("query_id", "gid"))
    if again.isEmpty():
        return found
    near = exact_answers(asking.join(again.select("gid").distinct(), "gid", "left_semi"), vectors, k, dim)
    return found.join(again, "query_id", "left_anti").unionByName(ranked(again, vectors, near, k))


def probed(asking: DataFrame, vectors: DataFrame, hashes: Hashes, probes: int, k: int, dim: int) -> DataFrame:
    """(asker, gid, score): the nearest entries in the buckets that each row of asking visits."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(hashes)  # some hundred KB, by dim alone

    def index(batches):
        for batch in batches:
            x = matrix(batch.column("embedding"), dim)
            for t in range(TABLES):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(shared.value.codes(x, t)), batch.column("gid"), batch.column("embedding")], names=["tab", "code", "gid", "embedding"])

    def visit(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                batch = whole.slice(start, 200)
                x = matrix(batch.column("embedding"), dim)
                for t in range(TABLES):
                    codes = shared.value.probes(x, t, probes)
                    again = pa.array(np.repeat(np.arange(len(x)), codes.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(codes.size, t, np.int32)), pa.array(codes.ravel()), batch.column("gid").take(again)], names=["tab", "code", "gid"])

    kind = T.StructType([T.StructField("tab", T.IntegerType()), T.StructField("code", T.LongType()), T.StructField("gid", T.LongType()), vectors.schema["embedding"]])
    entries = vectors.select("gid", "embedding").mapInArrow(index, kind)
    # buckets of more than PART_ROWS vectors stand in several parts; a query visits each of them
    counts = cut(entries.groupBy("tab", "code").agg(F.count("*").alias("n")))
    rows = counts.agg(F.sum("n")).first()[0]
    n_groups = max(1, rows * dim // GROUP_NUMBERS)
    large = counts.where(F.col("n") > PART_ROWS).select("tab", "code", F.ceil(F.col("n") / PART_ROWS).cast("int").alias("parts"))
    group = F.pmod(F.xxhash64("tab", "code", "part"), F.lit(n_groups)).alias("group")
    salted = entries.join(large, ["tab", "code"], "left").withColumn("part", F.pmod(F.xxhash64("gid"), F.coalesce("parts", F.lit(1))).cast("int"))
    salted = salted.select(group, F.lit(False).alias("asks"), "tab", "code", "part", "gid", "embedding", F.lit(None).cast("array<struct<tab:int,code:long,part:int>>").alias("visits"))
    to_visit = asking.mapInArrow(visit, "tab int, code long, gid long").join(counts.select("tab", "code"), ["tab", "code"], "left_semi")  # buckets that hold vectors
    to_visit = to_visit.join(large, ["tab", "code"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    visits = to_visit.groupBy("gid", group).agg(F.collect_list(F.struct("tab", "code", "part")).alias("visits"))
    nothing = [F.lit(None).cast(c).alias(n) for n, c in (("tab", "int"), ("code", "long"), ("part", "int"))]
    visits = visits.join(asking, "gid").select("group", F.lit(True).alias("asks"), *nothing, "gid", "embedding", "visits")
    # a task takes a set of groups: of each the vectors, by bucket, then the queries
    n_tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * 2
    met = salted.unionByName(visits).repartition(n_tasks, "group").sortWithinPartitions("group", "asks", "tab", "code", "part")

    def rank(batches):
        at, held, buckets, waiting = None, [], None, []

        def answer():
            """The k + 1 nearest of the visited buckets for each waiting query."""
            nonlocal buckets
            if held and waiting:
                if buckets is None:
                    ids = [np.concatenate([h[c] for h in held]) for c in range(5)]
                    change = np.flatnonzero((np.diff(ids[0]) != 0) | (np.diff(ids[1]) != 0) | (np.diff(ids[2]) != 0)) + 1
                    ends = [0, *change.tolist(), len(ids[0])]
                    buckets = {(int(ids[0][a]), int(ids[1][a]), int(ids[2][a])): (ids[3][a:b], ids[4][a:b]) for a, b in itertools.pairwise(ends)}
                asked: dict[tuple[int, int, int], list[int]] = {}
                for i, (_, _, own) in enumerate(waiting):
                    for v in own:
                        asked.setdefault((v["tab"], v["code"], v["part"]), []).append(i)
                q, found = np.stack([w[1] for w in waiting]), []
                for bucket, who in asked.items():
                    if bucket in buckets:
                        gids, x = buckets[bucket]
                        rows_, near, apart = nearest_of(x.astype(np.float64), gids, q[who], k + 1)
                        found.append((np.array(who)[rows_], near, apart))
                if found:
                    yield answer_batch(np.array([w[0] for w in waiting]), best_each(*(np.concatenate(c) for c in zip(*found, strict=True)), k + 1))
            waiting.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            groups, asks = batch.column("group").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            change = np.flatnonzero((np.diff(groups) != 0) | (asks[1:] != asks[:-1])) + 1
            for a, b in itertools.pairwise([0, *change.tolist(), len(groups)]):
                if groups[a] != at:
                    yield from answer()
                    held.clear()
                    at, buckets = groups[a], None
                part = batch.slice(a, b - a)
                x = part.column("embedding").flatten().to_numpy().reshape(-1, dim)
                if not asks[a]:
                    held.append((*(part.column(c).to_numpy() for c in ("tab", "code", "part", "gid")), x))
                    continue
                waiting.extend(zip(part.column("gid").to_pylist(), x.astype(np.float64), part.column("visits").to_pylist(), strict=True))
                if len(waiting) >= 1_000:
                    yield from answer()
        yield from answer()

    return met.mapInArrow(rank, ANSWER)
