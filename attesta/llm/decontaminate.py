"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Words are runs of ASCII letters and digits and of all non-ASCII characters, A-Z in lower
case. A benchmark item gives every window of `size` words, or one shorter window. Training
texts are scanned with rolling hashes, hits are verified word by word, and every word
inside an occurrence counts as hit.

The set is broadcast in blocks of at most `block_windows` windows: a larger benchmark takes
more passes over the documents, each of bounded size, whose hits are merged by document.

Defined cases: null and empty texts have no words and no hits; items without words never
occur; equal items each count; words of an item without item_id are hit, but having no name it
is not among the items found; rows of documents are never merged, even with equal doc_id;
an empty table gives no rows; columns of any name pass through `decontaminate` as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.columns import free_name

#: A-Z in lower case; bytes of words stay, all others turn into spaces.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MULTIPLIER = 0x9E3779B97F4A7C15


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows_of(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


class WindowSet:
    """Windows of benchmark items; finds where they occur in texts."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int):
        self.items: dict[tuple[int, ...], set[str | None]] = {}
        self.vocabulary: dict[bytes, int] = {}
        for item, text in items:
            for window in windows_of(words_of(text), size):
                key = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in window)
                self.items.setdefault(key, set()).add(item)
        self.sizes = sorted({len(k) for k in self.items})
        self.hashes = {n: np.unique(self.rolled(np.array([k for k in self.items if len(k) == n]).ravel(), n)[::n]) for n in self.sizes}
        self.bits = {}
        for n, hashes in self.hashes.items():
            self.bits[n] = np.zeros(1 << 22, bool)
            self.bits[n][hashes >> np.uint64(42)] = True

    @staticmethod
    def rolled(ids: np.ndarray, n: int) -> np.ndarray:
        """A hash of every window of n ids."""
        ids, factor = ids.astype(np.uint64), np.uint64(_MULTIPLIER)
        found = ids[: len(ids) - n + 1].copy()
        for i in range(1, n):
            found *= factor
            found += ids[i : len(ids) - n + 1 + i]
        return found * factor

    def scan(self, texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[str]]]:
        """For each text, given as words: spans (start, end) of words that occur, merged, and the items."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for words in texts for w in (*words, b"")), np.int64)
        ends = np.cumsum([len(w) + 1 for w in texts])
        hits: dict[int, tuple[list, set]] = {}
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        for n in self.sizes:
            if len(ids) < n:
                continue
            hashes = self.rolled(ids, n)
            maybe = np.flatnonzero((unknown[n:] == unknown[:-n]) & self.bits[n][hashes >> np.uint64(42)])
            for at in maybe[np.isin(hashes[maybe], self.hashes[n])].tolist():
                if items := self.items.get(tuple(ids[at : at + n].tolist())):
                    doc = int(np.searchsorted(ends, at, side="right"))
                    start = at - (int(ends[doc - 1]) if doc else 0)
                    spans, names = hits.setdefault(doc, ([], set()))
                    spans.append((start, start + n))
                    names |= items - {None}
        return [(merged(hits[i][0]), hits[i][1]) if i in hits else ([], set()) for i in range(len(texts))]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap made one."""
    found: list[list[int]] = []
    for a, b in sorted(spans):
        if found and a <= found[-1][1]:
            found[-1][1] = max(found[-1][1], b)
        else:
            found.append([a, b])
    return [(a, b) for a, b in found]


#: What a scan adds to a document: its number of words, the hit spans of words, the ids of occurring items.
ADDED = ("n_words", "spans", "items")


def benchmark_hits(df: DataFrame, benchmark: DataFrame, size: int = 13, block_windows: int = 200_000, names: tuple[str, str, str] = ADDED) -> DataFrame:
    """`df` with n_words, spans (of hit words) and items (ids of occurring items, sorted).

    The columns are called `names`; columns of `df` with these names are replaced.
    """
    found = df.drop(*names)
    for k, items in enumerate(item_blocks(benchmark, size, block_windows)):
        found = _scan(found, items, size, names, first=k == 0)
    return found


def item_blocks(benchmark: DataFrame, size: int, block_windows: int):
    """Lists of items, each with at most block_windows windows (an item alone may have more).

    One block at a time is read, so the driver holds no more than one.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    words = F.size(F.split("text", "[^0-9A-Za-z\\u0080-\\x{10FFFF}]+"))
    total = items.agg(F.coalesce(F.sum(F.greatest(words - (size - 1), F.lit(1))), F.lit(0))).first()[0]
    n = max(1, -(-2 * total // block_windows)) if total > block_windows else 1
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        yield [(r.item_id, r.text) for r in part.toLocalIterator()]


_built: list[tuple[list, int, WindowSet]] = []


def window_set(items: list[tuple[str | None, str | None]], size: int) -> WindowSet:
    """The windows of `items`, built once for each worker as long as the same list is asked for."""
    if not _built or _built[0][0] is not items or _built[0][1] != size:
        _built[:] = [(items, size, WindowSet(items, size))]
    return _built[0][2]


def _scan(df: DataFrame, items: list[tuple[str | None, str | None]], size: int, added: tuple[str, str, str], first: bool) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(items)
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    kinds = (T.LongType(), T.ArrayType(span), T.ArrayType(T.StringType()))
    fields = [f for f in df.schema.fields if f.name not in added]
    schema = T.StructType([*fields, *(T.StructField(n, k) for n, k in zip(added, kinds, strict=True))])
    names = [f.name for f in fields]

    def run(batches):
        windows = window_set(shared.value, size)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                words = [words_of(t.as_py()) for t in batch.column("text")]
                hits = windows.scan(words)
                if not first:
                    before = zip(batch.column(added[1]).to_pylist(), batch.column(added[2]).to_pylist(), strict=True)
                    hits = [(merged([*spans, *((s["start"], s["end"]) for s in old)]), items | set(had)) for (spans, items), (old, had) in zip(hits, before, strict=True)]
                columns = [
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in spans] for spans, _ in hits], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    pa.array([sorted(items) for _, items in hits], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *columns], names=[*names, *added])

    return df.mapInArrow(run, schema)


def n_hit(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0), lambda n, s: n + s["end"] - s["start"]).cast("long")


def contamination(df: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each document."""
    hits = benchmark_hits(df.select("doc_id", "text"), benchmark, size).withColumn("n_hit", n_hit())
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(df: DataFrame, benchmark: DataFrame, size: int = 13, remove: str = "documents") -> DataFrame:
    """`df` without contaminated documents ("documents"), or with hit words cut from texts ("spans")."""
    added = tuple(free_name(n, df.columns) for n in ADDED)
    hits, (n_words, spans, _) = benchmark_hits(df, benchmark, size, names=added), added
    if remove == "documents":
        hit = n_hit(spans)
        return hits.where(~((hit > 0) & (20 * hit >= F.col(n_words)))).select(df.columns)
    pattern = "[0-9A-Za-z\\u0080-\\x{10FFFF}]+"
    pieces = F.split("text", f"(?={pattern})(?<![0-9A-Za-z\\u0080-\\x{{10FFFF}}])")
    lead = F.when(F.col("text").rlike(f"^(?:{pattern})"), 0).otherwise(1)
    kept = F.filter(pieces, lambda p, i: ~F.exists(spans, lambda s: (i - lead >= s["start"]) & (i - lead < s["end"])))
    return hits.withColumn("text", F.when(F.size(spans) > 0, F.array_join(kept, "")).otherwise(F.col("text"))).select(df.columns)

