"""Filter interaction audit: what each filter removes in each of the 120 orders of five filters.

A text fails A with under 200 words, B if fewer than half of its words are distinct, C if over 2 %
of its code points are capitals A-Z, D if it holds one of the signs of `SIGNS`, and E if a smaller
doc_id anywhere in the table has the same text. The failures of a document are a mask of five bits;
`FIRST[mask, order]` is the step that removes it, so that no order is ever run. Tasks count removals
by part, order and step with bincount, once for all documents and once for each label, and Spark adds
the partial counts. What is redundant, unique or kept follows from these counts and those of the masks.

Same texts are found by SHA-256: the least doc_id of each digest is a partial aggregate, joined back
on doc_id and digest, so that a text of a third of all rows is nobody's key.

Defined cases: a null text is the empty text (no words, fails A) and the same as other empty ones;
a null part is ''; a row without doc_id is no copy, and none is a copy of it; rows that repeat a
doc_id count each, and none is a copy of the other; of several labels of a doc_id the highest counts,
and rows without a label are neither good nor toxic; an empty table gives no parts and so no rows;
other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.session import cut

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
SIGNS = b"#$%&*|"
#: Words are cut out of a text in pieces of so many bytes.
PIECE = 1 << 22
#: Rows whose steps are counted at once, and parts whose counts a task holds before it passes them on.
SLICE, HELD_PARTS = 2048, 1024

_WHITE = re.compile(rb"[\x20\x09-\x0D]")
_CAPITALS = bytes(range(0x41, 0x5B))


def first_failures() -> np.ndarray:
    """32 x 120: the step (from 0) at which a document with these failures goes, STEPS if it stays."""
    bit = {f: i for i, f in enumerate(FILTERS)}
    fails = (np.arange(1 << STEPS)[:, None] >> np.array([[bit[f] for f in order] for order in ORDERS]).reshape(1, -1)) & 1
    fails = fails.reshape(1 << STEPS, len(ORDERS), STEPS)
    return np.where(fails.any(axis=2), fails.argmax(axis=2), STEPS)


FIRST = first_failures()
#: A part's counts: removals of each order and step (and none), of all, good and toxic documents, then masks.
CELLS = len(ORDERS) * (STEPS + 1)
WIDE = 3 * CELLS + (1 << STEPS)


def words_in(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, piece by piece; no word is cut."""
    start = 0
    while start < len(text):
        stop = start + PIECE
        white = _WHITE.search(text, stop) if stop < len(text) else None
        stop = white.start() if white else len(text)
        yield text[start:stop].split()  # for bytes: space and \x09 to \x0D
        start = stop


def own_failures(text: bytes, points: int) -> int:
    """Bits of A to D for a text in UTF-8 with so many code points."""
    words, distinct = 0, set()
    for part in words_in(text):
        words += len(part)
        distinct.update(part)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    signs = len(text) - len(text.translate(None, SIGNS))
    return (words < 200) | (100 * len(distinct) < 50 * words) << 1 | (100 * capitals > 2 * points) << 2 | (signs > 0) << 3


def failures(df: DataFrame, labels: DataFrame, part: str = "source", text: str = "text") -> DataFrame:
    """doc_id, part, mask (bit i: fails FILTERS[i]), good and toxic (booleans) of every row of `df`.

    labels: doc_id, quality and toxic.
    """
    rows = df.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("part", T.StringType()), T.StructField("mask", T.IntegerType()), T.StructField("digest", T.BinaryType())])

    def scan(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            found = [(own_failures(t, n), hashlib.sha256(t).digest()) for t, n in ((x.as_py(), n) for x, n in zip(texts.cast(pa.binary()), pc.utf8_length(texts).to_pylist(), strict=True))]
            columns = [batch.column("doc_id"), batch.column("part"), pa.array([m for m, _ in found], pa.int32()), pa.array([d for _, d in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    seen = cut(rows.mapInArrow(scan, schema))  # texts are read once; both readers take the short rows
    first = seen.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(*(F.max((F.col(c) == 1).cast("int")).alias(c) for c in ("quality", "toxic")))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    joined = seen.join(first, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    return joined.select("doc_id", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"), *(F.coalesce(F.col(a) == 1, F.lit(False)).alias(b) for a, b in (("quality", "good"), ("toxic", "toxic"))))


def counted(codes: np.ndarray, parts: int, mask: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """parts x WIDE counts of rows with these part codes, masks and labels."""
    cell = (codes[:, None] * len(ORDERS) + np.arange(len(ORDERS))) * (STEPS + 1) + FIRST[mask]
    removed = [np.bincount(cell[of].ravel(), minlength=parts * CELLS).reshape(parts, CELLS) for of in (slice(None), good, toxic)]
    return np.hstack([*removed, np.bincount((codes << STEPS) + mask, minlength=parts << STEPS).reshape(parts, -1)])


def partial_counts(masks: DataFrame) -> DataFrame:
    """part, cell and n: counts of `failures`, those of all tasks added up."""

    def tally(batches):
        held: dict[str, np.ndarray] = {}

        def passed_on():
            for name, counts in held.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["part", "cell", "n"])
            held.clear()

        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                piece = batch.slice(start, SLICE)
                names = piece.column("part").dictionary_encode()
                mask, good, toxic = (piece.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "good", "toxic"))
                counts = counted(names.indices.to_numpy().astype(np.int64), len(names.dictionary), mask, good, toxic)
                for name, row in zip(names.dictionary.to_pylist(), counts, strict=True):
                    held[name] = held[name] + row if name in held else row
                if len(held) > HELD_PARTS:
                    yield from passed_on()
        yield from passed_on()

    cells = masks.select("part", "mask", "good", "toxic").mapInArrow(tally, "part string, cell int, n long")
    return cells.groupBy("part", "cell").agg(F.sum("n").alias("n"))


def report_of(counts: np.ndarray) -> dict[str, np.ndarray]:
    """The columns of one part's report, 120 x 5 each, from its counts."""
    removed, good, toxic = (counts[i * CELLS : (i + 1) * CELLS].reshape(len(ORDERS), STEPS + 1)[:, :STEPS] for i in range(3))
    masks = counts[3 * CELLS :]
    at = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    fails = np.array([masks[(np.arange(len(masks)) >> i) & 1 == 1].sum() for i in range(STEPS)])
    shapley = np.array([removed[at == i].sum() for i in range(STEPS)])
    return {
        "kept": masks.sum() - removed.cumsum(axis=1), "removed": removed, "redundant": fails[at] - removed,
        "unique_fails": masks[1 << np.arange(STEPS)][at], "good_lost": good, "toxic_lost": toxic, "shapley": shapley[at],
    }


def audit(df: DataFrame, labels: DataFrame, part: str = "source", text: str = "text") -> DataFrame:
    """One row for each part, order and step, zeros included.

    Columns part, filter_order, step (from 1), kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley; the filter of a step is the letter of filter_order there.
    """
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    schema = "part string, filter_order string, step int, " + ", ".join(f"{n} long" for n in names)
    cells = partial_counts(failures(df, labels, part, text)).groupBy("part").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))  # WIDE at most

    def expand(batches):
        for batch in batches:
            for name, found in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                counts = np.zeros(WIDE, np.int64)
                counts[[c["cell"] for c in found]] = [c["n"] for c in found]
                report = report_of(counts)
                fixed = [pa.array([name] * len(ORDERS) * STEPS), pa.array(np.repeat(ORDERS, STEPS)), pa.array(np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS)))]
                yield pa.RecordBatch.from_arrays([*fixed, *(pa.array(report[n].ravel().astype(np.int64)) for n in names)], names=["part", "filter_order", "step", *names])

    return cells.mapInArrow(expand, schema)


def audit_sql() -> str:
    """The report in DuckDB SQL over documents and labels."""
    return r"""
WITH letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT concat(a.f, b.f, c.f, d.f, e.f) AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, s AS step, filter_order[s] AS f, filter_order[:s - 1] AS before FROM orders, range(1, 6) t(s)),
texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM texts),
failing AS (
  SELECT doc_id, part, concat(
    CASE WHEN len(w) < 200 THEN 'A' END,
    CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END,
    CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' END,
    CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
    CASE WHEN min(doc_id) OVER (PARTITION BY text) < doc_id THEN 'E' END) AS fails
  FROM words),
marks AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
kinds AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
  FROM failing LEFT JOIN marks USING (doc_id) GROUP BY part, fails),
at_step AS (
  SELECT part, filter_order, step, f, n, good, toxic, fails,
    contains(fails, f) AS failing, len(list_filter(string_split(before, ''), lambda x: x <> '' AND contains(fails, x))) > 0 AS gone
  FROM kinds, steps),
summed AS (
  SELECT part, filter_order, step, f,
    sum(n) FILTER (NOT gone AND NOT failing) AS kept, sum(n) FILTER (failing AND NOT gone) AS removed,
    sum(n) FILTER (failing AND gone) AS redundant, sum(n) FILTER (fails = f) AS unique_fails,
    sum(good) FILTER (failing AND NOT gone) AS good_lost, sum(toxic) FILTER (failing AND NOT gone) AS toxic_lost
  FROM at_step GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step::INTEGER AS step,
  coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
  coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
FROM summed"""
