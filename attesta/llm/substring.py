"""Substring dedup by compact windows.

Tokens are shingles of five words. For each of `HASHES` hash functions the Cartesian tree of
a text's token hashes, built from the top and pruned below the least length, gives compact
windows (l, c, r): every passage within [l, r] that holds c has the token at c as its
min-hash. Windows of two functions are joined where their intervals meet: every passage in
the common interval that holds both minima has this signature of two tokens. The signatures
key a join over documents, so texts that meet agree in two functions on one interval: an
equal passage always does, one of a similarity of 0.8 does in 90 of 100 cases, one of 0.9 in 97. They
are then verified on the words, from the shared token over small edits while the Jaccard
similarity of five-word shingles stays at SIMILARITY or more.

A key links each of its windows to its first document (smallest doc_id). Where a batch of a task
has many windows of a key, they are linked to the first of the batch, which alone goes on, so
that a passage of very many documents is spread over the tasks. A text that does not share a passage
with its first document is not done: it goes on under keys of where their common words end
and of what follows there, on each side, which any other text that shares a passage
around that token has too. This is repeated until no key holds two texts; the common words
grow each time, so that it ends.

A repeated passage has MIN_WORDS words or more and stands in another document too. Its first
document keeps it. Documents whose whole text stands in an earlier one are copies: one text
stands for all of them, and each task sends the windows of a text only once.

Defined cases: null and empty texts, and texts of fewer than MIN_WORDS words, have no
passages; rows without doc_id take no part and stay as they are; rows that repeat a doc_id
with another text are documents of their own (ordered by text hash), rows that repeat both
are one; repeats inside one document are left; an empty table gives no rows; extra columns
pass through `drop_repeats`.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.session import cut

MIN_WORDS, SHINGLE, SIMILARITY = 50, 5, 0.8
HASHES = 3
#: Words that may differ in a row while a passage grows.
GAP = 3

_BASE = 0x100000001B3
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse, modulo 2^64."""
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        steps = np.full(size, _BASE, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
        steps = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        steps[0] = 1
        _inverse = np.multiply.accumulate(steps)
    return _powers, _inverse


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer, another function for each seed."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(text: str | None, size: int) -> np.ndarray:
    """A hash of each run of `size` words, A-Z in lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < size:
        return np.zeros(0, np.uint64)
    data = b" ".join(words)
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    return mixed((sums[ends] - sums[starts]) * inverse[starts])


def shingles_of(words: np.ndarray) -> np.ndarray:
    """A hash of each run of SHINGLE words, given the hashes of the words."""
    n = max(0, len(words) - SHINGLE + 1)
    found = words[:n].copy()
    for k in range(1, SHINGLE):
        found = found * np.uint64(_BASE) + words[k : n + k]
    return mixed(found)


_places = np.zeros(0, np.uint64)


def _place_hashes(n: int) -> np.ndarray:
    """A hash of 20 bits of each of the first n places, worked out once for all texts of a worker."""
    global _places
    if len(_places) < n:
        _places = mixed(np.arange(1 << (n - 1).bit_length(), dtype=np.uint64), 99) >> np.uint64(44)
    return _places[:n]


def spread(values: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of tokens, made distinct: equal tokens stand in an order by place, so that trees stay low."""
    return mixed(values, seed) & ~np.uint64(0xFFFFF) | _place_hashes(len(values))


def compact_windows(values: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(l, c, r) of the Cartesian tree's nodes that span `least` tokens or more; values are distinct."""
    found, stack = [], [(0, len(values))] if len(values) >= least else []
    while stack:
        l, end = stack.pop()  # noqa: E741
        c = l + int(values[l:end].argmin())
        found.append((l, c, end - 1))
        if c - l >= least:
            stack.append((l, c))
        if end - c > least:
            stack.append((c + 1, end))
    return found


def joined_intervals(one: np.ndarray, other: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(c, c of other) of windows of two functions whose common interval holds both minima and `least` tokens."""
    other = other[np.argsort(other[:, 1])]
    l, c, r = one.T  # noqa: E741
    lows, highs = np.searchsorted(other[:, 1], l), np.searchsorted(other[:, 1], r, "right")
    n = highs - lows
    x = np.repeat(np.arange(len(one)), n)
    y = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lows, n)
    left, right = np.maximum(l[x], other[y, 0]), np.minimum(r[x], other[y, 2])
    fits = (other[y, 0] <= c[x]) & (c[x] <= other[y, 2]) & (right - left + 1 >= least)
    return c[x[fits]], other[y[fits], 1]


def window_keys(tokens: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of two functions, and the token each stands at."""
    windows = [np.array(compact_windows(spread(tokens, i), least), np.int64).reshape(-1, 3) for i in range(1, HASHES + 1)]
    found = []
    for i, j in itertools.combinations(range(HASHES), 2):
        c, d = joined_intervals(windows[i], windows[j], least)
        found.append((mixed(tokens[c] ^ mixed(tokens[d], 64 + j), 1 + i), c))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def same_run(a: np.ndarray, b: np.ndarray) -> int:
    """How many words a and b have in common from the start."""
    done, n, size = 0, min(len(a), len(b)), 64
    while done < n:
        step = min(size, n - done)
        differ = a[done : done + step] != b[done : done + step]
        if differ.any():
            return done + int(differ.argmax())
        done, size = done + step, size * 4
    return n


#: Numbers of words left out in both texts, the smallest gaps and the most even ones first.
GAPS = sorted(((x, y) for x in range(GAP + 1) for y in range(GAP + 1) if x or y), key=lambda g: (sum(g), abs(g[0] - g[1])))
_GAP_RANK = np.full((GAP + 1, GAP + 1), len(GAPS))
for _rank, (_x, _y) in enumerate(GAPS):
    _GAP_RANK[_x, _y] = _rank


def grow(a: np.ndarray, b: np.ndarray, next_a: np.ndarray, next_b: np.ndarray, tokens: int, length_a: int, length_b: int) -> tuple[int, int, int, int, int]:
    """How far a passage goes on over gaps in a and b from their starts, and what it then has.

    next_a, next_b: at each place, the hash of the shingle that goes on from there; tokens, length_a,
    length_b: the shingles the passage shares so far and its words in both.
    It ends at the last run up to which the similarity of the whole passage holds; runs before
    that may be below it, as long as those that follow can make up for them.
    """
    i = j = 0
    best = (0, 0, tokens, length_a, length_b)
    while i < len(next_a) and j < len(next_b):
        meet = next_a[i : i + GAP + 1, None] == next_b[None, j : j + GAP + 1]
        rank = np.where(meet, _GAP_RANK[: meet.shape[0], : meet.shape[1]], len(GAPS)).min()
        if rank == len(GAPS):
            break
        x, y = GAPS[rank]
        run = same_run(a[i + x :], b[j + y :])
        tokens, length_a, length_b = tokens + run - SHINGLE + 1, length_a + x + run, length_b + y + run
        i, j = i + x + run, j + y + run
        lacking = SIMILARITY * (length_a + length_b - 2 * (SHINGLE - 1) - tokens) - tokens
        if lacking <= 0:
            best = (i, j, tokens, length_a, length_b)
        elif lacking > (1 - SIMILARITY) * min(len(a) - i, len(b) - j):
            break
    return best


def passages(first: str | None, text: str | None, seeds: list[tuple[int, int]], least: int = MIN_WORDS) -> list[tuple[int, int, int, int]]:
    """Verified passages (start, end, first_start, first_end) of `text` that repeat `first`, in words.

    seeds: words of `text` and of `first` where a shingle is shared. Runs of `least` words
    that are equal in both are found whether there is a seed in them or not.
    """
    a, b = run_hashes(text, 1), run_hashes(first, 1)
    return shared_passages(a, b, seed_runs(a, b, seeds), least)


def shared_passages(a: np.ndarray, b: np.ndarray, runs: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int, int]]:
    """The same, by the hashes of the words of `text` and of `first`, and the runs of equal words around seeds."""
    tokens, other = shingles_of(a), shingles_of(b)
    found: list[tuple[int, int, int, int]] = []

    def try_run(p: int, q: int, n: int) -> None:
        # n equal words from p and q on count before any gap is judged
        back = lambda x, t, at: (x[:at][::-1], t[: max(0, at - SHINGLE + 1)][::-1])
        before = (*back(a, tokens, p), *back(b, other, q))
        after = (a[p + n :], tokens[p + n :], b[q + n :], other[q + n :])
        state, left, right, moved = (n - SHINGLE + 1, n, n), [0, 0], [0, 0], True
        while moved:
            moved = False
            for side, at in ((after, right), (before, left)):
                one, t_one, two, t_two = side
                x, y, *state = grow(one[at[0] :], two[at[1] :], t_one[at[0] :], t_two[at[1] :], *state)
                at[0], at[1], moved = at[0] + x, at[1] + y, moved or x > 0
        start, end, start_b, end_b = p - left[0], p + n + right[0], q - left[1], q + n + right[1]
        if end - start >= least:
            one, two = set(tokens[start : end - SHINGLE + 1].tolist()), set(other[start_b : end_b - SHINGLE + 1].tolist())
            if len(one & two) >= SIMILARITY * len(one | two):
                found.append((start, end, start_b, end_b))

    for p, q, n in runs:
        if not any(s <= p and p + SHINGLE <= e and abs((p - s) - (q - t)) <= GAP * 8 for s, e, t, _ in found):
            try_run(p, q, n)
    # texts that repeat lines meet at one of many places: what is left uncovered is looked up
    far = least - SHINGLE
    if len(tokens) <= far or len(other) <= far:
        return found
    covered = np.zeros(len(tokens), bool)
    for s, e, *_ in found:
        covered[s : e - least + 1] = True
    order = np.argsort(other)
    ranked = other[order]
    lows = np.searchsorted(ranked, tokens)
    absent = np.concatenate(([0], np.cumsum(ranked[np.minimum(lows, len(ranked) - 1)] != tokens)))
    at = 0
    for p in np.flatnonzero((absent[far + 1 :] == absent[: -far - 1]) & ~covered[: len(tokens) - far]).tolist():
        if p < at:
            continue
        places = order[lows[p] : np.searchsorted(ranked, tokens[p], "right")]
        places = places[places < len(other) - far]
        for step in range(far, 0, -SHINGLE):  # tokens that touch end to end make the whole run
            if not len(places):
                break
            places = places[other[places + step] == tokens[p + step]]
        if len(places):
            q = int(places.min())
            right, left = same_run(a[p:], b[q:]), same_run(a[:p][::-1], b[:q][::-1])
            if right >= least:
                found.append((p - left, p + right, q - left, q + right))
                at = p + right - least + 1
    return found


def seed_runs(a: np.ndarray, b: np.ndarray, seeds: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of the runs of equal words around seeds, each once, in order."""
    found, ends = set(), {}
    for p, q in sorted(seeds):
        if p < ends.get(p - q, 0) or not np.array_equal(a[p : p + SHINGLE], b[q : q + SHINGLE]):
            continue
        after, before = same_run(a[p:], b[q:]), same_run(a[:p][::-1], b[:q][::-1])
        ends[p - q] = p + after - SHINGLE + 1
        found.add((p - before, q - before, before + after))
    return sorted(found)


def open_ends(a: np.ndarray, seeds: list[tuple[int, int]], runs: list[tuple[int, int, int]], found: list[tuple[int, int, int, int]], salt: int) -> list[tuple[int, int]]:
    """(key, word) of seeds that lie in no passage found: where the common words end, and what follows.

    A third text that shares a passage around the seed with text a, but not with b, goes on
    as a does on one side at least, and so has the same key there. runs: of equal words around
    the seeds; salt: the hash of text b.
    """
    held = np.zeros(len(a) + 1, bool)
    for s, e, *_ in found:
        held[s : max(s, e - SHINGLE + 1)] = True
    by_diagonal: dict[int, list[tuple[int, int]]] = {}
    for p, q, n in runs:
        by_diagonal.setdefault(p - q, []).append((p, n))
    at, low, high = [], [], []
    for p, q in seeds:
        if not held[p]:
            for start, n in by_diagonal.get(p - q, ()):
                if start <= p and p + SHINGLE <= start + n:
                    at.append(p)
                    low.append(start - 1)
                    high.append(start + n)
                    break
    if not at:
        return []
    at, low, high = (np.array(x) for x in (at, low, high))
    tokens, salted = shingles_of(a)[at], np.uint64(salt & (2**64 - 1))
    keys = []
    for far, side in ((high, 1), (low, -1)):
        inside = (far >= 0) & (far < len(a))
        x, away = at[inside], (far - at)[inside]
        key = mixed(tokens[inside] ^ mixed(a[far[inside]] ^ away.astype(np.uint64), 8) ^ salted, 9 + side)
        keys += zip(key.view(np.int64).tolist(), x.tolist(), strict=True)
    return keys


#: Texts (of two numbers each) that are named in a broadcast at most.
BROADCAST_TEXTS = 200_000
#: Windows of a key from which on the others of a batch are linked to the first of them.
HOT = 8
#: What a task sends: a window (first_at below zero), or a link within a batch, whose `key` is the text it is linked to.
SENT = ("key", "doc_id", "gid", "at", "first_at")


def sent_rows(keys: np.ndarray, ids: np.ndarray, gids: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """The windows of a batch; of keys with HOT and more, those of the first text, and links of the other texts to it."""
    order = np.lexsort((at, gids, ids, keys))
    keys, ids, gids, at = keys[order], ids[order], gids[order], at[order]
    fresh = np.concatenate(([True], keys[1:] != keys[:-1]))
    lead = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    counts = np.diff(np.append(np.flatnonzero(fresh), len(keys)))
    linked = (gids != gids[lead]) & (np.repeat(counts, counts) >= HOT)
    columns = (np.where(linked, gids[lead], keys), ids, gids, at.astype(np.int32), np.where(linked, at[lead], -1).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=list(SENT))


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, k, nullable=False) for n, k in fields])


def _windows(docs: DataFrame, least_words: int) -> DataFrame:
    """Window keys of all texts, as SENT says.

    Of the copies of a text a task sends the first, and again only one with a smaller doc_id,
    so that the first document of a text is always among them.
    """

    def run(batches):
        sent: dict[int, int] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                found, ids, gids = [], [], []
                for doc, gid, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "gid", "text")), strict=True):
                    if gid in sent and sent[gid] <= doc:
                        continue
                    sent[gid] = doc
                    tokens = run_hashes(text, SHINGLE)
                    if len(tokens) < least_words - SHINGLE + 1:
                        continue
                    found.append(window_keys(tokens, least_words - SHINGLE + 1))
                    ids.append(np.full(len(found[-1][0]), doc, np.int64))
                    gids.append(np.full(len(found[-1][0]), gid, np.int64))
                if found:
                    keys, at = (np.concatenate(x) for x in zip(*found, strict=True))
                    if len(keys):
                        yield sent_rows(keys.view(np.int64), np.concatenate(ids), np.concatenate(gids), at)

    long, int_ = T.LongType(), T.IntegerType()
    return docs.mapInArrow(run, _schema(("key", long), ("doc_id", long), ("gid", long), ("at", int_), ("first_at", int_)))


def links_of(windows: DataFrame) -> DataFrame:
    """(gid, doc_id, at, first_gid, first_at): each window beside that of the first document of its key.

    Windows of a key meet once: the first of them and all of them read one shuffle, which
    Spark reuses as both need the same columns, none of them nullable.
    """
    met = windows.repartition("key")
    window = F.when(F.col("first_at") < 0, F.struct("doc_id", "gid", "at", "first_at"))
    firsts = met.groupBy("key").agg(F.min(window).alias("f"), F.min(window["gid"]).alias("lo"), F.max(window["gid"]).alias("hi")).where("lo <> hi").select("key", "f")
    local, own = F.col("first_at") >= 0, F.col("gid") != F.col("f.gid")  # a key of links has no first
    kept = met.join(firsts, "key", "left").where(local | own)
    return kept.select("gid", "doc_id", "at", F.when(local, F.col("key")).otherwise(F.col("f.gid")).alias("first_gid"), F.when(local, F.col("first_at")).otherwise(F.col("f.at")).alias("first_at"))


#: Rows of `judged`: a passage, or (with first_id null) a word at which a text goes on under another key.
JUDGED = "doc_id long, gid long, start int, end int, first_id long, first_start int, first_end int, key long"


def judged(links: DataFrame, docs: DataFrame, texts: DataFrame, least_words: int) -> DataFrame:
    """Verified passages of linked texts, and keys under which a text goes on that shares none; see JUDGED.

    docs: doc_id, gid, text, one row each; texts: gid and least_id, the first document of each text.
    """
    # the smallest doc_id is asked for only so that both readers of the windows need the same columns (see links_of)
    pairs = cut(links.groupBy("gid", "first_gid").agg(F.collect_set(F.struct("at", "first_at")).alias("seeds"), F.min("doc_id").alias("seen_id")))
    # a pair is kept by the later of its texts; both are named by their first document
    named = pairs.join(texts, "gid").join(texts.select(F.col("gid").alias("first_gid"), F.col("least_id").alias("first_id")), "first_gid")
    late = (F.col("first_id") < F.col("least_id")) | (F.col("first_id") == F.col("least_id")) & (F.col("first_gid") < F.col("gid"))
    turned = F.transform("seeds", lambda s: F.struct(s["first_at"].alias("at"), s["at"].alias("first_at")))
    ends = lambda c, other: F.when(late, F.col(c)).otherwise(F.col(other))
    named = named.select(ends("gid", "first_gid").alias("gid"), ends("least_id", "first_id").alias("least_id"), ends("first_gid", "gid").alias("first_gid"), ends("first_id", "least_id").alias("first_id"), F.when(late, F.col("seeds")).otherwise(turned).alias("seeds"))
    named = cut(named.withColumn("pair", F.xxhash64("gid", "first_gid")))
    sides = named.select("pair", F.col("gid").alias("of"), F.col("least_id").alias("id"), F.lit(0).alias("side")).unionByName(
        named.select("pair", F.col("first_gid").alias("of"), F.col("first_id").alias("id"), F.lit(1).alias("side"))
    )
    # the texts of both sides, from one shuffle of the documents
    held = docs.join(sides.distinct(), (docs.doc_id == sides.id) & (docs.gid == sides.of)).select("pair", "side", "text")
    both = held.groupBy("pair").agg(F.max(F.when(F.col("side") == 0, F.col("text"))).alias("text"), F.max(F.when(F.col("side") == 1, F.col("text"))).alias("first_text"))
    both = both.join(named, "pair").select("gid", F.col("least_id").alias("doc_id"), "first_id", "first_gid", "seeds", "text", "first_text")

    def verify(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 128):
                rows = []
                for r in whole.slice(start, 128).to_pylist():
                    seeds = [(s["at"], s["first_at"]) for s in r["seeds"]]
                    a, b = run_hashes(r["text"], 1), run_hashes(r["first_text"], 1)
                    runs = seed_runs(a, b, seeds)
                    found = shared_passages(a, b, runs, least_words)
                    rows += [(r["doc_id"], r["gid"], s, e, r["first_id"], t, u, None) for s, e, t, u in found]
                    rows += [(r["doc_id"], r["gid"], at, None, None, None, None, key) for key, at in set(open_ends(a, seeds, runs, found, r["first_gid"]))]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
                    names = ["doc_id", "gid", "start", "end", "first_id", "first_start", "first_end", "key"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return both.mapInArrow(verify, JUDGED)


def repeats(df: DataFrame, least_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, gid, start, end, first_id, first_start, first_end): passages that repeat an earlier document.

    Positions count words; gid is the hash of the text. A passage has one row, with the earliest
    document that it was verified against. Copies of a whole text have one row,
    from its first to its last word.
    """
    docs = df.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text", F.length("text")).alias("gid"), "text")
    ids = cut(_counted(docs))
    texts = cut(ids.groupBy("gid").agg(F.min("doc_id").alias("least_id")))
    one_each = docs.dropDuplicates(["doc_id", "gid"]) if _repeated(ids) else docs
    links, found, again = links_of(_windows(docs, least_words)), None, False
    while True:
        seen = cut(judged(links, one_each, texts, least_words))
        passages_ = seen.where("first_id is not null").drop("key")
        found = passages_ if found is None else found.unionByName(passages_)
        # texts that share no passage with the first document meet those that go on alike
        going = seen.where("first_id is null").select("key", "doc_id", "gid", F.col("start").alias("at"))
        firsts = going.groupBy("key").agg(F.min(F.struct("doc_id", "gid", "at")).alias("f"), F.min("gid").alias("lo"), F.max("gid").alias("hi")).where("lo <> hi").select("key", "f")
        links = cut(going.join(firsts, "key").where("gid <> f.gid").select("gid", "doc_id", "at", F.col("f.gid").alias("first_gid"), F.col("f.at").alias("first_at")))
        if links.isEmpty():
            break
        if not again:  # all further rounds are among the texts of this one
            some = cut(links.select("gid").union(links.select("first_gid")).distinct().join(texts, "gid").select(F.col("gid").alias("of"), "least_id"))
            few = some.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS
            held = (F.col("gid") == F.col("of")) & (F.col("doc_id") == F.col("least_id"))
            one_each, again = cut(one_each.join(F.broadcast(some) if few else some, held, "left_semi")), True
    # a passage that was met under several keys has one row, with the smallest of the documents that hold it
    first = F.min(F.struct("first_id", "first_start", "first_end")).alias("f")
    found = found.groupBy("doc_id", "gid", "start", "end").agg(first).select("doc_id", "gid", "start", "end", "f.*")
    counted = ids.where(F.col("n") >= least_words).distinct()
    copies = counted.join(texts, "gid").where("doc_id > least_id").select("doc_id", "gid", F.lit(0).alias("start"), F.col("n").alias("end"), F.col("least_id").alias("first_id"), F.lit(0).alias("first_start"), F.col("n").alias("first_end"))
    return found.unionByName(copies)


def _counted(docs: DataFrame) -> DataFrame:
    """(doc_id, gid, n): the number of words of each row of docs."""

    def run(batches):
        for batch in batches:
            n = [len(t.as_py().encode("utf-8", "surrogatepass").split()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("gid"), pa.array(n, pa.int32())], names=["doc_id", "gid", "n"])

    return docs.mapInArrow(run, "doc_id long, gid long, n int")


def _repeated(ids: DataFrame) -> bool:
    """Whether some document stands in the table more than once."""
    return not ids.groupBy("doc_id", "gid").count().where("count > 1").isEmpty()


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words in spans, with the white space before each of them."""
    gone = np.zeros(max(e for _, e in spans), bool)
    for s, e in spans:
        gone[s:e] = True
    kept, at = [], 0
    for n, match in enumerate(re.finditer(r"[^ \t-\r]+", text)):
        if n >= len(gone):
            kept.append(text[at:])
            break
        if not gone[n]:
            kept.append(text[at : match.end()])
        at = match.end()
    return "".join(kept).strip()


def drop_repeats(df: DataFrame, least_words: int = MIN_WORDS) -> DataFrame:
    """`df` with repeated passages cut from all texts but the first; texts left empty go.

    A column n_chars, if there is one, is set to the new length.
    """
    found = repeats(df, least_words).groupBy("doc_id", "gid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    found = found.select(F.col("doc_id").alias("of_id"), F.col("gid").alias("of_gid"), "spans")
    gid = F.xxhash64(df["text"], F.length(df["text"]))
    joined = df.join(found, (df["doc_id"] == found["of_id"]) & (gid == found["of_gid"]), "left").select(df["*"], found["spans"].alias("repeat spans"))
    names = df.columns

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                spans, texts = part.column("repeat spans").to_pylist(), part.column("text").to_pylist()
                texts = [cut_words(t, [(s["start"], s["end"]) for s in cut]) if cut else t for t, cut in zip(texts, spans, strict=True)]
                keep = pa.array([not cut or bool(t) for t, cut in zip(texts, spans, strict=True)])
                columns = {n: part.column(n) for n in names} | {"text": pa.array(texts, pa.string())}
                if "n_chars" in names:
                    columns["n_chars"] = pa.array([n if not cut else len(t) for n, t, cut in zip(part.column("n_chars").to_pylist(), texts, spans, strict=True)], part.column("n_chars").type)
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names).filter(keep)

    return joined.mapInArrow(run, T.StructType(df.schema.fields))
