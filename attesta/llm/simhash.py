"""SimHash near-duplicate detection by a self-join of binary tries of fingerprints.

Fingerprints within `max_bits` differing bits agree on one of max_bits + 1 blocks of bits.
For each block the fingerprint is turned so that the block stands first; rows meet by that
block (by several blocks, where there are very many fingerprints), and below it a binary trie is joined with itself: node pairs go down together, each
pair carries the bits that differ so far and is pruned beyond the budget.

Equal fingerprints are one trie leaf, so exact copies cost nothing. A pair of nodes whose
leaves already are of one component is pruned too: dense groups of near copies give a
spanning forest, not their pairs.

`near_duplicates` links fingerprints as such. `verified_copies` takes PRINTS fingerprints of a
text, each by another hash of the same shingles: texts are candidates if one of them differs
in at most max_bits bits and all of them together in at most TOTAL bits each on average, so
that chance links of single fingerprints never join components; candidates are then verified on the shingles.

Defined cases: null and empty texts, and texts of white space, have the fingerprint zero and
are linked like any other; rows with equal doc_id each get the component of their text; a
null doc_id is never the name of a component unless no other id is in it; an empty table
gives no rows; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import itertools
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.graph import TASK_EDGES, components, in_tasks
from attesta.llm.substring import mixed
from attesta.session import cut

#: Node pairs that are expanded at once.
CHUNK = 100_000
#: A trie node of as many keys is a leaf; key pairs of leaves that are compared at once.
LEAF, LEAF_CELLS = 64, 1 << 20
#: Fingerprints that may meet by chance in one block.
BUCKET = 20_000
#: Fingerprints of a text in `verified_copies`, and bits in which each may differ on average. At a
#: similarity of 0.8 a bit differs in 15 of 100 cases, 9.7 of 64; unlike texts differ in 32.
PRINTS, TOTAL = 3, 16
#: Rows of one task of the trie join, on average.
TASK_ROWS = 500_000
#: Texts and characters of a component up to which its pairs are compared at once, those already connected left out.
SMALL, SMALL_CHARS = 256, 1 << 25
#: Texts and characters, on average, of each side of a cell in which pairs of larger components are compared.
CELL, CELL_CHARS = 256, 1 << 24
#: Keys by which the texts of a larger component meet, each of two min-hashes. Texts of a
#: similarity of 0.8 share none of them in 0.36^BANDS = 5 of a million pairs.
BANDS = 12


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles, repeats included; none of a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))


def majority_bits(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 16_384):
        counts += np.unpackbits(hashes[i : i + 16_384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int) -> int:
    """Bits set in over half of the XXH64 hashes (seed 42) of the word shingles, repeats included."""
    return majority_bits(shingle_hashes(text, shingle))


def fingerprints(df: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp long) of whole texts."""

    def run(batches):
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def block_choices(max_bits: int, n: int) -> list[list[tuple[int, int]]]:
    """Sets of bit blocks, (shift, width) each, one of which any two linked fingerprints agree on.

    64 bits are cut into max_bits + c blocks, of which max_bits errors leave c untouched. The
    more fingerprints, the larger c: more sets, but longer keys, so that about BUCKET
    fingerprints meet by chance. The links found are the same for each c.
    """
    c = 1
    while c < 4 and n >> (64 * c // (max_bits + c)) > BUCKET:
        c += 1
    edges = [round(i * 64 / (max_bits + c)) for i in range(max_bits + c + 1)]
    cut = [(64 - b, b - a) for a, b in itertools.pairwise(edges)]
    return [list(x) for x in itertools.combinations(cut, c)]


def brought_forward(keys: np.ndarray, chosen: list[tuple[int, int]]) -> np.ndarray:
    """Keys with the bits of the chosen blocks first and all others after them."""
    used = np.zeros(64, bool)
    for shift, width in chosen:
        used[shift : shift + width] = True
    rest = [(shift, 1) for shift in range(63, -1, -1) if not used[shift]]
    found = np.zeros_like(keys)
    for shift, width in [*chosen, *rest]:
        found = found << np.uint64(width) | keys >> np.uint64(shift) & np.uint64((1 << width) - 1)
    return found


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the smallest index of each component) after the links a-b."""
    while True:
        x, y = labels[a], labels[b]
        if not (differ := x != y).any():
            return labels
        np.minimum.at(labels, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while (labels[labels] != labels).any():
            labels = labels[labels]


def trie_self_join(keys: np.ndarray, depth: int, max_bits: int, others: np.ndarray | None = None, total: int = 0) -> np.ndarray:
    """Component labels of sorted 64-bit keys, linked at up to max_bits differing bits.

    Only keys that share their first `depth` bits are compared. others: further fingerprints
    of each key; a link then needs at most `total` differing bits in all of them together.
    """
    n = len(keys)
    labels = np.arange(n)
    if n < 2:
        return labels
    top = keys >> np.uint64(64 - depth) if depth else np.zeros(n, np.uint64)
    lows = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1])))
    highs = np.append(lows[1:], n)
    keep = highs - lows > 1
    lows, highs = lows[keep], highs[keep]
    stack = [(depth, np.stack([lows, highs, lows, highs, np.zeros_like(lows)]))]
    steps = np.arange(n)  # of labels along the keys: equal ends mean one component
    while stack:
        level, pairs = stack.pop()
        if pairs.shape[1] > CHUNK:
            stack.append((level, pairs[:, CHUNK:]))
            pairs = pairs[:, :CHUNK]
        a, a_end, b, b_end, bits = pairs
        whole = (labels[a] == labels[b]) & (steps[a_end - 1] == steps[a]) & (steps[b_end - 1] == steps[b])
        pairs = pairs[:, ~whole]
        a, a_end, b, b_end, bits = pairs
        small = ((a_end - a <= LEAF) & (b_end - b <= LEAF)) | (level >= 64)
        if small.any():
            links = [[], []]
            for x, y in leaf_pairs(keys, pairs[:, small], max_bits):
                if others is not None:
                    near = all_bits(keys, others, x, y) <= total
                    x, y = x[near], y[near]
                links[0].append(x)
                links[1].append(y)
            x, y = map(np.concatenate, links)
            if len(x):
                labels = join_labels(labels, x, y)
                steps = np.concatenate(([0], np.cumsum(labels[1:] != labels[:-1])))
            pairs = pairs[:, ~small]
            a, a_end, b, b_end, bits = pairs
        if not pairs.shape[1]:
            continue
        bit = np.uint64(1) << np.uint64(63 - level)
        above = ~((bit << np.uint64(1)) - np.uint64(1)) if level else np.uint64(0)
        cut_a = np.searchsorted(keys, (keys[a] & above) | bit)
        cut_b = np.searchsorted(keys, (keys[b] & above) | bit)
        same = a == b
        down = [(a, cut_a, b, cut_b, bits), (cut_a, a_end, cut_b, b_end, bits), (a, cut_a, cut_b, b_end, bits + 1)]
        down.append(tuple(x[~same] for x in (cut_a, a_end, b, cut_b, bits + 1)))
        following = np.concatenate([np.stack(d) for d in down], axis=1)
        a, a_end, b, b_end, bits = following
        following = following[:, (a < a_end) & (b < b_end) & (bits <= max_bits) & ~((a == b) & (a_end - a < 2))]
        if following.shape[1]:
            stack.append((level + 1, following))
    return labels


def leaf_pairs(keys: np.ndarray, pairs: np.ndarray, max_bits: int):
    """(x, y) of keys within max_bits bits, each in one leaf of a pair of leaves (a, a_end, b, b_end, ...)."""
    a, a_end, b, b_end = pairs[:4]
    order = np.argsort(np.maximum(a_end - a, b_end - b), kind="stable")  # leaves of like sizes together
    at = 0
    while at < len(order):
        wide = int(max(a_end[order[at]] - a[order[at]], b_end[order[at]] - b[order[at]]))
        size = max(1, LEAF_CELLS // max(1, 2 * wide) ** 2)
        part = order[at : at + size]
        at += size
        la, lb = a[part], b[part]
        i, j = np.arange(int((a_end[part] - la).max())), np.arange(int((b_end[part] - lb).max()))
        x, y = la[:, None] + i, lb[:, None] + j
        left, right = keys[np.minimum(x, len(keys) - 1)], keys[np.minimum(y, len(keys) - 1)]
        p, q, r = np.nonzero(np.bitwise_count(left[:, :, None] ^ right[:, None, :]) <= max_bits)
        x, y = x[p, q], y[p, r]
        fits = (x < a_end[part][p]) & (y < b_end[part][p]) & (x < y)
        yield x[fits], y[fits]


def all_bits(keys: np.ndarray, others: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of keys and others together, of the pairs x-y."""
    return np.bitwise_count(keys[x] ^ keys[y]).astype(np.int64) + np.bitwise_count(others[x] ^ others[y]).sum(axis=1, dtype=np.int64)


def stand_ins(keys: np.ndarray, others: np.ndarray, total: int) -> np.ndarray:
    """For each of sorted keys the index of one that stands for it in the trie.

    Of more than four equal keys, those that are near the first of them, or near the one
    before them in order of the other fingerprints, are linked to it and need no comparison.
    """
    found = np.arange(len(keys))
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    first = np.repeat(starts, sizes)
    many = np.flatnonzero((np.repeat(sizes, sizes) > 4) & (found != first))
    near = all_bits(keys, others, many, first[many]) <= total
    found[many[near]] = first[many[near]]
    rest = many[~near]
    follows = rest[all_bits(keys, others, rest, rest - 1) <= total]
    found[follows] = follows - 1
    while (found[found] != found).any():
        found = found[found]
    return found


def _tasks(prints: DataFrame, rows: int) -> int:
    """Tasks of a trie join: as many as shuffles have, more where the table is large."""
    return max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def _meeting(prints: DataFrame, choices: list[list[tuple[int, int]]], names: list[str]) -> DataFrame:
    """`prints` once for each fingerprint and each set of blocks: which, block, and head, by which near ones meet."""
    masks = [sum(((1 << w) - 1) << shift for shift, w in chosen) for chosen in choices]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    entries = [{"which": i, "block": k, "mask": m} for i in range(len(names)) for k, m in enumerate(signed)]
    listed = F.from_json(F.lit(json.dumps(entries)), "array<struct<which:int,block:int,mask:long>>")  # a literal, once folded
    rows = prints.withColumn("x", F.explode(listed))
    own = F.element_at(F.array(*[F.col(n) for n in names]), F.col("x.which") + 1)
    return rows.select("x.which", "x.block", F.xxhash64("x.which", "x.block", own.bitwiseAND(F.col("x.mask"))).alias("head"), *prints.columns)


def fingerprint_links(prints: DataFrame, max_bits: int = 4) -> DataFrame:
    """(a, b): links between distinct fingerprints `fp` that connect all within max_bits bits."""
    n = prints.count()
    choices = block_choices(max_bits, n)
    rows = _meeting(prints.select("fp"), choices, ["fp"]).withColumnRenamed("fp", "key")

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        block = np.concatenate([p.column("block").to_numpy() for p in parts])
        key = np.concatenate([p.column("key").to_numpy() for p in parts]).view(np.uint64)
        for i, chosen in enumerate(choices):
            own = np.unique(key[block == i])
            turned = brought_forward(own, chosen)
            order = np.argsort(turned)
            labels = trie_self_join(turned[order], sum(w for _, w in chosen), max_bits)
            linked = np.flatnonzero(labels != np.arange(len(own)))
            back = own[order].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(back[linked]), pa.array(back[labels[linked]])], names=["a", "b"])

    return rows.repartition(_tasks(prints, n * len(choices)), "block", "head").select("block", "key").mapInArrow(run, "a long, b long")


def candidate_links(prints: DataFrame, max_bits: int, total: int) -> DataFrame:
    """(a, b): links between rows of prints (pid, fp0, fp1, ...) that are near in one fingerprint and in all.

    Near: at most max_bits differing bits in one of them, at most `total` in all together. Rows that meet in a block
    and are connected there are linked to the one with the smallest pid, so that a group which
    meets in many blocks has mostly the same links in each of them.
    """
    names = [f"fp{i}" for i in range(PRINTS)]
    n = prints.count()
    choices = block_choices(max_bits, n)
    rows = _meeting(prints.select("pid", *names), choices, names)

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        which, block, pid = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("which", "block", "pid"))
        fps = np.stack([np.concatenate([p.column(c).to_numpy() for p in parts]) for c in names], axis=1).view(np.uint64)
        for i in range(PRINTS):
            for k, chosen in enumerate(choices):
                at = np.flatnonzero((which == i) & (block == k))
                turned, others = brought_forward(fps[at, i], chosen), np.delete(fps[at], i, axis=1)
                order = np.lexsort((*others.T, turned))
                at, turned, others = at[order], turned[order], others[order]
                stands = stand_ins(turned, others, total)
                chief = np.flatnonzero(stands == np.arange(len(at)))
                labels = trie_self_join(turned[chief], sum(w for _, w in chosen), max_bits, others[chief], total)
                own, joined = pid[at], labels[np.searchsorted(chief, stands)]
                least = np.full(len(chief), np.iinfo(np.int64).max)
                np.minimum.at(least, joined, own)
                least = least[joined]
                yield pa.RecordBatch.from_arrays([pa.array(x[own != least]) for x in (own, least)], names=["a", "b"])

    return rows.repartition(_tasks(prints, n * PRINTS * len(choices)), "which", "block", "head").drop("head").mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """doc_id, fingerprint, component_id and n_links (other fingerprints in the component) of each row."""
    prints = cut(fingerprints(df, shingle))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(fingerprint_links(distinct.select("fp"), max_bits))
    linked = roots.join(distinct, roots.node == distinct.fp).select("fp", "root", "least")
    named = linked.groupBy("root").agg(F.min("least").alias("linked_id"), (F.count("*") - 1).alias("linked_n"))
    linked = linked.join(named, "root").select("fp", "linked_id", "linked_n")
    classes = distinct.join(linked, "fp", "left").select(
        "fp", F.coalesce("linked_id", "least").alias("component_id"), F.coalesce("linked_n", F.lit(0)).alias("n_links")
    )
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; texts without words have one in common."""
    found = np.unique(shingle_hashes(text, size))
    return found if len(found) else np.zeros(1, np.uint64)


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have a Jaccard similarity of `similarity` or more."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    small, large = sorted((a, b), key=len)
    at = np.searchsorted(large, small)
    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return common >= similarity * (len(a) + len(b) - common)


def band_keys(hashes: np.ndarray) -> list[int]:
    """BANDS hashes of two min-hashes each."""
    if not len(hashes):
        return [0] * BANDS
    least = [mixed(hashes, i).min() for i in range(1, 2 * BANDS + 1)]
    return [int(mixed(np.array([a]), i)[0] ^ b) for i, (a, b) in enumerate(itertools.batched(least, 2), 1)]


def similar_pairs(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): those of `pairs` (a, own, b, label) of a Jaccard similarity of `similarity` or more that connect own and label.

    Pairs are compared in cells of about CELL texts, or CELL_CHARS characters, on each side. A text is sent once to a cell
    and hashed once there, however many pairs it stands in; labels that a link of the cell connects are not compared again.
    """
    pairs = pairs.select("a", "own", "b", "label", *[x for x in ("chars_a", "chars_b") if x in pairs.columns])
    if "chars_a" not in pairs.columns:
        lengths = texts.select("gid", F.length("text").alias("chars"))
        for x in "ab":
            pairs = pairs.join(lengths.select(F.col("gid").alias(x), F.col("chars").alias(f"chars_{x}")), x)
    few = pairs.count() <= TASK_EDGES  # of so few pairs, what joins the texts is broadcast
    n, chars = pairs.select("a", "chars_a").distinct().agg(F.count("*"), F.coalesce(F.sum("chars_a"), F.lit(0))).first()
    blocks = max(1, -(-n // CELL), -(-chars // CELL_CHARS))
    by_b = pairs.groupBy(F.pmod(F.xxhash64("a", F.lit("block")), F.lit(blocks)).alias("block"), "b", "chars_b").agg(F.collect_list(F.struct("a", "own", "label")).alias("met"))
    weighed = in_tasks(cut(by_b))
    parts = weighed.groupBy("block").agg(F.greatest(F.ceil(F.count("*") / CELL), F.ceil(F.sum("chars_b") / CELL_CHARS), F.lit(1)).alias("parts"))
    dealt = in_tasks(cut(weighed.join(parts, "block").select("block", F.pmod(F.xxhash64("b", F.lit("part")), "parts").alias("part"), "b", "met").coalesce(weighed.rdd.getNumPartitions())))
    sent = dealt.select("block", "part", F.explode(F.concat("met.a", F.array("b"))).alias("gid")).distinct()
    rows = texts.join(F.broadcast(sent) if few else sent, "gid").select("block", "part", "gid", "text", F.lit(None).cast(dealt.schema["met"].dataType).alias("met"))
    rows = rows.unionByName(dealt.select("block", "part", F.col("b").alias("gid"), F.lit(None).cast("string").alias("text"), "met"))

    def compare(cell):
        asks = cell.column("met").is_valid()
        given, wanted = cell.filter(pc.invert(asks)), cell.filter(asks)
        sets = {g: shingle_set(t.as_py(), shingle) for g, t in zip(given.column("gid").to_pylist(), given.column("text"), strict=True)}
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x] = root.get(root[x], root[x])
            return x

        out = []
        for b, met in zip(wanted.column("gid").to_pylist(), wanted.column("met").to_pylist(), strict=True):
            for m in met:
                x, y = top(m["own"]), top(m["label"])
                if x != y and alike(sets[m["a"]], sets[b], similarity):
                    root[max(x, y)] = min(x, y)
                    out.append((m["a"], b))
        return pa.table([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.groupBy("block", "part").applyInArrow(compare, "a long, b long")


def small_links(member: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b) of member (root, gid, text): links that connect the similar texts of each component; all are small."""

    def run(group):
        gids, sets = group.column("gid").to_pylist(), [shingle_set(t.as_py(), shingle) for t in group.column("text")]
        label, out = list(range(len(gids))), []
        for i, j in itertools.combinations(range(len(gids)), 2):
            if label[i] != label[j] and alike(sets[i], sets[j], similarity):
                label = [label[i] if x == label[j] else x for x in label]
                out.append((gids[i], gids[j]))
        return pa.table([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return member.select("root", "gid", "text").groupBy("root").applyInArrow(run, "a long, b long")


def verified_links(member: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): links of similar texts that connect all similar ones which meet in a component.

    member: root, gid; texts: gid, text. All texts of a small component meet; those of a larger
    one do by band keys, and lead one after the other in an order by hash: 64 times as many
    lead in each turn as in the one before, each against those after it that are not connected
    to it by then. It ends when all have led or all that meet are connected.
    """
    lengths = texts.select("gid", F.length("text").alias("chars"))
    sizes = member.join(lengths, "gid").groupBy("root").agg(F.count("*").alias("size"), F.sum("chars").alias("chars")).where("size > 1")
    member = cut(member.join(sizes, "root"))
    small = (F.col("size") <= SMALL) & (F.col("chars") <= SMALL_CHARS)
    found = cut(small_links(member.where(small).join(texts, "gid"), shingle, similarity))

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts_ = batch.column("text").to_pylist()
                keys, chars = [band_keys(shingle_hashes(t, shingle)) for t in texts_], np.repeat([len(t) for t in texts_], BANDS)
                band = np.tile(np.arange(BANDS, dtype=np.int64), batch.num_rows)
                key = np.array(keys, np.uint64).reshape(-1).view(np.int64)
                gid, root = (np.repeat(batch.column(c).to_numpy(), BANDS) for c in ("gid", "root"))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (root, gid, chars, band, key)], names=["root", "gid", "chars", "band", "key"])

    large = member.where(~small).join(texts, "gid").select("root", "gid", "text")
    keyed = large.mapInArrow(run, "root long, gid long, chars long, band long, key long").select("gid", "chars", F.xxhash64("root", "band", "key").alias("meet"))
    place = (F.xxhash64("gid", F.lit("place")) / F.lit(2.0**64) + 0.5).alias("place")
    keyed = in_tasks(cut(keyed.select("gid", "chars", "meet", place)))
    groups = keyed.groupBy("meet").agg(F.count("*").alias("n"), F.min(F.struct("place", "gid")).alias("first")).where("n > 1")
    soon = (F.col("n") <= 4) | (F.col("gid") == F.col("first.gid")) | (F.col("place") * F.col("n") <= 1)
    turn = F.when(soon, 0).otherwise(F.ceil(F.log(64.0, F.col("place") * F.col("n")))).cast("int")
    open_ = in_tasks(cut(keyed.join(groups, "meet").select("meet", "gid", "chars", "place", turn.alias("turn"), F.col("gid").alias("label")).coalesce(keyed.rdd.getNumPartitions())))
    now = 0
    tasks = open_.rdd.getNumPartitions()  # it only gets fewer rows
    while (last := open_.agg(F.max("turn")).first()[0]) is not None and now <= last:
        lead = open_.where(F.col("turn") == now).select("meet", F.col("gid").alias("a"), F.col("chars").alias("chars_a"), F.col("place").alias("of"), F.col("label").alias("own"))
        after = (F.col("place") > F.col("of")) | (F.col("place") == F.col("of")) & (F.col("gid") > F.col("a"))
        pairs = in_tasks(cut(lead.join(open_, "meet").where(after & (F.col("label") != F.col("own"))).select("a", "own", "chars_a", F.col("gid").alias("b"), "label", F.col("chars").alias("chars_b")).coalesce(tasks).distinct()))
        new = in_tasks(cut(similar_pairs(pairs, texts, shingle, similarity)))
        found, now = found.unionByName(new), now + 1
        merged = in_tasks(components(pairs.join(new, ["a", "b"]).coalesce(pairs.rdd.getNumPartitions()), "own", "label"))
        named = open_.join(merged, open_.label == merged.node, "left").select("meet", "gid", "chars", "place", "turn", F.coalesce("root", "label").alias("label")).coalesce(tasks)
        unsettled = named.groupBy("meet").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("meet")
        open_ = in_tasks(cut(named.join(unsettled, "meet")))
    return found


def verified_copies(df: DataFrame, shingle: int = 5, max_bits: int = 9, similarity: float = 0.8) -> DataFrame:
    """(doc_id, gid, kept_id): documents that a kept one stands for; gid is the hash of the text.

    Equal texts are copies of the one with the smallest doc_id. Others are candidates if near
    fingerprints connect them, and linked if the Jaccard similarity of their word shingles is
    `similarity` or more. The smallest doc_id of all that links connect, directly
    or through others, is kept. Rows without doc_id take no part.
    """
    gid = F.xxhash64(F.coalesce("text", F.lit("")), F.length(F.coalesce("text", F.lit(""))))
    docs = df.where("doc_id is not null").select("doc_id", gid.alias("gid"), F.coalesce("text", F.lit("")).alias("text"))

    names = [f"fp{i}" for i in range(PRINTS)]

    def prints_of(batches):
        for batch in batches:
            hashes = [shingle_hashes(t.as_py(), shingle) for t in batch.column("text")]
            fps = [np.fromiter((majority_bits(h if i == 0 else mixed(h, i)) for h in hashes), np.uint64, batch.num_rows).view(np.int64) for i in range(PRINTS)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("gid"), *map(pa.array, fps)], names=["doc_id", "gid", *names])

    prints = cut(docs.mapInArrow(prints_of, "doc_id long, gid long, " + ", ".join(f"{n} long" for n in names)))
    firsts = cut(prints.groupBy("gid", *names).agg(F.min("doc_id").alias("first_id")).withColumn("pid", F.xxhash64(*names)))
    roots = components(candidate_links(firsts.select("pid", *names).dropDuplicates(["pid"]), max_bits, PRINTS * TOTAL))
    member = firsts.join(roots, firsts.pid == roots.node, "left").select("gid", F.col("first_id").alias("doc_id"), F.coalesce("root", "pid").alias("root"))
    several = member.groupBy("root").count().where("count > 1").select("root")
    member = cut(member.join(several, "root"))
    texts = cut(docs.join(member.select("doc_id", "gid"), ["doc_id", "gid"]).dropDuplicates(["gid"]).select("gid", "text"))
    linked = components(verified_links(member.select("root", "gid"), texts, shingle, similarity))
    named = firsts.select("gid", "first_id").join(linked.select(F.col("node").alias("gid"), "root"), "gid")
    kept = named.groupBy("root").agg(F.min("first_id").alias("least_id"))
    named = named.join(kept, "root").select("gid", "least_id")
    known = firsts.select("gid", "first_id").join(named, "gid", "left").select("gid", F.coalesce("least_id", "first_id").alias("kept_id"))
    return prints.select("doc_id", "gid").join(known, "gid").where("doc_id > kept_id")


def drop_copies(df: DataFrame, shingle: int = 5, max_bits: int = 9, similarity: float = 0.8) -> DataFrame:
    """`df` with one document of each group of verified copies, that with the smallest doc_id."""
    copies = verified_copies(df, shingle, max_bits, similarity).select(F.col("doc_id").alias("gone_id"), F.col("gid").alias("gone_gid")).distinct()
    gid = F.xxhash64(F.coalesce(df["text"], F.lit("")), F.length(F.coalesce(df["text"], F.lit(""))))
    return df.join(copies, (df["doc_id"] == copies["gone_id"]) & (gid == copies["gone_gid"]), "left_anti")
