import itertools
import random

import numpy as np

from attesta.llm import simhash
from attesta.llm.graph import components
from tests.llm.helpers import clashing, documents, odd_rows


def word_shingles(text, size):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def brute(rows, shingle, max_bits):
    prints = [simhash.fingerprint(t, shingle) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= max_bits:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    return sorted((str(i), f"{prints[k]:016x}", str(least[group[k]])) for k, (i, _) in enumerate(rows))


def found(spark, rows, **kind):
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(clashing(documents(spark, rows)), **kind).collect())


def test_fingerprint_by_definition():
    import xxhash

    text = "One two  three\tfour five one Two three four É"
    words = text.encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)]
    bits = sum((1 << b) for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text, 4) == bits
    assert simhash.fingerprint("a b", 4) == xxhash.xxh64_intdigest(b"a b", 42)
    assert simhash.fingerprint(" \n", 4) == 0


def test_components_equal_brute_force(spark):
    random.seed(2)
    rows = []
    for k in range(40):
        words = [f"w{random.randint(0, 500)}" for _ in range(random.choice([3, 40, 300]))]
        for c in range(random.randint(1, 5)):
            copy = list(words)
            for _ in range(c):
                copy[random.randrange(len(copy))] = f"z{random.random()}"
            rows.append((len(rows), " ".join(copy)))
    assert found(spark, rows) == brute(rows, 4, 4)
    assert found(spark, odd_rows(), max_bits=6) == brute(odd_rows(), 4, 6)


def test_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_trie_join_of_dense_keys():
    rng = np.random.default_rng(4)
    keys = np.full(3000, 1 << 40, np.uint64)
    for _ in range(6):
        keys ^= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    keys = np.unique(np.concatenate([keys, rng.integers(0, 1 << 63, 2000, dtype=np.uint64)]))
    a, b = np.nonzero(np.bitwise_count(keys[:, None] ^ keys[None]) <= 4)
    expected = simhash.join_labels(np.arange(len(keys)), a, b)
    assert (simhash.trie_self_join(keys, 0, 4) == expected).all()


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (None, 3)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(roots[i] == 0 for i in range(201)) and all(roots[1000 + i] == 1000 for i in range(300)) and 5000 not in roots


def test_links_are_the_same_with_longer_keys(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base.copy()
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    keys = np.unique(np.concatenate([base, near])).view(np.int64).tolist()
    prints = spark.createDataFrame([(k,) for k in keys], "fp long")
    roots = lambda: {(r.node, r.root) for r in components(simhash.fingerprint_links(prints, 4)).collect()}
    short = roots()
    monkeypatch.setattr(simhash, "BUCKET", -1)
    assert len(simhash.block_choices(4, len(keys))[0]) > 1 and roots() == short


def test_verified_copies_by_definition(spark):
    random.seed(6)
    rows = []
    for k in range(30):
        words = [f"w{random.randint(0, 900)}" for _ in range(400)]
        for c in range(4):
            copy = list(words)
            for _ in range(2 * c):
                copy[random.randrange(len(copy))] = f"z{random.random()}"
            rows.append((1000 + len(rows), " ".join(copy)))
    rows += [(5000 + k, f"distinct text number {k} about nothing else at all") for k in range(20)] + [(1, "Same  text"), (2, "same text"), (3, None), (4, ""), (None, "same text")]
    docs = clashing(documents(spark, rows))
    text = {i: t for i, t in rows if i is not None}
    copies = simhash.verified_copies(docs).collect()
    for r in copies:
        a, b = word_shingles(text[r.doc_id], 5), word_shingles(text[r.kept_id], 5)
        assert r.kept_id < r.doc_id and len(a & b) >= 0.8 * len(a | b)
    gone = {r.doc_id for r in copies}
    similar = {j for i, j in ((1000 + 4 * k, 1000 + 4 * k + c) for k in range(30) for c in (1, 2, 3)) if (lambda a, b: len(a & b) >= 0.8 * len(a | b))(word_shingles(text[i], 5), word_shingles(text[j], 5))}
    assert len(gone & similar) >= 0.9 * len(similar) and not gone & set(range(5000, 5020)) and gone >= {2, 4}
    kept = simhash.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - len(gone)
    assert simhash.drop_copies(documents(spark, [])).count() == 0


def kept_by_links(rows, links):
    """Documents left of rows (id, text) when each group that links connect keeps its smallest id."""
    label = {i: i for i, _ in rows}
    for a, b in links:
        x, y = sorted((label[a], label[b]))
        label = {i: x if g == y else g for i, g in label.items()}
    return {i for i, g in label.items() if i == g}


def linked_pairs(rows, similarity=0.8):
    sets = [(i, word_shingles(t, 5)) for i, t in rows]
    return [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if len(a & b) >= similarity * len(a | b)]


def test_copies_of_a_later_base_and_many_groups_are_settled(spark, monkeypatch):
    """All candidates in one component: a star whose base comes late, and a dozen groups."""
    rng = random.Random(8)
    rows = []
    base = [f"b{rng.randint(0, 10**6)}" for _ in range(400)]
    for c in range(40):  # 8 words of 400: 0.82 similar to the base, about 0.66 to each other
        copy = list(base)
        for at in rng.sample(range(4, 396), 8):
            copy[at] = f"z{rng.random()}"
        rows.append((1 + c, " ".join(copy)))
    rows.append((99, " ".join(base)))
    for g in range(12):
        words = [f"g{rng.randint(0, 10**6)}" for _ in range(300)]
        for c in range(6):
            copy = list(words)
            copy[rng.randrange(300)] = f"z{rng.random()}"
            rows.append((100 + 10 * g + c, " ".join(copy)))
    links = linked_pairs(rows)
    assert not [1 for a, b in links if max(a, b) < 99]
    monkeypatch.setattr(simhash, "candidate_links", lambda prints, max_bits, total: prints.selectExpr("pid AS a", "min(pid) OVER () AS b"))
    for small in (3, 1000):
        monkeypatch.setattr(simhash, "SMALL", small)
        left = {r.doc_id for r in simhash.drop_copies(documents(spark, rows)).collect()}
        assert left == kept_by_links(rows, links) and len(left) == 13


def test_candidate_links_equal_brute_force(spark):
    """Several prints a text: near in one and in all; many equal first prints, and chance links that must not join."""
    rng = random.Random(6)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    base = [tuple(rng.getrandbits(64) for _ in range(3)) for _ in range(60)]
    prints = [*base, *(tuple(flip(x, rng.randint(0, 12)) for x in rng.choice(base)) for _ in range(300))]
    prints += [(base[0][0], rng.getrandbits(64), rng.getrandbits(64)) for _ in range(12)]  # equal by chance
    prints += [(base[1][0], flip(base[1][1], 6), flip(base[1][2], 9)) for _ in range(12)]  # equal and near
    prints = sorted(set(prints))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(i, *map(signed, p)) for i, p in enumerate(prints)]
    links = simhash.candidate_links(spark.createDataFrame(rows, "pid long, fp0 long, fp1 long, fp2 long"), 9, 48)
    found = {r.node: r.root for r in components(links).collect()}
    true = list(range(len(prints)))
    apart = lambda p, q: [(a ^ b).bit_count() for a, b in zip(p, q, strict=True)]
    for i, j in itertools.combinations(range(len(prints)), 2):
        bits = apart(prints[i], prints[j])
        if min(bits) <= 9 and sum(bits) <= 48 and true[i] != true[j]:
            lo, hi = sorted((true[i], true[j]))
            true = [lo if t == hi else t for t in true]
    assert [found.get(i, i) for i in range(len(prints))] == true


def test_cells_link_what_brute_force_links(spark, monkeypatch):
    """Many small cells: links of similar texts only, and as many as connect all similar ones."""
    rng = random.Random(9)
    rows = []
    for _ in range(4):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
        for _ in range(7):
            copy = list(words)
            copy[rng.randrange(120)] = f"z{rng.random()}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows), ""), (len(rows) + 1, "one two")]
    true = linked_pairs(rows)
    pairs = spark.createDataFrame([(a, a, b, b) for a, b in itertools.combinations(range(len(rows)), 2)], "a long, own long, b long, label long")
    monkeypatch.setattr(simhash, "CELL", 5)
    found = [tuple(r) for r in simhash.similar_pairs(pairs, spark.createDataFrame(rows, "gid long, text string"), 5, 0.8).collect()]
    assert {tuple(sorted(p)) for p in found} <= {tuple(sorted(p)) for p in true}
    assert kept_by_links(rows, found) == kept_by_links(rows, true)


def near_prints(n, seed=4):
    """Rows of three fingerprints each, all near those of the first."""
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(3)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [(i, *(signed(x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))) for x in base)) for i in range(n)]


def test_a_group_that_meets_in_many_blocks_has_few_links(spark):
    prints = spark.createDataFrame(near_prints(400), "pid long, fp0 long, fp1 long, fp2 long")
    links = {tuple(sorted(r)) for r in simhash.candidate_links(prints, 9, 48).collect()}
    assert len(links) < 6 * 400  # thirty blocks of three prints
    assert {r.root for r in components(spark.createDataFrame(sorted(links), "a long, b long")).collect()} == {0}


def test_turns_of_a_large_component_take_few_tasks(spark, monkeypatch):
    """Tasks that ran, of 64 that each shuffle has."""
    monkeypatch.setattr(simhash, "SMALL", 3)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):
        copy = list(base)
        copy[rng.randrange(150)] = f"z{i}"
        rows.append((i, " ".join(copy)))
    texts = simhash.cut(spark.createDataFrame(rows, "gid long, text string").coalesce(2))
    member = simhash.cut(texts.selectExpr("0L AS root", "gid"))
    own = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in own}
    context = spark.sparkContext
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        context.setJobGroup("turns", "turns")
        links = simhash.verified_links(member, texts, 5, 0.8).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    tracker = context.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup("turns") for s in tracker.getJobInfo(job).stageIds}
    infos = [tracker.getStageInfo(s) for s in stages]
    assert kept_by_links(rows, [tuple(r) for r in links]) == kept_by_links(rows, linked_pairs(rows))
    assert sum(i.numCompletedTasks for i in infos if i) < 30 * 64
