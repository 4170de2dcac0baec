import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from helixframe.llm import common, components, exact_dedup, near_copies, simhash

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_groups(docs, awkward, keep):
    texts = awkward + ["", "É é ß", "e é ß", "É É ß"] + ["copy"] * 50
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    d = docs(texts, ids).repartition(9)
    groups = {}
    for i, t in zip(ids, texts):
        groups.setdefault((t or "").translate(UP), []).append(i)
    want = {i: (max(g) if keep == "max" else min(g), len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for i in g}
    for bits in (1, 4):
        got = exact_dedup.exact_duplicates(d, keep=keep, fan_in_bits=bits).collect()
        assert {r.doc_id: (r.keep_id, r.group_size, r.digest.hex()) for r in got} == want
        assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_exact_null_and_repeated_ids(docs):
    d = docs(["a", "A", "a", "b"], [None, 5, 5, None])
    got = exact_dedup.exact_duplicates(d).collect()
    assert sum(r.kept for r in got) == 2 and {r.keep_id for r in got if r.group_size == 3} == {5}
    assert exact_dedup.drop_exact_duplicates(d).count() == 2
    assert exact_dedup.exact_duplicates(d.limit(0)).count() == 0
    assert exact_dedup.drop_exact_duplicates(d).columns == d.columns


def brute_fingerprint(text, k=4):
    w = "".join(" " if c in "\t\n\v\f\r" else c for c in text.translate(UP)).split(" ")
    w = [x for x in w if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def near_texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(200)]
        for _ in range(rng.randint(1, 5)):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(200)] = rng.choice(words)
            out.append(" ".join(t))
    return out


def test_simhash_components(docs, awkward):
    texts = awkward[:8] + near_texts() + ["", "The cat"]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(texts)).collect()}
    prints = [brute_fingerprint(t or "") for t in texts]
    assert [got[i].fp0 % 2**64 for i in range(len(texts))] == prints
    label = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 4:
                    label[i] = label[j] = min(label[i], label[j])
    assert [got[i].component_id for i in range(len(texts))] == label


@pytest.mark.parametrize(("distance", "n", "rows"), [(4, None, 20000), (4, 2**30, 20000), (4, None, 40), (3, None, 9), (0, None, 9), (8, 2**20, 20000)])
def test_links_join_what_all_pairs_join(spark, distance, n, rows):
    rng = np.random.default_rng(0)
    fps = set(map(int, rng.integers(-(2**62), 2**62, 60)))
    for x in list(fps)[:30]:
        for _ in range(4):
            y = x
            for b in rng.choice(63, rng.integers(1, 7), replace=False):
                y ^= 1 << int(b)
            fps.add(y)
            fps.add(y ^ -(1 << 63))  # the sign bit is a bit like the others
    for _ in range(150):  # a dense cluster
        y = 12345
        for b in rng.choice(10, rng.integers(1, 5), replace=False):
            y ^= 1 << int(b)
        fps.add(y)
    f = np.array(sorted(fps), np.int64)
    near = np.array([[((a ^ b) % 2**64).bit_count() <= distance for b in f.tolist()] for a in f.tolist()])
    label = np.arange(len(f))
    while True:
        new = np.array([label[r].min() for r in near])
        if (new == label).all():
            break
        label = new
    d = spark.createDataFrame([(int(x), int(x)) for x in f], "node bigint, fp0 bigint")
    roots = {r.node: r.root for r in components.connected_components(simhash.hamming_links(d, simhash.segments(distance, n or len(f)), distance, ["fp0"], rows)).collect()}
    assert [roots.get(int(x), int(x)) for x in f] == f[label].tolist()


def test_segments_miss_no_pair():
    rng = np.random.default_rng(5)
    for n in (10, 10**6, 10**9):
        plan = simhash.segments(4, n)
        for _ in range(300):
            x = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))
            assert any((x >> s & (1 << w) - 1).bit_count() <= r for _, s, w, r in plan)


def edited(rng, words, edits):
    out = list(words)
    for i in rng.sample(range(len(words)), edits):
        out[i] = f"new{rng.randrange(10**6)}"
    return out


def brute_components(texts):
    """Components of the pairs whose distinct five-word shingles are similar by 0.8 or more, as frozensets of positions."""
    sets = []
    for t in texts:
        w = (t or "").translate(UP).split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) / len(a | sets[j]) >= 0.8:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return {frozenset(i for i, x in enumerate(label) if x == k) for k in label}


def corpus(rng, groups=30):
    """Families of texts from identical to similarity 0.5, that share a passage across families, and short ones."""
    passage = [f"p{i}" for i in range(60)]
    out = []
    for g in range(groups):
        base = [f"v{rng.randrange(3000)}" for _ in range(rng.choice([6, 30, 200]))] + (passage if g % 3 == 0 else [])
        out += [" ".join(edited(rng, base, min(len(base), k))) for k in (0, 1, 2, 4, 6, 9)]
    return [*out, None, "", " ", "One two", "one TWO", "a b c d e", "a b c d e f", out[0].upper()]


@pytest.mark.parametrize("block_bytes", [1 << 25, 4000])
def test_near_copies_equal_brute_force(docs, block_bytes):
    texts = corpus(random.Random(7))
    got = near_copies.near_copies(docs(texts).repartition(5), block_bytes=block_bytes).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.component, set()).add(r.doc_id)
    assert {frozenset(x) for x in groups.values()} == brute_components(texts)
    assert all(r.component_id == min(groups[r.component]) for r in got)


def test_near_copies_in_small_and_large_tables(monkeypatch):
    """The pairs that a table proposes don't depend on how many texts are in it."""
    rng = random.Random(11)
    texts = [" ".join(edited(rng, [f"w{i}" for i in range(150)], rng.randrange(40))).encode() for _ in range(60)]
    f = [near_copies.features(t) for t in texts]
    pairs = lambda small: {(a, b) for i, j, _ in near_copies.Table([x[1] for x in f], [x[0] for x in f], 0.8, small).candidates() for a, b in zip(i.tolist(), j.tolist())}
    assert pairs(192) == pairs(1) and len(pairs(1)) > 20


def test_near_copies_recall():
    """Pairs just at 0.8 share an anchor and meet in a segment nearly always."""
    rng, met, n = random.Random(3), 0, 0
    for _ in range(400):
        base = [f"{rng.random()}" for _ in range(rng.choice([40, 100, 400]))]
        a, b = near_copies.features(" ".join(base).encode()), near_copies.features(" ".join(edited(rng, base, len(base) // 50)).encode())
        x, y = (np.frombuffer(f[4], np.uint64) for f in (a, b))
        if not near_copies.similar(x, y, 0.8):
            continue
        n += 1
        met += bool(set(a[2]) & set(b[2])) and any(len(i) for i, *_ in near_copies.Table([a[1], b[1]], [a[0], b[0]], 0.8).candidates())
    assert n > 100 and met >= 0.98 * n


def test_drop_near_copies(docs):
    texts = corpus(random.Random(9), 8)
    d = docs(texts)
    out = near_copies.drop_near_copies(d)
    assert out.columns == d.columns
    assert {r.doc_id for r in out.collect()} == {min(g) for g in brute_components(texts)}
    assert near_copies.drop_near_copies(d.limit(0)).count() == 0
    twice = near_copies.drop_near_copies(docs(["same words in here today"] * 4, [7, 7, None, None])).collect()
    assert [r.doc_id for r in twice] == [7]


@pytest.mark.parametrize("drop", [exact_dedup.drop_exact_duplicates, near_copies.drop_near_copies])
def test_dropped_rows_do_not_depend_on_splits(spark, tmp_path, drop):
    """The table is read with other splits after the operator has numbered its rows."""
    texts = [f"text number {i % 300} of some words that are its own {i % 300} and no other's" for i in range(400)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(7).write.parquet(str(tmp_path / "t"))
    d = spark.read.parquet(str(tmp_path / "t"))
    key = "spark.sql.files.minPartitionNum"
    spark.conf.set(key, "1")
    out = drop(d)
    spark.conf.set(key, "64")
    try:
        assert sorted(r.text for r in out.collect()) == sorted(set(texts))
    finally:
        spark.conf.unset(key)


def test_marks(spark):
    """No marked number is missed, whatever the bitmap's size; without() drops exactly what it is told."""
    some = spark.range(0, 5000, 7).select(F.col("id").alias("n"))
    rows = spark.range(5000).select(F.col("id").alias("n"), F.lit("x").alias("text"))
    seen = {r.n for r in rows.where(common.Marks(some).has("n")).collect()}
    assert set(range(0, 5000, 7)) <= seen and len(seen) < 720
    assert sorted(r.n for r in common.without(rows, some, "n").collect()) == [i for i in range(5000) if i % 7]
    assert common.without(rows, some.limit(0), "n").count() == 5000 and common.without(rows.limit(0), some, "n").count() == 0


def test_null_ids_stay_apart(docs):
    d = docs([" ".join(f"{k}{i}" for i in range(50)) for k in "abc"], [None, None, None])
    assert near_copies.drop_near_copies(d).count() == 3
    assert simhash.near_duplicates(d).count() == 3
    assert simhash.near_duplicates(d.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400)], "u bigint, v bigint")
    got = {r.node: r.root for r in components.connected_components(e).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[500] == 400
    assert components.connected_components(e.where(F.lit(False))).count() == 0
