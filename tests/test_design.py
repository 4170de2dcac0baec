"""The crossed split design and the sampled windows by plain loops over small data."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions import stats
from helixframe.operators import resample as R
from helixframe.sources import genome as G
from helixframe.sources.tables import lcg


def table(spark, seed, features, loci):
    rng = random.Random(seed)
    rows = [(f, e, round(rng.uniform(-1, 1) + f / 10, 3), 1.0 + rng.randrange(3)) for f in range(features) for e in range(loci) if rng.random() < 0.8]
    return spark.createDataFrame(rows, "feature_id bigint, locus bigint, a_f double, mass double"), rows


def medians(rows, loci):
    out = {}
    for f in {r[0] for r in rows}:
        own = sorted((r[2], r[3]) for r in rows if r[0] == f and r[1] in loci)
        total, cum = sum(w for _, w in own), 0.0
        for v, w in own:
            cum += w
            if cum >= total / 2:
                out[f] = v
                break
    return out


def hits(a, null, q):
    p = {f: (1 + sum(x >= v for x in null.values())) / (1 + len(null)) for f, v in a.items()}
    order, best, found = sorted(p, key=p.get), 1.0, set()
    for j in range(len(order), 0, -1):
        best = min(best, p[order[j - 1]] * len(order) / j)
        if round(best, 9) < q:
            found.add(order[j - 1])
    return found


def rho(x, y):
    rank = lambda v: [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]
    if len(x) < 3:
        return 0.0
    x, y = rank(x), rank(y)
    mx, my = sum(x) / len(x), sum(y) / len(y)
    vx, vy = sum((a - mx) ** 2 for a in x), sum((b - my) ** 2 for b in y)
    return sum((a - mx) * (b - my) for a, b in zip(x, y, strict=True)) / (vx * vy) ** 0.5 if vx and vy else 0.0


@pytest.mark.parametrize("matched", [False, True])
def test_split_design(spark, matched):
    (first, a), (second, b), (null, n) = table(spark, 1, 8, 9), table(spark, 2, 8, 9), table(spark, 3, 8, 9)
    partner = {0: 3, 3: 0, 1: 1, 5: 6, 7: 2} if matched else {f: f for f in range(8)}  # second -> first
    pairs = spark.createDataFrame([(x, y) for y, x in partner.items()], "first_id bigint, second_id bigint") if matched else None
    got = {r.cell: r for r in R.split_design(first, second, null, 6, 0.6, pairs).collect()}
    draws = {(r, e): x for r, e, x in spark.sql(f"select rep, locus, {lcg('rep', 'locus')} from (select explode(sequence(0, 5)) rep), (select explode(sequence(0, 8)) locus)").collect()}
    seen = {c: ([], []) for c in R.CELLS}
    for rep in range(6):
        order = sorted(range(9), key=lambda e: (draws[rep, e], e))
        half = [set(order[:4]), set(order[4:8])]  # the ninth is left out
        values = {(i, h): medians(rows, half[h]) for i, rows in enumerate((a, b, n)) for h in (0, 1)}
        sets = {(i, h): hits(values[i, h], values[2, h], 0.6) for i in (0, 1) for h in (0, 1)}
        for cell, at in R.CELLS.items():
            x, y = sets[0, 0], sets[at]
            if x | y:
                seen[cell][0].append(len(x & y) / len(x | y))
            name = partner if at[0] else {f: f for f in range(8)}
            both = [(values[0, 0][name[f]], v) for f, v in values[at].items() if name.get(f) in values[0, 0]]
            seen[cell][1].append(rho(*zip(*both, strict=True)))
    for cell, (j, r) in seen.items():
        mean = sum(j) / len(j)
        assert got[cell].splits == len(j) > 0
        assert got[cell].mean_jaccard == pytest.approx(mean)
        assert got[cell].sd_jaccard == pytest.approx((sum((x - mean) ** 2 for x in j) / len(j)) ** 0.5)
        assert got[cell].mean_rho == pytest.approx(sum(r) / len(r))


def test_split_design_of_nothing(spark):
    empty = table(spark, 1, 0, 0)[0]
    assert R.split_design(empty, empty, empty, 3).count() == 0
    one, _ = table(spark, 1, 3, 9)
    # without a null there is no p-value and no set
    assert {(r.mean_jaccard, r.splits) for r in R.split_design(one, one, empty, 3).collect()} == {(None, 0)}


def test_pvalues_by_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 1.0), ("c", 1.0), (None, 2.0), ("a", None)], "g string, v double")
    null = spark.createDataFrame([("a", 2.0), ("a", 1.0), ("b", 0.0), (None, 5.0), ("b", None)], "g string, v double")
    got = sorted(((r.g, r.v, r.p_value) for r in stats.empirical_pvalue(df, "v", null, "v", by=("g",)).collect()), key=repr)
    assert got == sorted([("a", 1.0, 1.0), ("a", 3.0, 1 / 3), ("b", 1.0, 0.5), ("c", 1.0, None), (None, 2.0, 1.0), ("a", None, None)], key=repr)


def test_windows_cross_pieces(spark):
    rng = random.Random(5)
    seqs = {"c1": "".join(rng.choice("acgt") for _ in range(70)), "c2": "N" * 20 + "ACGTACGTAC", "c3": "", "c4": None}
    contigs = spark.createDataFrame(list(seqs.items()), "chrom string, seq string")
    places = [(c, i) for c in seqs for i in range(-2, 75)] + [("c1", 3), ("c9", 0)]
    windows = spark.createDataFrame(places, "chrom string, window_start bigint")
    for size in (4, 7, 16, 4096):
        got = sorted((r.chrom, r.window_start, r.seq) for r in G.with_bases(windows, contigs, 10, 0.25, size).collect())
        want = [(c, i, seqs[c][i : i + 10].upper()) for c, i in places if seqs.get(c) and 0 <= i <= len(seqs[c]) - 10]
        assert got == sorted(w for w in want if w[2].count("N") < 2.5)


def test_windows_off_intervals(spark):
    rng = random.Random(6)
    intervals = [("c1", a, a + rng.randrange(0, 40)) for a in rng.sample(range(300), 12)] + [("c2", 10, 12), ("c2", 10, 12), ("c1", 400, 900), ("c1", 401, 899), (None, 0, 5), ("c1", None, 5)]
    iv = spark.createDataFrame(intervals, "chrom string, start bigint, end bigint")
    places = [(c, i) for c in ("c1", "c2", "c3") for i in range(0, 920, 3)]
    windows = spark.createDataFrame(places, "chrom string, window_start bigint")
    want = sorted((c, i) for c, i in places if not any(k == c and a is not None and a < b and a < i + 10 and b > i for k, a, b in intervals))
    for size in (8, 64, 4096):
        assert sorted((r.chrom, r.window_start) for r in G.off_intervals(windows, iv, 10, size).collect()) == want


def test_sampled_windows(spark):
    rng = random.Random(7)
    seqs = {f"chr{i}": "".join(rng.choice("ACGT") for _ in range(200 + 50 * i)) for i in range(1, 5)} | {"chrM": "A" * 500, "chr1_alt": "C" * 500, "chr9": "ACGT", "chr8": "N" * 500}
    contigs = spark.createDataFrame(list(seqs.items()), "chrom string, seq string")
    intervals = [("ccre", f"chr{1 + i % 4}", 13 * i % 180, 13 * i % 180 + 9) for i in range(40)] + [("ccre", "chr1", 0, 9)] * 3 + [("genic", "chr2", 50, 60), ("genic", "chr9", 0, 3), (None, "chr1", 0, 5), ("ccre", "chr1", 9, 9)]
    iv = spark.createDataFrame(intervals, "cls string, chrom string, start bigint, end bigint")
    run = lambda n, i=iv, c=contigs: sorted(map(tuple, G.sampled_windows(i, c, 20, {"ccre": 15, "genic": 5}, n, size=64).collect()))
    got = run(25)
    assert {c: sum(r[0] == c for r in got) for c in ("genic", "background")} == {"genic": 1, "background": 25}
    assert 0 < sum(r[0] == "ccre" for r in got) <= 15
    for cls, chrom, start, seq in got:
        assert seq == seqs[chrom][start : start + 20] and len(seq) == 20
        if cls == "background":
            assert chrom in ("chr1", "chr2", "chr3", "chr4") and not any(c and k == chrom and a < start + 20 and b > start for c, k, a, b in intervals)
        else:
            assert any(c == cls and k == chrom and max((a + b) // 2 - 10, 0) == start for c, k, a, b in intervals)
    assert run(25, iv.repartition(7), contigs.repartition(5)) == got
    # more than there are free starts: all that the draws find, which are most, on all parts of the contigs
    free = {(c, i) for c in ("chr1", "chr2", "chr3", "chr4") for i in range(len(seqs[c]) - 20) if not any(k and d == c and a < i + 20 and b > i for k, d, a, b in intervals)}
    found = {r[1:3] for r in run(10**3) if r[0] == "background"}
    assert {r[1:3] for r in got if r[0] == "background"} <= found <= free and len(found) > 0.9 * len(free)
    assert run(0, iv.limit(0)) == [] and [r for r in run(5, iv, contigs.limit(0)) if r[0] == "background"] == []


def test_sampled_windows_read_intervals_few_times(spark):
    """Of intervals that repeat, those of least draw as brute force has them; one pass for a bound, one for rows below it, one for the background."""
    rng = random.Random(8)
    rows = [(rng.choice("ab"), "c1", rng.randrange(3000), 3000 + rng.randrange(9)) for _ in range(300)] * 5 + [("b", "c1", 1, 3001)] * 2000 + [("x", "c1", 0, 3000)]
    contigs = spark.createDataFrame([("c1", "ACGT" * 1000), ("c2", "GATTACA" * 500)], "chrom string, seq string")
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    schema = "cls string, chrom string, start bigint, end bigint"
    iv = spark.createDataFrame(rows, schema).repartition(3).mapInArrow(look, schema)
    # rows of start 1 come first, so the bound that counts repeats has too few different ones of b
    draw = F.when(F.col("start") == 1, F.lit(0)).otherwise(F.col("start") * 7919 % 3001)
    got = G._chosen(iv, {"a": 12, "b": 40, "none": 3}, 0, draw)
    value = lambda r: (0 if r[2] == 1 else r[2] * 7919 % 3001, ":".join(map(str, r)))
    want = [r for c, n in (("a", 12), ("b", 40)) for r in sorted({r for r in rows if r[0] == c}, key=value)[:n]]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    seen.value = 0
    windows = G.sampled_windows(iv, contigs, 20, {"a": 12, "b": 4}, 5, draw=draw).collect()
    assert sum(r.cls == "background" for r in windows) == 5
    assert seen.value <= 4 * len(rows)


def test_medians_of_all_parts_at_once(spark):
    """One row a feature, however many splits: equal to the median of each part's rows, with ties, zero weights and missing loci."""
    rng = random.Random(5)
    rows = [(f, e, rng.choice([-0.5, 0.0, 0.25, 0.5, 1.0]), rng.choice([0.0, 0.5, 1.5, None])) for f in range(20) for e in range(7) if rng.random() < 0.7]
    values = spark.createDataFrame([*rows, (3, 1, None, 1.0)], "feature_id bigint, locus bigint, a_f double, mass double")
    deals = [(e, "".join(rng.choice("012") for _ in range(9))) for e in range(7)]
    got = R.deal_medians(values, spark.createDataFrame(deals, "locus bigint, deal string"), ["feature_id"], 2).collect()
    assert sorted(r.feature_id for r in got) == sorted({r[0] for r in rows})
    long = [(e, s, int(part)) for e, text in deals for s, part in enumerate(text) if part != "2"]
    parts = values.join(spark.createDataFrame(long, "locus bigint, split int, part int"), "locus")
    want = {(r.feature_id, r.split, r.part): r.m for r in stats.weighted_median(parts, ["feature_id", "split", "part"], "a_f", "mass", "m").collect() if r.m is not None}
    assert {(r.feature_id, s, p): m for r in got for p in (0, 1) for s, m in enumerate(r[f"m{p}"]) if m is not None} == want


def test_counted_rows_give_the_same_p_and_q(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 3.0, 1), ("a", 0.0, 2), ("b", 1.0, 2)], "g string, v double, n bigint")
    null = spark.createDataFrame([("a", 2.0, 2), ("a", 1.0, 5), ("b", 0.0, 4)], "g string, v double, n bigint")
    each = lambda d: d.withColumn("i", F.explode(F.expr("sequence(1, n)"))).select("g", "v")
    plain = stats.bh_qvalue(stats.empirical_pvalue(each(df), "v", each(null), "v", by=("g",)), "p_value", by=("g",))
    counted = stats.bh_qvalue(stats.empirical_pvalue(df, "v", null, "v", by=("g",), times="n"), "p_value", by=("g",), times="n")
    columns = ("g", "v", "p_value", "q_value")
    assert sorted(plain.select(*columns).distinct().collect()) == sorted(counted.select(*columns).collect())
