"""Programs on a toy model and planted data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import sequences as S
from helixframe.operators import alignment as A
from helixframe.operators import models as M
from helixframe.operators import toy
from helixframe.operators import vectors as V
from helixframe.plans import programs as P
from helixframe.sources import genome as G


@pytest.fixture(scope="module")
def elements(spark):
    return toy.elements_of(G.synthetic_corpus(spark, 4, 60, weights={"ccre": 1.0, "background": 0.0})).persist()


@pytest.fixture(scope="module")
def groups(elements):
    return elements.select("elem_id", F.substring("elem_id", 1, 9).alias("locus"))


@pytest.fixture(scope="module")
def model():
    return toy.ToyModel(d_model=12, layers=2)


def planted(spark, n=3000, d=10):
    """Sparse sums of orthogonal directions."""
    rng = np.random.default_rng(0)
    basis = np.linalg.qr(rng.standard_normal((d, d)))[0]
    z = np.abs(rng.standard_normal((n, d))) * (rng.random((n, d)) < 0.15)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(z @ basis)], "token bigint, h array<double>").repartition(2).persist()


def test_training_reaches_the_gate(spark):
    got = P.train_and_test(planted(spark), 20, 4, 12, rate=1e-2, batch=64)
    assert got["fvu"] <= 0.15 and got["last_loss"] < got["first_loss"] and 0 < got["l0"] <= 4


@pytest.mark.parametrize("family", ["topk", "gated", "jumprelu"])
def test_trained_encoders_apply(spark, family):
    acts = planted(spark, 200, 6)
    p, b, _ = M.train(acts, 8, 3, 2, family)
    x = np.array([r.h for r in acts.orderBy("token").collect()])
    want = M.codes_of(family, p, b, 3)(x)
    got = {(r.token, r.feature_id): r.z for r in V.encode(acts, family, p, b, 3).collect()}
    assert got == {(i, j): pytest.approx(want[i, j]) for i, j in zip(*np.nonzero(want > 0))}
    f, fired, n = V.reconstruction(acts, M.codes_of(family, p, b, 3), p["w"], b)
    e = x - (want @ p["w"] + b)
    assert n == 200 and f == pytest.approx((e**2).sum() / (((x - x.mean(axis=0)) ** 2).sum() + 1e-9)) and fired.tolist() == (want > 0).sum(axis=0).tolist()


def test_sums_in_lanes(spark):
    d = spark.range(0, 500, numPartitions=40).selectExpr("id % 3 as k", "array(cast(id as double), 1.0D) as v")
    got = V.tree_sum(d, lanes=4)
    assert {k: v.tolist() for k, v in got.items()} == {k: [float(sum(range(k, 500, 3))), float(len(range(k, 500, 3)))] for k in range(3)}
    assert V.tree_sum(d.where("false")) == {}


def test_dictionary_sweep_and_families(spark, elements, groups, model):
    acts = toy.activations(elements.select(F.col("elem_id").alias("seq_id"), "seq"), model, 1).persist()
    sweep = P.dictionary_sweep(acts, elements, groups, model, 1, (2,), 3, 1, (0, 1), 20)
    assert [(r["m"], r["level"], r["seed"]) for r in sweep] == [(m, v, s) for m in (24,) for v in ("element", "locus") for s in (0, 1)]
    assert all(0 <= r["above"] <= 1 and "pair_jaccard" in sweep[i] for i, r in enumerate(sweep) if r["seed"] == 1)
    pairs = P.cross_family(acts, elements, groups, model, 1, 12, 3, 1, ("topk", "jumprelu"), 20)
    assert [(r["level"], r["a"], r["b"]) for r in pairs] == [("element", "topk", "jumprelu"), ("locus", "topk", "jumprelu")]
    assert [(r["family"], r["rate"]) for r in P.family_calibration(acts, 12, 3, (1e-2,), 1, ("gated",))] == [("gated", 1e-2)]


def test_probes(elements, model):
    r = {x.features: x for x in P.probe_comparison(elements, model, 1, 2, (1.0, 100.0)).collect()}
    assert set(r) == {"hidden", "composition", "kmers"} and all(-1 <= x.rho <= 1 for x in r.values())
    sweep = P.layer_sweep(elements, model, (1.0,), mlp=False).collect()
    assert [x.layer for x in sweep] == toy.layer_candidates(2) and sum(x.best for x in sweep) == 1
    x = S.codes("ACGTGC")
    f = S.probe_features(x, 3)
    assert f.shape == (6, 5) and f[:, :4].argmax(axis=1).tolist() == x.tolist() and f[1, 4] == pytest.approx(2 / 3 - 0.5)
    assert S.probe_features(S.codes("")).shape == (0, 5)
    p = P.corpus_power(elements).first()
    assert p.n_elements == 4 and not p.enough


def profiles(spark):
    rng = np.random.default_rng(3)
    rows = [(e, e // 2, p, float(v), float(v + rng.normal(0, 0.2)), p % 3) for e in range(12) for p, v in enumerate(rng.random(20 + e))]
    return spark.createDataFrame(rows, "elem int, locus int, pos int, i double, e double, gc int")


def test_partners_and_bake_off(spark):
    p = profiles(spark)
    pairs = A.partners(p.select("elem", "locus"), 5).collect()
    assert len(pairs) == 12 and all(r.locus != r.other_locus for r in pairs)
    assert [r.asDict() for r in A.partners(p.select("elem", "locus").repartition(7), 5).orderBy("elem").collect()] == sorted((r.asDict() for r in pairs), key=lambda r: r["elem"])
    assert A.partners(p.where("locus = 0").select("elem", "locus")).count() == 0
    r = {x.metric: x for x in P.metric_bake_off(p, p.select("elem", (F.col("elem") < 6).alias("is_causal")).distinct()).collect()}
    assert len(r) == 5 and all(x.real > abs(x.shuffled) + 0.15 and x.separation > 0.9 and 0 <= x.auroc <= 1 for x in r.values())


def facts(spark, shift):
    rng = np.random.default_rng(int(shift * 100) + 1)
    return spark.createDataFrame([(f, e, e // 2, float(rng.normal(shift, 0.3)), 1.0 + f % 5) for f in range(60) for e in range(12)], "feature_id int, elem_id int, locus int, a_f double, mass double")


def test_gate_headline_nulls_and_deep_dive(spark):
    real, null, shuffled = facts(spark, 0.5), facts(spark, 0.0), facts(spark, 0.01)
    g = P.metric_gate(real, null, shuffled).first()
    assert g.real > 0.9 and g.g1 and g.g3
    h = {r.level: r for r in P.headline(real, null).collect()}
    assert set(h) == {"element", "locus"} and all(r.n == 60 and r.n_upper > 50 and r.n_lower == 0 and r.prob_greater > 0.95 for r in h.values())
    f, n = (A.aggregate_features(A.collapse_to_loci(d)) for d in (real, null))
    c = P.null_comparison(f, {"random": n, "self": f}).collect()
    assert [r.null for r in c] == ["random", "self"] and c[0].plain > 0.9 > c[1].plain
    counts, share = P.deep_dive({0: (real, null), 1: (facts(spark, 0.6), null)}, (0.1, 0.2), 40)
    rows = counts.collect()
    assert len(rows) == 4 and all(0 < r.n_high <= min(r.n_fdr, r.n_robust) for r in rows)
    assert 0 <= share.first().reproduced <= 1
    assert A.loci_per_feature(real).first().n_loci == 6


def test_headline_reads_its_tables_once(spark, tmp_path):
    from helixframe.plans import programs as P

    rows = [(f, e, e % 3, ((f * 7 + e * 5) % 11 - 5) / 5, 1.0 + (f + e) % 3) for f in range(12) for e in range(6)]
    for name in ("real", "null"):
        spark.createDataFrame(rows, "feature_id bigint, elem_id bigint, locus bigint, a_f double, mass double").write.parquet(f"{tmp_path}/{name}")
    out = P.headline(*(spark.read.parquet(f"{tmp_path}/{name}") for name in ("real", "null")))
    assert not out.inputFiles()  # what eight figures are made of is worked out once
    assert {(r.level, r.n, r.prob_greater) for r in out.collect()} == {("element", 12, 0.5), ("locus", 12, 0.5)}
