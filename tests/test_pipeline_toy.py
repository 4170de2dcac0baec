import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe import settings
from helixframe.functions import sequences as S
from helixframe.operators import sequence as Q
from helixframe.operators import toy
from helixframe.plans import pipeline
from helixframe.sources import genome as G


def naive(x, model, encode, layer, alts, summary):
    base = encode(model.hidden(x, layer)).max(axis=0)
    out = []
    for p in range(len(x)):
        for b in [c for c in range(4) if c != x[p]][: 3 if alts == "all" else 1]:
            y = x.copy()
            y[p] = b
            z = encode(model.hidden(y, layer))
            out.append(np.abs(base - (z[p] if summary == "token" else z.max(axis=0))))
    return np.array(out).reshape(len(x), -1, len(base))


@pytest.mark.parametrize("n", [20, 150])
@pytest.mark.parametrize("summary", ["max", "token"])
@pytest.mark.parametrize("layer", [1, 3])
def test_sensitivity_equals_encoding_whole_variants(n, summary, layer):
    rng = np.random.default_rng(n)
    x = rng.integers(0, 4, n).astype(np.int8)
    x[n // 3 : n // 3 + 6] = S.codes("GATAAG")
    model = toy.ToyModel(d_model=16, layers=4)
    encode = toy.topk_encoder(rng.standard_normal((24, 16)), rng.standard_normal(16) * 0.1, 5)
    got, _ = toy.sensitivity(x, model, encode, layer, "all", summary)
    assert np.allclose(got, naive(x, model, encode, layer, "all", summary), atol=1e-9)
    first, _ = toy.sensitivity(x, model, encode, layer, "first", summary)
    assert np.allclose(first, got[:, :1])


def test_settings():
    s = settings.load(["k=4", "smoke=true"], {"gc": 0.5})
    assert s.k == 4 and s.window == 256 and s.gc == 0.5 and s.width == 128
    with pytest.raises(ValueError):
        settings.load(["nope=1"])


def test_settings_file(tmp_path, monkeypatch):
    (tmp_path / "a.yaml").write_text("k: 5\ngc: 0.3\nsmoke_values: {k: 7}\n")
    (tmp_path / "b.json").write_text('{"window": 99}')
    assert settings.load(path=str(tmp_path / "a.yaml")).k == 5
    s = settings.load(["smoke=true", "windows=9"], {"gc": 0.6}, str(tmp_path / "a.yaml"))
    assert (s.k, s.gc, s.windows, s.window) == (7, 0.6, 9, 256)
    monkeypatch.setenv("HELIXFRAME_SETTINGS", str(tmp_path / "b.json"))
    assert settings.load().window == 99
    (tmp_path / "b.json").write_text("[1]")
    with pytest.raises(ValueError):
        settings.load()
    (tmp_path / "b.json").write_text('{"nope": 1}')
    with pytest.raises(ValueError):
        settings.load()
    assert settings.under("s3://x/", "a", "/b") == "s3://x/a/b"


def test_layers():
    assert toy.layer_candidates(8) == [2, 4, 6] and toy.layer_candidates(2) == [1] and toy.layer_candidates(3) == [1, 2]


def test_activations_and_annotation(spark):
    c = G.synthetic_corpus(spark, 40, 80)
    model = toy.ToyModel(d_model=16, layers=2)
    acts = toy.activations(c, model, 1).cache()
    assert acts.count() == 40 * 80 and acts.select("token").distinct().count() == 3200
    codes = acts.select("seq_id", "token", F.lit(0).cast("bigint").alias("feature_id"), F.col("h")[0].alias("z")).where("z > 0")
    features = spark.createDataFrame([(0,), (1,)], "feature_id bigint")
    got = {r.feature_id: r.label for r in toy.annotate(codes, c.select("seq_id", "cls"), Q.motif_hits(c).select("seq_id", "motif", "has"), features).collect()}
    assert got[1] == "dead" and got[0] in ("motif", "element", "unannotated")


SMALL = ["smoke=true", "windows=40", "window=64", "elements=5", "element=64", "expansion=1", "null_directions=10", "epochs=1", "d_model=16", "seeds=2", "replicates=20"]


def test_pipeline_smoke(spark, tmp_path):
    s = settings.load(SMALL)
    out = pipeline.run(spark, s, str(tmp_path))
    assert out["elements"] == 5 and all(sum(out[f"seed_{i}"]["labels"].values()) > 0 for i in range(2)) and not out["power"]["enough"]
    again = pipeline.run(spark, s, str(tmp_path))  # from the written tables
    assert again == out
    read = lambda name: spark.read.parquet(str(tmp_path / name))
    f = read("features-0")
    assert {"A_f", "threshold", "q_value", "lo", "ci_robust", "high_confidence", "note", "top_motif", "label"} <= set(f.columns)
    assert f.where("label = 'causal'").count() == f.where("A_f > threshold").count() == out["seed_0"]["labels"].get("causal", 0)
    assert f.where("high_confidence AND NOT ci_robust").count() == 0 and f.where("note IS NULL").count() == 0
    got = {r.control: r for r in read("controls").collect()}
    assert set(got) == {"null", "loglik", "shuffle", "seeds", "matched null"}
    n = f.where("A_f IS NOT NULL").count()
    assert got["null"].value == pytest.approx(f.where(f"A_f > {out['threshold']!r}").count() / n)
    assert got["loglik"].verdict in ("OK", "WEAK") and got["shuffle"].verdict in ("OK", "CHECK") and got["seeds"].verdict in ("OK", "unstable", "no match")
    assert read("classes").agg(F.sum("n")).first()[0] == n
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "report")).collect())
    assert "## Controls" in text and "matched null" in text


def test_pipeline_on_an_assay_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rng = np.random.default_rng(3)
    for name in ("x", "y"):
        rows = [f"{p}\t{'ACGT'[b]}\t{'ACGT'[(b + 1) % 4]}\t{rng.normal():.3f}" for p, b in enumerate(rng.integers(0, 4, 70))]
        (tmp_path / "in" / f"{name}.tsv").write_text("\n".join(["pos\tref\talt\teffect", *rows]))
    s = settings.load([*SMALL, "source=assay", f"path={tmp_path / 'in'}", "seeds=1"])
    out = pipeline.run(spark, s, str(tmp_path / "out"))
    assert out["elements"] == 2 and out["controls"]["seeds"] == (None, "one seed") and out["power"]["n_nonzero"] > 100


def test_matched_runs_and_verdicts(spark):
    w = {0: [[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]], 1: [[0.0, 2.0], [3.0, 0.1], [0.1, 1.0]]}
    weights = {s: spark.createDataFrame([(i, v) for i, v in enumerate(m)], "feature_id bigint, w array<double>") for s, m in w.items()}
    tested = {0: [(0, 0.4), (1, 0.2), (2, 0.9)], 1: [(0, 0.2), (1, 0.6), (2, None)]}
    tested = {s: spark.createDataFrame(r, "feature_id bigint, A_f double") for s, r in tested.items()}
    values, pairs = pipeline.matched_runs(tested, weights)
    # feature 2 points away from all of the second run; the second run's third direction is nobody's nearest
    assert sorted((r.feature_id, r.seed, r.a) for r in values.collect()) == [(0, 0, 0.4), (0, 1, 0.6), (1, 0, 0.2), (1, 1, 0.2)] and pairs.count() == 2
    rows = {r["control"]: r for r in pipeline.controls(tested[0], 0.3, 0.95, 0.5, tested[1], tested, weights)}
    assert rows["null"]["value"] == pytest.approx(2 / 3) and rows["null"]["verdict"] == "OK"
    assert rows["loglik"]["value"] == 0.5 and rows["loglik"]["verdict"] == "WEAK"
    assert rows["shuffle"]["value"] == 0.5 and rows["shuffle"]["verdict"] == "CHECK"
    assert rows["seeds"]["value"] == pytest.approx(0.1) and rows["seeds"]["verdict"] == "OK"
    alone = pipeline.controls(tested[0], 0.95, 0.95, None, tested[1].limit(0), {0: tested[0]}, weights)
    assert [r["verdict"] for r in alone] == ["-", "WEAK", "OK", "one seed"]


def test_substitution_alignment_and_tracks(spark):
    e = toy.elements_of(G.synthetic_corpus(spark, 4, 64, weights={"ccre": 1.0, "background": 0.0}))
    model = toy.ToyModel(d_model=8, layers=2)
    # one direction: the first motif channel's own
    w = model.rotation[:, :1].T
    got = toy.alignments_subst(e, model, toy.relu_encoder(w), 1).collect()
    assert len(got) == 4 and all(-1 <= r.a_f <= 1 and -1 <= r.a_f_subst <= 1 for r in got)
    plain = {r.elem_id: r.a_f for r in toy.alignments(e, model, toy.relu_encoder(w), 1, "precision_weighted").collect()}
    assert all(plain[r.elem_id] == pytest.approx(r.a_f) for r in got)
    t = toy.subspace_tracks(e, model, 1, np.eye(8)[:, :3]).collect()
    assert len(t) == 4 and all(-1 <= r.gc_rho <= 1 and (r.repeat_auroc is None or 0 <= r.repeat_auroc <= 1) for r in t)
