"""Corpus, activations by layer, encoders of several seeds, annotation, the causal test with its four controls, a report."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import stats
from helixframe.operators import alignment as A
from helixframe.operators import models as M
from helixframe.operators import resample as R
from helixframe.operators import sequence as Q
from helixframe.operators import toy
from helixframe.operators import vectors as V
from helixframe.plans import programs as P
from helixframe.settings import Settings, snapshot
from helixframe.sources import folders
from helixframe.sources import genome as G


def pick_layer(corpus: DataFrame, model) -> tuple[int, DataFrame]:
    """The candidate layer of greatest mean variance, the lower one of equals; and the table (layer, mean_var)."""
    parts = [V.moments(toy.activations(corpus, model, layer)).agg(F.lit(layer).alias("layer"), F.avg("var").alias("mean_var")) for layer in toy.layer_candidates(model.layers)]
    sweep = parts[0]
    for p in parts[1:]:
        sweep = sweep.unionByName(p)
    rows = sweep.collect()
    return max(rows, key=lambda r: (r["mean_var"], -r["layer"]))["layer"], sweep


WEIGHTS = "kind string, feature_id bigint, w array<double>"


def _trained(spark: SparkSession, acts: DataFrame, s: Settings, seed: int) -> DataFrame:
    """An encoder as rows (kind, feature_id, w): its directions, its bias, its losses by epoch."""
    w, b, losses = M.train_topk(acts, s.width, s.k, s.epochs, seed=seed)
    plain = lambda v: [float(x) for x in v]
    return spark.createDataFrame([("direction", i, plain(v)) for i, v in enumerate(w)] + [("bias", 0, plain(b)), ("loss", 0, plain(losses))], WEIGHTS)


def _random(n: int, d: int, seed: int) -> np.ndarray:
    w = np.random.default_rng(seed).standard_normal((n, d))
    return w / np.linalg.norm(w, axis=1, keepdims=True)


def matched_runs(tested: dict[int, DataFrame], weights: dict[int, DataFrame], least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """X18 over seeds: values (feature_id, seed, a) of the first seed's features that every other seed matches, and the matches.

    A match is a pair of directions each the other's nearest by cosine, above `least`, both with a known A_f: one to one without a
    matrix of all pairs.
    """
    first, *others = sorted(tested)
    known = lambda s: tested[s].where("A_f IS NOT NULL").select("feature_id", F.col("A_f").alias("a"))
    values, pairs = known(first).withColumn("seed", F.lit(first)), None
    for s in others:
        there, back = V.cosine_nearest(weights[first], weights[s], signed=True), V.cosine_nearest(weights[s], weights[first], signed=True)
        mutual = there.join(back.select(F.col("feature_id").alias("nearest"), F.col("nearest").alias("_back")), "nearest").where((F.col("_back") == F.col("feature_id")) & (F.col("cosine") > least))
        m = mutual.join(known(first).select("feature_id"), "feature_id").join(known(s).withColumnRenamed("feature_id", "nearest"), "nearest").select("feature_id", F.lit(s).alias("seed"), "cosine", "a")
        pairs = m if pairs is None else pairs.unionByName(m)
        values = values.unionByName(m.select("feature_id", "a", "seed"))
    if pairs is None:
        return values.limit(0), values.withColumn("cosine", F.lit(0.0)).limit(0)
    everywhere = pairs.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(others)).select("feature_id")
    return values.join(everywhere, "feature_id"), pairs


def controls(features: DataFrame, threshold: float, pct: float, loglik: float | None, shuffled: DataFrame, tested: dict[int, DataFrame], weights: dict[int, DataFrame], least: float = 0.5) -> list[dict]:
    """The four controls as rows (control, value, verdict); a value that nothing defines is None.

    null: share of features above the null's percentile; OK above 0.  loglik: share of these above the log-likelihood's own A; OK
    above one half, else WEAK.  shuffle: share of shuffled features above the threshold; OK up to twice the null's tail + 0.02,
    else CHECK.  seeds: median CV of A_f over matched features; OK below 0.5, else unstable, or why there is none.
    """
    share = lambda d: A.causal_fraction(d, F.lit(threshold)).first()["causal_fraction"]
    real, crossed = share(features), share(shuffled)
    beats = features.where(F.col("A_f") > threshold).agg(F.avg((F.col("A_f") > F.lit(loglik)).cast("double")).alias("b")).first()["b"] if loglik is not None else None
    rows = [
        {"control": "null", "value": real, "verdict": "OK" if real else "-"},
        {"control": "loglik", "value": beats, "verdict": "OK" if (beats or 0) > 0.5 else "WEAK"},
        {"control": "shuffle", "value": crossed, "verdict": "OK" if (crossed or 0) <= 2 * (1 - pct) + 0.02 else "CHECK"},
    ]
    if len(tested) < 2:
        return [*rows, {"control": "seeds", "value": None, "verdict": "one seed"}]
    values, _ = matched_runs(tested, weights, least)
    cv = A.seed_cv(values).agg(F.percentile("cv", F.lit(0.5)).alias("cv")).first()["cv"]
    return [*rows, {"control": "seeds", "value": cv, "verdict": "no match" if cv is None else "OK" if cv < 0.5 else "unstable"}]


def run(spark: SparkSession, s: Settings, folder: str, seeds: int | None = None) -> dict:
    """Every stage's table under the folder, each written once for its settings; returns the summary that the report holds.

    Tables: corpus, elements, activations, weights, alignment by seed, null and matched_null (R3 and R4: random directions, as
    they are and firing as rarely as the encoder), shuffled (C6), annotation (G5); and features-SEED with the test's classes,
    for the first seed with interval, high-confidence mark (G6) and annotation, controls (G4), classes, report.
    """
    seeds = s.seeds if seeds is None else seeds
    key = {"settings": snapshot(s)}
    table = lambda name, make, **more: G.memoised(spark, folder, name, key | more, make)
    corpus = table("corpus", lambda: G.synthetic_corpus(spark, s.windows, s.window, s.seed, s.gc))
    elements = table("elements", lambda: folders.load_elements(spark, s.source, s.path, s.release, s.elements, s.element, s.gc, s.seed + 100))
    model = toy.load_model("toy", d_model=s.d_model, layers=s.layers, seed=s.seed)
    layer, sweep = pick_layer(corpus, model)
    acts = table("activations", lambda: toy.activations(corpus, model, layer), layer=layer)
    groups = Q.locus_groups(elements.select("elem_id", "seq")).select("elem_id", "locus")
    located = lambda d: A.attach_loci(d, groups)
    aligned = lambda e, encode: toy.alignments(e, model, encode, layer, s.metric, s.alts, s.summary)
    power = P.corpus_power(elements).first().asDict()
    summary: dict = {"layer": layer, "windows": corpus.count(), "elements": power["n_elements"], "power": power}

    random = _random(s.null_directions, s.d_model, s.seed + 1)
    null = table("null", lambda: aligned(elements, toy.relu_encoder(random)), seed=s.seed + 1)
    threshold = stats.percentile_of(A.aggregate_features(A.collapse_to_loci(located(null)), s.min_active), "A_f", s.null_pct)
    tested, weights, encoders = {}, {}, {}
    for seed in range(seeds):
        held = table("weights", lambda: _trained(spark, acts, s, seed), seed=seed)  # noqa: B023
        weights[seed] = held.where("kind = 'direction'").select("feature_id", "w")
        b = np.array(held.where("kind = 'bias'").first()["w"])
        encoders[seed] = V.matrix(weights[seed])[1], b
        encode = toy.topk_encoder(*encoders[seed], s.k)
        real = table("alignment", lambda: aligned(elements, encode), seed=seed)  # noqa: B023
        out = A.causal_test(located(real), located(null), s.null_pct, s.min_active)
        if not seed:
            ci = R.bootstrap_ci(A.collapse_to_loci(located(real)), "feature_id", "locus", "a_f", "mass", s.replicates)
            out = A.robust(out, ci, threshold, s.q)
            codes = V.encode(acts, "topk", {"w": encoders[0][0]}, b, s.k).join(acts.select("token", "seq_id"), "token")
            notes = table("annotation", lambda: toy.annotate(codes, corpus.select("seq_id", "cls"), Q.motif_hits(corpus).select("seq_id", "motif", "has"), weights[0]))  # noqa: B023
            out = out.join(notes.withColumnsRenamed({"label": "note", "p_value": "motif_p"}), "feature_id", "left")
        out.write.mode("overwrite").parquet(f"{folder}/features-{seed}")
        tested[seed] = spark.read.parquet(f"{folder}/features-{seed}")
        labels = {r["label"]: r["count"] for r in tested[seed].groupBy("label").count().collect()}
        summary[f"seed_{seed}"] = {"losses": held.where("kind = 'loss'").first()["w"], "labels": labels}
    if not seeds:
        return summary

    first = tested[0]
    tokens, fired = acts.count(), V.encode(acts, "topk", {"w": encoders[0][0]}, encoders[0][1], s.k)
    live = fired.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("feature_id").alias("live")).first()
    directions = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(random)], "feature_id bigint, w array<double>")
    theta = {r["feature_id"]: r["theta"] for r in V.matched_null_theta(acts, directions, live["n"] / max(1, tokens * s.width)).collect()}
    rare = toy.relu_encoder(random, np.array([theta[i] for i in range(len(random))]))
    matched = table("matched_null", lambda: aligned(elements, rare), seed=s.seed + 1)
    base = stats.weighted_median(toy.loglik_baseline(elements), ["feature_id"], "a_f", "mass", "A_f").first()
    pairs = A.partners(groups.withColumnRenamed("elem_id", "elem"), s.seed).select(F.col("elem").alias("elem_id"), F.col("other"))
    crossed = elements.select("elem_id", "seq").join(pairs, "elem_id").join(elements.select(F.col("elem_id").alias("other"), "e_mean"), "other").drop("other")
    shuffled = table("shuffled", lambda: aligned(crossed, toy.topk_encoder(*encoders[0], s.k)).withColumn("mass", F.lit(1.0)))
    up = lambda d: A.aggregate_features(A.collapse_to_loci(located(d)), s.min_active)
    limit = threshold.first()["threshold"]
    rows = controls(first, limit, s.null_pct, base["A_f"] if base else None, up(shuffled), tested, weights, s.match)
    own = stats.percentile_of(up(matched), "A_f", s.null_pct).first()["threshold"]
    rows.append({"control": "matched null", "value": A.causal_fraction(first, F.lit(own)).first()["causal_fraction"], "verdict": "-"})
    spark.createDataFrame([(r["control"], r["value"], r["verdict"]) for r in rows], "control string, value double, verdict string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/controls")
    classes = first.where("A_f IS NOT NULL").groupBy("note").agg(F.count(F.lit(1)).alias("n"), F.percentile("A_f", F.lit(0.5)).alias("median_A"), F.avg((F.col("A_f") > limit).cast("double")).alias("share"))
    classes.coalesce(1).write.mode("overwrite").parquet(f"{folder}/classes")
    top = first.agg(F.count_if("ci_robust").alias("robust"), F.count_if("high_confidence").alias("high"), F.count_if((F.col("label") == "causal") & (F.col("note") == "unannotated")).alias("novel")).first()
    summary |= {"threshold": limit, "matched_threshold": own, "live": live["live"], "loglik_A": base["A_f"] if base else None, "controls": {r["control"]: (r["value"], r["verdict"]) for r in rows}, **top.asDict()}
    tables = "\n\n".join(f"## {name}\n\n{G.markdown(d)}" for name, d in (("Layers", sweep.orderBy("layer")), ("Controls", spark.read.parquet(f"{folder}/controls")), ("Classes", spark.read.parquet(f"{folder}/classes").orderBy("note"))))
    folders.write_text(spark, f"{report(summary)}\n\n{tables}", f"{folder}/report")
    folders.write_text(spark, snapshot(s), f"{folder}/settings")
    return summary


def report(summary: dict) -> str:
    """The summary in Markdown."""
    lines = ["# Causal test", ""]
    for k, v in summary.items():
        lines.append(f"- {k}: {v}")
    return "\n".join(lines)
