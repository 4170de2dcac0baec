"""Composite programs: the pipeline's phases and the audits as plans over the operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.durable import durable
from helixframe.functions import sequences as S
from helixframe.functions import stats
from helixframe.functions.arrow import row_struct
from helixframe.operators import alignment as A
from helixframe.operators import models as M
from helixframe.operators import resample as R
from helixframe.operators import vectors as V


def _rank(v: np.ndarray) -> np.ndarray:
    """Average ranks."""
    _, inverse, n = np.unique(v, return_inverse=True, return_counts=True)
    end = np.cumsum(n)
    return (end - (n - 1) / 2)[inverse]


def _ranked_precision(i: np.ndarray, rank: np.ndarray) -> float:
    """X8 of weights against the average ranks of the effects."""
    if len(i) < 3 or i.sum() <= 0:
        return 0.0
    return float(2 * (i * (rank - 1) / (len(rank) - 1 + 1e-12)).sum() / i.sum() - 1)


def _weighted_precision(i: np.ndarray, e: np.ndarray) -> float:
    return _ranked_precision(i, _rank(e))


def ism_alignment(corpus: DataFrame, masked: bool = False) -> DataFrame:
    """C1 (G10 with masked): (seq_id, feature_id, a_f, mass) of each motif channel that is active on a sequence.

    Sensitivity is I4, effect the planted motifs' mean effect by position (F9); mass is the channel's summed activation.
    Masked, positions of the repeat mask take no part, and sequences of fewer than ten others drop out.  One pass over the
    sequences; what comes out is the alignment fact.
    """

    def one(seq):
        x, out = S.codes(seq), []
        planted = [(int(i), name) for name, (c, _) in S.MOTIFS.items() for i in np.flatnonzero(S.matches(x, c) == len(c))]
        keep = ~S.repeat_mask(seq) if masked and planted else np.ones(len(x), bool)
        if planted and keep.sum() >= (10 if masked else 3):
            rank = _rank((S.motif_effect(x, planted).sum(axis=1) / 3.0)[keep])  # of all channels
            for k, (_, (consensus, _)) in enumerate(S.MOTIFS.items()):
                z = np.maximum(S.motif_scan(x, consensus), 0.0)
                if len(z) and z.max() > 0:
                    i = S.sensitivity(x, consensus).mean(axis=1)
                    out.append({"feature_id": k, "a_f": _ranked_precision(i[keep], rank), "mass": float(z.sum())})
        return (out,)

    r = corpus.select("seq_id", row_struct(one, "a array<struct<feature_id:int,a_f:double,mass:double>>")(F.col("seq")).alias("s"))
    return r.select("seq_id", F.explode("s.a").alias("a")).select("seq_id", "a.*")


def signal_audit(real: DataFrame, null: DataFrame) -> dict[str, DataFrame]:
    """Shift (Mann-Whitney), tails, counts of survivors on both sides, per-locus share of positive features."""
    rl, nl = A.collapse_to_loci(real), A.collapse_to_loci(null)
    features, nulls = A.aggregate_features(rl), A.aggregate_features(nl)
    q = lambda up: stats.bh_qvalue(stats.empirical_pvalue(features, "A_f", nulls, "A_f", up), "p_value")
    share = rl.groupBy("locus").agg(F.avg((F.col("a_f") > 0).cast("double")).alias("real")).join(nl.groupBy("locus").agg(F.avg((F.col("a_f") > 0).cast("double")).alias("null")), "locus")
    return {"shift": A.mann_whitney(features, nulls), "tails": A.tail_symmetry(features, nulls), "upper": q(True), "lower": q(False), "loci": share}


def locus_tests(share: DataFrame) -> tuple[float | None, float | None]:
    """X14 over signal_audit's loci, one row each: against one half, and paired against the null."""
    rows = share.select("real", "null").collect()
    return M.wilcoxon([r[0] for r in rows]), M.wilcoxon([r[0] - r[1] for r in rows], 0.0)


def high_confidence(real: DataFrame, null: DataFrame, q: float = 0.10, reps: int = 1000, pct: float = 0.95) -> DataFrame:
    """causal_test's features with their bootstrap interval, ci_robust and high_confidence."""
    loci = A.collapse_to_loci(real)
    threshold = stats.percentile_of(A.aggregate_features(A.collapse_to_loci(null)), "A_f", pct)
    ci = R.bootstrap_ci(loci, "feature_id", "locus", "a_f", "mass", reps)
    return A.robust(A.causal_test(real, null, pct), ci, threshold, q)


def deep_dive(by_seed: dict[int, tuple[DataFrame, DataFrame]], qs=(0.05, 0.10, 0.20), reps: int = 1000) -> tuple[DataFrame, DataFrame]:
    """G6 over seeds: counts (seed, q, n_fdr, n_robust, n_high) and the share of the first seed's high-confidence set that all others reproduce."""
    counts, hits = [], []
    for seed, (real, null) in by_seed.items():
        tested = high_confidence(real, null, max(qs), reps).withColumn("seed", F.lit(seed)).persist()
        for q in qs:
            below = F.col("q_value") < q
            counts.append(tested.agg(F.lit(seed).alias("seed"), F.lit(q).alias("q"), F.count_if(below).alias("n_fdr"), F.count_if("ci_robust").alias("n_robust"), F.count_if(below & F.col("ci_robust")).alias("n_high")))
        hits.append(tested.select("feature_id", "seed", F.col("high_confidence").alias("hit")))
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    return union(counts), A.seed_reproduced(union(hits))


def subspace_stability(a: DataFrame, b: DataFrame, seed: int = 0) -> dict[str, float | None]:
    """Overlap of two sets of directions, of random bases of the same ranks, and the nearest-cosine summary."""
    ua, ub = V.subspace_basis(a), V.subspace_basis(b)
    base = V.subspace_overlap(V.random_basis(len(ua), ua.shape[1], seed), V.random_basis(len(ub), ub.shape[1], seed + 1)) if ua.size and ub.size else None
    near = V.cosine_nearest(a, b).agg(F.percentile("cosine", F.lit(0.5)).alias("m"), F.avg((F.col("cosine") > 0.5).cast("double")).alias("s")).first()
    return {"overlap": V.subspace_overlap(ua, ub), "random": base, "median_nearest": near["m"], "share_above_half": near["s"]}


def calibration(align: DataFrame, reps: int = 100) -> DataFrame:
    """Studentised features."""
    loci = A.collapse_to_loci(align)
    ci = R.bootstrap_ci(loci, "feature_id", "locus", "a_f", "mass", reps)
    return R.studentised(A.aggregate_features(loci), ci)


def probe_report(probe: DataFrame, alphas=(1.0, 10.0, 100.0, 1000.0)) -> dict[str, float | None]:
    """Ridge under leave-one-group-out at the first best alpha, partial least squares by rank, and stability."""
    ridges = {f"ridge_{a}": lambda n, s, g, a=a: M.ridge(n, s, g, a) for a in alphas}
    ranks = {f"pls_{r}": lambda n, s, g, r=r: M.pls(n, s, g, r) for r in (1, 2, 3)}
    scores = M.mean_scores(probe, ridges | ranks)
    alpha = max(alphas, key=lambda a: (-np.inf if scores[f"ridge_{a}"] is None else scores[f"ridge_{a}"], -a))
    _, w = M.group_folds(probe, ridges[f"ridge_{alpha}"])
    return {"alpha": alpha, "ridge": scores[f"ridge_{alpha}"], "stability": M.direction_stability(w)} | {name: scores[name] for name in ranks}


def train_and_test(acts: DataFrame, width: int, k: int, epochs: int = 3, family: str = "topk", rate: float = 3e-3, seed: int = 0, batch: int = 256) -> dict[str, float]:
    """An encoder trained on acts, its FVU, the share of features that never fire, and whether both gates hold."""
    p, bias, losses = M.train(acts, width, k, epochs, family, rate, seed, batch)
    f, fired, n = V.reconstruction(acts, M.codes_of(family, p, bias, k), p["w"], bias)
    dead = float((fired == 0).mean())
    return {"fvu": f, "dead": dead, "l0": float(fired.sum() / max(1, n)), "accepted": float(f <= 0.15 and dead <= 0.05), "first_loss": losses[0], "last_loss": losses[-1]}


def family_calibration(acts: DataFrame, width: int, k: int, rates=(1e-3, 3e-3, 1e-2), epochs: int = 3, families=("topk", "gated", "jumprelu")) -> list[dict]:
    """train_and_test for each family and rate, as rows of a table."""
    return [{"family": f, "rate": r} | train_and_test(acts, width, k, epochs, f, r) for f in families for r in rates]


def _tested(elements: DataFrame, model, layer: int, encode, null: DataFrame, groups: DataFrame | None) -> DataFrame:
    """C3 of one encoder over elements; by locus if groups (elem_id, locus) are given, else each element is its own."""
    from helixframe.operators import toy

    real = toy.alignments(elements, model, encode, layer, "precision_weighted")
    located = lambda d: A.attach_loci(d, groups) if groups is not None else d.withColumn("locus", F.col("elem_id"))
    return A.causal_test(located(real), located(null))


def dictionary_sweep(acts: DataFrame, elements: DataFrame, groups: DataFrame, model, layer: int, expansions=(4, 8, 16, 32), k: int = 16, epochs: int = 3, seeds=(0, 1), null_directions: int = 100) -> list[dict]:
    """For each dictionary size and level (element, locus) the FVU, the share above the threshold, survivors at
    q < 0.1, and between seeds the Jaccard of the causal sets by id and by matched directions, and its rank agreement."""
    from helixframe.operators import toy

    spark, d, out = acts.sparkSession, model.d_model, []
    null_w = np.random.default_rng(1).standard_normal((null_directions, d))
    null = toy.alignments(elements, model, toy.relu_encoder(null_w / np.linalg.norm(null_w, axis=1, keepdims=True)), layer, "precision_weighted").persist()
    for x in expansions:
        trained = [M.train(acts, d * x, k, epochs, seed=s)[:2] for s in seeds]
        fvu = [V.reconstruction(acts, M.codes_of("topk", p, b, k), p["w"], b)[0] for p, b in trained]
        weights = [spark.createDataFrame([(i, [float(v) for v in w]) for i, w in enumerate(p["w"])], "feature_id bigint, w array<double>") for p, _ in trained]
        for level in ("element", "locus"):
            tests = [_tested(elements, model, layer, M.codes_of("topk", p, b, k), null, groups if level == "locus" else None).persist() for p, b in trained]
            for s, f, t in zip(seeds, fvu, tests, strict=True):
                r = t.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("A_f") > F.col("threshold")).cast("double")).alias("above"), F.count_if(F.col("q_value") < 0.1).alias("survivors")).first()
                out.append({"expansion": x, "m": d * x, "level": level, "seed": s, "fvu": f, **r.asDict()})
            if len(tests) > 1:
                out[-1] |= agreement(tests[0], tests[1], weights[0], weights[1])
            for t in tests:
                t.unpersist()
    null.unpersist()
    return out


def agreement(a: DataFrame, b: DataFrame, wa: DataFrame | None = None, wb: DataFrame | None = None) -> dict[str, float | None]:
    """Of two tested encoders: Jaccard of their causal ids (U1), rank correlation of A_f over common ids (J5, X5), and with
    directions the Jaccard of matched features (U2, U3)."""
    hit = lambda d, n: d.select("feature_id", F.col("A_f").alias(f"a{n}"), (F.col("A_f") > F.col("threshold")).alias(f"h{n}"))
    j = hit(a, 0).join(hit(b, 1), "feature_id", "full")
    ids = A.jaccard(j.fillna(False, ["h0", "h1"]), "feature_id", "h0", "h1").first()["jaccard"]
    rho = stats.spearman(j.withColumn("g", F.lit(0)), ["g"], "a0", "a1").first()
    out = {"jaccard": ids, "rho": rho["rho"] if rho else None}
    if wa is not None:
        side = lambda d: d.select(F.col("feature_id").alias("id"), (F.col("A_f") > F.col("threshold")).alias("hit"))
        m = A.matched_jaccard(M.match_features(wa, wb), side(a), side(b)).first()
        out |= {"pair_jaccard": m["pair_jaccard"], "hybrid_jaccard": m["hybrid_jaccard"]}
    return out


def cross_family(acts: DataFrame, elements: DataFrame, groups: DataFrame, model, layer: int, width: int, k: int = 16, epochs: int = 3, families=("topk", "gated", "jumprelu"), null_directions: int = 100) -> list[dict]:
    """For each pair of families, by element and by locus, how their causal sets and directions agree, and the
    overlap of the subspaces that their causal directions span."""
    from helixframe.operators import toy

    spark, out = acts.sparkSession, []
    null_w = np.random.default_rng(1).standard_normal((null_directions, model.d_model))
    null = toy.alignments(elements, model, toy.relu_encoder(null_w / np.linalg.norm(null_w, axis=1, keepdims=True)), layer, "precision_weighted").persist()
    trained = {f: M.train(acts, width, k, epochs, f)[:2] for f in families}
    weights = {f: spark.createDataFrame([(i, [float(v) for v in w]) for i, w in enumerate(p["w"])], "feature_id bigint, w array<double>") for f, (p, _) in trained.items()}
    for level in ("element", "locus"):
        tests = {f: _tested(elements, model, layer, M.codes_of(f, p, b, k), null, groups if level == "locus" else None).persist() for f, (p, b) in trained.items()}
        bases = {f: V.subspace_basis(weights[f].join(t.where("label = 'causal'").select("feature_id"), "feature_id", "semi")) for f, t in tests.items()}
        for i, a in enumerate(families):
            for b in families[i + 1 :]:
                out.append({"level": level, "a": a, "b": b, **agreement(tests[a], tests[b], weights[a], weights[b]), "overlap": V.subspace_overlap(bases[a], bases[b])})
        for t in tests.values():
            t.unpersist()
    null.unpersist()
    return out


def metric_bake_off(profiles: DataFrame, truth: DataFrame | None = None, seed: int = 0, metrics=None) -> DataFrame:
    """(metric, real, shuffled, separation, auroc) of every metric over profiles (elem, locus, pos, i, e, gc): median score, median
    score against another locus's effects, P(real > shuffled), and how well scores tell the elements of truth (elem, is_causal)."""
    from helixframe.operators.metrics import EXPERIMENT

    out = []
    for name in metrics or EXPERIMENT:
        real = EXPERIMENT[name](profiles).select("elem", "score")
        shuffled = A.shuffled_scores(profiles, name, seed).select("elem", F.col("a_f").alias("score"))
        one = real.agg(F.lit(name).alias("metric"), F.percentile("score", F.lit(0.5)).alias("real"))
        two = shuffled.agg(F.percentile("score", F.lit(0.5)).alias("shuffled"))
        shift = A.mann_whitney(real, shuffled, "score").select(F.col("prob_greater").alias("separation"))
        row = one.crossJoin(two).crossJoin(shift)
        if truth is not None:
            told = stats.auroc(real.join(truth, "elem").withColumn("g", F.lit(0)), ["g"], "score", "is_causal").agg(F.max("auroc").alias("auroc"))
            row = row.crossJoin(told)
        out.append(row)
    table = out[0]
    for row in out[1:]:
        table = table.unionByName(row)
    return table


def metric_gate(real: DataFrame, null: DataFrame, shuffled: DataFrame, pct: float = 0.95) -> DataFrame:
    """G30 over alignment facts: shares of features above the null's percentile for the real, null and shuffled sides, and
    the gates: real above null, shuffled within 0.03 of null, shuffled below real."""
    features = [A.aggregate_features(A.collapse_to_loci(d)) for d in (real, null, shuffled)]
    t = stats.percentile_of(features[1], "A_f", pct)
    share = lambda d, n: A.causal_fraction(d.crossJoin(F.broadcast(t)), F.col("threshold")).withColumnRenamed("causal_fraction", n)
    s = share(features[0], "real").crossJoin(share(features[1], "null")).crossJoin(share(features[2], "shuffled"))
    return s.withColumns({"g1": F.col("real") > F.col("null"), "g2": F.col("shuffled") <= F.col("null") + 0.03, "g3": F.col("shuffled") < F.col("real")})


def null_comparison(features: DataFrame, nulls: dict[str, DataFrame], density: str = "mean_mass", pct: float = 0.95) -> DataFrame:
    """(null, plain, stratified, lower): shares of features above each null's percentile, above that of the null's features of like
    density (X16), and below its mirror percentile."""
    out = []
    for name, null in nulls.items():
        plain = features.crossJoin(F.broadcast(null.agg(F.percentile("A_f", F.lit(pct)).alias("hi"), F.percentile("A_f", F.lit(1 - pct)).alias("lo"))))
        row = plain.agg(F.lit(name).alias("null"), F.avg((F.col("A_f") > F.col("hi")).cast("double")).alias("plain"), F.avg((F.col("A_f") < F.col("lo")).cast("double")).alias("lower"))
        own = A.stratified_threshold(features, null, density, pct).agg(F.avg((F.col("A_f") > F.col("threshold")).cast("double")).alias("stratified"))
        out.append(row.crossJoin(own))
    table = out[0]
    for row in out[1:]:
        table = table.unionByName(row)
    return table


def probe_blocks(elements: DataFrame, model=None, layer: int = 1, k: int | None = None) -> DataFrame:
    """G8's rows (elem_id, pos, x, y): hidden rows of a model, or F12's composition, or the one-hot word of k bases around (W7), against the effect."""

    def one(seq, e_mean):
        x = S.codes(seq)
        if model is not None:
            f = model.hidden(x, layer)
        elif k:
            f = np.eye(4**k)[S.kmer_codes(x, k)]
        else:
            f = S.probe_features(x)
        return ([{"pos": i, "x": v.tolist(), "y": float(e)} for i, (v, e) in enumerate(zip(f, e_mean, strict=False))],)

    u = row_struct(one, "rows array<struct<pos:int,x:array<double>,y:double>>")
    return elements.select("elem_id", F.explode(u("seq", "e_mean")["rows"]).alias("r")).select("elem_id", "r.*")


def probe_comparison(elements: DataFrame, model, layer: int, k: int = 3, alphas=(1.0, 10.0, 100.0, 1000.0), group: str = "elem_id") -> DataFrame:
    """(features, alpha, rho): hidden rows, composition and k-mers under leave-one-group-out ridge, each at its first best alpha.

    One pass over the rows gives the sums that all alphas share.
    """
    rows, spark = [], elements.sparkSession
    for name, blocks in (("hidden", probe_blocks(elements, model, layer)), ("composition", probe_blocks(elements)), ("kmers", probe_blocks(elements, k=k))):
        scores = _best_ridge(blocks.withColumn("grp", F.xxhash64(group)), alphas)
        rows.append((name, *scores))
    return spark.createDataFrame(rows, "features string, alpha double, rho double")


def _best_ridge(blocks: DataFrame, alphas) -> tuple[float, float | None]:
    scores = M.mean_scores(blocks, {str(a): lambda n, s, g, a=a: M.ridge(n, s, g, a) for a in alphas})
    return max(((a, scores[str(a)]) for a in alphas), key=lambda f: (-np.inf if f[1] is None else f[1], -f[0]))


def layer_sweep(elements: DataFrame, model, alphas=(1.0, 10.0, 100.0), mlp: bool = True) -> DataFrame:
    """(layer, alpha, ridge, mlp) of probes on each candidate layer, and the best by ridge (T6: lower layer of equals)."""
    from helixframe.operators import toy

    rows = []
    for layer in toy.layer_candidates(model.layers):
        blocks = probe_blocks(elements, model, layer).withColumn("grp", F.xxhash64("elem_id"))
        alpha, rho = _best_ridge(blocks, alphas)
        deep = M.mlp_folds(blocks).agg(F.avg("rho")).first()[0] if mlp else None
        rows.append((layer, alpha, rho, deep))
    best = max(rows, key=lambda r: (r[2] if r[2] is not None else -np.inf, -r[0]))[0]
    return elements.sparkSession.createDataFrame([(*r, r[0] == best) for r in rows], "layer int, alpha double, ridge double, mlp double, best boolean")


def corpus_power(elements: DataFrame, least: int = 20, nonzero: int = 1000) -> DataFrame:
    """G1: elements, positions with an effect, and whether both suffice for the test."""
    s = elements.agg(F.count(F.lit(1)).alias("n_elements"), F.coalesce(F.sum(F.size(F.filter("e_mean", lambda e: F.abs(e) > 0))), F.lit(0)).alias("n_nonzero"))
    return s.withColumn("enough", (F.col("n_elements") >= least) & (F.col("n_nonzero") >= nonzero))


def headline(real: DataFrame, null: DataFrame, q: float = 0.10) -> DataFrame:
    """At element and at locus level the features, threshold, share above and below, survivors on both sides, and the shift."""
    out = []
    real, null = durable(real), durable(null)
    for level, up in (("element", lambda d: d.select("feature_id", F.col("elem_id").alias("locus"), "a_f", "mass")), ("locus", A.collapse_to_loci)):
        # a row a feature, which eight figures are made of
        f, n = durable(A.aggregate_features(up(real))), durable(A.aggregate_features(up(null)))
        upper, lower = (stats.bh_qvalue(stats.empirical_pvalue(f, "A_f", n, "A_f", side), "p_value").agg(F.count_if(F.col("q_value") < q).alias(c)) for side, c in ((True, "n_upper"), (False, "n_lower")))
        size = f.agg(F.lit(level).alias("level"), F.count(F.lit(1)).alias("n"), F.percentile("A_f", F.lit(0.5)).alias("median_A"))
        out.append(size.crossJoin(stats.percentile_of(n, "A_f", 0.95)).crossJoin(A.tail_symmetry(f, n)).crossJoin(upper).crossJoin(lower).crossJoin(A.mann_whitney(f, n).select("prob_greater")))
    return out[0].unionByName(out[1])
