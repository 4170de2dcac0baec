"""Driver queries over embeddings as activations and the integer generator's directions as a dictionary."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import vectors as V
from helixframe.plans.registry import query
from helixframe.sources import tables as T

M, K, D = 64, 8, 64
_V = f"acts AS ({T.VECTORS_SQL}), dirs AS ({T.directions_sql(M, D)})"
_P = f"WITH {_V}, pr AS (SELECT token, r AS feature_id, list_dot_product(h, w) AS dot FROM acts, dirs)"


def _acts(spark, sf_dir):
    return T.vectors(spark, sf_dir)


def _dirs(spark):
    return T.directions(spark, M, D).select(F.col("r").alias("feature_id"), "w")


def _r(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query(f"{_P} SELECT token, feature_id, round(dot, 6) AS dot FROM pr")
def project_directions(spark, sf_dir):
    return _r(V.project(_acts(spark, sf_dir), _dirs(spark)), "dot")


@query(f"{_P} SELECT token, feature_id, round(z, 6) AS z FROM (SELECT token, feature_id, greatest(dot, 0) AS z, row_number() OVER (PARTITION BY token ORDER BY greatest(dot, 0) DESC, feature_id) AS k FROM pr) WHERE k <= {K} AND z > 0")
def encode_topk(spark, sf_dir):
    return _r(V.encode_topk(_acts(spark, sf_dir), _dirs(spark), K), "z")


@query(f"{_P} SELECT token, feature_id, round(z, 6) AS z FROM (SELECT token, feature_id, dot, exp(feature_id / 100.0::DOUBLE) * dot + 0.05 AS z FROM pr) WHERE dot - 0.1 + feature_id / 1000.0::DOUBLE > 0 AND z > 0")
def encode_gated(spark, sf_dir):
    """M8 with a scale and a gate for each feature."""
    import numpy as np

    f = np.arange(M)
    return _r(V.encode_gated(_acts(spark, sf_dir), _dirs(spark), f / 100.0, -0.1 + f / 1000.0, 0.05), "z")


@query(f"{_P} SELECT token, feature_id, round(greatest(dot + 0.01, 0), 6) AS z FROM pr WHERE dot + 0.01 > 0.1 + feature_id / 640.0::DOUBLE")
def encode_jumprelu(spark, sf_dir):
    """M9 with a threshold for each feature."""
    import numpy as np

    return _r(V.encode_jumprelu(_acts(spark, sf_dir), _dirs(spark), 0.1 + np.arange(M) / 640.0, 0.01), "z")


_CODES = f"{_P}, codes AS (SELECT token, feature_id, z FROM (SELECT token, feature_id, greatest(dot, 0) AS z, row_number() OVER (PARTITION BY token ORDER BY greatest(dot, 0) DESC, feature_id) AS k FROM pr) WHERE k <= {K} AND z > 0)"


def _codes(spark, sf_dir):
    return V.encode_topk(_acts(spark, sf_dir), _dirs(spark), K)


@query(f"{_CODES} SELECT feature_id, count(*) AS n_active, round(max(z), 6) AS max_z, round(count(*) / (SELECT count(*) FROM acts)::DOUBLE, 9) AS density FROM codes GROUP BY 1")
def firing_density(spark, sf_dir):
    out = V.firing_density(_codes(spark, sf_dir), _acts(spark, sf_dir).count())
    return _r(out, "max_z").withColumn("density", F.round("density", 9))


@query(f"{_CODES} SELECT feature_id, token, round(z, 6) AS z, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY z DESC, token) AS k FROM codes) WHERE k <= 5")
def top_activating(spark, sf_dir):
    return _r(V.top_activating(_codes(spark, sf_dir), 5), "z").select("feature_id", "token", "z", "rank")


@query(f"{_CODES}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature_id, token // 64 ORDER BY z DESC, token) AS f FROM codes) WHERE f = 1) SELECT feature_id, token, round(z, 6) AS z, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY z DESC, token) AS k FROM b) WHERE k <= 5")
def top_activating_blocks(spark, sf_dir):
    return _r(V.top_activating(_codes(spark, sf_dir), 5, 64), "z").select("feature_id", "token", "z", "rank")


_LONG = f"WITH acts AS ({T.VECTORS_SQL}), lng AS (SELECT token, j - 1 AS j, h[j] AS x FROM (SELECT token, h, unnest(range(1, len(h) + 1)) AS j FROM acts))"


@query(f"{_LONG} SELECT CAST(j AS INT) AS j, round(avg(x), 7) AS mean, round(var_pop(x), 7) AS var FROM lng GROUP BY 1")
def activation_moments(spark, sf_dir):
    return _r(V.moments(_acts(spark, sf_dir)), "mean", "var", digits=7)


@query(f"{_P} SELECT feature_id, round(quantile_cont(dot, 0.9), 6) AS theta FROM pr GROUP BY 1")
def matched_null_theta(spark, sf_dir):
    return _r(V.matched_null_theta(_acts(spark, sf_dir), _dirs(spark), 0.1), "theta")


@query(f"""{_CODES}, lng AS (SELECT token, j - 1 AS j, h[j] AS x FROM (SELECT token, h, unnest(range(1, {D + 1})) AS j FROM acts)), w AS (SELECT r, j - 1 AS j, w[j] AS v FROM (SELECT r, w, unnest(range(1, {D + 1})) AS j FROM dirs)),
bk AS (SELECT token, j, sum(z * v) AS y FROM codes JOIN w ON r = feature_id GROUP BY ALL), s AS (SELECT j, sum(pow(x - coalesce(y, 0), 2)) AS r, sum(x * x) - sum(x) * sum(x) / count(*) AS d FROM lng LEFT JOIN bk USING (token, j) GROUP BY 1)
SELECT round(sum(r) / (sum(d) + 1e-9), 6) AS fvu FROM s""")
def fvu(spark, sf_dir):
    from helixframe.operators.toy import topk_encoder

    w = V.matrix(_dirs(spark))[1]
    f, _, _ = V.reconstruction(_acts(spark, sf_dir), topk_encoder(w, 0.0, K), w)
    return spark.createDataFrame([(round(f, 6),)], "fvu double")


_AB = f"acts AS ({T.VECTORS_SQL}), u AS (SELECT token, list_transform(h, lambda x: x / (sqrt(list_dot_product(h, h)) + 1e-9)) AS w FROM acts), c AS (SELECT a.token AS feature_id, b.token AS nearest, abs(list_dot_product(a.w, b.w)) AS c FROM u a, u b WHERE a.token % 2 = 0 AND b.token % 2 = 1)"


def _ab(spark, sf_dir):
    v = _acts(spark, sf_dir).select(F.col("token").alias("feature_id"), F.col("h").alias("w"))
    return v.where("feature_id % 2 = 0"), v.where("feature_id % 2 = 1")


@query(f"WITH {_AB} SELECT feature_id, round(max(c), 6) AS cosine FROM c GROUP BY 1")
def cosine_nearest(spark, sf_dir):
    return _r(V.cosine_nearest(*_ab(spark, sf_dir)).drop("nearest"), "cosine")


@query(f"WITH acts AS ({T.VECTORS_SQL}) SELECT token, round(sqrt(list_dot_product(h, h)), 6) AS norm FROM acts")
def decoder_unit_norm(spark, sf_dir):
    return _r(V.unit_norm(_acts(spark, sf_dir), "h").select("token", "norm"), "norm")


@query(None)
def geometric_median(spark, sf_dir):
    m = V.geometric_median(_acts(spark, sf_dir))
    return spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(m)], "j int, value double")


@query(f"WITH acts AS ({T.VECTORS_SQL}), dirs AS ({T.directions_sql(8, D)}) SELECT token, round(sqrt(sum(pow(list_dot_product(h, w), 2))), 6) AS magnitude FROM acts, dirs GROUP BY 1")
def projection_magnitude(spark, sf_dir):
    """L11 on eight fixed directions, as SQL has no basis of its own to offer."""
    return _r(V.projection_magnitude(_acts(spark, sf_dir), V.matrix(T.directions(spark, 8, D), "r")[1].T), "magnitude")


@query(None)
def eigen_spectrum(spark, sf_dir):
    v = V.eigen_spectrum(_acts(spark, sf_dir), "h")
    return spark.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(v)], "rank int, value double")
