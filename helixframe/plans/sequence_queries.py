"""Driver queries over the corpus view of documents, whole texts of all rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from helixframe.durable import shared_dir
from helixframe.functions import sequences as S
from helixframe.operators import sequence as Q
from helixframe.plans.registry import query
from helixframe.sources import folders
from helixframe.sources import genome as G
from helixframe.sources import tables as T

_C = f"WITH corpus AS ({T.CORPUS_SQL})"
_MOT = "mot AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{c}', {w}::DOUBLE)" for n, (c, w) in S.MOTIFS.items()) + ") t(motif, cons, weight))"


def _matches_sql() -> str:
    """Rows (seq_id, motif, w, start, m): bases that agree at every start."""
    return """mt AS (SELECT seq_id, motif, w, p - 1 AS start, list_sum(list_transform(range(1, w + 1), lambda o: CAST(seq[p + o - 1] = cons[o] AS INT))) AS m
FROM (SELECT seq_id, motif, cons, seq, length(cons) AS w, unnest(range(1, length(seq) - length(cons) + 2)) AS p FROM corpus, mot))"""


@query(f"{_C} SELECT cls, count(*) AS n, round(avg(length(seq)), 6) AS mean_length, round(avg(CASE WHEN length(seq) > 0 THEN (length(seq) - length(translate(seq, 'GC', '')))::DOUBLE / length(seq) END), 6) AS mean_gc FROM corpus GROUP BY 1")
def corpus_class_stats(spark, sf_dir):
    return Q.class_stats(T.corpus(spark, sf_dir)).withColumns({"mean_length": F.round("mean_length", 6), "mean_gc": F.round("mean_gc", 6)})


@query(f"{_C} SELECT seq_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM corpus")
def reverse_complement(spark, sf_dir):
    return T.corpus(spark, sf_dir).select("seq_id", Q.reverse_complement(F.col("seq")).alias("rc"))


@query(f"""{_C}, r AS (SELECT CAST(seq_id AS VARCHAR) AS elem_id, sha1(upper(seq)) AS locus FROM corpus), g AS (SELECT locus, min(elem_id) AS a, max(elem_id) AS b, count(*) AS members FROM r GROUP BY 1),
k AS (SELECT *, len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: a[1:i] = b[1:i])) AS k FROM g)
SELECT elem_id, locus, CASE WHEN members = 1 OR k = 0 THEN a ELSE a[1:k] END AS locus_name, members FROM r JOIN k USING (locus)""")
def locus_groups(spark, sf_dir):
    return Q.locus_groups(T.corpus(spark, sf_dir).select(F.col("seq_id").cast("string").alias("elem_id"), "seq"))


@query(f"""{_C}, {_MOT}, {_matches_sql()}, b AS (SELECT seq_id, motif, any_value(w) AS w, max(m) AS m FROM mt GROUP BY ALL), f AS (SELECT mt.seq_id, mt.motif, min(start) AS start FROM mt JOIN b ON mt.seq_id = b.seq_id AND mt.motif = b.motif AND mt.m = b.m GROUP BY ALL)
SELECT c.seq_id, mot.motif, round(b.m * ({S.HIT!r})::DOUBLE + (b.w - b.m) * ({S.MISS!r})::DOUBLE, 8) AS best, CAST(f.start AS INT) AS start, b.m * ({S.HIT!r})::DOUBLE + (b.w - b.m) * ({S.MISS!r})::DOUBLE > 4 AS has
FROM corpus c CROSS JOIN mot LEFT JOIN b ON b.seq_id = c.seq_id AND b.motif = mot.motif LEFT JOIN f ON f.seq_id = c.seq_id AND f.motif = mot.motif""")
def motif_scan(spark, sf_dir):
    return Q.motif_hits(T.corpus(spark, sf_dir)).withColumn("best", F.round("best", 8))


@query(f"""{_C}, {_MOT}, {_matches_sql()}, h AS (SELECT seq_id, motif, max(m * ({S.HIT!r})::DOUBLE + (w - m) * ({S.MISS!r})::DOUBLE) > 4 AS has FROM mt GROUP BY ALL) SELECT seq_id, count(*) FILTER (has) AS n_motifs FROM corpus LEFT JOIN h USING (seq_id) GROUP BY 1""")
def has_motif(spark, sf_dir):
    return Q.motif_hits(T.corpus(spark, sf_dir)).groupBy("seq_id").agg(F.count_if("has").alias("n_motifs"))


@query(f"""{_C}, ch AS (SELECT seq_id, seq, unnest(range(1, length(seq) + 1)) AS p FROM corpus) SELECT CAST(code AS INT) AS code, count(*) AS n FROM (
SELECT list_sum(list_transform(range(0, 5), lambda o: (CASE WHEN p + o - 2 BETWEEN 1 AND length(seq) THEN strpos('ACGT', seq[p + o - 2]) - 1 ELSE 0 END) * CAST(pow(4, 4 - o) AS INT))) AS code FROM ch) GROUP BY 1""")
def kmer_features(spark, sf_dir):
    return Q.kmer_histogram(T.corpus(spark, sf_dir), 5)


@query(f"{_C} SELECT seq_id, CAST(len(list_distinct(list_transform(range(1, length(seq) - 9), lambda i: seq[i:i + 10]))) AS BIGINT) AS n_kmers FROM corpus")
def kmer_set(spark, sf_dir):
    return Q.kmer_set_size(T.corpus(spark, sf_dir), 11)


_ALU = ", ".join(f"('{k}')" for k in sorted({s[i : i + 11] for s in (S.ALU, S.reverse_complement(S.ALU)) for i in range(len(s) - 10)}))


_MASKED = f"""alu AS (SELECT * FROM (VALUES {_ALU}) t(k)), ch AS (SELECT seq_id, seq, unnest(range(1, length(seq) + 1)) AS p FROM corpus),
hit AS (SELECT seq_id, unnest(range(p, p + 11)) AS p FROM ch SEMI JOIN alu ON alu.k = ch.seq[p:p + 10] WHERE p + 10 <= length(seq)),
isl AS (SELECT seq_id, p, b, p - row_number() OVER (PARTITION BY seq_id, b ORDER BY p) AS g FROM (SELECT seq_id, p, seq[p] AS b FROM ch)),
hom AS (SELECT seq_id, p FROM (SELECT seq_id, p, count(*) OVER (PARTITION BY seq_id, b, g) AS n FROM isl) WHERE n >= 6)"""


@query(f"""{_C}, {_MASKED}
SELECT seq_id, coalesce(n, 0) AS n_masked FROM corpus LEFT JOIN (SELECT seq_id, count(DISTINCT p) AS n FROM (SELECT * FROM hit UNION ALL SELECT * FROM hom) GROUP BY 1) USING (seq_id)""")
def repeat_mask(spark, sf_dir):
    return Q.repeat_masks(T.corpus(spark, sf_dir)).select("seq_id", "n_masked")


@query(f"{_C} SELECT run[1] AS base, CAST(length(run) AS INT) AS length, count(*) AS n FROM (SELECT unnest(regexp_extract_all(seq, 'A{{6,}}|C{{6,}}|G{{6,}}|T{{6,}}')) AS run FROM corpus) GROUP BY ALL")
def homopolymer_runs(spark, sf_dir):
    return Q.homopolymer_runs(T.corpus(spark, sf_dir))


@query(f"""{_C}, ch AS (SELECT seq_id, length(seq) AS n, seq[p] AS b, p, CASE WHEN seq[p] IN ('C', 'G') THEN 1 ELSE 0 END AS gc FROM (SELECT seq_id, seq, unnest(range(1, length(seq) + 1)) AS p FROM corpus)),
w AS (SELECT *, least(25, n) AS w, sum(gc) OVER (PARTITION BY seq_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS cum FROM ch),
v AS (SELECT a.seq_id, a.b, (h.cum - coalesce(l.cum, 0)) / a.w::DOUBLE - 0.5 AS v FROM w a JOIN w h ON h.seq_id = a.seq_id AND h.p = least(a.n, a.p + (a.w - 1) // 2) LEFT JOIN w l ON l.seq_id = a.seq_id AND l.p = a.p - a.w // 2 - 1)
SELECT seq_id, count(*) FILTER (b = 'A') AS n_a, count(*) FILTER (b = 'C') AS n_c, count(*) FILTER (b = 'G') AS n_g, count(*) FILTER (b = 'T') AS n_t, round(avg(v), 8) AS gc_mean, round(max(v), 8) AS gc_max FROM corpus LEFT JOIN v USING (seq_id) GROUP BY 1""")
def composition_features(spark, sf_dir):
    return Q.composition(T.corpus(spark, sf_dir)).withColumns({"gc_mean": F.round("gc_mean", 8), "gc_max": F.round("gc_max", 8)})


_BI = "tab AS (SELECT a, b, ln((1 + (a * 4 + b) * 7 % 5) / sum(1 + (a * 4 + b) * 7 % 5) OVER (PARTITION BY a)) AS lp FROM range(4) x(a), range(4) y(b))"


@query(f"""{_C}, {_BI}, pr AS (SELECT seq_id, strpos('ACGT', seq[p]) - 1 AS a, strpos('ACGT', seq[p + 1]) - 1 AS b FROM (SELECT seq_id, seq, unnest(range(1, length(seq))) AS p FROM corpus))
SELECT c.seq_id, round(CASE WHEN length(c.seq) > 0 THEN ln(0.25) + coalesce(s, 0) ELSE 0 END, 6) AS loglik FROM corpus c LEFT JOIN (SELECT seq_id, sum(lp) AS s FROM pr JOIN tab USING (a, b) GROUP BY 1) USING (seq_id)""")
def bigram_loglik(spark, sf_dir):
    return Q.bigram_loglik(T.corpus(spark, sf_dir)).withColumn("loglik", F.round("loglik", 6))


@query(f"""{_C}, {_MOT}, h AS (SELECT seq_id, motif, strpos(seq, cons) - 1 AS start, seq FROM corpus, mot WHERE strpos(seq, cons) > 0)
SELECT seq_id, motif, CAST(start AS INT) AS start, seq[greatest(start - 15, 0) + 1:least(start + 16, length(seq))] AS "window" FROM h""")
def flank_windows(spark, sf_dir):
    c = T.corpus(spark, sf_dir)
    hits = None
    for name, (consensus, _) in S.MOTIFS.items():
        h = c.select("seq_id", F.lit(name).alias("motif"), (F.instr("seq", consensus) - 1).alias("start")).where("start >= 0")
        hits = h if hits is None else hits.unionByName(h)
    return Q.flank_windows(hits, c)


_D = S.HIT - S.MISS


@query(f"""{_C}, {_MOT}, pl AS (SELECT seq_id, motif, weight, p - 1 AS start, length(cons) AS w FROM (SELECT seq_id, seq, motif, cons, weight, unnest(range(1, length(seq) - length(cons) + 2)) AS p FROM corpus, mot) WHERE seq[p:p + length(cons) - 1] = cons)
SELECT seq_id, coalesce(n, 0) AS n_planted, round(coalesce(e, 0), 6) AS effect, coalesce(q, 0) AS n_positions FROM corpus LEFT JOIN (SELECT seq_id, count(*) AS n, sum(weight * w * 3 * {_D!r}) AS e FROM pl GROUP BY 1) USING (seq_id)
LEFT JOIN (SELECT seq_id, count(DISTINCT p) AS q FROM (SELECT seq_id, unnest(range(start, start + w)) AS p FROM pl) GROUP BY 1) USING (seq_id)""")
def motif_effect(spark, sf_dir):
    return Q.motif_effects(T.corpus(spark, sf_dir)).withColumn("effect", F.round("effect", 6))


_CHOOSE = lambda n, r: f"(lgamma({n} + 1) - lgamma({r} + 1) - lgamma({n} - {r} + 1))"


@query(f"""{_C}, {_MOT}, {_matches_sql()}, h AS (SELECT seq_id, motif, max(m * ({S.HIT!r})::DOUBLE + (w - m) * ({S.MISS!r})::DOUBLE) > 4 AS has FROM mt GROUP BY ALL),
s AS (SELECT mot.motif, count(*) FILTER (cls = 'en') AS k, count(*) FILTER (cls <> 'en') AS n_bg, count(*) FILTER (cls = 'en' AND has) AS hits, count(*) FILTER (cls <> 'en' AND has) AS bg_hits
  FROM corpus CROSS JOIN mot LEFT JOIN h ON h.seq_id = corpus.seq_id AND h.motif = mot.motif GROUP BY 1),
g AS (SELECT *, n_bg + k AS total, greatest(1, bg_hits) + hits AS good FROM s),
t AS (SELECT motif, sum(exp({_CHOOSE('good', 'i')} + {_CHOOSE('(total - good)', '(k - i)')} - {_CHOOSE('total', 'k')})) AS p FROM (SELECT g.*, unnest(range(hits, least(k, good) + 1)) AS i FROM g) WHERE k - i <= total - good GROUP BY 1)
SELECT motif, k, n_bg, hits, bg_hits, round(least(1.0, coalesce(p, 0)), 8) AS p_value FROM s LEFT JOIN t USING (motif)""")
def motif_enrichment(spark, sf_dir):
    c = T.corpus(spark, sf_dir)
    hits = Q.motif_hits(c).fillna(False, ["has"]).join(c.select("seq_id", "cls"), "seq_id")
    return Q.motif_enrichment(hits, F.col("cls") == "en").withColumn("p_value", F.round("p_value", 8))


@query(f"""{_C}, ch AS (SELECT seq_id, seq[p] AS ref, p - 1 AS pos FROM (SELECT seq_id, seq, unnest(range(1, length(seq) + 1)) AS p FROM corpus))
SELECT seq_id, count(*) AS n_variants, count(DISTINCT pos) AS n_pos FROM ch, (VALUES ('A'), ('C'), ('G'), ('T')) t(alt) WHERE alt <> ref GROUP BY 1""")
def ism_variants(spark, sf_dir):
    return Q.variants(T.corpus(spark, sf_dir)).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n_variants"), F.count_distinct("pos").alias("n_pos"))


_HIT, _MISS = f"({S.HIT!r})::DOUBLE", f"({S.MISS!r})::DOUBLE"
# every start that covers a mutated position, the best start before and after those that do
_ISM = f"""{_C}, {_MOT}, {_matches_sql()}, lr AS (SELECT *, max(m) OVER (PARTITION BY seq_id, motif ORDER BY start ROWS UNBOUNDED PRECEDING) AS lm,
  max(m) OVER (PARTITION BY seq_id, motif ORDER BY start DESC ROWS UNBOUNDED PRECEDING) AS rm, max(m) OVER (PARTITION BY seq_id, motif) AS top FROM mt),
co AS (SELECT lr.seq_id, lr.motif, lr.w, lr.top, lr.start + o AS pos, m, c.seq[lr.start + o + 1] AS ref, cons[o + 1] AS want FROM lr JOIN mot USING (motif) JOIN corpus c USING (seq_id), range(9) t(o) WHERE o < lr.w),
va AS (SELECT seq_id, motif, w, top, pos, alt, max(m - CAST(ref = want AS INT) + CAST(alt = want AS INT)) AS bm FROM co, (VALUES ('A'), ('C'), ('G'), ('T')) t(alt) WHERE alt <> ref GROUP BY ALL),
de AS (SELECT va.seq_id, va.motif, va.pos, va.alt, va.w, va.top, greatest(bm, coalesce(l.lm, -1), coalesce(r.rm, -1)) AS b FROM va
  LEFT JOIN lr l ON l.seq_id = va.seq_id AND l.motif = va.motif AND l.start = va.pos - va.w LEFT JOIN lr r ON r.seq_id = va.seq_id AND r.motif = va.motif AND r.start = va.pos + 1),
dl AS (SELECT seq_id, motif, pos, alt, abs(greatest(top * {_HIT} + (w - top) * {_MISS}, 0) - greatest(b * {_HIT} + (w - b) * {_MISS}, 0)) AS delta FROM de)"""


@query(f"""{_ISM}, av AS (SELECT seq_id, motif, pos, avg(delta) AS v FROM dl GROUP BY ALL), s AS (SELECT seq_id, motif, sum(v) AS t, count(*) FILTER (v > 1e-9) AS k FROM av GROUP BY ALL)
SELECT corpus.seq_id, mot.motif, round(coalesce(t, 0), 6) AS total, coalesce(k, 0) AS n_sensitive FROM corpus CROSS JOIN mot LEFT JOIN s ON s.seq_id = corpus.seq_id AND s.motif = mot.motif""")
def ism_sensitivity(spark, sf_dir):
    return Q.ism(T.corpus(spark, sf_dir)).withColumn("total", F.round("total", 6)).drop("peak")


@query(f"{_ISM} SELECT motif, CAST(strpos('ACGT', alt) - 1 AS INT) AS alt, count(*) AS n, round(avg(delta), 6) AS mean_delta FROM dl WHERE delta > 1e-9 GROUP BY ALL")
def ism_per_alt(spark, sf_dir):
    return Q.ism_by_alt(T.corpus(spark, sf_dir)).withColumn("mean_delta", F.round("mean_delta", 6))


@query(f"""{_C}, {_BI}, ch AS (SELECT seq_id, p, length(seq) AS n, strpos('ACGT', seq[p]) - 1 AS x, CASE WHEN p > 1 THEN strpos('ACGT', seq[p - 1]) - 1 END AS l, CASE WHEN p < length(seq) THEN strpos('ACGT', seq[p + 1]) - 1 END AS r FROM (SELECT seq_id, seq, unnest(range(1, length(seq) + 1)) AS p FROM corpus)),
al AS (SELECT ch.*, alt FROM ch, range(4) t(alt)),
d AS (SELECT seq_id, p, sum(abs(coalesce(t1.lp - t0.lp, 0) + coalesce(t3.lp - t2.lp, 0))) / 3.0::DOUBLE AS v FROM al LEFT JOIN tab t0 ON t0.a = l AND t0.b = x LEFT JOIN tab t1 ON t1.a = l AND t1.b = alt LEFT JOIN tab t2 ON t2.a = x AND t2.b = r LEFT JOIN tab t3 ON t3.a = alt AND t3.b = r GROUP BY ALL)
SELECT seq_id, round(coalesce(sum(v), 0), 6) AS total, round(max(v), 6) AS greatest FROM corpus LEFT JOIN d USING (seq_id) GROUP BY 1""")
def loglik_ism(spark, sf_dir):
    return Q.loglik_ism(T.corpus(spark, sf_dir)).withColumns({"total": F.round("total", 6), "greatest": F.round("greatest", 6)})


# by channel and sequence: sensitivities averaged over alternatives against the planted effects' ranks over the kept positions
_ALIGN = f"""pl AS (SELECT seq_id, weight, p - 1 AS start, length(cons) AS w FROM (SELECT seq_id, seq, cons, weight, unnest(range(1, length(seq) - length(cons) + 2)) AS p FROM corpus, mot) WHERE seq[p:p + length(cons) - 1] = cons),
ef AS (SELECT seq_id, pos, sum(weight * {S.HIT - S.MISS!r}) AS e FROM (SELECT seq_id, weight, unnest(range(start, start + w)) AS pos FROM pl) GROUP BY ALL),
rk AS (SELECT seq_id, pos, n, rank() OVER (PARTITION BY seq_id ORDER BY round(e, 9)) + (count(*) OVER (PARTITION BY seq_id, round(e, 9)) - 1) / 2.0::DOUBLE AS r
  FROM (SELECT kp.seq_id, kp.pos, coalesce(e, 0) AS e, count(*) OVER (PARTITION BY kp.seq_id) AS n FROM kp LEFT JOIN ef USING (seq_id, pos))),
sz AS (SELECT seq_id, any_value(n) AS n FROM rk GROUP BY 1),
av AS (SELECT seq_id, motif, pos, avg(delta) AS v FROM dl GROUP BY ALL),
sc AS (SELECT av.seq_id, motif, sum(v) AS s, sum(v * (r - 1) / (n - 1 + 1e-12)) AS t FROM av JOIN rk USING (seq_id, pos) GROUP BY ALL),
ma AS (SELECT seq_id, motif, sum(greatest(m * {_HIT} + (w - m) * {_MISS}, 0)) AS mass, max(m * {_HIT} + (w - m) * {_MISS}) AS top FROM mt GROUP BY ALL),
nu AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {i})" for i, n in enumerate(S.MOTIFS))}) t(motif, feature_id))
SELECT ma.seq_id, CAST(feature_id AS INT) AS feature_id, round(CASE WHEN s > 0 THEN 2 * t / s - 1 ELSE 0 END, 6) AS a_f, round(mass, 6) AS mass
FROM ma JOIN nu USING (motif) JOIN sz USING (seq_id) LEFT JOIN sc ON sc.seq_id = ma.seq_id AND sc.motif = ma.motif WHERE top > 0 AND ma.seq_id IN (SELECT seq_id FROM pl)"""


@query(f"{_ISM}, kp AS (SELECT seq_id, unnest(range(length(seq))) AS pos FROM corpus), {_ALIGN} AND n >= 3")
def compute_alignments(spark, sf_dir):
    """C1 over sequences that have planted motifs: precision-weighted alignment of each motif channel with the planted effects."""
    from helixframe.plans.programs import ism_alignment

    return ism_alignment(T.corpus(spark, sf_dir)).withColumn("a_f", F.round("a_f", 6)).withColumn("mass", F.round("mass", 6))


@query(f"{_ISM}, {_MASKED}, kp AS (SELECT seq_id, pos FROM (SELECT seq_id, unnest(range(length(seq))) AS pos FROM corpus) ANTI JOIN (SELECT seq_id, p - 1 AS pos FROM hit UNION SELECT seq_id, p - 1 FROM hom) USING (seq_id, pos)), {_ALIGN} AND n >= 10")
def repeat_masked_alignment(spark, sf_dir):
    from helixframe.plans.programs import ism_alignment

    return ism_alignment(T.corpus(spark, sf_dir), masked=True).withColumn("a_f", F.round("a_f", 6)).withColumn("mass", F.round("mass", 6))


@query(f"""WITH w AS (SELECT id, CASE WHEN id < 120 THEN 'ccre' WHEN id < 210 THEN 'genic' ELSE 'background' END AS cls FROM range(300) t(id))
SELECT cls, count(*) AS n, CAST(sum(CASE cls WHEN 'ccre' THEN 2 + CAST(floor(CAST({T.lcg('id', '1', '1')} AS DOUBLE) * 3) AS INT) WHEN 'genic' THEN 1 + CAST(floor(CAST({T.lcg('id', '2', '1')} AS DOUBLE) * 2) AS INT) ELSE 0 END) AS BIGINT) AS planted, 256 AS length FROM w GROUP BY 1""")
def synthetic_corpus(spark, sf_dir):
    c = G.synthetic_corpus(spark, 300, 256)
    return c.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("planted")).alias("planted"), F.min(F.length("seq")).alias("length"))




_DRAW = T.lcg("l_orderkey", "l_linenumber")


@query(f"SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY CAST(floor({_DRAW} * 2147483647) AS BIGINT), l_orderkey * 8 + l_linenumber) AS k FROM lineitem) WHERE k <= 2500")
def sample_exact(spark, sf_dir):
    rows = T.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr("l_orderkey * 8 + l_linenumber").alias("row"))
    return G.sample_exact(rows, "row", 2500, draw=F.expr(f"cast(floor({_DRAW} * 2147483647) as bigint)")).drop("row")


_EPOCH = T.lcg("vec_id", "3")


@query(f"""SELECT batch, count(*) AS n, sum(vec_id) AS ids FROM (SELECT vec_id, (row_number() OVER (ORDER BY CAST(floor({_EPOCH} * 2147483647) AS BIGINT), vec_id) - 1) // 64 AS batch FROM embeddings) GROUP BY 1""")
def exact_batches(spark, sf_dir):
    rows = T.read(spark, sf_dir, "embeddings").select("vec_id")
    return G.batches(rows, "vec_id", 64, draw=F.expr(f"cast(floor({_EPOCH} * 2147483647) as bigint)")).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("ids"))


@query(f"""WITH c AS ({T.CORPUS_SQL}), s AS (SELECT seq_id, length(seq) AS n, sum(length(seq)) OVER (ORDER BY seq_id ROWS UNBOUNDED PRECEDING) AS e FROM c WHERE length(seq) > 0)
SELECT o_orderkey AS token, seq_id, CAST(o_orderkey - (e - n) AS BIGINT) AS pos FROM orders LEFT JOIN s ON o_orderkey >= e - n AND o_orderkey < e""")
def token_positions(spark, sf_dir):
    return Q.token_positions(T.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("token")), T.corpus(spark, sf_dir))


_INTERVALS = "SELECT DISTINCT CASE l_returnflag WHEN 'R' THEN 'ccre' ELSE 'genic' END AS cls, l_partkey AS chrom, (l_suppkey * 37 + l_linenumber * 53 + l_orderkey) % 1500 AS start, (l_suppkey * 37 + l_linenumber * 53 + l_orderkey) % 1500 + CAST(l_quantity AS BIGINT) AS \"end\" FROM lineitem WHERE l_returnflag IN ('R', 'A')"
_PICK = f"CAST(floor({T.lcg('chrom', 'start', '7')} * 2147483647) AS BIGINT)"
_BACK = T.lcg("id", "0"), T.lcg("0", "id")


@query(f"""{_C}, iv AS ({_INTERVALS}), pk AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY {_PICK}, cls || ':' || chrom || ':' || start || ':' || "end") AS i FROM iv),
mid AS (SELECT DISTINCT cls, chrom, greatest((start + "end") // 2 - 32, 0) AS ws FROM pk WHERE i <= CASE cls WHEN 'ccre' THEN 200 ELSE 150 END),
ct AS (SELECT seq_id AS chrom, length(seq) AS n, row_number() OVER (ORDER BY seq_id) AS r FROM corpus WHERE length(seq) > 64),
dr AS (SELECT id, CAST(floor({_BACK[0]} * (SELECT count(*) FROM ct)) AS BIGINT) + 1 AS r, CAST({_BACK[1]} AS DOUBLE) AS u FROM range({64 * 120 + 4096}) t(id)),
pl AS (SELECT id, chrom, CAST(floor(u * (n - 64)) AS BIGINT) AS ws FROM dr JOIN ct USING (r)),
fr AS (SELECT chrom, ws, min(id) AS id FROM pl WHERE NOT EXISTS (SELECT 1 FROM iv WHERE iv.chrom = pl.chrom AND iv.start < pl.ws + 64 AND iv."end" > pl.ws) GROUP BY ALL),
al AS (SELECT * FROM mid UNION ALL SELECT 'background', chrom, ws FROM (SELECT *, row_number() OVER (ORDER BY id) AS k FROM fr) WHERE k <= 120)
SELECT al.cls, chrom, ws AS window_start, seq[ws + 1:ws + 64] AS seq FROM al JOIN corpus ON seq_id = chrom WHERE length(seq[ws + 1:ws + 64]) = 64""")
def sampled_windows(spark, sf_dir):
    """S5 with each document's bases as a contig and intervals that lineitem places on them."""
    T.read(spark, sf_dir, "lineitem").createOrReplaceTempView(name := f"lineitem_{uuid.uuid4().hex}")
    # the operator doesn't mind intervals that repeat, and makes few of them distinct
    intervals = spark.sql(_INTERVALS.replace("DISTINCT ", "").replace("FROM lineitem", f"FROM {name}").replace('"end"', "end"))
    contigs = T.corpus(spark, sf_dir).select(F.col("seq_id").alias("chrom"), "seq")
    return G.sampled_windows(intervals, contigs, 64, {"ccre": 200, "genic": 150}, 120, draw=F.expr(_PICK), order=F.col("chrom").cast("bigint"))


@query(f"{_C} SELECT CAST(seq_id AS VARCHAR) AS seq_id, seq, cls, CAST(length(seq) AS INT) AS len FROM corpus WHERE length(seq) > 0")
def fasta_corpus(spark, sf_dir):
    """The documents' sequences as FASTA and metadata, read back and joined."""
    d = T.corpus(spark, sf_dir).where(F.length("seq") > 0)
    return folders.load_corpus(spark, f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}", lambda: d).select("seq_id", "seq", "cls", "len")
