"""Sequence operators over corpus(seq_id, cls, seq).

Each sequence is scanned whole, in the stage that reads it: nothing is exploded to positions before it is reduced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import prefix
from helixframe.functions import sequences as S
from helixframe.functions.arrow import row_struct


def class_stats(corpus: DataFrame) -> DataFrame:
    """A4: windows, mean length and mean GC share of each class."""
    gc = F.when(F.length("seq") > 0, (F.length("seq") - F.length(F.translate("seq", "GC", ""))) / F.length("seq"))
    return corpus.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("seq")).alias("mean_length"), F.avg(gc).alias("mean_gc"))


def reverse_complement(seq: Column) -> Column:
    """F2 by built-ins; unknown letters become N."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGT]", "N"), "ACGT", "TGCA"))


def locus_groups(elements: DataFrame) -> DataFrame:
    """C7 with F5 and F6: elements(elem_id string, seq) -> elem_id, locus (hash), locus_name, members.

    The key is the hash of the sequence; the name, the members' longest common prefix without trailing -._ and blanks, is
    an attribute, so two loci may share one.  The prefix of the least and the greatest id is that of all.
    """
    rows = elements.select("elem_id", F.sha1(F.upper("seq")).alias("locus"))
    g = rows.groupBy("locus").agg(F.min("elem_id").alias("a"), F.max("elem_id").alias("b"), F.count(F.lit(1)).alias("members"))
    n = F.expr("aggregate(sequence(1, greatest(1, least(length(a), length(b)))), 0, (k, i) -> if(k = i - 1 and left(a, i) = left(b, i), i, k))")
    name = F.rtrim(F.regexp_replace(F.expr("left(a, k)"), "[-._ ]+$", ""))
    g = g.withColumn("k", n).withColumn("locus_name", F.when((F.col("members") == 1) | (name == ""), F.col("a")).otherwise(name))
    return rows.join(g.select("locus", "locus_name", "members"), "locus")


def motif_hits(corpus: DataFrame) -> DataFrame:
    """(seq_id, motif, best, start, has): best log-odds, its first start, and whether it exceeds 4; null if none fits."""

    def one(seq):
        x, out = S.codes(seq), []
        for name, (consensus, _) in S.MOTIFS.items():
            v = S.motif_scan(x, consensus)
            out.append({"motif": name, "best": float(v.max()) if len(v) else None, "start": int(v.argmax()) if len(v) else None})
        return (out,)

    hits = corpus.select("seq_id", row_struct(one, "hits array<struct<motif:string,best:double,start:int>>")(F.col("seq")).alias("s"))
    return hits.select("seq_id", F.explode("s.hits").alias("h")).select("seq_id", "h.motif", "h.best", "h.start", (F.col("h.best") > 4).alias("has"))


#: Bases whose k-mers are counted at once, about.
BASES = 1_000_000


def kmer_histogram(corpus: DataFrame, k: int = 5) -> DataFrame:
    """How often each centred base-4 k-mer code stands in the corpus; tasks count runs of sequences, code by code.

    What a task holds are the codes of one run, of `BASES` bases and one sequence more at most.
    """

    def counted(codes):
        v, n = np.unique(np.concatenate(codes), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int32()), pa.array(n, pa.int64())], names=["code", "n"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            for seq in b.column(0):
                if (s := seq.as_py()) is not None:
                    held.append(S.kmer_codes(S.codes(s), k))
                    size += len(s)
                    if size >= BASES:
                        yield counted(held)
                        held, size = [], 0
        if size:
            yield counted(held)

    return corpus.select("seq").mapInArrow(run, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def kmer_set_size(corpus: DataFrame, k: int = 11) -> DataFrame:
    """distinct k-mers of each sequence."""
    one = lambda seq: (len({seq[i : i + k] for i in range(len(seq) - k + 1)}),)
    return corpus.select("seq_id", row_struct(one, "n bigint")(F.col("seq"))["n"].alias("n_kmers"))


def repeat_masks(corpus: DataFrame) -> DataFrame:
    """(seq_id, n_masked, spans) of the repeat mask."""

    def one(seq):
        m = np.concatenate([[0], S.repeat_mask(seq).astype(np.int8), [0]])
        d = np.diff(m)
        spans = list(zip(np.flatnonzero(d == 1).tolist(), np.flatnonzero(d == -1).tolist(), strict=True))
        return sum(b - a for a, b in spans), [{"start": a, "end": b} for a, b in spans]

    return corpus.select("seq_id", row_struct(one, "n_masked bigint, spans array<struct<start:int,end:int>>")(F.col("seq")).alias("m")).select("seq_id", "m.*")


def homopolymer_runs(corpus: DataFrame) -> DataFrame:
    """W11 by built-ins: runs of six or more of one base, by base and length."""
    r = corpus.select(F.explode(F.regexp_extract_all("seq", F.lit(r"((.)\2{5,})"), F.lit(1))).alias("run"))
    return r.groupBy(F.left("run", F.lit(1)).alias("base"), F.length("run").alias("length")).agg(F.count(F.lit(1)).alias("n"))


def composition(corpus: DataFrame, width: int = 25) -> DataFrame:
    """F12 with W5: base counts and the spread of the centred GC average of each sequence."""

    def one(seq):
        x = S.codes(seq)
        v = S.moving_average(((x == 1) | (x == 2)).astype(float), width) - 0.5
        return tuple(int((x == b).sum()) for b in range(4)) + ((float(v.mean()), float(v.max())) if len(v) else (None, None))

    u = row_struct(one, "n_a bigint, n_c bigint, n_g bigint, n_t bigint, gc_mean double, gc_max double")
    return corpus.select("seq_id", u(F.col("seq")).alias("c")).select("seq_id", "c.*")


def bigram_loglik(corpus: DataFrame) -> DataFrame:
    """Log-likelihood of each sequence under the bigram table; the first base counts as one in four."""

    def one(seq):
        x = S.codes(seq).astype(int)
        return (float(np.log(0.25) + S.bigram_table()[x[:-1], x[1:]].sum()) if len(x) else 0.0,)

    return corpus.select("seq_id", row_struct(one, "loglik double")(F.col("seq"))["loglik"].alias("loglik"))


def flank_windows(hits: DataFrame, corpus: DataFrame, flank: int = 15) -> DataFrame:
    """The sequence within `flank` of each hit (seq_id, start), cut at the ends; unknown sequences drop out."""
    a = F.greatest(F.col("start") - flank, F.lit(0))
    b = F.least(F.col("start") + flank + 1, F.length("seq"))
    return hits.join(corpus.select("seq_id", "seq"), "seq_id").withColumn("window", F.substring("seq", a + 1, b - a)).drop("seq")


def token_positions(tokens: DataFrame, corpus: DataFrame, token: str = "token") -> DataFrame:
    """Tokens with seq_id and pos, where tokens number the bases of all sequences in order of seq_id, from 0 on.

    seq_id is unique and not null.  Each sequence's first token is a running sum of lengths; a token belongs to the last one at or before it.
    Tokens beyond the end, below 0 or null get nulls; empty and null sequences have no tokens.
    """
    own = corpus.select("seq_id", F.length("seq").cast("bigint").alias("_length")).where("_length > 0")
    own = prefix.running(prefix.blocked(own, "seq_id"), [], "seq_id", "_length", "_end").withColumn("_start", F.col("_end") - F.col("_length"))
    found = prefix.last_at_or_before(tokens, own, token, "_start", "_first")
    out = prefix.attach(found, own, [], F.col("_first"), "_start", "seq_id", "_end")
    inside = F.col(token) < F.col("_end")
    return out.select(*tokens.columns, F.when(inside, F.col("seq_id")).alias("seq_id"), F.when(inside, F.col(token) - F.col("_first")).alias("pos"))


def motif_effects(corpus: DataFrame) -> DataFrame:
    """F9 over motifs planted where their whole consensus stands: summed effect and the positions that have one."""

    def one(seq):
        x = S.codes(seq)
        planted = [(int(i), name) for name, (c, _) in S.MOTIFS.items() for i in np.flatnonzero(S.matches(x, c) == len(c))]
        e = S.motif_effect(x, planted)
        return len(planted), float(e.sum()), int((e.sum(axis=1) > 0).sum())

    return corpus.select("seq_id", row_struct(one, "n_planted bigint, effect double, n_positions bigint")(F.col("seq")).alias("e")).select("seq_id", "e.*")


def motif_enrichment(hits: DataFrame, foreground: Column) -> DataFrame:
    """Hypergeometric upper tail of foreground windows with each motif, against the background's rate.

    Population n_bg + K with max(1, round(p_bg n_bg)) + hits successes and K draws; the tail is summed from log-factorials
    on motif counts, a row a motif.
    """
    s = hits.groupBy("motif").agg(
        F.count_if(foreground).alias("k"), F.count_if(~foreground).alias("n_bg"), F.count_if(foreground & F.col("has")).alias("hits"), F.count_if(~foreground & F.col("has")).alias("bg_hits")
    )

    def one(k, n_bg, h, bg):
        from math import exp, lgamma

        p = bg / n_bg if n_bg else 0.0
        total, good = n_bg + k, max(1, round(p * n_bg)) + h
        choose = lambda n, r: lgamma(n + 1) - lgamma(r + 1) - lgamma(n - r + 1)
        tail = sum(exp(choose(good, i) + choose(total - good, k - i) - choose(total, k)) for i in range(h, min(k, good) + 1) if k - i <= total - good)
        return (min(1.0, tail),)

    u = row_struct(one, "p double")
    return s.withColumn("p_value", u("k", "n_bg", "hits", "bg_hits")["p"]).orderBy("p_value", "motif")


def ism(corpus: DataFrame) -> DataFrame:
    """I1-I4 over whole sequences: (seq_id, motif, total, n_sensitive, peak) of mean sensitivities by position."""

    def one(seq):
        x, out = S.codes(seq), []
        for name, (consensus, _) in S.MOTIFS.items():
            v = S.sensitivity(x, consensus).mean(axis=1)
            out.append({"motif": name, "total": float(v.sum()), "n_sensitive": int((v > 1e-9).sum()), "peak": int(v.argmax()) if len(v) else None})
        return (out,)

    r = corpus.select("seq_id", row_struct(one, "m array<struct<motif:string,total:double,n_sensitive:bigint,peak:int>>")(F.col("seq")).alias("s"))
    return r.select("seq_id", F.explode("s.m").alias("m")).select("seq_id", "m.*")


def ism_by_alt(corpus: DataFrame) -> DataFrame:
    """I4 by (motif, alt): n and mean_delta of the nonzero sensitivities of all sequences; alt is the base's number.

    A sequence's are counted and added up where it is scanned, so no row for a position leaves a task.
    """

    def one(seq):
        x, out = S.codes(seq), []
        for name, (consensus, _) in S.MOTIFS.items():
            v = S.sensitivity(x, consensus)
            p, a = np.nonzero(v > 1e-9)
            alt, delta = S.OTHERS[x[p], a], v[p, a]
            n, total = np.bincount(alt, minlength=4), np.bincount(alt, delta, 4)
            out += [{"motif": name, "alt": int(b), "n": int(n[b]), "total": float(total[b])} for b in np.flatnonzero(n)]
        return (out,)

    r = corpus.select(row_struct(one, "m array<struct<motif:string,alt:int,n:bigint,total:double>>")(F.col("seq")).alias("s"))
    r = r.select(F.explode("s.m").alias("m")).groupBy("m.motif", "m.alt").agg(F.sum("m.n").alias("n"), F.sum("m.total").alias("total"))
    return r.select("motif", "alt", "n", (F.col("total") / F.col("n")).alias("mean_delta"))


def ism_profiles(corpus: DataFrame) -> DataFrame:
    """I4 long: (seq_id, motif, pos, alt, delta) of the nonzero sensitivities; alt is the base's number."""

    def one(seq):
        x, out = S.codes(seq), []
        for name, (consensus, _) in S.MOTIFS.items():
            v = S.sensitivity(x, consensus)
            out += [{"motif": name, "pos": int(p), "alt": int(S.OTHERS[x[p], a]), "delta": float(v[p, a])} for p, a in zip(*np.nonzero(v > 1e-9), strict=True)]
        return (out,)

    r = corpus.select("seq_id", row_struct(one, "m array<struct<motif:string,pos:int,alt:int,delta:double>>")(F.col("seq")).alias("s"))
    return r.select("seq_id", F.explode("s.m").alias("m")).select("seq_id", "m.*")


def variants(corpus: DataFrame, every: bool = True) -> DataFrame:
    """(seq_id, pos, alt) of single substitutions: three other bases at each position, or the first one only.

    Positions whose base is none of A, C, G, T have no variant.  The mutated sequence is overlay(seq, alt, pos + 1).
    """
    p = corpus.select("seq_id", F.posexplode(F.split("seq", "")).alias("pos", "ref")).where(F.col("ref").isin(*"ACGT"))
    alts = F.filter(F.array(*map(F.lit, "ACGT")), lambda b: b != F.col("ref"))
    return p.select("seq_id", "pos", "ref", F.explode(alts if every else F.slice(alts, 1, 1)).alias("alt"))


def loglik_ism(corpus: DataFrame) -> DataFrame:
    """Summed and greatest log-likelihood sensitivity of each sequence."""

    def one(seq):
        v = S.loglik_sensitivity(S.codes(seq))
        return float(v.sum()), float(v.max()) if len(v) else None

    return corpus.select("seq_id", row_struct(one, "total double, greatest double")(F.col("seq")).alias("v")).select("seq_id", "v.*")
