import numpy as np
import pytest

from helixframe.functions import sequences as S
from helixframe.operators import sequence as Q


def naive_sensitivity(seq, consensus):
    base = max(np.maximum(S.motif_scan(S.codes(seq), consensus), 0), default=0)
    out = []
    for p, r in enumerate(seq):
        for b in "ACGT":
            if b != r:
                m = S.motif_scan(S.codes(seq[:p] + b + seq[p + 1 :]), consensus)
                out.append(abs(base - max(np.maximum(m, 0), default=0)))
    return np.array(out).reshape(len(seq), 3)


@pytest.mark.parametrize("n", [0, 3, 6, 7, 30, 80])
def test_sensitivity_equals_encoding_each_variant(n):
    rng = np.random.default_rng(n)
    seq = "".join(rng.choice(list("ACGT"), n))
    seq = seq[: n // 2] + "GATAAG"[: max(0, n - n // 2)] + seq[n // 2 + 6 :]
    for consensus, _ in S.MOTIFS.values():
        assert np.allclose(S.sensitivity(S.codes(seq), consensus), naive_sensitivity(seq, consensus).reshape(len(seq), 3))


def test_loglik_sensitivity_equals_scoring_each_variant():
    seq = "ACGTTGCAAC"
    t = S.bigram_table()
    ll = lambda s: sum(t[a, b] for a, b in zip(S.codes(s)[:-1], S.codes(s)[1:]))
    want = [np.mean([abs(ll(seq[:p] + b + seq[p + 1 :]) - ll(seq)) for b in "ACGT" if b != seq[p]]) for p in range(len(seq))]
    assert np.allclose(S.loglik_sensitivity(S.codes(seq)), want)


def test_motif_scan_finds_planted():
    v = S.motif_scan(S.codes("AAAATATAAAAAAA"), "TATAAA")
    assert v.argmax() == 4 and v.max() > 4
    assert len(S.motif_scan(S.codes("ACG"), "TATAAA")) == 0


def test_repeat_mask():
    assert S.repeat_mask("ACGTAAAAAGT").sum() == 0  # a run of five
    assert S.repeat_mask("ACGTAAAAAAGT").tolist() == [False] * 4 + [True] * 6 + [False] * 2
    assert S.repeat_mask("TTG" + S.ALU[20:31] + "GGA").sum() == 11
    assert S.repeat_mask("TTC" + S.reverse_complement(S.ALU[20:31]) + "CGA").sum() == 11


def test_codes_and_kmers():
    assert S.codes("acgtN").tolist() == [0, 1, 2, 3, 0]
    assert len(S.kmer_codes(S.codes("ACGTACGTACGT"), 3)) == 12
    assert S.reverse_complement("ACGTX") == "NACGT"


def test_motif_effect_adds_where_motifs_overlap():
    e = S.motif_effect(S.codes("TATAAATA"), [(0, "TATA"), (0, "TATA")])
    once = S.motif_effect(S.codes("TATAAATA"), [(0, "TATA")])
    assert np.allclose(e, 2 * once) and once[6:].sum() == 0 and np.allclose(once[np.arange(6), S.codes("TATAAA")], 0)


def test_locus_groups(spark):
    d = spark.createDataFrame([("TERT-GBM", "ACGT"), ("TERT-HEK", "acgt"), ("TERT-GSc", "ACGT"), ("BCL11A", "TTTT"), ("X-1", "GG"), ("Y-1", "GG")], "elem_id string, seq string")
    got = {r.elem_id: (r.locus, r.locus_name) for r in Q.locus_groups(d).collect()}
    assert got["TERT-GBM"] == got["TERT-HEK"] == got["TERT-GSc"] and got["TERT-GBM"][1] == "TERT"
    assert got["BCL11A"][1] == "BCL11A" and got["X-1"] == got["Y-1"] and got["X-1"][1] == "X-1"


def test_variants(spark):
    d = spark.createDataFrame([("a", "ACN")], "seq_id string, seq string")
    assert Q.variants(d).count() == 6 and [(r.pos, r.alt) for r in Q.variants(d, False).orderBy("pos").collect()] == [(0, "C"), (1, "A")]


def test_enrichment(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([("M", True, i < 8) for i in range(10)] + [("M", False, i < 1) for i in range(50)], "motif string, fg boolean, has boolean")
    assert Q.motif_enrichment(d, F.col("fg")).first().p_value < 1e-4


def test_kmers_are_counted_by_runs_of_sequences(spark, monkeypatch):
    import random

    rng = random.Random(2)
    seqs = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(60))) for _ in range(30)]
    corpus = spark.createDataFrame([(i, "en", s) for i, s in enumerate([*seqs, None, ""])], "seq_id int, cls string, seq string").coalesce(1)
    monkeypatch.setattr(Q, "BASES", 100)
    want: dict[int, int] = {}
    for s in seqs:
        for c in S.kmer_codes(S.codes(s), 5).tolist():
            want[c] = want.get(c, 0) + 1
    assert dict(Q.kmer_histogram(corpus, 5).collect()) == want


def test_sensitivities_by_alternative_are_those_of_the_positions(spark):
    import random

    rng = random.Random(3)
    seqs = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (0, 3, 6, 9, 10, 80)] + ["ACTATAAACCACGTGA", None]
    corpus = spark.createDataFrame(list(enumerate(seqs)), "seq_id int, seq string")
    want: dict[tuple, list[float]] = {}
    for r in Q.ism_profiles(corpus).collect():
        want.setdefault((r.motif, r.alt), []).append(r.delta)
    got = {(r.motif, r.alt): (r.n, r.mean_delta) for r in Q.ism_by_alt(corpus).collect()}
    assert got == {k: (len(v), pytest.approx(sum(v) / len(v))) for k, v in want.items()}
