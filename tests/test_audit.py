import numpy as np
import pytest

from helixframe.functions import sequences as S
from helixframe.operators import audit, toy


def test_replicates(spark):
    x = np.random.default_rng(0).standard_normal((30, 8))
    same = [r.overlap for r in audit.overlap_replicates(spark, [x, x], 20).collect()]
    assert len(same) == 20 and all(0 <= v <= 1 + 1e-9 for v in same)
    again = audit.overlap_replicates(spark, [x, x], 20).orderBy("rep").collect()
    assert [r.overlap for r in again] == [r.overlap for r in audit.overlap_replicates(spark, [x, x], 20).orderBy("rep").collect()]
    none = audit.overlap_replicates(spark, [np.zeros((0, 8)), x], 2, [np.zeros((0, 8)), x]).collect()
    assert all(r.overlap is None for r in none)


def test_ground_truth(spark):
    w = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.1, 0.1, 1.0])], "feature_id bigint, w array<double>")
    got = {r.feature_id: r.is_causal for r in audit.ground_truth(w, np.eye(3)[:, :2], 1).collect()}
    assert got == {0: True, 1: False, 2: False}


@pytest.mark.parametrize("n", [30, 160])
def test_hidden_change_equals_whole_variants(n):
    x = np.random.default_rng(n).integers(0, 4, n).astype(np.int8)
    model = toy.ToyModel(d_model=8, layers=2)
    base = model.hidden(x, 2)
    want = np.zeros_like(base)
    for p in range(n):
        for b in range(4):
            if b != x[p]:
                y = x.copy()
                y[p] = b
                want[p] += np.abs(model.hidden(y, 2)[p] - base[p]) / 3
    assert np.allclose(audit.hidden_change(x, model, 2), want, atol=1e-9)
    assert len(S.codes("")) == 0 and audit.hidden_change(S.codes(""), model, 1).shape == (0, 8)
