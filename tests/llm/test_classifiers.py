import itertools
import math
import os
import random

import numpy as np
import pytest

from helixframe.llm import quality, toxicity
from helixframe.llm.registry import QUERIES

SF = "/root/testdata/sf0.01"


def brute_segments(scores):
    """Maximal scoring segments by their definition: proper, and in no longer proper one."""
    n = len(scores)
    total = lambda a, b: sum(scores[a:b])

    def proper(a, b):
        t = total(a, b)
        return t > 0 and all(total(i, j) < t for i in range(a, b) for j in range(i + 1, b + 1) if (i, j) != (a, b))

    p = [(a, b) for a in range(n) for b in range(a + 1, n + 1) if proper(a, b)]
    return [s for s in p if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in p)]


def test_maximal_segments():
    rng = random.Random(0)
    for _ in range(150):
        s = [rng.choice([-0.5, -0.5, -0.5, 0.3, 0.7, 1.1, 2.3]) for _ in range(rng.randint(0, 11))]
        got = toxicity.maximal_segments(s)
        assert [(a, b) for a, b, _ in got] == brute_segments(s)
        assert all(v == pytest.approx(sum(s[a:b])) for a, b, v in got)


def test_marginals_equal_summing_over_labellings():
    rng = np.random.default_rng(0)
    model = quality.LineField(w=rng.normal(size=quality.WIDTH), move=rng.normal(size=(2, 2)))
    x = rng.normal(size=(5, quality.WIDTH)).astype(np.float32)
    weight = {}
    for y in itertools.product((0, 1), repeat=5):
        weight[y] = np.exp(sum(v * (x[t] @ model.w) for t, v in enumerate(y)) + sum(model.move[a, b] for a, b in zip(y, y[1:])))
    z = sum(weight.values())
    assert np.allclose(model.marginals(x), [sum(v for y, v in weight.items() if y[t]) / z for t in range(5)])


def brute_likelihood(x, y, w, move):
    """log of the label's likelihood over all kinds of the lines."""
    good = total = 0.0
    for z in itertools.product((0, 1), repeat=len(x)):
        score = np.exp(sum(v * (x[t] @ w) for t, v in enumerate(z)) + sum(move[a, b] for a, b in zip(z, z[1:])))
        total += score
        good += score * (1 - quality.SPOILS) ** (len(z) - sum(z))
    return np.log(good / total if y else 1 - good / total)


def test_hidden_kinds_are_summed_out_and_the_slope_is_right():
    rng = np.random.default_rng(1)
    docs = [(rng.normal(size=(n, 3)).astype(np.float32), int(y)) for n, y in zip(rng.integers(1, 6, 12), rng.integers(0, 2, 12))]
    theta = rng.normal(size=7)
    brute = lambda theta: sum(brute_likelihood(x, y, theta[:3], theta[3:].reshape(2, 2)) for x, y in docs)
    for cells in (10, 10**6):  # padded apart or together
        found = [p.gradient(theta[:3], theta[3:].reshape(2, 2)) for p in quality.chains_of(docs, cells)]
        assert sum(v for v, _ in found) == pytest.approx(brute(theta))
        slope = sum(g for _, g in found)
        for i in range(7):
            step = np.eye(7)[i] * 1e-5
            assert slope[i] == pytest.approx((brute(theta + step) - brute(theta - step)) / 2e-5, abs=1e-5)


def test_field_finds_where_bad_lines_begin():
    """Bad documents begin with good lines; their labels alone tell the field which lines are bad."""
    rng = np.random.default_rng(2)
    docs, kinds = [], []
    for _ in range(150):
        y = int(rng.random() < 0.5)
        n = int(rng.integers(4, 9))
        z = np.ones(n) if y else np.r_[np.ones(n // 2), np.zeros(n - n // 2)]
        docs.append((np.column_stack([np.ones(n), z * 2 - 1 + rng.normal(0, 0.7, n)]).astype(np.float32), y))
        kinds.append(z)
    model = quality.LineField(*quality.fit_chains(docs, spoils=0.5))
    right = [np.mean((np.array(model.marginals(x)) > 0.5) == z) for (x, _), z in zip(docs, kinds)]
    assert np.mean(right) > 0.88 and model.move[0, 0] > model.move[0, 1]


def test_lines_bound(spark):
    sample = spark.createDataFrame([(f"line one {i}\nline two".encode(), i % 2) for i in range(40)], "text binary, y int")
    few = quality.fit(sample, 10)
    assert np.isfinite(few.w).all() and not (few.w == quality.fit(sample).w).all()
    assert (quality.fit(sample, 0).w == 0).all()


def test_a_long_document_leaves_the_fit_alone(spark):
    """Wherever its hash puts it in the order: blank lines don't count, and too many lines leave out that document only."""
    rows = [(f"a good line of words {i}\nand another one {i}" if i % 2 else f"$$ {i} !!\n## {i}", i % 2) for i in range(40)]
    frame = lambda rows: spark.createDataFrame([(t.encode(), y) for t, y in rows], "text binary, y int")
    plain = quality.fit(frame(rows), 300, longest=90)
    assert np.abs(plain.w).max() > 0.1
    for i in range(12):
        with_long = quality.fit(frame([*rows, (f"word {i}\n" * 100 + "x\n" * 300, i % 2)]), 300, longest=90)
        assert np.allclose(with_long.w, plain.w, atol=1e-6)
        with_blank = quality.fit(frame([*rows, (f"good words {i}" + "\n" * 450_000, 1)]), 300, longest=90) if i < 2 else plain
        assert np.abs(with_blank.w).max() > 0.1


def test_toxic_score_equals_brute_force(spark):
    """Shares, log-odds, segments, E-values and the probability, from the counts on."""
    train = [("you vile scum today", 1), ("vile scumbag here", 1), ("a kind word today", 0), ("kind words are here", 0), ("words of today", 0)]
    sample = spark.createDataFrame([(t.encode(), y, 0.1) for t, y in train * 3] + [(t.encode(), y, 0.9) for t, y in train], "text binary, y int, u double")
    model = toxicity.fit(sample)
    assert model.base == pytest.approx(6.5 / 16)

    def odds(word):
        share = 6.5 / 16
        for n in (*toxicity.PREFIXES, None):
            if n is None or len(word) > n:
                has = [y for t, y in train * 3 if any((w == word) if n is None else (len(w) > n and w[:n] == word[:n]) for w in t.split())]
                share = (sum(has) + toxicity.STRENGTH * share) / (len(has) + toxicity.STRENGTH)
        return math.log(share / (1 - share)) - math.log(6.5 / 9.5) - toxicity.DRIFT

    for word in ("vile", "scum", "scumbag", "scumbags", "kind", "today", "unseen"):
        assert model.word(word.encode()) == pytest.approx(odds(word), abs=1e-6)
    assert odds("kind") < odds("unseen") < odds("vile")
    model.rate, model.log_k, model.weights = 1.3, -2.0, np.array([-1.0, 0.5, 0.25, 0.75])
    hot = {"vile": 3.0, "scum": 2.0}
    model.word = lambda w: hot.get(w.decode(), -1.0)
    text = "word vile word scum word word word word scum word"
    scores, segments = model.reader()(text.encode())
    assert segments == [(1, 4, 4.0), (8, 9, 2.0)]
    space = -2.0 + math.log(10)
    first = 1.3 * 4 - space
    sums = max(first, first + 1.3 * 2 - space + math.log(2))
    z = -1 + 0.5 * first + 0.25 * sums / 2 + 0.75 * sum(1.3 * s - space > math.log(20) for s in (4, 2))
    assert model.probability(10, segments) == pytest.approx(1 / (1 + math.exp(-z)))


@pytest.mark.parametrize("op", ["op2_toxicity", "op8_quality"])
@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out(spark, op):
    label = {"op2_toxicity": "toxic", "op8_quality": "quality"}[op]
    got = {r.doc_id: r for r in QUERIES[op](spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [(got[r.doc_id].predicted, r[label]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert np.mean([p == y for p, y in held]) > 0.9


def test_awkward_texts(spark, docs, awkward):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(None, 1, 1), (3, None, 1)], "doc_id bigint, quality int, toxic int")
    d = docs([("vile scum " if i % 2 else "kind word ") * 5 for i in range(40)] + awkward)
    t = toxicity.score_texts(d, toxicity.fit_from_labels(d, labels)).collect()
    q = quality.score_texts(d, quality.fit_from_labels(d, labels)).collect()
    assert all(0 <= r.toxicity.score <= 1 for r in t) and all(0 <= r.quality.score <= 1 for r in q) and len(t) == len(q) == 40 + len(awkward)
    kept = toxicity.drop_toxic(d, toxicity.fit_from_labels(d, labels))
    assert kept.columns == d.columns
    none = labels.limit(0)
    assert toxicity.score_texts(d, toxicity.fit_from_labels(d, none)).count() == quality.score_texts(d, quality.fit_from_labels(d, none)).count() == 50
    assert toxicity.score_texts(d.limit(0), toxicity.ToxicModel()).count() == 0


def test_toxic_passages_are_found(docs):
    model = toxicity.ToxicModel(base=0.1, rate=1.5, log_k=-4.0, weights=np.array([-3.0, 1.0, 0.0, 1.0]))
    for word in (b"scum", b"vile"):
        cell = toxicity.chain(word)[-1]
        model.toxic[cell] = model.docs[cell] = 2000
    text = "word " * 50 + "vile scum " + "word " * 50
    d = docs([text, "word " * 100, text, None], [0, 1, 0, None]).withColumnRenamed("normal", "toxicity")
    out = toxicity.score_texts(d, model)
    assert out.columns == [*d.columns, "_toxicity"]
    r = {x.doc_id: x for x in out.collect()}
    assert [(s.start, s.end) for s in r[0]._toxicity.segments] == [(50, 52)] and r[0]._toxicity.predicted == 1
    assert r[1]._toxicity.segments == [] and r[1]._toxicity.predicted == r[None]._toxicity.predicted == 0
    assert sorted(x.doc_id for x in toxicity.drop_toxic(d, model).where("doc_id is not null").collect()) == [1]
