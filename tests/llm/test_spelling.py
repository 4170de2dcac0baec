"""Spelling variants against the definition, word by word."""

import random
import re
import zlib
from collections import Counter

import pytest

from helixframe.llm import spelling


def _one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    short, long = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 2}
    form, near = {}, {}
    for w in n:
        found = [v for v in n if _one_edit(w, v)]
        near[w] = len(found)
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], near[w], n[form[w]] if form[w] else None) for w in n)


def result(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def some(seed):
    """Random words with planted edits, letters of two alphabets, counts that make chains of forms."""
    rng = random.Random(seed)
    letters, rows, base = "aabcdeeezxyÀàÿ×ñ", [], []
    for _ in range(25):
        base.append("".join(rng.choice(letters) for _ in range(rng.randint(6, 11))))
    for w in list(base):
        for _ in range(6):
            i, c = rng.randrange(len(w)), rng.choice(letters)
            base.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]]))
    for i in range(60):
        rows.append((i, " ".join(rng.choices(base, [1 / (1 + k % 13) ** 2 for k in range(len(base))], k=60))))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_the_definition(spark, seed):
    rows = some(seed)
    got = result(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert got == brute(rows)
    assert any(r[1] for r in got)


def test_all_single_edits_meet(spark):
    """Each edit of a word at each place, by letters that share bits and by ones that don't."""
    w = "strengthÀé"
    near = {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in "aezÀàÿ"} | {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in "asezÀàÿ"}
    near.discard(w)
    words = spark.createDataFrame([(w, 2), *((x, 2) for x in near)], "word string, n bigint")
    found = [r["near"] for r in spelling.near_pairs(words).where(f"word = '{w}'").collect()]
    assert sorted(found) == sorted(near)


def test_chain_of_forms(spark):
    rows = [(0, "abcdefgh " * 3000 + "abcdefghi " * 300 + "abcdefghij " * 30 + "abcdefghijk " * 3)]
    got = {r[0]: r for r in result(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id bigint, text string")))}
    assert result(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id bigint, text string"))) == brute(rows)
    assert got["abcdefghijk"][1:3] == ("abcdefghij", "abcdefgh")


def test_ties_take_the_smallest(spark):
    rows = [(0, "marbles " * 2 + "marblez " * 40 + "marblea " * 40)]
    got = {r[0]: r for r in result(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id bigint, text string")))}
    assert got["marbles"][1] == "marblea"


def test_awkward_rows(spark, docs, awkward):
    rows = list(enumerate(awkward)) + [(None, "repeated repeated"), (None, "repeated repeated"), (3, "Étranger étranger ÉTRANGER × " * 3)]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id bigint, text string, word string, n int")
    assert result(spelling.spelling_variants(df)) == brute(rows)
    assert result(spelling.spelling_variants(docs([]))) == []
    assert result(spelling.spelling_variants(docs([None, None]))) == []


def test_counts_pass_on_when_memory_is_full(spark, monkeypatch):
    """The counts of a task may come in several parts."""
    import pyarrow as pa

    monkeypatch.setattr(spelling, "HELD", 0)
    batch = pa.RecordBatch.from_pydict({"doc": ["1", "2"], "text": [b"marbles marbles", b"marbles"]})
    parts = list(spelling._counts(iter([batch])))
    assert sum(n for p in parts for n in p["n"].to_pylist()) == 3 and len(parts) > 1
