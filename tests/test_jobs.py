"""The jobs: runs over growing copies, repeated runs, runs that broke off, and the queries against their SQL."""

import datetime
import glob
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import jobs
from jobs import alignment_report, corpus_windows
from jobs.common import settings

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string"


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


def rows(df):
    return sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(jobs.QUERIES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = jobs.QUERIES[name](spark, SF)
    cur = con.execute(jobs.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall()), key=repr)
    assert want and rows(got) == want


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"window": 5}))
    assert settings(corpus_windows.__file__, str(tmp_path / "c.json"))["window"] == 5
    (tmp_path / "c.json").write_text(json.dumps({"widow": 5}))
    with pytest.raises(ValueError, match="widow"):
        settings(corpus_windows.__file__, str(tmp_path / "c.json"))


CONFIG = {"window": 4, "stride": 2, "longest_run": 3, "least_gc": 0.2, "most_gc": 0.8, "files_a_batch": 0}


def cut(texts):
    """Canonical windows of the texts, by the definition."""
    out = set()
    for text in texts:
        seq = "".join(c for c in (text or "").replace("a", "A").replace("c", "C").replace("g", "G").replace("t", "T") if c in "ACGT")
        for i in range(0, len(seq) - 3, 2):
            w = seq[i : i + 4]
            if 0.2 <= sum(c in "GC" for c in w) / 4 <= 0.8 and len(set(w)) > 1:
                out.add(min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA"))))
    return out


def put(spark, folder, texts, first):
    spark.createDataFrame([(first + i, t, "x" if i % 2 else None, "s") for i, t in enumerate(texts)], DOCS).coalesce(1).write.mode("append").parquet(folder)


def test_windows_of_a_growing_folder(spark, tmp_path):
    docs, out, mark = (str(tmp_path / x) for x in ("docs", "out", "mark"))
    one, two = ["ACGTTGCAAC", None, "", "acgt", "zzz", "GGGGCCCC"], ["ACGTTGCA", "TTACGGATCA" * 30, "TGAACCTTGG"]
    put(spark, docs, one, 0)
    assert corpus_windows.run(spark, docs, out, mark, CONFIG) == len(one)
    first = rows(corpus_windows.read(spark, out))
    canonical = lambda: {min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA"))) for w in (r["seq"] for r in corpus_windows.read(spark, out).collect())}
    assert canonical() == cut(one)
    assert corpus_windows.run(spark, docs, out, mark, CONFIG) == 0
    assert rows(corpus_windows.read(spark, out)) == first
    put(spark, docs, two, 100)
    assert corpus_windows.run(spark, docs, out, mark, CONFIG) == len(two)
    done = corpus_windows.read(spark, out)
    assert canonical() == cut(one + two) and done.count() == len(cut(one + two))
    assert set(first) <= set(rows(done))


def test_a_batch_that_is_run_again_replaces_itself(spark, tmp_path):
    """A run that broke off after its write, before its checkpoint: the commit of the batch is missing."""
    docs, out, mark = (str(tmp_path / x) for x in ("docs", "out", "mark"))
    put(spark, docs, ["ACGTTGCAAC", "TTACGGATCA"], 0)
    corpus_windows.run(spark, docs, out, mark, CONFIG)
    put(spark, docs, ["ACGTAGCAACGG"], 100)
    corpus_windows.run(spark, docs, out, mark, CONFIG)
    before = rows(corpus_windows.read(spark, out))
    for f in glob.glob(f"{mark}/commits/*1*") + glob.glob(f"{mark}/commits/.1*"):
        os.remove(f)
    corpus_windows.run(spark, docs, out, mark, CONFIG)
    assert rows(corpus_windows.read(spark, out)) == before


def test_files_a_batch_and_an_empty_table(spark, tmp_path):
    docs, out, mark = (str(tmp_path / x) for x in ("docs", "out", "mark"))
    spark.createDataFrame([], DOCS).write.parquet(docs)
    assert corpus_windows.run(spark, docs, out, mark, CONFIG) == 0
    texts = ["ACGTTGCAAC", "TTACGGATCA", "ACGTTGCAAC", "TGCAACGT"]
    for i, t in enumerate(texts):
        put(spark, docs, [t], i)
    assert corpus_windows.run(spark, docs, out, mark, CONFIG | {"files_a_batch": 1}) == 4
    got = corpus_windows.read(spark, out)
    assert got.count() == len(cut(texts)) and got.select("batch").distinct().count() > 1


def measurements(spark, n, seed=0):
    dates = [datetime.datetime(1994, 1 + i % 5, 1 + i % 27) for i in range(n)]
    made = [("RNA"[i % 3], i * 7 % 5, i * 11 % 97, float((i * 13 + seed) % 11) / 100, float(i % 50), None if i % 41 == 0 else d) for i, d in enumerate(dates)]
    return spark.createDataFrame(made, "l_returnflag string, l_suppkey bigint, l_partkey bigint, l_discount double, l_quantity double, l_shipdate timestamp_ntz")


def test_report_by_months(spark, tmp_path):
    """Months brought up to date one after another give what one run over all gives; a repeated run changes nothing."""
    config, table = settings(alignment_report.__file__), str(tmp_path / "m")
    measurements(spark, 900).write.parquet(table)
    whole = rows(alignment_report.run(spark, table, str(tmp_path / "a"), config))
    assert len(whole) == 10
    for months in (["1994-01", "1994-02"], ["1994-03", "1994-04"], ["1994-05", alignment_report.UNDATED], ["1994-02"]):
        last = alignment_report.run(spark, table, str(tmp_path / "b"), config, months)
    assert rows(last) == whole
    assert rows(alignment_report.run(spark, table, str(tmp_path / "b"), config)) == whole
    # late rows of one month
    late = measurements(spark, 60, seed=3).where(F.month("l_shipdate") == 3)
    late.write.mode("append").parquet(table)
    want = rows(alignment_report.run(spark, table, str(tmp_path / "c"), config))
    assert want != whole
    assert rows(alignment_report.run(spark, table, str(tmp_path / "b"), config, ["1994-03"])) == want
