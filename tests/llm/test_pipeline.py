import os

import pytest

import corpus_pipeline as C
from helixframe.llm import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["toxicity", "exact_dedup", "simhash", "decontamination", "byte_bpe"]
    before = {r.doc_id: r.text for r in docs.collect()}
    # planted: copies in other case, a near copy, a benchmark passage
    clean = next(i for i, t in before.items() if 100 < len(t.split()) < 400)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    words = before[clean].split()
    extra = [(10**6, before[clean].upper() if before[clean].isascii() else before[clean]), (10**6 + 1, " ".join([*words[:50], "novel", *words[51:]])), (10**6 + 2, "Intro. " + item)]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in extra], docs.schema))
    docs.repartition(3).write.mode("overwrite").parquet("/tmp/helixframe-test-docs")
    docs = spark.read.parquet("/tmp/helixframe-test-docs")
    kept = {}
    for name, stage in C.STAGES[1:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        kept[name] = {r.doc_id for r in out.select("doc_id").collect()}
    assert 10**6 in kept["exact_dedup"] and clean not in kept["exact_dedup"]
    assert len({clean, 10**6 + 1} & kept["simhash"]) <= 1
    assert 10**6 + 2 not in kept["decontamination"] and clean in kept["decontamination"]


def test_run(spark):
    out = C.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


def test_registry():
    assert {f"op{n}_" for n in range(1, 11)} == {f"{k.split('_')[0]}_" for k in registry.QUERIES if k.startswith("op")}
    assert set(registry.SQL) <= set(registry.QUERIES) and "pipeline" in registry.QUERIES


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    import glob

    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = c.execute(registry.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(tuple(r[k] for k in cols) for r in df.collect()) == sorted(tuple(r[names.index(k)] for k in cols) for r in cur.fetchall())
