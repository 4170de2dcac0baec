import gzip

import pytest

from helixframe.sources import folders
from helixframe.sources import genome as G
from helixframe.streaming import incremental as I


def test_synthetic_corpus(spark):
    c = G.synthetic_corpus(spark, 300, 256).cache()
    got = {r.cls: r["count"] for r in c.groupBy("cls").count().collect()}
    assert got == {"ccre": 120, "genic": 90, "background": 90}
    for r in c.collect():
        assert len(r.seq) == 256 and set(r.seq) <= set("ACGT")
        n = len(r.planted)
        assert n == 0 if r.cls == "background" else 1 <= n <= 2 if r.cls == "genic" else 2 <= n <= 4
        for p in r.planted:
            assert r.seq[p.start : p.end] == dict(TATA="TATAAA", GATA="GATAAG", EBOX="CACGTG", ETS="GGAAGT", SP1="GGGGCGGGG")[p.motif]
    again = G.synthetic_corpus(spark, 300, 256).repartition(7)
    assert sorted(r.seq for r in again.collect()) == sorted(r.seq for r in c.collect())


def test_fasta_round_trip(spark, tmp_path):
    c = G.synthetic_corpus(spark, 20, 60)
    G.write_fasta(c, str(tmp_path / "fa"))
    back = {r.seq_id: r.seq for r in G.read_fasta(spark, str(tmp_path / "fa")).collect()}
    assert back == {r.seq_id: r.seq for r in c.collect()}
    (tmp_path / "m.fa").write_text(">a x\nACG\nTTT\n>b y\nGG\n")
    assert {r.seq_id: r.seq for r in G.read_fasta(spark, str(tmp_path / "m.fa")).collect()} == {"a": "ACGTTT", "b": "GG"}


def test_bed_windows(spark, tmp_path):
    (tmp_path / "x.bed").write_text("#h\nc1\t10\t14\tz\nc1\t0\t2\nc1\t95\t99\n")
    contigs = spark.createDataFrame([("c1", "ACGT" * 25)], "chrom string, seq string")
    got = sorted((r.window_start, r.seq) for r in G.bed_windows(G.read_bed(spark, str(tmp_path / "x.bed")), contigs, 8).collect())
    assert got == [(0, "ACGTACGT"), (8, "ACGTACGT")]


def test_assay(spark, tmp_path):
    rows = [(p, r, a, v) for p, r, a, v in [(10, "A", "C", 0.1), (10, "A", "G", -0.2), (10, "A", "T", 0.0), (11, "C", "A", 0.3), (11, "C", "-", 9.0), (13, "G", "A", -2.0), (13, "G", "C", 1.0), (13, "G", "C", 3.0)]]
    (tmp_path / "toy.tsv").write_text("Position\tREF\tAlt\tlog2FC\n" + "\n".join("\t".join(map(str, r)) for r in rows))
    a = folders.read_assay(spark, str(tmp_path / "toy.tsv"))
    assert a.count() == 7 and {r.element for r in a.collect()} == {"toy"}
    e = {r.pos: r for r in G.assay_elements(a, least=3).collect()}
    assert sorted(e) == [10, 11, 12, 13]
    assert e[10].e_mean == pytest.approx(0.15) and e[10].e_signed == pytest.approx(-0.05)  # the zero leaves the divisor
    assert e[12].ref == "A" and e[12].e_mean == 0
    assert e[13].e_max == 3 and e[13].e_signed == pytest.approx(0.5)  # the last row of (13, C) wins
    assert G.assay_elements(a, least=10).count() == 0
    with pytest.raises(ValueError):
        G.resolve_columns(["position", "alt"])


def test_memo_key_has_all_settings(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for s in ({"metric": "a"}, {"metric": "a"}, {"metric": "b"}):
        assert G.memoised(spark, str(tmp_path), "t", s, make).count() == 3
    assert len(made) == 2


def test_sampling_and_markdown(spark):
    d = spark.range(100)
    assert G.sample_exact(d, "id", 10).count() == 10 and G.sample_exact(d, "id", 1000).count() == 100
    assert G.batches(d, "id", 10).select("batch").distinct().count() <= 10
    assert G.markdown(spark.range(1)) == "| id |\n| --- |\n| 0 |"


def test_running_density_equals_one_batch(spark, tmp_path):
    codes = spark.createDataFrame([(t, t % 3, float(t)) for t in range(30)], "token bigint, feature_id bigint, z double")
    codes.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(codes.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = I.run_density(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, I.state(spark, str(tmp_path / "out")).select("feature_id", "n_active", "max_z").collect()))
    assert got == sorted(map(tuple, I.partial_density(codes).collect()))


def test_corpus_is_built_once_and_keeps_metadata(spark, tmp_path):
    c = G.synthetic_corpus(spark, 30, 64)
    built = []
    for _ in range(2):
        got = folders.load_corpus(spark, str(tmp_path / "a"), lambda: built.append(1) or c)
    assert len(built) == 1
    want = {r.seq_id: (r.cls, r.seq, [tuple(p) for p in r.planted]) for r in c.collect()}
    assert {r.seq_id: (r.cls, r.seq, [tuple(p) for p in r.planted]) for r in got.collect()} == want and got.where("len <> 64").count() == 0
    with pytest.raises(FileNotFoundError):
        folders.load_corpus(spark, str(tmp_path / "none"))
    # '>' inside a header, Windows line ends, a last line without an end
    (tmp_path / "m.fa").write_bytes(b">a x>y\r\nAC\r\nGT\r\n>b\r\n\r\nTT>\r\n>c z\r\nA")
    assert {r.seq_id: r.seq for r in G.read_fasta(spark, str(tmp_path / "m.fa")).collect()} == {"a": "ACGT", "b": "TT>", "c": "A"}


def test_assay_folder_precedence(spark, tmp_path):
    row = "Pos\tRef\tAlt\tValue\tElement\n1\tA\tC\t0.5\t{}\n"
    for name in ("x.tsv", "my_elements_v2.tsv", "elements.tsv"):
        (tmp_path / name).write_text(row.format(name))
    (tmp_path / "note.md").write_text("not a table")
    with gzip.open(tmp_path / "elements.tsv.gz", "wt") as f:
        f.write(row.format("gz"))
    for want in ("gz", "elements.tsv", "my_elements_v2.tsv", "x.tsv"):
        assert [r.element for r in folders.read_assay(spark, str(tmp_path)).collect()] == [want]
        (tmp_path / ("elements.tsv.gz" if want == "gz" else want)).unlink()
    with pytest.raises(FileNotFoundError):
        folders.read_assay(spark, str(tmp_path))


def test_assay_files_of_several_headers(spark, tmp_path):
    (tmp_path / "a one.tsv").write_text("# made by hand\nposition\tref\talt\tscore\n1\tA\tC\t0.5\n1\tA\tC\t0.7\n")
    (tmp_path / "b.csv").write_text('Release,Position,Ref,Alt,"log2FC",Region\nGRCh38,1,a,c,-1.5,e\nGRCh37,2,A,C,9,e\nGRCh38,2,A,-,9,e\n')
    (tmp_path / "c.csv").write_text("Release,Position,Ref,Alt,log2FC,Region\ngrch38,1,A,C,2.5,e\n")
    got = folders.read_assay(spark, str(tmp_path), "GRCh38")
    assert sorted((r.element, r.pos, r.alt, r.eff) for r in got.collect()) == [("a one", 1, "C", 0.5), ("a one", 1, "C", 0.7), ("e", 1, "C", -1.5), ("e", 1, "C", 2.5)]
    # the last row of a file and the last file win
    last = {r.element: r.e_signed for r in G.assay_elements(got, least=1).collect()}
    assert last == {"a one": 0.7, "e": 2.5}


def test_last_row_wins_in_a_split_file(spark, tmp_path):
    n = 4000
    (tmp_path / "big.tsv").write_text("pos\tref\talt\teffect\telement\n" + "".join(f"{i % 20}\tA\tC\t{i}\te\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        a = folders.read_assay(spark, str(tmp_path / "big.tsv"))
        assert a.rdd.getNumPartitions() > 3
        got = {r.pos: r.e_signed for r in G.assay_elements(a.repartition(5)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {p: float(n - 20 + p) for p in range(20)}


def test_sources_of_elements(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("pos\tref\talt\teffect\n" + "".join(f"{p}\t{'ACGT'[p % 4]}\t{'CGTA'[p % 4]}\t{p - 6}\n" for p in range(5, 17) if p != 9))
    got = folders.load_elements(spark, "assay", str(tmp_path / "t.tsv")).collect()
    assert len(got) == 1 and got[0].elem_id == "t" and got[0].seq == "CGTAACGTACGTA"[0:4] + "A" + "GTACGTA"
    assert got[0].e_signed == [-1.0, 0.0, 1.0, 2.0, 0.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0] and got[0].e_alt[0] == [0.0, 0.0, 1.0, 0.0] and got[0].e_alt[4] == [0.0] * 4
    s = folders.load_elements(spark, "synthetic", n=3, length=64)
    folders.write_elements(s, str(tmp_path / "p"))
    assert sorted(folders.load_elements(spark, "table", str(tmp_path / "p")).collect()) == sorted(s.collect())
    folders.write_elements(s.drop("e_alt"), str(tmp_path / "p"))
    assert folders.load_elements(spark, "table", str(tmp_path / "p")).where("e_alt IS NULL").count() == 3
    for bad in (("nope", ""), ("assay", "")):
        with pytest.raises(ValueError):
            folders.load_elements(spark, *bad)
