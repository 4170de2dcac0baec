"""Token files against the tokenizers library, and the range coder's round trip."""

import zlib

import numpy as np
import pytest

from helixframe.llm import range_coder, token_output


def brute(rows, end=1):
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(token_output.vocabulary()), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def result(spark, df, path):
    token_output.write_ids(df, path, token_output.vocabulary(), 1)
    out = token_output.read_ids(spark, path)
    return sorted(((r["doc_id"], r["start"], len(r["ids"]) // 4, zlib.crc32(bytes(r["ids"]))) for r in out.collect()), key=lambda r: r[1])


@pytest.mark.parametrize("n", [0, 1, 2, 299, 300, 301, 2500])
def test_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 1000, n), rng.integers(0, 3, n), np.full(n, 999), np.minimum(rng.zipf(1.3, n), 999)):
        blocks = range_coder.pack(ids.astype("<u4"), 1000, block=300)
        assert len(blocks) == -(-n // 300)
        assert (range_coder.unpack(blocks) == ids).all()


def test_long_blocks_and_the_whole_vocabulary():
    ids = np.random.default_rng(1).permutation(49408).astype("<u4")
    assert (range_coder.unpack(range_coder.pack(ids, 49408)) == ids).all()
    few = np.tile(np.array([5, 9, 9, 7], "<u4"), 10_000)
    blocks = range_coder.pack(few, 49408, block=40_000)
    assert len(blocks[0]) < 2500
    assert (range_coder.unpack(blocks) == few).all()


def test_blocks_stand_alone_and_are_checked():
    ids = np.random.default_rng(2).integers(0, 500, 1000).astype("<u4")
    blocks = range_coder.pack(ids, 500, block=300)
    assert (range_coder.unpack([blocks[2]]) == ids[600:900]).all()
    for at in (0, 6, 14, range_coder.HEADER.size + 20):
        bad = bytearray(blocks[1])
        bad[at] ^= 64
        with pytest.raises(ValueError):
            range_coder.unpack([bytes(bad)])
    with pytest.raises(ValueError):
        range_coder.pack(np.array([500], "<u4"), 500)


def test_ranges_never_vanish():
    """Just below a boundary a narrow range is cut to one number, and then grows to a whole cell."""
    coder = range_coder._Writer(1, 10)
    coder.low[:], coder.range[:] = (1 << 60) - 1, (1 << 44) - 1
    coder.settle(1)
    assert coder.range[0] >= 1 << 44 and coder.place[0] <= 4


@pytest.mark.parametrize("seed", range(3))
def test_steady_streams(seed):
    """Long runs of sure proposals between surprises, where ranges shrink with their lower ends at rest."""
    rng = np.random.default_rng(seed)
    ids = np.concatenate([np.r_[np.full(rng.integers(1, 900), rng.integers(0, 40)), rng.integers(0, 49408, rng.integers(0, 9))] for _ in range(300)]).astype("<u4")
    assert (range_coder.unpack(range_coder.pack(ids, 49408, block=2000)) == ids).all()


def test_against_the_library(spark, tmp_path, awkward, monkeypatch):
    monkeypatch.setattr(token_output, "MEMO", 2000)
    texts = [*awkward, "don't STOP 123 <|endoftext|> é ́x a b c\u0085d \x1cy", "ΣΑΣ Σ İ ﬁ 漢字かな 👍🏽", "the cat. " * 4000, "a" * 300]
    rows = [(len(texts) - i, t) for i, t in enumerate(texts)] + [(None, "no id")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, shard int, n string").repartition(3)
    assert result(spark, df, str(tmp_path / "ids")) == brute(rows)


def test_repeats_and_empty_tables(spark, docs, tmp_path):
    rows = [(7, "same text"), (7, "same text"), (3, None), (3, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(spark, df, str(tmp_path / "a")) == brute(rows)
    assert result(spark, docs([]), str(tmp_path / "b")) == []


def test_rows_of_the_files_hold_whole_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_output, "ROW", 10)
    rows = [(i, "one two three four " * (i % 4)) for i in range(30)]
    run = token_output._rows(token_output.vocabulary(), 1)
    import pyarrow as pa
    from pyspark import TaskContext

    monkeypatch.setattr(TaskContext, "get", staticmethod(lambda: type("T", (), {"partitionId": lambda self: 0})()))
    parts = list(run(iter([pa.RecordBatch.from_pydict({"doc": [str(i) for i, _ in rows], "text": [t.encode() for _, t in rows]})])))
    assert len(parts) > 3
    got = [r for p in parts for b in token_output._documents(iter([p])) for r in b.to_pylist()]
    assert [(int(r["doc"]), r["place"], len(r["ids"]) // 4, zlib.crc32(r["ids"])) for r in got] == brute(rows)


def test_new_words_of_many_texts_are_encoded_in_one_call_and_kept():
    encode = token_output._Encoder(token_output.vocabulary())
    texts = [b"Alpha, beta. GAMMA\tdelta\n", "café Été, ça va.".encode(), b'wait... "what?" (yes), it\'s 3.14. a.b,c', "2×3 é J̌ İx.".encode(), b""]
    want = [np.array(encode.encode(t.decode()), "<u4").tobytes() for t in texts]
    calls, real = [], encode.encode
    encode.encode = lambda text: calls.append(text) or real(text)
    assert list(encode(texts * 20)) == want * 20 and len(calls) <= 2
    assert list(encode(texts[:2])) == want[:2] and len(calls) <= 2
    assert token_output._encoder(token_output.vocabulary()) is token_output._encoder(token_output.vocabulary())


@pytest.mark.parametrize("n", [255, 256, 511, 513, 5_000, 70_001])
def test_lanes_share_a_model_and_may_be_uneven(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.2, n), 49407).astype("<u4")
    blocks = range_coder.pack(ids, 49408)
    assert len(blocks) == 1 and (range_coder.unpack(blocks) == ids).all()


def test_letters_marks_and_digits_are_pieces_of_their_own_in_any_text():
    encode = token_output._Encoder(token_output.vocabulary())
    marks = "!!!", "###", "*** ", "? ", "\"(", ")-"
    texts = [f"Alpha{m}été{n}beta{m}{n}| ’".encode() for m in marks for n in range(50)] + [f"alpha{m}ÉTÉ{n}beta{m}".encode() for m in marks for n in range(50)]
    assert list(encode(texts)) == [np.array(encode.encode(t.decode()), "<u4").tobytes() for t in texts]
    assert len(encode.known) < 100
    awkward = ["H\u0331! a\u0301,b", "x<|endoftext|>, y <|ENDOFTEXT|> <|a", "12\u0301 3½4", "’s!'S ''t", "a\x1c,b \x7f. \u00a0,\u0085.", "×,é÷.", "=\u0338a", "", " \n", "İ, ǅ. ß!"]
    assert list(encode([t.encode() for t in awkward])) == [np.array(encode.encode(t), "<u4").tobytes() for t in awkward]


def test_long_groups_of_texts_are_cut(monkeypatch):
    monkeypatch.setattr(token_output, "TOGETHER", 10)
    encode = token_output._Encoder(token_output.vocabulary())
    texts = [b"one two, three", b"", b"four", b"  ", b"five. six", b""]
    assert list(encode(texts)) == [np.array(encode.encode(t.decode()), "<u4").tobytes() for t in texts]


def test_a_carry_goes_back_through_full_words():
    coder = range_coder._Writer(1, 10)
    coder.words[:3], coder.place[:], coder.low[:] = (5, 0xFFFF, 0xFFFF), 3, (1 << 64) - 1
    coder.raised(1, np.ones(1, np.uint64))
    assert coder.words[:3].tolist() == [6, 0, 0] and coder.low[0] == 0


def test_rare_ids_after_sure_proposals_keep_a_part():
    """The narrowest parts: proposals are as sure as can be, and what comes instead was never seen, in the widest vocabulary."""
    ids = np.tile(np.arange(5), 40_000)
    ids[::997] = range_coder._WIDEST - 1 - np.arange(len(ids[::997]))
    blocks = range_coder.pack(ids.astype("<u4"), range_coder._WIDEST)
    assert (range_coder.unpack(blocks) == ids).all()


def test_reading_leaves_the_sessions_batches_and_small_ones_are_encoded_together(spark, docs, tmp_path):
    import pyarrow as pa

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "1000")
        result(spark, docs(["one", "two"]), str(tmp_path / "a"))
        assert spark.conf.get(key) == "1000"
    finally:
        spark.conf.set(key, before)
    batches = [pa.RecordBatch.from_pydict({"doc": [str(i)], "text": [b"some text"]}) for i in range(50)]
    assert [len(texts) for _, texts in token_output._groups(iter(batches))] == [50]
