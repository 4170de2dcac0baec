"""Token ids of documents as files of range-coded blocks, in order of the documents' ids."""

from __future__ import annotations

import os
import re
import string
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm import range_coder
from helixframe.llm.common import remove_at_exit, shared_dir, small_batches, table, utf8

#: Ids that a row of the files holds, but for the rest of its last document.
ROW = range_coder.BLOCK
#: Bytes, roughly, of words and their ids that a worker remembers, and of the longest such word.  Bounds memory, not results.
MEMO, WORD = 200_000_000, 64
#: Bytes of texts, roughly, that are taken apart and whose new pieces are encoded together.
TOGETHER = 4 << 20
FILES = "shard int, first bigint, n bigint, doc_ids array<string>, sizes array<bigint>, blocks array<binary>"

#: Kinds of bytes: blanks, which never take part in a token, letters, marks, digits, and all that may depend on what is beside it.
_BLANK, _LETTER, _MARK, _DIGIT, _OTHER = range(5)
BLANKS = b" \t\n\r\x0b\x0c"
#: Bytes of Latin-1 letters, and the two signs among them.
_LATIN, _SIGNS = b"\xc3" + bytes(range(128, 192)), (b"\xc3\x97", b"\xc3\xb7")
_LATIN_WORD = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: Whether a piece begins at a byte, by the kinds of the byte before (times 8) and its own.
_CUT = bytes(
    b % 8 != _BLANK and (b // 8 == _BLANK or (b // 8 != b % 8 or b % 8 == _DIGIT) and not {b // 8, b % 8} & {_BLANK, _OTHER}) for b in range(256)
)
#: Characters that stand for the bytes of Latin-1 letters in a byte-level model, where they aren't those of Latin-1 itself.
_BYTE_LEVEL = {b: 256 + 33 + b - 127 for b in range(127, 161)} | {173: 256 + 67}

_encoders: dict[str, _Encoder] = {}


def _kinds(marks: bytes, latin: bool) -> bytes:
    out = bytearray([_OTHER]) * 256
    for kind, bs in ((_BLANK, BLANKS), (_LETTER, string.ascii_letters.encode()), (_DIGIT, string.digits.encode()), (_MARK, marks), (_LETTER, _LATIN if latin else b"")):
        for b in bs:
            out[b] = kind
    return bytes(out)


class _Encoder:
    """Ids of texts by a tokenizer file whose normal form drops white space, so that what lies between blanks is encoded by itself.

    If it is a byte-level BPE with an end mark, of a normal form in small letters that splits letters, single digits and marks, as CLIP's
    does, then these are encoded by themselves too.  Each piece of some texts is looked up once; new ones go to the library together,
    those of one kind in one call, where the end marks tell them apart.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # what is one piece of small letters, a digit or marks is in normal form
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.known, self.size = {}, 0
        self.ends = None
        # between blanks alone
        self.marks = self.lower = b""
        self.kinds = {True: bytes(_BLANK if b in BLANKS else _OTHER for b in range(256))}
        self.kinds[False] = self.kinds[True]
        suffix, added = getattr(self.tokenizer.model, "end_of_word_suffix", None), [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        inside = {c for t in added for c in t}
        marks = "".join(c for c in string.punctuation if c not in inside and c != "'").encode()
        if suffix and all(set(t) & set(string.punctuation) - {"'"} and t.isascii() and not set(t) & set(string.digits + string.whitespace) for t in added):
            whole = np.array(self.encode(PROBE), "<u4").tobytes()
            self.ends = np.zeros(self.vocabulary, bool)
            self.ends[[i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith(suffix)]] = True
            blank = self.kinds
            self.kinds, self.marks = {latin: _kinds(marks, latin) for latin in (True, False)}, marks
            self.lower = string.ascii_letters.encode() + string.digits.encode() + BLANKS + marks + b"'" + _LATIN
            if next(self([PROBE.encode()])) != whole:
                self.ends, self.kinds, self.marks, self.lower = None, blank, b"", b""
            self.known, self.size = {}, 0

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _single(self, pieces: list[bytes]) -> list[bytes]:
        many = self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in pieces], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in many]

    def _joined(self, pieces: list[bytes], latin: bool) -> list[bytes]:
        """Packed ids of pieces of one kind of character each."""
        text = b" ".join(pieces).lower().decode()
        if latin:
            text = text.lower().encode().decode("latin-1").translate(_BYTE_LEVEL)
        ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
        if len(cuts) != len(pieces) or cuts and cuts[-1] != 4 * len(ids):
            return self._single(pieces)
        packed = ids.tobytes()
        return [packed[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def _encode(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        if self.ends is None:
            return dict(zip(pieces, self._single(pieces), strict=True))
        ascii, latin, rest = [], [], []
        for p in pieces:
            if p.isalpha() or len(p) == 1 and p.isdigit() or not p.translate(None, self.marks):
                ascii.append(p)
            else:
                (latin if _LATIN_WORD.fullmatch(p) else rest).append(p)
        made = [*self._joined(ascii, False), *self._joined(latin, True), *self._single(rest)]
        return dict(zip([*ascii, *latin, *rest], made, strict=True))

    def __call__(self, texts: list[bytes]) -> Iterator[bytes]:
        """Packed ids of each text."""
        at, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= TOGETHER:
                yield from self._some(texts[at : i + 1])
                at, size = i + 1, 0
        yield from self._some(texts[at:])

    def _some(self, texts: list[bytes]) -> Iterator[bytes]:
        lean, kinds = [], []
        for text in texts:
            # where nothing else is in it, letters beyond ASCII are told by their bytes, and small letters may stand for others
            simple = not text.translate(None, self.lower) and not any(s in text for s in _SIGNS)
            kinds.append(text.translate(self.kinds[simple]))
            lean.append((text.lower() if simple and self.lower else text).translate(None, BLANKS))
        kind = np.frombuffer(b"\0".join([b"", *kinds]), np.uint8)
        begins = np.frombuffer((kind[:-1] << 3 | kind[1:]).tobytes().translate(_CUT), bool)[kind[1:] != _BLANK]
        cuts, data = np.flatnonzero(begins), b"".join(lean)
        if not len(cuts):
            yield from [b""] * len(texts)
            return
        ends = pa.py_buffer(np.append(cuts, len(data)).astype(np.int64))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, ends, pa.py_buffer(data)]).dictionary_encode()
        _, places, distinct = pieces.dictionary.buffers()
        places, distinct = np.frombuffer(places, np.int64, len(pieces.dictionary) + 1).tolist(), distinct.to_pybytes()
        ids = pa.array(self._ids([distinct[a:b] for a, b in zip(places, places[1:], strict=False)]), pa.large_binary()).take(pieces.indices)
        _, places, packed = ids.buffers()
        places = np.frombuffer(places, np.int64, len(ids) + 1)
        # texts begin with a piece, or where the next one does
        bounds = places[np.searchsorted(cuts, np.cumsum([0, *map(len, lean)]))].tolist()
        view = memoryview(packed if packed is not None else b"")
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield bytes(view[a:b])

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        if self.size > MEMO:
            self.known, self.size = {}, 0
        found = list(map(self.known.get, pieces))
        if missing := [p for p, ids in zip(pieces, found, strict=True) if ids is None]:
            made = self._encode(missing)
            found = [made[p] if ids is None else ids for p, ids in zip(pieces, found, strict=True)]
            if max(map(len, made)) > WORD:
                made = {p: ids for p, ids in made.items() if len(p) <= WORD}
            self.known.update(made)
            self.size += sum(map(len, made)) + sum(map(len, made.values())) + 150 * len(made)
        return found


#: A text of all kinds that tells whether a tokenizer splits where pieces begin.
PROBE = "Word, ÉTÉ.Ça don't) it's; x!? \"Who\"'; a-b 1234.5x àÀÿß,(é) 7é.9 onthetionsh ... *** x's! zz"


def _encoder(path: str) -> _Encoder:
    """The worker's own, which goes on to know words from one task to the next."""
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[bytes]]]:
    """Documents and texts of as many batches as make up what is encoded together, however few rows the session's batches have."""
    docs, texts, size = [], [], 0
    for batch in batches:
        docs += batch["doc"].to_pylist()
        texts += batch["text"].to_pylist()
        size += batch["text"].nbytes
        if size >= TOGETHER:
            yield docs, texts
            docs, texts, size = [], [], 0
    yield docs, texts


def _rows(tokenizer: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = _encoder(tokenizer), TaskContext.get().partitionId()
        first, held, ids, sizes = 0, [], [], []

        def out() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(held), "<u4")
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.binary()))
            row = (shard, first, len(flat), ids, sizes, range_coder.pack(flat, encode.vocabulary))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["shard", "first", "n", "doc_ids", "sizes", "blocks"])

        n = 0
        for docs, texts in _groups(batches):
            for doc, packed in zip(docs, encode(texts), strict=True):
                held.append(packed + end)
                ids.append(doc)
                sizes.append(len(packed) // 4 + 1)
                n += sizes[-1]
                if n >= ROW:
                    yield out()
                    first, n, held, ids, sizes = first + n, 0, [], [], []
        if ids:
            yield out()

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes each whole text by a tokenizer file, adds end_id, and writes the ids to a new folder in ascending order of <id_col>.

    The folder holds Parquet rows of whole documents: their ids and numbers of tokens, and the tokens as blocks of range_coder, each
    of which can be read by itself and has a checksum.  Tasks write ranges of <id_col>; `shard` numbers them in order, `first` counts the
    tokens of the shard before the row.  Null texts count as empty and have end_id alone; null ids come first; rows that repeat are
    written each time, those of equal ids in order of a hash of the text; an empty table makes a folder without rows.  Other columns
    don't matter.  The file of the tokenizer has to drop white space, as _Encoder says.
    """
    order = [F.col("doc").asc_nulls_first(), F.xxhash64("text")]
    rows = small_batches(docs).select(F.col(f"`{id_col}`").alias("doc"), utf8(text_col).alias("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    rows.select(F.col("doc").cast("string").alias("doc"), "text").mapInArrow(_rows(tokenizer, end_id), FILES).write.parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
            ids = range_coder.unpack(row["blocks"])
            ends = np.cumsum(np.array(row["sizes"], np.int64))
            starts = ends - row["sizes"]
            if len(ids) != row["n"] or ends[-1] != row["n"]:
                raise ValueError("a row's blocks hold other numbers of ids than it says")
            for at in range(0, len(ends), 1000):
                a, b = starts[at : at + 1000], ends[at : at + 1000]
                packed = [ids[i:j].tobytes() for i, j in zip(a.tolist(), b.tolist(), strict=True)]
                n = len(packed)
                columns = [pa.array([row["shard"]] * n, pa.int32()), pa.array(row["doc_ids"][at : at + 1000], pa.string()), pa.array(a + row["first"]), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "doc", "place", "ids"])


def read_ids(spark: SparkSession, path: str, id_col: str = "doc_id", id_type: str = "bigint") -> DataFrame:
    """<id_col>, start, ids of each document that write_ids wrote: tokens of all documents before it, and its own as packed 32-bit integers.

    Damaged blocks are errors.  Totals of the shards, of which there is one for each task that wrote, give where each begins.
    """
    # a limit of one row would stay in the session; splits of the files bound a batch, and its rows are taken one at a time
    files = small_batches(spark.read.schema(FILES).parquet(path))
    totals = files.groupBy("shard").agg(F.sum("n").alias("n"))
    begins = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("begin"))
    docs = files.mapInArrow(_documents, "shard int, doc string, place bigint, ids binary")
    return docs.join(F.broadcast(begins), "shard").select(F.col("doc").cast(id_type).alias(id_col), (F.col("begin") + F.col("place")).alias("start"), "ids")


def vocabulary() -> str:
    """The tokenizer file of the registered query."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op12_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, from files that are written to the shared folder and read back."""
    path = f"{shared_dir(spark)}/ids-{uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), path, vocabulary(), 1)
    remove_at_exit(spark, path)
    out = read_ids(spark, path)
    return out.select("doc_id", "start", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
