"""Token counts of a unigram vocabulary by a forward pass that runs once for each shared prefix."""

from __future__ import annotations

from os.path import commonprefix

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import free_name, per_text, small_batches, table, utf8
from helixframe.llm.pieces import BYTE_PENALTY, SPACE, default_path, piece_weights

#: Distinct pre-tokens whose counts a worker remembers.
MEMO = 800_000


class TrieCounter:
    """Tokens in the best segmentation of pre-tokens: the one of highest weight, of equal ones that of fewest tokens.

    Sorted pre-tokens are visited as a depth-first walk of their trie: the stack holds the forward state (weight,
    tokens) of every prefix on the path, so a prefix is computed once however many pre-tokens share it.
    Terminal counts are stored by pre-token.  A character outside the vocabulary costs one token a byte.
    """

    def __init__(self, weights: dict[str, float]):
        # every suffix of a piece, with the weight of those that are pieces: a longer arc can't exist beyond an absent suffix
        self.arcs: dict[str, float | None] = {p[i:]: None for p in weights for i in range(len(p))}
        self.arcs.update(weights)
        self.byte = min(weights.values(), default=0.0) - BYTE_PENALTY
        self.counts: dict[str, int] = {}

    def insert(self, words) -> None:
        get, path = self.arcs.get, ""
        weight, tokens = [0.0], [0]
        for word in sorted(words):
            keep = len(commonprefix((path, word))) + 1
            del weight[keep:], tokens[keep:]
            for j in range(len(weight), len(word) + 1):
                top, least = _NONE, 0
                for i in range(j - 1, -1, -1):
                    w = get(word[i:j], _ABSENT)
                    if w is None:
                        continue
                    if w is _ABSENT:
                        break
                    w += weight[i]
                    if w > top or w == top and tokens[i] < least - 1:
                        top, least = w, tokens[i] + 1
                if get(word[j - 1]) is None:
                    n = len(word[j - 1].encode("utf-8", "replace"))
                    w = weight[j - 1] + n * self.byte
                    if w > top or w == top and tokens[j - 1] + n < least:
                        top, least = w, tokens[j - 1] + n
                weight.append(top)
                tokens.append(least)
            path = word
            self.counts[word] = tokens[len(word)]


_ABSENT = object()
_NONE = float("-inf")


def split(text: bytes) -> list[str]:
    return [SPACE + w for w in text.decode("utf-8", "replace").translate(_BLANKS).split(" ") if w]


_BLANKS = {b: " " for b in (*range(9, 14), 32)}
_workers: dict[str, TrieCounter] = {}


def token_counts(docs: DataFrame, path: str | None = None, text_col: str = "text", name: str = "tokens", memo: int = MEMO) -> DataFrame:
    """docs with a struct column <name>: n_pretokens, n_tokens, longest (most tokens in a pre-token).

    Pre-tokens are runs of characters other than ASCII white space, each with the mark of a word's start in front.
    Null and empty texts have no tokens.  Rows stay where they are: counts are made within each task, for
    the distinct pre-tokens of a batch of texts that its worker doesn't remember.  Of segmentations of equal weight the one
    of fewer tokens counts.  Rows that repeat count alike; an empty table gives an empty one.  If docs has a column <name>,
    underscores go in front of the new one's.
    """
    path = path or default_path()

    def make():
        if path not in _workers:
            _workers[path] = TrieCounter(piece_weights(path))
        trie = _workers[path]

        def prepare(texts: list[bytes]) -> None:
            if len(trie.counts) > memo:
                trie.counts.clear()
            new: set[str] = set()
            for text in texts:
                new.update(split(text))
            trie.insert(new.difference(trie.counts))

        def one(text: bytes):
            counts = list(map(trie.counts.__getitem__, split(text)))
            return len(counts), sum(counts), max(counts, default=0)

        one.prepare = prepare
        return one

    return small_batches(docs).withColumn(free_name(docs, name), per_text(make, "n_pretokens bigint, n_tokens bigint, longest bigint")(utf8(text_col)))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "tokens.n_pretokens", "tokens.n_tokens", "tokens.longest")
