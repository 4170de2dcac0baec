"""Subword pieces of an existing vocabulary, with unigram weights from its scores."""

from __future__ import annotations

import math

SPACE = "▁"
#: Added to a rank before Zipf's law turns it into a weight.
ZIPF_OFFSET = 2.7
#: Natural-log weight of a fallback byte, below that of the rarest piece.
BYTE_PENALTY = 10.0


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def piece_weights(path: str) -> dict[str, float]:
    """Natural-log unigram weight of every ordinary piece.

    The file's scores are minus the ranks of its pieces; Zipf's law makes them weights, 1 / (rank + offset),
    normalised to sum to one.  Control, unknown, byte and unused (hugely negative) entries are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ranks = {}
    for i in range(model.get_piece_size()):
        if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i)) and model.get_score(i) > -1e6:
            ranks[model.id_to_piece(i)] = -model.get_score(i)
    raw = {p: -math.log(r + ZIPF_OFFSET) for p, r in ranks.items()}
    norm = math.log(sum(map(math.exp, raw.values())))
    return {p: w - norm for p, w in raw.items()}
