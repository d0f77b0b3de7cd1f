"""A piece vocabulary with unigram scores, shared by the encoder and the token counter.

The public model is BPE: it stores the order of its merges, not probabilities. The score of a piece is therefore a rule
(Zipf's law over its rank); any other vocabulary of (piece, score) can be passed instead.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

SPACE = "▁"
#: Scores are integers, in millionths of a nat: sums are exact, so ties are ties wherever a text is cut.
UNIT = 1_000_000
#: What each byte of a character without a piece costs below the rarest piece.
BYTE_PENALTY = 10 * UNIT
#: Below any sum of scores.
LEAST = -(1 << 62)


@dataclass(frozen=True, eq=False)
class Vocabulary:
    """surface: text of an id, with plain spaces; ids: (id, score) of a surface; byte_ids: ids of the 256 bytes."""

    surface: tuple[str | None, ...]
    ids: dict[str, tuple[int, int]]
    byte_ids: tuple[int, ...]
    byte_score: int
    longest: int

    def unknown(self, char: str) -> tuple[int, ...]:
        return tuple(self.byte_ids[b] for b in char.encode())


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def rank_score(rank: int) -> int:
    return -round(UNIT * math.log(rank + 2))


@lru_cache(maxsize=2)
def vocabulary(model: str) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    plain = [k for k in range(n) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k))]
    by_rank = sorted(plain, key=lambda k: (-sp.get_score(k), k))
    surface: list[str | None] = [None] * n
    ids: dict[str, tuple[int, int]] = {}
    for rank, k in enumerate(by_rank):
        surface[k] = sp.id_to_piece(k).replace(SPACE, " ")
        ids.setdefault(surface[k], (k, rank_score(rank)))
    bytes_ = tuple(sp.piece_to_id(f"<0x{b:02X}>") for b in range(256))
    return Vocabulary(tuple(surface), ids, bytes_, rank_score(len(plain)) - BYTE_PENALTY, max(map(len, ids)))
