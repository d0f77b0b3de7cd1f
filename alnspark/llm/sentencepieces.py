"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reports, at each position, every piece that ends there (its own and those on its output links, longest
first); each relaxes the best score at that position. A character without a piece goes to its bytes, so decoding
gives back every text exactly.

No piece goes on beyond a blank that follows a non-blank, so a text is encoded in chunks that begin at blanks, and
each worker remembers the chunks it has seen. A chunk in turn is cut at its last character and at a line's end, if
the characters there stand side by side in no piece. A vocabulary with other pieces is encoded in whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

from pyspark.sql import DataFrame

from .common import small_batches
from .pieces import LEAST, Vocabulary, default_model, vocabulary

#: Chunks in each of a worker's two generations.
MEMO = 200_000
CHUNK = re.compile(r" *[^ ]+| +$")


class Encoder(dict):
    """Chunk -> ids."""

    def __init__(self, v: Vocabulary):
        import ahocorasick

        super().__init__()
        self.v = v
        self.automaton = ahocorasick.Automaton()
        for surface, (k, score) in v.ids.items():
            self.automaton.add_word(surface, (k, len(surface), score))
        self.automaton.make_automaton()
        self.single = {s for s in v.ids if len(s) == 1}
        self.pairs = {s[i : i + 2] for s in v.ids for i in range(len(s) - 1)}
        self.old: dict[str, tuple[int, ...]] = {}
        self.by_chunk = not any(re.search("[^ ] ", s) for s in v.ids)

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        ids = self.old.get(chunk)
        if ids is None:
            # a mark at the end, or a line's end within: what stands on both sides is encoded apart
            n = len(chunk)
            if n > 64:
                ids = tuple(chain.from_iterable(self.part(chunk[a:b]) for a, b in pairwise(self.cuts(chunk))))
            else:  # a level for each cut, so 64 at most
                at = n - 1 if n > 1 and chunk[-2:] not in self.pairs else chunk.find("\n", 1)
                if at > 0 and chunk[at - 1 : at + 1] not in self.pairs:
                    ids = self[chunk[:at]] + self[chunk[at:]]
                else:
                    ids = self.segment(chunk)
        self.remember(chunk, ids)
        return ids

    def cuts(self, chunk: str) -> list[int]:
        """Where the chunk is cut: its ends, its line ends, and before each of the marks that a line ends with."""
        pairs, ends, at = self.pairs, [], chunk.find("\n", 1)
        while at > 0:
            if chunk[at - 1 : at + 1] not in pairs:
                ends.append(at)
            at = chunk.find("\n", at + 1)
        found, begin = [0], 0
        for end in [*ends, len(chunk)]:
            marks, k = [end], end
            while k - begin > 1 and chunk[k - 2 : k] not in pairs:
                k -= 1
                marks.append(k)
            found += reversed(marks)
            begin = end
        return found

    def part(self, chunk: str) -> tuple[int, ...]:
        """Ids of a part that isn't cut further here; short ones are remembered as chunks are."""
        ids = self.get(chunk)
        if ids is None:
            ids = self.old.get(chunk)
            if ids is None:
                ids = self.segment(chunk)
            self.remember(chunk, ids)
        return ids

    def remember(self, chunk: str, ids: tuple[int, ...]) -> None:
        if len(chunk) <= 64:
            if len(self) >= MEMO:  # the newer half stays at hand
                self.old = dict(self)
                self.clear()
            self[chunk] = ids

    def segment(self, text: str) -> tuple[int, ...]:
        """Ids of the best segmentation; of equal scores the one whose last piece is longest."""
        if not self.single.issuperset(text):
            return self.segment_with_bytes(text)
        n = len(text)
        best: list[int] = [LEAST] * (n + 1)
        best[0] = 0
        back: list = [None] * (n + 1)
        for end, piece in self.automaton.iter(text):
            end += 1
            score = best[end - piece[1]] + piece[2]
            if score > best[end]:
                best[end] = score
                back[end] = piece
        out: list[int] = []
        while n:
            k, length, _ = back[n]
            out.append(k)
            n -= length
        return tuple(out[::-1])

    def segment_with_bytes(self, text: str) -> tuple[int, ...]:
        """The same for a text with characters that have no piece of their own: their bytes are one more way to go."""
        n = len(text)
        best, back = [0] + [LEAST] * n, [((), 0)] * (n + 1)
        found: list[list[tuple[tuple[int, ...], int, int]]] = [[] for _ in range(n + 1)]
        for end, (k, length, score) in self.automaton.iter(text):
            found[end + 1].append(((k,), length, score))
        for end in range(1, n + 1):
            if text[end - 1] not in self.single:
                ids = self.v.unknown(text[end - 1])
                found[end].append((ids, 1, len(ids) * self.v.byte_score))
            for ids, length, score in found[end]:
                if (s := best[end - length] + score) > best[end]:
                    best[end], back[end] = s, (ids, length)
        out: list[int] = []
        while n:
            ids, length = back[n]
            out += reversed(ids)
            n -= length
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if not self.by_chunk:
            return list(self.segment(" " + text))
        parts = text.split(" ")
        chunks = [" " + p for p in parts] if all(parts) else CHUNK.findall(" " + text)
        return list(chain.from_iterable(map(self.__getitem__, chunks)))


def decode_ids(ids, v: Vocabulary) -> str:
    """The text of ids: surfaces joined, runs of byte ids read as UTF-8, the leading space taken off."""
    of_byte = {k: b for b, k in enumerate(v.byte_ids)}
    if of_byte.keys().isdisjoint(ids):
        return "".join([v.surface[k] or "" for k in ids])[1:]
    parts, run = [], bytearray()
    for k in ids:
        if k in of_byte:
            run.append(of_byte[k])
        else:
            if run:
                parts.append(run.decode(errors="replace"))
                run = bytearray()
            parts.append(v.surface[k] or "")
    return "".join([*parts, run.decode(errors="replace")])[1:]


@lru_cache(maxsize=2)
def encoder(model: str) -> Encoder:
    return Encoder(vocabulary(model))


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """All rows and columns of docs and piece_ids. A null text stays null, an empty one has no pieces. Blanks are kept
    as they are. Repeated rows get equal ids. An empty table gives no rows."""
    import pyarrow as pa

    path = model or default_model()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            ids = [None if t is None else e.encode(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, "piece_ids"])

    kept = docs.drop("piece_ids")
    return kept.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", piece_ids array<int>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """All rows and columns and decoded, the text of piece_ids (null for null)."""
    import pyarrow as pa

    path = model or default_model()
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            texts = [None if x is None else decode_ids(x, v) for x in batch.column(batch.schema.get_field_index("piece_ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    kept = encoded.drop("decoded")
    return kept.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", decoded string")
