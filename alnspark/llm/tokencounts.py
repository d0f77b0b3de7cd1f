"""Token counts by dynamic programming over a trie of the distinct pre-tokens.

A pre-token is a word with one space before it. Its best segmentation into pieces needs, for each of its prefixes, the
best score of that prefix; words that share a prefix share these scores. So distinct pre-tokens are put into a trie
whose nodes hold the forward score and the number of pieces, worked out once, when a node is made; the terminal
node has the count of its word. Each task keeps one trie over its batches, up to NODES nodes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import small_batches
from .pieces import LEAST, UNIT, Vocabulary, default_model, vocabulary
from .ppm import words

NODES = 600_000


class Trie:
    def __init__(self, v: Vocabulary):
        self.v = v
        self.reset()

    def reset(self) -> None:
        self.next: dict[int, int] = {}  # node << 21 | code point -> node
        self.score: list[int] = [0]
        self.pieces: list[int] = [0]
        self.terminal: dict[bytes | str, tuple[int, int]] = {}

    def add(self, word: str) -> tuple[int, int]:
        """Pieces and score of the best segmentation of a pre-token; of equal scores the one with the longer last piece."""
        ids, next_, score, pieces, longest = self.v.ids, self.next, self.score, self.pieces, self.v.longest
        path, node = [0], 0
        for d, char in enumerate(word, 1):
            key = node << 21 | ord(char)
            node = next_.get(key, -1)
            if node < 0:
                best, count = LEAST, 0
                for a in range(max(0, d - longest), d):
                    if (piece := ids.get(word[a:d])) and (s := score[path[a]] + piece[1]) > best:
                        best, count = s, pieces[path[a]] + 1
                if char not in ids:
                    n = len(char.encode())
                    if (s := score[path[d - 1]] + n * self.v.byte_score) > best:
                        best, count = s, pieces[path[d - 1]] + n
                node = next_[key] = len(score)
                score.append(best)
                pieces.append(count)
            path.append(node)
        return pieces[node], score[node]

    def of(self, tokens: set[bytes]) -> None:
        """Make sure that all tokens have a terminal."""
        if len(self.score) > NODES:
            self.reset()
        terminal = self.terminal
        for t in sorted(tokens.difference(terminal)):
            terminal[t] = self.add(" " + t.decode())


def count_tokens(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_pretokens, n_tokens, log_score for every row of docs: words (A-Z lower-cased), their pieces, and the
    sum of their best scores in nats.

    A null, empty or blank text has 0 of each. Repeated rows are counted each. An empty table gives no rows. Only
    doc_id and text are read.
    """
    import pyarrow as pa

    path = model or default_model()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(vocabulary(path))
        for batch in batches:
            counts = [Counter(words(t)) for t in batch.column(1).to_pylist()]
            trie.of(set().union(*counts))
            at = trie.terminal
            out: tuple[list, list, list] = ([], [], [])
            for c in counts:
                found = [(n, *at[w]) for w, n in c.items()]
                for column, value in zip(out, (sum(c.values()), sum(n * k for n, k, _ in found), sum(n * s for n, _, s in found) / UNIT), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())],
                ["doc_id", "n_pretokens", "n_tokens", "log_score"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_pretokens bigint, n_tokens bigint, log_score double")
