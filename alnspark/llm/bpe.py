"""Byte-level BPE ids of whole texts, with a memo of word chunks.

The pre-tokenizer never joins what stands before a lone blank (between two non-blanks) with what follows, so a text
may be cut before every such blank and the chunks encoded apart. Chunks repeat; each worker remembers them.

A token that the vocabulary has beside its merges (an added token) is found in a text first; what stands before and
after it is encoded apart.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache
from itertools import chain

MEMO = 120_000  # chunks remembered by a worker: about 40 MB


class _Irregular(Exception):
    """A blank beside another one: the whole text goes to the encoder instead."""


class Chunks(dict):
    """Chunk without its leading space (or with its leading newline) -> ids."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        body = chunk[1:] if chunk[:1] == "\n" else chunk
        if not body or body[0].isspace() or body[-1].isspace():
            raise _Irregular
        ids = tuple(self.encode(chunk if body is not chunk and chunk[0] == "\n" else " " + chunk))
        if len(self) >= MEMO:
            self.clear()
        self[chunk] = ids
        return ids


class Encoder:
    def __init__(self, ranks_path: str, pattern: str, added: tuple[tuple[str, int], ...] = ()):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.chunks = Chunks(self.encode)
        self.added = dict(added)
        # of added tokens that begin at one place the longest is taken
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split

    def ids(self, text: str) -> list[int]:
        for token in self.added:
            if token in text:
                parts = self.split(text)  # added tokens are at the odd places
                return [k for at, x in enumerate(parts) if x for k in ([self.added[x]] if at % 2 else self.plain(x))]
        return self.plain(text)

    def plain(self, text: str) -> list[int]:
        """Ids of a text without added tokens."""
        head, *rest = text.replace("\n", " \n").split(" ")
        if not head or head[-1].isspace():
            return self.encode(text)
        try:
            return [*self.encode(head), *chain.from_iterable(map(self.chunks.__getitem__, rest))]
        except _Irregular:
            return self.encode(text)


@lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str, added: tuple[tuple[str, int], ...] = ()) -> Encoder:
    return Encoder(ranks_path, pattern, added)


def added_tokens(json_path: str) -> tuple[tuple[str, int], ...]:
    """Content and id of the added tokens in the JSON file of a tokenizer."""
    with open(json_path) as f:
        found = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in found):
        raise ValueError("added tokens that depend on what is beside them are not supported")
    return tuple((t["content"], t["id"]) for t in found)


@lru_cache(maxsize=1)
def default_vocabulary() -> tuple[str, str, tuple[tuple[str, int], ...]]:
    """Path, pattern and added tokens of the public 50k byte-level vocabulary; a parameter everywhere."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
