"""Language identification with spans.

Each word is scored for each language by character n-grams; the word's script first narrows the languages that come
into question. A Viterbi pass over the words, with a penalty for every switch, labels spans of the text; the
language with most letters is the document's.

The model is fitted on a bounded sample of each language (SAMPLE documents, by hash of the id); tasks count the n-grams,
texts don't go to the driver. Words repeat, so a worker scores each distinct word once; Viterbi runs in step over the
documents of a batch.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from .common import clean, small_batches

#: Documents of each language that the model is fitted on, about.
SAMPLE = 1_500
GRAMS = (1, 2, 3, 4)
SLOTS = 1 << 17
SWITCH = 12.0
#: Nats that an n-gram that was never seen in a language costs at most, and a language of another script.
FLOOR, FOREIGN = 6.0, 30.0
#: Words that a worker remembers.
MEMO = 150_000


def _ranges(points: list[int]) -> list[tuple[int, int]]:
    """First and last of each run of neighbours."""
    out: list[tuple[int, int]] = []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1] = (out[-1][0], p)
        else:
            out.append((p, p))
    return out


@lru_cache(maxsize=2)
def letters(last: int = sys.maxunicode) -> re.Pattern:
    """A word: a letter (Unicode categories L), then letters and marks (M), of code points up to `last`. Numbers are no
    letters, whatever their shape."""
    every = range(last + 1)
    said = lambda points: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _ranges(points))
    letter = said([p for p in every if chr(p).isalpha()])
    mark = said([p for p in every if unicodedata.category(chr(p))[0] == "M"])
    return re.compile(f"[{letter}][{letter}{mark}]*")


def pattern(text: str) -> re.Pattern:
    """The pattern of words that does for the text; the one for code points of 16 bits is much the faster one."""
    return letters(sys.maxunicode if len(text.encode("utf-16-le", "surrogatepass")) > 2 * len(text) else 0xFFFF)


@lru_cache(maxsize=1)
def scripts() -> tuple[list[int], list[str]]:
    """Where each range of letters of one script begins, and the script: the first word of the letters' Unicode names,
    once forms for compatibility (of full width, of presentation, mathematical ones) stand for what they mean."""
    first, names = [0], ["LATIN"]
    for p in range(128, sys.maxunicode + 1):
        if chr(p).isalpha():
            name = unicodedata.name(unicodedata.normalize("NFKC", chr(p))[0], "OTHER").split(" ")[0]
            if name != names[-1]:
                first.append(p)
                names.append(name)
    return first, names


def script(word: str) -> str:
    if word.isascii():
        return "LATIN"
    first, names = scripts()
    return names[bisect_right(first, ord(word[0])) - 1]


def slots(words: list[str]):
    """For each n the slots of all n-grams of all words (a blank on both sides), and where each word's begin; every word
    has one n-gram of each n at least, as short ones are padded with zeros."""
    import numpy as np

    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    room = np.maximum(sizes, max(GRAMS))
    first = np.cumsum(room) - room
    points = np.zeros(room.sum(), np.uint64)
    text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    inner = np.repeat(first + 1, sizes - 2) + np.arange(len(text)) - np.repeat(np.cumsum(sizes - 2) - (sizes - 2), sizes - 2)
    points[inner] = text
    points[first] = points[first + sizes - 1] = 32
    for n in GRAMS:
        count = np.maximum(sizes - n + 1, 1)
        begin = np.cumsum(count) - count
        at = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(begin, count)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = (h ^ points[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        yield (h % np.uint64(SLOTS)).astype(np.int64), begin, count


@dataclass
class Model:
    languages: list[str]
    table: object  # SLOTS x languages: log probability of an n-gram, centred over the languages
    scripts: dict[str, object]  # script -> what its words add to each language: 0, or -FOREIGN


def counted(texts: list[str], langs: list[str]) -> Iterator[tuple[str, object, object, Counter]]:
    """Of each language the slots that its words' n-grams have, how often each occurs, and how often each script."""
    import numpy as np

    words: dict[str, Counter] = {x: Counter() for x in langs}
    for text, lang in zip(texts, langs, strict=True):
        lower = text.lower()
        words[lang].update(pattern(lower).findall(lower))
    for lang, seen in words.items():
        used: Counter = Counter()
        for w, n in seen.items():
            used[script(w)] += n
        counts, times = np.zeros(SLOTS, np.int64), np.fromiter(seen.values(), np.float64, len(seen))
        for slot, _, count in slots(list(seen)) if seen else ():
            counts += np.bincount(slot, weights=np.repeat(times, count), minlength=SLOTS).astype(np.int64)
        at = np.flatnonzero(counts)
        yield lang, at, counts[at], used


def model_of(names: list[str], counts, used: dict[str, Counter]) -> Model:
    """A model from `counts` (slots by languages) and how often each language's words are of each script."""
    import numpy as np

    share: dict[str, object] = {}
    for k, lang in enumerate(names):
        for s, n in used.get(lang, {}).items():
            share.setdefault(s, np.zeros(len(names)))[k] = n / max(1, sum(used[lang].values()))
    logs = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * SLOTS)) if names else counts
    logs -= logs.mean(1, keepdims=True) if names else 0
    return Model(names, np.clip(logs, -FLOOR, FLOOR).astype(np.float32), {s: np.where(u >= 0.01, 0.0, -FOREIGN).astype(np.float32) for s, u in share.items() if (u >= 0.01).any()})


def fit_texts(texts: list[str], langs: list[str]) -> Model:
    import numpy as np

    names = sorted(set(langs))
    counts, used = np.zeros((SLOTS, len(names)), np.float32), {}
    for lang, at, n, by_script in counted(texts, langs):
        counts[at, names.index(lang)] = n
        used[lang] = by_script
    return model_of(names, counts, used)


def fit(docs: DataFrame, where: Column | None = None, sample: int = SAMPLE) -> Model:
    """A model of the languages in docs.lang, of the rows for which `where` holds: about `sample` rows of each language,
    all of one id or none. Rows with a null text or lang are left out. The driver gets the sums by language and slot."""
    import numpy as np
    import pyarrow as pa

    known = clean(docs, "doc_id", "text", "lang").where("text is not null and lang is not null")
    known = known.where(where) if where is not None else known
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row per language
    if not sizes:
        return fit_texts([], [])
    # a share of each language by hash of the id: no sort, no window over a common language
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, sample / n)).otherwise(share)
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, at, n, used in counted(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.nulls(len(at), pa.string()), pa.array(at), pa.array(n)], ["lang", "script", "slot", "n"])
                k = len(used)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array(list(used), pa.string()), pa.nulls(k, pa.int64()), pa.array(list(used.values()), pa.int64())], ["lang", "script", "slot", "n"])

    sums = some.select("text", "lang").mapInArrow(run, "lang string, script string, slot bigint, n bigint").groupBy("lang", "script", "slot").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(sizes)
    counts, used = np.zeros((SLOTS, len(names)), np.float32), {x: Counter() for x in names}
    lang_at = np.array([names.index(x) for x in sums["lang"].to_pylist()], np.int64)
    by_slot = sums["slot"].is_valid().to_numpy()
    counts[sums["slot"].drop_null().to_numpy(), lang_at[by_slot]] = sums["n"].to_numpy()[by_slot]
    for r in sums.filter(sums["slot"].is_null()).to_pylist():
        used[r["lang"]][r["script"]] += r["n"]
    return model_of(names, counts, used)


class _Words(dict):
    """Word -> row of `scores`."""

    def __init__(self, model: Model):
        import numpy as np

        super().__init__()
        self.model, self.np = model, np
        self.scores = np.zeros((1024, len(model.languages)), np.float32)
        self.fits = np.zeros(1024, bool)  # the word's script is that of a language

    def learn(self, found: list[str]) -> None:
        """Score words that aren't here yet, all at once."""
        np, k = self.np, len(self)
        while k + len(found) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.fits = np.concatenate([self.fits, np.zeros_like(self.fits)])
        total = np.zeros((len(found), self.scores.shape[1]))
        for slot, begin, _ in slots(found):
            total += np.add.reduceat(self.model.table[slot], begin, axis=0)
        none = np.zeros(self.scores.shape[1], np.float32)
        self.scores[k : k + len(found)] = total / len(GRAMS) + np.stack([self.model.scripts.get(script(w), none) for w in found])
        self.fits[k : k + len(found)] = [script(w) in self.model.scripts for w in found]
        self.update(zip(found, range(k, k + len(found)), strict=True))


def viterbi(rows, sizes, scores, switch: float = SWITCH):
    """Labels of all words of a batch; `rows`: each word's row of `scores`; `sizes`: words of each document, all over 0."""
    import numpy as np

    order = np.argsort(-sizes, kind="stable")
    first = (np.cumsum(sizes) - sizes)[order]
    n, width = sizes[order], scores.shape[1]
    stay = np.zeros((len(rows), width), bool)
    best = np.zeros(len(rows), np.int16)
    value = scores[rows[first]].astype(np.float64)
    active = np.searchsorted(-n, -np.arange(1, n[0] + 1), side="right")  # documents with at least t + 1 words
    for t in range(1, n[0]):
        a = active[t]
        value_t, at = value[:a], first[:a] + t
        top = value_t.argmax(1)
        most = value_t[np.arange(a), top][:, None]
        value_t = value_t - most
        stay[at] = keep = value_t >= -switch
        best[at] = top
        value[:a] = np.where(keep, value_t, -switch) + scores[rows[at]]
    label = np.zeros(len(rows), np.int16)
    state = value.argmax(1)
    last = first + n - 1
    for t in range(n[0]):
        a = active[t]
        at, s = last[:a] - t, state[:a]
        label[at] = s
        state[:a] = np.where(stay[at, s], s, best[at])
    return label


def label_batch(texts: list[str | None], words: _Words, switch: float = SWITCH) -> list[tuple[str, float, list[tuple[int, int, str]], float]]:
    """Of each text the language, its share of the letters, the spans (start, end, language) in code points, and the share
    of the letters in words of a script that some language has."""
    import numpy as np

    names = words.model.languages
    found: list[tuple[str, float, list, float]] = [("und", 0.0, [], 0.0)] * len(texts)
    if not names:
        return found
    if len(words) > MEMO:
        words.clear()
    lowered = [(t or "").lower() for t in texts]
    tokens = [pattern(t).findall(t) for t in lowered]
    full = [k for k, x in enumerate(tokens) if x]
    if not full:
        return found
    sizes = np.array([len(tokens[k]) for k in full])
    flat = list(chain.from_iterable(tokens[k] for k in full))
    if unseen := sorted(set(flat).difference(words)):
        words.learn(unseen)
    rows = np.fromiter(map(words.__getitem__, flat), np.int64, len(flat))
    long = np.fromiter(map(len, flat), np.int64, len(flat))
    labels = viterbi(rows, sizes, words.scores, switch)
    ends = np.cumsum(sizes)
    fits = np.add.reduceat(long * words.fits[rows], ends - sizes) / np.add.reduceat(long, ends - sizes)
    change = np.r_[True, labels[1:] != labels[:-1]]
    for k, lo, hi, fit_ in zip(full, ends - sizes, ends, fits.tolist(), strict=True):
        by = np.bincount(labels[lo:hi], weights=long[lo:hi], minlength=len(names))
        top = int(by.argmax())
        starts = [0, *(np.flatnonzero(change[lo + 1 : hi]) + 1)]
        text = texts[k]
        if len(lowered[k]) != len(text):  # lower-casing can add code points: spans then are in the text as it is
            places = [m.span() for m in pattern(text).finditer(text)]
            same = len(places) == hi - lo
        else:
            same, places = True, None
        if len(starts) == 1 or not same:
            spans = [(0, len(text), names[top])]
        else:
            places = places or [m.span() for m in pattern(lowered[k]).finditer(lowered[k])]
            cuts = [0, *(places[s][0] for s in starts[1:]), len(text)]
            spans = [(a, b, names[labels[lo + s]]) for a, b, s in zip(cuts[:-1], cuts[1:], starts, strict=True)]
        found[k] = (names[top], float(by[top] / by.sum()), spans, fit_)
    return found


SPANS = "array<struct<start: int, end: int, lang: string>>"


def identify(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """All rows and columns of docs, and lang_pred, score (the language's share of the letters), spans, fit (the share of
    the letters in words of a script that some language has).

    Null or letterless text: 'und', 0, no spans. Spans cover the text without gaps. Repeated rows get equal results;
    of languages that tie the first by name wins. An empty table gives no rows.
    """
    import pyarrow as pa

    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(model)
        for batch in batches:
            out = label_batch(batch.column(batch.schema.get_field_index("text")).to_pylist(), words, switch)
            spans = [[{"start": a, "end": b, "lang": x} for a, b, x in s] for _, _, s, _ in out]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array(spans, kind), pa.array([x[3] for x in out], pa.float64())],
                [*batch.schema.names, "lang_pred", "score", "spans", "fit"],
            )

    kept = docs.drop("lang_pred", "score", "spans", "fit")
    return kept.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + f", lang_pred string, score double, spans {SPANS}, fit double")
