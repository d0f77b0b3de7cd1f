"""Toxicity by a classifier chain of sparse linear models over words and character n-grams.

Categories are predicted in sequence; each model gets the probabilities of the categories before it. While fitting,
those come from models that have not seen the document (out of fold), so the later model learns how far to trust them.

Fitting takes a bounded sample of labelled documents (SAMPLE, by hash of the id). Their texts stay with the executors:
tasks count in how many documents of each kind a feature stands, the best are chosen by SQL, and the driver gets the
numbers of the chosen features that each document has. Predicting goes over all whole texts, in one pass of an automaton
over the few n-grams with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from .common import clean, keep_by_id, materialize, small_batches

#: Labelled documents that the models are fitted on, at most.
SAMPLE = 8_000
FOLDS = 4
#: Characters of an n-gram; blanks count, so beginnings and ends of words are told from what stands inside. Whole words
#: count too.
GRAMS = (4, 5, 6)
#: n-grams are counted by hash in so many slots; those that share a slot are one feature.
SLOTS = 1 << 20
FEATURES = 800
LEAST_DOCS = 5
#: Penalty of a weight: for many documents, and (over their number) for few.
L1, L1_FEW = 2e-4, 0.2
STEPS = 200
REJECT = 0.5


def normalized(text: str | None) -> str:
    return f" {' '.join((text or '').lower().split())} "


def slots(text: str):
    """For each kind of feature of a normalized text its length (0: words), the slots, and the places where they begin."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    for n in GRAMS:
        if len(points) >= n:
            h = np.full(len(points) - n + 1, n, np.uint64)
            for k in range(n):
                h = (h ^ points[k : len(points) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(32)
            yield n, (h & np.uint64(SLOTS - 1)).astype(np.int64), np.arange(len(h))
    seen = {f" {w} ": 0 for w in text.split()}
    yield 0, np.fromiter((xxh3_64_intdigest(w) & (SLOTS - 1) for w in seen), np.int64, len(seen)), list(seen)


def present(text: str):
    """Sorted distinct slots of a normalized text."""
    import numpy as np

    return np.unique(np.concatenate([s for _, s, _ in slots(text)]))


def named(text: str, wanted: set[int]) -> set[tuple[int, str]]:
    """(slot, n-gram) of what a normalized text has of the wanted slots."""
    import numpy as np

    among = np.array(sorted(wanted))
    found: set[tuple[int, str]] = set()
    for n, s, places in slots(text):
        for k in np.flatnonzero(np.isin(s, among)):
            found.add((int(s[k]), text[places[k] : places[k] + n] if n else places[k]))
    return found


@dataclass
class Chain:
    """Categories in order; for each the slots' weights, the weights of the earlier probabilities and the intercept; the
    slots' n-grams."""

    categories: tuple[str, ...]
    weights: list[dict[int, float]] = field(default_factory=list)
    earlier: list[list[float]] = field(default_factory=list)
    intercepts: list[float] = field(default_factory=list)
    grams: list[tuple[str, int]] = field(default_factory=list)

    def automaton(self):
        """An automaton over the n-grams that gives the number of their slot; the weights by category and number."""
        import ahocorasick

        numbers = {s: k for k, s in enumerate(sorted({s for _, s in self.grams}))}
        a = ahocorasick.Automaton()
        for g, s in self.grams:
            a.add_word(g, numbers[s])
        if self.grams:
            a.make_automaton()
        return (a if self.grams else None), [[w.get(s, 0.0) for s in numbers] for w in self.weights]


def _fit_linear(x, y, fixed: int):
    """Weights and intercept of an L1 logistic regression; the last `fixed` columns carry no penalty."""
    import numpy as np

    n, p = x.shape
    w, v, b, vb, t = np.zeros(p, np.float32), np.zeros(p, np.float32), 0.0, 0.0, 1.0
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    b = vb = float(np.log(mean / (1 - mean)))
    z = np.random.default_rng(0).standard_normal(p).astype(np.float32)
    for _ in range(12):  # the largest singular value sets the step
        z = x.T @ (x @ z)
        z /= np.linalg.norm(z) + 1e-12
    step = 1.0 / (0.25 * (float(np.linalg.norm(x @ z)) ** 2 / n + 1.0) + 1e-6)
    shrink = np.full(p, max(L1, L1_FEW / n) * step, np.float32)
    if fixed:
        shrink[-fixed:] = 0
    for _ in range(STEPS):
        r = (1 / (1 + np.exp(-np.clip(x @ v + vb, -30, 30))) - y).astype(np.float32)
        u = v - step * (x.T @ r) / n
        new = np.sign(u) * np.maximum(np.abs(u) - shrink, 0)
        new_b = vb - step * float(r.mean())
        t1 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = new + ((t - 1) / t1) * (new - w), new_b + ((t - 1) / t1) * (new_b - b)
        w, b, t = new, new_b, t1
    return w, b


def sigmoid(x):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _fit_chain(categories: tuple[str, ...], rows: list[list[int]], values, fold, chosen: dict[tuple[int, int], list[int]]) -> Chain:
    """`rows`: the chosen slots of each document; `values`: documents by categories, 0 or 1; `chosen`: the slots for each
    category and the fold that is left out (-1: none)."""
    import numpy as np

    chain = Chain(categories)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.array([s for r in rows for s in r], np.int64)

    def fitted(c: int, left_out: int, extra):
        """Weights of the chosen slots, weights of `extra`, intercept and every document's logit."""
        slots_ = np.array(sorted(chosen[c, left_out]), np.int64)
        x = np.zeros((len(rows), len(slots_)), np.float32)
        if len(slots_):
            at = np.minimum(np.searchsorted(slots_, flat), len(slots_) - 1)
            hit = slots_[at] == flat
            x[owner[hit], at[hit]] = 1
        x = np.hstack([x, extra]).astype(np.float32)
        take = fold != left_out
        w, b = _fit_linear(x[take], values[take, c].astype(np.float32), extra.shape[1])
        k = len(slots_)
        return dict(zip(slots_.tolist(), w[:k].tolist(), strict=True)), [float(v) for v in w[k:]], float(b), x @ w + b

    seen = np.zeros((len(rows), 0), np.float32)  # probabilities of the earlier categories, out of fold
    for c in range(len(categories)):
        weights, earlier, intercept, _ = fitted(c, -1, seen)
        chain.weights.append({s: w for s, w in weights.items() if w})
        chain.earlier.append(earlier)
        chain.intercepts.append(intercept)
        if c + 1 < len(categories):
            logit = np.zeros(len(rows), np.float32)
            for f in range(FOLDS):
                if (fold != f).any() and (fold == f).any():
                    logit[fold == f] = fitted(c, f, seen)[3][fold == f]
            seen = np.hstack([seen, sigmoid(logit)[:, None]]).astype(np.float32)
    return chain


def _counted(sample: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """slot and, for each fold and category, in how many documents with a 0 and with a 1 it stands (f_c_0, f_c_1)."""
    import pyarrow as pa

    names = [f"f{f}_{c}_{v}" for f in range(FOLDS) for c in range(len(categories)) for v in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def parts(counts):
            at = np.flatnonzero(counts.any(axis=0))
            for k in range(0, len(at), 50_000):
                part = at[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(x.astype(np.int32)) for x in counts[:, part])], ["slot", *names])

        counts, seen = np.zeros((len(names), SLOTS), np.uint16), 0  # all that a task holds, however many documents it reads
        for batch in batches:
            for text, fold, *labels in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if seen == 65_535:
                    yield from parts(counts)
                    counts[:], seen = 0, 0
                mine, seen = present(normalized(text)), seen + 1
                for c, v in enumerate(labels):
                    counts[(fold * len(categories) + c) * 2 + v, mine] += 1
        yield from parts(counts)

    small_batches(sample.sparkSession)
    schema = "slot bigint, " + ", ".join(f"{n} int" for n in names)
    return sample.select("text", "fold", *categories).mapInArrow(run, schema).groupBy("slot").agg(*[F.sum(n).alias(n) for n in names])


def _choose(counts: DataFrame, sizes: dict[str, int], n_categories: int) -> dict[tuple[int, int], list[int]]:
    """For each category, and the fold left out, the FEATURES slots that tell its documents apart best."""
    chosen = {}
    for c in range(n_categories):
        for out in (-1, *(range(FOLDS) if c + 1 < n_categories else ())):
            used = [f for f in range(FOLDS) if f != out]
            pos, neg = (sum((F.col(f"f{f}_{c}_{v}") for f in used), F.lit(0)).cast("double") for v in (1, 0))
            n1, n0 = (float(max(1, sum(sizes[f"f{f}_{c}_{v}"] for f in used))) for v in (1, 0))
            share = (pos + neg) / (n1 + n0)
            score = F.abs(pos / n1 - neg / n0) / F.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)
            best = counts.where(pos + neg >= LEAST_DOCS).select("slot", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "slot").limit(FEATURES)
            chosen[c, out] = [r["slot"] for r in best.collect()]
    return chosen


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str], sample: int = SAMPLE) -> Chain:
    """A chain over `categories`, in their order: name -> SQL expression over the labels' columns, 0 or 1.

    Rows of labels with a null are left out; of several rows for one doc_id one is taken, the largest. Rows of docs that
    repeat a doc_id are all learned from. Copies of a text go to one fold. Without labelled documents every probability
    is near 0.
    """
    import numpy as np
    import pyarrow as pa

    names = tuple(categories)
    known = labels.select("doc_id", *[F.expr(e).cast("int").alias(c) for c, e in categories.items()]).dropna()
    known = known.groupBy("doc_id").agg(F.max(F.struct(*names)).alias("v")).select("doc_id", "v.*")
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    folded = keep_by_id(clean(docs, "doc_id", "text"), some, "doc_id").withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int"))
    rows = materialize(folded.repartition(max(1, sample // 1000)).withColumn("row", F.monotonically_increasing_id()), "labelled")
    counts = materialize(_counted(rows, names), "slots")
    sizes = {f"f{f}_{c}_{v}": 0 for f in range(FOLDS) for c in range(len(names)) for v in (0, 1)}
    for r in rows.groupBy("fold", *names).count().collect():  # one row for each fold and kind of document
        for c, name in enumerate(names):
            sizes[f"f{r['fold']}_{c}_{r[name]}"] += r["count"]
    chosen = _choose(counts, sizes, len(names))
    among = {s for x in chosen.values() for s in x}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.array(sorted(among), np.int64)
        for batch in batches:
            found = [np.intersect1d(present(normalized(t)), mine, assume_unique=True).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.list_(pa.int64()))], [*batch.schema.names[1:], "slots"])

    described = rows.select("text", "row", "fold", *names).mapInArrow(run, f"row bigint, fold int, {', '.join(f'{n} int' for n in names)}, slots array<bigint>")
    got = sorted(described.collect(), key=lambda r: r["row"])  # numbers only; `sample` rows but for repeated ids
    if not got:
        return Chain(names, [{} for _ in names], [[0.0] * k for k in range(len(names))], [-30.0] * len(names))
    chain = _fit_chain(names, [r["slots"] for r in got], np.array([[r[n] for n in names] for r in got]), np.array([r["fold"] for r in got]), chosen)
    needed = {s for w in chain.weights for s in w}

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sorted(set().union(*(named(normalized(t), needed) for t in batch.column(0).to_pylist())))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int64()), pa.array([g for _, g in found], pa.string())], ["slot", "gram"])

    if needed:
        spelled = rows.select("text").mapInArrow(spell, "slot bigint, gram string").distinct()
        chain.grams = sorted((r["gram"], r["slot"]) for r in spelled.collect())  # the few n-grams of the slots with a weight
    return chain


def predict(docs: DataFrame, chain: Chain) -> DataFrame:
    """All rows and columns of docs, and p_<category> for each category.

    A null, empty or blank text has no n-grams: only the intercepts speak. Repeated rows get equal results. An empty
    table gives no rows.
    """
    import pyarrow as pa

    names = [f"p_{c}" for c in chain.categories]
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        automaton, table = chain.automaton()
        weights = np.array(table)
        for batch in batches:
            p = np.zeros((len(chain.categories), batch.num_rows))
            for r, text in enumerate(batch.column(batch.schema.get_field_index("text")).to_pylist()):
                found = sorted({k for _, k in automaton.iter(normalized(text))}) if automaton else []
                for c, b in enumerate(chain.intercepts):
                    p[c, r] = b + weights[c, found].sum() + sum(w * p[k, r] for k, w in enumerate(chain.earlier[c]))
                    p[c, r] = sigmoid(p[c, r])
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x) for x in p]], [*batch.schema.names, *names])

    kept = docs.drop(*names)
    return kept.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + "".join(f", {n} double" for n in names))


#: The labelled columns as a chain: how bad the text is helps to tell whether it is toxic.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}


def verdicts(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, reject: float = REJECT) -> DataFrame:
    """docs with p_low_quality, p_toxic and rejected (p_toxic at or above `reject`)."""
    return predict(docs, fit(docs, labels, CATEGORIES, sample)).withColumn("rejected", F.col("p_toxic") >= reject)
