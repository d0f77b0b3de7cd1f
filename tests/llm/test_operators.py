"""Each operator on small tables with nulls, empty, repeated, tied and long texts, against brute force."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from alnspark.llm import bpe, common, fingerprint, langid, neardup, packing, pieces, ppm, quality, queries, sentencepieces, sharding, tokencounts, toxicity

#: Columns of other tables' and the operators' own names, which must do no harm.
EXTRA = (
    "row", "block", "cluster", "bands", "rare", "id", "component", "k", "set_key", "shard", "tier", "version", "shard_rows", "_file", "_arrival", "_metadata", "score", "rejected", "spans",
    "fit", "lang_pred", "piece_ids", "decoded", "p_toxic", "p_low_quality", "_others", "whole", "kept", "label", "count", "salt", "fold", "slots",
)
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in EXTRA)


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "xx", s, len(t or ""), *("?" * len(EXTRA))) for i, t, s in rows], SCHEMA)


def texts(seed=1, n=40):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeéßñ", k=rng.randint(1, 7))) for _ in range(120)]
    return [" ".join(rng.choices(words, k=rng.randint(1, 120))) + rng.choice([".", "!\nNew", " $"]) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    t = texts()
    odd = [None, "", "  \n\t ", "one", "a b c d", "x" * 3000, "dup dup " * 400, "ab▁c  d", "日本語 テスト 😀", "½ ② 12", "<|endoftext|> x<|endoftext|>", "\x00 z", " lead", "trail "]
    near = [" ".join(t[0].split()[:-1] + ["changed"]), t[0], t[0].upper()]
    long = " ".join(t) * 8
    all_ = t + odd + near + [long, long + " more"]
    out = [(k, x, f"h{k % 3}" if k % 5 else None) for k, x in enumerate(all_)]
    return [*out, out[3], (None, "no id here at all", "h0")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return docs_of(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [(0, "x", "h")]).where("doc_id < 0")


def words(t):
    return (t or "").encode().lower().split()


# 1


def brute_quality(t):
    t = t or ""
    w = [x for x in "".join(" " if c in quality.BLANKS else c for c in t).split(" ") if x]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if x.strip(quality.BLANKS)]
    return len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality(docs, rows, empty):
    found = quality.quality(docs).collect()
    assert len(found) == len(rows)
    want = sorted((i is None, i or 0, *brute_quality(t)) for i, t, _ in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == want
    for r in found:
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed and (not failed or not r.kept)
        assert (r.host_rate is None) == (r.host is None)
    assert quality.quality(empty).count() == 0


def test_host_verdicts_shrink_small_hosts(spark):
    good = " ".join(f"w{k}" for k in range(30))
    table = [(k, good, "big") for k in range(60)] + [(100 + k, "bad", "awful") for k in range(40)] + [(200, good, "awful"), (300, "bad", "tiny"), (301, good, "tiny")]
    found = {r.doc_id: r for r in quality.quality(docs_of(spark, table)).collect()}
    assert found[0].kept and not found[200].kept and not found[200].base_failed  # a clean page of a rejected host goes
    assert found[301].kept  # one failure of two condemns no host


# 2


def test_toxicity_learns_and_chains(spark, empty):
    rng = random.Random(3)
    t, labels = [], {"low_quality": [], "toxic": []}
    for k in range(400):
        w = rng.choices([f"word{j}" for j in range(50)], k=60)
        bad, poor = k % 5 == 0, k % 7 == 0
        if bad:
            w[rng.randrange(60)] = rng.choice(["nastyword", "nastyfolk"])
        if poor:
            w = [x + "%%%" for x in w]
        t.append(" ".join(w))
        labels["low_quality"].append(int(poor))
        labels["toxic"].append(int(bad))
    frame = docs_of(spark, [(k, x, None) for k, x in enumerate(t)] + [(999, None, None), (1000, "", None)])
    given = [(k, 1 - labels["low_quality"][k], labels["toxic"][k]) for k in range(300)]
    odd = [(None, 1, 1), (5000, 1, 1), (7, None, 1), given[3]]  # no id, no text, no label, a repeated row
    chain = toxicity.fit(frame, spark.createDataFrame(given + odd, "doc_id bigint, quality int, toxic int"), toxicity.CATEGORIES)
    assert len(chain.earlier[1]) == 1
    found = {r.doc_id: r for r in toxicity.predict(frame, chain).collect()}
    by = {s: [g for g, of in chain.grams if of == s] for _, s in chain.grams}
    for k, x in [*enumerate(t[:60]), (999, None), (1000, "")]:  # the chain by hand: each model gets the probabilities before it
        p = []
        for c in range(2):
            z = chain.intercepts[c] + sum(w for s, w in chain.weights[c].items() if any(g in toxicity.normalized(x) for g in by[s])) + sum(w * q for w, q in zip(chain.earlier[c], p, strict=True))
            p.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
        assert (found[k].p_low_quality, found[k].p_toxic) == pytest.approx(tuple(p), rel=1e-9)
    assert any("sty" in g and not g.startswith(" ") for g, s in chain.grams if chain.weights[1].get(s, 0) > 0)  # from inside of a word
    wrong = sum((found[k].p_toxic >= 0.5) != bool(labels["toxic"][k]) for k in range(300, 400))
    assert wrong <= 2 and len(found) == 402
    assert found[999].p_toxic == found[1000].p_toxic < 0.5 and found[999].rejected == '?'
    assert toxicity.predict(empty, chain).count() == 0
    none = toxicity.fit(frame, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"), toxicity.CATEGORIES)
    assert all(r.p_toxic < 0.5 for r in toxicity.predict(frame, none).collect())


def test_slots_are_named():
    text = toxicity.normalized("Ab abcdefg é日本語x")
    every = set(toxicity.present(text).tolist())
    spelled = toxicity.named(text, every)
    assert {s for s, _ in spelled} == every and all(g in text for _, g in spelled)
    assert {" abcdefg ", "cdef", "bcdefg", " é日本"} <= {g for _, g in spelled}
    assert toxicity.present(toxicity.normalized(None)).size == 0


# 3


def test_sharding(spark, docs, rows, empty):
    table = sharding.shard(docs, common.scratch_path(spark, "t"), arrivals=4, target_bytes=40_000)
    back = table.read()
    assert back.columns == docs.columns and back.exceptAll(docs).count() == 0 and back.count() == len(rows)
    assert len(table.versions()) > 1 and table.read(1).exceptAll(docs).count() == 0  # the version before compaction
    assert table.compact() == table.versions()[-1] == len(table.versions())  # nothing left to merge: no new version
    before = table.shards(table.versions()[-1])
    version = table.append(docs.limit(5))
    assert table.read(version).count() == len(rows) + 5 and table.read(version - 1).count() == len(rows)
    assert {s.path for s in before} <= {s.path for s in table.shards(version)}  # shards don't change
    with pytest.raises(Exception, match="exist"):
        table._commit(version, [])
    for _ in range(4):
        table.append(docs.limit(5))
    table.compact()
    assert table.read().count() == len(rows) + 25
    assert all(2 * s.bytes <= 40_000 or s.tier(40_000, 4) == 0 for s in table.shards(table.versions()[-1]))
    docs.limit(3).write.parquet(f"{table.root}/data/append-{'0' * 32}")  # of a run that died
    files = lambda: {f.name for f in Path(table.root, "data").rglob("*.parquet")}
    listed = lambda v: {s.path.rpartition("/")[2] for s in table.shards(v)}
    newest = table.versions()[-1]
    table.vacuum(keep=2, orphans_after=3600)  # too young
    assert table.versions() == [newest - 1, newest] and len(files() - listed(newest) - listed(newest - 1)) >= 1
    table.vacuum(keep=1, orphans_after=-60)
    assert files() == listed(newest) and table.read().count() == len(rows) + 25
    assert sharding.shard(empty, common.scratch_path(spark, "t")).read().count() == 0


@pytest.mark.parametrize("below", ["data/ckpt", "testdata/ck", "data/append-0/x y"])
def test_sharding_below_any_folder(spark, docs, rows, tmp_path, monkeypatch, below):
    table = sharding.shard(docs, f"{tmp_path}/{below}/shards", arrivals=3, target_bytes=40_000)
    back = table.read()
    assert back.count() == len(rows) and back.exceptAll(docs).count() == 0
    of = table.located().select("shard.*")
    assert of.where("number is null or tier is null or version is null").count() == 0
    assert {r.number: r["count"] for r in of.groupBy("number").count().collect()} == {r.number: r.rows for r in of.distinct().collect()}
    shards = table.shards(table.versions()[-1])
    monkeypatch.setattr(table, "shards", lambda version: shards[:-1])
    monkeypatch.setattr(table, "_read", lambda found: sharding.ShardedTable._read(table, shards))
    with pytest.raises(RuntimeError, match="manifest"):
        table.read()


def test_only_a_tier_is_merged(spark):
    table = sharding.ShardedTable(spark, common.scratch_path(spark, "t"), 40_000)
    tiers = [sharding.Shard(f"s{k}", b, 1) for k, b in enumerate([100] * 3 + [12_000] * 5)]
    merged = []
    table.versions, table.shards = lambda: [1], lambda v: [] if merged else tiers
    table._merge = lambda groups: merged.append(groups) or [sharding.Shard("m", 1, 5)]
    table._publish = lambda change: change(tiers)
    table.compact()
    assert {s.bytes for g in merged[0] for s in g} == {12_000}  # the three small ones wait for a fourth


def test_a_second_writer_is_no_loss(spark, docs):
    table = sharding.ShardedTable(spark, common.scratch_path(spark, "t"))
    table.append(docs.limit(3))
    other, commit = sharding.ShardedTable(spark, table.root), table._commit

    def late(version, shards):
        table._commit = commit
        other.append(docs.limit(2))  # takes the version
        return commit(version, shards)

    table._commit = late
    assert table.append(docs.limit(4)) == 3 and table.read().count() == 9


def test_merge_groups_keep_to_the_target():
    shards = [sharding.Shard(f"s{k}", b, 1) for k, b in enumerate([10, 12, 11, 90, 95, 9])]
    assert [sorted(s.bytes for s in g) for g in sharding.merge_groups(shards, 100)] == [[9, 10, 11, 12]]


# 4 and 10


def brute_segment(text, v):
    n = len(text)
    best, back = [0] + [pieces.LEAST] * n, [None] * (n + 1)
    for i in range(1, n + 1):
        for size in range(min(i, v.longest), 0, -1):
            if (p := v.ids.get(text[i - size : i])) and best[i - size] + p[1] > best[i]:
                best[i], back[i] = best[i - size] + p[1], (size, (p[0],))
        if text[i - 1] not in v.ids:
            ids = v.unknown(text[i - 1])
            if best[i - 1] + len(ids) * v.byte_score > best[i]:
                best[i], back[i] = best[i - 1] + len(ids) * v.byte_score, (1, ids)
    out, at = [], n
    while at:
        size, ids = back[at]
        out[:0] = ids
        at -= size
    return out, best[n]


def test_token_counts(docs, rows, empty):
    v = pieces.vocabulary(pieces.default_model())
    found = sorted(((r.doc_id is None, r.doc_id or 0, r.n_pretokens, r.n_tokens, r.log_score) for r in tokencounts.count_tokens(docs).collect()))
    want = []
    for i, t, _ in rows:
        parts = [brute_segment(" " + w.decode(), v) for w in words(t)]
        want.append((i is None, i or 0, len(parts), sum(len(p[0]) for p in parts), sum(p[1] for p in parts) / pieces.UNIT))
    assert found == sorted(want)
    assert tokencounts.count_tokens(empty).count() == 0


def test_sentencepiece_round_trip(docs, rows, empty):
    v = pieces.vocabulary(pieces.default_model())
    both = sentencepieces.decode(sentencepieces.encode(docs.select("doc_id", "text"))).collect()
    assert len(both) == len(rows)
    for r in both:
        assert r.decoded == r.text
        if r.text and len(r.text) < 4000:
            assert list(r.piece_ids) == brute_segment(" " + r.text, v)[0]
    assert sentencepieces.encode(empty).count() == 0


@pytest.mark.parametrize("text", ["日本語漢字" * 1000, "\n" * 5000, "\n".join(f"word{k % 97}" for k in range(5000)), "，。" * 2500 + "\nend!\n" + "!?" * 2500], ids=["cjk", "newlines", "lines", "marks"])
def test_sentencepiece_of_long_texts_without_blanks(text):
    v = pieces.vocabulary(pieces.default_model())
    e = sentencepieces.Encoder(v)
    for t in (text, text[:301], "a " + text + " b"):
        ids = e.encode(t)
        assert sentencepieces.decode_ids(ids, v) == t
        assert ids == (brute_segment(" " + t, v)[0] if len(t) < 400 else list(e.segment(" " + t)))


# 5


def test_pack_histogram_is_gapless_and_tight():
    rng = random.Random(5)
    counts = Counter(rng.choice([1, 3, 17, 100, 340, 341, 342, 400, 512, 600, 683, 700, 1023, 1024]) for _ in range(5000))
    slots, n = packing.pack_histogram(counts)
    bins = {}
    for length, first, after, base, per, at in slots:
        for rank in range(first, after):
            bins.setdefault(base + (rank - first) // per, []).append((at + (rank - first) % per * length, length))
    assert sum(len(b) for b in bins.values()) == 5000 and len(bins) == n
    for b in bins.values():
        end = 0
        for at, length in sorted(b):
            assert at == end
            end += length
        assert end <= 1024
        assert sum(3 * length > 1024 for _, length in b) <= 2
    assert n <= 1.05 * math.ceil(sum(k * c for k, c in counts.items()) / 1024)  # no packing reaches the bound here
    assert packing.pack_histogram({}) == ([], 0)


def test_packing(spark, docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = packing.pack(docs)
    found = packed.collect()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    for i, t, _ in rows:
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 2]
        mine = [r for r in by[i] if True]
        pieces_ = sorted({(r.piece, r.start, r.length, bytes(r.ids)) for r in mine})
        assert b"".join(p[3] for p in pieces_) == np.array(ids, "<u4").tobytes()
        assert [p[1] for p in pieces_] == list(np.cumsum([0, *(p[2] for p in pieces_)])[:-1])
        assert all(p[2] == 1024 for p in pieces_[1:])
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    assert sum(len(x) for x in whole.values()) == 4 * sum(r.length for r in found) and max(map(len, whole.values())) <= 4096
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "a\n\nb", "a \nb", "it's we'll\tx", "x  y", "\x1c a", "", "\n", "a\nb c", "é ü ñ 😀 日本"])
def test_bpe_chunks_are_exact(text):
    e = bpe.encoder(*bpe.default_vocabulary())
    assert e.ids(text) == e.encode(text)


@pytest.mark.parametrize(
    "text", ["a<|endoftext|>b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "one two  <|endoftext|>  three\n<|endoftext|>\n", "a <|endoftext|", "é<|endoftext|>日本 it's"]
)
def test_bpe_has_the_added_tokens_of_the_tokenizer(spark, text):
    import public_tokenizers
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert bpe.encoder(*bpe.default_vocabulary()).ids(text) == want
    [row] = packing.pack(docs_of(spark, [(1, text, None)])).collect()
    assert bytes(row.ids) == np.array([*want, 2], "<u4").tobytes()


# 6


def brute_winnow(text, k=fingerprint.K, w=fingerprint.W):
    p = [ord(c) for c in text]
    if not p:
        return []
    p += [0] * (k - len(p))
    h = []
    for i in range(len(p) - k + 1):
        x = sum((c + 1) * pow(fingerprint.BASE, -j, 1 << 64) for j, c in enumerate(p[i : i + k])) % (1 << 64)
        x ^= x >> 31
        h.append((x * 0xBF58476D1CE4E5B9 % (1 << 64)) >> 32)
    w, chosen = min(w, len(h)), []
    for i in range(len(h) - w + 1):
        low = min(h[i : i + w])
        at = max(j for j in range(i, i + w) if h[j] == low)
        if not chosen or chosen[-1] != (low, at):
            chosen.append((low, at))
    return chosen


def test_fingerprints(docs, rows, empty):
    short = [t for _, t, _ in rows if t and len(t) < 700][:12]
    for t in [*short, "ab" * 60, ""]:
        h, at = fingerprint.winnow(fingerprint.code_points(t), fingerprint.Roller())
        assert list(zip(h.tolist(), at.tolist(), strict=True)) == brute_winnow(t)
    found = fingerprint.against_edited(docs).collect()
    order = sorted(((-(2**63) if i is None else i), t or "", i) for i, t, _ in rows)
    want = []
    for k, (_, t, i) in enumerate(order):
        n = order[(k + 1) % len(order)][1]
        q = len(t) // 4
        want.append((i is None, i or 0, len(t), t[: len(t) - q] + n[:q]))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars, r.edited) for r in found) == sorted(want)
    hashes = lambda t: {h for h, _ in brute_winnow(t)}
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    digits = lambda t: "".join(f"{h:08x}{at:08x}" for h, at in brute_winnow(t))
    by_edited = {}
    for r in found:
        by_edited.setdefault((r.doc_id, r.edited), r)
    checked = 0
    for k, (_, t, i) in enumerate(order):
        n = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        if max(len(t), len(n)) < 900:
            r = by_edited[i, edited]
            assert (r.fingerprint, r.edited_fingerprint) == (digits(t), digits(edited))
            assert (r.near_edited, r.near_next) == pytest.approx((alike(hashes(t), hashes(edited)), alike(hashes(t), hashes(n))))
            checked += 1
    assert checked > 20
    assert fingerprint.against_edited(empty).count() == 0


def test_in_order_with_many_blocks(spark):
    table = docs_of(spark, [(k * 3, f"text number {k} " * 5, None) for k in range(97)])
    fingerprint.in_order.__defaults__ = (10,)
    try:
        found = {r.doc_id: r.edited for r in fingerprint.against_edited(table).collect()}
    finally:
        fingerprint.in_order.__defaults__ = (fingerprint.BLOCK,)
    for k in range(97):
        t, n = f"text number {k} " * 5, f"text number {(k + 1) % 97} " * 5
        assert found[k * 3] == t[: len(t) - len(t) // 4] + n[: len(t) // 4]


# 7


def test_language_spans(spark, empty):
    rng = random.Random(2)
    alphabet = {"aa": "abcde", "bb": "stuvw", "ru": "абвгд"}
    say = lambda x, n: " ".join("".join(rng.choices(alphabet[x], k=4)) for _ in range(n))
    model = langid.fit_texts([say(x, 50) for x in alphabet for _ in range(20)], [x for x in alphabet for _ in range(20)])
    mixed = say("aa", 30) + ". " + say("bb", 20) + "! " + say("ru", 5)
    table = docs_of(spark, [(0, mixed, None), (1, None, None), (2, "12 34 !!", None), (3, say("bb", 1), None), (4, say("ru", 2000), None)])
    found = {r.doc_id: r for r in langid.identify(table, model).collect()}
    assert found[0].lang_pred == "aa" and [s.lang for s in found[0].spans] == ["aa", "bb", "ru"]
    assert found[0].spans[0].start == 0 and found[0].spans[-1].end == len(mixed) and all(a.end == b.start for a, b in zip(found[0].spans, found[0].spans[1:], strict=False))
    assert found[1].lang_pred == found[2].lang_pred == "und" and found[1].score == 0 and found[1].spans == []
    assert found[3].lang_pred == "bb" and found[4].lang_pred == "ru" and found[4].score == 1
    for t in ("½ ② 12", "², ³", "Ⅷ"):
        assert langid.label_batch([t], langid._Words(model)) == [("und", 0.0, [], 0.0)]
    assert langid.script("Ａｂ") == langid.script("𝐀") == "LATIN" and langid.script("ﻡ") == "ARABIC" and langid.script("日") == "CJK"
    assert langid.pattern("हिन्दी x").findall("हिन्दी ½x𝐀") == ["हिन्दी", "x"] and langid.pattern("x𝐀").findall("½x𝐀") == ["x𝐀"]
    assert langid.identify(empty, model).count() == 0
    sampled = langid.fit(spark.createDataFrame([(k, say(x, 50), x) for k, x in enumerate(alphabet) for _ in range(20)], "doc_id bigint, text string, lang string"))
    assert {r.doc_id: r.lang_pred for r in langid.identify(table, sampled).collect()} == {k: r.lang_pred for k, r in found.items()}
    assert langid.identify(table, langid.fit(empty)).where("lang_pred <> 'und'").count() == 0


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(0)
    scores = rng.normal(size=(50, 3)).astype(np.float32) * 5
    sizes = np.array([7, 1, 4])
    rows_ = rng.integers(0, 50, sizes.sum())
    got, at = langid.viterbi(rows_, sizes, scores, 4.0), 0
    for n in sizes:
        part = scores[rows_[at : at + n]]
        paths = np.array(np.meshgrid(*[range(3)] * n)).reshape(n, -1).T
        value = [sum(part[k, p[k]] for k in range(n)) - 4.0 * (np.diff(p) != 0).sum() for p in paths]
        assert list(got[at : at + n]) == list(paths[int(np.argmax(value))])
        at += n


# 8


def shingle_set(t):
    w = words(t)
    return frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    items = [(i, shingle_set(t)) for i, t in rows]
    label = {i: i for i, _ in items}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, (i, a) in enumerate(items):
        for j, b in items[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b) and root(i) != root(j):
                label[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i, _ in items}


def test_near_duplicates(spark, docs, rows, empty):
    found = neardup.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    want = brute_components([(i, t) for i, t, _ in rows if i is not None])
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert neardup.near_duplicates(empty).count() == 0
    kept = neardup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(want.values()))


def test_near_copies_in_blocks(spark, monkeypatch):
    rng = random.Random(7)
    base = [f"w{k}" for k in range(120)]
    table = []
    for k in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        table.append((1000 - k, " ".join(w), None))
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 1_500)  # several blocks for the one cluster
    monkeypatch.setattr(neardup, "MEMBERS", 20)
    monkeypatch.setattr(common, "HOT_ROWS", 30)
    monkeypatch.setattr(neardup, "HOT_ROWS", 30)
    want = brute_components([(i, t) for i, t, _ in table])
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs_of(spark, table)).collect()} == want
    assert 1 < len(set(want.values())) < 150


def test_rows_of_one_id_are_judged_each(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows_ = [(1, a, None), (2, a, None), (2, b, None), (2, b, None), (2, b.upper(), None), (3, b + " more", None), (4, None, None), (4, "", None), (None, a, None)]
    left = neardup.deduplicate(docs_of(spark, rows_)).collect()
    assert sorted((r.doc_id, r.text or "") for r in left if r.doc_id) == [(1, a), (2, b.upper()), (4, "")]
    assert [r.text for r in left if r.doc_id is None] == [a]


def test_recall_of_the_bands(spark):
    """Pairs at 0.75 and little above, where a pair of sets is missed most often."""
    rng = random.Random(11)
    table = []
    for k in range(150):
        w = [f"p{k}w{j}" for j in range(60)]
        x = list(w)
        x[rng.randrange(56)] = "changed"  # 51 of 61 shingles, or more at the ends
        if k % 2:
            x[-3:] = ["other", "end", "here"]
        table += [(2 * k, " ".join(w), None), (2 * k + 1, " ".join(x), None)]
    want = brute_components([(i, t) for i, t, _ in table])
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs_of(spark, table)).collect()} == want
    assert 75 <= sum(k != v for k, v in want.items())


def test_a_hub_of_a_graph_is_dealt(spark, monkeypatch):
    from alnspark.llm import graph

    monkeypatch.setattr(common, "HOT_ROWS", 20)
    edges = [(k, 500) for k in range(100, 300)] + [(k, k + 1) for k in range(700, 760)] + [(5, 5), (9, 8), (9, 8)]
    found = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**{k: 100 for k in [*range(100, 300), 500]}, **{k: 700 for k in range(700, 761)}, 8: 8, 9: 8}


# 9


def test_ppm(spark, docs, rows, empty, monkeypatch):
    from pyspark.sql import functions as F

    few = [(i, t) for i, t, _ in rows if i is not None and len(t or "") < 1500]
    table = docs.where(F.col("doc_id").isNotNull() & (F.length(F.coalesce("text", F.lit(""))) < 1500))
    out = queries.held_out(7, 2)
    train = [t for i, t in few if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(x for t in train for x in [*words(t), None])
    n, v = sum(c.values()), len(c)
    for hot in (ppm.HOT_WORDS, 40):  # with 40, rare words go through the join
        monkeypatch.setattr(ppm, "HOT_WORDS", hot)
        found = ppm.score(table, ~out, 3).collect()
        assert len(found) == len(few)
        text_of = dict(few)
        for r in found:
            w = [*words(text_of[r.doc_id]), None]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
            assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
    for r in sorted(found, key=lambda r: r.doc_id)[::6]:
        assert r.score == pytest.approx(full_ppm(train, text_of[r.doc_id], 3), rel=1e-9)
    assert ppm.score(empty, ~out).count() == 0
    assert ppm.score(table, F.lit(False)).where("n_known > 0").count() == 0


def test_memo_of_costs_is_exact(spark):
    counts = ppm.count(docs_of(spark, [(k, t, None) for k, t in enumerate(texts(4, 20))]), 4)
    model = ppm.trie(counts, 4)
    window, _ = ppm.windows(texts(5, 10), 4)
    coster = ppm.Coster(model)
    for _ in range(2):
        assert np.allclose(coster(window), model.costs(window))
    every = np.array([(7 << 32) + (101 << 24) + (102 << 16) + (98 << 8) + s for s in range(256)])
    total = 10 ** model.costs(every)
    assert 0.9 < total.sum() < 1.02  # a distribution over what can follow, but for the bytes that no text has


def full_ppm(train, text, order):
    """Code length by the textbook: method D escapes, exclusion, every symbol that was seen, once or more."""
    counts = Counter()
    for t in train:
        b = [ppm.PAD] * order + list((t or "").encode()) + [ppm.END]
        counts.update(tuple(b[i - j : i + 1]) for i in range(order, len(b)) for j in range(order + 1))
    of = {}
    for s, n in counts.items():
        of.setdefault(s[:-1], {})[s[-1]] = n
    total, b = 0.0, [ppm.PAD] * order + list((text or "").encode()) + [ppm.END]
    for i in range(order, len(b)):
        out = set()
        for j in range(order, -1, -1):
            if not (seen := of.get(tuple(b[i - j : i]))):
                continue
            n = sum(seen.values())
            room = 1 - sum((2 * c - 1) / (2 * n) for s, c in seen.items() if s in out)
            if b[i] in seen:
                total += math.log10((2 * seen[b[i]] - 1) / (2 * n) / room)
                break
            total += math.log10(len(seen) / (2 * n) / room)
            out = set(seen)
        else:
            total -= math.log10(max(1, 255 - len(of.get((), ()))))
    return total


@pytest.mark.parametrize("most", [1_500_000, 300, 0])
def test_ppm_is_whole_at_any_size_of_the_trie(spark, monkeypatch, most):
    from pyspark.sql import functions as F

    t = [*texts(8, 14), "", None, "zz ~ qq", "日本語 ~~"]
    monkeypatch.setattr(ppm, "TRIE", most)
    train = [x for k, x in enumerate(t) if k % 3]
    found = {r.doc_id: r.score for r in ppm.score(docs_of(spark, [(k, x, None) for k, x in enumerate(t)]), F.col("doc_id") % 3 != 0, 3).collect()}
    assert len(found) == len(t)
    for k, x in enumerate(t):
        assert found[k] == pytest.approx(full_ppm(train, x, 3), rel=1e-9)


# the pipeline


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs_ = common.documents(spark, d)
    out, sizes = docs_, [docs_.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.materialize(stage(spark, out, d), name)
        assert out.columns == docs_.columns
        sizes.append(out.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 100
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    first = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs_, d).collect()}
    toxic = [i for i, x in labels.items() if x]
    assert sum(i not in first for i in toxic) >= 0.8 * len(toxic)
    assert all(i in first for i, x in labels.items() if not x)
    want = brute_components([(r.doc_id, r.text) for r in docs_.collect()])
    left = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs_, d).collect()}
    assert left == set(want.values())
    assert {r.doc_id for r in corpus_pipeline.run(spark, d).select("doc_id").distinct().collect()} == {r.doc_id for r in out.collect()}


def test_pipeline_keeps_mixed_and_unlearnable_documents(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F

    rng = random.Random(2)
    alphabet = {"aa": "abcde", "bb": "stuvw", "ru": "абвгд"}
    say = lambda x, n: " ".join("".join(rng.choices(alphabet[x], k=4)) for _ in range(n))
    table = [(k, say(x, 50), x) for k, x in enumerate(x for x in alphabet for _ in range(20))]
    odd = [(100, say("aa", 40) + ". " + say("bb", 30) + "! " + say("ru", 30), None), (101, "12 !!", None), (102, None, "aa"), (103, "ωψχ φυτ", None)]
    docs_ = spark.createDataFrame(table + odd, "doc_id bigint, text string, lang string")
    kept = lambda d: {r.doc_id for r in corpus_pipeline.drop_unknown_language(spark, d, "").collect()}
    assert kept(docs_) == {*range(60), 100}
    assert kept(docs_.withColumn("lang", F.lit(None).cast("string"))) == {*range(60), 100, 101, 102, 103}


def test_pipeline_keeps_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline

    t = texts(9, 30)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(20)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows_ = [*((k, x, None) for k, x in enumerate(t)), (100, None, None), (101, "", None), (3, t[3], None), (3, t[4] + " own", None), (None, t[5], None), (102, "long " * 20_000, None)]
    docs_ = docs_of(spark, rows_)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs_, str(tmp_path))
        assert out.schema == docs_.schema or out.columns == docs_.columns
        for r in out.collect():
            assert all(r[c] == "?" for c in EXTRA) and r.lang == "xx"
        nothing = stage(spark, docs_.where("doc_id < 0"), str(tmp_path))
        assert nothing.columns == docs_.columns and nothing.count() == 0
    docs_.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).where("doc_id = 102").count() > 1


def test_queries_name_every_operator():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]
