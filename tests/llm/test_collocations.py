"""Collocations against counts by hand."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from alnspark.llm import collocations as C


def by_hand(rows, least, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, words[i : i + k]] += 1
    out = []
    for lang in n:
        mine = []
        for (of, p), a in f.items():
            if of != lang or len(p) < 2 or a < least:
                continue
            if any(o == lang and b >= least and len(p) < len(q) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (o, q), b in f.items()):
                continue
            score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            mine.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(mine)[:top])]
    return sorted(out)


def found(df, least, top):
    return sorted(map(tuple, C.mine(df, least, top).collect()))


def texts(seed, n):
    rnd = random.Random(seed)
    words = ["a", "B", "cé", "d|", "the", "THE", "of", "x-y", "日本"]
    return [("".join(rnd.choice(words) + rnd.choice([" ", " ", "\t", "  ", ". ", ",", "\n", "!?"]) for _ in range(rnd.randint(0, 60))), rnd.choice(["en", "de", None, "und"])) for _ in range(n)]


def test_all_phrases_whatever_the_buckets(spark, monkeypatch):
    rows = texts(1, 60) * 2 + [("the of the of the of the of", "en")] * 9
    df = spark.createDataFrame(rows, "text string, lang string")
    assert found(df, 6, 25) == by_hand(rows, 6, 25)
    for name, value in (("FLUSH", 50), ("ROW", 7), ("BUCKET", 100), ("FILTER_BITS", 64)):  # full filter, hot words, parts of pieces
        monkeypatch.setattr(C, name, value)
    assert found(df.repartition(3), 4, 2000) == by_hand(rows, 4, 2000)


def test_word_ids_are_sparks(spark):
    some = [("en", "the"), ("", "x"), ("日", "本語"), ("und", "|")]
    df = spark.createDataFrame(some, "lang string, word string").select(F.xxhash64("lang", "word"))
    assert [r[0] for r in df.collect()] == [C.word_id(w.encode(), lang.encode()) for lang, w in some]


def test_nulls_empties_and_clashing_columns(spark):
    rows = [(None, "en"), ("", None), (" \t.,", "en"), ("a b. A B! a b", None), ("a b", "und")]
    df = spark.createDataFrame(rows, "text string, lang string").withColumns({c: F.lit(1) for c in ("a", "m", "piece", "word", "i1", "F")})
    assert found(df, 2, 10) == by_hand(rows, 2, 10) == [("und", 1, "a b", 4, 4, 4, 8, 1_000_000)]
    assert found(df.limit(0), 2, 10) == []


def test_a_long_text_without_a_stop(spark, monkeypatch):
    monkeypatch.setattr(C, "FLUSH", 1000)
    rows = [(" ".join(random.Random(5).choices(["p", "q", "r", "s"], k=20_000)), "en")]
    assert found(spark.createDataFrame(rows, "text string, lang string"), 30, 2000) == by_hand(rows, 30, 2000)


def test_exact_beyond_64_bits(spark):
    big = 9 * 10**17
    counts = spark.createDataFrame([(1, 2, 0, 0, big), (1, 2, 3, 0, big // 100 * 80), (2, 3, 0, 0, big)], "i1 long, i2 long, i3 long, i4 long, a long")
    words = spark.createDataFrame([(1, "en", big), (2, "en", big + 1), (3, "en", big)], "id long, lang string, f long")
    left = C.without_contained(counts)
    assert {tuple(r)[:4] for r in left.collect()} == {(1, 2, 3, 0)}
    got = C.score_cuts(counts, words, counts).collect()
    assert {(r.i1, r.i2, r.i3): r.score for r in got} == {(1, 2, 0): 2_000_000 * big // (2 * big + 1), (2, 3, 0): 2_000_000 * big // (2 * big + 1), (1, 2, 3): 2_000_000 * (big // 100 * 80) // (2 * big)}
