"""Turn repair against a search over all edits."""

import hashlib
import heapq
import random

from pyspark.sql import functions as F

from alnspark.llm import turns

NAMES = {2: "user", 3: "assistant"}


def cheapest(rows):
    """counts, cost, audit and digest of rows (turn, role, text) in order: a search by cost, then letters."""
    seen, faults = set(), []
    for _, r, x in rows:
        s = x.strip(turns.BLANKS)
        faults.append("blank" if not s else "duplicate" if (r, x) in seen else None if s[-1] in ".!?" else "truncated")
        seen.add((r, x))
    done, heap = set(), [(0, "", 0, 0, ())]
    while True:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        to = 3 if state == 2 else 2
        moves = [(2, "I", i, to, f"{NAMES[to]}:")]
        if i < len(rows):
            _, r, x = rows[i]
            moves.append((3, "D", i + 1, state, None))
            if faults[i] in (None, "truncated"):
                more = int(faults[i] == "truncated")
                moves.append((2 + more, "R", i + 1, to, f"{NAMES[to]}:{x}"))
                legal = {"s": 1 if state == 0 else None, "u": 2 if to == 2 else None, "a": 3 if to == 3 else None}.get(r[:1])
                if legal:
                    moves.append((more, "K", i + 1, legal, f"{r}:{x}"))
        for c, letter, j, s, line in moves:
            heapq.heappush(heap, (cost + c, audit + letter, j, s, lines if line is None else (*lines, line)))
    known = [t for t, _, _ in rows if t is not None]
    illegal = sum(p[1][:1] + q[1][:1] not in ("su", "ua", "au") for p, q in zip(rows, rows[1:]))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def conversations(n, most, seed):
    rnd = random.Random(seed)
    texts = ["Yes.", "no", "  ", "", "Why?", "a\nb!", "long text"]
    out = []
    for c in range(n):
        for t in range(rnd.randint(0, most)):
            if rnd.random() < 0.85:
                out.append((c if c else None, None if rnd.random() < 0.05 and t == 0 else t, rnd.choice(["system", "user", "user", "assistant", "assistant", "tool", ""]), rnd.choice(texts) + (str(t) + "." if rnd.random() < 0.5 else "")))
    return out


def expected(rows):
    of = {}
    for c, t, r, x in rows:
        of.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    return {c: cheapest(sorted(v, key=lambda r: (r[0] is not None, r[0] or 0))) for c, v in of.items()}


SCHEMA = "conv_id long, turn long, role string, text string"


def found(df, ids):
    return {r[0]: tuple(r)[1:] for r in turns.summarize(df, ids).collect()}


def test_repair_is_the_cheapest_whatever_the_blocks(spark, monkeypatch):
    rows = conversations(30, 25, 1)
    df = spark.createDataFrame(rows, SCHEMA)
    want = expected(rows)
    assert found(df, df) == want
    monkeypatch.setattr(turns, "BLOCK_ROWS", 4)  # conversations lie in up to seven blocks
    assert found(df.repartition(3), df) == want


def test_nulls_empty_tables_and_other_columns(spark):
    rows = [(1, 0, None, "Hi."), (1, 1, "assistant", None), (2, None, "user", "A."), (2, None, "user", "A."), (None, 3, "user", "Q?")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit(1), "edits": F.lit("x"), "Block": F.lit(2)})
    want = expected(rows)
    ids = df.select("conv_id", "text").union(spark.createDataFrame([(9, "gone")], "conv_id long, text string"))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found(df, ids) == want | {9: empty}
    assert found(df.limit(0), df.limit(0)) == {}


def test_repaired_turns_keep_their_texts(spark):
    rows = [(1, 0, "user", "One."), (1, 1, "user", "Two"), (1, 2, "system", "Three.")]
    got = [tuple(r) for r in turns.repair(spark.createDataFrame(rows, SCHEMA)).select("edit", "fault", "role", "text").collect()]
    assert "".join(r[0] for r in got) == cheapest([r[1:] for r in rows])[6]
    roles = [r[2] for r in got if r[0] != "D"]
    assert roles == ["user", "assistant"] * (len(roles) // 2)
    assert {r[3] for r in got if r[0] in "KR"} <= {"One.", "Two", "Three."}


def test_matrices_of_blocks_are_those_of_the_whole():
    rnd = random.Random(3)
    for _ in range(50):
        codes = "".join(rnd.choice("suaoxSUAO") for _ in range(rnd.randint(0, 12)))
        k = rnd.randint(0, len(codes))
        a, b = turns.matrix(codes[:k]), turns.matrix(codes[k:])
        both = [min(min(a[s * 4 + m] + b[m * 4 + e] for m in range(4)), turns.FAR) for s in range(4) for e in range(4)]
        assert both == turns.matrix(codes) or k in (0, len(codes))


def test_damage_by_hand(spark):
    import zlib

    df = spark.createDataFrame([(c, 0, "assistant", "A. B!") for c in range(60)] + [(None, None, None, None)], SCHEMA)
    got = {}
    for r in turns.damage(df).collect():
        got.setdefault(r[0], []).append(tuple(r)[2:])
    for c in [*range(60), None]:
        kind = zlib.crc32((f"{c}:0" if c is not None else " : ").encode()) % 20
        role, text = ("assistant", "A. B!") if c is not None else (" ", " ")
        want = {0: [], 1: [(role, "")], 2: [(role, text.replace(".", "").replace("!", ""))], 3: [(role, text)] * 2, 4: [("user", text)]}.get(kind, [(role, text)])
        assert got.get(c, []) == want
