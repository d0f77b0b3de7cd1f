"""Repair of the structure of conversations: the cheapest edits that give turns of the form system? (user assistant)*.

A backward pass gives the cost to go for each row and state of the grammar; a forward walk takes the ASCII-least edit of
those that keep to it. Both work on blocks of rows: a block's backward pass is a 4 x 4 matrix (least sums in place of sums of products),
its walk a map of states, so a conversation of any length is folded from its blocks, and no task holds all of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, LongType, StringType, StructField, StructType

from .common import BROADCAST_ROWS, HOT_ROWS, hot_counts, join_salted, materialize

BLANKS = " \t\n\x0b\x0c\r"
#: Rows of a block, on the average.
BLOCK_ROWS = 50_000
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
#: States: nothing yet, after system, after user, after assistant; the state that the next user or assistant turn leads to.
START, STATES = 0, 4
AFTER = (2, 2, 3, 2)
NAMES = {2: "user", 3: "assistant"}
#: What it costs to end from each state, by insertions alone.
FINISH = (0, 4, 2, 0)
FAR = 1 << 50

Costs = tuple[int, ...]


def kept_as(code: str, state: int) -> int | None:
    """The state after a row that is kept; None if it can't be."""
    role = code.lower()
    if role == "s":
        return 1 if state == START else None
    return {"u": 2, "a": 3}.get(role) if AFTER[state] == {"u": 2, "a": 3}.get(role) else None


def options(code: str, state: int) -> list[tuple[str, int, int]]:
    """Letter, cost and state of the edits of one row, in ASCII order; code: x must go, else the role's initial (o for any
    other), a capital for a truncated text."""
    out = [("D", DELETE, state)]
    if code != "x":
        more = int(code.isupper())
        if (to := kept_as(code, state)) is not None:
            out.append(("K", KEEP + more, to))
        out.append(("R", REROLE + more, AFTER[state]))
    return out


@lru_cache(maxsize=100_000)
def step(code: str, after: Costs) -> tuple[Costs, int]:
    """Costs to go before a row from those after it, less their least, and that least."""
    plain = [min(cost + after[to] for _, cost, to in options(code, s)) for s in range(STATES)]
    user, assistant = min(plain[2], plain[3] + INSERT), min(plain[3], plain[2] + INSERT)
    costs = (min(plain[0], user + INSERT), min(plain[1], user + INSERT), user, assistant)
    least = min(costs)
    return tuple(c - least if c < FAR else FAR for c in costs), least


@lru_cache(maxsize=100_000)
def choices(code: str, after: Costs) -> list[tuple[str, int]]:
    """For each state the edits up to and with this row's own, and the state after it."""
    before, least = step(code, after)
    out = []
    for state in range(STATES):
        letters, s = "", state
        while True:
            tight = [(letter, to) for letter, cost, to in options(code, s) if cost + after[to] == before[s] + least]
            if before[AFTER[s]] + INSERT == before[s]:
                tight.append(("I", AFTER[s]))
            if not tight:  # no end can be reached from here
                break
            letter, s = min(tight)
            letters += letter
            if letter != "I":
                break
        out.append((letters, s))
    return out


def matrix(codes: str) -> list[int]:
    """Least cost from each state before the rows (4 by 4, row by row) to each state after them."""
    columns = []
    for end in range(STATES):
        costs, total = tuple(0 if s == end else FAR for s in range(STATES)), 0
        for code in reversed(codes):
            costs, least = step(code, costs)
            total += least
        columns.append([c + total if c < FAR else FAR for c in costs])
    return [columns[end][s] for s in range(STATES) for end in range(STATES)]


def walk(codes: str, end: Costs, last: bool, states: list[int]) -> list[dict]:
    """edits and the state after them, from each of `states`; end: the costs to go after the rows."""
    after = [tuple(c - min(end) for c in end)]
    for code in reversed(codes):
        after.append(step(code, after[-1])[0])
    after = after[-2::-1]
    out = []
    for s in states:
        parts = []
        for code, costs in zip(codes, after):
            letters, s = choices(code, costs)[s]
            parts.append(letters)
        if last:
            parts.append("I" * (FINISH[s] // INSERT))
        out.append({"state": s, "edits": "".join(parts)})
    return out


def fold_ends(matrices: list[list[int]]) -> list[Costs]:
    """Costs to go after each block of a conversation, from the matrices of the blocks in order."""
    costs, out = FINISH, []
    for m in reversed(matrices):
        out.append(costs)
        costs = tuple(min(m[s * STATES + e] + costs[e] for e in range(STATES)) for s in range(STATES))
    return out[::-1]


def _struct(conv: DataType, **columns: DataType) -> StructType:
    return StructType([StructField("conv_id", conv), *[StructField(k, v) for k, v in columns.items()]])


def _map(df: DataFrame, schema: StructType, f: Callable[[dict], dict]) -> DataFrame:
    """A row from each row."""

    def run(batches: Iterator[pa.RecordBatch], fields=tuple(schema.fieldNames())) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [f(r) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in fields} for r in rows], schema=to_arrow)

    to_arrow = to_arrow_schema(schema)
    return df.mapInArrow(run, schema)


def _numbered(turns: DataFrame) -> DataFrame:
    """A written table of conv_id, turn, role, text, id, fault, code. Rows lie in the order of id, which goes up with
    conv_id, turn (nulls first), role and digest of the text; its upper bits number the blocks."""
    spark = turns.sparkSession
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    plain = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"))
    sep = F.lit("\x1f")
    digest = F.md5(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("\x1e")), sep, "role", sep, "text").cast("binary"))
    base = materialize(plain.withColumns({"digest": digest, "uid": F.monotonically_increasing_id()}), "turns")
    # who is the first of those with the same role and text
    place = F.struct(F.col("turn").isNotNull().alias("some"), "turn", "uid")
    counts = materialize(base.groupBy("digest").agg(F.count("*").alias("count"), F.min(place)["uid"].alias("first")).where("count > 1"), "repeated")
    repeated = counts.select("digest", "first")
    if counts.count() <= BROADCAST_ROWS:
        known = base.join(F.broadcast(repeated), "digest", "left")
    else:
        known = join_salted(base, repeated, "digest", hot_counts(counts, "digest", HOT_ROWS), "left")
    end = F.substr(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(-1), F.lit(1))
    fault = F.when(end == "", "blank").when(F.coalesce(F.col("first") != F.col("uid"), F.lit(False)), "duplicate").when(~end.isin(".", "!", "?"), "truncated")
    initial = F.substr("role", F.lit(1), F.lit(1))
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(initial)).otherwise(initial)
    coded = known.withColumn("fault", fault).withColumn("code", code)
    keys = ["conv_id", "turn", "role", "digest", "uid"]
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-base.count() // BLOCK_ROWS))
    in_order = coded.repartitionByRange(blocks, *keys).sortWithinPartitions(*keys)
    return materialize(in_order.select("conv_id", "turn", "role", "text", "fault", "code", F.monotonically_increasing_id().alias("id")), "in_order")


def _edits(rows: DataFrame) -> DataFrame:
    """conv_id, block, edits: the cheapest edits of each run of a conversation within a block."""
    conv = rows.schema["conv_id"].dataType
    block = F.shiftright("id", 33).alias("block")
    in_order = F.array_sort(F.collect_list(F.struct("id", "code")))
    runs = materialize(rows.groupBy("conv_id", block).agg(F.array_join(F.transform(in_order, lambda r: r["code"]), "").alias("codes")), "runs")
    # the conversations that lie in more than one block: one for each border between blocks at most, so all may be sent
    cut = runs.groupBy("conv_id").count().where("count > 1").select(F.col("conv_id").alias("_cut"))
    pieces = runs.join(F.broadcast(cut), F.col("conv_id").eqNullSafe(F.col("_cut")), "left_semi")
    matrices = _map(pieces, _struct(conv, block=LongType(), matrix=ArrayType(LongType())), lambda r: r | {"matrix": matrix(r["codes"])})

    def ends(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        costs = fold_ends(group["matrix"].to_pylist())
        last = [k == len(costs) - 1 for k in range(len(costs))]
        return group.select(["conv_id", "block"]).append_column("end", pa.array(costs, pa.list_(pa.int64()))).append_column("last", pa.array(last))

    def entries(group: pa.Table) -> pa.Table:
        group, state, out = group.sort_by("block"), START, []
        for walked in group["walked"].to_pylist():
            out.append(state)
            state = walked[state]["state"]
        return group.select(["conv_id", "block"]).append_column("entry", pa.array(out, pa.int32()))

    def beside(df: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
        other = found.select(F.col("conv_id").alias("_conv"), F.col("block").alias("_block"), *columns)
        return df.join(F.broadcast(other), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block")), "left").drop("_conv", "_block")

    to_go = materialize(matrices.groupBy("conv_id").applyInArrow(ends, _struct(conv, block=LongType(), end=ArrayType(LongType()), last=BooleanType())), "ends")
    steps = ArrayType(StructType([StructField("state", IntegerType()), StructField("edits", StringType())]))

    def walked(r: dict) -> dict:
        whole = r["end"] is None
        return r | {"walked": walk(r["codes"], FINISH if whole else tuple(r["end"]), whole or r["last"], [START] if whole else list(range(STATES)))}

    found = materialize(_map(beside(runs, to_go, "end", "last"), _struct(conv, block=LongType(), walked=steps), walked), "walked")
    of_cut = found.where(F.size("walked") > 1).select("conv_id", "block", F.transform("walked", lambda w: F.struct(w["state"].alias("state"))).alias("walked"))
    entry = of_cut.groupBy("conv_id").applyInArrow(entries, _struct(conv, block=LongType(), entry=IntegerType()))
    chosen = F.get("walked", F.coalesce("entry", F.lit(START)))
    return beside(found, entry, "entry").select("conv_id", "block", chosen["edits"].alias("edits"))


def repair(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text): one row for each edit, in the order of the repaired conversation. conv_id, turn
    (null for an inserted one), edit (K kept, R role changed, D deleted, I inserted), fault (blank, duplicate, truncated or
    null), old_role, role, text (both null where deleted). All rows of a conversation lie in one partition, together and
    in order.

    Rows are taken by turn, nulls first, ties by role and digest of the text; a null role or text counts as one space; a
    null conv_id is a conversation of its own. A fault is the first that applies: no character but blanks; role and text
    seen earlier in the conversation; last character other than a blank not one of .!? - blank and duplicate rows are deleted. A role that
    begins with none of s, u, a (an empty one too) can't be kept. Other columns are not read; no rows give no rows."""
    rows = _numbered(turns)
    conv = rows.schema["conv_id"].dataType
    block = F.shiftright("id", 33).alias("block")
    none = lambda kind: F.lit(None).cast(kind)
    marks = _edits(rows).select("conv_id", "block", F.lit(0).alias("tag"), none("long").alias("id"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"), none("string").alias("fault"), "edits")
    both = marks.unionByName(rows.select("conv_id", block, F.lit(1).alias("tag"), "id", F.col("turn").cast("long").alias("turn"), "role", "text", "fault", none("string").alias("edits")))
    in_order = both.repartition("conv_id").sortWithinPartitions("conv_id", "block", "tag", "id")
    schema = _struct(conv, turn=LongType(), edit=StringType(), fault=StringType(), old_role=StringType(), role=StringType(), text=StringType())

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A run's edits come before its rows; a run's last rows take what edits are left."""
        conv_id, started, state, edits, at, own = None, False, START, "", 0, 0
        for batch in batches:
            out = []

            def inserted() -> dict:
                return {"conv_id": conv_id, "edit": "I", "role": NAMES[state], "text": ""}

            for r in batch.to_pylist():
                if not r["tag"]:
                    if not started or r["conv_id"] != conv_id:
                        conv_id, started, state = r["conv_id"], True, START
                    edits, at, own = r["edits"], 0, len(r["edits"].rstrip("I"))
                    continue
                while edits[at] == "I":
                    at, state = at + 1, AFTER[state]
                    out.append(inserted())
                edit, at = edits[at], at + 1
                role, text = (None, None) if edit == "D" else (r["role"], r["text"])
                if edit == "R":
                    role = NAMES[AFTER[state]]
                if edit != "D":
                    state = 1 if role[0] == "s" else AFTER[state]
                out.append({"conv_id": conv_id, "turn": r["turn"], "edit": edit, "fault": r["fault"], "old_role": r["role"], "role": role, "text": text})
                while own <= at < len(edits):  # the end of the conversation
                    at, state = at + 1, AFTER[state]
                    out.append(inserted())
            yield pa.RecordBatch.from_pylist(out, schema=to_arrow)

    to_arrow = to_arrow_schema(schema)
    return in_order.mapInArrow(rebuild, schema)


def summaries(repaired: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of `repair`'s
    result, in one pass over its rows as they lie: neither rows nor texts of a conversation are held. The digest is that of the
    repaired role:text, joined by line ends, and so is made in one task for each conversation."""
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = _struct(repaired.schema["conv_id"].dataType, **dict.fromkeys(counts, LongType()), audit=StringType(), repaired_sha256=StringType())
    price = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}

    class Conversation:
        def __init__(self, conv_id):
            self.out = dict.fromkeys(counts, 0) | {"conv_id": conv_id}
            self.audit, self.digest, self.first, self.turns, self.last, self.role = [], hashlib.sha256(), True, 0, None, None
            self.least = None

        def add(self, r: dict) -> None:
            self.audit.append(r["edit"])
            self.out["cost"] += price[r["edit"]]
            if r["edit"] != "D":
                self.out["cost"] += r["fault"] == "truncated"
                self.digest.update((("" if self.first else "\n") + r["role"] + ":" + r["text"]).encode())
                self.first = False
            if r["edit"] == "I":
                return
            if r["fault"]:
                self.out[r["fault"]] += 1
            if self.role is not None:
                self.out["illegal"] += self.role[:1] + r["old_role"][:1] not in ("su", "ua", "au")
            self.role = r["old_role"]
            if r["turn"] is not None and r["turn"] != self.last:  # they go up
                self.least = r["turn"] if self.least is None else self.least
                self.last, self.turns = r["turn"], self.turns + 1

        def row(self) -> dict:
            self.out["gaps"] = 0 if self.least is None else self.last - self.least + 1 - self.turns
            return self.out | {"audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if now is None or r["conv_id"] != now.out["conv_id"]:
                    done += [now.row()] if now else []
                    now = Conversation(r["conv_id"])
                now.add(r)
            yield pa.RecordBatch.from_pylist(done, schema=to_arrow)
        if now:
            yield pa.RecordBatch.from_pylist([now.row()], schema=to_arrow)

    to_arrow = to_arrow_schema(schema)
    return repaired.mapInArrow(run, schema)


def summarize(turns: DataFrame, all_ids: DataFrame) -> DataFrame:
    """`summaries` of the repaired turns, and zeros, an empty audit and the digest of nothing for each other conv_id of all_ids."""
    found = materialize(summaries(repair(turns)), "summaries")
    ids = all_ids.select("conv_id").distinct()
    known = found.select(F.col("conv_id").alias("_known"))
    rest = ids.join(known, F.col("conv_id").eqNullSafe(F.col("_known")), "left_anti")
    zero = F.lit(0).cast("long")
    empty = rest.select("conv_id", *[zero.alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.lit("").alias("audit"), F.lit(hashlib.sha256().hexdigest()).alias("repaired_sha256"))
    return found.unionByName(empty)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults put in by crc32 of conv_id:turn, modulo 20: 0 drops a row, 1 empties its text, 2
    takes its .!? away, 3 repeats it, 4 makes its role user. Nulls count as one space, but for the columns conv_id and
    turn themselves."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")
