"""What must not grow with the depth or with the size of a group."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from alnspark.operators import assembly as A, models as M
from alnspark.plans.derive import reads

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_simple_columns_count_by_base(spark):
    df = reads(spark, DATA)
    few = A.columns(df, model=False, qualities=False)
    # a letter with what is inserted behind it: as many as there are, however many qualities
    assert few.where("nth = 0").select(F.max(F.size("seen"))).first()[0] <= 6 * 6
    rows = lambda x: sorted(map(tuple, A.simple(x).collect()))
    assert rows(few) == rows(A.columns(df))


def test_assembly_makes_its_calls_once(spark):
    lines = A.assemble(A.simple(A.columns(reads(spark, DATA), model=False, qualities=False)), chunk=300)
    assert "lineitem" not in plan(lines)


def test_genotype_costs_take_no_record_apart():
    deep = M.genotype_costs(np.zeros(2, int), np.array([0, 1]), np.zeros(2, int), np.array([30, 30]), np.array([3 * 10**12, 10**12]))
    like = M.genotype_costs(np.zeros(2, int), np.array([0, 1]), np.zeros(2, int), np.array([30, 30]), np.array([3000, 1000]))
    assert np.allclose(deep, like)


def test_phase_collects_no_names(spark):
    assert "collect_list(named_struct(qname" not in plan(M.phase(reads(spark, DATA), least_lod=5)).replace("struct(qname", "named_struct(qname").replace("named_named_", "named_")


def test_ranks_need_no_group_in_one_task(spark):
    from alnspark.operators import sorts

    df = spark.range(0, 1000).selectExpr("cast(null as int) as g", "(id * 37) % 1000 as v", "id")
    df = df.unionByName(df.selectExpr("cast(1 as int) as g", "v", "id").where("id < 10"))
    ranked = sorts.rank_within(df, ["g"], [F.col("v")], keep=["g", "v"])
    assert "row_number" not in plan(ranked)
    assert sorted((r.v, r["rank"]) for r in ranked.where("g is null").collect()) == [(k, k + 1) for k in range(1000)]
    some = sorted(r.v for r in df.where("g = 1").collect())
    assert sorted((r.v, r["rank"]) for r in ranked.where("g = 1").collect()) == [(v, k + 1) for k, v in enumerate(some)]


def test_sums_of_groups_beyond_64_bits(spark):
    from alnspark.plans.queries_templates import _by_group

    df = reads(spark, DATA).limit(10).withColumn("ordinal", F.lit(2**63 - 1))
    assert sum(int(r["sum"]) for r in _by_group(df).collect()) == 10 * (2**63 - 1)


def test_barcodes_are_counted_once_each(spark):
    from alnspark.operators import stats as S

    assert "lineitem" not in plan(S.barcode_bases(reads(spark, DATA)))


def test_duplicates_make_their_keys_once(spark):
    from alnspark.operators import dedup

    assert "lineitem" not in plan(dedup.duplicates(reads(spark, DATA)))


def placed(k, name, flag=99):
    tags = {"MC": ("Z", "10M"), "ms": ("i", str(k % 50))}
    return (k, 0, name, flag, 0, "chr1", 100, 60, "10M", 0, "chr1", 300, 210, "ACGTACGTAC", "I" * 10, tags, list(tags))


def joined(df):
    """Rows that the joins of a plan that has run gave, and how many nodes of it are Sorts of records."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        if "QueryStage" in name:
            todo.append(node.plan())
        if "Join" in name and node.metrics().contains("numOutputRows"):
            found.append(node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_optical_compares_no_cell_with_itself(spark):
    from alnspark.operators import dedup
    from alnspark.schema import READS

    rows = [placed(k, f"m:1:f:1:0:{k % 40}:{k % 30}:{k}") for k in range(400)] + [placed(900, "m:1:f:1:0:160:0:x"), placed(901, "m:1:f:1:0:5000:0:y"), placed(902, "m:1:f:1:1:0:0:z")]
    got = dedup.optical(spark.createDataFrame(rows, READS), 150)
    told = {r.ordinal: r.optical for r in got.collect()}
    assert len(told) == 402 and told.get(900, True) and not told.get(901, False) and not told.get(902, False) and all(v for k, v in told.items() if k < 900)
    assert sum(joined(got)) < 10 * len(rows)


def test_places_are_those_of_the_fields(spark):
    from alnspark.operators import dedup

    def field(name):
        c = name.split(":")
        at = {4: 2, 5: 3, 7: 5, 8: 5}.get(len(c))
        number = lambda t: int(t) if t.strip().lstrip("-").isdigit() else None
        digits = lambda t: number(t[: next((i for i, x in enumerate(t) if not x.isdigit()), len(t))])
        return None if at is None else (":".join(c[:at]), number(c[at]), digits(c[at + 1]))

    names = ["a:b:1:2", "a:b:c:12:7x", "m:1:f:1:3:44:55", "m:1:f:1:3:44:55:ACGT", "a:b", "", ":::", "::::::", "a:b:-3:x", "a:b:c:d:e:f", "m:1:f:1:3:44:55:A:B", "é:b:9:8"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", dedup.optical_place(F.col("n")).alias("p")).collect()
    assert {r.n: r.p and tuple(r.p) for r in got} == {n: field(n) for n in names}


def test_chains_look_up_places_once(spark):
    from alnspark.operators import chains

    df = reads(spark, DATA)
    told = plan(chains.chains(df, 200))
    assert "substring_index(qname" not in told and "split(qname" not in told


def test_markdup_leaves_records_by_name(spark):
    from alnspark.operators import dedup, mates

    df = mates.fixmate(reads(spark, DATA), scores=True)
    told = plan(dedup.markdup(df, barcode="BC", groups=True, clear=True, remove=True, supplementary=True)).split("== Physical Plan ==")[1]
    # one exchange of the records, by name, and one of those that stay; the third is that of records without names
    assert told.count("Exchange hashpartitioning(qname") == 3 and told.count("hashpartitioning(src") <= 2


def test_markdup_of_records_without_names(spark):
    from alnspark.operators import dedup
    from alnspark.schema import READS

    rows = [placed(k, None if k % 2 else f"n{k}") for k in range(6)]
    for supplementary in (False, True):
        got = dedup.markdup(spark.createDataFrame(rows, READS), supplementary=supplementary).collect()
        assert sorted((r.ordinal, bool(r.flag & 1024)) for r in got) == [(k, k != 5) for k in range(6)]


def test_clips_of_texts_are_those_of_operations(spark):
    from alnspark.functions import cigar as C

    texts = ["10M", "3S7M", "2H3S4M", "4M1S2H", "5S", "6H", "2H3S", "3S2H", "12S100M3D4N5=6X7I13H", "*", None, "3I4P2M", "1H2M3H"]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    ops, c = C.ops(F.col("c")), F.col("c")
    for r in df.select("c", C.left_clip(ops), C.right_clip(ops), C.reference_length(ops), C.text_left_clip(c), C.text_right_clip(c), C.text_reference_length(c)).collect():
        assert tuple(r[1:4]) == tuple(r[4:]), r.c
