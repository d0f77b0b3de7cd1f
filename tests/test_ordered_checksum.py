"""Checksums that depend on the order, against a pass over the records one after the other."""

import zlib

from pyspark.sql import functions as F

from alnspark.operators import checksum as K

from .test_fixtures import sam


def one_by_one(df, in_order):
    out, counts = {}, {}
    for r in sorted(K.record_factors(df, crcs=True).collect(), key=lambda r: (r.src, r.ordinal)):
        number = {"group": counts.get(("group", r.group), 0)}
        number["all"] = number["group"] if in_order == 1 else counts.get(("all", None), 0)
        for scope in (("group", r.group), ("all", None), ("fail" if r.failed else "pass", None)):
            crc = zlib.crc32(number["group" if scope[0] == "group" else "all"].to_bytes(8, "little"))
            row = out.setdefault(scope, dict.fromkeys(K.FIELDS, 1))
            for f in K.FIELDS:
                c = (r[f] ^ crc) & K.PRIME
                row[f] = row[f] * (1 if c in (0, K.PRIME) else c) % K.PRIME
            counts[scope] = counts.get(scope, 0) + 1
    return {k: (counts[k], *v.values()) for k, v in out.items()}


def found(df, in_order):
    return {(r.scope, r.group): (r.n, r.seq, r.name, r.qual, r.aux) for r in K.checksum(df, in_order=in_order).collect()}


def test_order_and_partitions(spark):
    rows = [f"r{k} {[0, 16, 512][k % 3]} chr1 {k + 1} 60 4M * 0 0 {'ACGT'[k % 4] * 4} IIII" + (f" RG:Z:g{k % 2}" if k % 5 else "") for k in range(60)]
    df = sam(spark, *rows)
    swapped = df.withColumn("ordinal", F.when(F.col("ordinal") == 7, 9).when(F.col("ordinal") == 9, 7).otherwise(F.col("ordinal")))
    for in_order in (1, 2):
        want = one_by_one(df, in_order)
        for parts in (1, 7, 64):
            assert found(df.repartition(parts), in_order) == want
        assert found(swapped, in_order)["all", None] != want["all", None]
    assert found(df, 0) == found(swapped, 0)
    assert found(df.limit(0), 1) == {}
