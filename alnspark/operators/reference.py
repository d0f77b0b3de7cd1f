"""Stretches of reference sequences beside records, by chunks of fixed length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Bases of a chunk, and of all references together up to which they are sent to every executor.
CHUNK, BROADCAST_BASES = 4_096, 64 << 20


def _pieces(reference: DataFrame) -> Column:
    return F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _cut(text: Column, first: Column) -> Column:
    return F.substr(text, (F.col("start0") - first * CHUNK + 1).cast("int"), (F.col("end0") - F.col("start0")).cast("int"))


def with_stretch(df: DataFrame, reference: DataFrame, name: str = "stretch", every: bool = False) -> DataFrame:
    """df (chrom, start0, end0, src, ordinal, ...) with what the reference (name, seq) has there; rows of other references
    go, or with `every` stay without it.

    References of up to BROADCAST_BASES in all are sent to the executors. Larger ones are joined by (chrom, chunk): a
    record meets the chunk it begins in, which brings the next one along, and only records that reach further are put
    together from all their chunks.
    """
    how = "left" if every else "inner"
    first = F.floor(F.col("start0") / CHUNK)
    last = F.floor((F.col("end0") - 1) / CHUNK)
    if (reference.agg(F.sum(F.length("seq"))).first()[0] or 0) <= BROADCAST_BASES:
        cut = reference.select(F.col("name").alias("chrom"), _pieces(reference).alias("_pieces"))
        text = F.array_join(F.slice("_pieces", (first + 1).cast("int"), (last - first + 1).cast("int")), "")
        return df.join(F.broadcast(cut), "chrom", how).withColumn(name, _cut(text, first)).drop("_pieces")
    chunks = reference.select(F.col("name").alias("chrom"), F.posexplode(_pieces(reference)).alias("_chunk", "_piece"))
    after = chunks.select("chrom", (F.col("_chunk") - 1).alias("_chunk"), F.col("_piece").alias("_after"))
    two = chunks.join(after, ["chrom", "_chunk"], "left").withColumn("_piece", F.concat("_piece", F.coalesce("_after", F.lit("")))).drop("_after")
    near = F.coalesce(last - first <= 1, F.lit(True))
    short = df.where(near).withColumn("_chunk", first.cast("int")).join(two, ["chrom", "_chunk"], how).withColumn(name, _cut(F.col("_piece"), first)).drop("_chunk", "_piece")
    long = df.where(~near)
    keys = ["src", "ordinal", "chrom", "start0", "end0"]
    parts = long.select(*keys, F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("_chunk")).join(chunks, ["chrom", "_chunk"])
    whole = parts.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_chunk", "_piece"))), lambda p: p["_piece"]), "").alias("_text"))
    return short.unionByName(long.join(whole, keys, how).withColumn(name, _cut(F.col("_text"), first)).drop("_text"))
