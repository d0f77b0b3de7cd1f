"""One-pass counts: flagstat, idxstats, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import flags as FL


def _categories() -> dict[str, Column]:
    flag = F.col("flag")
    b = lambda m: FL.bit(flag, m)
    secondary, supp = b(FL.SECONDARY), ~b(FL.SECONDARY) & b(FL.SUPP)
    primary = ~b(FL.SECONDARY) & ~b(FL.SUPP)
    paired, mapped = primary & b(FL.PAIRED), ~b(FL.UNMAP)
    both = paired & mapped & ~b(FL.MUNMAP)
    elsewhere = both & F.col("tid").isNotNull() & F.col("mtid").isNotNull() & (F.col("tid") != F.col("mtid"))
    return {
        "total": F.lit(True), "primary": primary, "secondary": secondary, "supplementary": supp, "duplicates": b(FL.DUP), "primary duplicates": primary & b(FL.DUP),
        "mapped": mapped, "primary mapped": primary & mapped, "paired in sequencing": paired, "read1": paired & b(FL.READ1), "read2": paired & b(FL.READ2),
        "properly paired": paired & b(FL.PROPER) & mapped, "with itself and mate mapped": both, "singletons": paired & mapped & b(FL.MUNMAP),
        "with mate mapped to a different chr": elsewhere, "with mate mapped to a different chr (mapQ>=5)": elsewhere & (F.coalesce("mapq", F.lit(0)) >= 5),
    }


def flagstat(df: DataFrame) -> DataFrame:
    """category, passed, failed: sixteen counts, by whether the record failed quality control. One aggregate."""
    fail = FL.bit(F.col("flag"), FL.QCFAIL)
    cats = _categories()
    sums = [F.count_if(F.coalesce(c, F.lit(False)) & (fail if f else ~fail)).alias(f"_{k}_{f}") for k, c in enumerate(cats.values()) for f in (0, 1)]
    rows = ", ".join(f"'{name}', `_{k}_0`, `_{k}_1`" for k, name in enumerate(cats))
    return df.agg(*sums).selectExpr(f"stack({len(cats)}, {rows}) as (category, passed, failed)")


def percent(part: Column, whole: Column) -> Column:
    """Two decimals of a single-precision ratio, or N/A."""
    return F.when(whole > 0, F.format_string("%.2f%%", (part.cast("float") / whole.cast("float") * 100).cast("double"))).otherwise("N/A")


def flagstat_percent(df: DataFrame) -> DataFrame:
    """Of the counts that have one: category and the percentage of passed records."""
    f = flagstat(df)
    whole = F.when(F.col("category").isin("primary mapped"), "primary").when(F.col("category").isin("properly paired", "singletons"), "paired in sequencing").when(F.col("category") == "mapped", "total")
    base = f.select(F.col("category").alias("_whole"), F.col("passed").alias("_n"))
    return f.withColumn("_of", whole).join(F.broadcast(base), F.col("_of") == F.col("_whole")).select("category", percent(F.col("passed"), F.col("_n")).alias("percent"))


def idxstats(df: DataFrame, header_sq: DataFrame) -> DataFrame:
    """name, length, mapped, unmapped of each reference, and of '*' what has no place."""
    unmapped = FL.bit(F.col("flag"), FL.UNMAP)
    counts = df.groupBy(F.coalesce("rname", F.lit("*")).alias("name")).agg(F.count_if(~unmapped).alias("m"), F.count_if(unmapped).alias("u"))
    # mapped records without a reference are ignored; the row of '*' is there in any case
    names = header_sq.select("name", "length").union(header_sq.sparkSession.range(1).select(F.lit("*"), F.lit(0).cast("bigint")))
    return names.join(counts, "name", "left").select("name", "length", F.when(F.col("name") == "*", 0).otherwise(F.coalesce("m", F.lit(0))).cast("bigint").alias("mapped"), F.coalesce("u", F.lit(0)).alias("unmapped"))


def samples(header_rg: DataFrame) -> DataFrame:
    """Distinct sample names; '.' if there are none."""
    return header_rg.select(F.coalesce("sm", F.lit(".")).alias("sample")).distinct()


def name_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("qname").count()
