"""BAM files by place: sorted and written with an index, indexed afterwards, read by region."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources import bai
from . import filters, sorts


def header_lines(header_sq: DataFrame, header_rg: DataFrame | None = None, by: str | None = None, tag: str | None = None, old: str | None = None, programs: list[dict[str, str]] | None = None) -> DataFrame:
    """kind, place, line: the @HD line, which tells the order of sorts.header_line (by, tag; `old`: the line before), @SQ in the order
    of tid, @RG by id, @PG as `programs` has them (see multi.program_chain)."""
    first = sorts.header_line(old, by, tag) if by else old or "@HD\tVN:1.6"
    pairs = lambda kind, columns: F.concat_ws("\t", F.lit(f"@{kind}"), *[F.concat(F.lit(f"{k}:"), F.col(c).cast("string")) for k, c in columns])
    sq = header_sq.select(F.lit(1).alias("kind"), F.lpad(F.col("tid").cast("string"), 12, "0").alias("place"), pairs("SQ", [("SN", "name"), ("LN", "length")]).alias("line"))
    spark = header_sq.sparkSession
    told = ["\t".join(["@PG", *(f"{k}:{v}" for k, v in p.items())]) for p in programs or []]
    out = sq.unionByName(spark.createDataFrame([(0, "", first), *[(3, f"{k:012d}", x) for k, x in enumerate(told)]], "kind int, place string, line string"))
    if header_rg is not None:
        fields = [(c.upper(), c) for c in header_rg.columns]
        out = out.unionByName(header_rg.select(F.lit(2).alias("kind"), F.col("id").alias("place"), pairs("RG", fields).alias("line")))
    return out


def header_text(*tables, **options) -> str:
    """The lines of `header_lines` in order: a header is small."""
    return "\n".join(r["line"] for r in header_lines(*tables, **options).orderBy("kind", "place").collect()) + "\n"


def write_bam(df: DataFrame, path: str, header: str, index: bool = False, mode: str = "overwrite") -> None:
    """A folder of BAM files, one for each partition in order. `index`: with their indices; df must be in order of places."""
    df.write.format("bam").mode(mode).option("header", header).option("index", str(index).lower()).save(path)


def write_sorted(df: DataFrame, path: str, header_sq: DataFrame, header_rg: DataFrame | None = None) -> None:
    """Sorted by place, with an index beside each file and a header that tells the order."""
    ordered = df.orderBy(*sorts.coordinate_keys())
    write_bam(ordered, path, header_text(header_sq, header_rg, by="coordinate"), index=True)


def read_regions(spark: SparkSession, path: str, regions: list[str]) -> DataFrame:
    """The records of BAM files that overlap any region; of files with an index only the blocks that may hold them are read."""
    return filters.by_regions(spark.read.format("bam").option("regions", " ".join(regions)).load(path), regions)


def bin_column(start0: Column, end0: Column) -> Column:
    out = F.lit(0)
    for bits, first in reversed(bai.LEVELS):
        level = F.shiftright(start0, bits)
        out = F.when(level == F.shiftright(end0 - 1, bits), level + first).otherwise(out)
    return out.cast("int")


def _placed(df: DataFrame) -> DataFrame:
    return filters.span(df.where("tid is not null and pos is not null"))


def index_chunks(df: DataFrame) -> DataFrame:
    """src, tid, bin, beg, end: where, by virtual offsets, the records of each bin begin within each block; df as read from BAM."""
    at = F.col("ordinal")
    by = [F.col("src"), F.col("tid"), bin_column(F.col("start0"), F.col("end0")).alias("bin"), F.shiftright(at, 16).alias("_block")]
    return _placed(df).groupBy(*by).agg(F.min(at).alias("beg"), (F.max(at) + 1).alias("end")).drop("_block")


def index_windows(df: DataFrame) -> DataFrame:
    """src, tid, window, offset: the first record that overlaps each window of 16,384 bases."""
    over = F.sequence(F.shiftright("start0", bai.WINDOW), F.shiftright(F.col("end0") - 1, bai.WINDOW))
    return _placed(df).select("src", "tid", F.explode(over).alias("window"), "ordinal").groupBy("src", "tid", "window").agg(F.min("ordinal").alias("offset"))


def write_indices(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes: an index written beside each BAM file of a path, a file in a task. What a task holds of its file is a row
    for each bin and block and for each window. A file whose header doesn't tell that order fails."""
    from ..sources.alignments import _bam_header, bam_header_text, parse_header
    from ..sources.files import file_system, paths_of

    files = paths_of({"path": path}, ".bam")
    for f in files:
        if {"SO": "coordinate"}.items() - dict(*parse_header(bam_header_text(f))["HD"]).items():
            raise ValueError(f"{f}: an index needs records in the order of their places")
    df = spark.read.format("bam").load(path)
    rows = index_chunks(df).select("src", "tid", F.lit(False).alias("is_window"), F.col("bin").cast("long").alias("key"), "beg", "end")
    rows = rows.unionByName(index_windows(df).select("src", "tid", F.lit(True).alias("is_window"), F.col("window").alias("key"), F.col("offset").alias("beg"), F.col("offset").alias("end")))

    def write(key: tuple, group: pa.Table) -> pa.Table:
        chunks: dict = {}
        windows: dict = {}
        for r in group.to_pylist():
            if r["is_window"]:
                windows.setdefault(r["tid"], {})[r["key"]] = r["beg"]
            else:
                chunks.setdefault(r["tid"], {}).setdefault(r["key"], []).append((r["beg"], r["end"]))
        target = files[key[0].as_py()]
        data = bai.encode(len(_bam_header(target)[0]), chunks, windows)
        fs, name = file_system(f"{target}.bai")
        with fs.open_output_stream(name, compression=None) as out:
            out.write(data)
        return pa.table({"path": [target], "bytes": [len(data)]})

    return rows.groupBy("src").applyInArrow(write, "path string, bytes long")
