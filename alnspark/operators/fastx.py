"""Sequence files: dictionaries, indices, stretches, FASTQ import; and SAM text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import flags as FL, sequence as Q
from .intervals import parse_region


def dictionary(fasta: DataFrame, uri: str | None = None, assembly: str | None = None, species: str | None = None) -> DataFrame:
    """name, length, md5 and the @SQ line of each sequence: printable characters only, in capitals."""
    seq = F.upper(F.regexp_replace("seq", "[^!-~]", ""))
    line = F.concat(
        F.lit("@SQ\tSN:"), "name", F.lit("\tLN:"), F.length(seq).cast("string"), F.lit("\tM5:"), F.md5(seq.cast("binary")),
        *[F.lit(f"\t{k}:{v}") for k, v in (("AS", assembly), ("SP", species), ("UR", uri)) if v],
    )
    return fasta.select("name", F.length(seq).cast("bigint").alias("length"), F.md5(seq.cast("binary")).alias("md5"), line.alias("line"))


def index(fasta: DataFrame) -> DataFrame:
    """The index of FASTA files: name, length, offset, linebases, linewidth."""
    return fasta.select("name", "length", "offset", "linebases", "linewidth")


def fetch(fasta: DataFrame, regions: list[str], reverse: bool = False, mark: bool = False) -> DataFrame:
    """region, seq: stretches by region string; `reverse`: of the other strand, `mark`: with /rc at the name."""
    rows = [(k, r, *parse_region(r)) for k, r in enumerate(regions)]
    wanted = fasta.sparkSession.createDataFrame(rows, "k int, region string, chrom string, beg bigint, end bigint")
    cut = F.substr("seq", (F.col("beg") + 1).cast("int"), (F.coalesce("end", F.length("seq").cast("bigint")) - F.col("beg")).cast("int"))
    seq = Q.reverse_complement(cut) if reverse else cut
    found = fasta.join(F.broadcast(wanted), F.col("name") == F.col("chrom"))  # a row for each region that was asked for
    return found.select("k", F.concat("region", F.lit("/rc" if reverse and mark else "")).alias("region"), seq.alias("seq"))


def wrap(seqs: DataFrame, width: int = 60) -> DataFrame:
    """name, line, text: sequences in lines of `width`."""
    starts = F.sequence(F.lit(0), F.greatest(F.expr(f"(length(seq) - 1) div {width}"), F.lit(0)))
    return seqs.select("name", "seq", F.explode(starts.cast("array<int>")).alias("line")).select("name", "line", F.substr("seq", (F.col("line") * width + 1).cast("int"), F.lit(width)).alias("text"))


def import_fastq(fastq: DataFrame, paired: bool = False, interleaved: bool = False, group: str | None = None, umi: bool = False) -> DataFrame:
    """Unmapped reads of FASTQ records. paired: part 0 and 1 are first and second; interleaved: records in turn."""
    second = (F.col("part") % 2 == 1) if paired else (F.col("ordinal") % 2 == 1) if interleaved else F.lit(False)
    both = paired or interleaved
    flag = F.when(second, FL.READ2).otherwise(FL.READ1) + FL.PAIRED + FL.UNMAP + FL.MUNMAP if both else F.lit(FL.UNMAP)
    name = F.regexp_replace("name", "/[12]$", "")
    plain = F.regexp_replace(name, ":[A-Za-z+]+$", "") if umi else name
    entries = [F.when(F.lit(group is not None), F.struct(F.lit("RG").alias("key"), F.struct(F.lit("Z").alias("t"), F.lit(group).alias("v")).alias("value")))]
    if umi:
        found = F.regexp_extract(name, ":([A-Za-z+]+)$", 1)
        entries.append(F.when(found != "", F.struct(F.lit("RX").alias("key"), F.struct(F.lit("Z").alias("t"), found.alias("v")).alias("value"))))
    tags = F.array_compact(F.array(*entries))
    null = lambda kind: F.lit(None).cast(kind)
    ordinal = (F.col("ordinal") * 2 + second.cast("int")) if paired else F.col("ordinal")
    return fastq.select(
        ordinal.cast("bigint").alias("ordinal"), F.lit(0).alias("src"), plain.alias("qname"), flag.cast("int").alias("flag"), null("int").alias("tid"), null("string").alias("rname"), null("bigint").alias("pos"), F.lit(0).alias("mapq"), null("string").alias("cigar"),
        null("int").alias("mtid"), null("string").alias("rnext"), null("bigint").alias("pnext"), F.lit(0).cast("bigint").alias("tlen"), "seq", "qual", F.map_from_entries(tags).alias("tags"), F.transform(tags, lambda e: e["key"]).alias("tag_order"),
    )


def sam_text(df: DataFrame) -> DataFrame:
    """src, ordinal, value: the lines of SAM text, tags in their order."""
    star = lambda c: F.coalesce(c, F.lit("*"))
    rnext = F.when(F.col("rnext").isNull(), "*").when(F.col("rnext") == F.col("rname"), "=").otherwise(F.col("rnext"))
    tags = F.transform("tag_order", lambda k: F.concat(k, F.lit(":"), F.element_at("tags", k)["t"], F.lit(":"), F.element_at("tags", k)["v"]))
    fields = [F.col("qname"), F.col("flag").cast("string"), star(F.col("rname")), F.coalesce("pos", F.lit(0)).cast("string"), F.coalesce("mapq", F.lit(255)).cast("string"), star(F.col("cigar")), rnext, F.coalesce("pnext", F.lit(0)).cast("string"), F.col("tlen").cast("string"), star(F.col("seq")), star(F.col("qual"))]
    return df.select("src", "ordinal", F.concat_ws("\t", *fields, tags).alias("value"))


def write_indexed(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """Parquet in order of coordinates: a region reads only the row groups whose ranges meet it."""
    keys = ["tid", "pos"]
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)
