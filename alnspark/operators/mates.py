"""Templates: mate repair, and reads back to FASTQ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import cigar as C, flags as FL, sequence as Q, tags as T
from .multi import barcode as barcode_field


def fixmate(df: DataFrame, scores: bool = False, template_cigar: bool = False, remove: bool = False) -> DataFrame:
    """Mate fields of the first two primary records of each name, from one window by name.

    Sets PAIRED, mate bits, RNEXT, PNEXT, TLEN from the 5' ends, MQ then MC; `scores`: ms, the mate's sum of good
    qualities; `template_cigar`: ct; `remove`: secondary and unmapped records go.
    """
    primary = ~FL.bit(F.col("flag"), FL.SECONDARY | FL.SUPP)
    w = Window.partitionBy("qname").orderBy(F.col("_primary").desc(), "src", "ordinal")
    length = F.greatest(C.text_reference_length(F.col("cigar")), F.lit(1))
    end = F.col("pos") + length - 1
    five = F.when(FL.bit(F.col("flag"), FL.REVERSE), end).otherwise(F.col("pos") - 1)
    mine = {**{c: F.col(c) for c in ("flag", "tid", "rname", "pos", "mapq", "cigar")}, "five": F.col("_five"), "end": F.col("_end"), "score": F.col("_score")}
    x = df.withColumns({"_primary": primary, "_five": five, "_end": end, "_score": Q.good(df)}).withColumn("_k", F.row_number().over(w))
    first, second = F.col("_primary") & (F.col("_k") == 1) & F.coalesce(F.lead("_primary").over(w), F.lit(False)), F.col("_primary") & (F.col("_k") == 2)
    # a column each, so that those nobody asks for aren't made
    x = x.withColumns({"_first": first, "_second": second, **{f"_next_{c}": F.lead(v).over(w) for c, v in mine.items()}, **{f"_last_{c}": F.lag(v).over(w) for c, v in mine.items()}})
    mate = {c: F.when(F.col("_first"), F.col(f"_next_{c}")).when(F.col("_second"), F.col(f"_last_{c}")) for c in mine}
    mine, mate = ({**of, "cigar": F.coalesce(of["cigar"], F.lit("*"))} for of in (mine, mate))
    has = F.col("_first") | F.col("_second")
    mate_unmapped, unmapped = FL.bit(mate["flag"], FL.UNMAP), FL.bit(F.col("flag"), FL.UNMAP)
    flag = F.col("flag").bitwiseOR(FL.PAIRED).bitwiseAND(~(FL.MUNMAP | FL.MREVERSE))
    flag = flag.bitwiseOR(F.when(mate_unmapped, FL.MUNMAP).otherwise(0)).bitwiseOR(F.when(FL.bit(mate["flag"], FL.REVERSE), FL.MREVERSE).otherwise(0))
    if remove:
        flag = F.when(mate_unmapped, flag.bitwiseAND(~(FL.MREVERSE | FL.PROPER))).otherwise(flag)
    together = ~unmapped & ~mate_unmapped & F.col("tid").isNotNull() & (F.col("tid") == mate["tid"])
    x = x.withColumns({
        "flag": F.when(has, flag).otherwise(F.col("flag")), "mtid": F.when(has, mate["tid"]).otherwise(F.col("mtid")), "rnext": F.when(has, mate["rname"]).otherwise(F.col("rnext")),
        "pnext": F.when(has, mate["pos"]).otherwise(F.col("pnext")), "tlen": F.when(has & together, mate["five"] - mine["five"]).when(has, 0).otherwise(F.col("tlen")),
    })
    drop = F.when(has, F.array_compact(F.array(F.when(mate_unmapped | mate["mapq"].isNull(), F.lit("MQ")), F.when(mate_unmapped & unmapped, F.lit("MC")), *([F.lit("ct")] if template_cigar else []))))
    drop = F.coalesce(drop, F.array().cast("array<string>"))
    x = x.withColumns({"tags": F.map_filter("tags", lambda k, _: ~F.array_contains(drop, k)), "tag_order": F.array_except("tag_order", drop)})
    beside = {"MQ": F.when(~mate_unmapped, mate["mapq"]).cast("string"), "MC": F.when(~(mate_unmapped & unmapped), mate["cigar"]), **({"ms": mate["score"].cast("string")} if scores else {})}
    x = x.withColumns({f"tag_{t}": F.when(has, v).otherwise(F.col(f"tag_{t}")) for t, v in beside.items() if f"tag_{t}" in df.columns})
    x = T.set_tag(x, "MQ", "i", F.when(has & ~mate_unmapped, mate["mapq"]))
    x = T.set_tag(x, "MC", "Z", F.when(has & ~(mate_unmapped & unmapped), mate["cigar"]))
    if template_cigar:
        x = T.set_tag(x, "ct", "Z", F.when(has & together, _template_cigar(mine, mate, F.col("_k"))))
    if scores:
        x = T.set_tag(x, "ms", "i", F.when(has, mate["score"]))
    x = x.select(*df.columns)
    return x.where(~FL.bit(F.col("flag"), FL.UNMAP | FL.SECONDARY)) if remove else x


def _template_cigar(mine: Column, mate: Column, k: Column) -> Column:
    """Segment, strand, CIGAR and gap of both ends; on the left one only."""

    def end(x: Column) -> Column:
        which = F.when(FL.bit(x["flag"], FL.READ1), "1").when(FL.bit(x["flag"], FL.READ2), "2").otherwise("0")
        return F.concat(which, F.when(FL.bit(x["flag"], FL.REVERSE), "R").otherwise("F"), x["cigar"])

    left = (mine["pos"] < mate["pos"]) | ((mine["pos"] == mate["pos"]) & (k == 1))
    return F.when(left, F.concat(end(mine), (mate["pos"] - mine["end"] - 1).cast("string"), F.lit("T"), end(mate)))


def to_fastq(
    df: DataFrame, suffix: bool = False, original: bool = False, default_quality: str = "B", strip: bool = False, strip_tag: str | None = None, umi: list[str] | None = None, casava: bool = False, barcode: str = "BC",
    copy_tags: list[str] | None = None,
) -> DataFrame:
    """qname, part (0 other, 1, 2), route, seq, qual: of each name and part the best record (one with qualities first),
    turned back to the sequenced strand. route: 'pair' if both parts are there, 'single', or 'other'.

    `suffix`: /1 or /2 at the name; `umi`: the first of these tags that is there goes to the name; `original`: qualities
    of OQ where it is there. `strip`: without soft-clipped bases, and without reads of which nothing is left; with
    `strip_tag` CIGAR, bases and qualities of what was clipped are a field of that tag. With `casava`, or with
    `copy_tags` (a list of tags, an empty one for all), there is a column comment: the read's number, filter and barcode
    (its own or the first one of its name), or the tags' fields.
    """
    usable = df.where(~FL.bit(F.col("flag"), FL.SECONDARY | FL.SUPP))
    one, two = FL.bit(F.col("flag"), FL.READ1), FL.bit(F.col("flag"), FL.READ2)
    part = F.when(one & ~two, 1).when(two & ~one, 2).otherwise(0)
    w = Window.partitionBy("qname", "part").orderBy(F.when(F.col("qual").isNotNull(), 0).otherwise(1), "src", "ordinal")
    by_name = Window.partitionBy("qname")
    if casava:
        whole = by_name.orderBy("src", "ordinal").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        usable = usable.withColumn("_first", F.first(F.when(T.value(barcode) != "", T.value(barcode)), ignorenulls=True).over(whole))
    best = usable.withColumn("part", part).withColumn("_k", F.row_number().over(w)).where("_k = 1")
    has = lambda p: F.max((F.col("part") == p).cast("int")).over(by_name) == 1
    rev = FL.bit(F.col("flag"), FL.REVERSE)
    bases, quals = F.col("seq"), F.coalesce(*([T.value("OQ")] if original else []), F.col("qual"), F.repeat(F.lit(default_quality), F.length("seq")))
    ops = C.ops(F.col("cigar"))
    head, tail = C.soft_ends(ops)
    inner = lambda c: F.substr(c, (head + 1).cast("int"), F.greatest(F.length(c) - head - tail, F.lit(0)).cast("int"))
    outer = lambda c: F.concat(F.substr(c, F.lit(1), head.cast("int")), F.substr(c, (F.length(c) - tail + 1).cast("int"), tail.cast("int")))
    turned_seq = lambda c: F.when(rev, Q.reverse_complement(c)).otherwise(c)
    turned = lambda c: F.when(rev, F.reverse(c)).otherwise(c)
    name = F.col("qname")
    if umi:
        found = F.regexp_replace(F.coalesce(*[T.value(t) for t in umi]), "[^A-Za-z]", "+")
        name = F.when(found.isNull(), name).when(name.contains("#"), F.regexp_replace(name, F.lit("#([^#]*)$"), F.concat(F.lit(":"), found, F.lit("#$1")))).otherwise(F.concat(name, F.lit(":"), found))
    if suffix:
        name = F.when(F.col("part") > 0, F.concat(name, F.lit("/"), F.col("part").cast("string"))).otherwise(name)
    comment = []
    if casava:
        own = F.coalesce(barcode_field(T.value(barcode)), F.lit("0"))
        told = F.when(own == "0", F.coalesce(barcode_field(F.col("_first")), F.lit("0"))).otherwise(own)
        comment = [F.concat(F.when(two, "2").otherwise("1"), F.lit(":"), F.when(FL.bit(F.col("flag"), FL.QCFAIL), "Y").otherwise("N"), F.lit(":0:"), told).alias("comment")]
    elif copy_tags is not None:
        wanted = (lambda k: k.isin(*copy_tags)) if copy_tags else (lambda k: F.lit(True))
        backup = strip and strip_tag is not None and (not copy_tags or strip_tag in copy_tags)
        clipped = F.lit(backup) & (head + tail > 0)
        fields = F.transform(F.filter("tag_order", lambda k: wanted(k) & ~(clipped & (k == F.lit(strip_tag or "")))), lambda k: F.concat(k, F.lit(":"), F.element_at("tags", k)["t"], F.lit(":"), F.element_at("tags", k)["v"]))
        saved = F.concat(F.lit(f"{strip_tag}:Z:"), C.format_ops(turned(ops)), F.lit(":"), turned_seq(outer(bases)), F.lit(":"), turned(outer(quals)))
        comment = [F.array_join(F.concat(fields, F.when(clipped, F.array(saved)).otherwise(F.array().cast("array<string>"))), "\t").alias("comment")]
    seq, qual = turned_seq(inner(bases) if strip else bases), turned(inner(quals) if strip else quals)
    out = best.select(name.alias("qname"), "part", F.when(F.col("part") == 0, "other").when(has(1) & has(2), "pair").otherwise("single").alias("route"), seq.alias("seq"), qual.alias("qual"), *comment)
    return out.where("seq <> ''") if strip else out


def fastq_text(reads: DataFrame) -> DataFrame:
    """value: the lines of each read of to_fastq; a comment of fields stands behind a tab, another behind a blank."""
    comment = []
    if "comment" in reads.columns:
        comment = [F.when(F.col("comment") == "", "").otherwise(F.concat(F.when(F.col("comment").rlike("^[12]:[YN]:0:"), " ").otherwise("\t"), "comment"))]
    return reads.select(F.concat(F.lit("@"), "qname", *comment, F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value"))


def fastq_counts(reads: DataFrame) -> DataFrame:
    """route, part, reads: how many reads of to_fastq go to each output."""
    return reads.groupBy("route", "part").agg(F.count("*").alias("reads"))
