"""The read record. Coordinates: pos is 1-based as in SAM text; all intervals are 0-based and half-open."""

READS = (
    "ordinal bigint, src int, qname string, flag int, tid int, rname string, pos bigint, mapq int, cigar string, "
    "mtid int, rnext string, pnext bigint, tlen bigint, seq string, qual string, "
    "tags map<string,struct<t:string,v:string>>, tag_order array<string>"
)
CORE = ["ordinal", "src", "qname", "flag", "tid", "rname", "pos", "mapq", "cigar", "mtid", "rnext", "pnext", "tlen", "seq", "qual"]
HEADER_SQ = "tid int, name string, length bigint"
BED = "chrom string, start0 bigint, end0 bigint"
