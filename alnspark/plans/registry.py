"""Names, queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import derive

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Common table expressions that the twins are written over.
CTES = {
    "reads": derive.READS_SQL,
    "sq": derive.HEADER_SQ_SQL,
    "rgs": derive.HEADER_RG_SQL,
    "bed": derive.BED_SQL,
    "contigs": derive.CONTIGS_SQL,
    "ref": derive.REFERENCE_SQL_DUCKDB,
    "ops": """SELECT ordinal, src, i, CAST(lens[i] AS BIGINT) AS len, kinds[i] AS op FROM (
      SELECT ordinal, src, lens, kinds, unnest(range(1, len(lens) + 1)) AS i FROM (
        SELECT ordinal, src, regexp_extract_all(cigar, '[0-9]+') AS lens, regexp_extract_all(cigar, '[MIDNSHP=X]') AS kinds FROM reads WHERE cigar IS NOT NULL))""",
    "blocks": """SELECT r.*, i, op, len,
        pos - 1 + coalesce(sum(CASE WHEN op IN ('M','D','N','=','X') THEN len ELSE 0 END) OVER w, 0)::BIGINT AS ref0,
        coalesce(sum(CASE WHEN op IN ('M','I','S','=','X') THEN len ELSE 0 END) OVER w, 0)::BIGINT AS query0
      FROM ops JOIN reads r USING (ordinal, src) WINDOW w AS (PARTITION BY ordinal, src ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "lens": """SELECT ordinal, src, sum(CASE WHEN op IN ('M','I','S','=','X') THEN len ELSE 0 END)::BIGINT AS qlen,
        sum(CASE WHEN op IN ('M','D','N','=','X') THEN len ELSE 0 END)::BIGINT AS rlen, sum(CASE WHEN op IN ('M','I','=','X') THEN len ELSE 0 END)::BIGINT AS mlen FROM ops GROUP BY 1, 2""",
    "span": "SELECT r.*, coalesce(qlen, 0) AS qlen, coalesce(rlen, 0) AS rlen, coalesce(mlen, 0) AS mlen, pos - 1 AS start0, pos - 1 + greatest(coalesce(rlen, 0), 1) AS end0 FROM reads r LEFT JOIN lens USING (ordinal, src)",
    "kept": "SELECT * FROM reads WHERE flag & 1796 = 0",
    "base": """SELECT b.*, ref0 + k AS p, query0 + k AS qp, substr(seq, CAST(query0 + k + 1 AS INT), 1) AS base,
        CASE WHEN qual IS NULL THEN 255 ELSE ascii(substr(qual, CAST(query0 + k + 1 AS INT), 1)) - 33 END AS q
      FROM (SELECT *, unnest(range(0, len)) AS k FROM blocks WHERE op = 'M' AND rname IS NOT NULL AND flag & 1796 = 0) b""",
    "depth": """SELECT rname AS chrom, p + 1 AS pos, count(*) AS depth FROM base GROUP BY 1, 2""",
}
_NEEDS = {"blocks": ["ops"], "lens": ["ops"], "span": ["lens"], "base": ["blocks"], "depth": ["base"]}


def with_ctes(sql: str, *names: str) -> str:
    """sql behind the named table expressions and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name in ("ops", "blocks", "lens", "span", "kept", "base") and "reads" not in order:
            order.append("reads")
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in order)
    return f"WITH {head} {sql}" if not sql.lstrip().upper().startswith("WITH ") else f"WITH {head}, {sql.lstrip()[5:]}"


def register(name: str, query: Query, sql: str | None = None, *ctes: str) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = with_ctes(sql, *ctes) if ctes else sql
