"""Quality rules at host level, DataFrame functions only.

Each document is judged by rules on its own text. The failures are counted by host, each host's failure rate is
shrunk towards the corpus by an empirical beta prior (so that a host with three pages is not condemned by two of
them), and hosts whose shrunk rate is too high take their remaining documents with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import WORD, materialize

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5

#: Words in windows that occur twice or more. `w` is the array of words. A cheap distinct count decides for most
#: texts; only texts that do repeat a window sort their windows.
_REPEATS = f"""
transform(array(h), h -> if(size(h) = size(array_distinct(h)), 0L,
  transform(array(array_sort(transform(h, (x, i) -> struct(x AS x, i AS i)))), s ->
    aggregate(
      array_sort(filter(
        transform(s, (e, j) -> if(coalesce(get(s, j - 1).x = e.x, false) OR coalesce(get(s, j + 1).x = e.x, false), e.i, -1)),
        v -> v >= 0)),
      struct(-{WINDOW} AS at, 0L AS n),
      (a, v) -> struct(v AS at, a.n + least({WINDOW}, v - a.at) AS n),
      a -> a.n))[0]))[0]
"""


def text_metrics(text: Column) -> dict[str, Column]:
    """Plain counts of one text; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    return {
        "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "_lines": lines,
        "_words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
    }


def document_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per input row: doc_id, host, the counts and base_failed. No shuffle."""
    return (
        docs.select("doc_id", F.col(host).alias("host"), *[c.alias(k) for k, c in text_metrics(F.col("text")).items()])
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn(
            "h",
            F.when(
                F.col("n_words") >= WINDOW,
                F.expr(f"transform(sequence(1, size(_words) - {WINDOW - 1}), i -> xxhash64(slice(_words, i, {WINDOW})))"),
            ).otherwise(F.expr("cast(array() as array<bigint>)")),
        )
        .withColumn("n_repeat_words", F.expr(_REPEATS))
        .select(
            "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        )
    )


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """alpha and beta by the method of moments over the hosts' rates (n documents, k failures each). The spread
    that sampling alone explains is taken off; without any left the prior is strong."""
    row = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("*").alias("hosts"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk")).first()
    if not row["n"]:
        return 0.5, 0.5
    mean = min(max(row["k"] / row["n"], 1e-6), 1 - 1e-6)
    spread = row["kk"] / row["n"] - (row["k"] / row["n"]) ** 2
    between = spread - mean * (1 - mean) * row["hosts"] / row["n"]
    strength = min(max(mean * (1 - mean) / between - 1, 1.0), 1000.0) if between > 0 else 1000.0
    return mean * strength, (1 - mean) * strength


def host_verdicts(rules: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """One row per host: host, n, k, host_rate (shrunk) and host_rejected. Counting combines on the map side,
    so a host with a third of all rows costs no more than any other."""
    hosts = materialize(rules.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("k")), "hosts")
    alpha, beta = beta_prior(hosts)
    rate = (F.col("k") + F.lit(alpha)) / (F.col("n") + F.lit(alpha + beta))
    return hosts.withColumn("host_rate", rate).withColumn("host_rejected", rate > max_rate)


def quality(docs: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """The rules and the host's verdict for every row of docs.

    Returns doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    host_rate. Null text: all counts 0, fails. Null host: host_rate null, judged by its own text alone. Repeated
    rows are judged and counted each. An empty table gives no rows. Columns other than doc_id, text and the host's
    are ignored.
    """
    rules = materialize(document_rules(docs, host), "rules")
    verdicts = host_verdicts(rules, max_rate).select("host", "host_rate", "host_rejected")
    return rules.join(verdicts, "host", "left").select(
        *[c for c in rules.columns], (~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False))).alias("kept"), "host_rate"
    )
