"""What becomes of each set of duplicates: the record that it goes back to, whether it is an optical one, how many it stands for.

A record with a mate is compared with those of its pair key; one without is compared at its place (the single key), where
it loses to any record with a mate. Of a place with such records the first one, by input, holds it: singles count for that one, and so for the
best of that one's pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.scratch import written
from . import dedup as DD
from .dedup import optical_place

#: Into how many stretches of the input a running minimum is cut, so that a key with very many records isn't one task.
STRETCHES = 64


def _records(df: DataFrame, mode: str, barcode: str | None, groups: bool, include_fails: bool, barcode_pattern: str | None) -> DataFrame:
    """Examined records with pk, sk (their keys), at (their place in the input) and the orders that the best has the least of."""
    k = DD._examined(df, mode, barcode, groups, include_fails, barcode_pattern)
    pair = F.struct("fail", (-(F.col("score") + F.col("ms"))).alias("worth"), "qname", "ordinal", "src")
    single = F.struct(F.lit(False).alias("fail"), (-F.col("score")).alias("worth"), F.lit("").alias("qname"), "ordinal", "src")
    x = k.select("src", "ordinal", "qname", "paired", "fail", "score", "ms", F.struct("ordinal", "src").alias("at"), F.when(F.col("paired"), F.unhex(F.md5(F.to_json("pair_key")))).alias("pk"), F.unhex(F.md5(F.to_json("single_key"))).alias("sk"), F.when(F.col("paired"), pair).otherwise(single).alias("order"))
    return written(x, "records")  # the keys are much work, and several joins read them


def _pairs(x: DataFrame) -> DataFrame:
    """pk, best (order), name, n."""
    return x.where("paired").groupBy("pk").agg(F.min("order").alias("best"), F.count("*").alias("n"))


def _places(x: DataFrame) -> DataFrame:
    """sk, holder (place in the input, pk, order of the first record with a mate, or null), best (order and name of the best
    without one), early (whether one without was there before the holder)."""
    holder = F.struct("at", "pk", "order")
    named = F.struct("order", "qname")
    each = x.groupBy("sk").agg(F.min_by(F.when(F.col("paired"), holder), F.when(F.col("paired"), F.col("at"))).alias("holder"), F.min_by(F.when(~F.col("paired"), named), F.when(~F.col("paired"), F.col("order"))).alias("best"), F.min(F.when(~F.col("paired"), F.col("at"))).alias("_first"), F.count_if(~F.col("paired")).alias("n"))
    return each.withColumn("early", F.coalesce(F.col("_first") < F.col("holder.at"), F.lit(False))).drop("_first")


def chains(df: DataFrame, distance: int | None = None, mode: str = "template", barcode: str | None = None, groups: bool = False, include_fails: bool = False, barcode_pattern: str | None = None) -> DataFrame:
    """src, ordinal, root_src, root_ordinal, origin (the root's name), type of each duplicate: SQ (optical) or LB.

    The root is the record that all of a chain go back to, however often the best changed on the way. With a distance, a
    duplicate is optical if the root, or a duplicate of its chain that beats it, lies on its tile within that distance in x and y. Of two with
    mates the passed one beats the failed one, then the higher score, then the smaller name; one with a mate beats one without.
    Places are dealt into cells of that size, and the best of each is held against those around, so the work grows with the records."""
    x = _records(df, mode, barcode, groups, include_fails, barcode_pattern)
    pairs = _pairs(x).select("pk", "best")
    places = _places(x).select("sk", F.col("holder.pk").alias("_hpk"), F.col("best").alias("_best"))
    roots = places.join(pairs.select(F.col("pk").alias("_hpk"), F.col("best").alias("_pb")), "_hpk", "left")
    name = F.when(F.col("_pb").isNotNull(), F.col("_pb.qname")).otherwise(F.col("_best.qname"))
    of_single = roots.select("sk", F.coalesce("_pb", F.col("_best.order")).alias("root"), name.alias("origin"))
    mine = x.where("paired").join(pairs, "pk").withColumn("root", F.col("best")).withColumn("origin", F.col("best.qname")).drop("best")
    every = mine.unionByName(x.where("not paired").join(of_single, "sk"))
    every = every.withColumns({"root_src": F.col("root.src"), "root_ordinal": F.col("root.ordinal")}).drop("root")
    is_root = (F.col("src") == F.col("root_src")) & (F.col("ordinal") == F.col("root_ordinal"))
    keys = ["src", "ordinal", "root_src", "root_ordinal"]
    twins = every.where(~is_root).select(*keys, "origin", "qname", "paired", "fail", "score", "ms")
    if distance is None:
        return twins.select(*keys, "origin", F.lit("LB").alias("type"))
    near = lambda c, d: F.abs(F.col(c) - F.col(d)) <= distance
    twins = written(twins.withColumns({"_p": optical_place(F.col("qname")), "_r": optical_place(F.col("origin"))}), "twins")  # several jobs read them
    close = (F.col("_p.prefix") == F.col("_r.prefix")) & near("_p.x", "_r.x") & near("_p.y", "_r.y")
    twins = twins.withColumn("_sq", F.coalesce(close, F.lit(False)))
    # of those not near the root: the less the better, with a mate before without, then as above; a chain of one duplicate has no other
    rank = F.struct((~F.col("paired")).alias("p"), "fail", (-(F.col("score") + F.when(F.col("paired"), F.col("ms")).otherwise(0))).alias("worth"), "qname")
    many = twins.groupBy("root_src", "root_ordinal").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    at = twins.where("_p.x is not null and _p.y is not null").join(many, ["root_src", "root_ordinal"], "left_semi")
    at = at.select(*keys, "_sq", rank.alias("rank"), F.col("_p.prefix").alias("tile"), F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))
    cell = lambda c: F.floor(F.col(c) / max(distance, 1))
    at = at.withColumns({"cx": cell("x"), "cy": cell("y")})
    beaten, one = _best_of_cells(at, "_sq")
    other = at.select("root_src", "root_ordinal", "tile", "cx", "cy", F.col("rank").alias("rank2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    meets = near("x", "x2") & near("y", "y2") & (F.col("rank2") < F.col("rank"))
    hit = one.join(other, ["root_src", "root_ordinal", "tile", "cx", "cy"]).where(meets).select("src", "ordinal").distinct().unionByName(beaten).withColumn("_hit", F.lit(True))
    return twins.join(hit, ["src", "ordinal"], "left").select(*keys, "origin", F.when(F.col("_sq") | F.col("_hit"), "SQ").otherwise("LB").alias("type"))


def _best_of_cells(at: DataFrame, settled: str = "_is_root") -> tuple[DataFrame, DataFrame]:
    """Of the duplicates that aren't settled (near their root): src, ordinal of those that another of their chain and cell beats, which is
    near as they share the cell; and the others, the best of each cell, once for each cell that they have to look into."""
    near = F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    at = at.withColumn("_first", F.min("rank").over(Window.partitionBy("root_src", "root_ordinal", "tile", "cx", "cy"))).where(f"not {settled}")
    beaten = at.where(F.col("_first") < F.col("rank")).select("src", "ordinal")
    best = at.where(F.col("_first") == F.col("rank")).withColumn("_c", F.explode(near))
    return beaten, best.select("src", "ordinal", "root_src", "root_ordinal", "rank", "tile", "x", "y", "_c.cx", "_c.cy")


def running_least(rows: DataFrame, key: str, at: str, value: str, stretches: int = STRETCHES) -> DataFrame:
    """rows with least: the least value among the rows of the key up to this one by `at` (a struct with ordinal first). The input is cut into
    stretches; each has its own minimum, and those before it are looked up."""
    cuts = rows.agg(F.percentile_approx(F.col(f"{at}.ordinal"), [k / stretches for k in range(1, stretches)])).first()[0] or []  # a number for each stretch
    stretch = F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda c: c < F.col("_o")))
    x = rows.withColumn("_o", F.col(f"{at}.ordinal")).withColumn("_s", stretch).drop("_o")
    inside = F.min(value).over(Window.partitionBy(key, "_s").orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    before = F.min("_m").over(Window.partitionBy(key).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    ahead = x.groupBy(key, "_s").agg(F.min(value).alias("_m")).select(key, "_s", before.alias("_before"))
    return x.withColumn("_in", inside).join(ahead, [key, "_s"]).withColumn("least", F.least("_in", "_before")).drop("_s", "_in", "_before")


def counts(df: DataFrame, mode: str = "template", barcode: str | None = None, groups: bool = False, include_fails: bool = False, barcode_pattern: str | None = None) -> DataFrame:
    """src, ordinal, n: how many examined records each kept one stands for, itself included.

    Records of a pair key all count. A single counts for the holder of its place if that is the best of its pairs when the single comes, or, for
    those that were there before, when the holder comes; later changes of the best keep what was counted. So the sum
    depends on the order of the input."""
    x = _records(df, mode, barcode, groups, include_fails, barcode_pattern)
    pairs, places = _pairs(x), _places(x)
    held = places.where("holder is not null and n > 0").select("sk", F.col("holder.at").alias("_hat"), F.col("holder.pk").alias("_hpk"), F.col("holder.order").alias("_horder"), "early", "n")
    # what is counted for a holder, and when: those before it as one, each later one by itself
    at_once = held.where("early").select(F.col("_hpk").alias("pk"), F.col("_hat").alias("at"), F.col("_horder").alias("_for"))
    later = x.where("not paired").join(held.select("sk", "_hat", "_hpk", "_horder"), "sk").where(F.col("at") > F.col("_hat")).select(F.col("_hpk").alias("pk"), "at", F.col("_horder").alias("_for"))
    nothing = F.lit(None).cast(x.schema["order"].dataType)
    mine = x.where("paired").join(held.select(F.col("_hpk").alias("pk")).distinct(), "pk", "left_semi")  # no other key has anything to count
    events = mine.select("pk", "at", "order", nothing.alias("_for")).unionByName(at_once.unionByName(later).select("pk", "at", nothing.alias("order"), "_for"))
    # a record comes before what is counted at its own place
    timed = events.withColumn("at", F.struct("at.ordinal", "at.src", F.col("_for").isNotNull().alias("k")))
    good = running_least(timed, "pk", "at", "order").where(F.col("_for").isNotNull() & (F.col("least") == F.col("_for"))).groupBy("pk").agg(F.count("*").alias("_more"))
    of_pairs = pairs.join(good, "pk", "left").select("best.src", "best.ordinal", (F.col("n") + F.coalesce("_more", F.lit(0))).alias("n"))
    of_singles = places.where("holder is null").select("best.order.src", "best.order.ordinal", "n")
    return of_pairs.unionByName(of_singles)
