"""Optional tags: map<string, struct<t string, v string>> beside their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

KIND = "map<string,struct<t:string,v:string>>"


def value(name: str, tags: str = "tags") -> Column:
    return F.try_element_at(F.col(tags), F.lit(name))["v"]


def beside(df: DataFrame, *names: str) -> DataFrame:
    """df with the tags' values as plain columns too, which fixmate keeps up and duplicates read: without the map a shuffle carries less."""
    return df.withColumns({f"tag_{n}": value(n) for n in names})


def plain(df: DataFrame, name: str) -> Column:
    """A tag's value, from its plain column where there is one."""
    return F.col(f"tag_{name}") if f"tag_{name}" in df.columns else value(name)


def set_tag(df: DataFrame, name: str, kind: str, v: Column) -> DataFrame:
    """A non-null v is appended as the last tag (an old one of the name goes); with a null v nothing changes."""
    entry = F.create_map(F.lit(name), F.struct(F.lit(kind).alias("t"), v.cast("string").alias("v")))
    others = F.map_filter(F.col("tags"), lambda k, _: k != name)
    order = F.concat(F.filter("tag_order", lambda k: k != name), F.array(F.lit(name)))
    return df.withColumns({"tags": F.when(v.isNotNull(), F.map_concat(others, entry)).otherwise(F.col("tags")), "tag_order": F.when(v.isNotNull(), order).otherwise(F.col("tag_order"))})


def keep_tags(df: DataFrame, keep: list[str] | None = None, remove: list[str] | None = None) -> DataFrame:
    """A list of tags to keep wins over one of tags to remove."""
    if keep is None and not remove:
        return df
    wanted = (lambda k: k.isin(*keep) if keep else F.lit(False)) if keep is not None else (lambda k: ~k.isin(*remove))
    return df.withColumns({"tags": F.map_filter("tags", lambda k, _: wanted(k)), "tag_order": F.filter("tag_order", wanted)})
