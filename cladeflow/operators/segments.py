"""Record sets: grouping by query and splitting into disjoint segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.functions import glob_id

#: Ordinals of one span, in which rows are followed in order, and spans of one higher span.
SPAN = 1 << 16
#: Levels of spans: three leave 2^15 of 2^63 ordinals, however few rows a span has.
LEVELS = 3


def span_levels(spans: DataFrame) -> list[DataFrame]:
    """Spans, and those that they lie in, up to few: what changes within each, and in all but the last what changes before it
    within the next higher one. Needs _span, first, last (queries) and changes."""
    out = [spans]
    while len(out) < LEVELS:
        s = out[-1].withColumn("_up", F.floor(F.col("_span") / SPAN))
        w = Window.partitionBy("_up").orderBy("_span")
        s = s.withColumn("_begins", F.coalesce(F.col("first") != F.lag("last").over(w), F.lit(False)).cast("int"))
        s = s.withColumn("_before", F.sum(F.col("_begins") + F.col("changes")).over(w) - F.col("changes"))
        up = s.groupBy(F.col("_up").alias("_span")).agg(F.min_by("first", "_span").alias("first"), F.max_by("last", "_span").alias("last"), F.sum(F.col("_begins") + F.col("changes")).alias("changes"))
        out[-1:] = [s, up]
    return out


def changes_before(spans: DataFrame) -> DataFrame:
    """_span, _before: the number of the group that a span starts with. Only the highest spans are ordered in one task."""
    *lower, top = span_levels(spans)
    w = Window.orderBy("_span")
    begins = F.coalesce(F.col("first") != F.lag("last").over(w), F.lit(True)).cast("int")
    out = top.withColumn("_begins", begins).select("_span", (F.sum(F.col("_begins") + F.col("changes")).over(w) - F.col("changes")).alias("_before"))
    for s in reversed(lower):
        out = s.join(out.select(F.col("_span").alias("_up"), F.col("_before").alias("_above")), "_up").select("_span", (F.col("_above") + F.col("_before")).alias("_before"))
    return out


def segment(df: DataFrame, split: bool = True, presorted: bool = False, consecutive: bool = False) -> DataFrame:
    """Add group_no and segment_no. A segment ends where the next row starts beyond all stops so far.

    consecutive starts a new group whenever the query changes in input order: the order is followed within spans of
    ordinals, one row for each span within spans of these, and so on. By default a query is one group and everything stays within it."""
    if consecutive:
        df = df.withColumn("_span", F.floor(F.col("ordinal") / SPAN))
        w = Window.partitionBy("_span").orderBy("ordinal")
        new = F.coalesce(F.col("query_id") != F.lag("query_id").over(w), F.lit(False)).cast("int")
        df = df.withColumn("_new", new).withColumn("_in", F.sum("_new").over(w))
        spans = df.groupBy("_span").agg(F.min_by("query_id", "ordinal").alias("first"), F.max_by("query_id", "ordinal").alias("last"), F.max("_in").alias("changes"))
        df = df.join(changes_before(spans), "_span").withColumn("group_no", F.col("_before") + F.col("_in")).drop("_span", "_new", "_in", "_before")
    else:
        df = df.withColumn("group_no", F.lit(1).cast("long"))
    if not split:
        return df.withColumn("segment_no", F.lit(1).cast("long"))
    order = ["ordinal"] if presorted else ["query_start", "query_stop", "ordinal"]
    w = Window.partitionBy("query_id", "group_no").orderBy(*order)
    before = F.max("query_stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("query_start") > before, F.lit(True)).cast("long")
    return df.withColumn("_new", new).withColumn("segment_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def query_range(df: DataFrame, keys: list[str]) -> DataFrame:
    """First start and last stop of the unmasked rows of each record set."""
    return df.where("not masked").groupBy(*keys).agg(F.min("query_start").alias("range_start"), F.max("query_stop").alias("range_stop"))


def glob_groups(df: DataFrame, regex: str = "(.+)") -> DataFrame:
    return df.withColumn("bin_id", glob_id(F.col("query_id"), regex))
