"""Segment predictions of the common-ancestor family, and ranges with their text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeflow.operators import filters, rpa
from cladeflow.plans.taxonomy import Taxonomy, classified, lcc_fold
from cladeflow.runtime import sent

KEYS = ["query_id", "group_no", "segment_no"]


def dummy(df: DataFrame, root: str = "1", keys: list[str] = KEYS) -> DataFrame:
    """The root without support over the whole query."""
    g = df.groupBy(*keys).agg(F.max("query_length").alias("seqlen"))
    return g.select(*keys, "seqlen", F.lit(1).cast("long").alias("feature_begin"), F.col("seqlen").alias("feature_end"), F.lit(root).alias("taxid"), F.lit(0).cast("long").alias("support"), F.lit(root).alias("rtax"))


def simple_lca(df: DataFrame, root: str = "1", keys: list[str] = KEYS, enough: Column | None = None, concept: bool = False, path: bool = False) -> DataFrame:
    """The common ancestor of the unmasked rows' taxa; rtax is that of the best-scored, or the node itself if those are all taxa.

    Needs `lineage`; path adds the node's own. Least and greatest lineages by the record set, no collected lists (but for the
    concept variant); rows that are dealt by query stay where they are. An ancestor of all taxa is one of the best-scored if
    those are all, so only concepts, which differ there, compare the sets."""
    if enough is not None:
        df = df.withColumn("masked", F.col("masked") | ~enough)
    best = filters.group(keys)
    df = df.withColumn("_best", F.max(filters.open_score()).over(best))
    every = F.when(~F.col("masked"), F.col("lineage"))
    top = F.when(~F.col("masked") & (F.col("score") == F.col("_best")), F.col("lineage"))
    ends = [F.min(every).alias("_a"), F.max(every).alias("_z"), F.min(top).alias("_ta"), F.max(top).alias("_tz")]
    if concept:
        ends += [F.collect_set(every).alias("_all"), F.collect_set(top).alias("_tops")]
    g = df.groupBy(*keys).agg(
        F.max("query_length").alias("seqlen"),
        F.min(F.when(~F.col("masked"), F.col("query_start"))).alias("_b"), F.max(F.when(~F.col("masked"), F.col("query_stop"))).alias("_e"),
        *ends,
    )
    from cladeflow.functions import common_prefix

    node = lcc_fold(F.col("_all")) if concept else common_prefix(F.col("_a"), F.col("_z"))
    best_node = F.element_at(common_prefix(F.col("_ta"), F.col("_tz")), -1)
    none = F.col("_a").isNull()
    taxid = F.when(none, F.lit(root)).otherwise(F.element_at(node, -1))
    return g.select(
        *keys, "seqlen",
        F.when(none, F.lit(1).cast("long")).otherwise(F.col("_b")).alias("feature_begin"),
        F.when(none, F.col("seqlen")).otherwise(F.col("_e")).alias("feature_end"),
        taxid.alias("taxid"),
        F.when(none, F.lit(0).cast("long")).otherwise(F.col("_e") - F.col("_b") + 1).alias("support"),
        F.when(none, F.lit(root)).otherwise(F.when(F.size("_all") == F.size("_tops"), taxid).otherwise(best_node) if concept else best_node).alias("rtax"),
        *([F.when(none, F.array(F.lit(root))).otherwise(node).alias("lineage")] if path else []),
    )


def megan_lca(df: DataFrame, root: str = "1", keys: list[str] = KEYS, top: float = 0.05, min_score: float = 0.0, least_support: int = 1, max_evalue: float = 1000.0, ignore_unclassified: bool = False, support: str = "running_max") -> DataFrame:
    df = filters.score_evalue_top(df, min_score, max_evalue, top, keys, support)
    if ignore_unclassified:
        df = filters.unclassified(df)
    return simple_lca(df, root, keys, enough=F.col("support") >= least_support)


def ic_megan_lca(df: DataFrame, root: str = "1", keys: list[str] = KEYS, **kw) -> DataFrame:
    """As documented: unclassified nodes count as their first classified ancestor, and the lowest common concept is taken.

    (megan_lca is what the option of this name is bound to elsewhere.)"""
    top, least = kw.pop("top", 0.05), kw.pop("least_support", 1)
    df = filters.score_evalue_top(df, kw.pop("min_score", 0.0), kw.pop("max_evalue", 1000.0), top, keys)
    df = df.withColumn("lineage", classified(F.col("lineage"), F.col("names")))
    return simple_lca(df, root, keys, enough=F.col("support") >= least, concept=True)


def n_best_lca(df: DataFrame, n: int = 1, root: str = "1", keys: list[str] = KEYS) -> DataFrame:
    return simple_lca(filters.n_best(df, n, keys), root, keys)


def predict(df: DataFrame, tax: Taxonomy, method: str = "rpa", **kw) -> DataFrame:
    """Resolve `taxid` and predict every segment. rpa takes queries and references, and gives ranges; point_ranges() makes
    ranges of the others' nodes."""
    df = tax.resolve(df, "taxid")
    methods = {"dummy": dummy, "simple-lca": simple_lca, "megan-lca": megan_lca, "ic-megan-lca": megan_lca, "n-best-lca": n_best_lca, "rpa": rpa.place}
    if method not in methods:
        raise ValueError(f"no prediction method {method!r}: one of {', '.join(methods)}")
    return methods[method](df, **kw)


def point_ranges(df: DataFrame, tax: Taxonomy) -> DataFrame:
    """Predicted nodes as ranges of one node: lower_lineage, upper_depth and a support array."""
    n = tax.nodes.select("taxid", F.col("lineage").alias("lower_lineage"), F.col("depth").alias("upper_depth"))
    return df.join(n, "taxid").withColumns({"support": F.array("support"), "ival": F.lit(1.0)})


# ranges: lower_lineage, upper_depth, support array from the upper to the lower node


def constant_range(n: Column, support: Column) -> Column:
    return F.array_repeat(support, n)


def prune_lower(support: Column) -> Column:
    """A range without its lower node."""
    return F.slice(support, F.lit(1), F.size(support) - 1)


def set_support(support: Column, at: Column, value: Column) -> Column:
    return F.transform(support, lambda x, i: F.when(i == at, value).otherwise(x))


def encode_tax(lineage: Column, upper_depth: Column, support: Column) -> Column:
    """From the lower node up, a node with its support where that changes; the upper node ends the text."""
    path = F.slice(lineage, upper_depth + 1, F.size(support))
    down = F.reverse(F.arrays_zip(path.alias("t"), support.alias("s")))
    told = F.filter(F.transform(down, lambda x, i: F.when(x["s"] != F.coalesce(F.when(i > 0, F.get(down, i - 1)["s"]), F.lit(0)), F.concat(x["t"], F.lit(":"), x["s"].cast("string")))), lambda x: x.isNotNull())
    upper = F.get(lineage, upper_depth)
    text = F.array_join(told, "-")
    last = F.element_at(down, -1)
    ends = F.element_at(told, -1).startswith(F.concat(upper, F.lit(":")))
    return F.when(F.size(told) == 0, upper).when(ends, text).otherwise(F.concat(text, F.lit("-"), last["t"]))


def decode_tax(df: DataFrame, tax: Taxonomy, col: str = "tax", width: str = "width") -> DataFrame:
    """lower_lineage, upper_depth and support of a tax text: a first support left out is the feature's width, later ones repeat.

    A node that isn't above the one before is an error."""
    parts = F.transform(F.split(col, "-"), lambda x: F.struct(F.get(F.split(x, ":"), F.lit(0)).alias("t"), F.get(F.split(x, ":"), F.lit(1)).try_cast("long").alias("s")))
    df = df.withColumn("_p", parts).withColumn("_lower", F.get("_p", F.lit(0))["t"])
    df = df.join(sent(tax.nodes.select(F.col("taxid").alias("_lower"), F.col("lineage").alias("lower_lineage")), tax.nodes), "_lower")
    where = F.transform("_p", lambda x: F.array_position("lower_lineage", x["t"]).cast("int") - 1)
    ok = F.forall("_p", lambda x: F.array_contains("lower_lineage", x["t"]))
    df = df.withColumn("_at", F.when(ok, where).otherwise(F.raise_error(F.lit("not an ancestor")).cast("array<int>")))
    depths = F.sequence(F.element_at("_at", -1), F.element_at("_at", F.lit(1)))
    known = F.arrays_zip(F.col("_at").alias("d"), F.transform("_p", lambda x: x["s"]).alias("s"))

    def at(d: Column) -> Column:
        hit = F.filter(known, lambda k: (k["d"] >= d) & k["s"].isNotNull())
        return F.coalesce(F.get(hit, F.size(hit) - 1)["s"], F.col(width).cast("long"))

    return df.withColumns({"support": F.transform(depths, at), "upper_depth": F.element_at("_at", -1)}).drop("_p", "_at", "_lower")
