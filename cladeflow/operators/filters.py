"""Mask filters over record sets. Rows are masked, never removed; all share the windows of the record set's keys, so a chain has one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.functions import common_prefix, glob_id, pid

KEYS = ["query_id"]


def mask(df: DataFrame, when: Column) -> DataFrame:
    return df.withColumn("masked", F.col("masked") | F.coalesce(when, F.lit(False)))


def group(keys: list[str]):
    return Window.partitionBy(*keys)


def open_score() -> Column:
    return F.when(~F.col("masked"), F.col("score"))


def band(best: Column, top: float) -> Column:
    """The least score within a fraction of the best, which is 0 at least: in double, kept in single precision."""
    return (F.lit(1.0 - top) * F.greatest(F.coalesce(best, F.lit(0.0)), F.lit(0.0)).cast("double")).cast("float")


def best_per(df: DataFrame, by: str, keys: list[str] = KEYS) -> DataFrame:
    """Of unmasked rows with one reference (or taxon) the best-scored stays, the first of equals."""
    w = Window.partitionBy(*keys, by, "masked").orderBy(F.desc("score"), "ordinal")
    return df.withColumn("_n", F.row_number().over(w)).transform(mask, F.col("_n") > 1).drop("_n")


def best_per_ref(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return best_per(df, "ref_id", keys)


def sort_by_score(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Position of each row, masked ones too: best score, then most identities, then input order."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("identities"), "ordinal")
    return df.withColumn("position", F.row_number().over(w))


def min_pid(df: DataFrame, least: float) -> DataFrame:
    return mask(df, pid() < F.lit(least).cast("float"))


def evalue_top(df: DataFrame, min_score: float = 0.0, top: float = 1.0, max_evalue: float = float("inf"), keys: list[str] = KEYS) -> DataFrame:
    """The best score counts masked rows too."""
    df = df.withColumn("_best", F.max("score").over(group(keys)))
    bad = (F.col("evalue") > max_evalue) | (F.col("score") < F.lit(min_score).cast("float"))
    if top < 1:
        bad = bad | (F.col("score") < band(F.col("_best"), top))
    return mask(df, bad).drop("_best")


def score_top(df: DataFrame, min_score: float = 0.0, top: float = 1.0, keys: list[str] = KEYS) -> DataFrame:
    """The best score is that of rows still unmasked."""
    df = mask(df, F.col("score") < F.lit(min_score).cast("float"))
    df = df.withColumn("_best", F.max(open_score()).over(group(keys)))
    return mask(df, F.col("score") < band(F.col("_best"), top)).drop("_best")


def n_best(df: DataFrame, n: int, keys: list[str] = KEYS) -> DataFrame:
    """Unmasked rows with one of the n highest distinct scores; n = 0 keeps all."""
    if n == 0:
        return df
    w = Window.partitionBy(*keys, "masked").orderBy(F.desc("score"))
    return df.withColumn("_r", F.dense_rank().over(w)).transform(mask, F.col("_r") > n).drop("_r")


def min_support(df: DataFrame, least: int, keys: list[str] = KEYS) -> DataFrame:
    df = df.withColumn("_n", F.sum((~F.col("masked")).cast("int")).over(group(keys)))
    return mask(df, F.col("_n") < least).drop("_n")


def score_evalue_top(df: DataFrame, min_score: float, max_evalue: float, top: float, keys: list[str] = KEYS, support: str = "running_max") -> DataFrame:
    """Score, e-value (limit in single precision) and band; adds `support`: how often a new best score is met in input order, or the hits."""
    df = mask(df, (F.col("score") < F.lit(min_score).cast("float")) | (F.col("evalue") > F.lit(max_evalue).cast("float").cast("double")))
    rows = Window.partitionBy(*keys).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    before = F.greatest(F.coalesce(F.max(open_score()).over(rows), F.lit(0.0)), F.lit(0.0))
    new = ~F.col("masked") if support == "hits" else ~F.col("masked") & (F.col("score") > before)
    df = df.withColumn("_new", F.coalesce(new, F.lit(False)).cast("int"))
    df = df.withColumns({"support": F.sum("_new").over(group(keys)).cast("int"), "_best": F.max(open_score()).over(group(keys))})
    return mask(df, F.col("score") < band(F.col("_best"), top)).drop("_new", "_best")


def unclassified(df: DataFrame) -> DataFrame:
    """Needs the resolved taxon's `unclassified`."""
    return mask(df, F.col("unclassified"))


def taxon_mask(df: DataFrame, sample_map: DataFrame, ref_map: DataFrame) -> DataFrame:
    """Rows whose query and reference have one taxon; unmapped references, and all rows of unmapped queries."""
    s = sample_map.select(F.col("seqid").alias("query_id"), F.col("taxid").alias("_s"))
    r = ref_map.select(F.col("seqid").alias("ref_id"), F.col("taxid").alias("_r"))
    df = df.join(s, "query_id", "left").join(r, "ref_id", "left")
    return mask(df, F.col("_s").isNull() | F.col("_r").isNull() | (F.col("_s") == F.col("_r"))).drop("_s", "_r")


def max_score(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The unmasked rows with the highest score alone."""
    df = df.withColumn("_best", F.max(open_score()).over(group(keys)))
    return mask(df, F.col("score") < F.col("_best")).drop("_best")


def score_range(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return df.where("not masked").groupBy(*keys).agg(F.min("score").alias("min_score"), F.max("score").alias("max_score"))


def same_id(df: DataFrame, regex: str) -> DataFrame:
    return mask(df, F.col("ref_id") == glob_id(F.col("query_id"), regex))


def same_taxon(df: DataFrame, mapping: DataFrame, regex: str) -> DataFrame:
    """The taxon of the id within the query's id against the reference's; unmapped ids mask."""
    df = df.withColumn("_q", glob_id(F.col("query_id"), regex))
    a = mapping.select(F.col("seqid").alias("_q"), F.col("taxid").alias("_s"))
    b = mapping.select(F.col("seqid").alias("ref_id"), F.col("taxid").alias("_r"))
    df = df.join(a, "_q", "left").join(b, "ref_id", "left")
    return mask(df, F.col("_s").isNull() | F.col("_r").isNull() | (F.col("_s") == F.col("_r"))).drop("_q", "_s", "_r")


def cleanse(df: DataFrame, t1: float, t2: float, keys: list[str] = KEYS) -> DataFrame:
    """Rows far from the core, which are the rows within t1 of the best score: half the score's and half the tree's distance.

    Needs `lineage`, and ordinals that are unique in a record set. The steps from a row down from what it shares with each
    core row are its depth for each, less the core's count on every node of its own path: no row meets the core's rows."""
    df = df.withColumn("_best", F.max(open_score()).over(group(keys)))
    core = (~F.col("masked")) & (F.col("score") >= band(F.col("_best"), t1))
    df = df.withColumn("_core", F.coalesce(core, F.lit(False)))
    df = df.withColumn("_n", F.sum(F.col("_core").cast("int")).over(group(keys)))
    on_node = df.where("_core").select(*keys, F.explode("lineage").alias("_node")).groupBy(*keys, "_node").agg(F.count("*").alias("_c"))
    shared = df.where("not _core").select(*keys, "ordinal", F.explode("lineage").alias("_node")).join(on_node, [*keys, "_node"]).groupBy(*keys, "ordinal").agg(F.sum("_c").alias("_shared"))
    df = df.join(shared, [*keys, "ordinal"], "left")
    far = F.col("_n") * F.size("lineage") - F.coalesce("_shared", F.lit(0))
    d = ((1 - F.col("score") / F.col("_best")) + far / (F.col("_n") * 7)) / 2
    return mask(df, ~F.col("_core") & (d > t2)).drop("_best", "_core", "_n", "_shared")


def redundant(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """In order of score, rows whose taxon lies within the common ancestor of the unmasked rows before. Needs `lineage`."""
    w = Window.partitionBy(*keys, "masked").orderBy(F.desc("score"), F.desc("identities"), "ordinal").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_lca", common_prefix(F.min("lineage").over(w), F.max("lineage").over(w)))
    return mask(df, F.col("_lca").isNotNull() & (F.size(common_prefix(F.col("_lca"), F.col("lineage"))) == F.size("_lca"))).drop("_lca")


def alignments_filter(df: DataFrame, keys: list[str] = KEYS, sample_map: DataFrame | None = None, ref_map: DataFrame | None = None, best_per_reference: bool = False, sort: bool = False, least_pid: float = 0.0, min_score: float = 0.0, top: float = 1.0, max_evalue: float = -1.0, best: int = 0, support: int = 1, keep_masked: bool = False) -> DataFrame:
    """All filters in their fixed order."""
    if sample_map is not None and ref_map is not None:
        df = taxon_mask(df, sample_map, ref_map)
    if best_per_reference:
        df = best_per_ref(df, keys)
    if sort:
        df = sort_by_score(df, keys)
    if least_pid > 0:
        df = min_pid(df, least_pid)
    if max_evalue >= 0:
        df = evalue_top(df, min_score, top, max_evalue, keys)
    elif min_score > 0 or top < 1:
        df = score_top(df, min_score, top, keys)
    if best:
        df = n_best(df, best, keys)
    if support > 1:
        df = min_support(df, support, keys)
    return df if keep_masked else df.where("not masked")
