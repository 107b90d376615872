"""Summaries of bins along the taxonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.plans.taxonomy import Taxonomy, annotate, lca_agg


def vprofile(bins: DataFrame, tax: Taxonomy) -> DataFrame:
    return annotate(bins, tax, "taxid", "rank").groupBy(F.col("taxon_rank").alias("rank")).agg(F.count("*").alias("n"))


def taxpath(bins: DataFrame, tax: Taxonomy) -> DataFrame:
    return annotate(bins, tax, "taxid", "path").withColumnRenamed("taxon_path", "path")


def taxsummary(bins: DataFrame, tax: Taxonomy) -> DataFrame:
    return taxpath(bins, tax).groupBy("path").agg(F.sum("support").alias("support"), F.sum("length").alias("length"))


def krona(summary: DataFrame) -> DataFrame:
    """Both magnitudes of each path as rows of their own datasets."""
    s = summary.where("path <> ''")
    return s.select(F.explode(F.array(F.struct(F.lit("support").alias("dataset"), F.col("support").alias("magnitude"), "path"), F.struct(F.lit("length").alias("dataset"), F.col("length").alias("magnitude"), "path"))).alias("x")).select("x.*")


def rollup(rows: DataFrame) -> DataFrame:
    """Magnitude, count and what ends there, of every prefix of every path; empty names are skipped."""
    names = F.filter(F.split("path", ";"), lambda x: x != "")
    part = rows.select("dataset", "magnitude", names.alias("p")).where("size(p) > 0")
    part = part.select("dataset", "magnitude", F.size("p").alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda k: F.struct(F.array_join(F.slice("p", F.lit(1), k), ";").alias("prefix"), k.alias("k")))).alias("x"))
    return part.groupBy("dataset", "x.prefix").agg(F.sum("magnitude").alias("magnitude"), F.count("*").alias("n"), F.sum(F.when(F.col("x.k") == F.col("n"), F.col("magnitude")).otherwise(0)).alias("unassigned"))


def krona_lca(rows: DataFrame, tax: Taxonomy, keys: list[str], root: str = "1") -> DataFrame:
    """The lowest common ancestor of each group's taxids; unknown ones count as the root."""
    path = F.coalesce("lineage", F.array(F.lit(root)))
    return tax.resolve(rows, "taxid", missing="keep").withColumn("lineage", path).groupBy(*keys).agg(F.element_at(lca_agg(F.col("lineage")), -1).alias("lca"))


def summaries(bins: DataFrame, tax: Taxonomy) -> dict[str, DataFrame]:
    s = taxsummary(bins, tax)
    return {"vprofile": vprofile(bins, tax), "taxpath": taxpath(bins, tax), "taxsummary": s, "krona": krona(s)}
