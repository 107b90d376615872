"""Biological views over the driver's tables: a taxonomy of regions, nations and suppliers, alignments from line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from cladeflow.plans.taxonomy import Taxonomy
from cladeflow.runtime import materialize, sent, table

_held: dict[tuple[str, str, str], object] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _held:
        _held[key] = make()
    return _held[key]


def tax_edges(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    s = lambda e: F.expr(e)
    rows = spark.createDataFrame([("1", "1", "no rank", "root")], "taxid string, parent_taxid string, rank string, name string")
    rows = rows.unionAll(t("region").select(s("'r' || r_regionkey"), F.lit("1"), F.lit("superkingdom"), "r_name"))
    rows = rows.unionAll(t("nation").select(s("'n' || n_nationkey"), s("'r' || n_regionkey"), F.lit("clade"), "n_name"))
    genus = "s_nationkey || '_' || s_suppkey % 3"
    rows = rows.unionAll(t("supplier").select(s(f"'g' || {genus}"), s("'n' || s_nationkey"), F.lit("genus"), s(f"CASE WHEN s_suppkey % 3 = 2 THEN 'unclassified ' ELSE 'Genus ' END || {genus}")).distinct())
    return rows.unionAll(t("supplier").select(s("'s' || s_suppkey"), s(f"'g' || {genus}"), F.lit("species"), "s_name"))


def taxonomy(spark: SparkSession, sf: str) -> Taxonomy:
    return _once(spark, sf, "tax", lambda: Taxonomy.build(tax_edges(spark, sf)))


def pruned(spark: SparkSession, sf: str) -> Taxonomy:
    return _once(spark, sf, "pruned", lambda: taxonomy(spark, sf).prune())


def mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers are species; every fifth is known by its genus alone."""
    return table(spark, sf, "supplier").select(F.expr("'s' || s_suppkey").alias("seqid"), F.expr("CASE WHEN s_suppkey % 5 = 0 THEN 'g' || s_nationkey || '_' || s_suppkey % 3 ELSE 's' || s_suppkey END").alias("taxid"))


def sample_map(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("seqid"), F.expr("'s' || o_custkey % 10").alias("taxid"))


def alignments(spark: SparkSession, sf: str, refs: DataFrame | None = None) -> DataFrame:
    """refs: columns to add by ref_id. They join before the rows are dealt by query, which stay dealt so for what follows."""
    df, more = table(spark, sf, "lineitem").withColumn("query_id", F.col("l_orderkey").cast("string")), []
    if refs is not None:
        more = [c for c in refs.columns if c != "ref_id"]
        df = df.join(refs, F.expr("'s' || l_suppkey") == F.col("ref_id"), "left").drop("ref_id")
    w = Window.partitionBy("query_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return df.withColumn("_n", F.row_number().over(w)).selectExpr(
        "cast(query_id AS bigint) * 100000 + _n AS ordinal", "l_returnflag = 'R' AS masked", "query_id",
        "cast(l_linenumber * 15 AS bigint) AS query_start", "cast(l_linenumber * 15 + l_quantity - 1 AS bigint) AS query_stop", "cast(200 AS bigint) AS query_length",
        "'s' || l_suppkey AS ref_id", "cast(l_linenumber * 10 AS bigint) AS ref_start", "cast(l_linenumber * 10 + l_quantity - 1 AS bigint) AS ref_stop",
        "cast(floor(l_extendedprice / 5000) AS float) AS score", "l_discount AS evalue", "cast(l_quantity AS bigint) AS identities", "cast(l_quantity + round(l_tax * 100) AS bigint) AS aln_length", *more,
    )


def resolved(spark: SparkSession, sf: str) -> DataFrame:
    """Alignments with their segment and their reference's node of the pruned tree, dealt by query."""
    from cladeflow.operators.segments import segment

    def make() -> DataFrame:
        m = mapping(spark, sf)
        return segment(alignments(spark, sf, sent(pruned(spark, sf).resolve(m.withColumnRenamed("seqid", "ref_id")), m)))

    return _once(spark, sf, "resolved", make)


def predictions(spark: SparkSession, sf: str, written: bool = False) -> DataFrame:
    """Point predictions of all segments with what binning needs, dealt by query; written for queries that read them more
    than once."""
    from cladeflow.operators.predictions import simple_lca

    def make() -> DataFrame:
        p = simple_lca(resolved(spark, sf), path=True).withColumnRenamed("lineage", "lower_lineage")
        return p.withColumns({"upper_depth": F.size("lower_lineage") - 1, "support": F.array("support"), "ordinal": F.col("feature_begin"), "bin_id": F.col("query_id")})

    if written:
        return _once(spark, sf, "predictions-written", lambda: materialize(predictions(spark, sf), "predictions"))
    return _once(spark, sf, "predictions", make)


#: The same views for DuckDB.
SQL = """WITH RECURSIVE edges AS (
  SELECT '1' AS taxid, '1' AS parent_taxid, 'no rank' AS rank, 'root' AS name
  UNION ALL SELECT 'r' || r_regionkey, '1', 'superkingdom', r_name FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'clade', n_name FROM nation
  UNION ALL SELECT DISTINCT 'g' || s_nationkey || '_' || (s_suppkey % 3), 'n' || s_nationkey, 'genus', CASE WHEN s_suppkey % 3 = 2 THEN 'unclassified ' ELSE 'Genus ' END || s_nationkey || '_' || (s_suppkey % 3) FROM supplier
  UNION ALL SELECT 's' || s_suppkey, 'g' || s_nationkey || '_' || (s_suppkey % 3), 'species', s_name FROM supplier),
tax AS (
  SELECT taxid, NULL::VARCHAR AS parent_taxid, rank, name, 0 AS depth, [taxid] AS lineage, [rank] AS ranks, [name] AS names, false AS unclassified FROM edges WHERE taxid = '1'
  UNION ALL SELECT e.taxid, e.parent_taxid, e.rank, e.name, t.depth + 1, list_append(t.lineage, e.taxid), list_append(t.ranks, e.rank), list_append(t.names, e.name), t.unclassified OR contains(e.name, 'unclassified') FROM edges e JOIN tax t ON e.parent_taxid = t.taxid WHERE e.taxid <> e.parent_taxid),
kept AS (SELECT *, list_filter(range(1, len(lineage) + 1), lambda i: i = 1 OR ranks[i] IN ('superkingdom', 'phylum', 'class', 'order', 'family', 'genus', 'species')) AS ix FROM tax
  WHERE depth = 0 OR rank IN ('superkingdom', 'phylum', 'class', 'order', 'family', 'genus', 'species')),
ptax AS (SELECT taxid, rank, name, unclassified, len(ix) - 1 AS depth, list_transform(ix, lambda i: lineage[i]) AS lineage, list_transform(ix, lambda i: ranks[i]) AS ranks, list_transform(ix, lambda i: names[i]) AS names FROM kept),
map AS (SELECT 's' || s_suppkey AS seqid, CASE WHEN s_suppkey % 5 = 0 THEN 'g' || s_nationkey || '_' || (s_suppkey % 3) ELSE 's' || s_suppkey END AS taxid FROM supplier),
aln AS (SELECT l_orderkey * 100000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ordinal, l_returnflag = 'R' AS masked, l_orderkey::VARCHAR AS query_id,
  (l_linenumber * 15)::BIGINT AS query_start, (l_linenumber * 15 + l_quantity - 1)::BIGINT AS query_stop, 200::BIGINT AS query_length, 's' || l_suppkey AS ref_id, (l_linenumber * 10)::BIGINT AS ref_start, (l_linenumber * 10 + l_quantity - 1)::BIGINT AS ref_stop,
  floor(l_extendedprice / 5000)::FLOAT AS score, l_discount AS evalue, l_quantity::BIGINT AS identities, (l_quantity + round(l_tax * 100))::BIGINT AS aln_length FROM lineitem),
seg0 AS (SELECT *, CASE WHEN query_start > max(query_stop) OVER (PARTITION BY query_id ORDER BY query_start, query_stop, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM aln),
seg AS (SELECT * EXCLUDE (new), (1 + sum(new) OVER (PARTITION BY query_id ORDER BY query_start, query_stop, ordinal ROWS UNBOUNDED PRECEDING))::BIGINT AS segment_no FROM seg0),
res AS (SELECT s.*, m.taxid, t.lineage, t.unclassified FROM seg s JOIN map m ON m.seqid = s.ref_id JOIN ptax t ON t.taxid = m.taxid)
"""


def lca_sql(rows: str, name: str) -> str:
    """CTEs for the simple common-ancestor prediction of rows with query_id, segment_no, masked, lineage, taxid, score."""
    return f""",
{name}_u AS (SELECT *, max(score) OVER (PARTITION BY query_id, segment_no) AS best FROM {rows} WHERE NOT masked),
{name}_a AS (SELECT query_id, segment_no, count(DISTINCT taxid) AS n, count(DISTINCT taxid) FILTER (score = best) AS t, min(query_start) AS b, max(query_stop) AS e FROM {name}_u GROUP BY ALL),
{name}_c AS (SELECT query_id, segment_no, node, k, count(DISTINCT taxid) AS n FROM (SELECT query_id, segment_no, taxid, unnest(lineage) AS node, unnest(range(len(lineage))) AS k FROM {name}_u) GROUP BY ALL),
{name}_d AS (SELECT query_id, segment_no, node, k, count(DISTINCT taxid) AS t FROM (SELECT query_id, segment_no, taxid, unnest(lineage) AS node, unnest(range(len(lineage))) AS k FROM {name}_u WHERE score = best) GROUP BY ALL),
{name} AS (SELECT g.query_id, g.segment_no, g.seqlen, coalesce(a.b, 1) AS feature_begin, coalesce(a.e, g.seqlen) AS feature_end,
  coalesce((SELECT max_by(c.node, c.k) FROM {name}_c c WHERE c.query_id = a.query_id AND c.segment_no = a.segment_no AND c.n = a.n), '1') AS taxid,
  coalesce(a.e - a.b + 1, 0) AS support,
  coalesce((SELECT max_by(d.node, d.k) FROM {name}_d d WHERE d.query_id = a.query_id AND d.segment_no = a.segment_no AND d.t = a.t), '1') AS rtax
  FROM (SELECT query_id, segment_no, max(query_length) AS seqlen FROM {rows} GROUP BY ALL) g LEFT JOIN {name}_a a ON a.query_id = g.query_id AND a.segment_no = g.segment_no)
"""
