"""The taxonomy as a table of nodes with their lineages, and tree operators as array expressions on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cladeflow.functions import common_prefix, fields
from cladeflow.runtime import materialize, sent

#: The ranks that are marked unless others are asked for.
RANKS = ("superkingdom", "phylum", "class", "order", "family", "genus", "species")


class Taxonomy:
    """Nodes (taxid, parent_taxid, rank, name, depth, lineage, ranks, names, marked, unclassified); lineages run from the root to the node."""

    def __init__(self, nodes: DataFrame, ranks: tuple[str, ...] = RANKS):
        self.nodes, self.ranks = nodes, ranks

    @classmethod
    def build(cls, edges: DataFrame, ranks: tuple[str, ...] = RANKS, root: str = "1") -> Taxonomy:
        """From (taxid, parent_taxid, rank, name): every node holds a part of its path and the node above that part, and takes
        over that node's part, so paths double with each join; orphans and cycles drop out."""
        e = edges.where((F.col("taxid") == root) | (F.col("taxid") != F.col("parent_taxid")))
        above = F.when(F.col("taxid") != root, F.col("parent_taxid"))
        parts = {"lineage": "taxid", "ranks": "rank", "names": "name"}
        nodes = e.select("taxid", above.alias("parent_taxid"), "rank", "name", above.alias("_up"), *(F.array(c).alias(n) for n, c in parts.items()))
        while True:
            nodes = materialize(nodes, "taxonomy-paths")
            if not nodes.where("_up is not null").limit(1).count():
                break
            higher = nodes.select(F.col("taxid").alias("_up"), F.col("_up").alias("_next"), *(F.col(n).alias(f"_{n}") for n in parts))
            longer = nodes.where("_up is not null").join(higher, "_up").select("taxid", "parent_taxid", "rank", "name", F.col("_next").alias("_up"), *(F.concat(f"_{n}", n).alias(n) for n in parts))
            longer = longer.where("_up is null or not array_contains(lineage, _up)")
            nodes = nodes.where("_up is null").unionByName(longer)
        nodes = nodes.drop("_up")
        nodes = nodes.withColumns({
            "depth": F.size("lineage") - 1,
            "marked": F.col("rank").isin(*ranks),
            # the root's own name is never looked at
            "unclassified": F.exists(F.slice("names", F.lit(2), F.size("names")), lambda x: x.contains("unclassified")),
        })
        return cls(materialize(nodes, "taxonomy"), ranks)

    def prune(self) -> Taxonomy:
        """Unmarked nodes go, the root aside; their children move up."""
        keep = lambda what: F.transform(F.filter(F.arrays_zip("lineage", "ranks", "names"), lambda x: (x["lineage"] == F.get("lineage", F.lit(0))) | x["ranks"].isin(*self.ranks)), lambda x: x[what])
        n = self.nodes.where(F.col("marked") | (F.col("depth") == 0))
        n = n.select("taxid", "rank", "name", "marked", "unclassified", keep("lineage").alias("lineage"), keep("ranks").alias("ranks"), keep("names").alias("names"))
        n = n.withColumns({"depth": F.size("lineage") - 1, "parent_taxid": F.get("lineage", F.size("lineage") - 2)})
        return Taxonomy(materialize(n, "pruned"), self.ranks)

    def nested_set(self) -> DataFrame:
        """taxid, left, right: a number on entry and one on exit. The taxonomy's order is one small sorted table."""
        sizes = self.nodes.select(F.explode("lineage").alias("taxid")).groupBy("taxid").agg(F.count("*").alias("size"))
        place = F.row_number().over(Window.orderBy("lineage")) - 1
        n = self.nodes.select("taxid", "depth", (2 * place - F.col("depth")).cast("long").alias("left")).join(sizes, "taxid")
        return n.select("taxid", "left", (F.col("left") + 2 * F.col("size") - 1).alias("right"))

    def rank_depths(self, ranks: tuple[str, ...] = RANKS) -> DataFrame:
        """taxid, rank_depth: a fixed depth for each rank; an unranked node, or one of its parent's rank, stays with its parent."""
        order = F.create_map(*[x for i, r in enumerate(ranks) for x in (F.lit(r), F.lit(i + 1))])
        return self.nodes.select("taxid", F.coalesce(F.array_max(F.transform("ranks", lambda r: order[r])), F.lit(0)).alias("rank_depth"))

    def resolve(self, df: DataFrame, col: str = "taxid", missing: str = "error", small: bool | None = None) -> DataFrame:
        """Join nodes to a taxid column; unknown ids are an error, dropped, or kept with nulls."""
        n = self.nodes.select(F.col("taxid").alias(col), "depth", "rank", "name", "lineage", "ranks", "names", "unclassified")
        out = df.join(sent(n, self.nodes) if small is None else F.broadcast(n) if small else n, col, "inner" if missing == "drop" else "left")
        if missing == "error":
            known = F.when(F.col("lineage").isNotNull() | F.col(col).isNull(), F.col("lineage"))
            out = out.withColumn("lineage", F.coalesce(known, F.raise_error(F.concat(F.lit("unknown taxid "), F.col(col))).cast("array<string>")))
        return out

    def version_hash(self) -> DataFrame:
        """MD5 of the sorted distinct edges, a line each."""
        edge = F.concat_ws("\t", "taxid", "parent_taxid")
        return self.nodes.where("parent_taxid is not null").agg(F.md5(F.concat(F.array_join(F.array_sort(F.collect_set(edge)), "\n"), F.lit("\n"))).alias("hash"))


def is_ancestor(a: Column, b: Column) -> Column:
    """Strictly above: by lineages."""
    return (F.size(a) < F.size(b)) & (F.get(b, F.size(a) - 1) == F.element_at(a, -1))


def distances(a: Column, b: Column) -> Column:
    """Edges from a to the common ancestor, from the root to it, and from b; for an ancestor a of b the root's are a's."""
    c = F.size(common_prefix(a, b))
    return F.struct((F.size(a) - c).alias("up"), (c - 1).alias("shared"), (F.size(b) - c).alias("down"))


def lca(a: Column, b: Column) -> Column:
    return common_prefix(a, b)


def lca_agg(lineage: Column) -> Column:
    """The lowest common ancestor's lineage of a group: what its least and its greatest lineage share.

    Both are plain aggregates, so groups combine before the shuffle and hold two rows' state whatever their size."""
    return common_prefix(F.min(lineage), F.max(lineage))


def lcc(a: Column, b: Column) -> Column:
    """The lowest common concept: the lower of two nodes on one path, else their common ancestor."""
    c = common_prefix(a, b)
    return F.when(F.size(c) == F.size(a), b).when(F.size(c) == F.size(b), a).otherwise(c)


def lcc_fold(lineages: Column) -> Column:
    """Over an array of lineages, deepest first, then by taxid path."""
    order = F.array_sort(lineages, lambda x, y: F.when(F.size(x) > F.size(y), -1).when(F.size(x) < F.size(y), 1).when(x < y, -1).when(x > y, 1).otherwise(0))
    return F.aggregate(F.slice(order, F.lit(2), F.greatest(F.size(order) - 1, F.lit(0))), F.get(order, F.lit(0)), lcc)


def classified(lineage: Column, names: Column) -> Column:
    """A lineage up to its first unclassified node, for the variant that looks at classified nodes alone."""
    bad = F.array_position(F.transform(names, lambda x: x.contains("unclassified")), True)
    return F.when(bad <= 1, lineage).otherwise(F.slice(lineage, F.lit(1), (bad - 1).cast("int")))


def at_rank(ranks: Column, values: Column, rank: str) -> Column:
    """The value of the lowest node of a rank on the path; the root's if there is none."""
    hit = F.filter(F.arrays_zip(ranks.alias("r"), values.alias("v")), lambda x: x["r"] == rank)
    return F.coalesce(F.get(hit, F.size(hit) - 1)["v"], F.get(values, F.lit(0)))


def traverse(df: DataFrame, tax: Taxonomy, col: str, ranks: tuple[str, ...] = RANKS, keep_not_rank: bool = False, keep_unknown: bool = False, invalid: str | None = None) -> DataFrame:
    """Replace a taxid column by the nearest node of the ranks, itself included, or the root; unknown ids drop their row."""
    j = df.join(sent(tax.nodes.select(F.col("taxid").alias(col), "lineage", "ranks"), tax.nodes), col, "left")
    hit = F.filter(F.arrays_zip("lineage", "ranks"), lambda x: x["ranks"].isin(*ranks))
    found = F.get(hit, F.size(hit) - 1)["lineage"]
    root = F.get("lineage", F.lit(0))
    other = F.lit(invalid) if invalid is not None else F.col(col)
    value = F.when(F.col("lineage").isNull(), other).otherwise(F.coalesce(found, other if keep_not_rank else root))
    out = j if keep_unknown else j.where("lineage is not null")
    return out.withColumn(col, value).select(*df.columns)


def annotate(df: DataFrame, tax: Taxonomy, col: str, what: str, all_nodes: bool = False, invalid: str | None = None) -> DataFrame:
    """Add name, rank, path or taxid_path of a taxid column; unknown ids drop their row unless a value is given for them."""
    n = tax.nodes.select(F.col("taxid").alias(col), "name", "rank", "lineage", "ranks", "names")
    j = df.join(sent(n, tax.nodes), col, "left" if invalid is not None else "inner")
    part = "names" if what == "path" else "lineage"
    steps = F.arrays_zip("lineage", "ranks", "names")
    if not all_nodes:
        steps = F.filter(steps, lambda x: x["ranks"].isin(*tax.ranks))
    path = F.array_join(F.transform(steps, lambda x: x[part]), ";")
    value = F.col(what) if what in ("name", "rank") else F.when(F.col("lineage").isNotNull(), path)
    return j.withColumn(f"_{what}", F.coalesce(value, F.lit(invalid)) if invalid is not None else value).select(*df.columns, F.col(f"_{what}").alias(f"taxon_{what}"))


def by_field(lines: DataFrame, field: int, edit) -> DataFrame:
    """A column `value` of tab-separated lines with one field, from 1, replaced by edit(DataFrame with `taxid`), which names what
    replaces it `taxid`; lines that edit drops, comments, blank lines and lines without the field go. A line that ends with the
    field gets a tab behind it."""
    f = fields(F.col("value"), "\t", field)
    df = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("_f", f).where(F.size("_f") >= field)
    df = edit(df.withColumn("taxid", F.get("_f", F.lit(field - 1))))
    cells = F.transform("_f", lambda x, i: F.when(i == field - 1, F.col("taxid")).otherwise(x))
    return df.select(F.array_join(cells, "\t").alias("value"))


def newick(df: DataFrame, tax: Taxonomy, col: str, ranks: tuple[str, ...] = RANKS, names: bool = False, fill: bool = False) -> DataFrame:
    """The subtree of some taxids at some ranks in Newick form, built bottom-up, one aggregation per depth; children in order of taxid.

    With fill a rank that a path lacks is an unnamed node. An empty input gives '();'."""
    n = df.select(F.col(col).alias("taxid")).distinct().join(tax.nodes.select("taxid", "lineage", "ranks", "names"), "taxid")
    steps = F.filter(F.arrays_zip("lineage", "ranks", "names"), lambda x: x["ranks"].isin(*ranks))
    label = "names" if names else "lineage"
    if fill:
        of_rank = lambda rank: F.filter(steps, lambda x: x["ranks"] == rank)
        by = [of_rank(r) for r in ranks]
        path = F.array(*[F.coalesce(F.get(b, F.size(b) - 1)[label], F.lit("")) for b in by])
        path = F.slice(path, F.lit(1), F.array_max(F.transform(F.sequence(F.lit(1), F.lit(len(ranks))), lambda i: F.when(F.get(path, i - 1) != "", i).otherwise(0))))
    else:
        path = F.transform(steps, lambda x: x[label])
    level = n.select(path.alias("path")).where("size(path) > 0").distinct().withColumn("text", F.lit(""))
    for depth in range(len(ranks), 0, -1):
        here, rest = level.where(F.size("path") == depth), level.where(F.size("path") < depth)
        name = F.get("path", F.lit(depth - 1))
        done = here.groupBy("path").agg(F.max("text").alias("text")).select(F.slice("path", F.lit(1), F.lit(depth - 1)).alias("path"), F.concat(F.col("text"), name).alias("text"))
        up = done.groupBy("path").agg(F.concat(F.lit("("), F.array_join(F.array_sort(F.collect_list("text")), ","), F.lit(")")).alias("text"))
        level = materialize(rest.unionByName(up), "newick")  # a row for each node at most
    return level.agg(F.concat(F.coalesce(F.max("text"), F.lit("()")), F.lit(";")).alias("newick"))
