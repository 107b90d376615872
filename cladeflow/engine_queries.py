"""The registered queries of the classification engine, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow import fixtures as X
from cladeflow import functions as fn
from cladeflow.operators import binning, filters, predictions, rpa, segments, summaries
from cladeflow.plans import taxonomy as tx
from cladeflow.runtime import materialize, scratch, sent, table
from cladeflow.sources import text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def masked(df: DataFrame) -> DataFrame:
    return df.select("ordinal", "masked")


V = X.SQL
SEG = ["query_id", "segment_no"]
PRED = ["query_id", "segment_no", "seqlen", "feature_begin", "feature_end", "taxid", "support", "rtax"]
PRED_SQL = ", ".join(PRED)


# sources and sinks


@query(V + "SELECT ordinal, masked, query_id, query_start, query_stop, ref_id, score::DOUBLE AS score, evalue, identities, aln_length FROM aln")
def aln_scan_project(spark, sf):
    """Alignments written as text and read again."""
    path = scratch(spark, "aln")
    a = X.alignments(spark, sf)
    text.write_alignments(a.withColumn("cigar", F.col("ordinal").cast("string")), path, trailing_tab=True)
    r = text.read_alignments(spark, path)
    return r.select(F.col("cigar").cast("long").alias("ordinal"), "masked", "query_id", "query_start", "query_stop", "ref_id", F.col("score").cast("double").alias("score"), "evalue", "identities", "aln_length")


@query(V + "SELECT seqid, taxid FROM map")
def map_scan(spark, sf):
    path = scratch(spark, "map")
    X.mapping(spark, sf).select(F.concat_ws("\t", "seqid", "taxid").alias("value")).write.text(path)
    return text.read_mapping(spark, path)


@query(V + "SELECT taxid, parent_taxid, rank, name FROM edges")
def tax_scan(spark, sf):
    path = scratch(spark, "dump")
    text.write_taxonomy(X.tax_edges(spark, sf), path)
    return text.read_taxonomy_edges(spark, path)


#: Documents as sequences d<id>; a null text is an empty sequence.
SEQS = "SELECT doc_id, 'd' || doc_id AS seq_id, coalesce(regexp_replace(translate(text, 'acgtuU', 'ACGTTT'), '[^ACGT]', 'N', 'g'), '') AS seq FROM documents"


def _fasta(spark, sf, in_order: bool = False) -> str:
    path = scratch(spark, "fasta")
    d = table(spark, sf, "documents").select("doc_id", F.expr("'d' || doc_id").alias("seq_id"), F.coalesce(fn.dna(F.col("text")), F.lit("")).alias("seq"))
    text.write_fasta(d.repartitionByRange("doc_id").sortWithinPartitions("doc_id") if in_order else d, path)
    return path


@query(f"SELECT seq_id, seq FROM ({SEQS})")
def fasta_scan(spark, sf):
    return text.read_fasta(spark, _fasta(spark, sf))


@query(f"SELECT seq_id FROM ({SEQS}) WHERE doc_id IN (SELECT doc_id FROM labels)")
def fasta_whitelist(spark, sf):
    return text.read_fasta(spark, _fasta(spark, sf), table(spark, sf, "labels").select(F.expr("'d' || doc_id").alias("id"))).select("seq_id")


@query(f"WITH s AS (SELECT doc_id, seq_id, length(seq) AS n, length(seq_id) + 2 AS head FROM ({SEQS})) SELECT seq_id AS name, n::INT AS length, (coalesce(sum(head + n + greatest(1, ceil(n / 60))) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + head)::BIGINT AS \"offset\", least(n, 60)::INT AS line_bases, CASE WHEN n = 0 THEN 0 ELSE least(n, 60) + 1 END::INT AS line_bytes FROM s")
def fasta_index(spark, sf):
    """The index of one file, written in parts, through its text form."""
    path, index = _fasta(spark, sf, in_order=True), scratch(spark, "fai")
    text.write_fai(text.build_fai(spark, path, one=path), index)
    return text.read_fai(spark, index, path).drop("file")


@query(f"SELECT seq_id AS name, 50 AS \"begin\", 50 + doc_id % 200 AS \"end\", md5(substring(seq, 51, (doc_id % 200)::BIGINT)) AS part FROM ({SEQS})")
def fasta_regions(spark, sf):
    path = _fasta(spark, sf)
    r = table(spark, sf, "documents").select(F.expr("'d' || doc_id").alias("name"), F.lit(50).cast("long").alias("begin"), (50 + F.col("doc_id") % 200).alias("end"))
    return text.read_regions(r, text.build_fai(spark, path)).select("name", F.col("begin").cast("int").alias("begin"), "end", F.md5("seq").alias("part"))


@query(V + "SELECT query_id || chr(9) || ref_id || chr(9) || printf('%.2f', 100.0 * identities / aln_length) || chr(9) || aln_length || chr(9) || (aln_length - identities) || chr(9) || (ordinal % 3) || chr(9) || query_start || chr(9) || query_stop || chr(9) || ref_start || chr(9) || ref_stop || chr(9) || evalue || chr(9) || score AS line FROM aln")
def aln_blasttab(spark, sf):
    a = X.alignments(spark, sf).withColumn("cigar", F.expr("concat('5=', repeat('1I2=', int(ordinal % 3)))"))
    return text.blasttab_lines(a).withColumnRenamed("value", "line")


@query(V + "SELECT ordinal % 2 AS file, query_id, ref_id, score::DOUBLE AS score, masked FROM aln")
def aln_gzip(spark, sf):
    """Alignments written to compressed files and read again."""
    path = scratch(spark, "aln")
    a = X.alignments(spark, sf).withColumn("cigar", F.expr("cast(ordinal % 2 AS string)"))
    text.write_alignments(a, path, compression="gzip")
    return text.read_alignments(spark, path).select(F.col("cigar").cast("long").alias("file"), "query_id", "ref_id", F.col("score").cast("double").alias("score"), "masked")


@query(V + "SELECT query_id, ref_id, query_start, ref_stop, score::DOUBLE AS score, evalue, aln_length FROM aln")
def blast_scan(spark, sf):
    """Eleven columns padded with spaces."""
    path = scratch(spark, "blast")
    text.alignment_lines(X.alignments(spark, sf).withColumn("masked", F.lit(False))).select(F.regexp_replace("value", "\t", "  \t ").alias("value")).write.text(path)
    return text.read_blast(spark, path).select("query_id", "ref_id", "query_start", "ref_stop", F.col("score").cast("double").alias("score"), "evalue", "aln_length")


@query("SELECT 's' || s_suppkey AS seqid, 'n' || s_nationkey AS taxid FROM supplier")
def map_first(spark, sf):
    """A key's first row counts."""
    path = scratch(spark, "map")
    s = table(spark, sf, "supplier").withColumn("turn", F.explode(F.array(F.lit(1), F.lit(2)))).select("turn", F.expr("concat('s', s_suppkey, '\t', if(turn = 1, concat('n', s_nationkey), 'x'))").alias("value"))
    s.coalesce(1).sortWithinPartitions("turn").select("value").write.text(path)
    return text.read_mapping(spark, path, last=False)


@query("SELECT DISTINCT 'c' || (o_custkey % 50) AS id FROM orders")
def id_scan(spark, sf):
    path = scratch(spark, "ids")
    table(spark, sf, "orders").select(F.expr("concat(' c', o_custkey % 50)").alias("value")).write.text(path)
    return text.read_ids(spark, path)


@query("SELECT o_orderkey::VARCHAR AS query_id, 's' || (o_custkey % 10) AS taxid FROM orders")
def simple_scan(spark, sf):
    path = scratch(spark, "simple")
    X.sample_map(spark, sf).select(F.concat_ws("\t", "seqid", "taxid", F.lit("rest")).alias("value")).write.text(path)
    return text.read_simple_predictions(spark, path)


#: Coding regions: suppliers, on either strand.
CDS = "SELECT 'p' || s_suppkey AS protein_id, 'c' || s_nationkey AS contig, 100 + 10 * s_suppkey AS start, 399 + 10 * s_suppkey AS stop, CASE WHEN s_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM supplier"


def _cds(spark, sf) -> DataFrame:
    path = scratch(spark, "cds")
    line = "concat_ws('\t', concat('c', s_nationkey), 'x', kind, 100 + 10 * s_suppkey, 399 + 10 * s_suppkey, '.', if(s_suppkey % 2 = 0, '+', '-'), '0', concat('ID=p', s_suppkey, ';note=a'))"
    table(spark, sf, "supplier").withColumn("kind", F.explode(F.array(F.lit("CDS"), F.lit("gene")))).select(F.expr(line).alias("value")).write.text(path)
    return text.read_cds(spark, path)


@query(CDS)
def cds_scan(spark, sf):
    return _cds(spark, sf)


@query(f"SELECT protein_id, (CASE WHEN strand = '+' THEN start + 3 * 6 ELSE stop - 3 * 19 - 2 END)::BIGINT AS dna_start, (CASE WHEN strand = '+' THEN start + 3 * 19 + 2 ELSE stop - 3 * 6 END)::BIGINT AS dna_stop FROM ({CDS})")
def cds_map(spark, sf):
    """Places 7 to 20 of each protein on its contig."""
    at = fn.protein_to_dna(F.lit(7), F.lit(20), F.col("start"), F.col("stop"), F.col("strand"))
    return _cds(spark, sf).select("protein_id", at.alias("x")).select("protein_id", F.col("x.start").alias("dna_start"), F.col("x.stop").alias("dna_stop"))


# scalar functions


@query(V + "SELECT ordinal, round((identities::FLOAT / greatest(query_length, aln_length)::FLOAT)::FLOAT::DOUBLE, 6) AS pid FROM aln")
def aln_pid(spark, sf):
    return X.alignments(spark, sf).select("ordinal", F.round(fn.pid().cast("double"), 6).alias("pid"))


@query(V + "SELECT aln.ordinal, map.taxid FROM aln LEFT JOIN map ON map.seqid = aln.ref_id")
def map_join(spark, sf):
    m = X.mapping(spark, sf).withColumnRenamed("seqid", "ref_id")
    return X.alignments(spark, sf).join(m, "ref_id", "left").select("ordinal", "taxid")


@query("SELECT doc_id, regexp_extract(source, '^(?:([a-z]+)[0-9]+)$', 1) AS bin_id FROM documents")
def glob_identifier(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fn.glob_id(F.col("source"), "([a-z]+)[0-9]+").alias("bin_id"))


DNA = "regexp_replace(translate(text, 'acgtuU', 'ACGTTT'), '[^ACGT]', 'N', 'g')"


@query(f"SELECT doc_id, md5(coalesce(substring({DNA}, (1 + doc_id % least(7, greatest(length(text), 1)))::BIGINT, length(text)), '')) AS infix FROM documents")
def seq_infix(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.coalesce(fn.dna(F.col("text")), F.lit("")).alias("s"))
    part = fn.infix(F.col("s"), (1 + F.col("doc_id") % F.least(F.lit(7), F.length("s"))).cast("int"), F.length("s") + 9)
    return d.select("doc_id", F.md5(F.when(F.length("s") > 0, part).otherwise("")).alias("infix"))


@query(f"WITH s AS (SELECT item_id, {DNA} AS s FROM benchmark), k AS (SELECT *, greatest(1, length(s) // 2) AS a, least(length(s), length(s) // 2 + 9) AS z FROM s) SELECT item_id, CASE WHEN item_id % 2 = 0 THEN s[greatest(1, a - 20):least(z + 4, length(s))] ELSE reverse(translate(s[greatest(1, a - 4):least(z + 20, length(s))], 'ACGT', 'TGCA')) END AS part FROM k")
def seq_ref_segment(spark, sf):
    """A middle part, widened by 20 places before and 4 behind on either strand."""
    b = table(spark, sf, "benchmark").select("item_id", fn.dna(F.col("text")).alias("s"))
    b = b.withColumns({"a": F.greatest(F.lit(1), F.expr("length(s) div 2")).cast("int"), "z": F.least(F.length("s"), F.expr("length(s) div 2 + 9")).cast("int")})
    even = F.col("item_id") % 2 == 0
    return b.select("item_id", fn.ref_segment(F.col("s"), F.when(even, F.col("a")).otherwise(F.col("z")), F.when(even, F.col("z")).otherwise(F.col("a")), F.lit(20), F.lit(4)).alias("part"))


@query("SELECT page_id, array_to_string(list_concat(string_split(url, '/')[1:2], [coalesce(array_to_string(string_split(url, '/')[3:], '/'), '')]), ' ') AS parts, len(string_split(url, '://'))::INT AS n FROM pages")
def text_fields(spark, sf):
    """Two fields and the rest of a URL, and how many fields a longer delimiter makes."""
    p = table(spark, sf, "pages")
    return p.select("page_id", F.array_join(fn.fields(F.col("url"), "/", 2), " ").alias("parts"), F.size(fn.fields(F.col("url"), "://", tail=False)).alias("n"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id::VARCHAR END AS gi, source AS id FROM documents")
def text_identifiers(spark, sf):
    d = table(spark, sf, "documents").withColumn("line", F.expr("if(doc_id % 3 = 0, concat(source, ' x|', doc_id), concat('gi|', doc_id, '|x|', source))"))
    return d.select("doc_id", fn.gi_field(F.col("line")).alias("gi"), fn.first_word(F.expr("concat(source, ' and more')")).alias("id"))


@query("SELECT doc_id, split_part('d' || doc_id || ' of ' || source, ' ', 1) AS seq_id FROM documents")
def strip_identifiers(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.expr("concat('d', doc_id, ' of ', source)").alias("seq_id"))
    return text.strip_identifiers(d, "seq_id")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '.' ELSE 'number' END AS told, CASE WHEN event_id % 5 = 0 THEN -1 ELSE value END AS back FROM events")
def score_texts(spark, sf):
    e = table(spark, sf, "events").withColumn("s", F.when(F.col("event_id") % 5 == 0, float("nan")).otherwise(F.col("value")))
    told = fn.score_text(F.col("s"))
    return e.select("event_id", F.when(told == ".", told).otherwise("number").alias("told"), F.nanvl(fn.score_value(told), F.lit(-1.0)).alias("back"))


@query(f"SELECT doc_id, md5(reverse(translate({DNA}, 'ACGT', 'TGCA'))) AS rc FROM documents")
def seq_revcomp(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(fn.revcomp(fn.dna(F.col("text")))).alias("rc"))


@query(f"WITH s AS (SELECT item_id, {DNA} AS s FROM benchmark), p AS (SELECT a.item_id, a.s AS a, b.s AS b FROM s a JOIN s b ON b.item_id = a.item_id + 1) SELECT item_id, levenshtein(a, b)::INT AS distance, abs(length(a) - length(b))::INT AS gaps, (least(length(a), length(b)) - (levenshtein(a, b) - abs(length(a) - length(b))))::INT AS matches FROM p")
def seq_edit_distance(spark, sf):
    s = table(spark, sf, "benchmark").select("item_id", fn.dna(F.col("text")).alias("s"))
    p = s.join(s.select((F.col("item_id") - 1).alias("item_id"), F.col("s").alias("b")), "item_id")
    return p.select("item_id", fn.edit_bounds(F.col("s"), F.col("b")).alias("x")).select("item_id", "x.distance", "x.gaps", "x.matches")


GAPPED = f"""WITH s AS (SELECT item_id, replace({DNA}, 'N', '-') AS s FROM benchmark),
p AS (SELECT a.item_id, rpad(a.s, greatest(length(a.s), length(b.s))::INT, '-') AS a, rpad(b.s, greatest(length(a.s), length(b.s))::INT, '-') AS b FROM s a JOIN s b ON b.item_id = a.item_id + 1),
c AS (SELECT item_id, unnest(range(1, length(a) + 1)) AS i, a, b FROM p),
d AS (SELECT item_id, i, a[i] AS x, b[i] AS y FROM c)"""


def _gapped(spark, sf) -> DataFrame:
    """Neighbouring items as gapped strings of one length."""
    s = table(spark, sf, "benchmark").select("item_id", F.translate(fn.dna(F.col("text")), "N", "-").alias("s"))
    p = s.join(s.select((F.col("item_id") - 1).alias("item_id"), F.col("s").alias("t")), "item_id")
    size = F.greatest(F.length("s"), F.length("t"))
    return p.select("item_id", F.rpad("s", size, F.lit("-")).alias("a"), F.rpad("t", size, F.lit("-")).alias("b"))


@query(GAPPED + """, k AS (SELECT item_id, i, x, y, x = '-' OR y = '-' AS g, lag(x = '-' OR y = '-', 1, false) OVER (PARTITION BY item_id ORDER BY i) AS before FROM d)
SELECT item_id, sum(CASE WHEN g THEN -1 - CASE WHEN before THEN 0 ELSE 5 END WHEN x = y THEN 2 ELSE -3 END)::DOUBLE AS score FROM k GROUP BY 1""")
def seq_affine_dna(spark, sf):
    return _gapped(spark, sf).select("item_id", fn.affine_score_dna(F.col("a"), F.col("b"), 2, -3, 5, 1).alias("score"))


# of the letters in these strings: A-A, C-C, G-G, T-T, A-C, A-G, A-T, C-G, C-T, G-T
@query(GAPPED + """, k AS (SELECT *, x = '-' OR y = '-' AS g FROM d WHERE NOT (x = '-' AND y = '-')), r AS (SELECT *, lag(g, 1, false) OVER (PARTITION BY item_id ORDER BY i) AS before FROM k),
m AS (SELECT * FROM (VALUES ('AA', 4), ('CC', 9), ('GG', 6), ('TT', 5), ('AC', 0), ('AG', 0), ('AT', 0), ('CG', -3), ('CT', -1), ('GT', -2)) AS v(p, n))
SELECT p.item_id, coalesce(sum(CASE WHEN g THEN CASE WHEN before THEN -1 ELSE -11 END ELSE n END), 0)::DOUBLE AS score FROM p LEFT JOIN r USING (item_id) LEFT JOIN m ON m.p = least(x, y) || greatest(x, y) GROUP BY 1""")
def seq_affine_protein(spark, sf):
    return _gapped(spark, sf).select("item_id", fn.affine_score_protein(F.col("a"), F.col("b"), 11, 1, rpa.SCORES).alias("score"))


@query(GAPPED + """, k AS (SELECT item_id, i, CASE WHEN y = '-' THEN 'I' WHEN x = '-' THEN 'D' WHEN x = y THEN '=' ELSE 'X' END AS c FROM d),
g AS (SELECT *, i - row_number() OVER (PARTITION BY item_id, c ORDER BY i) AS run FROM k), r AS (SELECT item_id, c, min(i) AS spot, count(*) AS n FROM g GROUP BY item_id, c, run)
SELECT p.item_id, coalesce(string_agg(n || c, '' ORDER BY spot), '') AS cigar FROM p LEFT JOIN r USING (item_id) GROUP BY 1""")
def seq_cigar(spark, sf):
    return _gapped(spark, sf).select("item_id", fn.cigar(F.col("a"), F.col("b")).alias("cigar"))


MAF = GAPPED + """, m AS (SELECT item_id, length(replace(a, '-', '')) AS ra, length(replace(b, '-', '')) AS qb, length(a) AS n, (SELECT count(*) FROM d WHERE d.item_id = p.item_id AND x = y AND x <> '-') AS same FROM p)
SELECT 'q' || item_id AS query_id, CASE WHEN {odd} THEN {back} ELSE 4 END::BIGINT AS query_start, CASE WHEN {odd} THEN {front} ELSE 3 + qb END::BIGINT AS query_stop,
  CASE WHEN {turn} THEN 5 + ra ELSE 6 END::BIGINT AS ref_start, CASE WHEN {turn} THEN 6 ELSE 5 + ra END::BIGINT AS ref_stop, item_id::DOUBLE AS score, same AS identities, n AS aln_length FROM m"""


def _maf(spark, sf) -> DataFrame:
    path = scratch(spark, "maf")
    block = "concat('a score=', item_id, ' E=0.5\ns r', item_id, ' 5 ', length(replace(a, '-', '')), ' + 100000 ', a, '\ns q', item_id, ' 3 ', length(replace(b, '-', '')), if(item_id % 2 = 1, ' - ', ' + '), '90000 ', b, '\n')"
    _gapped(spark, sf).select(F.expr(block).alias("value")).write.text(path)
    return text.read_maf(spark, path)


MAF_COLUMNS = ["query_id", "query_start", "query_stop", "ref_start", "ref_stop", "cast(score AS double) AS score", "identities", "aln_length"]


@query(MAF.format(odd="item_id % 2 = 1", back="90000 - 3 - qb + 1", front="90000 - 3", turn="item_id % 2 = 1"))
def maf_dna(spark, sf):
    return text.maf_to_alignments(_maf(spark, sf)).selectExpr(*MAF_COLUMNS)


@query(MAF.format(odd="item_id % 2 = 1", back="90000 - 3", front="90000 - 3 - qb + 1", turn="false"))
def maf_protein(spark, sf):
    return text.maf_to_alignments(_maf(spark, sf), protein=True).selectExpr(*MAF_COLUMNS)


# taxonomy


@query(V + "SELECT taxid, depth, array_to_string(lineage, ';') AS path, unclassified FROM tax")
def tax_lineage(spark, sf):
    return X.taxonomy(spark, sf).nodes.select("taxid", "depth", F.array_join("lineage", ";").alias("path"), "unclassified")


@query(V + "SELECT rank, max(depth) AS depth, count(*) AS n FROM tax GROUP BY rank")
def tax_depth(spark, sf):
    return X.taxonomy(spark, sf).nodes.groupBy("rank").agg(F.max("depth").alias("depth"), F.count("*").alias("n"))


@query(V + "SELECT taxid, depth::INT AS depth, CASE WHEN depth > 0 THEN lineage[depth] END AS parent_taxid FROM ptax")
def tax_prune(spark, sf):
    return X.pruned(spark, sf).nodes.select("taxid", "depth", "parent_taxid")


@query(V + "SELECT taxid FROM tax WHERE unclassified")
def tax_unclassified(spark, sf):
    return X.taxonomy(spark, sf).nodes.where("unclassified").select("taxid")


@query(V + "SELECT a AS ancestor, count(*) AS below FROM (SELECT unnest(lineage[:-2]) AS a FROM tax) GROUP BY a")
def tax_ancestor_pairs(spark, sf):
    """Containment by nested-set intervals, through lineages rather than a range join."""
    n = X.taxonomy(spark, sf).nested_set()
    return n.where("right > left + 1").select(F.col("taxid").alias("ancestor"), F.expr("(right - left - 1) div 2").alias("below"))


@query(V + "SELECT aln.ordinal, list_filter(a.lineage, lambda x: list_contains(b.lineage, x))[-1] AS lca, (len(a.lineage) - len(list_filter(a.lineage, lambda x: list_contains(b.lineage, x))))::INT AS up, (len(list_filter(a.lineage, lambda x: list_contains(b.lineage, x))) - 1)::INT AS shared, (len(b.lineage) - len(list_filter(a.lineage, lambda x: list_contains(b.lineage, x))))::INT AS down FROM aln JOIN tax a ON a.taxid = aln.ref_id JOIN tax b ON b.taxid = 'n' || (aln.ordinal % 25)")
def tax_lca_pair(spark, sf):
    n = X.taxonomy(spark, sf).nodes
    a = n.select(F.col("taxid").alias("ref_id"), F.col("lineage").alias("a"))
    b = n.select(F.col("taxid").alias("other"), F.col("lineage").alias("b"))
    j = X.alignments(spark, sf).withColumn("other", F.expr("'n' || ordinal % 25")).join(a, "ref_id").join(b, "other")
    return j.select("ordinal", F.element_at(tx.lca(F.col("a"), F.col("b")), -1).alias("lca"), tx.distances(F.col("a"), F.col("b")).alias("d")).select("ordinal", "lca", "d.up", "d.shared", "d.down")


#: Each node with its parent's parent or, for one in three, a nation's node.
PAIRS = ", pairs AS (SELECT a.taxid, a.lineage AS a, b.taxid AS other, b.lineage AS b FROM tax a JOIN tax b ON b.taxid = CASE WHEN len(a.lineage) > 2 AND len(a.name) % 3 > 0 THEN a.lineage[-3] ELSE 'n' || (len(a.name) % 25) END)"


def _pairs(spark, sf) -> DataFrame:
    n = X.taxonomy(spark, sf).nodes
    other = F.expr("if(size(lineage) > 2 AND length(name) % 3 > 0, element_at(lineage, -3), concat('n', length(name) % 25))")
    a = n.select("taxid", F.col("lineage").alias("a"), other.alias("other"))
    return a.join(n.select(F.col("taxid").alias("other"), F.col("lineage").alias("b")), "other")


@query(V + PAIRS + " SELECT taxid, other, len(b) < len(a) AND list_contains(a, other) AS above, len(a) < len(b) AND list_contains(b, taxid) AS below FROM pairs")
def tax_is_ancestor(spark, sf):
    return _pairs(spark, sf).select("taxid", "other", tx.is_ancestor(F.col("b"), F.col("a")).alias("above"), tx.is_ancestor(F.col("a"), F.col("b")).alias("below"))


@query(V + PAIRS + " SELECT taxid, other, CASE WHEN list_contains(a, other) THEN taxid WHEN list_contains(b, taxid) THEN other ELSE list_filter(a, lambda x: list_contains(b, x))[-1] END AS lcc FROM pairs")
def tax_lcc_pair(spark, sf):
    return _pairs(spark, sf).select("taxid", "other", F.element_at(tx.lcc(F.col("a"), F.col("b")), -1).alias("lcc"))


#: Lowest common concepts of a list of lineages, deepest first.
def _lcc_sql(paths: str) -> str:
    both = "list_filter(a, lambda e: list_contains(b, e))"
    step = f"CASE WHEN len({both}) = len(a) THEN b WHEN len({both}) = len(b) THEN a ELSE {both} END"
    return f"list_reduce(list_transform(list_sort(list_transform(list_distinct({paths}), lambda p: {{'n': -len(p), 'p': p}})), lambda s: s.p), lambda a, b: {step})"


@query(V + f"SELECT query_id, ({_lcc_sql('list(lineage)')})[-1] AS lcc FROM res GROUP BY 1")
def tax_lcc_set(spark, sf):
    return X.resolved(spark, sf).groupBy("query_id").agg(F.element_at(tx.lcc_fold(F.collect_set("lineage")), -1).alias("lcc"))


@query(V + "SELECT aln.ordinal, t.rank, t.depth FROM aln JOIN tax t ON t.taxid = CASE WHEN aln.ordinal % 11 = 0 THEN 'x' ELSE aln.ref_id END")
def tax_lookup(spark, sf):
    """Unknown nodes drop their row."""
    return X.taxonomy(spark, sf).resolve(_tagged(spark, sf), missing="drop").select("ordinal", "rank", "depth")


@query(V + "SELECT taxid, unnest(lineage) AS node, unnest(range(len(lineage)))::INT AS step FROM tax")
def tax_paths(spark, sf):
    """Every path, from the root down."""
    return X.taxonomy(spark, sf).nodes.select("taxid", F.posexplode("lineage").alias("step", "node"))


@query(V + ", c AS (SELECT query_id, node, k, count(DISTINCT taxid) AS n FROM (SELECT query_id, taxid, unnest(lineage) AS node, unnest(range(len(lineage))) AS k FROM res) GROUP BY ALL), g AS (SELECT query_id, count(DISTINCT taxid) AS n FROM res GROUP BY 1) SELECT g.query_id, max_by(c.node, c.k) AS lca FROM g JOIN c ON c.query_id = g.query_id AND c.n = g.n GROUP BY 1")
def tax_lca_set(spark, sf):
    return X.resolved(spark, sf).groupBy("query_id").agg(F.element_at(tx.lca_agg(F.col("lineage")), -1).alias("lca"))


@query(V + "SELECT taxid, list_max(list_transform(ranks, lambda r: coalesce(list_position(['superkingdom', 'phylum', 'class', 'order', 'family', 'genus', 'species'], r), 0)))::INT AS rank_depth FROM tax")
def tax_rank_depth(spark, sf):
    return X.taxonomy(spark, sf).rank_depths()


@query(V + "SELECT md5(string_agg(e, chr(10) ORDER BY e) || chr(10)) AS hash FROM (SELECT DISTINCT taxid || chr(9) || parent_taxid AS e FROM edges WHERE taxid <> parent_taxid)")
def tax_version_hash(spark, sf):
    return X.taxonomy(spark, sf).version_hash()


@query(V + "SELECT taxid, coalesce(list_filter(list_zip(ranks, names), lambda x: x[1] = 'genus')[-1][2], names[1]) AS genus FROM tax")
def tax_name_at_rank(spark, sf):
    return X.taxonomy(spark, sf).nodes.select("taxid", tx.at_rank(F.col("ranks"), F.col("names"), "genus").alias("genus"))


def _tagged(spark, sf) -> DataFrame:
    """A table with a taxid column, every eleventh unknown."""
    return X.alignments(spark, sf).select("ordinal", F.expr("CASE WHEN ordinal % 11 = 0 THEN 'x' ELSE ref_id END").alias("taxid"))


TAGGED = ", tagged AS (SELECT ordinal, CASE WHEN ordinal % 11 = 0 THEN 'x' ELSE ref_id END AS taxid FROM aln) "


@query(V + TAGGED + "SELECT ordinal, coalesce(list_filter(list_zip(t.lineage, t.ranks), lambda x: x[2] IN ('genus', 'superkingdom'))[-1][1], t.lineage[1]) AS taxid FROM tagged JOIN tax t USING (taxid)")
def tk_traverse(spark, sf):
    return tx.traverse(_tagged(spark, sf), X.taxonomy(spark, sf), "taxid", ("superkingdom", "genus"))


@query(V + TAGGED + "SELECT ordinal, g.taxid, coalesce(t.name, 'none') AS taxon_name FROM tagged g LEFT JOIN tax t ON t.taxid = g.taxid")
def tk_name(spark, sf):
    return tx.annotate(_tagged(spark, sf), X.taxonomy(spark, sf), "taxid", "name", invalid="none")


@query(V + TAGGED + "SELECT ordinal, taxid, t.rank AS taxon_rank FROM tagged JOIN tax t USING (taxid)")
def tk_rank(spark, sf):
    return tx.annotate(_tagged(spark, sf), X.taxonomy(spark, sf), "taxid", "rank")


PATH = "array_to_string(list_transform(list_filter(list_zip({0}, t.ranks), lambda x: x[2] IN ('superkingdom', 'genus', 'species')), lambda x: x[1]), ';')"


@query(V + TAGGED + f"SELECT ordinal, taxid, {PATH.format('t.names')} AS taxon_path FROM tagged JOIN tax t USING (taxid)")
def tk_path(spark, sf):
    return tx.annotate(_tagged(spark, sf), X.taxonomy(spark, sf), "taxid", "path")


@query(V + TAGGED + "SELECT ordinal, taxid, array_to_string(t.lineage, ';') AS taxon_taxid_path FROM tagged JOIN tax t USING (taxid)")
def tk_taxid_path(spark, sf):
    return tx.annotate(_tagged(spark, sf), X.taxonomy(spark, sf), "taxid", "taxid_path", all_nodes=True)


@query(V + TAGGED + "SELECT ordinal, CASE WHEN t.taxid IS NULL THEN 'none' ELSE coalesce(list_filter(list_zip(t.lineage, t.ranks), lambda x: x[2] = 'phylum')[-1][1], 'none') END AS taxid FROM tagged g LEFT JOIN tax t ON t.taxid = g.taxid")
def tk_traverse_invalid(spark, sf):
    """To a rank that is missing: both unknown nodes and those without it get a value."""
    return tx.traverse(_tagged(spark, sf), X.taxonomy(spark, sf), "taxid", ("phylum",), keep_not_rank=True, keep_unknown=True, invalid="none")


@query(V + TAGGED + "SELECT ordinal || chr(9) || t.rank || chr(9) || 'rest of it' || chr(9) || 'x' AS line, ordinal || chr(9) || t.rank || chr(9) AS short FROM tagged g JOIN tax t ON t.taxid = g.taxid")
def tk_field(spark, sf):
    """The second field of lines replaced by its rank, with columns behind it and without."""
    tax = X.taxonomy(spark, sf)
    rank = lambda df: tx.annotate(df, tax, "taxid", "rank").withColumn("taxid", F.col("taxon_rank"))
    t = _tagged(spark, sf)
    long = tx.by_field(t.select(F.concat_ws("\t", F.col("ordinal").cast("string"), "taxid", F.lit("rest of it\tx")).alias("value")), 2, rank)
    short = tx.by_field(t.select(F.concat_ws("\t", F.col("ordinal").cast("string"), "taxid").alias("value")), 2, rank)
    key = F.substring_index("value", "\t", 1).alias("key")
    return long.select(key, F.col("value").alias("line")).join(short.select(key, F.col("value").alias("short")), "key").drop("key")


@query(V + """, w AS (SELECT DISTINCT list_transform(list_filter(list_zip(t.lineage, t.ranks), lambda x: x[2] IN ('superkingdom', 'genus', 'species')), lambda x: x[1]) AS p FROM map JOIN tax t ON t.taxid = map.taxid),
l3 AS (SELECT p[1] AS a, p[2] AS b, '(' || string_agg(p[3], ',' ORDER BY p[3]) || ')' AS s FROM w WHERE len(p) = 3 GROUP BY 1, 2),
l2 AS (SELECT a, b, coalesce(s, '') || b AS s FROM (SELECT DISTINCT p[1] AS a, p[2] AS b FROM w WHERE len(p) >= 2) LEFT JOIN l3 USING (a, b)),
l1 AS (SELECT a, '(' || string_agg(s, ',' ORDER BY s) || ')' || a AS s FROM l2 GROUP BY 1)
SELECT '(' || string_agg(s, ',' ORDER BY s) || ');' AS newick FROM l1""")
def newick(spark, sf):
    return tx.newick(X.mapping(spark, sf), X.taxonomy(spark, sf), "taxid")


# segmentation


@query(V + "SELECT query_id, count(*) AS n FROM aln GROUP BY 1")
def seg_group(spark, sf):
    return segments.segment(X.alignments(spark, sf), split=False).groupBy("query_id").agg(F.count("*").alias("n"))


@query(V + ", a AS (SELECT ordinal, query_start, query_stop, (query_id::BIGINT // 3 % 5)::VARCHAR AS q FROM aln), g AS (SELECT *, CASE WHEN q = lag(q) OVER (ORDER BY ordinal) THEN 0 ELSE 1 END AS new FROM a), h AS (SELECT *, sum(new) OVER (ORDER BY ordinal ROWS UNBOUNDED PRECEDING)::BIGINT AS group_no FROM g), s AS (SELECT *, CASE WHEN query_start > max(query_stop) OVER (PARTITION BY group_no ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS next FROM h) SELECT ordinal, group_no, (1 + sum(next) OVER (PARTITION BY group_no ORDER BY ordinal ROWS UNBOUNDED PRECEDING))::BIGINT AS segment_no FROM s")
def seg_consecutive(spark, sf):
    """Queries that come again start new groups; rows as sorted in the input."""
    a = X.alignments(spark, sf).withColumn("query_id", F.expr("cast(cast(query_id AS bigint) div 3 % 5 AS string)"))
    return segments.segment(a, presorted=True, consecutive=True).select("ordinal", "group_no", "segment_no")


@query(V + ", a AS (SELECT (query_id::BIGINT // 3 % 5)::VARCHAR AS q, ordinal FROM aln), g AS (SELECT *, CASE WHEN q = lag(q) OVER (ORDER BY ordinal) THEN 0 ELSE 1 END AS new FROM a) SELECT group_no, any_value(q) AS query_id, count(*) AS n FROM (SELECT q, sum(new) OVER (ORDER BY ordinal ROWS UNBOUNDED PRECEDING)::BIGINT AS group_no FROM g) GROUP BY 1")
def seg_consecutive_whole(spark, sf):
    a = X.alignments(spark, sf).withColumn("query_id", F.expr("cast(cast(query_id AS bigint) div 3 % 5 AS string)"))
    return segments.segment(a, split=False, presorted=True, consecutive=True).groupBy("group_no", "query_id").agg(F.count("*").alias("n"))


@query(V + "SELECT query_id[:-2] AS bin_id, count(*) AS n FROM aln WHERE length(query_id) > 1 GROUP BY 1")
def seg_glob(spark, sf):
    return segments.glob_groups(X.alignments(spark, sf).where("length(query_id) > 1"), "(.+).").groupBy("bin_id").agg(F.count("*").alias("n"))


@query(V + "SELECT ordinal, segment_no FROM seg")
def seg_split(spark, sf):
    return segments.segment(X.alignments(spark, sf)).select("ordinal", "segment_no")


@query(V + "SELECT query_id, segment_no, min(query_start) AS range_start, max(query_stop) AS range_stop FROM seg WHERE NOT masked GROUP BY 1, 2")
def seg_range(spark, sf):
    return segments.query_range(X.resolved(spark, sf), SEG)


# filters


@query(V + "SELECT ordinal, masked OR row_number() OVER (PARTITION BY query_id, ref_id, masked ORDER BY score DESC, ordinal) > 1 AS masked FROM aln")
def flt_best_per_ref(spark, sf):
    return masked(filters.best_per_ref(X.alignments(spark, sf)))


@query(V + "SELECT ordinal, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, identities DESC, ordinal)::INT AS position FROM aln")
def flt_sort(spark, sf):
    return filters.sort_by_score(X.alignments(spark, sf)).select("ordinal", "position")


@query(V + "SELECT ordinal, masked OR (identities::FLOAT / greatest(query_length, aln_length)::FLOAT)::FLOAT < 0.1::FLOAT AS masked FROM aln")
def flt_min_pid(spark, sf):
    return masked(filters.min_pid(X.alignments(spark, sf), 0.1))


@query(V + "SELECT ordinal, masked OR evalue > 0.08 OR score < 2 OR score < ((1 - 0.3::DOUBLE) * greatest(max(score) OVER (PARTITION BY query_id), 0)::DOUBLE)::FLOAT AS masked FROM aln")
def flt_evalue_top(spark, sf):
    return masked(filters.evalue_top(X.alignments(spark, sf), 2.0, 0.3, 0.08))


@query(V + ", m AS (SELECT *, masked OR score < 2 AS m FROM aln) SELECT ordinal, m OR score < ((1 - 0.3::DOUBLE) * greatest(coalesce(max(CASE WHEN NOT m THEN score END) OVER (PARTITION BY query_id), 0), 0)::DOUBLE)::FLOAT AS masked FROM m")
def flt_min_score_top(spark, sf):
    return masked(filters.score_top(X.alignments(spark, sf), 2.0, 0.3))


@query(V + "SELECT ordinal, masked OR dense_rank() OVER (PARTITION BY query_id, masked ORDER BY score DESC) > 2 AS masked FROM aln")
def flt_n_best(spark, sf):
    return masked(filters.n_best(X.alignments(spark, sf), 2))


@query(V + "SELECT ordinal, masked OR count(*) FILTER (NOT masked) OVER (PARTITION BY query_id) < 3 AS masked FROM aln")
def flt_min_support(spark, sf):
    return masked(filters.min_support(X.alignments(spark, sf), 3))


MEGAN = """, e1 AS (SELECT *, masked OR score < 1 OR evalue > 0.09::FLOAT::DOUBLE AS m FROM res),
e2 AS (SELECT *, CASE WHEN NOT m AND score > greatest(coalesce(max(CASE WHEN NOT m THEN score END) OVER (PARTITION BY query_id, segment_no ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) THEN 1 ELSE 0 END AS new,
  max(CASE WHEN NOT m THEN score END) OVER (PARTITION BY query_id, segment_no) AS top FROM e1),
e3 AS (SELECT * EXCLUDE (masked), sum(new) OVER (PARTITION BY query_id, segment_no)::INT AS support, m OR score < ((1 - 0.2::DOUBLE) * greatest(coalesce(top, 0), 0)::DOUBLE)::FLOAT AS masked FROM e2)"""


@query(V + MEGAN + " SELECT ordinal, masked, support FROM e3")
def flt_score_evalue_top(spark, sf):
    return filters.score_evalue_top(X.resolved(spark, sf), 1.0, 0.09, 0.2, SEG).select("ordinal", "masked", "support")


@query(V + ", sm AS (SELECT o_orderkey::VARCHAR AS seqid, 's' || (o_custkey % 10) AS taxid FROM orders) SELECT a.ordinal, a.masked OR s.taxid IS NULL OR m.taxid IS NULL OR coalesce(s.taxid = m.taxid, false) AS masked FROM aln a LEFT JOIN sm s ON s.seqid = a.query_id LEFT JOIN map m ON m.seqid = a.ref_id")
def flt_taxon_mask(spark, sf):
    return masked(filters.taxon_mask(X.alignments(spark, sf), X.sample_map(spark, sf), X.mapping(spark, sf)))


@query(V + "SELECT ordinal, masked OR unclassified AS masked FROM res")
def flt_unclassified(spark, sf):
    return masked(filters.unclassified(X.resolved(spark, sf)))


@query(V + "SELECT ordinal, masked OR coalesce(score < max(CASE WHEN NOT masked THEN score END) OVER (PARTITION BY query_id), false) AS masked FROM aln")
def flt_max_score(spark, sf):
    return masked(filters.max_score(X.alignments(spark, sf)))


@query(V + "SELECT query_id, min(score)::DOUBLE AS min_score, max(score)::DOUBLE AS max_score FROM aln WHERE NOT masked GROUP BY 1")
def flt_score_range(spark, sf):
    return filters.score_range(X.alignments(spark, sf)).select("query_id", F.col("min_score").cast("double").alias("min_score"), F.col("max_score").cast("double").alias("max_score"))


@query(V + "SELECT ordinal, masked OR row_number() OVER (PARTITION BY query_id, taxid, masked ORDER BY score DESC, ordinal) > 1 AS masked FROM res")
def flt_best_per_taxon(spark, sf):
    return masked(filters.best_per(X.resolved(spark, sf), "taxid"))


@query(V + "SELECT ordinal, masked OR ref_id = 's' || (query_id::BIGINT % 10) AS masked FROM aln")
def flt_same_id(spark, sf):
    a = X.alignments(spark, sf).withColumn("query_id", F.expr("query_id || ':s' || cast(query_id AS bigint) % 10"))
    return masked(filters.same_id(a, "[0-9]+:(.*)"))


@query(V + ", a AS (SELECT aln.*, 's' || (query_id::BIGINT % 10) AS q FROM aln) SELECT a.ordinal, a.masked OR s.taxid IS NULL OR m.taxid IS NULL OR coalesce(s.taxid = m.taxid, false) AS masked FROM a LEFT JOIN map s ON s.seqid = a.q LEFT JOIN map m ON m.seqid = a.ref_id")
def flt_same_taxon(spark, sf):
    a = X.alignments(spark, sf).withColumn("query_id", F.expr("query_id || ':s' || cast(query_id AS bigint) % 10"))
    return masked(filters.same_taxon(a, X.mapping(spark, sf), "[0-9]+:(.*)"))


@query(V + """, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, identities DESC, ordinal) AS p FROM res WHERE NOT masked),
b AS (SELECT o.ordinal, o.taxid, o.lineage, x.taxid AS xt, x.lineage AS xl FROM o JOIN o x ON x.query_id = o.query_id AND x.p < o.p),
c AS (SELECT ordinal, node, k, count(DISTINCT xt) AS n FROM (SELECT ordinal, xt, unnest(xl) AS node, unnest(range(len(xl))) AS k FROM b) GROUP BY ALL),
n AS (SELECT ordinal, count(DISTINCT xt) AS n FROM b GROUP BY 1), l AS (SELECT n.ordinal, max_by(c.node, c.k) AS lca FROM n JOIN c ON c.ordinal = n.ordinal AND c.n = n.n GROUP BY 1)
SELECT r.ordinal, r.masked OR coalesce(list_contains(r.lineage, l.lca), false) AS masked FROM res r LEFT JOIN l ON l.ordinal = r.ordinal""")
def flt_redundant(spark, sf):
    return masked(filters.redundant(X.resolved(spark, sf)))


@query(V + """, b AS (SELECT *, max(CASE WHEN NOT masked THEN score END) OVER (PARTITION BY query_id) AS best FROM res),
c AS (SELECT *, NOT masked AND score >= ((1 - 0.2::DOUBLE) * greatest(best, 0)::DOUBLE)::FLOAT AS core FROM b),
f AS (SELECT r.ordinal, sum(len(r.lineage) - len(list_filter(r.lineage, lambda x: list_contains(k.lineage, x)))) AS far, count(*) AS n FROM c r JOIN c k ON k.query_id = r.query_id AND k.core GROUP BY 1)
SELECT c.ordinal, c.masked OR (NOT coalesce(c.core, false) AND coalesce(((1 - c.score::DOUBLE / c.best::DOUBLE) + f.far / (f.n * 7)) / 2 > 0.3, false)) AS masked FROM c LEFT JOIN f ON f.ordinal = c.ordinal""")
def flt_cleanse(spark, sf):
    return masked(filters.cleanse(X.resolved(spark, sf), 0.2, 0.3))


@query(V + """, b1 AS (SELECT * EXCLUDE (masked), masked OR row_number() OVER (PARTITION BY query_id, ref_id, masked ORDER BY score DESC, ordinal) > 1 AS masked FROM aln),
b2 AS (SELECT * EXCLUDE (masked), masked OR (identities::FLOAT / greatest(query_length, aln_length)::FLOAT)::FLOAT < 0.02::FLOAT OR score < 1 AS masked FROM b1),
b3 AS (SELECT * EXCLUDE (masked), masked OR score < ((1 - 0.9::DOUBLE) * greatest(coalesce(max(CASE WHEN NOT masked THEN score END) OVER (PARTITION BY query_id), 0), 0)::DOUBLE)::FLOAT AS masked FROM b2),
b4 AS (SELECT * EXCLUDE (masked), masked OR dense_rank() OVER (PARTITION BY query_id, masked ORDER BY score DESC) > 4 AS masked FROM b3),
b5 AS (SELECT *, count(*) FILTER (NOT masked) OVER (PARTITION BY query_id) AS n FROM b4) SELECT ordinal FROM b5 WHERE NOT masked AND n >= 2""")
def flt_chain(spark, sf):
    """All filters of the chain but the taxa's, in their order."""
    return filters.alignments_filter(X.alignments(spark, sf), best_per_reference=True, sort=True, least_pid=0.02, min_score=1.0, top=0.9, best=4, support=2).select("ordinal")


# predictions


@query(V + "SELECT query_id, segment_no, max(query_length) AS seqlen, 1::BIGINT AS feature_begin, max(query_length) AS feature_end, '1' AS taxid, 0::BIGINT AS support, '1' AS rtax FROM seg GROUP BY 1, 2")
def prd_dummy(spark, sf):
    return predictions.dummy(X.resolved(spark, sf)).select(*PRED)


@query(V + X.lca_sql("res", "p") + f"SELECT {PRED_SQL} FROM p")
def prd_simple_lca(spark, sf):
    return predictions.simple_lca(X.resolved(spark, sf)).select(*PRED)


@query(V + MEGAN + ", e4 AS (SELECT * EXCLUDE (masked), masked OR unclassified OR support < 1 AS masked FROM e3)" + X.lca_sql("e4", "p") + f"SELECT {PRED_SQL} FROM p")
def prd_megan_lca(spark, sf):
    return predictions.megan_lca(X.resolved(spark, sf), top=0.2, min_score=1.0, max_evalue=0.09, ignore_unclassified=True).select(*PRED)


@query(V + ", b AS (SELECT * EXCLUDE (masked), masked OR dense_rank() OVER (PARTITION BY query_id, segment_no, masked ORDER BY score DESC) > 2 AS masked FROM res)" + X.lca_sql("b", "p") + f"SELECT {PRED_SQL} FROM p")
def prd_n_best_lca(spark, sf):
    return predictions.n_best_lca(X.resolved(spark, sf), 2).select(*PRED)


IC = """, k AS (SELECT * EXCLUDE (lineage, masked, taxid), masked OR support < 1 AS masked, CASE WHEN cut IS NULL OR cut <= 1 THEN lineage ELSE lineage[:cut - 1] END AS lineage FROM (SELECT e3.*, list_position(list_transform(t.names, lambda x: contains(x, 'unclassified')), true) AS cut FROM e3 JOIN ptax t ON t.taxid = e3.taxid)),
u AS (SELECT *, max(score) OVER (PARTITION BY query_id, segment_no) AS best FROM k WHERE NOT masked),
g AS (SELECT query_id, segment_no, count(DISTINCT lineage[-1]) AS n, count(DISTINCT lineage[-1]) FILTER (score = best) AS t, min(query_start) AS b, max(query_stop) AS e, list(lineage) AS every, list(lineage) FILTER (score = best) AS tops FROM u GROUP BY 1, 2),
h AS (SELECT *, ({concept})[-1] AS node, list_reduce(tops, lambda a, b: list_filter(a, lambda e: list_contains(b, e)))[-1] AS top FROM g)
SELECT s.query_id, s.segment_no, s.seqlen, coalesce(b, 1) AS feature_begin, coalesce(e, s.seqlen) AS feature_end, coalesce(node, '1') AS taxid, coalesce(e - b + 1, 0) AS support, CASE WHEN node IS NULL THEN '1' WHEN n = t THEN node ELSE top END AS rtax
FROM (SELECT query_id, segment_no, max(query_length) AS seqlen FROM res GROUP BY 1, 2) s LEFT JOIN h ON h.query_id = s.query_id AND h.segment_no = s.segment_no"""


@query(V + MEGAN.replace("score < 1 OR evalue > 0.09::FLOAT::DOUBLE", "score < 0 OR evalue > 1000") + IC.format(concept=_lcc_sql("every")))
def prd_ic_megan_lca(spark, sf):
    return predictions.ic_megan_lca(X.resolved(spark, sf), top=0.2).select(*PRED)


def _ranges(spark, sf, written: bool = False) -> DataFrame:
    """Predictions as ranges of up to two nodes, to exercise the text form."""
    p = X.predictions(spark, sf, written)
    wide = (F.col("upper_depth") > 0) & (F.col("feature_begin") % 2 == 0)
    return p.withColumns({"support": F.when(wide, F.array(F.get("support", F.lit(0)) + 5, F.get("support", F.lit(0)))).otherwise(F.col("support")), "upper_depth": F.when(wide, F.col("upper_depth") - 1).otherwise(F.col("upper_depth")), "ival": F.when(wide, 0.5).otherwise(1.0)})


RANGES = X.lca_sql("res", "p") + ", q AS (SELECT p.*, t.lineage, t.depth, t.depth > 0 AND feature_begin % 2 = 0 AS wide FROM p JOIN ptax t ON t.taxid = p.taxid) "


@query(V + RANGES + "SELECT query_id, segment_no, CASE WHEN support = 0 THEN p.taxid ELSE p.taxid || ':' || support END || CASE WHEN wide THEN '-' || lineage[depth] || ':' || (support + 5) ELSE '' END AS tax FROM q p")
def gff_encode(spark, sf):
    return _ranges(spark, sf).select(*SEG, predictions.encode_tax(F.col("lower_lineage"), F.col("upper_depth"), F.col("support")).alias("tax"))


@query(V + RANGES + "SELECT query_id, feature_begin, taxid AS lower, CASE WHEN wide THEN lineage[depth] ELSE taxid END AS upper, CASE WHEN wide THEN (support + 5) || ';' || support WHEN support = 0 THEN seqlen::VARCHAR ELSE support::VARCHAR END AS support, CASE WHEN wide THEN 0.5 ELSE 1.0 END::DOUBLE AS ival FROM q")
def gff_decode(spark, sf):
    path = scratch(spark, "gff")
    r = _ranges(spark, sf)
    text.write_gff3(r, predictions.encode_tax(F.col("lower_lineage"), F.col("upper_depth"), F.col("support")), path)
    d = predictions.decode_tax(text.read_predictions(spark, path), X.pruned(spark, sf))
    return d.select("query_id", "feature_begin", F.element_at("lower_lineage", -1).alias("lower"), F.get("lower_lineage", F.col("upper_depth")).alias("upper"), F.array_join(F.transform("support", lambda x: x.cast("string")), ";").alias("support"), F.col("ival").cast("double").alias("ival"))


@query(V + RANGES + "SELECT query_id, segment_no, CASE WHEN wide THEN '7 7' ELSE '7' END AS same, CASE WHEN wide THEN (support + 5)::VARCHAR ELSE '' END AS pruned, CASE WHEN wide THEN (support + 5) || ' 1' ELSE '1' END AS changed, CASE WHEN wide THEN support ELSE coalesce(support, 0) END AS above FROM q")
def prd_ranges(spark, sf):
    """A range with one support, without its lower node, with another support there; the lower node's support at the root."""
    r, s = _ranges(spark, sf), F.col("support")
    told = lambda x: F.array_join(x.cast("array<string>"), " ")
    return r.select(
        *SEG, told(predictions.constant_range(F.size(s), F.lit(7).cast("long"))).alias("same"), told(predictions.prune_lower(s)).alias("pruned"),
        told(predictions.set_support(s, F.size(s) - 1, F.lit(1).cast("long"))).alias("changed"), F.when(F.col("upper_depth") > 0, fn.support_at_full(s, F.col("upper_depth"), F.lit(0))).otherwise(F.element_at(s, -1)).alias("above"),
    )


@query(V + RANGES + "SELECT query_id, count(*) AS n FROM q GROUP BY 1")
def gff_union(spark, sf):
    """Predictions of two folders at once."""
    r, tax = _ranges(spark, sf, written=True), predictions.encode_tax(F.col("lower_lineage"), F.col("upper_depth"), F.col("support"))
    paths = [scratch(spark, "gff") for _ in range(2)]
    for i, path in enumerate(paths):
        text.write_gff3(r.where(F.col("segment_no") % 2 == i), tax, path)
    return text.read_predictions(spark, paths).groupBy("query_id").agg(F.count("*").alias("n"))


# binning

POINTS = X.lca_sql("res", "p") + ", q AS (SELECT p.*, t.lineage, t.depth FROM p JOIN ptax t ON t.taxid = p.taxid) "


@query(V + POINTS + "SELECT node AS taxid, sum(support)::BIGINT AS support FROM (SELECT unnest(lineage) AS node, support FROM q) GROUP BY 1")
def bin_support(spark, sf):
    return binning.sample_support(X.predictions(spark, sf))


@query(V + POINTS + ", c AS (SELECT node, sum(support) AS n FROM (SELECT unnest(lineage) AS node, support FROM q) GROUP BY 1) SELECT query_id, segment_no, taxid FROM q WHERE taxid IN (SELECT node FROM c WHERE n >= 2000)")
def bin_noise(spark, sf):
    return binning.remove_noise(X.predictions(spark, sf), "2000").select(*SEG, F.element_at("lower_lineage", -1).alias("taxid"))


@query(V + POINTS + "SELECT query_id, greatest(floor((0.7::FLOAT * sum(support)::FLOAT)::FLOAT)::BIGINT, 50) AS threshold FROM q GROUP BY 1")
def bin_threshold(spark, sf):
    p = X.predictions(spark, sf).groupBy("query_id").agg(F.sum(F.get("support", F.lit(0))).alias("s"))
    return p.select("query_id", binning.threshold_of(F.col("s"), 0.7, 50).alias("threshold"))


#: The majority walk over points: best child of each node, steps from the root, thresholds, the reported end.
WALK = """, n0 AS (SELECT bin, d, node, parent, sum(CASE WHEN d = depth THEN support ELSE 0 END) AS direct, sum(support) AS total, min({{'o': feature_begin, 'p': lineage}}) AS first
  FROM (SELECT {bin} AS bin, feature_begin, lineage, depth, support, unnest(range(len(lineage))) AS d, unnest(lineage) AS node, unnest(list_concat(['']::VARCHAR[], lineage[:-2])) AS parent FROM {rows}) GROUP BY 1, 2, 3, 4),
n1 AS (SELECT *, row_number() OVER (PARTITION BY bin, d, parent ORDER BY total DESC, first) AS place, count(*) OVER (PARTITION BY bin, d, parent) AS kin FROM n0),
w0 AS (SELECT bin, d, node, direct, total, 1 AS kin FROM n1 WHERE d = 0 AND place = 1 UNION ALL SELECT n1.bin, n1.d, n1.node, n1.direct, n1.total, n1.kin FROM w0 JOIN n1 ON n1.bin = w0.bin AND n1.d = w0.d + 1 AND n1.parent = w0.node WHERE n1.place = 1),
w1 AS (SELECT *, coalesce(lead(kin) OVER (PARTITION BY bin ORDER BY d), 1) > 1 AS branching FROM w0),
b0 AS (SELECT {bin} AS bin, count(*) AS n, greatest(floor((0.7::FLOAT * sum(support)::FLOAT)::FLOAT)::BIGINT, 50) AS least, any_value(taxid) AS taxid, any_value(support) AS support, any_value(depth) AS depth FROM {rows} GROUP BY 1),
b1 AS (SELECT bin, sum(n) AS length FROM (SELECT {bin} AS bin, query_id, max(seqlen) AS n FROM {rows} GROUP BY 1, 2) GROUP BY 1),
b2 AS (SELECT bin, max(d) FILTER (direct >= least) AS low, coalesce(max(d) FILTER (total >= least), 0) AS back FROM w1 JOIN b0 USING (bin) GROUP BY 1),
b3 AS (SELECT bin, CASE WHEN low IS NULL THEN back ELSE coalesce((SELECT max(w1.d) + 1 FROM w1 JOIN b0 USING (bin) WHERE w1.bin = b2.bin AND w1.d < b2.low AND NOT (direct >= least AND NOT branching)), 0) END AS spot FROM b2),
ends AS (SELECT b0.bin, CASE WHEN b0.n = 1 THEN b0.taxid ELSE w1.node END AS taxid, (CASE WHEN b0.n = 1 THEN b0.support ELSE w1.total END)::BIGINT AS support, b1.length::BIGINT AS length, (CASE WHEN b0.n = 1 THEN b0.depth ELSE b3.spot END) AS spot
  FROM b0 JOIN b1 USING (bin) JOIN b3 USING (bin) JOIN w1 ON w1.bin = b0.bin AND w1.d = b3.spot)"""


@query(V + POINTS + WALK.format(bin="query_id", rows="q") + " SELECT bin AS sequence_id, taxid, support, length FROM ends")
def bin_consensus(spark, sf):
    return binning.emit(binning.consensus(X.predictions(spark, sf)))


#: Bins of all queries with one number but for its last digit, noise removed, from text on.
MANY = POINTS + """, c AS (SELECT node, sum(support) AS n FROM (SELECT unnest(lineage) AS node, support FROM q) GROUP BY 1),
z AS (SELECT q.* EXCLUDE (lineage, taxid, depth, support), CASE WHEN support = 0 THEN seqlen ELSE support END AS support, q.lineage, q.taxid, q.depth FROM q),
zc AS (SELECT node, sum(support) AS n FROM (SELECT unnest(lineage) AS node, support FROM z) GROUP BY 1), fine AS (SELECT *, left('0' || query_id, -1) AS bin_id FROM z WHERE taxid IN (SELECT node FROM zc WHERE n >= 500))"""


@query(V + MANY + WALK.format(bin="bin_id", rows="fine") + " SELECT bin AS sequence_id, taxid, support, length FROM ends")
def bin_predictions(spark, sf):
    """From prediction text to bins of several sequences."""
    path = scratch(spark, "gff")
    p = X.predictions(spark, sf).withColumn("query_id", F.concat(F.lit("0"), "query_id"))
    text.write_gff3(p.withColumn("ival", F.lit(1.0)), predictions.encode_tax(F.col("lower_lineage"), F.col("upper_depth"), F.col("support")), path)
    rows = text.read_predictions(spark, path).withColumn("ordinal", F.col("feature_begin"))
    bins = binning.bin_predictions(rows, X.taxonomy(spark, sf), pattern="(.+).", noise="500")
    return bins


@query(V + POINTS + WALK.format(bin="query_id", rows="q") + """, need AS (SELECT * FROM (VALUES ('superkingdom', 0.1::FLOAT), ('genus', 0.3::FLOAT), ('species', 0.5::FLOAT)) AS v(rank, pid)),
up AS (SELECT e.*, t.lineage, (SELECT min(i) FROM (SELECT unnest(t.ranks) AS rank, unnest(range(len(t.ranks))) AS i) r JOIN need USING (rank) WHERE need.pid > (e.support::FLOAT / e.length::FLOAT)::FLOAT) AS bad FROM ends e JOIN ptax t ON t.taxid = e.taxid)
SELECT bin AS sequence_id, lineage[CASE WHEN spot = 0 OR bad IS NULL THEN spot ELSE greatest(bad - 1, 0) END + 1] AS taxid, support, length FROM up""")
def bin_constraint(spark, sf):
    c = binning.consensus(X.predictions(spark, sf))
    return binning.emit(binning.constrain(c, X.pruned(spark, sf).nodes, {"superkingdom": 0.1, "genus": 0.3, "species": 0.5}))


BINS = POINTS + ", b AS (SELECT query_id AS sequence_id, taxid, support, seqlen AS length FROM q) "


def _bins(spark, sf, written: bool = False) -> DataFrame:
    return X.predictions(spark, sf, written).select(F.col("query_id").alias("sequence_id"), "taxid", F.get("support", F.lit(0)).alias("support"), F.col("seqlen").alias("length"))


@query(V + BINS + "SELECT sequence_id, taxid, support, length FROM b")
def bin_bioboxes(spark, sf):
    path = scratch(spark, "bins")
    text.write_bioboxes(_bins(spark, sf), path, "sample")
    return text.read_bioboxes(spark, path)


# summaries


@query(V + BINS + f""", s AS (SELECT {PATH.format('t.names')} AS path, t.rank, b.support, b.length FROM b JOIN ptax t USING (taxid)), y AS (SELECT path, sum(support) AS support, sum(length) AS length FROM s GROUP BY 1)
SELECT 'vprofile' AS part, count(DISTINCT rank) AS n, count(*)::BIGINT AS total FROM s UNION ALL SELECT 'taxpath', count(*), sum(support)::BIGINT FROM s UNION ALL SELECT 'taxsummary', count(*), sum(length)::BIGINT FROM y UNION ALL SELECT 'krona', 2 * count(*), coalesce(sum(support + length), 0)::BIGINT FROM y WHERE path <> ''""")
def agg_summaries(spark, sf):
    s = summaries.summaries(_bins(spark, sf, written=True), X.pruned(spark, sf))
    total = {"vprofile": "n", "taxpath": "support", "taxsummary": "length", "krona": "magnitude"}
    rows = [s[k].agg(F.lit(k).alias("part"), F.count("*").alias("n"), F.coalesce(F.sum(c), F.lit(0)).alias("total")) for k, c in total.items()]
    return rows[0].unionAll(rows[1]).unionAll(rows[2]).unionAll(rows[3])


@query(V + ", t AS (SELECT o_orderkey, unnest(['s' || (o_custkey % 10), 's' || (o_orderkey % 10), CASE WHEN o_orderkey % 13 = 0 THEN 'gone' ELSE 's' || (o_orderkey % 7) END]) AS taxid FROM orders), u AS (SELECT o_orderkey, coalesce(p.lineage, ['1']) AS l FROM t LEFT JOIN tax p ON p.taxid = t.taxid) SELECT o_orderkey, list_reduce(list(l), lambda a, b: list_filter(a, lambda e: list_contains(b, e)))[-1] AS lca FROM u GROUP BY 1")
def agg_krona_lca(spark, sf):
    """Unknown nodes count as the root."""
    o = table(spark, sf, "orders").select("o_orderkey", F.explode(F.expr("array(concat('s', o_custkey % 10), concat('s', o_orderkey % 10), if(o_orderkey % 13 = 0, 'gone', concat('s', o_orderkey % 7)))")).alias("taxid"))
    return summaries.krona_lca(o, X.taxonomy(spark, sf), ["o_orderkey"])


@query(V + BINS + "SELECT t.rank, count(*) AS n FROM b JOIN ptax t USING (taxid) GROUP BY 1")
def agg_vprofile(spark, sf):
    return summaries.vprofile(_bins(spark, sf), X.pruned(spark, sf))


@query(V + BINS + f"SELECT {PATH.format('t.names')} AS path, sum(support)::BIGINT AS support, sum(length)::BIGINT AS length FROM b JOIN ptax t USING (taxid) GROUP BY 1")
def agg_taxsummary(spark, sf):
    return summaries.taxsummary(_bins(spark, sf), X.pruned(spark, sf))


@query(V + BINS + f""", s AS (SELECT {PATH.format('t.names')} AS path, sum(support) AS support, sum(length) AS length FROM b JOIN ptax t USING (taxid) GROUP BY 1),
u AS (SELECT 'support' AS dataset, support AS magnitude, string_split(path, ';') AS p FROM s WHERE path <> '' UNION ALL SELECT 'length', length, string_split(path, ';') FROM s WHERE path <> ''),
v AS (SELECT dataset, magnitude, p, unnest(range(1, len(p) + 1)) AS k FROM u)
SELECT dataset, array_to_string(p[:k], ';') AS prefix, sum(magnitude)::BIGINT AS magnitude, count(*) AS n, coalesce(sum(magnitude) FILTER (k = len(p)), 0)::BIGINT AS unassigned FROM v GROUP BY 1, 2""")
def agg_rollup(spark, sf):
    return summaries.rollup(summaries.krona(summaries.taxsummary(_bins(spark, sf), X.pruned(spark, sf))))


@query(V + X.lca_sql("res", "p") + f"SELECT query_id, segment_no, support, {PATH.format('t.names')} AS path FROM p JOIN ptax t USING (taxid)")
def taxpath_flagship(spark, sf):
    """Every segment to its taxon's path, from raw alignments on."""
    tax = X.pruned(spark, sf)
    a = X.alignments(spark, sf, sent(X.mapping(spark, sf).withColumnRenamed("seqid", "ref_id")))
    p = predictions.simple_lca(segments.segment(tax.resolve(a)))
    return tx.annotate(p, tax, "taxid", "path").select(*SEG, "support", F.col("taxon_path").alias("path"))


def _sequences(ids: DataFrame, alphabet: str, n: int) -> DataFrame:
    """Letters from digests of the ids, 32 n of them; ids that share their last digit differ in few places."""
    digits = F.concat(*[F.md5(F.concat(F.substring("seq_id", -1, 1), F.lit(str(i)))) for i in range(n - 1)], F.md5("seq_id"))
    return ids.distinct().select("seq_id", F.translate(digits, "0123456789abcdef", alphabet).alias("seq"))


def _both_sequences(spark, sf, alphabet: str) -> tuple[DataFrame, DataFrame]:
    """Of all queries and of all references; these are few and are counted, so they are written."""
    a = X.alignments(spark, sf)
    return _sequences(a.select(F.col("query_id").alias("seq_id")), alphabet, 8), materialize(_sequences(a.select(F.col("ref_id").alias("seq_id")), alphabet, 8), "references", shuffled=True)


def _placed(spark, sf, alphabet: str, kind: str) -> DataFrame:
    p = rpa.place(X.resolved(spark, sf), *_both_sequences(spark, sf, alphabet), alphabet=kind)
    return p.select(
        *SEG, "feature_begin", "feature_end", "seqlen", F.element_at("lower_lineage", -1).alias("taxid"), F.get("lower_lineage", F.col("upper_depth")).alias("upper_taxid"),
        F.get("support", F.lit(0)).alias("support"), "rtax", "ival", F.aggregate("passes", F.lit(0), lambda a, x: a + x).alias("alignments"),
    )


@query(V + """, r0 AS (SELECT *, row_number() OVER (PARTITION BY query_id, segment_no ORDER BY score DESC, identities DESC, ordinal) AS p, dense_rank() OVER (PARTITION BY query_id, segment_no ORDER BY score DESC) AS grade,
  min(query_start) OVER (PARTITION BY query_id, segment_no) AS b, max(query_stop) OVER (PARTITION BY query_id, segment_no) AS e, count(*) OVER (PARTITION BY query_id, segment_no) AS n FROM res WHERE NOT masked),
r1 AS (SELECT query_id, segment_no, n, b, e, max(identities) FILTER (p = 1) AS same, bool_or(p = 1 AND aln_length = e - b + 1 AND identities = e - b + 1) AS exact, list(lineage) FILTER (grade = 1) AS one, list(lineage) FILTER (grade <= 2) AS two, max(grade) AS grades FROM r0 GROUP BY 1, 2, 3, 4, 5),
r2 AS (SELECT *, list_reduce(one, lambda a, b: list_filter(a, lambda x: list_contains(b, x))) AS low, list_reduce(two, lambda a, b: list_filter(a, lambda x: list_contains(b, x))) AS high FROM r1 WHERE n = 1 OR exact),
f AS (SELECT query_id, segment_no, max(query_length) AS seqlen, bool_and(masked) AS none FROM res GROUP BY 1, 2)
SELECT f.query_id, f.segment_no, f.seqlen, coalesce(b, 1) AS feature_begin, coalesce(e, f.seqlen) AS feature_end, coalesce(low[-1], '1') AS taxid, CASE WHEN n = 1 OR grades = 1 OR none THEN '1' ELSE high[-1] END AS upper_taxid, coalesce(same, 0) AS support, coalesce(low[-1], '1') AS rtax, CASE WHEN n > 1 THEN 0 ELSE 1 END::DOUBLE AS ival
FROM f LEFT JOIN r2 ON r2.query_id = f.query_id AND r2.segment_no = f.segment_no WHERE none OR r2.query_id IS NOT NULL""")
def rpa_unaligned(spark, sf):
    """What placement decides without an alignment: no row, one row, and identical references."""
    return _placed(spark, sf, "ACGTACGTACGTACGT", "nucleotide").where("alignments = 0").drop("alignments")


@query()
def rpa_binned(spark, sf):
    """Placement, the default prediction, as text and on into bins."""
    rows = X.alignments(spark, sf, sent(X.mapping(spark, sf).withColumnRenamed("seqid", "ref_id")))
    q, r = _both_sequences(spark, sf, "ACGTACGTACGTACGT")
    p = predictions.predict(segments.segment(rows), X.pruned(spark, sf), queries=q, references=r)
    path = scratch(spark, "gff")
    text.write_gff3(p, predictions.encode_tax(F.col("lower_lineage"), F.col("upper_depth"), F.col("support")), path)
    found = text.read_predictions(spark, path)
    return binning.bin_predictions(found, X.taxonomy(spark, sf), noise="50", least_pid={"species": 0.5})


@query()
def rpa_dna(spark, sf):
    return _placed(spark, sf, "ACGTACGTACGTACGT", "nucleotide")


@query()
def rpa_protein(spark, sf):
    return _placed(spark, sf, "ARNDCQEGHILKMFPS", "protein")


@query(V + "SELECT query_id, segment_no, masked FROM seg WHERE score >= 5")
def stream_filter(spark, sf):
    """The stateless part as a stream over files, the segmentation on each batch."""
    from cladeflow.streaming import run_stream

    return run_stream(spark, X.alignments(spark, sf), lambda df: segments.segment(df).where("score >= 5").select("query_id", "segment_no", "masked"))
