"""Golden cases on a small taxonomy, and every query with SQL against DuckDB."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cladeflow import engine_queries
from cladeflow import functions as fn
from cladeflow.operators import binning, filters, predictions, rpa, segments
from cladeflow.plans import taxonomy as tx
from cladeflow.sources import text

SF = "/root/testdata/sf0.001"
NODES = [
    ("1", "1", "no rank", "root"), ("2", "1", "superkingdom", "Bacteria"), ("10", "2", "phylum", "PhyA"), ("11", "2", "phylum", "PhyB"), ("20", "10", "clade", "CladeX"),
    ("30", "20", "genus", "GenA"), ("31", "20", "genus", "GenB"), ("40", "30", "species", "SpA1"), ("41", "30", "species", "SpA2"), ("42", "31", "species", "SpB1"),
    ("43", "11", "species", "unclassified PhyB sp."), ("50", "43", "no rank", "strain X"), ("99", "98", "species", "orphan"),
]
REFS = {"refA": "40", "refB": "41", "refC": "42", "refD": "43", "refE": "30"}


@pytest.fixture(scope="module")
def tax(spark):
    return tx.Taxonomy.build(spark.createDataFrame(NODES, "taxid string, parent_taxid string, rank string, name string"))


def lineages(t):
    return {r["taxid"]: r["lineage"] for r in t.nodes.select("taxid", "lineage").collect()}


def test_build_and_prune(tax):
    full, pruned = lineages(tax), lineages(tax.prune())
    assert "99" not in full and full["40"] == ["1", "2", "10", "20", "30", "40"]
    assert set(full) - set(pruned) == {"20", "50"} and pruned["40"] == ["1", "2", "10", "30", "40"]
    assert {r["taxid"] for r in tax.nodes.where("unclassified").collect()} == {"43", "50"}
    assert {r["taxid"]: r["rank_depth"] for r in tax.rank_depths().collect()}["40"] == 7


def test_nested_set(tax):
    n = {r["taxid"]: (r["left"], r["right"]) for r in tax.nested_set().collect()}
    up = lineages(tax)
    for a in up:
        for b in up:
            inside = n[a][0] < n[b][0] and n[b][1] < n[a][1]
            assert inside == (a != b and a in up[b])
    assert len({x for p in n.values() for x in p}) == 2 * len(n)


def test_ancestors(spark, tax):
    up = lineages(tax.prune())
    pairs = [("40", "41"), ("40", "42"), ("40", "43"), ("30", "40"), ("40", "40")]
    df = spark.createDataFrame([(a, b, up[a], up[b]) for a, b in pairs], "a string, b string, la array<string>, lb array<string>")
    got = df.select("a", "b", F.element_at(tx.lca(F.col("la"), F.col("lb")), -1).alias("lca"), F.element_at(tx.lcc(F.col("la"), F.col("lb")), -1).alias("lcc"), tx.distances(F.col("la"), F.col("lb")).alias("d")).collect()
    assert {(r["a"], r["b"]): r["lca"] for r in got} == {("40", "41"): "30", ("40", "42"): "10", ("40", "43"): "2", ("30", "40"): "30", ("40", "40"): "40"}
    assert {(r["a"], r["b"]): r["lcc"] for r in got}[("30", "40")] == "40"
    assert [tuple(r["d"]) for r in got if r["a"] == r["b"]] == [(0, 4, 0)]


def test_unknown_taxid_raises(spark, tax):
    with pytest.raises(Exception, match="unknown taxid"):
        tax.resolve(spark.createDataFrame([("-1",)], "taxid string")).collect()


ALN = "ordinal long, masked boolean, query_id string, query_start long, query_stop long, query_length long, ref_id string, ref_start long, ref_stop long, score float, evalue double, identities long, aln_length long"


def aln(spark, rows):
    return spark.createDataFrame([(i, m, "q1", a, b, 100, r, 1, 1 + b - a, float(s), e, n, k) for i, (a, b, r, s, e, n, k, m) in enumerate(rows)], ALN)


A1 = [(1, 40, "refA", 80, 1e-10, 38, 40, False), (5, 40, "refB", 80, 1e-10, 34, 36, False), (41, 70, "refC", 60, 1e-5, 28, 30, False), (70, 90, "refA", 50, 1e-4, 20, 21, False)]
A2 = [(1, 40, "refA", 80, 0.0, 1, 40, False), (1, 40, "refB", 80, 0.0, 1, 40, False), (1, 40, "refA", 90, 0.0, 1, 40, False), (1, 40, "refC", 60, 0.0, 1, 40, False), (1, 40, "refD", 60, 0.0, 1, 40, True), (1, 40, "refE", 45, 0.0, 1, 40, False)]


def test_segments_and_simple_lca(spark, tax):
    p = tax.prune()
    df = segments.segment(aln(spark, A1))
    assert [r["segment_no"] for r in df.orderBy("ordinal").collect()] == [1, 1, 2, 2]
    m = F.create_map(*[F.lit(x) for kv in REFS.items() for x in kv])
    got = predictions.simple_lca(p.resolve(df.withColumn("taxid", m[F.col("ref_id")]))).orderBy("segment_no").collect()
    assert [(r["taxid"], r["feature_begin"], r["feature_end"], r["support"], r["rtax"]) for r in got] == [("30", 1, 40, 40, "30"), ("10", 41, 90, 50, "42")]
    both = segments.segment(aln(spark, A1), consecutive=True, presorted=True).orderBy("ordinal").collect()
    assert [r["segment_no"] for r in both] == [1, 1, 2, 2]


@pytest.mark.parametrize("name, chain, expected", [
    ("best per reference", lambda d: filters.best_per_ref(d), {0, 4}),
    ("two best", lambda d: filters.n_best(d, 2), {3, 4, 5}),
    ("score band", lambda d: filters.score_top(d, 50.0, 0.2), {3, 4, 5}),
    ("e-value band", lambda d: filters.score_evalue_top(d, 0.0, 1000.0, 0.2), {3, 4, 5}),
    ("support", lambda d: filters.min_support(d, 6), {0, 1, 2, 3, 4, 5}),
    ("n = 0", lambda d: filters.n_best(d, 0), {4}),
])
def test_filters(spark, name, chain, expected):
    assert {r["ordinal"] for r in chain(aln(spark, A2)).where("masked").collect()} == expected


def test_running_support(spark):
    assert filters.score_evalue_top(aln(spark, A2), 0.0, 1000.0, 0.2).first()["support"] == 2


def test_band_scope(spark):
    rows = [(*r[:3], 200, *r[4:]) if i == 4 else r for i, r in enumerate(A2)]
    assert {r["ordinal"] for r in filters.evalue_top(aln(spark, rows), 0.0, 0.5, 1000.0).where("not masked").collect()} == set()
    assert {r["ordinal"] for r in filters.score_top(aln(spark, rows), 0.0, 0.5).where("masked").collect()} == {4}


PATHS = {"30": ["1", "2", "10", "30"], "10": ["1", "2", "10"], "40": ["1", "2", "10", "30", "40"], "42": ["1", "2", "10", "31", "42"]}


def test_consensus(spark):
    a = [("A", PATHS["30"], 3, [40], "q1", 100), ("A", PATHS["10"], 2, [50], "q1", 100)]
    b = [("B", PATHS["40"], 3, [60, 60], "q2", 200), ("B", PATHS["42"], 4, [50], "q2", 200)]
    one = [("C", PATHS["40"], 3, [70, 60], "q3", 90)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(a + b + one)], "bin_id string, lower_lineage array<string>, upper_depth int, support array<bigint>, query_id string, seqlen long, ordinal long")
    assert binning.threshold(90, 0.7, 50) == 63
    assert df.select(binning.threshold_of(F.lit(90), 0.7, 50)).first()[0] == 63

    def got(majority):
        return {r["bin_id"]: (r["kind"], r["lower_lineage"], r["upper_depth"], r["support"], r["length"]) for r in binning.consensus(df, majority, 50).collect()}

    assert got(0.7) == {"A": ("fallback", PATHS["10"], 2, [90], 100), "B": ("fallback", PATHS["10"], 2, [110], 200), "C": ("single", PATHS["40"], 3, [70, 60], 90)}
    half = got(0.5)
    assert half["A"][0] == "direct" and half["B"] == ("direct", PATHS["40"], 3, [60, 60], 200)
    names = spark.createDataFrame([(t, "name " + t) for t in ("1", "2", "10", "30", "31", "40", "42")], "taxid string, name string")
    log = {r["bin_id"]: r["value"] for r in binning.log_lines(binning.consensus(df, 0.5, 50), names, 0.5, 50).collect()}
    assert set(log) == {"A", "B"} and "  2 |         50 |         90 | 0 | *name 10" in log["A"] and "using direct binning mode..." in log["B"]


def test_noise(spark):
    rows = [(1, PATHS["40"], 3, [9, 5]), (1, PATHS["40"], 3, [9, 5]), (2, PATHS["42"], 4, [3]), (3, ["1", "7"], 1, [1])]
    df = spark.createDataFrame(rows, "n int, lower_lineage array<string>, upper_depth int, support array<bigint>")
    left = sorted((r["n"], r["lower_lineage"], r["support"]) for r in binning.remove_noise(df, "11").collect())
    assert left == [(1, PATHS["30"], [9]), (1, PATHS["30"], [9])]
    # a share of the root's support, 22 of it here
    assert binning.remove_noise(df, "0.5").count() == 2 and binning.remove_noise(df, "0.04").count() == 4 and binning.remove_noise(df).count() == 4


def test_sequences(spark):
    r = spark.range(1).select(fn.revcomp(F.lit("AACGTN")).alias("rc"), fn.edit_bounds(F.lit("ACGTN"), F.lit("ACGN")).alias("d"), fn.dna(F.lit("acguX")).alias("dna"), fn.cigar(F.lit("AC-GT"), F.lit("ACTG-")).alias("c")).first()
    assert (r["rc"], tuple(r["d"]), r["dna"], r["c"]) == ("NACGTT", (1, 1, 0, 4), "ACGTN", "2=1D1=1I")
    assert rpa.edit_distance("ACGTN", "ACGN") == 1 and rpa.edit_distance("", "AC") == 2
    assert rpa.align_protein("ARND", "ARND") == (0.0, 4.0)


def row(i, ref, score, n, k, taxid, seq="ACGT" * 10, a=1, b=40):
    return {"ordinal": i, "query_start": a, "query_stop": b, "ref_id": ref, "score": float(score), "identities": n, "aln_length": k, "lineage": PATHS[taxid], "ref_seq": seq}


def placed(rows, query="ACGT" * 10, exclude=0.5, band=0.05, align=rpa.align_dna):
    return rpa.Placement(rows, query, exclude, band, align).run()


def test_placement():
    one = placed([row(0, "refA", 80, 38, 40, "40", None)], None)
    assert (one["lower"][-1], one["upper"][-1], one["support"], one["ival"]) == ("40", "1", 38, 1.0)
    p41 = PATHS["30"] + ["41"]
    rows = [row(0, "a", 100, 40, 40, "40"), row(1, "b", 100, 39, 40, "40") | {"lineage": p41}, row(2, "c", 90, 30, 40, "42")]
    same = placed(rows)
    assert (same["lower"][-1], same["upper"][-1], same["support"], same["ival"], same["rtax"]) == ("30", "10", 40, 0.0, "30")
    # no second score: up to the root
    assert placed(rows[:2])["upper"] == ("1",) and placed(rows[:2])["alignments"] == 0
    near = "ACGT" * 9 + "ACTT"
    far = "ACGT" * 5 + "TTTT" * 5
    rows = [row(0, "a", 100, 39, 40, "40", near), row(1, "b", 99, 38, 40, "40", near[:-3] + "GTT") | {"lineage": p41}, row(2, "c", 60, 30, 40, "42", far)]
    got = placed(rows)
    assert got["rtax"] == "40" and got["upper"] == tuple(PATHS["40"][: len(got["upper"])]) and got["lower"][: len(got["upper"])] == got["upper"]
    with pytest.raises(ValueError, match="no sequence"):
        placed(rows, None)


def test_placement_by_hand():
    """Distances by a table: three references at known distances from the query and from each other."""
    p41 = PATHS["30"] + ["41"]

    def run(query_to, between, paths, scores=(100, 99, 98, 97)):
        table_ = {frozenset(k): v for k, v in between.items()} | {frozenset(("q", x)): d for x, d in query_to.items()}
        rows = [row(i, x, scores[i], 20, 40, "40", x) | {"lineage": paths[x]} for i, x in enumerate(query_to)]
        return placed(rows, "q", align=lambda a, b: (float(table_[frozenset((a, b))]) if a != b else 0.0, 30.0))

    paths = {"a": PATHS["40"], "b": p41, "c": PATHS["42"]}
    # b is nearer to a than the query is, c beyond: lower 30, upper 10; ival = (4 - 2) / (8 - 2)
    got = run({"a": 4, "b": 5, "c": 9}, {"ab": 2, "ac": 8, "bc": 8}, paths)
    assert (got["rtax"], got["lower"][-1], got["upper"][-1], got["support"]) == ("40", "30", "10", 30) and got["ival"] == pytest.approx(1 / 3)
    # nothing is nearer to a than the query: the nearest beyond bounds the range, the lower node stays; c lies far away
    got = run({"a": 2, "b": 5, "c": 9}, {"ab": 4, "ac": 9, "bc": 9}, paths)
    assert (got["lower"][-1], got["upper"][-1]) == ("40", "30") and got["ival"] == pytest.approx(0.5)
    # two equally near references of two genera: what they share
    got = run({"a": 3, "c": 3}, {"ac": 1}, paths, (100, 100))
    assert (got["rtax"], got["lower"][-1], got["upper"][-1], got["ival"]) == ("10", "10", "10", 1.0)
    # a contradiction: c of another genus is nearer to a than b of its own; the band grows by sqrt(6 / 3)
    assert rpa.band_factor(tuple(PATHS["40"]), [(0.0, tuple(PATHS["40"])), (3.0, tuple(PATHS["42"])), (6.0, tuple(p41))]) == pytest.approx(2**0.5)
    assert rpa.band_factor(tuple(PATHS["40"]), [(0.0, tuple(PATHS["40"])), (3.0, tuple(p41)), (6.0, tuple(PATHS["42"]))]) == 1.0


def test_protein_alignment():
    """Against a plain table, where of equal steps back a diagonal comes first, then a vertical one."""
    def plain(a, b):
        s = lambda x, y: rpa.SCORES[x, y]
        t = [[-(i + j) for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        n = [[i + j for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                ways = [(t[i - 1][j - 1] + s(x, y), n[i - 1][j - 1]), (t[i - 1][j] - 1, n[i - 1][j]), (t[i][j - 1] - 1, n[i][j - 1])]
                best = max(w[0] for w in ways)
                t[i][j], n[i][j] = best, next(w[1] for w in ways if w[0] == best) + 1
        own = sum(s(x, x) for x in a + b)
        mutual, norm = t[-1][-1], np.float32(n[-1][-1]) / np.float32(own)
        return float(np.float32(own - 2 * mutual) * norm), float(np.float32(2 * mutual) * norm)

    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = ("".join(rng.choice(list(rpa.RESIDUES[:6]), int(rng.integers(1, 14)))) for _ in range(2))
        assert rpa.align_protein(a, b) == pytest.approx(plain(a, b))


@pytest.mark.parametrize("alphabet", ["ACGTN", rpa.RESIDUES + "BX"])
def test_many_alignments(alphabet):
    """Pairs aligned at once against one by one: empty and unequal texts, and texts of several words of bits."""
    rng = np.random.default_rng(7)
    text_ = lambda n: "".join(rng.choice(list(alphabet), n))
    pairs = []
    for n in [0, 1, 2, 40, 63, 64, 65, 127, 128, 129, 200] * 12:
        a = text_(n)
        k = int(rng.integers(0, n + 1))
        pairs += [(a, a[:k] + text_(3) + a[k + 2 :]), (a, text_(int(rng.integers(0, 80))))]
    if len(alphabet) < 9:
        assert rpa.align_dna_pairs(pairs) == [rpa.align_dna(*p) for p in pairs]
    else:
        assert rpa.align_protein_pairs(pairs) == [rpa.align_protein(*p) for p in pairs]


def test_side_by_side():
    """Many segments of up to 40 rows together give what each gives alone, and almost all alignments are made in bulk."""
    rng = np.random.default_rng(5)
    text_ = lambda: "".join(rng.choice(list("ACGT"), 40))
    base = [text_() for _ in range(3)]
    near = lambda t: "".join(c if rng.random() > 0.1 else rng.choice(list("ACGT")) for c in t)
    taxa = sorted(PATHS)
    def make(align):
        return [rpa.Placement(rows, q, 0.5, 0.05, align) for rows, q in sets]
    sets = []
    for n in [2, 3, 5, 9, 17, 40] * 8:
        t = base[n % 3]
        sets.append(([row(i, f"r{i}", int(rng.integers(80, 100)), int(rng.integers(10, 39)), 40, taxa[int(rng.integers(0, len(taxa)))], near(t)) for i in range(n)], near(t)))
    alone = make(rpa.align_dna)
    want = [p.run() for p in alone]
    single = []
    known = rpa.Known(lambda a, b: single.append(1) or rpa.align_dna(a, b))
    together = make(lambda a, b: known[a, b])
    assert rpa.side_by_side(together, known, rpa.align_dna_pairs) == want and [p.aligned for p in together] == [p.aligned for p in alone]
    assert not single and len(known) > 500


def test_place(spark, tax):
    """The distributed form against the kernel: no row, one row, equal rows, aligned rows on both strands."""
    p = tax.prune()
    up = lineages(p)
    genome = {"refA": "ACGTTGCAAC" * 12, "refB": "ACGTTGCATC" * 12, "refC": "GGGTTTCCCA" * 12}
    query = genome["refA"][10:110]
    back = genome["refB"][::-1].translate(str.maketrans("ACGT", "TGCA"))
    genome["refB"] = back
    rows = [
        (0, True, "q0", 1, 40, 100, "refA", 11, 50, 80.0, 38, 40, "40"), (1, False, "q1", 1, 40, 100, "refA", 11, 50, 80.0, 38, 40, "40"),
        (2, False, "q2", 1, 40, 100, "refA", 11, 50, 80.0, 40, 40, "40"), (3, False, "q2", 1, 40, 100, "refC", 11, 50, 70.0, 9, 40, "42"),
        (4, False, "q3", 1, 40, 100, "refA", 11, 50, 80.0, 30, 40, "40"), (5, False, "q3", 3, 30, 100, "refB", 108, 81, 79.0, 20, 30, "41"), (6, False, "q3", 1, 40, 100, "refC", 11, 50, 60.0, 10, 40, "42"),
    ]
    df = spark.createDataFrame(rows, "ordinal long, masked boolean, query_id string, query_start long, query_stop long, query_length long, ref_id string, ref_start long, ref_stop long, score double, identities long, aln_length long, taxid string").withColumn("evalue", F.lit(0.0))
    refs = spark.createDataFrame(list(genome.items()), "seq_id string, seq string")
    queries = spark.createDataFrame([(f"q{i}", query) for i in range(4)], "seq_id string, seq string")
    found = predictions.predict(segments.segment(df), p, queries=queries, references=refs)
    got = {r["query_id"]: r for r in found.collect()}
    told = lambda q: (got[q]["lower_lineage"][-1], got[q]["lower_lineage"][got[q]["upper_depth"]], got[q]["support"][0], got[q]["ival"], got[q]["refs"])
    assert told("q0") == ("1", "1", 0, 1.0, 0) and (got["q0"]["feature_begin"], got["q0"]["feature_end"]) == (1, 100)
    assert told("q1") == ("40", "1", 38, 1.0, 1) and told("q2") == ("40", "10", 40, 0.0, 2)
    kernel = rpa.Placement([
        {"ordinal": i, "query_start": a, "query_stop": b, "ref_id": r, "score": s, "identities": n, "aln_length": k, "lineage": up[t], "ref_seq": cut}
        for (i, _, _, a, b, _, r, _, _, s, n, k, t), cut in zip(rows[4:], (genome["refA"][10:50], back[70:110][::-1].translate(str.maketrans("ACGT", "TGCA")), genome["refC"][10:50]), strict=True)
    ], query[:40], 0.5, 0.05, rpa.align_dna)
    x = kernel.run()
    assert (got["q3"]["lower_lineage"], got["q3"]["support"][0], got["q3"]["passes"]) == (list(x["lower"]), x["support"], kernel.aligned) and sum(kernel.aligned) > 2
    log = {r["query_id"]: r["value"] for r in rpa.log_lines(found, p.nodes.select("taxid", "name")).collect()}
    assert log["q1"].startswith("ID\t1:40@q1\n  NUMREF\t1\n    RANGE\tSpA1\tSpA1\troot\n") and "STATS\t-1:-1@q0\t0\t0\t0\t0\t0\t0.00" in log["q0"]
    with pytest.raises(Exception, match="no sequence"):
        predictions.predict(segments.segment(df), p, queries=queries, references=refs.where("seq_id <> 'refC'")).collect()
    with pytest.raises(ValueError, match="no prediction method"):
        predictions.predict(df, p, "best")


def test_bad_alignment_rows(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("# c\n\nq\t1\t2\t9\tr\t1\t2\t5\t0.1\t2\t2\n*q\t1\t2\t9\tr\t1\t2\t5\t0.1\t2\t2\tc\nq\t3\t2\t9\tr\t1\t2\t5\t0.1\t2\t2\nq\tx\n")
    loose = text.read_alignments(spark, str(tmp_path / "a.tsv"), strict=False).orderBy("ordinal").collect()
    assert [(r["masked"], r["error"]) for r in loose] == [(False, None), (True, None), (False, "query start beyond stop"), (False, "line too short")]
    with pytest.raises(Exception, match="beyond stop|too short"):
        text.read_alignments(spark, str(tmp_path / "a.tsv")).collect()


def test_fasta(spark, tmp_path):
    raw = ">s1 variant A->G\nACGT\nACG\n>s2\nAA\n>s3\n>s1 again\r\nGG\r\nG\r\n"
    (tmp_path / "a.fa").write_bytes(raw.encode())
    path = f"file://{tmp_path}/a.fa"
    index = text.build_fai(spark, path)
    fai = {r["offset"]: (r["name"], r["length"], r["line_bases"], r["line_bytes"]) for r in index.collect()}
    assert fai == {raw.index("ACGT"): ("s1", 7, 4, 5), raw.index("AA\n"): ("s2", 2, 2, 3), raw.index(">s1 again"): ("s3", 0, 0, 0), raw.index("GG\r"): ("s1", 3, 2, 4)}
    assert {r["seq_id"]: r["seq"] for r in text.read_fasta(spark, path).collect()} == {"s1": "GGG", "s2": "AA", "s3": ""}
    want = spark.createDataFrame([("s2", 0, 2), ("s2", 1, 99), ("s2", 50, 60), ("s3", 0, 5), ("none", 0, 1)], "name string, begin long, end long")
    assert sorted((r["name"], r["begin"], r["seq"]) for r in text.read_regions(want, index).collect()) == [("s2", 0, "AA"), ("s2", 1, "A"), ("s2", 50, ""), ("s3", 0, "")]
    both = spark.createDataFrame([("s1", 1, 6)], "name string, begin long, end long")
    assert sorted(r["seq"] for r in text.read_regions(both, index).collect()) == ["CGTAC", "GG"]
    (tmp_path / "b.fa").write_text(">s\nAC\nACG\nA\n")
    with pytest.raises(Exception, match="unequal lines"):
        text.build_fai(spark, str(tmp_path / "b.fa")).collect()
    with pytest.raises(Exception, match="comes again"):
        text.strip_identifiers(spark.createDataFrame([("a b",), ("a c",)], "seq_id string")).collect()


def _exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("name, most", [("prd_simple_lca", 1), ("prd_megan_lca", 1), ("prd_ic_megan_lca", 1), ("flt_best_per_taxon", 1), ("tax_lcc_set", 1), ("gff_encode", 1), ("bin_consensus", 1), ("bin_constraint", 1)])
def test_dealt_once(spark, name, most):
    """Rows are dealt by query once, from the raw alignments to the result."""
    assert _exchanges(engine_queries.QUERIES[name](spark, SF)) <= most


@pytest.mark.parametrize("view", ["resolved", "predictions"])
def test_views_are_not_written(spark, view):
    """What the queries share comes from the raw alignments, dealt once, and not from a written table that must be dealt again."""
    from cladeflow import fixtures

    df = getattr(fixtures, view)(spark, SF)
    assert any("lineitem.parquet" in f for f in df.inputFiles()) and _exchanges(df) == 1


def test_support_adds_up_first(spark):
    """A row for each path goes up the tree, not a row for each segment and node."""
    df = spark.range(1000).select(F.array(F.lit("1"), F.lit("2"), F.concat(F.lit("x"), F.col("id") % 7)).alias("lower_lineage"), F.lit(1).alias("upper_depth"), F.array(F.lit(9).cast("long"), F.lit(4).cast("long")).alias("support"))
    assert binning.own_support(df).count() == 8
    assert {r["taxid"]: r["support"] for r in binning.sample_support(df.where("id < 7")).collect()} == {"1": 63, "2": 63, **{f"x{i}": 4 for i in range(7)}}


def test_sparse_spans(spark):
    """Ordinals far apart make a span of each row; what is ordered in one task stays small, and the groups are right."""
    df = spark.range(70000).select((F.col("id") * 200000).alias("ordinal"), (F.floor(F.col("id") / 3) % 5).cast("string").alias("query_id"))
    got = segments.segment(df, split=False, consecutive=True)
    assert got.where("group_no <> 1 + floor(ordinal / 600000)").count() == 0 and got.count() == 70000
    spans = df.select(F.floor(F.col("ordinal") / segments.SPAN).alias("_span"), F.col("query_id").alias("first"), F.col("query_id").alias("last"), F.lit(0).alias("changes"))
    assert segments.span_levels(spans)[-1].count() == 1


def test_index_of_parts(spark, tmp_path, monkeypatch):
    """Parts in order have the index of the one file that they make, and fasta_index writes several."""
    raw = [f">r{i}\n{'ACGT' * (i % 7)}\n" for i in range(90)]
    (tmp_path / "one").mkdir(), (tmp_path / "parts").mkdir()
    (tmp_path / "one" / "a.fa").write_text("".join(raw))
    for k in range(3):
        (tmp_path / "parts" / f"part-{k}.fa").write_text("".join(raw[30 * k : 30 * k + 30]))
    told = lambda path, **kw: sorted(map(tuple, text.build_fai(spark, path, **kw).drop("file").collect()))
    assert told(f"file://{tmp_path}/parts", one="x") == told(f"file://{tmp_path}/one") and len(told(f"file://{tmp_path}/parts", one="x")) == 90
    written = []
    keep = text.write_fasta
    monkeypatch.setattr(text, "write_fasta", lambda df, path: (written.append(df.rdd.getNumPartitions()), keep(df, path)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        engine_queries.QUERIES["fasta_index"](spark, SF).count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert written[0] > 1


def test_bioboxes_parts(spark, tmp_path):
    """Each partition writes its own part; the header is the first, and the rows are all there."""
    rows = [(f"s{i}", str(i), i, 9) for i in range(400)]
    df = spark.createDataFrame(rows, "sequence_id string, taxid string, support long, length long").repartition(4)
    text.write_bioboxes(df, str(tmp_path / "b"), "one")
    parts = sorted(p.name for p in (tmp_path / "b").glob("part-*"))
    assert len(parts) == 5 and (tmp_path / "b" / parts[0]).read_text() == "@Version:0.9.0\n@SampleID:one\n@@SequenceID\tTaxID\t_Cladeflow_Support\t_Cladeflow_Length\n"
    assert text.read_bioboxes_header(spark, str(tmp_path / "b"))[0] == {"Version": "0.9.0", "SampleID": "one"}
    assert sorted(map(tuple, text.read_bioboxes(spark, str(tmp_path / "b")).collect())) == sorted(rows)


def test_stream_files(spark, monkeypatch):
    """As many files as a shuffle has partitions, in four batches."""
    from cladeflow import streaming

    told = {}
    whole, start = streaming.write_whole, streaming.stream_operator
    monkeypatch.setattr(streaming, "write_whole", lambda rows, folder, files: (told.update(files=files), whole(rows, folder, files)))
    monkeypatch.setattr(streaming, "stream_operator", lambda *a, **kw: (told.update(kw), start(*a, **kw))[1])
    spark.conf.set("spark.sql.shuffle.partitions", "10")
    try:
        rows = spark.range(500).select(F.col("id").alias("n"), (F.col("id") % 40).alias("query_id"))
        assert streaming.run_stream(spark, rows, lambda df: df).count() == 500
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert told == {"files": 10, "files_per_batch": 3}


def test_maf(spark, tmp_path):
    (tmp_path / "a.maf").write_text("# x\na score=12 E=1e-3\ns ref 2 4 + 10 AC-GT\ns q 0 4 - 4 ACTG-\n\n")
    r = text.maf_to_alignments(text.read_maf(spark, str(tmp_path / "a.maf"))).first()
    assert (r["query_start"], r["query_stop"], r["ref_start"], r["ref_stop"], r["identities"], r["aln_length"]) == (1, 4, 6, 3, 3, 5)
    r = text.maf_to_alignments(text.read_maf(spark, str(tmp_path / "a.maf")), protein=True).first()
    assert (r["query_start"], r["query_stop"], r["ref_start"], r["ref_stop"]) == (4, 1, 3, 6)


def test_gff_version_line(spark, tmp_path):
    rows = [(f"q{i}", 1, 9, 9, "1", 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "query_id string, feature_begin long, feature_end long, seqlen long, rtax string, ival double").repartition(4)
    text.write_gff3(df, F.lit("1"), str(tmp_path / "g"))
    parts = [p.read_text().split("\n") for p in (tmp_path / "g").glob("part-*")]
    assert len(parts) == 4 and all(p[0] == text.GFF_HEAD and p.count(text.GFF_HEAD) == 1 for p in parts)
    assert text.read_predictions(spark, str(tmp_path / "g")).count() == 40


@pytest.mark.parametrize("layout", sorted(text.LAYOUTS))
def test_bioboxes(spark, tmp_path, layout):
    df = spark.createDataFrame([("s1", "7", "b1", 5, 9)], "sequence_id string, taxid string, bin_id string, support long, length long")
    text.write_bioboxes(df, str(tmp_path / "b"), "one", "v1", layout=layout, tags={"Note": "a:b"})
    values, columns = text.read_bioboxes_header(spark, str(tmp_path / "b"))
    assert values == {"Version": "0.9.0", "SampleID": "one", "TaxonomyID": "v1", "_Cladeflow_Note": "a:b"} and columns[0] == "SequenceID"
    got = text.read_bioboxes(spark, str(tmp_path / "b")).first().asDict()
    assert got == {k: v for k, v in {"sequence_id": "s1", "taxid": "7", "bin_id": "b1", "support": 5, "length": 9}.items() if k not in {"taxid": ["bin_id"], "binid": ["taxid"], "taxid_binid": []}[layout]}


def test_taxonomy_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setenv(text.TAXONOMY_VARIABLE, str(tmp_path))
    (tmp_path / "nodes.dmp").write_text("1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tgenus\t|\n")
    (tmp_path / "names.dmp").write_text("1\t|\troot\t|\t\t|\tscientific name\t|\n2\t|\tG\t|\t\t|\tscientific name\t|\n2\t|\tgee\t|\t\t|\tsynonym\t|\n")
    assert text.read_taxonomy_version(spark) == ""
    (tmp_path / "version.txt").write_text("v7\nmore\n")
    assert text.read_taxonomy_version(spark) == "v7"
    assert sorted(map(tuple, text.read_taxonomy_edges(spark).collect())) == [("1", "1", "no rank", "root"), ("2", "1", "genus", "G")]


def test_fields(spark):
    rows = ["a\tb\tc", "a\tb", "a\t", "", "a"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, value string").orderBy("i")
    assert [r[0] for r in df.select(fn.fields(F.col("value"), "\t", 2)).collect()] == [["a", "b", "c"], ["a", "b", ""], ["a", ""], [""], ["a", ""]]
    assert [r[0] for r in df.select(fn.fields(F.col("value"), "\t")).collect()][:2] == [["a", "b", "c", ""], ["a", "b", ""]]
    assert df.select(fn.fields(F.lit("x||y||"), "||", tail=False)).first()[0] == ["x", "y"]


def test_newick_forms(spark, tax):
    df = spark.createDataFrame([("40",), ("43",), ("99",)], "t string")
    form = lambda **kw: tx.newick(df, tax, "t", ("superkingdom", "phylum", "genus", "species"), **kw).first()[0]
    assert form() == "((((40)30)10,(43)11)2);"
    assert form(names=True) == "((((SpA1)GenA)PhyA,(unclassified PhyB sp.)PhyB)Bacteria);"
    assert form(fill=True) == "((((40)30)10,((43))11)2);"
    assert tx.newick(df.where("t = 'x'"), tax, "t").first()[0] == "();"


def test_consecutive_spans(spark, monkeypatch):
    """Groups that go on over spans, begin at their border, or leave one out."""
    monkeypatch.setattr(segments, "SPAN", 4)
    ids = "aaabbbbbbbaaccccaaaabc"
    rows = [(i if i < 12 else i + 20, x) for i, x in enumerate(ids)]
    df = spark.createDataFrame(rows, "ordinal long, query_id string")
    got = [r["group_no"] for r in segments.segment(df, split=False, consecutive=True).orderBy("ordinal").collect()]
    want, n = [], 0
    for i, x in enumerate(ids):
        n += not i or x != ids[i - 1]
        want.append(n)
    assert got == want


WITH_SQL = sorted(engine_queries.ORACLE)


@pytest.mark.parametrize("name", WITH_SQL)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    a, b = engine_queries.QUERIES[name](spark, SF).toPandas(), con.execute(engine_queries.ORACLE[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    rows = lambda d: sorted(map(str, d[sorted(d.columns)].astype(str).itertuples(index=False, name=None)))
    assert rows(a) == rows(b)


@pytest.mark.parametrize("name", sorted(set(engine_queries.QUERIES) - set(engine_queries.ORACLE) - {"rpa_protein"}))
def test_runs(spark, name):
    assert engine_queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_affine_scores(spark):
    from cladeflow import functions as fn
    from cladeflow.operators.rpa import SCORES

    rows = [("ACGT", "ACGT"), ("AC--GT", "ACTTGT"), ("A-CN", "AT-N"), ("--AC", "--AC"), ("", "")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(fn.affine_score_dna(df.a, df.b, 2, -3, 5, 1).alias("d"), fn.affine_score_protein(df.a, df.b, 11, 1, SCORES).alias("p")).collect()
    # a run goes on when the gap changes sides; N matches nothing; columns of two gaps cost in DNA alone
    assert [r.d for r in got] == [8.0, 8.0 - 7.0, 2 - 7.0 - 3, 4 - 7.0, 0.0]
    assert [r.p for r in got] == [4 + 9 + 6 + 5.0, 24 - 12.0, 4 - 12.0 + 6, 13.0, 0.0]


def test_deep_tree(spark):
    """Long paths, orphans and a cycle."""
    chain = [("1", "1", "no rank", "root")] + [(str(i), str(i - 1), "r", f"n{i}") for i in range(2, 75)] + [("x", "y", "r", "x"), ("z", "x", "r", "z"), ("s", "s", "r", "self"), ("c1", "c2", "r", "c"), ("c2", "c3", "r", "c"), ("c3", "c1", "r", "c"), ("c4", "c1", "r", "c")]
    schema = "taxid string, parent_taxid string, rank string, name string"
    got = lineages(tx.Taxonomy.build(spark.createDataFrame(chain, schema)))
    assert set(got) == {str(i) for i in range(1, 75)} and got["74"] == [str(i) for i in range(1, 75)]
