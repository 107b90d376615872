"""Scalar expressions over alignments and sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pid() -> Column:
    """Identities over the longer of query and alignment, in single precision."""
    return (F.col("identities") / F.greatest("query_length", "aln_length")).cast("float")


def field(text: Column, delimiter: str, n: int) -> Column:
    """The n-th field (from 0) of a line; null beyond its end."""
    return F.get(F.split(text, delimiter), F.lit(n))


def fields(text: Column, delimiter: str = "\t", n: int = 0, tail: bool = True) -> Column:
    """The first n fields (0: all) and the rest of the line, which is there even if it is empty; without tail an empty rest goes."""
    parts = F.split(text, "\\Q" + delimiter + "\\E", n + 1 if n else -1)
    last = F.element_at(parts, -1) == ""
    if not tail:
        return F.when(last, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    short = ~last & (F.size(parts) <= n) if n else ~last
    return F.when(short, F.concat(parts, F.array(F.lit("")))).otherwise(parts)


def first_word(text: Column) -> Column:
    return F.regexp_extract(text, r"^(\S*)", 1)


def gi_field(text: Column, key: str = "gi") -> Column:
    """The value after a key in an identifier of the form gi|123|..., else null."""
    return F.nullif(F.regexp_extract(text, rf"(?:^|\|){key}\|([^|]*)", 1), F.lit(""))


def glob_id(text: Column, regex: str) -> Column:
    """Group 1 of a full match, which must be there and not empty; an empty pattern puts all in one bin."""
    if not regex:
        return F.lit("consensus_sequence")
    got = F.regexp_extract(text, f"^(?:{regex})$", 1)
    return F.when(got != "", got).otherwise(F.raise_error(F.concat(F.lit("identifier doesn't match: "), text)).cast("string"))


def dna(text: Column) -> Column:
    """A, C, G, T in capitals, U read as T, all else N."""
    return F.regexp_replace(F.translate(text, "acgtuU", "ACGTTT"), "[^ACGT]", "N")


def revcomp(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def infix(seq: Column, start: Column, stop: Column) -> Column:
    """Places start to stop, from 1 and inclusive, the stop held at the end; a start beyond the end is an error."""
    size = F.length(seq)
    return F.when(start <= size, F.substring(seq, start, F.least(stop, size) - start + 1)).otherwise(F.raise_error(F.lit("start beyond the sequence")).cast("string"))


def ref_segment(seq: Column, start: Column, stop: Column, left: Column, right: Column) -> Column:
    """The aligned part widened on both sides; start > stop is the reverse strand, widened the other way round."""
    ahead = infix(seq, F.greatest(F.lit(1), start - left), stop + right)
    back = revcomp(infix(seq, F.greatest(F.lit(1), stop - right), start + left))
    return F.when(start <= stop, ahead).otherwise(back)


def edit_bounds(a: Column, b: Column) -> Column:
    """Unit-cost edit distance and what it bounds: gaps, mismatches, matches."""
    d = F.levenshtein(a, b)
    gap = F.abs(F.length(a) - F.length(b))
    least = F.least(F.length(a), F.length(b))
    return F.struct(d.alias("distance"), gap.alias("gaps"), (d - gap).alias("mismatches"), (least - (d - gap)).alias("matches"))


def score_text(score: Column) -> Column:
    return F.when(score.isNull() | F.isnan(score), F.lit(".")).otherwise(score.cast("string"))


def score_value(text: Column) -> Column:
    return F.when(text == ".", F.lit(float("nan"))).otherwise(text.try_cast("double"))


def cigar(query: Column, ref: Column) -> Column:
    """Runs of =, X, I and D of two gapped strings of one length."""
    kind = F.zip_with(
        F.split(query, ""), F.split(ref, ""),
        lambda q, r: F.when(r == "-", "I").when(q == "-", "D").when(F.upper(q) == F.upper(r), "=").otherwise("X"),
    )
    text = F.array_join(kind, "")
    runs = F.regexp_extract_all(text, F.lit("(=+|X+|I+|D+)"), 1)
    return F.array_join(F.transform(runs, lambda x: F.concat(F.length(x).cast("string"), F.substring(x, 1, 1))), "")


def columns_equal(a: Column, b: Column) -> Column:
    """Columns of two gapped strings that agree, case aside."""
    return F.size(F.filter(F.zip_with(F.split(F.upper(a), ""), F.split(F.upper(b), ""), lambda x, y: (x == y) & (x != "-")), lambda x: x))


def affine_score_dna(a: Column, b: Column, match: float, mismatch: float, gap_open: float, gap_extend: float) -> Column:
    """Score of two gapped strings of one length: only equal A, C, G, T match; each column of a run of gaps, on whichever
    side, costs an extension, and the run an opening."""
    kind = F.zip_with(
        F.split(F.upper(a), ""), F.split(F.upper(b), ""),
        lambda x, y: F.when((x == "-") | (y == "-"), "G").when(x == "", "").when((x == y) & x.isin(*"ACGT"), "M").otherwise("X"),
    )
    text = F.array_join(kind, "")
    count = lambda c: F.length(text) - F.length(F.translate(text, c, ""))
    runs = F.regexp_count(text, F.lit("G+"))
    return (count("M") * match + count("X") * mismatch - runs * gap_open - count("G") * gap_extend).cast("double")


def affine_score_protein(a: Column, b: Column, gap_open: float, gap_extend: float, matrix: dict[tuple[str, str], int], unknown: int = -4) -> Column:
    """Score of two gapped strings of one length by a symmetric matrix; pairs that it lacks score `unknown`.

    Columns with a gap on both sides count for nothing; the first gap of a run costs the opening, the others an extension."""
    pairs = F.filter(F.zip_with(F.split(F.upper(a), ""), F.split(F.upper(b), ""), lambda x, y: F.concat(x, y)), lambda p: ~p.isin("--", ""))
    known = F.create_map(*[F.lit(v) for (x, y), n in sorted(matrix.items()) for v in (x + y, n)])
    points = F.transform(pairs, lambda p: F.when(p.contains("-"), 0).otherwise(F.coalesce(F.try_element_at(known, p), F.lit(unknown))))
    shape = F.array_join(F.transform(pairs, lambda p: F.when(p.contains("-"), "G").otherwise("P")), "")
    runs = F.regexp_count(shape, F.lit("G+"))
    gaps = F.length(shape) - F.length(F.translate(shape, "G", ""))
    return (F.aggregate(points, F.lit(0), lambda s, x: s + x) - runs * gap_open - (gaps - runs) * gap_extend).cast("double")


def common_prefix(a: Column, b: Column) -> Column:
    """The longest common prefix of two arrays: the path to the lowest common ancestor of two lineages."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.slice(a, F.lit(1), F.when(first == 0, F.size(same)).otherwise((first - 1).cast("int")))


def support_at(support: Column, upper_depth: Column, depth: Column) -> Column:
    """A range's support at a depth: 0 above its upper node, the last value below its lower node."""
    return F.when(depth < upper_depth, F.lit(0).cast("long")).otherwise(F.element_at(support, F.least(depth - upper_depth + 1, F.size(support))))


def support_at_full(support: Column, upper_depth: Column, depth: Column) -> Column:
    """The variant with the lower node's support above the upper node."""
    return F.when(depth < upper_depth, F.element_at(support, -1)).otherwise(support_at(support, upper_depth, depth))


def protein_to_dna(start: Column, stop: Column, contig_start: Column, contig_stop: Column, strand: Column) -> Column:
    """Codons of protein places on their contig, mirrored on the minus strand."""
    plus = strand != "-"
    a = F.when(plus, contig_start + 3 * (start - 1)).otherwise(contig_stop - 3 * (stop - 1) - 2)
    b = F.when(plus, contig_start + 3 * (stop - 1) + 2).otherwise(contig_stop - 3 * (start - 1))
    return F.struct(a.alias("start"), b.alias("stop"))
