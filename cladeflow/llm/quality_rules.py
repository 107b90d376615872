"""Line-first cleaning: rules judge every line, failing lines go, and a document that loses too much text is rejected.

DataFrame functions only. Defined results: a null text has no words and is rejected; an empty text too; both have the empty
cleaned text, as has a text none of whose lines pass; lines without a word go too; a rejected document's cleaned text is
given all the same; repeated rows are judged each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the contract as a Java pattern and as characters, and symbols that prose lacks.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Phrases of site furniture.
BOILERPLATE = "cookie policy|privacy policy|terms of (?:use|service)|all rights reserved|accept cookies|javascript|subscribe now|sign up|log ?in|click here|read more|skip to content"
#: A line ends as a sentence does, closing quotes and brackets aside.
TERMINAL = r"[.!?…:;。！？][\"'”’»)\]]*\s*$"


def let(value: Column, body) -> Column:
    """Bind a value once inside an expression: the optimiser can't copy what a lambda variable holds."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda x: x != "")


def repeated_words(words: Column) -> Column:
    """Words within three-word windows that occur twice or more."""

    def covered(places: Column) -> Column:
        return F.aggregate(
            F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3)))),
            F.lit(0),
            lambda a, x: a + x,
        )

    def places(g: Column, sorted_: Column) -> Column:
        twice = F.array_distinct(F.filter(sorted_, lambda x, i: (i > 0) & (x == F.get(sorted_, i - 1))))
        few = lambda d: F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: F.array_contains(d, F.get(g, i)))

        def many(d: Column) -> Column:  # many repeated windows: sort them with their places instead of searching a list
            pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
            same = lambda p: F.filter(p, lambda x, k: ((k > 0) & (F.get(p, k - 1)["h"] == x["h"])) | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False)))
            return F.sort_array(F.transform(let(pairs, same), lambda x: x["i"]))

        return let(twice, lambda d: F.when(F.size(d) == 0, F.lit(0)).when(F.size(d) <= 48, let(few(d), covered)).otherwise(let(many(d), covered)))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(windows(words), lambda g: let(F.sort_array(g), lambda s: places(g, s))))


def line_passes(line: Column) -> Column:
    """A line of prose: it ends as a sentence, is no menu, no boilerplate, no shouting, and few of its characters are symbols."""
    size = F.length(line)
    symbols = size - F.length(F.translate(line, SYMBOLS, ""))
    capitals = size - F.length(F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    bars = size - F.length(F.translate(line, "|»•·", ""))
    short = size <= 200
    return (
        line.rlike(TERMINAL)
        & (bars < 3)
        & (symbols * 20 <= size)
        & ~((capitals * 2 > size) & (size > 20))
        & ~(short & F.lower(line).rlike(BOILERPLATE))
    )


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat_percent: int = 50, max_lost_percent: int = 50) -> DataFrame:
    """Counts, base verdict, characters of the lines with a word and of those that stay, the final verdict, and the cleaned
    text (clean_text: the lines that pass, parted by new lines) of each document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(SPACE.replace("[", "[^")))
    chars = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.length(x))
    counted = let(
        lines,
        lambda a: F.struct(
            (F.size(a) - F.size(F.array_distinct(a))).alias("dup"),
            chars(a).alias("all"),
            F.array_join(F.filter(a, line_passes), "\n").alias("clean"),
        ),
    )
    solid = F.length(F.translate(text, SPACE_CHARS, ""))
    words = let(words_of(text), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("again")))
    rows = docs.select(
        F.col(id_col),
        words.alias("_w"),
        counted.alias("_l"),
        solid.cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    n, again = F.col("_w.n").cast("long"), F.col("_w.again").cast("long")
    failed = (n < min_words) | (100 * again > max_repeat_percent * n)
    kept_chars = F.length(F.translate("_l.clean", "\n", "")).cast("long")
    rows = rows.withColumn("_k", kept_chars)
    lost = 100 * (F.col("_l.all") - F.col("_k")) > max_lost_percent * F.col("_l.all")
    return rows.select(
        id_col,
        n.alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("_l.dup").cast("long").alias("n_dup_lines"),
        again.alias("n_repeat_words"),
        F.col("_l.all").cast("long").alias("line_chars"),
        F.col("_k").alias("kept_chars"),
        failed.alias("base_failed"),
        (~failed & ~lost).alias("kept"),
        F.col("_l.clean").alias("clean_text"),
    )


def op4_quality_rules(spark, sf_dir):
    from cladeflow.runtime import table

    # kept_chars and the verdict come from the cleaned text, which itself is the operator's output
    return quality_rules(table(spark, sf_dir, "documents")).drop("clean_text")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
g2 AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS k FROM g),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g2) WHERE c > 1),
rw AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(ls) AS x FROM w),
p AS (SELECT doc_id, length(x) AS n, regexp_matches(x, '[.!?…:;。！？]["''”’»)\]]*\s*$')
        AND length(x) - length(translate(x, '|»•·', '')) < 3
        AND (length(x) - length(translate(x, '#*$%&|<>', ''))) * 20 <= length(x)
        AND NOT ((length(x) - length(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) * 2 > length(x) AND length(x) > 20)
        AND NOT (length(x) <= 200 AND regexp_matches(lower(x), '@BOILERPLATE@')) AS good FROM l),
s AS (SELECT doc_id, sum(n) AS a, coalesce(sum(n) FILTER (good), 0) AS k FROM p GROUP BY doc_id),
b AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
             (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(rw.n, 0)::BIGINT AS n_repeat_words, coalesce(s.a, 0)::BIGINT AS line_chars, coalesce(s.k, 0)::BIGINT AS kept_chars
      FROM w LEFT JOIN rw ON rw.doc_id = w.doc_id LEFT JOIN s ON s.doc_id = w.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND NOT (100 * (line_chars - kept_chars) > 50 * line_chars) AS kept FROM f
""".replace("@BOILERPLATE@", BOILERPLATE)
