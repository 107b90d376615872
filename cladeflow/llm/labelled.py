"""Labelled rows for fitting: a fixed fold of the ids, at most so many rows of each class."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeflow.llm import common
from cladeflow.runtime import ship


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[pa.Table, dict[int, int]]:
    """Texts and labels (text, y) of at most per_class rows a class outside the held-out fold, and all rows' class sizes.

    An id with several labels counts as its smallest; of repeated documents one is taken."""
    rows = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)").where(~held_out("id"))
    rows = rows.groupBy("id").agg(F.min("y").alias("y"))
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    pick = None
    for y in (0, 1):
        part = rows.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
        pick = part if pick is None else pick.unionAll(part)
    # at most twice per_class ids: their size is bounded by the parameter
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(pick), "id")
    out = d.groupBy("id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("id", "y", "text").toArrow()
    return out.sort_by("id"), sizes


def chunks(column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of bounded slices of a text column."""
    for b in pa.table({"text": column}).combine_chunks().to_batches():
        for piece in common.pieces_of(b, "text", 1 << 20):
            yield common.text_bytes(piece.column("text"))


def scored(docs: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray | tuple[np.ndarray, ...]], threshold: float, id_col: str = "doc_id", text_col: str = "text", keep: str = "", more: tuple[str, ...] = ()) -> DataFrame:
    """id, held_out, score and predicted of each row, and the long columns that score() gives besides (more); with keep, the
    row's own columns and predicted alone, under that name, which must be free."""
    if keep and keep.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {keep} is there already")
    spark = docs.sparkSession
    ship(spark)
    names = docs.columns if keep else [id_col, text_col]
    inner = [f"c{i}" for i in range(len(names))]
    kinds = dict(docs.dtypes)
    text = inner[names.index(text_col)]
    rest = [c for c in inner if keep or c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in common.pieces_of(batch, text, 1 << 20):
                s = score(*common.text_bytes(b.column(text)))
                s, extra = (s[0], s[1:]) if isinstance(s, tuple) else (s, ())
                extra = [] if keep else [pa.array(x, pa.int64(), mask=x < 0) for x in extra]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(s, pa.float64()), *extra], names=[*rest, "score", *extras])

    extras = [] if keep else [f"x{i}" for i in range(len(more))]
    schema = ", ".join([*(f"{c} {kinds[n]}" for c, n in zip(inner, names, strict=True) if c in rest), "score double", *(f"{x} long" for x in extras)])
    out = docs.select(*(F.col(f"`{n}`").alias(c) for n, c in zip(names, inner, strict=True))).mapInArrow(run, schema)
    predicted = (F.col("score") >= threshold).cast("int")
    if keep:
        return out.select(*(F.col(c).alias(n) for n, c in zip(names, inner, strict=True)), predicted.alias(keep))
    return out.select(F.col(inner[0]).alias(id_col), held_out(inner[0]).alias("held_out"), "score", predicted.alias("predicted"), *(F.col(x).alias(n) for x, n in zip(extras, more, strict=True)))
