"""Approximate nearest neighbours by cosine: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample and every vector is put in a leaf. A query pops tree nodes from a priority
queue, nearest centroid first, and visits leaves in that order. How many it visits is calibrated: for a bounded set
of queries the true neighbours are found by brute force, and visits widen until the wanted recall is reached.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part, nor do those of
another dimension than most of the sample; equal scores go to the smaller id; rows with the query's own id are not
its candidates; repeated rows with one id count each; too few candidates are returned all; an empty table gives no row.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.runtime import materialize, ship


class Tree:
    """Nodes as arrays; a leaf has a number, an inner node its children's span."""

    def __init__(self, unit: np.ndarray, leaves: int, branch: int, seed: int):
        rng = np.random.default_rng(seed)
        centre, first, last, leaf = [unit.mean(0)], [0], [0], [-1]
        size = max(1, math.ceil(len(unit) / max(1, leaves)))
        todo, self.leaves = [(0, np.arange(len(unit)))], 0
        while todo:
            node, rows = todo.pop()
            parts = self._split(unit[rows], min(branch, max(2, len(rows) // size)), rng) if len(rows) > 1.5 * size else None
            if parts is None:
                leaf[node], self.leaves = self.leaves, self.leaves + 1
                continue
            first[node] = len(centre)
            for p in parts:
                todo.append((len(centre), rows[p]))
                centre.append(unit[rows[p]].mean(0))
                first.append(0)
                last.append(0)
                leaf.append(-1)
            last[node] = len(centre)
        self.centre = np.array(centre, np.float32)
        self.first, self.last, self.leaf = first, last, leaf

    @staticmethod
    def _split(x: np.ndarray, k: int, rng: np.random.Generator) -> list[np.ndarray] | None:
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(8):
            own = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
            used = np.unique(own)
            c = np.stack([x[own == j].mean(0) for j in used])
        parts = [np.flatnonzero(own == j) for j in used]
        return parts if len(parts) > 1 else None

    def distances(self, q: np.ndarray, a: int, b: int) -> np.ndarray:
        d = self.centre[a:b] - q
        return np.einsum("ij,ij->i", d, d)

    def assign(self, unit: np.ndarray) -> np.ndarray:
        """Each vector's leaf: the nearest child, level by level."""
        out, todo = np.zeros(len(unit), np.int32), [(0, np.arange(len(unit)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            a, b = self.first[node], self.last[node]
            c = self.centre[a:b]
            own = ((c * c).sum(1) - 2 * unit[rows] @ c.T).argmin(1)
            todo += [(a + j, rows[own == j]) for j in np.unique(own)]
        return out

    def visits(self, q: np.ndarray) -> Iterator[int]:
        """Leaves from a priority queue of nodes, nearest centroid first."""
        heap = [(0.0, 0)]
        while heap:
            _, node = heapq.heappop(heap)
            if self.leaf[node] >= 0:
                yield self.leaf[node]
                continue
            a, b = self.first[node], self.last[node]
            for d, j in zip(self.distances(q, a, b).tolist(), range(a, b), strict=True):
                heapq.heappush(heap, (d, j))


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col("v")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.coalesce(fine, F.lit(False)) & F.col("id").isNotNull())


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(1, keepdims=True)
    x = x / big
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """In double precision on the original vectors; the same bits for the same pair wherever it stands. Powers of two taken
    out of each vector change no bit, and keep squares of large and small components in range."""
    scaled = lambda a: np.ldexp(a, -np.frexp(np.abs(a).max(-1, keepdims=True))[1])
    norm = lambda a: np.sqrt((a * a).sum(-1))
    q, x = scaled(q), scaled(x)
    return (q * x).sum(-1) / (norm(q) * norm(x))


def nearest(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k nearest rows of a block.

    Of equal vectors only the k + 1 smallest ids can be among the nearest, and rows of equal ids: the rest is left out."""
    order = np.lexsort((ids, *([x[:, j] for j in range(min(x.shape[1], 4))])))
    ids, x = ids[order], x[order]
    new = np.concatenate([[True], (x[1:] != x[:-1]).any(1)]) if len(x) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    nth = np.arange(len(x)) - np.repeat(at, np.diff(np.append(at, len(x))))
    own = np.isin(ids, qids)
    nth = nth - np.concatenate([[0], np.cumsum(own)])[:-1] + np.repeat(np.concatenate([[0], np.cumsum(own)])[at], np.diff(np.append(at, len(x)))) if len(x) else nth
    keep = (nth <= k) | own
    ids, x = ids[keep], x[keep]
    u, uq = unit(x), unit(q)
    for a in range(0, len(q), 256):
        near = uq[a : a + 256] @ u.T
        for row, qid, qv in zip(near, qids[a : a + 256], q[a : a + 256], strict=True):
            ok = np.flatnonzero(ids != qid)
            if len(ok) > k:
                limit = np.partition(row[ok], len(ok) - k)[len(ok) - k] - 1e-9
                ok = ok[row[ok] >= limit]
            score = cosine(qv, x[ok]) if len(ok) else np.zeros(0)
            best = np.lexsort((ids[ok], -score))[:k]
            yield int(qid), ids[ok][best], score[best]


HITS = "query_id long, vec_id long, score double"
HIT_SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def hits(found: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    q, v, s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for qid, ids, score in found:
        q.append(np.full(len(ids), qid))
        v.append(ids)
        s.append(score)
    return pa.Table.from_arrays([pa.array(np.concatenate(q)), pa.array(np.concatenate(v)), pa.array(np.concatenate(s))], schema=HIT_SCHEMA)


def top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(rows: DataFrame, queries: DataFrame, k: int, most_queries: int) -> DataFrame:
    """Exact neighbours of a bounded set of queries, which every task holds."""
    held = queries.limit(most_queries).toArrow()
    qids, q = held.column("id").to_numpy(), matrix(held.column("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and len(qids):
                yield from hits(nearest(b.column("id").to_numpy(), matrix(b.column("v")), qids, q, k)).to_batches()

    return top(rows.mapInArrow(run, HITS), k)


class Index:
    """The tree, each vector's leaf, and how many leaves a query visits."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, recall: float = 0.95, sample: int = 20_000, calibrate: int = 128, leaf_rows: int = 200, branch: int = 12, seed: int = 11):
        spark = vectors.sparkSession
        ship(spark)
        self.k = k
        fine = usable(vectors, id_col, vector_col)
        # the fit: at most `sample` vectors, taken by a hash of their ids
        held = fine.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
        sizes = Counter(held.column("v").combine_chunks().value_lengths().to_pylist()) if held.num_rows else Counter()
        self.dim = sizes.most_common(1)[0][0] if sizes else 0
        fine = fine.where(F.size("v") == self.dim)
        x = matrix(held.column("v").filter(pa.compute.equal(held.column("v").combine_chunks().value_lengths(), self.dim))) if self.dim else np.zeros((0, 1))
        n = fine.count()
        self.tree = tree = Tree(unit(x).astype(np.float32), min(max(1, n // leaf_rows), max(1, len(x) // 8)), branch, seed) if len(x) else None

        def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    own = tree.assign(unit(matrix(b.column("v"))).astype(np.float32))
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own)], names=["id", "v", "leaf"])

        self.rows = materialize(fine.mapInArrow(leaf, "id long, v array<double>, leaf int"), "leaves")
        # a number for each leaf; leaves are at most an eighth of the sample
        self.sizes = {r["leaf"]: r["n"] for r in self.rows.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
        self.calibrated = calibrate
        self.visits, self.recall = self._calibrate(recall, calibrate)

    def _calibrate(self, wanted: float, most: int) -> tuple[int, float]:
        if not self.sizes:
            return 1, 1.0
        queries = self.rows.orderBy(F.xxhash64(F.lit(3), "id"), "id").select("id", "v").limit(most)
        true = brute_force(self.rows.select("id", "v"), queries, self.k, most)
        pairs = true.join(self.rows.select(F.col("id").alias("vec_id"), "leaf"), "vec_id").select("query_id", "leaf").collect()  # at most k times `most` rows, repeated ids aside
        held = queries.toArrow()
        at = {i: {f: n for n, f in enumerate(self.tree.visits(v))} for i, v in zip(held.column("id").to_pylist(), unit(matrix(held.column("v"))), strict=True)}
        when = sorted(at[r["query_id"]][r["leaf"]] for r in pairs if r["query_id"] in at)
        if not when:
            return 1, 1.0
        visits = when[min(len(when) - 1, math.ceil(wanted * len(when)) - 1)] + 1
        return visits, sum(w < visits for w in when) / len(when)

    def measured(self, most: int = 256) -> tuple[float, float]:
        """Recall against brute force for at most so many queries that calibration never saw, and the share of all rows that a
        query's leaves hold."""
        if not self.sizes:
            return 1.0, 1.0
        seen = self.rows.orderBy(F.xxhash64(F.lit(3), "id"), "id").select("id").limit(self.calibrated)
        queries = self.rows.join(F.broadcast(seen), "id", "left_anti").orderBy(F.xxhash64(F.lit(4), "id"), "id").select("id", "v").limit(most)
        queries = materialize(queries, "recall-queries")
        true = brute_force(self.rows.select("id", "v"), queries, self.k, most).select("query_id", "vec_id").distinct()
        found = self.search(queries).select("query_id", "vec_id").distinct()
        n = true.count()
        total = sum(self.sizes.values())
        read = [sum(self.sizes.get(f, 0) for f in itertools.islice(self.tree.visits(q), self.visits)) / total for q in unit(matrix(queries.toArrow().column("v")))]
        return (true.join(found, ["query_id", "vec_id"]).count() / n if n else 1.0), (sum(read) / len(read) if read else 1.0)

    def search(self, queries: DataFrame, block: int = 4096) -> DataFrame:
        """The k nearest found of each query (id, v), its own id left out."""
        k, tree, visits, sizes = self.k, self.tree, self.visits, self.sizes
        if not sizes:
            return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                take, leaves = [], []
                for i, q in enumerate(unit(matrix(b.column("v")))):
                    seen = rows = 0
                    for f in tree.visits(q):
                        if seen >= visits and rows > 2 * k:
                            break
                        seen, rows = seen + 1, rows + sizes.get(f, 0)
                        if f in sizes:
                            take.append(i)
                            leaves.append(f)
                c = b.take(pa.array(take, pa.int64()))
                yield pa.RecordBatch.from_arrays([*c.columns, pa.array(leaves, pa.int32())], names=["id", "v", "leaf"])

        routed = queries.mapInArrow(route, "id long, v array<double>, leaf int")
        asked = materialize(routed, "routes")
        # a leaf's rows and its queries are both dealt in blocks: no task holds more than a block of each
        counts = asked.groupBy("leaf").agg(F.count("*").alias("n"))
        spark = queries.sparkSession
        parts = spark.createDataFrame([(f, max(1, -(-n // block))) for f, n in sorted(sizes.items())], "leaf int, row_parts int")
        plan = counts.join(F.broadcast(parts), "leaf").select("leaf", "row_parts", F.ceil(F.col("n") / block).cast("int").alias("query_parts"))
        plan = F.broadcast(plan)  # a row for each leaf
        part = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "id", F.monotonically_increasing_id()), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        right = self.rows.join(plan, "leaf").withColumn("rp", part("row_parts", 1)).withColumn("qp", every("query_parts")).select("id", "v", "leaf", "rp", "qp")
        left = asked.join(plan, "leaf").withColumn("qp", part("query_parts", 2)).withColumn("rp", every("row_parts")).select("id", "v", "leaf", "rp", "qp")

        def score(q: pa.Table, x: pa.Table) -> pa.Table:
            if not q.num_rows or not x.num_rows:
                return HIT_SCHEMA.empty_table()
            return hits(nearest(x.column("id").to_numpy(), matrix(x.column("v")), q.column("id").to_numpy(), matrix(q.column("v")), k))

        keys = ("leaf", "rp", "qp")
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, HITS)
        return top(found, k)


def op6_nearest_neighbours(spark, sf_dir):
    from cladeflow.runtime import table

    index = Index(table(spark, sf_dir, "embeddings"))
    return index.search(index.rows.where("id % 50 = 0").select("id", "v"))
