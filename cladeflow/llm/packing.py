"""Packing token pieces into sequences with a grouping genetic algorithm.

Pieces of equal length are interchangeable, so an individual is a list of bins, each the lengths it holds.
Crossover injects whole well-filled bins of one parent into another, removes what is then there twice, and
best-fits the displaced documents. Groups of pieces evolve on several islands, each a task; between epochs
every island sends its elite to the next one. What the best individual leaves in bins that aren't full is
dealt anew into fewer groups, level by level, so that no task ever holds more than a bounded group.

Defined results: a null text is an empty one and has the end id alone; repeated rows are packed each; an
empty table gives no row; other columns are ignored. pack() keeps its items' columns, of which none may be named
_level, _group, _bin, sequence_id or offset: that is an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.llm import common
from cladeflow.runtime import materialize, ship

Bins = list[tuple[int, ...]]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of each text: only longer texts are cut, and the first piece takes what is over."""
    ship(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = common.byte_bpe(tokenizer)
        for batch in batches:
            for b in common.pieces_of(batch, "text"):
                rows = []
                for i, x in zip(b.column("id").to_pylist(), bpe.batch(b.column("text").to_pylist()), strict=True):
                    raw = np.append(x, np.uint32(end_id)).astype("<u4").tobytes()
                    n = len(raw) // 4
                    cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    rows += [(i, k, a, z - a, zlib.crc32(raw[4 * a : 4 * z])) for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: np.ndarray, bins: Bins, capacity: int, order: list[int] | None = None) -> Bins:
    """Put so many pieces of each length where the least room is left, longest first or in the given order."""
    out = list(bins)
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i, b in enumerate(out):
        room = capacity - sum(b)
        if room:
            at[room].append(i)
            mask |= 1 << room
    for length in order if order is not None else range(capacity, 0, -1):
        for _ in range(int(counts[length])):
            fits = mask >> length
            if fits:
                room = length + (fits & -fits).bit_length() - 1
                i = at[room].pop()
                if not at[room]:
                    mask ^= 1 << room
                out[i] = (*out[i], length)
                left = room - length
            else:
                i, left = len(out), capacity - length
                out.append((length,))
            if left:
                at[left].append(i)
                mask |= 1 << left
    return out


def bound(counts: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: the volume, and what large pieces can't share (Martello and Toth's L2)."""
    sizes = np.arange(capacity + 1)
    c, v = counts.astype(np.int64), counts.astype(np.int64) * sizes
    n_over, v_over = np.concatenate([np.cumsum(c[::-1])[::-1], [0]]), np.cumsum(v)
    half = capacity // 2
    best = -(-int(v.sum()) // capacity)
    for k in range(half + 1):
        n1 = int(n_over[capacity - k + 1]) if k else 0
        n2 = int(n_over[half + 1] - n_over[capacity - k + 1])
        v2 = int(v_over[capacity - k] - v_over[half])
        v3 = int(v_over[half] - (v_over[k - 1] if k else 0))
        best = max(best, n1 + n2 + max(0, -(-(v3 - (n2 * capacity - v2)) // capacity)))
    return best


def crossover(a: Bins, b: Bins, counts: np.ndarray, capacity: int, rng: np.random.Generator) -> Bins:
    """Whole well-filled bins of a go into b; b's bins that hold what is then there twice dissolve."""
    free = counts.astype(int).tolist()
    share = rng.uniform(0.3, 0.7)
    lot = rng.random(len(a))
    out: Bins = []
    for x, r in zip(a, lot, strict=True):
        if r < share and sum(x) >= capacity - 1:
            for n in x:
                free[n] -= 1
            out.append(x)
    # the fullest of the other's bins first; its loosest dissolve by chance, to be packed anew
    rest = sorted(b, key=sum, reverse=True)
    loose = rng.random(len(rest))
    for x, r in zip(rest, loose, strict=True):
        if sum(x) < capacity and r < 0.5:
            continue
        took = 0
        for n in x:
            if not free[n]:
                break
            free[n] -= 1
            took += 1
        if took == len(x):
            out.append(x)
        else:
            for n in x[:took]:
                free[n] += 1
    return best_fit(np.array(free), out, capacity)


def fitness(bins: Bins, capacity: int) -> tuple[int, float]:
    """Fewer bins first; then bins filled as unevenly as can be."""
    return len(bins), -sum((sum(b) / capacity) ** 2 for b in bins)


def evolve(counts: np.ndarray, capacity: int, seed: int, population: int, generations: int, guests: list[Bins]) -> Bins:
    """The fittest individual of one island after so many generations."""
    least = bound(counts, capacity)
    first = best_fit(counts, [], capacity)
    if len(first) <= least or not first:
        return first
    rng = np.random.default_rng(seed)
    pool = [first, *guests]
    lengths = np.flatnonzero(counts)
    while len(pool) < population:
        noisy = lengths[np.argsort(-(lengths * rng.uniform(0.9, 1.1, len(lengths))))]
        pool.append(best_fit(counts, [], capacity, noisy.tolist()))
    for _ in range(generations):
        pool.sort(key=lambda x: fitness(x, capacity))
        if len(pool[0]) <= least:
            break
        i = int(rng.integers(1, len(pool)))
        pool[-1] = min(pool[-1], crossover(pool[0], pool[i], counts, capacity, rng), crossover(pool[i], pool[0], counts, capacity, rng), key=lambda x: fitness(x, capacity))
    return min(pool, key=lambda x: fitness(x, capacity))


def dump(bins: Bins) -> bytes:
    flat = np.array([n for b in bins for n in (*b, 0)], np.uint16)
    return zlib.compress(flat.tobytes(), 1)


def load(raw: bytes) -> Bins:
    out: Bins = []
    held: list[int] = []
    for n in np.frombuffer(zlib.decompress(raw), np.uint16).tolist():
        if n:
            held.append(n)
        else:
            out.append(tuple(held))
            held = []
    return out


def pack(items: DataFrame, capacity: int, group_items: int = 32768, islands: int = 2, epochs: int = 2, population: int = 4, generations: int = 4, levels: int = 4, seed: int = 7) -> DataFrame:
    """Add sequence_id and offset to rows with a length of 1 to capacity (at most 65535).

    `items` is read several times: give it materialised. Evolution sees a group's count of pieces by length
    (at most capacity numbers); pieces take their places in the winning bins afterwards.
    """
    spark = items.sparkSession
    ship(spark)
    if not 1 <= capacity <= 65535:
        raise ValueError("capacity")
    names = items.columns
    if taken := {"_level", "_group", "_bin", "sequence_id", "offset"} & {x.lower() for x in names}:
        raise ValueError(f"items have columns {sorted(taken)}")
    full = items.where(F.col("length") == capacity).select(*names, F.lit(0).alias("_level"), F.xxhash64("doc_id", "piece").alias("_group"), F.monotonically_increasing_id().alias("_bin"), F.lit(0).cast("long").alias("offset"))
    done = [full]
    left = items.where(F.col("length") < capacity).select(*names)
    size = left.count()

    def elite(key, batches: list[pa.RecordBatch], guests: list[bytes], epoch: int) -> pa.RecordBatch:
        group, island = key
        counts = np.zeros(capacity + 1, np.int64)
        for b in batches:
            np.add.at(counts, b.column("length").to_numpy().astype(int), b.column("n").to_numpy())
        best = evolve(counts, capacity, seed + 1009 * group + 31 * island + epoch, population, generations, [load(g) for g in guests])
        row = {"group": [group], "island": [island], "elite": [dump(best)], "bins": [len(best)], "even": [fitness(best, capacity)[1]]}
        return pa.RecordBatch.from_pydict(row, schema=pa.schema([("group", pa.int32()), ("island", pa.int32()), ("elite", pa.binary()), ("bins", pa.int64()), ("even", pa.float64())]))

    elites = "group int, island int, elite binary, bins long, even double"

    def first(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([elite(tuple(k.as_py() for k in key), table.to_batches(), [], 0)])

    def later(epoch: int):
        def run(key: tuple[pa.Scalar, ...], table: pa.Table, guests: pa.Table) -> pa.Table:
            return pa.Table.from_batches([elite(tuple(k.as_py() for k in key), table.to_batches(), guests.column("elite").to_pylist(), epoch)])

        return run

    for level in range(1, levels + 1):
        if not size:
            break
        groups = max(1, -(-size // group_items))
        # the written number tells repeated rows apart: copies of one piece are dealt over all groups
        number = F.xxhash64(F.lit(level), "doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())
        keyed = materialize(left.withColumn("_group", F.pmod(number, F.lit(groups)).cast("int")), "grouped")
        # an island a task, up to a bound that grows with the cluster
        tasks = min(groups * islands, max(islands, 4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        dealt = lambda df: df.repartition(tasks, "group", "island")
        counts = materialize(keyed.groupBy(F.col("_group").alias("group"), "length").agg(F.count("*").alias("n")), "pack-counts", shuffled=True)
        wide = counts.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("island", F.col("island").cast("int"))
        best = materialize(dealt(wide).groupBy("group", "island").applyInArrow(first, elites), "pack-elites")
        for epoch in range(1, epochs):
            moved = best.withColumn("island", ((F.col("island") + 1) % islands).cast("int"))
            best = materialize(dealt(wide).groupBy("group", "island").cogroup(dealt(moved).groupBy("group", "island")).applyInArrow(later(epoch), elites), "pack-elites")
        won = best.groupBy("group").agg(F.min_by("elite", F.struct("bins", "even", "island")).alias("elite"))
        last = level == levels or groups == 1

        def place(key: tuple[pa.Scalar, ...], table: pa.Table, winner: pa.Table) -> pa.Table:
            bins = load(winner.column("elite")[0].as_py())
            lengths = table.column("length").to_numpy()
            order = np.argsort(lengths, kind="stable")
            stops = dict(zip(*(x.tolist() for x in np.unique(lengths[order], return_index=True)), strict=True))
            number, offset = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
            for k, b in enumerate(bins):
                at, open_ = 0, -1 if not last and sum(b) < capacity else k
                for n in b:
                    i = order[stops[n]]
                    stops[n] += 1
                    number[i], offset[i] = open_, at
                    at += n
            return table.append_column("_bin", pa.array(number)).append_column("offset", pa.array(offset)).select([*names, "_group", "_bin", "offset"])

        schema = f"{', '.join(f'{c} {t}' for c, t in items.dtypes)}, _group int, _bin long, offset long"
        # the same materialised pieces give the same groups and, sorted, the same places
        placed = materialize(keyed.groupBy("_group").cogroup(won.withColumnRenamed("group", "_group").groupBy("_group")).applyInArrow(place, schema), "packed", shuffled=True)
        done.append(placed.where("_bin >= 0").select(*names, F.lit(level).alias("_level"), F.col("_group").cast("long"), "_bin", "offset"))
        left = placed.where("_bin < 0").select(*names)
        size = 0 if last else left.count()
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    # a level's groups and bins number its sequences; full pieces of level 0 are sequences alone
    number = F.when(F.col("_level") == 0, F.col("_bin")).otherwise((F.col("_level").cast("long") * F.lit(1 << 58)) + F.col("_group") * F.lit(1 << 20) + F.col("_bin"))
    return out.select(*names, number.alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(materialize(pieces(docs, tokenizer, end_id, capacity, id_col, text_col), "pieces"), capacity)


def op3_best_fit_packing(spark, sf_dir):
    from cladeflow.runtime import table

    return pack_documents(table(spark, sf_dir, "documents"), common.tokenizer_path("byte_bpe_50k.json"))
