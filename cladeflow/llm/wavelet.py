"""Token-ID output: one wavelet matrix per shard.

A shard file holds the ids of consecutive documents as bit-planes, most significant bit first; each plane
lists its zeros' order first for the next plane (a wavelet matrix). A directory counts the ones before every block of
each plane; planes are stored in chunks of their own. Rank and select on the planes answer access, counting and
occurrence look-ups: an opened shard reads the directory and the few chunks that an answer needs.

Defined results: a null text is an empty one and has the end id alone; repeated rows are kept, ordered by
id, then text; a null id sorts first and is read back as null; an empty table writes no shard and reads
back no row; other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.llm import common
from cladeflow.runtime import scratch, ship

MAGIC = b"WVM1"
BLOCK = 1 << 16
RANK_BITS = 4096


class Shard:
    """A wavelet matrix with the documents' boundaries."""

    def __init__(self, n: int, planes: list, zeros: list[int], ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, ranks: list[np.ndarray]):
        self.n, self.planes, self.zeros = n, planes, zeros
        self.ids, self.known, self.lengths = ids, known, lengths
        self.ranks = ranks  # ones before each block of RANK_BITS, and in all

    @classmethod
    def build(cls, tokens: np.ndarray, ids: np.ndarray, known: np.ndarray, lengths: np.ndarray) -> Shard:
        levels = max(1, int(tokens.max()).bit_length()) if len(tokens) else 1
        seq = tokens.astype(np.uint16 if levels <= 16 else np.uint32)
        planes, zeros, ranks = [], [], []
        for b in range(levels - 1, -1, -1):
            bit = (seq & seq.dtype.type(1 << b)) != 0
            planes.append(np.packbits(bit))
            ones = np.bitwise_count(planes[-1])
            sums = np.add.reduceat(ones, np.arange(0, len(ones), RANK_BITS // 8), dtype=np.uint32) if len(ones) else ones.astype(np.uint32)
            ranks.append(np.concatenate([[0], np.cumsum(sums)]).astype(np.uint32))
            # taking by places is thrice as fast as by a mask
            zero = seq.take(np.flatnonzero(~bit))
            zeros.append(len(zero))
            seq = np.concatenate([zero, seq.take(np.flatnonzero(bit))])
        return cls(len(tokens), planes, zeros, ids, known, lengths, ranks)

    def to_bytes(self) -> Iterator[bytes]:
        side = zlib.compress(np.diff(self.ids, prepend=np.int64(0)).tobytes() + self.lengths.astype(np.uint32).tobytes() + np.packbits(self.known).tobytes(), 1)
        stored = []
        for p in self.planes:
            raw = p.tobytes()
            probe = raw[:BLOCK]
            small = bool(probe) and len(zlib.compress(probe, 1)) < 0.9 * len(probe)
            chunks = [raw[a : a + BLOCK] for a in range(0, len(raw), BLOCK)]
            # a chunk that doesn't shrink stays as it is, and is known by its size
            stored.append([min(zlib.compress(c, 1), c, key=lambda x: (len(x), x is not c)) if small else c for c in chunks])
        head = json.dumps({"n": self.n, "docs": len(self.ids), "zeros": self.zeros, "side": len(side), "planes": [[len(c) for c in x] for x in stored]}).encode()
        yield MAGIC + struct.pack("<I", len(head)) + head
        yield side
        yield from (r.astype("<u4").tobytes() for r in self.ranks)
        for chunks in stored:
            yield from chunks

    @classmethod
    def open(cls, read: Callable[[int, int], bytes]) -> Shard:
        """A shard from a way to read (offset, size) of its file: the planes' chunks are read when they are asked for."""
        start = read(0, 8)
        if start[:4] != MAGIC:
            raise ValueError("not a shard file")
        (h,) = struct.unpack_from("<I", start, 4)
        head = json.loads(read(8, h))
        at, d, n = 8 + h, head["docs"], head["n"]
        blocks = -(-((n + 7) // 8) // (RANK_BITS // 8)) + 1
        more = read(at, head["side"] + 4 * blocks * len(head["planes"]))
        side = zlib.decompress(more[: head["side"]])
        ids = np.cumsum(np.frombuffer(side, np.int64, d))
        lengths = np.frombuffer(side, np.uint32, d, 8 * d)
        known = np.unpackbits(np.frombuffer(side, np.uint8, -1, 12 * d), count=d).astype(bool)
        ranks = np.frombuffer(more, "<u4", -1, head["side"]).reshape(len(head["planes"]), blocks)
        at += len(more)
        planes = []
        for sizes in head["planes"]:
            planes.append(Plane(read, at, sizes, (n + 7) // 8))
            at += sum(sizes)
        return cls(n, planes, head["zeros"], ids, known, lengths, list(ranks))

    @classmethod
    def from_bytes(cls, raw: bytes) -> Shard:
        return cls.open(lambda at, size: raw[at : at + size])

    def decode(self) -> np.ndarray:
        """All ids in order: the planes' stable partitions undone from the last to the first."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        seq = np.zeros(self.n, kind)
        for b, (plane, z) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            bit = np.unpackbits(plane if isinstance(plane, np.ndarray) else plane.whole(), count=self.n).view(bool)
            out = np.empty(self.n, kind)
            out[np.flatnonzero(~bit)] = seq[:z]
            out[np.flatnonzero(bit)] = seq[z:] | kind(1 << b)
            seq = out
        return seq.astype(np.uint32)

    def _rank1(self, level: int, i: int) -> int:
        block = i // RANK_BITS
        a, whole = block * RANK_BITS // 8, i // 8
        p = self.planes[level]
        r = int(self.ranks[level][block]) + int(np.bitwise_count(p[a:whole]).sum())
        return r + ((int(p[whole]) >> (8 - i % 8)).bit_count() if i % 8 else 0)

    def _select(self, level: int, one: int, k: int) -> int:
        """The place of the k-th one (or zero) of a plane: its block by the directory, then its place in the block."""
        ranks = self.ranks[level].astype(np.int64)
        before = ranks if one else np.arange(len(ranks)) * RANK_BITS - ranks
        block = int(np.searchsorted(before[: max(1, len(ranks) - 1)], k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * RANK_BITS // 8 : (block + 1) * RANK_BITS // 8])
        return block * RANK_BITS + int(np.flatnonzero(bits == one)[k - int(before[block])])

    def _step(self, level: int, one: int, i: int) -> int:
        r = self._rank1(level, i)
        return self.zeros[level] + r if one else i - r

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, p in enumerate(self.planes):
            one = (int(p[i // 8]) >> (7 - i % 8)) & 1
            value = value * 2 + one
            i = self._step(level, one, i)
        return value

    def rank(self, token: int, i: int) -> int:
        """How often the id occurs before place i."""
        if token >> len(self.planes) or token < 0:
            return 0
        lo, hi = 0, min(max(i, 0), self.n)
        for level in range(len(self.planes)):
            one = (token >> (len(self.planes) - 1 - level)) & 1
            lo, hi = self._step(level, one, lo), self._step(level, one, hi)
        return hi - lo

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        return self.rank(token, self.n if stop is None else stop) - self.rank(token, start)

    def select(self, token: int, k: int) -> int:
        """The place of the k-th occurrence (from 0), or -1: down the planes to the token's own span, and back up."""
        if not 0 <= k < self.rank(token, self.n):
            return -1
        levels, place = len(self.planes), 0
        for level in range(levels):
            place = self._step(level, (token >> (levels - 1 - level)) & 1, place)
        place += k
        for level in range(levels - 1, -1, -1):
            one = (token >> (levels - 1 - level)) & 1
            place = self._select(level, one, place - self.zeros[level] if one else place)
        return place


class Plane:
    """A plane's bytes by slices, in chunks that are read once."""

    def __init__(self, read: Callable[[int, int], bytes], at: int, sizes: list[int], size: int):
        self.read, self.size, self.sizes = read, size, sizes
        self.at = [at + x for x in itertools.accumulate(sizes, initial=0)]
        self.chunks: dict[int, np.ndarray] = {}

    def chunk(self, i: int) -> np.ndarray:
        if i not in self.chunks:
            raw, whole = self.read(self.at[i], self.sizes[i]), min(BLOCK, self.size - i * BLOCK)
            self.chunks[i] = np.frombuffer(raw if len(raw) == whole else zlib.decompress(raw), np.uint8)
        return self.chunks[i]

    def whole(self) -> np.ndarray:
        return np.concatenate([self.chunk(i) for i in range(len(self.sizes))]) if self.sizes else np.zeros(0, np.uint8)

    def __getitem__(self, x: int | slice):
        if not isinstance(x, slice):
            return self.chunk(x // BLOCK)[x % BLOCK]
        a, b = x.start, min(x.stop, self.size)
        parts = [self.chunk(i)[max(0, a - i * BLOCK) : b - i * BLOCK] for i in range(a // BLOCK, -(-b // BLOCK))]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint8)


def read_shard(uri: str) -> Shard:
    """A whole shard."""
    store, path = common.filesystem(uri)
    with store.open_input_file(path) as f:
        return Shard.from_bytes(f.read())


def open_shard(uri: str) -> Shard:
    """A shard of which only what an answer needs is read."""
    store, path = common.filesystem(uri)
    f = store.open_input_file(path)

    def read(at: int, size: int) -> bytes:
        f.seek(at)
        return f.read(size)

    return Shard.open(read)


META = "part int, shard int, path string, n_docs long, n_tokens long"


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 4 << 20, partitions: int | None = None) -> DataFrame:
    """Encode each text, append end_id, write shards in ascending id order; one row per shard file.

    A shard is closed at shard_tokens ids, a single longer text excepted: a task holds one shard at a time.
    """
    spark = docs.sparkSession
    ship(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        bpe = common.byte_bpe(tokenizer)
        held, ids, known, lengths, size = [], [], [], [], 0
        end = np.array([end_id], np.uint32)

        def close() -> pa.RecordBatch:
            path = f"{folder}/{part:07d}-{shard:06d}.wvm"
            one = Shard.build(np.concatenate(held), np.array(ids, np.int64), np.array(known, bool), np.array(lengths, np.uint32))
            common.write_whole(path, one.to_bytes())
            row = {"part": [part], "shard": [shard], "path": [path], "n_docs": [len(ids)], "n_tokens": [size]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for batch in batches:
            for b in common.pieces_of(batch, "text"):
                for i, x in zip(b.column("id").to_pylist(), bpe.batch(b.column("text").to_pylist()), strict=True):
                    held += [x, end]
                    ids.append(0 if i is None else i)
                    known.append(i is not None)
                    lengths.append(len(x) + 1)
                    size += len(x) + 1
                    if size >= shard_tokens:
                        yield close()
                        held, ids, known, lengths, size, shard = [], [], [], [], 0, shard + 1
        if ids:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    meta = rows.repartitionByRange(n, "id").sortWithinPartitions("id", "text").mapInArrow(run, META)
    index = f"{folder}-index"
    meta.write.parquet(index)
    return spark.read.schema(META).parquet(index)


def read_shards(meta: DataFrame) -> DataFrame:
    """Each document from its shard file: id, start, n_tokens, ids_crc32."""
    spark = meta.sparkSession
    ship(spark)
    # one row per partition of the write, which the driver tracks anyway
    parts = sorted((r["part"], r["n"]) for r in meta.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    firsts, total = [], 0
    for part, n in parts:
        firsts.append((part, total))
        total += n
    begins = spark.createDataFrame(firsts, "part int, first long")
    before = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = meta.join(begins, "part").select("path", (F.col("first") + before).alias("start"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                s = read_shard(path)
                raw = memoryview(s.decode().tobytes())
                ends = np.cumsum(s.lengths.astype(np.int64))
                begin = ends - s.lengths
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(s.ids, mask=~s.known), pa.array(begin + start), pa.array(s.lengths.astype(np.int64)), pa.array(crc, pa.int64())], schema=schema)

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return shards.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_ids(spark, sf_dir):
    from cladeflow.runtime import table

    meta = write_shards(table(spark, sf_dir, "documents"), scratch(spark, "shards"), common.tokenizer_path("byte_bpe_50k.json"), 2)
    return read_shards(meta)
