"""Exact Jaccard join of word n-gram sets through set relations.

Sets with equal members are one set. Every set enters the inverted lists of its first members in a global order,
commonest shingles last. A list's entries form blocks of equal size and position; a block asks each size that may fit
once and skips its other blocks from the last useful position on. Entries that no other can match go.

Within a list one set's distances to all others are computed, as lower bounds from parity sketches. What a highly
similar set can be near to is derived from these answers by the triangle inequality; only a set that keeps an open
partner outside its group computes its own. The groups hold every similar pair, and few others.

A group's sets are then counted exactly: one set is the pivot, every other is written as its difference from the
pivot, and the overlap of any two is derived from both differences. Links and components come from these overlaps.

Defined results: null and empty texts, and texts without words, have no shingles and link with nothing; a text of
fewer than k words is one shingle; repeated rows have equal sets, so one component; rows with a null id take no part
and have a null component; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.llm import common
from cladeflow.runtime import fewer, fewer_files, give_back, materialize, ship, table

#: Most rows that a broadcast side may have; beyond it the join shuffles.
BROADCAST_ROWS = 300_000
#: Most links that one task joins to components (about 30 MB); more are contracted by rounds of shuffles first.
TASK_EDGES = 200_000
#: Copies of a set that one salt holds at least, and the most sets that are dealt over several salts (their list is broadcast).
SALT_ROWS, SALT_SETS = 256, 100_000
#: Lists of so many entries at most give their pairs at once; longer ones are searched with sketches at hand.
SHORT_LIST = 8
#: Entries of one part of a list; the parts of a longer list meet two by two, in tasks of their own.
PART_ENTRIES = 1 << 16
#: Differences of the sets of one block, each set taken as BLOCK_DIFFERENCES / BLOCK_SETS at least; a task holds two blocks.
BLOCK_DIFFERENCES, BLOCK_SETS = 1 << 18, 4096


def sets_of(raw: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted."""
    g, to = common.Words(raw, offsets).shingles(k)
    return [np.unique(g[a:b]) for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]


def set_id(s: np.ndarray) -> int:
    """A set's 64-bit name; sets of other sizes never share it in practice, and the size goes in."""
    h = (common.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(s))).reshape(1)
    return int(common.mix(h).view(np.int64)[0])


def level(n: np.ndarray | int):
    """Bits of a sketch: the power of two from the set's size on, 256 to 16384."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), 256, 16384)


def sketch(s: np.ndarray) -> bytes:
    """The parity of a set's members in each of level(n) places: sketches differ in no more places than sets do."""
    bits = np.bincount((s >> np.uint64(20)).astype(np.int64) & (int(level(len(s))) - 1), minlength=int(level(len(s)))) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def folded(sketches: np.ndarray, bits: int) -> np.ndarray:
    """Rows of 64-bit words at this level; a sketch of twice the level folds onto it by parity."""
    rows = [np.frombuffer(x, np.uint64) for x in sketches]
    return np.stack([r if len(r) * 64 == bits else r.reshape(-1, bits // 64)[0] ^ r.reshape(-1, bits // 64)[1] for r in rows])


def apart(na: np.ndarray, nb: np.ndarray, num: int, den: int) -> np.ndarray:
    """The most members in which similar sets of these sizes can differ."""
    both = -(-num * (na + nb) // (den + num))
    return na + nb - 2 * both


def near(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether sketches x[i] and y[j] differ in so many places at most, in slices of bounded size."""
    out, step = np.zeros(len(i), bool), max(1, (1 << 19) // max(1, x.shape[1]))
    for a in range(0, len(i), step):
        s = slice(a, a + step)
        out[s] = np.bitwise_count(x[i[s]] ^ y[j[s]]).sum(1, dtype=np.int64) <= most[s]
    return out


def common_shingles(docs: DataFrame, k: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most `most` of the commonest shingles and about how many texts have each: the tail of the global order.

    Any order is exact; this one keeps what many texts share out of the lists. Each slice of a partition
    names the shingles it has thrice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def close() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held), return_counts=True)
            often = np.flatnonzero(n >= 3)
            if len(often) > 20_000:
                often = often[np.argsort(-n[often], kind="stable")[:20_000]]
            return pa.RecordBatch.from_arrays([pa.array(token[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["token", "n"])

        for batch in batches:
            for b in common.pieces_of(batch, "text", 1 << 20):
                held += sets_of(*common.text_bytes(b.column("text")), k)
                size += sum(map(len, held[-b.num_rows :]))
                if size > 1_500_000:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    found = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    got = found.orderBy(F.desc("n"), "token").limit(most).toArrow()
    token, n = got.column("token").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


ROWS = "doc_id long, sid long, n int, token long, pos int, bits binary"


def signatures(docs: DataFrame, k: int, num: int, den: int, tail: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """A row for each text (pos -1, its hash as token), and one for each list entry of each set that a task meets first."""
    often, weight = tail
    names = ["doc_id", "sid", "n", "token", "pos", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            for b in common.pieces_of(batch, "text", 1 << 20):
                sets = sets_of(*common.text_bytes(b.column("text")), k)
                ids = [set_id(s) if len(s) else None for s in sets]
                sizes = np.array([len(s) for s in sets], np.int32)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.int64()), pa.array(sizes), b.column("text_hash"), pa.array(np.full(len(sets), -1, np.int32)), pa.array([sketch(s) if len(s) else None for s in sets], pa.binary())], names=names)
                new = [j for j, (i, d) in enumerate(zip(ids, b.column("doc_id").is_valid().to_pylist(), strict=True)) if d and i is not None and not (i in known or known.add(i))]
                if len(known) > 200_000:
                    known.clear()
                if not new:
                    continue
                heads = []
                for j in new:
                    s = sets[j]
                    p = len(s) - (num * len(s) + den - 1) // den + 1
                    if len(often):
                        at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                        w = np.where(often[at] == s, weight[at], 0)
                        if w.any():
                            s = s[np.argsort(w, kind="stable")]
                    heads.append(s[:p])
                count = np.array([len(h) for h in heads])
                total = int(count.sum())
                pos = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(total, pa.int64()), pa.array(np.repeat(np.array([ids[j] for j in new], np.int64), count)), pa.array(np.repeat(sizes[new], count)), pa.array(np.concatenate(heads).view(np.int64)), pa.array(pos.astype(np.int32)), pa.nulls(total, pa.binary())],
                    names=names,
                )

    return docs.mapInArrow(run, ROWS)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 20_000, most: int | None = None) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Sorted rows in portions that never part rows of equal keys, and the places where other keys begin.

    With most, equal keys' rows are parted after so many; then the portion holds that one key alone."""

    def begins(cols: dict[str, np.ndarray]) -> np.ndarray:
        new = np.zeros(len(cols[keys[0]]), bool)
        new[:1] = True
        for k in keys:
            new[1:] |= cols[k][1:] != cols[k][:-1]
        return np.flatnonzero(new)

    def join(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
        return parts[0] if len(parts) == 1 else {n: np.concatenate([x[n] for x in parts]) for n in parts[0]}

    held: list[dict[str, np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append({n: b.column(n).to_numpy(zero_copy_only=False) for n in b.schema.names})
        if sum(len(x[keys[0]]) for x in held) < least:
            continue
        cols = join(held)
        at = begins(cols)
        if len(at) > 1:
            yield {n: x[: at[-1]] for n, x in cols.items()}, at[:-1]
            cols = {n: x[at[-1] :].copy() for n, x in cols.items()}
        while most and len(cols[keys[0]]) >= 2 * most:
            yield {n: x[:most] for n, x in cols.items()}, at[:1]
            cols = {n: x[most:].copy() for n, x in cols.items()}
        held = [cols]
    if held:
        cols = join(held)
        yield cols, begins(cols)


def reach(na, pa_, nb, pb, num: int, den: int):
    """Whether sets whose first common member stands at these positions can still be similar enough."""
    most = np.minimum(na - pa_, nb - pb)
    return den * most >= num * (na + nb - most)


def partnered(t: np.ndarray, n: np.ndarray, pos: np.ndarray, num: int, den: int, most: int = 1 << 17) -> np.ndarray:
    """Of entries sorted by (t, n, pos): whether another entry of the same list can be similar enough.

    Entries of one block (size and position) are asked for once. A block asks each size that may fit once: from the last
    position that can still do, the size's other blocks are skipped. At most so many questions are held at a time."""
    block = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (n[1:] != n[:-1]) | (pos[1:] != pos[:-1])]))
    size, p = n[block], pos[block]
    sums = np.append(block, len(t))
    new = np.concatenate([[True], (t[block][1:] != t[block][:-1]) | (size[1:] != size[:-1])])
    start = np.flatnonzero(new)
    sizes, tall, wide = size[start], int(size.max()) + 1, int(p.max()) + 2
    lists = np.cumsum(np.concatenate([[0], t[1:] != t[:-1]]))[block]
    by_size, key = lists[start] * tall + sizes, (np.cumsum(new) - 1) * wide + p
    low = np.searchsorted(by_size, lists * tall + -(-num * size // den))
    high = np.searchsorted(by_size, lists * tall + np.minimum(den * size // num, tall - 1), side="right")
    total = np.empty(len(p), np.int64)
    todo, a = np.concatenate([[0], np.cumsum(high - low)]), 0
    while a < len(p):
        z = max(a + 1, int(np.searchsorted(todo, todo[a] + most, side="right")) - 1)
        count = (high - low)[a:z]
        asks = np.repeat(np.arange(a, z), count)
        to = np.arange(len(asks)) - np.repeat(np.cumsum(count) - count, count) + low[asks]
        need = -(-num * (size[asks] + sizes[to]) // (den + num))
        last = np.minimum(sizes[to] - need, wide - 1)
        at = np.searchsorted(key, to * wide + last, side="right")
        ok = (size[asks] - p[asks] >= need) & (last >= 0) & (at > start[to])
        found = np.where(ok, sums[np.maximum(at, start[to])] - sums[start[to]], 0)
        total[a:z] = np.add.reduceat(found, np.cumsum(count) - count)
        a = z
    other = total - reach(size, p, size, p, num, den)
    return np.repeat(other > 0, np.diff(sums))


ANSWERS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("token", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("part", pa.int32())])


def matched(entries: DataFrame, num: int, den: int, part_entries: int) -> DataFrame:
    """Pairs of sets (a, b) that share a short list, and the entries of longer lists (b null) with their part: 0, or from
    1 on in a list of several parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long, part = None, 0
        for r, begins in runs(batches, ["token"], most=part_entries):
            t, n, pos, sid = r["token"], r["n"].astype(np.int64), r["pos"].astype(np.int64), r["sid"]
            # a set can come from several tasks
            new = np.concatenate([[True], (t[1:] != t[:-1]) | (n[1:] != n[:-1]) | (pos[1:] != pos[:-1]) | (sid[1:] != sid[:-1])])
            t, n, pos, sid = t[new], n[new], pos[new], sid[new]
            goes_on = len(begins) == 1 and (t[0] == long or len(r["token"]) == part_entries)
            if goes_on:
                long, part = t[0], part + 1 if t[0] == long else 1
                own = np.full(len(t), part, np.int32)
            else:
                alive = partnered(t, n, pos, num, den)
                t, n, pos, sid = t[alive], n[alive], pos[alive], sid[alive]
                if not len(t):
                    continue
                first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
                m = np.diff(np.append(first, len(t)))
                low, high = [], []
                for many in range(2, SHORT_LIST + 1):
                    at = first[m == many]
                    for i in range(many if len(at) else 0):
                        for j in range(i):
                            u, v = at + j, at + i
                            ok = reach(n[u], pos[u], n[v], pos[v], num, den)
                            low.append(np.minimum(sid[u[ok]], sid[v[ok]]))
                            high.append(np.maximum(sid[u[ok]], sid[v[ok]]))
                if low:
                    both = np.unique(np.stack([np.concatenate(low), np.concatenate(high)], 1), axis=0)
                    none = [pa.nulls(len(both), f.type) for f in list(ANSWERS)[2:]]
                    yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), *none], schema=ANSWERS)
                keep = np.repeat(m > SHORT_LIST, m)
                t, n, pos, sid = t[keep], n[keep], pos[keep], sid[keep]
                own = np.zeros(len(t), np.int32)
            if len(t):
                yield pa.RecordBatch.from_arrays([pa.array(sid), pa.nulls(len(t), pa.int64()), pa.array(t), pa.array(n.astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(own)], schema=ANSWERS)

    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = entries.select("token", "n", "pos", "sid").repartition(parts, "token").sortWithinPartitions("token", "n", "pos", "sid")
    found = dealt.mapInArrow(run, "a long, b long, token long, n int, pos int, part int")
    # few of the entries are left; the sorts stay as small as they were, so these go to fewer files by a shuffle
    to = fewer(entries.sparkSession, parts)
    return found.repartition(to) if to < parts else found


def grouped(pos, n, bits, label: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Places (i, j) of sets of one list whose sketches leave them similar, enough to join each such pair; label holds the
    group of each place, and is joined as well."""
    edges: list[tuple[int, int]] = []
    levels = level(n)
    for bit in np.unique(levels).tolist():
        y = np.flatnonzero((levels == bit) | (levels == 2 * bit))
        wide, size, place = folded(bits[y], bit), n[y], pos[y]
        open_ = levels[y] == bit
        while open_.any():
            lab = label[y]
            if (lab == lab[0]).all():
                break
            i = int(np.argmax(open_))
            d = np.bitwise_count(wide ^ wide[i]).sum(1, dtype=np.int64)
            ok = (lab != lab[i]) & (d <= apart(size, size[i], num, den)) & reach(size, place, size[i], place[i], num, den)
            for other in np.unique(lab[ok]).tolist():
                edges.append((int(y[i]), int(y[np.flatnonzero(ok & (lab == other))[0]])))
            if ok.any():
                label[np.isin(label, np.append(lab[ok], lab[i]))] = min(int(lab[ok].min()), int(lab[i]))
                lab = label[y]
            open_[i] = False
            # the rest of the group: nearer to an outsider than this set's distances allow?
            own = np.flatnonzero(open_ & (lab == lab[i]))
            far = np.flatnonzero(lab != lab[i])
            if len(own) and len(far):
                far = far[d[far] <= d[own].max() + apart(size[far], size[own].max(), num, den) + 2]
                step = max(1, (1 << 19) // max(1, len(far)))
                for a in range(0, len(own), step):
                    o = own[a : a + step]
                    open_[o] = (d[far][None] - d[o][:, None] <= apart(size[far][None], size[o][:, None], num, den)).any(1)
            else:
                open_[own] = False
    return edges


def list_edges(lists: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that join the sets of each long list to groups; rows hold token, part x, part y, n, pos, sid, bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while above.setdefault(top, top) != top:
                top = above[top]
            while above[x] != top:
                above[x], x = top, above[x]
            return top

        for r, begins in runs(batches, ["token", "x", "y"], least=4000):
            n, pos, sid, bits = r["n"].astype(np.int64), r["pos"].astype(np.int64), r["sid"], r["bits"]
            if len(above) > 200_000:
                above.clear()  # groups known so far only save work
            found: list[tuple[int, int]] = []
            for a, z in zip(begins.tolist(), np.append(begins, len(sid))[1:].tolist(), strict=True):
                label = np.array([root(x) for x in sid[a:z].tolist()], np.int64)
                if (label == label[0]).all():
                    continue
                for i, j in grouped(pos[a:z], n[a:z], bits[a:z], label, num, den):
                    u, v = int(sid[a + i]), int(sid[a + j])
                    found.append((u, v) if u < v else (v, u))
                    low, high = sorted((root(u), root(v)))
                    above[high] = low
            if found:
                low, high = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["a", "b"])

    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lists.select("token", "x", "y", "n", "pos", "sid", "bits").repartition(parts, "token", "x", "y").sortWithinPartitions("token", "x", "y")
    return dealt.mapInArrow(run, "a long, b long")


def screened(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sketches leave them possible."""
    side = lambda x: sets.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"b{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = (b.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
            ba, bb = (b.column(c).to_numpy(zero_copy_only=False) for c in ("ba", "bb"))
            most, ok = apart(na, nb, num, den), np.zeros(len(na), bool)
            low = np.minimum(level(na), level(nb))
            for bit in np.unique(low).tolist():
                at = np.flatnonzero(low == bit)
                ok[at] = near(folded(ba[at], bit), folded(bb[at], bit), np.arange(len(at)), np.arange(len(at)), most[at])
            mask = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], names=["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ba", "bb").mapInArrow(run, "a long, b long")


def joined_in_task(edges: DataFrame) -> DataFrame:
    """(u, m): each set's least reachable one, by union and find in one task; the caller bounds the edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while above.setdefault(top, top) != top:
                top = above[top]
            while above[x] != top:
                above[x], x = top, above[x]
            return top

        for b in batches:
            for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
                low, high = sorted((root(u), root(v)))
                above[high] = low
        for name in sorted(above):
            root(name)
        if above:
            yield pa.RecordBatch.from_arrays([pa.array(list(above), pa.int64()), pa.array(list(above.values()), pa.int64())], names=["u", "m"])

    return edges.coalesce(1).mapInArrow(run, "u long, m long")


def components(links: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame | None:
    """(sid, comp) of every linked set, from written links. Each round joins every set to its least neighbour; what is
    left are links between the joined, far fewer: a written table per round, nothing on the driver. The last
    task_edges of them are joined in one task."""
    maps: list[DataFrame] = []
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    while (n := edges.count()) > task_edges:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "joined", shuffled=True)
        maps.append(to)
        of_u = edges.join(to, "u").select(F.col("m").alias("mu"), "v")
        of_v = of_u.join(to.select(F.col("u").alias("v"), F.col("m").alias("mv")), "v")
        edges = materialize(of_v.where("mu <> mv").select(F.col("mu").alias("u"), F.col("mv").alias("v")).distinct(), "edges", shuffled=True)
    if n:
        maps.append(joined_in_task(edges))
    if not maps:
        return None
    out = maps[0].select(F.col("u").alias("sid"), F.col("m").alias("comp"))
    for to in maps[1:]:
        out = out.join(to.withColumnRenamed("u", "comp"), "comp", "left").select("sid", F.coalesce("m", "comp").alias("comp"))
    return out


def candidate_groups(signed: DataFrame, sets: DataFrame, num: int, den: int, part_entries: int = PART_ENTRIES, sparing: bool = False) -> DataFrame | None:
    """(sid, comp) of every set that may be similar to another: any two similar sets are of one group."""
    answers = materialize(matched(signed.where("pos >= 0"), num, den, part_entries), "answers")
    if sparing:
        give_back(signed.sparkSession)
    edges = screened(answers.where("b is not null").select("a", "b").distinct(), sets, num, den)
    entries = answers.where("b is null").select("token", "n", "pos", "part", F.col("a").alias("sid"))
    several = entries.where("part > 0").groupBy("token").agg(F.max("part").alias("parts"))
    one = entries.where("part = 0").select("token", F.lit(0).alias("x"), F.lit(0).alias("y"), "n", "pos", "sid")
    other = F.explode(F.sequence(F.lit(1), "parts")).alias("other")
    more = entries.where("part > 0").join(several, "token").select("*", other)
    more = more.select("token", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "n", "pos", "sid")
    lists = one.unionAll(more).join(sets.select("sid", "bits"), "sid")
    return components(materialize(edges.unionAll(list_edges(lists, num, den)).distinct(), "edges", shuffled=True))


DIFFERENCES = "comp long, sid long, n int, copies long, pivot_n int, weight long, extra binary, lacking binary"


def differences(docs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Each member set as its difference from its group's pivot, the set that the group is named by.

    members holds sid, comp, rep, copies and n. The ids are broadcast if few; else both sides shuffle."""
    want = members.select(F.col("rep").alias("doc_id"), F.col("sid").alias("want"), "comp", "copies")
    streams = members.count() <= BROADCAST_ROWS
    if streams:
        want = F.broadcast(want)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in common.pieces_of(batch, "text", 1 << 20):
                # an id can come with several texts: the set decides
                ids = np.array([set_id(s) if len(s) else 0 for s in sets_of(*common.text_bytes(b.column("text")), k)], np.int64)
                same = pa.array(ids == b.column("want").to_numpy())
                yield pa.RecordBatch.from_arrays([b.column(c).filter(same) for c in ("want", "comp", "copies", "text")], names=["sid", "comp", "copies", "text"])

    found = docs.join(want, "doc_id").select("want", "comp", "copies", "text")
    texts = found.mapInArrow(pick, "sid long, comp long, copies long, text string")
    texts = materialize(fewer_files(texts, docs.rdd.getNumPartitions()) if streams else texts, "texts")
    pivots = texts.where("sid = comp").select("comp", F.col("text").alias("pivot"))

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, pivot = None, np.zeros(0, np.uint64)
        for batch in batches:
            for b in common.pieces_of(batch, "text", 1 << 20):
                rows = []
                sets = sets_of(*common.text_bytes(b.column("text")), k)
                for i, (comp, sid, copies) in enumerate(zip(*(b.column(c).to_pylist() for c in ("comp", "sid", "copies")), strict=True)):
                    if comp != name:
                        name, pivot = comp, sets_of(*common.text_bytes(b.column("pivot").slice(i, 1)), k)[0]
                    extra, lacking = np.setdiff1d(sets[i], pivot, assume_unique=True), np.setdiff1d(pivot, sets[i], assume_unique=True)
                    rows.append((comp, sid, len(sets[i]), copies, len(pivot), len(extra) + len(lacking), extra.tobytes(), lacking.tobytes()))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in DIFFERENCES.split(", ")])

    both = texts.join(pivots, "comp").select("comp", "sid", "copies", "text", "pivot")
    # rows that repeat an id repeat its set
    return materialize(both.mapInArrow(differ, DIFFERENCES).dropDuplicates(["sid"]), "differences", shuffled=True)


Side = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def side(extra: list[bytes], lacking: list[bytes], n: np.ndarray, pivot_n: int) -> Side:
    """Each set's overlap with the pivot, and all differences as (set, member, sign)."""
    parts = [np.frombuffer(x, np.uint64) for pair in zip(extra, lacking, strict=True) for x in pair]
    count = np.array([len(x) for x in parts])
    more, less = count[::2], count[1::2]
    row = np.repeat(np.repeat(np.arange(len(n)), 2), count)
    sign = np.repeat(np.tile([1, -1], len(n)), count)
    return n - more, row, np.concatenate(parts), sign


def overlaps(one: Side, two: Side, pivot_n: int, same: bool, rows: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """Exact sizes of the intersections of all sets of one side with all of the other, some rows at a time; where both are
    the same side, the diagonal is left without meaning.

    |A & B| = |A & P| + |B & P| - |P| + the product of the signed differences of A and B from the pivot P."""
    (p, i, s, u), (q, j, t, v) = one, two
    if same:
        token, many = np.unique(s, return_counts=True)
        shared = token[many > 1]
    else:
        shared = np.intersect1d(s, t)

    def known(row: np.ndarray, token: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(shared):
            return row[:0], row[:0], sign[:0]
        at = np.minimum(np.searchsorted(shared, token), len(shared) - 1)
        has = shared[at] == token
        return row[has], at[has], sign[has]

    (i, s, u), (j, t, v) = known(i, s, u), known(j, t, v)
    here, there = np.bincount(s, minlength=len(shared)), np.bincount(t, minlength=len(shared))
    # members that a good part of the sets differ by go through a matrix product, the rest pair by pair
    heavy = here * there > max(256, len(p) * len(q) // 32)
    column = np.cumsum(heavy) - 1
    order = np.argsort(t, kind="stable")
    j, t, v = j[order], t[order], v[order]
    first = np.searchsorted(t, np.arange(len(shared) + 1))
    dense = [(np.flatnonzero(heavy[s]), i, s, u), (np.flatnonzero(heavy[t]), j, t, v)]
    begins = np.searchsorted(i, np.arange(0, len(p) + rows, rows))
    for x in range(0, len(p), rows):
        out = (p[x : x + rows, None] + q[None] - pivot_n).astype(np.int32)
        part = np.arange(begins[x // rows], begins[x // rows + 1])
        light = part[~heavy[s[part]]]
        many = there[s[light]]
        to, a = np.concatenate([[0], np.cumsum(many)]), 0
        while a < len(light):
            z = max(a + 1, int(np.searchsorted(to, to[a] + (1 << 19), side="right")) - 1)
            c = many[a:z]
            k = np.repeat(light[a:z], c)
            at = np.arange(len(k)) - np.repeat(np.cumsum(c) - c, c) + first[s[k]]
            np.add.at(out, (i[k] - x, j[at]), (u[k] * v[at]).astype(np.int32))
            a = z
        for c in range(0, int(heavy.sum()), 512):
            two_sides = []
            for has, row, token, sign in dense:
                has = has[(column[token[has]] >= c) & (column[token[has]] < c + 512)]
                if row is i:
                    has = has[(row[has] >= x) & (row[has] < x + rows)]
                m = np.zeros((len(out) if row is i else len(q), 512), np.float32)
                m[row[has] - (x if row is i else 0), column[token[has]] - c] = sign[has]
                two_sides.append(m)
            out += np.rint(two_sides[0] @ two_sides[1].T).astype(np.int32)
        yield x, out


def counted(one: tuple, two: tuple | None, num: int, den: int) -> pa.RecordBatch:
    """(sid, more, least): of two blocks of a group (or of one with itself) each set's linked rows, and a set it hangs
    together with, the same for all that do."""
    same = two is None
    (sid_a, n_a, copies_a, side_a, pivot_n), (sid_b, n_b, copies_b, side_b, _) = one, two or one
    names = sid_a if same else np.concatenate([sid_a, sid_b])
    shift = 0 if same else len(sid_a)
    label, more = np.arange(len(names)), np.zeros(len(names), np.int64)
    for x, both in overlaps(side_a, side_b, pivot_n, same):
        ok = den * both.astype(np.int64) >= num * (n_a[x : x + len(both), None] + n_b[None] - both)
        if same:
            ok[np.arange(len(both)), np.arange(x, x + len(both))] = False
        more[x : x + len(both)] += np.where(ok, copies_b[None], 0).sum(1)
        if not same:
            more[shift:] += np.where(ok, copies_a[x : x + len(both), None], 0).sum(0)
        for r in np.flatnonzero(ok.any(1)).tolist():
            lab = label[shift + np.flatnonzero(ok[r])]
            low, high, mine = int(lab.min()), int(lab.max()), int(label[x + r])
            if low != high or low != mine:
                label[np.isin(label, np.append(lab, mine))] = min(low, mine)
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(more), pa.array(names[label])], names=["sid", "more", "least"])


def exact_links(apart_: DataFrame, num: int, den: int) -> DataFrame:
    """(sid, more, least), a row for each set and other block of its group: linked rows there, and a set it hangs together
    with. A group's sets are dealt to blocks of bounded size; every two blocks meet in one task."""
    spark = apart_.sparkSession
    weight = F.greatest("weight", F.lit(BLOCK_DIFFERENCES // BLOCK_SETS))
    wide = apart_.groupBy("comp").agg(F.ceil(F.sum(weight) / BLOCK_DIFFERENCES).cast("int").alias("blocks")).where("blocks > 1")
    if wide.count() <= BROADCAST_ROWS:
        wide = F.broadcast(wide)
    dealt = apart_.join(wide, "comp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("sid"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("comp", "sid", "n", "copies", "pivot_n", "extra", "lacking", "block", other)
    keys = ["comp", "x", "y"]
    dealt = dealt.select("comp", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "sid", "n", "copies", "pivot_n", "extra", "lacking")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, *keys).sortWithinPartitions(*keys, "block", "sid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, begins in runs(batches, keys, least=2000):
            for a, z in zip(begins.tolist(), np.append(begins, len(r["sid"]))[1:].tolist(), strict=True):
                cut = a + int(np.searchsorted(r["block"][a:z], r["x"][a], side="right"))
                blocks = []
                for f, t in ((a, cut), (cut, z)):
                    if t > f:
                        n, pivot_n = r["n"][f:t].astype(np.int64), int(r["pivot_n"][f])
                        blocks.append((r["sid"][f:t], n, r["copies"][f:t], side(r["extra"][f:t], r["lacking"][f:t], n, pivot_n), pivot_n))
                if r["x"][a] == r["y"][a]:
                    yield counted(blocks[0], None, num, den)
                elif len(blocks) == 2:
                    yield counted(*blocks, num, den)

    return dealt.mapInArrow(run, "sid long, more long, least long")


def dealt_rows(rows: DataFrame, few: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join by (sid, salt) that names the rows' sets. Rows of a set with more copies than a bound are dealt
    over salts, and the set's row to each of them: all sets together get as many rows more as rows fill the bound. Rows that
    no set can name are dealt over all partitions."""
    total = few.agg(F.sum("copies")).first()[0] or 0
    bound = max(SALT_ROWS, -(-total // SALT_SETS))
    many = F.ceil(F.col("copies") / bound).cast("int")
    # fewer than SALT_SETS sets have more copies than the bound
    hot = few.where(F.col("copies") > bound).select("sid", many.alias("many"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = F.when(F.col("sid").isNull() | F.col("doc_id").isNull(), F.lit(parts)).otherwise(F.coalesce("many", F.lit(1)))
    left = rows.join(F.broadcast(hot), "sid", "left").withColumn("salt", F.pmod(F.monotonically_increasing_id(), deal).cast("int")).drop("many")
    return left, few.withColumn("salt", F.explode(F.sequence(F.lit(0), many - 1)))


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", tail: int = 1 << 17, links: bool = False, part_entries: int = PART_ENTRIES, groups: bool = False, sparing: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id that links reach) under Jaccard >= num / den, 1/2 at least.

    With links also n_links: how many other rows reach that similarity (null for a null id, 0 without shingles). With
    groups also text_hash, by which the rows of one id differ, and group: the component's name (null without shingles or id).
    Sparing, the executors return their heap between the steps."""
    if 2 * num < den:
        raise ValueError("sketches need a similarity of 1/2 at least")
    spark = docs.sparkSession
    ship(spark)
    spare = (lambda: give_back(spark)) if sparing else lambda: None
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    signed = signatures(rows, k, num, den, common_shingles(rows, k, tail))
    signed = materialize(fewer_files(signed, rows.rdd.getNumPartitions()), "signatures")
    spare()
    own = signed.where("pos < 0").select("doc_id", "sid", "n", "bits", F.col("token").alias("text_hash"))
    sets = materialize(own.where("sid is not null and doc_id is not null").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bits").alias("bits")), "sets", shuffled=True)
    few = sets.select("sid", "rep", "copies")
    spare()
    candidates = candidate_groups(signed, sets, num, den, part_entries, sparing)
    spare()
    comp = None
    if candidates is not None:
        members = materialize(few.join(candidates, "sid"), "members", shuffled=True)
        differing = differences(rows, members, k)
        spare()
        found = materialize(exact_links(differing, num, den), "links", shuffled=True)
        spare()
        comp = components(found.where("sid <> least").select(F.col("sid").alias("a"), F.col("least").alias("b")))
        comp = comp if comp is None else materialize(comp, "components", shuffled=True)
        if links:
            few = few.join(found.groupBy("sid").agg(F.sum("more").alias("more")), "sid", "left")
    if comp is not None:
        named = few.join(comp, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
        least = few.join(comp, "sid").groupBy("comp").agg(F.min("rep").alias("least"))
        few = named.join(least, "comp", "left").withColumn("component_id", F.coalesce("least", "rep"))
    else:
        few = few.withColumn("component_id", F.col("rep")).withColumn("comp", F.col("sid"))
    if links:
        few = few.withColumn("n_links", F.col("copies") - 1 + (F.coalesce("more", F.lit(0)) if candidates is not None else F.lit(0)))
    few = materialize(few.where("copies > 1 or component_id <> rep or comp <> sid" + (" or n_links > 0" if links else "")).select("sid", "component_id", "comp", "copies", *(["n_links"] if links else [])), "named", shuffled=True)
    spare()
    left, right = dealt_rows(own.select("doc_id", "sid", "n", "text_hash"), few)
    out = left.join(right.drop("copies"), ["sid", "salt"], "left")
    n_links = [F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).alias("n_links")] if links else []
    named_ = ["text_hash", F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "sid")).alias("group")] if groups else []
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component, *n_links, *named_)


def op1_ngram_jaccard(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100, links=True)


#: The same rows by all pairs that share a shingle, and the closure of the links.
ORACLE = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM t),
n AS (SELECT t.doc_id, count(s.g) AS n FROM t LEFT JOIN s ON s.doc_id = t.doc_id GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON b.g = a.g AND b.doc_id <> a.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM t UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT n.doc_id, n.n AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = n.doc_id) AS component_id, (SELECT count(*) FROM links WHERE links.a = n.doc_id) AS n_links FROM n
"""
