"""Small fixtures with the awkward cases, each operator against brute force, a round trip or a library."""

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cladeflow.llm import common, jaccard_join, labelled, licenses, neighbours, packing, quality_classifier, quality_rules, sentence_pieces, toxicity, warc, wavelet
from cladeflow.runtime import scratch

LONG = "alpha beta gamma delta epsilon zeta. " * 4000
TEXTS = [None, "", "  \n\t", "one", "One two", "a b c d e f g h i j k l m n o p q r s t.", "a b c d e f g h i j k l m n o p q r s t.", "a b c d e f g h i j k l m n o p q r s u.", LONG, LONG + "tail", "é 😀 ▁x\r\n<|endoftext|> \x00", "MIT License"]
SCHEMA = "doc_id long, text string, lang string, source string, sid long, token long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, "s", 1, 2) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5], (None, "a b c", None, None, None, None)], SCHEMA)


def collect(df):
    return df.orderBy("doc_id").collect()


def sets(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize("k, num", [(3, 90), (5, 80), (1, 70)])
def test_jaccard(spark, docs, k, num):
    got = collect(jaccard_join.jaccard_components(docs, k, num, 100).where("doc_id is not null"))
    s = [sets(t, k) for t in TEXTS]
    comp = list(range(len(s)))
    for _ in s:
        for i in range(len(s)):
            for j in range(len(s)):
                if s[i] and s[j] and 100 * len(s[i] & s[j]) >= num * len(s[i] | s[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(i, len(x), comp[i]) for i, x in enumerate(s)}
    assert len(got) == len(TEXTS) + 1


def test_jaccard_random(spark):
    rng = np.random.default_rng(0)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 40, 60)) for _ in range(6)]
    texts = []
    for i in range(120):
        w = base[i % 6].split()
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(0, 60))] = f"v{i}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    s = [sets(t, 3) for t in texts]
    comp = list(range(120))
    for _ in range(120):
        before = list(comp)
        for i in range(120):
            for j in range(i):
                if 100 * len(s[i] & s[j]) >= 90 * len(s[i] | s[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
        if comp == before:
            break
    assert [r["component_id"] for r in collect(jaccard_join.jaccard_components(df, 3, 90, 100))] == comp


@pytest.mark.parametrize("task_edges", [0, 5, 10_000])
def test_components(spark, task_edges):
    """Rounds alone, rounds and a task, and the task alone agree with brute force; repeated links, loops and chains."""
    rng = np.random.default_rng(3)
    pairs = [(i, i + 1) for i in range(-5, 40)] + [(int(a), int(b)) for a, b in rng.integers(100, 400, (120, 2))] + [(7, 7), (7, 8), (-(1 << 62), 1 << 62)]
    least = {x: x for p in pairs for x in p}
    for _ in least:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    got = jaccard_join.components(spark.createDataFrame(pairs, "a long, b long"), task_edges)
    assert {r["sid"]: r["comp"] for r in got.collect()} == least
    assert got.count() == len(least)
    assert jaccard_join.components(spark.createDataFrame([], "a long, b long"), task_edges) is None


@pytest.mark.parametrize("op", ["jaccard", "tokens", "pack", "rules", "pieces", "licenses"])
def test_empty_table(spark, op):
    empty = spark.createDataFrame([], SCHEMA)
    bpe, sp = common.tokenizer_path("byte_bpe_50k.json"), common.tokenizer_path("piece_bpe_32k.model")
    run = {"jaccard": lambda: jaccard_join.jaccard_components(empty), "tokens": lambda: wavelet.read_shards(wavelet.write_shards(empty, scratch(spark, "t"), bpe, 2)), "pack": lambda: packing.pack_documents(empty, bpe), "rules": lambda: quality_rules.quality_rules(empty), "pieces": lambda: sentence_pieces.piece_digests(empty, sp), "licenses": lambda: licenses.scan_licenses(empty)}
    assert run[op]().count() == 0


def test_tokens(spark, docs):
    from tokenizers import Tokenizer

    path = common.tokenizer_path("byte_bpe_50k.json")
    got = collect(wavelet.read_shards(wavelet.write_shards(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), scratch(spark, "t"), path, 2, shard_tokens=20)))
    own, start = Tokenizer.from_file(path), 0
    for r, t in zip(got, TEXTS, strict=True):
        ids = np.array(own.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@pytest.mark.parametrize("top, n", [(1, 1), (2, 70_000), (300, 9000), (70_000, 40_000)])
def test_wavelet_file(tmp_path, top, n):
    """Access, counts and occurrences from an opened file, which reads a part of it."""
    rng = np.random.default_rng(n)
    x = np.minimum(rng.integers(0, top, n), rng.integers(0, top, n)).astype(np.uint32)
    uri = f"file://{tmp_path}/a.wvm"
    common.write_whole(uri, wavelet.Shard.build(x, np.array([3]), np.array([True]), np.array([n], np.uint32)).to_bytes())
    s = wavelet.open_shard(uri)
    for i in rng.integers(0, n, 20):
        t = int(x[i])
        at = np.flatnonzero(x == t)
        k = int(rng.integers(0, len(at)))
        assert s.access(int(i)) == t and s.select(t, k) == at[k] and s.rank(t, int(i)) == (at < i).sum() and s.count(t) == len(at)
        assert s.select(t, len(at)) == -1 and s.select(t, 0) == at[0] and s.select(t, len(at) - 1) == at[-1]
    assert s.count(1 << 20) == 0 and s.rank(-1, 5) == 0 and (wavelet.read_shard(uri).decode() == x).all()
    with pytest.raises(IndexError):
        s.access(n)


def test_wavelet_mixed_chunks(monkeypatch):
    """Chunks that shrink beside chunks that don't, or by chance keep their size."""
    monkeypatch.setattr(wavelet, "BLOCK", 64)
    monkeypatch.setattr(wavelet, "RANK_BITS", 64)
    rng = np.random.default_rng(4)
    for n in (520, 4000, 9001):
        x = np.concatenate([np.zeros(n, np.uint32), rng.integers(0, 1 << 12, n).astype(np.uint32), np.repeat(rng.integers(0, 99, n // 9), 9).astype(np.uint32)])
        s = wavelet.Shard.from_bytes(b"".join(wavelet.Shard.build(x, np.array([3]), np.array([True]), np.array([len(x)], np.uint32)).to_bytes()))
        assert (s.decode() == x).all() and all(s.access(int(i)) == x[i] for i in rng.integers(0, len(x), 30))


def test_wavelet_reads_little():
    x = np.random.default_rng(2).integers(0, 50_000, 3_000_000).astype(np.uint32)
    raw = b"".join(wavelet.Shard.build(x, np.array([3]), np.array([True]), np.array([len(x)], np.uint32)).to_bytes())
    asked = []

    def read(at, size):
        asked.append(size)
        return raw[at : at + size]

    s = wavelet.Shard.open(read)
    assert s.access(1_234_567) == x[1_234_567] and sum(asked) < 0.3 * len(raw)


def test_wavelet():
    x = np.random.default_rng(1).integers(0, 300, 5000).astype(np.uint32)
    s = wavelet.Shard.from_bytes(b"".join(wavelet.Shard.build(x, np.array([5, 7]), np.array([True, False]), np.array([3000, 2000], np.uint32)).to_bytes()))
    assert (s.decode() == x).all() and [s.access(i) for i in (0, 4999)] == [x[0], x[4999]] and s.known.tolist() == [True, False]
    assert s.count(7, 100, 4000) == (x[100:4000] == 7).sum() and s.select(7, 3) == np.flatnonzero(x == 7)[3] and s.select(7, 9999) == -1


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = common.tokenizer_path("byte_bpe_50k.json")
    rows = packing.pack_documents(docs, path, 2, 64).toPandas()
    filled = rows.groupby("sequence_id").length.sum()
    assert filled.max() <= 64 and len(filled) <= -(-rows.length.sum() // 64) + 1
    r = rows.sort_values(["sequence_id", "offset"])
    assert (r.groupby("sequence_id").length.cumsum() - r.length == r.offset).all()
    assert (rows[rows.piece > 0].length == 64).all() and set(rows.doc_id.dropna()) == set(range(len(TEXTS)))
    own, want = Tokenizer.from_file(path), []
    for i, t in [*enumerate(TEXTS), (5, TEXTS[5]), (-1, "a b c")]:
        ids = np.array(own.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        at, k = 0, 0
        while at < len(ids):
            n = (len(ids) - 1) % 64 + 1 if k == 0 else 64
            want.append((i, k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
            at, k = at + n, k + 1
    assert sorted(rows.fillna({"doc_id": -1})[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(int).itertuples(index=False, name=None)) == sorted(want)
    with pytest.raises(ValueError, match="offset"):
        packing.pack(spark.createDataFrame([], "doc_id long, piece int, length long, ids_crc32 long, offset long"), 64)


def test_packing_groups(spark):
    """Many groups, copies of one row among them, over several levels: every piece has one place, no bin is too full."""
    rng = np.random.default_rng(8)
    rows = [(i, 0, int(n), int(n)) for i, n in enumerate(rng.integers(1, 100, 3000))] + [(7, 0, 60, 5)] * 1000 + [(i, 0, 100, 1) for i in range(50)]
    items = spark.createDataFrame(rows, "doc_id long, piece int, length long, ids_crc32 long")
    got = packing.pack(items, 100, group_items=500).toPandas()
    assert sorted(got[["doc_id", "piece", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(rows)
    r = got.sort_values(["sequence_id", "offset"])
    assert (r.groupby("sequence_id").length.cumsum() - r.length == r.offset).all() and got.groupby("sequence_id").length.sum().max() <= 100
    counts = np.bincount([x[2] for x in rows], minlength=101)
    assert got.sequence_id.nunique() <= 1.01 * packing.bound(counts, 100) + 5


def test_crossover_keeps_pieces():
    rng = np.random.default_rng(2)
    counts = np.bincount(rng.integers(1, 100, 400), minlength=101)
    a, b = packing.best_fit(counts, [], 100), packing.best_fit(counts, [], 100, list(range(1, 101)))
    c = packing.crossover(a, b, counts, 100, rng)
    assert (np.bincount([n for x in c for n in x], minlength=101) == counts).all() and max(map(sum, c)) <= 100
    assert packing.bound(counts, 100) <= len(packing.evolve(counts, 100, 1, 4, 4, [])) <= len(a)


def library_spans(lib, text):
    return [(p.id, p.begin, p.end) for p in lib.encode(text, return_type="proto").pieces]


def test_pieces(spark, docs):
    import sentencepiece

    path = common.tokenizer_path("piece_bpe_32k.model")
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), sentence_pieces.encoder(path)
    for r in collect(sentence_pieces.piece_digests(docs.where("doc_id is not null"), path)):
        t = TEXTS[r["doc_id"]] or ""
        ids = lib.encode(t, add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
        size = len(t.encode())
        spans = np.array([x[1:] for x in library_spans(lib, t)] + [(size, size)], "<u4")
        assert r["spans_crc32"] == zlib.crc32(spans.tobytes()) and own.decode(ids) == lib.decode(ids)
    found = {r["doc_id"]: r for r in sentence_pieces.encode_pieces(docs.where("doc_id is not null"), path).collect()}
    for i, t in enumerate(TEXTS):
        got = list(zip(found[i]["ids"], found[i]["span_start"], found[i]["span_end"], strict=True))
        assert got[:-1] == library_spans(lib, t or "") and got[-1][1:] == (len((t or "").encode()),) * 2


def charsmap(entries):
    """A compiled character map: a double-array trie with a block of 256 places for each node, and the replacements."""
    texts, trie, units = b"", {}, [0] * 256
    for source, target in entries.items():
        node = trie
        for b in source.encode():
            node = node.setdefault(b, {})
        node[-1] = len(texts)
        texts += target.encode() + b"\0"

    def put(at, label, node):
        base = len(units)
        units.extend([0] * 256)
        units[at] = label | (base ^ at) << 10 | (0x100 if -1 in node else 0)
        if -1 in node:
            units[base] = node[-1] | 0x80000000
        for b, child in node.items():
            if b >= 0:
                put(base ^ b, b, child)

    put(0, 0, trie)
    return struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + texts


@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize("prefix", [False, True])
def test_character_map(squeeze, prefix):
    """A map with entries, the longest of which counts: ids, spans and text as the library's own with the same map."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(common.tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        m.ParseFromString(f.read())
    m.normalizer_spec.precompiled_charsmap = charsmap({"ﬁ": "fi", "A": "a", "AB": "xy", "é": "e", "\t": " ", "…": "...", "\u200b": "", "Ａ": "A", "¼": "1/4"})
    m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.add_dummy_prefix = squeeze, prefix
    lib, own = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString()), sentence_pieces.Encoder(serialized=m.SerializeToString())
    assert own.map.longest("ABA".encode(), 0) == (2, b"xy") and own.map.longest("ABA".encode(), 2) == (1, b"a") and own.map.longest(b"b", 0) is None
    for t in ["ABA ﬁne café…", "\t tab  AB\t", "\u200bzero \u200b", "ＡB  é ", "", "  ", "x▁ A¼", "日本 é😀A", "  two  words  ", "a\nA\n"]:
        assert own.spans(t)[:-1] == library_spans(lib, t), t
        ids = lib.encode(t, add_eos=True)
        assert own.encode(t) == ids and own.decode(ids) == lib.decode(ids)
        size = len(t.encode())
        assert own.digests(t)[0::3] == (len(ids), zlib.crc32(np.array([x[1:] for x in library_spans(lib, t)] + [(size, size)], "<u4").tobytes()))


def test_rules(spark, docs):
    good = "This is a sentence of plain prose with enough words in it. " + " ".join(f"word{i}" for i in range(60)) + "."
    df = spark.createDataFrame([(0, good), (1, "a | b | c | d\n" * 40 + good), (2, None), (3, "x y z " * 40)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(df).collect()}
    assert [got[i]["kept"] for i in range(4)] == [True, False, False, False]
    assert (got[3]["n_repeat_words"], got[2]["n_words"], got[1]["n_dup_lines"]) == (120, 0, 39)


MIT = licenses.KNOWN["MIT"]
LICENSED = [
    ("Copyright (c) 2020 Someone\n" + MIT.upper().replace("SUBLICENSE", "sub-licence"), "MIT"),
    # a notice ends with its sentence, not with its line or with an initial; wrapped lines may begin with the word
    ("Copyright (c) 2020 J. Smith and Foo.bar, Inc. All rights reserved. " + MIT.replace("\n", " "), "MIT"),
    ("  © X\n(c) 1999 Y.\n" + licenses.KNOWN["BSD-2-Clause"].replace("the above copyright", "the above\ncopyright"), "BSD-2-Clause"),
    ("copyright <YEAR> <HOLDER>\n" + licenses.KNOWN["ISC"], "ISC"), ("Released under the MIT licence!", "MIT-notice"), ("Copyright 2020 Acme. " + "x y z " * 3, None),
    ("other", None), (MIT + " and more", None), (None, None), ("...", None), ("", None), ("All rights reserved.", None), (LONG, None), (MIT, "MIT"), (MIT, "MIT"),
]


def test_licenses(spark):
    import duckdb

    df = spark.createDataFrame([(i, t, "x", "y") for i, (t, _) in enumerate(LICENSED)], "doc_id long, text string, text_digest string, license_id string")
    got = collect(licenses.scan_licenses(df))
    assert [r["license_id"] for r in got] == [n for _, n in LICENSED]
    assert [r["doc_id"] for r in got if r["text_digest"] is None] == [8, 9, 10, 11]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, (t, _) in enumerate(LICENSED)])
    assert [tuple(r) for r in got] == con.execute(licenses.ORACLE + " ORDER BY doc_id").fetchall()


def test_warc(spark):
    import base64

    import duckdb

    rows = [(3, "u", "same"), (1, "u\n", "same"), (2, None, None), (4, "v", ""), (5, "w", "é" * 100000), (5, "w", "é" * 100000), (None, "n", "same"), (None, "n", "alone"), (5, "w", "same")]
    df = spark.createDataFrame([(*r, "x", 9) for r in rows], "page_id long, url string, html string, sha string, refers_to long")
    index = warc.write_warc(df, scratch(spark, "w"), file_bytes=1000)
    found = warc.read_warc(index).collect()
    by_hand = []
    for i, _, t in rows:
        raw = (t or "").encode()
        first = min((j for j, _, s in rows if (s or "") == (t or "") and j is not None), default=None)
        own = first is None or i == first
        by_hand.append((i, "response" if own else "revisit", None if own else first, len(raw), len(raw) if own else 0, base64.b32encode(hashlib.sha1(raw).digest()).decode()))
    key = lambda r: (r[0] is None, *map(str, r))
    assert sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], len(r["payload"]), r["payload_digest"]) for r in found), key=key) == sorted(by_hand, key=key)
    assert index.select("file").distinct().count() >= 1 and {r["url"] for r in index.collect()} == {"u", "u\n", None, "v", "w", "n"}
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    sql = con.execute(warc.ORACLE).fetchall()
    assert sorted(((i, kind, to, n, d) for i, n, d, kind, to in sql), key=key) == sorted(((*r[:4], r[5]) for r in by_hand), key=key)
    assert list(warc.ranges([(0, 10), (10, 5), (10**7, 3)])) == [(0, 15, [(0, 10), (10, 5)]), (10**7, 10**7 + 3, [(10**7, 3)])]
    # payloads below the least size are all responses
    small = warc.read_warc(warc.write_warc(df, scratch(spark, "w"), least=5)).collect()
    assert all(r["record_type"] == "response" for r in small if r["payload_bytes"] < 5) and sum(r["record_type"] == "revisit" for r in small) == 0


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 8))
    x[500:560] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(600, None), (601, [0.0] * 8), (602, [float("nan")] * 8)]
    index = neighbours.Index(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), leaf_rows=40)
    got = index.search(index.rows.where("id % 50 = 0").select("id", "v"), block=64).toPandas()
    u, hits = x / np.linalg.norm(x, axis=1, keepdims=True), 0
    for q in range(0, 600, 50):
        s = neighbours.cosine(x[q], x)
        s[q] = -9
        want = np.lexsort((np.arange(600), -s))[:5]
        hits += len(set(want) & set(got[got.query_id == q].vec_id))
    assert index.measured(100)[0] >= 0.9 and neighbours.Index(spark.createDataFrame([], "vec_id long, embedding array<double>")).search(index.rows.select("id", "v").limit(0)).count() == 0
    assert hits >= 0.9 * 60 and got[got.query_id == 0].sort_values("rank").vec_id.tolist() == [500, 501, 502, 503, 504]


def test_classifiers(spark):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(600):
        w = [f"w{x}" for x in rng.integers(0, 300, 40)]
        toxic, poor = int(rng.random() < 0.3), int(rng.random() < 0.4)
        if toxic:
            w[7] = "nastyword"
        rows.append((i, ". ".join(" ".join(x + ("###" if poor else "") for x in w[a : a + 8]) for a in range(0, 40, 8))))
        labels.append((i, 1 - poor, toxic))
    d, y = spark.createDataFrame([*rows, (600, None)], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for module, score, k in ((toxicity, toxicity.score_toxicity, 2), (quality_classifier, quality_classifier.score_quality, 1)):
        got = score(d, module.train(d, y)).where("held_out and doc_id < 600").collect()
        assert np.mean([r["predicted"] == labels[r["doc_id"]][k] for r in got]) > 0.95
    model = toxicity.train(d, y)
    spot = toxicity.locate(d, model).limit(5).collect()
    assert spot and all("nastyword" in rows[r["doc_id"]][1].encode()[r["span_start"] : r["span_end"]].decode() for r in spot)
    worst = {r["doc_id"]: r for r in toxicity.score_toxicity(d, model).where("predicted = 1").collect()}
    assert worst and all("nastyword" in rows[i][1].encode()[r["span_start"] : r["span_end"]].decode() for i, r in worst.items())
    assert toxicity.score_toxicity(d, model).where("doc_id = 600").first()["span_start"] is None
    none = toxicity.train(d, y.where("toxic = 0"))
    assert none.score(*common.text_bytes(pa.array(["x", ""])))[0].tolist() == pytest.approx([toxicity.FLOOR] * 2)
    assert labelled.training_rows(d, y, "toxic", 10)[0].num_rows == 20


def test_word_vectors_read_every_row():
    # a late row is read whole after two million words of an early one
    late = "one two three four five"
    rows = pa.table({"id": [1, 2], "y": [0, 0], "text": ["a " * 2_000_001, late]})
    got = quality_classifier.fit(rows, {0: 2, 1: 0}).vectors
    alone = quality_classifier.fit(rows.slice(1), {0: 1, 1: 0}).vectors
    bucket, _, _ = quality_classifier.units(*common.text_bytes(pa.array([late])))
    assert len(set(bucket.tolist())) == 5 and np.allclose(got[bucket], alone[bucket])
    bare = quality_classifier.index_vectors(1 << quality_classifier.BITS, quality_classifier.DIM, 3)
    assert not np.allclose(got[bucket], bare[bucket] / 2)


@pytest.mark.parametrize("weight, part", [(1 << 18, 1 << 16), (512, 20)])
def test_jaccard_links(spark, monkeypatch, weight, part):
    # 512 and 20: many blocks a group, many parts a list
    monkeypatch.setattr(jaccard_join, "BLOCK_DIFFERENCES", weight)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 16)
    rng = np.random.default_rng(1)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 40, 60)) for _ in range(4)]
    rows = [(0, None), (1, ""), (2, "one"), (3, "One"), (3, "one"), (None, "one")]
    for i in range(10, 110):
        w = base[i % 4].split()[: int(rng.integers(55, 61))]
        for _ in range(int(rng.integers(0, 3))):
            w[int(rng.integers(0, 55))] = f"v{i % 7}"
        rows.append((i, " ".join(w)))
    rows += [(200, base[0]), (201, base[0]), (202, base[0].upper())]
    s = [sets(t, 3) if i is not None else set() for i, t in rows]
    want = sorted((i, sum(bool(j != k and a and b and 10 * len(a & b) >= 8 * len(a | b)) for k, b in enumerate(s))) for j, ((i, _), a) in enumerate(zip(rows, s, strict=True)) if i is not None)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80, 100, links=True, part_entries=part).collect()
    assert sorted((r["doc_id"], r["n_links"]) for r in got if r["doc_id"] is not None) == want
    assert [r["n_links"] for r in got if r["doc_id"] is None] == [None] and max(n for _, n in want) > 20
    with pytest.raises(ValueError):
        jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 40, 100)


def test_overlaps():
    rng = np.random.default_rng(2)
    pivot = np.unique(rng.integers(0, 2000, 900)).astype(np.uint64)
    noise = rng.integers(0, 2000, 300).astype(np.uint64)
    made = [np.unique(np.concatenate([pivot[rng.random(len(pivot)) < 0.8], noise[rng.random(300) < 0.3], rng.integers(0, 9000, 5).astype(np.uint64)])) for _ in range(90)]

    def packed(sets_):
        n = np.array([len(x) for x in sets_])
        return jaccard_join.side([np.setdiff1d(x, pivot).tobytes() for x in sets_], [np.setdiff1d(pivot, x).tobytes() for x in sets_], n, len(pivot))

    one, two = made[:50], made[50:]
    got = np.concatenate([x for _, x in jaccard_join.overlaps(packed(one), packed(two), len(pivot), False, rows=16)])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in two] for a in one]
    got = np.concatenate([x for _, x in jaccard_join.overlaps(packed(one), packed(one), len(pivot), True, rows=16)])
    want = np.array([[len(np.intersect1d(a, b)) for b in one] for a in one])
    off = ~np.eye(50, dtype=bool)
    assert (got[off] == want[off]).all()


def test_partnered():
    rng = np.random.default_rng(5)
    for _ in range(20):
        t, n = np.sort(rng.integers(0, 6, 80)), rng.integers(1, 40, 80)
        pos = (rng.random(80) * (n // 8 + 1)).astype(np.int64)
        order = np.lexsort((pos, n, t))
        t, n, pos = t[order], n[order], pos[order]
        ok = jaccard_join.reach(n[:, None], pos[:, None], n[None], pos[None], 90, 100) & (t[:, None] == t[None])
        np.fill_diagonal(ok, False)
        assert (jaccard_join.partnered(t, n, pos, 90, 100, most=64) == ok.any(1)).all()


def test_grouped():
    """Each pair whose sketches and positions leave it possible ends in one group, and no other set joins them."""
    rng = np.random.default_rng(6)
    base = [rng.integers(0, 2**63, m).astype(np.uint64) for m in (250, 260, 500, 540)]
    sets_ = []
    for i in range(120):
        b = base[i % 4]
        sets_.append(np.unique(np.concatenate([b[: len(b) - int(rng.integers(0, 25))], rng.integers(0, 2**63, int(rng.integers(0, 14))).astype(np.uint64)])))
    n, pos = np.array([len(x) for x in sets_]), rng.integers(0, 20, 120)
    bits = np.array([jaccard_join.sketch(x) for x in sets_], object)
    label = np.arange(120)
    edges = jaccard_join.grouped(pos, n, bits, label, 90, 100)
    levels, want = jaccard_join.level(n), np.arange(120)
    for i in range(120):
        for j in range(i):
            low = int(min(levels[i], levels[j]))
            if max(levels[i], levels[j]) > 2 * low or not jaccard_join.reach(n[i], pos[i], n[j], pos[j], 90, 100):
                continue
            x, y = jaccard_join.folded(bits[[i, j]], low)
            if np.bitwise_count(x ^ y).sum() <= jaccard_join.apart(n[i], n[j], 90, 100):
                want[want == max(want[i], want[j])] = min(want[i], want[j])
    assert label.tolist() == want.tolist() and 2 < len(set(want.tolist())) < 60
    from_edges = np.arange(120)
    for i, j in edges:
        from_edges[from_edges == max(from_edges[i], from_edges[j])] = min(from_edges[i], from_edges[j])
    assert from_edges.tolist() == want.tolist()


def test_full_licenses(spark):
    names = ["Apache-2.0", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense"]
    texts = [licenses.KNOWN[n] for n in names]
    opening = {"Apache-2.0": "Apache License", "CC0-1.0": "CC0 1.0 Universal", "GPL-3.0": "GNU GENERAL PUBLIC LICENSE", "MPL-2.0": "Mozilla Public License", "BSL-1.0": "Boost Software License"}
    assert all(word in licenses.KNOWN[n][:200] for n, word in opening.items())
    rows = [(i, "Copyright 2020 Someone\n" + t.upper().replace("  ", " ")) for i, t in enumerate(texts)]
    got = collect(licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [r["license_id"] for r in got] == names
    assert licenses.known_digests(spark).count() == len(licenses.KNOWN)


def test_classifier_cases(spark):
    """Nulls, empty and very long texts, repeated rows, other columns and no rows; without labels a constant score."""
    schema = "doc_id long, text string, score double, c0 string, predicted int"
    rows = [(i, t, None, "x", 7) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], 1.0, None, None), (None, "a b", None, None, None)]
    d = spark.createDataFrame(rows, schema)
    y = spark.createDataFrame([(i, i % 2, i % 2) for i in range(len(TEXTS))] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for module, score, empty in ((toxicity, toxicity.score_toxicity, toxicity.FLOOR), (quality_classifier, quality_classifier.score_quality, 0.5)):
        model = module.train(d, y)
        got = score(d, model).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if r["doc_id"] == 5}) == 1
        assert [r["held_out"] for r in got if r["doc_id"] is not None] == [zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in got if r["doc_id"] is not None]
        assert len({r["score"] for r in got if r["doc_id"] in (0, 1)}) == 1  # null and empty
        assert score(d.limit(0), model).count() == 0
        bare = module.train(d.limit(0), y)
        assert {round(r["score"], 6) for r in score(d, bare).collect()} == {empty}
        with pytest.raises(ValueError):
            score(d, model, keep="predicted")
        assert score(d, model, keep="verdict").columns == [*d.columns, "verdict"]


def test_noisy_or():
    """A score is one minus the product of what its sentences leave, by hand."""
    word = common.Words(*common.text_bytes(pa.array(["bad"])), toxicity.APART).hash
    model = toxicity.Model(word, np.array([3.0]), -1.0)
    text = "This is bad. All fine here! bad bad"
    score, start, end = model.score(*common.text_bytes(pa.array([text, "fine", ""])))
    left = [1 / (1 + np.exp(x)) for x in (2.0, 5.0)]
    assert score.tolist() == pytest.approx([1 - (1 - toxicity.FLOOR) * left[0] * left[1], toxicity.FLOOR, toxicity.FLOOR])
    assert text[start[0] : end[0]] == "bad bad" and start[1] == end[2] == -1


def test_cosine_range():
    a, b = np.array([1e200, 1e200, 0]), np.array([1e-200, 0, 0])
    assert neighbours.cosine(a, np.stack([a, b, -a])).tolist() == pytest.approx([1, 2**-0.5, -1])
    rng = np.random.default_rng(0)
    x, q = rng.normal(size=(50, 9)), rng.normal(size=9)
    plain = (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))
    assert np.allclose(neighbours.cosine(q, x), plain, rtol=0, atol=2e-16)


def test_rule_cases(spark):
    """Very long texts, repeated rows, other columns; the query's SQL on all texts here."""
    import duckdb

    texts = [*TEXTS, LONG.replace(". ", ".\n"), "x\n" * 500, "# | $ % & < > *"]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)] + [(-5, TEXTS[5], 2, None)], "doc_id long, text string, n_words int, kept string")
    got = quality_rules.quality_rules(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [*enumerate(texts), (-5, TEXTS[5])])
    want = con.execute(f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM ({quality_rules.ORACLE})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def test_rules_clean_text(spark):
    """The lines that pass are the cleaned text, and the verdict comes from it."""
    good = ["One line of prose.", "  Another one, quoted: \u201cend.\u201d ", "\u00e9\U0001f600 t\u00eate!\r", "One line of prose."]
    bad = ["no end", "a | b | c | d.", "Please accept cookies.", "SHOUTING IS NOT PROSE AT ALL.", "# $ % & * < > |.", "", " \t"]
    prose = [" ".join(f"{w}{i}" for w in ("Line", "has", "words", "as", "the", "others", "have", "too")) + "." for i in range(12)]
    texts = [None, "", " \n", "no end", "\n".join([*good, *bad]), "\n".join(x for p in zip(prose, bad * 2, strict=False) for x in p), "\n".join([*prose, "w " * 400]), "\n".join(prose)]
    want = ["", "", "", "", "\n".join(good), "\n".join(prose), "\n".join(prose), "\n".join(prose)]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i]["clean_text"] for i in range(len(texts))] == want
    assert [got[i]["kept_chars"] for i in range(len(texts))] == [len(x.replace("\n", "")) for x in want]
    assert [got[i]["kept"] for i in range(len(texts))] == [False] * 5 + [True, False, True]


def test_neighbour_cases(spark):
    """Repeated rows, equal vectors, another dimension, null ids and components, other columns of clashing names; few rows."""
    rows = [(0, [1.0, 0.0], 9, "x"), (1, [1.0, 0.0], 9, "x"), (1, [1.0, 0.0], 9, "x"), (2, [2.0, 0.0], 9, None), (3, [0.0, 1.0], 9, "x"), (4, [1.0], 9, "x"), (None, [1.0, 1.0], 9, "x"), (5, [None, 1.0], 9, "x"), (6, [], 9, "x"), (7, [float("inf"), 1.0], 9, "x"), (8, [1e200, -1e200], 9, "x")]
    index = neighbours.Index(spark.createDataFrame(rows, "vec_id long, embedding array<double>, leaf int, id string"))
    got = index.search(index.rows.where("id in (0, 8)").select("id", "v")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1), (0, 2, 1), (0, 3, 2), (0, 4, 8), (0, 5, 3), (8, 1, 0), (8, 2, 1), (8, 3, 1), (8, 4, 2), (8, 5, 3)]
    assert [r["score"] for r in got][:5] == pytest.approx([1, 1, 1, 2**-0.5, 0])


def test_token_cases(spark):
    """Repeated rows and null ids keep their places by id, then text; a shard holds one document at least."""
    rows = [(2, "b b", 1), (None, "n", 2), (1, "a", 3), (2, "a", 4), (2, "b b", 5), (None, None, 6)]
    path = common.tokenizer_path("byte_bpe_50k.json")
    d = spark.createDataFrame(rows, "doc_id long, text string, start long")
    meta = wavelet.write_shards(d, scratch(spark, "t"), path, 2, shard_tokens=1)
    got = wavelet.read_shards(meta).orderBy("start").collect()
    ids = [common.byte_bpe(path).one(t).size + 1 for t in ("", "n", "a", "a", "b b", "b b")]
    assert meta.count() == 6 and [(r["doc_id"], r["n_tokens"]) for r in got] == list(zip([None, None, 1, 2, 2, 2], ids, strict=True))
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum(ids)[:-1]]).tolist()


@pytest.mark.parametrize("op", ["neighbours", "warc"])
def test_more_empty_tables(spark, op):
    if op == "warc":
        assert warc.read_warc(warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), scratch(spark, "w"))).count() == 0
    else:
        index = neighbours.Index(spark.createDataFrame([], "vec_id long, embedding array<float>"))
        assert index.search(index.rows.select("id", "v")).count() == 0 and index.measured() == (1.0, 1.0)


def test_jaccard_sql(spark):
    """The query's SQL on awkward texts."""
    import duckdb

    rng = np.random.default_rng(9)
    base = " ".join(f"w{x}" for x in rng.integers(0, 50, 80))
    texts = [*TEXTS[:-4], *(base.replace("w7", f"x{i % 3}", i % 4) for i in range(12)), base.upper()]
    got = jaccard_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 90, 100, links=True)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    assert [tuple(r) for r in collect(got)] == con.execute(jaccard_join.ORACLE + " ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("salt_rows, salt_sets", [(256, 100_000), (7, 100_000), (7, 5)])
def test_jaccard_names_rows_in_proportion(spark, monkeypatch, salt_rows, salt_sets):
    """The small side of the last join doesn't grow with the number of partitions, whatever the copies."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 30)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts + texts + [texts[0] + " x"] + [texts[1]] * 80)]
    rows += [(None, texts[1]), (None, None), (len(rows), None), (len(rows) + 1, ""), (3, "a b c d"), (3, texts[1])]
    monkeypatch.setattr(jaccard_join, "SALT_ROWS", salt_rows, raising=False)
    monkeypatch.setattr(jaccard_join, "SALT_SETS", salt_sets, raising=False)

    def made(plan):
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            return made(plan.executedPlan())
        if name.endswith("QueryStage"):
            return made(plan.plan())
        own = plan.metrics().apply("numOutputRows").value() if name.startswith("Generate") else 0
        return own + sum(made(plan.children().apply(i)) for i in range(plan.children().size()))

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        out = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100, links=True)
        got = out.collect()
        assert 60 <= made(out._jdf.queryExecution().executedPlan()) <= 60 + len(rows) // salt_rows + 60
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    s = [(d, sets(t, 3)) for d, t in rows]
    linked = [[bool(x and y) and 100 * len(x & y) >= 90 * len(x | y) and i != j and a is not None and b is not None for j, (b, y) in enumerate(s)] for i, (a, x) in enumerate(s)]
    want = [(d, len(x), None if d is None else min([d, *(s[j][0] for j in range(len(s)) if linked[i][j])]), None if d is None else sum(linked[i])) for i, (d, x) in enumerate(s)]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got), key=key) == sorted(want, key=key)


def test_classifier_files(spark, tmp_path):
    """The query of a table in many partitions writes few files, and all rows."""
    rows = [(i, f"{'good prose of words' if i % 2 else 'BAD ### 1234'} {i}. " * 5) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(40).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(k) for k in keys]
    try:
        for k in keys:
            spark.conf.set(k, "64k")
        assert spark.read.parquet(f"{tmp_path}/documents.parquet").rdd.getNumPartitions() == 40
        quality_classifier.op9_quality_classifier(spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert len(list((tmp_path / "out").glob("*.parquet"))) == 8
    assert [(r["doc_id"], r["predicted"]) for r in out.orderBy("doc_id").collect()] == [(i, i % 2) for i in range(200)]


def test_jaccard_files(spark, monkeypatch):
    """Every table of the join goes to an eighth of the partitions' files, or two a core, however many partitions there are."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 60)) for _ in range(150)]
    rows = list(enumerate(texts + [t + f" x{i} y{i % 3}" for i, t in enumerate(texts * 9)]))
    write, files = jaccard_join.materialize, {}

    def told(df, name, *a, **b):
        out = write(df, name, *a, **b)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        return out

    docs, before = spark.createDataFrame(rows, "doc_id long, text string"), spark.conf.get("spark.sql.shuffle.partitions")
    want = sorted(jaccard_join.jaccard_components(docs, 3, 90, 100, links=True).collect())
    assert len({r["component_id"] for r in want}) == 150 and min(r["n_links"] for r in want) == 9
    monkeypatch.setattr(jaccard_join, "materialize", told)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        assert sorted(jaccard_join.jaccard_components(docs.repartition(64), 3, 90, 100, links=True).collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {"signatures", "answers", "texts"} <= set(files) and max(files.values()) <= 2 * spark.sparkContext.defaultParallelism
