"""SentencePiece BPE encoding that keeps every piece's span in the original bytes, and decoding.

Normalisation takes the longest prefix that the model's compiled character map knows and records where each
normalised byte came from; the merges run on the normalised text; each piece is projected to its source span.

Defined results: a null text is an empty one; an empty text has the end id alone and decodes to ''; repeated
rows are encoded each; other columns are ignored.

Many byte pieces of one character share that character's span. The ids, the spans and the decoded text of the query
come from one pass: a word's pieces and their places within it are kept for the words that come again.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.llm import common
from cladeflow.runtime import ship

MARK = "▁"
MARK_BYTES = MARK.encode()


class CharMap:
    """The compiled map: a double-array trie of sources, and a block of zero-ended replacements."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.texts = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.texts = blob[4 + size :]

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes taken and their replacement for the longest known prefix at this place."""
        if not self.units:
            return None
        shift = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        node, found = shift(self.units[0]), None
        for i in range(at, len(raw)):
            node ^= raw[i]
            if node >= len(self.units) or (unit := self.units[node]) & 0x800000FF != raw[i]:
                break
            node ^= shift(unit)
            if unit & 0x100:
                value = self.units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.texts[value : self.texts.index(b"\0", value)]
        return found


#: A segment's ids, the same as text, what they decode to, and of each id, as 32-bit numbers, how far its span ends behind the
#: span before, and the span's size in the source.
Word = tuple[tuple[int, ...], str, bytes, bytes]


class Encoder:
    def __init__(self, path: str | None = None, cache: int = 400_000, serialized: bytes = b""):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        if path is not None:
            with open(path, "rb") as f:
                serialized = f.read()
        model.ParseFromString(serialized)
        norm, train = model.normalizer_spec, model.trainer_spec
        if train.model_type != 2 or train.treat_whitespace_as_suffix or not norm.escape_whitespaces:
            raise ValueError("a BPE model with escaped white space before words is expected")
        self.map = CharMap(norm.precompiled_charsmap)
        self.dummy, self.squeeze = norm.add_dummy_prefix, norm.remove_extra_whitespaces
        self.pieces = [p.piece for p in model.pieces]
        # fixed values: kinds of pieces in the model file: 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte
        kinds = [p.type for p in model.pieces]
        if 4 in kinds or 5 in kinds:
            raise ValueError("user-defined or unused pieces aren't supported")
        self.score = {p.piece: p.score for p in model.pieces if p.type == 1}
        self.id = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == 1}
        self.unk = kinds.index(2)
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == 6}
        if not train.byte_fallback:
            self.byte = {}
        self.bytes_of = [bytes([int(p[3:5], 16)]) if k == 6 else b"" if k == 3 else p.replace(MARK, " ").encode() for p, k in zip(self.pieces, kinds, strict=True)]
        self.raw_byte = [k == 6 for k in kinds]
        self.step_of = [struct.pack("<2i", len(x), len(x)) for x in self.bytes_of]
        self.text_of = [str(i) for i in range(len(self.pieces))]
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece spans words")
        self.eos = self.pieces.index("</s>")
        # no normal piece holds these characters beside others, so that they part the text for certain
        self.cut = "" if any("\n" in p for p in self.id) else "\n"
        self.segment = re.compile(f"{self.cut}|{MARK}+[^{MARK}{self.cut}]*|[^{MARK}{self.cut}]+" if self.cut else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.cache: dict[str, Word] = {}
        self.most = cache

    def normalise(self, text: str) -> tuple[str, list[int] | None]:
        """The normalised text and, for each of its bytes and its end, the place in the source's bytes.

        None: the map changes nothing, and every byte stays but for escaped spaces (see encode)."""
        if not self.map.units and not self.squeeze:
            if not text:
                return "", None
            return (MARK if self.dummy else "") + text.replace(" ", MARK), None
        raw, out, where, at = text.encode(), bytearray(), [], 0
        lead, end, blank = 0, len(text.encode()), self.squeeze  # where the mark before the text, and its end, are taken to be
        while at < len(raw):
            got = self.map.longest(raw, at)
            if got is None:
                n = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
                got = n, raw[at : at + n]
            out += got[1]
            where += [at] * len(got[1])
            at += got[0]
            blank = blank and got[1] == b" "
            lead = at if blank else lead
        if self.squeeze:
            keep = [i for i, c in enumerate(out) if c != 32 or i and out[i - 1] != 32]
            if keep and out[keep[0]] == 32:
                keep = keep[1:]
            if keep and out[keep[-1]] == 32:
                end = where[keep[-1]]
                keep = keep[:-1]
            out, where = bytearray(out[i] for i in keep), [where[i] for i in keep]
        if not out:
            return "", [0]
        mark, new, to = MARK.encode(), bytearray(), []
        if self.dummy:
            new += mark
            to += [lead] * 3
        for c, w in zip(out, where, strict=True):
            new += mark if c == 32 else bytes([c])
            to += [w] * (3 if c == 32 else 1)
        return new.decode(), [*to, end]

    def merge(self, word: str) -> list[str]:
        """Best-scored neighbours join first, the leftmost of equals, until none is a piece."""
        get, none = self.score.get, float("-inf")
        parts = list(word)
        scores = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while scores and (best := max(scores)) != none:
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i < len(scores):
                scores[i] = get(parts[i] + parts[i + 1], none)
            if i:
                scores[i - 1] = get(parts[i - 1] + parts[i], none)
        return parts

    def merge_long(self, word: str) -> list[str]:
        """The same through a heap, for long words."""
        import heapq

        n = len(word)
        part, before, after = list(word), list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (s := self.score.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (-s, i, j, part[i] + part[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if not part[i] or after[i] != j or part[i] + part[j] != both:
                continue
            part[i], part[j], after[i] = both, "", after[j]
            if after[j] >= 0:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p in part if p]

    def pieces_in(self, word: str) -> Iterator[tuple[list[int], int, int]]:
        """Ids of each piece of a segment with its place in the segment's bytes; unknown pieces in a row are one."""
        at, unknown = 0, -1
        for p in self.merge(word) if len(word) <= 40 else self.merge_long(word):
            i, end = self.id.get(p), at + len(p.encode())
            if i is None and not self.byte:
                unknown = at if unknown < 0 else unknown
            else:
                if unknown >= 0:
                    yield [self.unk], unknown, at
                    unknown = -1
                yield [i] if i is not None else [self.byte[b] for b in p.encode()], at, end
            at = end
        if unknown >= 0:
            yield [self.unk], unknown, at

    def word(self, word: str) -> Word:
        """A segment of a text whose marks are all escaped spaces: a mark is one byte there."""
        got = self.cache.get(word)
        if got is None:
            ids = list(map(self.id.get, self.merge(word) if len(word) <= 40 else self.merge_long(word)))
            if None not in ids:
                spans = b"".join([self.step_of[i] for i in ids])
            else:
                ids, steps, raw = [], [], word.encode()
                for some, a, b in self.pieces_in(word):
                    n = b - a - 2 * raw.count(MARK_BYTES, a, b)
                    ids += some
                    steps += [n, n] + [0, n] * (len(some) - 1)
                spans = struct.pack(f"<{len(steps)}i", *steps)
            got = tuple(ids), " ".join([self.text_of[i] for i in ids]), b"".join([self.bytes_of[i] for i in ids]), spans
            if len(self.cache) < self.most and len(word) <= 64:
                self.cache[word] = got
        return got

    def encode(self, text: str) -> list[int]:
        return [i for w in self.aligned(text)[0] for i in w[0]] + [self.eos]

    def aligned(self, text: str) -> tuple[list[Word], np.ndarray]:
        """The segments of a text, and of each piece and the end id the source bytes [start, end) it stands for."""
        normal, where = self.normalise(text)
        known = self.cache.get
        words = [known(w) or self.word(w) for w in self.segment.findall(normal)]
        size = len(text.encode())
        steps = np.frombuffer(b"".join([w[3] for w in words]), "<i4").reshape(-1, 2)
        spans = np.empty((len(steps) + 1, 2), np.int64)
        if where is None and MARK not in text:
            np.cumsum(steps[:, 0], out=spans[:-1, 1])
            spans[:-1, 1] -= self.dummy  # the mark before the text stands for nothing
            np.subtract(spans[:-1, 1], steps[:, 1], out=spans[:-1, 0])
            np.maximum(spans, 0, out=spans)
        elif normal:
            if where is None:
                where = [0] * (3 * self.dummy)
                at = 0
                for c in text:
                    n = len(c.encode())
                    where += [at] * 3 if c == " " else [at] * n
                    at += n
                where.append(size)
            # with other marks in the text the places in the normalised bytes count, and lead to the source's
            places, at = [], 0
            for w in self.segment.findall(normal):
                for some, a, b in self.pieces_in(w):
                    places += [(at + a, at + b)] * len(some)
                at += len(w.encode())
            spans[:-1] = np.array(where, np.int64)[np.array(places, np.int64)]
        spans[-1] = size
        return words, spans

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """Each piece's id and the source bytes [start, end) it stands for; the end id's span is empty."""
        words, spans = self.aligned(text)
        return [(i, a, b) for i, (a, b) in zip([*(i for w in words for i in w[0]), self.eos], spans.tolist(), strict=True)]

    def decode(self, ids: list[int]) -> str:
        """Pieces joined; what byte pieces make is read as UTF-8, and the space put before the text goes."""
        out, held, first = [], b"", True
        for i in ids:
            if self.raw_byte[i]:
                held += self.bytes_of[i]
                first = False
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = b""
            t = " ⁇ " if i == self.unk else self.bytes_of[i].decode()
            if first and t and self.dummy and t[0] == " ":
                t = t[1:]
            if self.bytes_of[i]:
                first = False
            out.append(t)
        return "".join(out) + held.decode("utf-8", "replace")

    def digests(self, text: str) -> tuple[int, str, str, int]:
        """Number of ids, the SHA-256 of the ids and of the text decoded from them, and the CRC-32 of all spans as
        little-endian 32-bit numbers."""
        words, spans = self.aligned(text)
        n = len(spans)
        joined = " ".join([w[1] for w in words] + [str(self.eos)]).encode()
        if self.byte:  # a character's byte pieces lie in one segment: the segments' bytes join to the whole
            body = b"".join([w[2] for w in words])
            body = body[1:] if self.dummy and body[:1] == b" " else body
        else:
            body = self.decode([i for w in words for i in w[0]]).encode()
        return n, hashlib.sha256(joined).hexdigest(), hashlib.sha256(body).hexdigest(), zlib.crc32(spans.astype("<u4").tobytes())


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of each text with the end id, and each piece's span in the text's bytes."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for batch in batches:
            for b in common.pieces_of(batch, "text", 1 << 18):
                rows = [e.spans(t or "") for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([[x[k] for x in r] for r in rows], pa.list_(pa.int32())) for k in range(3))], names=["id", "ids", "span_start", "span_end"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>, span_start array<int>, span_end array<int>").withColumnRenamed("id", id_col)


def piece_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: number of ids, digest of the ids, digest of what they decode to, checksum of the pieces' source spans."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for batch in batches:
            for b in common.pieces_of(batch, "text"):
                rows = [e.digests(t or "") for t in b.column("text").to_pylist()]
                n, ids, decoded, spans = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string()), pa.array(spans, pa.int64())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long").withColumnRenamed("id", id_col)


def op5_sentence_pieces(spark, sf_dir):
    from cladeflow.runtime import table

    return piece_digests(table(spark, sf_dir, "documents"), common.tokenizer_path("piece_bpe_32k.model"))
