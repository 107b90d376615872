"""Vectorised text kernels and file access shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The white space that ends a word in the query contracts.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE_BYTES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20_240_817)
#: A random 64-bit word for every byte, and an odd base with its inverse modulo 2^64.
BYTE_WORD = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
_powers = {"n": 0}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        n = max(n, 1 << 20)
        for key, base in (("up", BASE), ("down", INVERSE)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[key] = np.cumprod(x, dtype=np.uint64)
        _powers["n"] = n
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and each row's offsets; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces_of(batch: pa.RecordBatch, text: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes of text, one row at least: bounds the kernels' memory."""
    _, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Words of many texts at once: starts, ends, 64-bit hashes, and how many each text has."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, apart: np.ndarray = IS_SPACE):
        low = LOWER[raw]
        space = apart[raw]
        begins, ends = ~space, ~space
        if len(raw):
            inner = space[:-1].copy()
            begins[1:] &= inner
            ends[:-1] &= space[1:]
            full = offsets[1:] > offsets[:-1]
            first, last = offsets[:-1][full], offsets[1:][full] - 1
            begins[first] = ~space[first]
            ends[last] = ~space[last]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        up, self._down = powers(len(raw) + 1)
        self._sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTE_WORD[low] * up[: len(raw)], out=self._sums[1:])
        self.hash = self.span_hash(self.start, self.end)
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.low = low

    def span_hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the lower-cased bytes [a, b)."""
        return mix((self._sums[b] - self._sums[a]) * self._down[a])

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word windows and each text's offsets into them; fewer words make one window."""
        n = np.maximum(self.count - k + 1, (self.count > 0).astype(self.count.dtype))
        to = np.concatenate([[0], np.cumsum(n)])
        h, w = self.hash, len(self.hash)
        out = np.zeros(to[-1], np.uint64)
        long = self.count >= k
        if long.any():
            g = np.zeros(w - k + 1, np.uint64)
            for j in range(k):
                g = (g + h[j : w - k + 1 + j]) * np.uint64(0xD6E8FEB86659FD93 + 2 * j)
            g = mix(g)
            starts, sizes = self.first[:-1][long], n[long]
            at = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            where = np.repeat(to[:-1][long] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            out[where] = g[at]
        for d in np.flatnonzero((self.count > 0) & ~long):
            g = np.uint64(0xA0761D6478BD642F + int(self.count[d]))
            with np.errstate(over="ignore"):
                for x in h[self.first[d] : self.first[d + 1]]:
                    g = (g + x) * np.uint64(0xE7037ED1A0B428DB)
            out[to[d]] = mix(np.array([g], np.uint64))[0]
        return out, to


def filesystem(uri: str):
    """pyarrow's filesystem for a path in the shared folder, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class WholeFile:
    """A file written under another name and moved into place when it is closed: a task that dies leaves no half file."""

    def __init__(self, uri: str):
        import uuid

        self.uri = uri
        self.store, self.path = filesystem(uri)
        self.store.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.half = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.stream = self.store.open_output_stream(self.half)

    def write(self, x: bytes) -> None:
        self.stream.write(x)

    def close(self) -> None:
        self.stream.close()
        self.store.move(self.half, self.path)


def write_whole(uri: str, parts: Iterator[bytes]) -> None:
    f = WholeFile(uri)
    for x in parts:
        f.write(x)
    f.close()


_tokenizers: dict[str, object] = {}


class ByteBPE:
    """Ids of a byte-level BPE vocabulary file of the tokenizers library.

    The merges run in tiktoken over the very same vocabulary (its ranks are the ids of the JSON file,
    its split is the file's byte-level split): the ids are those of tokenizers at a fifth of the CPU time.
    The first text of every batch is encoded by both and compared; where tiktoken refuses a text,
    tokenizers encodes it.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        # fixed values: the bytes that the byte-level alphabet prints as themselves
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        spec = json.load(open(path, encoding="utf-8"))
        added = {x["content"] for x in spec.get("added_tokens", [])}
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        # fixed value: the split of the byte-level pre-tokenizer
        split = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.fast = tiktoken.Encoding("bytes", pat_str=split, mergeable_ranks=ranks, special_tokens={})
        self.own = Tokenizer.from_file(path)
        self.special = sorted(added)

    def one(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.own.encode(text, add_special_tokens=False).ids, np.uint32)
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)
        except BaseException as e:  # a panic of the Rust side isn't an Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return np.array(self.own.encode(text, add_special_tokens=False).ids, np.uint32)

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        out = [self.one(t or "") for t in texts]
        for t, ids in zip(texts[:1], out, strict=False):
            if t and len(t) < 20_000 and self.own.encode(t, add_special_tokens=False).ids != ids.tolist():
                raise ValueError("the two encoders disagree about this vocabulary file")
        return out


def byte_bpe(path: str) -> ByteBPE:
    if path not in _tokenizers:
        _tokenizers[path] = ByteBPE(path)
    return _tokenizers[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
