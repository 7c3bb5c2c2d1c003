"""Byte-level BPE: encode whole texts with a public rank file, and decode ids to bytes.

Two tiers. A minimal perfect hash over the vocabulary resolves a pre-token that is itself a token: one hash, one displacement, one
comparison of bytes. All others are merged: bytes in a linked list, neighbouring pairs in a heap by (rank, place), so the
lowest rank and, among equals, the leftmost pair goes first, and a very long pre-token costs n log n.

Pre-tokens are the matches of the public pattern. What a pre-token gives (its ids, their decimals, the bytes decoded from them) is remembered in a
bounded table, so texts are put together from pre-tokens, not from single ids. Ids are remembered as packed 32-bit numbers, which take a
third of the room of Python numbers and are joined into a column as they are.

The tables depend on the rank file alone and are sent to the workers once. Texts are independent: no shuffle, no state between tasks.

Defined cases: a null text is empty; an empty text has no tokens (the digests of the empty string); special tokens are ordinary text;
equal rows give equal rows; an empty table gives no rows; other columns are passed through by :func:`encode_documents`.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, IntegerType, StructField, StructType

from lacuna.llm.common import table

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
REMEMBERED = 200_000
SLICE_BYTES = 2 << 20


def read_ranks(path: str) -> list[bytes]:
    """Tokens by id."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    return [ranks[i] for i in range(len(ranks))]


class PerfectHash:
    """A minimal perfect hash of byte strings by hashing into buckets and re-hashing whole buckets.

    Buckets go by falling size; each takes the first number under which all its keys fall on free places. A bucket of one key names its
    place directly (stored as -1 - place). Looking up a string that isn't a key gives some place, so callers compare."""

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        self.n, self.n_buckets = len(keys), max(1, len(keys) // per_bucket)
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        buckets: list[list[int]] = [[] for _ in range(self.n_buckets)]
        for i, b in enumerate((hashes >> np.uint64(32)) % np.uint64(self.n_buckets)):
            buckets[b].append(i)
        self.number, self.at = [0] * self.n_buckets, [0] * self.n
        taken, single, tries = np.zeros(self.n, bool), [], np.arange(1024, dtype=np.uint64)
        for b in sorted(range(self.n_buckets), key=lambda b: -len(buckets[b])):
            members = buckets[b]
            if len(members) < 2:
                single += [b] * len(members)
                continue
            for start in range(0, 1 << 26, len(tries)):
                places = self._place(hashes[members][:, None], tries + np.uint64(start)).astype(np.int64)
                ok = ~taken[places].any(axis=0)
                ok[ok] = (np.diff(np.sort(places[:, ok], axis=0), axis=0) > 0).all(axis=0)
                if ok.any():
                    d = int(ok.argmax())
                    break
            else:
                raise ValueError("two keys have one hash")
            self.number[b] = start + d
            taken[places[:, d]] = True
            for i, p in zip(members, places[:, d].tolist(), strict=True):
                self.at[p] = i
        for b, p in zip(single, np.flatnonzero(~taken).tolist(), strict=True):
            self.number[b], self.at[p] = -1 - p, buckets[b][0]

    def _place(self, h, d):
        """The place under number ``d``, for arrays; :meth:`place` says the same for one key."""
        return ((h ^ (d * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)) % np.uint64(self.n)

    def place(self, key: bytes) -> int:
        """The number of the key, if it is one."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.number[(h >> 32) % self.n_buckets]
        if d < 0:
            return self.at[-1 - d]
        return self.at[((h ^ (d * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * 0xD6E8FEB86659FD93 >> 33 & 0x7FFFFFFF) % self.n]


class Remembered(dict):
    """What a function gave for recent arguments: two generations of at most ``limit`` entries."""

    def __init__(self, fn, limit: int = REMEMBERED):
        super().__init__()
        self.fn, self.limit, self.old = fn, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.fn(key)
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Tables:
    """What encoding needs of a rank file; built once on the driver and sent to the workers."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, pattern
        self.hash = PerfectHash(tokens)
        self.byte_ids = [-1] * 256
        for i, t in enumerate(tokens):
            if len(t) == 1:
                self.byte_ids[t[0]] = i
        known = {t: i for i, t in enumerate(tokens)}
        pairs = [(known[t[:k]], known[t[k:]], i) for i, t in enumerate(tokens) for k in range(1, len(t)) if t[:k] in known and t[k:] in known]
        self.pairs = np.array(pairs, np.int64)
        self.key = hashlib.sha256(pattern.encode() + b"".join(b"%d:" % len(t) + t for t in tokens)).hexdigest()


class Codec:
    """Encodes texts and decodes ids in one worker."""

    def __init__(self, tables: Tables, remembered: int = REMEMBERED):
        self.tokens, self.hash, self.byte_ids = tables.tokens, tables.hash, tables.byte_ids
        none: dict[int, int] = {}
        self.after = [none] * len(self.tokens)  # by the left id, then by the right one: the id of the pair
        for left, right, whole in tables.pairs.tolist():
            if self.after[left] is none:
                self.after[left] = {}
            self.after[left][right] = whole
        self.pieces = regex.compile(tables.pattern).findall
        self.whole = Remembered(lambda text: array("i", self.piece(text)).tobytes(), remembered)
        self.told = Remembered(self._tell, remembered)

    def piece(self, text: str) -> tuple[int, ...] | list[int]:
        """Ids of one pre-token."""
        data = text.encode("utf-8", "surrogatepass")
        i = self.hash.place(data)
        return (i,) if self.tokens[i] == data else self.merge(data)

    def merge(self, data: bytes) -> list[int]:
        """Merge bytes by rank, leftmost first among equal ranks.

        ``ranks`` has the rank of the pair that starts at a place now, so an entry of the heap that no longer holds is told by comparison."""
        pair, ids, n = self.after, [self.byte_ids[b] for b in data], len(data)
        ranks = [pair[x].get(y, -1) for x, y in zip(ids, ids[1:], strict=False)] + [-1]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | k for k, r in enumerate(ranks) if r >= 0]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            top = pop(heap)
            r, k = top >> 32, top & 0xFFFFFFFF
            if ranks[k] != r:
                continue
            j = after[k]
            ids[k], ids[j], ranks[j], ranks[k] = r, -1, -1, -1
            after[k] = m = after[j]
            if m < n:
                before[m] = k
                ranks[k] = x = pair[r].get(ids[m], -1)
                if x >= 0:
                    push(heap, x << 32 | k)
            if (p := before[k]) >= 0:
                ranks[p] = x = pair[ids[p]].get(r, -1)
                if x >= 0:
                    push(heap, x << 32 | p)
        return [i for i in ids if i >= 0]

    def packed(self, text: str | None) -> bytes:
        """Ids of a text as 32-bit numbers, one after the other."""
        return b"".join(map(self.whole.__getitem__, self.pieces(text))) if text else b""

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def decode(self, ids) -> bytes:
        return decoded(self.tokens, ids)

    def _tell(self, piece: str) -> tuple[int, bytes, bytes]:
        """Of a pre-token: the number of its ids, the ids in decimal with a comma behind each, and the bytes that they decode to."""
        ids = self.piece(piece)
        return len(ids), b"%d," * len(ids) % tuple(ids), self.decode(ids)

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """The number of ids of a text and the digests of the ids and of the bytes decoded from them."""
        n, decimals, data = zip(*map(self.told.__getitem__, self.pieces(text)), strict=True) if text else ((), (), ())
        return sum(n), hashlib.sha256(b"".join(decimals)[:-1]).hexdigest(), hashlib.sha256(b"".join(data)).hexdigest()


_TABLES: dict[tuple[str, str], Tables] = {}
_CODECS: dict[tuple[str, int], Codec] = {}


def codec(tables: Tables, remembered: int = REMEMBERED) -> Codec:
    """The codec of this process for these tables; tasks that follow each other in a worker share what it remembers."""
    key = (tables.key, remembered)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(tables, remembered)
    return _CODECS[key]


def tables(path: str | None = None, pattern: str | None = None) -> Tables:
    """Tables of a rank file; by default the public multilingual one."""
    import public_tokenizers

    key = (path or public_tokenizers.path(RANK_FILE), pattern or public_tokenizers.PATTERN)
    if key not in _TABLES:
        _TABLES[key] = Tables(read_ranks(key[0]), key[1])
    return _TABLES[key]


def decoded(tokens: list[bytes], ids) -> bytes:
    """The bytes that ids stand for."""
    return b"".join(map(tokens.__getitem__, ids))


def _forget() -> None:
    """Drops the codec of this process. A codec and what it remembers refer to each other, so only a collection frees them."""
    _CODECS.clear()
    gc.collect()


def _as_it_is(value):
    """For workers that need no more than what was sent; it forgets the codec of an earlier task."""
    _forget()
    return value


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``SLICE_BYTES`` bytes, one row at least."""
    first = held = 0
    for k, size in enumerate(sizes.tolist()):
        held += size
        if held >= SLICE_BYTES:
            yield first, k + 1
            first, held = k + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def _appended(docs: DataFrame, name: str, kind: DataType, fn, needs, opened) -> DataFrame:
    """``docs`` and a column that ``fn(own, batch)`` gives for a few MB of rows at a time; ``own`` is ``opened(needs)`` of the worker.

    Tasks take turns on all workers that an executor has had use for, so a worker keeps no codec while others work."""
    shared = docs.sparkSession.sparkContext.broadcast(needs)  # bounded by the vocabulary

    def appended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = opened(shared.value)
        for batch in batches:
            for i, j in _slices(np.full(batch.num_rows, max(1, batch.nbytes // max(1, batch.num_rows)))):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, fn(own, part)], names=[*part.schema.names, name])
        own = None
        _forget()

    return docs.mapInArrow(appended, StructType([*docs.schema.fields, StructField(name, kind)]))


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """All columns of ``docs`` and __ids, the token ids of the whole text."""
    at = docs.columns.index("text")

    def ids(own: Codec, part: pa.RecordBatch) -> pa.Array:
        flat = [own.packed(text.as_py()) for text in part.column(at)]
        ends = np.cumsum([0, *map(len, flat)]) // 4
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(flat), np.int32)))

    return _appended(docs, "__ids", ArrayType(IntegerType()), ids, tables(path), codec)


def decode_documents(encoded: DataFrame, ids: str, path: str | None = None) -> DataFrame:
    """All columns of ``encoded`` and __bytes, the bytes that the ids stand for. A worker holds the tokens alone, no merges."""
    at = encoded.columns.index(ids)

    def back(tokens: list[bytes], part: pa.RecordBatch) -> pa.Array:
        return pa.array([decoded(tokens, v.as_py() or ()) for v in part.column(at)], pa.binary())

    return _appended(encoded, "__bytes", BinaryType(), back, tables(path).tokens, _as_it_is)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """All columns of ``docs`` and __digest: n_tokens, and the digests of the ids and of the bytes decoded from them.

    Encodes and decodes as the two functions above, but the ids stay in the worker."""
    shared = docs.sparkSession.sparkContext.broadcast(tables(path))

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(shared.value)
        for texts in series:
            yield pd.DataFrame([own.digest(text) for text in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256"])
    return docs.withColumn("__digest", digest("text"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return digests(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "__digest.*")
