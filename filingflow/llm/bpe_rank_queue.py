"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Merging always takes the pair of least rank, leftmost first.  The queue has
buckets of linked-list positions by merge rank and a two-level bitmap over the
ranks, whose find-first-set gives the next bucket at once, whatever the
pre-token's length.  Entries are never removed early: a popped position whose
pair has changed since is stale and skipped.  A pre-token of n bytes costs
O(n log n), so texts without white space are no special case.

``Encoder.long`` runs the queue over one long pre-token.  ``Encoder.short``
runs one queue over many short pre-tokens at once, in numpy: the first word of
the bitmap that isn't zero holds the least ranks of all of them, so each
pre-token with entries there merges its own least pair in the same step.

Texts are encoded per task, slice by slice; equal short pre-tokens are merged
once while a bounded memory of packed ids holds them.  The vocabulary is read
by the driver and broadcast; ``MAX_VOCABULARY_BYTES`` bounds it.  A Python
worker that Spark uses again keeps encoder and memory of the last vocabulary.

Defined results: a null or empty text has no tokens and decodes to no bytes;
invalid UTF-8 becomes U+FFFD before encoding; rows are independent, so
repeated rows and ids repeat their result; other columns are carried along,
those named like a result column are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import os
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MAX_VOCABULARY_BYTES = 32 << 20
#: Pre-tokens up to this many characters are remembered, this many in each of two generations.
MEMORY_CHARS, MEMORY_ENTRIES = 64, 150_000
_BATCH_BYTES = 4 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a base64 rank file; the driver reads it, its size is checked."""
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


_NONE = np.int64(1 << 40)


class Encoder:
    """Rank queues over pre-tokens; every queue is empty when a call ends."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=0)
        self.words = (max(ranks.values(), default=0) >> 8) + 1
        self.of_byte = np.array([ranks.get(bytes([b]), 0) for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.array(sorted(pairs), np.int64)
        self.keys = np.append(keys, np.int64((1 << 62)))
        self.merged = np.array([pairs[int(k)] for k in keys] + [_NONE], np.int64)

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.merged[at], _NONE)

    def short(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of pre-tokens that are not empty."""
        buf = np.frombuffer(b"".join(pieces), np.uint8)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        last = np.cumsum(size) - 1
        n = len(buf)
        owner = np.repeat(np.arange(len(pieces)), size)
        token, alive = self.of_byte[buf], np.ones(n, bool)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[last] = n
        before[last - size + 1] = -1
        pair = np.full(n + 1, _NONE)
        buckets: list[list[np.ndarray]] = [[] for _ in range(self.words)]
        top = 0

        def push(at):
            nonlocal top
            rank = pair[at]
            at, rank = at[rank != _NONE], rank[rank != _NONE]
            if not len(at):
                return
            entry = (owner[at] << 8 | rank & 255) << 32 | at
            word = rank >> 8
            order = np.argsort(word, kind="stable")
            word, entry = word[order], entry[order]
            cuts = np.flatnonzero(word[1:] != word[:-1]) + 1
            for w, part in zip(word[np.append(0, cuts)].tolist(), np.split(entry, cuts)):
                buckets[w].append(part)
                top |= 1 << w

        first = np.flatnonzero(after < n)
        pair[first] = self._pair(token[first], token[first + 1])
        push(first)
        while top:
            w = (top & -top).bit_length() - 1
            entry = buckets[w][0] if len(buckets[w]) == 1 else np.concatenate(buckets[w])
            entry = entry[pair[entry & 0xFFFFFFFF] == (w << 8 | entry >> 32 & 255)]  # others are stale
            entry.sort()  # by pre-token, rank, position
            piece = entry >> 40
            least = np.ones(len(entry), bool)
            least[1:] = piece[1:] != piece[:-1]
            rest = entry[~least]
            buckets[w] = [rest] if len(rest) else []
            if not len(rest):
                top &= top - 1
            i = entry[least] & 0xFFFFFFFF
            if not len(i):
                continue
            j = after[i]
            k = after[j]
            token[i] = pair[i]
            after[i] = k
            alive[j] = False
            pair[j] = pair[i] = _NONE
            has = k < n
            before[k[has]] = i[has]
            pair[i[has]] = self._pair(token[i[has]], token[k[has]])
            h = before[i]
            i2, h = i[h >= 0], h[h >= 0]
            pair[h] = self._pair(token[h], token[i2])
            push(np.concatenate([i[has], h]))
        counts = np.bincount(owner[alive], minlength=len(pieces))
        return token[alive].astype(np.int32), np.concatenate([[0], np.cumsum(counts)])

    def long(self, data: bytes) -> list[int]:
        n, get, longest, low, top, buckets = len(data), self.ranks.get, self.longest, [0] * self.words, 0, {}
        after, before, pair = list(range(1, n + 2)), list(range(-1, n)), [None] * (n + 1)
        for i in range(n - 1):
            r = get(data[i:i + 2])
            if r is not None:
                pair[i] = r
                if r in buckets:
                    buckets[r].append(i)  # ascending, so the list is a heap already
                else:
                    buckets[r] = [i]
                    low[r >> 8] |= 1 << (r & 255)
                    top |= 1 << (r >> 8)
        while top:
            a = (top & -top).bit_length() - 1
            word = low[a]
            r = (a << 8) + (word & -word).bit_length() - 1
            bucket = buckets[r]
            i = heappop(bucket)
            if not bucket:
                del buckets[r]
                low[a] = word = word & (word - 1)
                if not word:
                    top &= top - 1
            if pair[i] != r:
                continue  # stale: merged away, or another pair by now
            j = after[i]
            k = after[i] = after[j]
            before[k] = i
            pair[j] = None
            for x, end in ((i, after[k] if k < n else 0), (before[i], k)):
                if x < 0:
                    continue
                r = get(data[x:end]) if 0 < end - x <= longest else None
                if r is not None and pair[x] != r:
                    if r in buckets:
                        heappush(buckets[r], x)
                    else:
                        buckets[r] = [x]
                        low[r >> 8] |= 1 << (r & 255)
                        top |= 1 << (r >> 8)
                pair[x] = r
        out, i = [], 0
        while i < n:
            j = after[i]
            out.append(self.ranks[data[i:j]])
            i = j
        return out


class PackedMemory(dict):
    """Pre-token to packed int32 ids; long pre-tokens are not remembered.

    When the young generation is full it becomes the old one; what the next
    texts have of the old one becomes young again.
    """

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.encoder, self.old = Encoder(ranks), {}
        self.token = {rank: data for data, rank in ranks.items()}

    def learn(self, texts: list[list[str]]) -> None:
        """Have what the texts need, from the old generation or encoded."""
        needed = set().union(*texts)
        new = needed.difference(self)
        if len(self) + len(new) > MEMORY_ENTRIES:
            self.old = dict(self)
            self.clear()
            new = needed
        known = new.intersection(self.old)
        self.update({p: self.old.pop(p) for p in known})
        ranks, pieces, data = self.encoder.ranks, [], []
        for p in new.difference(known):
            if len(p) <= MEMORY_CHARS:
                b = p.encode()
                whole = ranks.get(b)
                if whole is not None:
                    self[p] = whole.to_bytes(4, "little")
                else:
                    pieces.append(p)
                    data.append(b)
        if pieces:
            ids, offs = self.encoder.short(data)
            packed, at = ids.astype("<i4").tobytes(), (offs * 4).tolist()
            self.update(zip(pieces, [packed[a:b] for a, b in zip(at, at[1:])]))

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.encoder.ranks.get(data)
        return np.array(self.encoder.long(data) if whole is None else [whole], "<i4").tobytes()


_kept: dict[str, PackedMemory] = {}


def _memory(shipped) -> PackedMemory:
    """Encoder and memory of the broadcast vocabulary, kept by the worker."""
    name, ranks = shipped.value
    if name not in _kept:
        _kept.clear()
        _kept[name] = PackedMemory(ranks)
    return _kept[name]


def _ship(spark: SparkSession, ranks_path: str):
    ranks = load_ranks(ranks_path)
    name = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    return spark.sparkContext.broadcast((name, ranks))


def _packed(batch: pa.RecordBatch, name: str, memory: PackedMemory, find) -> list[bytes]:
    """Packed ids of every text of the batch."""
    pieces = [find((t or b"").decode("utf-8", "replace")) for t in batch.column(name).cast(pa.binary()).to_pylist()]
    memory.learn(pieces)
    lookup = memory.__getitem__
    return [b"".join(map(lookup, p)) for p in pieces]


def _replaced(batch: pa.RecordBatch, name: str, column: pa.Array, new: str) -> pa.RecordBatch:
    keep = [n for n in batch.schema.names if n not in (name, new)]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + [column], keep + [new])


def _slices(batch: pa.RecordBatch, name: str):
    """Row ranges of about _BATCH_BYTES of the column."""
    rows = max(1, int(len(batch) * _BATCH_BYTES / max(1, batch.column(name).nbytes)))
    for a in range(0, len(batch), rows):
        yield batch.slice(a, rows)


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Replace ``text_col`` by its token ids, array<int>; other columns stay.

    ``pattern`` splits the text before merging, every match by itself; special
    tokens are ordinary text.
    """
    shipped = _ship(df.sparkSession, ranks_path)
    keep = [f for f in df.schema.fields if f.name not in (text_col, ids_col)]
    schema = T.StructType(keep + [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches):
        memory, find = _memory(shipped), regex.compile(pattern).findall
        for whole in batches:
            for batch in _slices(whole, text_col):
                packed = _packed(batch, text_col, memory, find)
                offs = np.zeros(len(packed) + 1, np.int64)
                np.cumsum([len(p) >> 2 for p in packed], out=offs[1:])
                ids = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))
                yield _replaced(batch, text_col, ids, ids_col)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for (null ids: no bytes)."""
    shipped = _ship(df.sparkSession, ranks_path)
    df = df.drop(bytes_col)
    schema = T.StructType(df.schema.fields + [T.StructField(bytes_col, T.BinaryType(), False)])

    def run(batches):
        token = _memory(shipped).token.__getitem__
        for whole in batches:
            for batch in _slices(whole, ids_col):
                out = [b"".join(map(token, ids or ())) for ids in batch.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays(batch.columns + [pa.array(out, pa.binary())], batch.schema.names + [bytes_col])

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Replace ids and decoded bytes by n_tokens, ids_sha256 and decoded_sha256."""
    keep = [f for f in df.schema.fields if f.name not in (ids_col, bytes_col, "n_tokens", "ids_sha256", "decoded_sha256")]
    schema = T.StructType(keep + [T.StructField("n_tokens", T.LongType(), False), T.StructField("ids_sha256", T.StringType(), False),
                                  T.StructField("decoded_sha256", T.StringType(), False)])

    def sha(data) -> str:
        return hashlib.sha256(data).hexdigest()

    class Decimals(dict):
        def __missing__(self, i):
            self[i] = s = str(i)
            return s

    def run(batches):
        names, decimal = [f.name for f in keep], Decimals().__getitem__
        for whole in batches:
            for batch in _slices(whole, ids_col):
                ids = batch.column(ids_col)
                counts = ids.value_lengths().fill_null(0).cast(pa.int64())
                text = [sha(",".join(map(decimal, x or ())).encode()) for x in ids.to_pylist()]
                data = [sha(x or b"") for x in batch.column(bytes_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [counts, pa.array(text), pa.array(data)],
                                                 schema=pa.schema([batch.schema.field(n) for n in names] + [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]))

    return df.mapInArrow(run, schema)


def token_digests(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``digests`` of ``decode`` of ``encode`` in one pass: ids and bytes stay in the task."""
    shipped = _ship(df.sparkSession, ranks_path)
    keep = [f for f in df.schema.fields if f.name not in (text_col, "n_tokens", "ids_sha256", "decoded_sha256")]
    schema = T.StructType(keep + [T.StructField("n_tokens", T.LongType(), False), T.StructField("ids_sha256", T.StringType(), False),
                                  T.StructField("decoded_sha256", T.StringType(), False)])

    def run(batches):
        memory, find = _memory(shipped), regex.compile(pattern).findall
        token, decimal = memory.token.__getitem__, {rank: str(rank) for rank in memory.token}.__getitem__
        for whole in batches:
            for batch in _slices(whole, text_col):
                counts, text, data = [], [], []
                for packed in _packed(batch, text_col, memory, find):
                    ids = np.frombuffer(packed, "<i4").tolist()
                    counts.append(len(ids))
                    text.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                    data.append(hashlib.sha256(b"".join(map(token, ids))).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in keep] + [pa.array(counts, pa.int64()), pa.array(text, pa.string()), pa.array(data, pa.string())], [f.name for f in schema])

    return df.mapInArrow(run, schema)


def op9_bpe_rank_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every document."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_digests(docs, path, public_tokenizers.PATTERN)
