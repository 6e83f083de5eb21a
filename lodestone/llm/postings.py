"""Chunks of documents, and the two hops that per-document sums over distinct items take.

Work that needs every distinct item of the corpus once (a pre-token, an n-gram) and a sum for
every document goes from chunks of documents to buckets of items and back:

    chunk --(items of the bucket, postings)--> bucket --(sums by document)--> chunk

A chunk is a run of consecutive rows of one input partition. Its key is (partition, counter), so
a task that is run again sends the same rows. A chunk sends each item once with all its postings
packed, which is the map-side combine; a bucket sees an item once per chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a chunk.
CHUNK = 16 << 20
ROUTED = "bucket int, chunk long, blob binary"


def input_bytes(docs: DataFrame, text_col: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0


def bucket_count(docs: DataFrame, text_col: str = "text", size: int = 32 << 20, n_bytes: int | None = None) -> int:
    """Buckets that get about `size` bytes of text each, at least the session's shuffle partitions."""
    n_bytes = input_bytes(docs, text_col) if n_bytes is None else n_bytes
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // size))


def chunked(batches: Iterable[pa.RecordBatch], size: int = CHUNK) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """(chunk key, batches) with the text in column 1; long batches are sliced."""
    part, n, held, held_bytes = TaskContext.get().partitionId(), 0, [], 0
    for batch in batches:
        text = batch.column(1)
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(text), 0), np.int64)) if len(batch) else np.zeros(0, np.int64)
        at = 0
        while at < len(batch):
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + size - held_bytes, side="right")))
            held.append(batch.slice(at, stop - at))
            held_bytes += int(ends[stop - 1] - base)
            at = stop
            if held_bytes >= size or at < len(batch):
                yield (part << 32) | n, held
                n, held, held_bytes = n + 1, [], 0
    if held:
        yield (part << 32) | n, held


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays and byte strings as one compressed blob."""
    head, body = [len(arrays)], []
    for a in arrays:
        raw = a if isinstance(a, bytes) else a.astype(a.dtype, copy=False).tobytes()
        kind = -1 if isinstance(a, bytes) else {"int8": 0, "uint8": 1, "uint16": 2, "int32": 3, "int64": 4, "uint64": 5, "float64": 6, "uint32": 7}[a.dtype.name]
        head += [kind, len(raw)]
        body.append(raw)
    return zstandard.ZstdCompressor(level=1).compress(np.array(head, np.int64).tobytes() + b"".join(body))


_KINDS = [np.int8, np.uint8, np.uint16, np.int32, np.int64, np.uint64, np.float64, np.uint32]


def unpack(blob: bytes) -> list:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 2 * n, 8).tolist(), 8 + 16 * n, []
    for kind, size in zip(head[::2], head[1::2], strict=True):
        out.append(raw[at : at + size] if kind < 0 else np.frombuffer(raw, _KINDS[kind], size // np.dtype(_KINDS[kind]).itemsize, at))
        at += size
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """a in the smallest unsigned type that holds it."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 1 << 32 else np.uint64)


def home_bucket(chunk: int, buckets: int) -> int:
    """The bucket of a chunk's own row: a hash of partition and counter, as chunk % buckets drops the partition where buckets is a power of two."""
    h = (chunk ^ chunk >> 30) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    h = (h ^ h >> 27) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return (h ^ h >> 31) % buckets


def two_hops(docs: DataFrame, buckets: int, encode: Callable, solve: Callable, merge: Callable, schema: str, chunk_bytes: int = CHUNK) -> DataFrame:
    """docs (id, text) through encode, solve and merge.

    encode(batches, buckets) -> (base blob, {bucket: blob}); the base blob holds what the chunk
    knows without any bucket. solve([blobs]) -> [blob or None] runs once a bucket. merge(base,
    [blobs]) -> pa.Table of the chunk's rows.
    """

    def send(batches):
        for key, held in chunked(batches, chunk_bytes):
            base, parts = encode(held, buckets)
            rows = [(home_bucket(key, buckets), key, b"B" + base), *((b, key, b"P" + x) for b, x in sorted(parts.items()))]
            yield pa.RecordBatch.from_pylist([{"bucket": b, "chunk": c, "blob": x} for b, c, x in rows], pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("blob", pa.binary())]))

    def at_bucket(t: pa.Table) -> pa.Table:
        chunk, blob = t["chunk"].to_pylist(), t["blob"].to_pylist()
        out = [(c, x) for c, x in zip(chunk, blob, strict=True) if x[:1] == b"B"]
        asked = [(c, x[1:]) for c, x in zip(chunk, blob, strict=True) if x[:1] == b"P"]
        del t, blob
        out += [(c, b"P" + x) for (c, _), x in zip(asked, solve([x for _, x in asked]), strict=True) if x is not None]
        return pa.table({"chunk": pa.array([c for c, _ in out], pa.int64()), "blob": pa.array([x for _, x in out], pa.binary())})

    def at_chunk(t: pa.Table) -> pa.Table:
        blob = t["blob"].to_pylist()
        return merge(next(x[1:] for x in blob if x[:1] == b"B"), [x[1:] for x in blob if x[:1] == b"P"])

    sent = docs.mapInArrow(send, ROUTED)
    return sent.groupBy("bucket").applyInArrow(at_bucket, "chunk long, blob binary").groupBy("chunk").applyInArrow(at_chunk, schema)
