"""Jaccard self-join of word n-gram sets by universe partition and pigeonhole.

A document's set holds its distinct n-word shingles. Sets fall into bands by size (each band
ends at 1/t of its start), and a set meets the sets of its own band and of the next one, so two
sets within the threshold t always meet in the larger one's band. In band k the universe of
shingles is hashed into m_k segments. Sets r and s with Jaccard >= t differ in at most
H = floor((1 - t) / (1 + t) * (|r| + |s|)) shingles, so of r's non-empty segments at most H can
differ from s's.

Allocation, by cost. The cost of a signature (a segment's number and the hash of the shingles in it)
is the length of its list, which the rarest of its shingles bounds: a first pass counts all
shingles of the corpus in a table of cells. A set publishes its H + 1 cheapest signatures. Both
sides rank by the signature alone, so two sets that agree on all but H signatures agree on one of
the published: of two sets' last published signatures the cheaper one's set has published nothing
that the other set would not have published too, were it there, so all H + 1 would differ. Signatures of
a passage that many documents share are dear, and are not published while a set has H + 1 of its own.
In bands that start at SMALL shingles or fewer, sets without H + 1 cheap signatures publish all
of theirs with the one-deletion neighbourhoods of segments of two or more shingles, which cover
two differences each; the cheap H + 1 of another set meet them as at most H can differ. A set whose
segments cannot cover H + 1 differences is reported, and its band is run again with more
segments, until none is left: no pair is ever missed.

Candidates. Keys are dealt to buckets of hashes, packed by chunk; equal sets within a chunk
publish once. Within a key's list every member is paired with the smallest id only. Of these
pairs each document has its smallest partner verified first, exactly, on the whole sets; then
those of the rest that join different components; then, for lists whose members still lie in
more than one component, the pairs between components. A group of thousands of near copies so
costs a star and not its square, and no pair of different components is left unverified.

Before texts meet, pairs are held against a bound: the universe is cut into parts, 1,024 or a
larger power of two that is at least twice the set's size, and a document keeps of each the
parity of its shingles there. Parts whose parities differ hold at least one shingle each in which
the sets differ, so a pair with more than H of them is no link. Parities of twice the parts fold
to those of half by exclusive or.

Edge cases: null and empty texts and texts of white space have no set, no links and themselves
as component; fewer than n words make one shingle of them all; rows that share an id are one
document as far as links go; a null id links with nothing and has a null component; empty tables
give no rows; other columns are never read.
"""

from __future__ import annotations

from math import ceil, floor

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected
from .postings import bucket_count, chunked, home_bucket, input_bytes, narrow, pack, unpack
from .scratch import discard, staged

#: Bands that start here or below have one-deletion neighbourhoods for sets without cheap signatures.
SMALL = 16
#: Buckets of keys at least: a pair comes from every bucket that holds one of its keys, so with few buckets its repeats would grow with their number.
BUCKETS = 64
#: Cells of the table of shingle counts: a cell for so many bytes of text, within these powers of two; codes to an octave.
CELL_BYTES, CELL_BITS, OCTAVE = 128, (12, 25), 8
#: A signature is dear if its list may be longer than this and than this many times a cell's mean.
DEAR, DEAR_MEANS = 64, 4
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Odd factors of the words of a shingle by place.
_PLACES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """64-bit hashes of words; starts anew when it holds many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = Words()


def windows(text: str | None, n: int = 5) -> np.ndarray:
    """64-bit hashes of the n-word shingles of a text, A-Z lower-cased, as they stand."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    k = min(n, len(words))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out += h[i : len(h) - k + 1 + i] * _PLACES[i % len(_PLACES)]
        if i % len(_PLACES) == len(_PLACES) - 1:
            out = mix(out)
    return mix(out)


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    return np.unique(windows(text, n))


class Costs:
    """Codes of the counts of shingles by cell, and the code from which a signature is dear."""

    def __init__(self, codes: np.ndarray, dear: int):
        self.codes, self.dear = codes, dear
        self.shift = np.uint64(65 - len(codes).bit_length())

    def of(self, s: np.ndarray) -> np.ndarray:
        return self.codes[(s >> self.shift).astype(np.int64)]


FREE = Costs(np.zeros(1, np.uint8), 255)
_BLOCK = 1 << 16


def shingle_costs(docs: DataFrame, n: int, n_bytes: int) -> Costs:
    """Counts of all shingles of docs (id, text) by cell: summed in tasks, by groups of tasks, and in all."""
    bits = min(max((n_bytes // CELL_BYTES).bit_length(), CELL_BITS[0]), CELL_BITS[1])
    cells, group = 1 << bits, max(1, ceil(docs.rdd.getNumPartitions() ** 0.5))
    shift = np.uint64(64 - bits)

    def count(batches):
        total, task = np.zeros(cells, np.uint32), TaskContext.get().partitionId()
        for batch in batches:
            for i in range(0, len(batch), 256):
                held = np.sort(np.concatenate([windows(t, n) for t in batch.column(1).slice(i, 256).to_pylist()]) >> shift)
                first = np.flatnonzero(np.diff(held, prepend=~held[:1]))
                total[held[first].astype(np.int64)] += np.diff(first, append=len(held)).astype(np.uint32)
        blocks = [total[i : i + _BLOCK] for i in range(0, cells, _BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(blocks), task % group, np.int32)), pa.array(np.arange(len(blocks), dtype=np.int32)), pa.array([pack(narrow(b)) for b in blocks], pa.binary())], ["part", "block", "counts"])

    def added(t: pa.Table) -> pa.Table:
        total = sum(unpack(x)[0].astype(np.int64) for x in t["counts"].to_pylist())
        return pa.table({"part": t["part"][:1], "block": t["block"][:1], "counts": pa.array([pack(narrow(total))], pa.binary())})

    out = "part int, block int, counts binary"
    sums = docs.select("id", "text").mapInArrow(count, out).groupBy("part", "block").applyInArrow(added, out).groupBy("block").applyInArrow(added, out)
    codes, total = np.zeros(cells, np.uint8), 0
    for r in sums.collect():  # at most 2 ** CELL_BITS cells, packed
        counts = unpack(r["counts"])[0].astype(np.int64)
        total += int(counts.sum())
        codes[r["block"] * _BLOCK : r["block"] * _BLOCK + len(counts)] = cost_code(counts)
    return Costs(codes, int(cost_code(np.array([max(DEAR, DEAR_MEANS * total / cells)]))[0]))


def cost_code(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(np.maximum(n, 1)) * OCTAVE), 254).astype(np.uint8)


class Bands:
    """Sizes of the bands, their segments, and what a set has to cover."""

    def __init__(self, t: float, widen: dict[int, int]):
        self.t, self.widen, self.starts = t, widen, [1]
        while self.starts[-1] < 1 << 40:
            self.starts.append(max(self.starts[-1] + 1, ceil(self.starts[-1] / t)))
        self.starts = np.array(self.starts)

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.starts, size, side="right")) - 1

    def segments(self, k: int) -> int:
        return (int(self.starts[k + 1] - 1) + 24) * self.widen.get(k, 1)

    def budget(self, size: int, k: int) -> int:
        """H + 1 for a set of this size against the sets it can be within t of and whose larger lies in band k."""
        largest = min(int(self.starts[k + 1]) - 1, floor(size / self.t + 1e-9))
        return floor((1 - self.t) / (1 + self.t) * (size + max(size, largest)) + 1e-9) + 1

    def met(self, size: int) -> list[int]:
        k, top = self.band(size), self.band(floor(size / self.t + 1e-9))
        return list(range(k, top + 1))


def signatures(s: np.ndarray, bands: Bands, costs: Costs = FREE) -> tuple[list[np.ndarray], list[int]]:
    """Keys that a set publishes, and the bands in which they cannot cover its budget."""
    out, short, cost, high, hashed = [], [], costs.of(s), s >> np.uint64(32), mix(s)
    for k in bands.met(len(s)):
        m, need = bands.segments(k), bands.budget(len(s), k)
        seg = (high * np.uint64(m)) >> np.uint64(32)  # segments are ranges of hashes, so they rise with the set
        first = np.flatnonzero(np.diff(seg, prepend=~seg[:1]))
        size = np.diff(first, append=len(s))
        sums, tag = np.add.reduceat(hashed, first), mix(seg[first] * np.uint64(1 << 12) + np.uint64(k))
        keys, dear = mix(sums ^ tag) >> np.uint64(10), np.minimum.reduceat(cost, first)
        if bands.starts[k] <= SMALL and (dear < costs.dear).sum() < need:
            owner = np.repeat(np.arange(len(first)), size)
            less = size[owner] > 1
            keys = np.concatenate([keys, mix((sums[owner] - hashed)[less] ^ tag[owner][less]) >> np.uint64(10)])
            if np.minimum(size, 2).sum() < need:
                short.append(k)
        elif len(keys) < need:
            short.append(k)
        else:
            # of equal costs those of most shingles first, beyond three they count alike; then by the key
            ranked = (dear.astype(np.uint64) << np.uint64(56)) | ((3 - np.minimum(size, 3)).astype(np.uint64) << np.uint64(54)) | keys
            keys = np.partition(ranked, need - 1)[:need] & np.uint64((1 << 54) - 1)
        out.append(mix(keys))
    return out, short


#: 64-bit words of the smallest parity sketch.
SKETCH = 16


def parities(s: np.ndarray) -> np.ndarray:
    """Parity sketch of a set: of 64 * SKETCH parts, and behind it of more parts if the set is larger than half that."""
    m = small = 64 * SKETCH
    while m < 2 * len(s):
        m *= 2
    odd = np.bincount((mix(s) >> np.uint64(40)).astype(np.int64) % m, minlength=m) & 1
    words = lambda x: np.packbits(x.astype(np.uint8), bitorder="little").view(np.int64)
    first = words(odd.reshape(-1, small).sum(axis=0) & 1)
    return first if m == small else np.concatenate([first, words(odd)])


FOUND = "kind string, a long, b long, members binary, sketch array<bigint>"
_FOUND = pa.schema([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("members", pa.binary()), ("sketch", pa.list_(pa.int64()))])


def _rows(kind: str, a, b=None, members=None, sketch=None) -> pa.RecordBatch:
    n = len(a)
    column = lambda x, t: pa.nulls(n, t) if x is None else pa.array(x, t)
    lists = None if sketch is None else pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sketch[0])]).astype(np.int32), sketch[1])
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.string()), pa.array(a, pa.int64()), column(b, pa.int64()), column(members, pa.binary()), pa.nulls(n, _FOUND.field("sketch").type) if lists is None else lists], schema=_FOUND)


def _publish(bands: Bands, costs: Costs, n: int, buckets: int):
    """Chunks to (bucket, blob): keys with members, and what the chunk knows of its documents."""

    def run(batches):
        for chunk, held in chunked(batches):
            ids, sizes, sketches, keys, owners, short = [], [], [], [], [], set()
            first: dict[bytes, int] = {}
            copies: list[tuple[int, int]] = []
            for batch in held:
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    s = shingles(text, n)
                    ids.append(i)
                    sizes.append(len(s))
                    sketches.append(parities(s))
                    if i is None or not len(s):
                        continue
                    if (leader := first.setdefault(xxhash.xxh3_128_digest(s.tobytes()), i)) != i:
                        copies.append((leader, i))
                        continue
                    mine, lacking = signatures(s, bands, costs)
                    short.update(lacking)
                    keys += mine
                    owners.append(np.full(sum(map(len, mine)), i, np.int64))
            key = np.concatenate([np.zeros(0, np.uint64), *keys])
            owner = np.concatenate([np.zeros(0, np.int64), *owners])
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out = [(home_bucket(chunk, buckets), b"B" + pack(np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids], np.uint8), np.array(sizes, np.int64), np.array([len(x) for x in sketches], np.int64), np.concatenate([np.zeros(0, np.int64), *sketches]), np.array(copies, np.int64).reshape(-1), np.array(sorted(short), np.int64)))]
            for b in np.flatnonzero(np.diff(cuts)):
                mine = order[cuts[b] : cuts[b + 1]]
                who, local = np.unique(owner[mine], return_inverse=True)
                k = key[mine] >> np.uint64(16)
                out.append((int(b), b"K" + pack((k & np.uint64(0xFFFFFFFF)).astype(np.uint32), (k >> np.uint64(32)).astype(np.uint16), narrow(local), who)))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["bucket", "blob"])

    return run


def _lists(t: pa.Table) -> pa.Table:
    """A bucket's candidate pairs (smallest member first), its lists of three and more, and the chunks' own rows."""
    out, keys, nodes = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for blob in t["blob"].to_pylist():
        if blob[:1] == b"B":
            ids, absent, sizes, lengths, words, copies, short = unpack(blob[1:])
            out.append(_rows("doc", pa.array(ids, mask=absent.astype(bool)), sizes, sketch=(lengths, words)))
            out += [_rows("copy", copies[::2], copies[1::2]), _rows("short", short)]
        else:
            low, high, local, who = unpack(blob[1:])
            keys.append(high.astype(np.uint64) << np.uint64(32) | low)
            nodes.append(who[local])
    key, node = np.concatenate(keys), np.concatenate(nodes)
    order = np.argsort(key, kind="stable")
    key, node = key[order], node[order]
    again = np.concatenate([[False], key[1:] == key[:-1]]) if len(key) else np.zeros(0, bool)
    shared = again | np.concatenate([again[1:], [False]]) if len(key) else again
    run = np.cumsum(~again)[shared]
    names, at = np.unique(node[shared], return_inverse=True)
    code = np.unique(run * max(len(names), 1) + at)
    run, at = code // max(len(names), 1), code % max(len(names), 1)
    first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, int)
    size = np.diff(np.concatenate([first, [len(run)]]))
    lead = np.repeat(at[first], size)
    pair = np.unique((lead * max(len(names), 1) + at)[lead != at])
    out.append(_rows("pair", names[pair // max(len(names), 1)], names[pair % max(len(names), 1)]))
    distinct = {at[i : i + n].tobytes() for i, n in zip(first[size > 2], size[size > 2], strict=True)}
    lists = [names[np.frombuffer(x, at.dtype)].tobytes() for x in sorted(distinct)]
    out.append(_rows("list", np.zeros(len(lists), np.int64), members=lists))
    return pa.Table.from_batches(out, _FOUND)


def _linked(t: float, n: int):
    """Keeps the rows (a, b, text_a, text_b) whose sets are within t."""

    def run(batches):
        held: tuple[tuple[int, str] | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            keep = []
            for a, text_a, text_b in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True):
                if held[0] != (a, text_a):  # rows that share an id may differ in their texts
                    held = ((a, text_a), shingles(text_a, n))
                s = shingles(text_b, n)
                both = len(np.intersect1d(held[1], s, assume_unique=True))
                # t as a fraction of 10,000, so that the comparison is of integers
                keep.append(10_000 * both >= round(10_000 * t) * (len(held[1]) + len(s) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def within_budget(differ: Column, t: float) -> Column:
    """Whether sets of na and nb shingles that differ in at least `differ` can be within t."""
    whole = round(10_000 * t)
    return differ * (10_000 + whole) <= (F.col("na") + F.col("nb")) * (10_000 - whole)


def possible(pairs: DataFrame, t: float) -> DataFrame:
    """Of rows (a, b, na, nb, first sketch words a0.. and b0..) the distinct (a, b) that sizes and first words allow."""
    differ = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(SKETCH)), F.lit(0))
    size = F.least("na", "nb") * 10_000 >= F.greatest("na", "nb") * round(10_000 * t)
    return pairs.filter(size & within_budget(differ, t)).select("a", "b").distinct()


def sketched(sketches: DataFrame, side: str, *more) -> DataFrame:
    """(id, n, first words) with a side's column names, after more columns."""
    return sketches.select(*more, F.col("id").alias(side), F.col("n").alias(f"n{side}"), *[F.element_at("sketch", i + 1).alias(f"{side}{i}") for i in range(SKETCH)])


def bounded(pairs: DataFrame, sketches: DataFrame, t: float) -> DataFrame:
    """The pairs (a, b) that sizes and whole sketches allow."""
    full = F.when(F.size("sketch") > SKETCH, F.slice("sketch", F.lit(SKETCH + 1), F.size("sketch"))).otherwise(F.col("sketch"))
    side = lambda c: sketches.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), full.alias(f"s{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    size = F.least("na", "nb") * 10_000 >= F.greatest("na", "nb") * round(10_000 * t)
    n = F.least(F.size("sa"), F.size("sb"))
    xor = lambda x, y: x.bitwiseXOR(y)
    # sizes within t of each other: one sketch is at most twice the other
    fold = lambda s: F.when(F.size(s) > n, F.zip_with(F.slice(s, F.lit(1), n), F.slice(s, n + 1, n), xor)).otherwise(F.col(s))
    differ = F.aggregate(F.zip_with(fold("sa"), fold("sb"), xor), F.lit(0), lambda total, x: total + F.bit_count(x))
    # not distinct: rows that share an id repeat a pair, and an aggregate here would keep Spark from splitting a hot a
    return both.filter(size).filter(within_budget(differ, t)).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, t: float, n: int) -> DataFrame:
    """The pairs (a, b) of ids whose texts' sets are within t."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return staged(rows.mapInArrow(_linked(t, n), "a long, b long"), "links")


def jaccard_components(docs: DataFrame, t: float = 0.75, n: int = 5, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    n_bytes, widen = input_bytes(rows), {}
    buckets = buckets or max(BUCKETS, bucket_count(rows, n_bytes=n_bytes))
    costs = shingle_costs(rows, n, n_bytes)
    while True:
        sent = rows.mapInArrow(_publish(Bands(t, widen), costs, n, buckets), "bucket int, blob binary")
        found = staged(sent.groupBy("bucket").applyInArrow(_lists, FOUND), "candidates", by="kind")
        short = [r[0] for r in found.filter("kind = 'short'").select("a").distinct().collect()]  # bands: a few dozen at most
        if not short:
            break
        widen |= {k: 4 * widen.get(k, 1) for k in short}
    kind = lambda k: found.filter(F.col("kind") == k)
    sketches = kind("doc").select(F.col("a").alias("id"), F.col("b").alias("n"), "sketch")
    lists = staged(kind("list").select("members").distinct().withColumn("list", F.xxhash64("members")).mapInArrow(_members, "list long, id long"), "lists")
    pairs = staged(bounded(kind("pair").select("a", "b").distinct(), sketches, t), "pairs")
    nodes = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(lists.select("id")).distinct()
    texts = staged(rows.join(nodes, "id", "left_semi"), "candidate-texts")
    best = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    within = linked(kind("copy").select("a", "b").unionByName(verified(best, texts, t, n)))
    within = linked(verified(across(pairs.join(best, ["a", "b"], "left_anti"), within), texts, t, n), within)
    homes = lists.join(within.select(F.col("node").alias("id"), "component"), "id", "left").select("list", "id", F.coalesce("component", "id").alias("home"))
    split = homes.groupBy("list").agg(F.min("home").alias("lo"), F.max("home").alias("hi")).filter("lo <> hi").select("list")
    homes = staged(homes.join(split, "list", "left_semi").join(sketches, "id"), "open-lists")
    x, y = (sketched(homes, i, "list", F.col("home").alias(f"home_{i}")) for i in "ab")
    rest = possible(x.join(y, "list").filter("a < b AND home_a <> home_b"), t).join(pairs, ["a", "b"], "left_anti")
    rest = staged(bounded(rest, sketches, t), "open-pairs")
    more = verified(rest, texts, t, n)
    within = linked(more, within)
    within = staged(within, "components")
    discard(lists, pairs, texts, homes, rest)
    out = kind("doc").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"))
    return out.join(within.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def linked(edges: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """(node, component) by edges (a, b), going on from the components within."""
    edges = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if within is None:
        return connected(edges)
    if edges.isEmpty():
        return within
    return connected(edges.unionByName(within.select(F.col("node").alias("u"), F.col("component").alias("v"))))


def across(pairs: DataFrame, within: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components."""
    home = lambda c: within.select(F.col("node").alias(c), F.col("component").alias(f"home_{c}"))
    both = pairs.join(home("a"), "a", "left").join(home("b"), "b", "left")
    return both.filter(F.coalesce("home_a", "a") != F.coalesce("home_b", "b")).select("a", "b")


def _members(batches):
    for batch in batches:
        parts = [np.frombuffer(x, np.int64) for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column(1), np.int64), [len(p) for p in parts])), pa.array(np.concatenate([np.zeros(0, np.int64), *parts]))], ["list", "id"])


def one_of_each(docs: DataFrame, **kw) -> DataFrame:
    """docs without the rows whose component has a smaller id; rows without an id stay."""
    comps = jaccard_components(docs, **kw)
    dropped = comps.filter("component_id < doc_id").select(F.col("doc_id").alias("dropped")).distinct()
    return docs.join(dropped, docs["doc_id"].cast("long") == dropped["dropped"], "left_anti")
