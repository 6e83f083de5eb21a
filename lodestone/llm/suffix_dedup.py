"""Removal of repeated byte strings by merging Burrows-Wheeler transforms.

Every `length`-byte string of a document that also starts in a document with a smaller id is
covered; covered bytes go. The corpus is cut so that equal strings meet: a string belongs to the
anchor (the k-byte substring of least hash, leftmost of equals) inside it, and the run of strings
of a document with one anchor is a fragment of at most 2 * length - k bytes. Fragments go to the
bucket of their anchor's hash.

First only anchors are asked for, as 32-bit fingerprints within their bucket: an anchor that stands
in one document has nothing to share, and most do. Documents then send the fragments of the
anchors that several have. An anchor that stands in more than HOT different fragments, such as a
frequent phrase in different surroundings, is split: its strings belong to it and to the k-byte
substring of next least hash together, so that its fragments are dealt over all buckets.

A bucket drops what a fingerprint let through, and keeps one of equal fragments with the smallest
id that has it. Fragments whose anchor has no other fragment are settled by that. The
others are dealt into shards; each shard's suffixes are sorted once and give its transform, and
the transforms are merged by refining their interleave: round h reads the transforms in the
order of round h - 1 and deals their symbols stably, which sorts by the first h symbols. Where a
border between rows first shows is their common prefix; after `length` rounds the rows between
borders are the intervals of suffixes that repeat, and the smallest id of an interval is what its
members are held against. No suffix is compared again.

A chunk of documents settles what it can itself: of equal fragments in a chunk only those of the
smallest id travel, so a passage that a third of the documents share sends one fragment a chunk.

Edge cases: null counts as empty; documents shorter than `length` keep everything; a null id
counts as larger than every id; documents that share an id do not cover each other, and are told
apart by their text; an empty table gives no rows; very long texts are cut like any other, a run of
RUN bytes at a time; other columns are never read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import postings
from .postings import narrow, pack, unpack

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
LAST_ID = (1 << 63) - 1
K = 24
#: Forms of an anchor's fragments beyond which it is split by a second one, and the bits that tell forms apart.
HOT, FORM_BITS = 128, 8
#: Bytes that are cut at once, and symbols that are merged at once.
RUN, MERGE = 1 << 20, 1 << 22
CHUNK = 8 << 20
SHARDS = 4
_POS = np.uint64((1 << 28) - 1)
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mix(h: np.ndarray, m: np.uint64) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * m
    return h ^ (h >> np.uint64(29))


def _hashes(word: np.ndarray, m: int) -> np.ndarray:
    """Hashes of the k-byte substrings at the first m places of the last axis; word: the eight bytes at each place."""
    return _mix(word[..., :m] * _M[0] ^ _mix(word[..., 8 : 8 + m], _M[1]) ^ word[..., K - 8 : K - 8 + m] * _M[2], _M[3])


def fragments(flat: np.ndarray, doc: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first start, starts) of the fragments of documents laid end to end.

    doc numbers the bytes, ends are the documents' ends in flat.
    """
    n, w = len(flat), length - K + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return np.zeros(0, np.uint64), none, none
    m = n - K + 1
    h = _hashes(np.ndarray((n - 7,), "<u8", np.ascontiguousarray(flat), 0, (1,)), m)
    low, span = (h & ~_POS) | np.arange(m, dtype=np.uint64), 1
    while 2 * span <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < w:
        low = np.minimum(low[: m - w + 1], low[w - span : w - span + m - w + 1])
    at = (low & _POS).astype(np.int64)
    starts = np.arange(len(at))
    ok = starts + length <= ends[doc[: len(at)]]
    at, starts = at[ok], starts[ok]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]) if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return h[at[first]], starts[first], np.diff(np.concatenate([first, [len(at)]]))


def split(flat: np.ndarray, length: int, anchor: np.ndarray, start: np.ndarray, n_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first start, starts, number of the fragment) of fragments cut by their strings' second anchors."""
    w, width = length - K + 1, 2 * length - K
    rows = np.concatenate([flat, np.zeros(width, np.uint8)])[start[:, None] + np.arange(width)]
    m = width - K + 1
    h = _hashes(np.ndarray((len(rows), width - 7), "<u8", rows, 0, (width, 1)), m)
    low, span = (h & ~_POS) | np.arange(m, dtype=np.uint64), 1
    next_ = np.full(low.shape, ~np.uint64(0))

    def least(i: slice, j: slice) -> tuple[np.ndarray, np.ndarray]:
        a, b = low[:, i], low[:, j]
        more = np.minimum(next_[:, i], next_[:, j])
        return np.minimum(a, b), np.where(a == b, more, np.minimum(np.maximum(a, b), more))  # a place may be in both spans

    while 2 * span <= w:
        low, next_ = least(slice(None, -span), slice(span, None))
        span *= 2
    if span < w:
        low, next_ = least(slice(0, m - w + 1), slice(w - span, w - span + m - w + 1))
    of = np.repeat(np.arange(len(start)), n_starts)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(n_starts) - n_starts, n_starts)
    at = (next_[of, inside] & _POS).astype(np.int64)
    first = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(at, prepend=-1) != 0))
    of = of[first]
    return _mix(anchor[of] * _M[2] ^ h[of, at[first]], _M[0]), start[of] + inside[first], np.diff(first, append=len(at)), of


def rows_of(flat: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """The strings as rows of a matrix, zero beyond their size."""
    out = np.zeros((len(start), width), np.uint8)
    padded = np.concatenate([flat, np.zeros(width, np.uint8)])
    for i in range(0, len(start), 1 << 16):
        s = slice(i, i + (1 << 16))
        out[s] = padded[start[s, None] + np.arange(width)]
        out[s][np.arange(width) >= size[s, None]] = 0
    return out


def fingerprints(rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each row and its size."""
    words = rows.view("<u8")
    a, b = size.astype(np.uint64), size.astype(np.uint64) + _M[1]
    for i in range(words.shape[1]):
        a, b = _mix(a ^ words[:, i], _M[0]) + _M[2], _mix(b + words[:, i] * _M[3], _M[1])
    return a, b


def classes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of equal (a, b)."""
    order = np.lexsort((b, a))
    new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]) if len(a) else np.zeros(0, bool)
    out = np.empty(len(a), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def shard_transform(symbols: np.ndarray, size: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, symbol before) of a shard's suffixes, sorted by depth symbols and more.

    symbols: a row a string, bytes + 1 (UTF-8 has no byte above 0xF4), zeros from its end on; the
    end mark is the suffix at size.
    """
    m, width = symbols.shape
    string = np.repeat(np.arange(m), size + 1)
    offset = np.arange(len(string)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
    # places by the first 8 symbols, then by twice as many each time, as a suffix's place and that of the one behind those symbols
    wide = np.zeros((m, width + 8), np.uint8)
    wide[:, :width] = symbols
    key = np.ndarray((m, width + 1), ">u8", wide, 0, (wide.shape[1], 1))[string, offset].astype(np.uint64)
    first, left, known = np.cumsum(size + 1) - size - 1, np.repeat(size, size + 1) - offset, 8
    while True:
        order = np.argsort(key)
        border = np.diff(key[order], prepend=~key[order][:1]) != 0
        if known > depth or border.all():
            break
        place = np.empty(len(key), np.int64)
        place[order] = np.cumsum(border)
        step = min(known, depth + 1 - known)
        behind = np.where(left >= step, place[first[string] + np.minimum(offset + step, size[string])], 0)
        key, known = (place.astype(np.uint64) << np.uint64(32)) | behind.astype(np.uint64), known + step
    string, offset = string[order], offset[order]
    return string, offset, np.where(offset > 0, symbols[string, offset - 1], 0).astype(np.uint8)


def merge_transforms(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of transforms sorted by their suffixes' first depth symbols.

    Returns for every row of the merged order the row of the transforms laid end to end, and the
    common prefix with the row before, depth if it is that or more.
    """
    flat = np.concatenate(transforms)
    source = np.repeat(np.arange(len(transforms), dtype=np.uint8), [len(t) for t in transforms])
    block, prefix = np.zeros(len(flat), np.int32), np.full(len(flat), depth, np.int16)
    symbol, line = np.empty(len(flat), flat.dtype), np.arange(len(flat))
    for h in range(depth):
        symbol[np.argsort(source, kind="stable")] = flat
        deal = np.argsort(symbol, kind="stable")
        source, dealt, old = source[deal], symbol[deal], block[deal]
        border = np.concatenate([[True], (dealt[1:] != dealt[:-1]) | (old[1:] != old[:-1])])
        prefix[border & (prefix == depth)] = h
        block = np.cumsum(border, dtype=np.int32)
    line[np.argsort(source, kind="stable")] = np.arange(len(flat))
    return line, prefix


def smallest_ids(rows: np.ndarray, size: np.ndarray, ids: np.ndarray, length: int, shards: int = SHARDS) -> np.ndarray:
    """For each string and offset the smallest id of a string that holds the same length bytes."""
    out = np.full((len(rows), rows.shape[1] - length + 1), LAST_ID)
    if not len(rows):
        return out
    symbols, parts, at = rows + np.uint8(1), [], 0
    symbols[np.arange(rows.shape[1]) >= size[:, None]] = 0
    for part in np.array_split(np.arange(len(rows)), min(shards, len(rows))):
        string, offset, before = shard_transform(symbols[part], size[part], length)
        parts.append((string + at, offset, before))
        at += len(part)
    line, prefix = merge_transforms([p[2] for p in parts], length)
    string, offset = (np.concatenate([p[i] for p in parts])[line] for i in (0, 1))
    borders = np.flatnonzero(prefix < length)
    least = np.repeat(np.minimum.reduceat(ids[string], borders), np.diff(np.concatenate([borders, [len(line)]])))
    whole = offset + length <= size[string]
    out[string[whole], offset[whole]] = least[whole]
    return out


def _masks(hit: np.ndarray) -> np.ndarray:
    """Rows of booleans as bits, the first column lowest."""
    return (hit.astype(np.uint64) << np.arange(hit.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def _cuts(texts: list[bytes], length: int):
    """(bytes, anchors, starts, sizes, documents, shifts from starts to positions) of runs of about RUN bytes of texts.

    A text of more than RUN bytes is taken in pieces that overlap by length - 1, so each of its strings is in one.
    """
    run, n = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), RUN):
            piece = t[at : at + RUN + length - 1] if len(t) > RUN else t
            if run and n + len(piece) > RUN:
                yield _run(run, length)
                run, n = [], 0
            run.append((i, at, piece))
            n += len(piece)
    if run:
        yield _run(run, length)


def _run(pieces: list[tuple[int, int, bytes]], length: int):
    sizes = np.array([len(p) for _, _, p in pieces], np.int64)
    flat, ends = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8), np.cumsum(sizes)
    doc = np.repeat(np.arange(len(pieces)), sizes)
    anchor, start, n_starts = fragments(flat, doc, ends, length)
    d = doc[start] if len(start) else start
    return flat, anchor, start, n_starts + length - 1, np.array([i for i, _, _ in pieces], np.int64)[d], (np.array([at for _, at, _ in pieces], np.int64) - (ends - sizes))[d]


def _identity(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Ids (LAST_ID for null), which are null, prints and bytes of a chunk's documents (id, text, print)."""
    raw = [x for b in held for x in b.column(0).to_pylist()]
    texts = [(t or "").encode() for b in held for t in b.column(1).to_pylist()]
    prints = np.array([x for b in held for x in b.column(2).to_pylist()], np.int64)
    return np.array([LAST_ID if x is None else x for x in raw], np.int64), np.array([x is None for x in raw], np.uint8), prints, texts


def _short(anchor: np.ndarray) -> np.ndarray:
    """32 bits of anchors that their bucket (the rest modulo the buckets) does not tell."""
    return (anchor >> np.uint64(32)).astype(np.uint32)


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each x is in known, which is sorted."""
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


def _ask(length: int):
    def encode(held: list[pa.RecordBatch], buckets: int) -> tuple[bytes, dict[int, bytes]]:
        ids, absent, prints, texts = _identity(held)
        anchor, doc, form = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for flat, a, start, size, d, _ in _cuts(texts, length):
            word = np.ndarray((max(len(flat) - 7, 0),), "<u8", np.ascontiguousarray(flat), 0, (1,))
            anchor.append(a)
            doc.append(d)
            # a few bits by which fragments of an anchor differ: of its first and last bytes
            form.append(_mix(word[start] * _M[0] ^ word[start + size - 8], _M[1]) >> np.uint64(64 - FORM_BITS) if len(start) else form[0])
        anchor, doc, form = (np.concatenate(x) for x in (anchor, doc, form))
        bucket = (anchor % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((form, _short(anchor), doc, bucket))
        bucket, doc, short, form = bucket[order], doc[order], _short(anchor)[order], form[order].astype(np.uint8)
        new = (np.diff(bucket, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0) | (np.diff(short, prepend=~short[:1]) != 0) | (np.diff(form, prepend=~form[:1]) != 0)
        bucket, doc, short, form = bucket[new], doc[new], short[new], form[new]
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        parts = {}
        for b in np.flatnonzero(np.diff(edges)):
            mine = slice(edges[b], edges[b + 1])
            parts[int(b)] = pack(narrow(doc[mine]), short[mine], form[mine])
        return pack(ids, absent, prints), parts

    return encode


def _repeated(blobs: list[bytes]) -> list[bytes | None]:
    """Of each chunk's (document, anchor) those whose anchor another document has, and whether it has more than HOT forms."""
    got = [unpack(x) for x in blobs]
    if not got:
        return []
    short, form = (np.concatenate([g[i] for g in got]) for i in (1, 2))
    first_here = np.concatenate([(np.diff(g[0].astype(np.int64), prepend=-1) != 0) | (np.diff(g[1], prepend=~g[1][:1]) != 0) for g in got])
    order = np.lexsort((form, short))
    by_anchor = np.flatnonzero(np.diff(short[order], prepend=~short[order][:1]))
    size = np.diff(by_anchor, append=len(short))
    new_form = (np.diff(short[order], prepend=~short[order][:1]) != 0) | (np.diff(form[order], prepend=form[order][:1]) != 0)
    times, forms = np.zeros(len(short), np.int64), np.zeros(len(short), np.int64)
    times[order] = np.repeat(np.add.reduceat(first_here[order].astype(np.int64), by_anchor), size)
    forms[order] = np.repeat(np.add.reduceat(new_form.astype(np.int64), by_anchor), size)
    cuts = np.cumsum([0, *(len(g[1]) for g in got)])
    keep, out = first_here & (times > 1), []
    for (doc, a, _), i, j in zip(got, cuts[:-1], cuts[1:], strict=True):
        k = keep[i:j]
        out.append(pack(narrow(doc[k]), a[k], (forms[i:j][k] > HOT).astype(np.uint8)) if k.any() else None)
    return out


def _by_document(base: bytes, parts: list[bytes]) -> pa.Table:
    """(doc_id, print, anchors) of the chunk's documents that share an anchor; an anchor is 1 << 32 higher if it is to be split."""
    ids, absent, prints = unpack(base)
    got = [unpack(x) for x in parts]
    doc = np.concatenate([np.zeros(0, np.int64), *(g[0].astype(np.int64) for g in got)])
    short = np.concatenate([np.zeros(0, np.uint64), *(g[1] | g[2].astype(np.uint64) << np.uint64(32) for g in got)])
    order = np.argsort(doc, kind="stable")
    who, cut = np.unique(doc[order], return_index=True)
    cut = [*cut.tolist(), len(doc)]
    anchors = [short[order[i:j]].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
    return pa.table({"doc_id": pa.array(ids[who], mask=absent[who].astype(bool)), "print": prints[who], "anchors": pa.array(anchors, pa.binary())})


def _encode(length: int):
    width = -(-(2 * length - K) // 8) * 8

    def encode(held: list[pa.RecordBatch], buckets: int) -> tuple[bytes, dict[int, bytes]]:
        ids, absent, prints, texts = _identity(held)
        shared = [np.frombuffer(x, np.uint64) for b in held for x in b.column(3).to_pylist()]
        low, top = np.uint64((1 << 32) - 1), np.uint64(1 << 32)
        known = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.uint64(i << 32) | (x & low) for i, x in enumerate(shared))]))
        hot = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.uint64(i << 32) | (x[x >= top] & low) for i, x in enumerate(shared))]))
        got = [(np.zeros(0, np.uint64), *[np.zeros(0, np.uint64)] * 2, np.zeros(0, np.uint8), *[np.zeros(0, np.int64)] * 2, np.zeros((0, width), np.uint8))]
        for flat, anchor, start, size, doc, shift in _cuts(texts, length):
            name = doc.astype(np.uint64) << np.uint64(32) | _short(anchor)
            keep, many = _among(name, known), _among(name, hot)
            if many.any():
                cut, at, n_starts, of = split(flat, length, anchor[many], start[many], size[many] - length + 1)
                keep &= ~many
                anchor, start, size = np.concatenate([anchor[keep], cut]), np.concatenate([start[keep], at]), np.concatenate([size[keep], n_starts + length - 1])
                doc, shift = (np.concatenate([x[keep], x[many][of]]) for x in (doc, shift))
            else:
                anchor, start, size, doc, shift = anchor[keep], start[keep], size[keep], doc[keep], shift[keep]
            rows = rows_of(flat, start, size, width)
            got.append((anchor, *fingerprints(rows, size), size.astype(np.uint8), doc, start + shift, rows))
        anchor, a, b, size, doc, pos = (np.concatenate([g[k] for g in got]) for k in range(6))
        same = classes(a, b)
        least = np.full(same.max() + 1 if len(same) else 0, LAST_ID)
        np.minimum.at(least, same, ids[doc])
        done = ids[doc] > least[same]
        full = (np.uint64(1) << (size[done].astype(np.uint64) - np.uint64(length - 1))) - np.uint64(1)
        base = pack(ids, absent, prints, narrow(doc[done]), narrow(pos[done]), full)
        go = np.flatnonzero(~done)
        bucket = (anchor[go] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        runs = np.cumsum([0, *(len(g[0]) for g in got)])
        parts = {}
        for x in np.flatnonzero(np.diff(cuts)):
            mine = go[order[cuts[x] : cuts[x + 1]]]
            which = np.searchsorted(runs, mine, side="right") - 1
            text = b"".join(got[r][6][mine[which == r] - runs[r]][np.arange(width) < size[mine[which == r], None]].tobytes() for r in np.unique(which))
            who, local = np.unique(doc[mine], return_inverse=True)
            parts[int(x)] = pack(anchor[mine], size[mine], narrow(local), ids[who], narrow(who), narrow(pos[mine]), text)
        return base, parts

    return encode


def _may_share(rows: np.ndarray, size: np.ndarray, anchor: np.ndarray, length: int) -> np.ndarray:
    """Which fragments can share a string with another one of their anchor.

    A shared string holds the anchor and length - k bytes around it, so half of them on one side: the
    fragments of an anchor that are alone in what stands that near on either side share nothing.
    """
    n, w, half = len(rows), length - K + 1, (length - K + 1) // 2
    if half < 8 or not n:
        return np.ones(n, bool)
    word = np.ndarray((n, rows.shape[1] - 7), "<u8", np.ascontiguousarray(rows), 0, (rows.shape[1], 1))
    at = ((_hashes(word, w) & ~_POS) | np.arange(w, dtype=np.uint64)).argmin(axis=1)
    i, out = np.arange(n), np.zeros(n, bool)
    for known, near, far in ((at >= half, at - half, at - 8), (size - at - K >= half, at + K, at + K + half - 8)):
        mine = i[known]
        key = _mix(word[mine, near[mine]] * _M[0] ^ _mix(word[mine, far[mine]] ^ anchor[mine], _M[1]), _M[3])
        order = np.argsort(key)
        equal = key[order][1:] == key[order][:-1]
        out[mine[order[1:][equal]]] = out[mine[order[:-1][equal]]] = True
    return out


def _solve(length: int):
    width = -(-(2 * length - K) // 8) * 8

    def solve(blobs: list[bytes]) -> list[bytes | None]:
        if not blobs:
            return []
        # first who has what: ids, anchors; then the texts of anchors that several documents have
        heads, texts = [], []
        for x in blobs:
            anchor, size, local, who_id, _, _, text = unpack(x)
            heads.append((anchor, size.astype(np.int64), who_id[local], np.arange(len(anchor))))
            texts.append(text)
        anchor, size, ids, nth = (np.concatenate([h[i] for h in heads]) for i in range(4))
        blob = np.repeat(np.arange(len(blobs)), [len(h[0]) for h in heads])
        order = np.argsort(anchor, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], anchor[order][1:] != anchor[order][:-1]]))
        group_size = np.diff(np.concatenate([first, [len(order)]]))
        shared = np.minimum.reduceat(ids[order], first) != np.maximum.reduceat(ids[order], first)
        keep = np.zeros(len(anchor), bool)
        keep[order] = np.repeat(shared, group_size)
        rows = []
        for i, (h, text) in enumerate(zip(heads, texts, strict=True)):
            start = np.cumsum(h[1]) - h[1]
            mine = keep[blob == i]
            rows.append(rows_of(np.frombuffer(text, np.uint8), start[mine], h[1][mine], width))
        del texts, heads
        rows, anchor, size, ids, blob, nth = np.concatenate(rows), anchor[keep], size[keep], ids[keep], blob[keep], nth[keep]
        same = classes(*fingerprints(rows, size))
        n = same.max() + 1 if len(same) else 0
        one, least = np.zeros(n, np.int64), np.full(n, LAST_ID)
        one[same] = np.arange(len(same))
        np.minimum.at(least, same, ids)
        low = np.repeat(least[:, None], width - length + 1, axis=1)  # a fragment alone under its anchor
        order = np.argsort(anchor[one], kind="stable")
        sorted_ = anchor[one][order]
        multi = np.concatenate([[False], sorted_[1:] == sorted_[:-1]]) if n else np.zeros(0, bool)
        multi |= np.concatenate([multi[1:], [False]]) if n else multi
        order = order[multi]
        order = order[_may_share(rows[one[order]], size[one[order]], anchor[one[order]], length)]
        at = 0
        while at < len(order):  # whole anchors, about MERGE symbols at once
            stop = min(len(order), at + MERGE // width)
            while stop < len(order) and anchor[one[order[stop]]] == anchor[one[order[stop - 1]]]:
                stop += 1
            part = order[at:stop]
            low[part] = smallest_ids(rows[one[part]], size[one[part]], least[part], length)
            at = stop
        out: list[bytes | None] = []
        for i, x in enumerate(blobs):
            mine = np.flatnonzero(blob == i)
            hit = (low[same[mine]] < ids[mine, None]) & (np.arange(low.shape[1]) <= size[mine, None] - length)
            mask = _masks(hit)
            mine, mask = mine[mask > 0], mask[mask > 0]
            _, _, local, _, who, pos, _ = unpack(x)
            out.append(pack(narrow(who[local][nth[mine]]), narrow(pos[nth[mine]]), mask) if len(mine) else None)
        return out

    return solve


def _merge(length: int):
    def merge(base: bytes, parts: list[bytes]) -> pa.Table:
        ids, absent, prints, *own = unpack(base)
        got = [own, *(unpack(x) for x in parts)]
        doc, pos = (np.concatenate([g[i].astype(np.int64) for g in got]) for i in (0, 1))
        mask = np.concatenate([g[2].astype(np.uint64) for g in got])
        bit = np.flatnonzero(np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").ravel())
        doc, start = doc[bit // 64], pos[bit // 64] + bit % 64
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + length)]) if len(doc) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(doc)]]) - 1
        spans = np.stack([start[first], start[last] + length], axis=1).astype(np.int64) if len(first) else np.zeros((0, 2), np.int64)
        who, cut = np.unique(doc[first], return_index=True) if len(first) else (np.zeros(0, int), np.zeros(0, int))
        cut = [*cut.tolist(), len(first)]
        return pa.table({"doc_id": pa.array(ids[who], mask=absent[who].astype(bool)), "print": prints[who], "spans": pa.array([spans[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})

    return merge


def repeated_spans(docs: DataFrame, length: int = 50, buckets: int | None = None) -> DataFrame:
    """(doc_id, print, spans) of the rows of docs (doc_id, text, print) that lose bytes; spans: pairs of int64 (from, to)."""
    if not K < length <= K + 60:
        raise ValueError(f"length must be from {K + 1} to {K + 60}")
    buckets = buckets or postings.bucket_count(docs, size=16 << 20)
    asked = postings.two_hops(docs, buckets, _ask(length), _repeated, _by_document, "doc_id long, print long, anchors binary", CHUNK)
    sharing = with_rows(docs, asked, "inner").select("doc_id", "text", "print", "anchors")
    found = postings.two_hops(sharing, buckets, _encode(length), _solve(length), _merge(length), "doc_id long, print long, spans binary", CHUNK)
    return found


def with_rows(docs: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """docs joined to other's row of the same (doc_id, print). Both joins of a run shuffle docs alike, so Spark does it once."""
    rest = [c for c in other.columns if c not in ("doc_id", "print")]
    once = other.dropDuplicates(["doc_id", "print"]).select(F.col("doc_id").alias("_id"), F.col("print").alias("_print"), *rest)
    return docs.join(once.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("print") == F.col("_print")), how)


def _cut(batches):
    for batch in batches:
        n_bytes, removed, n_spans, sha = [], [], [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = (text or "").encode()
            pairs = np.frombuffer(spans or b"", np.int64).reshape(-1, 2).tolist()
            h, at = hashlib.sha256(), 0
            for lo, hi in pairs:
                h.update(raw[at:lo])
                at = hi
            h.update(raw[at:])
            n_bytes.append(len(raw))
            removed.append(sum(hi - lo for lo, hi in pairs))
            n_spans.append(len(pairs))
            sha.append(h.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def suffix_dedup(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("print"))
    both = with_rows(rows, repeated_spans(rows, length, buckets), "left")
    return both.select("doc_id", "text", "spans").mapInArrow(_cut, SCHEMA)
