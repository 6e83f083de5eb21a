"""Token counts without token ids: pieces are counted once per distinct pre-token.

A chunk of documents is split into pre-tokens as the tokenizer's normaliser and pre-tokenizer
would; each distinct pre-token goes once per chunk, with its frequencies by document, to the
bucket of its hash. The bucket has the library count the pieces of each distinct pre-token once,
multiplies, and sends sums by document back to the chunk. Pre-tokens that stand in more than an
eighth of a chunk's documents (at most eight times the mean number of distinct pre-tokens a
document) are counted in the chunk, so that no bucket receives postings of every document.

Edge cases: null and empty texts have no bytes and no tokens; a pre-token without letters the
vocabulary knows counts as the library counts it; repeated rows and ids are counted row by row;
a null id is returned as null; a very long text is a chunk of its own; other columns are never read,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import postings
from .postings import narrow, pack, unpack

SCHEMA = "doc_id long, n_bytes long, n_tokens long"


class WordPieces:
    """Normaliser, pre-tokenizer and piece counts of a lower-casing BPE tokenizer file with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if any(x["type"] not in ("NFC", "Replace", "Lowercase") for x in spec["normalizer"]["normalizers"]):
            raise ValueError("another normaliser than NFC, white space, lower case")
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        # the library's \s is Unicode's White_Space; this module's also has the separators \x1c-\x1f
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"[^\s", r"[^\p{White_Space}"))
        special = [x["content"] for x in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special)))
        self.prefix = special[0][:2]

    def pre_tokens(self, text: str) -> tuple[int, list[str]]:
        """(special tokens inside the text, pre-tokens of the rest)."""
        import unicodedata

        if self.prefix in text and (parts := self.special.split(text))[1:]:
            return len(parts) - 1, [x for p in parts for x in self.pre_tokens(p)[1]]
        if not text.isascii():
            # character by character, as the library does: no final sigma
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return 0, self.pattern.findall(text.lower())

    def counts(self, words: list[str]) -> np.ndarray:
        """Pieces of each pre-token."""
        return np.array([len(self.tok.model.tokenize(w)) for w in self._mapped(words)], np.int64)

    def _mapped(self, words: list[str]) -> list[str]:
        table = byte_letters()
        return [w.encode().decode("latin-1").translate(table) for w in words]


@functools.cache
def byte_letters() -> dict[int, int]:
    """Byte to letter of byte-level vocabularies: visible Latin-1 as it is, others from 256 on in order."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: b for b in seen} | {b: 256 + i for i, b in enumerate(rest)}


@functools.cache
def word_pieces(path: str) -> WordPieces:
    return WordPieces(path)


def _encode(path: str):
    def encode(held: list[pa.RecordBatch], buckets: int) -> tuple[bytes, dict[int, bytes]]:
        wp = word_pieces(path)
        ids = [x for b in held for x in b.column(0).to_pylist()]
        known: dict[str, int] = defaultdict(lambda: len(known))
        runs, n_bytes, base = [], [], []
        for b in held:
            for text in b.column(1).to_pylist():
                n_special, words = wp.pre_tokens(text) if text else (0, [])
                n_bytes.append(len(text.encode()) if text else 0)
                base.append(n_special)
                runs.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        n = len(ids)
        doc = np.repeat(np.arange(n), [len(r) for r in runs])
        key, freq = np.unique(np.concatenate([np.zeros(0, np.int64), *runs]) * n + doc, return_counts=True)
        word, doc = key // max(n, 1), key % max(n, 1)
        base, names = np.array(base, np.int64), list(known)
        n_docs = np.bincount(word, minlength=len(names))
        hot = n_docs > max(n // 8, 64)
        if hot.any():
            pieces = np.zeros(len(names), np.int64)
            pieces[hot] = wp.counts([names[i] for i in np.flatnonzero(hot)])
            base += np.bincount(doc, weights=pieces[word] * freq, minlength=n).astype(np.int64)
        bucket = np.fromiter((zlib.crc32(w.encode()) % buckets for w in names), np.int64, len(names))
        bucket[hot] = -1
        order = np.argsort(bucket, kind="stable")
        first = np.concatenate([[0], np.cumsum(n_docs)])
        parts = {}
        for b in np.unique(bucket[bucket >= 0]):
            mine = order[np.searchsorted(bucket, b, sorter=order) : np.searchsorted(bucket, b, "right", sorter=order)]
            size = n_docs[mine]
            at = np.repeat(first[mine] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            parts[int(b)] = pack("\n".join([names[i] for i in mine]).encode(), narrow(size), narrow(doc[at]), narrow(freq[at]))
        absent = np.array([i is None for i in ids], np.uint8)
        return pack(np.array([i or 0 for i in ids], np.int64), absent, np.array(n_bytes, np.int64), base), parts

    return encode


def _solve(path: str):
    def solve(blobs: list[bytes]) -> list[bytes]:
        got = [unpack(x) for x in blobs]
        known: dict[str, int] = defaultdict(lambda: len(known))
        local = [np.fromiter(map(known.__getitem__, g[0].decode().split("\n")), np.int64) for g in got]
        pieces = word_pieces(path).counts(list(known))
        out = []
        for w, (_, size, doc, freq) in zip(local, got, strict=True):
            sums = np.bincount(doc, weights=np.repeat(pieces[w], size) * freq).astype(np.int64)
            out.append(pack(narrow(sums)))
        return out

    return solve


def _merge(base: bytes, parts: list[bytes]) -> pa.Table:
    ids, absent, n_bytes, total = unpack(base)
    total = total.copy()
    for x in parts:
        (sums,) = unpack(x)
        total[: len(sums)] += sums.astype(np.int64)
    return pa.table({"doc_id": pa.array(ids, mask=absent.astype(bool)), "n_bytes": n_bytes, "n_tokens": total})


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, chunk_bytes: int = postings.CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return postings.two_hops(rows, buckets or postings.bucket_count(rows), _encode(path), _solve(path), _merge, SCHEMA, chunk_bytes)


def over_limit(counts: DataFrame, limit: int = 2048) -> DataFrame:
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
