"""Byte-level BPE by backtracking over longest matches, and decoding by an offset table.

Encoding a pre-token: an Aho-Corasick automaton over the vocabulary gives the longest token at
every position in one pass. Tokens are taken from the left; a token is accepted if its end has
not been given up and it is compatible with the token before it (the merges of the two side by
side leave exactly the two). If not, its longest proper prefix in the vocabulary is tried, and
when none is left the position is given up and the token before is shortened. Each position is
given up at most once, so the work is linear, and the result is the one sequence that merging by
rank gives. Compatibility is a memoised table over pairs, filled by taking both tokens apart in
the reverse order of their merges.

Decoding: the bytes of all tokens lie in one array behind an offset table; a chunk of ids becomes
bytes by one gather. The decimal form of ids for digests is made in the same way.

Edge cases: null counts as empty, which has no ids; special strings inside texts are special
tokens, as in the library's default; bytes that are no UTF-8 decode to U+FFFD; very long
pre-tokens and texts take linear time; repeated rows and ids are rows of their own; other columns
are not read by round_trips, and encoded keeps them whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .names import free
from .token_counts import byte_letters

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
NEVER = 1 << 60
#: Remembered pre-tokens and pairs of a worker; beyond this the memory starts anew.
REMEMBER = 150_000
#: Characters of text that are encoded at once.
RUN = 2 << 20


def bytes_table(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, sizes) of byte strings end to end."""
    sizes = np.array([len(x) for x in parts], np.int32)
    return np.frombuffer(b"".join(parts), np.uint8), (np.cumsum(sizes) - sizes).astype(np.int32), sizes


def gather(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The strings of ids end to end, and the end of each."""
    blob, starts, sizes = table
    n = sizes[ids]
    ends = np.cumsum(n, dtype=np.int64)
    at = np.repeat(starts[ids].astype(np.int64) - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
    return blob[at].tobytes(), ends


class Bpe(dict):
    """A byte-level BPE vocabulary; as a dict it maps pre-tokens to their ids (int32 bytes)."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("another tokenizer than plain byte-level BPE")
        back = {v: k for k, v in byte_letters().items()}
        raw = lambda s: bytes(back[ord(c)] for c in s)
        vocab = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        n = max(vocab.values()) + 1
        self.size, self.rank, self.halves, self.pair = [0] * n, [-1] * n, [(0, 0)] * n, {}
        for k, (a, b) in enumerate(tuple(map(raw, m)) for m in spec["model"]["merges"]):
            a, b, ab = vocab[a], vocab[b], vocab[a + b]
            self.pair[a, b] = k
            if self.rank[ab] < 0:
                self.rank[ab], self.halves[ab] = k, (a, b)
        tokens = [b""] * n
        self.automaton = ahocorasick.Automaton()
        for s, i in vocab.items():
            tokens[i], self.size[i] = s, len(s)
            self.automaton.add_word(s.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = [next((vocab[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in vocab), -1) for s in tokens]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for s, i in self.special.items():
            tokens += [b""] * (i + 1 - len(tokens))
            tokens[i] = s.encode()
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
        self.decoding = bytes_table(tokens)
        self.decimals = bytes_table([b"%d," % i for i in range(len(tokens))])
        self.fits: dict[tuple[int, int], bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b by rank leaves a and b."""
        if (fit := self.fits.get((a, b))) is None:
            if len(self.fits) > REMEMBER:
                self.fits.clear()
            fit = self.fits[a, b] = self._compatible(a, b)
        return fit

    def _compatible(self, a: int, b: int) -> bool:
        # the pieces at the seam, from the last state back: each is there until its own next merge
        until_a = until_b = NEVER
        rank, halves, pair = self.rank, self.halves, self.pair
        while True:
            k = pair.get((a, b), NEVER)
            if k < until_a and k <= until_b and k < NEVER:  # of equal ranks the left goes first
                return False
            if rank[a] > rank[b]:
                until_a, a = rank[a], halves[a][1]
            elif rank[b] >= 0:
                until_b, b = rank[b], halves[b][0]
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        n, size = len(piece), self.size
        longest = [0] * n
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - size[token]] = token  # ends rise, so the longest comes last
        out: list[int] = []
        open_at, at = bytearray(b"\1") * (n + 1), 0
        token = longest[0] if n else -1
        while at < n:
            while token >= 0 and not (open_at[at + size[token]] and (not out or self.compatible(out[-1], token))):
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                token = longest[at] if at < n else -1
            else:
                open_at[at] = 0
                token = out.pop()
                at -= size[token]
        return out

    def __missing__(self, piece: str) -> bytes:
        if len(self) > REMEMBER:
            self.clear()
        ids = np.array(self.encode_piece(piece.encode()), np.int32).tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, without added special tokens."""
        parts = self.special_pattern.split(text) if self.special_pattern else [text]
        ids = [np.array([self.special[p]], np.int32).tobytes() if i % 2 else b"".join(map(self.__getitem__, self.pattern.findall(p))) for i, p in enumerate(parts)]
        return np.frombuffer(b"".join(ids), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return gather(self.decoding, ids)[0].decode("utf-8", "replace")


@functools.cache
def vocabulary(path: str) -> Bpe:
    return Bpe(path)


def runs(texts: list[str]) -> list[list[str]]:
    """texts in runs of about RUN characters."""
    out, n = [[]], 0
    for t in texts:
        if n > RUN:
            out.append([])
            n = 0
        out[-1].append(t)
        n += len(t)
    return out


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def round_trips(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: narrow, without a shuffle."""

    def run(batches):
        bpe = vocabulary(path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for texts in runs([t or "" for t in batch.column(1).to_pylist()]):
                ids = [bpe.encode(t) for t in texts]
                flat = np.concatenate([np.zeros(0, np.int32), *ids])
                stops = np.cumsum([len(x) for x in ids])
                (digits, d_ends), (raw, r_ends) = gather(bpe.decimals, flat), gather(bpe.decoding, flat)
                d_ends, r_ends = np.concatenate([[0], d_ends]), np.concatenate([[0], r_ends])
                for lo, hi in zip(np.concatenate([[0], stops[:-1]]), stops, strict=True):
                    n.append(int(hi - lo))
                    ids_sha.append(sha(digits[d_ends[lo] : max(d_ends[lo], d_ends[hi] - 1)]))
                    decoded = raw[r_ends[lo] : r_ends[hi]]
                    text_sha.append(sha(decoded.decode("utf-8", "replace").encode()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, SCHEMA)


def encoded(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with ids array<int> added as the last column (named ids, ids_ and so on, as is free)."""
    names = docs.columns
    name = free("ids", names)
    at = names.index(text_col)

    def run(batches):
        bpe = vocabulary(path)
        for batch in batches:
            first = 0
            for texts in runs([t or "" for t in batch.column(at).to_pylist()]):
                ids = [bpe.encode(t) for t in texts]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int32), *ids]))
                yield pa.RecordBatch.from_arrays([*batch.slice(first, len(texts)).columns, lists], [*names, name])
                first += len(texts)

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, ArrayType(IntegerType()))]))
