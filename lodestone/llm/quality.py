"""Quality classifier: supervised subword embeddings.

A text is the average of learned vectors of its features: words, word pairs and character
n-grams of 3 to 5 bytes inside "<word>", each hashed to one of `buckets` rows. A softmax over
that average gives the class; vectors and softmax are trained together by stochastic gradient
descent in numpy, on a bounded sample of labelled rows (`sample_rows`, drawn by a hash of the
id). The trained model is linear in the average, so scoring needs one number per bucket: a table
of fixed size that goes to the executors, and every whole text is scored where it is read.

Edge cases: null and empty texts have no features and get the score of the bias alone; without
labelled rows, or with one class only, that is the share of label 1 (0.5 without rows); a null
id is never held out and never learned from; of contradicting labels the higher counts; repeated
rows are scored alike; very long texts are scored whole, by their average like any other; other columns
are kept and never looked at, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .names import free

SCHEMA = "doc_id long, held_out boolean, score double"
SIZES = (3, 4, 5)
_M = np.uint64(0x9E3779B97F4A7C15)
#: Words that a worker remembers; beyond this the memory starts anew.
REMEMBER = 400_000


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M
    return h ^ (h >> np.uint64(29))


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, hash) of every word's own and n-gram features, and the words' own hashes."""
    flat = np.frombuffer(b"".join(b"<%b>" % w for w in words), np.uint8).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), size)
    ends = np.cumsum(size)
    left = ends[owner] - np.arange(len(flat))  # letters from here to the word's end
    owners, hashes = [], []
    h = np.zeros(len(flat), np.uint64)
    for n in range(1, max(SIZES) + 1):
        h = h[: len(flat) - n + 1] * np.uint64(257) + flat[n - 1 :] + np.uint64(1)
        if n in SIZES:
            ok = left[: len(h)] >= n
            owners.append(owner[: len(h)][ok])
            hashes.append(_mix(h[ok] + np.uint64(n << 56)))
        if len(h) <= 1:
            break
    powers = np.uint64(1_000_003) ** (np.arange(len(flat), dtype=np.uint64) - np.repeat((ends - size).astype(np.uint64), size))
    own = _mix(np.add.reduceat((flat + np.uint64(1)) * powers, ends - size)) if len(words) else np.zeros(0, np.uint64)
    return np.concatenate([np.arange(len(words)), *owners]), np.concatenate([own, *hashes]), own


def pair_hashes(own: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words; a word beside itself is one feature, whatever the word."""
    a, b = own[:-1], own[1:]
    return np.where(a == b, _M, _mix(a * np.uint64(31) + b))


def text_features(text: str | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    words = (text or "").encode().split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    owner, hashes, own = word_features(list(known))
    n = np.bincount(at)
    b = np.concatenate([hashes, pair_hashes(own[at])]) % np.uint64(buckets)
    weight = np.concatenate([n[owner], np.ones(len(words) - 1)])
    got, back = np.unique(b.astype(np.int64), return_inverse=True)
    return got, np.bincount(back, weights=weight)


@dataclass
class Model:
    """weight[b]: what bucket b adds to the logit of label 1 when the text is all b."""

    weight: np.ndarray
    bias: float


def train(texts: list[str | None], labels: list[int], buckets: int = 1 << 18, dim: int = 16, epochs: int = 5, rate: float = 0.5, seed: int = 7) -> Model:
    """Vectors and softmax by SGD, a text a step, with a rate that falls to zero."""
    y = np.array(labels, int)
    share = (y.sum() + 1) / (len(y) + 2)
    if len(set(labels)) < 2:
        return Model(np.zeros(buckets, np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)  # the bias stays at the labels' share: a text of unknown features gets that
    bias[1] = np.log(share / (1 - share))
    # the sample's features lie in two flat arrays that grow in place, so that the driver holds them once
    flat, parts, ends = bytearray(), bytearray(), [0]
    for text in texts:
        f, n = text_features(text, buckets)
        flat += f.astype(np.int32).tobytes()
        parts += (n / max(n.sum(), 1)).astype(np.float32).tobytes()
        ends.append(ends[-1] + len(f))
    flat, parts = np.frombuffer(flat, np.int32), np.frombuffer(parts, np.float32)
    steps, done = epochs * len(y), 0
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            lr = rate * (1 - done / steps)
            done += 1
            feats, part = flat[ends[i] : ends[i + 1]], parts[ends[i] : ends[i + 1]]
            hidden = part @ vectors[feats]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            grad = p @ out
            out -= lr * np.outer(p, hidden)
            # the average's gradient, scaled up by the number of distinct features as each has a small part in it
            vectors[feats] -= np.float32(lr) * np.minimum(part * len(feats), 8.0)[:, None] * grad
    return Model(vectors @ (out[1] - out[0]), float(bias[1] - bias[0]))


class Scorer:
    """Scores texts; remembers each word's sum over its features."""

    def __init__(self, model: Model):
        self.model, self.n = model, np.uint64(len(model.weight))
        self._start()

    def _start(self) -> None:
        self.known: dict[bytes, int] = {}
        self.sums, self.counts, self.own = np.zeros(1024), np.zeros(1024), np.zeros(1024, np.uint64)

    def _learn(self, words: list[bytes]) -> None:
        owner, hashes, own = word_features(words)
        first = len(self.known)
        while first + len(words) > len(self.sums):
            self.sums, self.counts, self.own = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sums, self.counts, self.own))
        stop = first + len(words)
        self.sums[first:stop] = np.bincount(owner, weights=self.model.weight[(hashes % self.n).astype(np.int64)], minlength=len(words))
        self.counts[first:stop] = np.bincount(owner, minlength=len(words))
        self.own[first:stop] = own
        self.known.update(zip(words, range(first, stop), strict=True))

    def score(self, texts: list[str | None]) -> np.ndarray:
        words = [(t or "").encode().split() for t in texts]
        new = set().union(*words).difference(self.known)
        if len(self.known) + len(new) > REMEMBER:
            self._start()
            new = set().union(*words)
        if new:
            self._learn(sorted(new))
        z = np.full(len(texts), self.model.bias)
        for i, w in enumerate(words):
            if w:
                at = np.fromiter(map(self.known.__getitem__, w), np.int64, len(w))
                pairs = self.model.weight[(pair_hashes(self.own[at]) % self.n).astype(np.int64)]
                z[i] += (self.sums[at].sum() + pairs.sum(dtype=np.float64)) / (self.counts[at].sum() + len(pairs))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, sample_rows: int = 3000, label: str = "quality", **kw) -> Model:
    """Train on about sample_rows labelled rows for which learn_from (over doc_id) holds."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label")).filter(learn_from)
    n = known.count()
    cut = F.lit(min(1.0, sample_rows / max(n, 1)))
    drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < cut * (1 << 20))
    # sample_rows ids and labels at most, but for the spread of the draw, and of each id one row
    got = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).toPandas()
    got = got.sort_values(["doc_id", "text"], kind="stable", na_position="first")
    texts, known = [t if isinstance(t, str) else None for t in got["text"]], got["label"].tolist()
    del got
    return train(texts, known, **kw)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs' columns and the score as the last one (named _score, _score_ and so on, as is free)."""
    spark, names = docs.sparkSession, docs.columns
    sent = spark.sparkContext.broadcast((model.weight, model.bias))
    name = free("_score", names)
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    text = names.index("text")

    def run(batches):
        scorer = Scorer(Model(*sent.value))
        for batch in batches:
            texts = batch.column(text).to_pylist()
            parts = [scorer.score(texts[i : i + 256]) for i in range(0, len(texts), 256)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0), *parts]))], [*names, name])

    return docs.mapInArrow(run, schema)
