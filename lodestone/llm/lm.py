"""Language-model scoring by an Elias-Fano trie of words, word pairs and word triples.

The model, over words, the text's end, and one class for everything unknown, with u and v the two
words before w (or the text's start):

    P1(w)      = (c(w) + 1) / (N + V + 1)
    P2(w | v)  = (c(v, w) + g2 * P1(w)) / (c(v) + g2)
    P3(w | uv) = (c(u, v, w) + s(v) * (c(v, w) + g2 * P1(w))) / (c(u, v) + s(v) * (c(v) + g2))

P3 is a Dirichlet prior of weight s(v) * (c(v) + g2) around P2, and sums to one over w whatever
s is. s(v) = g3 / (m(v) + g2), where m(v), at least c(v), is the largest count among the words
that share v's cell in a table of fixed size, so that every task knows it; the weight is g3 where
a cell has no larger word. The logarithm of P3 then falls into a part that the bucket of w can add
up alone, the numerator, and one that is the bucket of v's, the denominator: a pair as the context
of the word after it. So counts, trie and questions of a word meet in one bucket, and one shuffle
brings both the training counts and the questions there.

The trie of a bucket is reversed: words first, under them the words before, under those the words
before these. Each level holds its children's ids as one Elias-Fano sequence, relative to their
parents, behind monotone pointers; a node is found by a successor search within its context
(elias_fano.Level). Each node holds quantised smoothed values of 16 bits, in 1/2048 of a decimal
order: numerators rounded down and denominators up, which keeps the sum of probabilities at one or
below. The levels are flat arrays in a file that is memory-mapped. Ids are the words' hashes: 40 bits
under their word, 32 bits under their pair.

Words with more than 1/4096 of all training tokens (there can be no more than 4,096) are known to
every task: what is theirs alone is added up where a document is read, and their children are
dealt by the word before, to parts whose number grows with the word's count.

Edge cases: null and empty texts are one end token; nothing to learn from leaves the uniform
class of the unknown; a null id is neither learned from nor held out; repeated rows are learned
and scored as often as they stand; very long texts are a chunk of their own; other columns are never
read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import postings
from .elias_fano import EliasFano, Level
from .postings import narrow, pack, unpack
from .scratch import staged

SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: Stand-ins that no word can be: words hold no white space.
END, START = b"\r", b"\t"
HOT_SHARE = 4096
#: A hot word is dealt to as many parts as it would fill buckets, times this.
HOT_PARTS = 4
#: Steps in a decimal order, and the least order of each kind of value.
STEP, LEAST = 2048.0, -16
#: Bits of a word's hash that tell its cell in the table of largest counts, and codes to an octave.
CELL_BITS, OCTAVE = 22, 4
CHUNK, BUCKET = 8 << 20, 16 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def print40(h: np.ndarray) -> np.ndarray:
    """The id of a word under the word after it; its first CELL_BITS bits tell the cell."""
    return h >> np.uint64(24)


def print32(h: np.ndarray) -> np.ndarray:
    """The id of a word under the pair after it."""
    return h.astype(np.uint32)


def count_code(n: np.ndarray) -> np.ndarray:
    """Counts as a byte, rounded up."""
    return np.ceil(np.log2(np.maximum(n, 1)) * OCTAVE - 1e-9).astype(np.uint8)


def strength(codes: np.ndarray, print_: np.ndarray, g2: float, g3: float) -> np.ndarray:
    """s of the words of these 40-bit prints."""
    return g3 / (2.0 ** (codes[(print_ >> np.uint64(40 - CELL_BITS)).astype(np.int64)] / OCTAVE) + g2)


def quantised(x: np.ndarray, up: bool = False) -> np.ndarray:
    step = np.ceil if up else np.floor
    return np.clip(step((x - LEAST) * STEP), 0, 65535).astype(np.uint16)


def plain(x: np.ndarray) -> np.ndarray:
    return x / STEP + LEAST


class Trie:
    """Words, (word, word before) and (word, word before, word before that) over memory-mapped levels.

    unseen: of words, log10 of g2 * P1. back and context: of pairs, log10 of c(v, w) + g2 * P1(w), and of
    the denominator that the pair has as a context. seen: of triples, log10 of the numerator.
    """

    def __init__(self, n_words: int, child: np.ndarray, grandchild: np.ndarray, unseen: np.ndarray, back: np.ndarray, context: np.ndarray, seen: np.ndarray):
        """child: rising uint64 of word number << 40 | id; grandchild: pair number << 32 | id; values as log10."""
        two = Level.of((child >> np.uint64(40)).astype(np.int64), child & np.uint64((1 << 40) - 1), n_words)
        three = Level.of((grandchild >> np.uint64(32)).astype(np.int64), grandchild & np.uint64((1 << 32) - 1), len(child))
        values = [quantised(unseen), quantised(back), quantised(context, up=True), quantised(seen)]
        arrays = [*values, *two.arrays(), *three.arrays()]
        self._file = tempfile.TemporaryFile()  # the task's own: unlinked at once, gone with the task
        for a in arrays:
            self._file.write(b"\0" * (-self._file.tell() % 8))
            self._file.write(a.tobytes())
        self._file.write(b"\0" * 8)
        self._file.flush()
        whole, at, mapped = np.memmap(self._file, np.uint8, "r"), 0, []
        for a in arrays:
            at += -at % 8
            mapped.append(whole[at : at + a.nbytes].view(a.dtype))
            at += a.nbytes
        self.unseen, self.back, self.context, self.seen = mapped[:4]
        levels = []
        for i, level in ((4, two), (10, three)):
            parts = [EliasFano(s.n, s.low_bytes, *mapped[i + 3 * k : i + 3 * k + 3]) for k, s in enumerate((level.ids, level.pointers))]
            levels.append(Level(*parts))
        self.two, self.three = levels

    def pairs(self, word: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of (word, id of the word before), and whether the trie has them."""
        _, end, base = self.two.ranges(word)
        return self.two.find(end, base, child)

    def triples(self, pair: np.ndarray, n: np.ndarray, ids: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
        """Values of the triples that pairs (numbers, -1 for none) have: n ids each; otherwise of those that the trie lacks."""
        _, end, base = (np.repeat(x, n) for x in self.three.ranges(np.maximum(pair, 0))) if self.three.pointers.n > 1 else (np.zeros(len(ids), np.int64),) * 3
        at, there = self.three.find(end, base.astype(np.uint64), ids)
        there &= np.repeat(pair >= 0, n)
        out = otherwise.copy()
        out[there] = plain(self.seen[at[there]])
        return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over the rows of docs (text), counted by chunk and then summed."""

    def run(batches):
        for _, held in postings.chunked(batches):
            known: dict[bytes, int] = defaultdict(int)
            for b in held:
                for t in b.column(1).to_pylist():
                    for w in (t or "").encode().lower().split():
                        known[w] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(known), pa.binary()), pa.array(list(known.values()), pa.int64())], ["word", "n"])

    return docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def largest_counts(words: DataFrame, n_start: int) -> np.ndarray:
    """The table of 2 ** CELL_BITS codes: of each cell the largest count of a word in it."""

    def cells(batches):
        for b in batches:
            cell = (print40(hashes(b.column(0).to_pylist())) >> np.uint64(40 - CELL_BITS)).astype(np.int64)
            code = count_code(np.asarray(b.column(1)))
            order = np.lexsort((code, cell))
            last = order[np.flatnonzero(np.diff(cell[order], append=-1))]
            yield pa.RecordBatch.from_arrays([pa.array((cell[last] >> 14).astype(np.int32)), pa.array((cell[last] & 16383).astype(np.int16)), pa.array(code[last].astype(np.int16))], ["block", "cell", "code"])

    def block(t: pa.Table) -> pa.Table:
        out = np.zeros(1 << 14, np.uint8)
        np.maximum.at(out, np.asarray(t["cell"]), np.asarray(t["code"]).astype(np.uint8))
        return pa.table({"block": t["block"][:1], "codes": pa.array([out.tobytes()], pa.binary())})

    best = words.mapInArrow(cells, "block int, cell short, code short").groupBy("block", "cell").agg(F.max("code").alias("code"))
    codes = np.zeros(1 << CELL_BITS, np.uint8)
    # at most 2 ** CELL_BITS bytes
    for r in best.groupBy("block").applyInArrow(block, "block int, codes binary").collect():
        codes[r["block"] << 14 : (r["block"] + 1) << 14] = np.frombuffer(r["codes"], np.uint8)
    own = int(print40(hashes([START]))[0]) >> (40 - CELL_BITS)
    codes[own] = max(codes[own], count_code(np.array([n_start]))[0])
    return codes


def _encode(hot: dict[bytes, int], n_tokens: int, n_train: int, first: float):
    """first: log10 of the denominator of a text's first word."""

    def encode(held: list[pa.RecordBatch], buckets: int) -> tuple[bytes, dict[int, bytes]]:
        known: dict[bytes, int] = defaultdict(lambda: len(known))
        end, start = known[END], known[START]
        ids = [x for b in held for x in b.column(0).to_pylist()]
        learn = np.array([bool(x) for b in held for x in b.column(2).to_pylist()], bool)
        out = [bool(x) for b in held for x in b.column(3).to_pylist()]
        parts, sizes = [], []
        for b in held:
            for t in b.column(1).to_pylist():
                words = (t or "").encode().lower().split()
                sizes.append(len(words) + 1)
                parts += [[start, start], np.fromiter(map(known.__getitem__, words), np.int32, len(words)), [end]]
        flat = np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)
        del parts
        n, names = len(ids), list(known)
        size, v = np.array(sizes, np.int64), len(names)
        doc = np.repeat(np.arange(n), size)
        at = np.arange(len(doc)) + 2 * (doc + 1)
        word, before, ahead = flat[at], flat[at - 1], flat[at - 2]
        count = np.array([hot.get(w, -1) for w in names], np.int64)
        is_hot = count >= 0
        # what tasks know of hot words, where they stand
        total = lambda x: np.bincount(doc, weights=np.where(is_hot, x, 0)[word], minlength=n)
        base, seen = total(np.log10(np.where(is_hot, count, 0) + 1.0)), total(count > 0)
        h = hashes(names)
        pair, of = np.unique(word * v + before, return_inverse=True)
        w, b = pair // v, pair % v
        n_parts = np.where(is_hot, 1 + HOT_PARTS * buckets * count // max(n_tokens, 1), 1)
        salt = np.where(is_hot[w], 1 + (h[b] >> np.uint64(20)).astype(np.int64) % n_parts[w], 0).astype(np.uint64)
        bucket = ((h[w] + salt * _GOLDEN) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((print40(h)[b], w, bucket))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        if len(pair) * v * max(n, 1) < 1 << 62:
            key, freq = np.unique((rank[of] * v + ahead) * max(n, 1) + doc, return_counts=True)
            triple, doc = key // max(n, 1), key % max(n, 1)
            of, ahead = triple // v, triple % v
            new = np.diff(triple, prepend=-1) != 0
        else:  # one very long text with very many words
            by = np.lexsort((doc, ahead, rank[of]))
            of, ahead, doc = rank[of][by], ahead[by], doc[by]
            new = (np.diff(of, prepend=-1) != 0) | (np.diff(ahead, prepend=-1) != 0)
            cut = np.flatnonzero(new | (np.diff(doc, prepend=-1) != 0))
            freq = np.diff(cut, append=len(doc))
            of, ahead, doc, new = of[cut], ahead[cut], doc[cut], new[cut]
        first_of = np.flatnonzero(new)
        learned = np.add.reduceat(freq * learn[doc], first_of) if len(first_of) else first_of
        per_triple = np.diff(first_of, append=len(doc))
        of, ahead = of[first_of], ahead[first_of]
        w, b, bucket = w[order], b[order], bucket[order]
        per_pair = np.bincount(of, minlength=len(w))
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        cut3 = np.searchsorted(of, cut)
        edge = np.append(first_of, len(doc))
        blobs = {}
        for k in np.flatnonzero(np.diff(cut)):
            two, three = slice(cut[k], cut[k + 1]), slice(cut3[k], cut3[k + 1])
            post = slice(edge[three.start], edge[three.stop])
            turn = np.flatnonzero(np.diff(w[two], prepend=-1))
            p = print40(h[b[two]])
            blobs[int(k)] = pack(
                b"\n".join(names[x] for x in w[two][turn]), narrow(np.diff(turn, append=two.stop - two.start)), p.astype(np.uint32), (p >> np.uint64(32)).astype(np.uint8), narrow(per_pair[two]),
                print32(h[ahead[three]]), narrow(learned[three]), narrow(per_triple[three]), narrow(doc[post]), narrow(freq[post]),
            )
        flags = [np.array(x, np.uint8) for x in ([i is None for i in ids], out)]
        return pack(np.array([i or 0 for i in ids], np.int64), *flags, size, base, seen, np.full(n, -first)), blobs

    return encode


def _solve(hot: dict[bytes, int], n: int, v: int, g2: float, g3: float, codes: np.ndarray):
    def solve(blobs: list[bytes]) -> list[bytes]:
        if not blobs:
            return []
        known: dict[bytes, int] = defaultdict(lambda: len(known))
        got = []
        for x in blobs:
            names, n_children, low, high, n_ahead, ahead, learned, per_triple, doc, freq = unpack(x)
            word = np.repeat(np.fromiter(map(known.__getitem__, names.split(b"\n")), np.uint64, len(n_children)), n_children)
            got.append(((word << np.uint64(40)) | (high.astype(np.uint64) << np.uint64(32)) | low, n_ahead.astype(np.int64), ahead, learned, per_triple, doc, freq))
        # counts of pairs and triples, and of the words that are not hot
        child, of = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
        of = np.repeat(of.astype(np.uint64), np.concatenate([g[1] for g in got]))
        learned = np.concatenate([g[3].astype(np.int64) for g in got])
        c_pair = np.bincount(of.astype(np.int64), weights=learned, minlength=len(child)).astype(np.int64)
        kept = np.cumsum(c_pair > 0) - 1  # a pair's number among those learned
        code = (kept[of.astype(np.int64)].astype(np.uint64) << np.uint64(32)) | np.concatenate([g[2] for g in got])
        code, learned = code[learned > 0], learned[learned > 0]
        order = np.argsort(code)
        code, learned = code[order], learned[order]
        new = np.flatnonzero(np.diff(code, prepend=~code[:1]))
        grandchild, c_triple = code[new], np.add.reduceat(learned, new) if len(new) else learned
        del of, code, learned, order
        child, c_pair = child[c_pair > 0], c_pair[c_pair > 0]
        words = (child >> np.uint64(40)).astype(np.int64)
        count = np.bincount(words, weights=c_pair, minlength=len(known)).astype(np.int64)
        fixed = np.array([hot.get(w, -1) for w in known], np.int64)
        is_hot = fixed >= 0
        count = np.where(is_hot, fixed, count)
        prior = g2 * (count + 1) / (n + v + 1)
        s_word = strength(codes, print40(hashes(list(known))), g2, g3)
        s_before = strength(codes, child & np.uint64((1 << 40) - 1), g2, g3)
        back, of = c_pair + prior[words], (grandchild >> np.uint64(32)).astype(np.int64)
        trie = Trie(len(known), child, grandchild, np.log10(prior), np.log10(back), np.log10(c_pair + s_word[words] * (count[words] + g2)), np.log10(c_triple + s_before[of] * back[of]))
        del back, of, grandchild, c_triple, s_before, words, c_pair, child
        alone = quantised(np.log10(s_word * (count + g2)), up=True)  # the denominator of a pair that was not learned
        follows = np.array([w != END for w in known])
        zero = np.zeros(len(count))
        base, seen = (np.where(is_hot, zero, x) for x in (np.log10(count + 1.0), count > 0))
        out = []
        for code, n_ahead, ahead, _, per_triple, doc, freq in got:
            word, child = (code >> np.uint64(40)).astype(np.int64), code & np.uint64((1 << 40) - 1)
            pair, there = trie.pairs(word, child)
            pair = np.where(there, pair, -1)
            numerator, context = plain(trie.unseen[word]), np.where(follows[word], plain(alone[word]), 0.0)
            numerator[there] = plain(trie.back[pair[there]])
            own = there & follows[word]
            context[own] = plain(trie.context[pair[own]])
            numerator += np.log10(strength(codes, child, g2, g3))
            value = trie.triples(pair, n_ahead, ahead.astype(np.uint64), np.repeat(numerator, n_ahead)) - np.repeat(context, n_ahead)
            w = np.repeat(np.repeat(word, n_ahead), per_triple)
            total = lambda x: np.bincount(doc, weights=x * freq)  # noqa: B023, E731
            out.append(pack(total(base[w]), narrow(total(seen[w]).astype(np.int64)), total(np.repeat(value, per_triple))))
        return out

    return solve


def _merge(n: int, v: int):
    def merge(base: bytes, parts: list[bytes]) -> pa.Table:
        ids, absent, out, sizes, base_sum, seen, score = unpack(base)
        base_sum, seen, score = base_sum.copy(), seen.astype(np.int64), score.copy()
        for x in parts:
            for total, add in zip((base_sum, seen, score), unpack(x), strict=True):
                total[: len(add)] += add.astype(total.dtype)
        return pa.table({
            "doc_id": pa.array(ids, mask=absent.astype(bool)), "held_out": out.astype(bool), "n_tokens": sizes, "n_known": seen,
            "train_tokens": np.full(len(ids), n, np.int64), "base_score": base_sum - sizes * np.log10(n + v + 1), "score": score,
        })

    return merge


def lm_scores(docs: DataFrame, learn: Column, held_out: Column, g2: float = 500.0, g3: float = 20.0, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Scores of every row by the model of the rows for which learn holds."""
    no = F.lit(False)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.coalesce(learn, no).alias("learn"), F.coalesce(held_out, no).alias("out"))
    learned = rows.filter("learn").select("doc_id", "text")
    words = staged(word_counts(learned), "words")
    n_train = learned.select("doc_id").count()
    n_words, total = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n, v = total + n_train, n_words + bool(n_train)
    # each has more than 1/4096 of the tokens, so they are fewer than 4,096
    hot = {bytes(r["word"]): r["n"] for r in words.filter(F.col("n") * HOT_SHARE > n).collect()} | {END: n_train}
    codes = largest_counts(words, n_train)
    s = strength(codes, print40(hashes([START])), g2, g3)[0]
    first = float(np.log10(n_train + s * (n_train + g2)))
    return postings.two_hops(rows, buckets or postings.bucket_count(rows, size=BUCKET), _encode(hot, n, n_train, first), _solve(hot, n, v, g2, g3, codes), _merge(n, v), SCHEMA, CHUNK)
