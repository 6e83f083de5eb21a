"""The training-data operators on small cases against brute force: nulls, empty and long texts, ties, repeats, empty tables, other columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from lodestone.llm import bpe, exact_dedup, lm, mixing, ngram_join, quality, queries, suffix_dedup, token_counts, topk, url_filter
from lodestone.llm.components import connected
from lodestone.llm.elias_fano import EliasFano, Level
from tests.oracle import connect, same

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, bucket int, spans string, row string"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def frame(spark, rows):
    """documents of (id, text) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", None, "x", 1, "y", "z") for i, t in rows], DOCS)


def sentence(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "É", "ß"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(3)
    rows = [(i, sentence(rng, rng.choice([1, 3, 5, 6, 12, 40, 200]))) for i in range(60)]
    for i in range(60, 120):  # copies and near copies, of near copies too
        words = rows[rng.randrange(i)][1].split(" ")
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            words[rng.randrange(len(words))] = sentence(rng, 1)
        rows.append((i, " ".join(words)))
    shared = sentence(rng, 14)
    rows += [(i, f"{sentence(rng, 5)}\n{shared}\n{sentence(rng, 4)}") for i in range(120, 135)]
    rows += [(135, None), (136, ""), (137, " \t\x0b"), (138, "\x00\x01 \x00"), (139, "a " * 30_000), (140, "x" * 40_000), (141, "Σ İ <|endoftext|> end 🙂"), (142, rows[3][1].upper())]
    return rows + [rows[5], rows[5], (7, "another text under a known id"), (None, rows[4][1]), (None, None)]


def sha(b):
    return hashlib.sha256(b.encode() if isinstance(b, str) else b).hexdigest()


# exact dedup


def test_exact_dedup(spark, odd_rows):
    rows = exact_dedup.exact_dedup(frame(spark, odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    groups = {}
    for i, t in odd_rows:
        groups.setdefault(sha(re.sub("[\x20\x09-\x0d]", "", t or "")), []).append((-len(t or ""), i is None, i or 0))
    for r in rows:
        best = min(groups[r["digest"].hex()])
        assert r["keep_id"] == (None if best[1] else best[2])
        assert r["group_size"] == len(groups[r["digest"].hex()])
    assert Counter(r["digest"] for r in rows if r["kept"]) == Counter({bytes.fromhex(g): 1 for g in groups})


def test_digest_index_remembers(spark):
    index = exact_dedup.DigestIndex(spark, buckets=3)
    first = index.append(frame(spark, [(1, "a b"), (2, "ab")])).collect()
    assert {r["doc_id"]: r["kept"] for r in first} == {1: True, 2: False}
    second = {r["doc_id"]: r for r in index.append(frame(spark, [(0, "a  b"), (5, "c")])).collect()}
    assert not second[0]["kept"]
    assert second[0]["keep_id"] == 1
    assert second[5]["kept"]
    assert index.rows().count() == 2
    assert index.append(frame(spark, [])).count() == 0
    plan = index.rows().groupBy("digest").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # the buckets serve joins and groups by digest


def test_survivors_keep_one_of_each(spark, odd_rows):
    docs = frame(spark, odd_rows)
    left = exact_dedup.DigestIndex(spark).survivors(docs)
    assert left.columns == docs.columns
    texts = [re.sub("[\x20\x09-\x0d]", "", r["text"] or "") for r in left.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub("[\x20\x09-\x0d]", "", t or "") for _, t in odd_rows})


# suffix dedup


def brute_spans(rows, length):
    low = {}
    for i, t in rows:
        b = (t or "").encode()
        i = math.inf if i is None else i
        for k in range(len(b) - length + 1):
            low[b[k : k + length]] = min(i, low.get(b[k : k + length], math.inf))
    out = []
    for i, t in rows:
        b, spans = (t or "").encode(), []
        for k in range(len(b) - length + 1):
            if low[b[k : k + length]] < (math.inf if i is None else i):
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + length
                else:
                    spans.append([k, k + length])
        kept, at = b"", 0
        for lo, hi in spans:
            kept, at = kept + b[at:lo], hi
        kept += b[at:]
        out.append((i, len(b), len(b) - len(kept), len(spans), sha(kept)))
    return out


def test_suffix_dedup(spark, odd_rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "RUN", 7000)  # the long texts of 139 and 140 go in pieces
    rows = odd_rows + [(150, "ab" * 400), (151, "ba" * 300), (152, "z" + "ab" * 200 + "q")]
    got = [tuple(r) for r in suffix_dedup.suffix_dedup(frame(spark, rows), buckets=5).collect()]
    assert Counter(got) == Counter(brute_spans(rows, 50))
    assert suffix_dedup.suffix_dedup(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.suffix_dedup(frame(spark, rows), length=10)


def test_suffix_dedup_splits_hot_anchors(monkeypatch):
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    phrase, passage = letters(26), letters(70)
    texts = [letters(rng.randint(30, 90)) + (rng.choice([passage, phrase + passage[:40]]) if i % 15 == 0 else phrase) + letters(rng.randint(30, 90)) for i in range(300)]
    rows = list(enumerate(texts))
    want = {(r[0], r[2], r[3]) for r in brute_spans(rows, 50)}
    fragments = {}
    for hot in (1 << 30, 3):
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        spans, groups = plain_spans(rows, 50, 5)
        assert {(i, sum(b - a for a, b in s), len(s)) for i, s in spans.items()} == want
        fragments[hot] = max(groups.values())
    assert fragments[3] < fragments[1 << 30] / 3  # of one anchor in one merge


def texts_of(blob):
    anchor, size, *_, text = suffix_dedup.unpack(blob)
    ends = np.cumsum(size.astype(np.int64))
    return [(int(a), np.frombuffer(text, np.uint8)[e - n : e]) for a, e, n in zip(anchor, ends, size.astype(np.int64), strict=True)]


def plain_spans(rows, length, buckets):
    """Spans of each row by the operator's own steps over one chunk a row, without Spark; distinct fragments by anchor."""
    chunks = [[pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t]), pa.array([0])], ["doc_id", "text", "print"])] for i, t in rows]

    def hops(chunks, encode, solve, merge):
        sent = [encode(c, buckets) for c in chunks]
        back = [[] for _ in sent]
        for b in range(buckets):
            asked = [(k, x[1][b]) for k, x in enumerate(sent) if b in x[1]]
            for (k, _), x in zip(asked, solve([x for _, x in asked]), strict=True):
                back[k] += [x] if x is not None else []
        return [merge(x[0], y) for x, y in zip(sent, back, strict=True)], [x[1] for x in sent]

    asked, _ = hops(chunks, suffix_dedup._ask(length), suffix_dedup._repeated, suffix_dedup._by_document)
    again = [[pa.RecordBatch.from_arrays([*c[0].columns, pa.array([t["anchors"][0].as_py() if len(t) else b""], pa.binary())], ["doc_id", "text", "print", "anchors"])] for c, t in zip(chunks, asked, strict=True)]
    found, sent = hops(again, suffix_dedup._encode(length), suffix_dedup._solve(length), suffix_dedup._merge(length))
    groups = Counter(a for a, _ in {(a, x.tobytes()) for blobs in sent for blob in blobs.values() for a, x in texts_of(blob)})
    spans = {i: [] for i, _ in rows}
    for t in found:
        for i, s in zip(t["doc_id"].to_pylist(), t["spans"].to_pylist(), strict=True):
            spans[i] = np.frombuffer(s, np.int64).reshape(-1, 2).tolist()
    return spans, groups


def test_merged_transforms_sort_all_suffixes():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 30))) for _ in range(25)]
    rows = np.zeros((25, 40), np.uint16)
    for i, t in enumerate(texts):
        rows[i, : len(t)] = np.frombuffer(t.encode(), np.uint8) + 1
    size = np.array(list(map(len, texts)))
    parts = [suffix_dedup.shard_transform(rows[p], size[p], 8) for p in np.array_split(np.arange(25), 4)]
    starts = np.cumsum([0, *(len(p) for p in np.array_split(np.arange(25), 4))])
    line, prefix = suffix_dedup.merge_transforms([p[2] for p in parts], 8)
    string = np.concatenate([p[0] + s for p, s in zip(parts, starts[:4], strict=True)])[line]
    offset = np.concatenate([p[1] for p in parts])[line]
    got = [texts[s][o : o + 8] for s, o in zip(string, offset, strict=True)]
    assert got == sorted(got)
    assert len(got) == sum(len(t) + 1 for t in texts)
    for a, b, n in zip(got, got[1:], prefix[1:], strict=False):
        same_ = [x == y for x, y in zip(a.ljust(8, "\0"), b.ljust(8, "\0"), strict=True)]
        if False in same_:
            assert n == same_.index(False)
        else:  # beyond the end mark there is nothing to compare
            assert n == 8 if len(a) == 8 else n > len(a)


# URL filters


def test_url_filter(spark):
    pages = spark.createDataFrame(
        [(1, "http://u:p@A.B.example.com:80/x", "2024-02-01"), (2, "https://b.example.com", "2024-03-01"), (3, "nonsense", "2024-02-01"), (4, None, None), (5, "http://other.org/", "2024-02-01"), (6, "http://b.example.com/?q=http://other.org", "2024-02-10"), (6, "http://b.example.com/?q=http://other.org", "2024-02-10")],
        "page_id long, url string, fetched_on string",
    ).withColumns({"entry": F.lit("x"), "row": F.lit(1)})
    log = spark.createDataFrame(
        [("b.example.com", "add", "2024-01-01"), ("b.example.com", "add", "2024-01-15"), ("B.example.com", "remove", "2024-02-10"), ("b.example.com", "add", "2024-02-10"), ("example.com", "add", "2024-03-01"), (None, "add", "2024-01-01"), ("other.org", "drop", "2024-01-01"), ("other.org", "add", None)],
        "entry string, action string, dated string",
    )
    got = {(r["page_id"], r["host"], r["n_active"], r["matched"], r["blocked"]) for r in url_filter.filter_captures(pages, log).collect()}
    assert got == {(1, "a.b.example.com", 1, "b.example.com", True), (2, "b.example.com", 1, "example.com", True), (3, "", 0, None, False), (4, "", 0, None, False), (5, "other.org", 0, None, False), (6, "b.example.com", 0, None, False)}
    assert url_filter.filter_captures(pages, log).count() == 7
    assert not any(r["blocked"] for r in url_filter.filter_captures(pages, log.limit(0)).collect())
    assert url_filter.filter_captures(pages.limit(0), log).count() == 0


# BPE and token counts


def test_bpe_round_trips(spark, odd_rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTE)
    want = []
    for i, t in odd_rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    got = [tuple(r) for r in bpe.round_trips(frame(spark, odd_rows), BYTE).collect()]
    assert Counter(got) == Counter(want)
    assert bpe.round_trips(frame(spark, []), BYTE).count() == 0


def test_bpe_random_pieces():
    from tokenizers import Tokenizer

    tok, own, rng = Tokenizer.from_file(BYTE), bpe.vocabulary(BYTE), random.Random(5)
    for _ in range(2000):
        t = "".join(rng.choice(["a", "aa", "the", " the", "ing", "n", "\n", " ", "é", "日", "'s", "12"]) for _ in range(rng.randint(1, 30)))
        ids = own.encode(t)
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids
        assert own.decode(ids) == t


def test_token_counts(spark, odd_rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD)
    want = [(i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in odd_rows]
    got = token_counts.token_counts(frame(spark, odd_rows), WORD, buckets=3, chunk_bytes=4000)
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)
    assert token_counts.token_counts(frame(spark, []), WORD).count() == 0
    assert [r["over_limit"] for r in token_counts.over_limit(spark.createDataFrame([(2048,), (2049,)], "n_tokens long")).collect()] == [False, True]


# quality


def test_quality(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(w + "%%%" if i % 4 == 0 else w for w in sentence(rng, 30).split())) for i in range(200)]
    docs = frame(spark, [*rows, (900, None), (901, ""), (None, "x y"), rows[0]])
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i, _ in rows] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, quality.bucket_of(F.col("doc_id"), 4) != 2)
    got = quality.scored(docs, model)
    assert got.columns == [*docs.columns, "_score"]
    held = {r["doc_id"]: r["_score"] for r in got.collect() if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and r["doc_id"] < 900}
    assert len(held) > 30
    assert all((s >= 0.7) == (i % 4 != 0) for i, s in held.items())
    scores = {r["doc_id"]: r["_score"] for r in got.collect()}
    assert scores[900] == scores[901]
    assert 0 < scores[900] < 1
    assert quality.fit(docs, labels.limit(0), F.lit(True)).bias == 0
    assert quality.scored(docs.limit(0), model).count() == 0


def test_quality_learns_from_the_whole_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda texts, labels, **kw: seen.append(len(texts)))
    docs = spark.range(2900).selectExpr("id AS doc_id", "'a b' AS text")
    quality.fit(docs, docs.selectExpr("doc_id", "int(doc_id % 2) AS quality"), F.lit(True))
    assert seen == [2900]


# language model


def brute_scores(rows, g2=500, g3=20):
    """(id as text, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row by the model's formula."""
    words = [(i, re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["</s>"]) for i, t in rows]
    train = [w for i, w in words if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(x for w in train for x in w)
    runs = lambda k: Counter(p for w in train for p in zip(*[(["<s>"] * (k - 1) + w)[j:] for j in range(k)], strict=False))
    pairs, triples = runs(2), runs(3)
    n, v = sum(c.values()), len(c)
    before = Counter(c) + Counter({"<s>": len(train)})
    spelled = lambda x: lm.START if x == "<s>" else x.encode()
    cell = {x: int(lm.hashes([spelled(x)])[0]) >> (64 - lm.CELL_BITS) for x in before if x != "</s>"}
    most = Counter()
    for x, k in cell.items():
        most[k] = max(most[k], int(lm.count_code(np.array([before[x]]))[0]))
    s = lambda x: g3 / (2 ** (most[int(lm.hashes([spelled(x)])[0]) >> (64 - lm.CELL_BITS)] / lm.OCTAVE) + g2)

    def p3(a, b, x):
        opens = len(train) if (a, b) == ("<s>", "<s>") else pairs[a, b]
        return (triples[a, b, x] + s(b) * (pairs[b, x] + g2 * (c[x] + 1) / (n + v + 1))) / (opens + s(b) * (before[b] + g2))

    unknown = s("<s>") * g2 / (n + v + 1) / (len(train) + s("<s>") * (len(train) + g2))
    assert sum(p3("<s>", "<s>", x) for x in c) + unknown == pytest.approx(1)
    want = []
    for i, w in words:
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        score = sum(math.log10(p3(*p)) for p in zip(["<s>", "<s>", *w], ["<s>", *w], w, strict=False))
        want.append((str(i), bool(i is not None and zlib.crc32(str(i).encode()) % 7 == 2), len(w), sum(c[x] > 0 for x in w), n, base, score))
    return want


def test_lm_scores(spark, odd_rows):
    docs = frame(spark, odd_rows)
    fold = quality.bucket_of(F.col("doc_id"), 7)
    want = brute_scores(odd_rows)
    got = sorted((str(r[0]), *r[1:]) for r in lm.lm_scores(docs, fold != 2, fold == 2, buckets=4).collect())
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert -1e-3 * g[2] <= g[6] - w[6] <= 1e-9 * g[2]
    assert lm.lm_scores(docs.limit(0), fold != 2, fold == 2).count() == 0
    nothing = lm.lm_scores(docs.limit(1), F.lit(False), F.lit(True)).first()
    assert nothing["train_tokens"] == 0
    assert nothing["n_known"] == 0
    assert nothing["base_score"] == 0
    assert nothing["score"] == pytest.approx(0, abs=1e-3 * nothing["n_tokens"])


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, bits in [(0, 64), (1, 64), (5, 10), (900, 20), (5000, 63), (5000, 40)]:
        v = np.unique(np.concatenate([rng.integers(0, 1 << min(bits, 62), n, dtype=np.uint64), np.arange(n // 3, dtype=np.uint64)]))
        q = np.concatenate([v, v + np.uint64(1), rng.integers(0, 1 << min(bits, 62), 500, dtype=np.uint64)])
        ef = EliasFano.of(v)
        at, found = ef.successor(q)
        assert (at == np.searchsorted(v, q)).all()
        assert (found == np.isin(q, v)).all()
        assert (ef.at(np.arange(len(v))) == v).all()
    again = EliasFano.of(np.array([0, 0, 0, 7, 7, 1 << 40], np.uint64))
    assert again.at(np.arange(6)).tolist() == [0, 0, 0, 7, 7, 1 << 40]


def test_children_are_found_in_their_context():
    rng = np.random.default_rng(1)
    parent = np.sort(rng.integers(0, 300, 4000))
    ids = rng.integers(0, 1 << 12, 4000, dtype=np.uint64)
    keys = np.unique(np.stack([parent.astype(np.uint64), ids], axis=1), axis=0)
    keys = keys[keys[:, 0] % 7 != 3]  # some have no children
    level = Level.of(keys[:, 0].astype(np.int64), keys[:, 1], 320)
    asked = np.arange(320).repeat(40)
    want = rng.integers(0, 1 << 12, len(asked), dtype=np.uint64)
    _, end, base = level.ranges(asked)
    at, there = level.find(end, base, want)
    have = {(int(p), int(i)): k for k, (p, i) in enumerate(keys)}
    assert all((have.get((p, i), -1) == k) if t else (p, i) not in have for p, i, k, t in zip(asked.tolist(), want.tolist(), at.tolist(), there.tolist(), strict=True))
    assert 0 < there.sum() < len(asked)


# top-k


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)]
    rows += [(400, None), (401, [1.0, None] + [0.0] * 6), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, [0.0] * 8), (405, [1.0]), (406, []), (None, [1.0] * 8), rows[7], rows[8]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit(1), "cb": F.lit(2)})
    own = [(i, [math.floor(1024 * x) for x in e] + [0] * (8 - len(e))) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    want = []
    for i, q in dict(own).items():
        if i % 4 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, e, strict=True)), j) for j, e in own if j != i)[:10]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    got = topk.top_k(df, F.col("vec_id") % 4 == 0, 10, block_rows=90, query_block=30)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 4 == 0).count() == 0
    assert topk.top_k(df.filter("vec_id < 3"), F.col("vec_id") == 0).count() == 2


def test_threshold_stops_early(spark):
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(3000, 16)) * 0.5 ** np.arange(16)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "vec_id long, embedding array<double>")
    scored = spark.sparkContext.accumulator(0)
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, 5, block_rows=500, scored=scored).collect()
    whole = np.floor(rows * 1024).astype(np.int64)
    for i in range(0, 3000, 50):
        s = whole @ whole[i]
        best = sorted((-x, j) for j, x in enumerate(s.tolist()) if j != i)[:5]
        assert [(-r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == i] == best
    assert 0 < scored.value < 0.3 * 60 * 3000


def test_walk_is_exact():
    rng = np.random.default_rng(3)
    for n, dims, top in [(1, 3, 5), (40, 3, 2), (900, 4, 50), (900, 2, 1 << 30), (500, 6, 3)]:
        rows = rng.integers(-top, top + 1, (n, dims)) // (1 << rng.integers(0, 4, dims))
        asked = np.concatenate([rows[:20], np.zeros((1, dims), np.int64)])
        ids, own = rng.permutation(n), np.append(np.arange(len(asked) - 1) * 3, -1)
        block = topk.Queries(own, asked, 4, top)
        topk.walk(block, ids, rows, first=2)
        for q, (i, x) in enumerate(zip(own, asked, strict=True)):
            want = sorted((-int(s), j) for s, j in zip(rows @ x, ids.tolist(), strict=True) if j != i)[:4]
            assert [(-int(s), j) for s, j, o in zip(block.scores, block.found.tolist(), block.query, strict=True) if o == q] == want


# mixing


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(1, 9)), rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", None]), 1) for i in range(500)]
    rows += [(500, None, "en", "a", 1), (501, "", "xx", "empty", 1), (None, "w w", "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, factor int")
    targets = {"source": {"a": 0.5, "b": 0.3, "<null>": 0.2}, "lang": {"en": 0.6, "de": 0.3, "<null>": 0.1}}
    got = mixing.mix(docs, targets=targets, rate=0.2)
    assert got.count() == len(rows)
    total = got.agg(F.sum(F.col("n_tokens") * F.col("prob"))).first()[0]
    assert total == pytest.approx(0.2 * sum(len((r[1] or "").split()) for r in rows))
    for dim, col in (("source", "source"), ("lang", "lang")):
        shares = {r[0]: r[1] / total for r in got.groupBy(col).agg(F.sum(F.col("n_tokens") * F.col("prob"))).collect()}
        assert all(shares[k] == pytest.approx(x, abs=1e-3) for k, x in targets[dim].items())
    assert got.filter("source = 'empty' AND sampled").count() == 0
    assert mixing.sample(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_of_many_cells_stays_in_spark(spark):
    rows = [(i, "w " * (1 + i % 7), "en" if i % 3 else "de", f"s{i % 4}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": {"s0": 0.7, "s1": 0.1, "s2": 0.1, "s3": 0.1}}
    a, b = ({r["doc"]["doc_id"]: (r["factor"], r["prob"]) for r in mixing.mix(docs, targets=targets, most=m).collect()} for m in (100, 1))
    assert all(a[i] == pytest.approx(b[i], rel=1e-6) for i in range(80))


@pytest.mark.parametrize(("way", "most"), [("copies", 1000), ("bounded", 1000), ("copies", 1), ("bounded", 1)])
def test_mixing_meets_shares_where_cells_cap(spark, way, most):
    rows = [(i, "!! w w" if i < 3 else "w " * (1 + i % 5), "de" if i % 7 == 0 else "en", f"s{i % 3}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    shares = mixing.reached(mixing.mix(docs, alpha=0.5, rate=0.5), alpha=0.5).collect()
    assert max(abs(r["expected"] - r["target"]) for r in shares) > 0.05  # the registered parameters, capped
    got = mixing.mix(docs, alpha=0.5, rate=0.5, way=way, most=most)
    shares = mixing.reached(got, alpha=0.5).collect()
    assert all(r["expected"] == pytest.approx(r["target"], abs=1e-6) for r in shares)
    if way == "copies":
        assert shares[0]["rate"] == pytest.approx(0.5)
        assert mixing.sample(docs, way=way).count() == got.agg(F.sum("copies")).first()[0]
        assert got.filter("abs(copies - prob) >= 1").count() == 0
    else:
        assert got.agg(F.max("prob")).first()[0] <= 1
        assert 0 < shares[0]["rate"] < 0.5
        if most > 1:  # the rarest category is taken whole
            assert got.filter("topic = 'shouting'").agg(F.min("prob")).first()[0] > 0.99


def test_mixing_copies_has_the_factors_of_its_sql(spark):
    """Small cells, whose factors raking to TOL alone leaves off by more than the sixth decimal."""
    sf = "/root/testdata/sf0.01"
    same(queries.QUERIES["op9_mixing_copies"](spark, sf), connect(sf), queries.ORACLE_SQL["op9_mixing_copies"])


def test_least_rounds(spark):
    rng = np.random.default_rng(5)
    tokens, codes, shares = rng.integers(1, 90, 12).astype(float), [np.arange(12) % 3, np.arange(12) // 3 % 2], [np.array([0.5, 0.3, 0.2]), np.array([0.6, 0.4])]
    rake = lambda **kw: mixing.rake(tokens, codes, shares, **kw).tolist()
    assert rake(rounds=50, tol=1.0, least=7) == rake(rounds=7)
    assert rake(rounds=50, tol=1.0) == rake(rounds=1)
    assert rake(rounds=5, tol=1.0, least=7) == rake(rounds=5)
    cells = spark.createDataFrame([(f"s{i % 3}", f"l{i // 3 % 2}", f"t{i // 6}", int(t)) for i, t in enumerate(tokens)], "source string, lang string, topic string, tokens long")
    a, b = ({(r.source, r.lang, r.topic): r.factor for r in mixing.cell_weights(cells, way="copies", most=m, least=6).collect()} for m in (100, 1))
    assert a == pytest.approx(b, rel=1e-9)


@pytest.mark.parametrize("most", [1000, 1])
def test_filled_mixing_does_not_shrink_for_a_rare_category(spark, most):
    rows = [(i, "!! w" if i == 7 else "w " * (1 + i % 5), "de" if i % 7 == 0 else "en", f"s{i % 3}") for i in range(400)] + [(400, "w", "xx", "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(docs, alpha=0.5, rate=0.5, way="filled", most=most)
    shares = {(r["dim"], r["category"]): r for r in mixing.reached(got, alpha=0.5).collect()}
    assert shares["lang", "en"]["rate"] == pytest.approx(0.5, abs=5e-3)
    assert got.agg(F.max("prob")).first()[0] <= 1
    assert got.filter("lang = 'xx' OR topic = 'shouting'").agg(F.min("prob")).first()[0] > 0.95
    open_ = [r for r in shares.values() if r["dim"] == "source" and r["category"] != "rare"]
    assert max(r["expected"] / r["target"] for r in open_) == pytest.approx(min(r["expected"] / r["target"] for r in open_), rel=0.02)
    assert mixing.mix(docs.limit(0), way="filled", most=most).count() == 0


def test_bounded_rate_is_the_largest():
    t, codes = np.array([10.0, 90.0, 50.0, 50.0]), [np.array([0, 1, 1, 1]), np.array([0, 0, 1, 1])]
    shares = [np.array([0.2, 0.8]), np.array([0.5, 0.5])]
    w = mixing.rake(t, codes, shares, mixing.MOST_ROUNDS, mixing.TOL)
    assert (t * mixing.bounded_prob(t, w, codes, shares, 0.5)).sum() == pytest.approx(50, rel=2e-3)
    assert (t * mixing.bounded_prob(t, w, codes, shares, 0.1)).sum() == pytest.approx(20, rel=1e-6)
    clash = [np.array([0.2, 0.8]), np.array([0.1, 0.9])]  # the first cell is to have 0.2 of a marginal's 0.1
    assert mixing.residual(mixing.rake(t, codes, clash, 200, mixing.TOL), codes, clash) > mixing.LEFT


def test_cap_scale():
    t, f = np.array([10.0, 10.0, 80.0]), np.array([10.0, 1.0, 0.5])
    k = mixing.cap_scale(t, f, 0.3)
    assert (t * np.minimum(1, k * f)).sum() == pytest.approx(30)


# n-gram join


def brute_components(rows, t=75, n=5):
    sets = {}
    for i, x in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        sets.setdefault(i, []).append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    home = {i: i for i in sets}

    def find(i):
        while home[i] != i:
            i = home[i]
        return i

    ids = [i for i in sets if i is not None]
    for i in ids:
        for j in ids:
            if i < j and any(a and b and 100 * len(a & b) >= t * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = find(i), find(j)
                home[max(a, b)] = min(a, b)
    return {i: (find(i), [len(s) for s in x]) for i, x in sets.items()}


def test_ngram_join(spark, odd_rows):
    want = brute_components(odd_rows)
    got = ngram_join.jaccard_components(frame(spark, odd_rows), buckets=3).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        home, sizes = want[r["doc_id"]]
        assert r["component_id"] == home
        assert r["n_shingles"] in sizes
    assert len({h for h, _ in want.values()}) < len(want) - 20
    assert ngram_join.jaccard_components(frame(spark, [])).count() == 0


def test_every_text_of_an_id_links(spark):
    rng = random.Random(9)
    near = [sentence(rng, 40) for _ in range(4)]
    rows = [(i, near[i % 4]) for i in range(4)]
    rows += [(i % 4, sentence(rng, 40)) for i in range(4)] + [(10 + i, f"{near[i]} end") for i in range(4)]
    for order in (rows, rows[::-1]):
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(frame(spark, order), buckets=3).collect()}
        assert all(got[10 + i] == i for i in range(4))
    pairs = pa.RecordBatch.from_pylist([{"a": 1, "b": 2, "text_a": x, "text_b": f"{near[0]} end"} for x in (near[1], near[0], near[1])])
    assert [b.num_rows for b in ngram_join._linked(0.75, 5)([pairs])] == [1]


def test_chunks_spread_over_buckets():
    from lodestone.llm.postings import home_bucket

    for buckets in (8, 32, 960, 1024):
        homes = Counter(home_bucket(p << 32 | n, buckets) for p in range(300) for n in range(2))
        assert len(homes) >= min(buckets, 600) * 0.6
        assert max(homes.values()) <= 600 / buckets + 5 * (600 / buckets) ** 0.5 + 4


def test_signatures_miss_no_link():
    rng = np.random.default_rng(0)
    bands = ngram_join.Bands(0.75, {})
    for size in [1, 2, 3, 4, 5, 6, 7, 9, 12, 15, 16, 17, 18, 21, 22, 23, 30, 40, 70, 150, 400, 1500]:
        for _ in range(60):
            r = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            drop = int(rng.integers(0, max(1, size // 4) + 1))
            s = np.unique(np.concatenate([r[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, size // 6 + 1)), dtype=np.uint64)]))
            both = len(np.intersect1d(r, s))
            if 4 * both >= 3 * (len(r) + len(s) - both):
                (a, short_a), (b, short_b) = ngram_join.signatures(r, bands), ngram_join.signatures(s, bands)
                assert short_a or short_b or len(np.intersect1d(np.concatenate(a), np.concatenate(b)))
                x, y = ngram_join.parities(r), ngram_join.parities(s)
                assert np.bitwise_count((x[:16] ^ y[:16]).view(np.uint64)).sum() <= (len(r) + len(s)) // 7


def test_sketches_fold(spark):
    rng = np.random.default_rng(0)
    r = np.unique(rng.integers(0, 1 << 63, 1100, dtype=np.uint64))  # 4,096 parts; without a tenth of it 2,048
    others = {2: r[100:], 3: r[:900], 4: np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64)), 5: r[:600], 6: r}
    rows = [(i, len(s), ngram_join.parities(s).tolist()) for i, s in [(1, r), *others.items()]]
    sketches = spark.createDataFrame(rows, "id long, n long, sketch array<bigint>")
    pairs = spark.createDataFrame([(1, i) for i in others], "a long, b long")
    assert {x["b"] for x in ngram_join.bounded(pairs, sketches, 0.75).collect()} == {2, 3, 6}


def test_costs_count_all_shingles(spark, odd_rows):
    costs = ngram_join.shingle_costs(frame(spark, odd_rows).repartition(5).select(F.col("doc_id").alias("id"), "text"), 5, 1 << 16)
    total = Counter()
    for _, t in odd_rows:
        total.update((ngram_join.windows(t, 5) >> costs.shift).tolist())
    want = np.zeros(len(costs.codes), np.int64)
    want[list(total)] = list(total.values())
    assert (ngram_join.cost_code(want) == costs.codes).all()


def test_dear_signatures_miss_no_link():
    rng = np.random.default_rng(5)
    bands, codes = ngram_join.Bands(0.75, {}), np.zeros(1 << 12, np.uint8)
    codes[rng.integers(0, 1 << 12, 1 << 11)] = rng.integers(0, 200, 1 << 11)  # half of the cells cost something
    costs, links = ngram_join.Costs(codes, 100), 0
    for size in [1, 2, 3, 4, 6, 8, 11, 14, 16, 18, 22, 30, 50, 90, 200, 700]:
        passage = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        codes[(passage >> costs.shift).astype(np.int64)] = 180
        for _ in range(80):
            r = np.unique(np.concatenate([passage[: rng.integers(0, size + 1)], rng.integers(0, 1 << 63, size, dtype=np.uint64)])[:size])
            drop = int(rng.integers(0, max(1, size // 4) + 1))
            s = np.unique(np.concatenate([r[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, size // 6 + 1)), dtype=np.uint64)]))
            both = len(np.intersect1d(r, s))
            if 4 * both >= 3 * (len(r) + len(s) - both):
                links += 1
                (a, short_a), (b, short_b) = ngram_join.signatures(r, bands, costs), ngram_join.signatures(s, bands, costs)
                assert short_a or short_b or len(np.intersect1d(np.concatenate(a), np.concatenate(b)))
    assert links > 300


def test_common_passage_makes_no_pairs():
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(1 << 40)}"
    passage = [word() for _ in range(40)]
    for own in (60, 100, 300):
        texts = [" ".join([*(word() for _ in range(own // 2)), *passage, *(word() for _ in range(own // 2))]) for _ in range(300)]
        sets = [ngram_join.shingles(t) for t in texts]
        flat = np.concatenate(sets)
        codes = ngram_join.cost_code(np.bincount((flat >> np.uint64(48)).astype(np.int64), minlength=1 << 16))
        costs = ngram_join.Costs(codes, int(ngram_join.cost_code(np.array([64]))[0]))
        keys = Counter(k for s in sets for x in ngram_join.signatures(s, ngram_join.Bands(0.75, {}), costs)[0] for k in x.tolist())
        assert sum(n * (n - 1) // 2 for n in keys.values()) < 300


def test_short_bands_run_again():
    bands = ngram_join.Bands(0.75, {})
    crowded = np.arange(40, dtype=np.uint64)  # all in segment 0, as segments are taken from the high bits
    _, short = ngram_join.signatures(crowded, bands)
    assert short == bands.met(40)
    spread = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 40, dtype=np.uint64))
    assert ngram_join.signatures(spread, bands)[1] == []


def test_components(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(None, 5), (7, 7)] + [(2000 + i, 2001 + i) for i in range(40)]
    home = {x: x for p in pairs for x in p if x is not None}

    def find(i):
        while home[i] != i:
            i = home[i]
        return i

    for a, b in pairs:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            home[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(pairs, "u long, v long")).collect()}
    ends = {x for p in pairs for x in p if None not in p and p[0] != p[1]}
    assert got == {x: find(x) for x in ends}
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0


# queries and pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLE_SQL[name])


def documents(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def rows_of(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    return df.columns, [tuple(r) for r in df.collect()]


def test_op2_query(spark, sf_dir):
    columns, got = rows_of(spark, sf_dir, "op2_suffix_dedup")
    assert columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert Counter(got) == Counter(brute_spans(documents(spark, sf_dir), 50))
    assert any(r[2] for r in got)


def test_op4_query(spark, sf_dir):
    from tokenizers import Tokenizer

    tok, want = Tokenizer.from_file(BYTE), []
    for i, t in documents(spark, sf_dir):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    columns, got = rows_of(spark, sf_dir, "op4_bpe")
    assert columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(got) == Counter(want)


def test_op5_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    columns, got = rows_of(spark, sf_dir, "op5_quality")
    assert columns == ["doc_id", "held_out", "score", "predicted"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert Counter(r[0] for r in got) == Counter(i for i, _ in documents(spark, sf_dir))
    for i, held_out, score, predicted in got:
        assert held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= score <= 1
        assert predicted == int(score >= 0.7)
    held = [(score, labels[i]) for i, held_out, score, _ in got if held_out and labels.get(i) is not None]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert min(len(good), len(bad)) > 10
    assert sum(g > b for g in good for b in bad) > 0.98 * len(good) * len(bad)


def test_op6_query(spark, sf_dir):
    columns, got = rows_of(spark, sf_dir, "op6_lm_scoring")
    assert columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    want = {r[0]: r[1:] for r in brute_scores(documents(spark, sf_dir))}
    assert len(got) == len(want)
    for i, *r in got:
        w = want[str(i)]
        assert tuple(r[:4]) == w[:4]
        assert r[4] == pytest.approx(w[4], rel=1e-9)
        assert -1e-3 * r[1] <= r[5] - w[5] <= 1e-9 * r[1]


def test_op8_query(spark, sf_dir):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD)
    want = [(i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in documents(spark, sf_dir)]
    columns, got = rows_of(spark, sf_dir, "op8_token_counts")
    assert columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert Counter(got) == Counter(want)


def test_op10_query(spark, sf_dir):
    want = brute_components(documents(spark, sf_dir))
    columns, got = rows_of(spark, sf_dir, "op10_ngram_join")
    assert columns == ["doc_id", "n_shingles", "component_id"]
    assert Counter(got) == Counter((i, sizes[0], home) for i, (home, sizes) in want.items())
    assert any(i != home for i, _, home in got)


def test_every_operator_has_a_query():
    assert {m[1] for q in queries.QUERIES if (m := re.match(r"op(\d+)_", q))} == set(map(str, range(1, 11)))


def test_pipeline_stage_by_stage(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = spark.createDataFrame((out := stage(spark, docs, sf_dir)).collect(), out.schema)
        left[name] = {r["doc_id"]: r for r in docs.collect()}
        now = left[name]
        assert set(now) <= set(before)
        assert docs.count() == len(now)
        if name != "bpe":
            assert docs.columns == names
            assert all(now[i] == before[i] for i in now)
        if name == "quality":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
            held = [i for i in before if i in labels and zlib.crc32(str(i).encode()) % 4 == 2]
            assert all(i in now for i in held if labels[i] == 1)
        if name == "exact_dedup":
            texts = {}
            for i, r in before.items():
                texts.setdefault(re.sub("[\x20\x09-\x0d]", "", r["text"]), []).append((-len(r["text"]), i))
            assert set(now) == {min(g)[1] for g in texts.values()}
        if name == "near_dedup":
            home = brute_components([(i, r["text"]) for i, r in before.items()])
            assert set(now) == {h for h, _ in home.values()}
        if name == "bpe":
            tok = Tokenizer.from_file(BYTE)
            assert set(now) == set(before)
            assert all(r["ids"] == tok.encode(r["text"], add_special_tokens=False).ids for r in now.values())
    assert len(left["mixing"]) < len(left["near_dedup"])
    assert {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, sf_dir).collect()} == {i: r["ids"] for i, r in left["bpe"].items()}


def test_clashing_columns(spark):
    rng = random.Random(8)
    rows = [(i, sentence(rng, 30), "en", f"s{i % 3}") for i in range(30)] + [(30, None, None, None)]
    names = ["_source", "_lang", "_topic", "_n_tokens", "_factor", "_prob", "factor", "Prob", "sampled", "doc", "draw", "_score", "_SCORE_", "_dropped", "dropped", "IDS", "_doc", "_id", "_n", "best", "mine", "batch", "keep_id"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(i) for i, c in enumerate(names)})
    model = quality.Model(np.zeros(64, np.float32), 1.0)
    scored = quality.scored(docs, model)
    assert scored.columns == [*docs.columns, "_score__"]
    assert {r[-1] for r in scored.collect()} == {1 / (1 + math.exp(-1))}
    stages = {"mixing": mixing.sample(docs, rate=1.0), "near": ngram_join.one_of_each(docs), "exact": exact_dedup.DigestIndex(spark).survivors(docs), "bpe": bpe.encoded(docs, BYTE)}
    for name, out in stages.items():
        assert out.columns == docs.columns + (["ids_"] if name == "bpe" else [])
        got = out.collect()
        assert all(tuple(r[4 : 4 + len(names)]) == tuple(range(len(names))) for r in got)
        assert len(got) == 31 or name == "mixing"
