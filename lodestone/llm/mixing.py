"""Mixing to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Token counts are summed by cell (source x language x topic) with a map-side combine, so a source
with a third of the rows is one partial sum a task. The cells are raked to the three marginals;
a cell's weight over its tokens is the factor by which its documents should count. The draw
is a hash of the id, so a rerun after a lost executor draws the same. What becomes of cells that
need more than all of their documents is `way`:

* "capped": documents stay with probability min(1, k * factor), k chosen so that the expected
  tokens are `rate` of all. Cells that cap leave the marginals short; `reached` says by how much.
* "copies": a document counts rate * factor times, in whole copies and a draw for the rest. Marginals
  and rate are both met.
* "bounded": no document twice. The cells are raked under the bound of their own tokens at the
  largest rate up to `rate` that meets the marginals; the sample is smaller than `rate` if need be.

* "filled": no document twice, and the rate as near as that allows. A category that has fewer tokens
  than its target asks for at the rate is taken whole, the rest of its marginal shares what it leaves
  open, and the cells are raked to these shares under the bound of their own tokens. A category of a
  single document so costs the others nothing, where "bounded" would shrink the sample to fit it.

The last three rake until what is left of the marginals is TOL, for `least` rounds in any case, and
warn if it stays above LEFT. A share within TOL leaves the factors of small cells off by more than
that: whoever compares factors asks for rounds after which they no longer move.

Edge cases: null or unknown categories count as the category "<null>"; a null text has no tokens;
cells without tokens get factor 0 and none of their documents stay; categories without a target
share the data's own weight; an empty table gives no rows; rows with one id share one draw, and a
null id draws as the text "null"; very long texts weigh what they hold, so a single one may be much of
a cell; other columns are kept, whatever their names.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import staged

DIMS = ("source", "lang", "topic")
WAYS = ("capped", "copies", "bounded", "filled")
#: Cells are the product of three small vocabularies; beyond this the sums stay in Spark.
MAX_CELLS = 200_000
ROUNDS = 12
#: Raking by the residual: the largest distance of a share from its target at which it ends, its rounds at most, and what is too far.
TOL, MOST_ROUNDS, LEFT = 1e-9, 2000, 1e-6
#: Rounds of "filled" at most, where bounds may leave a little that no rate would meet.
FILL_ROUNDS = 200


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def form_topic(text: Column) -> Column:
    """A topic by the text's form, for corpora that carry none: table, shouting, symbols or prose."""
    has = lambda s: F.coalesce(F.contains(text, F.lit(s)), F.lit(False))
    return F.when(has(" | "), "table").when(has("!! "), "shouting").when(has("%%% ") | has("$$$ "), "symbols").otherwise("prose")


def rake(tokens: np.ndarray, codes: list[np.ndarray], shares: list[np.ndarray], rounds: int = ROUNDS, tol: float | None = None, bound: np.ndarray | None = None, least: int = 0) -> np.ndarray:
    """Cell weights, from the tokens', whose sums by each code approach shares; a marginal's shares sum to 1.

    With tol it ends as soon as no share is further than that, but not before `least` rounds; with a bound no weight exceeds it.
    """
    w = tokens / max(tokens.sum(), 1)
    for done in range(1, rounds + 1):
        for code, share in zip(codes, shares, strict=True):
            have = np.bincount(code, weights=w, minlength=len(share))
            w = w * np.divide(share, have, out=np.zeros_like(have), where=have > 0)[code]
            if bound is not None:
                w = np.minimum(w, bound)
        if tol is not None and done >= least and residual(w, codes, shares) <= tol:
            break
    return w


def residual(w: np.ndarray, codes: list[np.ndarray], shares: list[np.ndarray]) -> float:
    """The largest distance of a share from its target."""
    return max(float(np.abs(np.bincount(c, weights=w, minlength=len(s)) - s).max(initial=0)) for c, s in zip(codes, shares, strict=True))


def _warn(left: float) -> None:
    if left > LEFT:
        warnings.warn(f"the target shares contradict each other: raking stops {left:.2g} from them", stacklevel=3)


def bounded_prob(tokens: np.ndarray, w: np.ndarray, codes: list[np.ndarray], shares: list[np.ndarray], rate: float) -> np.ndarray:
    """Probabilities of at most 1 whose expected tokens meet shares, at the largest rate up to `rate`, to 1 in 1,000; w are raked weights."""
    total = tokens.sum()
    over = (w * total / np.maximum(tokens, 1e-300)).max(initial=0)
    low = min(rate, 1 / over) if over > 0 else 0.0
    best = low * w
    if low < rate and residual(w, codes, shares) <= LEFT:
        # no marginal can have more than all of its tokens
        high = min(rate, *((np.bincount(c, weights=tokens, minlength=len(s))[s > 0] / s[s > 0]).min() / total for c, s in zip(codes, shares, strict=True)))
        at = high
        while True:
            got = rake(w, codes, shares, MOST_ROUNDS, TOL, tokens / total / at)
            if residual(got, codes, shares) <= LEFT:
                low, best = at, at * got
            else:
                high = at
            if high - low <= high / 1000:
                break
            at = (low + high) / 2
    return np.minimum(1.0, np.divide(best * total, tokens, out=np.zeros_like(w), where=tokens > 0))


def filled_shares(share: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """share, cut to cap where it is more, the rest scaled up alike until all sum to 1; as far as caps allow."""
    if not (share > 0).any() or np.minimum(np.where(share > 0, np.inf, 0), cap).sum() <= 1:
        return np.where(share > 0, cap, 0.0)
    low, high = 0.0, 1.0
    while np.minimum(share * high, cap).sum() < 1:
        low, high = high, 2 * high
    for _ in range(100):
        k = (low + high) / 2
        low, high = (k, high) if np.minimum(share * k, cap).sum() < 1 else (low, k)
    return np.minimum(share * high, cap)


def cap_scale(tokens: np.ndarray, factor: np.ndarray, rate: float) -> float:
    """k with sum(tokens * min(1, k * factor)) = rate * sum(tokens): the largest factors cap first."""
    order = np.argsort(-factor, kind="stable")
    t, f = tokens[order].astype(float), factor[order]
    left = rate * t.sum() - np.concatenate([[0.0], np.cumsum(t)[:-1]])
    mass = np.cumsum((t * f)[::-1])[::-1]
    k = np.divide(left, mass, out=np.zeros_like(mass), where=mass > 0)
    ok = np.flatnonzero((k * f <= 1) & (mass > 0))
    return float(k[ok[0]]) if len(ok) else (1.0 / f[f > 0].min() if (f > 0).any() else 0.0)


def target_shares(cells: DataFrame, d: str, alpha: float, targets: dict[str, dict[str, float]] | None, total: float) -> DataFrame:
    """(d, share): the target share of each category of a marginal."""
    sums = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("t"))
    share = F.when(F.col("t") > 0, F.pow("t", F.lit(alpha))).otherwise(0.0)
    if targets and d in targets:
        wanted = cells.sparkSession.createDataFrame(list(targets[d].items()), f"{d} string, _want double")
        sums, share = sums.join(wanted, d, "left"), F.when(F.col("t") > 0, F.coalesce("_want", F.col("t") / total)).otherwise(0.0)
    sums = staged(sums.select(d, share.alias("share")), f"shares-{d}")
    return sums.withColumn("share", F.col("share") / max(sums.agg(F.sum("share")).first()[0] or 0, 1e-300))


def _weights_in_spark(cells: DataFrame, alpha: float, rate: float, targets: dict[str, dict[str, float]] | None, rounds: int, way: str, least: int) -> DataFrame:
    """As cell_weights, for more cells than the driver should hold: a round is three grouped sums.

    "bounded" takes the largest rate at which no cell's rate * factor is above 1: the marginals are
    met, by fewer tokens than the cells' own bounds would allow.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    shares = {d: target_shares(cells, d, alpha, targets, total) for d in DIMS}
    bound = F.col("tokens") / (float(total) * rate)
    if way == "filled":
        for d in DIMS:
            both = staged(shares[d].join(cells.groupBy(d).agg((F.sum("tokens") / (float(total) * rate)).alias("cap")), d), f"caps-{d}")
            held = lambda k, both=both: both.agg(F.sum(F.least(F.col("share") * k, F.col("cap")))).first()[0] or 0
            low, high = 0.0, 1.0
            while high < 1e12 and held(high) < 1:
                low, high = high, 2 * high
            for _ in range(40):
                k = (low + high) / 2
                low, high = (k, high) if held(k) < 1 else (low, k)
            shares[d] = both.select(d, F.least(F.col("share") * high, F.col("cap")).alias("share"))
    rows = cells.withColumn("w", F.col("tokens") / F.lit(float(total)))
    for done in range(1, rounds + 1):
        for d in DIMS:
            have = rows.groupBy(d).agg(F.sum("w").alias("_have"))
            rows = rows.join(have, d).join(shares[d], d).withColumn("w", F.when(F.col("_have") > 0, F.col("w") * F.col("share") / F.col("_have")).otherwise(0.0)).select(*DIMS, "tokens", "w")
            if way == "filled":
                rows = rows.withColumn("w", F.least("w", bound))
        rows = staged(rows, "raked")
        if way != "capped":
            left = max(rows.groupBy(d).agg(F.sum("w").alias("_have")).join(shares[d], d).agg(F.max(F.abs(F.col("_have") - F.col("share")))).first()[0] or 0 for d in DIMS)
            if done >= least and left <= TOL:
                break
    if way != "capped":
        _warn(left)
    factor = F.when(F.col("tokens") > 0, F.col("w") * float(total) / F.col("tokens")).otherwise(0.0)
    rows = staged(rows.select(*DIMS, "tokens", factor.alias("factor")), "factors")
    if way != "capped":
        k = rate if way in ("copies", "filled") else min(rate, 1 / max(rows.agg(F.max("factor")).first()[0] or 0, 1e-300))
        return rows.select(*DIMS, "factor", (F.col("factor") * k).alias("prob"))
    expected = lambda k: rows.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("factor") * k))).first()[0]
    lo, hi = 0.0, 1.0
    while hi < 1e12 and expected(hi) < rate * total:
        lo, hi = hi, 4 * hi
    for _ in range(40):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if expected(mid) < rate * total else (lo, mid)
    return rows.select(*DIMS, "factor", F.least(F.lit(1.0), F.col("factor") * hi).alias("prob"))


def cell_weights(cells: DataFrame, alpha: float = 0.5, rate: float = 0.5, targets: dict[str, dict[str, float]] | None = None, rounds: int | None = None, most: int = MAX_CELLS, way: str = "capped", least: int = 0) -> DataFrame:
    """cells (source, lang, topic, tokens) with factor and prob; up to `most` cells are raked in numpy, more in Spark.

    By "copies" prob is the expected number of copies and may be above 1. `least` is of no use to "capped", whose rounds are fixed.
    """
    if way not in WAYS:
        raise ValueError(f"{way} is none of {WAYS}")
    spark = cells.sparkSession
    rounds = rounds or {"capped": ROUNDS, "filled": FILL_ROUNDS}.get(way, MOST_ROUNDS)
    if cells.limit(most + 1).count() > most:
        return _weights_in_spark(cells, alpha, rate, targets, rounds, way, least)
    got = sorted(cells.collect(), key=lambda r: tuple(r[d] for d in DIMS))
    tokens = np.array([r["tokens"] for r in got], float)
    codes, shares = [], []
    for d in DIMS:
        names = sorted({r[d] for r in got})
        at = {x: i for i, x in enumerate(names)}
        code = np.array([at[r[d]] for r in got], int)
        sums = np.bincount(code, weights=tokens, minlength=len(names))
        share = np.where(sums > 0, np.power(np.maximum(sums, 1e-300), alpha), 0.0)
        if targets and d in targets:
            own = sums / max(sums.sum(), 1)
            share = np.array([targets[d].get(x, own[i]) if sums[i] > 0 else 0.0 for i, x in enumerate(names)])
        codes.append(code)
        shares.append(share / max(share.sum(), 1e-300))
    bound = None
    if got and way == "filled":
        bound = tokens / max(tokens.sum(), 1) / rate
        shares = [filled_shares(x, np.bincount(c, weights=bound, minlength=len(x))) for c, x in zip(codes, shares, strict=True)]
    w = rake(tokens, codes, shares, rounds, None if way == "capped" else TOL, bound, least) if got else tokens
    if got and way != "capped":
        _warn(residual(w, codes, shares))
    factor = np.divide(w * tokens.sum(), tokens, out=np.zeros_like(w), where=tokens > 0)
    if not got or way in ("copies", "filled"):
        prob = rate * factor if way != "filled" else np.minimum(1.0, rate * factor)
    else:
        prob = np.minimum(1.0, cap_scale(tokens, factor, rate) * factor) if way == "capped" else bounded_prob(tokens, w, codes, shares, rate)
    rows = [(*(r[d] for d in DIMS), float(f), float(p)) for r, f, p in zip(got, factor, prob, strict=True)]
    # at most `most` rows of five small values
    return F.broadcast(spark.createDataFrame(rows, ", ".join(f"{d} string" for d in DIMS) + ", factor double, prob double"))


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) from the id alone."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def mix(docs: DataFrame, topic: Column | None = None, alpha: float = 0.5, rate: float = 0.5, targets: dict[str, dict[str, float]] | None = None, most: int = MAX_CELLS, way: str = "capped", least: int = 0) -> DataFrame:
    """doc (a struct of docs' columns), source, lang, topic, n_tokens, factor, prob, sampled and copies (0 or 1 except by "copies")."""
    known = lambda c: F.coalesce(c, F.lit("<null>"))
    topic = form_topic(docs["text"]) if topic is None else topic
    rows = docs.select(F.struct("*").alias("doc"), draw(docs["doc_id"]).alias("draw"), n_words(docs["text"]).alias("n_tokens"), known(docs["source"]).alias("source"), known(docs["lang"]).alias("lang"), known(topic).alias("topic"))
    cells = staged(rows.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    out = rows.join(cell_weights(cells, alpha, rate, targets, most=most, way=way, least=least), list(DIMS))
    whole = F.floor("prob")
    return out.select("doc", *DIMS, "n_tokens", "factor", "prob", (F.col("draw") < F.col("prob")).alias("sampled"), (whole + (F.col("draw") < F.col("prob") - whole).cast("long")).alias("copies"))


def reached(mixed: DataFrame, alpha: float = 0.5, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Of mix's rows, by marginal and category: own, target, expected and drawn shares of tokens, and the expected tokens over all tokens."""
    cells = mixed.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.col("prob")).alias("e"), F.sum(F.col("n_tokens") * F.col("copies")).alias("s"))
    cells = staged(cells, "reached")
    total, e, s = (x or 1 for x in cells.agg(F.sum("tokens"), F.sum("e"), F.sum("s")).first())
    out = None
    for d in DIMS:
        sums = cells.groupBy(d).agg(*[F.sum(x).alias(x) for x in ("tokens", "e", "s")]).join(target_shares(cells, d, alpha, targets, total), d)
        part = sums.select(F.lit(d).alias("dim"), F.col(d).alias("category"), (F.col("tokens") / total).alias("own"), F.col("share").alias("target"), (F.col("e") / e).alias("expected"), (F.col("s") / s).alias("drawn"), F.lit(float(e / total)).alias("rate"))
        out = part if out is None else out.unionByName(part)
    return out


def sample(docs: DataFrame, way: str = "bounded", **kw) -> DataFrame:
    """The sampled documents, with docs' own columns only; by "copies" each as often as it counts."""
    out = mix(docs, way=way, **kw).filter("copies > 0")
    if way == "copies":
        out = out.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("doc.*")
