"""Mixing sources to target weights (problem 7).

A softmax classifier, fitted on a bounded sample of labelled rows, gives each document its posterior over the domains.
Rates of 0 to the source's repeat limit are then fitted by projected-gradient least squares, so that the expected token
totals of the domains and the totals of the labelled sources both match the targets. The gradient is gathered before it is
projected: the rate of a document is its start less one inner product with the steps so far, clipped, so a pass over the
documents costs the same at every step, a step needs only sums over all documents, and nothing per document is kept on
the driver. The steps' directions are combined by Anderson's rule. Rates become whole numbers by hashed rounding to one of
the two neighbours; of the shifts of a source's hash that are tried on a histogram the one counts that comes nearest to
its goal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.tokens import VOCABULARY, token_ids
from rollcall.session import cut, ship

#: Hashed token features, and classes of length beside them.
FEATURES, LENGTHS = 2_048, 40


def features(ids: list[int], dim: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Hashed, damped and normed token counts of a text, and its class of length, as (places, values)."""
    if not ids:
        return np.empty(0, dtype=np.int64), np.empty(0)
    places, counts = np.unique((np.asarray(ids, dtype=np.int64) * 2_654_435_761 >> 7) % dim, return_counts=True)
    values = np.log1p(counts)
    values /= np.sqrt((values**2).sum())
    size = dim + min(LENGTHS - 1, int(2 * np.log2(len(ids))))
    return np.append(places, size), np.append(values, 0.5)


def fit_softmax(x: np.ndarray, y: np.ndarray, weight: np.ndarray, k: int, steps: int = 150, ridge: float = 1e-3) -> np.ndarray:
    """(k, dim + 1) weights of a softmax regression of rows that count by weight, by accelerated full-batch gradient
    steps."""
    weight = (weight / weight.sum()).astype(x.dtype)[:, None]
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    w = np.zeros((k, x.shape[1]), dtype=x.dtype)
    ahead, t = w.copy(), 1.0
    goal = np.eye(k, dtype=x.dtype)[y]
    for _ in range(steps):
        z = x @ ahead.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = ahead - 3.0 * ((weight * (p - goal)).T @ x + ridge * ahead)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w


def posteriors(docs: DataFrame, names: list[str], key: str, text: str, source: str, path: str, sample: int, most: int, dim: int = FEATURES) -> DataFrame:
    """(key, source, n_tokens, q): q the posterior over names. The classifier sees about `sample` rows of each source, at
    most about `most` in all, chosen by hash; every row is then scored."""
    kinds = dict(docs.dtypes)
    k, width = len(names), dim + LENGTHS
    sample = min(sample, max(1, most // k))
    counts = {r[source]: r["n"] for r in docs.groupBy(source).agg(F.count("*").alias("n")).collect()}
    part = {s: min(1.0, sample / max(1, counts.get(s, 0))) for s in names}
    share = F.create_map(*[x for s in names for x in (F.lit(s), F.lit(part[s]))])
    drawn = docs.filter(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1_000_000)) < share[F.col(source)] * 1_000_000)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = [token_ids(t, path) for t in b[text]]
            both = [features(x, dim) for x in ids]
            yield pd.DataFrame({source: b[source], "at": [x for x, _ in both], "v": [y for _, y in both], "n": [float(len(x)) for x in ids]})

    rows = drawn.select(source, text).mapInPandas(encode, f"`{source}` string, at array<int>, v array<float>, n double").filter("n > 0").limit(2 * sample * k).collect()
    place = {s: i for i, s in enumerate(names)}
    x = np.zeros((len(rows), width), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, r["at"]] = r["v"]
    # A row counts by its tokens and by the rows it stands for, so that expected and labelled tokens agree overall.
    weight = np.array([r["n"] / part[r[source]] for r in rows])
    w = fit_softmax(x, np.array([place[r[source]] for r in rows], dtype=np.int64), weight, k) if rows else np.zeros((k, width + 1), dtype=np.float32)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, qs = [], []
            for t in b[text]:
                ids = token_ids(t, path)
                at, v = features(ids, dim)
                z = w[:, at] @ v + w[:, width]
                p = np.exp(z - z.max())
                n.append(len(ids))
                qs.append((p / p.sum()).astype(float))
            yield pd.DataFrame({key: b[key], source: b[source], "n_tokens": n, "q": qs})

    return docs.select(key, source, text).mapInPandas(score, f"`{key}` {kinds[key]}, `{source}` string, n_tokens bigint, q array<double>")


def anderson(points: list[np.ndarray], images: list[np.ndarray], depth: int = 6) -> np.ndarray:
    """The next point of a fixed-point iteration from its last points and their images."""
    p, g = np.array(points[-depth:]), np.array(images[-depth:])
    f = g - p
    if len(f) == 1:
        return g[0]
    df, dg = np.diff(f, axis=0).T, np.diff(g, axis=0).T
    gamma = np.linalg.lstsq(df, f[-1], rcond=1e-8)[0]
    return g[-1] - dg @ gamma


def fit_mix(
    docs: DataFrame,
    targets: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    path: str = VOCABULARY,
    sample: int = 400,
    steps: int = 24,
    max_sources: int = 1_000,
    most: int = 8_000,
    near: float = 1e-4,
    damp: float = 0.02,
) -> DataFrame:
    """(key, source, n_tokens, rate, repeats, q, d): the fitted rate and whole number of uses of each document of the
    targets' sources that has tokens, with its posterior q over the sources in their order and the place d of its own.

    See `mix_documents` for the parameters.
    """
    ship(docs.sparkSession)
    goals = targets.filter("target_share > 0 and max_repeats > 0").select(source, "target_share", "max_repeats").limit(max_sources + 1).collect()
    if len(goals) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    kinds = dict(docs.dtypes)
    none = docs.sparkSession.createDataFrame([], f"`{key}` {kinds[key]}, `{source}` string, n_tokens bigint, rate double, repeats bigint, q array<double>, d int")
    names = sorted(r[source] for r in goals)
    if not names:
        return none
    asked = docs.filter(F.col(source).isin(names))
    base = cut(posteriors(asked, names, key, text, source, path, sample, most).filter("n_tokens > 0"))
    k = len(names)
    place = F.create_map(*[x for i, s in enumerate(names) for x in (F.lit(s), F.lit(i))])[F.col(source)]
    base = base.withColumn("d", place)
    sums = base.groupBy("d").agg(F.sum("n_tokens").alias("n"), *[F.sum(F.col("q")[i] * F.col("n_tokens")).alias(f"q{i}") for i in range(k)]).collect()
    hard, soft = np.zeros(k), np.zeros(k)
    for r in sums:
        hard[r["d"]] = r["n"]
        soft += np.array([r[f"q{i}"] for i in range(k)])
    cap = np.array([float({r[source]: r["max_repeats"] for r in goals}[s]) for s in names])
    share = np.array([float({r[source]: r["target_share"] for r in goals}[s]) for s in names]) * (hard > 0)
    if not share.sum():
        return none
    share /= share.sum()
    total = min(cap[i] * hard[i] / share[i] for i in range(k) if share[i])
    goal = total * share
    start = np.divide(goal, hard, out=np.zeros(k), where=hard > 0)
    per = lambda v: F.element_at(F.array(*[F.lit(float(x)) for x in v]), F.col("d") + 1)

    def rate(point: np.ndarray) -> Column:
        """The start less the steps gathered for the posterior and for the own source, clipped."""
        inner = F.aggregate(F.zip_with(F.array(*[F.lit(float(x)) for x in point[:k]]), "q", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        return F.greatest(F.lit(0.0), F.least(per(cap), per(start - point[k:]) - inner))

    def totals(point: np.ndarray) -> np.ndarray:
        """The expected totals of the domains, then those of the labelled sources, at a point."""
        rated = base.select("d", "q", (rate(point) * F.col("n_tokens")).alias("r"))
        by = rated.groupBy("d").agg(F.sum("r").alias("r"), *[F.sum(F.col("q")[i] * F.col("r")).alias(f"q{i}") for i in range(k)]).collect()
        out = np.zeros(2 * k)
        for r in by:
            out[:k] += np.array([r[f"q{i}"] for i in range(k)])
            out[k + r["d"]] = r["r"]
        return out

    # Residuals are taken relative to what a domain holds, which makes a step of one about the right length.
    point, points, images = np.zeros(2 * k), [], []
    best, least = point, np.inf
    # The labelled totals bind; those of the domains are met as far as damp, their share of the squares, lets them.
    for _ in range(steps):
        off = totals(point) - np.concatenate([goal, goal])
        image = point + 0.7 * off / np.maximum(np.concatenate([soft, hard]), 1.0)
        image[:k] -= 0.7 * damp * point[:k]
        size = np.abs(image - point).max()
        if size < least:
            best, least = point, size
        if size < near:
            break
        points.append(point)
        images.append(image)
        point = anderson(points, images)
    rated = cut(base.withColumns({"rate": rate(best), "most": per(cap)}))
    return _whole_numbers(rated, key, {i: float(goal[i]) for i in range(k)})


def _whole_numbers(rated: DataFrame, key: str, goal: dict[int, float], shifts: int = 1_024) -> DataFrame:
    """repeats = floor(rate + u), u hashed in [0, 1) and shifted around that circle per source.

    Each document takes a neighbour of its rate, the upper one for as many shifts as its fraction says. The shift of a
    source is the one of `shifts` at which its tokens come nearest to the goal, found on one histogram.
    """
    u = F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    df = rated.withColumns({"u": u, "low": F.floor("rate"), "part": F.col("rate") - F.floor("rate")})
    # The upper neighbour is taken for shifts from 1 - part - u up to 1 - u, around the circle.
    at = lambda c: F.pmod(F.ceil(c * shifts), F.lit(shifts)).cast("int")
    begin, end = at(F.lit(1.0) - F.col("part") - F.col("u")), at(F.lit(1.0) - F.col("u"))
    moves = df.select("d", F.col("n_tokens").alias("n"), F.explode(F.array(F.struct(begin.alias("b"), F.lit(1).alias("s")), F.struct(end.alias("b"), F.lit(-1).alias("s")))).alias("m"))
    moves = moves.groupBy("d", "m.b").agg(F.sum(F.col("m.s") * F.col("n")).alias("n")).collect()
    at_zero = df.groupBy("d").agg(F.sum(F.col("n_tokens") * (F.col("low") + F.when(begin > end, 1).otherwise(0))).alias("n")).collect()
    change = {d: np.zeros(shifts) for d in goal}
    for r in moves:
        change[r["d"]][r["b"]] += r["n"]
    shift = dict.fromkeys(goal, 0.0)
    for r in at_zero:
        run = r["n"] + np.cumsum(change[r["d"]])
        shift[r["d"]] = float(np.abs(run - goal[r["d"]]).argmin()) / shifts
    theta = F.element_at(F.array(*[F.lit(shift[d]) for d in sorted(goal)]), F.col("d") + 1)
    bucket = (theta * shifts).cast("int")
    upper = F.when(begin <= end, (bucket >= begin) & (bucket < end)).otherwise((bucket >= begin) | (bucket < end))
    whole = (F.col("low") + F.when(upper, 1).otherwise(0)).cast("long")
    return df.withColumn("repeats", F.least(whole, F.col("most").cast("long"))).drop("u", "low", "part", "most")


def mix_documents(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", path: str = VOCABULARY, **options) -> DataFrame:
    """(key, source, n_tokens, repeats, rate, own_posterior), repeats >= 1: which documents to use how often.

    targets (source, target_share, max_repeats) is a parameter table of at most max_sources rows; a share that is null
    or not positive, or a source without tokens, takes no part. The total is the largest that the repeat limits allow
    for the given shares. Documents of other sources, and those without tokens, are left out. Options: sample bounds the
    labelled rows per source that the classifier is fitted on and most those of all sources, steps the passes of the
    fit, near the largest move at which it ends, damp how little the expected totals count against the least change of
    rates.
    """
    fitted = fit_mix(docs, targets, key, text, source, path, **options).filter("repeats > 0")
    return fitted.select(key, source, "n_tokens", "repeats", "rate", F.col("q")[F.col("d")].alias("own_posterior"))


def mix_report(fitted: DataFrame, targets: DataFrame, source: str = "source") -> DataFrame:
    """(source, target_share, actual_share, expected_share, fitted_share, tokens, documents, most_repeats), also for
    sources of which nothing was used.

    actual_share is that of the labelled tokens used, expected_share that of the domain by the posteriors of what is used,
    fitted_share that of the domain by the posteriors at the fitted rates, before rounding. The last two are 0 where
    fitted has no posteriors q, as the rows of mix_documents.
    """
    if "q" not in fitted.columns:
        fitted = fitted.withColumn("q", F.array().cast("array<double>"))
    names = targets.filter("target_share > 0 and max_repeats > 0").select(source)
    order = names.groupBy().agg(F.sort_array(F.collect_list(source)).alias("names"))  # a parameter table, bounded by fit_mix
    soft = fitted.select(F.posexplode("q").alias("i", "q"), (F.col("n_tokens") * F.col("repeats")).alias("used"), (F.col("n_tokens") * F.col("rate")).alias("rated"))
    soft = soft.groupBy("i").agg(F.sum(F.col("q") * F.col("used")).alias("expected"), F.sum(F.col("q") * F.col("rated")).alias("fitted"))
    soft = soft.join(order.select(F.posexplode("names").alias("i", source)), "i").drop("i")
    got = fitted.filter("repeats > 0").groupBy(source).agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    out = targets.select(source, "target_share").join(got, source, "left").join(soft, source, "left")
    every = out.agg(*[F.sum(c).alias(f"all_{c}") for c in ("tokens", "expected", "fitted")])
    out = out.withColumn("one", F.lit(1)).join(every.withColumn("one", F.lit(1)), "one")
    part = lambda c, name: F.coalesce(F.col(c) / F.col(f"all_{c}"), F.lit(0.0)).alias(name)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(source, "target_share", part("tokens", "actual_share"), part("expected", "expected_share"), part("fitted", "fitted_share"), zero("tokens"), zero("documents"), zero("most_repeats"))
