"""Filling containers of fixed capacity with texts (problem 6).

Texts are counted once. For each capacity the longer ones give full pieces, which fill a container each, and a rest;
rests and shorter texts are spread by hash over batches of a bounded number of windows, and each batch is divided by
multiway differencing: partial partitions are merged, those of the largest spread first, with the largest parts of one
on the smallest of the other, until one partition of near-equal windows is left. While windows come out above the
capacity the window count rises: those that came out full are kept, and the rest is differenced again, over more windows.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.tokens import VOCABULARY, count_tokens
from rollcall.session import cut


#: How full a window is, at least, that is kept when others of its batch exceed the capacity.
FULL = 0.985


def difference(sizes: Sequence[int], k: int) -> np.ndarray:
    """The window 0..k-1 of each item, by multiway differencing into k windows of near-equal sums.

    No items give an empty array; ties are broken by position.
    """
    n = len(sizes)
    if k <= 1 or n == 0:
        return np.zeros(n, dtype=np.int64)
    if n <= k:
        return np.arange(n, dtype=np.int64)
    # A partial partition holds the sums of its non-empty parts, falling, and a node for each; missing parts are empty.
    left, right = [-1] * n, [-1] * n
    order = np.argsort(-np.asarray(sizes, dtype=np.int64), kind="stable")
    # While there are fewer parts than windows the largest partition just takes up the next largest item: start there.
    first = order[:k]
    sums, nodes = np.asarray(sizes, dtype=np.int64)[first], first.astype(np.int64)
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = [(-int(sums[0] - sums[-1]), 0, sums, nodes)]
    heap += [(-int(sizes[i]), 1 + t, np.array([sizes[i]], dtype=np.int64), np.array([i], dtype=np.int64)) for t, i in enumerate(order[k:])]
    heapq.heapify(heap)
    tick = n + 1
    while len(heap) > 1:
        _, _, sa, na = heapq.heappop(heap)
        _, _, sb, nb = heapq.heappop(heap)
        a, b = len(sa), len(sb)
        over = max(0, a + b - k)
        if over:
            low_b, low_nb = sb[b - over :][::-1], nb[b - over :][::-1]
            both = sa[a - over :] + low_b
            base = len(left)
            left += na[a - over :].tolist()
            right += low_nb.tolist()
            sums = np.concatenate([sa[: a - over], both, sb[: b - over]])
            nodes = np.concatenate([na[: a - over], np.arange(base, base + over), nb[: b - over]])
        else:
            sums, nodes = np.concatenate([sa, sb]), np.concatenate([na, nb])
        rank = np.argsort(-sums, kind="stable")
        sums, nodes = sums[rank], nodes[rank]
        spread = int(sums[0] - (sums[-1] if len(sums) == k else 0))
        heapq.heappush(heap, (-spread, tick, sums, nodes))
        tick += 1
    out = np.empty(n, dtype=np.int64)
    for window, node in enumerate(heap[0][3].tolist()):
        todo = [node]
        while todo:
            x = todo.pop()
            if x < n:
                out[x] = window
            else:
                left_x, right_x = left[x], right[x]
                todo += (left_x, right_x)
    return out


def pack(sizes: Sequence[int], capacity: int) -> np.ndarray:
    """The container of each item, none above capacity; every size must lie in 1..capacity.

    The items are divided into as many windows as their sum needs at least. While a window exceeds the capacity the
    count rises: windows that fit are kept, fullest first, as long as the rest, divided anew into one window more than
    it needs, can take what is left over; so the division ends, and only the last windows have room.
    """
    sizes = np.asarray(sizes, dtype=np.int64)
    out = np.empty(len(sizes), dtype=np.int64)
    todo, base, more = np.arange(len(sizes)), 0, 0
    while len(todo):
        own = sizes[todo]
        k = min(len(todo), int(-(-own.sum() // capacity)) + more)
        window = difference(own, k)
        total = np.bincount(window, weights=own, minlength=k).astype(np.int64)
        if total.max() <= capacity:
            out[todo] = base + window
            break
        # Windows filled to a share that near-equal windows can't better are done; the others are divided again.
        full = np.nonzero((total <= capacity) & (total >= FULL * capacity))[0]
        if len(full) < max(1, k // 50):
            more += max(1, k // 200)
            continue
        place = np.full(k, -1)
        place[full] = np.arange(len(full))
        done = place[window] >= 0
        out[todo[done]] = base + place[window[done]]
        base += len(full)
        todo, more = todo[~done], 0
    return out


def pack_documents(
    docs: DataFrame,
    packs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    path: str = VOCABULARY,
    windows: int = 512,
    max_items: int = 8_000,
) -> DataFrame:
    """(pack_id, container_id, key, piece, start_token, n_tokens): every token of every text, once for each pack.

    A text is cut only where it alone exceeds the capacity: into full pieces and a rest. Texts without tokens (null,
    empty) take no room and get no row. packs (pack_id, capacity_tokens) is a small parameter table; rows with a
    missing or non-positive capacity are ignored. Batches hold about `windows` containers and at most about max_items
    items. Container ids are unique within a pack.
    """
    sized = cut(count_tokens(docs, key, text, path).filter("n_tokens > 0"))
    caps = packs.filter("capacity_tokens > 0").select("pack_id", F.col("capacity_tokens").cast("long").alias("cap")).dropDuplicates(["pack_id"])
    items = sized.join(F.broadcast(caps) if caps.count() <= 1_000 else caps)
    items = items.withColumns({"full": F.floor(F.col("n_tokens") / F.col("cap")), "rest": F.pmod("n_tokens", F.col("cap"))})
    whole = items.filter("full > 0").select("pack_id", key, "cap", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece"))
    whole = whole.select("pack_id", F.concat_ws("-", F.lit("f"), F.col(key), F.col("piece")).alias("container_id"), key, F.col("piece").cast("int").alias("piece"), (F.col("piece") * F.col("cap")).alias("start_token"), F.col("cap").alias("n_tokens"))
    loose = items.filter("rest > 0").select("pack_id", "cap", key, F.col("full").cast("int").alias("piece"), (F.col("full") * F.col("cap")).alias("start_token"), F.col("rest").alias("n_tokens"))
    per = loose.groupBy("pack_id").agg(F.greatest(F.ceil(F.sum("n_tokens") / (windows * F.first("cap"))), F.ceil(F.count("*") / max_items)).alias("batches"))
    loose = loose.join(per, "pack_id").withColumn("batch", F.pmod(F.xxhash64(key), F.col("batches")))
    kind = dict(docs.dtypes)[key]
    pack_kind = dict(packs.dtypes)["pack_id"]

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, "piece"], kind="stable")
        bins = pack(pdf["n_tokens"].to_numpy(), int(pdf["cap"].iloc[0]))
        pdf["container_id"] = [f"b{pdf['batch'].iloc[0]}-{x}" for x in bins]
        return pdf[["pack_id", "container_id", key, "piece", "start_token", "n_tokens"]]

    filled = loose.groupBy("pack_id", "batch").applyInPandas(fill, f"pack_id {pack_kind}, container_id string, `{key}` {kind}, piece int, start_token bigint, n_tokens bigint")
    return filled.unionByName(whole)


def fill_report(packed: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack_id, containers, tokens, fill): how many containers each capacity took and how full they are."""
    used = packed.groupBy("pack_id").agg(F.count_distinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
    return used.join(packs, "pack_id").select("pack_id", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))
