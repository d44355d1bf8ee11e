"""Greedy seed clustering: largest first, each takes the unused points within a radius of itself, not of its members.

The outcome depends on the order, but only along chains of points within the radius of each other: the connected
components of the neighbour graph are independent and are replayed one by one, in the global order, by a grouped
function. A component is as large as an unbroken chain of neighbours and carries ids and sizes only.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.operators.ranges import within_km
from rollcall.session import cut


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component; nodes without edges are their own."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(nodes.select(F.col("node"), F.col("node").alias("root")))
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        low = label.join(near, "node", "left").select("node", "root", F.least("root", F.coalesce("near", "root")).alias("low"))
        far = label.select(F.col("node").alias("low"), F.col("root").alias("far"))
        new = cut(low.join(far, "low").select("node", "root", F.least("low", "far").alias("new")))
        moved = new.filter("new <> root").limit(1).count()
        label = new.select("node", F.col("new").alias("root"))
        if not moved:
            return label


def greedy_clusters(points: DataFrame, km: float = 10.0) -> DataFrame:
    """(id, seed) of points (id, lat, lon, size); strictly nearer than km. Ties in size go to the smaller id.

    Points without usable coordinates are left out; an empty table gives no rows.
    """
    p = points.filter("lat is not null and lon is not null").select("id", "lat", "lon", "size")
    pairs = within_km(p.select(F.col("id").alias("lid"), F.col("lat").alias("llat"), F.col("lon").alias("llon")), p.select(F.col("id").alias("rid"), F.col("lat").alias("rlat"), F.col("lon").alias("rlon")), km)
    edges = cut(pairs.filter((F.col("km") < km) & (F.col("lid") < F.col("rid"))).select(F.col("lid").alias("a"), F.col("rid").alias("b")))
    part = components(edges, p.select(F.col("id").alias("node")))
    sized = p.select("id", "size").join(part.withColumnRenamed("node", "id"), "id")
    around = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("id", "other").groupBy("id").agg(F.collect_list("other").alias("others"))
    rows = sized.join(around, "id", "left")
    kind = dict(points.dtypes)["id"]

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "id"], ascending=[False, True])
        others = dict(zip(pdf["id"], pdf["others"], strict=True))
        seed: dict = {}
        for i in pdf["id"]:
            if i not in seed:
                seed[i] = i
                for o in others[i] if others[i] is not None else ():
                    seed.setdefault(o, i)
        return pd.DataFrame({"id": list(seed), "seed": list(seed.values())})

    return rows.groupBy("root").applyInPandas(replay, f"id {kind}, seed {kind}")
