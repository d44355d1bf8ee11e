"""An append-only ledger of decisions: stable ids, idempotent appends, current state, history and flips."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The fields that make a decision what it is; notes and confidence don't.
FIELDS = ("city", "person", "decision", "reason_code", "rule", "by", "evidence")


def with_id(entries: DataFrame) -> DataFrame:
    """Adds id: twelve hex digits over the fields; null counts as '' and keeps its place."""
    return entries.withColumn("id", F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FIELDS])), 1, 12))


def append(ledger: DataFrame, entries: DataFrame, order: str = "ord") -> DataFrame:
    """The entries that the ledger doesn't hold yet, each id once, by its first row."""
    new = with_id(entries)
    first = new.groupBy("id").agg(F.min_by(F.struct(*new.columns), order).alias("e")).select("e.*")
    return first.join(ledger.select("id"), "id", "left_anti")


def supersedes(ledger: DataFrame, order: str = "ord") -> DataFrame:
    """Adds supersedes: the id of the entry before, of the same city and person."""
    return ledger.withColumn("supersedes", F.lag("id").over(Window.partitionBy("city", "person").orderBy(order, "id")))


def current(ledger: DataFrame, order: str = "ord") -> DataFrame:
    """(city, person, decision, id): the last entry of each."""
    return ledger.groupBy("city", "person").agg(F.max_by(F.struct("decision", "id"), F.struct(order, "id")).alias("m")).select("city", "person", "m.*")


def history(ledger: DataFrame, needle: str) -> DataFrame:
    """Entries whose person holds the needle, whatever the case."""
    return ledger.filter(F.contains(F.lower(F.col("person").cast("string")), F.lit(needle.lower())))


def flips(ledger: DataFrame, order: str = "ord") -> DataFrame:
    """(city, person, path): those decided in more than one way, and the decisions in order."""
    g = ledger.groupBy("city", "person").agg(F.array_sort(F.collect_list(F.struct(order, "id", "decision"))).alias("l"))
    path = F.transform("l", lambda x: x["decision"])
    return g.filter(F.size(F.array_distinct(path)) > 1).select("city", "person", F.array_join(path, " -> ").alias("path"))
