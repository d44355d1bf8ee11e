"""Resolving names to indexed persons, refusing where a key is ambiguous.

The index is one table of keys; a query explodes to its keys in order of precedence, meets the index in one equi-join,
and the first key present decides: with one target it resolves, with several it refuses and no later key is tried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions import names as N

#: Key kinds in order of precedence.
EXACT, FULL, FIRST_LAST, INITIAL_LAST = "exact", "full", "first_last", "initial_last"


def person_forms(persons: DataFrame) -> DataFrame:
    """(target, form): the primary name and each alias of a person, under the primary name."""
    alias = persons.filter(F.coalesce("aliases", F.lit("")) != "").select(F.col("primary_name").alias("target"), F.explode(F.split("aliases", r"\|")).alias("form"))
    return persons.select(F.col("primary_name").alias("target"), F.col("primary_name").alias("form")).unionAll(alias).filter("form is not null and form <> ''")


def _keys(form: Column) -> list[tuple[str, Column]]:
    full = N.fold_name(form)
    return [(EXACT, N.fold_keep_suffix(form)), (FULL, full)]


def key_table(forms: DataFrame) -> DataFrame:
    """(kind, key, target) of every key of every form, distinct; empty keys left out."""
    df = forms.select("target", *[k.alias(name) for name, k in _keys(F.col("form"))])
    df = df.withColumn("p", N.name_parts(F.col(FULL)))
    pairs = F.array(
        F.struct(F.lit(EXACT).alias("kind"), F.col(EXACT).alias("key")),
        F.struct(F.lit(FULL).alias("kind"), F.col(FULL).alias("key")),
        F.struct(F.lit(FIRST_LAST).alias("kind"), F.concat("p.first", F.lit(" "), "p.last").alias("key")),
        F.struct(F.lit(INITIAL_LAST).alias("kind"), F.concat(F.substring("p.first", 1, 1), F.lit(" "), "p.last").alias("key")),
    )
    return df.filter(F.col(FULL) != "").select("target", F.explode(pairs).alias("k")).select("k.kind", "k.key", "target").filter(F.coalesce("key", F.lit("")) != "").distinct()


def index(keys: DataFrame) -> DataFrame:
    """(kind, key, n, target): how many targets a key has, and the least of them."""
    return keys.groupBy("kind", "key").agg(F.count("*").alias("n"), F.min("target").alias("target"))


def weak_names(authors: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, target) of names harvested from papers that no strong form covers, by full or exact key; the first
    spelling of each full key wins."""
    df = authors.select(F.col("author").alias("target"), *[k.alias(name) for name, k in _keys(F.col("author"))]).filter(F.col(FULL) != "").distinct()
    df = df.join(keys.filter(F.col("kind") == FULL).select(F.col("key").alias(FULL)).distinct(), FULL, "left_anti")
    df = df.join(keys.filter(F.col("kind") == EXACT).select(F.col("key").alias(EXACT)).distinct(), EXACT, "left_anti")
    return df.groupBy(F.col(FULL).alias("key")).agg(F.min("target").alias("target"))


def query_keys(asked: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name, rank, kind, k): the keys of each query in order of precedence.

    The exact key counts only for names with a homonym number, the initial key only where the given name is one letter.
    """
    df = asked.select(key, F.col(name).alias("name"), N.fold_name(F.col(name)).alias("f"), N.fold_keep_suffix(F.col(name)).alias("e"))
    df = df.withColumn("p", N.name_parts(F.col("f")))
    numbered = F.trim(F.coalesce("name", F.lit(""))).rlike(r"\s\d{4}$")
    tries = F.array(
        F.struct(F.lit(1).alias("rank"), F.lit(EXACT).alias("kind"), F.when(numbered, F.col("e")).alias("k")),
        F.struct(F.lit(2).alias("rank"), F.lit(FULL).alias("kind"), F.col("f").alias("k")),
        F.struct(F.lit(3).alias("rank"), F.lit(FIRST_LAST).alias("kind"), F.concat("p.first", F.lit(" "), "p.last").alias("k")),
        F.struct(F.lit(4).alias("rank"), F.lit(INITIAL_LAST).alias("kind"), F.when(F.length("p.first") == 1, F.concat("p.first", F.lit(" "), "p.last")).alias("k")),
    )
    return df.select(key, "name", F.col("f").alias("folded"), F.explode(F.filter(tries, lambda t: F.coalesce(t["k"], F.lit("")) != "")).alias("t")).select(key, "name", "folded", "t.*")


def resolve(asked: DataFrame, key: str, name: str, idx: DataFrame) -> DataFrame:
    """(key, target, how): how is the kind of key, ambiguous_<kind>, no_match, or empty for names without letters.

    Null names count as empty; repeated rows of one key resolve once.
    """
    tries = query_keys(asked, key, name).join(idx.withColumnRenamed("key", "k"), ["kind", "k"])
    first = tries.groupBy(key).agg(F.min(F.struct("rank", "kind", "n", "target")).alias("m"))
    own = asked.select(key, (N.fold_name(F.col(name)) == "").alias("blank")).groupBy(key).agg(F.bool_and("blank").alias("blank"))
    j = own.join(first, key, "left")
    one = (F.col("m.n") == 1) | (F.col("m.kind") == EXACT)
    how = F.when(F.col("blank"), "empty").when(F.col("m").isNull(), "no_match").when(one, F.col("m.kind")).otherwise(F.concat(F.lit("ambiguous_"), F.col("m.kind")))
    return j.select(key, F.when(one & ~F.col("blank"), F.col("m.target")).alias("target"), how.alias("how"))


def candidates(asked: DataFrame, key: str, name: str, keys: DataFrame) -> DataFrame:
    """(key, target): every person a name could be, by its full and its first and last key."""
    tries = query_keys(asked, key, name).filter(F.col("kind").isin(FULL, FIRST_LAST))
    return tries.join(keys.withColumnRenamed("key", "k"), ["kind", "k"]).select(key, "target").distinct()


def settle_by_city(asked: DataFrame, key: str, city: str, resolved: DataFrame, could: DataFrame, places: DataFrame) -> DataFrame:
    """(key, target, how): where the answer doesn't name the city and exactly one candidate does, that one.

    places (target, affiliation) holds what is known of each person.
    """
    want = asked.select(key, N.city_key(F.col(city)).alias("want")).dropDuplicates([key])
    named = could.join(want, key).join(places, "target").filter(N.city_named_in(F.col("affiliation"), F.col("want"))).select(key, "target").distinct()
    hits = named.groupBy(key).agg(F.count("*").alias("n"), F.min("target").alias("only"))
    now = resolved.join(named.select(key, "target", F.lit(True).alias("fits")), [key, "target"], "left").join(hits, key, "left")
    switch = F.col("fits").isNull() & (F.col("n") == 1)
    return now.select(key, F.when(switch, F.col("only")).otherwise(F.col("target")).alias("target"), F.when(switch, "affiliation").otherwise(F.col("how")).alias("how"))
