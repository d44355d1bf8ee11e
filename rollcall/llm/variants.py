"""Linking variant spellings of one name (problem 5).

Suffix blocking, on distinct words before names and on distinct names before records. Every suffix of a token is
indexed; as suffixes alone are overly common, each is refined with the head of the token before it, one letter being left
out between: so a block holds just the tokens that differ by one slip, wherever it lies, and none needs to be given up
for its size. Names then meet on two tokens, each in its own spelling, with a slip, or as a full form, and on a token
with an initial where one side gives no more; they are compared by longest-common-subsequence ratio over aligned
tokens. Records of matching names meet where they show something in common besides, and any record meets the indexed
persons of its name; what they show tells namesakes apart. All meetings are equi-joins, which Spark splits where a key
is hot; no group is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.persons import _SHORT, describe, mark_wide_places, name_match
from rollcall.operators.clusters import components as graph_components
from rollcall.session import cut, ship

#: Least length of a name token, and of a place word, that may carry a slip.
SLIP, PLACE_SLIP = 4, 6


def slips(words: DataFrame, least: int) -> DataFrame:
    """(word, others array): the other words of the table that differ by one slip: a letter more, less, other or moved.

    words (word) may repeat. Both need `least` letters. Every suffix is indexed with the head before it, with and
    without the letter between; two words share an entry exactly if their longest common subsequence leaves out one
    letter of either at most. Words without a slip partner have no row.
    """
    w = words.filter(F.length("word") >= least).select("word").distinct()
    n = F.length("word")
    cuts = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, n))))
    index = w.select("word", F.explode(F.array_distinct(F.concat(F.array(F.xxhash64("word")), cuts))).alias("h"))
    both = index.join(index.withColumnRenamed("word", "other"), "h").filter("word <> other")
    return both.groupBy("word").agg(F.collect_set("other").alias("others"))


def _classes(words: DataFrame) -> DataFrame:
    """(word, own): the word, rn read as m, with the full forms it is short for."""
    short = words.sparkSession.createDataFrame([(x, sorted(y)) for x, y in sorted(_SHORT.items())], "word string, full array<string>")
    own = F.concat(F.array("word"), F.coalesce("full", F.array().cast("array<string>")))
    return words.join(F.broadcast(short), "word", "left").select("word", F.array_distinct(F.transform(own, lambda x: F.replace(x, F.lit("rn"), F.lit("m")))).alias("own"))


#: Names of more tokens than this meet on two of them, as their triples would be too many.
TRIPLES = 6


def name_entries(names: DataFrame) -> DataFrame:
    """(n, h, asks, gives) of distinct names (n): what each is indexed under. A name that asks meets those that give.

    Every token of the shorter of two names has its own in the longer: as a word (its class, with slips), or as an
    initial or cut token of one side. So two names of three tokens or more share three words, two words and an initial, or
    a word and two initials; only where one name has two tokens do they meet on two words, or on a word and an initial. As a whole word can't go with an initial while the family name is left over, a middle initial beside a
    given name meets short words alone. Of two tokens a slip apart the rarer stands for the commoner too, so that a
    common token, however often it is misspelled, is indexed under few.
    """
    each = names.select("n", F.posexplode(F.split(F.substring_index("n", "|", 1), " ")).alias("i", "t"))
    each = each.withColumn("word", F.rtrim("t", F.lit(".")))
    words = cut(each.groupBy("word").agg(F.count("*").alias("seen")))
    own = _classes(words.select("word"))
    near = slips(words, SLIP).select("word", F.explode("others").alias("o")).join(words, "word").join(words.select(F.col("word").alias("o"), F.col("seen").alias("more")), "o")
    near = near.filter(F.struct("more", "o") > F.struct("seen", "word")).select("word", "o")
    up = near.join(own.withColumnRenamed("word", "o"), "o").groupBy("word").agg(F.array_distinct(F.flatten(F.collect_list("own"))).alias("up"))
    first = lambda c: F.substring(c, 1, 1)
    entry = cut(own.join(up, "word", "left").select("word", F.array_union("own", F.coalesce("up", F.array().cast("array<string>"))).alias("of")))
    token = F.struct("i", "word", "t", ((F.length("word") == 1) | (F.col("t") != F.col("word"))).alias("cut"), "of")
    whole = cut(each.join(entry, "word").groupBy("n").agg(F.sort_array(F.collect_list(token)).alias("ts")))
    size = F.size("ts")
    none, yes, no = F.array().cast("array<bigint>"), F.lit(True), F.lit(False)
    part = lambda hashes, asks, gives: F.transform(hashes, lambda h: F.struct(h.alias("h"), asks.alias("asks"), gives.alias("gives")))
    key = lambda mark, *c: F.xxhash64(F.lit(mark), *c)

    def crossed(mark: str, p: Column, q: Column) -> Column:
        return F.flatten(F.transform(p, lambda x: F.transform(q, lambda y: key(mark, F.least(x, y), F.greatest(x, y)))))

    single = whole.filter(size == 1).select("n", key("1", F.col("ts")[0]["word"]).alias("h"), yes.alias("asks"), yes.alias("gives"))
    two = whole.filter(size > 1).select("n", "ts", ((size == 2) | (size > TRIPLES)).alias("wide"), (size == 2).alias("short"), F.element_at("ts", -1)["t"].alias("last"), F.explode("ts").alias("a"))
    two = two.select("*", F.explode(F.filter("ts", lambda t: t.i != F.col("a.i"))).alias("b"))
    full = F.when((F.col("a.i") < F.col("b.i")) & (F.length("a.word") > 1) & (F.length("b.word") > 1), F.array_distinct(crossed("=", F.col("a.of"), F.col("b.of")))).otherwise(none)
    initial = lambda mark: F.transform("a.of", lambda x: key(mark, x, first("b.word")))
    solid = F.length("a.word") >= SLIP
    # Of names with an initial, those of two tokens ask all, and the middle initials of longer ones are asked.
    plain = F.when(solid, initial("^")).otherwise(none)
    ending = (F.col("a.t") == F.col("last")) | (F.col("b.t") == F.col("last")) | (F.length("b.word") > 1)
    asks = F.when(solid & F.col("wide") & ~F.col("b.cut"), F.concat(initial("^2"), F.when(~F.col("short") | (F.length("b.t") < 4), initial("^3")).otherwise(none))).otherwise(none)
    asked = F.when(solid & ~F.col("short") & F.col("b.cut"), F.when(ending, initial("^2")).otherwise(initial("^3"))).otherwise(none)
    pairs = two.select("n", F.explode(F.concat(part(full, F.col("wide"), yes), part(plain, F.col("wide") & F.col("b.cut"), yes), part(asks, yes, no), part(asked, no, yes))).alias("e"))
    three = whole.filter((size > 2) & (size <= TRIPLES)).select("n", "ts", F.explode("ts").alias("a"))
    three = three.select("*", F.explode(F.filter("ts", lambda t: t.i > F.col("a.i"))).alias("b"))
    three = three.select("*", F.explode(F.filter("ts", lambda t: (t.i != F.col("a.i")) & (t.i != F.col("b.i")))).alias("c"))
    # c is the token that differs in kind: a word with two words, an initial with two words, a word with two initials.
    words3 = F.flatten(F.transform("a.of", lambda x: F.flatten(F.transform("b.of", lambda y: F.transform("c.of", lambda z: F.xxhash64(F.lit("==="), F.array_sort(F.array(x, y, z))))))))
    whole2 = (F.length("a.word") > 1) & (F.length("b.word") > 1)
    words3 = F.when(whole2 & (F.length("c.word") > 1) & (F.col("b.i") < F.col("c.i")), F.array_distinct(words3)).otherwise(none)
    words2 = F.when(whole2, F.array_distinct(F.transform(crossed("=", F.col("a.of"), F.col("b.of")), lambda h: key("==", h, first("c.word"))))).otherwise(none)
    heads = lambda mark, u, v: F.when(F.length("c.word") >= SLIP, F.transform("c.of", lambda x: key(mark, x, u, v))).otherwise(none)
    one, other = first("a.word"), first("b.word")
    cut_one, cut_other = F.when(F.col("a.cut"), one).otherwise(other), F.when(F.col("a.cut"), other).otherwise(one)
    mixed = lambda u, v: F.when(F.col("a.cut") != F.col("b.cut"), heads("^1", u, v)).otherwise(none)
    triples = part(words3, yes, yes), part(words2, F.col("c.cut"), yes), part(heads("^^", F.least(one, other), F.greatest(one, other)), F.col("a.cut") & F.col("b.cut"), yes), part(mixed(cut_one, cut_other), yes, no), part(mixed(cut_other, cut_one), no, yes)
    triples = three.select("n", F.explode(F.concat(*triples)).alias("e"))
    return single.unionAll(pairs.select("n", "e.*")).unionAll(triples.select("n", "e.*"))


def name_meetings(names: DataFrame) -> DataFrame:
    """(x, y), x < y, of distinct names (n): all that `name_match` may accept, and few besides."""
    entries = cut(name_entries(names))
    x = entries.filter("asks").select("h", F.col("n").alias("x"))
    y = entries.filter("gives").select("h", F.col("n").alias("y"), "asks")
    number = lambda c: F.substring_index(c, "|", -1)
    fits = (number("x") == "") | (number("y") == "") | (number("x") == number("y"))
    once = (F.col("x") < F.col("y")) | ~F.col("asks") & (F.col("x") != F.col("y"))  # of two that ask one suffices
    return x.join(y, "h").filter(once & fits).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def name_pairs(names: DataFrame) -> DataFrame:
    """(x, y, name, slip, numbered) of distinct names (n): all ordered pairs that can be one name, and each with itself.

    name is the ratio of their longest common subsequences, slip that it rests on a slip of the pen, numbered that both
    carry the same homonym number.
    """
    number = lambda c: F.substring_index(c, "|", -1)
    met = name_meetings(names)
    met = met.unionAll(names.select(F.col("n").alias("x"), F.col("n").alias("y")))

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both = [name_match(p, q) for p, q in zip(b["x"], b["y"], strict=True)]
            b = b.assign(name=[r for r, _ in both], slip=[s for _, s in both])
            yield b[b["name"] > 0]

    good = met.mapInPandas(compared, "x string, y string, name double, slip boolean")
    good = cut(good.withColumn("numbered", (number("x") == number("y")) & (number("x") != "")))
    return good.unionAll(good.filter("x <> y").select(F.col("y").alias("x"), F.col("x").alias("y"), "name", "slip", "numbered"))


def _shown(places: str) -> Column:
    """What a record shows besides a name, as keys: place words, parts of an identifier, the homepage.

    An identifier shows three parts, one of which two wrong signs leave as it is.
    """
    parts = F.when(F.col("orcid") != "", F.array(*[F.concat(F.lit(f"#{k}"), F.substring("orcid", 1 + 5 * k, 5 + k // 2)) for k in range(3)]))
    home = F.when((F.col("user") != "") & (F.col("host") != ""), F.array(F.concat_ws("/", F.lit("@"), "host", "user")))
    none = F.array().cast("array<string>")
    return F.concat(F.col(places), F.coalesce(parts, none), F.coalesce(home, none))


def near_places(features: DataFrame) -> DataFrame:
    """features with `around`: the places and the words of other records that differ from one by a slip."""
    words = features.select("key", F.explode("places").alias("word"))
    near = slips(words.select("word"), PLACE_SLIP)
    more = words.join(near, "word").groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("more"))
    return features.join(more, "key", "left").withColumn("around", F.array_union("places", F.coalesce("more", F.array().cast("array<string>")))).drop("more")


SCORE = ["name", "slip", "numbered"]


def _best(every: DataFrame) -> DataFrame:
    """One row for each pair of records: of several spellings the best pair counts, one without a slip before one with."""
    every = every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *SCORE)
    best = every.groupBy("a", "b").agg(F.max(F.struct((~F.col("slip")).alias("whole"), "name")).alias("m"), F.max("numbered").alias("numbered"))
    return best.select("a", "b", "m.name", (~F.col("m.whole")).alias("slip"), "numbered")


def same_names(features: DataFrame) -> DataFrame:
    """(a, b, name, slip, numbered), a < b: all records of which two spellings can be one name, as in `name_pairs`."""
    named = cut(features.select("key", F.explode("names").alias("n")))
    pairs = cut(name_pairs(named.select("n").distinct()))
    one, two = named.select(F.col("n").alias("x"), F.col("key").alias("a")), named.select(F.col("n").alias("y"), F.col("key").alias("b"))
    return _best(one.join(pairs, "x").join(two, "y").filter("a < b"))


def likely_pairs(features: DataFrame) -> DataFrame:
    """The pairs of same_names that can count: one is an indexed person, or both show something in common besides (see
    `_shown`) or carry the same homonym number. features have `around`, as `near_places` adds it.

    Two records that aren't indexed need more than a name to be one person, so of a hot name only those meet that
    have it.
    """
    named = cut(features.select("key", "kind", F.explode("names").alias("n"), _shown("places").alias("e"), _shown("around").alias("f")))
    indexed = F.col("kind") == "d"
    names = cut(named.groupBy("n").agg((F.count("*") > 1).alias("several"), F.bool_or(indexed).alias("index"), F.bool_or(~indexed).alias("other")))
    of = lambda c: names.select(F.col("n").alias(c), F.struct("several", "index", "other").alias(f"of_{c}"))
    # A name of one record that goes with no other has nothing to meet.
    pairs = cut(name_pairs(names.select("n")).join(of("x"), "x").filter("x <> y or of_x.several").join(of("y"), "y"))
    # An indexed record and another meet whatever they show, below; and what is shown is shown both ways.
    half = pairs.filter("x <= y and (of_x.index and of_y.index or of_x.other and of_y.other)")
    partners = half.select(F.col("y").alias("n")).distinct()
    own = F.when(F.substring_index("n", "|", -1) != "", F.array(F.concat(F.lit("n"), F.substring_index("n", "|", -1)))).otherwise(F.array().cast("array<string>"))
    meant = half.join(named.select(F.col("n").alias("x"), F.col("key").alias("a"), indexed.alias("i"), F.concat("e", own).alias("es")), "x").filter("case when i then of_y.index else of_y.other end")
    one = meant.select("x", "y", "a", F.explode(F.transform("es", lambda e: F.xxhash64("y", "i", e))).alias("h"), *SCORE)
    two = named.join(partners, "n", "left_semi").select(F.explode(F.transform(F.array_distinct(F.concat("f", own)), lambda e: F.xxhash64("n", indexed, e))).alias("h"), F.col("key").alias("b"))
    besides = one.join(two, "h").filter("x <> y and a <> b or a < b").select("a", "b", *SCORE)
    persons = named.filter("kind = 'd'").select(F.col("n").alias("y"), F.col("key").alias("b"))
    direct = named.filter("kind <> 'd'").select(F.col("n").alias("x"), F.col("key").alias("a")).join(pairs.filter("of_x.other and of_y.index"), "x").join(persons, "y").select("a", "b", *SCORE)
    return _best(besides.unionAll(direct))


def compare(features: DataFrame) -> DataFrame:
    """likely_pairs with what the records show besides: same_id, same_home, shared, wide and apart.

    Identifiers compare as equal (1), nearly equal (0.7: two wrong signs at most), different (-1) or unknown (0),
    homepages alike; shared counts equal or nearly equal place words, wide those of towns, apart tells how far both have
    places and share none.
    """
    features = cut(near_places(features))
    named = cut(likely_pairs(features))
    fa = features.select(F.col("key").alias("a"), *[F.col(c).alias(f"{c}_a") for c in ("places", "orcid", "host", "user")])
    fb = features.select(F.col("key").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("places", "around", "orcid", "host", "user")])
    both = named.join(fa, "a").join(fb, "b")
    wrong = F.size(F.filter(F.sequence(F.lit(1), F.lit(16)), lambda i: F.substring("orcid_a", i, F.lit(1)) != F.substring("orcid_b", i, F.lit(1))))
    same_id = F.when((F.col("orcid_a") == "") | (F.col("orcid_b") == ""), 0.0).when(F.col("orcid_a") == F.col("orcid_b"), 1.0).when(wrong <= 2, 0.7).otherwise(-1.0)
    hosts = F.col("host_a") == F.col("host_b")
    same_home = F.when((F.col("user_a") == "") | (F.col("user_b") == ""), 0.0).when(~hosts, -1.0).when(F.col("user_a") == F.col("user_b"), 1.0).otherwise(-0.5)
    town = lambda w: w.startswith("~")
    met = F.filter("places_a", lambda w: F.array_contains("around_b", w))
    both = both.withColumns({"same_id": same_id, "same_home": same_home, "shared": F.size(F.filter(met, lambda w: ~town(w))), "wide": F.size(F.filter(met, town))})
    narrow = F.exists("places_a", lambda w: ~town(w)) & F.exists("places_b", lambda w: ~town(w))
    apart = F.when((F.size("places_a") == 0) | (F.size("places_b") == 0) | (F.col("shared") > 0), 0.0).when(F.col("wide") == 0, 1.0).when(narrow, 0.4).otherwise(0.0)
    return both.select("a", "b", "name", "slip", "numbered", "same_id", "same_home", "shared", "wide", apart.alias("apart"))


def place_points() -> Column:
    """Points for shared places: a narrow word counts most, a wide one alone little."""
    both = F.col("shared") + F.col("wide")
    return F.when((F.col("shared") >= 1) & (both >= 2), 2.0).when(F.col("shared") == 1, 1.5).when(F.col("wide") >= 1, 0.7).otherwise(0.0)


def evidence() -> Column:
    """What a compared pair shows for one person, in points."""
    shared = place_points() - 1.5 * F.col("apart")
    ids = F.when(F.col("same_id") == 1, 4.0).when(F.col("same_id") > 0, 2.5).when(F.col("same_id") < 0, -4.0).otherwise(0.0)
    home = F.when(F.col("same_home") == 1, 2.5).when(F.col("same_home") < 0, -0.5).otherwise(0.0)
    name = F.when(F.col("slip"), 0.0).otherwise(1.0) + 2 * (F.col("name") - 0.8)
    return name + shared + ids + home + F.when(F.col("numbered"), 1.0).otherwise(0.0)


def components(edges: DataFrame) -> DataFrame:
    """(key, root) of the connected components of edges (a, b): the least key of each. Loops and repeats do no harm."""
    edges = edges.select("a", "b")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    return graph_components(edges, nodes).withColumnRenamed("node", "key")


#: Least points at which a record joins an indexed person, two indexed records join, and two other records join; and
#: the margin by which the best person must lead the next.
JOIN_PERSON, JOIN_INDEX, JOIN_OTHERS, MARGIN = 0.9, 3.0, 1.6, 0.4


def person_edges(scored: DataFrame) -> DataFrame:
    """(a, b) accepted links of compared pairs with points.

    Indexed records (d) join on equal identifiers or homepages and enough points. Any other record joins the one
    indexed person that leads; the indexed records of one person count as one. Others join each other directly.
    """
    kind = lambda c: F.substring(c, 1, 1)
    scored = scored.withColumns({"ka": kind("a"), "kb": kind("b")})
    index = scored.filter("ka = 'd' and kb = 'd'").filter((F.col("pts") >= JOIN_INDEX) & ((F.col("same_id") > 0) | (F.col("same_home") == 1) | (F.col("shared") >= 1) & (F.col("same_id") == 0)) & (F.col("same_id") >= 0)).select("a", "b")
    groups = components(index)
    cross = scored.filter("(ka = 'd') <> (kb = 'd')").select(F.when(F.col("ka") == "d", F.col("b")).otherwise(F.col("a")).alias("r"), F.when(F.col("ka") == "d", F.col("a")).otherwise(F.col("b")).alias("key"), "pts")
    cross = cross.join(groups, "key", "left").withColumn("person", F.coalesce("root", "key"))
    by = cross.groupBy("r", "person").agg(F.max_by("key", F.struct("pts", "key")).alias("key"), F.max("pts").alias("pts"))
    top = by.groupBy("r").agg(F.max_by(F.struct("key", "person", "pts"), F.struct("pts", "person")).alias("m"), F.sort_array(F.collect_list("pts"), False).alias("all"))
    second = F.coalesce(F.get("all", F.lit(1)), F.lit(-9.0))
    joined = top.filter((F.col("m.pts") >= JOIN_PERSON) & (F.col("m.pts") - second >= MARGIN)).select("r", "m.key", "m.person")
    # A record that joined no person goes with the one person to whose records its links are strongest, so that no
    # chain of records ties two persons together; records that touch no person join each other.
    person = cut(joined.select("r", "person", "key"))
    links = cut(scored.filter("ka <> 'd' and kb <> 'd'").filter((F.col("pts") >= JOIN_OTHERS) & (F.col("same_id") >= 0)).select("a", "b", "pts"))
    while True:
        pa, pb = (person.select(F.col("r").alias(x), F.col("key").alias(f"key_{x}"), F.col("person").alias(f"person_{x}")) for x in "ab")
        known = links.join(pa, "a", "left").join(pb, "b", "left")
        half = known.filter("person_a is null").select(F.col("a").alias("r"), F.col("person_b").alias("person"), F.col("key_b").alias("key"), "pts").unionAll(known.filter("person_b is null").select(F.col("b").alias("r"), F.col("person_a").alias("person"), F.col("key_a").alias("key"), "pts"))
        later = half.filter("person is not null").groupBy("r").agg(F.max_by(F.struct("person", "key"), F.struct("pts", "person", "key")).alias("m")).select("r", "m.person", "m.key")
        later = cut(later)
        if later.isEmpty():
            break
        person = cut(person.unionAll(later))
    one = person.select("r")
    loose = links.join(one.withColumnRenamed("r", "a"), "a", "left_anti").join(one.withColumnRenamed("r", "b"), "b", "left_anti").select("a", "b")
    return index.unionAll(person.select(F.col("r").alias("a"), F.col("key").alias("b"))).unionAll(loose)


def collapse(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features of one record for each group of copies, members (key, rep, solid)).

    Copies show the same in everything but their spelling's outer form; they are compared once, so that a group of
    copies, however large, costs one record. Indexed records are never copies. solid tells that copies of that kind are
    one person even if nothing else links them: they show more than a name.
    """
    shown = ["kind", "names", "places", "orcid", "host", "user"]
    loose = features.filter("kind <> 'd'")
    reps = loose.groupBy(*shown).agg(F.min("key").alias("rep"))
    same = F.lit(True)
    a, b = loose.alias("x"), reps.alias("y")
    for c in shown:
        same = same & (F.col(f"x.{c}") == F.col(f"y.{c}"))
    solid = (F.size("x.places") > 0) | (F.col("x.orcid") != "") | (F.col("x.user") != "")
    members = a.join(b, same).select(F.col("x.key").alias("key"), F.col("y.rep").alias("rep"), solid.alias("solid"))
    members = cut(members.unionAll(features.filter("kind = 'd'").select("key", F.col("key").alias("rep"), F.lit(True).alias("solid"))))
    return cut(features.join(members.filter("key = rep").select("key"), "key", "left_semi")), members


def same_persons(records: DataFrame, towns: DataFrame | None = None) -> DataFrame:
    """(key, root, spellings) of records as for `describe`: root is the least key among the records of one person.

    Records without a usable name are left out; copies that show no more than a name and are tied by nothing else have
    no root.
    """
    features = cut(mark_wide_places(cut(describe(records).filter(F.size("names") > 0)), towns))
    alone, members = collapse(features)
    scored = cut(compare(alone).withColumn("pts", evidence()))
    person = components(cut(person_edges(scored)))
    indexed = person.filter(F.col("key").startswith("d")).select("root", F.lit(True).alias("indexed")).distinct()
    person = person.join(indexed, "root", "left").select(F.col("key").alias("rep"), "root", "indexed")
    placed = members.join(person, "rep", "left")
    root = F.when((F.col("key") == F.col("rep")) | F.col("indexed"), F.coalesce("root", "rep")).when(F.col("solid"), F.coalesce("root", "rep"))
    return placed.select("key", root.alias("root")).join(features.select("key", "spellings"), "key")


def variant_classes(records: DataFrame, towns: DataFrame | None = None) -> DataFrame:
    """(key, person, links): one row for each record with a usable name: its class, and how many records of it
    `linked_variants` links to it. Nothing is multiplied, so a person may have any number of records."""
    own = cut(same_persons(records, towns).select("key", F.coalesce("root", "key").alias("person"), F.array_sort(F.array_distinct("spellings")).alias("s")))
    whole = own.groupBy("person", "s").agg(F.count("*").alias("n"))
    spelled = whole.withColumn("sp", F.explode("s"))
    # Records of equal spellings are one class; of the others those are linked that share no spelling.
    shared = spelled.select("person", "s", "sp").join(spelled.select("person", F.col("s").alias("t"), F.col("n").alias("m"), "sp"), ["person", "sp"]).select("person", "s", "t", "m").distinct().groupBy("person", "s").agg(F.sum("m").alias("alike"))
    total = whole.groupBy("person").agg(F.sum("n").alias("all"))
    return own.join(shared, ["person", "s"]).join(total, "person").select("key", "person", (F.col("all") - F.col("alike")).alias("links"))


def linked_variants(records: DataFrame, towns: DataFrame | None = None) -> DataFrame:
    """(key_a, key_b), key_a < key_b: records of one person that share no exactly equal spelling.

    records as for `describe`, towns as for `mark_wide_places`. Records without a usable name are linked to none. Pairs
    of one person within one table count too. Groups of records with one spelling give no pair among themselves:
    spellings are paired first and the records behind them last.
    """
    own = cut(same_persons(records, towns).filter("root is not null").select("root", "key", F.array_sort(F.array_distinct("spellings")).alias("s")))
    kinds = own.select("root", "s").distinct()
    several = kinds.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1").select("root")
    kinds = kinds.join(several, "root", "left_semi")
    apart = kinds.join(kinds.withColumnRenamed("s", "t"), "root").filter((F.col("s") < F.col("t")) & ~F.arrays_overlap("s", "t"))
    both = apart.join(own, ["root", "s"]).select("root", "t", F.col("key").alias("x")).join(own.select("root", F.col("s").alias("t"), F.col("key").alias("y")), ["root", "t"])
    return both.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))
