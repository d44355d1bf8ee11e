"""Choosing the best of several answers: title rules, institutions and geocodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions import names as N
from rollcall.functions.geo import haversine
from rollcall.functions.text_udfs import best_partners, name_agrees, sequence_ratio
from rollcall.plans.registry import Registry
from rollcall.plans.relational import title_rules
from rollcall.plans.scalars import _sql_plain
from rollcall.session import cut, table

R = Registry()
query = R.query


def _sql_fold(c: str) -> str:
    return f"trim(regexp_replace({_sql_plain(c)}, '[^a-z0-9 ]+', ' ', 'g'))"


@query(f"""
SELECT title_id, upper(country) AS pool, {_sql_fold('x')} AS rule FROM (SELECT title_id, country, unnest(list_filter(list_transform(list_concat(string_split(coalesce(title_local, ''), ' / '), string_split(coalesce(title_en, ''), ' / ')), lambda x: trim(x)), lambda x: x <> '')) AS x FROM titles)
""")
def rules_explode(spark: SparkSession, d: str) -> DataFrame:
    """One rule per alternative of the local and the English title."""
    t = table(spark, d, "titles")
    both = F.concat(N.title_alternatives(F.col("title_local")), N.title_alternatives(F.col("title_en")))
    return t.select("title_id", F.upper("country").alias("pool"), F.explode(both).alias("x")).select("title_id", "pool", N.fold_title(F.col("x")).alias("rule"))


@query("""
WITH r AS (SELECT upper(country) AS pool, unnest(list_filter([lower(title_local), lower(title_en)], lambda x: coalesce(x, '') <> '')) AS rule FROM titles),
v AS (SELECT lower(title_verbatim) AS title, upper(left(inst_id, 2)) AS country, count(*) AS n FROM roster WHERE coalesce(title_verbatim, '') <> '' GROUP BY ALL)
SELECT title, cast(sum(n) AS BIGINT) AS n FROM v WHERE NOT EXISTS (SELECT 1 FROM r WHERE (r.pool = v.country OR r.pool = 'XX') AND contains(v.title, r.rule)) GROUP BY title
""")
def unruled_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles that no rule covers and how often they stand; counted before the rules are tried."""
    v = table(spark, d, "roster").filter(F.coalesce("title_verbatim", F.lit("")) != "").groupBy(F.lower("title_verbatim").alias("title"), F.upper(F.substring("inst_id", 1, 2)).alias("country")).agg(F.count("*").alias("k"))
    tried = v.withColumn("pool", F.explode(F.array("country", F.lit("XX")))).join(title_rules(spark, d), "pool").filter(F.col("title").contains(F.col("rule"))).select("title", "country").distinct()
    return v.join(tried, ["title", "country"], "left_anti").groupBy("title").agg(F.sum("k").alias("n"))


def _blocks(left: DataFrame, right: DataFrame, by: str | None, most_left: int = 1_000, most_right: int = 8_000) -> DataFrame:
    """best_partners of left among the rows of right that are equal in `by`, or among all; in blocks of bounded size that
    meet each other completely, so that no country or word is too large for one task."""
    left, right = (df.withColumn("by", F.col(by) if by else F.lit("")).filter("by is not null") for df in (left, right))
    parts = lambda df, name, most: df.groupBy("by").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias(name))
    both = parts(left, "nl", most_left).join(parts(right, "nr", most_right), "by")
    one = left.join(both, "by").withColumn("l", F.pmod(F.xxhash64("id"), "nl").cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("nr") - 1)))
    two = right.join(both, "by").withColumn("r", F.pmod(F.xxhash64("key"), "nr").cast("int")).withColumn("l", F.explode(F.sequence(F.lit(0), F.col("nl") - 1)))
    block = ["by", "l", "r"]
    grouped = one.select(*block, "id", "text", "country", "host", "words").groupBy(*block).cogroup(two.select(*block, "key", "text", "country", "host", "words").groupBy(*block))
    found = grouped.applyInPandas(best_partners, "id long, c int, d int, s double, k long")
    return found.groupBy("id").agg(F.max(F.struct("c", "d", "s", (-F.col("k")).alias("k"))).alias("o"))


def pick_institutions(c: DataFrame, i: DataFrame) -> DataFrame:
    """institution_pick of candidates (cand_id, affiliation, country, homepage) and institutions (inst_key, name, country, homepage)."""
    place = lambda df, text: df.select("*", N.fold_plain(F.col(text)).alias("text"), N.host(F.col("homepage")).alias("host"))
    c = place(c.filter("affiliation is not null").withColumn("country", F.lower(F.trim("country"))), "affiliation")
    i = place(i.filter("inst_key is not null").withColumn("country", F.lower("country")), "name")
    shown = ["text", "country", "host"]
    c = c.select("cand_id", *shown)
    named = lambda df: df.withColumn("words", N.distinctive_tokens(F.col("text"))).filter(F.size("words") > 0)
    asked = cut(named(c.groupBy(*shown).agg(F.min("cand_id").alias("id"))))
    known = cut(named(i.groupBy(*shown).agg(F.min("inst_key").alias("key"))))
    # Who meets an institution of the own country needs no other.
    home = cut(_blocks(asked, known, "country"))
    best = home.unionAll(_blocks(asked.join(home, "id", "left_anti"), known, None))
    a, b = c.alias("a"), asked.join(best, "id").select(*shown, "o").alias("b")
    same = F.col("a.text") == F.col("b.text")
    for x in ("country", "host"):
        same = same & F.col(f"a.{x}").eqNullSafe(F.col(f"b.{x}"))
    status = F.when((F.col("o.c") == 1) & ((F.col("o.s") >= 0.75) | (F.col("o.d") == 1)), "auto").otherwise("needs_review")
    return a.join(b, same, "left").select("cand_id", (-F.col("o.k")).alias("inst_key"), F.round("o.s", 6).alias("similarity"), F.when(F.col("o").isNull(), "no_match").otherwise(status).alias("status"))


@query()
def institution_pick(spark: SparkSession, d: str) -> DataFrame:
    """The best institution for each affiliation of a candidate: country, then domain, then similarity, then key.

    Candidates are all institutions that share an identifying word, however common; similarity is computed where the
    other marks are equal and the letters allow a better one. auto when the country fits and the name is similar or the
    domain fits. No SQL equivalent for the similarity.
    """
    return pick_institutions(table(spark, d, "candidates_csrankings").select("cand_id", "affiliation", "country", "homepage"), table(spark, d, "institutions_geocoded").select("inst_key", "name", "country", "homepage"))


def settle_institutions(i: DataFrame) -> DataFrame:
    """(inst_key, status, city_note) of matched institutions (inst_key, inst_id, country, city_expected, ror_id,
    ror_country, ror_city, lat, similarity, domain_match, coords_from).

    no_match without a record; auto if the country is the expected one, the name is similar or the domain fits, and the
    city isn't an unrelated one; else needs_review. A row that borrows coordinates is anchored, unless auto, if the row
    it names has some; else it needs review. Null texts count as ''.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    asked, got = N.fold_plain(text("city_expected")), N.fold_plain(text("ror_city"))
    i = i.withColumns({"asked": asked, "got": got, "found": text("ror_id") != ""})
    named = (F.col("asked") == "") | F.contains(F.col("got"), F.substring("asked", 1, 5))
    i = i.withColumn("named", named).withColumn("alike", F.when(F.col("named"), 1.0).otherwise(sequence_ratio(F.when(~F.col("named"), F.col("asked")), F.when(~F.col("named"), F.col("got")))))
    fits = (F.lower(text("ror_country")) == F.lower(text("country"))) & ((F.coalesce("similarity", F.lit(0.0)) >= 0.75) | F.coalesce("domain_match", F.lit(False)))
    first = F.when(~F.col("found"), "no_match").when(fits & (F.col("alike") >= 0.45), "auto").otherwise("needs_review")
    note = F.when(F.col("found") & ~F.col("named"), F.concat(F.lit("expected "), text("city_expected"), F.lit(", found "), text("ror_city"), F.when(F.col("alike") < 0.45, " (unrelated)").otherwise("")))
    i = i.withColumns({"first": first, "note": F.coalesce(note, F.lit(""))})
    source = i.filter("inst_id is not null and lat is not null").select(F.col("inst_id").alias("coords_from")).distinct().withColumn("lends", F.lit(True))
    i = i.join(source, "coords_from", "left")
    borrowed = F.when(text("coords_from") == "", F.col("first")).when(F.col("lends"), F.when(F.col("first") == "auto", "auto").otherwise("anchored")).otherwise("needs_review")
    return i.select("inst_key", borrowed.alias("status"), F.col("note").alias("city_note"))


@query()
def institution_status(spark: SparkSession, d: str) -> DataFrame:
    """How far each institution's match holds. The table has one country, which stands for that of the match; no SQL
    equivalent for the similarity."""
    i = table(spark, d, "institutions_geocoded")
    return settle_institutions(i.select("inst_key", "inst_id", "country", "city_expected", "ror_id", F.col("country").alias("ror_country"), "ror_city", "lat", "similarity", "domain_match", "coords_from"))


@query()
def geocode_pick(spark: SparkSession, d: str) -> DataFrame:
    """The nearest agreeing answer of the first stage that has one, within 30 km of the city; else the city itself."""
    i = table(spark, d, "institutions_geocoded").select("inst_id", "name", "city_expected", F.col("lat").alias("ilat"), F.col("lon").alias("ilon"))
    p = table(spark, d, "institutions_geocoded_precise").filter("lat between -90 and 90 and lon between -180 and 180").select("inst_id", "site_id", "lat", "lon", "geocode_query", "geocode_precision")
    j = p.join(i, "inst_id").withColumn("km", F.coalesce(haversine(F.col("lat"), F.col("lon"), F.col("ilat"), F.col("ilon")), F.lit(0.0))).filter("km <= 30")
    ok = j.withColumn("agrees", name_agrees(N.fold_title(F.col("name")), N.fold_title(F.col("geocode_query")), N.fold_title(F.col("city_expected")))).filter("agrees")
    stage = F.when(F.col("geocode_precision") == "building", 1).when(F.col("geocode_precision") == "street", 2).otherwise(3)
    best = ok.groupBy("inst_id").agg(F.min(F.struct(stage.alias("stage"), F.col("km"), "site_id", "lat", "lon")).alias("m"))
    return i.join(best, "inst_id", "left").select("inst_id", F.coalesce("m.lat", "ilat").alias("lat"), F.coalesce("m.lon", "ilon").alias("lon"), F.coalesce(F.round("m.km", 3), F.lit(0.0)).alias("shift_km"), F.when(F.col("m").isNull(), "city_centroid").otherwise("site").alias("kind"))
