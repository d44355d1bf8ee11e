"""Filters, joins, aggregates, windows, orderings and set operations over the domain tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollcall.plans.registry import Registry
from rollcall.session import table

R = Registry()
query = R.query

# The countries in scope, with both codes of the United Kingdom.
SCOPE = "at be bg hr cy cz dk ee fi fr de gr hu ie it lv lt lu mt nl pl pt ro sk si es se ch no is li gb uk".split()
YEARS = (2021, 2026)
CORE_MIN = 3
SNAPSHOT = "2026-08-06"

_SCOPE_SQL = ", ".join(f"'{c}'" for c in SCOPE)


def _n() -> Column:
    return F.count("*").alias("n")


# Filters


@query(f"SELECT cand_id, lower(trim(country)) AS country FROM candidates_csrankings WHERE lower(trim(country)) IN ({_SCOPE_SQL})")
def filter_in_set(spark: SparkSession, d: str) -> DataFrame:
    c = F.lower(F.trim("country"))
    return table(spark, d, "candidates_csrankings").filter(c.isin(SCOPE)).select("cand_id", c.alias("country"))


@query(f"SELECT paper_key, author, year FROM authorships WHERE year BETWEEN {YEARS[0]} AND {YEARS[1]}")
def filter_year_window(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "authorships").filter(F.col("year").between(*YEARS)).select("paper_key", "author", "year")


@query("SELECT venue, count(*) AS n FROM authorships WHERE paper_key LIKE 'journals/%' OR paper_key LIKE 'conf/%' GROUP BY venue")
def filter_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "authorships").filter(F.col("paper_key").startswith("journals/") | F.col("paper_key").startswith("conf/")).groupBy("venue").agg(_n())


_COUNTS_SQL = "SELECT author, count(*) FILTER (layer = 'core' AND NOT is_findings) AS core, count(*) FILTER (NOT (layer = 'core' AND NOT is_findings)) AS extended FROM authorships GROUP BY author"


def author_counts(spark: SparkSession, d: str) -> DataFrame:
    """Papers per author in the core layer, without findings, and beyond it."""
    core = F.coalesce((F.col("layer") == "core") & ~F.col("is_findings"), F.lit(False))
    known = F.col("layer").isNotNull() & F.col("is_findings").isNotNull()
    return table(spark, d, "authorships").groupBy("author").agg(F.count_if(core).alias("core"), F.count_if(known & ~core).alias("extended"))


@query(_COUNTS_SQL)
def conditional_agg(spark: SparkSession, d: str) -> DataFrame:
    return author_counts(spark, d)


@query(f"SELECT * FROM ({_COUNTS_SQL}) WHERE core >= {CORE_MIN}")
def threshold_filter(spark: SparkSession, d: str) -> DataFrame:
    return author_counts(spark, d).filter(F.col("core") >= CORE_MIN)


@query("SELECT pid FROM dblp_persons WHERE coalesce(affiliations_current, '') <> '' OR coalesce(affiliations_former, '') <> '' OR coalesce(affiliations_phd, '') <> ''")
def any_nonempty(spark: SparkSession, d: str) -> DataFrame:
    some = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("affiliations_current", "affiliations_former", "affiliations_phd")]
    return table(spark, d, "dblp_persons").filter(some[0] | some[1] | some[2]).select("pid")


@query("""SELECT roster_id FROM roster WHERE CASE WHEN inst_id LIKE 'de-%' THEN site ELSE group_or_dept END IN ('Main site', 'Learning Systems Group', 'Cognitive Systems Group')""")
def dynamic_column_filter(spark: SparkSession, d: str) -> DataFrame:
    """The column to test is named by data: a map of columns, looked up by the institution's country."""
    r = table(spark, d, "roster")
    which = F.when(F.col("inst_id").startswith("de-"), "site").otherwise("group_or_dept")
    value = F.element_at(F.create_map(F.lit("site"), "site", F.lit("group_or_dept"), "group_or_dept"), which)
    return r.filter(F.array_contains(F.array(*map(F.lit, ("Main site", "Learning Systems Group", "Cognitive Systems Group"))), value)).select("roster_id")


@query("SELECT cand_id FROM candidates_csrankings WHERE regexp_matches(affiliation, '(?i)(institute|academy) (of|for)')")
def regex_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates_csrankings").filter(F.col("affiliation").rlike("(?i)(institute|academy) (of|for)")).select("cand_id")


@query("SELECT site_id, lat, lon FROM institutions_geocoded_precise WHERE lat > 40 AND lat < 60 AND lon > -5 AND lon < 20")
def bbox_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "institutions_geocoded_precise").filter("lat > 40 and lat < 60 and lon > -5 and lon < 20").select("site_id", "lat", "lon")


@query("SELECT inst_key, csrankings_faculty FROM institutions_geocoded WHERE csrankings_faculty > 0")
def positive_only(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "institutions_geocoded").filter("csrankings_faculty > 0").select("inst_key", "csrankings_faculty")


@query(f"""SELECT k.check_id, max(c.core) AS best FROM roster_checked k JOIN ({_COUNTS_SQL}) c ON c.author = k.name WHERE k.core_papers < {CORE_MIN} GROUP BY k.check_id HAVING max(c.core) >= {CORE_MIN}""")
def decision_relevant(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a decision would lift over the threshold."""
    k = table(spark, d, "roster_checked").filter(F.col("core_papers") < CORE_MIN).select("check_id", "name")
    return k.join(author_counts(spark, d), k["name"] == F.col("author")).groupBy("check_id").agg(F.max("core").alias("best")).filter(F.col("best") >= CORE_MIN)


@query("SELECT cand_id FROM candidates_csrankings WHERE core_papers > 0 OR extended_papers > 0")
def any_activity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates_csrankings").filter("core_papers > 0 or extended_papers > 0").select("cand_id")


@query("SELECT inst_id, min(source) AS source FROM institutions_geocoded_precise WHERE source IS NOT NULL GROUP BY inst_id HAVING count(DISTINCT source) = 1")
def single_source(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "institutions_geocoded_precise").filter("source is not null").groupBy("inst_id").agg(F.collect_set("source").alias("s")).filter(F.size("s") == 1).select("inst_id", F.get("s", F.lit(0)).alias("source"))


@query("SELECT inst_key FROM institutions_geocoded WHERE lat IS NOT NULL AND lon IS NOT NULL AND coalesce(city_expected, '') <> ''")
def nonempty_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "institutions_geocoded").filter(F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.nullif("city_expected", F.lit("")).isNotNull()).select("inst_key")


@query("SELECT site_id, coalesce(shift_from_city_km, 0) AS km FROM institutions_geocoded_precise WHERE coalesce(shift_from_city_km, 0) <= 30")
def distance_guard(spark: SparkSession, d: str) -> DataFrame:
    """A missing distance counts as none and passes."""
    km = F.coalesce("shift_from_city_km", F.lit(0.0))
    return table(spark, d, "institutions_geocoded_precise").filter(km <= 30).select("site_id", km.alias("km"))


@query("SELECT inst_id, name FROM institutions_geocoded WHERE inst_id = (SELECT min(inst_id) FROM institutions_geocoded)")
def lookup_slug(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "institutions_geocoded")
    return lookup(i, "inst_id", i.agg(F.min("inst_id")).first()[0]).select("inst_id", "name")


def lookup(df: DataFrame, key: str, value: str) -> DataFrame:
    """The rows of one key; an unknown key is an error that lists some known ones."""
    found = df.filter(F.col(key) == value)
    if not found.limit(1).count():
        some = [r[0] for r in df.select(key).distinct().orderBy(key).limit(20).collect()]
        raise KeyError(f"{value!r} is not a {key}; some that are: {some}")
    return found


@query("SELECT doc_id FROM documents WHERE retrieved_at <= TIMESTAMP '2026-08-15 00:00:00' AND (city_id IS NULL OR city_id > 100)")
def as_of_filter(spark: SparkSession, d: str) -> DataFrame:
    """Begun by the date, and open or ended after it."""
    return table(spark, d, "documents").filter((F.col("retrieved_at") <= F.lit("2026-08-15 00:00:00").cast("timestamp")) & (F.col("city_id").isNull() | (F.col("city_id") > 100))).select("doc_id")


@query("SELECT cand_id, core_papers, extended_papers FROM candidates_csrankings WHERE core_papers > 0 AND extended_papers > 0")
def positive_pair(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates_csrankings").filter("core_papers > 0 and extended_papers > 0").select("cand_id", "core_papers", "extended_papers")


# Joins


@query("SELECT r.roster_id, coalesce(lower(i.country), '') AS country FROM roster r LEFT JOIN institutions_geocoded i USING (inst_id)")
def join_left_lookup(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "institutions_geocoded").select("inst_id", F.lower("country").alias("c"))
    return table(spark, d, "roster").join(i, "inst_id", "left").select("roster_id", F.coalesce("c", F.lit("")).alias("country"))


_FORMS_SQL = "SELECT pid, primary_name AS form FROM dblp_persons UNION ALL SELECT pid, unnest(string_split(aliases, '|')) FROM dblp_persons WHERE coalesce(aliases, '') <> ''"


def name_forms(spark: SparkSession, d: str) -> DataFrame:
    """(pid, form): the primary name and every alias of each person."""
    p = table(spark, d, "dblp_persons")
    alias = p.filter(F.coalesce("aliases", F.lit("")) != "").select("pid", F.explode(F.split("aliases", r"\|")).alias("form"))
    return p.select("pid", F.col("primary_name").alias("form")).unionAll(alias)


@query(f"""
WITH o AS (SELECT orcid, max(pid) AS pid FROM dblp_persons WHERE coalesce(orcid, '') <> '' GROUP BY orcid),
f AS (SELECT form, min(pid) AS pid FROM ({_FORMS_SQL}) GROUP BY form)
SELECT c.cand_id, coalesce(o.pid, f.pid) AS pid, CASE WHEN o.pid IS NOT NULL THEN 'orcid' WHEN f.pid IS NOT NULL THEN 'name' ELSE '' END AS matched_by
FROM candidates_csrankings c LEFT JOIN o ON c.orcid = o.orcid LEFT JOIN f ON c.name = f.form
""")
def join_priority_keys(spark: SparkSession, d: str) -> DataFrame:
    """The identifier first, else any form of the name: two equi-joins."""
    c = table(spark, d, "candidates_csrankings").select("cand_id", "name", "orcid")
    o = table(spark, d, "dblp_persons").filter(F.coalesce("orcid", F.lit("")) != "").groupBy("orcid").agg(F.max("pid").alias("by_orcid"))
    f = name_forms(spark, d).groupBy("form").agg(F.min("pid").alias("by_name"))
    j = c.join(o, "orcid", "left").join(f, c["name"] == f["form"], "left")
    how = F.when(F.col("by_orcid").isNotNull(), "orcid").when(F.col("by_name").isNotNull(), "name").otherwise("")
    return j.select("cand_id", F.coalesce("by_orcid", "by_name").alias("pid"), how.alias("matched_by"))


@query(f"SELECT f.pid, cast(coalesce(sum(c.core), 0) AS BIGINT) AS core, cast(coalesce(sum(c.extended), 0) AS BIGINT) AS extended FROM ({_FORMS_SQL}) f LEFT JOIN ({_COUNTS_SQL}) c ON c.author = f.form GROUP BY f.pid")
def join_alias_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Papers over all forms of a name; authors are counted before the join."""
    j = name_forms(spark, d).join(author_counts(spark, d), F.col("form") == F.col("author"), "left")
    return j.groupBy("pid").agg(F.coalesce(F.sum("core"), F.lit(0)).alias("core"), F.coalesce(F.sum("extended"), F.lit(0)).alias("extended"))


@query("""
WITH k AS (SELECT DISTINCT paper_key FROM authorships WHERE paper_key IS NOT NULL),
m AS (SELECT paper_key, venue_abbrev, layer, row_number() OVER (PARTITION BY paper_key ORDER BY length(dblp_prefix) DESC, dblp_prefix) AS r FROM k JOIN venue_dblp_keys ON starts_with(paper_key, dblp_prefix))
SELECT paper_key, venue_abbrev, layer FROM m WHERE r = 1
""")
def join_longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The longest prefix wins: every prefix length in use becomes an equi-join key, so no pair is tried in vain; there
    are at most as many lengths as the longest prefix has letters."""
    keys = table(spark, d, "authorships").select("paper_key").filter("paper_key is not null").distinct()
    v = table(spark, d, "venue_dblp_keys")
    lengths = [r[0] for r in v.select(F.length("dblp_prefix").alias("n")).distinct().collect()]
    cut = keys.withColumn("n", F.explode(F.array(*map(F.lit, lengths)))).withColumn("dblp_prefix", F.substring("paper_key", F.lit(1), F.col("n"))).filter(F.length("dblp_prefix") == F.col("n"))
    return cut.join(v, "dblp_prefix").groupBy("paper_key").agg(F.max_by(F.struct("venue_abbrev", "layer"), F.struct("n", "dblp_prefix")).alias("m")).select("paper_key", "m.*")


_RULES_SQL = "SELECT title_id, upper(country) AS pool, unnest(list_filter([lower(title_local), lower(title_en)], lambda x: coalesce(x, '') <> '')) AS rule FROM titles"


def title_rules(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "titles")
    return t.select("title_id", F.upper("country").alias("pool"), F.explode(F.filter(F.array(F.lower("title_local"), F.lower("title_en")), lambda x: F.coalesce(x, F.lit("")) != "")).alias("rule"))


@query(f"""
WITH v AS (SELECT DISTINCT lower(title_verbatim) AS title, upper(left(inst_id, 2)) AS country FROM roster WHERE coalesce(title_verbatim, '') <> ''),
m AS (SELECT title, v.country, title_id, row_number() OVER (PARTITION BY title, v.country ORDER BY CASE WHEN pool = 'XX' THEN 1 ELSE 0 END, title <> rule, length(rule) DESC, title_id, rule) AS r
      FROM v JOIN ({_RULES_SQL}) t ON (t.pool = v.country OR t.pool = 'XX') AND contains(v.title, t.rule))
SELECT title, country, title_id FROM m WHERE r = 1
""")
def join_rule_match(spark: SparkSession, d: str) -> DataFrame:
    """Pools in order, in a pool exact before contained, then the longest rule: once per distinct title and country."""
    v = table(spark, d, "roster").filter(F.coalesce("title_verbatim", F.lit("")) != "").select(F.lower("title_verbatim").alias("title"), F.upper(F.substring("inst_id", 1, 2)).alias("country")).distinct()
    pools = v.withColumn("pool", F.explode(F.array("country", F.lit("XX"))))
    m = pools.join(title_rules(spark, d), "pool").filter(F.col("title").contains(F.col("rule")))
    order = F.struct((F.col("pool") != "XX").alias("own"), (F.col("title") == F.col("rule")).alias("exact"), F.length("rule").alias("n"), (-F.col("title_id")).alias("i"))
    return m.groupBy("title", "country").agg(F.max_by("title_id", order).alias("title_id"))


@query("SELECT k.check_id, coalesce(nullif(o.name, ''), nullif(k.dblp_name, '')) AS name FROM roster_checked k LEFT JOIN (SELECT name, inst_id FROM roster_checked WHERE match = 'override' GROUP BY name, inst_id) o ON k.name = o.name AND k.inst_id = o.inst_id")
def join_override(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "roster_checked")
    o = k.filter("match = 'override'").select("name", "inst_id", F.col("name").alias("settled")).distinct()
    return k.join(o, ["name", "inst_id"], "left").select("check_id", F.coalesce(F.nullif("settled", F.lit("")), F.nullif("dblp_name", F.lit(""))).alias("name"))


@query("SELECT r.roster_id, CASE WHEN t.counts_as_pi = 'review' AND r.group_or_dept LIKE '%Learning%' THEN 'yes' ELSE coalesce(t.counts_as_pi, 'unknown') END AS verdict FROM roster r LEFT JOIN titles t ON r.title_verbatim = t.title_local")
def join_patch(spark: SparkSession, d: str) -> DataFrame:
    """A second table changes a value only where the first left it open."""
    r, t = table(spark, d, "roster"), table(spark, d, "titles").select("title_local", "counts_as_pi")
    j = r.join(t, F.col("title_verbatim") == F.col("title_local"), "left")
    v = F.when((F.col("counts_as_pi") == "review") & F.col("group_or_dept").like("%Learning%"), "yes").otherwise(F.coalesce("counts_as_pi", F.lit("unknown")))
    return j.select("roster_id", v.alias("verdict"))


@query("SELECT i.inst_key, coalesce(a.names, '') AS names FROM institutions_geocoded i LEFT JOIN (SELECT ror_id, array_to_string(list_sort(list(DISTINCT name)), '|') AS names FROM institutions_geocoded_precise WHERE ror_id IS NOT NULL AND name IS NOT NULL GROUP BY ror_id) a ON i.ror_id = a.ror_id")
def join_alias_list(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "institutions_geocoded_precise").filter("ror_id is not null and name is not null").groupBy("ror_id").agg(F.array_join(F.sort_array(F.collect_set("name")), "|").alias("names"))
    return table(spark, d, "institutions_geocoded").select("inst_key", "ror_id").join(a, "ror_id", "left").select("inst_key", F.coalesce("names", F.lit("")).alias("names"))


@query("SELECT a.inst_key, coalesce(a.lat, b.lat) AS lat, coalesce(a.lon, b.lon) AS lon, CASE WHEN a.lat IS NULL AND b.lat IS NOT NULL THEN 'anchored' ELSE a.status END AS status FROM institutions_geocoded a LEFT JOIN institutions_geocoded b ON a.coords_from = b.inst_id AND a.coords_from <> ''")
def join_self_ref(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates taken from another row of the same table, one hop."""
    i = table(spark, d, "institutions_geocoded")
    b = i.select(F.col("inst_id").alias("from"), F.col("lat").alias("blat"), F.col("lon").alias("blon"))
    j = i.join(b, F.nullif("coords_from", F.lit("")) == F.col("from"), "left")
    status = F.when(F.col("lat").isNull() & F.col("blat").isNotNull(), "anchored").otherwise(F.col("status"))
    return j.select("inst_key", F.coalesce("lat", "blat").alias("lat"), F.coalesce("lon", "blon").alias("lon"), status.alias("status"))


@query("SELECT inst_key FROM institutions_geocoded i WHERE NOT EXISTS (SELECT 1 FROM roster r WHERE r.inst_id = i.inst_id)")
def join_anti_cover(spark: SparkSession, d: str) -> DataFrame:
    """Institutions that no roster covers."""
    return table(spark, d, "institutions_geocoded").join(table(spark, d, "roster").select("inst_id"), "inst_id", "left_anti").select("inst_key")


@query("SELECT c.country, bool_or(contains(lower(i.name), lower(c.city))) AS named, count(*) AS n FROM city_list c JOIN institutions_geocoded i ON lower(i.country) = c.country GROUP BY c.country")
def join_theta_exists(spark: SparkSession, d: str) -> DataFrame:
    """Whether any institution of the country names a listed city."""
    c, i = table(spark, d, "city_list").select("country", "city"), table(spark, d, "institutions_geocoded").select(F.lower("country").alias("country"), "name")
    return c.join(i, "country").groupBy("country").agg(F.bool_or(F.contains(F.lower("name"), F.lower("city"))).alias("named"), _n())


@query("SELECT name, arg_max_null(affiliation, cand_id) AS elsewhere FROM candidates_csrankings WHERE lower(trim(country)) NOT IN ('de', 'germany') GROUP BY name")
def split_in_notin(spark: SparkSession, d: str) -> DataFrame:
    """Rows beyond a set, the last of each name."""
    c = table(spark, d, "candidates_csrankings").filter(~F.lower(F.trim("country")).isin("de", "germany"))
    return c.groupBy("name").agg(F.max_by("affiliation", "cand_id").alias("elsewhere"))


@query("SELECT i.inst_key, f.geocode_query FROM institutions_geocoded i LEFT JOIN (SELECT inst_id, arg_min(geocode_query, site_id) AS geocode_query FROM institutions_geocoded_precise WHERE geocode_query IS NOT NULL GROUP BY inst_id) f USING (inst_id)")
def join_first_match(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "institutions_geocoded_precise").filter("geocode_query is not null").groupBy("inst_id").agg(F.min_by("geocode_query", "site_id").alias("geocode_query"))
    return table(spark, d, "institutions_geocoded").select("inst_id", "inst_key").join(f, "inst_id", "left").select("inst_key", "geocode_query")


@query("SELECT v.venue_abbrev, count(*) AS n FROM (SELECT unnest(string_split(venues, ';')) AS venue FROM candidates_csrankings WHERE coalesce(venues, '') <> '') c JOIN venue_dblp_keys v ON c.venue = v.venue_abbrev GROUP BY v.venue_abbrev")
def join_exploded_registry(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates_csrankings").filter(F.coalesce("venues", F.lit("")) != "").select(F.explode(F.split("venues", ";")).alias("venue_abbrev"))
    # Counted before the join: the shuffle carries venues, not rows.
    return c.groupBy("venue_abbrev").agg(F.count("*").alias("k")).join(table(spark, d, "venue_dblp_keys").groupBy("venue_abbrev").agg(F.count("*").alias("m")), "venue_abbrev").select("venue_abbrev", (F.col("k") * F.col("m")).alias("n"))


@query("SELECT p.site_id, i.csrankings_faculty FROM institutions_geocoded_precise p JOIN institutions_geocoded i ON p.name = i.name")
def join_inner_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "institutions_geocoded_precise").select("site_id", "name").join(table(spark, d, "institutions_geocoded").select("name", "csrankings_faculty"), "name").select("site_id", "csrankings_faculty")


@query(f"SELECT coalesce(r.name, a.author) AS name, coalesce(r.n, 0) AS on_rosters, coalesce(a.core, 0) AS core FROM (SELECT name, count(*) AS n FROM roster WHERE name IS NOT NULL GROUP BY name) r FULL JOIN ({_COUNTS_SQL}) a ON r.name = a.author")
def join_full_outer(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "roster").filter("name is not null").groupBy("name").agg(F.count("*").alias("k"))
    j = r.join(author_counts(spark, d), r["name"] == F.col("author"), "full")
    return j.select(F.coalesce("name", "author").alias("name"), F.coalesce("k", F.lit(0)).alias("on_rosters"), F.coalesce("core", F.lit(0)).alias("core"))


# Aggregates


@query("SELECT country, affiliation, count(*) AS n FROM candidates_csrankings GROUP BY ALL ORDER BY n DESC, country, affiliation")
def agg_group_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates_csrankings").groupBy("country", "affiliation").agg(_n()).orderBy(F.desc("n"), "country", "affiliation")


@query("SELECT author, array_to_string(list_sort(list(DISTINCT venue)), ';') AS venues, count(DISTINCT year) AS n_years, max(year) AS last_year FROM authorships GROUP BY author")
def agg_collect_set(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "authorships").groupBy("author").agg(F.array_join(F.sort_array(F.collect_set("venue")), ";").alias("venues"), F.count_distinct("year").alias("n_years"), F.max("year").alias("last_year"))


@query("SELECT venue, year, count(*) AS n FROM authorships GROUP BY GROUPING SETS ((venue), (year))")
def agg_multi_counter(spark: SparkSession, d: str) -> DataFrame:
    """Several counters in one pass."""
    a = table(spark, d, "authorships")
    return a.groupingSets([["venue"], ["year"]], "venue", "year").agg(_n())


@query("SELECT count(*) AS n, count(*) FILTER (coalesce(orcid, '') <> '') AS with_orcid, round(count(*) FILTER (coalesce(orcid, '') <> '') / count(*), 6) AS share FROM dblp_persons")
def agg_global(spark: SparkSession, d: str) -> DataFrame:
    has = F.count_if(F.coalesce("orcid", F.lit("")) != "")
    return table(spark, d, "dblp_persons").agg(_n(), has.alias("with_orcid"), F.round(has / F.count("*"), 6).alias("share"))


@query("SELECT match, count(*) AS n FROM roster_checked GROUP BY match")
def agg_tally(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "roster_checked").groupBy("match").agg(_n())


@query("SELECT inst_id, count(*) AS n, count(*) FILTER (match = 'exact') AS exact, count(*) FILTER (match = 'ambiguous') AS ambiguous, count(*) FILTER (match = 'none') AS unmatched FROM roster_checked GROUP BY inst_id")
def agg_pivot_verdict(spark: SparkSession, d: str) -> DataFrame:
    of = lambda v: F.count_if(F.col("match") == v)
    return table(spark, d, "roster_checked").groupBy("inst_id").agg(_n(), of("exact").alias("exact"), of("ambiguous").alias("ambiguous"), of("none").alias("unmatched"))


@query("SELECT coalesce(source, '(all)') AS source, count(*) AS n, cast(sum(length(text)) AS BIGINT) AS chars FROM (SELECT coalesce(source, '?') AS source, text FROM documents) GROUP BY ROLLUP (source)")
def agg_rollup_total(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.coalesce("source", F.lit("?")).alias("source"), F.length("text").alias("k"))
    return docs.rollup("source").agg(_n(), F.sum("k").alias("chars")).withColumn("source", F.coalesce("source", F.lit("(all)")))


@query("SELECT inst_id, array_to_string(list(source ORDER BY site_id), ';') AS sources, count(DISTINCT source) AS n_sources FROM institutions_geocoded_precise WHERE source IS NOT NULL GROUP BY inst_id")
def agg_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources in order of appearance and their distinct number."""
    g = table(spark, d, "institutions_geocoded_precise").filter("source is not null").groupBy("inst_id").agg(F.array_sort(F.collect_list(F.struct("site_id", "source"))).alias("s"))
    return g.select("inst_id", F.array_join(F.transform("s", lambda x: x["source"]), ";").alias("sources"), F.size(F.array_distinct(F.transform("s", lambda x: x["source"]))).cast("long").alias("n_sources"))


@query("SELECT country, round(sum(CASE WHEN matched_by = 'orcid' THEN 1.0 WHEN matched_by = 'name' THEN 0.5 ELSE 0 END)::DOUBLE, 6) AS weight FROM candidates_csrankings GROUP BY country")
def agg_weighted(spark: SparkSession, d: str) -> DataFrame:
    w = F.when(F.col("matched_by") == "orcid", 1.0).when(F.col("matched_by") == "name", 0.5).otherwise(0.0)
    return table(spark, d, "candidates_csrankings").groupBy("country").agg(F.round(F.sum(w), 6).alias("weight"))


@query("SELECT r.roster_id, coalesce(max(k.core_papers), 0) AS best FROM roster r LEFT JOIN roster_checked k ON r.name = k.name AND r.inst_id = k.inst_id GROUP BY r.roster_id")
def agg_max_default(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "roster_checked").groupBy("name", "inst_id").agg(F.max("core_papers").alias("m"))
    return table(spark, d, "roster").select("roster_id", "name", "inst_id").join(k, ["name", "inst_id"], "left").select("roster_id", F.coalesce("m", F.lit(0)).alias("best"))


@query(f"SELECT form, min(pid) AS pid FROM ({_FORMS_SQL}) GROUP BY form HAVING count(DISTINCT pid) = 1")
def agg_exactly_one(spark: SparkSession, d: str) -> DataFrame:
    """Forms that exactly one person has: the least and the largest owner agree."""
    return name_forms(spark, d).groupBy("form").agg(F.min("pid").alias("pid"), F.max("pid").alias("z")).filter(F.col("pid") == F.col("z")).select("form", "pid")


@query("""
WITH a AS (SELECT DISTINCT name FROM roster WHERE name IS NOT NULL), b AS (SELECT DISTINCT name FROM candidates_csrankings WHERE name IS NOT NULL),
s AS (SELECT count(*) FILTER (b.name IS NULL) AS only_a, count(*) FILTER (a.name IS NULL) AS only_b, count(*) FILTER (a.name IS NOT NULL AND b.name IS NOT NULL) AS shared FROM a FULL JOIN b ON a.name = b.name)
SELECT only_a, only_b, shared, only_a + only_b + shared AS all_names, CASE WHEN shared > 0 THEN round((only_a + shared) * (only_b + shared) / shared, 4) END AS estimate FROM s
""")
def agg_overlap_capture(spark: SparkSession, d: str) -> DataFrame:
    """Two sources: overlap and the two-sample estimate of the total."""
    a = table(spark, d, "roster").filter("name is not null").select(F.col("name").alias("a")).distinct()
    b = table(spark, d, "candidates_csrankings").filter("name is not null").select(F.col("name").alias("b")).distinct()
    s = a.join(b, F.col("a") == F.col("b"), "full").agg(F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"))
    x, y, z = F.col("only_a"), F.col("only_b"), F.col("shared")
    return s.select(x, y, z, (x + y + z).alias("all_names"), F.when(z > 0, F.round((x + z) * (y + z) / z, 4)).alias("estimate"))


@query("SELECT affiliation, count(*) AS k, array_to_string(list_transform(list({'p': -core_papers, 'i': cand_id, 'n': name} ORDER BY -core_papers, cand_id), lambda x: coalesce(x.n, '') || ':' || cast(-x.p AS VARCHAR)), ';') AS people FROM candidates_csrankings WHERE core_papers IS NOT NULL GROUP BY affiliation")
def agg_nested_array(spark: SparkSession, d: str) -> DataFrame:
    """People of an affiliation, most papers first, as one nested list."""
    g = table(spark, d, "candidates_csrankings").filter("core_papers is not null").groupBy("affiliation").agg(F.count("*").alias("k"), F.array_sort(F.collect_list(F.struct((-F.col("core_papers")).alias("p"), "cand_id", "name"))).alias("l"))
    return g.select("affiliation", "k", F.array_join(F.transform("l", lambda x: F.concat(F.coalesce(x["name"], F.lit("")), F.lit(":"), (-x["p"]).cast("string"))), ";").alias("people"))


@query("WITH t AS (SELECT DISTINCT name FROM roster WHERE name IS NOT NULL), c AS (SELECT DISTINCT name FROM candidates_csrankings) SELECT count(*) AS n, round(avg(CASE WHEN c.name IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS recall FROM t LEFT JOIN c ON t.name = c.name")
def agg_recall(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "roster").filter("name is not null").select("name").distinct()
    c = table(spark, d, "candidates_csrankings").select("name").distinct().withColumn("hit", F.lit(1.0))
    return t.join(c, "name", "left").agg(_n(), F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("recall"))


@query("SELECT inst_id, count(DISTINCT source) AS n_sources, count(DISTINCT source) < 2 AS low_confidence FROM institutions_geocoded_precise GROUP BY inst_id")
def redundancy_gate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "institutions_geocoded_precise").groupBy("inst_id").agg(F.count_distinct("source").alias("n_sources")).withColumn("low_confidence", F.col("n_sources") < 2)


# Windows and orders


@query("SELECT name, arg_min(pid, pid) AS pid FROM (SELECT primary_name AS name, pid FROM dblp_persons) GROUP BY name")
def win_first_per_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dblp_persons").groupBy(F.col("primary_name").alias("name")).agg(F.min("pid").alias("pid"))


@query("SELECT affiliation, name, cand_id FROM (SELECT *, row_number() OVER (PARTITION BY affiliation, name ORDER BY cand_id) AS r FROM candidates_csrankings) WHERE r = 1")
def preview_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The first of repeated rows: an aggregate, so that copies fall away before the shuffle."""
    return table(spark, d, "candidates_csrankings").groupBy("affiliation", "name").agg(F.min("cand_id").alias("cand_id"))


@query("SELECT inst_id, arg_min(site_id, (shift_from_city_km, site_id)) AS site_id, min(shift_from_city_km) AS km FROM institutions_geocoded_precise WHERE shift_from_city_km IS NOT NULL GROUP BY inst_id")
def argmin(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "institutions_geocoded_precise").filter("shift_from_city_km is not null")
    return p.groupBy("inst_id").agg(F.min_by("site_id", F.struct("shift_from_city_km", "site_id")).alias("site_id"), F.min("shift_from_city_km").alias("km"))


@query("SELECT country, inst_key FROM (SELECT lower(country) AS country, inst_key, row_number() OVER (PARTITION BY lower(country) ORDER BY coalesce(domain_match, false) DESC, coalesce(similarity, -1) DESC, inst_key) AS r FROM institutions_geocoded) WHERE r = 1")
def argmax_lexi(spark: SparkSession, d: str) -> DataFrame:
    """The best row by several keys in order, the first at a tie."""
    order = F.struct(F.coalesce("domain_match", F.lit(False)).alias("d"), F.coalesce("similarity", F.lit(-1.0)).alias("s"), (-F.col("inst_key")).alias("i"))
    return table(spark, d, "institutions_geocoded").groupBy(F.lower("country").alias("country")).agg(F.max_by("inst_key", order).alias("inst_key"))


@query("SELECT country, cand_id, row_number() OVER (PARTITION BY country ORDER BY core_papers DESC NULLS LAST, cand_id) AS place FROM candidates_csrankings")
def rank_rows(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("country").orderBy(F.desc_nulls_last("core_papers"), "cand_id")
    return table(spark, d, "candidates_csrankings").select("country", "cand_id", F.row_number().over(w).cast("long").alias("place"))


@query("""
WITH s AS (SELECT inst_id, site_id, shift_from_city_km AS km, CASE geocode_precision WHEN 'building' THEN 1 WHEN 'street' THEN 2 WHEN 'district' THEN 3 WHEN 'area' THEN 4 ELSE 5 END AS stage FROM institutions_geocoded_precise WHERE shift_from_city_km <= 30),
m AS (SELECT inst_id, min(stage) AS stage FROM s GROUP BY inst_id)
SELECT s.inst_id, s.stage, arg_min(s.site_id, (s.km, s.site_id)) AS site_id FROM s JOIN m ON s.inst_id = m.inst_id AND s.stage = m.stage GROUP BY s.inst_id, s.stage
""")
def first_nonempty_stage(spark: SparkSession, d: str) -> DataFrame:
    """The first stage that yields anything, and in it the nearest: one aggregate over a struct."""
    stage = F.when(F.col("geocode_precision") == "building", 1).when(F.col("geocode_precision") == "street", 2).when(F.col("geocode_precision") == "district", 3).when(F.col("geocode_precision") == "area", 4).otherwise(5)
    p = table(spark, d, "institutions_geocoded_precise").filter("shift_from_city_km <= 30")
    g = p.groupBy("inst_id").agg(F.min(F.struct(stage.alias("stage"), F.col("shift_from_city_km").alias("km"), "site_id")).alias("m"))
    return g.select("inst_id", "m.stage", "m.site_id")


@query("SELECT country, name, cand_id FROM candidates_csrankings ORDER BY country NULLS FIRST, name NULLS FIRST, cand_id")
def sort_multi(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates_csrankings").select("country", "name", "cand_id").orderBy("country", "name", "cand_id")


@query("SELECT cand_id, core_papers FROM candidates_csrankings ORDER BY core_papers DESC NULLS LAST, cand_id LIMIT 40")
def topk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates_csrankings").select("cand_id", "core_papers").orderBy(F.desc_nulls_last("core_papers"), "cand_id").limit(40)


@query("SELECT cand_id, name FROM candidates_csrankings ORDER BY cand_id LIMIT 200 OFFSET 200")
def paginate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates_csrankings").select("cand_id", "name").orderBy("cand_id").offset(200).limit(200)


@query("SELECT venue, count(*) AS n FROM authorships GROUP BY venue ORDER BY n DESC, venue LIMIT 10")
def topk_groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "authorships").groupBy("venue").agg(_n()).orderBy(F.desc("n"), "venue").limit(10)


@query("""
WITH r AS (SELECT inst_id, site_id, shift_from_city_km AS km, row_number() OVER (PARTITION BY inst_id ORDER BY shift_from_city_km, site_id) AS r FROM institutions_geocoded_precise WHERE shift_from_city_km IS NOT NULL)
SELECT inst_id, string_agg(cast(site_id AS VARCHAR), ' ' ORDER BY km, site_id) AS nearest FROM r WHERE r <= 6 GROUP BY inst_id
""")
def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    """Six per group, rendered to a text; the window filter keeps groups from being gathered whole."""
    w = Window.partitionBy("inst_id").orderBy("shift_from_city_km", "site_id")
    p = table(spark, d, "institutions_geocoded_precise").filter("shift_from_city_km is not null").select("inst_id", "site_id", "shift_from_city_km", F.row_number().over(w).alias("r")).filter("r <= 6")
    return p.groupBy("inst_id").agg(F.array_sort(F.collect_list(F.struct("shift_from_city_km", "site_id"))).alias("l")).select("inst_id", F.array_join(F.transform("l", lambda x: x["site_id"].cast("string")), " ").alias("nearest"))


# Sets


@query("SELECT name, 'roster' AS origin FROM roster UNION ALL SELECT name, 'candidate' FROM candidates_csrankings")
def set_union_all(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "roster").select("name", F.lit("roster").alias("origin"))
    return a.unionByName(table(spark, d, "candidates_csrankings").select("name", F.lit("candidate").alias("origin")))


@query("SELECT name FROM roster UNION SELECT name FROM candidates_csrankings")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "roster").select("name").union(table(spark, d, "candidates_csrankings").select("name")).distinct()


@query("SELECT name FROM roster EXCEPT SELECT name FROM candidates_csrankings")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "roster").select("name").subtract(table(spark, d, "candidates_csrankings").select("name"))


@query("SELECT name FROM roster INTERSECT SELECT name FROM candidates_csrankings")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "roster").select("name").intersect(table(spark, d, "candidates_csrankings").select("name"))


@query("SELECT cand_id, len(list_intersect(string_split(coalesce(venues, ''), ';'), ['CLV', 'NLPRA', 'RLSYS'])) > 0 AS hit FROM candidates_csrankings")
def array_overlap(spark: SparkSession, d: str) -> DataFrame:
    hit = F.arrays_overlap(F.split(F.coalesce("venues", F.lit("")), ";"), F.array(*map(F.lit, ("CLV", "NLPRA", "RLSYS"))))
    return table(spark, d, "candidates_csrankings").select("cand_id", hit.alias("hit"))


# Lookup caches


@query("SELECT i.inst_key, c.geocode_display FROM institutions_geocoded i LEFT JOIN (SELECT geocode_query, min(geocode_display) AS geocode_display FROM institutions_geocoded_precise WHERE coalesce(geocode_display, '') <> '' GROUP BY geocode_query) c ON i.name || ', ' || i.city_expected = c.geocode_query")
def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Answers of an earlier lookup, empty ones left out, joined to the questions."""
    i, c = _questions(spark, d)
    return i.join(c, "geocode_query", "left").select("inst_key", "geocode_display")


@query("SELECT i.inst_key FROM institutions_geocoded i WHERE NOT EXISTS (SELECT 1 FROM institutions_geocoded_precise c WHERE coalesce(geocode_display, '') <> '' AND c.geocode_query = i.name || ', ' || i.city_expected)")
def cache_miss(spark: SparkSession, d: str) -> DataFrame:
    i, c = _questions(spark, d)
    return i.join(c, "geocode_query", "left_anti").select("inst_key")


def _questions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    i = table(spark, d, "institutions_geocoded").select("inst_key", F.concat("name", F.lit(", "), "city_expected").alias("geocode_query"))
    c = table(spark, d, "institutions_geocoded_precise").filter(F.coalesce("geocode_display", F.lit("")) != "").groupBy("geocode_query").agg(F.min("geocode_display").alias("geocode_display"))
    return i, c


@query("""
WITH h AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY retrieved_at DESC NULLS LAST, doc_id) AS r FROM documents)
SELECT source, doc_id FROM h WHERE r = 1
""")
def source_authority(spark: SparkSession, d: str) -> DataFrame:
    """The freshest row of each source."""
    docs = table(spark, d, "documents")
    return docs.groupBy("source").agg(F.max_by("doc_id", F.struct(F.col("retrieved_at").isNotNull(), "retrieved_at", -F.col("doc_id"))).alias("doc_id"))

