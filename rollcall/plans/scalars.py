"""Projections and scalar functions over the domain tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions import names as N
from rollcall.functions.text_udfs import name_agrees as name_agrees_udf
from rollcall.functions.text_udfs import sequence_ratio
from rollcall.plans.registry import Registry
from rollcall.session import table

R = Registry()
query = R.query


def _sql_plain(c: str) -> str:
    return f"strip_accents(lower(replace(coalesce({c}, ''), chr(160), ' ')))"


def _sql_squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def _sql_name(c: str) -> str:
    x = _sql_squeeze(f"regexp_replace(regexp_replace({_sql_plain(c)}, '\\s+\\d{{4}}$', ''), '[^a-z ]+', ' ', 'g')")
    for _ in range(4):
        x = f"list_extract(list_transform([{x}], lambda v: CASE WHEN trim(regexp_replace(v, '{N._TITLE}', '')) = '' THEN v ELSE trim(regexp_replace(v, '{N._TITLE}', '')) END), 1)"
    return x


def _sql_inst(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({_sql_plain(c)}, '\\s+\\d{{4}}$', ''), '[^a-z0-9 ]+', ' ', 'g'))"


def _sql_city(c: str) -> str:
    pairs = ", ".join(f"'{k}': '{v}'" for k, v in N.CITY_NAMES.items())
    x = f"replace(replace(replace({_sql_inst(c)}, 'ue', 'u'), 'oe', 'o'), 'ae', 'a')"
    return f"list_extract(list_transform([{x}], lambda v: coalesce(MAP {{{pairs}}}[v], v)), 1)"


def _sql_distinctive(c: str) -> str:
    generic = ", ".join(f"'{w}'" for w in N.GENERIC_WORDS.split())
    return f"list_distinct(list_filter(string_split({_sql_inst(c)}, ' '), lambda w: length(w) > 3 AND w NOT IN ({generic})))"


@query(f"SELECT cand_id, {_sql_name('name')} AS folded FROM candidates_csrankings")
def fold_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates_csrankings").select("cand_id", N.fold_name(F.col("name")).alias("folded"))


@query(f"SELECT pid, {_sql_squeeze('regexp_replace(' + _sql_plain('primary_name') + chr(44) + ' ' + repr('[^a-z0-9 ]+') + ', ' + repr(' ') + ', ' + repr('g') + ')')} AS folded FROM dblp_persons")
def fold_keep_suffix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dblp_persons").select("pid", N.fold_keep_suffix(F.col("primary_name")).alias("folded"))


@query(f"SELECT roster_id, trim(regexp_replace({_sql_plain('title_verbatim')}, '[^a-z0-9 ]+', ' ', 'g')) AS folded FROM roster")
def fold_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "roster").select("roster_id", N.fold_title(F.col("title_verbatim")).alias("folded"))


@query(f"SELECT inst_key, {_sql_plain('name')} AS folded FROM institutions_geocoded")
def fold_plain(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "institutions_geocoded").select("inst_key", N.fold_plain(F.col("name")).alias("folded"))


@query(f"SELECT inst_key, {_sql_inst('name')} AS folded FROM institutions_geocoded")
def fold_inst(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "institutions_geocoded").select("inst_key", N.fold_inst(F.col("name")).alias("folded"))


@query(f"SELECT pid, trim(regexp_replace(regexp_replace({_sql_plain('primary_name')}, '\\s+\\d{{4}}$', ''), '[^a-z ]+', ' ', 'g')) AS folded FROM dblp_persons")
def fold_author(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dblp_persons").select("pid", N.fold_author(F.col("primary_name")).alias("folded"))


_KEYS = f"""
WITH f AS (SELECT cand_id, {_sql_name('name')} AS folded FROM candidates_csrankings),
p AS (SELECT *, list_filter(string_split(folded, ' '), lambda w: w <> '') AS parts FROM f),
u AS (SELECT *, CASE WHEN len(list_filter(parts, lambda w: length(w) > 1)) >= 2 THEN list_filter(parts, lambda w: length(w) > 1) ELSE parts END AS used FROM p)
"""


@query(_KEYS + "SELECT cand_id, folded AS full_key, CASE WHEN len(parts) >= 2 THEN used[1] || ' ' || used[-1] END AS first_last, CASE WHEN len(parts) >= 2 THEN used[1][1] || ' ' || used[-1] END AS initial_last FROM u")
def name_keys(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "candidates_csrankings").select("cand_id", N.fold_name(F.col("name")).alias("full_key"))
    df = df.withColumn("p", N.name_parts(F.col("full_key")))
    return df.select("cand_id", "full_key", (F.concat("p.first", F.lit(" "), "p.last")).alias("first_last"), F.concat(F.substring("p.first", 1, 1), F.lit(" "), "p.last").alias("initial_last"))


@query(f"SELECT roster_id, {_sql_squeeze('regexp_replace(trim(regexp_replace(' + _sql_plain('title_verbatim') + f''', '[^a-z0-9 ]+', ' ', 'g')), '\\b(?:{N.DECORATIONS})\\b', ' ', 'g')''')} AS rank_word FROM roster")
def normalise_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "roster").select("roster_id", N.normalise_title(F.col("title_verbatim")).alias("rank_word"))


@query("SELECT roster_id, unnest(list_filter(list_transform(string_split(coalesce(title_verbatim, ''), ' / '), lambda x: trim(x)), lambda x: x <> '')) AS alternative FROM roster")
def title_alternatives(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "roster").select("roster_id", F.explode(N.title_alternatives(F.col("title_verbatim"))).alias("alternative"))


@query(f"SELECT inst_key, {_sql_city('city_expected')} AS city_key FROM institutions_geocoded")
def city_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "institutions_geocoded").select("inst_key", N.city_key(F.col("city_expected")).alias("city_key"))


def _sql_same(c: str) -> str:
    return f"replace(replace(replace(replace({_sql_name(c)}, 'ue', 'u'), 'oe', 'o'), 'ae', 'a'), 'ss', 's')"


@query(f"SELECT inst_key, {_sql_same('city_expected')} = {_sql_same('ror_city')} AS same_city FROM institutions_geocoded")
def same_city(spark: SparkSession, d: str) -> DataFrame:
    def key(c: str):
        x = N.fold_name(F.col(c))
        for a, b in (("ue", "u"), ("oe", "o"), ("ae", "a"), ("ss", "s")):
            x = F.replace(x, F.lit(a), F.lit(b))
        return x

    return table(spark, d, "institutions_geocoded").select("inst_key", (key("city_expected") == key("ror_city")).alias("same_city"))


@query("SELECT inst_key, left(regexp_replace(regexp_replace(lower(coalesce(name, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80) AS slug FROM institutions_geocoded")
def slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "institutions_geocoded").select("inst_key", N.slug(F.col("name")).alias("slug"))


@query(f"SELECT inst_key, array_to_string(list_sort({_sql_distinctive('name')}), ' ') AS tokens FROM institutions_geocoded")
def distinctive_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "institutions_geocoded").select("inst_key", F.array_join(F.array_sort(N.distinctive_tokens(F.col("name"))), " ").alias("tokens"))


_AGREE = f"""
WITH p AS (SELECT cand_id, c.affiliation AS a, i.name AS b FROM candidates_csrankings c JOIN dblp_persons d ON c.dblp_pid = d.pid JOIN institutions_geocoded i ON d.affiliations_current = i.name),
f AS (SELECT *, {_sql_inst('a')} AS fa, {_sql_inst('b')} AS fb, {_sql_distinctive('a')} AS da, {_sql_distinctive('b')} AS db FROM p)
SELECT cand_id, list_has_any(da, db) OR (fa <> '' AND fb <> '' AND (contains(fa, fb) OR contains(fb, fa))) AS agrees FROM f
"""


def _affiliation_pairs(spark: SparkSession, d: str) -> DataFrame:
    c, p, i = table(spark, d, "candidates_csrankings"), table(spark, d, "dblp_persons"), table(spark, d, "institutions_geocoded")
    pairs = c.select("cand_id", F.col("affiliation").alias("a"), "dblp_pid").join(p.select("pid", "affiliations_current"), F.col("dblp_pid") == F.col("pid"))
    return pairs.join(i.select(F.col("name").alias("b"), "city_expected"), F.col("affiliations_current") == F.col("b"))


@query(_AGREE)
def names_agree(spark: SparkSession, d: str) -> DataFrame:
    return _affiliation_pairs(spark, d).select("cand_id", N.names_agree(F.col("a"), F.col("b")).alias("agrees"))


@query()
def name_agrees(spark: SparkSession, d: str) -> DataFrame:
    """Graded agreement of institution names; no SQL equivalent."""
    pairs = _affiliation_pairs(spark, d)
    return pairs.select("cand_id", name_agrees_udf(N.fold_title(F.col("a")), N.fold_title(F.col("b")), N.fold_title(F.col("city_expected"))).alias("agrees"))


@query()
def seq_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Ratcliff-Obershelp similarity; no SQL equivalent."""
    return _affiliation_pairs(spark, d).select("cand_id", F.round(sequence_ratio(N.fold_plain(F.col("a")), N.fold_plain(F.col("b"))), 6).alias("ratio"))


@query(f"""
WITH w AS (SELECT cand_id, i.city_expected AS city, list_filter(regexp_split_to_array(coalesce(c.affiliation, ''), '[^A-Za-zÀ-ÿ]+'), lambda x: x <> '') AS words
           FROM candidates_csrankings c JOIN dblp_persons p ON c.dblp_pid = p.pid JOIN institutions_geocoded i ON p.affiliations_current = i.name),
u AS (SELECT cand_id, city, unnest(words) AS word FROM w), k AS (SELECT DISTINCT cand_id FROM u WHERE {_sql_city('city')} <> '' AND {_sql_city('word')} = {_sql_city('city')})
SELECT DISTINCT cand_id, cand_id IN (SELECT cand_id FROM k) AS named FROM w
""")
def city_named_in(spark: SparkSession, d: str) -> DataFrame:
    pairs = _affiliation_pairs(spark, d).withColumn("k", N.city_key(F.col("city_expected")))
    return pairs.select("cand_id", N.city_named_in(F.col("a"), F.col("k")).alias("named")).groupBy("cand_id").agg(F.bool_or("named").alias("named"))


@query("SELECT cand_id, nullif(nullif(upper(regexp_extract(coalesce(orcid, ''), '(\\d{4}-\\d{4}-\\d{4}-\\d{3}[\\dXx])', 1)), ''), '0000-0000-0000-0000') AS orcid FROM candidates_csrankings")
def orcid_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates_csrankings").select("cand_id", N.clean_orcid(F.col("orcid")).alias("orcid"))


@query("SELECT pid, nullif(string_split(coalesce(aliases, ''), '|')[1], '') AS first_alias, array_to_string(string_split(coalesce(aliases, ''), '|')[2:], '|') AS other_aliases FROM dblp_persons")
def array_first_rest(spark: SparkSession, d: str) -> DataFrame:
    a = F.split(F.coalesce("aliases", F.lit("")), r"\|")
    return table(spark, d, "dblp_persons").select("pid", F.nullif(F.get(a, F.lit(0)), F.lit("")).alias("first_alias"), F.array_join(F.slice(a, 2, F.greatest(F.lit(1), F.size(a))), "|").alias("other_aliases"))


@query("""
WITH n AS (SELECT pid, unnest(list_concat(list_transform(string_split(coalesce(affiliations_current, ''), '|'), lambda x: 'current:' || x),
  list_transform(string_split(coalesce(affiliations_former, ''), '|'), lambda x: 'former:' || x), ['PhD ' || coalesce(cast(phd_year AS VARCHAR), '') || ':' || coalesce(affiliations_phd, '')])) AS note FROM dblp_persons)
SELECT pid, count(*) FILTER (note LIKE 'current:_%') AS n_current, count(*) FILTER (note LIKE 'former:_%') AS n_former, coalesce(max(try_cast(nullif(regexp_extract(note, '^PhD (\\d+)', 1), '') AS INTEGER)), 0) AS phd_year FROM n GROUP BY pid
""")
def label_partition(spark: SparkSession, d: str) -> DataFrame:
    """Notes by label: current, former, doctoral with the latest year."""
    tag = lambda label, c: F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.concat(F.lit(label), x))
    phd = F.concat(F.lit("PhD "), F.coalesce(F.col("phd_year").cast("string"), F.lit("")), F.lit(":"), F.coalesce("affiliations_phd", F.lit("")))
    notes = table(spark, d, "dblp_persons").select("pid", F.concat(tag("current:", "affiliations_current"), tag("former:", "affiliations_former"), F.array(phd)).alias("notes"))
    having = lambda label: F.size(F.filter("notes", lambda x: x.startswith(label) & (F.length(x) > len(label)))).cast("long")
    years = F.transform(F.filter("notes", lambda x: x.startswith("PhD")), lambda x: F.regexp_extract(x, r"^PhD (\d+)", 1).try_cast("int"))
    return notes.select("pid", having("current:").alias("n_current"), having("former:").alias("n_former"), F.coalesce(F.array_max(years), F.lit(0)).alias("phd_year"))


@query("SELECT cand_id, coalesce(try_cast(split_part(homepage, '-', 2) AS INTEGER), 0) AS n FROM candidates_csrankings")
def safe_int(spark: SparkSession, d: str) -> DataFrame:
    part = F.get(F.split("homepage", "-"), F.lit(1))
    return table(spark, d, "candidates_csrankings").select("cand_id", F.coalesce(part.try_cast("int"), F.lit(0)).alias("n"))


@query("SELECT venue, count(*) AS n, count(*) FILTER (contains(lower(coalesce(venue, '')), '-f')) AS n_findings FROM authorships GROUP BY venue")
def flag_contains(spark: SparkSession, d: str) -> DataFrame:
    flag = F.contains(F.lower(F.coalesce("venue", F.lit(""))), F.lit("-f"))
    return table(spark, d, "authorships").groupBy("venue").agg(F.count("*").alias("n"), F.count_if(flag).alias("n_findings"))


_HOST = "nullif(replace(lower(regexp_extract(coalesce({0}, ''), '(?i)https?://([^/]+)', 1)), 'www.', ''), '')"


@query(f"""
WITH h AS (SELECT roster_id, {_HOST.format('r.personal_url')} AS a, {_HOST.format('i.homepage')} AS b FROM roster r JOIN institutions_geocoded i USING (inst_id))
SELECT roster_id, a AS person_host, b AS home_host, coalesce(suffix(a, b) OR suffix(b, a), false) AS hit FROM h
""")
def host_match(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "roster").select("roster_id", "inst_id", N.host(F.col("personal_url")).alias("person_host"))
    i = table(spark, d, "institutions_geocoded").select("inst_id", N.host(F.col("homepage")).alias("home_host"))
    hit = F.endswith("person_host", F.col("home_host")) | F.endswith("home_host", F.col("person_host"))
    return r.join(i, "inst_id").select("roster_id", "person_host", "home_host", F.coalesce(hit, F.lit(False)).alias("hit"))


@query()
def display_name(spark: SparkSession, d: str) -> DataFrame:
    """The display name among typed names: the first of type display, else the first, else ''."""
    i = table(spark, d, "institutions_geocoded").select("inst_key", F.array(F.struct(F.lit("label").alias("type"), F.col("name").alias("value")), F.struct(F.lit("ror_display").alias("type"), F.col("ror_name").alias("value"))).alias("names"))
    shown = F.filter("names", lambda n: (n["type"] == "ror_display") & (F.coalesce(n["value"], F.lit("")) != ""))
    return i.select("inst_key", F.coalesce(F.get(shown, F.lit(0))["value"], F.get("names", F.lit(0))["value"], F.lit("")).alias("display_name"))


@query("""SELECT geocode_precision, CASE WHEN regexp_matches(coalesce(geocode_display, ''), '^\\d+ ') THEN 'building' WHEN contains(coalesce(geocode_display, ''), 'Street') THEN 'street'
WHEN contains(coalesce(geocode_display, ''), ',') THEN 'district' ELSE 'area' END AS precision_found, count(*) AS n FROM institutions_geocoded_precise GROUP BY ALL""")
def precision_case(spark: SparkSession, d: str) -> DataFrame:
    shown = F.coalesce("geocode_display", F.lit(""))
    case = F.when(shown.rlike(r"^\d+ "), "building").when(shown.contains("Street"), "street").when(shown.contains(","), "district").otherwise("area")
    return table(spark, d, "institutions_geocoded_precise").groupBy("geocode_precision", case.alias("precision_found")).agg(F.count("*").alias("n"))


@query("SELECT counts_as_pi, lower(trim(coalesce(counts_as_pi, ''))) IN ('yes', 'y', 'true') AS truth, count(*) AS n FROM titles GROUP BY ALL")
def truthy(spark: SparkSession, d: str) -> DataFrame:
    truth = F.lower(F.trim(F.coalesce("counts_as_pi", F.lit("")))).isin("yes", "y", "true")
    return table(spark, d, "titles").groupBy("counts_as_pi", truth.alias("truth")).agg(F.count("*").alias("n"))


@query("SELECT roster_id, coalesce(nullif(site, ''), nullif(group_or_dept, ''), nullif(other_affiliations, ''), '') AS place FROM roster")
def coalesce_nonempty(spark: SparkSession, d: str) -> DataFrame:
    some = [F.nullif(F.col(c), F.lit("")) for c in ("site", "group_or_dept", "other_affiliations")]
    return table(spark, d, "roster").select("roster_id", F.coalesce(*some, F.lit("")).alias("place"))


@query("SELECT doc_id, left(text, 60) AS head, length(text) AS n FROM documents")
def truncate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.substring("text", 1, 60).alias("head"), F.length("text").cast("long").alias("n"))


@query("""
WITH c AS (SELECT site_id, 'CRS3035RES1000mN' || cast(floor(lat * 50000) AS BIGINT) || 'E' || cast(floor((lon + 90) * 50000) AS BIGINT) AS cell FROM institutions_geocoded_precise WHERE lat > 0 AND lon > -90)
SELECT site_id, cast(regexp_extract(cell, 'N(\\d+)E', 1) AS BIGINT) + 500 AS north, cast(regexp_extract(cell, 'E(\\d+)$', 1) AS BIGINT) + 500 AS east FROM c
""")
def cell_id_parse(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "institutions_geocoded_precise").filter("lat > 0 and lon > -90")
    c = s.select("site_id", F.concat(F.lit("CRS3035RES1000mN"), F.floor(F.col("lat") * 50000), F.lit("E"), F.floor((F.col("lon") + 90) * 50000)).alias("cell"))
    return c.select("site_id", (F.regexp_extract("cell", r"N(\d+)E", 1).cast("long") + 500).alias("north"), (F.regexp_extract("cell", r"E(\d+)$", 1).cast("long") + 500).alias("east"))


@query("SELECT pid, trim(split_part(split_part(coalesce(affiliations_current, ''), '|', 1), ',', 1)) AS segment FROM dblp_persons")
def primary_segment(spark: SparkSession, d: str) -> DataFrame:
    a = F.coalesce("affiliations_current", F.lit(""))
    return table(spark, d, "dblp_persons").select("pid", F.trim(F.substring_index(F.substring_index(a, "|", 1), ",", 1)).alias("segment"))


@query("SELECT country, cast(100 * count(*) FILTER (nullif(orcid, '') IS NOT NULL) // count(*) AS BIGINT) || '%' AS share, format('{:,}', sum(core_papers)::BIGINT) AS papers FROM candidates_csrankings GROUP BY country")
def fmt_pct(spark: SparkSession, d: str) -> DataFrame:
    with_orcid = F.count_if(F.nullif("orcid", F.lit("")).isNotNull())
    share = F.concat(F.floor(100 * with_orcid / F.count("*")).cast("string"), F.lit("%"))
    return table(spark, d, "candidates_csrankings").groupBy("country").agg(share.alias("share"), F.format_number(F.sum("core_papers"), 0).alias("papers"))


@query(f"SELECT cand_id, replace({_sql_name('name')}, ' ', '-') AS person_id FROM candidates_csrankings")
def person_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates_csrankings").select("cand_id", F.replace(N.fold_name(F.col("name")), F.lit(" "), F.lit("-")).alias("person_id"))


@query("SELECT roster_id, replace(replace(replace(replace(replace(title_verbatim, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;') AS html FROM roster")
def html_escape(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("title_verbatim")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return table(spark, d, "roster").select("roster_id", c.alias("html"))


@query("SELECT inst_key, to_base64(encode(coalesce(name, ''))) AS packed, coalesce(name, '') AS unpacked FROM institutions_geocoded")
def base64_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    packed = F.base64(F.encode(F.coalesce("name", F.lit("")), "UTF-8"))
    return table(spark, d, "institutions_geocoded").select("inst_key", F.replace(packed, F.lit("\r\n"), F.lit("")).alias("packed"), F.decode(F.unbase64(packed), "UTF-8").alias("unpacked"))


@query("SELECT cand_id, CASE WHEN extended_papers > 0 THEN round(100000.0 * core_papers / extended_papers, 4) ELSE 0 END AS ratio FROM candidates_csrankings")
def safe_ratio(spark: SparkSession, d: str) -> DataFrame:
    r = F.when(F.col("extended_papers") > 0, F.round(F.lit(100000.0).cast("double") * F.col("core_papers") / F.col("extended_papers"), 4)).otherwise(F.lit(0.0))
    return table(spark, d, "candidates_csrankings").select("cand_id", r.alias("ratio"))


@query("SELECT cand_id, least(greatest(core_papers, 2), 10) AS clamped FROM candidates_csrankings")
def clamp(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates_csrankings").select("cand_id", F.least(F.greatest("core_papers", F.lit(2)), F.lit(10)).alias("clamped"))


@query("SELECT cand_id, array_to_string(list_filter(string_split(coalesce(venues, ''), ';'), lambda x: x <> ''), ',') AS venues, len(list_filter(string_split(coalesce(venues, ''), ';'), lambda x: x <> '')) AS n FROM candidates_csrankings")
def split_nonempty(spark: SparkSession, d: str) -> DataFrame:
    v = F.filter(F.split(F.coalesce("venues", F.lit("")), ";"), lambda x: x != "")
    return table(spark, d, "candidates_csrankings").select("cand_id", F.array_join(v, ",").alias("venues"), F.size(v).cast("long").alias("n"))
