"""Identity resolution and the ledger over the domain tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions import names as N
from rollcall.operators import identity as I  # noqa: E741
from rollcall.operators import ledger as L
from rollcall.plans.registry import Registry
from rollcall.plans.relational import author_counts
from rollcall.plans.scalars import _sql_city, _sql_name, _sql_plain, _sql_squeeze
from rollcall.session import table

R = Registry()
query = R.query


def _sql_keep(c: str) -> str:
    return _sql_squeeze(f"regexp_replace({_sql_plain(c)}, '[^a-z0-9 ]+', ' ', 'g')")


def _sql_parts(src: str, keep: str, name: str) -> str:
    """A CTE body: keep, name, folded f, exact e, first a and last z."""
    return f"""
SELECT {keep}, nm, f, e, CASE WHEN len(p) >= 2 THEN u[1] END AS a, CASE WHEN len(p) >= 2 THEN u[-1] END AS z FROM (
 SELECT *, CASE WHEN len(list_filter(p, lambda w: length(w) > 1)) >= 2 THEN list_filter(p, lambda w: length(w) > 1) ELSE p END AS u FROM (
  SELECT *, list_filter(string_split(f, ' '), lambda w: w <> '') AS p FROM (SELECT *, {name} AS nm, {_sql_name(name)} AS f, {_sql_keep(name)} AS e FROM {src})))"""


_INDEX = f"""
WITH forms AS (SELECT primary_name AS target, primary_name AS form FROM dblp_persons UNION ALL SELECT primary_name, unnest(string_split(aliases, '|')) FROM dblp_persons WHERE coalesce(aliases, '') <> ''),
fk AS ({_sql_parts("(SELECT * FROM forms WHERE coalesce(form, '') <> '')", 'target', 'form')}),
keys AS (SELECT DISTINCT kind, key, target FROM (
 SELECT 'exact' AS kind, e AS key, target FROM fk WHERE f <> '' UNION ALL SELECT 'full', f, target FROM fk WHERE f <> ''
 UNION ALL SELECT 'first_last', a || ' ' || z, target FROM fk WHERE f <> '' UNION ALL SELECT 'initial_last', a[1] || ' ' || z, target FROM fk WHERE f <> '') WHERE coalesce(key, '') <> ''),
idx AS (SELECT kind, key, count(*) AS n, min(target) AS target FROM keys GROUP BY kind, key)
"""


def _sql_resolve(src: str, key: str, name: str) -> str:
    return f"""{_INDEX},
q AS ({_sql_parts(src, key, name)}),
t AS (SELECT {key}, 1 AS rank, 'exact' AS kind, CASE WHEN regexp_matches(trim(coalesce(nm, '')), '\\s\\d{{4}}$') THEN e END AS k FROM q UNION ALL SELECT {key}, 2, 'full', f FROM q
 UNION ALL SELECT {key}, 3, 'first_last', a || ' ' || z FROM q UNION ALL SELECT {key}, 4, 'initial_last', CASE WHEN length(a) = 1 THEN a || ' ' || z END FROM q),
m AS (SELECT {key}, arg_min({{'kind': t.kind, 'n': n, 'target': target}}, rank) AS m FROM t JOIN idx ON t.kind = idx.kind AND t.k = idx.key GROUP BY {key}),
res AS (SELECT q.{key}, CASE WHEN f <> '' AND (m.n = 1 OR m.kind = 'exact') THEN m.target END AS target,
 CASE WHEN f = '' THEN 'empty' WHEN m IS NULL THEN 'no_match' WHEN m.n = 1 OR m.kind = 'exact' THEN m.kind ELSE 'ambiguous_' || m.kind END AS how FROM q LEFT JOIN m ON q.{key} = m.{key})
"""


def _keys(spark: SparkSession, d: str) -> DataFrame:
    return I.key_table(I.person_forms(table(spark, d, "dblp_persons")))


@query(_INDEX + "SELECT kind, key, n, target FROM idx")
def identity_index(spark: SparkSession, d: str) -> DataFrame:
    return I.index(_keys(spark, d))


@query(f"""{_INDEX},
w AS (SELECT DISTINCT author AS target, {_sql_name('author')} AS f, {_sql_keep('author')} AS e FROM authorships)
SELECT f AS key, min(target) AS target FROM w WHERE f <> '' AND f NOT IN (SELECT key FROM keys WHERE kind = 'full') AND e NOT IN (SELECT key FROM keys WHERE kind = 'exact') GROUP BY f
""")
def identity_weak_add(spark: SparkSession, d: str) -> DataFrame:
    return I.weak_names(table(spark, d, "authorships"), _keys(spark, d))


@query(_sql_resolve("candidates_csrankings", "cand_id", "name") + "SELECT cand_id, target, how FROM res")
def identity_resolve(spark: SparkSession, d: str) -> DataFrame:
    return I.resolve(table(spark, d, "candidates_csrankings"), "cand_id", "name", I.index(_keys(spark, d)))


_COULD = ", could AS (SELECT DISTINCT {key}, target FROM t JOIN keys ON t.kind = keys.kind AND t.k = keys.key WHERE t.kind IN ('full', 'first_last'))"


@query(_sql_resolve("candidates_csrankings", "cand_id", "name") + _COULD.format(key="cand_id") + " SELECT cand_id, target FROM could")
def identity_candidates(spark: SparkSession, d: str) -> DataFrame:
    return I.candidates(table(spark, d, "candidates_csrankings"), "cand_id", "name", _keys(spark, d))


_ROSTER = "(SELECT r.roster_id, r.name, i.city_expected AS city FROM roster r JOIN institutions_geocoded i USING (inst_id))"


@query(_sql_resolve(_ROSTER, "roster_id", "name") + _COULD.format(key="roster_id") + f""",
pl AS (SELECT target, list_filter(regexp_split_to_array(aff, '[^A-Za-zÀ-ÿ]+'), lambda x: x <> '') AS words FROM (SELECT primary_name AS target, concat_ws(' ', coalesce(affiliations_current, ''), coalesce(affiliations_former, '')) AS aff FROM dblp_persons)),
pw AS (SELECT DISTINCT target, {_sql_city('w')} AS ck FROM (SELECT target, unnest(words) AS w FROM pl)),
want AS (SELECT roster_id, {_sql_city('city')} AS ck FROM {_ROSTER}),
named AS (SELECT DISTINCT c.roster_id, c.target FROM could c JOIN want USING (roster_id) JOIN pw ON pw.target = c.target AND pw.ck = want.ck WHERE want.ck <> ''),
hits AS (SELECT roster_id, count(*) AS n, min(target) AS only_one FROM named GROUP BY roster_id)
SELECT res.roster_id, CASE WHEN named.target IS NULL AND hits.n = 1 THEN only_one ELSE res.target END AS target, CASE WHEN named.target IS NULL AND hits.n = 1 THEN 'affiliation' ELSE how END AS how
FROM res LEFT JOIN named ON res.roster_id = named.roster_id AND res.target = named.target LEFT JOIN hits ON res.roster_id = hits.roster_id
""")
def identity_city_tiebreak(spark: SparkSession, d: str) -> DataFrame:
    asked = _roster_cities(spark, d)
    keys = _keys(spark, d)
    places = table(spark, d, "dblp_persons").select(F.col("primary_name").alias("target"), F.concat_ws(" ", F.coalesce("affiliations_current", F.lit("")), F.coalesce("affiliations_former", F.lit(""))).alias("affiliation"))
    return I.settle_by_city(asked, "roster_id", "city", I.resolve(asked, "roster_id", "name", I.index(keys)), I.candidates(asked, "roster_id", "name", keys), places)


def _roster_cities(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "institutions_geocoded").select("inst_id", F.col("city_expected").alias("city"))
    return table(spark, d, "roster").select("roster_id", "inst_id", "name").join(i, "inst_id").select("roster_id", "name", "city")


@query(_sql_resolve("roster", "roster_id", "name") + "SELECT r.inst_id, how, count(*) AS n FROM res JOIN roster r USING (roster_id) GROUP BY ALL")
def roster_check(spark: SparkSession, d: str) -> DataFrame:
    """How the names of each roster resolve."""
    r = table(spark, d, "roster")
    return I.resolve(r, "roster_id", "name", I.index(_keys(spark, d))).join(r.select("roster_id", "inst_id"), "roster_id").groupBy("inst_id", "how").agg(F.count("*").alias("n"))


@query(_sql_resolve("roster", "roster_id", "name") + _COULD.format(key="roster_id") + """,
cnt AS (SELECT author, count(*) FILTER (layer = 'core' AND NOT is_findings) AS core FROM authorships GROUP BY author),
c AS (SELECT could.roster_id, could.target, coalesce(core, 0) AS core, row_number() OVER (PARTITION BY could.roster_id ORDER BY coalesce(core, 0) DESC, could.target) AS r
      FROM could JOIN res ON could.roster_id = res.roster_id LEFT JOIN cnt ON could.target = author WHERE how LIKE 'ambiguous%')
SELECT roster_id, string_agg(target || ' (' || core || ')', '; ' ORDER BY core DESC, target) AS candidates FROM c WHERE r <= 6 GROUP BY roster_id
""")
def identity_queue(spark: SparkSession, d: str) -> DataFrame:
    """The refused names with their six most published candidates."""
    r, keys = table(spark, d, "roster"), _keys(spark, d)
    refused = I.resolve(r, "roster_id", "name", I.index(keys)).filter("how like 'ambiguous%'").select("roster_id")
    c = I.candidates(r, "roster_id", "name", keys).join(refused, "roster_id").join(author_counts(spark, d).select("author", "core"), F.col("target") == F.col("author"), "left")
    c = c.select("roster_id", (-F.coalesce("core", F.lit(0))).alias("less"), "target")
    best = c.groupBy("roster_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("less", "target"))), 1, 6).alias("l"))
    return best.select("roster_id", F.array_join(F.transform("l", lambda x: F.concat(x["target"], F.lit(" ("), (-x["less"]).cast("string"), F.lit(")"))), "; ").alias("candidates"))


def _sql_author(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({_sql_plain(c)}, '\\s+\\d{{4}}$', ''), '[^a-z ]+', ' ', 'g'))"


@query(f"""
WITH o AS (SELECT orcid, min(pid) AS pid FROM dblp_persons WHERE coalesce(orcid, '') <> '' GROUP BY orcid),
a AS (SELECT {_sql_author('primary_name')} AS f, count(*) AS n, min(pid) AS pid FROM dblp_persons GROUP BY 1)
SELECT cand_id, coalesce(o.pid, CASE WHEN a.n = 1 THEN a.pid END) AS pid, CASE WHEN o.pid IS NOT NULL THEN 'orcid' WHEN a.n = 1 THEN 'name' WHEN a.n > 1 THEN 'ambiguous(' || a.n || ')' ELSE 'no_match' END AS how
FROM candidates_csrankings c LEFT JOIN o ON c.orcid = o.orcid LEFT JOIN a ON {_sql_author('c.name')} = a.f
""")
def author_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The identifier, else the one person of the folded name."""
    p, c = table(spark, d, "dblp_persons"), table(spark, d, "candidates_csrankings").select("cand_id", "orcid", N.fold_author(F.col("name")).alias("f"))
    o = p.filter(F.coalesce("orcid", F.lit("")) != "").groupBy("orcid").agg(F.min("pid").alias("by_orcid"))
    a = p.groupBy(N.fold_author(F.col("primary_name")).alias("f")).agg(F.count("*").alias("n"), F.min("pid").alias("by_name"))
    j = c.join(o, "orcid", "left").join(a, "f", "left")
    how = F.when(F.col("by_orcid").isNotNull(), "orcid").when(F.col("n") == 1, "name").when(F.col("n") > 1, F.concat(F.lit("ambiguous("), F.col("n"), F.lit(")"))).otherwise("no_match")
    return j.select("cand_id", F.coalesce("by_orcid", F.when(F.col("n") == 1, F.col("by_name"))).alias("pid"), how.alias("how"))


# Ledger: decisions on people, taken from the event stream.

_ENTRIES_SQL = """SELECT cast(user_id % 7 AS BIGINT) AS city, user_id AS person, event_type AS decision, '' AS reason_code, 'r' || cast(event_id % 3 AS VARCHAR) AS rule, 'stream' AS "by", cast(cast(floor(value) AS BIGINT) % 5 AS VARCHAR) AS evidence, event_id AS ord FROM events"""
_ID_SQL = """left(sha1(concat_ws('|', coalesce(city::VARCHAR, ''), coalesce(person::VARCHAR, ''), coalesce(decision, ''), coalesce(reason_code, ''), coalesce(rule, ''), coalesce("by", ''), coalesce(evidence, ''))), 12)"""
_LEDGER_SQL = f"WITH e AS ({_ENTRIES_SQL}), i AS (SELECT *, {_ID_SQL} AS id FROM e), l AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1)"


def decision_entries(events: DataFrame) -> DataFrame:
    """Ledger entries made of events."""
    return events.select(
        (F.col("user_id") % 7).alias("city"), F.col("user_id").alias("person"), F.col("event_type").alias("decision"), F.lit("").alias("reason_code"),
        F.concat(F.lit("r"), (F.col("event_id") % 3).cast("string")).alias("rule"), F.lit("stream").alias("by"), (F.floor("value") % 5).cast("string").alias("evidence"), F.col("event_id").alias("ord"),
    )


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    none = L.with_id(decision_entries(table(spark, d, "events"))).filter("false")
    return L.append(none, decision_entries(table(spark, d, "events")))


@query(f"WITH e AS ({_ENTRIES_SQL}) SELECT ord, {_ID_SQL} AS id FROM e")
def ledger_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return L.with_id(decision_entries(table(spark, d, "events"))).select("ord", "id")


@query(_LEDGER_SQL + " SELECT id, ord FROM l WHERE id NOT IN (SELECT id FROM i WHERE ord % 2 = 0)")
def ledger_append(spark: SparkSession, d: str) -> DataFrame:
    """What the odd entries add to a ledger of the even ones."""
    e = decision_entries(table(spark, d, "events"))
    return L.append(L.with_id(e.filter("ord % 2 = 0")), e).select("id", "ord")


@query(_LEDGER_SQL + " SELECT id, lag(id) OVER (PARTITION BY city, person ORDER BY ord, id) AS supersedes FROM l")
def ledger_supersedes(spark: SparkSession, d: str) -> DataFrame:
    return L.supersedes(_ledger(spark, d)).select("id", "supersedes")


@query(_LEDGER_SQL + " SELECT city, person, arg_max(decision, ord) AS decision, arg_max(id, ord) AS id FROM l GROUP BY city, person")
def ledger_current(spark: SparkSession, d: str) -> DataFrame:
    return L.current(_ledger(spark, d))


@query(_LEDGER_SQL + " SELECT id, person, decision FROM l WHERE contains(person::VARCHAR, '12')")
def ledger_history(spark: SparkSession, d: str) -> DataFrame:
    return L.history(_ledger(spark, d), "12").select("id", "person", "decision")


@query(_LEDGER_SQL + " SELECT city, person, string_agg(decision, ' -> ' ORDER BY ord, id) AS path FROM l GROUP BY city, person HAVING count(DISTINCT decision) > 1")
def ledger_flips(spark: SparkSession, d: str) -> DataFrame:
    return L.flips(_ledger(spark, d))
