"""Sources, sinks and streams over the domain tables: each round trip must give the table back."""

from __future__ import annotations

from string import ascii_lowercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.plans.identity import decision_entries
from rollcall.plans.registry import Registry
from rollcall.session import table
from rollcall.sources import files
from rollcall.streaming import ledger as stream

R = Registry()
query = R.query


def _text(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in columns])


_CAND = ["cand_id", "name", "affiliation", "homepage"]
_CAND_SQL = "SELECT cand_id, coalesce(name, '') AS name, coalesce(affiliation, '') AS affiliation, coalesce(homepage, '') AS homepage FROM candidates_csrankings"


def _back(df: DataFrame) -> DataFrame:
    return df.select(F.col("cand_id").cast("long").alias("cand_id"), *[F.coalesce(c, F.lit("")).alias(c) for c in _CAND[1:]])


@query(_CAND_SQL)
def scan_csv(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark, "csv")
    files.write_csv(_text(table(spark, d, "candidates_csrankings"), _CAND), path)
    return _back(files.read_csv(spark, path, _CAND))


@query(_CAND_SQL)
def scan_csv_gz(spark: SparkSession, d: str) -> DataFrame:
    """Compressed files aren't splittable: many of moderate size keep the read parallel."""
    path = files.scratch(spark, "csv-gz")
    files.write_csv(_text(table(spark, d, "candidates_csrankings"), _CAND).repartition(4), path, "gzip")
    return _back(files.read_csv(spark, path, _CAND))


@query("SELECT roster_id, coalesce(title_verbatim, '') AS title_verbatim, coalesce(name, '') AS name FROM roster")
def sink_csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path, columns = files.scratch(spark, "sink"), ["roster_id", "title_verbatim", "name"]
    files.write_csv(_text(table(spark, d, "roster"), columns), path)
    return files.read_csv(spark, path, columns).select(F.col("roster_id").cast("long").alias("roster_id"), *[F.coalesce(c, F.lit("")).alias(c) for c in columns[1:]])


def shards_back(spark: SparkSession, candidates: DataFrame, shards: list[str]) -> DataFrame:
    """(shard, cand_id) of candidates (cand_id, name), all written by initial, from the shards asked for."""
    # Spark writes a lower-case İ as two signs, i and a dot above; SQL as the i alone.
    root, first = files.scratch(spark, "shards"), F.substring(F.lower(F.substring("name", 1, 1)), 1, 1)
    shard = F.when(first.isin(list(ascii_lowercase)), first).otherwise("other")
    files.write_shards(candidates.select(F.col("cand_id").cast("string").alias("cand_id"), shard.alias("initial")), root, F.col("initial"))
    return files.read_shards(spark, root, shards, ["cand_id", "initial"]).select("shard", F.col("cand_id").cast("long").alias("cand_id"))


@query("SELECT CASE WHEN lower(left(name, 1)) BETWEEN 'a' AND 'z' THEN lower(left(name, 1)) ELSE 'other' END AS shard, cand_id FROM candidates_csrankings")
def scan_sharded(spark: SparkSession, d: str) -> DataFrame:
    """Shards by letter and one of other, blank and missing initials; those are missing that no name begins with, and one
    that is asked for and never written."""
    return shards_back(spark, table(spark, d, "candidates_csrankings"), [*ascii_lowercase, "other", "never-written"])


@query("""SELECT run, inst_id, check_id, CASE WHEN run > (SELECT min(run) FROM roster_checked) THEN coalesce(site, '') ELSE '' END AS site FROM roster_checked""")
def scan_path_partition(spark: SparkSession, d: str) -> DataFrame:
    """The run comes from the path; the files of later runs have a column more, which is empty for the first."""
    root, k = files.scratch(spark, "runs"), table(spark, d, "roster_checked")
    runs = sorted(r[0] for r in k.select("run").distinct().limit(1_001).collect())
    if len(runs) > 1_000:
        raise ValueError("more than 1,000 runs")
    paths = {}
    for i, run in enumerate(runs):
        columns = ["check_id", "inst_id"] + (["site"] if i else [])
        files.write_csv(_text(k.filter(F.col("run") == run), columns), f"{root}/{run}/roster.csv")
        paths[f"{root}/{run}/roster.csv"] = columns
    df = files.read_by_path(spark, paths, r"/([^/]+)/roster\.csv/", ["run"])
    site = F.col("site") if "site" in df.columns else F.lit(None).cast("string")
    return df.select("run", "inst_id", F.col("check_id").cast("long").alias("check_id"), F.coalesce(site, F.lit("")).alias("site"))


_GEO = "doc_id bigint, lat string, lon string, address map<string,string>"


@query("SELECT site_id, cast(cast(lat AS VARCHAR) AS DOUBLE) AS lat, geocode_precision AS precision_found FROM institutions_geocoded_precise WHERE lat IS NOT NULL")
def scan_json(spark: SparkSession, d: str) -> DataFrame:
    """Nested documents with numbers as text and sparse maps; malformed ones stand between them and are passed over."""
    path = files.scratch(spark, "json")
    p = table(spark, d, "institutions_geocoded_precise")
    doc = p.select(F.col("site_id").alias("doc_id"), F.col("lat").cast("string").alias("lat"), F.col("lon").cast("string").alias("lon"), F.create_map(F.lit("precision"), "geocode_precision").alias("address"))
    lines = doc.select(F.to_json(F.struct(*doc.columns)).alias("value"))
    lines.unionAll(doc.select(F.concat(F.lit('{"doc_id": '), F.col("doc_id"), F.lit(', "lat": "1.0", "address": {')).alias("value"))).write.text(path)
    back = spark.read.schema(_GEO + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return back.filter("_corrupt_record is null and lat is not null").select(F.col("doc_id").alias("site_id"), F.col("lat").cast("double").alias("lat"), F.try_element_at("address", F.lit("precision")).alias("precision_found"))


@query("SELECT event_id, event_type FROM events")
def scan_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Lines, with blank ones between."""
    path, e = files.scratch(spark, "jsonl"), table(spark, d, "events")
    e.select(F.concat(F.to_json(F.struct("event_id", "event_type")), F.lit("\n")).alias("value")).write.text(path)
    return files.read_lines(spark, path, "event_id bigint, event_type string").select("event_id", "event_type")


@query("SELECT city_id, city, country FROM city_list")
def scan_wrapped_json(spark: SparkSession, d: str) -> DataFrame:
    """A payload behind an assignment, as pages carry it."""
    path = files.scratch(spark, "wrapped")
    rows = table(spark, d, "city_list").select(F.struct("city_id", "city", "country").alias("r")).agg(F.to_json(F.struct(F.collect_list("r").alias("rows"))).alias("j"))
    rows.select(F.concat(F.lit("window.DATA = "), "j", F.lit(";")).alias("value")).coalesce(1).write.text(path)
    return files.read_wrapped(spark, path + "/part-*", "rows array<struct<city_id:bigint,city:string,country:string>>").select(F.explode("rows").alias("r")).select("r.*")


@query("SELECT inst_id AS token FROM institutions_geocoded GROUP BY inst_id")
def scan_text_tokens(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark, "tokens")
    table(spark, d, "institutions_geocoded").select(F.concat_ws(" ", "inst_id", "inst_id").alias("value")).write.text(path)
    return files.read_tokens(spark, path)


@query("SELECT paper_key, author FROM authorships WHERE year > 2024 AND layer = 'core'")
def scan_filter_pushdown(spark: SparkSession, d: str) -> DataFrame:
    """Both predicates and the two columns reach the scan."""
    return table(spark, d, "authorships").filter("year > 2024 and layer = 'core'").select("paper_key", "author")


@query("""
SELECT inst, col, v AS allowed FROM (SELECT inst, col, unnest(string_split(rest, ';')) AS v FROM (VALUES ('a', 'site', 'North;South'), ('b', 'group', 'X')) t(inst, col, rest))
""")
def parse_registry(spark: SparkSession, d: str) -> DataFrame:
    """Packed `inst:column:a;b|...`; parts of any other shape are passed over."""
    one = spark.range(1).select(F.lit("a:site:North;South|broken|b:group:X||").alias("packed"))
    parts = F.filter(F.transform(F.split("packed", r"\|"), lambda x: F.split(x, ":")), lambda x: F.size(x) == 3)
    return one.select(F.explode(parts).alias("p")).select(F.col("p")[0].alias("inst"), F.col("p")[1].alias("col"), F.explode(F.split(F.col("p")[2], ";")).alias("allowed"))


@query("SELECT count(*) AS n, 0 AS wrong FROM candidates_csrankings")
def strict_width_check(spark: SparkSession, d: str) -> DataFrame:
    """Reads strictly: a record of another width would end the job, also where few columns are used."""
    path = files.scratch(spark, "strict")
    files.write_csv(_text(table(spark, d, "candidates_csrankings"), _CAND), path)
    df = files.read_csv(spark, path, _CAND, strict=True)
    return df.select(F.struct(*_CAND).alias("r")).agg(F.count("r").alias("n"), F.count_if(F.col("r.cand_id").isNull()).cast("int").alias("wrong"))


@query()
def freshness(spark: SparkSession, d: str) -> DataFrame:
    """Files changed since a moment; depends on the file system."""
    path = files.scratch(spark, "fresh")
    spark.range(10).select(F.col("id").cast("string").alias("value")).write.text(path)
    return files.fresh(spark, path, "2020-01-01")


@query()
def scan_xml(spark: SparkSession, d: str) -> DataFrame:
    """Person elements with attributes, repeated children and named letters; no SQL equivalent."""
    path = files.scratch(spark, "xml")
    p = table(spark, d, "dblp_persons")
    esc = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    aka = F.transform(F.split(F.coalesce("aliases", F.lit("")), r"\|"), lambda a: F.concat(F.lit("<author>"), esc(a), F.lit("</author>")))
    p.select(F.concat(F.lit('<www key="homepages/'), "pid", F.lit('"><author>'), F.replace(esc(F.col("primary_name")), F.lit("ü"), F.lit("&uuml;")), F.lit("</author>"), F.array_join(aka, ""), F.lit("</www>")).alias("value")).write.text(path)
    df = files.read_xml(spark, path + "/part-*", "www", "_key string, author array<string>")
    return df.select(F.replace("_key", F.lit("homepages/")).alias("pid"), F.get("author", F.lit(0)).alias("primary_name"), F.size("author").alias("n_forms"))


@query()
def scan_raster(spark: SparkSession, d: str) -> DataFrame:
    """The first cells of a small raster, written on the driver and read in bands; the path must be one all tasks see."""
    import os
    from urllib.parse import urlparse

    import numpy as np

    from rollcall.sources.raster import register, write_raster

    register(spark)
    path = urlparse(files.scratch(spark, "raster")).path
    os.makedirs(os.path.dirname(path), exist_ok=True)
    write_raster(path, np.arange(600, dtype="f4").reshape(20, 30) - 10, west=5.0, north=50.0, step=0.1)
    return spark.read.format("population_raster").option("path", path).option("rows", 6).option("lat_min", 48.5).load()


@query()
def payload_json(spark: SparkSession, d: str) -> DataFrame:
    """Institutions with their people as one nested text each."""
    c = table(spark, d, "candidates_csrankings").groupBy("affiliation").agg(F.sort_array(F.collect_list(F.struct("cand_id", "name", "core_papers"))).alias("pp"))
    return c.select("affiliation", F.to_json(F.struct(F.col("affiliation").alias("n"), F.size("pp").alias("k"), "pp")).alias("payload"))


@query("""SELECT count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT left(sha1(concat_ws('|', cast(user_id % 7 AS VARCHAR), user_id::VARCHAR, event_type, '', 'r' || cast(event_id % 3 AS VARCHAR), 'stream', cast(cast(floor(value) AS BIGINT) % 5 AS VARCHAR))), 12) AS id FROM events GROUP BY 1)""")
def stream_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The stream's outcome: as many rows as ids, the same as the batch append."""
    src, out, mark = (files.scratch(spark, x) for x in ("stream-in", "stream-out", "stream-mark"))
    e = table(spark, d, "events")
    e.repartition(4).write.parquet(src)
    done = stream.run_append(spark, src, e.schema, decision_entries, out, mark)
    return done.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))
