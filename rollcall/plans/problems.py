"""The core's pN_ queries, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.operators.bad_rows import check_records, header_columns, loaded_values, split_rows
from rollcall.operators.spatial import points_in_zones, radius_pairs
from rollcall.session import table

NEAR_M = 75.0


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Sites at most 75 m apart, and the catchments that hold a site."""
    sites = table(spark, d, "institutions_geocoded_precise")
    near = radius_pairs(sites, "site_id", "lat", "lon", NEAR_M)
    held = points_in_zones(sites, "site_id", "lat", "lon", table(spark, d, "catchments"), "zone_id", "boundary_wkt")
    return near.select(F.col("id_a").alias("site_id"), F.lit("site").alias("near_kind"), F.col("id_b").alias("near_id")).unionByName(
        held.select(F.col("id").alias("site_id"), F.lit("zone").alias("near_kind"), F.col("zone").alias("near_id"))
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that fail, a row for each reason."""
    checked = check_records(table(spark, d, "rulings_raw"), table(spark, d, "rulings_files"))
    return split_rows(checked)[1].select("raw_id", "reason")


def p3_loaded(spark: SparkSession, d: str) -> DataFrame:
    """Records that load, with every column of any file, trimmed where the rules trim."""
    files = table(spark, d, "rulings_files")
    good = split_rows(check_records(table(spark, d, "rulings_raw"), files))[0].select("raw_id", "row")
    return loaded_values(good, header_columns(files)).withColumn("confidence", F.lower("confidence"))


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_loaded": p3_loaded}
