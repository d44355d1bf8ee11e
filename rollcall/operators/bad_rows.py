"""Separating records that fail to parse from those that load (problem 3).

Everything stays a column expression: the record is cut at its quote characters, so that pieces at even places lie
outside quotes and those at odd places inside. The shape rules look only at the outer pieces; the fields are then
loaded as nullable text by name, each constraint adds its reason to an error array, and rows are split by whether that
array is empty.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for a field boundary while a record is taken apart; text that holds it or the escape is escaped first.
_SEP, _ESC = "\x01", "\x02"

# The allowed confidence words; the form of an evidence URL.
CONFIDENCE = ("high", "medium", "low", "")
URL = r"(?i)^https?://(?:[^\s/?#@]*@)?[^\s/?#:@]*[^\s/?#:@.][^\s/?#:@]*\.[^\s/?#:@]*[^\s/?#:@.][^\s/?#:@]*(?::\d*)?(?:[/?#]\S*)?$"
_EDGES = r"(?U)^\s+|\s+$"


def trimmed(c: Column) -> Column:
    """c without outer white space of any script, null as ''."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), _EDGES, "")


def confidence_ok(c: Column) -> Column:
    return F.lower(trimmed(c)).isin(*CONFIDENCE)


def url_ok(c: Column) -> Column:
    t = trimmed(c)
    return (t == "") | t.rlike(URL)


#: Constraint rules by column: the reason, and the test a text value must pass.
RULES: dict[str, tuple[str, object]] = {
    "confidence": ("bad_confidence", confidence_ok),
    "evidence_url": ("bad_evidence_url", url_ok),
}


def parse_records(raw: DataFrame, record: str, delimiter: str, header: str) -> DataFrame:
    """Adds `fields` (array of nullable text), `n_expected` and `shape_error` ('quoting', 'column_count' or null).

    record, delimiter and header name columns of raw. A null record counts as an empty one. A field is quoted as a
    whole or not at all; inner quotes are doubled; any other quote is wrong, and so is an unclosed one.
    """
    delim = F.col(delimiter)
    text = F.replace(F.replace(F.coalesce(F.col(record), F.lit("")), F.lit(_ESC), F.lit(_ESC + "e")), F.lit(_SEP), F.lit(_ESC + "s"))
    # With a delimiter before and behind, every piece outside quotes must begin and end with one, but for the empty one
    # that a doubled quote leaves; so no piece needs to know its place from the end, and the work stays linear.
    df = raw.withColumn("__pieces", F.split(F.concat(delim, text, delim), '"', -1))

    def wrong(s: Column, i: Column) -> Column:
        return (i % 2 == 0) & (s != "") & ~(s.startswith(delim) & s.endswith(delim))

    def plain(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 1, s).when(s == "", F.lit('"')).otherwise(F.replace(s, delim, F.lit(_SEP)))

    joined = F.array_join(F.transform("__pieces", plain), "")
    back = lambda x: F.replace(F.replace(x, F.lit(_ESC + "s"), F.lit(_SEP)), F.lit(_ESC + "e"), F.lit(_ESC))
    inner = F.substring(joined, F.lit(2), F.length(joined) - 2)
    quoting = (F.size("__pieces") % 2 == 0) | F.exists(F.transform("__pieces", wrong), lambda x: x)
    df = df.withColumn("__quoting", quoting).withColumn("fields", F.transform(F.split(inner, _SEP, -1), back))
    n = F.size(F.split(F.replace(F.col(header), delim, F.lit(_SEP)), _SEP, -1))
    df = df.withColumn("n_expected", n)
    shape = F.when(F.col(header).isNull(), "unknown_source").when(F.col("__quoting"), "quoting").when(F.size("fields") != F.col("n_expected"), "column_count")
    return df.withColumn("shape_error", shape).drop("__pieces", "__quoting")


def check_records(
    raw: DataFrame,
    files: DataFrame,
    record: str = "raw_record",
    source: str = "source_file",
    rules: Mapping[str, tuple[str, object]] = RULES,
) -> DataFrame:
    """raw with `row` (map of column name to text) and `errors` (array of reasons, empty where the row loads).

    files holds one row per source: its name, `delimiter` and `header_text`; it is small but is joined without a hint,
    so its size decides the strategy. A source absent from files gives the reason `unknown_source`. Columns of raw
    other than record and source pass through untouched, whatever they are called, except `row`, `errors`, `fields`,
    `n_expected`, `shape_error`, which are replaced.
    """
    own = files.select(F.col(source).alias("__source"), F.col("delimiter").alias("__delimiter"), F.col("header_text").alias("__header"))
    df = raw.drop("row", "errors", "fields", "n_expected", "shape_error").join(own, F.col(source) == F.col("__source"), "left")
    df = parse_records(df, record, "__delimiter", "__header")
    names = F.split(F.replace(F.col("__header"), F.col("__delimiter"), F.lit(_SEP)), _SEP, -1)
    df = df.withColumn("row", F.when(F.col("shape_error").isNull(), F.map_from_arrays(names, F.col("fields"))))
    tests = [F.when(F.map_contains_key("row", name) & ~test(F.element_at("row", name)), F.lit(reason)) for name, (reason, test) in rules.items()]
    bad = F.filter(F.array(*tests), lambda x: x.isNotNull())
    errors = F.when(F.col("shape_error").isNotNull(), F.array("shape_error")).otherwise(bad)
    return df.withColumn("errors", errors).drop("__source", "__delimiter", "__header", "fields", "n_expected", "shape_error")


def header_columns(files: DataFrame) -> list[str]:
    """The column names of all files, sorted; files as for `check_records`. Only names that differ reach the driver."""
    delim = F.coalesce(F.nullif("delimiter", F.lit("")), F.lit(","))
    names = F.split(F.replace(F.coalesce("header_text", F.lit("")), delim, F.lit(_SEP)), _SEP, -1)
    return sorted(r["c"] for r in files.select(F.explode(names).alias("c")).filter("c <> ''").distinct().collect())


def loaded_values(rows: DataFrame, columns: list[str], rules: Mapping[str, tuple[str, object]] = RULES, row: str = "row") -> DataFrame:
    """rows that load with each of `columns` as nullable text out of `row`, trimmed as its rule trims where one tests it.

    A column that a row's file doesn't have is null. Columns of rows other than row stay, but for those of equal names.
    """
    value = lambda c: F.try_element_at(row, F.lit(c))
    text = [F.when(value(c).isNotNull(), trimmed(value(c))).alias(c) if c in rules else value(c).alias(c) for c in columns]
    return rows.select(*[c for c in rows.columns if c not in (row, *columns)], *text)


def split_rows(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that load, with `row`; failing rows, one per reason, with `reason` and the record as it came)."""
    good = checked.filter(F.size("errors") == 0).drop("errors")
    bad = checked.filter(F.size("errors") > 0).select(*[c for c in checked.columns if c not in ("errors", "row")], F.explode("errors").alias("reason"))
    return good, bad
