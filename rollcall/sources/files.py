"""File sources and sinks: delimited, JSON, XML and token files, read by declared schema, all in the shared folder.

Readers never infer: every cell of a delimited file is text, an empty one is null.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.session import shared_folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which every executor reaches."""
    return f"{shared_folder(spark).rstrip('/')}/rollcall/{name}-{uuid.uuid4().hex}"


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def write_csv(df: DataFrame, path: str, compression: str = "none", mode: str = "errorifexists") -> None:
    """Delimited files with a header, fields in the order of df, quotes doubled; an existing target is an error."""
    df.write.mode(mode).option("header", True).option("escape", '"').option("quoteAll", True).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("compression", compression).csv(path)


def read_csv(spark: SparkSession, path: str | list[str], columns: list[str], strict: bool = False) -> DataFrame:
    """Delimited files with a header, all text; gzip by its ending. Quoted fields may hold line breaks.

    strict makes a record of any other width an error, whatever columns are read later.
    """
    r = spark.read.schema(text_schema(columns)).option("header", True).option("escape", '"').option("multiLine", True).option("maxCharsPerColumn", -1).option("enforceSchema", False)
    if strict:
        r = r.option("mode", "FAILFAST")
    return r.csv(path)


def write_shards(df: DataFrame, root: str, shard: Column) -> None:
    """Folders of delimited files under root, one for each value of shard that df has; the values must be plain words."""
    df.withColumn("shard", F.concat(shard, F.lit(".csv"))).write.partitionBy("shard").option("header", True).option("escape", '"').csv(root)


def read_shards(spark: SparkSession, root: str, shards: list[str], columns: list[str]) -> DataFrame:
    """The files root/<shard>.csv that exist, or folders of that name as write_shards leaves them, with `shard` from
    their path; a missing one is passed over."""
    df = spark.read.schema(text_schema(columns)).option("header", True).option("escape", '"').option("ignoreMissingFiles", True).option("recursiveFileLookup", True).csv(root)
    shard = F.regexp_extract("_metadata.file_path", r"/(?:shard=)?([^/]+)\.csv(?:/[^/]*)?$", 1)
    return df.withColumn("shard", shard).filter(F.col("shard").isin(shards))


def read_by_path(spark: SparkSession, paths: dict[str, list[str]], pattern: str, names: list[str]) -> DataFrame:
    """Files whose headers differ, under one another by column name, with keys taken from the path by a pattern.

    paths maps a folder or file to its columns; names are those of the pattern's groups.
    """
    out = None
    for path, columns in paths.items():
        df = read_csv(spark, path, columns)
        df = df.withColumns({n: F.regexp_extract("_metadata.file_path", pattern, i + 1) for i, n in enumerate(names)})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per file; a malformed one has only nulls and its text in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON record per line; blank lines are passed over, malformed ones kept in _corrupt_record."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    return parsed.select("r.*")


def read_wrapped(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON behind an assignment and before a semicolon, one per file."""
    text = spark.read.text(path, wholetext=True)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\[{]*=\s*", ""), r";\s*$", "")
    return text.select(F.from_json(body, schema).alias("r")).select("r.*")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The distinct words of text files."""
    return spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("token")).filter("token <> ''").distinct()


# The named entities of the Latin-1 set that stand in bibliographic dumps.
ENTITIES = {"auml": "ä", "ouml": "ö", "uuml": "ü", "Auml": "Ä", "Ouml": "Ö", "Uuml": "Ü", "szlig": "ß", "eacute": "é", "egrave": "è", "agrave": "à", "ccedil": "ç", "ntilde": "ñ", "oslash": "ø", "aring": "å", "aelig": "æ", "iacute": "í", "oacute": "ó", "aacute": "á", "uacute": "ú"}


def read_xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Elements of one tag by declared schema, attributes with a leading _; named letters are put in first.

    The file is read as lines, elements are cut out by their tag and parsed one by one, so a broken one harms no other:
    its row has nulls and its text in _corrupt_record. Elements of the tag must not nest, and each must begin on a line
    of its own or follow another element.
    """
    text = spark.read.text(path, wholetext=True)
    body = F.col("value")
    for name, letter in ENTITIES.items():
        body = F.replace(body, F.lit(f"&{name};"), F.lit(letter))
    each = text.select(F.explode(F.regexp_extract_all(body, F.lit(rf"(?s)(<{tag}[ >].*?</{tag}>)"), F.lit(1))).alias("x"))
    parsed = each.select(F.from_xml("x", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record", "attributePrefix": "_", "valueTag": "_VALUE"}).alias("r"))
    return parsed.select("r.*")


def fresh(spark: SparkSession, path: str, since: str) -> DataFrame:
    """(file) of the files under path changed after a moment."""
    files = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("changed"))
    return files.filter(F.col("changed") > F.lit(since).cast("timestamp")).select("file").distinct()
