"""Scans: JSON lines and arrays, CSV, relevance files, binary files, usage series, SQL over views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.ordering import with_row_number


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, in whatever store it names."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def jsonl(spark: SparkSession, path: str, schema: str | T.StructType, missing_ok: bool = False, strict: bool = True) -> DataFrame:
    """Rows of JSON lines by a declared schema; blank lines are skipped.

    ``strict``: a malformed line is an error, else it is dropped.  ``missing_ok``: no file gives no rows.
    """
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def jsonl_with_index(spark: SparkSession, path: str, schema: str, most: int | None = None) -> DataFrame:
    """As jsonl, with ``row_index`` (0-based among non-blank lines in file order) and ``n_bytes`` of each line."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")).withColumn("_line", F.monotonically_increasing_id()).where(F.trim("value") != "")
    numbered = with_row_number(lines, "_file", "_block", "_line", name="row_index")
    if most is not None:
        numbered = numbered.where(F.col("row_index") < most)
    return numbered.select("row_index", (F.octet_length("value") + 1).alias("n_bytes"), F.from_json("value", schema, {"mode": "FAILFAST"}).alias("_r")).select("row_index", "n_bytes", "_r.*")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a file that is one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def all_strings(df: DataFrame) -> DataFrame:
    """Each value as JSON text, strings as they are."""
    nested = ("array", "struct", "map")
    return df.select(*[(F.to_json(c) if t.startswith(nested) else F.col(c).cast("string")).alias(c) for c, t in df.dtypes])


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_id, rel) of a four-column relevance file; other lines are ignored, of repeats the last line wins."""
    lines = spark.read.text(path).withColumn("_n", F.monotonically_increasing_id()).withColumn("p", F.split(F.trim("value"), r"\s+")).where("size(p) = 4")
    rows = lines.select(F.col("p")[0].alias("qid"), F.col("p")[2].alias("doc_id"), F.col("p")[3].cast("int").alias("rel"), "_n")
    return rows.groupBy("qid", "doc_id").agg(F.max_by("rel", "_n").alias("rel"))


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, content, sha256) of files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", "content", F.sha2("content", 256).alias("sha256"))


def discovered(spark: SparkSession, path: str, pattern: str, schema: str) -> DataFrame:
    """Rows of the JSON files below a folder, with each one's ``path``; a file that is found twice is an error."""
    files = binary_files(spark, path, pattern).groupBy(F.regexp_replace("path", "/+", "/").alias("p")).count()
    if not files.where("count > 1").isEmpty():
        raise ValueError(f"a file below {path} is found twice")
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(path)
    return rows.withColumn("path", F.col("_metadata.file_path"))


def data_uris(files: DataFrame, mime: str) -> DataFrame:
    return files.select("path", F.concat(F.lit(f"data:{mime};base64,"), F.base64("content")).alias("uri"))


def pinned_jsonl(spark: SparkSession, path: str, schema: str, digest: str, rows: int) -> DataFrame:
    """JSON lines of a file whose sha256 and number of rows are known; an error if either differs."""
    found = [r.sha256 for r in binary_files(spark, path).select("sha256").collect()]
    if found != [digest]:
        raise ValueError(f"{path} has digest {found}")
    df = jsonl(spark, path, schema)
    if df.count() != rows:
        raise ValueError(f"{path} doesn't have {rows} rows")
    return df


def sql(spark: SparkSession, text: str, views: dict[str, DataFrame], cap: int | None = None, **args: object) -> DataFrame:
    """Rows of a parameterised query over the views, at most ``cap``."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    out = spark.sql(text, args=args or None)
    return out if cap is None else out.limit(cap)


def sql_or_error(spark: SparkSession, text: str, views: dict[str, DataFrame], cap: int) -> tuple[DataFrame, str | None]:
    """(rows, None) of a query, or (no rows, what is wrong with it)."""
    from pyspark.errors import AnalysisException, ParseException

    try:
        return sql(spark, text, views, cap), None
    except (AnalysisException, ParseException) as e:
        return spark.createDataFrame([], "error string"), str(e)


def first_schema(df: DataFrame, order: str, doc: str) -> DataFrame:
    """(field, kind): fields and types of the first JSON document in the order."""
    first = df.select(order, doc).orderBy(order).limit(1)
    kinds = F.from_json(F.to_json(F.try_variant_get(F.parse_json(doc), "$", "map<string,variant>")), "map<string,variant>")
    return first.select(F.explode(kinds).alias("field", "value")).select("field", F.schema_of_variant("value").alias("kind"))


def describe(views: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """(table, columns): each view's typed columns."""
    return spark.createDataFrame([(n, ", ".join(f"{c} {t}" for c, t in df.dtypes)) for n, df in sorted(views.items())], "table string, columns string")


def pairs(df: DataFrame, query: str, positive: str) -> DataFrame:
    """(query, positive) as strings; rows with an empty or null side are dropped."""
    q, p = F.col(query).cast("string"), F.col(positive).cast("string")
    return df.where((q != "") & (p != "")).select(q.alias("query"), p.alias("positive"))


def usage_series(df: DataFrame, series: str = "series") -> DataFrame:
    """(id, day, used) of nested series of labelled (timestamp, value) points."""
    points = df.select(F.explode(series).alias("s")).select(F.col("s.labels")["id"].alias("id"), F.explode("s.values").alias("v"))
    return points.groupBy("id", F.to_date(F.timestamp_seconds("v.timestamp")).alias("day")).agg(F.sum(F.col("v.value").cast("double")).alias("used"))


def strict_or_quarantine(df: DataFrame, errors: Column) -> tuple[DataFrame, DataFrame]:
    """(rows without errors, rows with them and their ``errors``)."""
    marked = df.withColumn("errors", errors)
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)
