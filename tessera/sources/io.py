"""Scans and sinks. All go through Spark's file systems; nothing is read by the driver alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X
from tessera.operators.relational import keep_first

ID_HEADERS = ["nctid", "nct_id", "trial_id", "study_id"]


def family(spark: SparkSession, folder: str, prefix: str) -> DataFrame:
    """All Parquet files of a table family, `prefix*.parquet`; an error if there are none."""
    return spark.read.option("mergeSchema", "true").parquet(f"{folder}/{prefix}*.parquet")


def parquet_parts(spark: SparkSession, paths: list[str], columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(*paths)
    return df.select(*columns) if columns else df


def csv(spark: SparkSession, paths: str | list[str], typed: bool = False, columns: list[str] | None = None) -> DataFrame:
    """A CSV with a header: types inferred, or all texts with '' as null. Of the columns asked for, those that exist."""
    df = spark.read.options(header=True, inferSchema=typed, multiLine=True, escape='"', nullValue="").csv(paths)
    if not typed:
        df = df.select(*(F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns))
    return df.select(*(F.col(f"`{c}`") for c in columns if c in df.columns)) if columns else df


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None, strict: bool = True, limit: int | None = None) -> DataFrame:
    """A record a line; bad lines fail the scan, or are dropped if not strict."""
    reader = spark.read.option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    df = (reader.schema(schema) if schema else reader).json(path)
    return df.limit(limit) if limit else df


def json_any(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A file that holds one JSON array, one object, or a record a line; told by its first character and whether its lines parse alone."""
    lines = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    whole = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", True).json(path)
    head = spark.read.text(path).where(F.trim("value") != "").limit(2).collect()
    first = head[0][0].strip() if head else ""
    return whole if first.startswith("[") or len(head) == 1 or first in ("{", "[") else lines


def last_by_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key in order."""
    return keep_first(df, [key], [F.col(c).desc() for c in order])


def xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Records of an XML file or folder; a record that does not parse has its text in _corrupt_record."""
    reader = spark.read.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).load(path)


def documents(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, id, content): whole files, the id from the file's name."""
    df = spark.read.format("binaryFile").load(pattern)
    return df.select("path", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("id"), F.decode("content", "UTF-8").alias("content"))


def entity_tables(spark: SparkSession, root: str, table: str, mode: str = "auto", other: str = "filled") -> DataFrame:
    """A table kept in a folder for each entity, `root/NCT*/table.csv` or an alternative `root/NCT*/<other>/table_<other>.csv`.

    mode auto takes an entity's alternative where there is one, base and alternative take that alone."""
    path = F.col("_metadata.file_path")
    tables = []
    for rank, pattern in enumerate((f"{root}/NCT*/{other}/{table}_{other}.csv", f"{root}/NCT*/{table}.csv")):
        if mode == "auto" or (mode == "base") == (rank == 1):
            spark_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
            if spark_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(spark_path):
                df = spark.read.options(header=True, multiLine=True, escape='"').csv(pattern)
                tables.append(df.select("*", F.regexp_extract(path, r"/(NCT\d+)/", 1).alias("entity"), F.lit(rank).alias("_rank")))
    if not tables:
        raise FileNotFoundError(f"no {table} under {root}")
    df = tables[0]
    for more in tables[1:]:
        df = df.unionByName(more, allowMissingColumns=True)
    best = df.groupBy("entity").agg(F.min("_rank").alias("_best"))
    return df.join(best, "entity").where("_rank = _best").drop("_rank", "_best")


def id_list(df: DataFrame) -> DataFrame:
    """(id): the ids in the column that is named as such, else the first, split, upper case, distinct."""
    names = {c.lower(): c for c in df.columns}
    column = next((names[h] for h in ID_HEADERS if h in names), df.columns[0])
    return df.select(F.explode(X.id_list(F.col(column))).alias("id")).distinct()


def schema_table(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, type, is_id) of several tables."""
    rows = [(n, f.name, f.dataType.simpleString(), f.name.lower() in ID_HEADERS or f.name.lower().endswith(("_id", "key"))) for n, df in tables.items() for f in df.schema.fields]
    return next(iter(tables.values())).sparkSession.createDataFrame(rows, "`table` string, `column` string, type string, is_id boolean")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, fields: list[str], mode: str = "overwrite") -> None:
    """The fields in their order, empty where df has none; other columns are left out."""
    have = set(df.columns)
    df.select(*(F.col(f"`{f}`") if f in have else F.lit("").alias(f) for f in fields)).write.mode(mode).options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_parquet(df: DataFrame, path: str, rows_per_file: int = 5_000_000, by: list[str] | None = None, mode: str = "overwrite") -> None:
    out = df.write.mode(mode).option("maxRecordsPerFile", rows_per_file)
    (out.partitionBy(*by) if by else out).parquet(path)


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, neighbours): sorted distinct neighbours."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_set("dst")).alias("neighbours"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those of old whose key new lacks."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def append_missing(spark: SparkSession, df: DataFrame, path: str, keys: list[str]) -> int:
    """Appends the rows whose key the table at path lacks; how many. A run that broke off goes on where it was."""
    try:
        done = spark.read.parquet(path).select(*keys)
        df = df.join(done, keys, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    n = df.count()
    df.write.mode("append").parquet(path)
    return n


def manifest(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, bytes, sha256) of files."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def download_name(url: Column) -> Column:
    """A safe file name from a URL, with eight digits of its MD5 so that equal names from different places differ."""
    base = F.regexp_extract(url, r"([^/?#]+)(?:[?#].*)?$", 1)
    stem, ext = F.regexp_extract(base, r"^(.*?)(\.[A-Za-z0-9]+)?$", 1), F.regexp_extract(base, r"(\.[A-Za-z0-9]+)$", 1)
    return F.concat(X.file_name(stem), F.lit("_"), F.substring(F.md5(url.cast("binary")), 1, 8), ext)
