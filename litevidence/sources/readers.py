"""Reading the engine's inputs: Parquet, delimited text, folders per source, relational dumps."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from litevidence import schemas
from litevidence.operators.mentions import name_columns
from litevidence.sources.writers import staged


def read_parquet(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Parquet with a declared schema; only the columns used later are read."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def read_text(
    spark: SparkSession,
    path: str,
    schema: StructType | None = None,
    sep: str = "\t",
    names: Mapping[str, str] | None = None,
) -> DataFrame:
    """Delimited text with a header line. Every column is a string; `NA` and `None` are plain text.

    With a schema its columns are picked by header name, whatever their order in the file. `names` maps
    names in the file to the names used here.
    """
    rows = (
        spark.read.option("sep", sep)
        .option("header", True)
        .option("escape", '"')
        .option("multiLine", True)
        .csv(path)
        .withColumnsRenamed(dict(names or {}))
    )
    if schema is None:
        return rows
    known = set(rows.columns)
    return rows.select(
        *[
            (F.col(f"`{f.name}`") if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def read_lines(spark: SparkSession, path: str, schema: StructType, sep: str = "\t") -> DataFrame:
    """Large delimited text without line breaks inside values: files are split among tasks."""
    return spark.read.schema(schema).option("sep", sep).option("header", True).option("escape", '"').csv(path)


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    return name_columns(read_parquet(spark, path, schemas.RAW_MATCHES))


def read_dated_evidence(spark: SparkSession, path: str) -> DataFrame:
    """All `sourceId=...` folders in one scan; a filter on sourceId reads only the folders it needs."""
    return spark.read.schema(schemas.DATED_EVIDENCE).parquet(path)


# Types from narrow to wide; two types meet in the wider one, and any other two in text.
_WIDER = ("boolean", "tinyint", "smallint", "int", "bigint", "double", "string")


def _wider(one: str, two: str) -> str:
    if one == two:
        return one
    numbers = _WIDER[1:6]
    one, two = ("double" if t == "float" else t for t in (one, two))
    if one in numbers and two in numbers:
        return max(one, two, key=numbers.index)
    return one if one == two else two if one == "void" else one if two == "void" else "string"


def read_drifted(spark: SparkSession, folders: Mapping[str, str], source: str = "sourceId") -> tuple[DataFrame, DataFrame]:
    """Folders of one kind of table whose columns have drifted apart, as one table, and a report of what differed.

    Columns are matched by name, without regard to case, never by position. Types that differ are widened (whole numbers, then
    double, then text), columns that a folder lacks are null. `source` names the folder. The report has a row per folder and
    column: folder, column, found, used, and what was done (`as it is`, `widened`, `missing`). Only the folders'
    schemas are read here.
    """
    tables = {name: spark.read.parquet(path) for name, path in folders.items()}
    used: dict[str, list[str]] = {}     # name in lower case: name as first met, type
    for table in tables.values():
        for column, kind in table.dtypes:
            known = used.setdefault(column.lower(), [column, kind])
            known[1] = _wider(known[1], kind)
    whole, report = None, []
    for name, table in tables.items():
        own = {column.lower(): (column, kind) for column, kind in table.dtypes}
        chosen = []
        for key, (column, kind) in used.items():
            if key in own:
                chosen.append(F.col(f"`{own[key][0]}`").cast(kind).alias(column))
                report.append((name, column, own[key][1], kind, "as it is" if own[key][1] == kind else "widened"))
            else:
                chosen.append(F.lit(None).cast(kind).alias(column))
                report.append((name, column, None, kind, "missing"))
        part = table.select(*chosen).withColumn(source, F.lit(name))
        whole = part if whole is None else whole.unionByName(part)
    return whole, spark.createDataFrame(report, "folder string, column string, found string, used string, done string")


def read_checked(
    spark: SparkSession, path: str, schema: StructType, sep: str = "\t", multiline: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Delimited text with a header line: the rows that fit the schema, and a quarantine of all others.

    A record with too few or too many fields, or with a value that is not of its column's type, goes whole to the quarantine:
    file, record, n_fields and reason. The two tables add up to the records of the files. With `multiline` values may hold line
    breaks and a file is read by one task; without, files are split.
    """
    broken = "_broken"
    typed = StructType([*schema.fields, StructField(broken, StringType())])
    read = spark.read.schema(typed).option("sep", sep).option("header", True).option("escape", '"')
    rows = read.option("multiLine", multiline).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", broken).csv(path)
    # Written, so that the files are parsed once for both tables.
    rows = staged(rows.select("*", F.col("_metadata.file_name").alias("_file")), "checked-text")
    # Separators outside of quotes: what is between quotes is taken out first.
    bare = F.regexp_replace(broken, '"(?:[^"]|"")*"', "")
    n = (F.char_length(bare) - F.char_length(F.replace(bare, F.lit(sep), F.lit("")))) / len(sep) + 1
    few = F.when(n < len(schema.fields), "too few fields").when(n > len(schema.fields), "too many fields").otherwise("a value of another type")
    quarantine = rows.where(F.col(broken).isNotNull()).select(
        F.col("_file").alias("file"), F.col(broken).alias("record"), n.cast("int").alias("n_fields"), few.alias("reason")
    )
    return rows.where(F.col(broken).isNull()).select(*[f"`{f.name}`" for f in schema.fields]), quarantine


def read_tables(
    spark: SparkSession, folder: str, tables: list[str], names: Mapping[str, str] | None = None
) -> dict[str, DataFrame]:
    """Relational tables from Parquet extracts, one per table; `names` maps their columns to the names used here."""
    found = {name: spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet") for name in tables}
    return {name: rows.withColumnsRenamed(dict(names or {})) for name, rows in found.items()}


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str,
    lower: int,
    upper: int,
    partitions: int,
    **options: str,
) -> DataFrame:
    """A database table read in parallel ranges of a numeric column; needs the driver on the class path."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url, dbtable=table, partitionColumn=partition_column, lowerBound=str(lower),
            upperBound=str(upper), numPartitions=str(partitions), **options,
        )
        .load()
    )
