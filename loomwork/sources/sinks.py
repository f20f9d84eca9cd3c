"""Sinks: Parquet with an exact layout, manifests, tables of text, logs and tar shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_samples(df: DataFrame, path: str, rows_per_file: int = 5000, rows_per_group: int = 500, by_dataset: bool = False, mode: str = "errorifexists") -> None:
    """Parquet files and row groups of at most so many rows; with ``by_dataset`` a folder per data set."""
    writer = df.write.mode(mode).option("maxRecordsPerFile", rows_per_file).option("parquet.block.row.count.limit", rows_per_group)
    (writer.partitionBy("dataset_name") if by_dataset else writer).parquet(path)


def manifest_of(spark: SparkSession, path: str) -> DataFrame:
    """(path, num_rows) of what was written, from a scan without columns."""
    scan = spark.read.parquet(path)
    return scan.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("num_rows"))


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON texts, bytes in base 64."""
    out = []
    for f in df.schema:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            out.append(F.to_json(f.name).alias(f.name))
        elif isinstance(f.dataType, T.BinaryType):
            out.append(F.base64(f.name).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    flat(df).write.mode(mode).csv(path, sep="\t", header=True, quote='"', escape='"')


def quoted_list(column: str):
    """A text list as Python writes it: ['a', "it's"]; null elements are None, empty and null lists []."""

    def one(x):
        plain = F.replace(F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")), F.lit("\r"), F.lit("\\r"))
        doubled = F.contains(x, F.lit("'")) & ~F.contains(x, F.lit('"'))
        single = F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'"))
        return F.when(x.isNull(), F.lit("None")).when(doubled, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(single)

    return F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(column, one), ", "), F.lit("]")), F.lit("[]"))


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_lists(df: DataFrame, path: str, by: str, value: str) -> None:
    """One folder of text lines for each value of ``by``."""
    df.select(by, F.col(value).cast("string").alias("value")).write.partitionBy(by).text(path)


def write_report(report: DataFrame, path: str, kind: str, order: list[str] | None = None, mode: str = "errorifexists") -> None:
    """A report as one file: ``csv`` with a header, ``json`` lines, or ``txt`` lines of ``name: value, ...``.

    Reports are aggregates, so one task writes them, in the order of the named columns.
    """
    rows = flat(report)
    one = rows.repartition(1)
    one = one.sortWithinPartitions(*order) if order else one
    if kind == "csv":
        one.write.mode(mode).csv(path, header=True, quote='"', escape='"')
    elif kind == "json":
        one.write.mode(mode).option("ignoreNullFields", "false").json(path)
    elif kind == "txt":
        parts = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in rows.columns]
        one.select(F.concat_ws(", ", *parts).alias("value")).write.mode(mode).text(path)
    else:
        raise ValueError(kind)
