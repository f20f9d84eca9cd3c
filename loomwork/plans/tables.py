"""The engine's proxies on relational tables: where each query finds its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def micros(name: str) -> Column:
    """Microseconds since 1970 of a timestamp without a zone, whatever the session's zone."""
    return F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(name)).cast("timestamp"))


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, name: str, *columns: str) -> DataFrame:
        """A table's columns dealt over all cores: a file of few megabytes is one split, and costly work on its rows would be one task's."""
        return getattr(self, name).select(*columns).repartition(3 * self.spark.sparkContext.defaultParallelism)

    @property
    def tokens(self) -> DataFrame:
        """Documents as samples: a token for four characters, one at least."""
        return self.documents.select("doc_id", "lang", "source", F.greatest(F.floor(F.col("n_chars") / 4), F.lit(1)).cast("bigint").alias("tokens"))

    @property
    def judged(self) -> DataFrame:
        """Labelled documents with a rule's prediction of quality."""
        return self.documents.join(self.labels, "doc_id").select("doc_id", "lang", "source", "n_chars", "quality", "toxic", (F.col("n_chars") >= 600).alias("predicted"))
