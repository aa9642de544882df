"""Named queries over the derived tables, each with its SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from .views import VIEWS, duck, spark_sql, spark_view, stored_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Attribute access to the derived tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return spark_view(self.spark, self.folder, name)
        raise AttributeError(name)

    def unstored(self, name: str) -> DataFrame:
        """The derived table for a single reader, without a copy in the scratch folder."""
        return self.spark.sql(spark_sql(self.folder, name))

    def stream(self, name: str) -> DataFrame:
        """The stored derived table as a file stream."""
        stored = getattr(self, name)
        return self.spark.readStream.schema(stored.schema).parquet(stored_path(self.spark, self.folder, name))

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def references(self) -> DataFrame:
        """Five reference vectors with the fixed reference texts."""
        from pyspark.sql import functions as F

        from paperloom.operators.analysis import REFERENCE_CLAUSES

        names = F.array(
            *[F.struct(F.lit(a).alias("id"), F.lit(b).alias("reference"), F.lit(c).alias("ref_text")) for a, b, c in REFERENCE_CLAUSES]
        )
        rows = self.vectors.where("vec_id < 5").withColumn("n", F.get(names, F.col("vec_id").cast("int")))
        return rows.select(
            F.col("n.id").alias("ref_id"),
            F.col("vec_id").cast("int").alias("ref_rank"),
            "n.reference",
            "n.ref_text",
            F.col("embedding").alias("vector"),
        )

    @cached_property
    def clause_vectors(self) -> DataFrame:
        from pyspark.sql import functions as F

        v = self.vectors.where("vec_id >= 5")
        return v.select(
            F.col("vec_id").alias("clause_id"),
            F.when(F.col("label") == 3, None).otherwise(F.col("embedding")).alias("vector"),
            F.concat(F.lit("clause "), F.col("vec_id").cast("string")).alias("text"),
        )


def apart(df: DataFrame, key: str, rows: str) -> DataFrame:
    """The whole table, with the key of some rows moved out of reach of any match."""
    from pyspark.sql import functions as F

    return df.withColumn(key, F.expr(f"case when {rows} then -1 - {key} else {key} end"))


def query(name: str, build: Callable[[Tables], DataFrame], sql: str | None = None, **ctes: str) -> None:
    """Register a query; ``sql`` may use the view names and the extra CTEs."""
    assert name not in QUERIES, name
    QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
    if sql is not None:
        ORACLES[name] = duck(sql, **ctes)
