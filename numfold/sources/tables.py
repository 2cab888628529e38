"""Test tables as relations of vectors, images, signals, samples, and JSON forms of arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEIGHT, WIDTH = 31, 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, a): embeddings as double vectors, which are 8 x 8 matrices as well."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, r, c, v): whole event values by day and hour, one image an event type, empty pixels 0."""
    events = table(spark, sf_dir, "events")
    pixel = events.groupBy(F.col("event_type").alias("img"), (F.dayofmonth("ts") - 1).alias("r"), F.hour("ts").alias("c")).agg(F.sum(F.floor("value")).cast("double").alias("v"))
    rows, cols = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (HEIGHT, WIDTH))
    grid = events.select(F.col("event_type").alias("img")).distinct().select("img", rows.alias("r")).select("img", "r", cols.alias("c"))
    return grid.join(pixel, ["img", "r", "c"], "left").select("img", "r", "c", F.coalesce("v", F.lit(0.0)).alias("v"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, k, x): event values by user in the order of event_id."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("series"), F.col("event_id").alias("k"), F.col("value").alias("x"))


def to_json(values: Column, nrows: int, ncols: int) -> Column:
    """Nested row-major JSON of a column-major matrix."""
    return F.to_json(F.array(*(F.array(*(values[j * nrows + i] for j in range(ncols))) for i in range(nrows))))


def from_json(text: Column) -> Column:
    """Column-major values of nested row-major JSON."""
    rows = F.from_json(text, "array<array<double>>")
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(rows[0]) - 1), lambda j: F.transform(rows, lambda r: F.get(r, j))))


def vector_to_json(values: Column) -> Column:
    """Flat JSON array."""
    return F.to_json(values)


def vector_from_json(text: Column) -> Column:
    return F.from_json(text, "array<double>")


def sized_to_json(values: Column, nrows: Column, ncols: Column) -> Column:
    """JSON object of nrows, ncols and column-major data."""
    return F.to_json(F.struct(nrows.cast("int").alias("nrows"), ncols.cast("int").alias("ncols"), values.alias("data")))


def sized_from_json(text: Column) -> Column:
    """Struct (nrows, ncols, data); an error if the sizes do not fit the data."""
    m = F.from_json(text, "nrows int, ncols int, data array<double>")
    return F.when(m["nrows"] * m["ncols"] == F.size(m["data"]), m).otherwise(F.raise_error(F.lit("the data does not fit nrows and ncols")))


def to_ml(values: Column) -> Column:
    """A vector of pyspark.ml."""
    from pyspark.ml.functions import array_to_vector

    return array_to_vector(values)


def from_ml(vector: Column) -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(vector)
