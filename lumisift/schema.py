"""Table schemas and the check that a table has them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema

DISK = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("mtime", T.LongType()),
    T.StructField("size", T.LongType()),
])

# A removed row keeps its image_id, with empty path and content_hash.
# vec_version names the append that holds the image's vector.
MANIFEST = T.StructType([
    T.StructField("image_id", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("mtime", T.LongType()),
    T.StructField("size", T.LongType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("vec_version", T.LongType()),
])

VECTORS = T.StructType([
    T.StructField("image_id", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

COMMITS = T.StructType([
    T.StructField("version", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("max_image_id", T.LongType()),
    T.StructField("first_vectors", T.LongType()),
    T.StructField("voided", T.LongType()),
    T.StructField("indexed", T.LongType()),
    T.StructField("removed", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("run", T.StringType()),
])


def require(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``; another shape is an error."""
    found = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    for field in schema.fields:
        if found.get(field.name) != field.dataType.simpleString():
            raise ValueError(
                f"column {field.name}: expected {field.dataType.simpleString()}, "
                f"found {found.get(field.name)}"
            )
    return df.select(*schema.fieldNames())


def small_table(spark: SparkSession, rows: list[dict], schema: T.StructType) -> DataFrame:
    """A few rows as a local relation, whose size the optimizer knows."""
    return spark.createDataFrame(pa.Table.from_pylist(rows, to_arrow_schema(schema)), schema)
