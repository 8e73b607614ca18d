"""Schemas at the stage boundaries."""

from pyspark.sql import types as T

TURN = T.StructType(
    [T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]
)
DIALOG = T.ArrayType(TURN)

POSTS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
)

PROMPTS = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("id", T.IntegerType()),
        T.StructField("step", T.IntegerType()),
        T.StructField("content", T.StringType()),
    ]
)


def labels(label_col: str) -> T.StructType:
    """Label table with one row for each cluster."""
    return T.StructType(
        [
            T.StructField("Cluster", T.IntegerType()),
            T.StructField("Text", T.StringType()),
            T.StructField(label_col, T.StringType()),
            T.StructField("Cluster Count", T.LongType()),
        ]
    )
