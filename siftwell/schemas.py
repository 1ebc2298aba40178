"""The tables of the engine."""

from pyspark.sql import types as T

FILES = T.StructType(
    [
        T.StructField("hash", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime", T.DoubleType()),
        T.StructField("path", T.StringType()),
    ]
)
MANIFEST = T.StructType([*FILES.fields, T.StructField("hash_algo", T.StringType())])
ACTIONS = T.StructType(
    [
        T.StructField("action", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("dest", T.StringType()),
        T.StructField("hash", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("reason", T.StringType()),
    ]
)
RESULTS = T.StructType([*ACTIONS.fields, T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType())])
