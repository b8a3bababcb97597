"""Fixed schemas of the tables that enter and leave the library."""

from pyspark.sql import types as T

PARSED_LOG = T.StructType([
    T.StructField("LineId", T.LongType()),
    T.StructField("EventId", T.StringType()),
    T.StructField("Content", T.StringType()),
    T.StructField("EventTemplate", T.StringType()),
    T.StructField("ParameterList", T.StringType()),
])

TEMPLATES = T.StructType([
    T.StructField("EventId", T.StringType()),
    T.StructField("EventTemplate", T.StringType()),
    T.StructField("Occurrences", T.LongType()),
])

# Positional: the four columns carry no dependable names in the file.
POSITIONAL_LOG = T.StructType([
    T.StructField("c0", T.StringType()),
    T.StructField("c1", T.StringType()),
    T.StructField("c2", T.StringType()),
    T.StructField("c3", T.StringType()),
])

ANNOTATIONS = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("Type", T.StringType()),
])

# One row per value that a format covers; lists are built only at a sink.
FORMAT_ROWS = T.StructType([
    T.StructField("DynamicID", T.LongType()),
    T.StructField("Template", T.StringType()),
    T.StructField("ParameterIndex", T.IntegerType()),
    T.StructField("TokenFormat", T.StringType()),
    T.StructField("Token", T.StringType()),
    T.StructField("ComponentFormat", T.StringType()),
    T.StructField("Value", T.StringType()),
    T.StructField("Parts", T.ArrayType(T.StringType())),
    T.StructField("ValueType", T.StringType()),
    T.StructField("GroupID", T.LongType()),
    T.StructField("FirstLine", T.LongType()),
])
