"""Row types of the generic relations that operators work on."""

from pyspark.sql import types as T

PARAMETER = T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType())])
SIGNATURE = T.StructType([T.StructField("parameters", T.ArrayType(PARAMETER)), T.StructField("return_type", T.StringType()), T.StructField("decorators", T.ArrayType(T.StringType())), T.StructField("raw", T.StringType())])
FIELD = T.StructType([T.StructField("name", T.StringType()), T.StructField("type_annotation", T.StringType()), T.StructField("default_value", T.StringType())])
TAG = T.StructType(
    [
        T.StructField("rel_fname", T.StringType()),
        T.StructField("fname", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("node_type", T.StringType()),
        T.StructField("parent_name", T.StringType()),
        T.StructField("parent_line", T.IntegerType()),
        T.StructField("signature", SIGNATURE),
        T.StructField("fields", T.ArrayType(FIELD)),
    ]
)
HISTORY = T.StructType([T.StructField("commit_id", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("author", T.StringType()), T.StructField("file", T.StringType())])
SYMBOL_EDGE = T.StructType([T.StructField(n, T.StringType()) for n in ("src_file", "src_sym", "dst_file", "dst_sym")])
EDGE = T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.StringType())])
