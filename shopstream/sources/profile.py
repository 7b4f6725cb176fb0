"""What fields the wire messages really hold, known or not."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import ensure_checkpoint_dir

KINDS = "path string, kind string, n bigint"
# a JSON string from its second character on; possessive, so a long one is neither tried again nor kept on the stack
_REST = r'[^"\\]*+(?:\\.[^"\\]*+)*+"'
_TOKENS = rf'("{_REST}\s*+:)|("){_REST}|-?[0-9][0-9.eE+-]*+'
_MARK = "\x01"                                                             # never stands in a JSON value as it is


def _kind(v: Column) -> Column:
    """JSON kind of a variant: object, array, string, number, boolean or null."""
    shape = F.schema_of_variant(v)
    return (F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array")
            .when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean").when(shape == "VOID", "null")
            .otherwise("number"))


def _skeleton(text: Column) -> Column:
    """A JSON text with its string values empty and its numbers 0: paths and kinds stay.  Null for texts that aren't JSON."""
    marked = F.regexp_replace(text, _TOKENS, f"$1$2$2{_MARK}")             # a name as it is, "" or nothing, then the mark
    for old, new in ((f":{_MARK}", ":"), (f'"{_MARK}', '"'), (_MARK, "0")):
        marked = F.replace(marked, F.lit(old), F.lit(new))
    return F.when(F.try_parse_json(text).isNotNull(), marked)


def field_profile(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """(path, kind, n): how often each path of the JSON documents holds a value of a kind.

    ``$`` is the document, ``.name`` a field, ``[*]`` the elements of an array.  Texts that aren't JSON count
    under ``$`` as ``malformed``.  The messages are read once: messages whose skeletons are equal are counted
    together (partial aggregates, so no shape is a hot key), and the skeletons with their counts are
    checkpointed.  Each step opens the objects and arrays of the one before with a lateral ``variant_explode``;
    there are as many steps as the deepest document has levels, all over the skeletons alone.
    """
    spark = raw.sparkSession
    ensure_checkpoint_dir(spark)
    shapes = raw.groupBy(_skeleton(F.col(value_col)).alias("shape")).agg(F.count(F.lit(1)).alias("n")).checkpoint()
    level = (shapes.where("shape IS NOT NULL").select(F.lit("$").alias("path"), F.try_parse_json("shape").alias("v"), "n")
             .withColumn("kind", _kind(F.col("v"))))
    counted = [shapes.where("shape IS NULL").select(F.lit("$").alias("path"), F.lit("malformed").alias("kind"), "n"),
               level.select("path", "kind", "n")]
    while True:
        inner = level.where(F.col("kind").isin("object", "array")).withColumnRenamed("kind", "outer_kind")
        if inner.isEmpty():
            break
        opened = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        step = F.when(F.col("outer_kind") == "array", "[*]").otherwise(F.concat(F.lit("."), F.col("key")))
        level = (opened.select(F.concat("path", step).alias("path"), F.col("value").alias("v"), "n")
                 .withColumn("kind", _kind(F.col("v"))))
        counted.append(level.select("path", "kind", "n"))
    rows = reduce(DataFrame.unionByName, counted)
    return rows.groupBy("path", "kind").agg(F.sum("n").alias("n"))
