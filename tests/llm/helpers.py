"""Small tables for the corpus operators: awkward rows that every operator must take."""

import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def awkward(spark, extra=()):
    """Nulls, an empty text, a very long one, ties, repeated rows and columns with clashing names."""
    rows = [(None, "a null id with a few words"), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "tab\tand\nline\x0bbreaks\x0c here "), (6, "w%d " * 30000 % tuple(range(30000))), *extra]
    schema = "doc_id long, text string, size int, shard string, s string, base string, part string, n long, token string, kept string, h long, node long"
    return spark.createDataFrame([(*r, 7, "x", "y", "z", "p", 1, "t", "k", 2, 3) for r in rows], schema)


def table_rows(spark, name, sf=SMALL):
    return [r.asDict() for r in spark.read.parquet(f"{sf}/{name}.parquet").collect()]
