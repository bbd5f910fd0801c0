"""Small tables with every kind of dirt, for the tests of the text operators."""

from pyspark.sql import functions as F

DOC = "doc_id long, id string, observed double, parser string, receipt string, text string, lang string, source string, source_id string, n_chars long"
URL = "url string, document_id string"
BLOCK = "document_id string, block_id string, position int, kind string, text string, headings array<string>, heading_level int"
CALL = "request_key string, request_json string, response_json string, error_json string, legacy_refs_json string, ordinal long"

#: Columns that operators use for themselves, or that other tables have.
CLASH = ["site", "day", "items", "item", "html", "tokens", "repeats", "keys", "key", "h", "code", "fill", "n", "mark", "part", "p", "whole", "blocks", "n_docs", "status", "score", "label", "confidence", "line_no", "template"]


def with_clashes(df):
    """The table with further columns of clashing names."""
    return df.select("*", *[F.lit(f"other {c}").alias(c) for c in CLASH if c not in df.columns])


def documents(spark, rows):
    base = dict(doc_id=None, id=None, observed=None, parser="p", receipt="{}", text=None, lang=None, source=None, source_id=None, n_chars=None)
    names = list(base)
    return spark.createDataFrame([tuple({**base, **r}[n] for n in names) for r in rows], DOC)


def blocks(spark, rows):
    base = dict(document_id=None, block_id=None, position=None, kind="paragraph", text=None, headings=[], heading_level=None)
    names = list(base)
    return spark.createDataFrame([tuple({**base, **r}[n] for n in names) for r in rows], BLOCK)


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def read(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")
