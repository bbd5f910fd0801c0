"""Digests of rows and tables that tell types apart: 1, 1.0, "1" and true all differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def encoded(c: Column, kind: T.DataType) -> Column:
    """An unambiguous text of a value: a tag of its kind, its length, its content.  NaN and infinities are refused."""
    if isinstance(kind, T.StructType):
        parts = [F.concat(_sized("k", F.lit(f.name)), encoded(c[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(c.isNull(), "n0:").otherwise(_sized("o", F.concat(*parts) if parts else F.lit("")))
    if isinstance(kind, T.ArrayType):
        return F.when(c.isNull(), "n0:").otherwise(_sized("l", F.array_join(F.transform(c, lambda x: encoded(x, kind.elementType)), "")))
    if isinstance(kind, T.MapType):
        entry = F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(_sized("k", e["key"]) if isinstance(kind.keyType, T.StringType) else encoded(e["key"], kind.keyType), encoded(e["value"], kind.valueType)))
        return F.when(c.isNull(), "n0:").otherwise(_sized("o", F.array_join(entry, "")))
    if isinstance(kind, T.BinaryType):
        text, tag = F.hex(c), "b"
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        d = c.cast("double")
        text = F.when(F.isnan(d) | (F.abs(d) == float("inf")), F.raise_error(F.lit("no digest of NaN or infinity"))).otherwise(d.cast("string"))
        tag = "f"
    elif isinstance(kind, T.BooleanType):
        text, tag = c.cast("string"), "t"
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        text, tag = c.cast("string"), "i"
    elif isinstance(kind, T.StringType):
        text, tag = c, "s"
    else:
        text, tag = c.cast("string"), kind.typeName()
    return F.when(c.isNull(), "n0:").otherwise(_sized(tag, text))


def _sized(tag: str, text: Column) -> Column:
    return F.concat(F.lit(tag), F.length(text).cast("string"), F.lit(":"), text)


def row_digest(df: DataFrame, columns: list[str] | None = None, name: str = "digest") -> DataFrame:
    """Add the SHA-256 of the columns, whatever their order."""
    cols = sorted(columns or df.columns)
    text = F.concat(*[F.concat(_sized("k", F.lit(c)), encoded(F.col(c), df.schema[c].dataType)) for c in cols])
    return df.withColumn(name, F.sha2(text, 256))


def table_digest(df: DataFrame) -> str:
    """A digest of the bag of rows: row digests are added up, so neither order nor partitions matter."""
    d = row_digest(df, name="__d")
    pieces = [F.sum(F.conv(F.substring("__d", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)").cast("decimal(38,0)")).alias(f"s{i}") for i in range(8)]
    row = d.agg(F.count(F.lit(1)).alias("n"), *pieces).first()
    import hashlib

    return hashlib.sha256("|".join(str(row[c] or 0) for c in ("n", *[f"s{i}" for i in range(8)])).encode()).hexdigest()


def schema_digest(df: DataFrame) -> str:
    import hashlib

    return hashlib.sha256(df.schema.json().encode()).hexdigest()
