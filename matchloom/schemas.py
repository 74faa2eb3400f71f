"""Table schemas, and conforming a frame to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.functions.vocab import AUDIO_COLUMNS

STRING, STRINGS = T.StringType(), T.ArrayType(T.StringType())


def fields(names: str, kind: T.DataType) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names.split()]


TARGETS = T.StructType(fields("target_id target_name description target_url", STRING) + fields("genres subgenres activity countries languages tempos moods", STRINGS) + fields("tier", T.IntegerType()) + fields("updated_at", T.TimestampType()))
INTERACTIONS = T.StructType(fields("match_id campaign_id target_id target_name target_url status item_id url_item_id source_item_id item_name artist item_url", STRING) + fields("updated_at", T.TimestampType()))
ITEMS = T.StructType(fields("item_id item_name artist album", STRING) + fields("duration_ms popularity", T.DoubleType()) + fields(" ".join(AUDIO_COLUMNS), T.DoubleType()))
EMBEDDING_CACHE = T.StructType([T.StructField("text_hash", STRING), T.StructField("model_name", STRING), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in order: absent ones are typed nulls, bad values null, NaN null."""
    have = set(df.columns)
    out = []
    for f in schema.fields:
        if f.name not in have:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        c = F.col(f"`{f.name}`")
        simple = isinstance(df.schema[f.name].dataType, T.StringType) and not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))
        c = c.try_cast(f.dataType) if simple else c.cast(f.dataType)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        out.append(c.alias(f.name))
    return df.select(*out)
