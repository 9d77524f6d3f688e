"""Loader invariants. A breach refuses the input; nothing is repaired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..language.names import SCALARS, TAGS


class LoadError(ValueError):
    pass


def _bad_number(v: Column) -> Column:
    return F.isnan(v) | (F.abs(v) == F.lit(float("inf")))


def _some(c: Column, prop: str, test) -> Column:
    return F.exists(c, lambda x: F.coalesce(test(x[prop]), F.lit(False)))


def load_error(schema: T.StructType) -> Column:
    """The first breach of a canonical event, or null."""
    found: list[Column] = []
    no = F.lit(False)
    for f in schema.fields:
        low, c = f.name.lower(), F.col(f.name)
        if low == "_parse_error":
            found.insert(0, c)
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            props = {x.name.lower(): x.name for x in f.dataType.elementType.fields}
            if "pt" in props:
                # Elements without pt are skipped but don't reset the order; equal values may follow.
                pts = F.filter(F.transform(c, lambda x: x[props["pt"]]), lambda v: v.isNotNull())
                found.append(F.when(F.exists(F.zip_with(F.slice(pts, F.lit(1), F.greatest(F.size(pts) - 1, F.lit(0))), F.slice(pts, F.lit(2), F.size(pts)), lambda a, b: b > a), lambda v: F.coalesce(v, no)), F.lit(f"{f.name} doesn't fall in pt")))
            for p in ("pt", "e"):
                if p in props:
                    found.append(F.when(_some(c, props[p], lambda v: v < 0), F.lit(f"{f.name} has a negative {p}")))
            for p in TAGS & set(props):
                found.append(F.when(_some(c, props[p], lambda v: ~v.isin(0, 1)), F.lit(f"{f.name}.{p} is neither 0 nor 1")))
            for p in props.values():
                found.append(F.when(_some(c, p, _bad_number), F.lit(f"{f.name}.{p} isn't finite")))
        elif low == "met":
            v = c["pt"] if isinstance(f.dataType, T.StructType) else c
            found.append(F.when(v < 0, F.lit("MET has a negative pt")))
        elif low in SCALARS:
            found.append(F.when(c < 0, F.lit(f"{f.name} is negative")))
        elif low == "triggers" and isinstance(f.dataType, T.StructType):
            for x in f.dataType.fields:
                found.append(F.when(~c[x.name].isin(0, 1), F.lit(f"trigger {x.name} is neither 0 nor 1")))
    return F.coalesce(*found, F.lit(None).cast("string"))


def validated(df: DataFrame) -> DataFrame:
    """The events with ``_load_error`` (null where they are sound)."""
    return df.withColumn("_load_error", load_error(df.schema))


def refusing(df: DataFrame, read: set[str] | None = None, order: str = "event") -> DataFrame:
    """The events, of which an unsound one raises when it is read. Only the columns ``read`` (by lower-cased names) are checked,
    so no others are read for it."""
    kept = T.StructType([f for f in df.schema.fields if read is None or f.name.lower() in read])
    error = load_error(kept)
    at = F.concat(F.lit("event "), F.coalesce(F.col(order).cast("string"), F.lit("?")), F.lit(": ")) if order in df.columns else F.lit("")
    sound = F.when(error.isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(at, error)).cast("boolean"))
    return df.where(sound)


def check_events(df: DataFrame, order: str = "event") -> DataFrame:
    """The events; raises for the first unsound one by ``order``. One aggregated row is read."""
    bad = validated(df).agg(F.min(F.when(F.col("_load_error").isNotNull(), F.struct(F.col(order), F.col("_load_error")))).alias("b")).first()["b"]
    if bad is not None:
        raise LoadError(f"event {bad[0]}: {bad[1]}")
    return df
