"""Idempotent merges of a rollup with what is stored: the same delta twice changes nothing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.store import materialised


def _greatest(old: str, new: str, **_) -> Column:
    return F.greatest(old, new)


def _least(old: str, new: str, **_) -> Column:
    return F.least(old, new)


def _union(old: str, new: str, **_) -> Column:
    return F.array_sort(F.array_union(F.coalesce(old, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>"))))


def _newer(old: str, new: str, guard: Column) -> Column:
    return F.when(guard, F.col(new)).otherwise(F.col(old))


#: greatest (monotone counts), least (first seen), union (sets), newer (replaced by an equal or later generation),
#: last (last writer wins by an order that the rows carry).
CLASSES = {"greatest": _greatest, "least": _least, "union": _union, "newer": _newer, "last": _newer}


def merged(target: DataFrame, delta: DataFrame, keys: list[str], columns: dict[str, str], order: list[str] | None = None) -> DataFrame:
    """target with delta merged in, by keys; columns maps each value column to its class.

    order names the columns that decide for `newer` (an equal one replaces) and `last` (an equal one changes nothing).
    Both sides hold one row a key.
    """
    order = order or []
    a = target.select(*keys, *[F.col(c).alias(f"__old_{c}") for c in dict.fromkeys([*columns, *order])], F.lit(True).alias("__has_old"))
    b = delta.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in dict.fromkeys([*columns, *order])], F.lit(True).alias("__has_new"))
    both = a.join(b, keys, "full")
    old, new = F.struct(*[F.col(f"__old_{c}") for c in order] or [F.lit(0)]), F.struct(*[F.col(f"__new_{c}").alias(f"__old_{c}") for c in order] or [F.lit(0)])
    only_new, has_new = F.col("__has_old").isNull(), F.coalesce("__has_new", F.lit(False))

    def value(c: str, kind: str) -> Column:
        guard = has_new & (only_new | (new >= old if kind == "newer" else new > old))
        return CLASSES[kind](f"__old_{c}", f"__new_{c}", **({"guard": guard} if kind in ("newer", "last") else {})).alias(c)

    kinds = {**{c: next((k for k in columns.values() if k in ("newer", "last")), "last") for c in order}, **columns}
    return both.select(*keys, *[value(c, k) for c, k in kinds.items()])


def upsert(spark: SparkSession, path: str, delta: DataFrame, keys: list[str], columns: dict[str, str], partition: list[str], order: list[str] | None = None) -> None:
    """Merge delta into the rollup stored at path, partitioned by some of its keys.

    Only partitions that delta touches are read and replaced. The merged rows are materialised before any file goes, and
    merging a delta again changes nothing, so a batch that comes twice, or a run that ends half way, does no harm. Both
    sides hold one row a key. For streams: foreachBatch(lambda batch, _: upsert(...)).
    """
    delta = materialised(delta)
    touched = delta.select(*partition).distinct()
    try:
        target = spark.read.schema(delta.schema).parquet(path)
        target = target.join(touched, partition, "left_semi")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        target = delta.limit(0)
    out = materialised(merged(target, delta, keys, columns, order).select(*delta.columns))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)
