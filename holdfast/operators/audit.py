"""Audited repairs: keep-first deduplication, reference checks and the audit row per check."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F, types as T

from holdfast.functions.scalars import pct
from holdfast.operators.stable import stable

COPIES = "_copies"
# repeated or unknown keys that are taken to the rows (two whole numbers each); with more, the rows are shuffled
FEW_KEYS = 4_000_000


def _few(keys: DataFrame) -> DataFrame:
    """Keys that rows are compared with, found before the rows are read: adaptive execution would shuffle the rows meanwhile."""
    found = stable(keys)
    return F.broadcast(found) if found.count() <= FEW_KEYS else found


class Check(NamedTuple):
    issue: str
    affected: Column  # aggregate
    total: Column  # aggregate
    treatment: str
    reason: str


def audit(flagged: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """(issue, affected, total, pct, treatment, reason), all checks of a table from one pass over it."""
    one_row = flagged.agg(
        *[F.coalesce(c.affected, F.lit(0)).cast("long").alias(f"a{i}") for i, c in enumerate(checks)],
        *[F.coalesce(c.total, F.lit(0)).cast("long").alias(f"n{i}") for i, c in enumerate(checks)],
    )
    rows = [
        F.struct(
            F.lit(c.issue).alias("issue"), F.col(f"a{i}").alias("affected"), F.col(f"n{i}").alias("total"),
            F.coalesce(pct(F.col(f"a{i}"), F.col(f"n{i}"), 3), F.lit(0.0)).alias("pct"),
            F.lit(c.treatment).alias("treatment"), F.lit(c.reason).alias("reason"),
        )
        for i, c in enumerate(checks)
    ]
    return one_row.select(F.inline(F.array(*rows)))


def first_order(df: DataFrame, key: str) -> Column:
    """What "first" means for the rows of a table: position in the files if known, then the id. Whole numbers are packed
    into one decimal of fixed width, which lets Spark aggregate by hash."""
    if "ingest_ord" not in df.columns:
        return F.col(key)
    if isinstance(df.schema["ingest_ord"].dataType, T.IntegralType):
        return F.col("ingest_ord").cast("decimal(10,0)") * F.lit("10000000000000000000").cast("decimal(20,0)") + F.col(key).cast("decimal(20,0)")
    return F.struct("ingest_ord", key)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in ``order`` plus the number of rows it stands for (column ``_copies``).

    A partial aggregate, so a key that holds a large part of the table is reduced in every map task
    before the shuffle. NULL keys form a group of their own.
    """
    kept = [c for c in df.columns if c not in keys]
    # remaining columns make the choice deterministic where the order leaves a tie
    rank = F.struct(*order, *[c for c in kept if c not in order])
    return (
        df.groupBy(*keys).agg(F.min_by(F.struct(*kept), rank).alias("_row"), F.count("*").alias(COPIES))
        .select(*keys, "_row.*", COPIES)
    )


def key_digest(keys: Sequence[str]) -> dict[str, Column]:
    """Two 64-bit digests of a key as columns ``_d1`` and ``_d2``; missing values count."""
    absent = F.concat(*[F.when(F.col(k).isNull(), "1").otherwise("0") for k in keys])
    return {"_d1": F.xxhash64(*keys, absent), "_d2": F.xxhash64(F.lit("second"), absent, *keys)}


def first_of_repeated(df: DataFrame, keys: Sequence[str], key: str) -> DataFrame:
    """First row per key, for a table in which few keys repeat; what "first" means says ``first_order(df, key)``.

    A hash aggregate over digests of the key finds the repeated ones; nothing but the digests is shuffled for it. Rows of all
    other keys stream past these few and are not shuffled (beyond FEW_KEYS of them they are); only the rows of repeated keys are reduced
    further, by a partial aggregate, so that a key that holds a large part of the table is one row per map task.
    NULL keys form a group of their own. Rows with the same key and place are told apart by their remaining columns; a missing
    place comes last."""
    digests = list(key_digest(keys))
    tagged = df.withColumns(key_digest(keys))
    repeated = _few(tagged.groupBy(*digests).agg(F.count("*").alias(COPIES)).where(F.col(COPIES) > 1).select(*digests))
    alone = tagged.join(repeated, digests, "left_anti")
    copies = tagged.join(repeated, digests, "left_semi").withColumn("_place", first_order(df, key))
    order = F.struct(F.col("_place").isNull(), "_place", *[c for c in df.columns if c not in keys])
    picked = copies.groupBy(*digests).agg(F.min_by(F.struct(*df.columns), order).alias("_row")).select("_row.*")
    return alone.select(*df.columns).unionByName(picked)


def unknown_codes(df: DataFrame, parents: dict[str, DataFrame]) -> DataFrame:
    """(_code, _of): the values of several key columns that no parent has, with the column's number, from one pass over the
    keys; see ``rows_without``."""
    used = df.select(F.inline(F.array(*[F.struct(F.col(c).alias("_code"), F.lit(i).alias("_of")) for i, c in enumerate(parents)])))
    held = reduce(DataFrame.unionAll, [t.select(F.col(c).alias("_code"), F.lit(i).alias("_of")) for i, (c, t) in enumerate(parents.items())])
    return _few(used.where("_code IS NOT NULL").distinct().join(held.distinct(), ["_code", "_of"], "left_anti"))


def rows_without(df: DataFrame, codes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows all of whose key columns are known; unknown codes are few and taken to the rows."""
    out = df
    for i, column in enumerate(columns):
        own = codes.where(F.col("_of") == i)
        out = out.where(F.col(column).isNotNull()).join(own, F.col(column) == own["_code"], "left_anti")
    return out


def mark_known(df: DataFrame, key: str, parents: DataFrame, flag: str) -> DataFrame:
    """Add ``flag``: true where ``key`` occurs in the parent's column of the same name."""
    known = parents.select(key).where(F.col(key).isNotNull()).distinct().withColumn(flag, F.lit(True))
    return df.join(known, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def orphans(df: DataFrame, key: str, parents: DataFrame) -> DataFrame:
    """Rows whose key the parent does not have, a missing key included. The unknown keys are found among the distinct ones;
    they are few, so that adaptive execution can take them to the rows instead of shuffling the rows."""
    unknown = df.select(key).distinct().join(parents.select(key).distinct(), key, "left_anti")
    return df.join(unknown, df[key].eqNullSafe(unknown[key]), "left_semi")


def known_rows(df: DataFrame, key: str, parents: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Rows whose key the parent has. The unknown keys are found among the distinct ones; they are few, so that adaptive
    execution can take them to the rows instead of shuffling the rows. ``source``: a table with all keys of ``df`` that is
    cheaper to read."""
    used = (df if source is None else source).select(key).where(F.col(key).isNotNull()).distinct()
    unknown = used.join(parents.select(key).distinct(), key, "left_anti")
    return df.where(F.col(key).isNotNull()).join(unknown, key, "left_anti")
