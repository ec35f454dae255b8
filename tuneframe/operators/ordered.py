"""Ordered scans within a key that stay distributed when one key is hot.

``Window.partitionBy(key).orderBy(t)`` puts every row of a key into one task.
Here the order is cut into buckets of a given width, and rows are dealt by
``(key, bucket)``: a key that holds a third of the data is spread over as
many tasks as it has buckets. What a bucket needs of earlier ones is one
edge per bucket and key, so the rows themselves move once and nothing is
sorted, sampled or checkpointed beforehand.

* :func:`lag_scan`: the previous row's values within the key (nulls kept);
* :func:`carry_scan`: the last non-null value at or before each row
  (``last(x, ignoreNulls)``), the position, or both;
* :func:`asof_join`: the latest right row at or before each left row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_of(order: str, width: float) -> Column:
    """The bucket of a numeric order column."""
    return F.floor(F.col(order) / F.lit(width)).cast("bigint")


def lag_scan(df: DataFrame, key: list[str], order: list[str], cols: list[str], width: float, suffix: str = "_prev") -> DataFrame:
    """Add ``<col><suffix>``: the value of the row before within the key, as ``lag`` gives it.

    ``order[0]`` is numeric and is cut into buckets of ``width``. Inside a
    bucket a window suffices. The first row of a bucket follows the last row
    of the key's bucket before: the first and last rows of all buckets, two
    per bucket at most, are put in order among themselves. Both parts read
    the same shuffle.
    """
    b = df.withColumn("_b", bucket_of(order[0], width))
    w = Window.partitionBy(*key, "_b").orderBy(*order)
    inside = b.select("*", F.row_number().over(w).alias("_rn"), F.lead(F.lit(1)).over(w).isNull().alias("_end"),
                      *[F.lag(c).over(w).alias(f"{c}{suffix}") for c in cols])
    over = Window.partitionBy(*key).orderBy("_b", "_rn")
    edge = inside.filter((F.col("_rn") == 1) | F.col("_end"))
    for c in cols:
        edge = edge.withColumn(f"{c}{suffix}", F.lag(c).over(over))
    out = inside.filter("_rn > 1").unionByName(edge.filter("_rn = 1"))
    return out.drop("_b", "_rn", "_end")


def carry_scan(
    df: DataFrame,
    key: list[str],
    order: list[str],
    width: float,
    fill: list[str] | None = None,
    last: list[str] | None = None,
    position: str | None = None,
    suffix: str = "_last",
    sums: dict[str, str] | None = None,
    tops: dict[str, str] | None = None,
) -> DataFrame:
    """Add ``<col><suffix>`` for ``fill`` (last non-null value at or before the row),
    ``<col>_prev`` for ``last`` (the row before's value, nulls kept), ``position`` (from 1),
    and for ``sums`` and ``tops`` (new name -> column) the sum and the maximum up to the row.

    What enters a bucket comes from one row per bucket and key, joined back
    on ``(key, bucket)``, by which the rows lie dealt already.
    """
    fill, last, sums, tops = fill or [], last or [], sums or {}, tops or {}
    b = df.withColumn("_b", bucket_of(order[0], width))
    w = Window.partitionBy(*key, "_b").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = b.select("*", F.row_number().over(w).alias("_rn"),
                    *[F.last(c, ignorenulls=True).over(upto).alias(f"_f_{c}") for c in fill],
                    *[F.lag(c).over(w).alias(f"_l_{c}") for c in last],
                    *[F.sum(c).over(upto).alias(f"_s_{n}") for n, c in sums.items()],
                    *[F.max(c).over(upto).alias(f"_t_{n}") for n, c in tops.items()])
    at = F.struct(*order) if len(order) > 1 else F.col(order[0])
    ends = [F.count(F.lit(1)).alias("_n")]
    ends += [F.max_by(F.struct(c), F.when(F.col(c).isNotNull(), at)).alias(f"_f_{c}") for c in fill]
    ends += [F.max_by(F.struct(c), at).alias(f"_l_{c}") for c in last]
    ends += [F.sum(c).alias(f"_s_{n}") for n, c in sums.items()] + [F.max(c).alias(f"_t_{n}") for n, c in tops.items()]
    edges = b.groupBy(*key, "_b").agg(*ends)
    before = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    into = edges.select(*key, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                        *[F.last(f"_f_{c}", ignorenulls=True).over(before)[c].alias(f"_cf_{c}") for c in fill],
                        *[F.last(f"_l_{c}").over(before)[c].alias(f"_cl_{c}") for c in last],
                        *[F.sum(f"_s_{n}").over(before).alias(f"_cs_{n}") for n in sums],
                        *[F.max(f"_t_{n}").over(before).alias(f"_ct_{n}") for n in tops])
    match = F.col("h._b").eqNullSafe(F.col("i._b"))
    for k in key:
        match = match & F.col(f"h.{k}").eqNullSafe(F.col(f"i.{k}"))
    out = here.alias("h").join(into.alias("i"), match)
    made = [F.coalesce(F.col(f"_f_{c}"), F.col(f"_cf_{c}")).alias(f"{c}{suffix}") for c in fill]
    made += [F.when(F.col("_rn") > 1, F.col(f"_l_{c}")).otherwise(F.col(f"_cl_{c}")).alias(f"{c}_prev") for c in last]
    made += [(F.coalesce(f"_s_{n}", F.lit(0)) + F.coalesce(f"_cs_{n}", F.lit(0))).alias(n) for n in sums]
    made += [F.greatest(f"_t_{n}", f"_ct_{n}").alias(n) for n in tops]
    if position:
        made.append((F.col("_before") + F.col("_rn")).cast("bigint").alias(position))
    return out.select(*[F.col(f"h.{c}") for c in df.columns], *made)


def asof_join(left: DataFrame, right: DataFrame, key: list[str], order: str, cols: list[str], width: float) -> DataFrame:
    """Each left row gets the right row's ``cols`` with the largest ``order``
    ``<=`` its own (per key): union both sides, forward-fill the right
    values over the ordered scan, keep the left rows. Right rows sort before
    left rows at equal ``order``, so an equal value matches.
    """
    lcols = left.columns
    l2 = left.select(
        *lcols, *[F.lit(None).cast(right.schema[c].dataType).alias(f"_r_{c}") for c in cols], F.lit(1).alias("_side")
    )
    rsel = [F.col(k) for k in key] + [F.col(order)] + [F.col(c).alias(f"_r_{c}") for c in cols]
    r2 = right.select(*rsel, F.lit(0).alias("_side"))
    for c in lcols:
        if c not in r2.columns:
            r2 = r2.withColumn(c, F.lit(None).cast(left.schema[c].dataType))
    u = l2.unionByName(r2.select(*l2.columns))
    scanned = carry_scan(u, key, [order, "_side"], width, fill=[f"_r_{c}" for c in cols], suffix="_now")
    out = scanned.filter(F.col("_side") == 1)
    return out.select(*lcols, *[F.col(f"_r_{c}_now").alias(c) for c in cols])


# Shares that a group is dealt into before its first rows are taken.
TOP_K_SHARES = 64


def top_k_per_group(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows per group under ``order`` (Column expressions).

    ``row_number() <= k`` is planned with a partial ``WindowGroupLimit``
    before the shuffle, so each task ships at most ``k`` rows per group and
    a group holding a third of all rows never reaches one task whole. Spark
    plans that only up to ``spark.sql.optimizer.windowGroupLimitThreshold``;
    beyond it the first ``k`` rows of 64 shares of each group are taken first.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > limit:
        share = F.pmod(F.xxhash64(*[c for c, t in df.dtypes if not t.startswith(("map", "variant"))]), F.lit(TOP_K_SHARES))
        shares = Window.partitionBy(*group, "_share").orderBy(*order)
        df = df.withColumn("_share", share).withColumn("_r", F.row_number().over(shares))
        df = df.filter(F.col("_r") <= k).drop("_r", "_share")
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")
