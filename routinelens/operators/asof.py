"""As-of join: for each left row the latest right row of its key at or before its time.

The rows of both sides meet in one window per key and time bucket, so a key that holds a third of all rows is
spread over its buckets. What a bucket inherits is the last right row of the buckets before it: a table of one row a
key and bucket, scanned by a small window per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets that the time range is cut into if no width is given.
BUCKETS = 256


def bucket_width(left: DataFrame, time: str, buckets: int = BUCKETS) -> int:
    low, high = left.agg(F.min(time), F.max(time)).first()
    return 1 if low is None else max(1, (high - low) // buckets + 1)


def asof_all(times: DataFrame, right: DataFrame, key: str, names: list[str], time: str, tie: str, payload: list[str], width: int | None = None, staleness: int | None = None) -> DataFrame:
    """Per row of ``times`` and name a row (..., key, payload) of the last right row of that name at or before its time, null where there is none.

    All names are read in one sorted pass over time buckets that carries the last row of each, so left rows are not repeated for each name before the
    pass. A bucket inherits the last rows before it from a table of one row a bucket. ``names`` are few, as the signals of a home are.
    """
    if width is None:
        width = bucket_width(times, time)
    of = lambda c: F.col(f"`{c}`")
    found = F.struct(F.col(time).alias("_at"), *[of(c) for c in payload])
    kept = F.struct(*[of(c) for c in times.columns])
    lefts = times.select(F.col(time).alias("_t"), F.lit(1).alias("_s"), F.lit(None).cast(dict(right.dtypes)[tie]).alias("_k"), kept.alias("_left"), F.lit(None).cast(dict(right.dtypes)[key]).alias("_name"), F.lit(None).cast(right.select(found).schema[0].dataType).alias("_right"))
    rights = right.filter(F.col(time).isNotNull() & F.col(key).isin(names)).select(F.col(time).alias("_t"), F.lit(0).alias("_s"), F.col(tie).alias("_k"), F.lit(None).cast(times.select(kept).schema[0].dataType).alias("_left"), F.col(key).alias("_name"), found.alias("_right"))
    both = lefts.unionByName(rights).withColumn("_b", F.floor(F.col("_t") / width))
    own = lambda n: F.when(F.col("_name") == n, F.col("_right"))
    by = W.partitionBy("_b").orderBy("_t", "_s", "_k").rowsBetween(W.unboundedPreceding, 0)
    local = both.select("_b", "_t", "_left", F.array(*[F.last(own(n), ignorenulls=True).over(by) for n in names]).alias("_local")).filter(F.col("_left").isNotNull())
    tails = both.groupBy("_b").agg(*[F.max_by(own(n), F.when(F.col("_name") == n, F.struct("_t", "_k"))).alias(f"_{i}") for i, n in enumerate(names)])
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)  # one row a bucket
    carried = tails.select("_b", F.array(*[F.last(f"_{i}", ignorenulls=True).over(before) for i in range(len(names))]).alias("_carry"))
    each = F.arrays_zip(F.array(*map(F.lit, names)).alias("name"), F.col("_local").alias("local"), F.col("_carry").alias("carry"))
    rows = local.join(carried, "_b").select("_t", "_left", F.explode(each).alias("e")).select("_t", "_left.*", F.col("e.name").alias(key), F.coalesce("e.local", "e.carry").alias("_hit"))
    alive = F.lit(True) if staleness is None else F.col("_t") - F.col("_hit._at") <= staleness
    return rows.select(*[of(c) for c in times.columns], key, *[F.when(alive, F.col(f"_hit.{c}")).alias(c) for c in payload])


def asof(left: DataFrame, right: DataFrame, keys: list[str], time: str, tie: str, payload: list[str], width: int | None = None, inclusive: bool = True, staleness: int | None = None, right_time: str | None = None) -> DataFrame:
    """``left`` with the ``payload`` columns of the right row, null where there is none.

    Both sides have ``keys`` and the integer column ``time``; of right rows of one time the one of largest ``tie`` counts.
    A right row older than ``staleness`` does not count. ``right_time`` names an output column for its time.
    Null keys or times match nothing.
    """
    if width is None:
        width = bucket_width(left, time)
    at = right_time or "_asof_time"
    side_right, side_left = (0, 1) if inclusive else (1, 0)
    of = lambda c: F.col(f"`{c}`")
    kept = F.struct(*[of(c) for c in left.columns])
    found = F.struct(F.col(time).alias(at), *[of(c) for c in payload])
    lefts = left.select(*[of(k) for k in keys], F.col(time).alias("_t"), F.lit(side_left).alias("_s"), F.lit(None).cast(dict(right.dtypes)[tie]).alias("_k"), kept.alias("_left"), F.lit(None).cast(right.select(found).schema[0].dataType).alias("_right"))
    rights = right.filter(F.col(time).isNotNull()).select(*[of(k) for k in keys], F.col(time).alias("_t"), F.lit(side_right).alias("_s"), F.col(tie).alias("_k"), F.lit(None).cast(left.select(kept).schema[0].dataType).alias("_left"), found.alias("_right"))
    both = lefts.unionByName(rights).withColumn("_b", F.floor(F.col("_t") / width))
    local = F.last("_right", ignorenulls=True).over(W.partitionBy(*keys, "_b").orderBy("_t", "_s", "_k").rowsBetween(W.unboundedPreceding, 0))
    tails = both.groupBy(*keys, "_b").agg(F.max_by("_right", F.when(F.col("_right").isNotNull(), F.struct("_t", "_k"))).alias("_tail"))
    before = F.last("_tail", ignorenulls=True).over(W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    carried = tails.select(*keys, "_b", before.alias("_carry"))
    joined = both.withColumn("_local", local).filter(F.col("_left").isNotNull()).join(carried, [*keys, "_b"], "left")
    hit: Column = F.coalesce("_local", "_carry")
    alive = F.lit(True) if staleness is None else F.col("_t") - hit[at] <= staleness
    names = [*([at] if right_time else []), *payload]
    return joined.select("_left.*", *[F.when(alive, hit[c]).alias(c) for c in names])
