"""Relational building blocks shared by the operators (J*, A*, W*, O*).

These are thin, declarative compositions; Catalyst/AQE pick the physical
strategy. The only hand-placed decision is broadcasting, and that is always
behind an explicit size check.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import cut_lineage


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` only if it provably has at most ``max_rows`` rows.

    The check is a bounded action (``limit(max_rows + 1).count()``); beyond
    the bound the DataFrame is returned as is and the join shuffles (AQE may
    still switch to a broadcast once it has measured the shuffle output).
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def bounded_rows(df: DataFrame, max_rows: int, what: str) -> list:
    """Collect a DataFrame that must be small; raise if it is not."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what}: more than {max_rows} rows; refusing to collect")
    return rows


def rank_within(partition: Sequence[str], order: Sequence[Column]) -> Column:
    """1-based ranking position inside each partition."""
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))


def top_k_per_group(df: DataFrame, partition: Sequence[str], order: Sequence[Column],
                    k: int, rank_col: str = "rank") -> DataFrame:
    """O1: the first k rows per group under a total order.

    ``row_number() <= k`` is planned as WindowGroupLimit, so each map task
    keeps at most k rows per group before the shuffle: a hot group cannot
    flood one reducer.
    """
    return (df.withColumn(rank_col, rank_within(partition, order))
              .filter(F.col(rank_col) <= k)
              .withColumn(rank_col, F.col(rank_col).cast("bigint")))


def score_order(score: str = "score", tie: str = "doc_id", digits: int = 9) -> list[Column]:
    """Total order used at every cut: rounded score desc, then id asc."""
    return [F.desc(F.round(F.col(score), digits)), F.asc(F.col(tie))]


def left_lookup(df: DataFrame, table: DataFrame, on: Sequence[str] | str, col: str,
                default="") -> DataFrame:
    """Left equi-join with a default for missing keys."""
    keys = [on] if isinstance(on, str) else list(on)
    t = table.select(*keys, F.col(col).alias("__v"))
    return df.join(t, keys, "left").withColumn(col, F.coalesce(F.col("__v"), F.lit(default))).drop("__v")


def priority_union(frames: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Union where an earlier frame wins for the same key.

    Implemented as union + ``min_by`` over a priority column, i.e. one
    aggregation (partial aggregation before the shuffle), no window sort.
    """
    tagged = [f.withColumn("__prio", F.lit(i)) for i, f in enumerate(frames)]
    u = tagged[0]
    for f in tagged[1:]:
        u = u.unionByName(f)
    others = [c for c in u.columns if c not in key and c != "__prio"]
    agg = [F.min_by(F.col(c), F.col("__prio")).alias(c) for c in others]
    return u.groupBy(*key).agg(*agg)


def minmax_scale(df: DataFrame, col: str, out: str, by: Sequence[str] | None = None,
                 eps: float = 1e-8) -> DataFrame:
    """A5: (x - min) / (max - min + eps), globally or per group.

    The global form collects one 2-number aggregate (bounded) and applies it
    as literals, so no single-partition window or cross join is needed.
    """
    if by:
        stats = df.groupBy(*by).agg(F.min(col).alias("__mn"), F.max(col).alias("__mx"))
        return (df.join(stats, list(by), "left")
                  .withColumn(out, (F.col(col) - F.col("__mn")) / (F.col("__mx") - F.col("__mn") + eps))
                  .drop("__mn", "__mx"))
    row = df.agg(F.min(col).alias("mn"), F.max(col).alias("mx")).first()
    mn = row["mn"] if row["mn"] is not None else 0.0
    mx = row["mx"] if row["mx"] is not None else 0.0
    return df.withColumn(out, (F.col(col) - F.lit(float(mn))) / F.lit(float(mx) - float(mn) + eps))


def take_first(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """First n rows under an explicit order (TakeOrderedAndProject)."""
    return df.orderBy(*order_by).limit(n)


def seeded_order_key(id_col: str, seed: int) -> Column:
    """Deterministic pseudo-random order key, one that any engine can make."""
    return F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))


def assign_batches(df: DataFrame, id_col: str, batch_size: int, seed: int = 42,
                   partition: Sequence[str] | None = None) -> DataFrame:
    """Seeded shuffle and batching.

    Batch ids come from a global row number under the hash order. The global
    rank is computed without a single-partition window: rows are range
    partitioned on the hash key, per-partition counts give offsets.
    """
    key = seeded_order_key(id_col, seed)
    ranked = global_row_number(df.withColumn("__key", key), ["__key", id_col], "__rn")
    return ranked.withColumn("batch_id", F.floor((F.col("__rn") - 1) / batch_size).cast("bigint")).drop("__key", "__rn")


def global_row_number(df: DataFrame, order_cols: Sequence[str], out: str,
                      descending: bool = False) -> DataFrame:
    """Global 1-based row number under a total order, without pulling all
    rows into one task.

    Rows are range-partitioned and sorted on the order key; each partition
    counts its rows (one tiny aggregate, one number per partition), and the
    prefix sums of those counts become per-partition offsets. The sorted rows
    are written to the checkpoint folder first: a range exchange samples its
    bounds each time it runs, so counts and rows must come from one run.
    """
    order = [F.desc(c) if descending else F.asc(c) for c in order_cols]
    spark = df.sparkSession
    nparts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parted = (df.repartitionByRange(nparts, *order)
                .sortWithinPartitions(*order)
                .withColumn("__pid", F.spark_partition_id()))
    # local row number via a per-partition monotonically increasing id
    parted = cut_lineage(parted.withColumn("__mid", F.monotonically_increasing_id()))
    counts = parted.groupBy("__pid").agg(F.count("*").alias("__n"), F.min("__mid").alias("__m0"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: the window over it is tiny by construction
    offs = counts.withColumn("__off", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    offs = F.broadcast(  # one row per range partition
        offs.select("__pid", "__off", "__m0"))
    return (parted.join(offs, "__pid")
                  .withColumn(out, (F.col("__off") + F.col("__mid") - F.col("__m0") + 1).cast("bigint"))
                  .drop("__pid", "__off", "__mid", "__m0"))


def exact_quantiles(df: DataFrame, value: str, by: Sequence[str], qs: Sequence[float],
                    names: Sequence[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (numpy / ``quantile_cont``
    semantics) without an aggregation buffer holding every value.

    Rows get one global number in the order of (group, value), by range
    partitions, so a group of any size is spread over as many tasks as its rows
    need; a row's rank is its number less the first of its group. Only the
    rows at positions ``floor(p (n-1))`` and ``ceil(p (n-1))`` are kept and
    interpolated. NULL values are ignored.
    """
    names = list(names or [f"p{int(round(q * 100))}" for q in qs])
    by = list(by)
    d = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))
    numbered = global_row_number(d, [*by, "__v"], "__r1")
    if by:
        n = numbered.groupBy(*by).agg(F.count("*").alias("__n"), F.min("__r1").alias("__first"))
        same = None
        for c in by:  # groups may be NULL
            eq = F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}"))
            same = eq if same is None else same & eq
        ranked = numbered.alias("r").join(n.alias("g"), same).select("r.*", "__n", (F.col("__r1") - F.col("__first")).alias("__r"))
    else:
        total = numbered.count()
        ranked = numbered.withColumn("__r", F.col("__r1") - 1).withColumn("__n", F.lit(total))
    aggs = []
    for q, name in zip(qs, names):
        pos = F.lit(float(q)) * (F.col("__n") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        frac = pos - lo
        v_lo = F.max(F.when(F.col("__r") == lo, F.col("__v")))
        v_hi = F.max(F.when(F.col("__r") == hi, F.col("__v")))
        aggs.append((v_lo + (v_hi - v_lo) * F.first(frac)).alias(name))
    keep = None
    for q in qs:
        pos = F.lit(float(q)) * (F.col("__n") - 1)
        c = (F.col("__r") == F.floor(pos)) | (F.col("__r") == F.ceil(pos))
        keep = c if keep is None else keep | c
    return ranked.filter(keep).groupBy(*by).agg(*aggs)


def maxsim(run: DataFrame, chunk_col: str = "doc_id", score_col: str = "score") -> DataFrame:
    """A2 (+T3): document score = maximum of its chunks' scores, per query.
    The document id is the chunk id without its last ``_`` part."""
    from quarry.functions.text import doc_id_from_chunk
    return (run.groupBy("query_id", doc_id_from_chunk(chunk_col).alias("doc_id"))
               .agg(F.max(score_col).alias("score")))
