"""Inputs: table reads, CSV with schema inference, integer coding of
categorical columns, z-scores and train/test splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.density import col, zscore
from ..session import kept, scratch_path, scratch_run

DEFAULT_MAX_BROADCAST_BYTES = 64 << 20
#: Bytes of a code table's row beside the value (row header, lengths, code).
CODE_ROW_BYTES = 32


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---- CSV ------------------------------------------------------------------------
def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def read_csv_infer(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header row and inferred column types."""
    return (spark.read.format("csv").option("header", "true")
            .option("inferSchema", "true").load(path))


def csv_round_trip(df: DataFrame) -> DataFrame:
    """Write ``df`` as CSV under the shared checkpoint folder, read it back."""
    path = scratch_path(df.sparkSession, "csv")
    write_csv(df, path)
    return read_csv_infer(df.sparkSession, path)


# ---- domains ----------------------------------------------------------------------
def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col, value): the distinct non-null values of columns of ONE data type,
    ``col`` being the column's place in ``columns``. One scan: equal pairs
    combine map-side, so a column costs its distinct values, not its rows."""
    pairs = F.inline(F.array(*[F.struct(F.lit(j).alias("col"), col(c).alias("value"))
                               for j, c in enumerate(columns)]))
    return df.select(pairs).where(F.col("value").isNotNull()).distinct()


def domain_sizes(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Number of distinct non-null values of each column (0 for an empty one).

    The distinct pairs are counted in two levels, so no column's values meet in
    one task; columns of one type share a scan.
    """
    by_type: dict[str, list[str]] = {}
    for c in dict.fromkeys(columns):
        by_type.setdefault(df.select(col(c)).schema[0].dataType.simpleString(), []).append(c)
    sizes = dict.fromkeys(columns, 0)
    for names in by_type.values():
        for r in distinct_values(df, names).groupBy("col").agg(F.count(F.lit(1)).alias("n")).collect():
            sizes[names[r["col"]]] = r["n"]
    return sizes


# ---- integer codes ----------------------------------------------------------------
def fit_codes(df: DataFrame, columns: list[str], partitions: int | None = None) -> DataFrame:
    """Code table (col, value, code) for columns of ONE data type: code =
    rank of the value among the distinct non-null values of its column, from
    0, in sort order.

    All the columns share one scan: (column index, value) pairs are
    de-duplicated (partial aggregation map-side), range-partitioned on
    (col, value), ranked inside each partition, and shifted by the number of
    values of the same column in the partitions before it (a table with one
    row per partition and column). No column's domain is gathered into one
    task, however large it is.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # kept with its partition numbers before both uses: range bounds come from a
    # sample, so two evaluations need not agree
    dom = kept(distinct_values(df, columns).repartitionByRange(n, "col", "value")
               .withColumn("pid", F.spark_partition_id()))
    local = dom.withColumn("r", F.row_number().over(Window.partitionBy("pid", "col").orderBy("value")))
    sizes = dom.groupBy("pid", "col").agg(F.count(F.lit(1)).alias("c"))
    offsets = sizes.select("pid", "col", F.coalesce(F.sum("c").over(
        Window.partitionBy("col").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("off"))
    return (local.join(offsets, ["pid", "col"])       # partitions x columns rows
            .select("col", "value", (F.col("off") + F.col("r") - 1).cast("int").alias("code")))


def encode_codes(df: DataFrame, columns: dict[str, str] | list[str], keep: bool = False,
                 max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """Replace (or add, for a ``{source: target}`` map) integer codes of
    categorical columns. Columns of the same type are coded together from one
    scan; the code tables are materialised once in the shared checkpoint
    folder and each is broadcast only when its counted size allows; NULL
    stays NULL."""
    if not isinstance(columns, dict):
        columns = {c: c for c in columns}
    by_type: dict[str, list[str]] = {}
    for src in columns:
        by_type.setdefault(df.schema[src].dataType.simpleString(), []).append(src)
    out = df
    for srcs in by_type.values():
        # small, lineage cut, survives executor loss, no executor memory held
        with scratch_run(df.sparkSession) as run:
            codes = run.result(fit_codes(df, srcs))
        size = F.octet_length("value") if isinstance(df.schema[srcs[0]].dataType, (T.StringType, T.BinaryType)) \
            else F.lit(8)
        sizes = {r["col"]: r["bytes"] for r in codes.groupBy("col").agg(
            F.sum(size + CODE_ROW_BYTES).alias("bytes")).collect()}
        for j, src in enumerate(srcs):
            dst = columns[src]
            t = codes.where(F.col("col") == j).select(F.col("value").alias(src),
                                                     F.col("code").alias(f"__code_{dst}"))
            if sizes.get(j, 0) <= max_broadcast_bytes:
                t = F.broadcast(t)
            out = out.join(t, on=[src], how="left")
            if dst == src and not keep:
                out = out.withColumn(src, F.col(f"__code_{dst}")).drop(f"__code_{dst}")
            else:
                out = out.withColumnRenamed(f"__code_{dst}", dst)
    return out


# ---- z-score -----------------------------------------------------------------------
#: From this many columns on, z-score moments come from the mergeable summaries that ``fit``
#: uses for wide networks: one aggregate of two functions a column outgrows the JIT limit.
WIDE_COLUMNS = 32


def standardize(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """z-score every DoubleType column (or ``columns``) in place.

    All means and sample sds come from one pass over the table, kept as one row
    and attached as a scalar subquery, so every later action that reads the
    z-scores reads that row instead of rescanning; names and column order are
    preserved, a zero or NULL sd gives NULL instead of an error, and NaN counts as
    missing in the moments.
    """
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    if not columns:
        return df
    if len(columns) >= WIDE_COLUMNS:
        from ..operators.moments import column_moments
        with scratch_run(df.sparkSession) as run:
            row = run.result(column_moments(df, columns).agg(F.array_sort(F.collect_list(F.struct("j", "mean", "sd"))).alias("z")))
        stats = row.scalar()
        z = {c: (F.get(stats, F.lit(j))["mean"], F.get(stats, F.lit(j))["sd"]) for j, c in enumerate(columns)}
    else:
        row = kept(df.agg(F.struct(*[e for j, c in enumerate(columns) for e in (
            F.avg(F.nanvl(col(c).cast("double"), F.lit(None))).alias(f"m{j}"),
            F.stddev_samp(F.nanvl(col(c).cast("double"), F.lit(None))).alias(f"s{j}"))]).alias("z")))
        stats = row.scalar()
        z = {c: (stats[f"m{j}"], stats[f"s{j}"]) for j, c in enumerate(columns)}
    return df.withColumns({c: zscore(col(c), *ms) for c, ms in z.items()})


# ---- splits -------------------------------------------------------------------------
def split_key(df: DataFrame, key: str, buckets: int = 5) -> tuple[DataFrame, DataFrame]:
    """Deterministic 80/20 split on an integer key: test = key % buckets == 0."""
    k = col(key) % F.lit(buckets)
    return df.filter(k != 0), df.filter(k == 0)


def random_side(keys: list[str], weights=(0.8, 0.2), seed: int = 1) -> Column:
    """Side 0, 1, ... of a row: a random number in [0, 1) that depends only on
    the seed and the row's key columns (the first 32 bits of an md5), so the
    assignment is the same however the table is partitioned or read again.
    A NULL key counts as the empty text."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(col(k).cast("string"), F.lit("")) for k in keys])
    u = F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    total, bound, side = float(sum(weights)), 0.0, F.lit(len(weights) - 1)
    bounds = []
    for w in weights[:-1]:
        bound += w / total
        bounds.append(bound)
    for i in reversed(range(len(bounds))):
        side = F.when(u < bounds[i], F.lit(i)).otherwise(side)
    return side


def split_random(df: DataFrame, keys: list[str], weights=(0.8, 0.2), seed: int = 1) -> list[DataFrame]:
    """Random split by ``random_side``; the parts together are ``df``."""
    side = random_side(keys, weights, seed)
    return [df.filter(side == i) for i in range(len(weights))]
