"""Building blocks that keep every other operator safe at any group size.

``materialize``  cuts lineage with a table in the shared folder.
``lookup_join``  broadcasts a side after measuring it; beyond the bound it joins by shuffle, hot keys salted.
``number_rows``  numbers rows in order without putting a group into one task.
``running_sum``  the same for cumulative sums.
``fill_forward``  the same for the last value seen.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A lookup side of at most this many rows and bytes is broadcast.
BROADCAST_ROWS = 100_000
# An ordered group of at most this many rows may be sorted by one task.
ONE_TASK_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024
# Least number of tasks a hot key is spread over.
SALTS = 16
# A key with more rows than this is hot; found in a sample of this share of the rows.
HOT_ROWS = 1_000_000
HOT_SAMPLE = 0.01

# Used where spark.checkpoint.dir is not set.
SCRATCH_KEY = "areapanel.scratch.dir"

Keys = Sequence[str]

# Tables this process has written, for ``release``.
_written: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only when Spark runs on this machine alone.

    Spark's own setting is only read. The temporary folder is remembered per session under a key of this library.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(SCRATCH_KEY, None)
    if folder:
        return folder
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):  # local-cluster has executors of its own
        raise RuntimeError(f"set spark.checkpoint.dir (or {SCRATCH_KEY}) to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="areapanel-")
    spark.conf.set(SCRATCH_KEY, folder)
    return folder


def scratch_path(spark: SparkSession, name: str = "table") -> str:
    """A new place in the shared folder, which ``release`` deletes."""
    path = f"{scratch_dir(spark).rstrip('/')}/areapanel-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def _row_bytes(df: DataFrame) -> Column:
    """Rough size of a row: the length of its texts and of the text form of nested values, 8 for everything else."""
    size = F.lit(0)
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(field.dataType, T.BinaryType):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        elif not isinstance(field.dataType, T.AtomicType):  # such as vectors, whose text is longer than their numbers
            size = size + F.coalesce(F.octet_length(c.cast("string")), F.lit(0))
        else:
            size = size + F.lit(8)
    return size


def materialize_observed(df: DataFrame, **figures: Column) -> tuple[DataFrame, dict]:
    """Write ``df`` once to the shared folder and read it back, with aggregates of its rows worked out on the way.

    Later plans start from the files, so they neither recompute the input nor depend on the executors that
    made it.
    """
    spark, path, seen = df.sparkSession, scratch_path(df.sparkSession), Observation()
    df.observe(seen, *[c.alias(n) for n, c in figures.items()]).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), dict(seen.get)


def materialize_measured(df: DataFrame) -> tuple[DataFrame, int, int]:
    """``materialize_observed`` with the number of rows and their size in bytes."""
    stored, seen = materialize_observed(df, n=F.count(F.lit(1)), bytes=F.sum(_row_bytes(df)))
    return stored, seen["n"], seen["bytes"] or 0


def release(spark: SparkSession) -> int:
    """Delete the tables this session has written to the shared folder; frames built on them can no longer be run."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        done += bool(path.getFileSystem(conf).delete(path, True))
    return done


def materialize_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``materialize_measured`` without the bytes."""
    return materialize_measured(df)[:2]


def materialize(df: DataFrame) -> DataFrame:
    """``materialize_measured`` without the measures."""
    return materialize_measured(df)[0]


def hot_keys(df: DataFrame, on: Keys, fraction: float = HOT_SAMPLE, rows: int = HOT_ROWS) -> DataFrame:
    """Keys that hold more than about ``rows`` rows of ``df``, from a sample of the key columns.

    The sample only decides which keys a join spreads over many tasks; no row and no result depends on it.
    """
    seen = df.select(*on).dropna("any").sample(fraction, seed=0).groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    return seen.filter(F.col("_n") > rows * fraction).select(*on)


def salted_join(
    left: DataFrame, right: DataFrame, on: Keys, how: str = "left", hot: DataFrame | None = None,
    salts: int | None = None,
) -> DataFrame:
    """Equi-join that keeps ``left``'s rows and spreads the ``hot`` keys (all keys if None) over ``salts`` tasks.

    A left row of a hot key draws a salt from its key and place, so that copies of one row spread as well;
    a right row of a hot key is copied once per salt. Every pair of matching rows meets exactly once. Left rows with a
    missing key match nothing and are spread too. ``hot`` must be short: it is broadcast.
    """
    on = list(on)
    salts = salts or max(SALTS, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = F.xxhash64(*[F.col(f"`{c}`") for c in on], F.spark_partition_id(), F.monotonically_increasing_id())
    drawn = F.pmod(own, F.lit(salts)).cast("int")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    if hot is None:
        salted_left = left.withColumn("_salt", drawn)
        salted_right = right.withColumn("_salt", F.explode(every))
    else:
        marked = F.broadcast(hot.select(*on).distinct().withColumn("_hot", F.lit(True)))
        missing = F.lit(False)
        for c in on:
            missing = missing | F.col(f"`{c}`").isNull()
        salted_left = left.withColumn("_drawn", drawn).join(marked, on, "left").withColumn(
            "_salt", F.when(F.col("_hot") | missing, F.col("_drawn")).otherwise(0)).drop("_hot", "_drawn")
        salted_right = right.join(marked, on, "left").withColumn(
            "_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0))))).drop("_hot")
    return salted_left.join(salted_right, [*on, "_salt"], how).drop("_salt")


def lookup_join(
    left: DataFrame, right: DataFrame, on: Keys, how: str = "left", limit: int | None = None, derived: bool = True
) -> DataFrame:
    """Join a large left side to a side that is usually small.

    The right side is measured first. Up to ``limit`` rows and ``BROADCAST_BYTES`` it is broadcast, so that the left
    side is not shuffled; beyond that it is a shuffled join in which the left side's hot keys are salted. A ``derived``
    right side is measured while it is written out, so that it is computed once; one that is cheap to read again is
    only measured.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"lookup_join keeps the left side's rows, so it cannot do a {how} join")
    limit = BROADCAST_ROWS if limit is None else limit
    if derived:
        right, rows, size = materialize_measured(right)
    else:
        rows, size = right.limit(limit + 1).agg(F.count(F.lit(1)), F.sum(_row_bytes(right))).first()
    if rows <= limit and (size or 0) <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), list(on), how)
    return salted_join(left, right, on, how, materialize(hot_keys(left, on)))


def group_lookup(left: DataFrame, right: DataFrame, by: Keys, how: str = "inner", **kw) -> DataFrame:
    """``lookup_join`` on group keys that may be NULL: rows without a key are a group like others."""
    own = [c for c in right.columns if c not in set(by)]
    key = F.struct(*[F.col(f"`{c}`") for c in by]).alias("_group")  # NULLs inside a struct are equal
    joined = lookup_join(left.select("*", key), right.select(key, *own), ["_group"], how, **kw)
    return joined.select(*[F.col(f"`{c}`") for c in [*left.columns, *own]])


def _slices(df: DataFrame, part: Keys, order: Sequence[Column]) -> DataFrame:
    """Range-partition by (part, order) and remember slice and place; slices follow each other in order."""
    keys = [F.col(c).asc() for c in part] + list(order)
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # The id holds the partition number in its upper bits and the place inside the partition in the lower 33.
    ranged = ranged.withColumn("_id", F.monotonically_increasing_id())
    return materialize(
        ranged.withColumn("_slice", F.shiftright("_id", 33)).withColumn("_place", F.col("_id").bitwiseAND((1 << 33) - 1))
    ).drop("_id")


def _window(part: Keys) -> Window:
    return Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))


def number_rows(
    df: DataFrame, part: Keys, order: Sequence[Column], name: str = "row", one_task_rows: int | None = None
) -> DataFrame:
    """Row number within ``part`` by ``order``; end ``order`` with a unique key to make it definite.

    Few rows (counted) use a plain window. Otherwise rows are range-partitioned and a row's number is its place in
    its slice plus the rows of its group in earlier slices; no task holds a whole group.
    """
    limit = ONE_TASK_ROWS if one_task_rows is None else one_task_rows
    df, rows = materialize_counted(df)
    if rows <= limit:
        return df.withColumn(name, F.row_number().over(_window(part).orderBy(*order)).cast("long"))
    placed = _slices(df, part, order)
    group = [*part, "_slice"]
    # One row per group and slice: at most the number of groups plus the number of slices.
    tally = placed.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    before = _window(part).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    tally = tally.select(*group, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = _null_safe_lookup(placed, tally, part)
    return joined.withColumn(name, F.col("_before") + F.col("_place") - F.col("_first") + 1).drop(
        "_slice", "_place", "_first", "_before"
    )


def _null_safe_lookup(placed: DataFrame, tally: DataFrame, part: Keys) -> DataFrame:
    """Bring per-(group, slice) figures back to the rows; group keys may be null."""
    code = F.xxhash64(F.lit(0), *[F.col(c) for c in part], *[F.col(c).isNull() for c in part])
    tally, rows = materialize_counted(tally.withColumn("_code", code))
    same = tally.select("_code", "_slice", *[F.col(c).alias(f"_k_{c}") for c in part],
                        *[c for c in tally.columns if c not in {*part, "_code", "_slice"}])
    left = placed.withColumn("_code", code)
    match = (left["_code"] == same["_code"]) & (left["_slice"] == same["_slice"])
    for c in part:
        match = match & left[c].eqNullSafe(same[f"_k_{c}"])
    side = F.broadcast(same) if rows <= BROADCAST_ROWS else same
    joined = left.join(side, match, "inner")
    return joined.drop(same["_slice"]).drop("_code", *[f"_k_{c}" for c in part])


def running_sum(
    df: DataFrame, part: Keys, order: Sequence[Column], value: str, name: str = "running",
    one_task_rows: int | None = None,
) -> DataFrame:
    """Sum of ``value`` over the rows of ``part`` up to and including the row, by ``order``."""
    limit = ONE_TASK_ROWS if one_task_rows is None else one_task_rows
    upto = (Window.unboundedPreceding, Window.currentRow)
    df, rows = materialize_counted(df)
    if rows <= limit:
        return df.withColumn(name, F.sum(value).over(_window(part).orderBy(*order).rowsBetween(*upto)))
    placed = _slices(df, part, order)
    group = [*part, "_slice"]
    tally = placed.groupBy(*group).agg(F.sum(value).alias("_n"))
    before = _window(part).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    tally = tally.select(*group, F.sum("_n").over(before).alias("_before"))  # NULL while no row had a value
    local = placed.withColumn(
        name, F.sum(value).over(Window.partitionBy(*group).orderBy("_place").rowsBetween(*upto))
    )
    joined = _null_safe_lookup(local, tally, part)
    both = F.coalesce(F.col("_before") + F.col(name), F.col("_before"), F.col(name))
    return joined.withColumn(name, both).drop("_slice", "_place", "_before")


def fill_forward(
    df: DataFrame, part: Keys, order: Sequence[Column], value: str, name: str, one_task_rows: int | None = None
) -> DataFrame:
    """The last value that is not NULL at or before each row of ``part``, by ``order``.

    Beyond the counted bound rows lie in range slices; what a slice inherits is the last value of the slices before it,
    found among one row per slice.
    """
    limit = ONE_TASK_ROWS if one_task_rows is None else one_task_rows
    upto = (Window.unboundedPreceding, Window.currentRow)
    df, rows = materialize_counted(df)
    if rows <= limit:
        return df.withColumn(name, F.last(value, ignorenulls=True).over(_window(part).orderBy(*order).rowsBetween(*upto)))
    placed = _slices(df, part, order)
    group = [*part, "_slice"]
    at = F.when(F.col(value).isNotNull(), F.col("_place"))
    ends = placed.groupBy(*group).agg(F.max_by(value, at).alias("_last"))
    before = _window(part).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*group, F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    local = placed.withColumn("_own", F.last(value, ignorenulls=True).over(Window.partitionBy(*group).orderBy("_place").rowsBetween(*upto)))
    joined = _null_safe_lookup(local, ends, part)
    return joined.withColumn(name, F.coalesce("_own", "_carried")).drop("_slice", "_place", "_own", "_carried")
