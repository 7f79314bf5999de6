"""Random draws that do not depend on how the rows are partitioned."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areapanel.functions.probability import ln_gamma

# Draws made by one seeded generator, and so the size of one row batch.
CHUNK = 10_000


def uniform(keys: Sequence[Column], seed: int) -> Column:
    """A number in [0, 1) fixed by the key and the seed: the first 52 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_value(u: Column, rate: Column) -> Column:
    """Smallest count whose cumulative Poisson probability reaches ``u``.

    Probabilities are summed inside the row, over the counts within 12 sqrt(rate) + 60 of the rate; outside of these
    they vanish in double precision. Each follows from the one before it.
    """
    reach = F.sqrt(rate) * 12.0 + 60.0
    first = F.greatest(F.floor(rate - reach), F.lit(0)).cast("bigint")
    last = F.ceil(rate + reach).cast("bigint")
    least = F.exp(first * F.ln(rate) - rate - ln_gamma(first.cast("double") + 1.0))
    start = F.struct(F.lit(0.0).alias("sum"), least.alias("p"), first.alias("below"))

    def step(acc: Column, k: Column) -> Column:
        total = acc["sum"] + acc["p"]
        return F.struct(total.alias("sum"), (acc["p"] * rate / (k + 1)).alias("p"),
                        (acc["below"] + F.when(total < u, F.lit(1)).otherwise(F.lit(0))).cast("bigint").alias("below"))

    drawn = F.aggregate(F.sequence(first, last), start, step, lambda acc: acc["below"])
    return F.when(rate > 0, drawn).when(rate == 0, F.lit(0).cast("bigint"))


def poisson_draws(
    df: DataFrame, rates: dict[str, str], keys: Sequence[str], years: Sequence[int], seed: int, year: str = "year"
) -> DataFrame:
    """One row per input row and future year, with one draw per rate column; ``rates`` maps rate -> result."""
    kept = [c for c in df.columns if c != year]
    future = df.select(*kept).withColumn(year, F.explode(F.array(*[F.lit(int(y)) for y in years])))
    drawn = {
        name: poisson_value(uniform([*[F.col(k) for k in keys], F.col(year), F.lit(name)], seed), F.col(rate))
        for rate, name in rates.items()
    }
    return future.withColumns(drawn).select(*keys, year, *drawn)


def gamma_draws(
    df: DataFrame, keys: Sequence[str], shape: str, rate: str, n: int, seed: int, name: str = "draw"
) -> DataFrame:
    """``n`` gamma draws per row, one output row each (key, draw_no, draw).

    A row becomes chunks of at most ``CHUNK`` draws; each chunk has its own generator, seeded by seed, key and chunk
    number, so any task may make it at any time and get the same numbers.
    """
    chunks = (n + CHUNK - 1) // CHUNK
    work = df.select(
        *[F.col(f"`{k}`") for k in keys], F.col(shape).cast("double").alias("w_shape"), F.col(rate).cast("double").alias("w_rate"),
        F.xxhash64(*[F.col(f"`{k}`") for k in keys]).alias("w_code"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("w_chunk"),
    ).filter("w_shape > 0 AND w_rate > 0")
    # A chunk is a small row that becomes a large batch, so chunks are spread over all tasks before they grow.
    work = work.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "w_code", "w_chunk")
    out = T.StructType([*[df.schema[k] for k in keys], T.StructField("draw_no", T.LongType()),
                        T.StructField(name, T.DoubleType())])

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for *key, shape_, rate_, code, chunk in batch.itertuples(index=False, name=None):
                first = chunk * CHUNK
                size = min(CHUNK, n - first)
                generator = np.random.default_rng([seed, code % (1 << 63), chunk])
                made = {k: [v] * size for k, v in zip(keys, key)}
                made["draw_no"] = np.arange(first + 1, first + size + 1)
                made[name] = generator.gamma(shape_, 1.0 / rate_, size)
                yield pd.DataFrame(made)

    return work.mapInPandas(draw, out)
