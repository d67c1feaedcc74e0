"""Measurements over data and logs: rates, latencies, log summaries, column profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import running_totals, with_chunks, with_row_index
from .windows import floor_div

# The percentiles a latency report gives.
PERCENTILES = (5, 25, 50, 75, 99)

# What a throughput line of a worker's log looks like.
RATE_PATTERN = r".*That's ([0-9.]+) elements/second/core.*"
WORKER_PATTERN = r".*Worker: ([0-9.]+).*"
QUERY_PATTERN = r".*Query ([0-9.]+).*"


def throughput(df: DataFrame, every: int, worker: str, order_by: Sequence[str], ts: str = "ts") -> DataFrame:
    """The rate of each run of ``every`` rows of a worker.

    The first run only starts the clock, so rates begin with the second. A run that takes no time
    has no rate.
    """
    indexed = with_row_index(df.select(worker, *dict.fromkeys([*order_by, ts])), order_by, within=[worker])
    marks = indexed.filter(F.pmod(F.col("row_index") + 1, F.lit(every)) == 0)
    number = floor_div(F.col("row_index") + 1, every)
    at = F.unix_micros(ts)
    # every mark ends its own run and starts the next
    ends = marks.select(
        worker,
        F.inline(
            F.array(
                F.struct(number.alias("report"), F.lit(None).cast("long").alias("_from"), at.alias("_to")),
                F.struct((number + 1).alias("report"), at.alias("_from"), F.lit(None).cast("long").alias("_to")),
            )
        ),
    )
    runs = ends.groupBy(worker, "report").agg(F.max("_from").alias("_from"), F.max("_to").alias("_to"))
    millis = floor_div(F.col("_to"), 1000) - floor_div(F.col("_from"), 1000)
    return runs.filter("_from IS NOT NULL AND _to IS NOT NULL").select(
        worker,
        "report",
        millis.alias("millis"),
        F.when(millis > 0, F.lit(float(every)) * 1000 / millis).alias("elements_per_second"),
    )


def latency(df: DataFrame, value: str | Column, percentiles: Sequence[int] = PERCENTILES) -> DataFrame:
    """One row with count, average, minimum, maximum and exact percentiles of a measurement.

    Percentile p lies at rank ``p * (n + 1) / 100`` between two neighbours. Equal measurements are
    folded first; ranks come from running totals over the distinct values. The mean adds the measurements in
    their own type.
    """
    measured = df.select((F.col(value) if isinstance(value, str) else value).alias("_v")).filter("_v IS NOT NULL")
    folded = measured.groupBy("_v").agg(F.count(F.lit(1)).alias("_rows"))
    ranked = running_totals(folded, ["_v"], {"_rank": F.col("_rows")})
    ranked = ranked.withColumn("_n", folded.agg(F.sum("_rows")).scalar())
    n = F.col("_n")

    def at_rank(rank: Column) -> Column:
        return F.min(F.when(F.col("_rank") >= rank, F.col("_v")))

    bounds, results = [], []
    for p in percentiles:
        position = F.lit(p) * (n + 1) / 100.0
        low = F.least(F.greatest(F.floor(position), F.lit(1)), n)
        high = F.least(low + 1, n)
        part = F.when((position < 1) | (position >= n), 0.0).otherwise(position - F.floor(position))
        bounds += [at_rank(low).alias(f"_lo{p}"), at_rank(high).alias(f"_hi{p}"), F.first(part).alias(f"_at{p}")]
        results.append((F.col(f"_lo{p}") + F.col(f"_at{p}") * (F.col(f"_hi{p}") - F.col(f"_lo{p}"))).alias(f"p{p}"))
    # in the type of the input: decimals and whole numbers add up exactly in any order
    total = F.sum(F.col("_v") * F.col("_rows")).cast("double")
    summary = ranked.agg(
        F.sum("_rows").alias("n"), total.alias("_total"), F.min("_v").alias("low"), F.max("_v").alias("high"), *bounds
    )
    return summary.select("n", (F.col("_total") / F.col("n")).alias("mean"), "low", "high", *results)


def log_rates(lines: DataFrame, by_query: bool = False) -> DataFrame:
    """Mean rate per worker (and query) of throughput log lines, and the sum of the means.

    ``lines`` has a ``value`` column, one log line each; other lines are ignored, and so are rates that are no
    number, which ``malformed_rates`` lists. Rates are added as decimals with twelve places.
    """
    keys = {"worker": WORKER_PATTERN} | ({"query": QUERY_PATTERN} if by_query else {})
    parsed = lines.filter(F.col("value").rlike(RATE_PATTERN)).select(
        *(F.regexp_extract("value", pattern, 1).alias(name) for name, pattern in keys.items()),
        F.regexp_extract("value", RATE_PATTERN, 1).try_cast("decimal(38,12)").alias("_rate"),
    ).filter("_rate IS NOT NULL")
    for name in keys:
        parsed = parsed.filter(F.col(name) != "")
    # the mean comes first: the total below then needs the same partial sums and shares the shuffle
    means = parsed.groupBy(*keys).agg(
        (F.sum("_rate").cast("double") / F.count(F.lit(1))).alias("mean_rate"), F.count(F.lit(1)).alias("entries")
    )
    total = means.agg(F.sum(F.col("mean_rate").cast("decimal(38,9)")).cast("double")).scalar()
    return means.select(*keys, "mean_rate", "entries", total.alias("sum_of_means"))


def malformed_rates(lines: DataFrame) -> DataFrame:
    """The throughput log lines whose rate is no number."""
    rate = F.regexp_extract("value", RATE_PATTERN, 1).try_cast("decimal(38,12)")
    return lines.filter(F.col("value").rlike(RATE_PATTERN) & rate.isNull())


def profile_columns(
    df: DataFrame, columns: Sequence[str], order_by: Sequence[str], chunk_rows: int = 100_000
) -> DataFrame:
    """Per column: minimum, maximum, bits for the largest value and for the range, mean run length.

    Runs are stretches of equal neighbours along ``order_by``. ``use_rle`` says that the mean run,
    rounded up and less one, reaches five. Bits are given for whole numbers only.
    """
    needed = list(dict.fromkeys([*order_by, *columns]))
    chunks = with_chunks(with_row_index(df.select(*needed), order_by), "row_index", chunk_rows, 1)
    local = Window.partitionBy("_chunk").orderBy("row_index")
    starts = {c: ~F.lag(c).over(local).eqNullSafe(F.col(c)) | (F.col("row_index") == 0) for c in columns}
    flagged = chunks.select("*", *(s.alias(f"_s_{c}") for c, s in starts.items())).filter(~F.col("_halo"))
    summary = flagged.agg(
        F.count(F.lit(1)).alias("_n"),
        *(F.min(c).cast("double").alias(f"_lo_{c}") for c in columns),
        *(F.max(c).cast("double").alias(f"_hi_{c}") for c in columns),
        *(F.count(F.when(F.col(f"_s_{c}"), 1)).alias(f"_runs_{c}") for c in columns),
    )
    rows = F.array(
        *(
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(f"_lo_{c}").alias("low"),
                F.col(f"_hi_{c}").alias("high"),
                (F.col("_n") / F.col(f"_runs_{c}")).alias("mean_run"),
            )
            for c in columns
        )
    )
    out = summary.select(F.inline(rows))

    def bits(value: Column) -> Column:
        whole = (value >= 0) & (F.floor(value) == value)
        return F.when(whole, F.length(F.bin(value.cast("long")))).cast("int")

    return out.select(
        "column_name",
        "low",
        "high",
        bits(F.col("high")).alias("value_bits"),
        bits(F.col("high") - F.col("low")).alias("range_bits"),
        "mean_run",
        (F.ceil("mean_run") - 1 >= 5).alias("use_rle"),
    )
