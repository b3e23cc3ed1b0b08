"""Forecasts against observations: pairing and measures by lead."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.folders import exists, written
from ..functions.scalars import at_least, cut, is_finite, plus_minutes, ratio


def pair(forecasts: DataFrame, observations: DataFrame) -> DataFrame:
    """issue_time, lead_min, y, x, forecast, observed where both are numbers (neither NULL nor NaN).

    An equi-join on valid time and cell: both sides are dealt out by it, nothing is broadcast by force.
    """
    fc = forecasts.select("issue_time", "lead_min", "y", "x", F.col("rate").alias("forecast"), plus_minutes("issue_time", F.col("lead_min")).alias("valid_time"))
    obs = observations.select("valid_time", "y", "x", F.col("rate").alias("observed"))
    return fc.join(obs, ["valid_time", "y", "x"]).drop("valid_time").na.drop(subset=["forecast", "observed"])


def continuous(pairs: DataFrame, *by: str) -> DataFrame:
    """n, mae, rmse and bias by lead (or other columns)."""
    e = F.col("forecast") - F.col("observed")
    return pairs.groupBy(*(by or ("lead_min",))).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"))


def _contingency(threshold: Column | float) -> list[Column]:
    f, o = at_least("forecast", threshold), at_least("observed", threshold)
    return [F.count_if(f & o).alias("hits"), F.count_if(~f & o).alias("misses"), F.count_if(f & ~o).alias("false_alarms"), F.count_if(~f & ~o).alias("correct_negatives")]


def with_scores(table: DataFrame) -> DataFrame:
    """pod, far, csi and hss of a contingency table, NULL where a denominator is 0."""
    h, m, fa, cn = (F.col(c) for c in ("hits", "misses", "false_alarms", "correct_negatives"))
    hss = (h + m) * (m + cn) + (h + fa) * (fa + cn)
    return table.select("*", ratio(h, h + m).alias("pod"), ratio(fa, h + fa).alias("far"), ratio(h, h + m + fa).alias("csi"), ratio(2 * (h * cn - m * fa), hss).alias("hss"))


def categorical(pairs: DataFrame, threshold: float) -> DataFrame:
    return with_scores(pairs.groupBy("lead_min").agg(*_contingency(threshold)))


def categorical_sweep(pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """categorical() for several thresholds in one pass: the thresholds are exploded after partial work on the pairs."""
    swept = pairs.select("lead_min", "forecast", "observed", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    return with_scores(swept.groupBy("threshold", "lead_min").agg(*_contingency(F.col("threshold"))))


def persistence(pairs: DataFrame) -> DataFrame:
    """RMSE by lead of the observation at lead 0 used as forecast; issues without one are left out.

    The lead-0 value comes from a window over (issue, cell), which spares the self-join.
    """
    w = Window.partitionBy("issue_time", "y", "x")
    held = pairs.withColumn("start", F.max(F.when(F.col("lead_min") == 0, F.col("observed"))).over(w)).where("start IS NOT NULL")
    e = F.col("start") - F.col("observed")
    return held.groupBy("lead_min").agg(F.sqrt(F.avg(e * e)).alias("rmse_persistence"))


def skill(pairs: DataFrame) -> DataFrame:
    """1 - mse / mse of persistence by lead; NULL where persistence is exact."""
    both = continuous(pairs).join(persistence(pairs), "lead_min")
    mine, base = F.col("rmse") * F.col("rmse"), F.col("rmse_persistence") * F.col("rmse_persistence")
    return both.select("lead_min", "n", "rmse", "rmse_persistence", (1 - ratio(mine, base)).alias("skill"))


def strata(pairs: DataFrame, edges: list[float], labels: list[str]) -> DataFrame:
    """Bias and n by lead and observed intensity; pairs outside all intervals are left out."""
    e = F.col("forecast") - F.col("observed")
    return pairs.withColumn("band", cut("observed", edges, labels)).where("band IS NOT NULL").groupBy("lead_min", "band").agg(F.avg(e).alias("bias"), F.count("*").alias("n"))


def strata_pivot(pairs: DataFrame, edges: list[float], labels: list[str]) -> DataFrame:
    """A column of bias for each interval."""
    return strata(pairs, edges, labels).groupBy("lead_min").pivot("band", labels).agg(F.first("bias"))


def sampled(rows: DataFrame, n: int, by: list[str], key: list[str], seed: int = 0) -> DataFrame:
    """n rows of each group (of the whole table without ``by``), without replacement: those whose hashed key is smallest, the same on every run.

    Every task first keeps the n smallest of each group of its rows, so what is shuffled and sorted is at most n rows a group
    and task, however large a group is.
    """
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]).cast("binary"))
    hashed = rows.withColumn("_h", order)
    cut = [c for c in dict.fromkeys([*by, "_h", *key])]

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size, most = 0, 65_536

        def kept() -> pa.Table:
            table = pa.concat_tables(held)
            table = table.take(pc.sort_indices(table.select(cut), sort_keys=[(c, "ascending") for c in cut]))
            at = np.arange(len(table))
            first = np.zeros(len(table), bool)
            first[:1] = True
            for c in by:
                codes = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                first[1:] |= codes[1:] != codes[:-1]
            return table.filter(pa.array(at - np.maximum.accumulate(np.where(first, at, 0)) < n))

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            size += len(batch)
            if size > most:
                held = [kept()]
                size = len(held[0])
                if size > most // 2:  # many groups: what there is goes on, the rest of the work is after the shuffle
                    yield from held[0].to_batches()
                    held, size = [], 0
        if size:
            yield from kept().to_batches()

    few = hashed.mapInArrow(smallest, hashed.schema)
    rn = F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_h", *key))
    return few.withColumn("_rn", rn).where(F.col("_rn") <= n).drop("_rn", "_h")


# ---- measures that add up


def run_states(pairs: DataFrame, thresholds: list[float], run: str = "issue_time") -> DataFrame:
    """run, lead_min, n, sum_error, sum_absolute, sum_square and tables (threshold, hits, misses, false_alarms, correct_negatives): a run's mergeable state."""
    e = F.col("forecast") - F.col("observed")
    tables = []
    for t in sorted(thresholds):
        tables.append(F.struct(F.lit(float(t)).alias("threshold"), *_contingency(float(t))))
    return pairs.groupBy(run, "lead_min").agg(F.count("*").alias("n"), F.sum(e).alias("sum_error"), F.sum(F.abs(e)).alias("sum_absolute"), F.sum(e * e).alias("sum_square"), F.array(*tables).alias("tables"))


def add_runs(spark: SparkSession, pairs: DataFrame, thresholds: list[float], path: str, run: str = "issue_time") -> None:
    """Adds the states of the runs in ``pairs`` to the store; a run that is there already is replaced, other runs are not read.

    Runs are filed by day, and a day's file is written anew with the runs of the day that stay.
    """
    new = written(run_states(pairs, thresholds, run).withColumn("day", F.date_format(run, "yyyy-MM-dd")), "states")
    if exists(spark, path):
        days = new.select("day").distinct()
        old = spark.read.schema(new.schema).parquet(path).join(F.broadcast(days) if days.count() <= 10_000 else days, "day", "left_semi")
        new = written(old.join(new.select(run).distinct(), run, "left_anti").unionByName(new), "states")
    new.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def stored_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path).drop("day")


def merged_continuous(states: DataFrame, *by: str) -> DataFrame:
    """continuous() from states: n, mae, rmse and bias by lead."""
    n = F.sum("n")
    return states.groupBy(*(by or ("lead_min",))).agg(n.alias("n"), (F.sum("sum_absolute") / n).alias("mae"), F.sqrt(F.sum("sum_square") / n).alias("rmse"), (F.sum("sum_error") / n).alias("bias"))


def merged_categorical(states: DataFrame) -> DataFrame:
    """categorical_sweep() from states."""
    each = states.select("lead_min", F.explode("tables").alias("t")).select("lead_min", "t.*")
    return with_scores(each.groupBy("threshold", "lead_min").agg(*[F.sum(c).alias(c) for c in ("hits", "misses", "false_alarms", "correct_negatives")]))


def summary_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(f"distinct_{c}") for c in columns])


def value_range(rows: DataFrame, column: str) -> DataFrame:
    c = F.when(is_finite(column), F.col(column))
    return rows.agg(F.min(c).alias("low"), F.max(c).alias("high"), F.avg(c).alias("mean"))


def side_by_side(operational: DataFrame, model: DataFrame) -> DataFrame:
    """Two measure tables joined on lead, columns suffixed _op and _model."""
    suffix = lambda df, s: df.select("lead_min", *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c != "lead_min"])
    return suffix(operational, "op").join(suffix(model, "model"), "lead_min")


def win_rates(table: DataFrame) -> DataFrame:
    """Share of leads where the model has the lower RMSE and the higher CSI."""
    win = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return table.agg(win(F.col("rmse_model") < F.col("rmse_op")).alias("rmse_wins"), win(F.col("csi_model") > F.col("csi_op")).alias("csi_wins"), F.count("*").alias("leads"))


def weighted_huber(pairs: DataFrame, *by: str, penalty: float = 0.0) -> DataFrame:
    """Mean of huber(delta 1) * (1 + observed), plus penalty * (mean forecast - mean observed) ** 2."""
    d = F.abs(F.col("forecast") - F.col("observed"))
    q = F.least(d, F.lit(1.0))
    loss = F.avg((0.5 * q * q + (d - q)) * (1 + F.col("observed")))
    gap = F.avg("forecast") - F.avg("observed")
    return pairs.groupBy(*by).agg(loss.alias("huber"), (loss + penalty * gap * gap).alias("total"))


def batch_rmse(pairs: DataFrame, batch: Column) -> DataFrame:
    """Mean of the batches' RMSE, and their number."""
    e = F.col("forecast") - F.col("observed")
    each = pairs.groupBy(batch.alias("batch")).agg(F.sqrt(F.avg(e * e)).alias("rmse"))
    return each.agg(F.avg("rmse").alias("mean_rmse"), F.count("*").alias("batches"))


def report(continuous_table: DataFrame, categorical_table: DataFrame) -> str:
    """A Markdown table of measures by lead (as many rows as leads)."""
    rows = continuous_table.join(categorical_table, "lead_min").orderBy("lead_min").collect()
    number = lambda x, form: "-" if x is None else format(x, form)
    head = "| lead | n | MAE | RMSE | bias | POD | FAR | CSI | HSS |\n|---|---|---|---|---|---|---|---|---|"
    lines = [f"| +{r.lead_min} | {r.n:,} | {number(r.mae, '.2f')} | {number(r.rmse, '.2f')} | {number(r.bias, '+.2f')} | " + " | ".join(number(r[c], ".2f") for c in ("pod", "far", "csi", "hss")) + " |" for r in rows]
    return "\n".join([head, *lines])
