"""Run summaries and parsed logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossweave.functions.text import density_percent, mean_pm_sd, strategy


def summary(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, n, mean, sd, least, most)."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("sd"), F.round(F.min(v), 6).alias("least"), F.round(F.max(v), 6).alias("most"))


def layers(df: DataFrame, *keys: str) -> DataFrame:
    """Of layer accuracies (layer, accuracy): the best, the last layer's, the embedding layer's and the mean of layers 2 to 4."""
    mid = F.avg(F.when(F.col("layer").between(2, 4), F.col("accuracy")))
    return df.groupBy(*keys).agg(F.max("accuracy").alias("best"), F.max_by("accuracy", "layer").alias("final"), F.max(F.when(F.col("layer") == 0, F.col("accuracy"))).alias("embedding"), F.round(mid, 6).alias("middle"), F.max(F.when(F.col("layer") == 3, F.col("accuracy"))).alias("layer3"))


def complete_means(counts: DataFrame, key: str, *run: str) -> DataFrame:
    """(condition, key, mean): means over all runs of a condition, with 0 where a run lacks the key. counts: condition, run, key, n."""
    runs = counts.select("condition", *run).distinct()
    grid = runs.join(counts.select("condition", key).distinct(), "condition")
    full = grid.join(counts, ["condition", *run, key], "left")
    return full.groupBy("condition", key).agg(F.round(F.avg(F.coalesce("n", F.lit(0))), 6).alias("mean"))


def mode_delta(df: DataFrame, key: str, mode: str, first: str, second: str, value: str) -> DataFrame:
    """(key, first, second, delta): second less first by key, the largest gain first."""
    side = lambda m: F.max(F.when(F.col(mode) == m, F.col(value)))
    out = df.groupBy(key).agg(side(first).alias(first), side(second).alias(second))
    return out.where(F.col(first).isNotNull() & F.col(second).isNotNull()).withColumn("delta", F.round(F.col(second) - F.col(first), 6)).orderBy(F.desc("delta"), key)


def replicate_baseline(df: DataFrame, strategies: list[str], at: Column) -> DataFrame:
    """The one row where `at` holds stands for every strategy that lacks it."""
    spark = df.sparkSession
    base, rest = df.where(at), df.where(~at)
    all_of = F.broadcast(spark.createDataFrame([(s,) for s in strategies], "strategy string"))
    return rest.unionByName(base.drop("strategy").crossJoin(all_of).select(*df.columns))


def best_by_least(df: DataFrame, what: str, value: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(what, F.struct(value, what)).alias(what), F.min(value).alias(value))


def perplexity(loss: Column) -> Column:
    return F.exp(loss)


def final_eval_loss(states: DataFrame) -> DataFrame:
    """(run, loss): the least evaluation loss in the history of the state with the most steps.

    states: run, global_step, log_history (array of struct with a nullable eval_loss)."""
    last = states.groupBy("run").agg(F.max_by("log_history", "global_step").alias("h"))
    return last.select("run", F.array_min(F.filter(F.transform("h", lambda e: e.eval_loss), lambda v: v.isNotNull())).alias("loss"))


def split_history(history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a training loss, rows with an evaluation loss."""
    return history.where("loss is not null"), history.where("eval_loss is not null")


def word_log(text: Column) -> Column:
    """Pair and sentence counts and the four precisions of an evaluation log; a log without four fails."""
    # the patterns are fixed by the format of the logs
    found = F.regexp_extract_all(text, F.lit(r"top-\d+ precision\s*:\s*([0-9.]+)"), F.lit(1))
    values = F.when(F.size(found) == 4, found).otherwise(F.raise_error(F.concat(F.lit("expected 4 precisions, found "), F.size(found).cast("string"))))
    number = lambda p: F.regexp_extract(text, p, 1).try_cast("int")
    at = lambda k: F.element_at(values, k).cast("double")
    return F.struct(number(r"(\d+) (?:word )?pairs").alias("pairs"), number(r"(\d+) sentences").alias("sentences"), at(1).alias("word_top1"), at(2).alias("word_top5"), at(3).alias("sent_top1"), at(4).alias("sent_top5"))


def section(text: Column, title: str, end: str = r"Test \d|$(?!.)") -> Column:
    """The text of a log after a title, up to the next header."""
    return F.regexp_extract(text, rf"(?is){title}(.*?)(?:{end})", 1)


def section_precision(text: Column, title: str, k: int) -> Column:
    return F.regexp_extract(section(text, title), rf"(?i)top-{k} precision\s*:\s*([0-9.]+)", 1).try_cast("double")


def condition_order(df: DataFrame, order: list[str]) -> DataFrame:
    return df.orderBy(F.array_position(F.array(*map(F.lit, order)), F.col("condition")))


def run_summary(runs: DataFrame, metrics: list[str], order: list[str]) -> DataFrame:
    """One row a condition of `order` (others last, by name): density, strategy, number and list of its seeds, mean and sample SD of the metrics."""
    values = [a for m in metrics for a in (F.round(F.avg(m), 6).alias(f"{m}_mean"), F.round(F.stddev_samp(m), 6).alias(f"{m}_sd"))]
    seeds = F.array_sort(F.collect_set("seed"))
    out = runs.groupBy("condition").agg(F.size(seeds).alias("n_seeds"), F.array_join(F.transform(seeds, lambda s: s.cast("string")), ",").alias("seeds"), *values)
    place = F.array_position(F.array(*map(F.lit, order)), F.col("condition"))
    own = out.select("condition", density_percent(F.col("condition")).alias("density"), strategy(F.col("condition")).alias("strategy"), *out.columns[1:])
    return own.orderBy(F.when(place == 0, len(order) + 1).otherwise(place), "condition")


def mean_table(df: DataFrame, label: str, metrics: list[str], digits: int = 4) -> str:
    """A Markdown table of `mean +/- sd` cells from columns metric_mean and metric_sd; N/A where they are null."""
    cells = df.select(F.col(label).cast("string").alias(label), *(mean_pm_sd(F.col(f"{m}_mean"), F.col(f"{m}_sd"), digits).alias(m) for m in metrics))
    return markdown(cells, [label, *metrics])


def markdown(df: DataFrame, columns: list[str]) -> str:
    """A table of a summary, all its rows."""
    rows = df.select(*(F.col(c).cast("string") for c in columns)).toLocalIterator()
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join("N/A" if v is None else v for v in r) + " |" for r in rows]) + "\n"


def placed(df: DataFrame, *order: Column | str) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.orderBy(*order)))
