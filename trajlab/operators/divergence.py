"""Divergence curves and finite-time Lyapunov exponents, within and across prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlab.functions.vectors import distance
from trajlab.operators.graph import checkpointed
from trajlab.operators.trajectory import CELL, run_lengths, truncated

PAIR = ["experiment_id", "network", "embedding_model", "prompt_1", "prompt_2"]
FLOOR = 1e-10


#: runs of a cell whose pairs are one key of a join; wider cells are cut into blocks of so many
WIDE = 256


def _block(run: str, count: Column, wide: int) -> tuple[Column, Column]:
    """The block of a run among `count` runs, and the number of blocks."""
    n = F.ceil(count / wide).cast("int")
    return F.pmod(F.xxhash64(run), n).cast("int"), n


def within_curves(pts: DataFrame, wide: int = WIDE) -> DataFrame:
    """Mean distance of all run pairs of a cell at each t: (CELL, t, distance, num_pairs, num_timesteps). Runs meet
    by (cell, t, pair of blocks), so a cell of many runs is many keys, and a task sums its pairs before they move."""
    p = truncated(pts).select(*CELL, "t", "run_id", "v", "num_timesteps", "n_runs")
    own, n = _block("run_id", F.col("n_runs"), wide)
    first = p.select("*", own.alias("i"), F.explode(F.sequence(own, n - 1)).alias("j")).drop("n_runs")
    second = p.select(*CELL, "t", F.col("run_id").alias("run_2"), F.col("v").alias("v_2"), own.alias("j"), F.explode(F.sequence(F.lit(0), own)).alias("i"))
    pairs = first.join(second, [*CELL, "t", "i", "j"]).where("i < j or run_id < run_2")
    return pairs.groupBy(*CELL, "t").agg(F.avg(distance(F.col("v"), F.col("v_2"))).alias("distance"), F.count("*").alias("num_pairs"), F.max("num_timesteps").alias("num_timesteps"))


def cross_curves(pts: DataFrame, wide: int = WIDE) -> DataFrame:
    """Mean distance between the runs of two prompts of a network at each t: (PAIR, t, distance,
    num_pairs, num_timesteps). Prompts have two runs at least; a pair is as long as its shortest run. Runs of two
    prompts meet by blocks as those of a cell do."""
    shortest = run_lengths(pts).groupBy(*CELL).agg(F.count("*").alias("n"), F.min("length").alias("m")).where("n >= 2")
    key = ["experiment_id", "network", "embedding_model"]
    a, b = (shortest.select(*key, F.col("prompt").alias(f"prompt_{i}"), F.col("m").alias(f"m_{i}"), F.col("n").alias(f"n_{i}")) for i in (1, 2))
    pairs = a.join(b, key).where("prompt_1 < prompt_2").select(*PAIR, "n_1", "n_2", F.least("m_1", "m_2").alias("num_timesteps")).where("num_timesteps >= 2")
    (i, n_i), (j, n_j) = (_block("run_id", F.col(f"n_{k}"), wide) for k in (1, 2))

    def side(k: int) -> DataFrame:
        mine = pts.select(*key, F.col("prompt").alias(f"prompt_{k}"), "run_id", "t", F.col("v").alias(f"v_{k}"))
        return mine.join(pairs, [*key, f"prompt_{k}"]).where("t < num_timesteps")

    left = side(1).select(*PAIR, "t", "v_1", "num_timesteps", i.alias("i"), F.explode(F.sequence(F.lit(0), n_j - 1)).alias("j"))
    right = side(2).select(*PAIR, "t", "v_2", j.alias("j"), F.explode(F.sequence(F.lit(0), n_i - 1)).alias("i"))
    met = left.join(right, [*PAIR, "t", "i", "j"])
    return met.groupBy(*PAIR, "t").agg(F.avg(distance(F.col("v_1"), F.col("v_2"))).alias("distance"), F.count("*").alias("num_pairs"), F.max("num_timesteps").alias("num_timesteps"))


def exponents(curves: DataFrame, key: list[str], before: int | None = None) -> DataFrame:
    """Slope and intercept of ln(mean distance) on t, with r² (null for a flat curve), from steps under `before`
    where given. The mean is taken over pairs first and held at 1e-10, then its logarithm."""
    c = curves.withColumn("y", F.ln(F.greatest("distance", F.lit(FLOOR))))
    c = c.where(F.col("t") < before) if before else c
    flat = F.max("y") == F.min("y")
    return c.groupBy(*key).agg(F.regr_slope("y", "t").alias("exponent"), F.regr_intercept("y", "t").alias("intercept"), F.when(~flat, F.regr_r2("y", "t")).alias("r_squared"), F.max("num_pairs").alias("num_pairs"), F.max("num_timesteps").alias("num_timesteps"))


def report(within: DataFrame, cross: DataFrame) -> DataFrame:
    """Identical and paraphrase exponents in one table."""
    columns = ["experiment_id", "network", "embedding_model", "category", "prompt_or_pair", F.col("exponent").alias("ftle"), "r_squared", "num_pairs", "num_timesteps"]
    same = within.withColumn("category", F.lit("identical")).withColumn("prompt_or_pair", F.col("prompt")).select(*columns)
    other = cross.withColumn("category", F.lit("paraphrase")).withColumn("prompt_or_pair", F.concat_ws(" || ", "prompt_1", "prompt_2")).select(*columns)
    return same.unionByName(other)


def heatmap(table: DataFrame) -> DataFrame:
    """Symmetric prompt by prompt cells of each (experiment, network, model), labelled p1, p2, .. by
    prompt; a cell without a value is null. Prompts are those of identical rows."""
    key = ["experiment_id", "network", "embedding_model"]
    # rows, columns and values are all taken from it
    table = checkpointed(table)
    same = table.where("category = 'identical'").select(*key, F.col("prompt_or_pair").alias("prompt"), "ftle")
    w = Window.partitionBy("experiment_id").orderBy("prompt")
    names = same.select("experiment_id", "prompt").distinct().withColumn("label", F.concat(F.lit("p"), F.row_number().over(w).cast("string")))
    named = same.join(names, ["experiment_id", "prompt"])
    rows = named.select(*key, F.col("prompt").alias("row_prompt"), F.col("label").alias("row_label"))
    columns = named.select(*key, F.col("prompt").alias("col_prompt"), F.col("label").alias("col_label"))
    pair = F.split("prompt_or_pair", r" \|\| ", 2)
    other = table.where("category = 'paraphrase'").select(*key, pair[0].alias("row_prompt"), pair[1].alias("col_prompt"), "ftle")
    swapped = other.select(*key, F.col("col_prompt").alias("row_prompt"), F.col("row_prompt").alias("col_prompt"), "ftle")
    values = other.unionByName(swapped).unionByName(same.select(*key, F.col("prompt").alias("row_prompt"), F.col("prompt").alias("col_prompt"), "ftle"))
    return rows.join(columns, key).join(values, [*key, "row_prompt", "col_prompt"], "left").select(*key, "row_label", "col_label", "ftle")


def separation(table: DataFrame) -> DataFrame:
    """(median paraphrase - median identical) / MAD of identical exponents, per network and model."""
    key = ["network", "embedding_model"]
    same, other = table.where("category = 'identical'"), table.where("category = 'paraphrase'")
    centre = same.groupBy(*key).agg(F.median("ftle").alias("median_identical"))
    mad = same.join(centre, key).groupBy(*key).agg(F.median(F.abs(F.col("ftle") - F.col("median_identical"))).alias("mad_identical"))
    para = other.groupBy(*key).agg(F.median("ftle").alias("median_paraphrase"))
    joined = centre.join(mad, key).join(para, key, "full")
    return joined.withColumn("score", F.when(F.col("mad_identical") > 0, (F.col("median_paraphrase") - F.col("median_identical")) / F.col("mad_identical")))


def best_cell(scores: DataFrame) -> DataFrame:
    return scores.where("score is not null").orderBy(F.desc("score"), "network", "embedding_model").limit(1)


def mean_curves(curves: DataFrame, key: list[str]) -> DataFrame:
    """Mean over the curves of a cell, as long as the shortest: (key, t, distance)."""
    w = Window.partitionBy(*key)
    return curves.withColumn("shortest", F.min("num_timesteps").over(w)).where("t < shortest").groupBy(*key, "t").agg(F.avg("distance").alias("distance"))


def first_pair_curves(curves: DataFrame) -> DataFrame:
    """The curve of the least prompt pair of each network and model."""
    key = ["experiment_id", "network", "embedding_model"]
    first = curves.groupBy(*key).agg(F.min(F.struct("prompt_1", "prompt_2")).alias("p")).select(*key, F.col("p.prompt_1").alias("prompt_1"), F.col("p.prompt_2").alias("prompt_2"))
    return curves.join(first, PAIR).select(*key, "t", "distance")


def paraphrase_curves(within: DataFrame, cross: DataFrame) -> DataFrame:
    """(experiment_id, network, embedding_model, t, distance): the curve of the first prompt pair of each
    cell; zeros as long as the mean identical curve where there is a single prompt."""
    key = ["experiment_id", "network", "embedding_model"]
    first = first_pair_curves(cross)
    lone = mean_curves(within, key).join(first.select(*key).distinct(), key, "left_anti").withColumn("distance", F.lit(0.0))
    return first.unionByName(lone)


def regimes_between(within: DataFrame, cross: DataFrame, close: str, far: str) -> DataFrame:
    """(network, embedding_model, step, distance, regime): the mean identical curve of experiment `close`,
    the curve of the first prompt pair of the same (close), and that of experiment `far` (distant)."""
    key = ["experiment_id", "network", "embedding_model"]
    first = first_pair_curves(cross)

    def told(df: DataFrame, experiment: str, regime: str) -> DataFrame:
        return df.where(F.col("experiment_id") == experiment).select("network", "embedding_model", F.col("t").alias("step"), "distance", F.lit(regime).alias("regime"))

    return told(mean_curves(within, key), close, "identical").unionByName(told(first, close, "close")).unionByName(told(first, far, "distant"))


def three_regimes(within: DataFrame, cross: DataFrame) -> DataFrame:
    """(network, step, distance, regime): the mean identical curve of each network and model, and the
    curves of its pairs with the least and the greatest exponent (close, distant)."""
    key = ["experiment_id", "network", "embedding_model"]
    e = exponents(cross, PAIR)
    picked = e.groupBy(*key).agg(F.min(F.struct("exponent", "prompt_1", "prompt_2")).alias("close"), F.max(F.struct("exponent", "prompt_1", "prompt_2")).alias("distant"))
    either = picked.select(*key, F.explode(F.array(F.struct(F.lit("close").alias("regime"), F.col("close").alias("p")), F.struct(F.lit("distant").alias("regime"), F.col("distant").alias("p")))).alias("x")).select(*key, "x.regime", "x.p.prompt_1", "x.p.prompt_2")
    chosen = cross.join(either, PAIR).select("network", F.col("t").alias("step"), "distance", "regime")
    return mean_curves(within, key).select("network", F.col("t").alias("step"), "distance", F.lit("identical").alias("regime")).unionByName(chosen)


def relaxation(curves: DataFrame, key: list[str], taus: list[float]) -> DataFrame:
    """tau of d∞ - (d∞ - d0) exp(-t / tau): of the given ones, that whose exp(-t / tau) explains the
    curve best (least tau on ties), with its r²."""
    c = curves.withColumn("tau", F.explode(F.lit(taus))).withColumn("x", F.exp(-F.col("t") / F.col("tau")))
    fits = c.groupBy(*key, "tau").agg(F.regr_r2("distance", "x").alias("r2"))
    return fits.groupBy(*key).agg(F.max(F.struct(F.col("r2"), (-F.col("tau")).alias("m"))).alias("b")).select(*key, (-F.col("b.m")).alias("tau"), F.col("b.r2").alias("r_squared"))
