"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonde.llm.common import attach, stored

AXES = ("source", "lang", "topic")
ROUNDS = 24
TEMPER = 0.9


def topic_of(text: Column) -> Column:
    """A coarse topic from the text's form; null texts have topic `none`."""
    size = F.octet_length(text)
    return (F.when(text.isNull(), "none").when(text.contains("http"), "web").when(text.contains(" | "), "list")
            .when(size < 500, "note").when(size < 5000, "article").otherwise("book"))


def tokens_of(text: Column) -> Column:
    """Token weight: a quarter of the UTF-8 bytes, and one for the end; null texts weigh one."""
    return F.coalesce(F.floor(F.octet_length(text) / 4), F.lit(0)) + F.lit(1)


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None, axes: Sequence[str] = AXES, rounds: int = ROUNDS,
         temper: float = TEMPER) -> DataFrame:
    """`cells` (axes, tokens) with the fitted `weight` of each cell.

    Every round scales the weights of all cells to each axis' target shares in turn.  `targets`
    maps an axis to (axis, share); without one the target is the axis' own token share to the
    power `temper`, made to sum to one, which lifts small sources.  A level without a target keeps
    no weight.  Cells are one row for each combination of levels, so they are few however many
    documents there are; they stand in one partition and no round shuffles.
    """
    out = cells.coalesce(1).withColumn("weight", F.col("tokens").cast("double"))
    for axis in axes:
        if targets and axis in targets:
            side = targets[axis].select(F.col(axis).alias("_level"), F.col("share").cast("double").alias(f"_to_{axis}"))
            out = out.join(side, F.col(axis) == F.col("_level"), "left").drop("_level").coalesce(1)
            out = out.withColumn(f"_to_{axis}", F.coalesce(f"_to_{axis}", F.lit(0.0)))
        else:
            level = F.pow(F.sum("tokens").over(Window.partitionBy(axis)).cast("double"), F.lit(temper))
            out = out.withColumn("_level", level).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(axis)))
            out = out.withColumn(f"_to_{axis}", F.col("_level") / F.sum(F.col("_level") / F.col("_n")).over(
                Window.partitionBy(F.lit(0)))).drop("_level", "_n")
    for _ in range(rounds):
        for axis in axes:
            out = out.withColumn("weight", F.coalesce(F.try_divide(
                F.col("weight") * F.col(f"_to_{axis}"), F.sum("weight").over(Window.partitionBy(axis))), F.lit(0.0)))
    return out.select(*axes, "tokens", "weight")


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, seed: int = 0, rounds: int = ROUNDS,
        temper: float = TEMPER) -> DataFrame:
    """One row per document: doc_id, its cell and tokens, `probability` and whether it is `sampled`.

    Cells are (source, lang, topic); a null level is a level of its own.  The fitted weight of a
    cell over its tokens is the wanted density; the densest cell is kept whole and all others
    in proportion, so no probability is cut off at one and expected token shares meet the targets
    the fit has reached.  A document is sampled if a number drawn from its id lies below
    its probability: repeated ids are drawn alike, a null id draws as the text `null`.  An empty
    input gives no rows.
    """
    keyed = docs.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"),
        topic_of(F.col("text")).alias("topic"), tokens_of(F.col("text")).cast("bigint").alias("tokens"))
    cells = keyed.groupBy(*AXES).agg(F.sum("tokens").alias("tokens"))
    fitted = rake(cells, targets, AXES, rounds, temper)
    fitted = fitted.withColumn("_density", F.col("weight") / F.col("tokens"))
    rate = stored(fitted.select(*AXES, F.round(
        F.col("_density") / F.max("_density").over(Window.partitionBy(F.lit(0))), 9).alias("probability")), "rates")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    draw = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
    return (attach(keyed, rate, list(AXES), "inner").withColumn("sampled", draw < F.col("probability"))
            .select("doc_id", *AXES, "tokens", "probability", "sampled"))
