"""Answers to scores, and scores to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import text as T


def evaluate(rows: DataFrame) -> DataFrame:
    """Adds pred, reasoning, em, f1, mark and error to rows(context, raw, gold).

    Without context nothing is asked: an empty answer with the error no_context; without a raw answer llm_call_failed.
    """
    blank = F.coalesce(F.trim("context"), F.lit("")) == ""
    error = F.when(blank, "no_context").when(F.col("raw").isNull(), "llm_call_failed")
    pred = F.when(error.isNotNull(), "").otherwise(T.extract_answer(F.col("raw")))
    out = rows.withColumn("error", error).withColumn("pred", pred).withColumn("reasoning", F.when(F.col("error").isNull(), T.reasoning_of(F.col("raw"))).otherwise(""))
    return out.withColumn("em", T.exact_match(F.col("pred"), F.col("gold"))).withColumn("f1", T.token_f1(F.col("pred"), F.col("gold"))).withColumn("mark", T.mark(F.col("em"), F.col("f1")))


def summary(scored: DataFrame, tokens: str | None = None) -> DataFrame:
    """One row: n, em and f1 in percent (two decimals), mean tokens (one decimal)."""
    picks = [F.count("*").alias("n"), F.round(F.avg("em") * 100, 2).alias("em"), F.round(F.avg("f1") * 100, 2).alias("f1")]
    return scored.agg(*picks, *([F.round(F.avg(tokens), 1).alias("tokens")] if tokens else []))


def unify_tokens(eval_count: Column, usage: Column) -> Column:
    """Tokens as one server or the other counts them; 0 if none does."""
    return F.coalesce(F.nullif(eval_count, F.lit(0)), usage, F.lit(0))


def distribution(labelled: DataFrame, label: str) -> DataFrame:
    """(label, n, fraction) with fractions of all rows, four decimals; null labels count as unparseable."""
    counts = labelled.groupBy(F.coalesce(label, F.lit("unparseable")).alias("label")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    # the total is one row
    return counts.join(F.broadcast(total), how="cross").select("label", "n", F.round(F.col("n") / F.col("total"), 4).alias("fraction"))


def judge_means(judged: DataFrame, *scores: str) -> DataFrame:
    """One row: all questions, and for each judge's score its mean and how many could be read."""
    return judged.agg(F.count("*").alias("n_questions"), *(F.round(F.avg(s), 4).alias(f"{s}_mean") for s in scores), *(F.count(s).alias(f"n_{s}") for s in scores))


def confusion(pairs: DataFrame, similarity: str, positive: str, tau: float) -> DataFrame:
    """One row: counts and rates of taking pairs of at least tau for the same."""
    said, real = F.coalesce(F.col(similarity), F.lit(-1.0)) >= tau, F.col(positive)
    c = pairs.agg(F.count_if(said & real).alias("tp"), F.count_if(~said & real).alias("fn"), F.count_if(said & ~real).alias("fp"), F.count_if(~said & ~real).alias("tn"))
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    tp, fn, fp, tn = (F.col(x) for x in ("tp", "fn", "fp", "tn"))
    return c.select("*", rate(tp, tp + fn).alias("recall"), rate(fp, fp + tn).alias("false_merge"), rate(tp, tp + fp).alias("precision"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"))


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__rn = 1").drop("__rn")


def grid_table(scores: DataFrame, rows: DataFrame, row: list[str], column: str, columns: list[str], values: list[str]) -> DataFrame:
    """A report: a row for each row of the grid `rows`, a cell for each column and value, and each value's mean over the
    columns that are there. Missing cells, and means of nothing, are `--`; the others have one decimal."""
    picked = scores.where(F.col(column).isin(columns)).groupBy(*row, column).agg(*(F.avg(v).alias(v) for v in values))
    wide = picked.groupBy(*row).agg(*(F.max(F.when(F.col(column) == c, F.col(v))).alias(f"{c}_{v}") for c in columns for v in values), *(F.avg(v).alias(f"avg_{v}") for v in values))
    out = rows.join(wide, row, "left")
    cells = [f"{c}_{v}" for c in columns for v in values] + [f"avg_{v}" for v in values]
    return out.select(*row, *(T.cell(F.col(c)).alias(c) for c in cells))


def pending(grid: DataFrame, finished: DataFrame, key: list[str]) -> DataFrame:
    """Configurations of a grid that have no result yet."""
    return grid.distinct().join(finished.select(*key).distinct(), key, "left_anti")


def answer_prompt(context: Column, question: Column, priming: str = "reasoning-first") -> Column:
    """What the answering model is sent; an unknown priming counts as reasoning-first."""
    tails = {"answer-first": "Answer first, then give the reasoning.\nAnswer:", "answer-only": "Give the answer only.\nAnswer:"}
    tail = tails.get(priming, "Give the reasoning first, then a line `Answer: ...`.\nReasoning:")
    return F.concat(F.lit("Context:\n"), F.coalesce(context, F.lit("")), F.lit("\n\nQuestion: "), F.coalesce(question, F.lit("")), F.lit(f"\n\n{tail}"))


def judge_score(raw: Column, field: str) -> Column:
    """A number out of the first flat JSON object of a judge's answer; null if there is none or it is no number."""
    flat = F.try_parse_json(F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)\{[^{}]*\}", 0))
    return F.try_variant_get(flat, f"$.{field}", "double")


def timing_summary(rows: DataFrame, milliseconds: str = "retrieve_total_ms") -> DataFrame:
    """One row: questions and mean seconds a question, three decimals."""
    return rows.agg(F.count("*").alias("n_questions"), F.round(F.avg(milliseconds) / 1000, 3).alias("retrieve_sec_per_q"))


def config_grid(spark, **values: list) -> DataFrame:
    """All combinations of the given values, each once, as text; a grid of settings is small by nature."""
    from itertools import product

    rows = list(dict.fromkeys(product(*([str(v) for v in vs] for vs in values.values()))))
    return spark.createDataFrame(rows, ", ".join(f"`{k}` string" for k in values))


def unpivot(scores: DataFrame, key: list[str], columns: list[str], name: str = "method", value: str = "value") -> DataFrame:
    """Columns of scores as rows."""
    return scores.unpivot(key, columns, name, value)
