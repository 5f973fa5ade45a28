"""Tables of a report from a tree of result files: one DataFrame of text cells a table.

Rows and columns come from a Layout, not from what is there, so that a configuration without a result shows as `--`.
Files that are missing or broken count as no result.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.functions.fixed import FAILURE_CATEGORIES
from quillmesh.operators.evaluation import grid_table
from quillmesh.sources.files import read_tolerant

#: Where each table's results lie, the levels of folders below, and the file.
TREES = {
    "main": ("main_table", ("dataset", "method", "llm"), "score.json"),
    "ablation": ("ablation", ("dataset", "variant", "llm"), "score.json"),
    "timing": ("efficiency", ("dataset", "method"), "timing.json"),
    "build": ("kg_stats", ("dataset",), "kg_stats.json"),
    "probe": ("appendix_B_embedding", ("dataset",), "embedding_probe.json"),
    "sensitivity": ("appendix_C_sensitivity", ("dataset", "param", "value"), "score.json"),
    "failures": ("appendix_E_failures", ("dataset",), "failures.json"),
    "priming": ("appendix_G_cot", ("dataset", "priming"), "score.json"),
    "recogniser": ("appendix_H_ner", ("dataset", "ner"), "ner_stats.json"),
    "recogniser_em": ("appendix_H_ner", ("dataset", "ner"), "end_em.json"),
    "judge": ("appendix_I_ragas", ("dataset", "method"), "ragas.json"),
}
_SCORE = "em double, f1 double"


@dataclass(frozen=True)
class Layout:
    """What the tables have as rows and columns. `own` is the method whose graph the build times are of."""

    datasets: tuple[str, ...]
    methods: tuple[str, ...]
    llms: tuple[str, ...]
    own: str
    variants: tuple[str, ...] = ()
    efficiency: tuple[str, ...] = ()
    strategies: tuple[str, ...] = ()
    sensitivity: dict[str, tuple] = field(default_factory=dict)
    primings: tuple[str, ...] = ()
    recognisers: tuple[str, ...] = ()


def results(spark: SparkSession, base: str, tree: str, schema: str) -> DataFrame:
    """The values of one kind of result file, with a column for each level of folders above it."""
    folder, levels, name = TREES[tree]
    rows = read_tolerant(spark, f"{base}/{folder}", schema)
    parts = F.split(F.regexp_extract("file", rf"/{folder}/(.*)/{name.replace('.', '[.]')}$", 1), "/")
    fine = rows.where(F.col("file").endswith(f"/{name}") & (F.size(parts) == len(levels)))
    return fine.select(*(parts[i].alias(x) for i, x in enumerate(levels)), "value.*")


def _grid(spark: SparkSession, **values: tuple) -> DataFrame:
    """All rows of a table, numbered in the order given."""
    rows = [(i, *map(str, x)) for i, x in enumerate(product(*values.values()))]
    return spark.createDataFrame(rows, ", ".join(["place int", *(f"`{k}` string" for k in values)]))


def _cell(value: Column, digits: int = 1) -> Column:
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value.cast("double"))).otherwise("--")


def _filled(grid: DataFrame, keys: list[str], parts: DataFrame, cells: dict[str, int]) -> DataFrame:
    out = grid.join(parts, keys, "left").orderBy("place")
    return out.select(*keys, *(_cell(F.col(c), n).alias(c) for c, n in cells.items()))


def main_table(spark: SparkSession, base: str, at: Layout) -> DataFrame:
    """EM and F1 of every method and model on every dataset, and their means over the datasets that are there."""
    return grid_table(results(spark, base, "main", _SCORE), _grid(spark, method=at.methods, llm=at.llms).drop("place"), ["method", "llm"], "dataset", list(at.datasets), ["em", "f1"])


def _means(spark: SparkSession, base: str, tree: str, key: str, rows: tuple[str, ...], at: Layout, where: Column | None = None) -> DataFrame:
    scores = results(spark, base, tree, _SCORE).where(F.col("dataset").isin(list(at.datasets)))
    scores = scores if where is None else scores.where(where)
    return _filled(_grid(spark, **{key: rows}), [key], scores.groupBy(key).agg(F.avg("em").alias("em"), F.avg("f1").alias("f1")), {"em": 1, "f1": 1})


def ablation_table(spark: SparkSession, base: str, at: Layout, llm: str) -> DataFrame:
    """Mean EM and F1 of every variant for one model."""
    return _means(spark, base, "ablation", "variant", at.variants, at, F.col("llm") == llm)


def priming_table(spark: SparkSession, base: str, at: Layout) -> DataFrame:
    return _means(spark, base, "priming", "priming", at.primings, at)


def efficiency_table(spark: SparkSession, base: str, at: Layout) -> DataFrame:
    """Mean seconds and tokens a question of every method, and build minutes of the own one."""
    timing = results(spark, base, "timing", "retrieve_sec_per_q double, tokens_per_q struct<total_tokens:double>").where(F.col("dataset").isin(list(at.datasets)))
    each = timing.groupBy("method").agg(F.avg("retrieve_sec_per_q").alias("seconds"), F.avg("tokens_per_q.total_tokens").alias("tokens"))
    build = results(spark, base, "build", "build_time_min double").where(F.col("dataset").isin(list(at.datasets))).agg(F.avg("build_time_min").alias("build_min")).withColumn("method", F.lit(at.own))
    return _filled(_grid(spark, method=at.efficiency), ["method"], each.join(build, "method", "full"), {"seconds": 2, "tokens": 0, "build_min": 1})


def probe_table(spark: SparkSession, base: str, at: Layout) -> DataFrame:
    """Recall of synonyms, false merges and F1 of every strategy on every dataset."""
    rows = results(spark, base, "probe", "by_strategy map<string,struct<syn_recall:double,false_merge:double,f1:double>>")
    each = rows.select("dataset", F.explode("by_strategy").alias("strategy", "v")).select("dataset", "strategy", "v.*")
    return _filled(_grid(spark, dataset=at.datasets, strategy=at.strategies), ["dataset", "strategy"], each, {"syn_recall": 1, "false_merge": 1, "f1": 1})


def sensitivity_tables(spark: SparkSession, base: str, at: Layout) -> dict[str, DataFrame]:
    """For every parameter EM / F1 of every dataset at every value."""
    scores = results(spark, base, "sensitivity", _SCORE)
    both = F.concat(_cell(F.col("em")), F.lit("/"), _cell(F.col("f1")))
    out = {}
    for param, values in at.sensitivity.items():
        cells = [F.max(F.when(F.col("value") == str(v), both)).alias(str(v)) for v in values]
        wide = scores.where(F.col("param") == param).groupBy("dataset").agg(*cells)
        grid = _grid(spark, dataset=at.datasets).join(wide, "dataset", "left").orderBy("place")
        out[param] = grid.select("dataset", *(F.coalesce(F.col(f"`{v}`"), F.lit("--")).alias(str(v)) for v in values))
    return out


def failure_table(spark: SparkSession, base: str, at: Layout) -> DataFrame:
    """The share of every kind of failure on every dataset, and their mean."""
    rows = results(spark, base, "failures", "distribution_fraction map<string,double>")
    each = rows.select("dataset", F.explode("distribution_fraction").alias("category", "share"))
    return grid_table(each, _grid(spark, category=tuple(FAILURE_CATEGORIES)).drop("place"), ["category"], "dataset", list(at.datasets), ["share"])


def recogniser_table(spark: SparkSession, base: str, at: Layout) -> DataFrame:
    stats = results(spark, base, "recogniser", "recall double, over_extract double")
    end = results(spark, base, "recogniser_em", "em double")
    return _filled(_grid(spark, dataset=at.datasets, ner=at.recognisers), ["dataset", "ner"], stats.join(end, ["dataset", "ner"], "full"), {"recall": 1, "over_extract": 1, "em": 1})


def judge_table(spark: SparkSession, base: str, at: Layout) -> DataFrame:
    rows = results(spark, base, "judge", "faithfulness_mean double, context_relevance_mean double")
    return _filled(_grid(spark, dataset=at.datasets, method=at.efficiency), ["dataset", "method"], rows, {"faithfulness_mean": 1, "context_relevance_mean": 1})


def report(spark: SparkSession, base: str, at: Layout, llm: str | None = None) -> dict[str, DataFrame]:
    """All tables, by name."""
    single = {"main": main_table, "efficiency": efficiency_table, "probe": probe_table, "failures": failure_table, "priming": priming_table, "recogniser": recogniser_table, "judge": judge_table}
    out = {name: f(spark, base, at) for name, f in single.items()}
    out["ablation"] = ablation_table(spark, base, at, llm or at.llms[0])
    return out | {f"sensitivity {k}": v for k, v in sensitivity_tables(spark, base, at).items()}


def graph_counts(entity: DataFrame, relation: DataFrame, incidence: DataFrame, synonym: DataFrame) -> DataFrame:
    """(kind, n): nodes and edges of a graph by type."""
    kinds = F.when(F.coalesce("is_title", F.lit(False)), "title entity").otherwise("entity")
    edges = F.when(F.coalesce("is_title_edge", F.lit(False)), "title edge").otherwise("hyperedge")
    parts = [entity.select(kinds.alias("kind")), relation.select(F.lit("relation").alias("kind")), incidence.select(edges.alias("kind")), synonym.select(F.lit("synonym").alias("kind"))]
    counts = [p.groupBy("kind").agg(F.count("*").alias("n")) for p in parts]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


def question_timing(rows: DataFrame, config) -> DataFrame:
    """(qid, retrieve_total_ms, elapsed_internal_s, n_subq, context_chars, ablation, hyperparams): a row a question with the
    settings it ran with, as JSON. rows(qid, retrieve_total_ms, elapsed, n_subq, context, ablation)."""
    import json
    from dataclasses import asdict

    return rows.select("qid", "retrieve_total_ms", F.col("elapsed").alias("elapsed_internal_s"), "n_subq", F.length(F.coalesce("context", F.lit(""))).alias("context_chars"), "ablation", F.lit(json.dumps(asdict(config))).alias("hyperparams"))


def token_totals(rows: DataFrame) -> DataFrame:
    """One row: mean prompt, completion and total tokens a question, one decimal; null counts are 0."""
    names = ("prompt_tokens", "completion_tokens", "total_tokens")
    return rows.agg(*(F.round(F.avg(F.coalesce(n, F.lit(0))), 1).alias(n) for n in names))


def status_report(records: DataFrame) -> DataFrame:
    """(line_no, line): the counts of all outcomes, then a line a chunk with its flags and its events below.

    records(chunk_id, title, status, is_table, events array<string>).
    """
    flag = F.when(F.col("status") == "retry_ok", "[RETRY] ").when(F.col("status") == "empty", "[EMPTY] ").when(F.col("status") == "failed", "[FAILED] ").otherwise("")
    head = records.groupBy(F.coalesce("status", F.lit("unknown")).alias("s")).agg(F.count("*").alias("n")).select(F.struct(F.lit(0).alias("part"), F.lit(None).cast("bigint").alias("chunk"), F.col("s").alias("key"), F.lit(-1).alias("pos")).alias("at"), F.concat("s", F.lit(": "), F.col("n").cast("string")).alias("line"))
    own = records.select(F.struct(F.lit(1).alias("part"), F.col("chunk_id").alias("chunk"), F.lit("").alias("key"), F.lit(-1).alias("pos")).alias("at"), F.concat(flag, F.when(F.col("is_table"), "[TABLE] ").otherwise(""), F.coalesce("title", F.lit("")), F.lit(": "), F.coalesce(F.size("events"), F.lit(0)).cast("string"), F.lit(" events")).alias("line"))
    events = records.select("chunk_id", F.posexplode("events").alias("pos", "e")).select(F.struct(F.lit(1).alias("part"), F.col("chunk_id").alias("chunk"), F.lit("").alias("key"), F.col("pos").alias("pos")).alias("at"), F.concat(F.lit("  - "), F.coalesce("e", F.lit(""))).alias("line"))
    return head.unionByName(own).unionByName(events).orderBy("at").select("at", "line")


def nth(rows: DataFrame, order: list[Column], limit: int | None = None, index: int | None = None) -> DataFrame:
    """The first `limit` rows in an order, or only the one at `index` (from 0), for a trial run."""
    if index is not None:
        return rows.orderBy(*order).offset(index).limit(1)
    return rows if limit is None else rows.orderBy(*order).limit(limit)
