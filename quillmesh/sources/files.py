"""Readers and writers of the stages' files: questions, extractions, graph tables, results, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION = "id string, question string, answer string, context string"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions from JSON whose context items are [title, [sentences]] pairs, brought to structs.

    The file may be an array or one object a line; unreadable records are dropped.
    """
    raw = spark.read.json(path, schema=QUESTION, multiLine=True, mode="PERMISSIVE").where("id is not null or question is not null")
    pairs = F.from_json("context", "array<array<string>>")
    item = lambda p: F.struct(p[0].alias("title"), F.from_json(p[1], "array<string>").alias("sentences"))
    return raw.select("id", "question", "answer", F.transform(pairs, item).alias("context"))


def read_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, value) of every JSON file under a folder; files that are missing or cannot be read give no row."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"file string, value struct<{schema}>")
    text = F.decode("content", "UTF-8")
    rows = files.select(F.col("path").alias("file"), F.from_json(text, schema, {"mode": "PERMISSIVE"}).alias("value"), F.try_parse_json(text).isNotNull().alias("fine"))
    return rows.where("fine").drop("fine")


def read_scores(spark: SparkSession, base: str) -> DataFrame:
    """(table, dataset, method, llm, em, f1) of a results tree table/dataset/method/llm/score.json."""
    rows = read_tolerant(spark, base, "em double, f1 double")
    parts = F.split(F.regexp_extract("file", r"([^/]+/[^/]+/[^/]+/[^/]+)/score\.json$", 1), "/")
    return rows.where(F.col("file").endswith("/score.json")).select(*(parts[i].alias(n) for i, n in enumerate(("table", "dataset", "method", "llm"))), "value.em", "value.f1")


def write_graph(base: str, **tables: DataFrame) -> None:
    """Graph tables as Parquet folders, one a table."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{base}/{name}.parquet")


def write_results(df: DataFrame, path: str, drop: tuple[str, ...] = ("raw",)) -> None:
    """Results as JSON lines, without the models' raw output."""
    df.drop(*drop).write.mode("overwrite").json(path)


def extraction_report(records: DataFrame) -> DataFrame:
    """(chunk_id, line): a line of text a record: a flag for its status, [TABLE] for lists, title and number of events."""
    flag = F.when(F.col("status") == "retry_ok", "[RETRY] ").when(F.col("status") == "empty", "[EMPTY] ").when(F.col("status") == "failed", "[FAILED] ").otherwise("")
    table = F.when(F.col("is_table"), "[TABLE] ").otherwise("")
    return records.select("chunk_id", F.concat(flag, table, F.coalesce("title", F.lit("")), F.lit(": "), F.col("n_events").cast("string"), F.lit(" events")).alias("line"))


def write_report(report: DataFrame, path: str) -> None:
    report.orderBy("chunk_id").select("line").write.mode("overwrite").text(path)


def markdown(table: DataFrame, most: int = 5_000) -> str:
    """A small finished report as a Markdown table; refuses more than `most` rows."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    head = "| " + " | ".join(table.columns) + " |\n|" + "---|" * len(table.columns)
    return "\n".join([head, *("| " + " | ".join("--" if v is None else str(v) for v in r) + " |" for r in rows)]) + "\n"


def read_or_default(spark: SparkSession, path: str, schema: str, default: list[tuple]) -> DataFrame:
    """JSON lines, or the default rows where the file is missing; these are then written there."""
    try:
        return spark.read.schema(schema).json(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows = spark.createDataFrame(default, schema)
    rows.write.json(path)
    return rows
