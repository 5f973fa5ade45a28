"""Plans: what must not be in them, and what must reach the scan."""

from pyspark.sql import functions as F

from quillmesh.operators import passages as P
from quillmesh.operators import retrieval as R


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_pruned_scan(spark, tmp_path):
    spark.range(10).select(F.col("id").alias("rel_id"), F.col("id").alias("ent_id"), F.lit("x" * 50).alias("wide")).write.parquet(str(tmp_path / "t"))
    text = plan(spark.read.parquet(str(tmp_path / "t")).where("ent_id > 3").groupBy("rel_id").count())
    assert "GreaterThan(ent_id,3)" in text and "wide" not in text.split("ReadSchema")[1].split("\n")[0]


def test_top_k_is_cut_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 5 as q", "id", "cast(id as double) as s")
    assert "WindowGroupLimit" in plan(R.top_k(df, ["q"], [F.desc("s"), F.col("id")], 3))


def test_no_products(spark):
    e = "array<struct<name:string,attribute:string,definition:string>>"
    facts = spark.createDataFrame([], f"rel_id bigint, relation string, entities {e}, source_title string, chunk_id bigint")
    kept = P.deduplicate_facts(facts)
    places = P.fact_entities(kept)
    for df in (P.fold_entities(places), P.build_incidence(kept, places), P.title_entities(kept, places)):
        assert "CartesianProduct" not in plan(df) and "NestedLoop" not in plan(df) and "InPandas" not in plan(df) and "EvalPython" not in plan(df)
