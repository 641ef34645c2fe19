"""What Spark guesses to be small is not sent through the driver."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql.readwriter import DataFrameWriter

import corpus_pipeline
from quillon.llm import brown, common, near


def plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def plans(monkeypatch):
    """Plans of the tables written meanwhile, as they are before any size is measured."""
    found, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **b: (found.append((path, plan(self._df))), write(self, path, *a, **b))[1])
    return found


@pytest.fixture
def many(spark):
    """A table whose size Spark guesses at 0.6 MB though an explode makes 40 MB of it."""
    return spark.range(40_000).withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(30)))).select("id", F.format_string("word %09d", "x").alias("word"))


def test_a_table_guessed_small_is_not_broadcast(spark, many, plans):
    rows = common.written(spark.range(400_000).join(many, "id").groupBy("id").agg(F.max("word").alias("word")), "broadcasts")
    assert "Broadcast" not in plans[0][1] and rows.count() == 40_000
    tiny = spark.range(2)
    common.written(spark.range(400_000).join(tiny, "id"), "broadcasts")
    assert "BroadcastHashJoin" in plans[1][1]  # truly small ones are


def test_settings_are_put_back_and_a_smaller_threshold_holds(spark, plans):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for most, guessed in (("10m", str(256 << 10)), ("1k", "1024"), ("-1", "-1"), ("256KB", str(256 << 10))):
            spark.conf.set(names[0], most)
            held = common._broadcasts(spark)
            assert held == {names[0]: guessed, names[1]: most}
            common.written(spark.range(3), "broadcasts")
            assert [spark.conf.get(n, None) for n in names] == [most, before[names[1]]]
        spark.conf.set(names[1], "2m")
        assert common._broadcasts(spark)[names[1]] == "2m"
    finally:
        for n in names:
            spark.conf.unset(n) if before[n] is None else spark.conf.set(n, before[n])


def test_results_that_are_read_later_do_not_broadcast(documents):
    assert "Broadcast" not in plan(near.near_duplicates(documents, width=3))
    assert "Broadcast" not in plan(brown.score(documents, *brown.fit(documents)))


def test_all_tables_of_the_pipelines_near_copies_are_written_so(spark, documents, monkeypatch):
    held, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **b: (held.append(spark.conf.get("spark.sql.autoBroadcastJoinThreshold")), write(self, path, *a, **b))[1])
    kept = corpus_pipeline.drop_near_copies(spark, documents.select("doc_id", "text", "lang", "source", "n_chars"), "")
    assert "Broadcast" not in plan(kept) and len(held) > 10
    assert all(int(x.rstrip("b")) <= common.GUESSED for x in held)
