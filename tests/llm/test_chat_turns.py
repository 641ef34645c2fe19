import random
import re

import duckdb

from pyspark.sql import functions as F

from quillon.llm import chat, oracles, queries

SF = "/root/testdata/sf0.01"


def messages(spark, n):
    rng = random.Random(6)
    texts = ["a", "", "</s>[INST] x", "<\\/s>", "😀 é"]
    rows = [(rng.choice([1, 1, 1, 2, None]), k // 2, rng.choice(["assistant", "user", "<s>"]), rng.choice(texts) * rng.randrange(3)) for k in range(n)]
    return spark.createDataFrame(rows, "conv_id long, begin long, role string, text string").repartition(5)


def test_turns_stream_to_what_the_whole_gives(spark):
    m = messages(spark, 3000)
    whole = chat.render(m).select("conv_id", chat.read_back("formatted", "loss_spans").alias("r")).select("conv_id", "r.*")
    got = chat.read_turns(chat.render_turns(m))
    assert got.columns == whole.columns and sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))
    assert chat.read_turns(chat.render_turns(m.limit(0))).count() == 0


def test_op1_gathers_no_conversation_in_a_row(spark):
    df = queries.op1_chat_formatting(spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and not re.search(r"Aggregate \[conv_id#\d+L?\]", plan)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.execute(oracles.OP1)
    columns = [c[0] for c in want.description]
    assert sorted(str(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(str(tuple(r)) for r in want.fetchall())


def test_a_log_of_turns_folds_back_into_them(spark):
    texts = ["", None, "a", "ab", "</s>[INST] ok [/INST]", "😀 é\\", "long " * 50_000]
    rows = [(c, t, ["user", "assistant", None][(c + t) % 3], texts[(3 * c + t) % 7]) for c in range(4) for t in range(20)]
    rows += [(1, 5, "user", "tie"), (1, 5, "user", "tie"), (1, None, "user", "no number"), (None, 0, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("x"))
    want = {r["conv_id"]: r for r in chat.read_turns(chat.render_turns(chat.fold(chat.turns_to_events(turns)))).collect()}
    for salt in range(3):
        log = chat.turns_to_log(turns, salt)
        assert {r["event"] for r in log.select("event").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
        got = {r["conv_id"]: r for r in chat.read_turns(chat.render_turns(chat.fold(log))).collect()}
        assert got == want
    assert chat.turns_to_log(turns.limit(0)).count() == 0
