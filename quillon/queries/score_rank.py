"""Queries of scoring (D), filters (E), ranking (G), history (H) and context (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon import adapters as A
from quillon.functions import text as T
from quillon.operators import context, filters, history, rank, scoring, search
from quillon.queries.base import CAT, FREQ, HIST, OPENS, PARTS, SCORED, query
from quillon.sources.files import scratch
from quillon.streaming.history import read_state, stream_history

SCALES = (1.0, 0.5, 2.0)


def _history(spark, sf):
    entries = history.history_entries(A.opens(spark, sf), A.prepared(spark, sf).items, ("user_id", "event_id"))
    return history.last_n(entries, 50, tie=("event_id",))


def _scored(spark, sf):
    p = A.prepared(spark, sf)
    return scoring.recommend(p.items, p.freqs, A.weights(spark), A.MULTIPLIERS, _history(spark, sf), SCALES)


@query("d01_tag_score", f"WITH {FREQ}, {PARTS} SELECT f.id, round(coalesce(p.v, 0), 4) AS tag_score FROM feat f LEFT JOIN tagp p ON p.id = f.id")
def d01(spark, sf):
    p = A.prepared(spark, sf)
    return scoring.tag_score(p.items, p.freqs.tags, A.weights(spark).tags, 1.2).withColumn("tag_score", F.round("tag_score", 4))


@query("d02_author_score", f"WITH {FREQ}, {PARTS} SELECT f.id, round(coalesce(p.v, 0), 4) AS author_score FROM feat f LEFT JOIN authp p ON p.id = f.id")
def d02(spark, sf):
    p = A.prepared(spark, sf)
    return scoring.author_score(p.items, p.freqs.authors, A.weights(spark).authors, 0.8).withColumn("author_score", F.round("author_score", 4))


@query("d03_title_score", f"WITH {FREQ}, {PARTS} SELECT f.id, round(coalesce(p.v, 0), 4) AS title_score FROM feat f LEFT JOIN wordp p ON p.id = f.id")
def d03(spark, sf):
    p = A.prepared(spark, sf)
    return scoring.title_score(p.items, p.freqs.words, A.weights(spark).words, 1.1).withColumn("title_score", F.round("title_score", 4))


@query("d04_history_bonus", f"WITH {HIST} SELECT facet, feature, round(bonus, 4) AS bonus FROM bonus")
def d04(spark, sf):
    return scoring.history_bonus(_history(spark, sf), A.prepared(spark, sf).freqs, SCALES).withColumn("bonus", F.round("bonus", 4))


@query("d05_history_score", f"{'WITH ' + SCORED} SELECT f.id, round(coalesce(h.v, 0), 4) AS history_score FROM feat f LEFT JOIN histp h ON h.id = f.id")
def d05(spark, sf):
    p = A.prepared(spark, sf)
    return scoring.history_score(p.items, scoring.history_bonus(_history(spark, sf), p.freqs, SCALES), 0.7).withColumn("history_score", F.round("history_score", 4))


@query("d06_recommend", f"WITH {SCORED} SELECT id, score, title, upload_date FROM scored")
def d06(spark, sf):
    return _scored(spark, sf).select("id", "score", "title", "upload_date")


@query("d07_recommend_linear", f"WITH {FREQ}, {PARTS} SELECT f.id, CAST(trunc(round(coalesce(t.old, 0) + coalesce(a.old, 0) + coalesce(w.old, 0), 6)) AS INTEGER) AS score FROM feat f LEFT JOIN tagp t ON t.id = f.id LEFT JOIN authp a ON a.id = f.id LEFT JOIN wordp w ON w.id = f.id")
def d07(spark, sf):
    p = A.prepared(spark, sf)
    return scoring.recommend_linear(p.items, p.freqs, A.weights(spark), A.MULTIPLIERS).select("id", "score")


@query("d08_effective_weights", f"WITH {FREQ} SELECT w.feature, CASE WHEN w.feature = 'crimson' THEN 4.0 ELSE CAST(w.weight AS DOUBLE) END AS weight FROM tagw w JOIN tagf USING (feature) UNION ALL SELECT 'plate', 0.25")
def d08(spark, sf):
    own = spark.createDataFrame([("crimson", 4.0), ("plate", 0.25)], "feature string, weight double")
    return scoring.effective_weights(A.weights(spark).tags, own, A.prepared(spark, sf).freqs.tags)


@query("e01_block_tags", f"WITH {SCORED} SELECT id, score FROM scored WHERE NOT list_has_any(parsed_tags, ['crimson', 'PROMO'])")
def e01(spark, sf):
    return filters.block_tags(_scored(spark, sf), ["crimson", "PROMO"]).select("id", "score")


@query("e01_block_tags_joined", f"WITH {SCORED} SELECT id, score FROM scored WHERE NOT list_has_any(parsed_tags, ['crimson', 'PROMO'])")
def e01_joined(spark, sf):
    return filters.block_tags_joined(_scored(spark, sf), spark.createDataFrame([("crimson",), ("PROMO",)], "tag string")).select("id", "score")


_BOUNDS = "bounds AS (SELECT min(score) AS low, CASE WHEN max(score) > min(score) THEN max(score) ELSE min(score) + 1 END AS high FROM scored), cut AS (SELECT low, high, CASE WHEN low <= 0 AND high >= 0 THEN 0 ELSE low END AS threshold FROM bounds)"


@query("e02_score_bounds", f"WITH {SCORED}, {_BOUNDS} SELECT * FROM cut")
def e02(spark, sf):
    return filters.score_bounds(_scored(spark, sf))


@query("e03_min_score", f"WITH {SCORED}, {_BOUNDS} SELECT id, score FROM scored, cut WHERE score >= threshold")
def e03(spark, sf):
    return filters.min_score(_scored(spark, sf)).select("id", "score")


@query("e04_keyword_search", f"WITH {SCORED} SELECT id FROM scored WHERE contains(search_text, 'gear') AND contains(search_text, 'brand#1')")
def e04(spark, sf):
    return filters.keyword_search(A.prepared(spark, sf).items, " Gear，BRAND#1, ,").select("id")


@query("e04_keyword_search_blocks", f"WITH {SCORED} SELECT id FROM scored WHERE contains(search_text, 'gear') AND contains(search_text, 'brand#1')")
def e04_blocks(spark, sf):
    """The same from stored blocks, of which those without the terms' trigrams are not read."""
    return search.store_search(A.prepared(spark, sf).items, rows=200).search(" Gear，BRAND#1, ,").select("id")


@query("e05_keyword_search_columns", f"WITH {CAT} SELECT id FROM cat WHERE (contains(lower(title), 'gear') OR contains(lower(tags), 'gear')) AND (contains(lower(author), 'brand#1') OR contains(lower(title), 'brand#1'))")
def e05(spark, sf):
    return filters.keyword_search_columns(A.small_catalogue(spark, sf), "Gear,BRAND#1", ("title", "tags", "author", "team")).select("id")


@query("e06_is_web_link", f"WITH {CAT} SELECT id, p_partkey % 3 <> 0 AS web FROM cat")
def e06(spark, sf):
    df = A.small_catalogue(spark, sf)
    return df.select("id", T.is_web_link(F.when(F.col("id").startswith("JM"), F.concat(F.lit("ftp://"), "link")).otherwise(F.concat(F.lit(" 　"), F.upper("link")))).alias("web"))


@query("g01_sort_catalogue", f"WITH {SCORED} SELECT id, score, row_number() OVER (ORDER BY score DESC, upload_date DESC, id) AS place FROM scored")
def g01(spark, sf):
    """All rows with their place."""
    return rank.with_place(_scored(spark, sf)).select("id", "score", "place")


@query("g02_page", f"WITH {SCORED} SELECT id, score FROM scored ORDER BY score DESC, upload_date DESC, id LIMIT 200 OFFSET 400")
def g02(spark, sf):
    return rank.page(_scored(spark, sf), rank.sort_order(), 2, 200).select("id", "score")


@query("g03_page_ranges", "WITH n AS (SELECT count(*) AS n FROM part) SELECT CAST(i AS INTEGER) AS page_index, (i * 300) || ' ~ ' || (least(i * 300 + 300, n) - 1) AS label FROM n, range(CAST((SELECT ceil(n / 300) FROM n) AS BIGINT)) r(i)")
def g03(spark, sf):
    return rank.page_ranges(A.small_catalogue(spark, sf), 300)


@query("g04_top_features", f"WITH {FREQ} SELECT * FROM (SELECT * FROM tagf ORDER BY freq DESC, feature LIMIT 15)")
def g04(spark, sf):
    return rank.top_features(A.prepared(spark, sf).freqs.tags, 15)


@query("g05_history_top_features", f"WITH {HIST} SELECT feature, n AS freq FROM hcount WHERE facet = 'tag' ORDER BY n DESC, feature LIMIT 15")
def g05(spark, sf):
    return rank.history_top_features(_history(spark, sf), "tag", 15)


_ENTRY = "opened_at, action, id, title, author, link, local_path, array_to_string(tags, '|') AS tags, array_to_string(title_words, '|') AS title_words"


def _flat(df):
    return df.withColumns({"tags": F.array_join("tags", "|"), "title_words": F.array_join("title_words", "|")})


@query("h01_history_entries", f"WITH {HIST} SELECT {_ENTRY} FROM entries")
def h01(spark, sf):
    return _flat(history.history_entries(A.opens(spark, sf), A.prepared(spark, sf).items))


@query("h02_click_log_entries", f"""WITH {CAT}, {OPENS}, r AS (SELECT o.event_id, o.opened_at, CASE WHEN o.event_id % 9 = 0 THEN 'unknown' ELSE o.id END AS token, CASE o.event_id % 4 WHEN 0 THEN 'ftp://x' WHEN 1 THEN '' ELSE 'https://t.example/a b?c=' || o.event_id END AS target FROM opens o WHERE o.event_id % 10 <> 3)
SELECT r.event_id, r.opened_at, r.token, c.id IS NOT NULL AS known, CASE WHEN c.id IS NOT NULL THEN 'network_link' END AS action, CASE WHEN r.target LIKE 'https://%' THEN r.target ELSE c.link END AS redirect, c.title FROM r LEFT JOIN cat c ON c.id = r.token""")
def h02(spark, sf):
    target = F.expr("CASE event_id % 4 WHEN 0 THEN 'ftp://x' WHEN 1 THEN '' ELSE concat('https://t.example/a b?c=', event_id) END")
    path = F.concat(F.when(F.col("event_id") % 10 == 3, "/other?token=").otherwise("/open?token="), F.when(F.col("event_id") % 9 == 0, "unknown").otherwise(F.col("id")), F.lit("&target="), F.url_encode(target))
    requests = A.opens(spark, sf).select("opened_at", path.alias("path"), "event_id")
    found = history.click_log_entries(requests, A.prepared(spark, sf).items, ("event_id",))
    return found.select("event_id", "opened_at", "token", "known", "action", "redirect", "title")


@query("h03_last_n", f"WITH {OPENS} SELECT user_id, event_id, opened_at, id FROM opens QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY opened_at DESC, event_id DESC) <= 50")
def h03(spark, sf):
    opens = A.opens(spark, sf).withColumn("title", F.lit(""))
    return history.last_n(opens, 50, "user_id", ("event_id",)).select("user_id", "event_id", "opened_at", "id")


@query("h04_history_counts", f"WITH {HIST} SELECT * FROM hcount")
def h04(spark, sf):
    return history.history_counts(_history(spark, sf))


@query("h05_stream_history", f"WITH {HIST} SELECT user_id, event_id, opened_at, id, title FROM entries QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY opened_at DESC, event_id DESC) <= 5")
def h05(spark, sf):
    """Opens in several files, taken in micro batches; the last five of each user."""
    source, state, marks = (scratch(spark, n) for n in ("opens", "state", "marks"))
    opens = A.opens(spark, sf)
    opens.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(opens.schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream_history(stream, A.prepared(spark, sf).items, state, marks, 5, "user_id", ("event_id",)).awaitTermination()
    return read_state(spark, state).select("user_id", "event_id", "opened_at", "id", "title")


@query("i01_sample_context")
def i01(spark, sf):
    return context.sample_context(_scored(spark, sf), 50, 7).select("id", "score")


@query("i02_format_context", f"WITH {SCORED}, few AS (SELECT * FROM scored ORDER BY score DESC, upload_date DESC, id LIMIT 20) SELECT '### 当前选中的参考库存数据：' || chr(10) || string_agg('- ID: ' || id || ' | 标题: ' || title || ' | 作者: ' || author || ' | 标签: ' || tags || ' | 评分: ' || score || ' | 链接: ' || link || chr(10), '' ORDER BY score DESC, id) AS context FROM few")
def i02(spark, sf):
    return context.format_context(rank.page(_scored(spark, sf), rank.sort_order(), 0, 20))


@query("i03_split_reasoning", """WITH m AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Thinking Process: a ' || text || ' </think> b ' || text WHEN 1 THEN '<think>' || text WHEN 2 THEN text ELSE '<think>x</think> y </think> z' END AS reply, trim(text) AS t, text FROM conversations)
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN trim('a ' || text) WHEN 1 THEN t WHEN 2 THEN '' ELSE 'x' END AS think, CASE turn % 4 WHEN 0 THEN trim('b ' || text) WHEN 1 THEN '' WHEN 2 THEN text ELSE 'y' END AS answer FROM m""")
def i03(spark, sf):
    reply = F.expr("CASE turn % 4 WHEN 0 THEN concat('Thinking Process: a ', text, ' </think> b ', text) WHEN 1 THEN concat('<think>', text) WHEN 2 THEN text ELSE '<think>x</think> y </think> z' END")
    return context.split_reasoning(A.table(spark, sf, "conversations").select("conv_id", "turn", reply.alias("reply")), "reply").drop("reply")
