"""Queries of sources (A), vectors (F), matching (J), plans (K) and pages (L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon import adapters as A
from quillon.functions import text as T
from quillon.operators import matching, pages, vectors
from quillon.plans import preprocess as plans
from quillon.queries.base import CAT, FREQ, OPENS, query
from quillon.schema import CATALOGUE
from quillon.sources import files, scratch
from quillon.sources.scratch import stored

COLUMNS = ", ".join(CATALOGUE)


@query("a01_read_catalogue_csv", f"WITH {CAT} SELECT {COLUMNS.replace('team', 'CASE WHEN p_partkey % 2 = 0 THEN team ELSE CAST(NULL AS VARCHAR) END AS team')} FROM cat".replace("ELSE CAST(NULL AS VARCHAR) END", "ELSE '' END"))
def a01(spark, sf):
    """The catalogue in two folders of files of different headers, read back."""
    path = files.scratch(spark, "csv")
    df = A.small_catalogue(spark, sf).withColumn("n", F.regexp_extract("link", r"(\d+)/$", 1).cast("long"))
    df.where("n % 2 = 0").select(*CATALOGUE).write.option("header", True).option("escape", '"').mode("append").csv(path)
    df.where("n % 2 = 1").select(*[c for c in reversed(CATALOGUE) if c != "team"]).write.option("header", True).option("escape", '"').mode("append").csv(path)
    return files.read_catalogue_csv(spark, path).select(*CATALOGUE)


@query("a02_read_bookmarks", f"WITH {CAT} SELECT link, 'Tom & ' || file_name AS file_name FROM cat")
def a02(spark, sf):
    path = files.scratch(spark, "marks")
    A.small_catalogue(spark, sf).select(F.concat(F.lit('<DT><A HREF="'), "link", F.lit('" ADD_DATE="1">Tom &amp; '), "file_name", F.lit("</A> <A>x</A>"))).write.text(path)
    return files.read_bookmarks(spark, path)


@query("a03_read_link_list", f"WITH {CAT} SELECT link FROM cat WHERE p_partkey % 3 <> 0")
def a03(spark, sf):
    path = files.scratch(spark, "links")
    A.small_catalogue(spark, sf).select(F.concat(F.lit("see "), "link", F.lit(" and more"))).write.text(path)
    return files.read_link_list(spark, path, r"https://example\.org/g/\d+/").select("link")


@query("a04_read_word_set", "SELECT DISTINCT p_name AS term FROM part")
def a04(spark, sf):
    path = files.scratch(spark, "words")
    A.table(spark, sf, "part").select(F.concat(F.lit("'"), "p_name", F.lit("', x"))).coalesce(1).write.text(path)
    return files.read_word_set(spark, path)


@query("a05_read_semantic_map", "SELECT p_name AS term, CAST(max(p_partkey) AS VARCHAR) AS mapped FROM part GROUP BY 1")
def a05(spark, sf):
    path = files.scratch(spark, "map")
    last = A.table(spark, sf, "part").groupBy("p_name").agg(F.max("p_partkey").cast("string").alias("v"))
    last.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("p_name", "v"))))).write.text(path)
    return files.read_semantic_map(spark, path).select("term", "mapped")


def _stored(spark, sf):
    path = files.scratch(spark, "catalogue")
    files.write_catalogue(A.small_catalogue(spark, sf), path)
    return path


@query("a06_read_catalogue", f"WITH {CAT} SELECT {COLUMNS} FROM cat")
def a06(spark, sf):
    return files.read_catalogue(spark, _stored(spark, sf), require_id=True)


@query("a07_write_catalogue", f"WITH {CAT} SELECT {COLUMNS} FROM cat")
def a07(spark, sf):
    """Every row twice, the second with another title: the first of each id stays."""
    path = files.scratch(spark, "catalogue")
    df = A.small_catalogue(spark, sf)
    twice = df.withColumn("n", F.lit(1)).unionByName(df.withColumn("title", F.lit("later")).withColumn("n", F.lit(2)))
    files.write_catalogue(twice, path, ["n"])
    return spark.read.parquet(path)


@query("a08_upsert_catalogue", f"WITH {CAT} SELECT id, CASE WHEN p_partkey % 3 = 1 THEN 'new' ELSE title END AS title FROM cat UNION ALL SELECT 'added ' || id, 'new' FROM cat WHERE p_partkey % 3 = 1")
def a08(spark, sf):
    df = A.small_catalogue(spark, sf)
    part = df.where("regexp_extract(link, '([0-9]+)/$', 1) % 3 = 1").withColumn("title", F.lit("new"))
    batch = part.unionByName(part.withColumn("id", F.concat(F.lit("added "), "id")))
    return files.upsert_catalogue(df, batch).select("id", "title")


@query("a08_upsert_buckets", f"WITH {CAT} SELECT id, CASE WHEN p_partkey % 3 = 1 THEN 'new' ELSE title END AS title FROM cat UNION ALL SELECT 'added ' || id, 'new' FROM cat WHERE p_partkey % 3 = 1")
def a08_buckets(spark, sf):
    """The same in a table of hash buckets, merged twice."""
    path, df = files.scratch(spark, "buckets"), A.small_catalogue(spark, sf)
    part = df.where("regexp_extract(link, '([0-9]+)/$', 1) % 3 = 1").withColumn("title", F.lit("new"))
    files.upsert_buckets(df, path, number=8)
    files.upsert_buckets(part.unionByName(part.withColumn("id", F.concat(F.lit("added "), "id"))), path)
    return files.read_buckets(spark, path).select("id", "title")


@query("a09_history_files", f"WITH {OPENS} SELECT opened_at, id, 't' AS title FROM opens ORDER BY opened_at DESC LIMIT 50")
def a09(spark, sf):
    path = files.scratch(spark, "history")
    files.write_history(A.opens(spark, sf).select("opened_at", "action", "id", F.lit("t").alias("title")), path, 80)
    return files.read_history(spark, path, 50).select("opened_at", "id", "title")


@query("a10_vector_files", "SELECT (CASE WHEN vec_id % 3 = 0 THEN 'JM' ELSE 'NH' END) || vec_id AS id, CAST(i AS INTEGER) AS place, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) r(i)")
def a10(spark, sf):
    path = files.scratch(spark, "vectors")
    files.write_vectors(A.vectors(spark, sf), path)
    return files.read_vectors(spark, path).select("id", F.posexplode("embedding").alias("place", "x")).select("id", (F.col("place") + 1).alias("place"), F.col("x").cast("double").alias("x"))


@query("a11_list_images", "SELECT DISTINCT 'region=' || label AS source, 1 AS n, len(CAST(label AS VARCHAR)) AS bytes FROM embeddings")
def a11(spark, sf):
    """One file a label, in a folder each."""
    path = files.scratch(spark, "images")
    labels = A.table(spark, sf, "embeddings").select("label").distinct()
    labels.select(F.col("label").cast("string").alias("value"), F.col("label").alias("region")).repartition(1).write.partitionBy("region").option("lineSep", "\x00").text(path)
    folders = [f"{path}/region={r[0]}" for r in labels.collect()]
    manifest = files.list_images(spark, folders, extensions=("txt",))
    return manifest.groupBy("source").agg(F.count("*").alias("n"), (F.sum("size") - F.count("*")).alias("bytes"))


@query("a12_export_term_report", f"WITH {FREQ} SELECT feature, freq FROM tagf WHERE feature <> ''")
def a12(spark, sf):
    path = files.scratch(spark, "report")
    files.export_term_report(A.prepared(spark, sf).freqs.tags, path)
    return spark.read.csv(path, header=True, schema="feature string, freq long").where("feature IS NOT NULL")


@query("a13_failed_pages", "SELECT CAST(event_id % 97 AS INTEGER) AS page, min(event_id) AS first_line FROM events WHERE event_type = 'error' GROUP BY 1")
def a13(spark, sf):
    lines = A.table(spark, sf, "events").selectExpr("event_id AS line_no", "if(event_type = 'error', concat('[页数: ', event_id % 97, ', ID: NH1] failed'), 'fine') AS value")
    return files.failed_pages(lines, files.FAILED_PATTERNS[0])


_DOC = "'标题《' || title || '》，作者 ' || author || '，团队 ' || team || '，语言 ' || language || '，元素标签：' || tags || '。'"


@query("f01_semantic_documents", f"WITH {CAT} SELECT id, substring({_DOC}, 1, 800) AS document FROM cat")
def f01(spark, sf):
    return vectors.semantic_documents(A.small_catalogue(spark, sf))


@query("f02_embed")
def f02(spark, sf):
    docs = vectors.semantic_documents(A.small_catalogue(spark, sf))
    return vectors.embed(docs, "document", vectors.hashing_encoder(32)).select("id", F.transform("embedding", lambda x: F.round(x.cast("double"), 4)).alias("embedding"))


@query("f03_l2_normalise", "SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 4) AS norm, round(e[1] / sqrt(list_sum(list_transform(e, lambda x: x * x))), 4) AS first FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3) AS e FROM embeddings)")
def f03(spark, sf):
    from quillon.functions.text import l2_normalise

    df = A.table(spark, sf, "embeddings").withColumn("e", F.transform("embedding", lambda x: x.cast("double") * 3))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x))
    return df.select("vec_id", F.round(norm, 4).alias("norm"), F.round(l2_normalise(F.col("e"))[0], 4).alias("first"))


_VECS = "v AS (SELECT (CASE WHEN vec_id % 3 = 0 THEN 'JM' ELSE 'NH' END) || vec_id AS id, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT e AS q FROM v WHERE vec_id = 0)"


@query("f04_semantic_topk", f"WITH {CAT}, {_VECS} SELECT v.id, round(list_cosine_similarity(e, q) * 100, 4) AS semantic_score FROM v JOIN cat ON cat.id = v.id, q WHERE cat.team <> 'team 3' ORDER BY list_cosine_similarity(e, q) DESC, v.id LIMIT 100")
def f04(spark, sf):
    items = A.small_catalogue(spark, sf).where("team <> 'team 3'")
    return vectors.semantic_topk(items, A.vectors(spark, sf), A.query_vector(spark, sf), 100).withColumn("semantic_score", F.round("semantic_score", 4))


@query(
    "f04_semantic_topk_queries",
    f"WITH {CAT}, {_VECS}, s AS (SELECT a.id AS query_id, v.id, round(list_cosine_similarity(v.e, a.e) * 100, 6) AS score FROM v JOIN cat ON cat.id = v.id, v a WHERE cat.team <> 'team 3' AND a.vec_id % 20 = 0) "
    "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score AS semantic_score FROM s QUALIFY rank <= 100",
)
def f04_queries(spark, sf):
    """The hundred items nearest to each vector whose number is divisible by 20, of all vectors."""
    items, found = A.small_catalogue(spark, sf).where("team <> 'team 3'"), A.vectors(spark, sf)
    best = vectors.semantic_topk_queries(items, found, found.where("pos % 20 = 0").select(F.col("id").alias("query_id"), "embedding"), 100)
    return best.select("query_id", F.col("rank").cast("long").alias("rank"), "id", "semantic_score")


_TOP5000 = (
    f"WITH {_VECS}, s AS (SELECT a.id AS query_id, v.id, round(list_cosine_similarity(v.e, a.e) * 100, 6) AS score FROM v, v a WHERE a.vec_id % 20 = 0) "
    "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score AS semantic_score FROM s QUALIFY rank <= 5000"
)


@query("f04_semantic_topk_5000", _TOP5000)
def f04_5000(spark, sf):
    """The 5000 vectors nearest to each whose number is divisible by 20, of all vectors."""
    found = A.vectors(spark, sf)
    best = vectors.semantic_topk_queries(found.select("id"), found, found.where("pos % 20 = 0").select(F.col("id").alias("query_id"), "embedding"))
    return best.select("query_id", F.col("rank").cast("long").alias("rank"), "id", "semantic_score")


_IMAGES = """img AS (SELECT vec_id, '/images/' || vec_id || '.jpg' AS path, (CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END) AS source, vec_id || '.jpg' AS name, CASE WHEN vec_id % 100 = 99 THEN ' ' ELSE 'IT' || (vec_id // 5) END AS item_id,
  vec_id * 3 AS size, vec_id * 1000 AS mtime_ns, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"""
_MEANS = _IMAGES + """, places AS (SELECT item_id, i, avg(e[i] / sqrt(list_sum(list_transform(e, lambda x: x * x)))) AS x FROM img, range(1, 65) r(i) WHERE trim(item_id) <> '' GROUP BY 1, 2),
norms AS (SELECT item_id, sqrt(sum(x * x)) AS n FROM places GROUP BY 1), means AS (SELECT item_id, list(x / n ORDER BY i) AS m FROM places JOIN norms USING (item_id) GROUP BY 1)"""


@query("f05_item_vectors", f"WITH {_MEANS} SELECT item_id, CAST(i AS INTEGER) AS place, round(m[i], 4) + 0.0 AS x FROM means, range(1, 65) r(i)")
def f05(spark, sf):
    v = vectors.item_vectors(A.images(spark, sf))
    return v.select("item_id", F.posexplode("embedding").alias("place", "x")).select("item_id", (F.col("place") + 1).alias("place"), F.round("x", 4).alias("x"))


@query("f06_cover_topk", f"WITH {_MEANS}, best AS (SELECT a.item_id AS id, list_dot_product(a.m, b.m) * 100 AS s FROM means a, means b WHERE b.item_id = 'IT7' AND a.item_id <> 'IT3' ORDER BY s DESC, id LIMIT 20) SELECT CAST(row_number() OVER (ORDER BY s DESC, id) AS INTEGER) AS rank, id, round(s, 4) AS cover_score FROM best")
def f06(spark, sf):
    v = vectors.item_vectors(A.images(spark, sf))
    candidates = v.where("item_id <> 'IT3'").select(F.concat(F.lit(" "), F.lower("item_id")).alias("id"))
    return vectors.cover_topk(v, " it7", candidates=candidates, k=20).withColumn("cover_score", F.round("cover_score", 4))


@query("f07_image_topk", f"WITH {_IMAGES}, best AS (SELECT i.*, list_dot_product(i.e, q.e) AS s FROM img i, img q WHERE q.vec_id = 0 AND i.source = 'odd' ORDER BY s DESC, i.path LIMIT 10) SELECT CAST(row_number() OVER (ORDER BY s DESC, path) AS INTEGER) AS rank, path, source, name, item_id, round(s, 4) AS score FROM best")
def f07(spark, sf):
    return vectors.image_topk(A.images(spark, sf), A.query_vector(spark, sf), 10, "odd").withColumn("score", F.round("score", 4))


@query(
    "f06_cover_topk_queries",
    f"WITH {_MEANS}, s AS (SELECT b.item_id AS query_id, a.item_id AS id, round(list_dot_product(a.m, b.m) * 100, 6) AS score FROM means a, means b WHERE CAST(substr(b.item_id, 3) AS BIGINT) % 20 = 0) "
    "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, round(score, 4) AS cover_score FROM s QUALIFY rank <= 20",
)
def f06_queries(spark, sf):
    """The twenty items nearest to each whose number is divisible by 20, of all items."""
    v = stored(vectors.item_vectors(A.images(spark, sf)), "item-vectors")
    best = vectors.cover_topk_queries(v, v.where("cast(substring(item_id, 3, 20) AS long) % 20 = 0").select(F.concat(F.lit(" "), F.lower("item_id")).alias("query_id")), k=20)
    return best.select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("cover_score", 4).alias("cover_score"))


@query(
    "f07_image_topk_queries",
    f"WITH {_IMAGES}, s AS (SELECT q.name AS query_id, i.path, i.source, i.name, i.item_id, round(list_dot_product(i.e, q.e), 6) AS s FROM img i, img q WHERE q.vec_id % 20 = 0 AND i.source = 'odd') "
    "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, path) AS rank, path, source, name, item_id, round(s, 4) AS score FROM s QUALIFY rank <= 10",
)
def f07_queries(spark, sf):
    """The ten images nearest to each whose number is divisible by 20, of all of a source."""
    index = A.images(spark, sf)
    asked = A.table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.concat("vec_id", F.lit(".jpg")).alias("query_id"), "embedding")
    best = vectors.image_topk_queries(index, asked, 10, "odd")
    return best.withColumns({"rank": F.col("rank").cast("long"), "score": F.round("score", 4)})


@query("f08_index_diff", f"WITH {_IMAGES} SELECT path, CASE WHEN vec_id % 11 = 0 THEN 'deleted' WHEN vec_id % 7 = 0 THEN 'add_or_update' ELSE 'unchanged' END AS status FROM img UNION ALL SELECT '/new' || path, 'add_or_update' FROM img WHERE vec_id % 13 = 0 AND vec_id % 11 <> 0")
def f08(spark, sf):
    return vectors.index_diff(A.images(spark, sf), A.new_images(spark, sf))


@query(
    "f09_refresh_index",
    f"WITH {_IMAGES}, new AS (SELECT path, source, CASE WHEN vec_id % 7 = 0 THEN size + 1 ELSE size END AS size, vec_id, e FROM img WHERE vec_id % 11 <> 0) "
    "SELECT path, source, size, CAST(len(e) AS INTEGER) AS dim, round(CASE WHEN vec_id % 7 = 0 THEN 1.0 ELSE list_sum(e) END, 4) AS total FROM new "
    "UNION ALL SELECT '/new' || path, source, vec_id * 3, 64, 1.0 FROM new WHERE vec_id % 13 = 0",
)
def f09(spark, sf):
    """Only changed and new images are encoded anew: a name of one word has a single component of 1, a kept vector its old components."""
    new = A.new_images(spark, sf).drop("embedding").withColumn("content", F.col("name"))
    out = vectors.refresh_index(A.images(spark, sf), new, vectors.hashing_encoder(64), "m", "m", order=("path",))
    return out.select("path", "source", "size", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("f10_index_stats", f"WITH {_IMAGES} SELECT source, count(*) AS images, CAST(max(len(e)) AS INTEGER) AS dimension FROM img GROUP BY 1 UNION ALL SELECT 'all', count(*), CAST(max(len(e)) AS INTEGER) FROM img")
def f10(spark, sf):
    return vectors.index_stats(A.images(spark, sf))


@query("f11_attach_similarity", f"WITH {CAT}, {_VECS}, best AS (SELECT v.id, round(list_cosine_similarity(e, q) * 100, 4) AS semantic_score FROM v, q ORDER BY list_cosine_similarity(e, q) DESC, v.id LIMIT 100) SELECT id, title, semantic_score FROM cat JOIN best USING (id)")
def f11(spark, sf):
    items = A.small_catalogue(spark, sf)
    found = vectors.semantic_topk(A.vectors(spark, sf).select("id"), A.vectors(spark, sf), A.query_vector(spark, sf), 100)
    return vectors.attach_similarity(items, found.withColumn("semantic_score", F.round("semantic_score", 4)), "semantic_score").select("id", "title", "semantic_score")


@query("j01_match_exact", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '/f/' || o_orderkey END AS local_path FROM orders")
def j01(spark, sf):
    """An order's name against the folders of every second order."""
    orders = A.table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("order "), "o_orderkey", F.lit(": "), "o_orderpriority").alias("file_name"))
    folders = orders.where("o_orderkey % 2 = 0").select(T.sanitise_name(F.col("file_name")).alias("folder_name"), F.concat(F.lit("/f/"), "o_orderkey").alias("path"), F.col("o_orderkey").alias("pos"))
    return matching.match_exact(orders, folders).select("o_orderkey", "local_path")


@query("j02_match_close")
def j02(spark, sf):
    """Every document's title without its first character and with a digit more, against the titles of all."""
    titles = A.titles(spark, sf)
    items = titles.select("doc_id", F.concat(F.substring("title", 2, 100), (F.col("doc_id") % 10).cast("string")).alias("file_name"))
    return matching.match_close(items, A.title_folders(titles)).select("doc_id", "file_name", "local_path")


@query("k01_fingerprint", f"WITH {CAT} SELECT md5('stamp|' || count(*) || '|' || max(id)) AS fingerprint FROM cat")
def k01(spark, sf):
    return plans.fingerprint(A.small_catalogue(spark, sf), ("stamp",))


_LOCAL = "CASE WHEN p_partkey % 3 <> 0 THEN '/f/' || p_partkey ELSE f.local_path END AS local_path"


def _with_folders(spark, sf):
    """The small catalogue, two thirds of it with a folder of their own; the names of the rest are like none."""
    df = A.small_catalogue(spark, sf).withColumn("n", F.regexp_extract("link", r"(\d+)/$", 1).cast("long"))
    df = df.withColumn("file_name", F.when(F.col("n") % 3 == 0, F.concat(F.lit("无無無無無無"), "n")).otherwise(F.col("file_name")))
    folders = df.where("n % 3 <> 0").select(F.col("file_name").alias("folder_name"), F.concat(F.lit("/f/"), "n").alias("path"), F.col("n").alias("pos"))
    return df.drop("n"), folders


@query("k02_preprocess", f"WITH {FREQ} SELECT f.id, {_LOCAL}, f.search_text, len(f.parsed_tags) AS n_tags, len(f.title_words) AS n_words, a.freq AS author_freq FROM feat f JOIN authf a ON a.feature = f.author")
def k02(spark, sf):
    df, folders = _with_folders(spark, sf)
    p = plans.preprocess(df, A.DICTIONARIES, folders)
    both = p.items.join(p.freqs.authors.withColumnsRenamed({"feature": "author", "freq": "author_freq"}), "author")
    return both.select("id", "local_path", "search_text", F.size("parsed_tags").cast("long").alias("n_tags"), F.size("title_words").cast("long").alias("n_words"), "author_freq")


@query("k02_preprocess_stored", f"WITH {FREQ} SELECT f.id, {_LOCAL}, f.search_text, len(f.parsed_tags) AS n_tags, len(f.title_words) AS n_words, a.freq AS author_freq FROM feat f JOIN authf a ON a.feature = f.author")
def k02_stored(spark, sf):
    """Features stored under the fingerprint of the catalogue, and taken from there the second time."""
    folder = files.scratch(spark, "prepared")
    df, folders = _with_folders(spark, sf)
    plans.preprocess_stored(df, A.DICTIONARIES, folder, folders)
    p = plans.preprocess_stored(df, A.DICTIONARIES, folder, folders)
    both = p.items.join(p.freqs.authors.withColumnsRenamed({"feature": "author", "freq": "author_freq"}), "author")
    return both.select("id", "local_path", "search_text", F.size("parsed_tags").cast("long").alias("n_tags"), F.size("title_words").cast("long").alias("n_words"), "author_freq")


@query("k02_preprocess_parts", f"WITH {FREQ} SELECT f.id, f.search_text, len(f.parsed_tags) AS n_tags, len(f.title_words) AS n_words, a.freq AS author_freq FROM feat f JOIN authf a ON a.feature = f.author")
def k02_parts(spark, sf):
    """Features in hash buckets: first of a catalogue of which some rows are other or missing, then of the whole one, for which only their buckets are worked out."""
    folder, df = files.scratch(spark, "parts"), A.small_catalogue(spark, sf)
    before = df.where("id NOT LIKE '%7'").withColumn("author", F.when(F.col("id").endswith("13"), "other").otherwise(F.col("author")))
    plans.preprocess_parts(before, A.DICTIONARIES, folder, number=16)
    p = plans.preprocess_parts(df, A.DICTIONARIES, folder)
    both = p.items.join(p.freqs.authors.withColumnsRenamed({"feature": "author", "freq": "author_freq"}), "author")
    return both.select("id", "search_text", F.size("parsed_tags").cast("long").alias("n_tags"), F.size("title_words").cast("long").alias("n_words"), "author_freq")


@query("w1_ingest", f"WITH {CAT} SELECT {COLUMNS} FROM cat WHERE p_partkey % 2 = 1 UNION ALL SELECT id, link, file_name, 'new title', tags, author, team, language, pages, upload_date FROM cat WHERE p_partkey % 2 = 0")
def w1(spark, sf):
    """Half of the catalogue comes again as raw CSV with other titles and no ids."""
    path = files.scratch(spark, "raw")
    df = A.small_catalogue(spark, sf)
    df.where("regexp_extract(link, '([0-9]+)/$', 1) % 2 = 0").withColumn("title", F.lit("new title")).drop("id").write.option("header", True).option("escape", '"').csv(path)
    return plans.ingest(files.read_catalogue_csv(spark, path), df)


BIG = """big AS (SELECT 'NH' || o_orderkey AS id, [c_mktsegment, n_name, o_orderpriority, 'status ' || o_orderstatus] AS tags, c_name AS author, regexp_split_to_array(n_name || ' ' || lower(c_mktsegment), '[^\\p{L}\\p{N}]+') AS words, strftime(o_orderdate, '%Y-%m-%d') AS upload_date
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
t AS (SELECT id, unnest(tags) AS x, sqrt(len(tags)) AS n FROM big), tf AS (SELECT x, count(*) AS f FROM t GROUP BY 1), w AS (SELECT id, unnest(list_filter(words, lambda y: y <> 'old')) AS x, sqrt(greatest(len(list_filter(words, lambda y: y <> 'old')), 1)) AS n FROM big), wf AS (SELECT x, count(*) AS f FROM w GROUP BY 1),
af AS (SELECT author AS x, count(*) AS f FROM big GROUP BY 1),
p AS (SELECT id, ln(1 + f) * 10 / n * 0.5 AS v FROM t JOIN tf USING (x) UNION ALL SELECT id, ln(1 + f) * 10 / n FROM w JOIN wf USING (x) UNION ALL SELECT id, ln(1 + f) * 10 * 5.0 FROM big JOIN af ON af.x = author),
s AS (SELECT id, CAST(trunc(round(sum(v), 6)) AS INTEGER) AS score FROM p GROUP BY 1)"""


def _view(spark, sf):
    """The large catalogue, scored: kept in this application's folder under the fingerprint of its cells, worked out anew when they change."""
    folder = f"{scratch.folder(spark)}/views"
    return plans.view_stored(plans.preprocess_stored(A.large_catalogue(spark, sf), A.DICTIONARIES, folder), folder)


@query("w2_recommend_page", f"WITH {BIG} SELECT id, score, author, upload_date FROM s JOIN big USING (id) ORDER BY score DESC, upload_date DESC, id LIMIT 500")
def w2(spark, sf):
    """The first page over the large catalogue, whose features and order are kept for further pages."""
    return _view(spark, sf).page().select("id", "score", "author", "upload_date")


@query("w2_deep_page", f"WITH {BIG} SELECT id, score FROM s JOIN big USING (id) ORDER BY score DESC, upload_date DESC, id LIMIT 500 OFFSET 5000")
def w2_deep(spark, sf):
    """A deep page of the same order: made now, or by w2_recommend_page before in this application."""
    return _view(spark, sf).page(page_index=10).select("id", "score")


_PAGE_RULES = (
    pages.Rule("title", ((("title", {}), "", None, "text"),)),
    pages.Rule("heading", ((("h2", {}), "", None, "text"), (("h1", {}), "", None, "text"))),
    pages.Rule("menu", ((("nav", {}), "", ("a", {}), "texts"),)),
)


@query("l01_extract_fields")
def l01(spark, sf):
    return pages.extract_fields(A.table(spark, sf, "pages"), _PAGE_RULES)


@query(
    "l02_extract_listing",
    "SELECT page_id, TRY_CAST(nullif(regexp_extract(url, '[?&]page=(\\d{1,9})', 1), '') AS INTEGER) AS page_no, CAST(1 AS INTEGER) AS position, 'JM' || page_id AS id, '/album/' || page_id || '/x' AS detail_url, '/t/' || page_id || '.jpg' AS thumb_url FROM pages",
)
def l02(spark, sf):
    """Stored pages, each with a list of the other layout put in front."""
    listed = F.format_string('<div class="list-col"><a href="/album/%d/x"><img data-original="/t/%d.jpg"></a></div><div class="list-col"><a href="/other">no</a></div>', "page_id", "page_id")
    return pages.extract_listing(A.table(spark, sf, "pages").select("page_id", "url", F.concat(listed, F.coalesce("html", F.lit(""))).alias("html")), pages.ALBUM_LIST)


@query("l03_pending_items", "SELECT 'JM' || page_id AS id, page_id % 2 <> 0 AS need_record, page_id % 3 <> 0 AND page_id % 5 <> 0 AS need_thumb FROM pages WHERE NOT (page_id % 2 = 0 AND page_id % 3 = 0)")
def l03(spark, sf):
    p = A.table(spark, sf, "pages").select("page_id", F.concat(F.lit("JM"), "page_id").alias("id"), F.when(F.col("page_id") % 5 == 0, "").otherwise("/t.jpg").alias("thumb_url"))
    return pages.pending_items(p, p.where("page_id % 2 = 0"), p.where("page_id % 3 = 0")).select("id", "need_record", "need_thumb")


