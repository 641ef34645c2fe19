"""Queries of cleaning (B) and features (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon import adapters as A
from quillon.functions import text as T
from quillon.operators import clean, features
from quillon.queries.base import CAT, FEAT, FREQ, query
from quillon.sources.buckets import bucket_of

COLUMNS = "id, link, file_name, title, tags, author, team, language, pages, upload_date"


def _dirty(spark, sf):
    """Rows with missing ids, padded ids, empty titles and repeated ids."""
    df = A.small_catalogue(spark, sf).withColumn("n", F.regexp_extract("link", r"(\d+)/$", 1).cast("long"))
    return df.withColumns({
        "id": F.when(F.col("n") % 4 == 0, F.lit(None)).when(F.col("n") % 4 == 1, F.concat(F.lit("　 "), "id", F.lit("\t"))).when(F.col("n") % 4 == 2, "NH1").otherwise(F.col("id")),
        "title": F.when(F.col("n") % 6 == 0, "").otherwise(F.col("title")), "team": F.when(F.col("n") % 3 == 0, F.lit(None)).otherwise(F.col("team")),
    })


DIRTY = CAT + """, dirty AS (
  SELECT p_partkey AS n, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 2 THEN 'NH1' ELSE id END AS id, link, file_name, CASE WHEN p_partkey % 6 = 0 THEN '' ELSE title END AS title, tags, author,
    CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE team END AS team, language, pages, upload_date FROM cat)"""
RESOLVED = """coalesce(id, CASE WHEN regexp_extract(link, '/g/(\\d+)', 1) <> '' THEN 'NH' || regexp_extract(link, '/g/(\\d+)', 1) ELSE 'JM' || regexp_extract(link, '/album/(\\d+)', 1) END)"""


@query("b01_resolve_id", f"WITH {DIRTY} SELECT n, {RESOLVED} AS id FROM dirty")
def b01(spark, sf):
    return _dirty(spark, sf).select("n", T.resolve_id(F.col("id"), F.col("link")).alias("id"))


@query("b02_normalise_catalogue", f"""WITH {DIRTY}, named AS (SELECT n, {RESOLVED} AS id, link, file_name, CASE WHEN title = '' THEN file_name ELSE title END AS title, tags, author, coalesce(team, '') AS team, language, pages, upload_date FROM dirty)
SELECT {COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n) AS r FROM named) WHERE r = 1""")
def b02(spark, sf):
    return clean.normalise_catalogue(_dirty(spark, sf), ["n"])


@query("b03_title_fallback", f"WITH {DIRTY} SELECT n, CASE WHEN title = '' THEN file_name ELSE title END AS title FROM dirty")
def b03(spark, sf):
    return clean.title_fallback(_dirty(spark, sf)).select("n", "title")


@query("b04_dedupe_first", f"WITH {CAT} SELECT author, id, tags FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY upload_date, id) AS r FROM cat) WHERE r = 1")
def b04(spark, sf):
    return clean.dedupe_first(A.small_catalogue(spark, sf), "author", ["upload_date", "id"]).select("author", "id", "tags")


_PIECES = "list_filter(list_transform(string_split(tags, ','), lambda x: trim(x)), lambda x: x <> '')"


@query("b05_move_language_tags", f"""WITH {CAT}, t AS (SELECT id, {_PIECES} AS p, list_filter([language], lambda x: x <> '') AS l FROM cat), m AS (SELECT *, list_filter(p, lambda x: x IN ('small', 'red', 'hot')) AS moved FROM t)
SELECT id, array_to_string(list_filter(p, lambda x: x NOT IN ('small', 'red', 'hot')), ', ') AS tags, array_to_string(list_concat(l, list_transform(list_sort(list_transform(list_distinct(moved), lambda x: {{'p': list_position(moved, x), 'x': x}})), lambda s: s.x)), ', ') AS language FROM m""")
def b05(spark, sf):
    return clean.move_language_tags(A.small_catalogue(spark, sf), ("small", "red", "hot")).select("id", "tags", "language")


@query("b06_normalise_date", f"WITH {CAT} SELECT id, CASE WHEN p_partkey % 3 = 0 THEN 'none' ELSE upload_date END AS upload_date, upload_date AS stamp FROM cat")
def b06(spark, sf):
    df = A.small_catalogue(spark, sf)
    noisy = F.when(F.col("id").startswith("JM"), " none　").otherwise(F.concat(F.lit("上架: "), "upload_date", F.lit(" 10:00")))
    return df.select("id", T.normalise_date(noisy).alias("upload_date"), T.stamp_date(F.concat("upload_date", F.lit("T10:00:00Z"))).alias("stamp"))


@query("b07_split_join_items", f"""WITH {CAT}, t AS (SELECT id, {_PIECES} AS p FROM cat)
SELECT id, len(p) AS n, array_to_string(list_transform(list_sort(list_transform(list_distinct(p), lambda x: {{'p': list_position(p, x), 'x': x}})), lambda s: s.x), ', ') AS joined FROM t""")
def b07(spark, sf):
    items = T.split_items(F.col("tags"))
    return A.small_catalogue(spark, sf).select("id", F.size(items).cast("long").alias("n"), T.join_unique(items).alias("joined"))


@query("b08_attach_file_names", f"WITH {CAT} SELECT id, CASE WHEN p_partkey % 2 = 0 THEN 'named ' || p_partkey ELSE '' END AS file_name FROM cat")
def b08(spark, sf):
    df = A.small_catalogue(spark, sf).withColumn("n", F.regexp_extract("link", r"(\d+)/$", 1).cast("long"))
    marks = df.where("n % 2 = 0").select("link", F.concat(F.lit("named "), "n").alias("file_name"))
    return clean.attach_file_names(df, marks).select("id", "file_name")


@query("b09_backfill_id_from_link", f"WITH {CAT} SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN id WHEN p_partkey % 3 = 0 THEN 'JM' || p_partkey ELSE 'NH' || p_partkey || '/x' END AS id FROM cat")
def b09(spark, sf):
    df = A.small_catalogue(spark, sf).withColumn("p_partkey", F.regexp_extract("link", r"(\d+)/$", 1).cast("long"))
    df = df.withColumn("link", F.when(F.col("link").contains("/g/"), F.concat("link", F.lit("x/"))).otherwise(F.col("link")))
    return clean.backfill_id_from_link(df.withColumn("id", F.when(F.col("p_partkey") % 2 == 0, F.col("id")))).select("p_partkey", "id")


@query("b10_conform_raw", f"WITH {CAT} SELECT CASE WHEN p_partkey % 3 = 0 THEN 'JM' || p_partkey ELSE '' END AS id, link, title, array_to_string({_PIECES}, ', ') AS tags, upload_date FROM cat")
def b10(spark, sf):
    return clean.conform_raw(A.small_catalogue(spark, sf), "JM").select("id", "link", "title", "tags", "upload_date")


@query("b11_sanitise_name", f"WITH {CAT} SELECT id, replace(replace(link, '/', '_'), ':', '_') AS name FROM cat")
def b11(spark, sf):
    return A.small_catalogue(spark, sf).select("id", T.sanitise_name(F.col("link")).alias("name"))


@query("b12_search_text", f"WITH {FEAT} SELECT id, search_text FROM feat")
def b12(spark, sf):
    return clean.with_search_text(A.small_catalogue(spark, sf)).select("id", "search_text")


@query("b13_encode_covers", f"WITH {CAT} SELECT id, 'data:image/' || (CASE WHEN p_partkey % 2 = 0 THEN 'jpeg' ELSE 'png' END) || ';base64,' || base64(encode(repeat(tags, 3))) AS data_uri FROM cat WHERE p_partkey % 10 <> 0")
def b13(spark, sf):
    df = A.small_catalogue(spark, sf).withColumn("n", F.regexp_extract("link", r"(\d+)/$", 1).cast("long"))
    path = F.concat(F.lit("/covers/"), "id", F.when(F.col("n") % 2 == 0, ".jpg").otherwise(".PNG"))
    return clean.encode_covers(df.select(path.alias("path"), F.encode(F.repeat("tags", 3), "UTF-8").alias("content")), df.where("n % 10 = 0").select("id"))


@query("b14_resolve_cover", f"WITH {CAT} SELECT id, CASE WHEN p_partkey % 2 = 0 THEN 'cached' WHEN p_partkey % 3 = 0 THEN 'online' WHEN p_partkey % 5 = 0 THEN 'local' END AS cover FROM cat")
def b14(spark, sf):
    df = A.small_catalogue(spark, sf).withColumn("n", F.regexp_extract("link", r"(\d+)/$", 1).cast("long"))
    found = [df.where(f"n % {k} = 0").select("id", F.lit(v).alias("data_uri")) for k, v in ((2, "cached"), (3, "online"), (5, "local"))]
    return clean.resolve_cover(df, *found).select("id", "cover")


@query("c01_parse_tags", f"WITH {FEAT} SELECT id, array_to_string(parsed_tags, '|') AS parsed_tags FROM feat")
def c01(spark, sf):
    d = A.DICTIONARIES
    return features.parse_tags(A.small_catalogue(spark, sf), d.stop_tags, d.tag_map).select("id", F.array_join("parsed_tags", "|").alias("parsed_tags"))


@query("c01_parse_tags_joined", f"WITH {FEAT} SELECT id, array_to_string(parsed_tags, '|') AS parsed_tags FROM feat")
def c01_joined(spark, sf):
    d = A.DICTIONARIES
    stops = spark.createDataFrame([(x,) for x in sorted(d.stop_tags)], "term string")
    maps = spark.createDataFrame(list(d.tag_map.items()), "term string, mapped string")
    return features.parse_tags_joined(A.small_catalogue(spark, sf), stops, maps).select("id", F.array_join("parsed_tags", "|").alias("parsed_tags"))


@query("c02_tokenize_titles", "SELECT doc_id, len(t) AS n, array_to_string(t, '|') AS surfaces FROM (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), '\\[.*?\\]', '', 'g'), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM documents)")
def c02(spark, sf):
    """Whole texts of documents as titles."""
    docs = A.table(spark, sf, "documents").select("doc_id", F.col("text").alias("title"))
    return features.tokenize_titles(docs).select("doc_id", F.size("tokens").cast("long").alias("n"), F.array_join(F.transform("tokens", lambda t: t["surface"]), "|").alias("surfaces"))


@query("c03_title_words", f"WITH {FEAT} SELECT id, array_to_string(title_words, '|') AS title_words FROM feat")
def c03(spark, sf):
    return A.prepared(spark, sf).items.select("id", F.array_join("title_words", "|").alias("title_words"))


@query("c04_feature_counts", f"WITH {FEAT} SELECT id, feature, count(*) AS cnt, round(any_value(norm), 4) AS norm FROM (SELECT id, unnest(parsed_tags) AS feature, sqrt(greatest(len(parsed_tags), 1)) AS norm FROM feat) GROUP BY 1, 2")
def c04(spark, sf):
    return features.feature_counts(A.prepared(spark, sf).items, "parsed_tags").withColumn("norm", F.round("norm", 4))


@query("c05_frequencies", f"WITH {FREQ} SELECT 'tag' AS facet, * FROM tagf UNION ALL SELECT 'title_word', * FROM wordf")
def c05(spark, sf):
    f = A.prepared(spark, sf).freqs
    return f.tags.select(F.lit("tag").alias("facet"), "*").unionByName(f.words.select(F.lit("title_word").alias("facet"), "*"))


@query("c06_author_frequency", f"WITH {FREQ} SELECT * FROM authf")
def c06(spark, sf):
    return A.prepared(spark, sf).freqs.authors


@query("c07_base_scores", f"WITH {FREQ} SELECT feature, freq, round(ln(1 + freq) * 10, 4) AS base FROM tagf")
def c07(spark, sf):
    return features.base_scores(A.prepared(spark, sf).freqs.tags).withColumn("base", F.round("base", 4))


@query("c08_unmapped_tags", f"WITH {CAT}, t AS (SELECT DISTINCT unnest({_PIECES}) AS tag FROM cat), u AS (SELECT tag FROM t WHERE tag NOT IN ('small', 'red', 'STANDARD', 'size 1')) SELECT tag, (SELECT count(*) FROM u) AS n_unmapped FROM u")
def c08(spark, sf):
    terms = spark.createDataFrame([(x,) for x in A.DICTIONARIES.tag_map], "term string")
    return features.unmapped_tags(A.small_catalogue(spark, sf), terms)


@query("c09_title_word_report", f"WITH {FREQ} SELECT * FROM wordf")
def c09(spark, sf):
    return features.title_word_report(A.small_catalogue(spark, sf), A.DICTIONARIES.stop_words, A.DICTIONARIES.word_map)


_MAP = "m AS (SELECT DISTINCT p_name AS term, split_part(p_name, ' ', 2) AS mapped FROM part)"


@query("c10_disambiguate_map", f"WITH {_MAP} SELECT term, mapped || '(' || first_value(term) OVER (PARTITION BY mapped ORDER BY term) || ')' AS mapped FROM m")
def c10(spark, sf):
    maps = A.table(spark, sf, "part").select(F.col("p_name").alias("term"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("mapped")).distinct()
    return features.disambiguate_map(maps.withColumn("pos", F.col("term"))).drop("pos")


@query("c11_facet_values", f"WITH {FREQ} SELECT feature FROM tagf")
def c11(spark, sf):
    return features.facet_values(A.prepared(spark, sf).freqs.tags)


@query("c12_catalogue_metrics", f"WITH {FREQ} SELECT (SELECT count(*) FROM feat WHERE team = 'team 3') AS n_items, (SELECT count(*) FROM authf) AS n_authors, (SELECT count(*) FROM tagf) AS n_tags, (SELECT count(*) FROM wordf) AS n_title_words")
def c12(spark, sf):
    p = A.prepared(spark, sf)
    return features.catalogue_metrics(p.items.where("team = 'team 3'"), p.freqs.authors, p.freqs.tags, p.freqs.words)


@query("c12_approximate_metrics")
def c12_approximate(spark, sf):
    """The counts of the whole catalogue from sketches of hash buckets, merged."""
    items = A.prepared(spark, sf).items
    return features.approximate_metrics(features.facet_sketches(items.withColumn("bucket", bucket_of("id", 16)), "bucket"))
