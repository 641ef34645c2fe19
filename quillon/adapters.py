"""The supplied tables as catalogue, history, vectors, images and clicks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.scoring import Multipliers, Weights
from quillon.plans.preprocess import Dictionaries, Prepared, preprocess

#: The dictionaries that the queries use.
DICTIONARIES = Dictionaries({"size 3", "hot"}, {"small": "little", "red": "crimson", "STANDARD": "regular", "size 1": "tiny"}, {"old"}, {"ring": "band", "bolt": "screw"})
MULTIPLIERS = Multipliers(1.2, 0.8, 1.1, 0.7)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer scan tasks than cores is dealt to all of them before row-wise work on its texts; a larger one stays as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's ten columns from part; every fifth row has a blank and a repeated tag."""
    return spread(table(spark, sf_dir, "part")).selectExpr(
        "concat(if(p_partkey % 3 = 0, 'JM', 'NH'), p_partkey) AS id",
        "concat('https://example.org/', if(p_partkey % 3 = 0, 'album', 'g'), '/', p_partkey, '/') AS link",
        "concat(p_name, ' ', p_partkey) AS file_name",
        "concat('[', p_brand, '] ', p_name) AS title",
        "concat(p_type, ', ', replace(p_name, ' ', ', '), ', size ', p_size % 7, if(p_partkey % 5 = 0, ', , red', '')) AS tags",
        "p_brand AS author",
        "concat('team ', p_partkey % 11) AS team",
        "CASE p_partkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'ja' WHEN 2 THEN 'zh' ELSE '' END AS language",
        "cast(p_size AS string) AS pages",
        "date_format(date_add(DATE '2020-01-01', cast(p_partkey % 1000 AS int)), 'yyyy-MM-dd') AS upload_date",
    )


def large_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue of many authors from orders, customer and nation."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    o = spread(o.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_orderdate"))
    both = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return both.selectExpr(
        "concat('NH', o_orderkey) AS id", "concat('https://example.org/g/', o_orderkey, '/') AS link", "'' AS file_name",
        "concat(n_name, ' ', lower(c_mktsegment)) AS title", "concat(c_mktsegment, ', ', n_name, ', ', o_orderpriority, ', status ', o_orderstatus) AS tags",
        "c_name AS author", "'' AS team", "'' AS language", "'' AS pages", "date_format(o_orderdate, 'yyyy-MM-dd') AS upload_date",
    )


def prepared(spark: SparkSession, sf_dir: str) -> Prepared:
    return preprocess(small_catalogue(spark, sf_dir), DICTIONARIES)


def opens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(opened_at, action, id, user_id, event_id) from clicks and views."""
    parts = table(spark, sf_dir, "part").count()
    found = table(spark, sf_dir, "events").where("event_type IN ('click', 'view')").withColumn("k", F.col("event_id") % parts)
    return found.selectExpr(
        "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") AS opened_at", "if(event_type = 'click', 'network_link', 'local_folder') AS action",
        "concat(if(k % 3 = 0, 'JM', 'NH'), k) AS id", "user_id", "event_id",
    )


def weights(spark: SparkSession) -> Weights:
    schema = "feature string, weight double"
    return Weights(
        spark.createDataFrame([("little", 2.5), ("crimson", -1.5), ("absent", 9.0)], schema),
        spark.createDataFrame([("Brand#2", 7.0)], schema),
        spark.createDataFrame([("band", 0.5), ("gear", -3.0)], schema),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, embedding, pos) by the small catalogue's ids."""
    return table(spark, sf_dir, "embeddings").selectExpr("concat(if(vec_id % 3 = 0, 'JM', 'NH'), vec_id) AS id", "embedding", "vec_id AS pos")


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"])


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image index: five images an item, two sources."""
    return table(spark, sf_dir, "embeddings").selectExpr(
        "concat('/images/', vec_id, '.jpg') AS path", "if(label % 2 = 0, 'even', 'odd') AS source", "concat(vec_id, '.jpg') AS name",
        "if(vec_id % 100 = 99, ' ', concat('IT', vec_id div 5)) AS item_id", "vec_id * 3 AS size", "vec_id * 1000 AS mtime_ns", "embedding",
    )


def new_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next snapshot: some changed, some gone, some new."""
    old = images(spark, sf_dir).withColumn("n", (F.col("size") / 3).cast("long")).where("n % 11 <> 0")
    changed = old.withColumn("size", F.when(F.col("n") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")))
    added = old.where("n % 13 = 0").withColumn("path", F.concat(F.lit("/new"), "path"))
    return changed.unionByName(added).drop("n")


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, title) of every document: its first twelve words, each written as one character of a large script, as in titles of Chinese characters."""
    words = F.slice(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+", 13), 1, 12)
    letter = F.transform(words, lambda w: F.decode(F.unhex(F.hex(F.lit(0x4E00) + F.pmod(F.hash(w), F.lit(20_000)))), "UTF-16BE"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(letter, "").alias("title"))


def title_folders(named: DataFrame) -> DataFrame:
    """A folder for every title."""
    return named.select(F.col("title").alias("folder_name"), F.concat(F.lit("/f/"), F.col("doc_id").cast("string")).alias("path"), F.col("doc_id").alias("pos"))
