from pyspark.sql import functions as F

from quillon.adapters import DICTIONARIES, small_catalogue
from quillon.operators import features
from quillon.plans import preprocess as plans
from quillon.sources import buckets

SF = "/root/testdata/sf0.001"


def same(a, b):
    names = sorted(a.items.columns)
    assert sorted(b.items.columns) == names
    for x, y in ((a.items.select(*names), b.items.select(*names)), (a.freqs.together().select("facet", "feature", "freq"), b.freqs.together().select("facet", "feature", "freq"))):
        assert sorted(map(str, x.collect())) == sorted(map(str, y.collect()))
    for facet in ("tags", "authors", "words"):
        assert sorted(map(str, getattr(a.freqs, facet).collect())) == sorted(map(str, getattr(b.freqs, facet).collect()))


def test_one_changed_row_rebuilds_one_bucket(spark, tmp_path):
    df, folder = small_catalogue(spark, SF), f"file://{tmp_path}"

    def files(name="items"):
        return {str(p.relative_to(tmp_path)) for p in (tmp_path / name / "data").rglob("*.parquet")}

    first = plans.preprocess_parts(df, DICTIONARIES, folder, number=8)
    same(first, plans.preprocess(df, DICTIONARIES))
    before = files()
    assert plans.preprocess_parts(df, DICTIONARIES, folder).stamp == first.stamp and files() == before
    changed = df.withColumn("tags", F.when(F.col("id") == "NH1", "brand new, small").otherwise(F.col("tags")))
    second = plans.preprocess_parts(changed, DICTIONARIES, folder)
    same(second, plans.preprocess(changed, DICTIONARIES))
    assert len({f.split("_bucket=")[1].split("/")[0] for f in files() - before}) == 1 and second.stamp != first.stamp
    fewer = changed.where("id NOT IN ('NH1', 'NH2', 'JM3')").unionByName(changed.limit(2).withColumn("id", F.lit(None).cast("string")))
    same(plans.preprocess_parts(fewer, DICTIONARIES, folder), plans.preprocess(fewer, DICTIONARIES))
    (tmp_path / "fingerprints" / "manifest" / f"{2:012d}" / "_SUCCESS").unlink()  # a run that broke off before its end
    same(plans.preprocess_parts(df, DICTIONARIES, folder), plans.preprocess(df, DICTIONARIES))
    same(plans.preprocess_parts(df.limit(0), DICTIONARIES, folder), plans.preprocess(df.limit(0), DICTIONARIES))


def test_folders_and_dictionaries_count(spark, tmp_path):
    df, folder = small_catalogue(spark, SF).limit(20), f"file://{tmp_path}"
    paths = df.limit(5).select(F.col("file_name").alias("folder_name"), F.concat(F.lit("/f/"), "id").alias("path"), F.lit(1).cast("long").alias("pos"))
    same(plans.preprocess_parts(df, DICTIONARIES, folder, paths, number=4), plans.preprocess(df, DICTIONARIES, paths))
    other = plans.Dictionaries({"hot"}, {}, set(), {})
    same(plans.preprocess_parts(df, other, folder, paths), plans.preprocess(df, other, paths))


def test_sketches_merge(spark):
    rows = [(f"i{k}", f"author {k % 3000}", [f"t{k % 977}", f"u{k}"], [f"w{k % 50}"]) for k in range(12_000)]
    items = spark.createDataFrame(rows, "id string, author string, parsed_tags array<string>, title_words array<string>")
    want = {"n_items": 12_000, "n_authors": 3000, "n_tags": 12_977, "n_title_words": 50}
    parts = features.facet_sketches(items.withColumn("bucket", buckets.bucket_of("id", 5)), "bucket")
    assert parts.select("bucket").distinct().count() == 5
    for sketches in (parts, features.facet_sketches(items)):
        got = features.approximate_metrics(sketches).first().asDict()
        assert got["n_items"] == 12_000 and all(abs(got[k] - n) <= 0.03 * n for k, n in want.items())
    assert features.approximate_metrics(features.facet_sketches(items.limit(0))).first().asDict() == dict.fromkeys(want, 0)
