import re
import unicodedata

from quillon import adapters, registry
from quillon.operators import rank

SF = "/root/testdata/sf0.001"


def tokens(text):
    plain = re.sub(r"\[.*?\]", "", text or "")
    return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in plain).split()


def test_c02_tokenises_whole_texts(spark):
    texts = {r["doc_id"]: r["text"] for r in adapters.table(spark, SF, "documents").collect()}
    got = {r["doc_id"]: r for r in registry.QUERIES["c02_tokenize_titles"](spark, SF).collect()}
    assert set(got) == set(texts) and max(len(t or "") for t in texts.values()) > 80
    for doc_id, text in texts.items():
        assert got[doc_id]["surfaces"] == "|".join(tokens(text)) and got[doc_id]["n"] == len(tokens(text))


def test_f01_documents_keep_their_end(spark):
    items = {r["id"]: r for r in adapters.small_catalogue(spark, SF).collect()}
    got = {r["id"]: r["document"] for r in registry.QUERIES["f01_semantic_documents"](spark, SF).collect()}
    assert set(got) == set(items)
    for key, document in got.items():
        r = items[key]
        whole = f"标题《{r['title']}》，作者 {r['author']}，团队 {r['team']}，语言 {r['language']}，元素标签：{r['tags']}。"
        assert document == whole[:800]


def test_g01_places_every_row(spark):
    rows = [(f"i{k}", k % 97, f"2024-01-{k % 28 + 1:02d}") for k in range(2000)]
    df = spark.createDataFrame(rows, "id string, score int, upload_date string").repartition(7)
    got = {r["id"]: r["place"] for r in rank.with_place(df).collect()}
    order = sorted(sorted(sorted(rows), key=lambda r: r[2], reverse=True), key=lambda r: r[1], reverse=True)
    assert got == {r[0]: n for n, r in enumerate(order, 1)}
    assert rank.with_place(df.limit(0)).count() == 0


def test_g01_has_as_many_rows_as_the_catalogue(spark):
    sf = SF.replace("0.001", "0.01")
    n = adapters.small_catalogue(spark, sf).count()
    places = sorted(r["place"] for r in registry.QUERIES["g01_sort_catalogue"](spark, sf).collect())
    assert n > 300 and places == list(range(1, n + 1))
