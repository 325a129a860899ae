"""Sinks, document stores and state writes by example."""

from pyspark.sql import functions as F

from passagekit.operators import catalog as C
from passagekit.sources import store


def test_a_source_is_replaced_and_no_other(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "source_id long, text string")
    store.replace_partitions(rows, path)
    store.replace_partitions(spark.createDataFrame([(1, "d")], rows.schema), path)
    store.replace_partitions(rows.limit(0), path)
    assert sorted((r.source_id, r.text) for r in spark.read.parquet(path).collect()) == [(1, "d"), (2, "c")]


def test_bad_documents_are_left_out(spark, tmp_path):
    path = str(tmp_path / "j")
    spark.createDataFrame([('{"id": 1, "x": "a"}',), ('{"id": 2, "x"',), ('{"x": "no id"}',)], "value string").write.text(path)
    assert [(r.id, r.x) for r in store.read_documents(spark, path, "id long, x string", "id").collect()] == [(1, "a")]


def test_upsert_keeps_the_old_id_and_facets_unless_new(spark):
    kind = "video_id string, list_id string, source_id string, title string, sequence_number int"
    base = spark.createDataFrame([("v1", "l", "old", "t", 3), ("v2", "l", "two", "u", None)], kind)
    new = spark.createDataFrame([("v1", "l", "new", "t2", None), ("v3", "l", "three", "w", 9)], kind)
    out = {r.video_id: tuple(r)[2:] for r in C.upsert(base, new, ["video_id", "list_id"], ["source_id"], ["sequence_number"]).collect()}
    assert out == {"v1": ("old", "t2", 3), "v2": ("two", "u", None), "v3": ("three", "w", 9)}


def test_updates_of_missing_keys_change_nothing(spark):
    base = spark.createDataFrame([(1, 5), (2, 6)], "k int, v int")
    patch = spark.createDataFrame([(1, None), (9, 1)], "k int, v int")
    assert sorted((r.k, r.v) for r in C.update_present(base, patch, "k", "v").collect()) == [(1, None), (2, 6)]


def test_selection(spark):
    pairs = lambda xs: spark.createDataFrame([(x, i) for i, x in enumerate(xs)], "source_id string, ord int")
    out = C.reconcile_selection(pairs("cab"), pairs("abde"), pairs("abcd")).orderBy("part", "ord").collect()
    assert [r.source_id for r in out] == ["a", "b", "e"]


def test_hosts(spark):
    urls = spark.createDataFrame([("https://www.site.tv/x",), ("https://notsite.tv/",), ("site.tv",)], "url string")
    out = C.host_platform(urls, [("site.tv", "site"), ("www.site.tv", "never")]).collect()
    assert [r.platform for r in out] == ["site", None, None]


def test_truncation(spark):
    rows = [(100.0, 100, 100), (80.0, 100, None), (95.0, 100, 120), (None, None, None), (5.0, 0, 0)]
    df = spark.createDataFrame(rows, "d double, c int, e int").select(C.truncation_status(F.col("d"), F.col("c"), F.col("e")).alias("s"))
    assert [r.s for r in df.collect()] == ["ok", "truncated", "truncated", "unverified", "unverified"]
