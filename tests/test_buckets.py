"""The merge-on-read store against merging in memory."""

from dataclasses import replace

import pytest
from helpers import rows
from pyspark.sql import functions as F
from test_sync import same

from hubwright.operators.build import build_graph
from hubwright.operators.graph import PropertyGraph
from hubwright.plans.model import infer_model
from hubwright.session import bucket_count
from hubwright.sources import buckets
from hubwright.streaming.sync import merge_load, sync_full


@pytest.fixture
def shop_store(spark, shop, tmp_path):
    loads = [(shop[n], infer_model(shop[n])) for n in ("orders",)]
    graph = build_graph(loads)
    path = f"file://{tmp_path}/store"
    buckets.create(graph, path, [m for _, m in loads], bucket_rows=20)
    return graph, path


def changed(shop, wanted="id in (1, 2, 33)"):
    spec = shop["orders"]
    moved = spec.df.where(wanted).withColumn("status", F.lit("lost")).withColumn("customer_id", F.lit(3)).withColumn("amount", F.expr("if(id = 2, null, amount * 2)"))
    return replace(spec, df=moved), infer_model(spec)


def test_what_is_written_is_read(spark, shop_store):
    graph, path = shop_store
    same(buckets.load(spark, path), graph)
    assert buckets.newest_version(spark, path) == 1
    with pytest.raises(FileExistsError):
        buckets.create(graph, path)
    with pytest.raises(FileNotFoundError):
        buckets.load(spark, path + "-none")


@pytest.mark.parametrize("keep_old", [False, True])
def test_upserts_equal_merging_in_memory(spark, shop, shop_store, keep_old):
    graph, path = shop_store
    for wanted, status in (("id in (1, 2, 33)", "lost"), ("id in (2, 3, 60)", "found")):
        spec, model = changed(shop, wanted)
        spec = replace(spec, df=spec.df.withColumn("status", F.lit(status)))
        buckets.upsert(spark, path, spec, model, not keep_old)
        graph = merge_load(graph, spec, model, not keep_old)
    same(buckets.load(spark, path), graph)
    buckets.compact(spark, path, share=0)
    same(buckets.load(spark, path), graph)


def test_links_are_merged_by_both_ends(spark, shop, tmp_path):
    links, model = shop["order_items"], infer_model(shop["order_items"])
    graph, path = build_graph([(links, model)]), f"file://{tmp_path}/links"
    buckets.create(graph, path, [model], bucket_rows=20)
    more = replace(links, df=links.df.where("order_id < 5").withColumn("qty", F.lit(99)))
    buckets.upsert(spark, path, more, model)
    same(buckets.load(spark, path), merge_load(graph, more, model))


def test_earlier_versions_stay_readable(spark, shop, shop_store):
    graph, path = shop_store
    spec, model = changed(shop)
    second = buckets.upsert(spark, path, spec, model)
    third = buckets.compact(spark, path, share=0)
    after = merge_load(graph, spec, model)
    same(buckets.load(spark, path, 1), graph)
    same(buckets.load(spark, path, second), after)
    assert third == second + 1 and buckets.vacuum(spark, path, third) > 0
    same(buckets.load(spark, path, third), after)
    assert buckets.vacuum(spark, path, third) == 0


def bases(spark, path, version=None):
    return {(name, bucket): folder for name, bucket, kind, folder, _ in buckets.live_files(spark, path, version) if kind == buckets.BASE}


def test_untouched_buckets_keep_their_files(spark, shop, shop_store):
    graph, path = shop_store
    before = bases(spark, path)
    buckets.upsert(spark, path, *changed(shop, "id = 1"))
    assert bases(spark, path) == before
    touched = {(n, b) for n, b, kind, _, _ in buckets.live_files(spark, path) if kind != buckets.BASE}
    written = sum(r for *_, kind, _, r in buckets.live_files(spark, path) if kind != buckets.BASE)
    # one row: its node, its hubs and stubs, their edges, and the voided sources
    assert written <= 12 and len(touched) < len(before) / 2
    buckets.compact(spark, path, share=0)
    after = bases(spark, path)
    assert {k for k in before if after[k] != before[k]} <= touched and {k for k in before if after[k] == before[k]}
    assert buckets.compact(spark, path, share=0) is None
    buckets.upsert(spark, path, *changed(shop, "id = 1"))
    assert buckets.compact(spark, path, share=100.0) is None


def test_a_table_that_has_outgrown_its_buckets_is_dealt_anew(spark, shop, shop_store):
    graph, path = shop_store
    buckets.upsert(spark, path, *changed(shop, "id = 1"))
    graph = merge_load(graph, *changed(shop, "id = 1"))
    before = {t.name: t.buckets for t in buckets.stored_tables(spark, path)}
    grown = buckets.compact(spark, path, share=10.0, bucket_rows=8)
    after = {t.name: t.buckets for t in buckets.stored_tables(spark, path)}
    # 61 rows as the delta's row counts too; hubs have few rows
    assert after["Order",] == 8 > 2 * before["Order",] and after["Status",] == before["Status",] == 1
    same(buckets.load(spark, path), graph)
    assert {t.name: t.buckets for t in buckets.stored_tables(spark, path, grown - 1)} == before
    buckets.upsert(spark, path, *changed(shop, "id = 2"))
    same(buckets.load(spark, path), merge_load(graph, *changed(shop, "id = 2")))


def test_an_upsert_reads_nothing_of_the_store(spark, shop, shop_store, monkeypatch):
    _, path = shop_store
    monkeypatch.setattr(buckets, "_select", None)
    assert buckets.upsert(spark, path, *changed(shop)) == 2


def test_new_tables_come_with_an_upsert(spark, shop, shop_store):
    graph, path = shop_store
    spec, model = shop["employees"], infer_model(shop["employees"])
    buckets.upsert(spark, path, spec, model)
    same(buckets.load(spark, path), sync_full(graph, spec, model))
    buckets.upsert(spark, path, replace(spec, df=spec.df.where("id = 5").withColumn("manager_id", F.lit(7))), model)
    boss = buckets.load(spark, path).edge("HAS_MANAGER").where("src_id = 'id=5'")
    assert rows(boss) == [("id=5", "id=7")]


def test_a_batch_is_written_once(spark, shop, shop_store):
    _, path = shop_store
    spec, model = changed(shop)
    first = buckets.upsert(spark, path, spec, model, batch="a", mark="7")
    assert buckets.upsert(spark, path, spec, model, batch="a", mark="8") == first
    assert buckets.stored_mark(spark, path) == "7"
    buckets.upsert(spark, path, spec, model, batch="b")
    assert buckets.stored_mark(spark, path) == "7" and buckets.newest_version(spark, path) == first + 1


def test_of_two_writers_one_fails(spark, shop, shop_store, monkeypatch):
    _, path = shop_store
    commit = buckets._Version.commit

    def late(self):
        monkeypatch.setattr(buckets._Version, "commit", commit)
        self.head = (self.head[0], "f" * 32, *self.head[2:])
        buckets.upsert(spark, path, *changed(shop, "id = 2"))
        return commit(self)

    monkeypatch.setattr(buckets._Version, "commit", late)
    with pytest.raises(RuntimeError, match="another writer"):
        buckets.upsert(spark, path, *changed(shop, "id = 1"))
    lost = buckets.load(spark, path).edge("HAS_STATUS").where("dst_id = 'value=lost'")
    assert rows(lost.select("src_id")) == [("id=2",)]


def test_clearing_deltas_and_unknown_columns(spark, tmp_path):
    from hubwright.sources.tables import TableSpec

    path = f"file://{tmp_path}/odd"
    first = TableSpec("things", spark.createDataFrame([(1, "a", 1.5), (2, "b", None), (None, "c", 2.5)], "id int, name string, w double"), ("id",))
    buckets.create(build_graph([(first, infer_model(first))]), path, [infer_model(first)], bucket_rows=1)
    later = TableSpec("things", spark.createDataFrame([(1, None, 7), (3, "d", None)], "id int, name string, extra int"), ("id",))
    buckets.upsert(spark, path, later, infer_model(later))
    none = replace(later, df=later.df.where("false"))
    buckets.upsert(spark, path, none, infer_model(later))
    want = [(1, None, 1.5, 7), (2, "b", None, None), (3, "d", None, None)]
    assert rows(buckets.load(spark, path).node("Thing").select("id", "name", "w", "extra")) == want
    buckets.compact(spark, path, share=0)
    assert rows(buckets.load(spark, path).node("Thing").select("id", "name", "w", "extra")) == want


def test_buckets_do_not_grow_with_the_rows(spark, tmp_path):
    """Small buckets are made while they are few; a store of more rows gets larger ones, until they are full."""
    assert [bucket_count(n, 2000, 1 << 20) for n in (0, 2001, 128_000, 54_000_000, 10**9)] == [1, 2, 64, 64, 954]
    rows_ = spark.range(200).selectExpr("concat('id=', id) AS _id", "'id' AS _key", "id")
    path = f"file://{tmp_path}/many"
    buckets.create(PropertyGraph({"N": rows_}), path, bucket_rows=1)
    assert [t.buckets for t in buckets.stored_tables(spark, path)] == [64]
    assert buckets.compact(spark, path, bucket_rows=1) is None
    assert buckets.load(spark, path).node("N").distinct().count() == 200
