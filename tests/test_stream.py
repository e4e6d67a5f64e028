"""Sync as a stream into the bucketed store."""

from dataclasses import replace
from pathlib import Path

from helpers import rows
from pyspark.sql import functions as F
from test_sync import same

from hubwright.operators.build import build_graph
from hubwright.plans.model import infer_model
from hubwright.sources import buckets
from hubwright.streaming.sync import latest_rows, merge_batch, sync_full, sync_stream


def run(spark, spec, model, source, path, checkpoint):
    stream = spark.readStream.schema(spec.df.schema).option("maxFilesPerTrigger", 2).parquet(source)
    query = sync_stream(stream, path, spec, model, checkpoint, column="id")
    assert query.awaitTermination(300)
    if query.exception():
        raise query.exception()


def test_rounds_equal_a_full_sync(spark, shop, tmp_path):
    """Three rounds over arriving files, the last batch of the second repeated as after a failure before its checkpoint."""
    spec, model = shop["orders"], infer_model(shop["orders"])
    source, path, checkpoint = (f"file://{tmp_path}/{n}" for n in ("source", "store", "checkpoint"))
    parts = [
        spec.df.where("id <= 20"),
        spec.df.where("id between 21 and 40").union(spec.df.where("id = 21").withColumn("status", F.lit("twice"))),
        spec.df.where("id > 40").union(spec.df.where("id in (3, 4)").withColumn("status", F.lit("lost"))),
    ]
    versions = []
    for i, part in enumerate(parts):
        part.coalesce(2).write.mode("append").parquet(source)
        run(spark, spec, model, source, path, checkpoint)
        versions.append(buckets.newest_version(spark, path))
        if i == 1:
            last = max((p for p in Path(f"{tmp_path}/checkpoint/commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
            last.unlink()
            (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
            run(spark, spec, model, source, path, checkpoint)
            assert buckets.newest_version(spark, path) == versions[-1]
    assert versions == sorted(set(versions)) and buckets.stored_mark(spark, path) == "60"
    changed = spec.df.withColumn("status", F.expr("if(id in (3, 4), 'lost', status)"))
    want = sync_full(build_graph([(replace(spec, df=changed), model)]), replace(spec, df=changed), model)
    got = buckets.load(spark, path)
    # the planted row with the same key and mark: either of the two, but one of them
    twice = got.edge("HAS_STATUS").where("src_id = 'id=21'")
    assert twice.count() == 1
    keep = "src_id <> 'id=21'"
    same(got.with_nodes("Status", want.node("Status")).with_edges(("Order", "HAS_STATUS", "Status"), got.edge("HAS_STATUS").where(keep)),
         want.with_edges(("Order", "HAS_STATUS", "Status"), want.edge("HAS_STATUS").where(keep)))


def test_newest_row_of_a_key(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, None, "c"), (2, None, "d"), (None, 1, "e")], "id int, at int, v string")
    assert rows(latest_rows(df, ("id",), "at")) == sorted([(1, 7, "b"), (2, None, "d"), (None, 1, "e")], key=repr)


def test_an_empty_batch_writes_nothing(spark, shop, tmp_path):
    spec, model = shop["orders"], infer_model(shop["orders"])
    path = f"file://{tmp_path}/store"
    merge_batch(path, spec, model, "id")(spec.df.where("false"), 0)
    assert buckets.newest_version(spark, path) == 0
