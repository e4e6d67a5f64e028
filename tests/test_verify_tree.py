"""The tree of digests against comparing all keys."""

from dataclasses import replace

import pytest
from helpers import rows

from hubwright.operators.build import build_graph
from hubwright.operators.verify import verify_full, verify_surplus
from hubwright.operators.verify_tree import compare
from hubwright.plans.model import infer_model
from hubwright.sources.tables import TableSpec


def numbers(spark, wanted="true", repeats=0):
    df = spark.range(5000).where(wanted)
    for _ in range(repeats):
        df = df.union(spark.range(40))
    return TableSpec("numbers", df, ("id",))


def differences(got):
    return sorted((*r[:-1], r[-1]) for r in rows(got.differences))


def expected(df, graph, model):
    return sorted([(*r, "missing") for r in rows(verify_full(df, graph, model))] + [(*r, "surplus") for r in rows(verify_surplus(df, graph, model))])


def test_equal_sides_take_one_level(spark):
    spec = numbers(spark)
    got = compare(spec.df, build_graph([(spec, infer_model(spec))]), infer_model(spec), level_bits=4)
    assert got.equal and [level[:3] for level in got.levels] == [(4, 16, 0)] and got.differences.isEmpty()


@pytest.mark.parametrize(("bits", "opened", "leaf"), [(4, 1000, 10), (4, 2, 10), (8, 1000, 1), (10, 1000, 4096)])
def test_missing_and_surplus_keys(spark, bits, opened, leaf):
    spec = numbers(spark)
    model = infer_model(spec)
    graph = build_graph([(numbers(spark, "id % 997 != 3 "), model)])
    source = numbers(spark, "id not in (10, 11)", repeats=2).df
    got = compare(source, graph, model, bits, opened, leaf)
    assert not got.equal and differences(got) == expected(source, graph, model)
    assert sum(1 for d in differences(got) if d[-1] == "missing") == 6


def test_only_differing_ranges_are_opened(spark):
    spec = numbers(spark)
    model = infer_model(spec)
    graph = build_graph([(numbers(spark, "id != 77"), model)])
    got = compare(spec.df, graph, model, level_bits=4, leaf_rows=50)
    assert [(depth, n) for depth, _, n, _ in got.levels] == [(4, 1), (8, 1)] and got.levels[1][3] < 100
    assert differences(got) == [("id=77", "missing")]


def test_links_and_missing_parts(spark, shop):
    spec = shop["order_items"]
    model = infer_model(spec)
    holed = replace(spec, df=spec.df.where("order_id % 7 != 0"))
    graph = build_graph([(holed, model)])
    source = spec.df.where("order_id > 2").union(spec.df.selectExpr("cast(null as int)", "product_id", "qty", "unit_price").limit(3))
    assert differences(compare(source, graph, model, level_bits=4)) == expected(source, graph, model)


def test_empty_sides(spark):
    spec, none = numbers(spark), numbers(spark, "false")
    model = infer_model(spec)
    graph, empty = build_graph([(spec, model)]), build_graph([(none, model)])
    assert compare(none.df, empty, model).equal
    assert len(differences(compare(spec.df, empty, model, level_bits=4, leaf_rows=1))) == 5000
    assert {d[-1] for d in differences(compare(none.df, graph, model))} == {"surplus"}
