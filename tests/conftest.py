import sys
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from hubwright.session import local_session  # noqa: E402
from hubwright.sources.tables import ForeignKey, TableSpec  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # tiny inputs: two tasks per stage are enough to have data meet across partitions
    session = local_session("hubwright-tests", cores=8, shuffle_partitions=2, conf={"spark.default.parallelism": "2"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def shop(spark):
    """A small shop: orders with a link table, a hierarchy, composite keys and planted duplicates."""
    statuses = ("shipped", "pending", "cancelled")
    names = [f"Customer {g}" for g in range(1, 9)] + ["Globex LLC", "Globex L.L.C.", "Jonathan Smith", "Jonathon Smith"]
    customers = [(i, n) for i, n in enumerate(names, 1)]
    products = [(i, f"Product {i}") for i in range(1, 6)]
    orders = [
        (g, g % 8 + 1, statuses[g % 3], f"Product {g % 5 + 1}", Decimal("7.5") * g, "2024-01-01 00:00:00")
        for g in range(1, 61)
    ]
    items = [
        (o, p, (o + p) % 4 + 1, Decimal("3.25") * p) for o in range(1, 61) for p in range(1, 6) if (o + p) % 3 == 0
    ]
    bosses = [("CEO", None), ("VP Eng", 1), ("VP Sales", 1), ("Eng Lead", 2), ("Dev A", 4), ("Dev B", 4),
              ("Sales Lead", 3), ("AE 1", 7), ("AE 2", 7), ("Loner", None)]
    employees = [(i, n, m) for i, (n, m) in enumerate(bosses, 1)]
    shipments = [("EU", 1, "DHL"), ("EU", 2, "UPS"), ("US", 1, "FedEx")]
    details = [("EU", 1, "fragile"), ("US", 1, "oversize")]

    def key(name, columns, table, refs):
        return ForeignKey(name, columns, table, refs)

    def table(name, rows, schema, pk, *fks):
        return TableSpec(name, spark.createDataFrame(rows, schema), pk, fks)

    order_df = spark.createDataFrame(
        orders, "id int, customer_id int, status string, product string, amount decimal(10,2), created_at string"
    )
    order_df = order_df.withColumn("created_at", order_df.created_at.cast("timestamp"))
    return {
        "customers": table("customers", customers, "id int, name string", ("id",)),
        "products": table("products", products, "id int, name string", ("id",)),
        "orders": TableSpec("orders", order_df, ("id",), (key("c", ("customer_id",), "customers", ("id",)),)),
        "order_items": table(
            "order_items", items, "order_id int, product_id int, qty int, unit_price decimal(10,2)", ("order_id", "product_id"),
            key("o", ("order_id",), "orders", ("id",)), key("p", ("product_id",), "products", ("id",)),
        ),
        "employees": table(
            "employees", employees, "id int, name string, manager_id int", ("id",), key("m", ("manager_id",), "employees", ("id",))
        ),
        "shipments": table("shipments", shipments, "region string, seq int, carrier string", ("region", "seq")),
        "shipment_details": table(
            "shipment_details", details, "region string, seq int, note string", ("region", "seq"),
            key("s", ("region", "seq"), "shipments", ("region", "seq")),
        ),
    }
