import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shopflow.session import build_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session("shopflow-tests", cpus="*", shuffle_partitions=8, driver_memory="8g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sample_lines(spark):
    """The 11-line order sample (6 orders, 6 customers)."""
    import datetime as dt
    rows = [
        ("ORD12345", "prod1", "cust789", "2023-12-15T14:30:00"), ("ORD12345", "prod5", "cust789", "2023-12-15T14:30:00"),
        ("ORD12346", "prod1", "cust790", "2023-12-16T10:15:00"), ("ORD12346", "prod3", "cust790", "2023-12-16T10:15:00"),
        ("ORD12347", "prod2", "cust791", "2024-03-20T09:45:00"),
        ("ORD12348", "prod1", "cust792", "2024-03-21T16:20:00"), ("ORD12348", "prod4", "cust792", "2024-03-21T16:20:00"),
        ("ORD12349", "prod3", "cust793", "2024-03-22T11:30:00"), ("ORD12349", "prod5", "cust793", "2024-03-22T11:30:00"),
        ("ORD12350", "prod1", "cust794", "2024-03-23T14:00:00"), ("ORD12350", "prod5", "cust794", "2024-03-23T14:00:00"),
    ]
    data = [(o, p, c, dt.datetime.fromisoformat(t)) for o, p, c, t in rows]
    return spark.createDataFrame(data, "orderNr string, productNr string, customerNr string, dateTime timestamp_ntz")


@pytest.fixture(scope="session")
def sample_products(spark):
    rows = [(f"prod{i}", f"Product {i}", "desc", "Brand", None, 0, False, 0.5) for i in range(1, 6)]
    return spark.createDataFrame(
        rows, "id string, title string, description string, brand string, seasons array<string>, "
              "stockLevel int, isOnSale boolean, seasonRelevancyFactor double")
