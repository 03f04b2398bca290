import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from basketry.schema import SCHEMAS  # noqa: E402
from basketry.tables import Tables  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from basketry.session import local_session
    s = local_session(cores=4, shuffle_partitions=4, driver_memory="4g",
                      conf={"spark.sql.maxMetadataStringLength": "1000"})  # whole paths in plans
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="basketry-test-")


def make_tables(spark, **rows) -> Tables:
    return Tables(**{name: spark.createDataFrame(rows.get(name, []), SCHEMAS[name])
                     for name in SCHEMAS})


@pytest.fixture(scope="session")
def mini(spark) -> Tables:
    """The literal frame of FIXTURES.md section 3."""
    return make_tables(
        spark,
        users=[(1,), (2,)],
        departments=[(1, "produce"), (2, "dairy eggs"), (3, "empty dept")],
        aisles=[(1, "fresh fruits"), (2, "milk")],
        products=[(10, "Banana", 1, 1), (11, "Organic Banana 50%", 1, 1), (12, "Milk", 2, 2),
                  (13, "New_Product", 1, 2)],
        orders=[(100, 1, "train", 2, 0, 9, 7.0), (101, 1, "train", 3, 6, 9, 8.0),
                (102, 2, "train", 2, 0, 14, 30.0)],
        order_details=[(100, 10, 1, 1), (100, 12, 2, 0), (101, 10, 1, 1), (102, 11, 1, 0),
                       (102, 12, 2, 1)],
    )


def rows(df):
    return [tuple(r) for r in df.collect()]
