import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from chronodex.session import build_session

    s = build_session("local[4]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not DATA.exists():
        pytest.skip("no test tables here")
    return str(DATA)


@pytest.fixture(scope="session")
def empty_tables(spark, data, tmp_path_factory):
    """A data folder with all tables of the smallest one, without rows."""
    out = tmp_path_factory.mktemp("empty")
    for p in Path(data).glob("*.parquet"):
        spark.read.parquet(str(p)).limit(0).coalesce(1).write.parquet(f"{out}/{p.name}")
    return str(out)


@pytest.fixture(scope="session")
def null_tables(spark, data, tmp_path_factory):
    """A data folder whose tables have a few rows of nulls each."""
    out = tmp_path_factory.mktemp("nulls")
    for p in Path(data).glob("*.parquet"):
        schema = spark.read.parquet(str(p)).schema
        spark.createDataFrame([tuple([None] * len(schema))] * 3, schema).coalesce(1).write.parquet(f"{out}/{p.name}")
    return str(out)
