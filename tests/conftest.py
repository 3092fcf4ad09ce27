import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}"


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def same():
    """Compares a query with its SQL over the small tables."""
    import duckdb

    sys.path.insert(0, str(ROOT / "tools"))
    import compare

    db = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")

    def check(df, sql):
        columns, got = compare.rows(df.columns, [tuple(r) for r in df.collect()])
        rel = db.execute(sql)
        want_columns, want = compare.rows([c[0] for c in rel.description], rel.fetchall())
        assert columns == want_columns
        assert got == want

    return check
