import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
         .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
         .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def plain(value):
    """Rows of either engine as comparable values."""
    import math

    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows(df) -> list[tuple]:
    return sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)


@pytest.fixture(scope="session")
def oracle():
    """sql, folder of tables -> sorted rows with columns by name."""
    import duckdb

    def run(sql: str, folder: str):
        con = duckdb.connect()
        for f in Path(folder).iterdir():
            con.execute(f"CREATE VIEW {f.name.split('.')[0]} AS SELECT * FROM read_parquet('{f}{'/*.parquet' if f.is_dir() else ''}')")
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        return sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)
    return run


DATA = "/root/testdata/sf0.001"
