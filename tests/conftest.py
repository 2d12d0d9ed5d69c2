import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
# Python workers import the package as well.
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidegrid.session import builder

    session = (
        builder("tests")
        .master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def compare():
    """Runs a query and its SQL on one folder; returns both as sorted lists of rows."""
    import glob
    import math

    import duckdb

    def plain(v):
        if isinstance(v, bool) or v is None:
            return v
        if isinstance(v, float):
            return "nan" if math.isnan(v) else float(f"{v:.9g}") if v else 0.0
        if isinstance(v, (list, tuple)):
            return tuple(plain(x) for x in v)
        return plain(float(v)) if type(v).__name__ == "Decimal" else v

    def run(spark, query, sql, sf_dir):
        con = duckdb.connect()
        con.sql("SET timezone = 'UTC'")
        for p in glob.glob(f"{sf_dir}/*.parquet"):
            con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
        df = query(spark, sf_dir)
        names = sorted(df.columns)
        ours = [tuple(plain(r[c]) for c in names) for r in df.collect()]
        rel = con.sql(sql)
        assert names == sorted(rel.columns)
        at = [rel.columns.index(c) for c in names]
        theirs = [tuple(plain(r[k]) for k in at) for r in rel.fetchall()]
        return sorted(ours, key=repr), sorted(theirs, key=repr)

    return run
