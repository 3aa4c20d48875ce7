import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """Runs DuckDB SQL over the tables of a folder and gives rows with columns in name order."""
    import duckdb

    def run(sf_dir: str, sql: str) -> list[tuple]:
        con = duckdb.connect()
        for f in sorted(os.listdir(sf_dir)):
            con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
        cur = con.execute(sql)
        names = [c[0] for c in cur.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        return [tuple(r[i] for i in order) for r in cur.fetchall()]

    return run
