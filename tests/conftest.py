import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"
os.environ["PYSPARK_PYTHON"] = sys.executable


@pytest.fixture(scope="session")
def spark():
    from lexispark.session import local_session

    session = local_session("tests", cores="4", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def data(folder: str = "sf0.001") -> str:
    path = Path(os.environ.get("LEXISPARK_TESTDATA", "/root/testdata")) / folder
    if not path.exists():
        pytest.skip(f"no test data in {path}")
    return str(path)


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def canon(rows: list[tuple]) -> list[tuple]:
    def one(v):
        if v is None:
            return "~"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


def assert_same(df, con, sql: str) -> None:
    names = sorted(df.columns)
    got = [tuple(r[c] for c in names) for r in df.collect()]
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    want = [tuple(r[columns.index(c)] for c in names) for r in result.fetchall()]
    assert canon(got) == canon(want)
