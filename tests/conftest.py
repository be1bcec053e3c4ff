import sys
from pathlib import Path

import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lectern.session import session

    s = session("local[*]", 8, **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    """DuckDB with a view of each table."""
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(value):
    """A value in a form that compares equal across engines: doubles to nine figures, timestamps and dates as dates."""
    if value is None or value is pd.NA or value is pd.NaT or isinstance(value, float) and value != value:
        return None
    if hasattr(value, "isoformat"):
        return str(value)[:10]
    if isinstance(value, (list, tuple)) or hasattr(value, "tolist") and getattr(value, "ndim", 0):
        return tuple(plain(v) for v in value)
    if isinstance(value, (int, float)) or hasattr(value, "dtype"):
        return f"{float(value):.9g}"
    return str(value)


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False)), key=str)
