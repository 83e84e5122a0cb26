"""One session for all tests, and the small data as DuckDB views."""

from __future__ import annotations

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from terravane.session import local_session  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "3g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in sorted(os.listdir(DATA)):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.fixture(scope="session")
def data() -> str:
    return DATA


def normal(frame) -> list[tuple]:
    """Rows as sorted tuples, columns by name, numbers at six decimals."""

    def one(v):
        if v is None or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return bool(v)
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return round(float(v), 6)
        return str(v)

    columns = sorted(frame.columns)
    return sorted((tuple(one(v) for v in row) for row in frame[columns].itertuples(index=False, name=None)), key=str)


def close(x: tuple, y: tuple) -> bool:
    """Equal but for the last digit of rounded numbers, which sums in another order may tip."""
    return all(abs(u - v) <= 1.5e-5 if isinstance(u, float) and isinstance(v, float) else u == v for u, v in zip(x, y))


@pytest.fixture(scope="session")
def same():
    def check(a, b) -> bool:
        if sorted(a.columns) != sorted(b.columns) or len(a) != len(b):
            return False
        x, y = normal(a), normal(b)
        return x == y or all(close(p, q) for p, q in zip(x, y))

    return check
