import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from marketlake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", 4)
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def bars_of(spark):
    """Bars of one symbol from (open, high, low, close) rows, oldest first."""
    def make(rows, tf="M1", step=60, symbol="X"):
        data = [(symbol, tf, i * step, i, *map(float, r), 1.0) for i, r in enumerate(rows)]
        return spark.createDataFrame(data, "symbol string, tf string, bucket long, bar_no long, open double, high double, low double, close double, volume double")

    return make
