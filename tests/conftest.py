import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stationflow import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(
        "tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def hourly(spark):
    """``hourly(n, fn)``: n hourly rows of one station from 2024-01-01."""
    import datetime as dt

    def make(n, fn=lambda i: {"temp_ar_c": float(i)}, station="a", start=dt.datetime(2024, 1, 1), skip=()):
        rows = [
            {"municipio": station, "data_hora": start + dt.timedelta(hours=i), **fn(i)}
            for i in range(n) if i not in skip
        ]
        names = [k for k in rows[0] if k not in ("municipio", "data_hora")]
        schema = "municipio string, data_hora timestamp, " + ", ".join(f"{c} double" for c in names)
        return spark.createDataFrame([tuple(r[k] for k in ("municipio", "data_hora", *names)) for r in rows], schema)

    return make
