import datetime as dt
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from undercroft import schemas  # noqa: E402
from undercroft.config import RiskConfig  # noqa: E402
from undercroft.session import build_session, drop_staged  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
        "spark.ui.showConsoleProgress": "false",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_staged(session)
    session.stop()


SMALL = RiskConfig(min_object_events=1, noisy_fire_events=3, noisy_flood_events=3)
H0 = dt.datetime(2024, 1, 1)


def at(hours: float) -> dt.datetime:
    return H0 + dt.timedelta(hours=hours)


def channels_frame(spark, rows):
    """rows: (id, sensor_type, name, object_id)"""
    full = [(i, "system", kind, None, name, obj, None) for i, kind, name, obj in rows]
    return spark.createDataFrame(full, schemas.CHANNELS)


def events_frame(spark, rows):
    """rows: (channel_id, ts, alarm, number, word)"""
    full = [
        (n, channel, ts, alarm, word if word is not None else (None if num is None else str(num)), num, word)
        for n, (channel, ts, alarm, num, word) in enumerate(rows)
    ]
    return spark.createDataFrame(full, schemas.EVENTS)


def values(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()] if order else [tuple(r) for r in df.collect()]
