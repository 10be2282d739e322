"""Explicit schemas of every table the engine reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T

_LONG, _INT, _DOUBLE, _STR, _BOOL = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType()
_NTZ = T.TimestampNTZType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


EVENTS = _struct(
    event_id=_LONG, channel_id=_LONG, event_ts=_NTZ, is_alarm=_BOOL, value_raw=_STR, value_num=_DOUBLE, value_cat=_STR
)
OBJECTS = _struct(id=_LONG, level=_INT, parent_id=_LONG, kind=_STR, name=_STR)
CHANNELS = _struct(
    id=_LONG, system_type=_STR, sensor_type=_STR, tag=_STR, name=_STR, object_id=_LONG, picket=_STR
)
ALARMS = _struct(event_id=_LONG, channel_id=_LONG, event_ts=_NTZ, value_raw=_STR, value_num=_DOUBLE, value_cat=_STR)
HOURLY = _struct(
    channel_id=_LONG, hour_ts=_NTZ, n_events=_LONG, n_alarms=_LONG,
    value_mean=_DOUBLE, value_min=_DOUBLE, value_max=_DOUBLE,
)
WEATHER = _struct(day=T.DateType(), temp_mean=_DOUBLE, precipitation_mm=_DOUBLE, humidity=_DOUBLE)
PREDICTIONS = _struct(
    id=_LONG, object_id=_LONG, channel_id=_LONG, risk_type=_STR, probability=_DOUBLE, horizon_hours=_INT,
    explanation=_STR, recommendation=_STR, status=_STR, source=_STR, created_at=_NTZ,
)
FEEDBACK = _struct(id=_LONG, prediction_id=_LONG, decision=_STR, reason=_STR, user_login=_STR, created_at=_NTZ)
DECISIONS = _struct(
    prediction_id=_LONG, decision=_STR, reason=_STR, create_ticket=_BOOL, user_login=_STR, decided_at=_NTZ
)
TICKETS = _struct(
    id=_LONG, prediction_id=_LONG, object_id=_LONG, title=_STR, body=_STR, status=_STR, external_id=_STR,
    created_at=_NTZ,
)
CALIBRATION = _struct(
    risk_type=_STR, threshold=_DOUBLE, n_dispatch=_LONG, n_false_alarm=_LONG, user_login=_STR, updated_at=_NTZ
)
AUDIT = _struct(id=_LONG, user_login=_STR, action=_STR, details=_STR, created_at=_NTZ)

# Raw text files: header name -> normalised name. Fixed wording of the journal exports.
JOURNAL_HEADER = {
    "ид_события": "event_id",
    "ид_канала_данных": "channel_id",
    "дата": "date",
    "время": "time",
    "тревожное": "alarm",
    "значение_датчика": "value",
}
OBJECT_HEADER = {
    "ид_объект": "id",
    "иерархия_уровень": "level",
    "родитель": "parent_id",
    "вид_объекта": "kind",
    "диспетчерское_название_объекта": "name",
}
CHANNEL_HEADER = {
    "ид_канала_данных": "id",
    "тип_инж_системы": "system_type",
    "тип_датчика": "sensor_type",
    "тег_инженерной_системы": "tag",
    "название_датчика": "name",
    "ид_объект": "object_id",
}
# Columns whose presence identifies the kind of a file, most specific kind first.
KIND_MARKERS = {
    "objects": frozenset(OBJECT_HEADER),
    "channels": frozenset({"ид_канала_данных", "тип_инж_системы", "тип_датчика", "ид_объект"}),
    "journal": frozenset({"ид_события", "ид_канала_данных", "дата", "тревожное"}),
}

# One event of a wire batch.
WIRE_EVENT = T.StructType([
    T.StructField("event_id", _LONG), T.StructField("channel_id", _LONG),
    T.StructField("event_ts", _NTZ), T.StructField("alarm", _BOOL), T.StructField("value", _STR),
])
WIRE_BATCH = T.StructType([T.StructField("events", T.ArrayType(WIRE_EVENT))])

WEATHER_PAYLOAD = T.StructType([
    T.StructField("reason", _STR),
    T.StructField("daily", T.StructType([
        T.StructField("time", T.ArrayType(_STR)),
        T.StructField("temperature_2m_mean", T.ArrayType(_DOUBLE)),
        T.StructField("precipitation_sum", T.ArrayType(_DOUBLE)),
        T.StructField("relative_humidity_2m_mean", T.ArrayType(_DOUBLE)),
    ])),
])

# Model metrics document; risk-keyed maps keep it open to new risks.
_METRIC = T.StructType([
    T.StructField("threshold", _DOUBLE), T.StructField("precision", _DOUBLE), T.StructField("recall", _DOUBLE),
    T.StructField("positives_pred", _LONG), T.StructField("positives_true", _LONG), T.StructField("n", _LONG),
    T.StructField("pr_auc", _DOUBLE),
])
_BY_RISK = T.MapType(_STR, T.MapType(_STR, _METRIC))
METRICS_DOC = T.StructType([
    T.StructField("trained_at", _STR), T.StructField("retrained_at", _STR),
    T.StructField("n_train", _LONG), T.StructField("n_valid", _LONG), T.StructField("n_test", _LONG),
    T.StructField("features", T.ArrayType(_STR)),
    T.StructField("thresholds", T.MapType(_STR, T.MapType(_STR, _DOUBLE))),
    T.StructField("valid", _BY_RISK), T.StructField("test", _BY_RISK),
    T.StructField("retrain", T.MapType(_STR, T.StructType([T.StructField("n", _LONG), T.StructField("trees", _LONG)]))),
    T.StructField("shap", T.MapType(_STR, T.ArrayType(T.StructType([
        T.StructField("feature", _STR), T.StructField("gain", _DOUBLE), T.StructField("mean_abs_shap", _DOUBLE),
    ])))),
])
