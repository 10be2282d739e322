"""Domain vocabulary and tunables. Everything here is data; no operator hard-codes a value."""

from __future__ import annotations

from dataclasses import dataclass, field

RISKS = ("fire", "flood", "failure", "intrusion")
DECISIONS = ("dispatch", "false_alarm", "watch", "maintenance")

# ---------------------------------------------------------------------------
# Fixed values of the domain: they must equal the journal's own wording.
# ---------------------------------------------------------------------------
RISK_TITLES = {
    "fire": "Пожар",
    "flood": "Подтопление",
    "failure": "Отказ датчика",
    "intrusion": "НСД",
}
RECOMMENDATIONS = {
    "fire": "Проверить дымовые, тепловые и газовые датчики на пикетах объекта. При нескольких пикетах — выезд бригады.",
    "flood": "Проверить насосы и датчики затопления, сверить с осадками. При «Затоплен» — выезд на объект.",
    "failure": "Запланировать ТО: канал даёт отказ или дребезг. Сверить питание/ИБП, не трактовать как инцидент.",
    "intrusion": "Верифицировать НСД: режим охраны, соседние контактные датчики, камеры. Одиночная сработка чаще ложная.",
}
DECISION_TITLES = {
    "dispatch": "Выезд",
    "false_alarm": "Ложное",
    "watch": "Наблюдение",
    "maintenance": "ТО",
}
FIRE_PAIRS = (
    ("Датчик дыма", "Обнаружен дым"),
    ("Газовый датчик", "Обнаружен газ"),
    ("Тепловой датчик", "Не замкнут"),
    ("Ручной извещатель", "Не замкнут"),
)
FLOOD_PAIRS = (
    ("Состояние насоса", "Затоплен"),
    ("Состояние насоса", "Работают все насосы в АНС"),
    ("Датчик затопления", "Не замкнут"),
)
FAILURE_VALUES = (
    "Неисправен",
    "Обесточен",
    "Отключено устройство",
    "Питание от батарей",
    "Много неисправных устройств",
    "Не определено",
)
INTRUSION_TYPES = (
    "Датчик движения",
    "КД АВ",
    "КД Дверь",
    "КД Люк",
    "Стекло",
    "9-секционный люк",
)
INTRUSION_PAIRS = (("Состояние УИР-Р", "Рычаг сдернут"),)
HOURLY_SENSOR_TYPES = (
    "Датчик температуры",
    "Тепловой датчик",
    "Датчик затопления",
    "Состояние насоса",
    "Состояние вентилятора",
)
FLOOD_MONTHS = (3, 4, 5, 6, 7, 8)
HEATING_MONTHS = (11, 12, 1, 2)


@dataclass(frozen=True)
class Target:
    """Quality goal of one risk and the order in which its two halves are met."""

    min_precision: float
    min_recall: float
    strategy: str


TARGETS = {
    "fire": Target(0.30, 0.70, "recall_first"),
    "flood": Target(0.30, 0.70, "recall_first"),
    "failure": Target(0.40, 0.60, "recall_first"),
    "intrusion": Target(0.80, 0.50, "precision_first"),
}

# Class-conditional seasonal boosts of the alarm rules: risk -> (months, boost).
SEASON_BOOST = {
    "flood": (FLOOD_MONTHS, 0.04),
    "failure": (HEATING_MONTHS, 0.03),
    "fire": (HEATING_MONTHS, 0.02),
}


@dataclass(frozen=True)
class RiskConfig:
    """Vocabulary, windows and thresholds used by the operators."""

    fire_pairs: tuple[tuple[str, str], ...] = FIRE_PAIRS
    flood_pairs: tuple[tuple[str, str], ...] = FLOOD_PAIRS
    failure_values: tuple[str, ...] = FAILURE_VALUES
    intrusion_types: tuple[str, ...] = INTRUSION_TYPES
    intrusion_pairs: tuple[tuple[str, str], ...] = INTRUSION_PAIRS

    smoke_type: str = "Датчик дыма"
    heat_type: str = "Тепловой датчик"
    flood_sensor_type: str = "Датчик затопления"
    temp_types: tuple[str, ...] = ("Датчик температуры",)
    gas_types: tuple[str, ...] = ("Газовый датчик",)
    pump_type: str = "Состояние насоса"
    fan_type: str = "Состояние вентилятора"
    guard_type: str = "Состояние охраны"
    door_types: tuple[str, ...] = ("Датчик движения", "КД Дверь", "КД АВ", "КД Люк")
    on_value: str = "Включен"
    guard_on_value: str = "На охране"
    hourly_types: tuple[str, ...] = HOURLY_SENSOR_TYPES

    # Sensor families shown on an object's card.
    card_fire_types: tuple[str, ...] = ("Датчик дыма", "Тепловой датчик", "Газовый датчик", "Ручной извещатель")
    card_flood_types: tuple[str, ...] = ("Датчик затопления", "Состояние насоса")
    card_guard_types: tuple[str, ...] = ("Датчик движения", "КД АВ", "КД Дверь", "КД Люк", "Стекло")
    no_picket: str = "без пикета"
    no_sensor: str = "НЕТ В СПРАВОЧНИКЕ"
    no_system: str = "—"

    # A thermometer outside this range is broken, not cold.
    temp_min: float = -45.0
    temp_max: float = 90.0

    history_hours: int = 24
    short_hours: int = 6
    horizon_hours: int = 24
    noisy_fire_events: int = 365
    noisy_flood_events: int = 365
    min_object_events: int = 100
    # An event whose channel name carries no picket still counts as one (empty) picket.
    count_blank_picket: bool = True
    # 0 = weather of the same day (look-ahead inside the day), 1 = the day before, …
    weather_lag_days: int = 0

    train_years: tuple[int, ...] = (2019, 2020, 2021, 2022, 2023, 2024)
    valid_years: tuple[int, ...] = (2025,)
    test_years: tuple[int, ...] = (2026,)
    targets: dict[str, Target] = field(default_factory=lambda: dict(TARGETS))


def default_config() -> RiskConfig:
    """The production vocabulary."""
    return RiskConfig()


# Feature panel, in output order.
ID_COLUMNS = ("object_id", "hour_ts", "day")
LABEL_COLUMNS = tuple(f"y_{r}_cnt" for r in RISKS) + tuple(f"y_{r}" for r in RISKS)
FEATURE_COLUMNS = (
    "hour_of_day", "day_of_week", "month", "month_sin", "month_cos", "flood_season", "heating_season",
    "n_channels", "n_smoke", "n_heat", "n_pump", "n_flood_sensor", "n_temp", "n_gas", "n_guard", "n_pickets",
    "ev_1h", "ev_6h", "ev_24h", "al_1h", "al_6h", "al_24h", "fire_1h", "fire_6h", "fire_24h",
    "flood_1h", "flood_6h", "flood_24h", "failure_1h", "failure_6h", "failure_24h", "failure_new_24h",
    "intrusion_1h", "intrusion_6h", "intrusion_24h", "fire_pickets_6h", "intrusion_channels_6h",
    "pump_on_6h", "pump_on_24h", "fan_on_24h", "chatter_max_24h", "channel_touches_24h", "events_per_channel_24h",
    "temp_mean_6h", "temp_mean_24h", "temp_max_6h", "temp_max_24h", "temp_min_24h", "temp_trend",
    "gas_mean_24h", "gas_max_6h", "gas_max_24h", "guard_on", "temp_out", "precip", "humidity",
)
PANEL_COLUMNS = ID_COLUMNS + FEATURE_COLUMNS + LABEL_COLUMNS
