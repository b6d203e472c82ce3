"""Column names, units, row schemas and agronomic parameters."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import types as T

KEY = "station"
DAY = "day"

# The seven daily variables and the headings of the uploaded CSV.
VARIABLES = (
    "pressure_hpa",
    "rh_min",
    "wind_ms",
    "temp_c",
    "rad_j",
    "precip_mm",
    "rh",
)
SPANISH_NAMES = {
    "Presión atmosférica": "pressure_hpa",
    "Humedad relativa mínima": "rh_min",
    "Velocidad del viento": "wind_ms",
    "Temperatura": "temp_c",
    "Radiación solar": "rad_j",
    "Precipitaciones": "precip_mm",
    "Humedad relativa": "rh",
}
DATE_HEADING = "Fecha"

# Headings containing one of these are scaled by median and IQR.
ROBUST_PATTERNS = ("velocidad", "presión", "precipitacion", "precipitaciones")

# The prefixes that saved names carry.
NAME_PREFIXES = ("sarima", "var", "sarimax", "lstm", "window")

MAX_HORIZON = 365
DEFAULT_HORIZON = 30


def scaler_kind(heading: str) -> str:
    """'robust' or 'standard' for a column heading."""
    low = heading.lower()
    return "robust" if any(p in low for p in ROBUST_PATTERNS) else "standard"


SCALER_KINDS = {canon: scaler_kind(name) for name, canon in SPANISH_NAMES.items()}

CLIMATE_SCHEMA = T.StructType(
    [T.StructField(KEY, T.LongType()), T.StructField(DAY, T.DateType())]
    + [T.StructField(v, T.DoubleType()) for v in VARIABLES]
)

SCALE_ENTRY = "struct<kind:string,center:double,scale:double>"
SCALES_TYPE = f"map<string,{SCALE_ENTRY}>"

REGISTRY_SCHEMA = (
    "model_type string, name string, station bigint, target string, "
    "params map<string,string>, coef array<double>, sigma2 double, n bigint, "
    f"scales {SCALES_TYPE}, error string, trained_at timestamp"
)


@dataclass(frozen=True)
class CropParams:
    """Almond orchard under drip irrigation; every value can be overridden.

    ``stage_deficit`` optionally replaces the flat ``deficit`` factor by one
    factor per growth stage (initial, development, mid, late, end).
    """

    stage_days: tuple[int, int, int, int] = (15, 50, 98, 31)
    kc_initial: float = 0.4
    kc_mid: float = 0.9
    kc_end: float = 0.65
    rain_threshold: float = 3.0
    rain_fraction: float = 0.75
    efficiency: float = 0.95
    deficit: float = 0.2
    stage_deficit: tuple[float, float, float, float, float] | None = None


@dataclass(frozen=True)
class TrainConfig:
    """What to fit. ``order`` is (p, d, q), ``seasonal`` is (P, D, Q, s).

    ``regressors`` are the variables a 'sarimax' model regresses on, the target
    always left out; None takes all others. ``min_seasons`` asks for so many
    seasons of differenced days beyond what the estimate itself needs.
    ``parameters`` holds settings of registered families, by family.
    """

    families: tuple[str, ...] = ("sarima", "var")
    order: tuple[int, int, int] = (1, 1, 1)
    seasonal: tuple[int, int, int, int] = (1, 1, 1, 30)
    maxlags: int = 15
    ic: str = "aic"
    test_size: int = 180
    window: int = 30
    ridge: float = 1.0
    variables: tuple[str, ...] = VARIABLES
    regressors: tuple[str, ...] | None = None
    min_seasons: int = 0
    parameters: Mapping[str, Mapping[str, object]] = field(default_factory=dict)

    def __post_init__(self):
        from acequia.models import families  # noqa: F401 - registers the built-in ones
        from acequia.models.family import known

        unknown = set(self.families) - set(known())
        if not self.families or unknown:
            raise ValueError(f"families must be drawn from {known()}, got {self.families}")
        if set(self.regressors or ()) - set(self.variables):
            raise ValueError(f"regressors must be drawn from {self.variables}")
        if self.test_size < 0:
            raise ValueError("test_size must not be negative")
