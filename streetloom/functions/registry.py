"""Kinematics of transport modes: how long a vehicle takes for a stretch."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_SPEED = 60.0


@dataclass(frozen=True)
class TransportSpec:
    name: str
    vmax_kmh: float
    accel_m: float
    brake_m: float
    coef: float

    def validate(self) -> TransportSpec:
        if not self.name or not self.name.strip():
            raise ValueError("a mode needs a name")
        if self.vmax_kmh <= 0:
            raise ValueError(f"{self.name}: top speed must be above 0")
        if self.accel_m < 0 or self.brake_m < 0:
            raise ValueError(f"{self.name}: distances must not be negative")
        if not 0 < self.coef <= 1:
            raise ValueError(f"{self.name}: coefficient must be in (0, 1]")
        return self

    def travel_time(self, length: Column, limit: Column | None = None, min_speed: float = MIN_SPEED) -> Column:
        return travel_time(F.lit(float(self.vmax_kmh)), F.lit(float(self.accel_m)), F.lit(float(self.brake_m)), F.lit(float(self.coef)), length, limit, min_speed)


def travel_time(vmax_kmh: Column, accel: Column, brake: Column, coef: Column, length: Column, limit: Column | None = None, min_speed: float = MIN_SPEED) -> Column:
    """Minutes for a stretch between two stops: speed up, cruise, brake; too short a stretch only peaks."""
    top = vmax_kmh * 1000.0 / 60.0
    if limit is not None:
        top = F.when((limit > 0) & ~F.isnan(limit), F.least(top, limit)).otherwise(top)
    v = F.greatest(top * coef, F.lit(min_speed))
    ramp = accel + brake
    peak = F.greatest(v * length / ramp, F.lit(min_speed))
    whole = 2.0 * accel / v + 2.0 * brake / v + (length - ramp) / v
    return F.when(length <= 0, 0.0).when((ramp > 1e-9) & (length < ramp), 2.0 * length / peak).otherwise(whole)


# The default modes.
DEFAULTS = [
    TransportSpec("bus", 90, 700, 650, 0.7),
    TransportSpec("trolleybus", 70, 750, 700, 0.7),
    TransportSpec("tram", 75, 500, 450, 0.8),
    TransportSpec("subway", 80, 450, 450, 0.9),
]
TRAIN = TransportSpec("train", 140, 600, 450, 0.97)


class TransportRegistry:
    """Modes by name; names are compared in lower case without outer white space."""

    def __init__(self, specs: list[TransportSpec] = DEFAULTS):
        self._specs = {self._key(s.name): s.validate() for s in specs}

    @staticmethod
    def _key(name: str) -> str:
        return name.strip().lower()

    def get(self, name: str) -> TransportSpec:
        try:
            return self._specs[self._key(name)]
        except KeyError:
            raise KeyError(f"unknown transport type: {name}") from None

    def try_get(self, name: str) -> TransportSpec | None:
        return self._specs.get(self._key(name))

    def add(self, spec: TransportSpec, overwrite: bool = False) -> None:
        if not overwrite and self._key(spec.name) in self._specs:
            raise KeyError(f"transport type exists: {spec.name}")
        self._specs[self._key(spec.name)] = replace(spec, name=self._key(spec.name)).validate()

    def update(self, name: str, **changes) -> TransportSpec:
        self._specs[self._key(name)] = replace(self.get(name), **changes).validate()
        return self.get(name)

    def remove(self, name: str) -> None:
        self.get(name)
        del self._specs[self._key(name)]

    def ensure(self, name: str, vmax_kmh: float = 25, accel_m: float = 500, brake_m: float = 500, coef: float = 0.8) -> TransportSpec:
        if self.try_get(name) is None:
            self.add(TransportSpec(self._key(name), vmax_kmh, accel_m, brake_m, coef))
        return self.get(name)

    def list_types(self) -> list[str]:
        return sorted(self._specs)

    def to_df(self, spark: SparkSession) -> DataFrame:
        """One row per mode, for joins."""
        rows = [(k, float(s.vmax_kmh), float(s.accel_m), float(s.brake_m), float(s.coef)) for k, s in sorted(self._specs.items())]
        return spark.createDataFrame(rows, "mode string, vmax double, accel double, brake double, coef double")

    def check(self, modes: list[str]) -> None:
        unknown = [m for m in modes if self.try_get(m) is None]
        if unknown:
            raise ValueError(f"unknown transport types: {unknown}")
