"""Typed settings: the first layer that has a value wins, types and ranges are
checked, and where each value came from is kept."""

from __future__ import annotations

from dataclasses import MISSING, dataclass, field, fields
from typing import Any, get_type_hints


class SettingsError(ValueError):
    """A setting is missing, of the wrong type, out of range or unknown."""


def setting(default: Any = MISSING, low: float | None = None, high: float | None = None, above: float | None = None, choices: tuple = ()):
    """A field with its range: ``low`` and ``high`` inclusive, ``above`` exclusive."""
    return field(default=default, metadata={"low": low, "high": high, "above": above, "choices": choices})


def typed(name: str, kind: type, value: Any) -> Any:
    """The value as ``kind``. Flags are true/false/yes/no/on/off/1/0 in any case;
    whole numbers may not lose a fraction; a list is comma-separated or a sequence."""
    if kind is bool:
        flag = {"true": True, "yes": True, "on": True, "1": True, "false": False, "no": False, "off": False, "0": False}.get(str(value).strip().lower())
        if flag is None:
            raise SettingsError(f"{name}: not a flag: {value!r}")
        return flag
    if kind is tuple:
        parts = value.split(",") if isinstance(value, str) else list(value)
        return tuple(dict.fromkeys(p for p in (str(x).strip() for x in parts) if p))
    try:
        if isinstance(value, bool) or (kind is int and float(value) != int(float(value))):
            raise ValueError
        return int(float(value)) if kind is int else kind(value)
    except (TypeError, ValueError, OverflowError):
        raise SettingsError(f"{name}: not {kind.__name__}: {value!r}") from None


def resolve(cls: type, **layers: dict[str, Any] | None) -> tuple[Any, dict[str, str]]:
    """Settings of a frozen dataclass from named layers, strongest first (such as
    ``given``, ``file``); then defaults. Returns them and the layer of each.
    A None in a layer counts as absent; names that no field has raise."""
    kinds, values, origin = get_type_hints(cls), {}, {}
    names = {f.name for f in fields(cls)}
    for layer, entries in layers.items():
        unknown = sorted((entries or {}).keys() - names)
        if unknown:
            raise SettingsError(f"{layer}: unknown settings {unknown}")
    for f in fields(cls):
        for layer, entries in layers.items():
            if (entries or {}).get(f.name) is not None:
                values[f.name], origin[f.name] = typed(f.name, kinds[f.name], entries[f.name]), layer
                break
        else:
            if f.default is MISSING:
                raise SettingsError(f"{f.name}: no value")
            values[f.name], origin[f.name] = f.default, "default"
        x, m = values[f.name], f.metadata
        if m.get("low") is not None and not x >= m["low"] or m.get("high") is not None and not x <= m["high"] or m.get("above") is not None and not x > m["above"]:
            raise SettingsError(f"{f.name}: {x!r} is out of range")
        if m.get("choices") and not set(x if isinstance(x, tuple) else [x]) <= set(m["choices"]):
            raise SettingsError(f"{f.name}: {x!r} is none of {m['choices']}")
    return cls(**values), origin


@dataclass(frozen=True)
class SequenceSettings:
    """How sequences are cut and split; the rest of the fractions is the test."""

    lookback: int = setting(120, low=1)
    horizon: int = setting(15, low=1)
    stride: int = setting(1, low=1)
    sessions: tuple = setting(("premarket", "regular", "aftermarket"), choices=("premarket", "regular", "aftermarket", "overnight"))
    train_fraction: float = setting(0.7, above=0.0, high=1.0)
    validation_fraction: float = setting(0.15, above=0.0, high=1.0)

    def __post_init__(self):
        if not self.train_fraction + self.validation_fraction < 1:
            raise SettingsError("train and validation leave no test fraction")
        if not self.sessions:
            raise SettingsError("sessions: none given")

    @property
    def test_fraction(self) -> float:
        return 1 - self.train_fraction - self.validation_fraction
