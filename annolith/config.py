"""Settings of a run: checked by ranges, merged over defaults, and read from the short forms of a command line."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any


class ConfigError(ValueError):
    """A setting that is unknown, of the wrong kind or out of range."""


def within(name: str, value: Any, low: float, high: float) -> list[str]:
    ok = isinstance(value, (int, float)) and not isinstance(value, bool) and low <= value <= high
    return [] if ok else [f"{name} must be a number from {low:g} to {high:g}, not {value!r}"]


def interval(name: str, value: Any, low: float, high: float) -> list[str]:
    """A pair in order, both ends within the bounds."""
    if not isinstance(value, (list, tuple)) or len(value) != 2:
        return [f"{name} must be a pair, not {value!r}"]
    found = [p for k, v in zip("01", value, strict=True) for p in within(f"{name}[{k}]", v, low, high)]
    return found or ([] if value[0] <= value[1] else [f"{name} is out of order: {value!r}"])


def probabilities(name: str, value: Any, keys: Sequence[str]) -> list[str]:
    """A mapping of known keys to numbers from 0 to 1."""
    if not isinstance(value, Mapping):
        return [f"{name} must be a mapping, not {value!r}"]
    return [f"{name}: {k!r} is unknown" for k in value if k not in keys] + [p for k, v in value.items() if k in keys for p in within(f"{name}.{k}", v, 0, 1)]


def weights(name: str, value: Any, keys: Sequence[str]) -> list[str]:
    """A mapping of known keys to non-negative numbers of which one is above 0."""
    if not isinstance(value, Mapping) or not value:
        return [f"{name} must be a filled mapping, not {value!r}"]
    found = [f"{name}: {k!r} is unknown" for k in value if k not in keys] + [p for k, v in value.items() for p in within(f"{name}.{k}", v, 0, float("inf"))]
    return found or ([] if sum(value.values()) > 0 else [f"{name} sums to 0"])


def checked(config: Mapping[str, Any], rules: Mapping[str, Callable[[str, Any], list[str]]]) -> dict[str, Any]:
    """config, or an error that names every setting at fault; rules take a name and a value."""
    found = [f"{name} is missing" for name in rules if name not in config]
    found += [p for name, rule in rules.items() if name in config for p in rule(name, config[name])]
    if found:
        raise ConfigError("; ".join(found))
    return dict(config)


def overlaid(base: Mapping[str, Any], over: Mapping[str, Any], name: str = "") -> dict[str, Any]:
    """base with the settings of over, mappings merged at every depth; names that begin with _ are comments, others must be known to base."""
    if not isinstance(over, Mapping):
        raise ConfigError(f"{name or 'the configuration'} must be a mapping, not {over!r}")
    out = dict(base)
    for key, value in over.items():
        if key.startswith("_"):
            continue
        if key not in base:
            raise ConfigError(f"{f'{name}.{key}' if name else key} is no known setting")
        out[key] = overlaid(base[key], value, f"{name}.{key}".lstrip(".")) if isinstance(base[key], Mapping) else value
    return out


def pairs(text: str, known: Sequence[str], kind: Callable[[str], Any] = float) -> dict[str, Any]:
    """`a=1,b=2` as a mapping."""
    out: dict[str, Any] = {}
    for part in filter(None, map(str.strip, text.split(","))):
        key, sign, value = (x.strip() for x in part.partition("="))
        if not sign or key not in known:
            raise ConfigError(f"{part!r} is not one of {', '.join(known)} with a value")
        try:
            out[key] = kind(value)
        except ValueError:
            raise ConfigError(f"{value!r} is no value for {key}") from None
    if not out:
        raise ConfigError("no settings are given")
    return out


def size(text: str) -> tuple[int, int]:
    """`640x480` as two whole numbers."""
    width, sign, height = text.lower().partition("x")
    if not (sign and width.strip().isdigit() and height.strip().isdigit()):
        raise ConfigError(f"{text!r} is no size like 640x480")
    return int(width), int(height)
