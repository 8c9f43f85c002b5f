"""Settings of a run: one table of names, kinds and rules; files and overrides that break any are refused as a whole."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from types import MappingProxyType

from pyspark.sql import SparkSession

from strideframe.errors import SettingsError
from strideframe.operators.evaluate import SCENARIOS
from strideframe.schema import CHANNELS, COMPOSITIONS
from strideframe.sources.artifacts import identity


@dataclass(frozen=True)
class Field:
    """``follows`` names the setting whose value this one has unless it is given itself; ``kind`` of None lets null be a value too."""

    kinds: tuple[type | None, ...]
    default: object = None
    rule: Callable[[object], bool] = lambda v: True
    says: str = ""
    follows: str | None = None

    def wrong(self, value) -> str | None:
        if value is None and None in self.kinds:
            return None
        known = tuple(k for k in self.kinds if k is not None)
        if isinstance(value, bool) and bool not in known or not isinstance(value, (*known, int) if float in known else known):
            return f"is {type(value).__name__}, not {' or '.join(k.__name__ for k in known)}"
        return None if self.rule(value) else f"is {value!r}, not {self.says}"


def _among(*names: str):
    return lambda v: v in names


_positive, _share = (lambda v: v > 0, "positive"), (lambda v: 0 < v < 1, "between 0 and 1")
FIELDS: Mapping[str, Field] = MappingProxyType({
    "seed": Field((int,), 42, lambda v: v >= 0, "0 or more"),
    "sampling.seed": Field((int,), rule=lambda v: v >= 0, says="0 or more", follows="seed"),
    "split.seed": Field((int,), rule=lambda v: v >= 0, says="0 or more", follows="seed"),
    "split.held_out": Field((int, str, None)),
    "split.validation_fraction": Field((float,), 0.15, *_share),
    "recordings.composition": Field((str,), "harth_walking_speed", _among(*COMPOSITIONS), f"one of {sorted(COMPOSITIONS)}"),
    "recordings.variant": Field((str,), "six_channel", _among(*CHANNELS), f"one of {sorted(CHANNELS)}"),
    "recordings.rate_hz": Field((float,), 50.0, *_positive),
    "windows.samples": Field((int,), 160, *_positive),
    "windows.hop": Field((int,), 40, *_positive),
    "windows.mode": Field((str,), "strict", _among("strict", "compat"), "strict or compat"),
    "scenarios.names": Field((list,), list(SCENARIOS), lambda v: bool(v) and set(v) <= set(SCENARIOS), f"some of {list(SCENARIOS)}"),
    "scenarios.scarce": Field((int,), 2, *_positive),
    "scenarios.synthetic_cap": Field((int,), 500, lambda v: v >= 0, "0 or more"),
    "forest.trees": Field((int,), 100, *_positive),
    "forest.exact": Field((bool,), False),
    "forest.seed": Field((int,), rule=lambda v: v >= 0, says="0 or more", follows="seed"),
})


def _flat(tree: Mapping, at: str = "") -> dict:
    """Dotted names of a nested object; what a table name stands for is a value, whatever it holds."""
    out: dict = {}
    for name, value in tree.items():
        path = f"{at}.{name}" if at else str(name)
        out |= _flat(value, path) if isinstance(value, Mapping) and path not in FIELDS else {path: value}
    return out


class Settings(Mapping):
    """Every setting by its dotted name, given or by default; equal settings have one ``identity``."""

    def __init__(self, given: Mapping | None = None):
        given = _flat(given or {})
        broken = [f"{name} isn't a setting" for name in given if name not in FIELDS]
        broken += [f"{name} {text}" for name, value in given.items() if name in FIELDS and (text := FIELDS[name].wrong(value))]
        if broken:
            raise SettingsError("; ".join(sorted(broken)))
        self.given = given
        own = {name: given.get(name, f.default) for name, f in FIELDS.items() if f.follows is None}
        own |= {name: given.get(name, own[f.follows]) for name, f in FIELDS.items() if f.follows is not None}
        self.values = MappingProxyType({name: own[name] for name in FIELDS})
        if own["windows.hop"] > own["windows.samples"]:
            raise SettingsError(f"windows.hop {own['windows.hop']} leaves gaps between windows of {own['windows.samples']}")

    def __getitem__(self, name: str):
        return self.values[name]

    def __iter__(self):
        return iter(self.values)

    def __len__(self) -> int:
        return len(self.values)

    def overridden(self, overrides: Mapping | None = None, **named) -> Settings:
        """With other values; a ``seed`` moves all that follow it, but those that are named themselves, here or before."""
        return Settings(self.given | _flat(named) | _flat(overrides or {}))

    @property
    def identity(self) -> str:
        return identity(dict(self.values))


def read_settings(spark: SparkSession, path: str, overrides: Mapping | None = None, **named) -> Settings:
    """A JSON file of nested or dotted settings; a name that comes twice is refused."""

    def once(pairs):
        if twice := {k for k, _ in pairs if [x for x, _ in pairs].count(k) > 1}:
            raise SettingsError(f"names come twice: {sorted(twice)}")
        return dict(pairs)

    try:
        tree = json.loads(spark.read.text(path, wholetext=True).first()[0].removeprefix("﻿"), object_pairs_hook=once)
    except (json.JSONDecodeError, TypeError) as broken:
        raise SettingsError("not JSON") from broken
    if not isinstance(tree, dict):
        raise SettingsError("settings are one object")
    return Settings(tree).overridden(overrides, **named)
