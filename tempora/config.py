"""Settings from a JSON file, the environment and arguments, each over the one before it."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields

#: Environment variables are named so, with the setting in capitals.
PREFIX = "TEMPORA_"
_SECRET = ("password", "token")


@dataclass
class Config:
    table: str = ""
    rate: str = "1/s"
    aggregates: str = ""
    granularity: str = "1h"
    cross_labels: str = ""
    override: bool = False
    output: str = "text"
    password: str = ""
    token: str = ""

    def __str__(self) -> str:
        shown = {f.name: "******" if f.name in _SECRET and getattr(self, f.name) else getattr(self, f.name) for f in fields(self)}
        return json.dumps(shown)

    __repr__ = __str__


def _typed(default: object, value: object) -> object:
    if isinstance(default, bool) and isinstance(value, str):
        return value.strip().lower() in ("1", "true", "yes")
    return value


def load(path: str = "", environment: dict[str, str] | None = None, **given: object) -> Config:
    """The settings; unknown ones in the file or the arguments are an error."""
    env = os.environ if environment is None else environment
    path = path or env.get(PREFIX + "CONFIG", "")
    found: dict[str, object] = {}
    if path:
        with open(path) as f:
            found |= json.load(f)
    names = {f.name: f.default for f in fields(Config)}
    found |= {n: env[PREFIX + n.upper()] for n in names if PREFIX + n.upper() in env}
    found |= {k: v for k, v in given.items() if v not in (None, "")}
    if unknown := sorted(found.keys() - names.keys()):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return Config(**{k: _typed(names[k], v) for k, v in found.items()})
