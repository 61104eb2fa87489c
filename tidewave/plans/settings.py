"""Settings: dotted overrides, a hash that names results, and sweeps over them."""

from __future__ import annotations

import copy
import hashlib
import json
from collections.abc import Iterable, Mapping

from pyspark.sql import SparkSession


def digest(settings: Mapping) -> str:
    """The first twelve hex digits of SHA-256 over the sorted JSON."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:12]


def _value(text: str):
    try:
        return json.loads(text)
    except ValueError:
        words = {"true": True, "false": False, "null": None, "none": None, "~": None}
        return words.get(text.lower(), text)


def load(spark: SparkSession, path: str) -> dict:
    """Settings from a JSON file in any store that Spark reads; anything but an object of settings is an error."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} isn't one file")
    found = json.loads(rows[0]["value"])
    if not isinstance(found, dict):
        raise ValueError(f"{path} doesn't hold an object of settings")
    return found


def override(settings: Mapping, changes: Iterable[str]) -> dict:
    """A copy with `dotted.key=value` changes; an unknown key or a change without '=' is an error."""
    out = copy.deepcopy(dict(settings))
    for change in changes:
        key, sign, text = change.partition("=")
        if not sign:
            raise ValueError(f"{change} is not of the form key=value")
        *path, last = key.strip().split(".")
        at = out
        for part in path:
            at = at.get(part) if isinstance(at, dict) else None
        if not isinstance(at, dict) or last not in at:
            raise KeyError(f"unknown setting {key}")
        at[last] = _value(text.strip())
    return out


def sweep(fixed: Mapping, runs: Iterable[Mapping]) -> list[dict]:
    """The settings of each run: the fixed ones, with the run's own values where both have one; keys must be known."""
    out = []
    for run in runs:
        if unknown := set(run) - set(fixed):
            raise KeyError(f"unknown settings {', '.join(sorted(unknown))}")
        merged = {k: {**v, **run[k]} if isinstance(v, dict) and isinstance(run.get(k), dict) else run.get(k, v) for k, v in fixed.items()}
        out.append(merged | {"name": digest(merged)})
    return out
