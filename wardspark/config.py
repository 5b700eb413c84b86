"""Settings in layers: defaults, a file, the environment, the session."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import SparkSession

# fixed values: settings and what they are without any layer above; files that are looked for, in this order
DEFAULTS = {"base_ref": "main", "semgrep_config": "max", "output_dir": ".", "artifacts_dir": "artifacts", "report_format": "both", "fail_on_severity": None, "verbose": False, "quiet": False, "color": True}
FILES = [".wardspark.toml", "wardspark.toml"]
#: Variables of the environment with other names than their settings; settings that have none; flags that are turned round.
PREFIX, NAMES, UNNAMED, INVERTED = "WARDSPARK_", {"color": "NO_COLOR", "fail_on_severity": "FAIL_ON"}, ("report_format",), ("color",)
TRUE = ("1", "true", "yes")


def found(folders: list[str | Path]) -> Path | None:
    """The first file of settings in these folders."""
    return next((p for f in folders for n in FILES if (p := Path(f) / n).is_file()), None)


def from_file(path: str | Path | None) -> dict:
    """What a file sets; nothing if it isn't there or can't be read."""
    try:
        return tomllib.loads(Path(path).read_text(encoding="utf-8")) if path else {}
    except (OSError, UnicodeDecodeError, tomllib.TOMLDecodeError):
        return {}


def _value(key: str, text: str, inverted: bool = False):
    return (text.lower() in TRUE) != inverted if isinstance(DEFAULTS.get(key), bool) else text


def from_environment(env: Mapping[str, str]) -> dict:
    names = {k: PREFIX + NAMES.get(k, k.upper()) for k in DEFAULTS if k not in UNNAMED}
    return {k: _value(k, env[n], k in INVERTED) for k, n in names.items() if n in env}


def from_session(spark: SparkSession) -> dict:
    """Settings of the session under ``wardspark.``."""
    said = {k: spark.conf.get(f"wardspark.{k}", None) for k in DEFAULTS}
    return {k: _value(k, v) for k, v in said.items() if v is not None}


def load(path: str | Path | None = None, folders: list[str | Path] = (".", "~"), env: Mapping[str, str] | None = None, spark: SparkSession | None = None) -> dict:
    """All settings: a later layer wins. Without a path the folders are searched; keys that aren't known stay."""
    path = path or found([Path(f).expanduser() for f in folders])
    return DEFAULTS | from_file(path) | from_environment(os.environ if env is None else env) | (from_session(spark) if spark is not None else {})
