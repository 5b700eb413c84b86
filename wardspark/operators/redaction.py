"""Masking of secrets in nested JSON. There are three rules, which differ on purpose; they are never merged.

Objects of any depth cannot be walked by expressions, so these are Arrow-batched functions over JSON strings. A string
that is no JSON object or array comes back as it is; null stays null.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardspark.functions.text import SECRET_VALUES

# fixed values: words of a key, and beginnings of a value, that make a string a secret
KEYS = ("token", "secret", "authorization", "apikey")
BEGINNINGS = ("ghp_", "github_pat_", "sk-", "Bearer ")
_KEY, _VALUES = re.compile("token|secret|apikey|api_key|authorization", re.IGNORECASE), [(k, re.compile(p)) for k, p in SECRET_VALUES]


def _mask(value: str, hidden: int) -> str:
    """Four characters at each end; values up to a length are hidden altogether."""
    return "***REDACTED***" if len(value) <= hidden else f"{value[:4]}***{value[-4:]}"


def _sensitive(key: str) -> bool:
    return any(w in key.lower() for w in KEYS)


def _stored(value: object, key: str = "") -> object:
    if isinstance(value, dict):
        return {k: _stored(v, k) for k, v in value.items()}
    if isinstance(value, list):
        return [_stored(v) for v in value]
    if isinstance(value, str) and (_sensitive(key) or value.startswith(BEGINNINGS)):
        return _mask(value, 8)
    return value


def _event(value: dict) -> dict:
    """Objects only: lists stay as they are, and a value of eight characters is shown in part."""
    out = {}
    for k, v in value.items():
        if isinstance(v, str) and _sensitive(k):
            out[k] = _mask(v, 7)
        else:
            out[k] = _event(v) if isinstance(v, dict) else v
    return out


def _sanitised(value: object, path: str, found: list) -> object:
    if isinstance(value, str):
        for kind, pattern in _VALUES:
            if pattern.search(value):
                found.append((path, kind, _mask(value, 8)))
                return _mask(value, 8)
        return value
    if isinstance(value, list):
        return [_sanitised(v, f"{path}[{k}]", found) for k, v in enumerate(value)]
    if isinstance(value, dict):
        out = {}
        for k, v in value.items():
            at = f"{path}.{k}" if path else k
            if _KEY.search(k) and isinstance(v, str):
                kind = next((n for n, p in _VALUES if p.search(v)), "key_match")
                found.append((at, kind, _mask(v, 8)))
                out[k] = _mask(v, 8)
            else:
                out[k] = _sanitised(v, at, found)
        return out
    return value


def _json(text: str | None):
    try:
        found = json.loads(text) if text else None
    except ValueError:
        return None
    return found if isinstance(found, dict | list) else None


def _each(rule):
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([t if (v := _json(t)) is None else json.dumps(rule(v), ensure_ascii=False) for t in column], dtype=object)

    return F.pandas_udf(run, T.StringType())


def redact_stored(text: Column) -> Column:
    """As events are stored: by key and by how a value begins, at any depth."""
    return _each(_stored)(text)


def redact_event(text: Column) -> Column:
    """As events are sent on: by key, in nested objects."""
    return _each(lambda v: _event(v) if isinstance(v, dict) else v)(text)


def redact_object(text: Column) -> Column:
    """sanitized (JSON) and findings (path, type, masked), in the order of the object."""
    schema = T.StructType().add("sanitized", T.StringType()).add("findings", T.ArrayType(T.StructType().add("path", T.StringType()).add("type", T.StringType()).add("masked", T.StringType())))

    def run(column: pd.Series) -> pd.DataFrame:
        out = []
        for t in column:
            v, found = _json(t), []
            out.append((t if v is None else json.dumps(_sanitised(v, "", found), ensure_ascii=False), [dict(zip(("path", "type", "masked"), f, strict=True)) for f in found]))
        return pd.DataFrame(out, columns=["sanitized", "findings"])

    return F.pandas_udf(run, schema)(text)


# fixed values: what is hidden in the text of a patch
PATCH_SECRETS = [
    r"AKIA[0-9A-Z]{16}",
    r"ghp_[A-Za-z0-9]{36}",
    r"sk-[A-Za-z0-9]{20,}",
    r"AIza[0-9A-Za-z\\-_]{35}",
    r"-----BEGIN [A-Z ]+PRIVATE KEY-----",
    r"[A-Za-z0-9_/=+\\-]{32,}",
]


def redact_patch(text: Column) -> Column:
    """As redact_secrets, but a long token may hold backslashes."""
    for p in PATCH_SECRETS:
        text = F.regexp_replace(text, p, "[REDACTED]")
    return text
