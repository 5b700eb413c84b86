"""Severity and confidence vocabularies. There are three of severity, which differ on purpose; they are never merged."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: finding severities and their order
FINDING = {"critical": "critical", "high": "high", "error": "high", "medium": "medium", "warning": "medium", "low": "low", "info": "info"}
RANK = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
CONFIDENCE = {"high": 0.9, "medium": 0.6, "low": 0.3}
# fixed values: weights of the consensus score
SEVERITY_WEIGHT = {"CRITICAL": 1.0, "HIGH": 0.8, "MEDIUM": 0.6, "LOW": 0.4, "INFO": 0.2}
CONFIDENCE_WEIGHT = {"HIGH": 1.0, "MEDIUM": 0.75, "LOW": 0.5}


def lookup(values: dict, key: Column, default) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def finding_severity(raw: Column) -> Column:
    """Null and unknown words are info."""
    return F.when(raw.isNull(), "info").otherwise(lookup(FINDING, F.lower(F.trim(raw)), "info"))


def consensus_severity(raw: Column) -> Column:
    """Null and unknown words are MEDIUM, and information counts as LOW."""
    known = {"CRITICAL": "CRITICAL", "HIGH": "HIGH", "ERROR": "HIGH", "MEDIUM": "MEDIUM", "WARNING": "MEDIUM", "LOW": "LOW", "INFO": "LOW"}
    return F.when(raw.isNull(), "MEDIUM").otherwise(lookup(known, F.upper(F.trim(raw)), "MEDIUM"))


def consensus_confidence(raw: Column) -> Column:
    """Null and unknown words are MEDIUM."""
    known = {"HIGH": "HIGH", "MEDIUM": "MEDIUM", "LOW": "LOW"}
    return F.when(raw.isNull(), "MEDIUM").otherwise(lookup(known, F.upper(raw), "MEDIUM"))


def stored_severity(raw: Column, source: Column) -> Column:
    """As kept in report rows: what is missing is UNKNOWN for bandit and INFO for semgrep."""
    return F.when(raw.isNull() | (raw == ""), F.when(source == "bandit", "UNKNOWN").otherwise("INFO")).otherwise(F.upper(raw))


def rank(severity: Column) -> Column:
    return F.when(severity.isNull(), 0).otherwise(lookup(RANK, F.lower(severity), 0))


def confidence(raw: Column) -> Column:
    """Words to numbers; a number is clamped to [0, 1]; anything else is 0.5."""
    number = raw.try_cast("double")
    word = lookup(CONFIDENCE, F.lower(F.trim(raw)), 0.5)
    return F.when(raw.isNull(), 0.5).when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))).otherwise(word)


def consensus_score(severity: Column, confidence_word: Column, scanners: Column) -> Column:
    """Severity weight times confidence weight times min(1, 0.5 + 0.1 per scanner)."""
    s, c = lookup(SEVERITY_WEIGHT, F.upper(severity), 0.5), lookup(CONFIDENCE_WEIGHT, F.upper(confidence_word), 0.5)
    return s * c * F.least(F.lit(1.0), F.lit(0.5) + scanners * 0.1)


def consensus_label(severity: Column, confidence_word: Column, scanners: Column, score: Column) -> Column:
    sure = (scanners >= 3) | (severity == "CRITICAL") | ((scanners >= 2) & (confidence_word == "HIGH")) | (score >= 0.4)
    return F.when(sure, 1).otherwise(0)
