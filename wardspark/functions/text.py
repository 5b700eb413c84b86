"""Expressions over strings: redaction, masking, tokens, chunks, excerpts, diffs, versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what counts as a secret in text
SECRETS = ["AKIA[0-9A-Z]{16}", "ghp_[A-Za-z0-9]{36}", "sk-[A-Za-z0-9]{20,}", "AIza[0-9A-Za-z\\-_]{35}", "-----BEGIN [A-Z ]+PRIVATE KEY-----"]
LONG_TOKEN = "[A-Za-z0-9_\\-/=+]{32,}"
# fixed values: what the gateway masks, by key and by value
SECRET_KEY = "(?i)token|secret|apikey|api_key|authorization"
SECRET_VALUES = [
    ("github_token", "ghp_[A-Za-z0-9]{36}"),
    ("github_token", "github_pat_[A-Za-z0-9_]{20,}"),
    ("openai_key", "sk-[A-Za-z0-9]{20,}"),
    ("generic_bearer", "Bearer\\s+[A-Za-z0-9._-]+"),
    ("jwt", "[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+"),
]


def redact_secrets(text: Column) -> Column:
    """Known secrets, then any token of 32 characters or more, become [REDACTED]."""
    for p in [*SECRETS, LONG_TOKEN]:
        text = F.regexp_replace(text, p, "[REDACTED]")
    return text


def mask_value(value: Column) -> Column:
    """Four characters at each end; a value of at most eight is hidden altogether."""
    return F.when(F.char_length(value) <= 8, "***REDACTED***").otherwise(F.concat(F.left(value, F.lit(4)), F.lit("***"), F.right(value, F.lit(4))))


#: A character of a JSON string, and a key that names a secret with the colon behind it.
_CHAR = r'(?:[^"\\]|\\u[0-9a-fA-F]{4}|\\[^u])'
_NAMED = rf'(?i)("{_CHAR}*(?:token|secret|authorization|apikey){_CHAR}*"\s*:\s*)'


def masked_json(text: Column) -> Column:
    """JSON with the strings masked that stand under keys which name secrets, at any depth: four characters at each end,
    of eight at least. What is masked already stays."""
    long = F.regexp_replace(text, rf'{_NAMED}"(?!\*\*\*REDACTED\*\*\*")({_CHAR}{{4}}){_CHAR}*({_CHAR}{{4}})"', '$1"$2***$3"')
    return F.regexp_replace(long, rf'{_NAMED}"{_CHAR}{{0,7}}"', '$1"***REDACTED***"')


def secret_type(value: Column) -> Column:
    """The first kind of secret that a value holds, or null."""
    found = F.lit(None).cast("string")
    for kind, pattern in reversed(SECRET_VALUES):
        found = F.when(value.rlike(pattern), kind).otherwise(found)
    return found


def blocked_output(text: Column, patterns: list[str] = ()) -> Column:
    """Whether an output holds a listed string, a dangerous command or a code fence."""
    hit = text.rlike("rm\\s+-rf") | text.rlike("(?i)DROP\\s+TABLE") | text.rlike("(?i)curl\\s+[^\\n]*\\|\\s*sh") | text.contains("```")
    for p in patterns:
        hit = hit | text.contains(p)
    return hit


def identifier_tokens(text: Column) -> Column:
    """Lower-cased identifiers of two characters or more."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z_][a-z0-9_]+"), 0)


def code_tokens(text: Column) -> Column:
    """Identifiers, numbers and single other signs."""
    return F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\\sA-Za-z0-9_]"), 0)


def chunks(text: Column, size: int, overlap: int) -> Column:
    """Overlapping pieces of ``size`` characters; the last one ends with the text."""
    n, step = F.char_length(text), size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - F.lit(size)) / F.lit(step)).cast("int")) * step, F.lit(step))
    return F.when(n > 0, F.transform(starts, lambda s: F.substr(text, s + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def line_windows(lines: Column, size: int, stride: int) -> Column:
    """Windows of ``size`` lines, one every ``stride``; tails are kept."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(lines) - 1, F.lit(0)), F.lit(stride))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(lines, s + 1, F.lit(size)).alias("lines")))


def version_key(version: Column) -> Column:
    """Three numbers of a version, without operators before it; missing ones are 0."""
    v = F.regexp_replace(version, "^[\\s^~<>=!v]+", "")
    part = lambda k: F.coalesce(F.regexp_extract(v, f"^(?:\\d+\\.){{{k}}}(\\d+)", 1).try_cast("int"), F.lit(0))
    return F.struct(part(0).alias("major"), part(1).alias("minor"), part(2).alias("patch"))


def language_of(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1))
    return F.when(suffix == "py", "python").when(suffix.isin("ts", "tsx"), "typescript").when(suffix.isin("js", "jsx", "mjs", "cjs"), "javascript").otherwise("unknown")


def normal_path(path: Column) -> Column:
    """Leading dots and slashes go, as characters."""
    return F.ltrim(path, F.lit("./"))


def excerpt(lines: Column, start: Column, end: Column, context: int = 2, most: int = 12, chars: int = 1200) -> Column:
    """Lines around a span, those of the span marked, redacted and cut."""
    first = F.greatest(start - context, F.lit(1))
    last = F.least(end + context, F.size(lines), first + most - 1)
    rows = F.transform(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>")), lambda k: F.concat(F.when((k >= start) & (k <= end), "> ").otherwise("  "), F.element_at(lines, k)))
    return F.left(redact_secrets(F.array_join(rows, "\n")), F.lit(chars))


def diff_stats(diff: Column) -> Column:
    """Added and removed lines, hunks and files of a unified diff."""
    rows = F.split(diff, "\n")
    n = lambda cond: F.size(F.filter(rows, cond))
    return F.struct(
        n(lambda x: x.startswith("+") & ~x.startswith("+++")).alias("added"),
        n(lambda x: x.startswith("-") & ~x.startswith("---")).alias("removed"),
        n(lambda x: x.startswith("@@")).alias("hunks"),
        n(lambda x: x.startswith("+++ ")).alias("files"),
    )


def snippet(text: Column, most: int = 300) -> Column:
    """Without code blocks, white space collapsed, cut."""
    return F.left(F.trim(F.regexp_replace(F.regexp_replace(text, "(?s)```.*?```", " "), "\\s+", " ")), F.lit(most))
