"""Deterministic fixes, applied file by file, and checks of what a model returns."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixes of one line: kind, what must be there, and what comes in its place.
LINE_FIXES = {
    "untrusted_to_innerhtml": (re.compile(r"\.innerHTML(\s*=)"), r".textContent\1"),
    "json_eval": (re.compile(r"\beval\s*\("), "JSON.parse("),
    "shell_true": (re.compile(r"shell\s*=\s*True"), "shell=False"),
    "regexp_escape": (re.compile(r"new\s+RegExp\s*\(\s*([A-Za-z_$][\w$]*)\s*\)"), r"new RegExp(escapeRegExp(\1))"),
    "constant_time_compare": (re.compile(r"\b([A-Za-z_]\w*(?:token|secret|digest|signature))\s*==\s*([A-Za-z_]\w*)"), r"hmac.compare_digest(\1, \2)"),
}
IMPORTS = {"constant_time_compare": "import hmac"}
HELPERS = {"regexp_escape": "function escapeRegExp(s) { return s.replace(/[.*+?^${}()|[\\]\\\\]/g, '\\\\$&'); }"}
PATCHED = "filepath string, finding_id string, status string, reason string, diff string"


def apply_fixes(files: DataFrame, findings: DataFrame) -> DataFrame:
    """files: filepath, text; findings: finding_id, filepath, line, fix. A file's findings are applied from its end to
    its start; one on a line that was changed already is rejected; imports and helpers come in once. The file's diff
    stands with its last applied finding."""

    def per_file(rows: pd.DataFrame) -> pd.DataFrame:
        path, text = rows.filepath.iloc[0], rows.text.iloc[0] or ""
        lines, taken, out, extra = text.split("\n"), set(), [], []
        for r in rows.sort_values(["line", "finding_id"], ascending=[False, True]).itertuples():
            fix = LINE_FIXES.get(r.fix)
            at = int(r.line) - 1
            if fix is None:
                reason = "no fix"
            elif not 0 <= at < len(lines):
                reason = "out of bounds"
            elif at in taken:
                reason = "overlap"
            else:
                new = fix[0].sub(fix[1], lines[at], count=1)
                reason = None if new != lines[at] else "pattern not found"
                if reason is None:
                    lines[at] = new
                    taken.add(at)
                    extra += [x for x in (IMPORTS.get(r.fix), HELPERS.get(r.fix)) if x and x not in text and x not in extra]
            out.append([path, r.finding_id, "rejected" if reason else "patched", reason, None])
        done = [k for k, o in enumerate(out) if o[2] == "patched"]
        if done:
            diff = difflib.unified_diff(text.split("\n"), extra + lines, f"a/{path}", f"b/{path}", lineterm="", n=3)
            out[done[-1]][4] = "\n".join(diff)
        return pd.DataFrame(out, columns=[c.split(" ")[0] for c in PATCHED.split(", ")])

    j = findings.join(files, "filepath").select("filepath", "text", "finding_id", "line", "fix")
    return j.groupBy("filepath").applyInPandas(per_file, PATCHED)


def diff_only(text: Column) -> Column:
    """The first reason why a model's answer isn't just a diff, or null."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return (
        F.when(text.contains("```"), "contains code fence")
        .when(text.rlike("\\bExplanation\\b"), "contains prose")
        .when(F.size(lines) == 0, "empty response")
        .when(~(lines[0].startswith("diff --git") | lines[0].startswith("--- a/")), "missing diff header")
        .when(F.exists(lines, lambda x: x.startswith("$")), "contains shell prompt")
    )


def candidate_features(candidates: DataFrame) -> DataFrame:
    """Eight numbers of a candidate: lines, files, hunks, length, origin, validation, errors."""
    from wardspark.functions.text import diff_stats

    s = diff_stats(F.col("diff"))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    v = F.array(*[x.cast("double") for x in (s["added"] + s["removed"], s["files"], s["hunks"], F.char_length("diff"), flag(F.col("source") == "deterministic"), flag(F.col("validated")), F.coalesce("lint_errors", F.lit(0)), F.coalesce("test_failures", F.lit(0)))])
    return candidates.select("candidate_id", v.alias("features"))
