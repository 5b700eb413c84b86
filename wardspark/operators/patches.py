"""Patches: parsed diffs, policy, ranking, rates, bundles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardspark.functions.text import diff_stats, normal_path

# fixed values: what an added line must not hold, and the categories whose findings a model may patch
BANNED = [
    r"(?i)\bbcrypt\b",
    r"(?i)\bargon2\b",
    r"(?i)\bpasslib\b",
    r"(?i)\bhashlib\.(md5|sha1)\b",
    r"(?i)\bmd5\b",
    r"(?i)\bsha1\b",
    r"(?i)\beval\(",
    r"(?i)\bexec\(",
    r"(?i)\bos\.system\(",
    r"(?i)\bsubprocess\.(run|popen)\(",
    r"\bshell\s*=\s*True\b",
]
ALLOWED = ["injection.xss", "xss", "innerhtml", "insecure-request", "injection.command", "command-injection", "injection.sql", "path.traversal", "ssrf", "unsafe.exec"]
_COMMENT, _IMPORT = r"^(#|//|/\*|\*)", r"^(import\s|from\s|const\s.*require\(|export\s.*from\s)"
PARSED = "files array<string>, hunks array<struct<hunk:int,path:string,lines:array<struct<kind:string,old_line:int,new_line:int,text:string>>>>"


def _first_number(heads: pa.Array, sign: str) -> np.ndarray:
    """The first number behind a sign; 0 where there is none or it is no int."""
    digits = pc.fill_null(pc.struct_field(pc.extract_regex(heads, sign + "(?P<n>[0-9]+)"), [0]), "0")
    if len(digits) and pc.max(pc.binary_length(digits)).as_py() > 9:
        bare = [x.lstrip("0") or "0" for x in digits.to_pylist()]
        digits = pa.array([x if len(x) <= 10 and int(x) < 1 << 31 else "0" for x in bare], pa.string())
    return pc.cast(digits, pa.int64()).to_numpy()


def _parse(diffs: pa.Array) -> pa.Array:
    """Files and hunks of a batch of diffs. All lines lie in one array; what stands before a line is counted by running sums."""
    split = pc.split_pattern(pc.fill_null(diffs, ""), "\n")
    at, lines = split.offsets.to_numpy(), split.flatten()
    starts = lambda x, p: pc.starts_with(x, p).to_numpy(zero_copy_only=False)
    mark = starts(lines, "@@")
    head = mark.copy()
    head[at[:-1]] = True
    plus, minus = (starts(lines, c) & ~starts(lines, c * 3) & ~head for c in "+-")
    out = plus | minus | starts(lines, " ") & ~head

    path_at = np.flatnonzero(starts(lines, "+++ "))
    path = pc.utf8_trim(pc.utf8_slice_codeunits(lines.take(pa.array(path_at)), 4), " ")
    path = pc.if_else(pc.starts_with(path, "b/"), pc.utf8_slice_codeunits(path, 2), path)
    known = pc.not_equal(path, "/dev/null")
    path_at, path = path_at[known.to_numpy(zero_copy_only=False)], path.filter(known)
    paths_of = np.searchsorted(path_at, at)

    hunk_at = np.flatnonzero(mark)
    of = np.searchsorted(at, hunk_at, "right") - 1
    before = np.searchsorted(path_at, hunk_at)
    named = before > paths_of[of]  # heads before any path begin no hunk
    hunk_at, of, before = hunk_at[named], of[named], before[named]
    hunks_of = np.searchsorted(hunk_at, at)
    heads = lines.take(pa.array(hunk_at))

    head_at = np.flatnonzero(head)
    piece = np.searchsorted(head_at, np.flatnonzero(out), "right") - 1
    hunk = np.full(len(head_at), -1)
    hunk[np.searchsorted(head_at, hunk_at)] = np.arange(len(hunk_at))
    line_at = np.flatnonzero(out)[hunk[piece] >= 0]
    hunk = hunk[piece][hunk[piece] >= 0]

    def numbers(sign: str, other: np.ndarray) -> pa.Array:
        passed = np.cumsum(~other & ~head)  # a head counts nothing, so this is what stands up to it
        found = _first_number(heads, sign)[hunk] + passed[line_at] - 1 - passed[hunk_at[hunk]]
        return pa.array(found, pa.int32(), mask=other[line_at])

    kind = pa.array([" ", "-", "+"]).take(pa.array(minus[line_at] + 2 * plus[line_at]))
    text = pc.utf8_slice_codeunits(lines.take(pa.array(line_at)), 1)
    rows = pa.StructArray.from_arrays([kind, numbers("-", plus), numbers("[+]", minus), text], ["kind", "old_line", "new_line", "text"])
    listed = lambda offsets, x: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), x)
    number = pa.array(np.arange(len(hunk_at)) - hunks_of[of] + 1, pa.int32())
    hunks = pa.StructArray.from_arrays([number, path.take(pa.array(before - 1)), listed(np.append(np.searchsorted(line_at, hunk_at), len(line_at)), rows)], ["hunk", "path", "lines"])
    return pa.StructArray.from_arrays([listed(paths_of, path), listed(hunks_of, hunks)], ["files", "hunks"])


def parsed(diffs: DataFrame) -> DataFrame:
    """Adds files (paths that the diff writes, as they come) and hunks (number, path, lines) to each row with a diff, in time
    that grows with its lines."""
    parse = F.arrow_udf(lambda x: _parse(x), PARSED)
    return diffs.withColumn("_p", parse("diff")).select(*diffs.columns, "_p.files", "_p.hunks")


def diff_lines(diffs: DataFrame) -> DataFrame:
    """diffs: diff_id, diff. Each line in a hunk with kind (+, - or blank) and its numbers in the old and new file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_diff = _parse(batch.column("diff")).field("hunks")
            hunks = of_diff.flatten()
            of_hunk, at = hunks.field("lines"), pc.list_parent_indices(hunks.field("lines"))
            of, lines = pc.list_parent_indices(of_diff).take(at), of_hunk.flatten()
            columns = [batch.column("diff_id").take(of), hunks.field("path").take(at), pc.cast(hunks.field("hunk").take(at), pa.int64()), *lines.flatten()]
            yield pa.RecordBatch.from_arrays(columns, ["diff_id", "path", "hunk", "kind", "old_line", "new_line", "text"])

    kind = diffs.schema["diff_id"].dataType.simpleString()
    return diffs.select("diff_id", "diff").mapInArrow(run, f"diff_id {kind}, path string, hunk long, kind string, old_line int, new_line int, text string")


def import_end(source: Column, most: int = 40) -> Column:
    """The last line of the blank, comment and import lines that a file begins with."""
    lines = F.transform(F.slice(F.split(source, "\n"), 1, most), F.trim)
    head = lambda x: (x == "") | x.rlike(_COMMENT) | x.rlike(_IMPORT)
    other = F.array_position(F.transform(lines, lambda x: ~head(x)), True)
    return F.coalesce(F.when(other > 0, other - 1).otherwise(F.size(lines)), F.lit(0)).cast("int")


def category_allowed(category: Column, rule: Column, allowed: list[str] = ALLOWED) -> Column:
    """Whether a category or a rule is, or holds, one of those allowed; all are if the list is empty."""
    if not allowed:
        return F.lit(True)
    c, r = F.lower(F.coalesce(category, F.lit(""))), F.lower(F.coalesce(rule, F.lit("")))
    return reduce(lambda a, b: a | b, [c.contains(x) | r.contains(x) for x in allowed if x])


def policy(diffs: DataFrame, hunks: int = 3, lines: int = 20, reach: int = 3, allowed: list[str] = ALLOWED) -> DataFrame:
    """diffs: diff_id, diff, start_line, end_line, and, where they are known, filepath, category, rule_id and source (the
    file's text). The first reason against a diff, or null: an empty diff, a category that is not allowed, several files or
    none, another file, too many hunks or changed lines, a change away from the finding that is no import at the file's
    beginning, a banned addition that is no comment."""
    have = lambda c: F.col(c) if c in diffs.columns else F.lit(None).cast("string")
    d = parsed(diffs.select("diff_id", "diff", "start_line", "end_line", have("filepath").alias("filepath"), have("category").alias("category"), have("rule_id").alias("rule_id"), import_end(have("source")).alias("imports")))
    d = d.withColumn("changed", F.expr("filter(flatten(transform(hunks, h -> h.lines)), x -> x.kind <> ' ')"))
    at = lambda x: F.coalesce(x["old_line"], x["new_line"])
    inside = lambda x: at(x).between(F.col("start_line") - reach, F.col("end_line") + reach)
    importing = lambda x: F.trim(x["text"]).rlike(_IMPORT) & (at(x) <= F.col("imports"))
    bad = lambda x: (x["kind"] == "+") & ~F.trim(x["text"]).rlike(_COMMENT) & reduce(lambda a, b: a | b, [x["text"].rlike(p) for p in BANNED])
    known = F.col("category").isNull() & F.col("rule_id").isNull()
    other = F.col("filepath").isNotNull() & (normal_path(F.col("files")[0]) != normal_path(F.col("filepath")))
    reason = (
        F.when(F.trim(F.coalesce("diff", F.lit(""))) == "", "not a diff")
        .when(~known & ~category_allowed(F.col("category"), F.col("rule_id"), allowed), "category not allowed")
        .when(F.size("files") == 0, "not a diff")
        .when(F.size("files") > 1, "more than one file")
        .when(other, "another file")
        .when(F.size("hunks") > hunks, "too many hunks")
        .when(F.size("changed") > lines, "too many lines")
        .when(F.exists("changed", lambda x: ~importing(x) & ~inside(x)), "outside the finding")
        .when(F.exists("changed", bad), "banned addition")
    )
    return d.select("diff_id", reason.alias("reason"))


def rank(candidates: DataFrame) -> DataFrame:
    """candidates: finding_id, candidate_id, diff, source, valid, score. Valid ones in order: score, deterministic ones,
    then fewer lines, files, hunks, and the id."""
    s = candidates.where("valid").withColumn("s", diff_stats(F.col("diff")))
    size = F.col("s.added") + F.col("s.removed")
    w = Window.partitionBy("finding_id").orderBy(F.desc(F.coalesce("score", F.lit(0.0))), (F.col("source") != "deterministic").cast("int"), size, F.col("s.files"), F.col("s.hunks"), "candidate_id")
    return s.select("finding_id", "candidate_id", size.alias("lines"), F.row_number().over(w).alias("place"))


def rates(patches: DataFrame, outcomes: DataFrame, newest: int = 200) -> DataFrame:
    """patches: job_id, total, validated; outcomes: job_id, action, ts, id. Success and acceptance per job, the latter
    over the newest outcomes only."""
    w = Window.partitionBy("job_id").orderBy(F.desc("ts"), F.desc("id"))
    o = outcomes.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= newest)
    o = o.groupBy("job_id").agg(F.count("*").alias("outcomes"), F.count_if(F.col("action") == "accepted").alias("accepted"))
    ratio = lambda a, b: F.bround(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 3)
    j = patches.join(o, "job_id", "left")
    return j.select("job_id", ratio(F.col("validated"), F.col("total")).alias("success_rate"), ratio(F.coalesce("accepted", F.lit(0)), F.col("outcomes")).alias("acceptance_rate"))


def new_failures(baseline: DataFrame, patched: DataFrame) -> DataFrame:
    """Steps (step, code) that fail now and did not before; a step without a baseline did not."""
    b = baseline.select("step", F.col("code").alias("was"))
    return patched.join(b, "step", "left").where("code <> 0 AND coalesce(was, 0) = 0").select("step", "code")


def bundle(diffs: DataFrame) -> DataFrame:
    """job_id and the diffs of its files, by path, as one text."""
    return diffs.groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "diff"))), lambda x: x["diff"]), "\n").alias("diff"))
