"""What comes in: reports of scanners and stores, in their own shapes, brought to the shapes that the rest works on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspark.functions.text import normal_path
from wardspark.operators.findings import first_wins, last_wins

_BANDIT = "filename string, line_number int, line_range array<int>, test_id string, test_name string, issue_name string, issue_severity string, issue_confidence string, issue_text string"
_SEMGREP = "check_id string, path string, start struct<line:int,col:int>, end struct<line:int,col:int>, extra struct<message:string,severity:string,confidence:string,lines:string>"
REPORT = (
    "bandit struct<results:array<struct<" + ",".join(f"{c.split(' ', 1)[0]}:{c.split(' ', 1)[1]}" for c in _BANDIT.split(", ")) + ">>>, "
    "semgrep struct<results:array<struct<check_id:string,path:string,start:struct<line:int,col:int>,end:struct<line:int,col:int>,extra:struct<message:string,severity:string,confidence:string,lines:string>>>>"
)
#: Columns of a scanner's finding.
SCANNED = ["scanner", "file_path", "line_start", "line_end", "category", "severity", "confidence", "message", "code_snippet", "rule_id"]


def given(*columns: Column | str) -> Column:
    """The first that is neither null nor empty (nor 0, for numbers)."""
    out = None
    for c in columns:
        c = F.col(c) if isinstance(c, str) else c
        text = c.cast("string")
        one = F.when(text.isNotNull() & (text != "") & (text != "0"), c)
        out = one if out is None else F.coalesce(out, one)
    return out


def parse_reports(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """reports: report_id, report (JSON with the results of bandit and semgrep). Findings as they are stored (report_id,
    ordinal, source, severity, confidence, rule_id, file, line, message, raw_json), and counts per report; a report without
    results, or that is no JSON, has counts of 0."""
    r = reports.select("report_id", F.from_json("report", REPORT).alias("r"))
    empty = lambda c: F.coalesce(c, F.array())
    trimmed = lambda *c: F.trim(F.coalesce(given(*c), F.lit("")))
    b = r.select("report_id", F.posexplode("r.bandit.results").alias("ordinal", "x")).select(
        "report_id",
        "ordinal",
        F.lit("bandit").alias("source"),
        F.coalesce(given("x.issue_severity"), F.lit("UNKNOWN")).alias("severity"),
        F.col("x.issue_confidence").alias("confidence"),
        F.coalesce(given("x.test_id"), F.lit("unknown")).alias("rule_id"),
        F.coalesce(given("x.filename"), F.lit("unknown")).alias("file"),
        F.col("x.line_number").alias("line"),
        F.coalesce(given(trimmed("x.issue_text", "x.issue_name"), "x.test_id"), F.lit("bandit finding")).alias("message"),
        F.to_json("x").alias("raw_json"),
    )
    s = r.select("report_id", F.posexplode("r.semgrep.results").alias("ordinal", "x")).select(
        "report_id",
        "ordinal",
        F.lit("semgrep").alias("source"),
        F.coalesce(given("x.extra.severity"), F.lit("INFO")).alias("severity"),
        F.col("x.extra.confidence").alias("confidence"),
        F.coalesce(given("x.check_id"), F.lit("unknown")).alias("rule_id"),
        F.coalesce(given("x.path"), F.lit("unknown")).alias("file"),
        F.col("x.start.line").alias("line"),
        F.coalesce(given(trimmed("x.extra.message", "x.check_id"), "x.check_id"), F.lit("semgrep finding")).alias("message"),
        F.to_json("x").alias("raw_json"),
    )
    n = lambda c: F.size(empty(F.col(c)))
    counts = r.select("report_id", n("r.bandit.results").alias("bandit"), n("r.semgrep.results").alias("semgrep")).withColumn("total", F.col("bandit") + F.col("semgrep"))
    return b.unionByName(s), counts


def weak_labels(stored: DataFrame) -> DataFrame:
    """Stored findings as labels: source, rule_id, severity, confidence, message, line, filepath without leading dots and
    slashes."""
    path = normal_path(F.coalesce(F.when(F.col("file") != "unknown", F.col("file")), F.lit("")))
    return stored.select("report_id", "source", "rule_id", F.coalesce(given("severity"), F.lit("UNKNOWN")).alias("severity"), "confidence", F.coalesce("message", F.lit("")).alias("message"), "line", path.alias("filepath"))


def _scanned(rows: DataFrame, scanner: str, **columns: Column) -> DataFrame:
    return rows.select(F.lit(scanner).alias("scanner"), *[columns[c].alias(c) for c in SCANNED[1:]])


def from_scanners(bandit: DataFrame | None = None, semgrep: DataFrame | None = None, secrets: DataFrame | None = None, patterns: DataFrame | None = None, dependencies: DataFrame | None = None) -> DataFrame:
    """The results of up to five scanners as findings of one shape, all of them, without removing repeats. bandit has its own
    columns; the others check_id, path, start, end and extra (message, severity, lines)."""
    parts = []
    if bandit is not None:
        last = F.element_at(F.when(F.size("line_range") > 0, F.col("line_range")), -1)
        parts.append(_scanned(bandit, "bandit", file_path=F.col("filename"), line_start=F.col("line_number"), line_end=F.coalesce(last, "line_number"), category=F.concat_ws(":", "test_id", "test_name"), severity=F.col("issue_severity"), confidence=F.col("issue_confidence"), message=F.col("issue_text"), code_snippet=F.lit(""), rule_id=F.col("test_id")))
    start, end = F.coalesce("start.line", F.lit(0)), F.coalesce("end.line", "start.line", F.lit(0))
    common = {"file_path": F.coalesce("path", F.lit("")), "line_start": start, "line_end": end, "message": F.coalesce("extra.message", F.lit("")), "code_snippet": F.coalesce("extra.lines", F.lit("")), "rule_id": F.coalesce("check_id", F.lit(""))}
    if semgrep is not None:
        word = F.coalesce("extra.severity", F.lit("WARNING"))
        level = F.when(word == "ERROR", "HIGH").when(word == "INFO", "LOW").otherwise("MEDIUM")
        parts.append(_scanned(semgrep, "semgrep", **common, category=F.coalesce("check_id", F.lit("unknown")), severity=level, confidence=F.when(level == "HIGH", "HIGH").otherwise("MEDIUM")))
    said = lambda c: F.when(common["message"] == "", c).otherwise(common["message"])
    if secrets is not None:
        parts.append(_scanned(secrets, "secrets", **common | {"message": said("Secret detected")}, category=F.lit("secrets.hardcoded"), severity=F.lit("HIGH"), confidence=F.lit("HIGH")))
    if patterns is not None:
        parts.append(_scanned(patterns, "patterns", **common, category=F.coalesce("check_id", F.lit("pattern")), severity=F.coalesce("extra.severity", F.lit("MEDIUM")), confidence=F.lit("MEDIUM")))
    if dependencies is not None:
        parts.append(_scanned(dependencies, "dependencies", **common, category=F.lit("dependency.vuln"), severity=F.coalesce("extra.severity", F.lit("HIGH")), confidence=F.lit("HIGH")))
    return reduce(DataFrame.unionByName, parts)


def matches(value: Column, allowed: list[str]) -> Column:
    """Whether a value is in a list; an entry that ends with * stands for all that begin like it. Any is in an empty list."""
    if not allowed:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [value.startswith(x[:-1]) if x.endswith("*") else value == x for x in allowed])


def chosen(findings: DataFrame, confidence: str | None = None, rules: list[str] = (), categories: list[str] = ()) -> DataFrame:
    """Findings of a confidence at least, of these rules (the category where there is none) and categories."""
    rank = lambda c: F.when(c == "HIGH", 3).when(c == "MEDIUM", 2).when(c == "LOW", 1).otherwise(0)
    d = findings
    if confidence:
        d = d.where(rank(F.upper(F.coalesce("confidence", F.lit("")))) >= rank(F.lit(confidence.upper())))
    if rules:
        d = d.where(matches(given("rule_id", "category"), list(rules)))
    return d.where(matches(F.col("category"), list(categories))) if categories else d


def patch_inputs(findings: DataFrame) -> DataFrame:
    """findings: finding_id, filepath, start_line, end_line, rule_id, category. Those that a patch can be made for: with an
    id, a path and lines; an end that is missing or 0 is the start."""
    end = F.coalesce(given("end_line"), "start_line")
    d = findings.withColumn("end_line", end)
    return d.where(given("finding_id").isNotNull() & given("filepath").isNotNull() & given("start_line").isNotNull() & given("end_line").isNotNull())


#: Where a field may stand, in order, and what it is if it stands nowhere.
UNIFIED = {
    "code_snippet": (["code_snippet", "code", "evidence.excerpt"], ""),
    "file_path": (["file_path", "filename", "location.filepath", "path"], "unknown"),
    "line_start": (["line_start", "line_number", "location.start_line", "start.line"], 0),
    "line_end": (["line_end", "location.end_line", "end.line"], None),
    "category": (["category", "test_id", "rule.category", "check_id"], "unknown"),
    "severity": (["severity"], None),
    "finding_id": (["finding_id", "sample_id"], None),
}


def unify(rows: DataFrame, json: str) -> DataFrame:
    """Adds the fields of ``UNIFIED`` from JSON objects of any of the known shapes. What is empty or 0 counts as missing."""
    at = lambda p: F.get_json_object(json, f"$.{p}")
    found = {k: given(*[at(p) for p in paths]) for k, (paths, _) in UNIFIED.items()}
    start = F.coalesce(found["line_start"].try_cast("int"), F.lit(0))
    path = F.coalesce(found["file_path"], F.lit("unknown"))
    return rows.select(
        "*",
        F.coalesce(found["code_snippet"], F.lit("")).alias("code_snippet"),
        path.alias("file_path"),
        start.alias("line_start"),
        F.coalesce(found["line_end"].try_cast("int"), start).alias("line_end"),
        F.coalesce(found["category"], F.lit("unknown")).alias("category"),
        F.coalesce(found["severity"], F.lower(given(at("issue_severity"))), F.lit("medium")).alias("severity"),
        F.coalesce(found["finding_id"], F.concat_ws(":", path, start)).alias("finding_id"),
    )


def by_suffix(files: DataFrame, path: str, suffixes: list[str]) -> DataFrame:
    """Files whose name ends with one of these."""
    return files.where(reduce(lambda a, b: a | b, [F.col(path).endswith(s) for s in suffixes]))


def span_groups(findings: DataFrame, scanners: int = 5) -> DataFrame:
    """Findings of exactly one span: file_path, line_start, line_end, the distinct scanners, rules and categories (sorted),
    the highest severity and confidence as ranks from 0 to 3, and the share of all scanners that agree."""
    rank = lambda c: F.max(F.when(F.col(c) == "HIGH", 3).when(F.col(c) == "MEDIUM", 2).when(F.col(c) == "LOW", 1).otherwise(0))
    names = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c))))
    g = findings.groupBy("file_path", "line_start", "line_end").agg(
        F.count("*").alias("n"),
        names("scanner").alias("scanners"),
        names("rule_id").alias("rules"),
        names("category").alias("categories"),
        rank("severity").alias("severity_rank"),
        rank("confidence").alias("confidence_rank"),
        F.count_if(F.col("scanner").isin("secrets", "dependencies")).alias("trusted"),
        F.min_by(given("category", "rule_id"), F.when(F.col("scanner").isin("secrets", "dependencies"), F.struct("scanner", "ordinal"))).alias("trusted_category"),
    )
    return g.withColumn("consensus", F.size("scanners") / scanners)


def labelled_items(items: DataFrame, labels: DataFrame, order: str) -> DataFrame:
    """Items that have a label (by sample_id, the last label by order), whose columns win over the item's."""
    last = last_wins(labels, ["sample_id"], [order]).drop(order)
    own = [c for c in items.columns if c == "sample_id" or c not in last.columns]
    return items.select(*own).join(last, "sample_id")


def gold_samples(gold: DataFrame, selected: DataFrame, order: str) -> DataFrame:
    """Gold labels (sample_id, verdict, category, fix_type, notes, language, span_start, span_end) with code and context of
    the selected items (sample_id, code_snippet, context_before, context_after, span_start, span_end); what is missing is
    empty, the label's span wins."""
    s = last_wins(selected, ["sample_id"], [order]).select("sample_id", "code_snippet", "context_before", "context_after", F.col("span_start").alias("_start"), F.col("span_end").alias("_end"))
    text = lambda c, d="": F.coalesce(c, F.lit(d)).alias(c)
    return gold.join(s, "sample_id", "left").select(
        "sample_id", text("language", "python"), text("code_snippet"), text("context_before"), text("context_after"), F.coalesce("span_start", "_start").alias("span_start"), F.coalesce("span_end", "_end").alias("span_end"),
        text("verdict", "UNCERTAIN"), text("category", "unknown"), text("fix_type", "unknown"), text("notes"),
    )


def updated_labels(samples: DataFrame, labels: DataFrame, versions: DataFrame) -> DataFrame:
    """samples with weak_labels (the labels of their id, ordered; none: an empty array) and tool_versions (a map) widened by
    those that are new. labels: sample_id and more; versions: sample_id, tool_versions."""
    columns = [c for c in labels.columns if c != "sample_id"]
    own = labels.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("weak_labels"))
    new = versions.select("sample_id", F.col("tool_versions").alias("_new"))
    d = samples.drop("weak_labels").join(own, "sample_id", "left").join(new, "sample_id", "left")
    old = F.coalesce("tool_versions", F.create_map().cast("map<string,string>"))
    both = F.when(F.col("_new").isNull(), old).otherwise(F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys("_new"), k)), "_new"))
    empty = F.array().cast(own.schema["weak_labels"].dataType)
    return d.withColumn("tool_versions", both).withColumn("weak_labels", F.coalesce("weak_labels", empty)).drop("_new")


def changed_files(*sources: DataFrame) -> DataFrame:
    """path: of the first source that has any rows (changes against a remote, against the local branch, all files)."""
    for s in sources[:-1]:
        if not s.isEmpty():
            return s.select("path").distinct()
    return sources[-1].select("path").distinct()


def first_reported(findings: DataFrame) -> DataFrame:
    """Findings of patterns and of syntax trees without repeats of a file, line and rule: the first one stays."""
    return first_wins(findings, ["path", "line", "rule_id"], ["ordinal"])
