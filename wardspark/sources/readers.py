"""Sources. Schemas are given, so nothing is inferred by an extra pass over the data."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BANDIT = "results array<struct<filename:string,line_number:int,line_range:array<int>,test_id:string,test_name:string,issue_name:string,issue_severity:string,issue_confidence:string,issue_text:string,code:string>>"
SEMGREP = "results array<struct<check_id:string,path:string,start:struct<line:int,col:int>,end:struct<line:int,col:int>,extra:struct<message:string,severity:string,confidence:string,lines:string,metadata:map<string,string>>>>"
MODEL = "sample_id string, filepath string, span struct<start_line:int,end_line:int>, risk_score double, top_categories array<struct<category:string,confidence:double>>, model string, calibrated boolean"
SAMPLE = "sample_id string, language string, repo string, commit string, filepath string, code_snippet string, function_span struct<start_line:int,end_line:int,start_col:int,end_col:int>, context_before string, context_after string, weak_labels array<struct<source:string,rule_id:string,severity:string,confidence:string,message:string,line:int,extra:map<string,string>>>, gold_labels map<string,string>"
AUDIT = "dependencies array<struct<name:string,version:string,vulns:array<struct<id:string,fix_versions:array<string>>>>>"
# fixed values: folders that a walk leaves out
SKIPPED = [".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".next", "site-packages"]


def reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Results of saved reports (one JSON document a file), one per row."""
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("results").alias("r")).select("r.*")


def bandit(spark: SparkSession, path: str) -> DataFrame:
    return reports(spark, path, BANDIT)


def semgrep(spark: SparkSession, path: str) -> DataFrame:
    return reports(spark, path, SEMGREP)


def all_rulesets(frames: list[DataFrame]) -> DataFrame:
    """Results of several rule sets; a finding of two sets stays twice."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def pip_audit(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.schema(AUDIT).option("multiLine", True).json(path).select(F.explode("dependencies").alias("d"))
    return d.select("d.name", "d.version", F.explode("d.vulns").alias("v")).select("name", "version", F.col("v.id").alias("advisory"), F.col("v.fix_versions").alias("fixed"))


NPM = "vulnerabilities map<string,struct<name:string,severity:string,range:string,isDirect:boolean>>"


def npm_audit(spark: SparkSession, path: str) -> DataFrame:
    """name, severity, range, direct of the packages that an audit of packages names; nothing from a file without any."""
    d = spark.read.schema(NPM).option("multiLine", True).json(path).select(F.explode("vulnerabilities").alias("name", "v"))
    return d.select(F.coalesce("v.name", "name").alias("name"), F.lower("v.severity").alias("severity"), F.col("v.range").alias("range"), F.coalesce("v.isDirect", F.lit(False)).alias("direct"))


# fixed values: rule sets that always run, and those for files by suffix
RULESETS = ["p/security-audit", "p/owasp-top-ten", "p/secrets", "p/sql-injection", "p/xss", "p/command-injection"]
SUFFIX_RULESETS = {".py": ["p/python", "p/django", "p/flask"], ".js": ["p/javascript", "p/nodejs", "p/react"], ".ts": ["p/typescript", "p/nodejs", "p/react"], ".tsx": ["p/typescript", "p/react", "p/nextjs"], ".jsx": ["p/javascript", "p/react"]}


def rulesets_for(files: DataFrame, by: list[str]) -> DataFrame:
    """files: path. The rule sets for the files of each value of ``by``, as a sorted set; each file says its suffix only."""
    own = F.array(*[F.when(F.col("path").endswith(s), F.array(*map(F.lit, sets))).otherwise(F.array().cast("array<string>")) for s, sets in SUFFIX_RULESETS.items()])
    seen = files.select(*by, F.flatten(own).alias("sets")).distinct()
    return seen.groupBy(*by).agg(F.array_sort(F.array_union(F.array(*map(F.lit, RULESETS)), F.flatten(F.collect_set("sets")))).alias("rulesets"))


def model_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL).json(path)


def samples(spark: SparkSession, path: str) -> DataFrame:
    """Function samples from lines of JSON; what can't be read has _corrupt."""
    return spark.read.schema(SAMPLE + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


_LABEL = "source:string,rule_id:string,test_id:string,check_id:string,severity:string,confidence:string,message:string,issue_text:string,filepath:string,filename:string,path:string,line:int,line_number:int"


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of a file in any of its shapes: lines of labels, or a document with findings, results or items. One schema
    holds all shapes, so the shape need not be known beforehand."""
    one = f"struct<{_LABEL}>"
    schema = f"{_LABEL.replace(':', ' ').replace(',', ', ')}, findings array<{one}>, results array<{one}>, items array<{one}>"
    d = spark.read.schema(schema).option("multiLine", not path.endswith(".jsonl")).json(path)
    own = F.struct(*[F.col(c.split(":")[0]) for c in _LABEL.split(",")])
    many = F.coalesce("findings", "results", "items", F.array(own))
    l = d.select(F.explode(many).alias("l")).select("l.*")  # noqa: E741
    place = F.ltrim(F.coalesce("filepath", "filename", "path"), F.lit("./"))
    return l.select(F.coalesce("rule_id", "test_id", "check_id").alias("rule_id"), F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("severity", F.lit("UNKNOWN")).alias("severity"), "confidence", F.coalesce("message", "issue_text").alias("message"), place.alias("filepath"), F.coalesce("line", "line_number").alias("line"))


def validated(samples: DataFrame, required: tuple[str, ...] = ("sample_id", "language", "filepath", "code_snippet")) -> DataFrame:
    """One row: how many rows there are and how many are no samples."""
    bad = F.col("_corrupt").isNotNull()
    for c in required:
        bad = bad | F.col(c).isNull()
    return samples.agg(F.count("*").alias("total"), F.count_if(bad).alias("errors"))


def text_files(spark: SparkSession, root: str, suffixes: list[str]) -> DataFrame:
    """path (below the root) and text of the files of a tree, without skipped and hidden folders."""
    glob = "{" + ",".join(f"*{s}" for s in suffixes) + "}"
    d = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True)
    path = F.regexp_replace(F.input_file_name(), "^.*?" + root.rstrip("/").removeprefix("file://").replace(".", "\\.") + "/", "")
    parts = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    hidden = F.exists(parts, lambda p: p.isin(SKIPPED) | p.startswith("."))
    return d.select(path.alias("path"), F.col("value").alias("text")).where(~hidden)


def capped(files: DataFrame, by: str, most: int) -> DataFrame:
    """At most so many files of each, by path."""
    from wardspark.operators.datasets import cap_per

    return cap_per(files, by, most, "path")


def pyproject(files: DataFrame) -> DataFrame:
    """Packages of pyproject.toml files (path, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b.path, b.text, strict=True):
                try:
                    found = tomllib.loads(text or "").get("project", {}).get("dependencies", [])
                except tomllib.TOMLDecodeError:
                    found = []
                rows += [(path, d) for d in found if isinstance(d, str)]
            yield pd.DataFrame(rows, columns=["path", "text"])

    from wardspark.operators.spans import requirements

    return requirements(files.select("path", "text").mapInPandas(run, "path string, text string"))


def markdown_sections(docs: DataFrame, most: int = 1200, size: int = 800, overlap: int = 100) -> DataFrame:
    """document_id, chunk_index, text: cut before headings of level 2; what is longer than ``most`` before those of level 3
    (and deeper), and what is still longer by length. White space at the ends goes, and so do empty pieces."""
    from wardspark.functions.text import chunks

    stripped = lambda c: F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")
    full = lambda parts: F.filter(F.transform(parts, stripped), lambda p: p != "")
    short = lambda c: F.char_length(c) <= most
    by_length = lambda c: F.when(short(c), F.array(c)).otherwise(chunks(c, size, overlap))
    by_part = lambda c: F.when(short(c), F.array(c)).otherwise(F.flatten(F.transform(full(F.split(c, "(?md)(?=^###)")), by_length)))
    pieces = F.flatten(F.transform(full(F.split("text", "(?md)(?=^##[^#])")), by_part))
    return docs.select("document_id", F.posexplode(pieces).alias("chunk_index", "text"))


def page_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text of raw pages: without scripts, styles and tags."""
    t = F.regexp_replace("html", "(?is)<(script|style)[^>]*>.*?</\\1>", " ")
    return pages.select("page_id", "url", F.trim(F.regexp_replace(F.regexp_replace(t, "(?s)<[^>]+>", " "), "\\s+", " ")).alias("text"))


def allowlist(value: str) -> list[str]:
    """Rules of a comma list, or of a text with a rule a line; what follows # is left out."""
    rows = value.splitlines() if "\n" in value else value.split(",")
    return [r for r in (row.split("#")[0].strip() for row in rows) if r]


def allowed(findings: DataFrame, column: str, rules: list[str]) -> DataFrame:
    """Rows whose value is listed, or begins as a listed one that ends in *; all rows where nothing is listed."""
    if not rules:
        return findings
    hit = F.col(column).isin([r for r in rules if not r.endswith("*")])
    for r in rules:
        if r.endswith("*"):
            hit = hit | F.col(column).startswith(r[:-1])
    return findings.where(hit)
