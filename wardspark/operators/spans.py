"""Joins of lines and spans, labels and versions. Each has an equality on (repo, file) or name; ranges come after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardspark.functions.size import small
from wardspark.functions.text import version_key

# fixed values: packages with known faults: ecosystem, package, below this version, severity, identifier
ADVISORIES = [
    ("pypi", "django", "3.2.25", "high", "CVE-2024-27351"),
    ("pypi", "django", "2.2", "critical", "CVE-2019-14234"),
    ("pypi", "flask", "2.2.5", "high", "CVE-2023-30861"),
    ("pypi", "requests", "2.31.0", "medium", "CVE-2023-32681"),
    ("pypi", "pyyaml", "5.4", "critical", "CVE-2020-14343"),
    ("pypi", "urllib3", "1.26.18", "medium", "CVE-2023-45803"),
    ("pypi", "pillow", "10.0.1", "high", "CVE-2023-44271"),
    ("pypi", "cryptography", "41.0.6", "medium", "CVE-2023-49083"),
    ("pypi", "aiohttp", "3.9.0", "high", "CVE-2023-47627"),
    ("pypi", "sqlalchemy", "1.4.49", "medium", "CVE-2023-30861"),
    ("pypi", "werkzeug", "2.3.8", "high", "CVE-2023-46136"),
    ("pypi", "jinja2", "3.1.3", "medium", "CVE-2024-22195"),
    ("pypi", "paramiko", "3.4.0", "high", "CVE-2023-48795"),
    ("pypi", "tornado", "6.3.3", "high", "CVE-2023-28370"),
    ("npm", "lodash", "4.17.21", "high", "CVE-2021-23337"),
    ("npm", "axios", "1.6.0", "high", "CVE-2023-45857"),
    ("npm", "express", "4.19.2", "medium", "CVE-2024-29041"),
    ("npm", "jsonwebtoken", "9.0.0", "high", "CVE-2022-23529"),
    ("npm", "minimist", "1.2.6", "critical", "CVE-2021-44906"),
    ("npm", "node-fetch", "2.6.7", "high", "CVE-2022-0235"),
    ("npm", "tar", "6.1.11", "critical", "CVE-2021-37712"),
    ("npm", "glob-parent", "5.1.2", "high", "CVE-2020-28469"),
    ("npm", "semver", "7.5.2", "medium", "CVE-2022-25883"),
    ("npm", "qs", "6.10.3", "high", "CVE-2022-24999"),
    ("npm", "tough-cookie", "4.1.3", "medium", "CVE-2023-26136"),
    ("npm", "word-wrap", "1.2.4", "medium", "CVE-2023-26115"),
    ("npm", "xml2js", "0.5.0", "medium", "CVE-2023-0842"),
    ("npm", "moment", "2.29.4", "high", "CVE-2022-31129"),
]


#: Lines of a bin: spans are dealt to the bins they touch, so that a line meets the spans of its bin only.
BIN = 64


def _bins(spans: DataFrame, start: str, end: str) -> DataFrame:
    """A row for each bin that a span touches."""
    return spans.where(F.col(end) >= F.col(start)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / BIN), F.floor(F.col(end) / BIN))))


def enclosing(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """lines: row_id, repo, filepath, line. spans: sample_id, repo, filepath, start_line, end_line. row_id and the
    narrowest span around the line; of equal ones the later start."""
    s = _bins(spans.where("start_line > 0 AND end_line > 0"), "start_line", "end_line")
    j = lines.withColumn("_bin", F.floor(F.col("line") / BIN)).join(s, ["repo", "filepath", "_bin"]).where("line BETWEEN start_line AND end_line")
    best = F.min_by("sample_id", F.struct(F.col("end_line") - F.col("start_line"), -F.col("start_line"), "sample_id"))
    return j.groupBy("row_id").agg(best.alias("sample_id"))


def nearest(lines: DataFrame, spans: DataFrame, distance: int = 3) -> DataFrame:
    """row_id and the nearest span by line. Only spans that start within the distance, or are the next to start before
    these, are looked at; a span that holds the line wins, then the distance, then the smaller start."""
    known = spans.where("start_line > 0 AND end_line > 0")
    # those that start nearby: a start is dealt to the bins that its reach touches
    s = _bins(known.withColumns({"_from": F.col("start_line") - distance, "_to": F.col("start_line") + distance}), "_from", "_to").drop("_from", "_to")
    close = lines.withColumn("_bin", F.floor(F.col("line") / BIN)).join(s, ["repo", "filepath", "_bin"]).where(F.abs(F.col("start_line") - F.col("line")) <= distance)
    # the last one that starts before these: starts and lines of a file in one order, a line before a start at its place
    span = F.struct("sample_id", "start_line", "end_line")
    order = Window.partitionBy("repo", "filepath").orderBy("_at", "_kind", "span.end_line", "span.sample_id")
    starts = known.select("repo", "filepath", F.col("start_line").alias("_at"), F.lit(1).alias("_kind"), span.alias("span"))
    asked = lines.where("line IS NOT NULL").select("repo", "filepath", (F.col("line") - distance).alias("_at"), F.lit(0).alias("_kind"), "row_id", "line")
    past = starts.unionByName(asked, allowMissingColumns=True).withColumn("before", F.last("span", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    past = past.where("_kind = 0 AND before IS NOT NULL").select("row_id", "line", "before.*")
    away = F.greatest(F.lit(0), F.col("start_line") - F.col("line"), F.col("line") - F.col("end_line"))
    j = close.select("row_id", "line", "sample_id", "start_line", "end_line").unionByName(past).withColumn("away", away).where(F.col("away") <= distance)
    return j.groupBy("row_id").agg(F.min_by("sample_id", F.struct("away", "start_line", "end_line", "sample_id")).alias("sample_id"))


def map_lines(lines: DataFrame, spans: DataFrame, distance: int = 3) -> DataFrame:
    """All lines with sample_id: around them, else near them, else null."""
    inside = enclosing(lines, spans)
    rest = lines.join(inside, "row_id", "left_anti")
    found = inside.unionByName(nearest(rest, spans, distance))
    return lines.select("row_id").join(found, "row_id", "left")


def attach_labels(samples: DataFrame, labels: DataFrame) -> DataFrame:
    """samples: sample_id, repo, filepath, start_line, end_line. labels: label_id, repo (null: any), filepath, line.
    Every label inside a sample, one row each; samples without labels stay with a null label_id."""
    s, known = _bins(samples, "start_line", "end_line").alias("s"), labels.withColumn("_bin", F.floor(F.col("line") / BIN)).alias("l")
    inside = (F.col("s.filepath") == F.col("l.filepath")) & (F.col("s._bin") == F.col("l._bin")) & F.col("l.line").between(F.col("s.start_line"), F.col("s.end_line"))
    own = s.join(known.where("l.repo IS NOT NULL"), inside & (F.col("s.repo") == F.col("l.repo")))
    anyone = s.join(known.where("l.repo IS NULL"), inside)
    hits = own.select("s.sample_id", "l.label_id").union(anyone.select("s.sample_id", "l.label_id"))
    return samples.select("sample_id").join(hits, "sample_id", "left")


def vulnerable(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """packages: ecosystem, package, version. Each advisory that holds for a package: same name, version below."""
    p = packages.withColumn("name", F.lower("package")).withColumn("v", version_key(F.col("version")))
    a = advisories.select("ecosystem", F.col("package").alias("name"), version_key(F.col("below")).alias("below_v"), "below", "severity", "advisory")
    return p.join(small(a), ["ecosystem", "name"]).where("v < below_v").drop("v", "below_v")


def advisories(spark) -> DataFrame:
    return spark.createDataFrame(ADVISORIES, "ecosystem string, package string, below string, severity string, advisory string")


def requirements(files: DataFrame) -> DataFrame:
    """Pinned packages of requirements files (path, text): path, package, version, line."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("k", "row"))
    pattern = "^\\s*([A-Za-z0-9_.\\-]+)\\s*(?:\\[[^\\]]*\\])?\\s*[=<>~!]=?=?\\s*([0-9][0-9A-Za-z.]*)"
    name, version = F.regexp_extract("row", pattern, 1), F.regexp_extract("row", pattern, 2)
    return lines.where(name != "").select("path", F.lit("pypi").alias("ecosystem"), name.alias("package"), version.alias("version"), (F.col("k") + 1).alias("line"))


def package_json(files: DataFrame) -> DataFrame:
    """Packages of package.json files (path, text); development ones win."""
    deps = lambda k: F.from_json(F.get_json_object("text", f"$.{k}"), "map<string,string>")
    empty = F.create_map().cast("map<string,string>")
    own, dev = F.coalesce(deps("dependencies"), empty), F.coalesce(deps("devDependencies"), empty)
    both = F.map_concat(F.map_filter(own, lambda k, v: ~F.array_contains(F.map_keys(dev), k)), dev)
    return files.select("path", F.explode(both).alias("package", "version")).select("path", F.lit("npm").alias("ecosystem"), "package", "version")
