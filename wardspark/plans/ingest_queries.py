"""Queries over what comes in: reports, scanners' results, labels, features, policies, masked objects, retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.functions import vector
from wardspark.operators import datasets, features, ingest, patches, policies, redaction, retrieval, verdicts
from wardspark.plans.common import FINDINGS, findings, table

_CODES = ["subprocess.run(c, shell=True)", "x = 1 # NOSEC", "cursor.execute(q + v)", "value = request.args", "element.innerHTML = s", "plain = text"]
_WORDS = ["sql-injection", "B602 shell", "md5 used", "innerHTML", "path-traversal ../", "hardcoded_password", "jwt none", "B999", "nothing", "sha1"]


def _pick(words: list[str], key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (key % len(words) + 1).cast("int"))


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir)
    scanner = _pick(["bandit", "semgrep", "secrets", "patterns", "dependencies"], F.expr("ordinal div 100") % 7 % 5)
    level = F.when(F.col("severity") == "critical", "CRITICAL").otherwise(F.upper("severity"))
    return f.select(
        "ordinal", scanner.alias("scanner"), F.col("filepath").alias("file_path"), F.col("start_line").alias("line_start"), (F.col("start_line") + F.col("ordinal") % 2).alias("line_end"), F.concat("rule_id", F.lit(":"), "severity").alias("category"),
        level.alias("severity"), F.col("confidence_word").alias("confidence"), F.when(F.col("ordinal") % 3 > 0, F.col("rule_id")).alias("rule_id"), F.col("message"),
    )


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ingest.span_groups(_scanned(spark, sf_dir))
    return g.withColumn("code", _pick(_CODES, F.col("line_start")))


def _told(d: DataFrame, *more: str) -> DataFrame:
    return d.select("file_path", "line_start", "line_end", "label", "detected", *more)


def span_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ingest.span_groups(_scanned(spark, sf_dir))
    return d.select("file_path", "line_start", "line_end", "n", *[F.array_join(c, ",").alias(c) for c in ("scanners", "rules", "categories")], "severity_rank", "confidence_rank", "trusted", F.round("consensus", 6).alias("consensus"))


def gold_labels_by_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(verdicts.gold_label(_groups(spark, sf_dir), ["R1*"], ["R7:high"]))


def council_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(verdicts.council_label(_groups(spark, sf_dir), ["R1*"], ["R7:high"]), "true_votes", "false_votes")


def chosen_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.chosen(_scanned(spark, sf_dir), "medium", ["R1*", "R7", "R3:low"], ["R1*", "R3:low"]).select("ordinal")


def inferred_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir).select("ordinal", F.col("rule_id").alias("rule"), F.concat(_pick(_WORDS, F.expr("ordinal div 100"))).alias("message"))
    c = verdicts.infer_category(F.col("rule"), F.col("message"))
    return f.select("ordinal", c.alias("category"), verdicts.infer_fix(F.col("rule"), F.col("message"), c).alias("fix_type"))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of each order: its lines as results, some with what is missing or empty."""
    f = table(spark, sf_dir, "lineitem")
    text = lambda c, k: F.when(F.col("l_partkey") % k == 0, "").otherwise(c)
    b = F.struct(F.concat(F.lit("src/f"), F.col("l_suppkey").cast("string"), F.lit(".py")).alias("filename"), F.col("l_linenumber").alias("line_number"), F.concat(F.lit("B"), F.col("l_suppkey").cast("string")).alias("test_id"), text(F.lit("HIGH"), 3).alias("issue_severity"), F.when(F.col("l_partkey") % 2 == 0, "LOW").alias("issue_confidence"), text(F.concat(F.lit(" found "), F.col("l_partkey").cast("string")), 5).alias("issue_text"))
    s = F.struct(F.concat(F.lit("js."), F.col("l_suppkey").cast("string")).alias("check_id"), F.when(F.col("l_partkey") % 7 > 0, "web/a.js").alias("path"), F.struct(F.col("l_linenumber").alias("line")).alias("start"), F.struct(text(F.lit("said"), 4).alias("message"), F.when(F.col("l_partkey") % 3 > 0, "ERROR").alias("severity")).alias("extra"))
    of = lambda flag, c: F.array_sort(F.collect_list(F.when(F.col("l_returnflag") == flag, F.struct("l_linenumber", "l_partkey", "l_suppkey", c.alias("x")))))
    r = f.groupBy(F.col("l_orderkey").alias("report_id")).agg(of("R", b).alias("b"), of("A", s).alias("s"))
    body = F.to_json(F.struct(F.struct(F.transform("b", lambda x: x["x"]).alias("results")).alias("bandit"), F.struct(F.transform("s", lambda x: x["x"]).alias("results")).alias("semgrep")))
    return r.select("report_id", F.when(F.col("report_id") % 11 == 0, "no json").otherwise(body).alias("report"))


def parsed_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.parse_reports(_reports(spark, sf_dir))[0].drop("raw_json")


def parsed_report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.parse_reports(_reports(spark, sf_dir))[1]


def unified_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of three shapes."""
    p = table(spark, sf_dir, "part")
    bandit = F.to_json(F.struct(F.concat(F.lit("a"), F.col("p_size").cast("string")).alias("filename"), F.col("p_size").alias("line_number"), F.lit("B1").alias("test_id"), F.lit("HIGH").alias("issue_severity")))
    semgrep = F.to_json(F.struct(F.lit("b.js").alias("path"), F.struct(F.col("p_size").alias("line")).alias("start"), F.struct((F.col("p_size") + 2).alias("line")).alias("end"), F.lit("js.x").alias("check_id")))
    own = F.to_json(F.struct(F.lit("f1").alias("finding_id"), F.lit("").alias("file_path"), F.struct(F.lit("c.py").alias("filepath"), F.col("p_size").alias("start_line")).alias("location"), F.lit(0).alias("line_start"), F.lit("low").alias("severity"), F.lit("x = 1").alias("code")))
    body = F.when(F.col("p_partkey") % 3 == 0, bandit).when(F.col("p_partkey") % 3 == 1, semgrep).otherwise(own)
    return ingest.unify(p.select("p_partkey", body.alias("body")), "body").drop("body")


def labelled_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), "lang", F.lit("old").alias("verdict"))
    la = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sample_id"), F.when(F.col("quality") == 1, "TP").otherwise("FP").alias("verdict"), F.col("doc_id").alias("place"))
    return ingest.labelled_items(i, la, "place")


def gold_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sample_id"), F.when(F.col("quality") == 1, "TP").alias("verdict"), F.lit(None).cast("string").alias("category"), F.lit("fix").alias("fix_type"), F.lit(None).cast("string").alias("notes"), F.lit(None).cast("string").alias("language"), F.when(F.col("doc_id") % 2 == 0, 1).alias("span_start"), F.lit(None).cast("int").alias("span_end"))
    s = table(spark, sf_dir, "documents").where("doc_id % 3 > 0").select(F.col("doc_id").alias("sample_id"), F.md5("text").alias("code_snippet"), F.col("lang").alias("context_before"), F.lit(None).cast("string").alias("context_after"), F.lit(5).alias("span_start"), F.lit(9).alias("span_end"), F.col("doc_id").alias("place"))
    return ingest.gold_samples(g, s, "place")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def features_of_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir).select("doc_id", features.sample_features(F.col("text")).alias("f")).select("doc_id", "f.*")
    return d.withColumn("avg_line_length", F.round("avg_line_length", 6))


def features_of_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir)
    scanners = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("bandit"), F.lit("patterns"))).otherwise(F.array(F.lit("secrets")))
    f = features.consensus_features(F.col("text"), _pick(["SQL.injection", "crypto.weak", "hardcoded.secrets", "path.traversal"], F.col("doc_id")), scanners, _pick(["high", "odd", "CRITICAL"], F.col("doc_id")))
    return d.select("doc_id", f.alias("f")).select("doc_id", "f.*")


def features_of_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir).select("doc_id", features.generated_features(F.col("text"), F.lit(7)).alias("f")).select("doc_id", "f.*")
    return d.withColumn("avg_line_length", F.round("avg_line_length", 6))


def features_of_improved(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir).select("doc_id", features.improved_features(F.col("text"), F.lit(7)).alias("f")).select("doc_id", "f.*")
    return d.withColumn("avg_line_length", F.round("avg_line_length", 6))


_SCRAP = "CASE doc_id % 4 WHEN 0 THEN ' def f(x): return eval (x) if x else 1' WHEN 1 THEN ' class C; for while md5 SELECT + \"a\" ' WHEN 2 THEN ' yaml.load(open (request.args)) % (a) .format (b) f\"c\"' ELSE '' END"


def features_engineered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of documents with scraps of code behind them."""
    d = _documents(spark, sf_dir).withColumn("text", F.concat("text", F.expr(_SCRAP)))
    f = features.engineered_features(F.col("text"), F.concat(F.lit("src/config/f"), F.col("doc_id").cast("string"), F.lit("_test.py")), _pick(["B101", "semgrep.x", "other"], F.col("doc_id")), _pick(["high", "odd"], F.col("doc_id")), F.lit(None).cast("string"))
    d = d.select("doc_id", f.alias("f")).select("doc_id", "f.*").drop("rule_hash")
    return d.withColumn("avg_line_length", F.round("avg_line_length", 6)).withColumn("blank_line_ratio", F.round("blank_line_ratio", 6))


def features_of_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir)
    return d.select("doc_id", features.gold_features(F.col("text"), F.array(F.lit("semgrep"), F.lit("dependencies"))).alias("f")).select("doc_id", "f.*")


def ratio_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.ratio_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def floor_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.floor_split(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "quality")


def retrieval_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chunk_id"), "text")
    t = datasets.triples(d, most=0)
    return t.select("triple_id", "chunk_id", "query", F.array_join("negatives", ",").alias("negatives"))


def masked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rules over objects with one level of nesting."""
    c = table(spark, sf_dir, "customer")
    body = F.concat(F.lit('{"api_token": "'), F.col("c_name"), F.lit('", "note": "'), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Bearer "), "c_name")).otherwise(F.col("c_name")), F.lit('", "in": {"secret": "'), F.left("c_name", F.lit(8)), F.lit('"}, "list": ["sk-short"]}'))
    d = c.select("c_custkey", body.alias("body"))
    d = d.select("c_custkey", redaction.redact_stored(F.col("body")).alias("stored"), redaction.redact_event(F.col("body")).alias("sent"), redaction.redact_object(F.col("body")).alias("o"))
    at = lambda c, p: F.get_json_object(c, f"$.{p}")
    return d.select("c_custkey", at("stored", "api_token").alias("token"), at("stored", "note").alias("note"), at("stored", "in.secret").alias("secret"), at("stored", "list[0]").alias("item"), at("sent", "note").alias("sent_note"), at("sent", "in.secret").alias("sent_secret"), at("sent", "list[0]").alias("sent_item"), at("o.sanitized", "note").alias("clean_note"), F.array_join(F.transform("o.findings", lambda f: F.concat_ws("=", f["path"], f["type"])), ",").alias("found"))


def policy_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tool for each nation, overridden by some of the regions'."""
    n = table(spark, sf_dir, "nation")
    base = n.select(F.col("n_name").alias("tool"), F.lit(True).alias("allowed"), F.array(F.lit("read")).alias("scopes"), (F.col("n_nationkey") % 2 == 0).alias("requires_approval"))
    over = n.where("n_nationkey % 3 = 0").select(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("unknown").alias("tool"), F.when(F.col("n_regionkey") == 1, False).alias("allowed"), F.lit(None).cast("array<string>").alias("scopes"), F.lit(True).alias("requires_approval"))
    return policies.apply(base, over.dropDuplicates(["tool"])).select("tool", "allowed", F.array_join("scopes", ",").alias("scopes"), "requires_approval")


def mahalanobis_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every vector, all dimensions, from the mean of all."""
    v = table(spark, sf_dir, "embeddings")
    mean, cov = retrieval.mean_and_covariance(v, "embedding")
    return v.select("vec_id", F.round(retrieval.mahalanobis(F.col("embedding"), *retrieval.inverse_covariance(mean, cov)), 4).alias("distance"))


def top_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return v.select("vec_id", F.posexplode(vector.top_probabilities(F.col("e"), 3)).alias("place", "x")).select("vec_id", "place", F.col("x.class").alias("class"), F.round("x.p", 6).alias("p"))


def patch_policy_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diffs of one and of two files, near and far from the finding, with imports, and of categories that are not allowed."""
    f = findings(spark, sf_dir)
    kind, line = F.expr("ordinal div 100") % 7, F.col("start_line")
    head = lambda p: F.concat(F.lit("--- a/"), p, F.lit("\n+++ b/"), p, F.lit("\n"))
    hunk = lambda n, body: F.concat(F.lit("@@ -"), n.cast("string"), F.lit(",1 +"), n.cast("string"), F.lit(",2 @@\n"), F.lit(body))
    diff = (
        F.when(kind == 0, "")
        .when(kind == 1, F.concat(head(F.col("filepath")), hunk(line, "-a\n+b\n"), head(F.lit("other.py")), hunk(line, "-a\n+b")))
        .when(kind == 2, F.concat(head(F.col("filepath")), hunk(line + 100, "-a\n+b")))
        .when(kind == 3, F.concat(head(F.col("filepath")), hunk(line, "-a\n+x = hashlib.md5(b)")))
        .when(kind == 4, F.concat(head(F.lit("elsewhere.py")), hunk(line, "-a\n+b")))
        .when(kind == 5, F.concat(head(F.col("filepath")), hunk(F.lit(1), "+import os\n"), hunk(line + 3, " x\n-a\n+# eval(x)")))
        .otherwise(F.concat(head(F.col("filepath")), *[hunk(line, "+b\n") for _ in range(4)]))
    )
    category = F.when(F.expr("ordinal div 100") % 11 == 0, "style").otherwise("Injection.XSS")
    d = f.select(F.col("ordinal").alias("diff_id"), diff.alias("diff"), "start_line", (line + 3).alias("end_line"), "filepath", category.alias("category"), F.col("rule_id"), F.lit("# note\nimport sys\n\nx = 1").alias("source"))
    return patches.policy(d)


QUERIES = {
    f.__name__: f
    for f in (span_groups, gold_labels_by_rules, council_labels, chosen_findings, inferred_categories, parsed_reports, parsed_report_counts, unified_fields, labelled_items, gold_samples, features_of_samples, features_of_consensus, features_of_generated, features_of_improved, features_engineered, features_of_gold, ratio_split, floor_split, retrieval_triples, masked_events, policy_overrides, mahalanobis_distance, top_classes, patch_policy_reasons)
}


def _case(words: list[str], key: str) -> str:
    quote = lambda w: "'" + w.replace("'", "''") + "'"
    return f"CASE {key} % {len(words)} " + " ".join(f"WHEN {k} THEN {quote(w)}" for k, w in enumerate(words)) + " END"


def _has(text: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _count(text: str, *words: str) -> str:
    return "CAST(" + " + ".join(f"(length({text}) - length(replace({text}, '{w}', ''))) // {len(w)}" for w in words) + " AS INT)"


_SCAN = f"""{FINDINGS}, sc AS (SELECT ordinal, {_case(["bandit", "semgrep", "secrets", "patterns", "dependencies"], "(ordinal // 100 % 7 % 5)")} AS scanner, filepath AS file_path, start_line AS line_start, start_line + ordinal % 2 AS line_end,
    concat(rule_id, ':', severity) AS category, upper(severity) AS severity, confidence_word AS confidence, CASE WHEN ordinal % 3 > 0 THEN rule_id END AS rule_id FROM findings),
gr AS (SELECT file_path, line_start, line_end, count(*) AS n, list_sort(list(DISTINCT scanner)) AS scanners, coalesce(list_sort(list(DISTINCT rule_id) FILTER (WHERE rule_id IS NOT NULL)), []) AS rules, list_sort(list(DISTINCT category)) AS categories,
    CAST(max(CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END) AS INT) AS severity_rank, CAST(max(CASE confidence WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END) AS INT) AS confidence_rank,
    count(*) FILTER (WHERE scanner IN ('secrets', 'dependencies')) AS trusted, first(category ORDER BY scanner, ordinal) FILTER (WHERE scanner IN ('secrets', 'dependencies')) AS trusted_category FROM sc GROUP BY 1, 2, 3)"""
_SURE = "CASE " + " ".join(f"WHEN regexp_matches(code, '{p}', 'i') THEN '{c}'" for p, c in verdicts.SURE) + " END"
_DOUBT = "(" + " OR ".join(f"regexp_matches(code, '{p}', 'i')" for p in verdicts.DOUBTFUL) + ")"
_VOTES = lambda ps: "(" + " + ".join(f"CAST(regexp_matches(code, '{p}', 'i') AS INT)" for p in ps) + ")"
_CODED = f"{_SCAN}, co AS (SELECT *, {_case(_CODES, 'line_start')} AS code, list_filter(rules, lambda r: starts_with(r, 'R1') OR r = 'R7:high') AS ar, list_filter(categories, lambda c: starts_with(c, 'R1') OR c = 'R7:high') AS ac FROM gr)"
_VERDICT = f"""{_CODED}, v AS (SELECT *, {_DOUBT} AS doubt, {_SURE} AS sure, len(scanners) AS s FROM co)
SELECT file_path, line_start, line_end, CAST(CASE WHEN doubt THEN 0 WHEN sure IS NOT NULL OR trusted > 0 OR len(ar) > 0 OR len(ac) > 0 OR (s >= 2 AND severity_rank >= 2) OR s >= 3 OR (severity_rank >= 2 AND confidence_rank >= 2) THEN 1 ELSE 0 END AS INT) AS label,
    CASE WHEN NOT doubt THEN coalesce(sure, trusted_category, ar[1], split_part(ac[1], ':', 1)) END AS detected FROM v"""
_COUNCIL = f"""{_CODED}, v AS (SELECT *, {_SURE} AS sure, len(scanners) AS s, 2 * {_VOTES([p for p, _ in verdicts.SURE])} + 2 * trusted + 2 * len(ar) + 2 * len(ac) + CASE WHEN len(scanners) >= 2 AND severity_rank >= 2 THEN 1 ELSE 0 END + CASE WHEN len(scanners) >= 2 AND confidence_rank >= 2 THEN 1 ELSE 0 END AS t,
    2 * {_VOTES(verdicts.DOUBTFUL)} + CASE WHEN len(scanners) = 1 AND severity_rank <= 1 AND confidence_rank <= 1 THEN 1 ELSE 0 END AS f FROM co),
w AS (SELECT *, CASE WHEN t >= 2 AND t >= f + 1 THEN 1 WHEN f >= 2 AND f >= t + 1 THEN 0 END AS label FROM v)
SELECT file_path, line_start, line_end, CAST(label AS INT) AS label, CASE WHEN label = 1 THEN coalesce(sure, trusted_category, ar[1], split_part(ac[1], ':', 1)) END AS detected, CAST(t AS INT) AS true_votes, CAST(f AS INT) AS false_votes FROM w"""
_RULE = lambda k: "CASE " + " ".join("WHEN regexp_matches(said, '{}', 'i') THEN '{}'".format(r[0].replace("sha1(?!.)", "sha1$").replace("'", "''"), r[k]) for r in verdicts.RULES)
_D = "d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)"
_MEAN = "round((length(t) - len(l) + 1) / len(l), 6)"
_LONG = "CAST(list_max(list_transform(l, lambda x: length(x))) AS INT)"
_RE = lambda p, o="": f"regexp_matches(t, '{p}'{o})"
_NUM = lambda p: f"CAST(len(regexp_extract_all(t, '{p}')) AS INT)"
_INDENT = r"list_transform({}, lambda x: length(regexp_extract(x, '^[\s\x0B]*')))"
_DRAWN = lambda seed, c: f"sha256(concat('{seed}:', {c}))"
_MASK = "CASE WHEN length({0}) <= {1} THEN '***REDACTED***' ELSE left({0}, 4) || '***' || right({0}, 4) END"
ORACLE = {
    "span_groups": f"WITH {_SCAN} SELECT file_path, line_start, line_end, n, array_to_string(scanners, ',') AS scanners, array_to_string(rules, ',') AS rules, array_to_string(categories, ',') AS categories, severity_rank, confidence_rank, trusted, round(len(scanners) / 5, 6) AS consensus FROM gr",
    "gold_labels_by_rules": f"WITH {_VERDICT}",
    "council_labels": f"WITH {_COUNCIL}",
    "chosen_findings": f"WITH {_SCAN} SELECT ordinal FROM sc WHERE confidence IN ('HIGH', 'MEDIUM') AND (starts_with(coalesce(rule_id, category), 'R1') OR coalesce(rule_id, category) IN ('R7', 'R3:low')) AND (starts_with(category, 'R1') OR category = 'R3:low')",
    "inferred_categories": f"WITH {FINDINGS}, s AS (SELECT ordinal, lower(concat(rule_id, ' ', {_case(_WORDS, '(ordinal // 100)')})) AS said FROM findings) SELECT ordinal, {_RULE(1)} ELSE 'misc.other' END AS category, {_RULE(2)} ELSE 'unknown' END AS fix_type FROM s",
    "parsed_reports": """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS k FROM lineitem WHERE l_orderkey % 11 > 0 AND l_returnflag IN ('R', 'A'))
        SELECT l_orderkey AS report_id, CAST(k AS INT) AS ordinal, 'bandit' AS source, CASE WHEN l_partkey % 3 = 0 THEN 'UNKNOWN' ELSE 'HIGH' END AS severity, CASE WHEN l_partkey % 2 = 0 THEN 'LOW' END AS confidence, concat('B', l_suppkey) AS rule_id, concat('src/f', l_suppkey, '.py') AS file, l_linenumber AS line,
            CASE WHEN l_partkey % 5 = 0 THEN concat('B', l_suppkey) ELSE concat('found ', l_partkey) END AS message FROM l WHERE l_returnflag = 'R'
        UNION ALL SELECT l_orderkey, CAST(k AS INT), 'semgrep', CASE WHEN l_partkey % 3 > 0 THEN 'ERROR' ELSE 'INFO' END, NULL, concat('js.', l_suppkey), CASE WHEN l_partkey % 7 > 0 THEN 'web/a.js' ELSE 'unknown' END, l_linenumber, CASE WHEN l_partkey % 4 = 0 THEN concat('js.', l_suppkey) ELSE 'said' END FROM l WHERE l_returnflag = 'A'""",
    "parsed_report_counts": "SELECT l_orderkey AS report_id, CAST(count(*) FILTER (WHERE l_returnflag = 'R' AND l_orderkey % 11 > 0) AS INT) AS bandit, CAST(count(*) FILTER (WHERE l_returnflag = 'A' AND l_orderkey % 11 > 0) AS INT) AS semgrep, CAST(count(*) FILTER (WHERE l_returnflag IN ('R', 'A') AND l_orderkey % 11 > 0) AS INT) AS total FROM lineitem GROUP BY 1",
    "unified_fields": """SELECT p_partkey, CASE p_partkey % 3 WHEN 2 THEN 'x = 1' ELSE '' END AS code_snippet, CASE p_partkey % 3 WHEN 0 THEN concat('a', p_size) WHEN 1 THEN 'b.js' ELSE 'c.py' END AS file_path, CAST(p_size AS INT) AS line_start, CAST(CASE p_partkey % 3 WHEN 1 THEN p_size + 2 ELSE p_size END AS INT) AS line_end,
        CASE p_partkey % 3 WHEN 0 THEN 'B1' WHEN 1 THEN 'js.x' ELSE 'unknown' END AS category, CASE p_partkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity, CASE p_partkey % 3 WHEN 0 THEN concat('a', p_size, ':', p_size) WHEN 1 THEN concat('b.js:', p_size) ELSE 'f1' END AS finding_id FROM part""",
    "labelled_items": "SELECT doc_id AS sample_id, lang, CASE WHEN quality = 1 THEN 'TP' ELSE 'FP' END AS verdict FROM documents JOIN labels USING (doc_id)",
    "gold_samples": """SELECT l.doc_id AS sample_id, 'python' AS language, coalesce(md5(d.text), '') AS code_snippet, coalesce(d.lang, '') AS context_before, '' AS context_after, CASE WHEN l.doc_id % 2 = 0 THEN 1 WHEN d.doc_id IS NOT NULL THEN 5 END AS span_start, CASE WHEN d.doc_id IS NOT NULL THEN 9 END AS span_end,
        CASE WHEN quality = 1 THEN 'TP' ELSE 'UNCERTAIN' END AS verdict, 'unknown' AS category, 'fix' AS fix_type, '' AS notes FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id AND d.doc_id % 3 > 0""",
    "features_of_samples": f"""WITH {_D} SELECT doc_id, CAST(len(l) AS INT) AS n_lines, CAST(length(t) AS INT) AS n_chars, CAST(least(512, len(regexp_extract_all(t, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\\s\\x0BA-Za-z0-9_]'))) AS INT) AS n_tokens, {_MEAN} AS avg_line_length,
        {_has("t", "import ")} AS has_import, {_has("t", "def ")} AS has_function_def, {_has("t", "class ")} AS has_class_def, {_has("t", "try:", "except")} AS has_try_except, {_has("t", "eval(")} AS has_eval, {_has("t", "exec(")} AS has_exec, {_has("t", "subprocess")} AS has_subprocess, {_has("t", "os.system")} AS has_os_system,
        {_has("lower(t)", "select", "insert", "update", "delete", "execute")} AS has_sql, {_has("t", "shell=True", "shell = True")} AS has_shell FROM d""",
    "features_of_consensus": f"""WITH {_D}, e AS (SELECT *, lower({_case(["SQL.injection", "crypto.weak", "hardcoded.secrets", "path.traversal"], "doc_id")}) AS k, doc_id % 2 = 0 AS two FROM d)
        SELECT doc_id, CASE WHEN two THEN 2 ELSE 1 END AS scanner_count, two AS has_bandit, false AS has_semgrep, NOT two AS has_secrets_scanner, two AS has_pattern_scanner, false AS has_dependency_scanner, CASE WHEN two THEN 0.4::DOUBLE ELSE 0.2 END AS scanner_agreement_ratio, CASE doc_id % 3 WHEN 0 THEN 0.8::DOUBLE WHEN 1 THEN 0.5 ELSE 1.0 END AS severity_score,
        {_has("k", "injection")} AS is_injection, {_has("k", "secret", "credential")} AS is_secrets, {_has("k", "crypto")} AS is_crypto, {_has("k", "xss")} AS is_xss, {_has("k", "path")} AS is_path_traversal, {_has("k", "deserial", "pickle")} AS is_deserialization, {_has("k", "dependency", "cve")} AS is_dependency_vuln, CAST(length(t) AS INT) AS code_length,
        {_has("lower(t)", "request", "input", "args", "params", "query")} AS has_user_input, {_has("lower(t)", "eval", "exec", "system", "popen", "shell")} AS has_dangerous_function, {_has("upper(t)", "SELECT", "INSERT", "UPDATE", "DELETE", "DROP")} AS has_sql_keyword, {_has("lower(t)", "open(", "read(", "write(", "file")} AS has_file_operation FROM e""",
    "features_of_generated": f"""WITH {_D} SELECT doc_id, CAST(len(l) AS INT) AS n_lines, CAST(length(t) AS INT) AS n_chars, 7 AS n_tokens, {_MEAN} AS avg_line_length, {_LONG} AS max_line_length, {_count("t", "def ", "function ")} AS n_functions, {_count("t", "class ")} AS n_classes, {_count("t", "import ", "from ")} AS n_imports, {_count("t", "#", "//", "/*")} AS n_comments,
        {_has("t", "try:", "try {")} AS has_try_except, {_has("t", "assert ")} AS has_assert, {_has("t", "logger.", "logging.", "console.log")} AS has_logging, {_has("t", '"sk-', '"pk_')} OR contains(lower(t), '"aws_') AS has_hardcoded_string, {_has("upper(t)", "SELECT", "INSERT", "UPDATE", "DELETE")} AS has_sql_keywords, {_has("t", "os.system", "subprocess", "shell=True", "exec(")} AS has_shell_calls,
        {_has("t", "open(", ".read(", ".write(", "file")} AS has_file_ops, {_has("t", "requests.", "http", "socket", "urllib")} AS has_network, {_has("t", "hashlib", "crypto", "encrypt", "decrypt")} AS has_crypto, {_has("t", "request.", "input(", "argv", "args")} AS has_user_input,
        CAST(coalesce(list_max({_INDENT.format("list_filter(l, lambda x: regexp_matches(x, '[^" + chr(92) + "s" + chr(92) + "x0B]'))")}), 0) // 4 AS INT) AS indentation_depth FROM d""",
    "features_of_improved": f"""WITH {_D} SELECT doc_id, CAST(len(l) AS INT) AS n_lines, CAST(length(t) AS INT) AS n_chars, 7 AS n_tokens, {_MEAN} AS avg_line_length, {_LONG} AS max_line_length, {_count("t", "def ", "function ")} AS n_functions, {_count("t", "class ")} AS n_classes, {_count("t", "import ", "require(")} AS n_imports, {_count("t", "#", "//")} AS n_comments,
        {_has("t", "try:", "try {")} AS has_try_except, {_has("t", "assert ")} AS has_assert, {_has("t", "logging.", "logger.", "console.log")} AS has_logging, {_RE('["' + "''" + ']([a-zA-Z0-9]{16,})["' + "''" + ']')} AS has_hardcoded_string, {_RE(chr(92) + "b(SELECT|INSERT|UPDATE|DELETE|WHERE)" + chr(92) + "b", ", 'i'")} AS has_sql_keywords, {_has("t", "subprocess", "os.system", "exec(")} AS has_shell_calls,
        {_has("t", "open(", "read(", "write(")} AS has_file_ops, {_has("t", "requests.", "urllib")} OR contains(lower(t), 'http') AS has_network, contains(t, 'hashlib') OR contains(lower(t), 'crypto') OR contains(t, 'encrypt') AS has_crypto, {_has("t", "input(", "request.", "argv")} AS has_user_input, CAST(list_max({_INDENT.format("l")}) // 4 AS INT) AS indentation_depth FROM d""",
    "features_engineered": f"WITH d AS (SELECT doc_id, coalesce(text, '') || {_SCRAP} AS t FROM documents) SELECT doc_id, "
    "CAST(len(string_split(t, chr(10))) AS INT) AS code_lines, "
    "CAST(length(t) AS INT) AS code_chars, "
    "round(length(t) / len(string_split(t, chr(10))), 6) AS avg_line_length, "
    "CAST(list_max(list_transform(string_split(t, chr(10)), lambda x: length(x))) AS INT) AS max_line_length, "
    "round(len(list_filter(string_split(t, chr(10)), lambda x: NOT regexp_matches(x, '\\S'))) / len(string_split(t, chr(10))), 6) AS blank_line_ratio, "
    "0 AS nested_depth, "
    "CAST(len(regexp_extract_all(t, '\\bdef\\s+\\w+|function\\s+\\w+')) AS INT) AS function_count, "
    "CAST(len(regexp_extract_all(t, '\\bclass\\s+\\w+')) AS INT) AS class_count, "
    "CAST(len(regexp_extract_all(t, '\\bfor\\b|\\bwhile\\b')) AS INT) AS loop_count, "
    "CAST(len(regexp_extract_all(t, '\\bif\\b|\\belse\\b|\\belif\\b')) AS INT) AS conditional_count, "
    "CAST(len(regexp_extract_all(t, '\\+\\s*[\"'']|[\"'']\\s*\\+')) AS INT) AS string_concat_count, "
    "CAST(len(regexp_extract_all(t, 'f[\"'']')) AS INT) AS fstring_count, "
    "CAST(len(regexp_extract_all(t, '\\.format\\s*\\(')) AS INT) AS format_count, "
    "CAST(len(regexp_extract_all(t, '%\\s*\\(')) AS INT) AS percent_format_count, "
    "CAST(regexp_matches(t, '\\beval\\s*\\(') AS INT) AS has_eval, "
    "CAST(regexp_matches(t, '\\bexec\\s*\\(') AS INT) AS has_exec, "
    "CAST(regexp_matches(t, '\\bsubprocess\\b') AS INT) AS has_subprocess, "
    "CAST(regexp_matches(t, 'shell\\s*=\\s*True') AS INT) AS has_shell_true, "
    "CAST(regexp_matches(t, '(?i)\\bSELECT\\b|\\bINSERT\\b|\\bUPDATE\\b|\\bDELETE\\b') AS INT) AS has_sql, "
    "CAST(regexp_matches(t, 'request\\.|req\\.') AS INT) AS has_request, "
    "CAST(regexp_matches(t, 'input\\(|argv|request\\.(get|post|form|args)') AS INT) AS has_user_input, "
    "CAST(regexp_matches(t, 'open\\s*\\(|read\\(|write\\(') AS INT) AS has_file_ops, "
    "CAST(regexp_matches(t, '(?i)md5|sha1|hashlib|crypto') AS INT) AS has_crypto, "
    "CAST(regexp_matches(t, 'pickle|marshal') AS INT) AS has_pickle, "
    "CAST(regexp_matches(t, 'yaml\\.load|yaml\\.unsafe') AS INT) AS has_yaml_load, "
    "CAST(regexp_matches(t, 'innerHTML|dangerouslySetInnerHTML') AS INT) AS has_innerhtml, "
    "CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 2 END AS severity_score, "
    "2 AS confidence_score, "
    "1 AS is_test_file, "
    "0 AS is_vendor, "
    "1 AS is_config, "
    "2 AS path_depth, "
    "CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS is_bandit, "
    "CASE WHEN doc_id % 3 = 1 THEN 1 ELSE 0 END AS is_semgrep FROM d",
    "features_of_gold": f"""WITH {_D} SELECT doc_id, CAST(len(l) AS INT) AS n_lines, CAST(length(t) AS INT) AS n_chars, 2 AS scanner_count, false AS has_bandit, true AS has_semgrep, false AS has_secrets, false AS has_patterns, true AS has_deps, {_has("t", "request", "input", "argv", "args")} AS has_user_input, {_has("t", "eval", "exec", "system", "pickle")} AS has_dangerous_fn, {_has("upper(t)", "SELECT", "INSERT", "UPDATE", "DELETE")} AS has_sql FROM d""",
    "ratio_split": f"WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY {_DRAWN(42, 'doc_id')}, doc_id) - 1 AS k, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN k < floor(n * 0.8::DOUBLE) THEN 'train' WHEN k < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM k",
    "floor_split": f"WITH k AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {_DRAWN(42, 'doc_id')}, doc_id) - 1 AS k, count(*) OVER (PARTITION BY quality) AS n FROM labels) SELECT doc_id, quality, CASE WHEN k < floor(n * 0.8::DOUBLE) THEN 'train' WHEN k < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM k",
    "retrieval_triples": f"""WITH r AS (SELECT item_id, text, row_number() OVER (ORDER BY {_DRAWN(1337, 'item_id')}, item_id) - 1 AS r, count(*) OVER () AS n, array_to_string(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]+')[1:12], ' ') AS q FROM benchmark)
        SELECT left(sha1(concat(a.q, a.item_id)), 12) AS triple_id, a.item_id AS chunk_id, a.q AS query, string_agg(b.item_id, ',' ORDER BY (b.r - a.r + a.n) % a.n) AS negatives FROM r a JOIN r b ON (b.r - a.r + a.n) % a.n BETWEEN 1 AND 3 WHERE a.q <> '' GROUP BY ALL""",
    "masked_events": f"""WITH c AS (SELECT c_custkey, c_name AS v, CASE WHEN c_custkey % 2 = 0 THEN 'Bearer ' || c_name ELSE c_name END AS note, left(c_name, 8) AS s FROM customer)
        SELECT c_custkey, {_MASK.format("v", 8)} AS token, CASE WHEN c_custkey % 2 = 0 THEN {_MASK.format("note", 8)} ELSE note END AS note, {_MASK.format("s", 8)} AS secret, {_MASK.format("'sk-short'", 8)} AS item, note AS sent_note, {_MASK.format("s", 7)} AS sent_secret, 'sk-short' AS sent_item,
        CASE WHEN c_custkey % 2 = 0 THEN {_MASK.format("note", 8)} ELSE note END AS clean_note, 'api_token=key_match' || CASE WHEN c_custkey % 2 = 0 THEN ',note=generic_bearer' ELSE '' END || ',in.secret=key_match' AS found FROM c""",
    "policy_overrides": "SELECT n_name AS tool, CASE WHEN n_nationkey % 6 = 0 AND n_regionkey = 1 THEN false ELSE true END AS allowed, 'read' AS scopes, n_nationkey % 2 = 0 OR n_nationkey % 6 = 0 AS requires_approval FROM nation",
    "top_classes": "WITH x AS (SELECT vec_id, unnest(list_transform(embedding, lambda v: v::DOUBLE)) AS p, generate_subscripts(embedding, 1) - 1 AS class FROM embeddings) SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, class) - 1 AS INT) AS place, CAST(class AS INT) AS class, round(p, 6) AS p FROM x QUALIFY place < 3",
    "patch_policy_reasons": f"""WITH {FINDINGS} SELECT ordinal AS diff_id, CASE WHEN ordinal // 100 % 7 = 0 THEN 'not a diff' WHEN ordinal // 100 % 11 = 0 THEN 'category not allowed' ELSE CASE ordinal // 100 % 7 WHEN 1 THEN 'more than one file' WHEN 2 THEN 'outside the finding' WHEN 3 THEN 'banned addition' WHEN 4 THEN 'another file' WHEN 6 THEN 'too many hunks' END END AS reason FROM findings""",
}
