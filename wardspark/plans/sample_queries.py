"""Queries over steps on the way to samples: files, labels, examples for ranking, candidates, notes, vocabulary, numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.functions import vector
from wardspark.functions.text import SECRET_VALUES, SECRETS
from wardspark.operators import findings as ops
from wardspark.operators import ingest, pipelines, redaction, retrieval
from wardspark.plans import finding_queries, ingest_queries
from wardspark.plans.common import FINDINGS, findings, table


def changed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No source of the first kind, so those of the second; the third is not asked."""
    d = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), (F.col("doc_id") % 50).cast("string"), F.lit(".md")).alias("path"), "lang")
    return ingest.changed_files(d.where("lang = 'none'"), d.where("lang = 'en'"), d)


def ranking_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as outcomes of a customer's job; two of three customers have a diff."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), F.concat(F.when(F.col("o_orderkey") % 2 == 0, "det-").otherwise("llm-"), F.col("o_orderkey").cast("string")).alias("candidate_id"), F.when(F.col("o_orderstatus") == "F", "accepted").otherwise("rejected").alias("action"))
    d = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("job_id"), F.concat(F.lit("+"), F.col("c_name")).alias("diff"))
    return pipelines.outcome_candidates(o, d)


def relabelled_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as samples, lines as their labels; the versions of every other are new in part."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample_id"), F.when(F.col("s_suppkey") % 5 > 0, F.create_map(F.lit("bandit"), F.lit("1.0"), F.lit("own"), F.lit("2.0"))).alias("tool_versions"))
    l = table(spark, sf_dir, "lineitem").where("l_suppkey % 7 > 0").select(F.col("l_suppkey").alias("sample_id"), F.concat(F.lit("R"), F.col("l_partkey").cast("string")).alias("rule_id"), F.col("l_linenumber").alias("line"))  # noqa: E741
    v = s.where("sample_id % 2 = 0").select("sample_id", F.create_map(F.lit("bandit"), F.lit("1.1"), F.lit("semgrep"), F.lit("3.0")).alias("tool_versions"))
    d = ingest.updated_labels(s, l, v)
    names = F.array_join(F.transform(F.array_sort(F.map_entries("tool_versions")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return d.select("sample_id", F.array_join(F.transform("weak_labels", lambda x: F.concat_ws(":", x["rule_id"], x["line"])), " ").alias("labels"), names.alias("versions"))


def stored_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.weak_labels(ingest_queries.parsed_reports(spark, sf_dir))


def merged_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged findings as samples, with the tokens of their code."""
    d = pipelines.training_samples(ops.consensus(finding_queries._scanned(spark, sf_dir)))
    return d.select("sample_id", "file_path", "line_start", "label", "verdict", F.array_join("tokens", " ").alias("tokens"))


def best_scored_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 surest merged findings."""
    merged = ops.consensus(finding_queries._scanned(spark, sf_dir)).withColumn("consensus_score", F.round("consensus_score", 6))
    return ops.by_score(merged).limit(50).select("file_path", "bucket", "consensus_score")


def events_of_last_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-25 12:00:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").where(F.col("ts") >= pipelines.since(7, now)).select("event_id", "ts")


def files_by_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("src/p"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 4 == 0, ".py").when(F.col("p_partkey") % 4 == 1, ".tsx").when(F.col("p_partkey") % 4 == 2, ".pyc").otherwise(".js")).alias("path"))
    return ingest.by_suffix(d, "path", [".py", ".ts", ".tsx"])


def following_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("graph_id"), F.col("l_linenumber").alias("place"), F.expr("l_partkey * 100000 + l_suppkey").alias("node_id")).distinct()
    return pipelines.hit_edges(h)


def preferred_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two makers' candidates for each file; a third of them was not validated, a seventh failed."""
    f = findings(spark, sf_dir)
    diff = F.concat(F.lit("+++ b/x\n@@ -1 +1 @@\n"), F.repeat(F.lit("+a\n"), (F.col("ordinal") % 4 + 1).cast("int")))
    made = lambda d, source: d.select(F.col("filepath").alias("finding_id"), F.concat(F.lit(source[:3]), F.col("ordinal").cast("string")).alias("candidate_id"), diff.alias("diff"), F.lit(source).alias("source"), F.col("confidence").alias("score"))
    one, two = made(f.where("ordinal % 2 = 0"), "deterministic"), made(f.where("ordinal % 2 = 1"), "llm")
    ids = f.select(F.concat(F.when(F.col("ordinal") % 2 == 0, "det").otherwise("llm"), F.col("ordinal").cast("string")).alias("candidate_id"), (F.col("ordinal") % 7 > 0).alias("valid"), "ordinal")
    return pipelines.best_candidates([one, two], ids.where("ordinal % 3 > 0").drop("ordinal"))


def reported_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir).select(F.col("filepath").alias("path"), F.col("start_line").alias("line"), "rule_id", "ordinal", "message")
    return ingest.first_reported(f)


def patches_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(redaction.redact_patch(F.col("text"))).alias("digest"), F.size(F.split(redaction.redact_patch(F.col("text")), "\\[REDACTED\\]")).alias("parts"))


def fixed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eighths, so that every tie is one."""
    return table(spark, sf_dir, "part").select("p_partkey", pipelines.fixed(F.col("p_partkey") / 8 * 1000, 2).alias("two"), pipelines.fixed(F.col("p_partkey") / 8, 1).alias("one"), pipelines.fixed(F.col("p_partkey") / 8, 0).alias("none"))


def pair_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with the one of the next id, feature by feature."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(n, "vec_id").select("vec_id", F.posexplode(vector.pair_features(F.col("v"), F.col("w"))).alias("place", "x")).withColumn("x", F.round("x", 6) + F.lit(0.0))  # no negative zeros


def padded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of a text's words as ids, within marks, in 64 places."""
    ids = F.transform(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\n]+"), lambda w: w != ""), F.char_length)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(vector.padded(ids, 64, [101], [102]).cast("array<string>"), " ").alias("ids"))


def documents_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, some of them Markdown with headings and words that tell their type."""
    more = F.when(F.col("doc_id") % 5 == 0, "\n## Fix pattern\n").when(F.col("doc_id") % 5 == 1, "\n## CWE-79\n##  second \n").when(F.col("doc_id") % 5 == 2, "\n## Example\n```py\n").when(F.col("doc_id") % 5 == 3, "\n### Semgrep\n").otherwise("\n")
    text = F.concat(F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("#  Title of "), F.col("doc_id").cast("string"), F.lit(" \n"))).otherwise(""), F.coalesce("text", F.lit("")), more)
    path = F.concat(F.lit("kb/d"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 > 0, ".md").otherwise(".txt"))
    d = retrieval.document_metadata(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), path.alias("path"), text.alias("text")))
    return d.select("document_id", "title", F.array_join("sections", "|").alias("sections"), "doc_type")


def noted_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category, fix and notes of all findings."""
    f = findings(spark, sf_dir)
    i = f.select(F.col("ordinal").alias("item_id"), F.col("rule_id"), ingest_queries._pick(ingest_queries._WORDS, F.expr("ordinal div 100")).alias("message"), F.when(F.col("ordinal") % 3 == 0, "TP").when(F.col("ordinal") % 3 == 1, "FP").otherwise("UNCERTAIN").alias("verdict"))
    return pipelines.labelled_notes(i).select(F.col("item_id").alias("ordinal"), "category", "fix_type", "notes")


_PLANTED = "concat(coalesce(text, ''), CASE doc_id % 5 WHEN 0 THEN concat('\n x AKIA', upper(left(md5(cast(doc_id AS {text})), 16))) WHEN 1 THEN concat('\na=ghp_', left(sha256(cast(doc_id AS {text})), 36), ' sk-', md5(cast(doc_id AS {text}))) WHEN 2 THEN concat('\n\nBearer ', md5(cast(doc_id AS {text}))) WHEN 3 THEN '\n-----BEGIN RSA PRIVATE KEY-----' ELSE '' END)"


def secrets_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, most with a secret of some kind behind them."""
    planted = F.expr(_PLANTED.format(text="string").replace("sha256(cast(doc_id AS string))", "sha2(cast(doc_id AS string), 256)"))
    return pipelines.scan_secrets(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), planted.alias("text")))


def vocabulary_by_first_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 5,000 words that stand twice, in order of their first place."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\n]+"), lambda w: w != "").alias("words"))
    return pipelines.first_seen_vocabulary(d, "words", "doc_id", 2)


def model_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of labelled documents as models, their share of good ones as F1."""
    m = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").groupBy(F.col("source").alias("model")).agg(F.avg("quality").alias("f1"))
    return pipelines.ensemble_weights(m).select("model", F.round("weight", 6).alias("weight"))


def patchable_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of which some lack an id, a path or lines."""
    n = lambda k, c: F.when(F.col("ordinal") % k > 0, c)
    f = findings(spark, sf_dir).select("ordinal", n(11, F.col("ordinal").cast("string")).alias("finding_id"), F.when(F.col("ordinal") % 13 == 0, "").otherwise(F.col("filepath")).alias("filepath"), n(5, F.col("start_line")).alias("start_line"), F.when(F.col("ordinal") % 3 == 0, 0).otherwise(F.col("end_line")).alias("end_line"), "rule_id", F.lit("x").alias("category"))
    return ingest.patch_inputs(f).select("ordinal", "start_line", "end_line")


QUERIES = {
    f.__name__: f
    for f in (changed_paths, ranking_examples, relabelled_samples, stored_weak_labels, merged_training_rows, best_scored_findings, events_of_last_days, files_by_suffix, following_hits, preferred_candidates, reported_once, patches_redacted,
              fixed_numbers, pair_vectors, padded_ids, documents_described, noted_findings, secrets_found, vocabulary_by_first_use, model_weights, patchable_findings)
}

_MERGED = finding_queries.ORACLE["consensus_bucket_merge"]
_CATEGORIES = ingest_queries.ORACLE["inferred_categories"]
_KINDS = [(k, p) for k, p in SECRET_VALUES if k != "jwt"] + [(f"secret_{n}", p) for n, p in enumerate(SECRETS) if p not in [x for _, x in SECRET_VALUES]]
_PATCH = "text"
for _p in redaction.PATCH_SECRETS:
    _PATCH = f"regexp_replace({_PATCH}, '{_p}', '[REDACTED]', 'g')"
_HIDDEN = "CASE WHEN length(m) <= 8 THEN '***REDACTED***' ELSE left(m, 4) || '***' || right(m, 4) END"
_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\n]+'), lambda w: w <> '')"
_PICKED = "CASE (ordinal // 100) % 10 WHEN 0 THEN 'sql-injection' WHEN 1 THEN 'B602 shell' WHEN 2 THEN 'md5 used' WHEN 3 THEN 'innerHTML' WHEN 4 THEN 'path-traversal ../' WHEN 5 THEN 'hardcoded_password' WHEN 6 THEN 'jwt none' WHEN 7 THEN 'B999' WHEN 8 THEN 'nothing' WHEN 9 THEN 'sha1' END"

ORACLE = {
    "changed_paths": "SELECT DISTINCT source || '/' || (doc_id % 50) || '.md' AS path FROM documents WHERE lang = 'en'",
    "ranking_examples": """SELECT o_custkey AS job_id, CASE WHEN o_orderkey % 2 = 0 THEN 'det-' ELSE 'llm-' END || o_orderkey AS candidate_id, '+' || c_name AS diff, CASE WHEN o_orderkey % 2 = 0 THEN 'deterministic' ELSE 'llm' END AS source,
        CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END AS label FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 3 > 0""",
    "relabelled_samples": """WITH l AS (SELECT l_suppkey AS k, string_agg('R' || l_partkey || ':' || l_linenumber, ' ' ORDER BY 'R' || l_partkey, l_linenumber) AS labels FROM lineitem WHERE l_suppkey % 7 > 0 GROUP BY 1)
        SELECT s_suppkey AS sample_id, coalesce(labels, '') AS labels, CASE WHEN s_suppkey % 5 > 0 AND s_suppkey % 2 = 0 THEN 'bandit=1.1,own=2.0,semgrep=3.0' WHEN s_suppkey % 2 = 0 THEN 'bandit=1.1,semgrep=3.0' WHEN s_suppkey % 5 > 0 THEN 'bandit=1.0,own=2.0' ELSE '' END AS versions FROM supplier LEFT JOIN l ON k = s_suppkey""",
    "stored_weak_labels": f"WITH p AS ({ingest_queries.ORACLE['parsed_reports']}) SELECT report_id, source, rule_id, severity, confidence, message, line, CASE WHEN file = 'unknown' THEN '' ELSE ltrim(file, './') END AS filepath FROM p",
    "merged_training_rows": f"""WITH m AS ({_MERGED}) SELECT sha256(concat_ws(':', file_path, line_start, category)) AS sample_id, file_path, line_start, label, CASE label WHEN 1 THEN 'TP' WHEN 0 THEN 'FP' END AS verdict,
        array_to_string(regexp_extract_all(code_snippet, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\\sA-Za-z0-9_]'), ' ') AS tokens FROM m""",
    "best_scored_findings": f"WITH m AS ({_MERGED}) SELECT file_path, bucket, consensus_score FROM m ORDER BY consensus_score DESC, file_path, bucket LIMIT 50",
    "events_of_last_days": "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-18 12:00:00'",
    "files_by_suffix": "SELECT p_partkey, 'src/p' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.py' ELSE '.tsx' END AS path FROM part WHERE p_partkey % 4 < 2",
    "following_hits": "WITH h AS (SELECT DISTINCT l_orderkey AS graph_id, l_linenumber AS place, l_partkey * 100000 + l_suppkey AS node_id FROM lineitem), e AS (SELECT graph_id, lag(node_id) OVER (PARTITION BY graph_id ORDER BY place, node_id) AS src, node_id AS dst FROM h) SELECT * FROM e WHERE src IS NOT NULL",
    "preferred_candidates": f"""WITH {FINDINGS}, c AS (SELECT filepath AS finding_id, CASE WHEN ordinal % 2 = 0 THEN 'det' ELSE 'llm' END || ordinal AS candidate_id, ordinal % 4 + 1 AS lines, ordinal, confidence FROM findings WHERE ordinal % 3 > 0 AND ordinal % 7 > 0)
        SELECT finding_id, candidate_id, CAST(lines AS INTEGER) AS lines, CAST(row_number() OVER (PARTITION BY finding_id ORDER BY confidence DESC, ordinal % 2, lines, candidate_id) AS INTEGER) AS place FROM c""",
    "reported_once": f"WITH {FINDINGS} SELECT filepath AS path, start_line AS line, rule_id, ordinal, message FROM findings QUALIFY row_number() OVER (PARTITION BY filepath, start_line, rule_id ORDER BY ordinal) = 1",
    "patches_redacted": f"SELECT doc_id, md5({_PATCH}) AS digest, CAST(len(string_split({_PATCH}, '[REDACTED]')) AS INTEGER) AS parts FROM documents",
    "fixed_numbers": "SELECT p_partkey, format('{:.2f}', p_partkey * 125::DOUBLE) AS two, format('{:.1f}', p_partkey / 8) AS one, format('{:.0f}', p_partkey / 8) AS none FROM part",
    "pair_vectors": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
        p AS (SELECT a.vec_id, list_concat(a.v, b.v, list_transform(range(1, 65), lambda i: abs(a.v[i] - b.v[i])), list_transform(range(1, 65), lambda i: a.v[i] * b.v[i])) AS f FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
        SELECT vec_id, CAST(unnest(range(0, 256)) AS INTEGER) AS place, round(unnest(f), 6) + 0.0::DOUBLE AS x FROM p""",
    "padded_ids": f"""WITH i AS (SELECT doc_id, list_concat([101], list_transform({_WORDS}[1:62], lambda w: length(w)), [102]) AS ids FROM documents)
        SELECT doc_id, array_to_string(list_concat(ids, list_transform(range(0, 64 - len(ids)), lambda x: 0)), ' ') AS ids FROM i""",
    "documents_described": """WITH d AS (SELECT doc_id, doc_id % 7 > 0 AS md, CASE WHEN doc_id % 3 > 0 THEN '#  Title of ' || doc_id || ' ' || chr(10) ELSE '' END || coalesce(text, '') || chr(10) || CASE doc_id % 5 WHEN 0 THEN '## Fix pattern' || chr(10) WHEN 1 THEN '## CWE-79' || chr(10) || '##  second ' || chr(10) WHEN 2 THEN '## Example' || chr(10) || '```py' || chr(10) WHEN 3 THEN '### Semgrep' || chr(10) ELSE '' END AS t FROM documents)
        SELECT doc_id AS document_id, CASE WHEN md AND doc_id % 3 > 0 THEN trim(regexp_extract(t, '(?m)^#\\s+(.+)$', 1)) WHEN md THEN 'd' || doc_id || '.md' ELSE 'd' || doc_id || '.txt' END AS title,
            CASE WHEN md THEN array_to_string(regexp_extract_all(t, '(?m)^##\\s+(.+)$', 1)[1:10], '|') ELSE '' END AS sections,
            CASE WHEN NOT md THEN NULL WHEN contains(lower(t), 'fix pattern') OR contains(lower(t), '- pattern:') THEN 'fix_patterns' WHEN contains(lower(t), 'cwe-') THEN 'vulnerability_reference' WHEN contains(lower(t), 'example') AND contains(t, '```') THEN 'code_examples' WHEN contains(lower(t), 'bandit') OR contains(lower(t), 'semgrep') THEN 'scanner_rules' ELSE 'playbook' END AS doc_type FROM d""",
    "noted_findings": f"""WITH c AS ({_CATEGORIES}), f AS (SELECT * FROM (WITH {FINDINGS} SELECT ordinal, rule_id, {_PICKED} AS message FROM findings))
        SELECT c.*, concat_ws('; ', 'rule ' || rule_id, message, CASE ordinal % 3 WHEN 0 THEN 'TP' WHEN 1 THEN 'FP' ELSE 'UNCERTAIN' END || ' as ' || category, CASE WHEN ordinal % 3 = 0 THEN 'fix by ' || fix_type END) AS notes FROM c JOIN f USING (ordinal)""",
    "secrets_found": f"WITH d AS (SELECT doc_id, {_PLANTED.format(text='varchar')} AS text FROM documents), l AS (SELECT CAST(doc_id AS VARCHAR) AS path, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS INTEGER) AS line, unnest(string_split(text, chr(10))) AS row FROM d), h AS ("
    + " UNION ALL ".join(f"SELECT path, line, '{k}' AS rule_id, regexp_extract(row, '{p}') AS m FROM l WHERE regexp_matches(row, '{p}')" for k, p in _KINDS)
    + f") SELECT DISTINCT path, line, rule_id, 'HIGH' AS severity, {_HIDDEN} AS masked FROM h",
    "vocabulary_by_first_use": f"""WITH w AS (SELECT doc_id, unnest({_WORDS}) AS token, unnest(range(0, len({_WORDS}))) AS place FROM documents), g AS (SELECT token, count(*) AS n, min({{'d': doc_id, 'p': place}}) AS first FROM w GROUP BY token),
        k AS (SELECT * FROM g WHERE n >= 2 AND token NOT IN ('[PAD]', '[CLS]', '[SEP]', '[UNK]') ORDER BY first, token LIMIT 5000) SELECT token, n, CAST(row_number() OVER (ORDER BY first, token) + 3 AS INTEGER) AS index FROM k""",
    "model_weights": "WITH m AS (SELECT source AS model, avg(quality) AS f1 FROM labels JOIN documents USING (doc_id) GROUP BY 1) SELECT model, round(CASE WHEN sum(f1) OVER () > 0 THEN f1 / sum(f1) OVER () ELSE 1 / count(*) OVER () END, 6) AS weight FROM m",
    "patchable_findings": f"WITH {FINDINGS} SELECT ordinal, start_line, CASE WHEN ordinal % 3 = 0 THEN start_line ELSE end_line END AS end_line FROM findings WHERE ordinal % 11 > 0 AND ordinal % 13 > 0 AND ordinal % 5 > 0",
}
