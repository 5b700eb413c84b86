"""Queries over labels, reports and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.functions.text import identifier_tokens
from wardspark.operators import fixes, graphs, labelling, reports, spans
from wardspark.plans.common import FINDINGS, SPANS_SQL, findings, table
from wardspark.plans.common import spans as all_spans


def category_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", labelling.category(F.concat("p_type", F.lit("-"), F.element_at(F.array(*map(F.lit, ("SQLi", "os.exec", "Html", "token", "pickle", "md5", "file", "cve"))), (F.col("p_partkey") % 8 + 1).cast("int")))).alias("category"))


def staged_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir)
    path = F.when(F.col("ordinal") % 11 == 0, F.concat(F.lit("tests/"), F.col("filepath"))).otherwise(F.col("filepath"))
    snippet = F.when(F.col("ordinal") % 7 == 0, "x = request.args").when(F.col("ordinal") % 13 == 0, "y() # nosec").otherwise("z = 1")
    return f.select("ordinal", labelling.staged_verdict(path, snippet, F.col("severity"), F.col("confidence_word")).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


def verdict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of each finding, by all phases; staged_verdicts has the short form that its SQL states."""
    f = findings(spark, sf_dir)
    one = lambda k, *values: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    path = F.when(F.col("ordinal") % 11 == 0, F.concat(F.lit("tests/"), F.col("filepath"))).when(F.col("ordinal") % 5 == 0, F.concat(F.lit("auth/"), F.col("filepath"))).otherwise(F.col("filepath"))
    snippet = one(F.col("ordinal") % 7, "x = request.args", "y() # nosec", "z = 1", "token = random()", "shuffle(x)", "changeme", "user")
    rule = one(F.col("ordinal") % 9, "B101", "B110", "B404", "B311", "B105", "innerHTML", "B608", "R1", "R2")
    message = F.concat("message", one(F.col("ordinal") % 3, "", " possible", " xss"))
    v = labelling.inferred_verdict(rule, message, path, snippet, F.col("severity"), F.col("confidence_word"))
    return f.select("ordinal", v.alias("verdict"))


def inferred_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict_rows(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("n"))


def vulnerability_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "row"))
    return d.select("doc_id", "k", labelling.vulnerability(F.col("row")).alias("kind")).where("kind IS NOT NULL")


def risk_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels")  # noqa: E741
    k = F.col("doc_id") % 4
    verdict = F.when(F.col("toxic") == 1, "TP").when(k == 1, "UNCERTAIN").otherwise("FP")
    return l.select("doc_id", labelling.risk_label(F.when(k == 0, F.col("quality")), F.when(k == 2, F.col("toxic") == 1), verdict).alias("risk")).where("risk IS NOT NULL")


def closed_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.createDataFrame([("en",), ("fr",)], "word string")
    return labelling.unknown_words(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", words)


def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.element_at(F.array(*map(F.lit, ("Eval", "yaml file", "none", "PATH sql"))), (F.col("p_partkey") % 4 + 1).cast("int"))).alias("q"))
    return q.select("p_partkey", labelling.expanded(F.col("q")).alias("expanded"))


def safe_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.concat(F.lit("f"), (F.col("doc_id") % 97).cast("string")).alias("filepath"), F.col("doc_id").cast("string").alias("sample_id"))
    f = table(spark, sf_dir, "labels").where("toxic = 1").select(F.concat(F.lit("f"), (F.col("doc_id") % 97).cast("string")).alias("filepath"))
    return labelling.safe_files(d, f, 10, 3)


def report_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report_id"), F.col("o_orderpriority").alias("repo"), F.col("o_orderdate").alias("created_at"))
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("report_id")).agg(F.count("*").alias("findings"))
    first = o.agg(F.min("repo")).first()[0]
    return reports.report_list(o, c, 50, first)


def patch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("finding_id"))
    c = l.where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("finding_id"), (F.col("l_linestatus") == "F").alias("validated"))
    s = l.where("l_returnflag = 'R' AND l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("finding_id")).agg(F.min("l_partkey").alias("candidate_id"))
    t = l.groupBy(F.col("l_orderkey").alias("finding_id")).agg(F.max("l_quantity").alias("seconds")).where("seconds > 10")
    return reports.summarise(reports.patch_statuses(o, s, c), t)


def risk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.risk_summary(findings(spark, sf_dir).select(F.col("confidence").alias("score")))


def mapping_rates_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = findings(spark, sf_dir).select(F.col("ordinal").alias("row_id"), F.lit("r").alias("repo"), "filepath", F.col("end_line").alias("line"))
    m = li.select("row_id", "filepath").join(spans.enclosing(li, all_spans(spark)), "row_id", "left")
    return reports.mapping_rates(m, "filepath")


def token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.length_statistics(table(spark, sf_dir, "documents"), identifier_tokens(F.col("text")), "lang")


def citation_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    t = l.select(F.col("l_orderkey").alias("finding_id"), (F.col("l_suppkey") % 3 + 1).alias("tier"), F.col("l_linenumber").alias("place"), F.concat_ws("-", "l_partkey", "l_suppkey").alias("chunk_id"))
    return reports.citations(t)


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "conversations")
    n = c.select(F.col("conv_id").alias("graph_id"), F.col("turn").alias("node_id"), F.array(F.char_length("text").cast("double"), F.col("turn").cast("double")).alias("v"))
    e = c.where("turn > 0").select(F.col("conv_id").alias("graph_id"), (F.col("turn") - 1).alias("src"), F.col("turn").alias("dst"), F.lit(0).alias("type"))
    return n, e


def graph_collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.collate(*_graph(spark, sf_dir))[1].select("graph_id", "src", "dst")


def graph_neighbour_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.neighbour_means(*_graph(spark, sf_dir))


def graph_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.mean_pool(_graph(spark, sf_dir)[0]).withColumn("value", F.round("value", 6))


def graph_use_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("graph_id"), F.col("role").alias("name"), F.col("turn").alias("node_id"))
    return graphs.use_edges(c)


def graph_sibling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("graph_id"), F.col("role").alias("body"), F.col("turn").alias("place"), F.col("turn").alias("node_id"))
    return graphs.sibling_edges(c)


def answer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    text = F.when(k == 0, "--- a/x\n+++ b/x").when(k == 1, "```\nx").when(k == 2, "Explanation: x").when(k == 3, "x").otherwise("diff --git a b\n$ rm")
    return table(spark, sf_dir, "part").select("p_partkey", fixes.diff_only(text).alias("reason"))


def _any(column: str, patterns: list[str]) -> str:
    return "(" + " OR ".join("regexp_matches({}, '{}', 'i')".format(column, p.replace("'", "''")) for p in patterns) + ")"


def _has(column: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_ASSERTS, _RANDOM, _SECRET, _MARKUP = "(contains(rule, 'B101') OR contains(lower(rule), 'assert'))", "(contains(rule, 'B311') OR contains(lower(rule), 'random'))", "regexp_matches(rule, 'B10[567]')", "(contains(lower(rule), 'innerhtml') OR contains(message, 'xss'))"
_PHASES = [
    (_any("path", labelling.FALSE_PATHS), "FP"),
    *[(f"{_any('rule', [r])} AND {_any(chr(40) + 'path || chr(32) || code' + chr(41), [p])}", "FP") for r, p in labelling.FALSE_RULES],
    (_any("code", labelling.FALSE_CODE), "FP"), (_any("code", labelling.TRUE_CODE), "TP"),
    (f"{_ASSERTS} AND {_has('path', 'auth', 'security', 'permission', 'access')}", "UNCERTAIN"), (_ASSERTS, "FP"),
    (f"contains(rule, 'B110') AND {_has('code', 'security', 'auth', 'password', 'token', 'secret')}", "TP"), ("contains(rule, 'B110') OR contains(rule, 'B404')", "FP"),
    (f"{_RANDOM} AND {_has('code', 'secret', 'token', 'password', 'key', 'salt', 'nonce', 'iv')}", "TP"), (f"{_RANDOM} AND {_has('code', 'shuffle', 'sample', 'choice', 'color', 'display', 'game')}", "FP"), (_RANDOM, "UNCERTAIN"),
    (f"{_SECRET} AND ({_has('code', 'xxx', 'placeholder', 'changeme', 'example', 'your_')} OR {_has('path', 'test', 'example', 'sample', 'config')})", "FP"), (_SECRET, "TP"),
    (f"{_MARKUP} AND {_has('path', 'ckeditor', 'tinymce', 'vendor', 'node_modules', '.min.js')}", "FP"), (f"{_MARKUP} AND {_has('code', 'request', 'user', 'param', 'input')}", "TP"), (_MARKUP, "UNCERTAIN"),
    ("weight >= 0.7", "TP"), ("weight <= 0.3", "UNCERTAIN"), (_any("lower(rule || ' ' || message)", labelling.UNCERTAIN_WORDS), "UNCERTAIN"),
]
_CHOSEN = lambda k, *values: "CASE " + k + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"
_WEIGHED = lambda c, table, other: f"CASE upper({c}) " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in table.items()) + f" ELSE {other} END"
_VERDICT_ROWS = f"""WITH {FINDINGS}, s AS (SELECT ordinal, lower(CASE WHEN ordinal % 11 = 0 THEN 'tests/' || filepath WHEN ordinal % 5 = 0 THEN 'auth/' || filepath ELSE filepath END) AS path,
    lower({_CHOSEN("ordinal % 7", "x = request.args", "y() # nosec", "z = 1", "token = random()", "shuffle(x)", "changeme", "user")}) AS code, {_CHOSEN("ordinal % 9", "B101", "B110", "B404", "B311", "B105", "innerHTML", "B608", "R1", "R2")} AS rule,
    lower(message || {_CHOSEN("ordinal % 3", "", " possible", " xss")}) AS message, {_WEIGHED("severity", labelling.SEVERITY_WEIGHT, 0.5)} * {_WEIGHED("confidence_word", labelling.CONFIDENCE_WEIGHT, 0.7)} AS weight FROM findings),
    v AS (SELECT ordinal, CASE {" ".join(f"WHEN {c} THEN '{v}'" for c, v in _PHASES)} ELSE 'TP' END AS verdict FROM s)"""

QUERIES = {
    f.__name__: f
    for f in (category_map, staged_verdicts, inferred_verdicts, verdict_rows, vulnerability_windows, risk_labels, closed_vocabulary, query_expansion, safe_documents, report_list, patch_summary, risk_summary, mapping_rates_by_file, token_lengths, citation_tiers, graph_collate, graph_neighbour_means, graph_mean_pool, graph_use_edges, graph_sibling_edges, answer_checks)
}


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_CATEGORY = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(c, '{w}')" for w in words) + f" THEN '{name}'" for name, words in labelling.CATEGORIES) + " ELSE c END"
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(row, {_lit('(?i)' + p)}) THEN '{k}'" for p, k in labelling.VULNERABLE) + " END"
_EXPAND = "q || CASE " + " ".join(f"WHEN contains(lower(q), '{t}') THEN ' {e}'" for t, e in labelling.EXPANSIONS) + " ELSE '' END"
_SEV = "CASE upper(severity) WHEN 'CRITICAL' THEN 1.0 WHEN 'HIGH' THEN 0.9 WHEN 'MEDIUM' THEN 0.7 WHEN 'LOW' THEN 0.4 ELSE 0.2 END"
_CON = "CASE confidence_word WHEN 'HIGH' THEN 1.0 WHEN 'MEDIUM' THEN 0.7 ELSE 0.4 END"
ORACLE = {
    "verdict_rows": f"{_VERDICT_ROWS} SELECT * FROM v",
    "inferred_verdicts": f"{_VERDICT_ROWS} SELECT verdict, count(*) AS n FROM v GROUP BY verdict",
    "category_map": f"WITH p AS (SELECT p_partkey, lower(p_type || '-' || ['SQLi', 'os.exec', 'Html', 'token', 'pickle', 'md5', 'file', 'cve'][CAST(p_partkey % 8 + 1 AS INT)]) AS c FROM part) SELECT p_partkey, {_CATEGORY} AS category FROM p",
    "staged_verdicts": f"WITH {FINDINGS} SELECT CASE WHEN ordinal % 11 = 0 OR (ordinal % 13 = 0 AND ordinal % 7 <> 0) THEN 'FP' WHEN ordinal % 7 = 0 THEN 'TP' WHEN {_SEV}::DOUBLE * {_CON}::DOUBLE >= 0.6::DOUBLE THEN 'TP' WHEN {_SEV}::DOUBLE * {_CON}::DOUBLE < 0.3::DOUBLE THEN 'FP' ELSE 'UNCERTAIN' END AS verdict, count(*) AS n FROM findings GROUP BY 1",
    "vulnerability_windows": f"WITH d AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS k, unnest(string_split(text, chr(10))) AS row FROM documents) SELECT doc_id, k, {_KIND} AS kind FROM d WHERE kind IS NOT NULL",
    "risk_labels": "SELECT doc_id, risk FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN quality WHEN doc_id % 4 = 2 THEN toxic WHEN toxic = 1 THEN 1 WHEN doc_id % 4 = 1 THEN NULL ELSE 0 END AS risk FROM labels) WHERE risk IS NOT NULL",
    "closed_vocabulary": "SELECT doc_id, lang FROM documents WHERE lang NOT IN ('en', 'fr')",
    "query_expansion": f"WITH p AS (SELECT p_partkey, p_name || ' ' || ['Eval', 'yaml file', 'none', 'PATH sql'][CAST(p_partkey % 4 + 1 AS INT)] AS q FROM part) SELECT p_partkey, {_EXPAND} AS expanded FROM p",
    "safe_documents": """WITH d AS (SELECT source AS repo, concat('f', doc_id % 97) AS filepath, CAST(doc_id AS VARCHAR) AS sample_id FROM documents), c AS (SELECT * FROM d WHERE filepath NOT IN (SELECT concat('f', doc_id % 97) FROM labels WHERE toxic = 1) QUALIFY row_number() OVER (PARTITION BY filepath ORDER BY sample_id) <= 3)
        SELECT filepath, repo, sample_id FROM c QUALIFY row_number() OVER (PARTITION BY repo ORDER BY sha256(concat('safe:', sample_id)), sample_id) <= 10""",
    "report_list": "WITH r AS (SELECT o_orderkey AS report_id, o_orderpriority AS repo, o_orderdate AS created_at FROM orders WHERE o_orderpriority = (SELECT min(o_orderpriority) FROM orders) ORDER BY created_at DESC, report_id DESC LIMIT 50) SELECT r.*, (SELECT count(*) FROM lineitem WHERE l_orderkey = report_id) AS findings FROM r",
    "patch_summary": """WITH c AS (SELECT l_orderkey AS f, count(*) FILTER (WHERE l_returnflag <> 'N') AS n, max(CASE WHEN l_returnflag <> 'N' AND l_linestatus = 'F' THEN 1 ELSE 0 END) AS valid, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'F') AS s, max(l_quantity) AS q FROM lineitem GROUP BY 1),
        j AS (SELECT CASE WHEN coalesce(s, 0) > 0 THEN 'patched' WHEN coalesce(n, 0) = 0 THEN 'no_candidate' WHEN valid = 0 THEN 'rejected' ELSE 'validated' END AS st, CASE WHEN q > 10 THEN q END AS q FROM orders LEFT JOIN c ON o_orderkey = f)
        SELECT count(*) AS total, count(*) FILTER (WHERE st = 'patched') AS patched, count(*) FILTER (WHERE st = 'validated') AS validated, count(*) FILTER (WHERE st = 'rejected') AS rejected, count(*) FILTER (WHERE st = 'no_candidate') AS no_candidate, round(avg(q), 6) AS avg_seconds FROM j""",
    "risk_summary": f"WITH {FINDINGS} SELECT count(*) AS total, count(*) FILTER (WHERE confidence > 0.7::DOUBLE) AS high, count(*) FILTER (WHERE confidence BETWEEN 0.4::DOUBLE AND 0.7::DOUBLE) AS medium, count(*) FILTER (WHERE confidence < 0.4::DOUBLE) AS low FROM findings",
    "mapping_rates_by_file": f"WITH {FINDINGS}, {SPANS_SQL}, m AS (SELECT filepath, EXISTS (SELECT 1 FROM spans s WHERE s.filepath = f.filepath AND f.end_line BETWEEN s.start_line AND s.end_line) AS ok FROM findings f) SELECT filepath, count(*) AS total, count(*) FILTER (WHERE ok) AS mapped, grouping(filepath) AS level FROM m GROUP BY ROLLUP (filepath)",
    "token_lengths": "WITH t AS (SELECT lang, len(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]+')) AS n FROM documents) SELECT lang, CAST(min(n) AS INT) AS least, CAST(max(n) AS INT) AS most, round(avg(n), 4) AS mean FROM t GROUP BY lang",
    "citation_tiers": """WITH t AS (SELECT l_orderkey AS finding_id, l_suppkey % 3 + 1 AS tier, concat(l_partkey, '-', l_suppkey) AS chunk_id, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 3 ORDER BY l_linenumber, concat(l_partkey, '-', l_suppkey)) AS k FROM lineitem)
        SELECT finding_id, chunk_id, CAST(row_number() OVER (PARTITION BY finding_id ORDER BY CASE WHEN tier <= 2 AND k <= 2 THEN 0 ELSE 1 END, tier, k, chunk_id) AS INT) AS n FROM t QUALIFY n <= 5""",
    "graph_collate": "WITH o AS (SELECT conv_id, coalesce(sum(count(*)) OVER (ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM conversations GROUP BY conv_id) SELECT conv_id AS graph_id, CAST(turn - 1 + o AS BIGINT) AS src, CAST(turn + o AS BIGINT) AS dst FROM conversations JOIN o USING (conv_id) WHERE turn > 0",
    "graph_neighbour_means": """WITH v AS (SELECT conv_id, turn, unnest([0, 1]) AS dim, unnest([length(text)::DOUBLE, turn::DOUBLE]) AS value FROM conversations)
        SELECT a.conv_id AS graph_id, a.turn AS node_id, a.dim, coalesce(b.value, 0) AS value FROM v a LEFT JOIN v b ON a.conv_id = b.conv_id AND a.dim = b.dim AND b.turn = a.turn - 1 AND a.turn > 0""",
    "graph_mean_pool": "WITH v AS (SELECT conv_id AS graph_id, unnest([0, 1]) AS dim, unnest([length(text)::DOUBLE, turn::DOUBLE]) AS x FROM conversations) SELECT graph_id, dim, round(avg(x), 6) AS value FROM v GROUP BY 1, 2",
    "graph_use_edges": "SELECT conv_id AS graph_id, min(turn) OVER (PARTITION BY conv_id, role) AS src, turn AS dst FROM conversations QUALIFY src <> dst",
    "graph_sibling_edges": "SELECT conv_id AS graph_id, turn AS src, lead(turn) OVER (PARTITION BY conv_id, role ORDER BY turn) AS dst FROM conversations QUALIFY dst IS NOT NULL",
    "answer_checks": "SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN 'contains code fence' WHEN 2 THEN 'contains prose' WHEN 3 THEN 'missing diff header' WHEN 4 THEN 'contains shell prompt' END AS reason FROM part",
}
