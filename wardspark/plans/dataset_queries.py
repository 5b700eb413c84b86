"""Queries over documents, labels, vectors and patches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.functions import text, vector
from wardspark.operators import code, datasets, metrics, patches, retrieval, store
from wardspark.plans.common import FINDINGS, findings, table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").join(_docs(spark, sf_dir).select("doc_id", "lang", "source", "n_chars"), "doc_id")


def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.hash_split(_docs(spark, sf_dir).select("doc_id"), "doc_id")


def split_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.count_splits(datasets.hash_split(table(spark, sf_dir, "labels"), "doc_id"), "quality")


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.stratified_split(_labelled(spark, sf_dir), "doc_id", "lang").select("doc_id", "lang", "split")


def ood_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.ood_split(_docs(spark, sf_dir).select("doc_id", "source"), "doc_id", "source")


def balance_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.balance_ratio(table(spark, sf_dir, "labels"), "doc_id", F.col("quality") == 0, 2).select("doc_id", "quality")


def balance_oversample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.balance_oversample(table(spark, sf_dir, "labels"), "doc_id", "quality").select("doc_id", "quality", "copy")


def capped_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.cap_per(_docs(spark, sf_dir).select("doc_id", "source"), "source", 5, datasets.draw("cap", F.col("doc_id")), "doc_id")


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.class_weights(_labelled(spark, sf_dir), "lang").withColumn("weight", F.round("weight", 6))


def agreement_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels").select((F.col("doc_id") % 300).cast("string").alias("duplicate_group"), F.col("quality").alias("verdict"))  # noqa: E741
    return datasets.agreement(l)


def token_vocab_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.vocabulary(_docs(spark, sf_dir), text.identifier_tokens(F.col("text")), 1000)


def code_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.code_features(_docs(spark, sf_dir).select("doc_id", "text"), "text").drop("text")


def line_rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("R1", "high", "secret", "CWE-798", "(?i)(token|password|secret)\\s*[=:]"), ("R2", "low", "contact", "CWE-200", "[a-z0-9.]+@[a-z0-9]+\\.[a-z]+"), ("R3", "low", "markup", "CWE-79", "&&&|%%%"), ("R4", "medium", "licence", "-", "(?i)licen[sc]ed? ")]
    files = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), "text")
    return code.scan_lines(files, rules).drop("cwe")


def redact_long_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(text.redact_secrets(F.col("text"))).alias("digest"))


def redact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.regexp_count(text.redact_secrets(F.col("text")), F.lit("\\[REDACTED\\]"))
    return _docs(spark, sf_dir).groupBy("source").agg(F.sum(n).alias("n"), F.count_if(n > 0).alias("docs"))


def mask_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", text.mask_value(F.col("c_name")).alias("masked"), text.mask_value(F.left("c_name", F.lit(6))).alias("short"))


def excerpt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(text.excerpt(F.split("text", "\n"), F.lit(2), F.lit(3))).alias("digest"))


def chunk_800_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = retrieval.index(_docs(spark, sf_dir).select(F.col("doc_id").alias("document_id"), "text"))
    return c.select("document_id", "chunk_index", "chunk_id", F.md5("text").alias("digest"))


def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _docs(spark, sf_dir).select("doc_id", F.explode(text.line_windows(F.split("text", "\n"), 4, 2)).alias("w"))
    return w.select("doc_id", F.col("w.start").alias("start"), F.md5(F.array_join("w.lines", "\n")).alias("digest"))


def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.hash_embedding(_docs(spark, sf_dir), "doc_id", "text").withColumn("weight", F.round("weight", 6))


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.nearest(q, e.select(F.col("vec_id").alias("item_id"), "embedding"), 10)


def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.word_scores(q, _docs(spark, sf_dir).select("doc_id", "text"))


def rerank_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    first = retrieval.nearest(q, e.select(F.col("vec_id").alias("item_id"), "embedding"), 30).drop("place")
    b = e.select(F.col("vec_id").alias("item_id"), F.when(F.col("label") % 2 == 0, "guide").otherwise("note").alias("doc_type"), retrieval.boost(F.col("label") % 3, (F.col("label") == 4).cast("int"), (F.col("label") == 7).cast("int"), F.col("label") % 2 == 0).alias("boost"))
    return retrieval.rerank(first, b, 30, 5, ["guide"]).select("query_id", "item_id", "rerank", "place")


def mean_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.mean_and_covariance(table(spark, sf_dir, "embeddings"), "embedding")[1].withColumn("cov", F.round("cov", 5) + F.lit(0.0))  # no negative zeros


def ood_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limits, 1.7 and 0.45 for vectors of 8 numbers, grow by ln(n) and sqrt(n)."""
    e = table(spark, sf_dir, "embeddings")
    v = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    h = F.round(vector.entropy(F.transform(v, lambda x: x / total)), 6)
    grown = F.size("embedding") / 8.0
    return e.select("vec_id", h.alias("entropy"), retrieval.out_of_distribution(h, F.round(vector.norm(F.col("embedding")), 6), 1.7 + F.log(grown), 0.45 * F.sqrt(grown)).alias("reason"))


def auroc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auroc(_labelled(spark, sf_dir), F.col("quality"), F.col("n_chars")).select(F.round("auroc", 6).alias("auroc"))


def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = metrics.confusion(_labelled(spark, sf_dir), F.col("quality"), (F.col("n_chars") > 400).cast("int"))
    return c.select("tp", "fp", "fn", "tn", *[F.round(x, 6).alias(x) for x in ("accuracy", "precision", "recall", "f1")])


def per_class_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("label"), F.when(F.col("vec_id") % 4 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("told"))
    return metrics.per_class(e, "label", "told")


def anti_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.resume(_docs(spark, sf_dir).select("doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"])


def upsert_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 5000).alias("key"), F.col("o_orderkey").alias("id"), "o_orderstatus")
    return store.insert_if_absent(o.where("id < 2000"), o.where("id >= 2000"), ["key"], ["id"])


def replace_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 5000).alias("key"), F.col("o_orderkey").alias("id"), "o_orderstatus")
    return store.replace_by_key(o.where("id < 2000"), o.where("id >= 2000"), ["key"], ["id"])


def overlay_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("k"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).alias("title"))
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("title"))
    base = n.select("n_nationkey", "k").join(r, "k")
    return store.overlay(base, n.select("n_nationkey", "title"), "n_nationkey", ["title"])


def select_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("item_id"), F.concat(F.lit("s"), F.substring("source", 4, 9)).alias("source"), "lang", F.concat("lang", (F.col("doc_id") % 5).cast("string")).alias("rule_id"), (F.col("doc_id") % 3 + 1).alias("weight"), F.greatest(F.lit(0), F.col("doc_id") % 9 - 5).alias("hardness"))
    return datasets.select_round_robin(d.drop("lang"), 60, 4)


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir)
    line = F.col("start_line").cast("string")
    body = F.concat(F.lit("--- a/"), F.col("filepath"), F.lit("\n+++ b/"), F.col("filepath"), F.lit("\n@@ -"), line, F.lit(",3 +"), line, F.lit(",4 @@\n keep\n-old "), F.col("rule_id"), F.lit("\n+new\n+"), F.when(F.col("ordinal") % 5 == 0, "eval(x)").otherwise("safe(x)"), F.lit("\n keep"))
    return f.select(F.col("ordinal").alias("diff_id"), body.alias("diff"), "start_line", "end_line")


def diff_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patches.diff_lines(_diffs(spark, sf_dir)).select("diff_id", "hunk", "kind", "old_line", "new_line", "text")


def diff_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patches.policy(_diffs(spark, sf_dir))


def rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir)
    diff = F.concat(F.lit("+++ b/x\n@@ -1 +1 @@\n"), F.repeat(F.lit("+a\n"), (F.col("ordinal") % 4 + 1).cast("int")))
    c = f.select(F.col("filepath").alias("finding_id"), F.col("ordinal").cast("string").alias("candidate_id"), diff.alias("diff"), F.when(F.col("ordinal") % 2 == 0, "deterministic").otherwise("llm").alias("source"), (F.col("ordinal") % 3 > 0).alias("valid"), F.col("confidence").alias("score"))
    return patches.rank(c)


def patch_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    p = l.groupBy(F.col("l_orderkey").alias("job_id")).agg(F.count("*").alias("total"), F.count_if(F.col("l_linestatus") == "F").alias("validated"))
    o = l.select(F.col("l_orderkey").alias("job_id"), F.when(F.col("l_returnflag") == "A", "accepted").otherwise("rejected").alias("action"), F.col("l_shipdate").alias("ts"), F.col("l_partkey").alias("id"))
    return patches.rates(p, o, 2)


QUERIES = {
    f.__name__: f
    for f in (hash_split, split_class_counts, stratified_split, ood_split, balance_ratio, balance_oversample, capped_per_source, class_weights, agreement_rate, token_vocab_top, code_features, line_rule_hits, redact_long_tokens, redact_counts, mask_values, excerpt_context, chunk_800_100, line_windows, hash_embedding, cosine_topk, lexical_topk, rerank_boost, mean_cov, ood_reasons, auroc_rank, confusion_counts, per_class_prf, anti_resume, upsert_first_wins, replace_by_key, overlay_config, select_round_robin, diff_line_numbers, diff_policy, rank_candidates, patch_rates)
}
_BUCKET = "CAST(concat('0x', left(sha256(concat('42:', doc_id)), 16)) AS UBIGINT)::DOUBLE / 18446744073709551616"
_SPLIT = f"CASE WHEN {_BUCKET} < 0.8 THEN 'train' WHEN {_BUCKET} < 0.8 + 0.1 THEN 'val' ELSE 'test' END"
_LAB = "lab AS (SELECT l.*, d.lang, d.source, d.n_chars FROM labels l JOIN documents d USING (doc_id))"
_DRAW = "sha256(concat('42:', doc_id))"
_REDACT = "text"
for _p in [*text.SECRETS, text.LONG_TOKEN]:
    _REDACT = f"regexp_replace({_REDACT}, '{_p}', '[REDACTED]', 'g')"
_TOKENS = "regexp_extract_all(lower(text), '[a-z_][a-z0-9_]+')"
_MASK = "CASE WHEN length({c}) <= 8 THEN '***REDACTED***' ELSE left({c}, 4) || '***' || right({c}, 4) END"
_COS = "round(list_dot_product(q.e, i.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(i.e, i.e))), 6)"
_VEC = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"
_NEAREST = f"{_VEC}, n AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, {_COS} AS score FROM v q, v i WHERE q.vec_id % 20 = 0)"
_ORD = "SELECT o_orderkey % 5000 AS key, o_orderkey AS id, o_orderstatus FROM orders"
_CONF = "SELECT count(*) FILTER (WHERE quality = 1 AND n_chars > 400)::DOUBLE AS tp, count(*) FILTER (WHERE quality = 0 AND n_chars > 400)::DOUBLE AS fp, count(*) FILTER (WHERE quality = 1 AND n_chars <= 400)::DOUBLE AS fn, count(*) FILTER (WHERE quality = 0 AND n_chars <= 400)::DOUBLE AS tn FROM lab"
ORACLE = {
    "hash_split": f"SELECT doc_id, {_SPLIT} AS split FROM documents",
    "split_class_counts": f"SELECT split, quality, count(*) AS n, grouping(split, quality) AS level FROM (SELECT quality, {_SPLIT} AS split FROM labels) GROUP BY CUBE (split, quality)",
    "stratified_split": f"""WITH {_LAB}, k AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_DRAW}, doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM lab),
        t AS (SELECT *, greatest(1, n * 8 // 10) AS tr, greatest(1, n // 10) AS va FROM k), u AS (SELECT *, CASE WHEN n - tr - va < 1 AND va <= 1 THEN tr - 1 ELSE tr END AS tr2, CASE WHEN n - tr - va < 1 AND va > 1 THEN va - 1 ELSE va END AS va2 FROM t)
        SELECT doc_id, lang, CASE WHEN n = 1 OR (n = 2 AND k = 1) THEN 'train' WHEN n = 2 THEN 'test' WHEN k <= tr2 THEN 'train' WHEN k <= tr2 + va2 THEN 'val' ELSE 'test' END AS split FROM u""",
    "ood_split": f"WITH g AS (SELECT source FROM (SELECT DISTINCT source FROM documents) ORDER BY sha256(concat('42:', source)), source LIMIT (SELECT greatest(1, count(DISTINCT source) // 10) FROM documents)) SELECT doc_id, source, CASE WHEN source IN (SELECT source FROM g) THEN 'ood' ELSE {_SPLIT} END AS split FROM documents",
    "balance_ratio": f"SELECT doc_id, quality FROM labels QUALIFY quality = 0 OR row_number() OVER (PARTITION BY quality = 0 ORDER BY {_DRAW}, doc_id) <= 2 * (SELECT count(*) FROM labels WHERE quality = 0) OR NOT EXISTS (SELECT 1 FROM labels WHERE quality = 0)",
    "balance_oversample": f"WITH k AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {_DRAW}, doc_id) AS k, count(*) OVER (PARTITION BY quality) AS n FROM labels), t AS (SELECT *, max(n) OVER () AS top FROM k) SELECT doc_id, quality, CAST(unnest(range(1, top // n + CASE WHEN k <= top % n THEN 2 ELSE 1 END)) AS INT) AS copy FROM t",
    "capped_per_source": "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256(concat('cap:', doc_id)), doc_id) <= 5",
    "class_weights": f"WITH {_LAB}, i AS (SELECT lang, 1.0::DOUBLE / count(*) AS x FROM lab GROUP BY lang) SELECT lang, round(x / (SELECT avg(x) FROM i), 6) AS weight FROM i",
    "agreement_rate": "WITH g AS (SELECT doc_id % 300 AS g, count(*) AS n, count(DISTINCT quality) AS v FROM labels GROUP BY 1 HAVING count(*) >= 2) SELECT count(*) AS groups, round(100.0 * count(*) FILTER (WHERE v = 1) / greatest(count(*), 1), 4)::DOUBLE AS agreement FROM g",
    "token_vocab_top": f"WITH c AS (SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS token FROM documents) GROUP BY token HAVING count(*) >= 2) SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) + 1 AS INT) AS index FROM c ORDER BY n DESC, token LIMIT 1000",
    "code_features": r"""SELECT doc_id, CAST(length(text) AS INT) AS n_chars_, CAST(len(string_split(text, chr(10))) AS INT) AS n_lines, CAST(list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS INT) AS longest_line,
        CAST(length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS INT) AS n_digits, CAST(len(regexp_extract_all(text, '\b(?:if|for|while|and|or)\b')) AS INT) AS n_branches, contains(lower(text), 'select ') AS has_sql,
        regexp_matches(text, 'https?://') AS has_url, regexp_matches(text, '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b') AS has_ip, regexp_matches(lower(text), 'password|secret|token') AS has_secret_word FROM documents""",
    "line_rule_hits": r"""WITH li AS (SELECT CAST(doc_id AS VARCHAR) AS path, unnest(string_split(text, chr(10))) AS row, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
        r(rule_id, severity, category, p) AS (VALUES ('R1', 'high', 'secret', '(?i)(token|password|secret)\s*[=:]'), ('R2', 'low', 'contact', '[a-z0-9.]+@[a-z0-9]+\.[a-z]+'), ('R3', 'low', 'markup', '&&&|%%%'), ('R4', 'medium', 'licence', '(?i)licen[sc]ed? '))
        SELECT path, CAST(k AS INT) AS line, rule_id, severity, category FROM li, r WHERE NOT starts_with(ltrim(row), '//') AND NOT starts_with(ltrim(row), '*') AND regexp_matches(row, p)""",
    "redact_long_tokens": f"SELECT doc_id, md5({_REDACT}) AS digest FROM documents",
    "redact_counts": f"WITH r AS (SELECT source, len(regexp_extract_all({_REDACT}, '\\[REDACTED\\]')) AS n FROM documents) SELECT source, CAST(sum(n) AS BIGINT) AS n, count(*) FILTER (WHERE n > 0) AS docs FROM r GROUP BY source",
    "mask_values": f"SELECT c_custkey, {_MASK.format(c='c_name')} AS masked, {_MASK.format(c='left(c_name, 6)')} AS short FROM customer",
    "excerpt_context": f"""WITH li AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS row, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
        e AS (SELECT doc_id, string_agg(CASE WHEN k BETWEEN 2 AND 3 THEN '> ' ELSE '  ' END || row, chr(10) ORDER BY k) AS text FROM li WHERE k <= 5 GROUP BY doc_id) SELECT doc_id, md5(left({_REDACT}, 1200)) AS digest FROM e""",
    "chunk_800_100": "WITH c AS (SELECT doc_id AS document_id, text, unnest(range(0, CAST(greatest(0, ceil((length(text) - 800) / 700)) AS BIGINT) + 1)) AS k FROM documents WHERE length(text) > 0) SELECT document_id, CAST(k AS INT) AS chunk_index, concat(document_id, ':', k) AS chunk_id, md5(substring(text, k * 700 + 1, 800)) AS digest FROM c",
    "line_windows": "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents) SELECT doc_id, CAST(s AS INT) AS start, md5(array_to_string(x[s + 1:s + 4], chr(10))) AS digest FROM (SELECT doc_id, x, unnest(range(0, len(x), 2)) AS s FROM l)",
    "hash_embedding": f"WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents), c AS (SELECT doc_id, CAST(CAST(concat('0x', left(sha1(token), 8)) AS BIGINT) % 256 AS INT) AS bucket, count(*) AS n FROM t GROUP BY 1, 2) SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM c",
    "cosine_topk": f"WITH {_NEAREST} SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INT) AS place FROM n QUALIFY place <= 10",
    "lexical_topk": f"""WITH q AS (SELECT item_id AS query_id, token, count(*) AS times FROM (SELECT item_id, unnest({_TOKENS}) AS token FROM benchmark WHERE item_id % 20 = 0) GROUP BY 1, 2), t AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents) GROUP BY 1, 2)
        SELECT query_id, doc_id, round(sum(times * 2.2::DOUBLE * tf / (tf + 1.2::DOUBLE)), 6) AS score FROM t JOIN q USING (token) GROUP BY 1, 2""",
    "rerank_boost": f"""WITH {_NEAREST}, f AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) <= 30),
        b AS (SELECT f.*, label, round(score + (label % 3) * 0.1::DOUBLE + CASE WHEN label = 4 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN label = 7 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN label % 2 = 0 THEN 0.2::DOUBLE ELSE 0 END, 6) AS rerank FROM f JOIN v ON item_id = vec_id WHERE label % 2 = 0)
        SELECT query_id, item_id, rerank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, score DESC, item_id DESC) AS INT) AS place FROM b QUALIFY place <= 5""",
    "mean_cov": f"WITH {_VEC}, x AS (SELECT e[i + 1] AS a, e[j + 1] AS b, i, j FROM v, range(64) r(i), range(64) s(j)) SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(covar_samp(a, b) + CASE WHEN i = j THEN 0.001 ELSE 0 END, 5) + 0.0::DOUBLE AS cov FROM x GROUP BY i, j",
    "ood_reasons": f"""WITH {_VEC}, a AS (SELECT vec_id, list_transform(e, lambda x: abs(x)) AS w, round(sqrt(list_dot_product(e, e)), 6) AS d FROM v), p AS (SELECT vec_id, d, round(list_sum(list_transform(w, lambda x: -(x / list_sum(w)) * ln(x / list_sum(w) + 1e-8))), 6) AS h FROM a)
        SELECT vec_id, h AS entropy, CASE WHEN d > 0.45::DOUBLE * sqrt(8) THEN 'embedding_distance' WHEN h > 1.7::DOUBLE + ln(8) THEN 'entropy' END AS reason FROM p""",
    "auroc_rank": f"WITH {_LAB}, r AS (SELECT quality AS y, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS r FROM lab), t AS (SELECT sum(r) FILTER (WHERE y = 1) AS s, count(*) FILTER (WHERE y = 1)::DOUBLE AS a, count(*) FILTER (WHERE y = 0)::DOUBLE AS b FROM r) SELECT round((s - a * (a + 1) / 2) / (a * b), 6) AS auroc FROM t",
    "confusion_counts": f"WITH {_LAB}, c AS ({_CONF}) SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c",
    "per_class_prf": """WITH e AS (SELECT label, CASE WHEN vec_id % 4 = 0 THEN (label + 1) % 10 ELSE label END AS told FROM embeddings), c AS (SELECT DISTINCT label AS class FROM e UNION SELECT told FROM e),
        s AS (SELECT class, (SELECT count(*) FROM e WHERE label = class AND told = class) AS tp, (SELECT count(*) FROM e WHERE label = class) AS support, (SELECT count(*) FROM e WHERE told = class) AS t FROM c)
        SELECT class, round(coalesce(tp / nullif(t, 0), 0), 6) AS precision, round(coalesce(tp / nullif(support, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(t + support, 0), 0), 6) AS f1, support FROM s""",
    "anti_resume": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "upsert_first_wins": f"WITH o AS ({_ORD}) SELECT * FROM o WHERE id < 2000 UNION ALL SELECT * FROM (SELECT * FROM o WHERE id >= 2000 AND key NOT IN (SELECT key FROM o WHERE id < 2000) QUALIFY row_number() OVER (PARTITION BY key ORDER BY id) = 1)",
    "replace_by_key": f"WITH o AS ({_ORD}) SELECT * FROM o WHERE id < 2000 AND key NOT IN (SELECT key FROM o WHERE id >= 2000) UNION ALL SELECT * FROM (SELECT * FROM o WHERE id >= 2000 QUALIFY row_number() OVER (PARTITION BY key ORDER BY id DESC) = 1)",
    "overlay_config": "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE r_name END AS title FROM nation JOIN region ON n_regionkey = r_regionkey",
    "diff_line_numbers": f"""WITH {FINDINGS}, f AS (SELECT ordinal AS diff_id, start_line, rule_id, ordinal % 5 = 0 AS bad FROM findings)
        SELECT diff_id, 1::BIGINT AS hunk, k[1] AS kind, CASE WHEN k[1] <> '+' THEN CAST(start_line + CAST(k[2] AS INT) AS INT) END AS old_line, CASE WHEN k[1] <> '-' THEN CAST(start_line + CAST(k[3] AS INT) AS INT) END AS new_line, k[4] AS text
        FROM (SELECT diff_id, start_line, unnest([[' ', '0', '0', 'keep'], ['-', '1', '0', 'old ' || rule_id], ['+', '0', '1', 'new'], ['+', '0', '2', CASE WHEN bad THEN 'eval(x)' ELSE 'safe(x)' END], [' ', '2', '3', 'keep']]) AS k FROM f)""",
    "diff_policy": f"WITH {FINDINGS} SELECT ordinal AS diff_id, CASE WHEN ordinal % 5 = 0 THEN 'banned addition' END AS reason FROM findings",
    "rank_candidates": f"""WITH {FINDINGS} SELECT filepath AS finding_id, CAST(ordinal AS VARCHAR) AS candidate_id, CAST(ordinal % 4 + 1 AS INT) AS lines, CAST(row_number() OVER (PARTITION BY filepath ORDER BY confidence DESC, ordinal % 2, ordinal % 4 + 1, CAST(ordinal AS VARCHAR)) AS INT) AS place FROM findings WHERE ordinal % 3 > 0""",
    "patch_rates": """WITH p AS (SELECT l_orderkey AS job_id, count(*) AS total, count(*) FILTER (WHERE l_linestatus = 'F') AS validated FROM lineitem GROUP BY 1),
        o AS (SELECT l_orderkey AS job_id, l_returnflag = 'A' AS ok FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_partkey DESC) <= 2), r AS (SELECT job_id, count(*) FILTER (WHERE ok) / count(*) AS a FROM o GROUP BY 1)
        SELECT job_id, round_even(validated / total, 3) AS success_rate, round_even(a, 3) AS acceptance_rate FROM p JOIN r USING (job_id)""",
}
