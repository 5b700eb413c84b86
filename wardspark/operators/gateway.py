"""The tool gateway: decisions, masked events, summaries, rates."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardspark.functions.size import small
from wardspark.functions.text import SECRET_KEY, SECRET_VALUES, blocked_output, mask_value
from wardspark.operators.replays import Limiter, replayed

# fixed values: the tools' policies: name, scopes, approval, properties, required ones, others allowed, mode of redaction,
# kinds of secret that count (empty: all)
POLICIES = [
    ("github.create_or_update_comment", ["write"], True, {"repo": "string", "pr_number": "number", "body": "string", "token": "string"}, ["repo", "pr_number", "body"], True, "mask", ["github_token", "generic_bearer"]),
    ("validator.run", ["read", "write"], False, {"repo": "string", "commit": "string", "patch": "string"}, ["repo", "commit", "patch"], True, "mask", []),
    ("fs.read", ["read"], False, {"path": "string"}, ["path"], False, "mask", []),
    ("fs.write", ["write"], True, {"path": "string", "content": "string"}, ["path", "content"], False, "deny", []),
]
POLICY = "tool string, scopes array<string>, requires_approval boolean, properties map<string,string>, required array<string>, additional boolean, mode string, kinds array<string>"


def policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLICIES, POLICY)


def _is(kind: Column, value: Column) -> Column:
    """Whether a JSON value (as get_json_object shows it, type from its schema) has the type asked for."""
    found = F.when(value.rlike('^".*"$'), "string").when(value.rlike("^-?[0-9.eE+-]+$"), "number").when(value.isin("true", "false"), "boolean").when(value.startswith("{"), "object").when(value.startswith("["), "array").otherwise("null")
    return found == kind


def decide(requests: DataFrame, policy: DataFrame) -> DataFrame:
    """requests: request_id, tool, scope, args (a JSON object), asks_approval, approved. decision and reason, the first rule that
    speaks: known tool, scope, arguments, secrets where they are denied, approval; else mask or allow."""
    raw = F.from_json("args", "map<string,variant>")
    p = policy.withColumn("known", F.lit(True))
    d = requests.join(small(p), "tool", "left").withColumn("given", F.coalesce(F.transform_values(raw, lambda k, v: F.to_json(v)), F.create_map().cast("map<string,string>")))
    names = F.map_keys("given")
    missing = F.array_except("required", names)
    extra = F.array_except(names, F.map_keys("properties"))
    wrong = F.filter(F.array_intersect(F.map_keys("properties"), names), lambda k: ~_is(F.element_at("properties", k), F.element_at("given", k)))
    kinds = lambda v: [F.when(v.rlike(x), k) for k, x in SECRET_VALUES]
    secrets = F.transform(F.map_entries("given"), lambda e: F.coalesce(*kinds(e["value"]), F.when(e["key"].rlike(SECRET_KEY), "key_match")))
    secrets = F.filter(secrets, lambda s: s.isNotNull() & ((F.size("kinds") == 0) | F.array_contains("kinds", s)))
    d = d.withColumn("secrets", secrets)
    wants = F.col("requires_approval") | F.coalesce("asks_approval", F.lit(False))
    schema = F.lit("args schema violation: ")
    reason = (
        F.when(F.col("known").isNull(), "tool not in allowlist")
        .when(~F.array_contains("scopes", F.coalesce("scope", F.lit(""))), "scope not allowed")
        .when(F.size(missing) > 0, F.concat(schema, F.lit("missing "), missing[0]))
        .when(~F.col("additional") & (F.size(extra) > 0), F.concat(schema, F.lit("unexpected property "), extra[0]))
        .when(F.size(wrong) > 0, F.concat(schema, wrong[0], F.lit(" type mismatch")))
        .when((F.col("mode") == "deny") & (F.size("secrets") > 0), F.concat(F.lit("secret detected: "), F.col("secrets")[0]))
        .when(wants & ~F.coalesce("approved", F.lit(False)), "approval required")
        .otherwise("allowed")
    )
    decision = F.when(reason == "approval required", "require_approval").when(reason != "allowed", "deny").when(F.size("secrets") > 0, "mask").otherwise("allow")
    return d.select("request_id", "tool", decision.alias("decision"), reason.alias("reason"))


def safe_output(outputs: DataFrame, allow_code: bool, patterns: list[str], origin: str) -> DataFrame:
    """outputs: output_id, text. What may be shown and its marks."""
    text = F.col("text")
    for _, x in SECRET_VALUES:
        text = F.regexp_replace(text, x, "***REDACTED***")
    blocked = F.lit(not allow_code) & blocked_output(F.col("text"), patterns)
    return outputs.select("output_id", text.alias("text"), F.col("text").contains("```").alias("contains_code"), blocked.alias("blocked"), (F.lit(origin == "tool") & ~blocked).alias("trusted"), F.lit(origin == "llm").alias("untrusted"))


def masked_args(args: Column) -> Column:
    """A flat JSON object with secrets masked, by key or by value."""
    given = F.from_json(args, "map<string,string>")
    secret = lambda k, v: k.rlike(SECRET_KEY) | v.rlike("|".join(x for _, x in SECRET_VALUES))
    return F.to_json(F.transform_values(given, lambda k, v: F.when(secret(k, v), mask_value(v)).otherwise(v)))


def canonical_json(args: pd.Series) -> pd.Series:
    """With sorted keys at every depth; deep objects need Python."""
    return args.map(lambda a: None if a is None else json.dumps(json.loads(a), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def args_hash(args: Column) -> Column:
    return F.sha2(F.pandas_udf(canonical_json, "string")(args), 256)


def newest(events: DataFrame, most: int) -> DataFrame:
    """Newest first; rows without a time last; ties by id."""
    return events.orderBy(F.desc_nulls_last("ts"), "event_id").limit(most)


def within(events: DataFrame, since: str | None, until: str | None) -> DataFrame:
    """Fails open: a row without a time passes, and so does everything where a bound can't be read."""
    ok = F.lit(True)
    if since is not None:
        ok = ok & F.coalesce(F.col("ts") >= F.lit(since).try_cast("timestamp_ntz"), F.lit(True))
    if until is not None:
        ok = ok & F.coalesce(F.col("ts") <= F.lit(until).try_cast("timestamp_ntz"), F.lit(True))
    return events.where(ok)


def summary(events: DataFrame, most: int = 500) -> DataFrame:
    """Totals over the newest events: all, and those denied or waiting."""
    return newest(events, most).agg(F.count("*").alias("total"), F.count_if(F.col("decision").isin("deny", "require_approval")).alias("blocked"))


def top_values(events: DataFrame, column: str, most: int = 500, k: int = 5) -> DataFrame:
    """The most common values among the newest events; of equal ones the one seen first."""
    n = newest(events, most).withColumn("_o", F.struct(F.col("ts").isNull(), -F.unix_micros(F.col("ts").cast("timestamp")), "event_id"))
    g = n.groupBy(column).agg(F.count("*").alias("n"), F.min("_o").alias("_first"))
    return g.orderBy(F.desc("n"), "_first").limit(k).select(column, "n")


def rate_limit(requests: DataFrame, most: int, seconds: int = 60) -> DataFrame:
    """requests: client, event_id, ts. A request passes if fewer than ``most`` of its client passed in the last seconds;
    what is turned away doesn't count, and requests without a time take no part. The log of a client is bounded by
    ``most``, and nothing else of it is kept."""
    d = requests.select(F.col("client").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), F.col("event_id").alias("seq"))
    return replayed(d, Limiter(most, seconds)).select(F.col("key").alias("client"), F.col("seq").alias("event_id"), "accepted")


def sliding_counts(requests: DataFrame, seconds: int = 60) -> DataFrame:
    """How many requests a client sent in the seconds up to each."""
    w = Window.partitionBy("client").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return requests.select("client", "event_id", F.count("*").over(w).alias("recent"))
