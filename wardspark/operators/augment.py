"""Variants of code samples, the same for the same sample wherever it is made."""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that are never renamed.
KEPT = {"self", "cls", "return", "import", "from", "def", "class", "for", "while", "if", "else", "elif", "in", "is", "not", "and", "or", "None", "True", "False", "const", "let", "var", "function", "new", "this", "null", "true", "false", "print", "await", "async", "try", "except", "finally", "with", "as", "lambda", "yield"}


def without_comments(code: Column) -> Column:
    return F.regexp_replace(code, "(?m)[ \\t]*(?:#|//)[^\\n]*$", "")


def even_space(code: Column) -> Column:
    """No blanks at line ends, no more than one empty line in a row."""
    return F.trim(F.regexp_replace(F.regexp_replace(code, "(?m)[ \\t]+$", ""), "\\n{3,}", "\n\n"))


def renamed(code: str, seed: int, most: int = 5) -> str:
    """The most frequent identifiers (twice or more) get other names, drawn by the seed."""
    counts = Counter(w for w in re.findall(r"\b[A-Za-z_]\w+\b", code) if w not in KEPT)
    names = sorted((w for w, n in counts.items() if n >= 2), key=lambda w: (-counts[w], w))[:most]
    r = random.Random(seed)
    for w in names:
        code = re.sub(rf"\b{re.escape(w)}\b", f"{w[0]}_{r.randrange(1000)}", code)
    return code


def augment(samples: DataFrame, variants: int, seed: str = "42") -> DataFrame:
    """samples: sample_id, code. sample_id, variant, code: variant 0 without comments, 1 with even space, from 2 on with
    other names; those that changed nothing are left out. All variants keep the sample's id, so a split by it keeps
    them together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = []
            for i, v, c in zip(b.sample_id, b.variant, b.code, strict=True):
                made.append(renamed(c, int(sha256(f"{seed}:{i}:{v}".encode()).hexdigest()[:8], 16)))
            yield pd.DataFrame({"sample_id": b.sample_id, "variant": b.variant, "code": made})

    d = samples.where("code IS NOT NULL").select("sample_id", "code", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))).alias("variant"))
    made = F.when(F.col("variant") == 0, without_comments(F.col("code"))).otherwise(even_space(F.col("code")))
    plain = d.where("variant < 2").withColumn("made", made).where("made <> code").select("sample_id", "variant", F.col("made").alias("code"))
    new = d.where("variant >= 2").select(F.col("sample_id").cast("string"), "variant", "code")
    names = new.mapInPandas(run, "sample_id string, variant int, code string").join(samples.select(F.col("sample_id").cast("string"), F.col("code").alias("_was")), "sample_id").where("code <> _was").drop("_was")
    return plain.withColumn("sample_id", F.col("sample_id").cast("string")).unionByName(names)


# fixed values: names that a variant gives numbers instead
RENAMED = r"\b(?:user_input|user_data|user_id|data|payload|content)\b"


def three_variants(samples: DataFrame) -> DataFrame:
    """samples: code_snippet, filepath and more. The variants of each that differ from it: names of inputs numbered place by
    place, comments gone, white space even; with augmentation and an id of their own in place of sample_id."""
    code = F.col("code_snippet")
    parts = F.split(code, RENAMED)
    renamed = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("var_"), i.cast("string"), p))), "")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(code, "(?md)#.*$", ""), "(?md)//.*$", ""), r"(?s)/\*.*?\*/", "")
    lines = F.transform(F.split(code, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)[\s\x1c-\x1f]+\z", ""), "  +", " "))
    even = F.array_join(F.filter(lines, lambda x: x != ""), "\n")
    made = F.array(*[F.struct(F.lit(n).alias("augmentation"), c.alias("code")) for n, c in (("var_rename", renamed), ("no_comments", bare), ("whitespace_norm", even))])
    rest = [c for c in samples.columns if c not in ("sample_id", "code_snippet", "augmentation")]
    d = samples.where(code.isNotNull()).select(*rest, F.explode(F.filter(made, lambda x: x["code"] != code)).alias("x"))
    own = F.sha2(F.concat(F.coalesce("filepath", F.lit("")), F.lit(":"), F.col("x.code")), 256)
    return d.select(*rest, own.alias("sample_id"), F.col("x.code").alias("code_snippet"), F.col("x.augmentation").alias("augmentation"))
