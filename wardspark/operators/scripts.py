"""Functions and classes of script files, by tokens, bracket depths and what stands around a token; samples of code spans.

A text is cut into tokens by one expression (comments, strings, templates and patterns are one token each), so all else is
windows: running sums give line, column and bracket depth; at one depth the next token behind an opening bracket is the
closing one; the last opening bracket of the depth above is the bracket that a token lies in. Among the tokens that lie in
one bracket directly, the kinds of those before and behind it tell a declaration. Without a grammar this is close, not
exact: templates nest once, and a return type in braces is taken for the body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STRING = r'"(?:[^"\\\n]++|\\(?s:.))*+"' + r"|'(?:[^'\\\n]++|\\(?s:.))*+'"
_INNER = r"`(?:[^`\\]++|\\(?s:.))*+`"
TOKEN = "|".join([
    r"//[^\n]*+", r"/\*(?s:.*?)\*/", _STRING,
    r"`(?:[^`\\$]++|\\(?s:.)|\$(?!\{)|\$\{(?:[^`{}\"']++|" + _STRING + "|" + _INNER + r"|\{[^{}]*+\})*+\})*+`",
    r"(?<=[(,=:\[!&|?{};]\s{0,3}|return\s{1,3})/(?![/*])(?:[^/\\\[\n]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])++/[a-z]*+",
    r"[A-Za-z_$#][\w$]*+", r"\d[\w.]*+", r"\s++", "=>", r"[!<>+\-*%&|^?/~]++=*+|={2,}+", "(?s:.)",
])
#: Kinds of tokens by what they are: control words, parts of declarations, literals.
WORDS = {
    "f": ["function"], "c": ["class"], "a": ["async"], "A": ["abstract"], "v": ["const", "let", "var"], "x": ["export", "default"],
    "m": ["static", "get", "set", "public", "private", "protected", "readonly", "override"],
    "K": ["if", "for", "while", "switch", "catch", "with", "return", "new", "typeof", "throw", "await", "do", "else", "case", "yield", "delete", "void", "in", "of", "extends", "implements"],
}
MOST_LINES = 400
SPAN = ["path", "kind", "name", "start_line", "start_col", "end_line", "end_col"]


def _kind(t: Column) -> Column:
    out = F.when(t.isin(*"(){}[];,.:=*@"), t).when(t == "=>", ">")
    for k, words in WORDS.items():
        out = out.when(t.isin(words), k)
    return out.when(t.rlike("^[A-Za-z_$#]"), "i").when(t.rlike("^[0-9\"'`]"), "s").when(t.rlike("^/.*/[a-z]*$"), "s").otherwise("o")


def tokens(files: DataFrame) -> DataFrame:
    """files: path, text. The tokens but white space and comments: path, k, token, kind, line, col, end_line, end_col (lines
    from 1, columns from 0), level (how many brackets it lies in; a bracket lies where its opening one does), and inner,
    the k of the bracket that it lies in (-1: none) with its kind."""
    d = files.where("text IS NOT NULL").select("path", F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN), 0)).alias("k", "token"))
    before = Window.partitionBy("path").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    size, tail = F.char_length("token"), F.char_length(F.substring_index("token", "\n", -1))
    feeds = size - F.char_length(F.replace("token", F.lit("\n"), F.lit("")))
    opens, closes = F.col("token").isin("(", "[", "{"), F.col("token").isin(")", "]", "}")
    run = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    d = d.withColumns({"at": run(size), "line": (1 + run(feeds)).cast("int"), "depth": run(opens.cast("int") - closes.cast("int"))})
    begun = F.coalesce(F.max(F.when(feeds > 0, F.col("at") + size - tail)).over(before), F.lit(0))
    d = d.withColumns({"col": (F.col("at") - begun).cast("int"), "feeds": feeds, "level": F.col("depth") - closes.cast("int")})
    d = d.where(~F.col("token").rlike(r"^(\s|//|/\*)")).select(
        "path", "k", "token", _kind(F.col("token")).alias("kind"), "line", "col", (F.col("line") + F.col("feeds")).cast("int").alias("end_line"), F.when(F.col("feeds") > 0, tail).otherwise(F.col("col") + size).cast("int").alias("end_col"), "level"
    )
    # an opening bracket stands a second time among what lies in it, as a mark
    each = F.struct("level", F.lit(False).alias("mark")), F.struct((F.col("level") + 1).alias("level"), F.lit(True).alias("mark"))
    d = d.withColumn("at", F.explode(F.when(F.col("kind").isin("(", "[", "{"), F.array(*each)).otherwise(F.array(each[0])))).withColumns({"level": F.col("at.level"), "mark": F.col("at.mark")}).drop("at")
    within = F.last(F.when(F.col("mark"), F.struct("k", "kind")), ignorenulls=True).over(Window.partitionBy("path", "level").orderBy("k", "mark"))
    d = d.withColumn("inner", within).where("NOT mark").drop("mark")
    return d.select("path", "k", "token", "kind", "line", "col", "end_line", "end_col", "level", F.coalesce("inner.k", F.lit(-1)).alias("inner"), F.col("inner.kind").alias("inner_kind"))


def spans(files: DataFrame) -> DataFrame:
    """files: path, text. Declared functions (no generators), classes (no abstract ones), methods, and arrow functions that
    a name is bound to: path, kind, name and their span; that of an arrow function begins with its parameters."""
    d = tokens(files)
    part = Window.partitionBy("path", "inner")
    on, off = part.orderBy("k"), part.orderBy(F.desc("k"))
    place, end = F.struct("line", "col"), F.struct(F.col("end_line").alias("line"), F.col("end_col").alias("col"))
    fresh = F.col("line") > F.lag("end_line").over(on)
    text = F.concat(F.when(fresh, "/").otherwise(""), F.col("kind"))  # a stroke where a line begins
    nearby = lambda a, b: F.array_join(F.collect_list(text).over(on.rowsBetween(a, b)), "")
    d = d.withColumns({
        "text": text, "before": nearby(-14, -1), "behind": nearby(1, 20), "prev": F.lag("kind").over(on), "prev_place": F.lag(place).over(on), "prev_end": F.lag(end).over(on),
        "next": F.lead("kind").over(on), "next_token": F.lead("token").over(on), "fresh": F.coalesce(fresh, F.lit(True)), "close": F.lead(F.struct("kind", end.alias("end"))).over(on),
    })
    prev_modifier = F.col("prev").isin("m", "a", "*", "@")
    modifier = F.col("kind").isin("m", "a", "*")
    past = on.rowsBetween(Window.unboundedPreceding, -1)
    ahead = off.rowsBetween(Window.unboundedPreceding, -1)
    goes_on = F.col("kind").isin("o", ".", ":", "=", ">", "(", "[", ",", ")", "]", "}") | F.col("prev").isin("o", ".", ":", "=", ">", ",", "K")
    d = d.withColumns({
        "chain": F.last(F.when(modifier & ~F.coalesce(prev_modifier, F.lit(False)), place), ignorenulls=True).over(past),
        "after_sign": F.last(F.when(F.col("prev") == "=", place), ignorenulls=True).over(on.rowsBetween(Window.unboundedPreceding, 0)),
        "bound": F.last(F.when((F.col("kind") == "i") & F.col("behind").rlike("^/?(:[^=;]*)?=") & (F.col("fresh") | F.col("before").rlike("[;{}xv,]$")), F.col("token")), ignorenulls=True).over(past),
        "stop": F.last(F.when(F.col("kind").isin("{", ";", "f", "c"), F.struct("kind", "close")), ignorenulls=True).over(ahead),
        "stmt_end": F.last(F.when(F.col("kind").isin(";", ",") | (F.col("fresh") & ~goes_on), F.col("prev_end")), ignorenulls=True).over(ahead),
        "last_end": F.last(end).over(part.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "is_body": (F.col("kind") == "{") & F.col("before").rlike("c[^;{}]*$"),
    })
    body = (F.col("stop.kind") == "{") & (F.col("stop.close.kind") == "}")
    statement = F.col("before").rlike("(^|[;}x])/?a?$|/a$") | (F.col("fresh") & F.col("prev").isin("i", "s", ")", "]", "}"))
    declared = statement & F.col("behind").rlike("^/?i") & body & F.coalesce(F.col("inner_kind") == "{", F.lit(True))
    method = F.col("behind").rlike(r"^(/?o[^(){};]*)?/?\(/?\)(/?:[^;{}=>]*)?/?\{") & body & (F.col("inner_kind") == "{") & ~F.col("before").rlike(r"[fK.][*]?$") & ~F.coalesce(F.col("prev").isin("K", "f", ".", "=", ":", "o"), F.lit(False))
    arrow = F.col("before").rlike(r"((^|[;{}xv,])/?|/)i(/?:[^=;]*)?/?=/?a?/?(i|\(/?\)(/?:[^=;]*)?)$") & F.coalesce(F.col("inner_kind") == "{", F.lit(True))
    kind = F.when(F.col("kind") == "f", F.when(declared, "function")).when(F.col("kind") == "c", F.when(declared & ~F.coalesce(F.col("prev") == "A", F.lit(False)), "class")).when(F.col("kind") == ">", F.when(arrow, "arrow")).when((F.col("kind") == "i") & method, "method")
    found = d.withColumn("found", kind)
    start = F.when(F.col("found") == "arrow", F.col("after_sign")).when((F.col("found") == "method") & prev_modifier, F.coalesce("chain", place)).when((F.col("found") == "function") & (F.col("prev") == "a"), F.col("prev_place")).otherwise(place)
    expression = F.coalesce("stmt_end", "last_end")
    # an arrow's own tokens behind it end its expression; a body in braces ends with them
    finish = F.when((F.col("found") == "arrow") & (F.col("next") != "{"), expression).otherwise(F.col("stop.close.end"))
    name = F.when(F.col("found") == "arrow", F.col("bound")).when(F.col("found") == "method", F.col("token")).otherwise(F.col("next_token"))
    bodies = found.where("is_body").select("path", F.col("k").alias("inner"), F.lit(True).alias("field"))
    rows = found.where("found IS NOT NULL").join(bodies, ["path", "inner"], "left").where("found <> 'arrow' OR field IS NULL")
    rows = rows.select("path", F.col("found").alias("kind"), name.alias("name"), start.alias("s"), finish.alias("e"))
    return rows.select("path", "kind", "name", F.col("s.line").alias("start_line"), F.col("s.col").alias("start_col"), F.col("e.line").alias("end_line"), F.col("e.col").alias("end_col"))


def code_samples(files: DataFrame, found: DataFrame, language: str, context: int = 10, most: int = MOST_LINES) -> DataFrame:
    """files: repo, commit, path, text; found: path and spans, with more columns or without. A sample for each span of at
    most so many lines: sample_id, language, repo, commit, filepath, snippet, the lines before and behind it, n_lines of
    the file, and found's columns. Spans go to the file's row, so a text is not multiplied by its spans."""
    spans_ = found.where(F.col("end_line") - F.col("start_line") < most).groupBy("path").agg(F.collect_list(F.struct(*[c for c in found.columns if c != "path"])).alias("found"))
    lines = F.split(F.regexp_replace("text", r"\r\n?|[\x0b\x0c\x1c-\x1e\x85  ]", "\n"), "\n")
    d = files.join(spans_, "path").withColumn("lines", F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines))
    cut = lambda a, b: F.array_join(F.slice("lines", F.greatest(a, F.lit(1)), F.greatest(b - F.greatest(a, F.lit(1)) + 1, F.lit(0))), "\n")
    one = lambda s: F.struct(
        s.alias("s"), cut(s["start_line"], s["end_line"]).alias("snippet"), cut(s["start_line"] - context, s["start_line"] - 1).alias("context_before"), cut(s["end_line"] + 1, s["end_line"] + context).alias("context_after")
    )
    d = d.select("repo", "commit", F.col("path").alias("filepath"), F.size("lines").alias("n_lines"), F.explode(F.transform("found", one)).alias("x"))
    raw = F.concat_ws("|", F.lit(language), "repo", "commit", "filepath", "x.s.start_line", "x.s.end_line")
    return d.select(F.sha2(raw, 256).alias("sample_id"), F.lit(language).alias("language"), "repo", "commit", "filepath", F.col("x.snippet").alias("code_snippet"), "x.context_before", "x.context_after", "n_lines", "x.s.*")


# fixed values: what a graph of a script holds, in this order
NODES = [
    (r"\bfunction\s+(\w+)", "FunctionDef"), (r"\bclass\s+(\w+)", "ClassDef"), (r"\bconst\s+(\w+)\s*=", "ConstDef"), (r"\blet\s+(\w+)\s*=", "VarDef"), (r"\bvar\s+(\w+)\s*=", "VarDef"), (r"(\w+)\s*\(", "Call"),
]


def script_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files: path, text. Nodes (path, node, type, name, line) of a script by simple patterns, kind after kind, each kind in
    text order, and edges (path, src, dst) from each to the next. The lines are running sums over the pieces between."""
    parts = []
    for n, (pattern, kind) in enumerate(NODES):
        whole, between = F.regexp_extract_all("text", F.lit(pattern), 0), F.split("text", pattern)
        zipped = F.arrays_zip(whole.alias("hit"), F.regexp_extract_all("text", F.lit(pattern), 1).alias("name"), F.slice(between, 1, F.size(whole)).alias("gap"))
        parts.append(files.where("text IS NOT NULL").select("path", F.lit(n).alias("n"), F.lit(kind).alias("type"), F.posexplode(zipped).alias("k", "z")))
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    feeds = lambda c: F.char_length(c) - F.char_length(F.replace(c, F.lit("\n"), F.lit("")))
    w = Window.partitionBy("path", "n").orderBy("k")
    d = d.withColumn("line", 1 + F.sum(feeds(F.col("z.gap"))).over(w) + F.coalesce(F.sum(feeds(F.col("z.hit"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nodes = d.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("n", "k")) - 1).alias("node"), "type", F.col("z.name").alias("name"), F.col("line").cast("int").alias("line"))
    return nodes, nodes.where("node > 0").select("path", (F.col("node") - 1).alias("src"), F.col("node").alias("dst"))
