"""Chunks of text: lines, overlap, complexity, pattern audits and BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names of the body audit's patterns, and calls that it looks for.
BODY_PATTERNS = ("unwrap", "expect", "panic_macros", "unwrap_unchecked", "transmute", "await_in_guard_scope", "self_recursion", "unbounded_loop")
CALLS = {
    "unwrap": r"\.\s*unwrap\s*\(", "expect": r"\.\s*expect\s*\(", "panic_macros": r"\b(?:panic|unreachable|todo|unimplemented)!",
    "unwrap_unchecked": r"\.\s*(?:unwrap_unchecked|unwrap_err_unchecked)\s*\(", "transmute": r"\btransmute(?:::<[^()]*>)?\s*\(",
}
# What tells that a binding holds a lock.
GUARDS = ("MutexGuard", "RwLockReadGuard", "RwLockWriteGuard", "Guard", "Ref<", "RefMut<", ".lock()", ".read()", ".write()")
BLOCK = r"\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}"  # braces to a depth of three
LOOP, EXIT = rf"\bloop\s*({BLOCK})", r"\b(?:break|return)\b|\?"
GUARDED = r"(?s)\blet\b[^;]*(?:" + "|".join(g.replace(".", r"\.").replace("(", r"\(").replace(")", r"\)") for g in GUARDS) + r")[^;]*;(.*)$"
# What the cyclomatic estimate counts, as plain substrings.
BRANCHES = ("if", "else if", "while", "for", "match", "&&", "||")
K1, B = 1.2, 0.75


def line_offsets(docs: DataFrame) -> DataFrame:
    """(doc_id, line, start, bytes): byte offset of every line, from 0.

    Offsets follow from where the line breaks are among the text's bytes, so
    nothing is shuffled.
    """
    size = F.transform(F.split("text", "\n"), lambda x: F.octet_length(x).cast("long"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("starts"))
    starts = F.aggregate("size", zero, lambda s, n: F.struct((s["at"] + n + 1).alias("at"), F.array_append(s["starts"], s["at"]).alias("starts")))["starts"]
    rows = docs.select("doc_id", size.alias("size")).select("doc_id", F.posexplode(F.arrays_zip(starts.alias("start"), F.col("size").alias("bytes"))).alias("pos", "l"))
    return rows.select("doc_id", (F.col("pos") + 1).cast("long").alias("line"), "l.start", "l.bytes")


def line_of_byte(text: Column, offset: Column) -> Column:
    """1-based line that holds a byte offset."""
    head = F.decode(F.substring(F.encode(text, "utf-8"), F.lit(1), offset.cast("int")), "iso-8859-1")
    return F.size(F.split(head, "\n")).cast("long")


def snippet(text: Column, first_line: Column, lines: int = 5, max_chars: int = 400) -> Column:
    """At most five lines, cut to 400 characters, from a 1-based line."""
    return F.substring(F.array_join(F.slice(F.split(text, "\n"), first_line, F.lit(lines)), "\n"), 1, max_chars)


def _count(line: Column, needle: str) -> Column:
    return ((F.length(line) - F.length(F.replace(line, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def complexity(docs: DataFrame) -> DataFrame:
    """Line and keyword counts per document; keywords count as substrings, so
    ``else if`` counts twice and ``format`` as ``for``."""
    lines = F.split("text", "\n")
    trimmed = F.transform(lines, lambda x: F.trim(x))
    words = {n: _count(F.col("text"), f"{n} ") for n in ("fn", "struct", "trait")}
    branches = sum((_count(F.col("text"), b) for b in BRANCHES[1:]), _count(F.col("text"), BRANCHES[0]))
    rows = docs.select(
        "doc_id",
        F.size(lines).cast("long").alias("lines"),
        F.size(F.filter(trimmed, lambda x: x != "")).cast("long").alias("non_empty"),
        F.size(F.filter(trimmed, lambda x: x.startswith("//"))).cast("long").alias("comments"),
        *[c.alias(f"n_{n}") for n, c in words.items()],
        branches.alias("cyclomatic"),
    )
    return rows.withColumn("per_function", F.round(F.when(F.col("n_fn") == 0, F.lit(0.0)).otherwise(F.col("cyclomatic") / F.col("n_fn")), 6))


def _known_patterns(patterns: list[str] | None) -> list[str]:
    names = patterns or list(BODY_PATTERNS)
    if unknown := set(names) - set(BODY_PATTERNS):
        raise ValueError(f"unknown patterns: {sorted(unknown)}; there are {', '.join(BODY_PATTERNS)}")
    return names


def _own_calls(text: Column) -> Column:
    """A pattern for calls of the function that the text defines first."""
    return F.concat(F.lit(r"\b"), F.regexp_extract(text, r"\bfn\s+(\w+)", 1), F.lit(r"\s*\("))


def body_audit(docs: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """(doc_id, pattern, hits) for every pattern that the text of a function has.

    Lexical: loops count unless they have a break, return or ``?`` in them, an
    await if a binding of the text before it holds a lock, and calls of the
    function's own name beyond its definition.
    """
    t, hits = F.col("text"), {}
    for n in _known_patterns(patterns):
        if n == "unbounded_loop":
            hits[n] = F.size(F.filter(F.regexp_extract_all(t, F.lit(LOOP), F.lit(1)), lambda b: ~b.rlike(EXIT)))
        elif n == "await_in_guard_scope":
            hits[n] = F.regexp_count(F.regexp_extract(t, GUARDED, 1), F.lit(r"\.await\b"))
        elif n == "self_recursion":
            hits[n] = F.when(t.rlike(r"\bfn\s+\w+"), F.regexp_count(t, _own_calls(t)) - 1).otherwise(0)
        else:
            hits[n] = F.regexp_count(t, F.lit(CALLS[n]))
    counts = F.array(*[F.struct(F.lit(n).alias("pattern"), c.cast("long").alias("hits")) for n, c in hits.items()])
    return docs.select("doc_id", F.explode(counts).alias("p")).select("doc_id", "p.*").where("hits > 0")


def body_context(docs: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """(doc_id, line, pattern, context): lines with a call that the audit looks
    for, with the lines before and after."""
    names = [n for n in _known_patterns(patterns) if n in CALLS]
    lines = docs.select("doc_id", F.split("text", "\n").alias("ls"))
    rows = lines.select("doc_id", "ls", F.posexplode("ls").alias("pos", "content"))
    found = F.array_compact(F.array(*[F.when(F.col("content").rlike(CALLS[n]), F.lit(n)) for n in names]))
    near = F.slice("ls", F.greatest(F.col("pos"), F.lit(1)), F.least(F.col("pos") + 2, F.lit(3)))
    return rows.select("doc_id", (F.col("pos") + 1).cast("long").alias("line"), F.explode(found).alias("pattern"), F.array_join(near, "\n").alias("context"))


def unsafe_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, line, lines, has_safety): blocks that start with ``unsafe {``, how many
    lines they have, and whether one of the five lines before has SAFETY."""
    lines = docs.select("doc_id", F.split("text", "\n").alias("ls"))
    rows = lines.select("doc_id", "ls", F.posexplode("ls").alias("pos", "content")).where(F.col("content").rlike(r"\bunsafe\s*\{"))
    near = F.slice("ls", F.greatest(F.col("pos") - 4, F.lit(1)), F.least(F.col("pos") + 1, F.lit(6)))
    rest = F.array_join(F.slice("ls", F.col("pos") + 1, F.size("ls")), "\n")
    size = F.size(F.split(F.regexp_extract(rest, rf"\bunsafe\s*({BLOCK})", 1), "\n")).cast("long")
    return rows.select("doc_id", (F.col("pos") + 1).cast("long").alias("line"), size.alias("lines"), F.exists(near, lambda x: x.contains("SAFETY")).alias("has_safety"))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, up to 40 bytes long."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: (t != "") & (F.octet_length(t) <= 40))


def postings(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """(id, token, tf): the inverted index."""
    return chunks.select(F.col(id_col).alias("id"), F.explode(tokens(F.col(text_col))).alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"))


def bm25(chunks: DataFrame, queries: DataFrame, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """(query_id, id, score) of every chunk that shares a token with a query.

    queries: query_id, query. Tokens of queries filter the index by a semi join
    before anything is counted by chunk; lengths come from the token arrays.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("token"))
    sized = chunks.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("ts"))
    totals = sized.agg(F.count("*").alias("n"), F.avg(F.size("ts")).alias("avg_len"))
    hits = sized.select("id", F.size("ts").alias("len"), F.explode("ts").alias("token")).join(asked.select("token").distinct(), "token", "left_semi")
    tf = hits.groupBy("id", "token", "len").agg(F.count("*").alias("tf"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    rows = tf.join(df, "token").crossJoin(F.broadcast(totals)).select("id", "token", part.alias("part"))  # one row
    return rows.join(asked, "token").groupBy("query_id", "id").agg(F.round(F.sum("part"), 6).alias("score"))


def bm25_fields(chunks: DataFrame, queries: DataFrame, fields: list[str], id_col: str = "chunk_id") -> DataFrame:
    """(query_id, id, score): BM25 of each field by itself, added up."""
    scores = [bm25(chunks.select(F.col(id_col).alias("id"), F.coalesce(f, F.lit("")).alias("text")), queries, "id", "text") for f in fields]
    rows = scores[0]
    for s in scores[1:]:
        rows = rows.unionByName(s)
    return rows.groupBy("query_id", "id").agg(F.round(F.sum("score"), 6).alias("score"))


def top_k(scores: DataFrame, k: int, group: str = "query_id", key: str = "id") -> DataFrame:
    """The k best rows of each query, with rank, ties by id."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), key))
    return scores.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)
