"""Chunks: overlap with neighbours, splitting, text for embedding."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.identity import chunk_id, module_path

CONTAINERS = ("impl", "module", "trait")
SHOWN = 5  # imports and calls that a chunk's text lists


def lines_of(text: Column) -> Column:
    """Lines; an end of line at the end starts no further one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, "\n$", ""), "\n"))


def overlap(chunks: DataFrame, group: str, order: str, text: str, share: float = 0.2) -> DataFrame:
    """Adds overlap_prev, the first lines of the chunk before, and overlap_next,
    the last lines of the chunk itself where another follows.

    Both are ``ceil(lines * share)`` lines, share within 0 and 0.5.
    """
    share = min(max(share, 0.0), 0.5)
    w = Window.partitionBy(group).orderBy(order)
    count = lambda t: F.ceil(F.size(lines_of(t)) * F.lit(share)).cast("int")
    prev = F.lag(text).over(w)
    own, follows = F.col(text), F.lead(F.lit(1)).over(w).isNotNull()
    head = F.when(count(prev) > 0, F.array_join(F.slice(lines_of(prev), 1, count(prev)), "\n"))
    tail = F.when(follows & (count(own) > 0), F.array_join(F.slice(lines_of(own), -count(own), count(own)), "\n"))
    return chunks.withColumns({"overlap_prev": head, "overlap_next": tail})


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.octet_length(text) / 4)).cast("long")


def embedding_text(c: dict[str, Column]) -> Column:
    """Text of a chunk with its context in front. Keys are the columns of chunks:
    file_path, line_start, line_end, module_path, symbol_name, symbol_kind,
    parent_symbol_name, split_part, split_total, docstring, imports,
    outgoing_calls, content."""
    listed = lambda label, a: F.when(F.size(a) > 0, F.concat(F.lit(f"// {label}: "), F.array_join(F.slice(a, 1, SHOWN), ", ")))
    head = F.concat_ws(
        "\n",
        F.concat(F.lit("// File: "), c["file_path"]),
        F.concat(F.lit("// Location: lines "), c["line_start"], F.lit("-"), c["line_end"]),
        F.when(F.size(c["module_path"]) > 0, F.concat(F.lit("// Module: "), F.array_join(c["module_path"], "::"))),
        F.concat(F.lit("// Symbol: "), c["symbol_name"], F.lit(" ("), c["symbol_kind"], F.lit(")")),
        F.concat(F.lit("// Parent: "), c["parent_symbol_name"]),
        F.concat(F.lit("// Chunk part: "), c["split_part"], F.lit("/"), c["split_total"]),
        F.concat(F.lit("// Purpose: "), c["docstring"]),
        listed("Imports", c["imports"]),
        listed("Calls", c["outgoing_calls"]),
    )
    return F.concat(head, F.lit("\n\n"), c["content"])


def without_containers(chunks: DataFrame, max_tokens: int) -> DataFrame:
    """Leaves out oversized containers that strictly hold another chunk, and names
    the nearest of these as the parent of what they held.

    Chunks pair within a file only. chunks: file_path, line_start, line_end,
    symbol_name, symbol_kind, content, chunk_id.
    """
    big = F.col("symbol_kind").isin(*CONTAINERS) & (estimated_tokens(F.col("content")) > max_tokens)
    outer = chunks.where(big).select("file_path", F.col("line_start").alias("s"), F.col("line_end").alias("e"), F.col("symbol_name").alias("parent"), F.col("chunk_id").alias("outer_id"))
    inside = (F.col("s") <= F.col("line_start")) & (F.col("e") >= F.col("line_end")) & ((F.col("s") < F.col("line_start")) | (F.col("e") > F.col("line_end")))
    held = chunks.join(outer, "file_path").where(inside)
    gone = held.select(F.col("outer_id").alias("chunk_id")).distinct()
    nearest = held.groupBy("chunk_id").agg(F.min_by("parent", F.struct(F.col("e") - F.col("s"), "outer_id")).alias("parent_symbol_name"))
    return chunks.drop("parent_symbol_name").join(gone, "chunk_id", "left_anti").join(nearest, "chunk_id", "left")


def split_lines(text: str, target_tokens: int) -> list[tuple[int, str]]:
    """(first line, part): as many lines a part as stay within the target, one at
    least; a text that fits is its own part."""
    lines = text.removesuffix("\n").split("\n") if text else []
    parts: list[tuple[int, list[str]]] = []
    size = 0
    for i, line in enumerate(lines):
        added = len(line.encode()) + 1
        if parts and -(-(size + added - 1) // 4) <= target_tokens:
            parts[-1][1].append(line)
            size += added
        else:
            parts.append((i, [line]))
            size = added
    return [(i, "\n".join(p)) for i, p in parts] if len(parts) > 1 else [(0, text)]


def chunk_files(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """One chunk for each symbol (path, name, kind, line_start, line_end) of files
    (path, content): its lines, its module, and an id that follows from its place."""
    rows = symbols.join(files.select("path", "content"), "path")
    lines = F.slice(F.split("content", "\n"), F.col("line_start").cast("int"), (F.col("line_end") - F.col("line_start") + 1).cast("int"))
    place = chunk_id(F.col("path"), F.col("name"), F.col("line_start"), F.lit(1))
    return rows.select(place.alias("chunk_id"), F.col("path").alias("file_path"), F.array_join(module_path(F.col("path")), "::").alias("module_path"), F.col("name").alias("symbol_name"), F.col("kind").alias("symbol_kind"), "line_start", "line_end", F.array_join(lines, "\n").alias("content"))


def split_oversized(chunks: DataFrame, target_tokens: int) -> DataFrame:
    """(chunk_id, split_part, split_total, line_start, content) of all chunks; a
    narrow pass, since a part's end depends on the part before it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, start, content in zip(b["chunk_id"], b["line_start"], b["content"]):
                parts = split_lines(content or "", target_tokens)
                out += [(i, k + 1, len(parts), start + at, text) for k, (at, text) in enumerate(parts)]
            yield pd.DataFrame(out, columns=["chunk_id", "split_part", "split_total", "line_start", "content"])

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    return chunks.select("chunk_id", "line_start", "content").mapInPandas(run, f"chunk_id {kind}, split_part long, split_total long, line_start long, content string")


def trim_type(t: Column) -> Column:
    """A type without the default parameters of the standard library."""
    t = F.regexp_replace(t, "(, Global)+>", ">")
    t = F.regexp_replace(t, ", RandomState>", ">")
    t = F.regexp_replace(t, ", BuildHasherDefault<[^<>]*(?:<[^<>]*>)?[^<>]*>>", ">")
    return F.regexp_replace(t, r"LazyLock<(.+?), fn\(\) -> \1>", "LazyLock<$1>")
