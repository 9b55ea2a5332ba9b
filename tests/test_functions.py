"""Chunking, embedding, rendering and file filters."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import chunking, embedding, render
from graphloom.sources import filters


def test_overlap(spark):
    ten = "\n".join(f"l{i}" for i in range(10)) + "\n"
    df = spark.createDataFrame([(1, 1, ten), (1, 2, "x\ny"), (1, 3, ""), (1, 4, "z"), (2, 1, "q")], "g long, o long, t string")
    got = {(r["g"], r["o"]): (r["overlap_prev"], r["overlap_next"]) for r in chunking.overlap(df, "g", "o", "t").collect()}
    assert got == {(1, 1): (None, "l8\nl9"), (1, 2): ("l0\nl1", "y"), (1, 3): ("x", None), (1, 4): (None, None), (2, 1): (None, None)}


def test_split(spark):
    text = "\n".join(f"line_{i}();" for i in range(40))
    parts = chunking.split_lines(text, 20)
    assert "\n".join(p for _, p in parts) == text and all(-(-len(p) // 4) <= 20 for _, p in parts) and parts[1][0] == parts[0][1].count("\n") + 1
    assert chunking.split_lines("a\nb", 100) == [(0, "a\nb")] and chunking.split_lines("", 5) == [(0, "")] and chunking.split_lines("x" * 99, 5) == [(0, "x" * 99)]
    df = spark.createDataFrame([(1, 10, text), (2, 1, None)], "chunk_id long, line_start long, content string")
    rows = chunking.split_oversized(df, 20).orderBy("chunk_id", "split_part").collect()
    assert rows[0]["line_start"] == 10 and rows[0]["split_total"] == len(parts) and rows[-1]["content"] == ""


def test_containers(spark):
    big = "x" * 400
    c = spark.createDataFrame([("m", "f", 1, 50, "outer", "module", big), ("i", "f", 5, 30, "Thing", "impl", big), ("a", "f", 6, 9, "go", "function", "y"), ("s", "f", 60, 70, "alone", "impl", big), ("o", "g", 5, 9, "far", "function", "y")], "chunk_id string, file_path string, line_start long, line_end long, symbol_name string, symbol_kind string, content string")
    got = {r["chunk_id"]: r["parent_symbol_name"] for r in chunking.without_containers(c, 50).collect()}
    assert got == {"a": "Thing", "s": None, "o": None}


def test_embedding_text(spark):
    lit = dict(file_path=F.lit("src/a.rs"), line_start=F.lit(1), line_end=F.lit(3), module_path=F.array(F.lit("crate"), F.lit("a")), symbol_name=F.lit("f"), symbol_kind=F.lit("function"), parent_symbol_name=F.lit(None).cast("string"), split_part=F.lit(1), split_total=F.lit(2), docstring=F.lit(None).cast("string"), imports=F.array(*[F.lit(c) for c in "abcdefg"]), outgoing_calls=F.array().cast("array<string>"), content=F.lit("fn f() {}"))
    text = spark.range(1).select(chunking.embedding_text(lit)).first()[0]
    assert text == "// File: src/a.rs\n// Location: lines 1-3\n// Module: crate::a\n// Symbol: f (function)\n// Chunk part: 1/2\n// Imports: a, b, c, d, e\n\nfn f() {}"


@pytest.mark.parametrize(("t", "want"), [("Vec<Vec<u8, Global>, Global>", "Vec<Vec<u8>>"), ("HashMap<K, V, RandomState, Global>", "HashMap<K, V>"), ("Map<K, BuildHasherDefault<Fx<u8>>>", "Map<K>"), ("LazyLock<Mutex<u8>, fn() -> Mutex<u8>>", "LazyLock<Mutex<u8>>"), ("u32", "u32")])
def test_trim_type(spark, t, want):
    assert spark.range(1).select(chunking.trim_type(F.lit(t))).first()[0] == want


def test_embedders(spark):
    e = embedding.HashingEmbedder(16)
    df = spark.createDataFrame([(1, "a b a"), (2, None)], "i long, t string")
    v = {r["i"]: r["v"] for r in df.select("i", embedding.embed(F.col("t"), e).alias("v")).collect()}
    assert np.linalg.norm(v[1]) == pytest.approx(1) and not any(v[2])
    i = embedding.Identity("openrouter", "a/b;c=é", 8, 512, "find: %")
    assert embedding.Identity.decode(i.encode()) == i
    for bad in ("x;v=2", "emb;v=1;rt=a;model=b;dim=1;max=1;query=", "emb;v=2;v=2", "emb;v=2;rt=a;model=%G0;dim=1;max=1;query=", "emb;v=2;junk"):
        with pytest.raises(ValueError):
            embedding.Identity.decode(bad)
    assert embedding.plan_batches([5, 5, 9, 1, 1], 3, 15) == [(0, 2), (2, 3), (3, 5)] and embedding.plan_batches([], 3, 9) == [] and embedding.plan_batches([99], 3, 9) == [(0, 1)]


def test_cached_vectors(spark):
    e = embedding.HashingEmbedder(4)
    items = spark.createDataFrame([("a", "x "), ("b", "y"), ("c", " "), ("d", None)], "target string, source string")
    h = {r["target"]: r["content_hash"] for r in embedding.with_cached(items, spark.createDataFrame([], "target string, content_hash string, vector array<float>, embedder_version string"), e).collect()}
    assert set(h) == {"a", "b"}
    cache = spark.createDataFrame([("a", h["a"], [1.0], e.identity.encode()), ("b", h["b"], [1.0], "other")], "target string, content_hash string, vector array<float>, embedder_version string")
    assert {r["target"]: r["vector"] for r in embedding.with_cached(items, cache, e).collect()} == {"a": [1.0], "b": None}


def test_rendering():
    nodes, edges = [("k::a", 0, 1.0), ('k::m::b<"T">', 1, 0.5)], [("k::a", 'k::m::b<"T">', "Calls"), ("k::a", "gone", "Uses")]
    text = render.mermaid(nodes, edges)
    assert text.startswith("flowchart LR") and 'k__a["a"]:::seed' in text and "k__a --> k__m__b__T__" in text and "gone" not in text
    assert "a [1.00] (seed)" in render.outline(nodes, edges)


def test_filters(spark):
    names = {".env": 1, "x/.env.local": 1, "a.env": 1, "d/secrets/x.rs": 1, "k/id.pem": 1, "my_password.rs": 1, "x/target/y.rs": 1, "src/main.rs": 0, "environment.rs": 0, "src/target.rs": 0}
    df = spark.createDataFrame([(n,) for n in names], "p string")
    assert {r[0]: int(r[1]) for r in df.select("p", filters.is_sensitive(F.col("p"))).collect()} == names
    f = spark.createDataFrame([("a.rs", "fn a() {}", 9), ("b.rs", 'let password = "hunter2hunter2";', 9), ("c.rs", "x", 1 << 30)], "path string, content string, size long")
    assert [r["path"] for r in filters.readable(f).collect()] == ["a.rs"]
