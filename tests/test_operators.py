"""Operators on small hand-made tables."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from graphloom.functions import identity
from graphloom.operators import incremental, navigate, ranking, relations, search, spans, surface, text, traverse, vector
from graphloom.operators.components import connected_components
from graphloom.operators.graph import Graph, page


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


@pytest.mark.parametrize(
    ("edges", "longest", "want"),
    [
        ("aa", 5, ["a"]), ("ab ba", 5, ["a -> b"]), ("ab bc ca", 5, ["a -> b -> c"]), ("ab", 5, []), ("ab bc cd da", 3, []),
        ("ab ac ba ca", 5, ["a -> b", "a -> c"]), ("ab ab ba", 5, ["a -> b"]), ("ab bc ca cb", 4, ["a -> b -> c", "b -> c"]),
    ],
)
def test_cycles(spark, edges, longest, want):
    df = spark.createDataFrame([(e[0], e[1]) for e in edges.split()], "src string, dst string")
    assert [p for p, _ in rows(traverse.cycles(df, longest))] == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(7, 5), (5, 9), (3, 3), (9, 7), (1, 200), (200, 160), (None, 4)]
    got = dict(rows(connected_components(spark.createDataFrame(chain, "a long, b long"))))
    assert got == {i: 1 for i in [1, 200, *range(100, 161)]} | {5: 5, 7: 5, 9: 5}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_reach(spark):
    e = spark.createDataFrame([tuple(x) for x in ("ab", "bc", "ca", "cd", "de", "xy")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "id string")
    assert rows(traverse.reach(e, start, 3)) == [("a", 3), ("b", 1), ("c", 2), ("d", 3)]
    assert rows(traverse.reach(e, start, 0)) == []


def test_ancestors_stop_at_the_root(spark):
    nodes = spark.createDataFrame([("v", "s"), ("s", "m"), ("m", None), ("x", None)], "id string, parent_id string")
    assert rows(traverse.ancestors(nodes, nodes.select("id").where("id IN ('v', 'x')"))) == [("v", "m", 2), ("v", "s", 1), ("v", "v", 0), ("x", "x", 0)]


GLOBS = """tokio tokio 1|tokio tokio_util 0|* '' 1|* anything 1|domain* domain_core 1|domain* domain 1|domain* core_domain 0|*core domain_core 1|*core domain_core_v2 0|foo*bar foobar 1|foo*bar foo_x_bar 1|foo*bar foo 0|a_c abc 0|a%c abc 0"""


def test_globs(spark):
    for glob, name, want in (c.split() for c in GLOBS.split("|")):
        got = spark.range(1).select(relations.glob_match(F.lit(name.strip("'")), glob)).first()[0]
        assert got == (want == "1"), (glob, name)


@pytest.mark.parametrize(
    ("attribute", "pattern", "want"),
    [
        ("#[derive(Debug)]", "derive", "attr"), ("#[derive(Debug)]", "#[derive(", "attr"), ("#[must_use]", "must_use", "attr"), ("#[cfg(test)]", "cfg", "attr"), ("#[cfg(derive)]", "derive", None),
        ("#[a::b::test]", "test", "attr"), ("#[derive(Debug)]", "derive(D", "attr"), ("/// Safety first", "Safety", "doc"), ("#[derive(Debug)]", "", None), ("#[derived]", "derive", None),
    ],
)
def test_attribute_match(spark, attribute, pattern, want):
    assert spark.range(1).select(surface.matches_attribute(F.lit(attribute), pattern)).first()[0] == want


def test_derives(spark):
    a = F.array(*[F.lit(x) for x in ("#[derive(Debug)]", "/// x", "#[derive(std::clone::Clone, ::serde::Serialize,)]", "#[must_use]")])
    assert spark.range(1).select(surface.derives(a)).first()[0] == ["Clone", "Debug", "Serialize"]


def test_kinds_and_capacity(spark):
    assert surface.item_kind("FN") == "Function"
    with pytest.raises(ValueError):
        surface.item_kind("macro")
    cases = {"8": 8, "1_024": 1024, "N": None, "4 * 2": None, "": None, "-1": None, "0": 0}
    df = spark.createDataFrame([(k,) for k in cases], "argument string")
    assert {r[0]: r[1] for r in df.select("argument", surface.capacity(F.col("argument"))).collect()} == cases
    calls = spark.createDataFrame([("tokio::sync::mpsc::channel", "8"), ("mpsc::channel", "8"), ("crossbeam_channel::unbounded", "")], "path string, argument string")
    assert rows(surface.channel_audit(calls), "channel", "bounded", "capacity") == [("crossbeam_unbounded", False, None), ("tokio_mpsc", True, 8)]


def test_vectors(spark):
    one = lambda a, b: spark.range(1).select(vector.cosine(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)))).first()[0]
    assert (one([1.0, 0.0], [1.0, 0.0]), one([1.0, 0.0], [0.0, 1.0]), one([1.0, 0.0], [-1.0, 0.0]), one([0.0, 0.0], [1.0, 0.0])) == (1, 0, -1, 0)
    v = spark.createDataFrame([(1, [1.0, 0.0], 10), (2, [0.9, 0.1], 10), (3, [0.0, 1.0], 11), (4, [1.0, 0.0], 11)], "vec_id long, embedding array<float>, c long")
    assert rows(vector.overlap_pairs(v, 0.8)) == [(1, 2, 0.993884), (1, 4, 1.0), (2, 4, 0.993884)]
    assert rows(vector.overlap_pairs(v, 0.8, block_col="c"), "id_a", "id_b") == [(1, 4), (2, 4)]
    p = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.85), (4, 5, 0.95)], "id_a long, id_b long, score double")
    assert rows(vector.clusters(p), "cluster", "size", "avg_score", "min_score") == [(1, 3, 0.875, 0.85), (4, 2, 0.95, 0.95)]
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, query_vector array<float>")
    assert rows(vector.nearest(v, q, 2), "id", "rank") == [(1, 1), (4, 2)]
    assert rows(vector.exact_pairs(spark.createDataFrame([(1, "h1"), (2, "h2"), (3, "h1")], "id long, h string"), "id", "h")) == [(1, 1, 2), (3, 1, 2)]


def test_fusion_and_quality(spark):
    a = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2)], "query_id long, id long, score double, rank long")
    b = spark.createDataFrame([(1, 11, 0.9, 1), (1, 12, 0.8, 2)], "query_id long, id long, score double, rank long")
    assert [r["id"] for r in search.fuse(a, b).orderBy("rank").collect()] == [11, 10, 12]
    relevant = spark.createDataFrame([(1, 11), (2, 5)], "query_id long, id long")
    q = {r["query_id"]: r for r in search.quality(a, relevant).collect()}
    assert (q[1]["mrr"], q[1]["recall"], q[1]["precision"], q[1]["ndcg"]) == (0.5, 1.0, 0.5, 0.63093)
    assert q[2]["mrr"] == q[2]["precision"] == q[2]["ndcg"] == 0.0
    assert search.mean_quality(search.quality(a, relevant)).first()["queries"] == 2

    def down():
        raise OSError("no index")

    assert search.resilient(down, lambda: b).count() == 2 and search.resilient(lambda: a, lambda: b).count() == 3
    with pytest.raises(RuntimeError):
        search.resilient(down, down)


def test_bm25(spark):
    c = spark.createDataFrame([(1, "fn parse_file parses a file"), (2, "fn read_content reads"), (3, None), (4, "")], "chunk_id long, content string")
    q = spark.createDataFrame([(1, "Parse FILE"), (2, "nothing here"), (3, "")], "query_id long, query string")
    got = rows(text.top_k(text.bm25(c, q), 5), "query_id", "id")
    assert got == [(1, 1)]
    assert text.postings(c.limit(0)).count() == 0


def test_best_by_blocks(spark):
    words = "a b c d e f g h the the of".split()
    c = spark.createDataFrame([(i, None if i == 7 else " ".join(words[(i * j) % 11] for j in range(i % 9))) for i in range(60)], "chunk_id long, content string").repartition(3)
    q = spark.createDataFrame([(1, "A the"), (2, "h of b"), (3, "nothing"), (4, None), (5, "the of a b c d e f g h")], "query_id long, query string")
    for k, block in ((1, 5), (4, 1), (100, 1 << 22)):
        assert rows(ranking.bm25_top(c, q, k, block_postings=block)) == rows(text.top_k(text.bm25(c, q), k).select("query_id", "id", "score", "rank"))
    assert ranking.bm25_top(c.limit(0), q, 3).count() == ranking.bm25_top(c, q.limit(0), 3).count() == 0
    v = spark.createDataFrame([(i, None if i == 8 else [float(i % 5 - 2), float(i % 3), None if i == 4 else 1.0, 2.0][: 4 - (i == 6)]) for i in range(40)] + [(99, [0.0, 0.0])], "vec_id string, embedding array<float>")
    asked = v.where("vec_id IN (3, 4, 6, 8, 99)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    scored = v.crossJoin(asked).select("query_id", F.col("vec_id").alias("id"), F.round((1 + vector.cosine(F.col("embedding"), F.col("query_vector"))) / 2, 6).alias("score"))
    for k, block in ((3, 4), (60, 1000)):
        near = vector.nearest(v.repartition(3), asked, k, block_rows=block)
        assert sorted(map(str, near.collect())) == sorted(map(str, text.top_k(scored, k).collect()))
        assert not re.search("Cartesian|NestedLoop", near._jdf.queryExecution().toString())
    assert vector.nearest(v.limit(0), asked, 3).count() == vector.nearest(v, asked.limit(0), 3).count() == 0


def test_quality_by_totals(spark):
    a = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2)], "query_id long, id long, score double, rank long")
    every = spark.createDataFrame([(1, 11), (1, 12), (2, 5)], "query_id long, id long")
    totals = every.groupBy("query_id").agg(F.count("*").alias("total"))
    listed = every.join(a.select("query_id", "id"), ["query_id", "id"])
    assert rows(search.quality(a, listed, totals=totals)) == rows(search.quality(a, every))
    assert rows(search.tune_k(a, a, listed, totals=totals)) == rows(search.tune_k(a, a, every))


def test_text(spark):
    d = spark.createDataFrame([(1, "a\nbé\n\nfn x() { unsafe {\n} // SAFETY\n unsafe { y.unwrap() }"), (2, "")], "doc_id long, text string")
    assert rows(text.line_offsets(d))[:4] == [(1, 1, 0, 1), (1, 2, 2, 3), (1, 3, 6, 0), (1, 4, 7, 17)]
    assert rows(text.unsafe_blocks(d)) == [(1, 4, 2, False), (1, 6, 1, True)]
    assert rows(text.body_audit(d)) == [(1, "unwrap", 1)]
    assert rows(text.body_context(d)) == [(1, 6, "unwrap", "} // SAFETY\n unsafe { y.unwrap() }")]
    with pytest.raises(ValueError):
        text.body_audit(d, ["nope"])
    c = text.complexity(d).where("doc_id = 1").first()
    assert (c["lines"], c["non_empty"], c["n_fn"], c["cyclomatic"], c["per_function"]) == (6, 5, 1, 0, 0.0)
    line = d.where("doc_id = 1").select(text.line_of_byte(F.col("text"), F.lit(7)), text.snippet(F.col("text"), F.lit(2), 2)).first()
    assert tuple(line) == (4, "bé\n")


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("fn f() { x.unwrap(); y . unwrap (); }", {"unwrap": 2}), ("fn f() { x.unwrap_or(1); }", {}), ('fn f() { x.expect("a"); expect(1); }', {"expect": 1}),
        ('fn f() { panic!("x"); std::todo!(); unimplemented!(); unreachable!(); assert!(a); }', {"panic_macros": 4}), ("fn f() { a.unwrap_unchecked(); a.unwrap_err_unchecked(); }", {"unwrap_unchecked": 2}),
        ("fn f() { std::mem::transmute::<u32, Vec<u8>>(x); transmute(y); my_transmute(z); }", {"transmute": 2}),
        ("fn f() { loop { step(); } }", {"unbounded_loop": 1}), ("fn f() { loop { if x { break; } } }", {}), ("fn f() { loop { g()?; } }", {}), ("fn f() { loop { if a { if b { return; } } } }", {}),
        ("async fn f() { let g = m.lock(); h().await; }", {"await_in_guard_scope": 1}), ("async fn f() { h().await; let g = m.lock(); }", {}), ("async fn f() { let g: MutexGuard<u8> = x; a().await; b().await; }", {"await_in_guard_scope": 2}),
        ("fn fact(n: u32) -> u32 { n * fact(n - 1) }", {"self_recursion": 1}), ("fn f(n: u32) { ff(n); g.f2(1) }", {}), ("", {}),
    ],
)
def test_body_audit(spark, body, want):
    got = {p: n for _, p, n in rows(text.body_audit(spark.createDataFrame([(1, body)], "doc_id long, text string")))}
    assert got == want


def test_incremental_index(spark, tmp_path):
    files = lambda **kw: spark.createDataFrame(list(kw.items()), "path string, content string")
    prepare = lambda df: df.select("path", F.length("content").alias("n"))
    index = incremental.IncrementalIndex(spark, f"file://{tmp_path}/index", prepare)
    assert index.open() is None and index.runs() == 0
    state = lambda: [(p, n, r) for p, n, r in rows(index.open(), "path", "n", "run")]
    assert index.update(files(a="1", b="22", c="333")) == 3 and state() == [("a", 1, 1), ("b", 2, 1), ("c", 3, 1)]
    assert index.update(files(a="1", b="22", c="333")) == 0 and index.runs() == 1
    assert index.update(files(a="1", b="4444", d="55555")) == 3
    assert state() == [("a", 1, 1), ("b", 4, 2), ("d", 5, 2)]
    assert rows(index.log(), "run", "path", "change")[3:] == [(2, "b", "modified"), (2, "c", "deleted"), (2, "d", "added")]
    again = incremental.IncrementalIndex(spark, f"file://{tmp_path}/index", prepare)
    assert again.update(files(a="1", b="4444", d="55555")) == 0 and again.repair(files(a="1", b="4444", d="55555")) == 0
    # rows that got lost are prepared anew
    tables = again.store.open()
    again.store.build("index", "broken", {"state": tables["state"], "rows": tables["rows"].where("path <> 'b'"), "log": tables["log"]})
    assert again.repair(files(a="1", b="4444", d="55555")) == 1 and state() == [("a", 1, 1), ("b", 4, 3), ("d", 5, 2)]


def test_cluster_page(spark):
    found = spark.createDataFrame([(1, 3, 0.9, 0.8), (2, 2, 0.8, 0.8), (3, 9, 0.7, 0.6)], "cluster long, size long, avg_score double, min_score double")
    assert rows(vector.cluster_page(found, 4), "cluster", "shown") == [(1, 3), (2, 1)]
    assert rows(vector.cluster_page(found, 4, 1), "cluster", "shown") == [(2, 2), (3, 2)]
    assert vector.cluster_page(found, 4, 3).count() == 0


def test_pairs_of_blocks(spark):
    made = [(i, [float((i * 7 + k) % 5) for k in range(4)], i % 2) for i in range(40)] + [(99, [], 0)]
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>, g int")
    every = rows(vector.overlap_pairs(df, 0.9, block_rows=3))
    assert every == rows(vector.overlap_pairs(df, 0.9)) and len(every) > 20
    apart = {(a, b) for a, b, _ in every if a % 2 != b % 2}
    assert {(a, b) for a, b, _ in rows(vector.overlap_pairs(df, 0.9, block_col="g", block_rows=3))} == apart


def test_fields_add_up(spark):
    c = spark.createDataFrame([(1, "parse file", "parse", None), (2, "read content", "read", "parse later")], "chunk_id long, content string, name string, doc string")
    q = spark.createDataFrame([(1, "parse")], "query_id long, query string")
    got = dict(rows(text.bm25_fields(c, q, ["content", "name", "doc"]), "id", "score"))
    parts = [dict(rows(text.bm25(c.select("chunk_id", F.coalesce(f, F.lit("")).alias("content")), q), "id", "score")) for f in ("content", "name", "doc")]
    assert got == pytest.approx({i: sum(p.get(i, 0) for p in parts) for i in (1, 2)}, abs=2e-6)


def test_tokens_of_other_scripts(spark):
    got = spark.createDataFrame([("Él niño; naïve_über straße42 " + "x" * 41 + " ü" + "é" * 20 + " 梦境",)], "t string").select(text.tokens(F.col("t"))).first()[0]
    assert got == ["él", "niño", "naïve", "über", "straße42", "梦境"]


def test_resilient_search(spark):
    hit = lambda: spark.createDataFrame([(1, 7, 0.5, 1)], "query_id long, id long, score double, rank long")
    late = lambda: hit().withColumn("score", F.raise_error(F.lit("down")).cast("double"))
    assert rows(search.resilient(hit, late), "id") == [(7,)]
    with pytest.raises(RuntimeError):
        search.resilient(late, late)


def test_state(spark):
    old = spark.createDataFrame([("a", "1", 1, 5), ("b", "2", 1, 5), ("c", "3", 1, 5)], "path string, content_hash string, size long, last_modified long")
    new = spark.createDataFrame([("a", "1", 1, 5), ("b", "9", 2, 5), ("d", "4", 1, 6)], old.schema)
    changes = incremental.diff(old, new)
    assert rows(changes) == [("b", "modified"), ("c", "deleted"), ("d", "added")]
    assert incremental.diff(old, old).count() == 0
    root = lambda s: incremental.root_hash(s).first()[0]
    assert root(old) == root(old.repartition(3)) != root(new) and len(root(old.limit(0))) == 64
    assert rows(incremental.changed_candidates(old, new), "path") == [("b",), ("d",)]
    chunks = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "path string, x string")
    fresh = spark.createDataFrame([("b", "B2"), ("d", "D"), ("a", "no")], chunks.schema)
    assert rows(incremental.apply_changes(chunks, changes, fresh)) == [("a", "A"), ("b", "B2"), ("d", "D")]
    assert rows(incremental.upsert(chunks, fresh, "path")) == [("a", "no"), ("b", "B2"), ("c", "C"), ("d", "D")]
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert rows(incremental.consistency(ids(1, 2), ids(2, 3))) == [(1, "vector"), (3, "text")]
    v = spark.createDataFrame([("x", float(i)) for i in range(100)] + [("y", 1.0), ("y", 1.0)], "g string, v double")
    assert rows(incremental.percentiles(v, "g", "v")) == [("x", 100, 50.0, 95.0, 99.0), ("y", 2, 1.0, 1.0, 1.0)]
    m = spark.createDataFrame([("Permission denied",), ("timeout",)], "m string")
    assert rows(m.select(incremental.error_category(F.col("m")))) == [("Permanent",), ("Transient",)]
    h = lambda *s: incremental.health(spark.createDataFrame(list(zip(("bm25", "vector", "merkle"), s)), "component string, status string")).first()[0]
    assert (h("healthy", "healthy", "healthy"), h("unhealthy", "healthy", "healthy"), h("unhealthy", "unhealthy", "healthy")) == ("healthy", "degraded", "unhealthy")
    b = spark.createDataFrame([(0, 10), (0, 600), (1, 5)], "batch long, n long")
    assert tuple(incremental.token_batches(b).first()) == (615, 527, 5, 512, 1029)


def test_enclosing(spark):
    s = spark.createDataFrame([("f", 0, 10_000, "outer"), ("f", 5_000, 5_100, "inner"), ("f", 5_000, 5_100, "twin"), ("g", 0, 9, "other")], "file string, start long, stop long, id string")
    h = spark.createDataFrame([(1, "f", 5_010, 5_020), (2, "f", 5_090, 5_200), (3, "f", 9_999, 10_001), (4, "g", 0, 9), (5, "h", 1, 2)], "hit_id long, file string, lo long, hi long")
    assert rows(spans.enclosing(s, h, bucket=512)) == [(1, "inner"), (2, "outer"), (4, "other")]


def test_ids(spark):
    r = spark.range(1).select(identity.node_id(F.lit("a"), F.lit("bc")), identity.node_id(F.lit("ab"), F.lit("c")), identity.module_path(F.lit("x/src/a/mod.rs")), identity.module_path(F.lit("build.rs"))).first()
    assert r[0] == identity.node_id_of("a", "bc") != r[1] and (r[2], r[3]) == (["crate", "a"], ["build"])


@pytest.fixture(scope="module")
def graph(spark):
    n = spark.createDataFrame(
        [("c", "Crate", "k", "k", "c", None, None, None, None, None, "lib"), ("m", "Module", "k", "k", "c", "c", None, None, None, None, None), ("f", "Item", "run", "k::run", "c", "m", "Function", "a.rs", 5, 9, None), ("g", "Item", "run", "k::m::run", "c", "m", "Function", "b.rs", 1, 9, None)],
        "id string, kind string, display_name string, qualified_name string, crate_id string, parent_id string, item_kind string, file string, span_start long, span_end long, crate_target_kind string",
    ).withColumn("attributes", F.array().cast("array<string>"))
    u = spark.createDataFrame([("u1", "f", "m", "z.rs", 1, 2, "Read", "g", 1.0), ("u2", "f", "m", "z.rs", 1, 2, "Write", None, 1.0)], "usage_id string, target string, consumer_module string, file string, start long, stop long, category string, consumer_function string, weight double")
    b = spark.createDataFrame([("d", "m", "Value", "run", "f", "Declared", "Public", None, False), ("e", "missing", "Value", "run", "f", "NamedImport", "Public", None, True)], "binding_id string, from_module string, namespace string, visible_name string, target string, kind string, vis_tag string, vis_node string, is_explicit_pub_use boolean")
    return Graph(n, b, u, spark.createDataFrame([("f",)], "target string"), spark.createDataFrame([], "target string, type_string string, is_mut boolean"))


def test_navigation(graph):
    assert rows(navigate.find_definition(graph, "ru"), "item", "is_exact") == [("k::m::run", False), ("k::run", False)]
    assert len(rows(navigate.find_definition(graph, "run", True))) == 2 and rows(navigate.find_definition(graph, "ru", True)) == []
    assert rows(navigate.references(graph, "run"), "file", "what") == [("a.rs", "declaration"), ("b.rs", "declaration"), ("z.rs", "usage")]
    assert rows(navigate.rename_preview(graph, "k::run", "go"), "file", "start") == [("a.rs", 5), ("z.rs", 1)]
    with pytest.raises(ValueError):
        navigate.rename_preview(graph, "nobody", "x")


def test_missing_nodes_are_errors(graph):
    with pytest.raises(Exception, match="missing node"):
        relations.who_imports(graph, "k::run").collect()


def test_pages(graph):
    p = page(relations.who_uses(graph, "k::run"), ["file", "category"], 1, 5).collect()
    assert [(r["category"], r["total"]) for r in p] == [("Write", 2)]
    assert rows(relations.who_calls(graph, "k::run"), "caller") == [("k::m::run",)]
    with pytest.raises(ValueError):
        relations.rank_metric(relations.dependency_metric(graph), "beauty")
    assert rows(surface.dead_pub(graph), "item") == [("k::run",)]


def test_recursion_limits(graph):
    got = traverse.recursive_callers(graph, "k::run", 3).first()
    assert tuple(got) == (1, 1, 1, False)
    assert tuple(traverse.recursive_callers(graph, "k::run", 0).first()) == (0, 1, 0, True)
