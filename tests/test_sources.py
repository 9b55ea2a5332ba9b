"""Stores, source files, lexical facts and streams."""

from __future__ import annotations

import pytest

from graphloom.sources import files, rust_facts
from graphloom.sources.rust_facts import type_uses
from graphloom.sources.snapshots import SnapshotStore
from graphloom.streaming import windows

SOURCE = '''use std::{collections::{HashMap, HashSet as Set}, io::{self, Read}};
pub use crate::a::*;
/// Doc
pub fn outer(x: u32) -> u32 { fn inner() { leaf(); } helper(x); a::b(1); if (x) {} x.method() }
struct S;
impl Trait for S { fn go(&self) { outer(2) } }
const N: usize = 3;
'''


def test_use_trees():
    assert rust_facts.flatten_use("std::{collections::{HashMap, HashSet as Set}, io::{self, Read}}") == [("std::collections::HashMap", "HashMap"), ("std::collections::HashSet", "Set"), ("std::io", "io"), ("std::io::Read", "Read")]
    assert rust_facts.flatten_use("crate::a::*") == [("crate::a::*", "*")]


def test_facts(spark):
    got = rust_facts.lexical_facts(spark.createDataFrame([("a.rs", SOURCE), ("b.rs", ""), ("c.rs", None)], "path string, content string")).collect()
    by = lambda k: sorted((r["name"], r["detail"]) for r in got if r["fact"] == k)
    assert by("fn") == [("go", ""), ("inner", ""), ("outer", "pub")] and by("struct") == [("S", "")] and by("impl") == [("Trait for S", "")] and by("const") == [("N", "")]
    assert by("call") == [("a::b", "outer"), ("helper", "outer"), ("leaf", "inner"), ("method", "outer"), ("outer", "go")]
    assert len(by("use")) == 5


def test_files(spark, tmp_path):
    for name, body in (("src/a.rs", "fn a() {}"), ("src/b.txt", "no"), ("target/c.rs", "no"), ("d.rs", "x\0y"), ("e.rs", "")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    got = files.read_sources(spark, str(tmp_path))
    assert sorted(r["path"] for r in got.collect()) == ["d.rs", "src/a.rs"]
    first = files.fingerprint(got)
    assert first == files.fingerprint(files.read_sources(spark, str(tmp_path)))
    (tmp_path / "src/a.rs").write_text("fn b() {}")
    assert first != files.fingerprint(files.read_sources(spark, str(tmp_path)))
    assert files.read_file(spark, str(tmp_path / "src/b.txt")) == "no"
    assert "binary" in files.read_file(spark, str(tmp_path / "d.rs")) and "empty" in files.read_file(spark, str(tmp_path / "e.rs"))


def test_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    assert store.open() is None and store.ids() == []
    first, new = store.build("w", "f1", {"t": spark.range(3)})
    assert new and store.build("w", "f1", {"t": spark.range(9)}) == (first, False)
    second, _ = store.build("w", "f2", {"t": spark.range(5)})
    assert store.open()["t"].count() == 5 and store.open(first)["t"].count() == 3
    assert store.build("w", "f1", {"t": spark.range(4)}, force=True) == (first, True) and store.open()["t"].count() == 4
    assert sorted(store.clear(dry_run=True)) == sorted([first, second]) and store.open() is not None
    assert store.rotate(1) in ([second], []) and store.open()["t"].count() == 4
    store.clear(dry_run=False)
    assert store.open() is None


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 {h:02}:{m:02}:00", u, "view", 1.0) for i, (h, m, u) in enumerate([(0, 5, 1), (0, 50, 1), (1, 10, 1), (1, 30, 2), (3, 0, 1)])]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").selectExpr("event_id", "cast(ts AS timestamp_ntz) AS ts", "user_id", "event_type", "value")
    df.write.parquet(f"{tmp_path}/events.parquet")
    events = lambda: windows.read_events(spark, f"{tmp_path}/events.parquet")
    assert sorted(r["n"] for r in windows.run_available(windows.tumbling(events()), "t").collect()) == [1, 2, 2]
    assert sum(r["n"] for r in windows.run_available(windows.sliding(events()), "s").collect()) == 10
    assert sorted((r["user_id"], r["n"]) for r in windows.run_available(windows.sessions(events()), "w").collect()) == [(1, 1), (1, 1), (1, 2), (2, 1)]


def test_watch_folder(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.rs").write_text("fn a() {}")
    seen = []
    go = lambda: windows.watch_folder(spark, str(tmp_path / "src"), lambda df, _: seen.extend(r["path"] for r in df.select("path").collect()), str(tmp_path / "state")).awaitTermination()
    go()
    (tmp_path / "src/b.rs").write_text("fn b() {}")
    go()
    assert [p.rsplit("/", 1)[1] for p in seen] == ["a.rs", "b.rs"]


def test_type_references(spark):
    source = "pub struct Foo<T> { pub a: Vec<Bar>, b: &'a str }\nimpl Display for Foo<u8> {\n    fn fmt(&self, f: &mut Formatter<'_>) -> Result<(), Error> { let x: std::collections::HashMap<Key, u32> = y; }\n}\nfn solo(a: u32, b: Option<Qux>) -> Bar {}\n"
    files = spark.createDataFrame([("p", source), ("q", None), ("r", "")], "path string, content string")
    got = {(r["type"], r["context"], r["owner"], r["line"]) for r in type_uses(files).collect()}
    assert got == {
        ("Vec", "field", "Foo", 1), ("Bar", "generic", "Foo", 1), ("Display", "impl", "Display for Foo<u8>", 2), ("Foo", "impl", "Display for Foo<u8>", 2), ("Formatter", "parameter", "fmt", 3),
        ("Result", "return", "fmt", 3), ("Error", "generic", "fmt", 3), ("HashMap", "let", "fmt", 3), ("Key", "generic", "fmt", 3), ("Option", "parameter", "solo", 5), ("Qux", "generic", "solo", 5), ("Bar", "return", "solo", 5),
    }


def test_restore(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    assert store.backups() == [] and store.restore() is None
    first, _ = store.build("w", "1", {"t": spark.range(1)})
    second, _ = store.build("w", "2", {"t": spark.range(2)})
    assert store.backups() == [first] and store.open()["t"].count() == 2
    assert store.restore() == first and store.open()["t"].count() == 1 and store.backups() == [second]
    assert store.restore("nothing") is None and store.restore(second) == second
