"""Snapshots: versioned Parquet folders with a pointer to the current one.

Everything goes through Hadoop's file system layer, so a store can be anywhere.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession

SCHEMA_VERSION = 1


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self, path):
        return path.getFileSystem(self._conf)

    def _exists(self, name: str) -> bool:
        p = self._path(name)
        return self._fs(p).exists(p)

    def _put(self, name: str, text: str) -> None:
        """Write under another name, then rename over the old file."""
        tmp, to = self._path(f"{name}.{uuid.uuid4().hex}"), self._path(name)
        fs = self._fs(to)
        out = fs.create(tmp, True)
        out.write(text.encode())
        out.close()
        # renames over the old file in one step where the store can do so
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri() if to.toUri().getScheme() else fs.getUri(), self._conf)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(context.makeQualified(tmp), context.makeQualified(to), options)

    def _get(self, name: str) -> str | None:
        if not self._exists(name):
            return None
        return "\n".join(r["value"] for r in self.spark.read.text(f"{self.root}/{name}").collect())

    def snapshot_id(self, workspace: str, fingerprint: str) -> str:
        return hashlib.sha256("\0".join([workspace, fingerprint, str(SCHEMA_VERSION)]).encode()).hexdigest()

    def build(self, workspace: str, fingerprint: str, tables: dict[str, DataFrame], force: bool = False) -> tuple[str, bool]:
        """Write the tables unless this very state is there; (id, was written)."""
        sid = self.snapshot_id(workspace, fingerprint)
        if not force and self._exists(f"{sid}/manifest.json"):
            self._put("CURRENT", sid)
            return sid, False
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/{sid}/{name}")
        self._put(f"{sid}/manifest.json", json.dumps({"version": SCHEMA_VERSION, "workspace": workspace, "fingerprint": fingerprint, "tables": sorted(tables)}))
        self._put("CURRENT", sid)
        return sid, True

    def open(self, sid: str | None = None) -> dict[str, DataFrame] | None:
        """The tables of a snapshot, the current one by default; None if there is
        none or its version differs."""
        sid = sid or (self._get("CURRENT") or "").strip()
        text = self._get(f"{sid}/manifest.json") if sid else None
        manifest = json.loads(text) if text else None
        if not manifest or manifest["version"] != SCHEMA_VERSION:
            return None
        return {t: self.spark.read.parquet(f"{self.root}/{sid}/{t}") for t in manifest["tables"]}

    def ids(self) -> list[str]:
        root = self._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = self._fs(root)
        if not fs.exists(root):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory())

    def clear(self, dry_run: bool = True) -> list[str]:
        """Snapshots that are, or with ``dry_run`` would be, deleted."""
        ids = self.ids()
        if not dry_run:
            for name in (*ids, "CURRENT"):
                p = self._path(name)
                self._fs(p).delete(p, True)
        return ids

    def backups(self) -> list[str]:
        """Snapshots other than the current one, the newest first."""
        root = self._jvm.org.apache.hadoop.fs.Path(self.root)
        if not self.ids():
            return []
        current = (self._get("CURRENT") or "").strip()
        found = sorted(((s.getModificationTime(), s.getPath().getName()) for s in self._fs(root).listStatus(root) if s.isDirectory()), reverse=True)
        return [n for _, n in found if n != current and self._exists(f"{n}/manifest.json")]

    def restore(self, sid: str | None = None) -> str | None:
        """Make a snapshot the current one, the newest backup by default; None if there is none."""
        sid = sid or next(iter(self.backups()), None)
        if sid is None or not self._exists(f"{sid}/manifest.json"):
            return None
        self._put("CURRENT", sid)
        return sid

    def rotate(self, keep: int) -> list[str]:
        """Delete all but the newest ``keep`` snapshots and the current one."""
        root = self._jvm.org.apache.hadoop.fs.Path(self.root)
        found = sorted(((s.getModificationTime(), s.getPath().getName()) for s in self._fs(root).listStatus(root) if s.isDirectory()), reverse=True)
        current = (self._get("CURRENT") or "").strip()
        gone = [n for _, n in found[keep:] if n != current]
        for n in gone:
            p = self._path(n)
            self._fs(p).delete(p, True)
        return gone
