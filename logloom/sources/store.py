"""The stored tables: Parquet parts behind a log of manifests, one per version.

Parts and manifests go through Hadoop's file systems, so root may be a local
folder (of a local master) or one that all executors share, by any scheme. A
write stages new parts first; a manifest, written aside and renamed to the next
free number, makes them visible all at once. A failed import leaves the store
as it was, and of two writers at once the second fails. messages only ever get
parts added; sessions and import_state are merged and replaced. Parts that the
last manifest doesn't name are of earlier versions or of failed writes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERSION = 4
SCHEMAS = {
    "sessions": "source string, session_id string, cwd string, repo_path string, git_branch string, version string, custom_title string, agent_name string, started_at string, ended_at string, imported_at string",
    "messages": "seq bigint, uuid string, source string, session_id string, parent_uuid string, role string, content string, timestamp string, is_sidechain boolean",
    "import_state": "jsonl_path string, source string, file_size bigint, last_offset bigint, imported_at string, line_feeds bigint",
}
#: Columns that a store of version 3 has no values for, and what all its rows mean.
LEGACY_SOURCE = "claude_code"


def stamp_source(rows: DataFrame) -> DataFrame:
    """Rows of version 3 in today's layout: all are of the only source there was."""
    source = F.coalesce("source", F.lit(LEGACY_SOURCE)) if "source" in rows.columns else F.lit(LEGACY_SOURCE)
    return rows.withColumn("source", source)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        root = root.rstrip("/")
        self.root = root if "://" in root or root.startswith("file:") else f"file://{root}"
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)
        self._fs.mkdirs(self._path("/_manifests"))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}{name}")

    def _latest(self) -> int:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("/_manifests"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self) -> dict:
        n = self._latest()
        if not n:
            return {"number": 0, "version": VERSION, "next_seq": 1, "parts": {t: [] for t in SCHEMAS}}
        stream = self._fs.open(self._path(f"/_manifests/{n}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) | {"number": n}

    def _switch(self, manifest: dict, after: int) -> None:
        """Make manifest the one after the given number; an error if there is one already."""
        tmp, to = self._path(f"/_manifests/.{uuid.uuid4().hex}"), self._path(f"/_manifests/{after + 1}.json")
        out = self._fs.create(tmp, False)
        try:
            out.write(bytearray(json.dumps(manifest, indent=1).encode()))
        finally:
            out.close()
        # Rename.NONE: an existing target is an error in every file system.
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), self._conf).rename(tmp, to, options)

    def read(self, name: str) -> DataFrame:
        """A table in today's columns: those a part lacks are null, those dropped since are gone."""
        schema = StructType.fromDDL(SCHEMAS[name])
        parts = self.manifest()["parts"].get(name, [])
        if not parts:
            return self.spark.createDataFrame([], schema)
        raw = self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.root}/{p}" for p in parts])
        cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in raw.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
        return raw.select(*cols)

    def publish(self, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None, next_seq: int | None = None, version: int | None = None) -> None:
        """Stage all parts, then switch the manifest once."""
        m = self.manifest()
        parts = {t: list(p) for t, p in m["parts"].items()}
        for tables, keep in ((replace or {}, False), (append or {}, True)):
            for name, df in tables.items():
                part = f"{name}/{uuid.uuid4().hex}"
                df.write.mode("error").option("compression", "zstd").parquet(f"{self.root}/{part}")
                parts[name] = [*parts.get(name, []), part] if keep else [part]
        self._switch({"version": version or m["version"], "next_seq": next_seq or m["next_seq"], "parts": parts}, m["number"])

    def delete_all(self) -> None:
        self._switch({"version": VERSION, "next_seq": 1, "parts": {t: [] for t in SCHEMAS}}, self._latest())

    def migrate(self) -> dict[str, int]:
        """Rewrite a version 3 store: stamp its only source on every row. Rows per table, all 0 if there is nothing to do."""
        m = self.manifest()
        if m["version"] >= VERSION:
            return dict.fromkeys(SCHEMAS, 0)
        tables = {name: stamp_source(self.read(name)) for name in SCHEMAS}
        counts = {name: df.count() for name, df in tables.items()}
        self.publish(replace=tables, version=VERSION)
        return counts
