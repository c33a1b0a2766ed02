"""Versioned tables: parts that are only ever added, keys that are gone, and one numbered file for each version.

A version is published by renaming its file to the next number, which fails if
that number is taken; so a reader sees a version whole or not at all, a writer
that dies before leaves the last one as it was, and of two writers with the same
base one is refused.  A reader pins the version that it began with.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts and sets of gone keys of a table, at most; then it is written anew as one part.
MOST_PARTS = 16


class Conflict(RuntimeError):
    """Another writer has published since."""


@dataclass
class Delta:
    """A change of a table: rows whose key is in ``gone`` go, then the ``added`` rows come."""

    key: str
    gone: DataFrame | None = None
    added: DataFrame | None = None


class Store:
    """The tables of one index below a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def read_text(self, path: str) -> str | None:
        fs, p = self._fs(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    @staticmethod
    def _local(path: str) -> Path | None:
        return Path(path.removeprefix("file://")) if path.startswith(("file:///", "/")) else None

    def write_text(self, path: str, text: str, *, overwrite: bool = True) -> None:
        """Writes a small file beside the target and renames it, so that a reader sees the old or the new one.

        Without ``overwrite`` a target that is there already raises Conflict.
        """
        fresh = f"{path}.{uuid.uuid4().hex}.new"
        if local := self._local(fresh):
            local.parent.mkdir(parents=True, exist_ok=True)
            local.write_text(text, "utf-8")
        else:
            fs, p = self._fs(fresh)
            out = fs.create(p, True)
            try:
                out.write(bytearray(text, "utf-8"))
            finally:
                out.close()
        self._rename(fresh, path, overwrite)

    def _rename(self, fresh: str, path: str, overwrite: bool) -> None:
        """In one step: Hadoop's own renaming of local files takes several."""
        if local := self._local(fresh):
            if overwrite:
                local.replace(self._local(path))
                return
            try:
                os.link(local, self._local(path))
            except FileExistsError:
                raise Conflict(path) from None
            finally:
                local.unlink()
            return
        context = self.spark.sparkContext
        hadoop = context._jvm.org.apache.hadoop.fs
        kind = getattr(hadoop, "Options$Rename")
        options = context._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE if overwrite else kind.NONE
        (fs, source), (_, target) = self._fs(fresh), self._fs(path)
        try:
            hadoop.FileContext.getFileContext(source.toUri(), context._jsc.hadoopConfiguration()).rename(source, target, options)
        except Exception as x:
            if not overwrite and "FileAlreadyExistsException" in str(x):
                fs.delete(source, False)
                raise Conflict(path) from None
            raise

    def _numbers(self) -> list[int]:
        fs, folder = self._fs(f"{self.root}/versions")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _version_path(self, number: int) -> str:
        return f"{self.root}/versions/{number:010d}.json"

    def manifest(self, version: int | None = None) -> dict:
        """The current version, or an earlier one: its number, and the parts and gone keys of each table."""
        numbers = self._numbers()
        if not numbers:
            return {"version": 0, "tables": {}}
        return json.loads(self.read_text(self._version_path(version or numbers[-1])))

    def table(self, name: str, manifest: dict | None = None) -> DataFrame:
        """The rows of a table: of each part those whose key hasn't gone since."""
        entry = (manifest or self.manifest())["tables"][name]
        return self._rows(entry)

    def _rows(self, entry: dict) -> DataFrame:
        out: DataFrame | None = None
        first = 0
        schema = None
        while first < len(entry["parts"]):
            after = [g for g in entry["gone"] if g["upto"] > first]
            last = min((g["upto"] for g in after), default=len(entry["parts"]))
            reader = self.spark.read if schema is None else self.spark.read.schema(schema)
            df = reader.parquet(*(p["path"] for p in entry["parts"][first:last]))
            schema = schema or df.schema
            for key in sorted({g["key"] for g in after}):
                df = df.join(self.spark.read.parquet(*(g["path"] for g in after if g["key"] == key)), key, "left_anti")
            df = df.select(schema.fieldNames())
            out = df if out is None else out.unionByName(df)
            first = last
        return out

    def has(self, name: str) -> bool:
        return name in self.manifest()["tables"]

    def _write(self, name: str, df: DataFrame, version: int) -> dict:
        path = f"{self.root}/{name}/v{version}-{uuid.uuid4().hex}.parquet"
        df.write.option("compression", "zstd").parquet(path)
        return {"path": path, "rows": self.spark.read.parquet(path).count()}

    def publish(self, tables: dict[str, DataFrame] | None = None, *, deltas: dict[str, Delta] | None = None, base: dict | None = None) -> dict:
        """Writes tables whole, and of others the changes only, then publishes them as one version; tables that aren't named stay.

        With ``base``, the version from which the tables were made, Conflict is
        raised if another one has been published since.
        """
        old = base or self.manifest()
        version = old["version"] + 1
        if base is not None and self.manifest()["version"] != base["version"]:
            raise Conflict(f"version {base['version']} isn't the last one any more")
        entries = dict(old["tables"])
        for name, df in (tables or {}).items():
            entries[name] = {"parts": [self._write(name, df, version)], "gone": []}
        for name, d in (deltas or {}).items():
            entries[name] = self._changed(name, entries.get(name, {"parts": [], "gone": []}), d, version)
        manifest = {"version": version, "tables": entries, "at": time.time()}
        self.write_text(self._version_path(version), json.dumps(manifest), overwrite=False)
        return manifest

    def _changed(self, name: str, entry: dict, d: Delta, version: int) -> dict:
        parts, gone = list(entry["parts"]), list(entry["gone"])
        if d.gone is not None and parts:
            written = self._write(f"{name}-gone", d.gone.select(d.key).where(F.col(d.key).isNotNull()).distinct(), version)
            if written["rows"]:
                gone.append({**written, "key": d.key, "upto": len(parts)})
        if d.added is not None:
            written = self._write(name, d.added, version)
            if written["rows"] or not parts:
                parts.append(written)
        entry = {"parts": parts, "gone": gone}
        if len(parts) + len(gone) <= MOST_PARTS:
            return entry
        return {"parts": [self._write(name, self._rows(entry), version)], "gone": []}

    def compact(self, name: str, sort: list[str]) -> dict:
        """A table written anew as one part, in order of some columns, by which a reader finds its rows."""
        base = self.manifest()
        return self.publish({name: self.table(name, base).repartitionByRange(*sort).sortWithinPartitions(*sort)}, base=base)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes what the last ``keep`` versions don't use; returns how many folders."""
        numbers = self._numbers()
        kept = [self.manifest(n) for n in numbers[-keep:]]
        used = {x["path"] for m in kept for e in m["tables"].values() for x in (*e["parts"], *e["gone"])}
        gone = 0
        for name in {p[len(self.root) + 1 :].split("/")[0] for p in used}:
            fs, folder = self._fs(f"{self.root}/{name}")
            for status in fs.listStatus(folder):
                path = f"{self.root}/{name}/{status.getPath().getName()}"
                if path not in used:
                    fs.delete(status.getPath(), True)
                    gone += 1
        for n in numbers[:-keep]:
            fs, path = self._fs(self._version_path(n))
            fs.delete(path, False)
        return gone

    @staticmethod
    def fingerprint(df: DataFrame) -> list[str]:
        """The number of rows and a sum over the digests of all of them, whatever their order."""
        row = df.agg(F.count("*"), F.sum(F.xxhash64(*(F.col(f"`{c}`") for c in sorted(df.columns))).cast("decimal(38,0)"))).first()
        return [str(row[0]), str(row[1])]

    def replicate(self, target: str) -> dict:
        """Copies the current version to another folder and publishes it there once every table has the same rows, by number and digest.

        The copy names the version that it was made from, by which
        ``is_replica_of`` tells whether it is up to date.
        """
        source = self.manifest()
        other = Store(self.spark, target)
        base = other.manifest()
        version = base["version"] + 1
        entries = {}
        for name in source["tables"]:
            df = self.table(name, source)
            part = other._write(name, df, version)
            if self.fingerprint(df) != self.fingerprint(self.spark.read.parquet(part["path"])):
                raise ValueError(f"replica of {name} differs")
            entries[name] = {"parts": [part], "gone": []}
        manifest = {"version": version, "tables": entries, "source": self.root, "source_version": source["version"], "at": time.time()}
        other.write_text(other._version_path(version), json.dumps(manifest), overwrite=False)
        return manifest

    def is_replica_of(self, source: Store) -> bool:
        m = self.manifest()
        return m.get("source") == source.root and m.get("source_version") == source.manifest()["version"]
