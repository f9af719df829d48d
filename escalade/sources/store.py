"""JSON-lines tables, artifacts, and a versioned table with backups, restore and keyed upsert."""

from __future__ import annotations

import json
import re
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.lexicon import BACKUPS_KEPT
from ..functions.scores import json_safe


def _fs(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path's class."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, path: str) -> bool:
    fs, path_of = _fs(spark, path)
    return fs.exists(path_of(path))


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, missing_ok: bool = False) -> DataFrame:
    """Rows of a JSON-lines table; blank lines are skipped, broken ones fail. A missing table is empty where that is allowed."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def in_file_order(rows: DataFrame, name: str) -> DataFrame:
    """Rows of files with a column that sorts them by file, then by place in the file: the rows of a file's block are numbered in order by the task that reads it."""
    return rows.withColumn(name, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")))


def load_config(spark: SparkSession, path: str) -> dict:
    """A YAML file, or a JSON one by its name."""
    text = _read_text(spark, path)
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ValueError(f"{path}: no YAML reader is installed; give the configuration as .json") from e
    return yaml.safe_load(text)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line, keys in order, NaN and infinities as null."""
    safe = [json_safe(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in sorted(df.dtypes)]
    df.select(*safe).write.mode("overwrite").json(path)


def write_artifact(spark: SparkSession, path: str, value: object) -> None:
    """A small result as indented JSON with sorted keys; NaN and infinities become null."""

    def safe(v: object) -> object:
        if isinstance(v, dict):
            return {k: safe(x) for k, x in v.items()}
        if isinstance(v, list | tuple):
            return [safe(x) for x in v]
        return None if isinstance(v, float) and (v != v or abs(v) == float("inf")) else v

    _write_text(spark, path, json.dumps(safe(value), indent=2, sort_keys=True, ensure_ascii=False) + "\n")


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, path_of = _fs(spark, path)
    out = fs.create(path_of(path), True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    """A small file as a whole."""
    return spark.read.option("wholetext", True).text(path).first()["value"]


def signals_path(spark: SparkSession, base: str, role: str, model_role: str) -> str:
    """The table of a role and model role, else the older one of the role alone, else the former."""
    preferred, older = f"{base}/{role}_{model_role}", f"{base}/{role}"
    return older if not exists(spark, preferred) and exists(spark, older) else preferred


def load_corpus(spark: SparkSession, base: str, schema: StructType | str, roles: tuple[str, ...] = ("fit", "calib", "eval"), limit: int | None = None) -> DataFrame:
    """The role partitions of a corpus, each cut to its first rows by ordinal where a limit is given."""
    parts = [in_file_order(read_jsonl(spark, f"{base}/queries_{r}.jsonl", schema), "__pos") for r in roles]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    if limit is None:
        return out.drop("__pos")
    from ..operators.corpus import head_per_role

    return head_per_role(out, limit, "__pos").drop("__pos")


def upserted(old: DataFrame, new: DataFrame, key: str = "query_id") -> DataFrame:
    """Old rows whose key is not among the new ones, and the new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def todo(rows: DataFrame, done: DataFrame, key: str = "query_id") -> DataFrame:
    return rows.join(done.select(key), key, "left_anti")


class VersionedTable:
    """A table whose every write is a new version directory; a pointer file names the live one.

    Readers never see half a write: the pointer moves after the version is complete. Versions that are no longer
    live are the backups; the newest `keep` stay. Restoring moves the pointer, the version that was live stays a backup.
    """

    def __init__(self, spark: SparkSession, base: str, schema: StructType | str, keep: int = BACKUPS_KEPT):
        self.spark, self.base, self.schema, self.keep = spark, base.rstrip("/"), schema, keep

    @property
    def live(self) -> str | None:
        return _read_text(self.spark, f"{self.base}/CURRENT").strip() if exists(self.spark, f"{self.base}/CURRENT") else None

    def read(self) -> DataFrame:
        name = self.live
        return self.spark.read.schema(self.schema).parquet(f"{self.base}/versions/{name}") if name else self.spark.createDataFrame([], self.schema)

    def versions(self) -> list[str]:
        """All versions, newest first."""
        root = f"{self.base}/versions"
        if not exists(self.spark, root):
            return []
        fs, path_of = _fs(self.spark, root)
        order = lambda v: (m[1], int(m[2] or 0)) if (m := re.fullmatch(r"(.*?Z)(?:_(\d+))?", v)) else (v, 0)
        return sorted((s.getPath().getName() for s in fs.listStatus(path_of(root)) if s.isDirectory()), key=order, reverse=True)

    def backups(self) -> list[str]:
        return [v for v in self.versions() if v != self.live]

    def write(self, rows: DataFrame) -> str:
        """A new live version; the one before becomes a backup."""
        stamp, there = datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ"), set(self.versions())
        name, n = stamp, 1
        while name in there:
            name, n = f"{stamp}_{n}", n + 1
        rows.write.mode("errorifexists").parquet(f"{self.base}/versions/{name}")
        self._point(name)
        self.prune()
        return name

    def upsert(self, new: DataFrame, key: str = "query_id") -> str:
        return self.write(upserted(self.read(), new, key))

    def restore(self, name: str | None = None, dry_run: bool = False) -> str:
        """Makes a backup live, the newest by default."""
        there = self.backups()
        chosen = name or (there[0] if there else None)
        if chosen not in there:
            raise ValueError(f"no backup {chosen!r}")
        if not dry_run:
            self._point(chosen)
        return chosen

    def prune(self) -> list[str]:
        fs, path_of = _fs(self.spark, self.base)
        old = self.backups()[self.keep :]
        for v in old:
            fs.delete(path_of(f"{self.base}/versions/{v}"), True)
        return old

    def _point(self, name: str) -> None:
        fs, path_of = _fs(self.spark, self.base)
        _write_text(self.spark, f"{self.base}/CURRENT.tmp", name)
        live = path_of(f"{self.base}/CURRENT")
        if not fs.rename(path_of(f"{self.base}/CURRENT.tmp"), live):  # some file systems do not replace
            fs.delete(live, False)
            fs.rename(path_of(f"{self.base}/CURRENT.tmp"), live)
