"""Stage materialisation (S4): reuse a saved stage unless forced.

The reference caches each stage in a file named only after the stage, so a
changed threshold silently reuses old rows. Here a stage's folder name
carries a hash of everything its rows depend on: the parameters and code that
the caller names (see ``identity``), the files of its sources, and the key of
the stage before it. A change of any is a miss.

Every build writes a version folder of its own and then a small manifest in
it, which is what makes it count. So a build that fails or is killed leaves
what was there; a forced one does not touch files that others are reading;
and no rename is needed, which object stores lack. The manifest holds the
schema (a hit therefore reads no footer and runs no job), the counts observed
while the rows were written, and whatever the builder adds.

Stages are written with the Hadoop file system of the path, so a shared
folder (HDFS, object store) works the same as a local one. Writing a stage
also cuts the lineage: later steps read the files, so a lost executor
recomputes from the stage, not from the sources.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.types import StructType

from ..session import stable

#: the manifest of a version; Spark's readers skip names with an underscore
MARKER = "_PARLANCE_STAGE"


@dataclass
class Stage:
    name: str
    key: str
    path: str
    reused: bool
    df: DataFrame
    info: dict = field(default_factory=dict)
    version: str = ""

    @property
    def upstream(self) -> str:
        """What a stage that is built on this one passes as ``upstream``: the
        rows may differ from version to version."""
        return f"{self.key}/{self.version}"


@dataclass
class Built:
    """What a builder may return beside the rows: ``info`` (plain values)
    goes into the manifest; ``counts`` are aggregates, by name, that are
    observed while the rows are written and then stand in ``info``."""
    df: DataFrame
    info: dict = field(default_factory=dict)
    counts: dict[str, Column] = field(default_factory=dict)


def stage_key(name: str, params: dict | None = None, upstream: str | None = None) -> str:
    blob = json.dumps({"name": name, "params": params or {}, "upstream": upstream},
                      sort_keys=True, default=str)
    return hashlib.sha256(blob.encode()).hexdigest()[:16]


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    jvm = spark.sparkContext._jvm
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _versions(spark: SparkSession, path: str) -> list[str]:
    """The version folders of a stage, the newest first (names begin with
    the time), finished or not."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory()]
    return [f"{path}/{n}" for n in sorted(names, reverse=True) if n.startswith("v-")]


def _manifest(spark: SparkSession, version: str) -> dict | None:
    """A version's manifest; None where it is missing or was cut off."""
    try:
        return json.loads(_read_text(spark, f"{version}/{MARKER}") or "null")
    except json.JSONDecodeError:
        return None


def _open(spark: SparkSession, name: str, key: str, path: str, version: str, manifest: dict, reused: bool) -> Stage:
    schema = StructType.fromJson(manifest["schema"])
    return Stage(name, key, path, reused, spark.read.schema(schema).parquet(version), manifest["info"],
                 version.rsplit("/", 1)[1])


def stage(spark: SparkSession, name: str, build: Callable[[], DataFrame | Built], root: str,
          params: dict | None = None, upstream: str | None = None, force: bool = False,
          accept: Callable[[dict], bool] | None = None) -> Stage:
    """Return the stage's rows, built and written only on a miss. ``build``
    is not called on a hit. ``accept`` may refuse a saved version by its
    info."""
    key = stage_key(name, params, upstream)
    path = f"{root.rstrip('/')}/{name}-{key}"
    if not force:
        for version in _versions(spark, path):
            manifest = _manifest(spark, version)
            if manifest is None:
                continue
            if accept is None or accept(manifest["info"]):
                return _open(spark, name, key, path, version, manifest, True)
            break  # an older one is no better
    built = build()
    if not isinstance(built, Built):
        built = Built(built)
    version = f"{path}/v-{int(time.time() * 1000):013d}-{uuid.uuid4().hex[:8]}"
    df, seen = built.df, None
    if built.counts:
        seen = Observation()
        df = df.observe(seen, *[c.alias(n) for n, c in built.counts.items()])
    df.write.parquet(version)
    manifest = {"schema": json.loads(built.df.schema.json()),
                "info": built.info | (dict(seen.get) if seen is not None else {})}
    _write_text(spark, f"{version}/{MARKER}", json.dumps(manifest))
    return _open(spark, name, key, path, version, manifest, False)


def materialise(spark: SparkSession, name: str, build: Callable[[], DataFrame | Built], root: str | None = None,
                params: dict | None = None, upstream: str | None = None, force: bool = False,
                accept: Callable[[dict], bool] | None = None) -> Stage:
    """:func:`stage` under ``root``; without one, a checkpoint of this run,
    with the same info and counts."""
    if root is not None:
        return stage(spark, name, build, root, params, upstream, force, accept)
    built = build()
    if not isinstance(built, Built):
        built = Built(built)
    if not built.counts:
        return Stage(name, "", "", False, stable(built.df), built.info)
    seen = Observation()
    df = stable(built.df.observe(seen, *[c.alias(n) for n, c in built.counts.items()]))
    return Stage(name, "", "", False, df, built.info | dict(seen.get))


def prune_stages(spark: SparkSession, root: str, older_than_seconds: float = 7 * 86400) -> list[str]:
    """Delete what no run needs any more: versions that a newer one has
    replaced, and unfinished ones, once they are ``older_than_seconds``
    (a reader or a writer may still be at them). Return what was removed."""
    fs, p = _fs(spark, root)
    limit, removed = (time.time() - older_than_seconds) * 1000, []
    for st in fs.listStatus(p) if fs.exists(p) else []:
        done = False
        for version in _versions(spark, str(st.getPath())) if st.isDirectory() else []:
            finished = _manifest(spark, version) is not None
            if (done or not finished) and int(version.rsplit("/v-", 1)[1][:13]) <= limit:
                fs.delete(_fs(spark, version)[1], True)
                removed.append(version)
            done = done or finished
    return removed


def clear_stages(spark: SparkSession, root: str) -> list[str]:
    """Delete the folders under ``root`` that :func:`stage` made (a version
    in them carries its manifest) and no others; return what was removed."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    removed = []
    for st in fs.listStatus(p):
        path = str(st.getPath())
        if st.isDirectory() and any(_fs(spark, f"{v}/{MARKER}")[0].exists(_fs(spark, f"{v}/{MARKER}")[1])
                                    for v in _versions(spark, path)):
            fs.delete(st.getPath(), True)
            removed.append(path)
    return removed
