"""Reading corpus splits, keeping source order, and combining sources
(S1-S3, P1, P2, P4, U1).

Spark has no row order, but every operator that the reference bases on
"position in the split" (first N rows, default speaker names, stable ties)
needs one. ``read_corpus`` therefore adds ``pos``: the 0-based row position
in file order, computed from the parquet scan's own ``_metadata.row_index``
plus the row count of the files before it. No shuffle of the corpus is
needed: the per-file count table has one row per file.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .identity import code_digest, files_digest

log = logging.getLogger(__name__)


def _cores(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def few_splits(scan: DataFrame) -> bool:
    """True when a bare file scan has fewer input splits than the cluster
    has cores. Ask only of a scan: on a plan with exchanges, turning it into
    an RDD would run those stages."""
    return scan.rdd.getNumPartitions() < _cores(scan)


def spread(df: DataFrame, scan: DataFrame | None = None) -> DataFrame:
    """Spread rows over the cluster's cores before CPU-heavy row-local work
    when the underlying scan (``scan``, default ``df``) has few splits (a
    single-row-group file is one task). A many-file corpus is left alone:
    no shuffle."""
    if few_splits(df if scan is None else scan):
        return df.repartition(_cores(df))
    return df


def read_table(spark: SparkSession, path: str | Sequence[str], schema: StructType | str | None = None,
               spread_out: bool = True) -> DataFrame:
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.parquet(*_paths(path))
    return spread(df) if spread_out else df


def read_corpus(spark: SparkSession, path: str | Sequence[str], schema: StructType | str | None = None,
                source_no: int = 0, position: bool = True) -> DataFrame:
    """Scan a parquet split with an optional declared schema; add
    ``source_no`` and ``pos`` (0-based row position in file order)."""
    raw = read_table(spark, path, schema, spread_out=False)
    df = with_source_position(raw) if position else raw
    return spread(df, scan=raw).withColumn("source_no", F.lit(source_no))


def with_source_position(raw: DataFrame, name: str = "pos") -> DataFrame:
    """Add the 0-based row position in file order to a parquet scan."""
    data_cols = raw.columns
    df = raw.select(*data_cols,
                    F.col("_metadata.file_path").alias("_src_file"),
                    F.col("_metadata.row_index").alias("_src_row"))
    n_files = len(raw.inputFiles())
    if n_files <= 1:
        return df.withColumn(name, F.col("_src_row")).drop("_src_file", "_src_row")
    files = df.groupBy("_src_file").agg(F.count(F.lit(1)).alias("_src_n"))
    before = Window.orderBy("_src_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("_src_file",
                           F.coalesce(F.sum("_src_n").over(before), F.lit(0)).alias("_src_off"))
    return (df.join(offsets, "_src_file")
              .withColumn(name, F.col("_src_off") + F.col("_src_row"))
              .drop("_src_file", "_src_row", "_src_off"))


def head(df: DataFrame, n: int, pos_col: str = "pos") -> DataFrame:
    """The first ``n`` rows of a split in source order (``train[:n]``).
    A filter on the position column, so no single task gathers the rows."""
    return df.where(F.col(pos_col) < F.lit(n))


def read_head(spark: SparkSession, path: str | Sequence[str], n: int, schema: StructType | str | None = None,
              source_no: int = 0) -> DataFrame:
    """S1 and S2 together: the first ``n`` rows of a split. Rows are first
    counted by file, which reads no column; of several files only those that
    begin before row ``n`` are opened (they are the first in path order, so
    positions stay the same)."""
    raw = read_table(spark, path, schema, spread_out=False)
    if len(raw.inputFiles()) > 1:
        files = raw.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count(F.lit(1)).alias("n"))
        before = Window.orderBy("f").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
        needed = files.select("f", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("b")) \
            .where(F.col("b") < n).orderBy("f").collect()
        if needed:
            path = [r["f"] for r in needed]
    return head(read_corpus(spark, path, schema, source_no), n)


def rename(df: DataFrame, mapping: dict[str, str], if_exists: bool = True) -> DataFrame:
    """Rename columns; with ``if_exists=False`` a missing name raises."""
    if not if_exists:
        missing = [c for c in mapping if c not in df.columns]
        if missing:
            raise KeyError(f"columns not found: {missing}")
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def keep(df: DataFrame, cols: Sequence[str], always: Sequence[str] = ("source_no", "pos")) -> DataFrame:
    """Keep-list projection in the frame's own column order (the
    bookkeeping columns ``source_no``/``pos`` are kept as well)."""
    wanted = set(cols) | set(always)
    return df.select(*[c for c in df.columns if c in wanted])


def default_speaker(df: DataFrame, speaker_col: str = "speaker_id", pos_col: str = "pos") -> DataFrame:
    """``speaker_<pos>`` only when the speaker column is absent; a null
    speaker in an existing column stays null (it is an ordinary group)."""
    if speaker_col in df.columns:
        return df
    return df.withColumn(speaker_col, F.concat(F.lit("speaker_"), F.col(pos_col).cast("string")))


def concat_sources(dfs: Sequence[DataFrame]) -> DataFrame:
    """Concatenate sources by column name; duplicates kept, missing
    columns null-filled. A column whose type differs between sources raises
    (Spark alone would cast one side and fail later, or lose values).
    Source order is ``(source_no, pos)``."""
    if not dfs:
        raise ValueError("no sources")
    types: dict[str, str] = {}
    for d in dfs:
        for f in d.schema.fields:
            kind = f.dataType.simpleString()
            if types.setdefault(f.name, kind) != kind:
                raise TypeError(f"column {f.name}: {types[f.name]} in one source, {kind} in another")
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


@dataclass
class SourceSpec:
    """One corpus source: where it is, how to adapt its columns. ``reads``
    names what ``prepare`` reads beside the source (paths of tables that it
    joins, say), so that a saved stage is not taken for current when those
    have changed."""
    path: str
    rename: dict[str, str] = field(default_factory=dict)
    keep: Sequence[str] | None = None
    head: int | None = None
    schema: StructType | str | None = None
    prepare: Callable[[DataFrame], DataFrame] | None = None
    reads: Sequence[str] = ()


def source_identity(spark: SparkSession, spec: SourceSpec) -> dict:
    """What the rows of a source depend on, without a job: its files and
    those of ``reads``, how it is adapted, and the code that does it. A
    source without files has the files None."""
    return {"path": spec.path, "files": files_digest(spark, spec.path), "rename": spec.rename,
            "keep": None if spec.keep is None else list(spec.keep), "head": spec.head, "schema": str(spec.schema),
            "reads": [[p, files_digest(spark, p)] for p in spec.reads], "prepare": code_digest(spec.prepare)}


def still_skipped(spark: SparkSession, specs: Sequence[SourceSpec], skipped: Sequence[str]) -> bool:
    """Whether the sources that a saved stage lacks still cannot be read.
    (That a missing one has files now shows in its identity; one that had
    files but could not be read may be readable by now.)"""
    for spec in specs:
        if any(s.startswith(f"{spec.path}: ") for s in skipped) and files_digest(spark, spec.path) is not None:
            try:
                check_files(spark, spec)
            except (PySparkException, Py4JJavaError, BrokenSource):
                continue
            return False
    return True


class BrokenSource(Exception):
    """A source with files that are not Parquet."""


def check_files(spark: SparkSession, spec: SourceSpec) -> None:
    """Raise when a file of the source has no readable footer. The files
    are counted where they are read, by one task each or so, without a
    column; a file that Spark has to leave out is looked at again, since one
    without rows is left out as well."""
    reader = spark.read.option("ignoreCorruptFiles", "true")
    if spec.schema is not None:
        reader = reader.schema(spec.schema)
    df = reader.parquet(*_paths(spec.path))
    files = df.select(F.col("_metadata.file_path").alias("f"))
    listed = df.inputFiles()
    if files.agg(F.count_distinct("f")).first()[0] == len(listed):
        return
    seen = {r["f"] for r in files.distinct().collect()}
    broken = []
    for path in sorted(set(listed) - {_plain(f) for f in seen} - seen):
        try:
            spark.read.parquet(path).schema
        except (PySparkException, Py4JJavaError):
            broken.append(path.rsplit("/", 1)[1])
    if broken:
        raise BrokenSource(", ".join(broken[:10]) + (f" and {len(broken) - 10} more" if len(broken) > 10 else ""))


def _plain(path: str) -> str:
    """``inputFiles`` writes local paths with three slashes, the metadata
    column with one or three."""
    return path.replace("file:///", "file:/", 1) if path.startswith("file:///") else path.replace("file:/", "file:///", 1)


def _paths(path: str | Sequence[str]) -> list[str]:
    return [path] if isinstance(path, str) else list(path)


def load_sources(spark: SparkSession, specs: Sequence[SourceSpec],
                 fallback: SourceSpec | None = None) -> tuple[DataFrame, list[str]]:
    """S3: load each source; one that cannot be read (missing, or with a
    file that is not what it claims to be) is skipped whole and reported,
    with the files at fault. When none loads, the fallback source is read in
    full (the enhanced pipeline) or, without one, an error is raised (voices
    pipeline). Errors in adapting a source that was read are errors of the
    caller and are raised.

    Returns the union and the list of skipped sources with their error."""
    frames, skipped = [], []
    for i, spec in enumerate(specs):
        try:
            raw = _read_one(spark, spec, i)
        except (PySparkException, Py4JJavaError, BrokenSource) as exc:  # whatever the reader raises
            log.warning("source %s skipped: %s", spec.path, exc)
            skipped.append(f"{spec.path}: {type(exc).__name__}" + (f" ({exc})" if isinstance(exc, BrokenSource) else ""))
            continue
        frames.append(_adapt(raw, spec))
    if frames:
        return concat_sources(frames), skipped
    if fallback is None:
        raise RuntimeError("no source could be loaded")
    full = SourceSpec(fallback.path, fallback.rename, fallback.keep, None,
                      fallback.schema, fallback.prepare)
    return _adapt(_read_one(spark, full, 0), full), skipped


def _read_one(spark: SparkSession, spec: SourceSpec, source_no: int) -> DataFrame:
    """Resolve a source and look at every file's footer, so that a missing
    path, a bad schema or a file of another format fails here and not later."""
    check_files(spark, spec)
    return read_corpus(spark, spec.path, spec.schema, source_no) if spec.head is None else \
        read_head(spark, spec.path, spec.head, spec.schema, source_no)


def _adapt(df: DataFrame, spec: SourceSpec) -> DataFrame:
    if spec.prepare is not None:
        df = spec.prepare(df)
    df = rename(df, spec.rename)
    return df if spec.keep is None else keep(df, spec.keep)
