"""What a saved stage depends on, as digests: files, and code.

Both are found without a Spark job, so that asking for a stage that is there
costs a few directory listings."""

from __future__ import annotations

import dataclasses
import functools
import hashlib
import inspect
import re
import sys
import sysconfig
import types
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession

# The fields of a listed file that tell whether it is still the same.
LISTED = re.compile(r"path=(.*?); isDirectory=(true|false)(?:; length=(\d+))?.*?; modification_time=(\d+)")
PLAIN = (type(None), bool, int, float, complex, str, bytes)


def _digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


# --- files ---------------------------------------------------------------------

def _entries(jvm, statuses) -> list[tuple[str, bool, str, str]]:
    """(path, is a folder, length, time) of listed files, read off the text
    of the whole listing, however many there are; of a file system whose
    listing reads otherwise, one by one."""
    found = LISTED.findall(jvm.org.apache.commons.lang3.ArrayUtils.toString(statuses))
    if len(found) == len(statuses):
        return [(p, folder == "true", size or "", time) for p, folder, size, time in found]
    return [(str(st.getPath()), st.isDirectory(), str(st.getLen()), str(st.getModificationTime())) for st in statuses]


def files_digest(spark: SparkSession, path: str | Sequence[str]) -> str | None:
    """Digest of the names, lengths and times of all files that Spark would
    read at ``path`` (a file, a folder, a pattern, or several); None when
    there are none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for one in [path] if isinstance(path, str) else path:
        start = jvm.org.apache.hadoop.fs.Path(one)
        fs = start.getFileSystem(conf)
        matched = fs.globStatus(start)
        work = [] if matched is None else _entries(jvm, matched)
        while work:
            name, folder, size, time = work.pop()
            if folder:
                inside = _entries(jvm, fs.listStatus(jvm.org.apache.hadoop.fs.Path(name)))
                # What Spark's readers skip does not count.
                work += [x for x in inside if x[0].rsplit("/", 1)[1][:1] not in ("_", ".")]
            else:
                found.append(f"{name} {size} {time}")
    return _digest(sorted(found)) if found else None


# --- code ----------------------------------------------------------------------

@functools.cache
def _is_library(file: str | None) -> bool:
    return file is None or "site-packages" in file or file.startswith((sysconfig.get_paths()["stdlib"], "<frozen", "<string"))


def _module_is_library(module: types.ModuleType | None) -> bool:
    return module is None or _is_library(getattr(module, "__file__", None))


def code_digest(*values) -> str:
    """Digest of functions and of the values they use: their code, defaults
    and closures, and the functions and constants of the project's own
    modules that they name, so that a changed threshold or helper shows.
    Library code counts by name. A Spark session is the same whichever it
    is; an object without a value of its own (whose text holds its place in
    memory) is new in every session, which is safe."""
    out: list[str] = []
    seen: set[int] = set()
    for value in values:
        _code_parts(value, out, seen)
    return _digest(out)


def _code_parts(value, out: list[str], seen: set[int]) -> None:
    def each(kind: str, values) -> None:
        out.append(f"{kind}(")
        for v in values:
            _code_parts(v, out, seen)
        out.append(")")

    if isinstance(value, PLAIN):
        out.append(repr(value))
    elif isinstance(value, functools.partial):
        each("partial", (value.func, value.args, value.keywords))
    elif inspect.ismethod(value):
        each("method", (value.__func__, value.__self__))
    elif isinstance(value, types.FunctionType):
        _function_parts(value, out, seen)
    elif isinstance(value, types.CodeType):
        out.append(value.co_code.hex())
        each("names", value.co_names)
        each("consts", value.co_consts)
    elif isinstance(value, (list, tuple)):
        each("list", value)
    elif isinstance(value, (set, frozenset)):
        out.append(f"set{sorted(map(repr, value))}")
    elif isinstance(value, dict):
        each("dict", [x for item in sorted(value.items(), key=repr) for x in item])
    elif isinstance(value, (types.ModuleType, types.BuiltinFunctionType, type)):
        out.append(f"{type(value).__name__} {value.__name__}")
    elif dataclasses.is_dataclass(value):
        each(type(value).__qualname__, [getattr(value, f.name) for f in dataclasses.fields(value)])
    elif isinstance(value, SparkSession):
        out.append("session")
    elif isinstance(value, DataFrame):
        out.extend(_frame_parts(value))
    elif isinstance(value, Column):
        out.append(str(value))
    elif hasattr(value, "__wrapped__"):  # a cached or decorated function
        _code_parts(value.__wrapped__, out, seen)
    else:
        out.append(repr(value))


def _frame_parts(df: DataFrame) -> list[str]:
    """Plan and files of a frame. Rows that it holds itself (made from
    Python values, or a checkpoint) are not in the plan: such a frame is new
    every time."""
    plan = df._jdf.queryExecution().analyzed()
    leaves = plan.collectLeaves()
    names = [leaves.apply(i).getClass().getSimpleName() for i in range(leaves.size())]
    own = [uuid.uuid4().hex] if {"LocalRelation", "LogicalRDD"} & set(names) else []
    return [re.sub(r"#\d+L?", "", plan.toString()), *sorted(df.inputFiles()), *own]


def _names(code: types.CodeType) -> list[str]:
    inner = [n for c in code.co_consts if isinstance(c, types.CodeType) for n in _names(c)]
    return [*code.co_names, *inner]


def _function_parts(fn: types.FunctionType, out: list[str], seen: set[int]) -> None:
    out.append(f"function {fn.__module__}.{fn.__qualname__}")
    if _is_library(fn.__code__.co_filename) or id(fn.__code__) in seen:
        return
    seen.add(id(fn.__code__))
    for part in (fn.__code__, fn.__defaults__, fn.__kwdefaults__):
        _code_parts(part, out, seen)
    for cell in fn.__closure__ or ():
        _code_parts(cell.cell_contents, out, seen)
    names = dict.fromkeys(_names(fn.__code__))
    for name in names:
        value = fn.__globals__.get(name)
        if isinstance(value, types.ModuleType) and not _module_is_library(value):
            for other in names:
                found = getattr(value, other, None)
                if not isinstance(found, types.ModuleType) and _is_own(found):
                    out.append(f"{value.__name__}.{other}")
                    _code_parts(found, out, seen)
        elif _is_own(value):
            out.append(name)
            _code_parts(value, out, seen)


def _is_own(value) -> bool:
    """A constant, or something the project defines."""
    if value is None:
        return False
    if isinstance(value, (*PLAIN, list, tuple, set, frozenset, dict, functools.partial)):
        return True
    if isinstance(value, types.FunctionType):
        return not _is_library(value.__code__.co_filename)
    return not _module_is_library(sys.modules.get(getattr(value, "__module__", None) or ""))
