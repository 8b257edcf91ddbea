"""The file source: which files there are, which handler reads each, and what is left out."""

from __future__ import annotations

import fnmatch
import pathlib
import posixpath
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.text import is_generated

#: Folders that are never read, and those that are not read unless asked for.
HARD_EXCLUDES = [".git", ".lorekeep"]
DEFAULT_EXCLUDES = "node_modules vendor target build dist out __pycache__ .venv venv .next .nuxt .svelte-kit .dart_tool .idea .vscode coverage .turbo .nx .yarn .cache .parcel-cache".split()
DEFAULT_GLOBS = ["*.egg-info", "bazel-*"]


def glob_regex(pattern: str) -> str:
    """The whole-path regular expression of a glob in which * and ? stay within a folder."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            end = pattern.find("]", i + 1)
            if end < 0:
                out += r"\["
            else:
                out += "[" + pattern[i + 1 : end].replace("\\", r"\\") + "]"
                i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def matches_glob(path: Column, pattern: str) -> Column:
    """A glob on the path; one with ** means that the rest of it occurs anywhere."""
    hit = path.rlike(glob_regex(pattern)) if pattern.count("[") == pattern.count("]") else F.lit(False)
    return hit | path.contains(pattern.replace("**", "")) if "**" in pattern else hit


def in_excluded_folder(path: Column, names: Iterable[str], globs: Iterable[str]) -> Column:
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    hit = F.arrays_overlap(folders, F.array(*map(F.lit, names)))
    for g in globs:
        hit = hit | F.exists(folders, _like(glob_regex(g)))
    return hit


def _like(pattern: str) -> Callable[[Column], Column]:
    return lambda x: x.rlike(pattern)


@dataclass
class IgnoreRules:
    """Lines of ignore files, in the order in which they bind; the last that fits a path decides."""

    rules: list[tuple[str, bool]] = field(default_factory=list)

    def add(self, folder: str, text: str) -> None:
        """The lines of ``folder``'s ignore file. Files of outer folders are added before those of inner ones."""
        prefix = folder.strip("/")
        for line in text.splitlines():
            line = line.rstrip() if not line.endswith("\\ ") else line
            if not line or line.startswith("#"):
                continue
            negated = line.startswith("!")
            line = line[1:] if negated else line.removeprefix("\\")
            only_folders = line.endswith("/")
            line = line.rstrip("/")
            anchored = "/" in line
            parts = [p for p in line.split("/") if p]
            if not parts:
                continue
            body = ""
            for k, p in enumerate(parts):
                body += ".*" if p == "**" and k == len(parts) - 1 else "(?:[^/]+/)*" if p == "**" else glob_regex(p)[1:-1] + ("/" if k < len(parts) - 1 else "")
            start = (re.escape(prefix) + "/" if prefix else "") + ("" if anchored else "(?:[^/]+/)*")
            self.rules.append((f"^{start}{body}" + ("/.*$" if only_folders else "(?:/.*)?$"), negated))

    def ignored(self, path: str) -> bool:
        out = False
        for pattern, negated in self.rules:
            if out is negated and re.match(pattern, path):
                out = not negated
        return out

    def column(self, path: Column) -> Column:
        """The same as an expression: each rule overrides those before."""
        out = F.lit(False)
        for pattern, negated in self.rules:
            out = F.when(path.rlike(pattern), F.lit(not negated)).otherwise(out)
        return out


@dataclass
class Registry:
    """Handlers by extension and by file name pattern. A file has one primary handler and maybe additional ones."""

    by_extension: dict[str, str] = field(default_factory=dict)
    by_name: list[tuple[str, str]] = field(default_factory=list)
    additional: dict[str, list[str]] = field(default_factory=dict)

    def handler_for(self, path: str) -> str | None:
        name = posixpath.basename(path)
        ext = posixpath.splitext(name)[1].lower()
        if ext in self.by_extension:
            return self.by_extension[ext]
        return next((h for pattern, h in self.by_name if fnmatch.fnmatchcase(name, pattern)), None)

    def handlers_for(self, path: str) -> list[str]:
        first = self.handler_for(path)
        more = self.additional.get(posixpath.splitext(path)[1].lower(), [])
        return [h for h in [first, *more] if h]

    def column(self, path: Column) -> Column:
        """The primary handler's name, null without one."""
        name = F.substring_index(path, "/", -1)
        ext = F.when(F.instr(name, ".") > 0, F.concat(F.lit("."), F.lower(F.substring_index(name, ".", -1))))
        out = F.lit(None).cast("string")
        for pattern, h in reversed(self.by_name):
            out = F.when(name.rlike(glob_regex(pattern)), F.lit(h)).otherwise(out)
        table = F.create_map(*(F.lit(x) for pair in self.by_extension.items() for x in pair)) if self.by_extension else None
        return F.coalesce(table[ext], out) if table is not None else out


def default_registry() -> Registry:
    from lorekeep.sources.handlers import BY_EXTENSION, BY_NAME, MORE

    return Registry(dict(BY_EXTENSION), list(BY_NAME), {k: list(v) for k, v in MORE.items()})


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, length) of all files under a folder; the path is relative to it. Spark's own listing leaves out
    names that begin with a dot or an underscore; those come from ``skipped_files``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1]
    rows = files.select(F.regexp_replace(F.col("path"), "^.*?" + re.escape(base) + "/", "").alias("path"), "content", "length")
    return rows.unionByName(skipped_files(spark, root))


def skipped_files(spark: SparkSession, root: str) -> DataFrame:
    """The files with a dot or an underscore before a part of their path, except in folders that are never read. The
    driver lists their names; executors read local ones, the driver those of other file systems."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, todo = [], [(top, "", False)]
    while todo:
        folder, rel, hidden = todo.pop()
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            path, odd = f"{rel}{name}", hidden or name[0] in "._"
            if status.isDirectory():
                if name not in HARD_EXCLUDES and name not in DEFAULT_EXCLUDES:
                    todo.append((status.getPath(), f"{path}/", odd))
            elif odd:
                found.append((path, status.getPath()))
    schema = "path string, content binary, length long"
    if fs.getScheme() == "file":
        names = spark.createDataFrame([(p, full.toUri().getPath()) for p, full in found], "path string, full string")

        def read(batches):
            for b in batches:
                data = [pathlib.Path(x).read_bytes() for x in b["full"]]
                yield pd.DataFrame({"path": b["path"], "content": data, "length": [len(x) for x in data]})

        return names.mapInPandas(read, schema)
    rows = []
    for path, full in found:
        stream = fs.open(full)
        try:
            data = bytes(stream.readAllBytes())
        finally:
            stream.close()
        rows.append((path, data, len(data)))
    return spark.createDataFrame(rows, schema)


def walk(files: DataFrame, registry: Registry, excludes: Iterable[str] = (), ignore: IgnoreRules | None = None, roots: Iterable[str] = (), skip_handlers: Iterable[str] = ()) -> DataFrame:
    """``files`` that some handler reads, with its name, without excluded and ignored ones; each path once."""
    path = F.col("path")
    rows = files.where(~in_excluded_folder(path, [*HARD_EXCLUDES, *DEFAULT_EXCLUDES], DEFAULT_GLOBS))
    for e in excludes:
        rows = rows.where(~matches_glob(path, e))
    if ignore and ignore.rules:
        rows = rows.where(~ignore.column(path))
    within = [r.strip("/") for r in roots]
    if within:
        hit = F.lit(False)
        for r in within:
            hit = hit | (path == r) | path.startswith(f"{r}/") if r not in ("", ".") else F.lit(True)
        rows = rows.where(hit)
    rows = rows.withColumn("handler", registry.column(path)).where("handler IS NOT NULL")
    if skip := list(skip_handlers):
        rows = rows.where(~F.col("handler").isin(*skip))
    return rows.dropDuplicates(["path"])


def ignore_rules(files: DataFrame) -> IgnoreRules:
    """Of a project's ignore files, of which there are as many as folders that have one."""
    rows = files.where(F.col("path").rlike(r"(^|/)\.gitignore$")).select("path", F.decode("content", "UTF-8").alias("text")).collect()
    rules = IgnoreRules()
    for r in sorted(rows, key=lambda r: (r["path"].count("/"), r["path"])):
        rules.add(posixpath.dirname(r["path"]), r["text"])
    return rules


def without_generated(files: DataFrame) -> DataFrame:
    return files.where(~is_generated(F.decode(F.substring("content", 1, 4096), "UTF-8")))


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """(hash, subject, body) of a log whose records end with \\x1e and whose fields are parted by \\x1f."""
    parts = F.split("value", "\x1f")
    rows = spark.read.option("lineSep", "\x1e").text(path).select(parts.alias("p")).where(F.size("p") >= 2)
    return rows.select(F.trim(F.get("p", F.lit(0))).alias("hash"), F.trim(F.get("p", F.lit(1))).alias("subject"), F.trim(F.coalesce(F.get("p", F.lit(2)), F.lit(""))).alias("body"))


def closed_issues(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, detail) of closed issues; the detail is the reason, else the description."""
    schema = "id string, title string, description string, status string, close_reason string"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).where("status = 'closed'")
    return rows.select("id", "title", F.coalesce(F.nullif(F.trim("close_reason"), F.lit("")), F.col("description"), F.lit("")).alias("detail"))


def python_source_roots(text: str) -> list[str]:
    """Source folders that a pyproject file names, for setuptools, poetry and hatch."""
    import tomllib

    try:
        tool = tomllib.loads(text).get("tool", {})
    except tomllib.TOMLDecodeError:
        return []
    st = tool.get("setuptools", {})
    found = list((st.get("packages", {}).get("find", {}) if isinstance(st.get("packages"), dict) else {}).get("where", []))
    found += [v for v in (st.get("package-dir") or {}).values()]
    for p in tool.get("poetry", {}).get("packages", []) or []:
        found.append(p.get("from", "."))
    wheel = tool.get("hatch", {}).get("build", {}).get("targets", {}).get("wheel", {})
    found += list(wheel.get("sources", []) if isinstance(wheel.get("sources"), list) else wheel.get("sources", {}))
    found += [posixpath.dirname(p) or "." for p in wheel.get("packages", []) or []]
    return list(dict.fromkeys(x.strip("/") or "." for x in found if isinstance(x, str)))
