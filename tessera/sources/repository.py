"""Files of repositories as rows: listed in tasks without entering ignored folders, judged by name, and only then read."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import ScanConfig
from ..functions.text import matches_any, suffix
from .shared import stored


def marked(files: DataFrame, extensions: tuple[str, ...], patterns: list[str] | tuple[str, ...] = (), ignored_dirs: tuple[str, ...] = (), binary: Column | None = None) -> DataFrame:
    """``files`` (path) with ``reason``: the first rule that leaves a file out (dir, ext, pattern, binary), null if it stays."""
    inside = F.lit(False)
    if ignored_dirs:
        inside = F.arrays_overlap(F.slice(F.split("path", "/"), F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0))), F.array(*[F.lit(d) for d in ignored_dirs]))
    reason = F.when(inside, "dir").when(~suffix(F.col("path")).isin(*extensions), "ext").when(matches_any(F.col("path"), list(patterns)), "pattern")
    if binary is not None:
        reason = reason.when(binary, "binary")
    return files.withColumn("reason", reason)


def counts(files: DataFrame) -> DataFrame:
    """One row of counters over marked files; a limit on returned files doesn't change it."""
    outside = F.coalesce(F.col("reason") != "dir", F.lit(True))
    names = ("dir", "ext", "pattern", "binary")
    return files.agg(F.count_if(outside).alias("seen"), *[F.count_if(F.col("reason") == n).alias(f"ignored_{n}") for n in names], F.count_if(F.col("reason").isNull()).alias("kept"))


def looks_binary(content: Column) -> Column:
    """Whether the first 4096 bytes hold a zero byte."""
    return F.locate("00", F.regexp_replace(F.hex(F.substring(content, 1, 4096)), "(..)", "$1 ")) % 3 == 1


def decoded(content: Column) -> Column:
    """UTF-8 where the bytes are valid, without a byte order mark, else Latin-1; line ends unified."""
    text = F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")


_LISTED = "repo string, root string, path string, size_bytes long, mtime double, reason string, error string"
#: Bytes of files that a task reads, and bytes of a file beyond which it isn't read.
TASK_BYTES, MOST_BYTES = 64 << 20, 64 << 20
#: Bytes of contents that are handed over together.
BATCH_BYTES = 8 << 20


def listing(spark: SparkSession, roots: Mapping[str, str], config: ScanConfig | None = None) -> DataFrame:
    """A row for each file below each root (repo to folder), and one for each folder that is left out; nothing is read.

    Returns repo, root, path (relative), size_bytes, mtime, reason and error. Folders of ignored names are not entered (reason
    ``dir``), links are not followed, and what can't be listed is a row with reason ``unlisted`` and the error. Each root is
    walked by a task of its own, through any file system that pyarrow knows by the root's address. (Spark's own file reader
    would leave out names that begin with a dot or an underscore, and read folders that are ignored.)
    """
    config = config or ScanConfig()
    ignored = set(config.ignored_dirs)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for repo, root in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                try:
                    system, base = opened(root)
                    waiting = [base]
                except (OSError, pa.ArrowException) as failure:
                    waiting, rows = [], [(repo, root, "", None, None, "unlisted", str(failure))]
                while waiting:
                    folder = waiting.pop()
                    try:
                        found = system.get_file_info(fs.FileSelector(folder))
                    except (OSError, pa.ArrowException) as failure:
                        rows.append((repo, root, folder[len(base) :].strip("/"), None, None, "unlisted", str(failure)))
                        continue
                    for entry in found:
                        path = entry.path[len(base) :].strip("/")
                        if entry.type == fs.FileType.Directory:
                            if entry.base_name in ignored:
                                rows.append((repo, root, path, None, None, "dir", None))
                            elif not linked(system, entry.path):
                                waiting.append(entry.path)
                        elif entry.type == fs.FileType.File:
                            rows.append((repo, root, path, entry.size, entry.mtime_ns / 1e9 if entry.mtime_ns is not None else None, None, None))
                    if len(rows) > 10_000:
                        yield as_batch(rows)
                        rows = []
                if rows:
                    yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _LISTED.split(", ")])

    named = spark.createDataFrame(sorted(roots.items()), "repo string, root string").repartition(max(1, len(roots)), "repo")
    return _judged(named.mapInArrow(walk, _LISTED), config)


def _judged(found: DataFrame, config: ScanConfig) -> DataFrame:
    """Files that stay so far have no reason; folders and failures keep theirs."""
    files = marked(found.withColumnRenamed("reason", "_own"), config.extensions, config.ignored_patterns)
    return files.withColumn("reason", F.coalesce("_own", "reason")).select(*[x.split()[0] for x in _LISTED.split(", ")])


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address or a local folder, and the folder's path there; an error if it isn't one."""
    system, base = fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", root) if root.startswith("file:") else root)
    if system.get_file_info(base).type != fs.FileType.Directory:
        raise FileNotFoundError(f"no folder: {root}")
    return system, base.rstrip("/")


def linked(system: fs.FileSystem, path: str) -> bool:
    return isinstance(system, fs.LocalFileSystem) and os.path.islink(path)


def contents(listed: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows of a listing with text: only files without a reason are read, in tasks of about ``TASK_BYTES``.

    A filter on ``listed`` thus keeps contents from being read. A file beyond ``most_bytes`` has reason ``large``, one with a
    zero byte in its first 4096 ``binary``, one that can't be read ``unreadable`` with the error; their text is null.
    """
    waiting = listed.where("reason IS NULL")
    # one number reaches the driver
    total = waiting.agg(F.sum(F.least("size_bytes", F.lit(most_bytes))).alias("n")).first().n or 0
    dealt = waiting.repartition(max(1, -(-total // TASK_BYTES)), "repo", "path")
    names = [x.split()[0] for x in _LISTED.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        systems: dict[str, tuple] = {}
        for batch in batches:
            rows, held = [], 0
            for repo, root, path, size, mtime, reason, error in zip(*[batch.column(n).to_pylist() for n in names], strict=True):
                content = None
                if size is not None and size > most_bytes:
                    reason = "large"
                else:
                    try:
                        system, base = systems.get(root) or systems.setdefault(root, opened(root))
                        with system.open_input_stream(f"{base}/{path}") as stream:
                            content = stream.read()
                    except (OSError, pa.ArrowException) as failure:
                        reason, error = "unreadable", str(failure)
                if content is not None and b"\0" in content[:4096]:
                    content, reason = None, "binary"
                rows.append((repo, root, path, size, mtime, reason, error, content))
                held += len(content or b"")
                if held > BATCH_BYTES:
                    yield as_batch(rows)
                    rows, held = [], 0
            if rows:
                yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.string(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [*names, "content"])

    found = dealt.mapInArrow(read, f"{_LISTED}, content binary")
    return found.withColumn("text", decoded(F.col("content"))).drop("content")


@dataclass(frozen=True)
class Scanned:
    """Files of several repositories: those with text, a row of counters for each repository, and a row for each failure."""

    files: DataFrame
    counts: DataFrame
    failures: DataFrame


def scan_all(spark: SparkSession, roots: Mapping[str, str], config: ScanConfig | None = None) -> Scanned:
    """Scans all roots in one run; a root that fails stops no other. The listing and what was read are stored once.

    counts: repo, seen, dirs_ignored, ignored_ext, ignored_pattern, ignored_binary, too_large, unreadable, kept and status (``failed`` if
    the root couldn't be listed).
    """
    listed = stored(listing(spark, roots, config))
    read = stored(contents(listed))
    left_out = listed.where("reason IS NOT NULL").select("repo", "path", "reason", "error").unionByName(read.select("repo", "path", "reason", "error"))
    of = lambda *reasons: F.count_if(F.col("reason").isin(*reasons))
    counted = left_out.groupBy("repo").agg(
        F.count_if(F.coalesce(~F.col("reason").isin("dir", "unlisted"), F.lit(True))).alias("seen"), of("dir").alias("dirs_ignored"), of("ext").alias("ignored_ext"), of("pattern").alias("ignored_pattern"), of("binary").alias("ignored_binary"),
        of("large").alias("too_large"), of("unreadable").alias("unreadable"), F.count_if(F.col("reason").isNull()).alias("kept"), F.count_if((F.col("reason") == "unlisted") & (F.col("path") == "")).alias("_failed"),
    )
    named = spark.createDataFrame([(r,) for r in sorted(roots)], "repo string")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in counted.columns if c not in ("repo", "_failed")]
    counts = named.join(counted, "repo", "left").select("repo", *zero, F.when(F.col("_failed") > 0, "failed").otherwise("ok").alias("status"))
    failures = left_out.where(F.col("reason").isin("unlisted", "unreadable", "large")).select("repo", "path", "reason", "error")
    return Scanned(read.where("reason IS NULL").drop("reason", "error", "root"), counts, failures)


def scan(spark: SparkSession, root: str, config: ScanConfig | None = None) -> DataFrame:
    """path (relative), size_bytes, mtime, text of the kept files under ``root``, ordered by path up to ``max_files``."""
    config = config or ScanConfig()
    listed = listing(spark, {"": root}, config)
    if listed.where("reason = 'unlisted' AND path = ''").head(1):
        raise FileNotFoundError(root)
    found = contents(listed).where("reason IS NULL").select("path", "size_bytes", "mtime", "text")
    return found.orderBy("path").limit(config.max_files) if config.max_files else found
