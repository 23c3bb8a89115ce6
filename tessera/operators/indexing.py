"""The index run: files to chunks to points, with checks before anything changes and a cleanup after.

A run is a few DataFrames; only counts come to the driver. Files that can't be read or are too large are rows of a log and
don't stop the others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from . import documents, points as P


class NotIndexable(ValueError):
    """A run that may not start."""


@dataclass(frozen=True)
class Indexed:
    """The table after the run, what the run says of itself (one row), and a row for each file."""

    points: DataFrame
    report: DataFrame
    files: DataFrame


def preflight(stored: DataFrame, repo: str, root: str, version: str = documents.SCHEMA_VERSION) -> None:
    """Raises if the table holds points of another schema, or of the same repository name under another root."""
    # at most a row per content type each
    for kind, rows in (("legacy", P.legacy(stored, version)), ("colliding", P.collisions(stored, repo, root))):
        counted = {r.content_type: r[kind] for r in rows.collect()}
        if counted:
            raise NotIndexable(f"{kind} points: {counted}")


def file_log(files: DataFrame, most_chars: int) -> DataFrame:
    """repo, path, status and reason for each file: ``error`` with a reason, or ``ok``."""
    reason = F.when(F.col("text").isNull(), "unreadable").when(F.length("text") > most_chars, "too long")
    return documents.classified(files).join(files.select("repo", "path", F.when(reason.isNull(), "ok").otherwise("error").alias("status"), reason.alias("reason")), ["repo", "path"])


def index(files: DataFrame, stored: DataFrame, root: str, embed: Callable[[DataFrame], DataFrame] | None = None, size: int = 120, overlap: int = 20, least: float = 0.95, complete: bool = True, most_chars: int = 50_000_000, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Indexed:
    """Chunks ``files`` (repo, path, text), replaces their points in ``stored`` and takes stale ones away.

    ``stored`` and the result have id, repo, repo_root, path, content_type, chunk_id, content_hash, start_line, end_line, text
    and chunk_schema_version, and vector if ``embed`` (rows with id and text to id and vector) is given. If fewer than
    ``least`` of the files give chunks or are found blank, nothing changes and the report says so. Stale points go only after
    ``complete`` scans, and files with errors keep theirs. ``keep`` may store what is used several times.
    """
    log = keep(file_log(files, most_chars))
    good = files.where(F.length("text") <= most_chars)
    found = documents.chunk_files(good, size, overlap)
    # the position of a chunk decides which emission of one id is the last
    order = F.struct("start_line", "end_line", "content_hash")
    new = found.select(
        T.point_id(F.col("repo"), F.lit(root), F.col("chunk_id")).alias("id"), "repo", F.lit(root).alias("repo_root"), "path", F.col("collection").alias("content_type"), "chunk_id", "content_hash",
        "start_line", "end_line", F.col("content").alias("text"), "chunk_schema_version", order.alias("seq"),
    )
    new = keep(P.last_by(new, ["id"], ["seq"]))
    if embed:
        new = keep(new.join(embed(new.select("id", "text")), "id"))
    scanned, indexed = log.select(F.concat_ws("\u0001", "repo", "path").alias("path")), log.where("status = 'ok'").select(F.concat_ws("\u0001", "repo", "path").alias("path"))
    report = P.coverage(scanned, indexed, least)
    outcome = report.first()
    if outcome.status == "insufficient_coverage":
        return Indexed(stored, report.withColumn("upserted", F.lit(0).cast("long")).withColumn("deleted", F.lit(0).cast("long")), log)
    after = keep(P.upsert(stored, new, unique=True))
    gone = after.limit(0).select("id")
    if complete:
        keyed = after.where((F.col("repo_root") == root) & F.col("path").isNotNull()).select("id", F.concat_ws("\u0001", "repo", "path").alias("path"), "content_type", "chunk_id")
        gone = keep(P.stale(keyed, scanned, indexed, new.select(F.concat_ws("\u0001", "repo", "path").alias("path"), "content_type", "chunk_id")).select("id"))
    totals = report.withColumn("upserted", F.lit(new.count())).withColumn("deleted", F.lit(gone.count()))
    return Indexed(P.delete(after, gone), totals, log)
