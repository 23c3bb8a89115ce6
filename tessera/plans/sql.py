"""Table functions for SQL: after ``register(spark)`` a query can say

    SELECT f.path, s.* FROM files f, LATERAL code_symbols(f.text, 'python') s
    SELECT f.path, w.* FROM files f, LATERAL line_windows(f.text, 120, 20) w
    SELECT * FROM remembered(TABLE(statements) PARTITION BY user, kind, topic ORDER BY seq)

They give the rows of ``chunks.symbols``, ``chunks.windows`` and ``memory.reconcile``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators import code, memory


def _lines(text: str | None) -> list[str]:
    """Lines as ``functions.text.lines`` cuts them."""
    unified = (text or "").replace("\r\n", "\n").replace("\r", "\n")
    return (unified[:-1] if unified.endswith("\n") else unified).split("\n") if unified else []


@udtf(returnType="symbol string, qualified string, parent string, start_line int, end_line int, content string, head string, calls array<string>")
class CodeSymbols:
    """The declarations of a text: of the module and its classes. A broken text has none."""

    def eval(self, text: str, language: str) -> Iterator[tuple]:
        lines = _lines(text)
        for d in code.walk("\n".join(lines), language != "python", 1 << 30)[0]:
            if d.direct:
                yield d.symbol, d.qualified, d.parent.qualified if d.parent else None, d.start + 1, d.end + 1, "\n".join(lines[d.start : d.end + 1]), d.head, list(dict.fromkeys(d.calls))


@udtf(returnType="chunk_index int, start_line int, end_line int, content string")
class LineWindows:
    """Windows of ``size`` lines, each sharing ``overlap`` lines with the one before."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
        if size <= 0 or not 0 <= overlap < size:
            raise ValueError("size must be positive and overlap in [0, size)")
        lines = _lines(text)
        for n, a in enumerate(range(0, max(len(lines) - overlap, 1) if lines else 0, size - overlap)):
            yield n, a + 1, min(a + size, len(lines)), "\n".join(lines[a : a + size])


@udtf
class Remembered:
    """Statements of one topic (a partition, in the order of seq) folded into entries; it holds the latest active ones alone.

    The table has seq, value and confidence; the columns it is partitioned by are given with each entry.
    """

    @staticmethod
    def analyze(statements: AnalyzeArgument) -> AnalyzeResult:
        schema = StructType([f for f in statements.dataType.fields if f.name not in ("seq", "value", "confidence")])
        kinds = {"long": LongType(), "string": StringType(), "double": DoubleType(), "boolean": BooleanType()}
        for name, kind in (x.split() for x in memory.ENTRY.split(", ")):
            schema.add(name, kinds[kind])
        return AnalyzeResult(schema)

    def __init__(self) -> None:
        self.live: list[memory.Entry] = []
        self.key: tuple = ()

    def rows(self, entries: list[memory.Entry]) -> Iterator[tuple]:
        for e in entries:
            yield (*self.key, e.id, e.value, e.confidence, e.times_reinforced, e.active, e.supersedes)

    def eval(self, row: Row) -> Iterator[tuple]:
        said = row.asDict()
        self.key = tuple(v for k, v in said.items() if k not in ("seq", "value", "confidence"))
        yield from self.rows(memory.take(self.live, said["seq"], said["value"], said["confidence"])[1])

    def terminate(self) -> Iterator[tuple]:
        yield from self.rows(self.live)


def register(spark: SparkSession) -> None:
    """Makes the table functions known to a session's SQL."""
    spark.udtf.register("code_symbols", CodeSymbols)
    spark.udtf.register("line_windows", LineWindows)
    spark.udtf.register("remembered", Remembered)
