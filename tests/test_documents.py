"""The dispatcher, symbol chunks and the index run on literal files."""

import pytest

from tessera import config
from tessera.operators import chunks, documents, indexing

SERVICE = """import os


def trim(text):
    return text.strip()


@register
class Store(Base):
    \"\"\"Keeps
    what it is given.\"\"\"

    LIMIT = 3
    name: str = "x"

    @property
    def load(self):
        return trim(self.name)

    def save(self, text):
        def inner():
            return 1
        return self.load(text)

    class Inner:
        pass


if __name__ == "__main__":
    trim("x")
"""
CARD = """import React, { useState } from 'react';
import './card.css';

export const money = (v: number) => `${v}`;

export class Cart {
  total: number = 0;

  add(item: Item) {
    this.total += item.price;
    return this.show();
  }

  show() {
    return money(this.total);
  }
}

export default function Card(props: Props) {
  return <div>{money(props.price)}</div>;
}

export { money as asMoney };
"""
FILES = [
    ("a", "src/store.py", SERVICE), ("a", "src/card.tsx", CARD), ("a", "docs/guide.md", "# Guide\nintro\n\n## Install\nstep"), ("a", "docs/guide.rst", "Title\n=====\ntext\n\nNext\n----\nmore"),
    ("a", "docs/guide.adoc", "= One\ntext\n== Two\nmore"), ("a", "infra/settings.yaml", "app:\n  x: 1\n\ndb:\n  y: 2"), ("a", "config/settings.ini", "[a]\nx=1\n[b]\ny=2"), ("a", ".env", "A=1\n\nB=2"),
    ("a", "db/f.sql", "CREATE FUNCTION f() AS $$\nBEGIN\n  x;\nEND;\n$$;\n\nSELECT 1;"), ("a", "notes.txt", "\n".join(f"l{i}" for i in range(50))), ("a", "src/blank.py", " \n\n"), ("a", "src/empty.md", ""), ("a", "src/spaces.md", " \n \n"),
    ("b", "src/store.py", "x = 1\n"), ("a", "lost.py", None),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = documents.chunk_files(spark.createDataFrame(FILES, "repo string, path string, text string").repartition(3), 20, 0).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.repo, r.path, r.start_line, r.symbol is None, r.end_line)):
        out.setdefault((r.repo, r.path), []).append(r)
    return out


def test_each_file_goes_to_its_chunker(found):
    shown = {k[1]: [(r.strategy, r.content_type, r.start_line, r.end_line) for r in v] for k, v in found.items() if k[0] == "a" and not k[1].startswith("src/")}
    assert shown == {
        "docs/guide.md": [("doc_section", "doc_section", 1, 2), ("doc_section", "doc_section", 4, 5)],
        "docs/guide.rst": [("doc_section", "doc_section", 1, 3), ("doc_section", "doc_section", 5, 7)],
        "docs/guide.adoc": [("doc_section", "doc_section", 1, 2), ("doc_section", "doc_section", 3, 4)],
        "infra/settings.yaml": [("config_section", "config_block", 1, 2), ("config_section", "config_block", 4, 5)],
        "config/settings.ini": [("config_section", "config_block", 1, 2), ("config_section", "config_block", 3, 4)],
        ".env": [("config_section", "config_block", 1, 1), ("config_section", "config_block", 3, 3)],
        "db/f.sql": [("sql_statement", "sql_block", 1, 5), ("sql_statement", "sql_block", 7, 7)],
        "notes.txt": [("doc_section", "doc_section", 1, 50)] if ".txt" in config.DOC_EXTENSIONS else [("line_window", "code_context", 1, 20), ("line_window", "code_context", 21, 40), ("line_window", "code_context", 41, 50)],
    }


def test_blank_and_lost_files(found):
    assert ("a", "src/blank.py") not in found and ("a", "src/empty.md") not in found and ("a", "lost.py") not in found
    assert [(r.strategy, r.content) for r in found["a", "src/spaces.md"]] == [("line_window", " \n ")]
    assert [(r.start_line, r.content, r.symbol) for r in found["b", "src/store.py"]] == [(1, "x = 1", None)]


def test_a_class_that_fits_is_one_chunk_and_gaps_are_chunks(found):
    rows = found["a", "src/store.py"]
    assert [(r.start_line, r.end_line, r.qualified, r.kind) for r in rows] == [(1, 1, None, None), (4, 5, "trim", "function"), (8, 26, "Store", "class"), (29, 30, None, None)]
    assert {r.qualified: r.callers for r in rows if r.qualified == "trim"} == {"trim": ["Store"]}


def test_members_of_a_large_class(spark):
    df = spark.createDataFrame([("p", SERVICE)], "path string, text string")
    rows = sorted(chunks.symbol_chunks(df, "python", 5).collect(), key=lambda r: (r.start_line, r.symbol is None))
    assert [(r.start_line, r.end_line, r.qualified, r.kind) for r in rows] == [
        (1, 1, None, None), (4, 5, "trim", "function"), (8, 26, "Store", "class"), (8, 14, None, None), (16, 18, "Store.load", "method"), (20, 23, "Store.save", "method"), (25, 26, "Store.Inner", "class"), (29, 30, None, None),
    ]
    by = {r.qualified: r for r in rows}
    assert by["Store"].content == "class Store(Base):\ndocstring: Keeps what it is given.\nclass_attributes: LIMIT, name\nmethods: load, save\nnested_classes: Inner"
    assert by["Store.load"].content.startswith("    @property") and by["Store.load"].callees == ["trim"] and by["Store.save"].callees[-1] == "Store.load"


def test_script_members_imports_and_exports(spark):
    df = spark.createDataFrame([("p", CARD)], "path string, text string")
    rows = sorted(chunks.symbol_chunks(df, "typescript", 5).collect(), key=lambda r: (r.start_line, r.symbol is None))
    assert [(r.start_line, r.end_line, r.qualified, r.kind) for r in rows] == [
        (1, 2, None, None), (4, 4, "money", "helper"), (6, 17, "Cart", "class"), (7, 7, None, None), (9, 12, "Cart.add", "method"), (14, 16, "Cart.show", "method"), (19, 21, "Card", "component"), (23, 23, None, None),
    ]
    assert rows[0].imports == ["react", "./card.css"] and rows[0].exports == ["money", "Cart", "Card", "asMoney"]
    by = {r.qualified: r for r in rows}
    assert by["Cart"].content == "export class Cart\nfields: total\nmethods: add, show\nclass_summary: Cart"
    assert by["Cart.add"].callees == ["Cart.show"] and by["money"].callers == ["Cart", "Cart.show", "Card"]


def test_many_symbols_in_one_file(spark):
    """A generated file: the work is a walk over its lines, not over pairs of symbols."""
    text = "\n".join(f"def f{i}():\n    return f{(i + 1) % 4000}()\n" for i in range(4000))
    rows = chunks.symbol_chunks(spark.createDataFrame([("p", text)], "path string, text string"), "python").collect()
    assert len(rows) == 4000 and all(r.callees == [f"f{(int(r.symbol[1:]) + 1) % 4000}"] and len(r.callers) == 1 for r in rows)


NONE = "id string, repo string, repo_root string, path string, content_type string, chunk_id string, content_hash string, start_line int, end_line int, text string, chunk_schema_version string"


def test_index_run(spark, tmp_path):
    schema = "repo string, path string, text string"

    def stored(df):
        place = str(tmp_path / f"{len(list(tmp_path.iterdir()))}")
        df.write.parquet(place)
        return spark.read.schema(df.schema).parquet(place)

    empty = spark.createDataFrame([], NONE)
    files = [("a", f"docs/f{i}.md", f"# One {i}\ntext\n# Two\nmore") for i in range(40)]
    first = indexing.index(spark.createDataFrame(files, schema), empty, "/code", size=20, overlap=0, keep=stored)
    assert first.points.count() == 80 and first.report.first().asDict() == {"scanned": 40, "indexed": 40, "coverage": 1.0, "status": "success", "upserted": 80, "deleted": 0}
    # one file gone, one unreadable, one shorter
    changed = [*files[2:], ("a", "docs/f1.md", None)]
    changed[0] = ("a", "docs/f2.md", "# One\nalone")
    second = indexing.index(spark.createDataFrame(changed, schema), stored(first.points), "/code", size=20, overlap=0, keep=stored)
    paths = sorted(r.path for r in second.points.collect())
    assert "docs/f0.md" not in paths and paths.count("docs/f1.md") == 2 and paths.count("docs/f2.md") == 1 and len(paths) == 77
    assert [(r.path, r.reason) for r in second.files.where("status = 'error'").collect()] == [("docs/f1.md", "unreadable")]
    # a scan that was cut short takes nothing away; too many errors change nothing
    part = indexing.index(spark.createDataFrame(files[:3], schema), stored(first.points), "/code", size=20, overlap=0, complete=False, keep=stored)
    assert part.points.count() == 80
    bad = [(r, p, None if i % 2 else t) for i, (r, p, t) in enumerate(files)]
    refused = indexing.index(spark.createDataFrame(bad, schema), stored(first.points), "/code", keep=stored)
    assert refused.points.count() == 80 and refused.report.first().status == "insufficient_coverage"
    assert indexing.index(spark.createDataFrame([], schema), stored(first.points), "/code", keep=stored).points.count() == 0


def test_preflight(spark):
    rows = spark.createDataFrame([("1", "a", "/x", "p", "code", "c", "h", 1, 1, "t", "v5")], NONE)
    indexing.preflight(rows, "a", "/x")
    with pytest.raises(indexing.NotIndexable, match="colliding"):
        indexing.preflight(rows, "a", "/y")
    with pytest.raises(indexing.NotIndexable, match="legacy"):
        indexing.preflight(rows, "a", "/x", "v6")


def test_an_index_run_picks_the_last_emissions_once(spark):
    """New points with an id each are not grouped again, and what a call graph doesn't need doesn't go through its exchange."""
    from tessera.operators import chunks, points

    old = spark.createDataFrame([("a", "old"), ("b", "old")], "id string, text string")
    new = spark.createDataFrame([("b", "new", 1), ("c", "new", 2)], "id string, text string, seq int")
    made = points.upsert(old, new, unique=True)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, points.upsert(old, new).collect())) == [("a", "old"), ("b", "new"), ("c", "new")]
    assert "max_by" not in made._jdf.queryExecution().toString()
    code = chunks.symbol_chunks(spark.createDataFrame([("f.py", "def a():\n    b()\n\ndef b():\n    pass\n")], "path string, text string"), "python")
    exchanged = code._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1].split("\n")[1]
    assert "nested" not in exchanged and {(r.symbol, tuple(r.callees)) for r in code.where("symbol IS NOT NULL").collect()} == {("a", ("b",)), ("b", ())}
