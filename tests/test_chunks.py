"""Chunkers on literal cases and against plain loops."""

import hashlib
import re
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.config import ChunkConfig
from tessera.functions import classify, text as T
from tessera.operators import chunks


def spans(spark, text, opens):
    df = spark.createDataFrame([("p", text)], "path string, text string")
    return [(r.start_line, r.end_line) for r in chunks.sections(df, opens).orderBy("start_line").collect()]


@pytest.mark.parametrize(
    ("opens", "text", "expected"),
    [
        (chunks.markdown_headings, "# Guide\nintro\n\n## Install\nstep 1", [(1, 2), (4, 5)]),
        (chunks.markdown_headings, "# A\n```sh\n# not a heading\n```\n\ntext\n\n## B\nx", [(1, 6), (8, 9)]),
        (chunks.markdown_headings, "plain\ntext", [(1, 2)]),
        (chunks.markdown_headings, "~~~~\n# a\n~~~\n# b\n~~~~\n# c", [(1, 5), (6, 6)]),
        (chunks.rst_headings, "Title\n=====\nintro\n\nNext\n----\nbody", [(1, 3), (5, 7)]),
        (chunks.adoc_headings, "= Doc\nintro\n== Part\nbody", [(1, 2), (3, 4)]),
        (chunks.yaml_keys, "app:\n  name: x\n\ndb:\n  host: y", [(1, 2), (4, 5)]),
        (chunks.yaml_keys, "# note: x\n- a: b\nkey: 1", [(1, 2), (3, 3)]),
        (chunks.ini_headings, "[a]\nx = 1\n\n[[b]]\ny = 2", [(1, 2), (4, 5)]),
        (chunks.blank_separated, "A=1\nB=2\n\n\nC=3", [(1, 2), (5, 5)]),
        (chunks.json_keys, '{\n  "a": {\n    "x": "}{",\n    "y": 1\n  },\n  "b": ["[", 2]\n}', [(1, 1), (2, 5), (6, 7)]),
        (chunks.sql_statements, "SELECT 1;\nSELECT 2;", [(1, 1), (2, 2)]),
        (chunks.sql_statements, "CREATE FUNCTION f() AS $x$\nBEGIN\n  a;\nEND;\n$x$ LANGUAGE q;\n\nSELECT 1;", [(1, 5), (7, 7)]),
        (chunks.sql_statements, "SELECT ';'\n, (1;2\n) -- ;\n/* ;\n; */ ;\nSELECT 2", [(1, 5), (6, 6)]),
    ],
)
def test_sections(spark, opens, text, expected):
    assert spans(spark, text, opens) == expected


@pytest.mark.parametrize("text", ["", "\n", "  \n \n"])
def test_blank_texts_have_no_sections(spark, text):
    assert spans(spark, text, chunks.markdown_headings) == []


@pytest.mark.parametrize(("size", "overlap"), [(4, 1), (10, 2), (1, 0), (120, 20)])
def test_windows_like_a_loop(spark, size, overlap):
    texts = ["\n".join(f"l{i}" for i in range(n)) for n in (0, 1, 3, 4, 5, 7, 119, 120, 121, 300)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    expected = set()
    for i, t in enumerate(texts):
        rows, start, k = t.split("\n") if t else [], 0, 0
        while rows:
            end = min(start + size, len(rows))
            expected.add((str(i), k, start + 1, end, "\n".join(rows[start:end])))
            if end == len(rows):
                break
            start, k = start + size - overlap, k + 1
    assert {tuple(r) for r in chunks.windows(df, size, overlap).collect()} == expected


@pytest.mark.parametrize(("size", "overlap"), [(0, 0), (5, -1), (5, 5)])
def test_bad_windows_raise(spark, size, overlap):
    with pytest.raises(ValueError):
        chunks.windows(spark.createDataFrame([("p", "x")], "path string, text string"), size, overlap)
    with pytest.raises(ValueError):
        ChunkConfig(size, overlap)


PYTHON = """import os


class Service:
    def load(self):
        return helper(os.environ)

    def save(self, x):
        self.load()
        return x.strip()


def helper(value):
    return value
"""


def test_python_symbols_and_calls(spark):
    df = spark.createDataFrame([("a.py", PYTHON), ("b.py", "x = 1\n")], "path string, text string")
    found = {r.qualified: r for r in chunks.call_graph(chunks.symbols(df, "python")).collect()}
    assert {k: (r.kind, r.start_line, r.end_line) for k, r in found.items()} == {"Service": ("class", 4, 10), "Service.load": ("method", 5, 6), "Service.save": ("method", 8, 10), "helper": ("function", 13, 14)}
    assert found["Service.save"].callees == ["Service.load", "x.strip"] and found["Service.load"].callees == ["helper"]
    assert found["helper"].callers == ["Service", "Service.load"] and found["Service.load"].callers == ["Service", "Service.save"]


SCRIPT = """import x from 'y'
export const useProduct = (id) => {
  return formatPrice(id)
}
export function formatPrice(v) {
  return v.toFixed(2)
}
export function ProductCard(p) {
  const a = useProduct(p.id)
  return <div>{a}</div>
}
class Store {
}
"""


def test_script_symbols(spark):
    df = spark.createDataFrame([("a.tsx", SCRIPT)], "path string, text string")
    found = {r.symbol: (r.kind, r.start_line, r.end_line) for r in chunks.symbols(df, "typescript").collect()}
    assert found == {"useProduct": ("hook", 2, 4), "formatPrice": ("helper", 5, 7), "ProductCard": ("component", 8, 11), "Store": ("class", 12, 13)}


def test_paragraphs_give_the_text_again(spark):
    texts = ["", "a", "one\n\ntwo\n\n\nthree", "x" * 1000, "line\n" * 200, "p" * 299 + "\n\n" + "q" * 10, "\n\n\nstart"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in chunks.paragraphs(df, 300).orderBy("id", "at").collect():
        assert 0 < len(r.piece) <= 300
        got[r.id] = got.get(r.id, "") + r.piece
    assert got == {i: t for i, t in enumerate(texts) if t}


def test_identity(spark):
    row = spark.range(1).select(
        T.content_hash(F.lit("alpha\r\nbeta\r\n")).alias("a"), T.content_hash(F.lit("alpha\nbeta\n")).alias("b"), T.point_id(F.lit("r"), F.lit("/x"), F.lit("c")).alias("u"),
        T.chunk_id(F.lit("p"), F.lit(1), F.lit(2), F.lit("python")).alias("c"), T.chunk_id(F.lit("p"), F.lit(1), F.lit(2), F.lit("python"), F.lit("A.x"), F.lit("method")).alias("s"),
        T.summary_text(F.lit("apps/chunk.py"), F.lit("python"), F.lit(1), F.lit(4), F.lit("code_context"), F.lit("\n line  1\nline 2")).alias("t"),
    ).first()
    assert row.a == row.b == hashlib.sha256(b"alpha\nbeta\n").hexdigest()
    assert row.u == str(uuid.uuid5(uuid.NAMESPACE_URL, "r:/x:c"))
    assert row.c == hashlib.sha256(b"p:1:2:python").hexdigest() and row.s == hashlib.sha256(b"p:python:A.x:method:no-signature").hexdigest()
    assert row.t == "apps/chunk.py | python | lines 1-4 | type=code_context | first_line=line 1"


def test_lines_like_split_lines(spark):
    texts = ["", "a", "a\n", "a\n\n", "\n", "a\r\nb\rc", "x\ny"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", T.lines(F.col("text")).alias("l"))
    assert {r.text: r.l for r in df.collect()} == {t: t.splitlines() for t in texts}


def test_small_text_functions(spark):
    row = spark.range(1).select(
        T.token_estimate(F.lit("a b c d e f g h i j")).alias("ten"), T.token_estimate(F.lit("")).alias("none"), T.byte_cut(F.lit("aé🙂b"), 4).alias("cut"), T.byte_cut(F.lit("abc"), 3).alias("whole"),
        T.suffix(F.lit("a/b/.env")).alias("env"), T.suffix(F.lit("a/X.TSX")).alias("tsx"), T.collapsed(F.lit(" a\u00a0 b\n")).alias("c"), T.plain_letters(F.lit("NÃO às")).alias("p"),
    ).first()
    assert (row.ten, row.none, row.cut, row.whole, row.env, row.tsx, row.c, row.p) == (12, 1, "aé", "abc", "", ".tsx", "a b", "nao as")


@pytest.mark.parametrize(
    ("path", "kind", "collection", "language"),
    [
        ("docs/guide.py", "doc_section", "docs", "python"), ("README.md", "doc_section", "docs", "markdown"), ("src/tests/a.py", "test_case", "code", "python"), ("src/a.spec.ts", "test_case", "code", "typescript"),
        ("test_a.py", "test_case", "code", "python"), ("db/a.sql", "sql_block", "code", "sql"), ("package.json", "config_block", "code", "json"), ("src/data.json", "code_context", "code", "json"),
        ("infra/settings.yaml", "config_block", "code", "yaml"), (".env", "config_block", "code", "text"), ("src/a.go", "code_context", "code", "text"), ("x\\config\\a.yml", "config_block", "code", "yaml"),
    ],
)
def test_classification(spark, path, kind, collection, language):
    row = spark.createDataFrame([(path,)], "path string").select(classify.content_type(F.col("path")).alias("k"), classify.language(F.col("path")).alias("l")).select("k", classify.collection(F.col("k")).alias("c"), "l").first()
    assert tuple(row) == (kind, collection, language)


def test_globs(spark):
    row = spark.createDataFrame([("a/b/c.py",)], "path string").select(*[T.matches_any(F.col("path"), [g]).alias(g) for g in ("*.py", "a/*", "b/*", "c.py", "a/?/c.p[xy]")]).first()
    assert tuple(row) == (True, True, False, False, True)
    assert re.fullmatch("x", "x")
