"""The lexical walk over code: where symbols end, what is quoted, and what it makes of texts that don't end."""

from __future__ import annotations

import ast
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunks, documents
from tessera.operators.code import lex, walk

MODULE = '''import os

def load(
    path,
):
    data = open(path)
    return parse(data)


class A:
    """def fake():
        pass
"""
    x: int = 1
    def m(self):
        s = f"""
text in column 0
"""
        return self.n(s)
'''

SCRIPT = """import { a } from "x";
export function render(
  p: Props,
): string {
  const t = `
function fake() {
  ${p.items.map((i) => `<b>${i}</b>`)}
}
`;
  return t;
}
export default memo(function Card() {
  return <p>Don't {x}</p>;
});
const x = useThing(() => {
  return 1;
});
export const sum = (a: number, b: number) => a + b;
class S extends B {
  private url = '/api';
  onClick = () => {
    this.go();
  };
  @Get(
    '/x',
  )
  go<T>(a: T): void { foo?.bar(a) }
}
const re = /[{"]/g;
"""


def spans(text: str, script: bool, most: int = 100) -> dict:
    found, _, broken = walk(text, script, most)
    assert not broken
    return {d.qualified: (d.start + 1, d.end + 1) for d in found if d.direct}


def test_heads_over_several_lines_and_strings():
    assert spans(MODULE, False) == {"load": (3, 7), "A": (10, 19), "A.m": (15, 19)}
    assert spans(SCRIPT, True) == {"render": (2, 11), "Card": (12, 14), "x": (15, 17), "sum": (18, 18), "S": (19, 28), "S.onClick": (21, 23), "S.go": (24, 27)}


def test_what_symbols_say_of_themselves():
    found = {d.qualified: d for d in walk(SCRIPT, True, 3)[0]}
    assert found["render"].head == "export function render( p: Props, ): string" and found["render"].calls == ["p.items.map"]
    assert found["S"].summed and found["S"].fields == ["url"] and found["S"].calls == ["this.go", "Get", "foo.bar"]
    python = {d.qualified: d for d in walk(MODULE, False, 100)[0]}
    assert python["A"].fields == ["x"] and python["A"].doc.startswith("def fake") and python["load"].head == "def load( path, ):" and python["load"].calls == ["open", "parse"]


@pytest.mark.parametrize(
    "text",
    [
        "export function format(value: string): string;\nexport function format(value: any): string {\n  return String(value);\n}\n",
        "export default class extends Base {\n  run(): void {}\n}\n",
        "export default function() {\n  return <section />;\n}\n",
        "export default () => <div />;\n",
        "export default forwardRef((props, ref) => {\n  return <input ref={ref} />;\n});\n",
        "export abstract class Service {\n  run(): void {}\n}\n",
    ],
)
def test_script_declarations(text):
    found, _, broken = walk(text, True, 100)
    named = [(d.symbol, d.word, d.line) for d in found if d.parent is None]
    expected = {"format": [("format", "function", 1)], "extends": [("default", "class", 0)], "function()": [("default", "function", 0)], "() =>": [("default", "function", 0)], "forwardRef": [("default", "function", 0)], "abstract": [("Service", "class", 0)]}
    assert not broken and named == next(v for k, v in expected.items() if k in text)


def test_texts_that_do_not_end_are_broken(spark):
    for text, script in (("def broken(\n", False), ('x = """\n', False), ("a)\n", False), ("export const b = () => {\n  return 1;\n", True), ("const t = `x${1}\n", True), ("(]\n", True)):
        assert walk(text, script, 10) == ([], [], True)
    rows = documents.chunk_files(spark.createDataFrame([("r", "src/a.py", "def broken(\nx = 1\ny = 2"), ("r", "src/b.ts", "a {")], "repo string, path string, text string"), 2, 1).collect()
    assert sorted((r.path, r.strategy, r.start_line, r.end_line, r.symbol) for r in rows) == [("src/a.py", "line_window", 1, 2, None), ("src/a.py", "line_window", 2, 3, None), ("src/b.ts", "line_window", 1, 1, None)]


def test_empty_and_long_lines():
    assert walk("", False, 5) == ([], [], False) and walk("\n\n", True, 5) == ([], [], False)
    long = "x = '" + "a" * 500_000 + "'\ndef f():\n    return (" + "1, " * 100_000 + ")\n"
    assert spans(long, False) == {"f": (2, 3)}
    assert spans("const a = `" + "b" * 500_000 + "`;\nfunction f() {" + "g();" * 100_000 + "}\n", True) == {"f": (2, 2)}


def source(r: random.Random, depth: int = 0) -> list[str]:
    """Lines of random valid Python: nested blocks, heads over lines, strings that look like code, comments, decorators."""
    pad = "    " * depth
    out = []
    for _ in range(r.randint(1, 4)):
        kind = r.randrange(9 if depth < 3 else 5)
        if kind == 0:
            out += [f"{pad}x{r.randrange(9)} = call(1,", "  2,", f"{pad})"]
        elif kind == 1:
            out += [f'{pad}s = """', "def fake(:", "    class Fake:", '"""', f"{pad}# a comment", ""]
        elif kind == 2:
            out += [f"{pad}y = 'it\\'s' + \"#\" + \\", "5 * ' '"]
        elif kind == 3:
            out += [f"{pad}pass  # )(", ""]
        elif kind == 4:
            out += [f"{pad}def one{r.randrange(99)}(a=')'): return a"]
        elif kind == 5:
            out += [f"{pad}if x:", *source(r, depth + 1), f"{pad}else:", *source(r, depth + 1)]
        elif kind == 6:
            out += [f"{pad}@wraps(", f"{pad}    f)", f"{pad}async def f{r.randrange(99)}(", f"{pad}    a, b={{'k': [1]}},", f"{pad}) -> int:", *source(r, depth + 1)]
        elif kind == 7:
            out += [f"{pad}class C{r.randrange(99)}(Base,", f"{pad}  metaclass=M):", *source(r, depth + 1), f"{pad}# behind"]
        else:
            out += [f"{pad}def g{r.randrange(99)}():", *source(r, depth + 1)]
    return out


def test_python_spans_equal_the_syntax_tree():
    def declared(nodes, parent):
        for x in nodes:
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{parent}.{x.name}" if parent else x.name
                yield name, min([x.lineno, *[d.lineno for d in x.decorator_list]]), x.end_lineno
                if isinstance(x, ast.ClassDef):
                    yield from declared(x.body, name)

    r = random.Random(11)
    checked = 0
    for _ in range(400):
        text = "\n".join(source(r))
        expected = sorted(declared(ast.parse(text).body, None))
        found, _, broken = walk(text, False, 1000)
        assert not broken and sorted((d.qualified, d.start + 1, d.end + 1) for d in found if d.direct) == expected, text
        checked += len(expected)
    assert checked > 500


def test_lines_between_symbols():
    text = "# module comment\nimport os\n\nimport re\ndef load(x):\n    return x\n\nif x:\n    def inner():\n        pass\nelse:\n    y = 1\n# end\n"
    found, gaps, _ = walk(text, False, 20)
    assert [(d.qualified, d.direct) for d in found] == [("load", True), ("inner", False)]
    assert [(a + 1, b + 1) for a, b in gaps] == [(2, 2), (4, 4), (8, 12), (1, 1), (13, 13)]
    assert walk("one\n\ntwo\n", False, 20)[1] == [(0, 2)]


def test_quiet_text_keeps_places():
    lexed = lex(SCRIPT, True)
    assert len(lexed.text) == len(SCRIPT) and not lexed.broken
    assert all(SCRIPT[a] in "([{" and SCRIPT[b] in ")]}" for a, b in lexed.pairs.items())


def test_calls_and_callers(spark):
    text = "def helper() -> str:\n    return 'ok'\n\ndef load() -> str:\n    return helper()\n\nclass Service:\n    def run(self) -> str:\n        return self.load()\n\n    def load(self) -> str:\n        return helper()\n"
    by = {r.qualified: r for r in chunks.symbol_chunks(spark.createDataFrame([("p", text)], "path string, text string"), "python", 3).collect() if r.qualified}
    assert by["helper"].callees == [] and by["helper"].callers == ["load", "Service", "Service.load"]
    assert by["Service"].callees == ["Service.load", "helper"] and by["Service.run"].callees == ["Service.load"] and by["Service.load"].callees == ["helper"]
    decorated = "@register(helper())\ndef load() -> int:\n    return 1\n"
    (row,) = chunks.symbol_chunks(spark.createDataFrame([("p", decorated)], "path string, text string"), "python").collect()
    assert row.callees == ["register", "helper"]
    script = "@Inject(\n  buildFactory(),\n)\nexport class Service {\n  @trace(\n    buildPath(),\n  )\n  load(): string {\n    return new Client().run(helper(), super.load());\n  }\n}\n"
    by = {r.qualified: r for r in chunks.symbol_chunks(spark.createDataFrame([("p", script)], "path string, text string"), "typescript", 3).collect() if r.qualified}
    assert by["Service"].callees == ["Inject", "buildFactory", "trace", "buildPath", "Client", "helper", "super.load"] and by["Service.load"].callees == ["trace", "buildPath", "Client", "helper", "super.load"]
    assert by["Service"].content.startswith("@Inject(\n") and by["Service"].content.endswith("methods: load\nclass_summary: Service")


def test_call_graphs_are_dealt_by_text_not_by_compressed_bytes(spark):
    """Few shuffled bytes still go to as many tasks as asked for; more text asks for more."""
    files = spark.createDataFrame([(f"f{i}.py", "def a():\n    b()\n\ndef b():\n    pass\n") for i in range(60)], "path string, text string")
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert chunks.dealt(files) == shuffled
    assert chunks.dealt(files.limit(1).select(F.repeat(F.lit("x"), chunks.TASK_CHARS).alias("text")).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(shuffled + 3))))) == shuffled + 3
    found = chunks.symbols(files, "python")
    tasks = lambda rows: {r.t for r in rows.select(F.spark_partition_id().alias("t")).collect()}
    assert len(tasks(chunks.call_graph(found))) > shuffled / 2
    assert len(tasks(chunks.call_graph(found, 3 * shuffled))) > shuffled
