"""Symbols of code files, told by a lexical walk: quotes and comments, brackets and their matches, indentation.

The walk keeps what an expression over lines can't: in which string or comment a place is, and which bracket closes which.
It is a small function of one text; Spark deals files to tasks and hands texts over in Arrow batches, and what is made of
declarations (kinds, summaries, call graphs) is DataFrame work in ``chunks``.

Python: a line counts if it starts outside strings and brackets and continues no other. A declaration reaches to the last
line of code before the next line that is indented no more. Scripts: a declaration stands at the start of a line of the
module or of a class body; it reaches to the bracket that matches its first one, or to the end of its statement. A text whose brackets
don't match, or with an open string, gives no symbols (``broken``). Code inside Python's f-strings counts as text; code in
holes of template strings counts as code.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..sources.shared import map_arrow

# Words before a bracket that aren't calls, how many lines a script's head may take, and how many fields a summary names.
SCRIPT_WORDS = {"catch", "class", "for", "function", "if", "import", "return", "switch", "typeof", "while"}
PYTHON_WORDS = {"and", "as", "assert", "await", "case", "class", "def", "del", "elif", "else", "except", "for", "from", "if", "import", "in", "is", "lambda", "match", "not", "or", "raise", "return", "super", "while", "with", "yield"}
HEAD_LINES, FIELDS = 12, 6
#: Characters and rows that a task gathers before it gives them out.
BATCH_CHARS, BATCH_ROWS = 4 << 20, 8192

_PYTHON_QUIET = re.compile(r'''(?s)(?P<open>"""(?:[^"\\]|\\.|"(?!""))*+(?:"""|(?P<a>\Z))|\'\'\'(?:[^'\\]|\\.|'(?!''))*+(?:\'\'\'|(?P<b>\Z)))|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|(?P<note>#[^\n]*)''')
_SCRIPT_CODE = re.compile(r"""(?s)(?P<note>//[^\n]*|/\*.*?(?:\*/|\Z))|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|(?<=[=(,:;!&|?{\[])[ \t]*/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*|(?P<mark>[`{}])""")
_SCRIPT_TEMPLATE = re.compile(r"(?s)\\.|`|\$\{")
_BRACKETS = re.compile(r"[\[({})\]\n]")
_CLOSES = {")": "(", "]": "[", "}": "{"}
_CALL = re.compile(r"(?<![\w$.])(?<!\bdef )(?<!\bclass )(?<!\bfunction )([^\W\d][\w$]*|\$[\w$]*)((?:\.[^\W\d][\w$]*)*)\s*\(")
#: Stands for what is quoted or commented, so that lengths and lines stay.
GONE = "\0"


@dataclass
class Lexed:
    """A text with quotes and comments blanked (``quiet``, by line), with comments alone blanked (``bare``), and its brackets."""

    lines: list[str]
    quiet: list[str]
    bare: list[str]
    text: str
    starts: list[int]
    depth: list[int]
    held: list[bool]
    pairs: dict[int, int]
    broken: bool

    def line(self, place: int) -> int:
        return bisect_right(self.starts, place) - 1


def _spans(text: str, script: bool) -> Iterator[tuple[int, int, bool, bool]]:
    """start, end, whether it is a comment, whether it is open at the end: all that is quoted or commented."""
    if not script:
        for m in _PYTHON_QUIET.finditer(text):
            yield m.start(), m.end(), m["note"] is not None, m["a"] is not None or m["b"] is not None
        return
    at, opened, holes = 0, None, []
    while True:
        m = (_SCRIPT_CODE if opened is None else _SCRIPT_TEMPLATE).search(text, at)
        if m is None:
            break
        at = m.end()
        if opened is not None:
            if m[0] == "`" or m[0] == "${":
                yield opened, at, False, False
                opened = None
                if m[0] == "${":
                    holes.append(0)
        elif m["mark"] is None:
            yield m.start(), at, m["note"] is not None, False
        elif m[0] == "`":
            opened = m.start()
        elif holes:
            holes[-1] += 1 if m[0] == "{" else -1
            if holes[-1] < 0:
                holes.pop()
                opened = m.start()
    if opened is not None or holes:
        yield (opened if opened is not None else len(text)), len(text), False, True


def lex(text: str, script: bool) -> Lexed:
    quiet, bare, held, at, open_ = [], [], set(), 0, False
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    for a, b, note, unended in _spans(text, script):
        inside = re.sub(r"[^\n]", GONE, text[a:b])
        quiet += [text[at:a], inside]
        bare += [text[at:a], inside if note else text[a:b]]
        first, last = bisect_right(starts, a), bisect_right(starts, b - 1)
        held.update(range(first, last))
        at, open_ = b, unended
    quiet.append(text[at:])
    bare.append(text[at:])
    code = "".join(quiet)
    depth, stack, pairs, broken = [0], [], {}, open_
    for m in _BRACKETS.finditer(code):
        mark = m[0]
        if mark == "\n":
            depth.append(len(stack))
        elif mark not in _CLOSES:
            stack.append((mark, m.start()))
        elif stack and stack[-1][0] == _CLOSES[mark]:
            pairs[stack.pop()[1]] = m.start()
        else:
            broken = True
            break
    depth += [0] * (len(starts) - len(depth))
    return Lexed(text.split("\n"), code.replace(GONE, " ").split("\n"), "".join(bare).replace(GONE, " ").split("\n"), code, starts, depth, [i in held for i in range(len(starts))], pairs, broken or bool(stack))


@dataclass
class Declared:
    """A declaration: 0-based first line (decorators included), line of its own, last line, and what it says of itself."""

    symbol: str
    word: str
    start: int
    line: int
    head: str
    end: int = -1
    head_end: int = -1
    parent: Declared | None = None
    exported: bool = False
    #: Whether it stands in the module or in a class that does, not in a branch or a function.
    direct: bool = True
    doc: str | None = None
    calls: list[str] = field(default_factory=list)
    fields: list[str] = field(default_factory=list)
    members: list[Declared] = field(default_factory=list)
    chosen: bool = False
    summed: bool = False

    @property
    def qualified(self) -> str:
        return f"{self.parent.qualified}.{self.symbol}" if self.parent else self.symbol


def _calls(code: str, words: set[str]) -> list[str]:
    """Called names in order, as a name or a path of names."""
    plain = code.replace(GONE, " ").replace("?.", ".").replace("!.", ".")
    return [m[1] + m[2] for m in _CALL.finditer(plain) if m[1] not in words]


def _joined(lines: list[str]) -> str:
    return " ".join(" ".join(x.replace(GONE, "").strip() for x in lines if x.strip()).split())


_DEF = re.compile(r"(?:async\s+)?(def|class)\s+([^\W\d]\w*)")
_GOES_ON = re.compile(r"(?:elif|else|except|finally)\b")
_ASSIGNED = re.compile(r"([^\W\d]\w*)\s*(?::(?!=)|=(?!=))")
_DOC = re.compile(r'''(?s)[rRuU]?(?:"""(.*?)"""|\'\'\'(.*?)\'\'\'|"([^"\n]*)"|'([^'\n]*)')\s*\Z''')


def _python(lexed: Lexed) -> tuple[list[Declared], list[tuple[int, int]]]:
    """Declarations in order, and the spans of the module's other statements."""
    quiet, bare, n = lexed.quiet, lexed.bare, len(lexed.lines)
    firsts = [i for i in range(n) if not lexed.depth[i] and not lexed.held[i] and bare[i].strip() and not (i and quiet[i - 1].rstrip().endswith("\\"))]
    found: list[Declared] = []
    statements: list[tuple[int, int]] = []
    blocks: list[tuple[int, Declared | None]] = []
    decorated, noted, before = None, [], -1

    def add(to: Declared | None, calls: list[str]) -> None:
        if to is None:
            return
        to.calls += calls
        # a class calls what its methods call
        if to.word == "def" and to.direct and to.parent is not None:
            to.parent.calls += calls

    for i, j in zip(firsts, [*firsts[1:], n][: len(firsts)], strict=True):
        code = "\n".join(quiet[i:j])
        last = next(k for k in range(j - 1, i - 1, -1) if bare[k].strip())
        indent = len(bare[i].expandtabs()) - len(bare[i].expandtabs().lstrip())
        code = code.strip()
        while blocks and blocks[-1][0] >= indent:
            gone = blocks.pop()[1]
            if gone is not None:
                gone.end = before
        before = last
        top = blocks[-1][1] if blocks else None
        holder = next((d for _, d in reversed(blocks) if d is not None), None)
        m = _DEF.match(code)
        if blocks and blocks[0][1] is None and statements:
            statements[-1] = (statements[-1][0], last)
        if m:
            own = Declared(m[2], m[1], i if decorated is None else decorated, i, "", parent=holder, direct=not blocks or (top is not None and top.word == "class" and top.direct))
            colon, inside = len(code), 0
            for k in range(m.end(), len(code)):
                inside += (code[k] in "([{") - (code[k] in ")]}")
                if code[k] == ":" and not inside:
                    colon = k
                    break
            own.head_end = i + code.count("\n", 0, colon)
            own.head = " ".join(x.strip() for x in lexed.lines[i : own.head_end + 1] if x.strip())
            if top is not None:
                top.members.append(own)
            found.append(own)
            blocks.append((indent, own))
            add(own, noted + _calls(code[colon:], PYTHON_WORDS))
            decorated, noted = None, []
            continue
        if code.startswith("@"):
            decorated = i if decorated is None else decorated
            noted += _calls(code, PYTHON_WORDS)
            continue
        add(holder, _calls(code, PYTHON_WORDS))
        opens = code.endswith(":")
        if top is not None and top.word == "class":
            if not opens:
                for part in code.split(";"):
                    while assigned := _ASSIGNED.match(part.lstrip()):
                        top.fields.append(assigned[1])
                        if assigned[0].endswith(":"):
                            break
                        part = part.lstrip()[assigned.end() :]
            said = _DOC.match("\n".join(bare[i:j]).strip())
            if said and top.doc is None and not top.members and not top.fields and top.head_end < i and not any(bare[k].strip() for k in range(top.head_end + 1, i)):
                top.doc = next((x for x in said.groups() if x is not None), "")
        if not blocks:
            if _GOES_ON.match(code) and statements:
                statements[-1] = (statements[-1][0], last)
            else:
                statements.append((i, last))
        if opens:
            blocks.append((indent, None))
        decorated, noted = None, []
    for _, gone in blocks:
        if gone is not None:
            gone.end = before
    return found, statements


# What a script's declarations, class members and fields look like at the start of a statement, as results depend on it.
_NAME = r"[A-Za-z_$][\w$]*"
_SCRIPT_CLASS = re.compile(rf"(export\s+)?(default\s+)?(?:declare\s+)?(?:abstract\s+)?class\b(?:\s+(?!extends\b|implements\b)({_NAME}))?")
_SCRIPT_FUNCTION = re.compile(rf"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\b\s*\*?\s*({_NAME})\s*(?:<[^{{(]+>\s*)?\(")
_SCRIPT_VARIABLE = re.compile(rf"(?:export\s+)?(?:default\s+)?(?:const|let|var)\s+({_NAME})")
_INNER_FUNCTION = re.compile(rf"\bfunction\s*\*?\s*({_NAME})?\s*(?:<[^{{(]+>\s*)?\(")
_WORDS = r"(?:(?:public|private|protected|readonly|static|abstract|override|declare|async)\s+)*"
_METHOD = re.compile(rf"{_WORDS}(?:(?:get|set)\s+)?\*?\s*(#?{_NAME})\s*(?:<[^{{(]+>\s*)?\(")
_ARROW = re.compile(rf"{_WORDS}(#?{_NAME})\s*[?!]?\s*(?::[^=]+)?=\s*(?:async\s+)?(?:function\b|\([^)]*\)\s*(?::[^=]*)?=>|{_NAME}\s*=>)")
_FIELD = re.compile(rf"{_WORDS}(#?{_NAME})\s*[?!]?\s*(?::|=(?!>))")


def _head(lexed: Lexed, i: int) -> tuple[int, str]:
    """Last line of a script declaration's head, and its text: lines up to one with a brace, an arrow or a semicolon."""
    stop = min(len(lexed.lines), i + HEAD_LINES)
    for k in range(i, stop):
        if re.search(r"[{;]|=>", lexed.quiet[k]):
            return k, _joined(_rows(lexed, i, k))
        if k > i and not lexed.quiet[k].strip():
            return k, _joined(_rows(lexed, i, k))
    return stop - 1, _joined(_rows(lexed, i, stop - 1))


def _rows(lexed: Lexed, first: int, last: int) -> list[str]:
    end = lexed.starts[last + 1] - 1 if last + 1 < len(lexed.starts) else len(lexed.text)
    return lexed.text[lexed.starts[first] : end].split("\n")


def _block_end(lexed: Lexed, i: int) -> int | None:
    """The line with the brace that matches a declaration's first one, or a later one that opens on that line."""
    place = lexed.text.find("{", lexed.starts[i])
    while place >= 0:
        close = lexed.pairs[place]
        line = lexed.line(close)
        end = lexed.starts[line + 1] if line + 1 < len(lexed.starts) else len(lexed.text)
        place = lexed.text.find("{", close, end)
        if place < 0:
            return line
    return None


def _statement_end(lexed: Lexed, i: int) -> int:
    """The line that ends a statement: with a semicolon outside brackets, or the next one that goes on to nothing."""
    base = lexed.depth[i]
    for k in range(i, len(lexed.lines)):
        inside = lexed.depth[k]
        for mark in lexed.quiet[k]:
            inside += (mark in "([{") - (mark in ")]}")
            if mark == ";" and inside <= base:
                return k
        if inside <= base and (k > i or re.search(r"=>\s*\S", lexed.quiet[k])) and lexed.quiet[k].strip() and not re.search(r"(?:[,=(+\-*/?:&|.]|=>)\s*$", lexed.quiet[k]):
            after = lexed.quiet[k + 1].strip() if k + 1 < len(lexed.lines) else ""
            if not re.match(r"[.?:&|+*/,)\]}=]", after):
                return k
    return len(lexed.lines) - 1


def _script_declared(header: str, member: bool) -> tuple[str, str, bool] | None:
    """symbol, word, whether it has a block, of a head; None if it declares nothing."""
    block = "{" in header
    if member:
        m = _METHOD.match(header)
        if m:
            return (m[1], "method", True) if block else None
        m = _ARROW.match(header)
        return (m[1], "method", block or "function" in header) if m else None
    default = re.match(r"export\s+default\s", header) is not None
    m = _SCRIPT_CLASS.match(header)
    if m:
        return (m[3] or "default", "class", True) if block and (m[3] or default) else None
    m = _SCRIPT_FUNCTION.match(header)
    if m:
        return (m[1], "function", True) if block else None
    inner = _INNER_FUNCTION.search(header) if default else None
    if inner:
        return (inner[1] or "default", "function", True) if block else None
    m = _SCRIPT_VARIABLE.match(header)
    name = m[1] if m else "default"
    if not m and not default:
        return None
    if "=>" not in header and not (m and re.search(r"=\s*(?:async\s+)?function\b", header)):
        return None
    return name, "function", block or "function" in header


def _script(lexed: Lexed, first: int, last: int, depth: int, parent: Declared | None) -> Iterator[Declared]:
    """Declarations of the lines of one depth; ``parent`` is the class whose body they are."""
    i, decorated, noted = first, None, []
    while i <= last:
        code = lexed.quiet[i].strip()
        if lexed.depth[i] != depth or lexed.held[i] or not code:
            i += 1
            continue
        if code.startswith("@"):
            decorated = i if decorated is None else decorated
            place = re.compile(r"\s*@[\w$.]+\s*").match(lexed.text, lexed.starts[i]).end()
            end = lexed.line(lexed.pairs[place]) if lexed.text[place : place + 1] == "(" else i
            noted += _calls("\n".join(_rows(lexed, i, end)), SCRIPT_WORDS)
            i = end + 1
            continue
        head_end, header = _head(lexed, i)
        told = _script_declared(header, parent is not None)
        if told is None:
            m = _FIELD.match(code) if parent is not None else None
            if m and len(parent.fields) < FIELDS:
                parent.fields.append(m[1])
            i, decorated, noted = i + 1, None, []
            continue
        symbol, word, block = told
        end = _block_end(lexed, i) if block else _statement_end(lexed, i)
        if end is None:
            i += 1
            continue
        head = header[:-1].rstrip() if header.endswith("{") else header.rstrip(";")
        own = Declared(symbol, word, i if decorated is None else decorated, i, head, end, head_end, parent, header.startswith("export "))
        own.calls += noted
        if parent is not None:
            parent.members.append(own)
        yield own
        if word == "class":
            opened = lexed.text.find("{", lexed.starts[i])
            own.head_end = lexed.line(opened)
            inner = len([1 for a, b in lexed.pairs.items() if a <= opened <= b]) if lexed.depth[i] != depth else depth + 1
            yield from _script(lexed, own.head_end + 1, end - 1, inner, own)
            for member in own.members:
                own.calls += member.calls
        else:
            body = "\n".join(_rows(lexed, i, end))
            cut = body.find("{" if block else "=>")
            own.calls += _calls(body[cut + 1 :] if cut >= 0 else "", SCRIPT_WORDS)
        i, decorated, noted = end + 1, None, []


def _choose(found: list[Declared], most: int) -> None:
    """Marks what becomes a chunk: the module's own declarations, and members of classes of more than ``most`` lines, which are summed up."""
    for d in found:
        if d.direct and (d.parent is None or d.parent.summed):
            d.chosen = True
            d.summed = d.word == "class" and d.end - d.start + 1 > most and any(m.direct for m in d.members)


def _useful(line: str, script: bool) -> bool:
    return bool(line.strip()) and not (script and line.strip() in {"{", "}", "};", ";"})


def _gaps(lexed: Lexed, found: list[Declared], statements: list[tuple[int, int]], script: bool) -> Iterator[tuple[int, int]]:
    """Spans outside symbols: the module's statements, joined where they touch, and runs of other lines without useless ends."""
    covered = [False] * len(lexed.lines)
    for d in found:
        if d.chosen and not d.summed:
            covered[d.start : d.end + 1] = [True] * (d.end + 1 - d.start)
        elif d.chosen and script:
            covered[d.start : d.head_end + 1] = [True] * (d.head_end + 1 - d.start)
    joined: list[tuple[int, int]] = []
    for a, b in statements:
        if joined and a <= joined[-1][1] + 1:
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
        else:
            joined.append((a, b))
    for a, b in joined:
        yield a, b
        covered[a : b + 1] = [True] * (b + 1 - a)
    i, n = 0, len(covered)
    while i < n:
        j = i
        while j < n and not covered[j]:
            j += 1
        kept = [k for k in range(i, j) if _useful(lexed.lines[k], script)]
        if kept:
            yield kept[0], kept[-1]
        i = max(j, i + 1)


def walk(text: str, script: bool, most: int) -> tuple[list[Declared], list[tuple[int, int]], bool]:
    """Declarations, spans of lines outside chosen ones, and whether the text is broken."""
    lexed = lex(text, script)
    if lexed.broken:
        return [], [], True
    if script:
        found, statements = list(_script(lexed, 0, len(lexed.lines) - 1, 0, None)), []
    else:
        found, statements = _python(lexed)
    _choose(found, most)
    # a text without declarations (prose, say) isn't cut at its statements
    return found, list(_gaps(lexed, found, statements if found else [], script)), False


_FIELDS = "start_line int, end_line int, content string, symbol string, word string, parent string, parent_word string, exported boolean, head string, doc string, calls array<string>, fields array<string>, methods array<string>, nested array<string>, decorators string, direct boolean, chosen boolean, summed boolean, broken boolean"


def declarations(files: DataFrame, script: bool, most: int = 120, overlap: int = 0) -> DataFrame:
    """A row for each declaration of ``files`` and each span of lines outside chosen ones (symbol is null), with all columns but text.

    A broken text has rows for its windows of ``most`` lines instead (broken is true).
    """
    names = [x.split()[0] for x in _FIELDS.split(", ")]
    lists = {"calls", "fields", "methods", "nested"}
    types = {n: pa.list_(pa.string()) if n in lists else pa.int32() if n.endswith("_line") else pa.bool_() if n in {"exported", "direct", "chosen", "summed", "broken"} else pa.string() for n in names}
    carried = [c for c in files.columns if c != "text"]

    def said(d: Declared, lines: list[str]) -> tuple:
        methods, nested = [m.symbol for m in d.members if m.direct and m.word != "class"], [m.symbol for m in d.members if m.direct and m.word == "class"]
        unique = lambda names: list(dict.fromkeys(names))
        above = (d.parent.qualified, d.parent.word) if d.parent else (None, None)
        return (d.start + 1, d.end + 1, "\n".join(lines[d.start : d.end + 1]), d.symbol, d.word, *above, d.exported, d.head, d.doc, unique(d.calls), unique(d.fields), unique(methods), nested, "\n".join(lines[d.start : d.line]), d.direct, d.chosen, d.summed, False)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, of, size = [], [], 0

            def shaped() -> pa.RecordBatch:
                columns = [pa.array(c, types[n]) for n, c in zip(names, zip(*made, strict=True), strict=True)]
                own = batch.select(carried).take(pa.array(of))  # noqa: B023
                return pa.RecordBatch.from_arrays([*own.columns, *columns], [*carried, *names])

            for i, text in enumerate(x.as_py() for x in batch.column("text")):
                lines = text.split("\n") if text else []
                found, gaps, broken = walk(text or "", script, most)
                if broken:
                    gaps = [(a, min(a + most, len(lines)) - 1) for a in range(0, max(len(lines) - overlap, 1), most - overlap)]
                made += [said(d, lines) for d in found] + [(a + 1, b + 1, "\n".join(lines[a : b + 1]), *[None] * 15, broken) for a, b in gaps]
                of += [i] * (len(made) - len(of))
                size += len(text or "")
                # rows of several texts go out together, up to a size
                if made and (size > BATCH_CHARS or len(made) > BATCH_ROWS):
                    yield shaped()
                    made, of, size = [], [], 0
            if made:
                yield shaped()

    texts = files.select(*carried, F.array_join(T.lines(F.col("text")), "\n").alias("text"))
    kept = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in carried)
    return map_arrow(texts, rows, f"{kept}, {_FIELDS}")
