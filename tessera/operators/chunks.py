"""Splitting texts into chunks of lines: windows, sections, configuration blocks, statements, symbols.

All take ``files`` with path and text and give one row per chunk: path, chunk_index, start_line, end_line (1-based,
inclusive), content. A boundary chunker marks lines that open a chunk; a chunk ends before the next one. All but the
lexical walk over code (``code``) stays in expressions over a text's lines, so files are independent and nothing is
shuffled. Chunks are cut out before rows are made of them, so no row ever carries its file's lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..functions.arrays import let, totals_before
from .code import declarations


def useful(script: Column | bool = False) -> Callable[[Column], Column]:
    """Tests lines: neither blank nor, in scripts, closing marks alone."""
    return lambda x: x.rlike(r"(?U)\S") & ~(F.lit(script) & x.rlike(r"(?U)^\s*(?:[{}]|\};|;)\s*$"))


def trimmed(lines: Column, spans: Column, counts: Callable[[Column], Column] = useful()) -> Column:
    """start_line, end_line, content of the spans (start, end; 1-based) without the lines at their edges that don't count."""

    def cut(span: Column) -> Column:
        def edges(body: Column) -> Column:
            full = F.filter(F.transform(body, lambda x, i: F.when(counts(x), i)), lambda i: i.isNotNull())
            return let(F.struct(F.array_min(full).alias("first"), F.array_max(full).alias("last")), lambda e: F.when(e["first"].isNotNull(), F.struct((span["start"] + e["first"]).alias("start_line"), (span["start"] + e["last"]).alias("end_line"), F.array_join(F.slice(body, e["first"] + 1, e["last"] - e["first"] + 1), "\n").alias("content"))))

        return let(F.slice(lines, span["start"], F.greatest(span["end"] - span["start"] + 1, F.lit(0))), edges)

    return F.array_compact(F.transform(spans, cut))


def window_spans(count: Column, size: int, overlap: int) -> Column:
    """start, end of the windows of ``size`` lines, each sharing ``overlap`` lines with the one before; none without lines."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap in [0, size)")
    starts = F.sequence(F.lit(0), F.greatest(count - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(count > 0, F.transform(starts, lambda s: F.struct((s + 1).alias("start"), F.least(s + size, count).alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def whole(lines: Column, spans: Column) -> Column:
    """start_line, end_line, content of the spans as they are."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start_line"), s["end"].alias("end_line"), F.array_join(F.slice(lines, s["start"], s["end"] - s["start"] + 1), "\n").alias("content")))


def windows(files: DataFrame, size: int = 120, overlap: int = 20) -> DataFrame:
    """Windows of ``size`` lines, each sharing ``overlap`` lines with the one before."""
    rows = files.select("path", T.lines(F.col("text")).alias("_lines"))
    cut = rows.select("path", F.posexplode(whole(F.col("_lines"), window_spans(F.size("_lines"), size, overlap))).alias("chunk_index", "c"))
    return cut.select("path", "chunk_index", "c.*")


def section_spans(lines: Column, opens: Column) -> Column:
    """start, end of the sections that begin at the 0-based indexes ``opens``; what stands before is one too."""
    starts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), opens)))
    return let(starts, lambda at: F.transform(at, lambda s, i: F.struct((s + 1).alias("start"), F.coalesce(F.get(at, i + 1), F.size(lines)).alias("end"))))


def sections(files: DataFrame, opens: Callable[[Column], Column]) -> DataFrame:
    """Chunks that begin at the lines whose 0-based indexes ``opens`` (of the lines) gives; what stands before is one too."""
    rows = files.select("path", T.lines(F.col("text")).alias("_lines"))
    cut = rows.select("path", F.explode(trimmed(F.col("_lines"), section_spans(F.col("_lines"), opens(F.col("_lines"))))).alias("c"))
    return cut.select("path", "c.*")


def _where(lines: Column, test: Callable[[Column, Column], Column]) -> Column:
    return F.filter(F.transform(lines, lambda x, i: F.when(test(x, i), i)), lambda i: i.isNotNull())


def markdown_headings(lines: Column) -> Column:
    """Lines ``# heading`` (up to six marks, three spaces before) outside fenced blocks.

    A fence opens with three or more of one mark and closes with as many or more of the same alone on a line.
    """
    start = F.struct(F.lit("").alias("fence"), F.array().cast("array<int>").alias("found"), F.lit(0).alias("at"))

    def step(acc: Column, line: Column) -> Column:
        mark = F.regexp_extract(line, r"^ {0,3}(`{3,}|~{3,})", 1)
        inside = acc["fence"] != ""
        closes = inside & (F.substring(mark, 1, 1) == F.substring(acc["fence"], 1, 1)) & (F.length(mark) >= F.length(acc["fence"])) & line.rlike(r"^ {0,3}(`{3,}|~{3,})\s*$")
        fence = F.when(closes, F.lit("")).when(inside, acc["fence"]).otherwise(mark)
        heading = ~inside & (mark == "") & line.rlike(r"^ {0,3}#{1,6}\s+\S")
        return F.struct(fence.alias("fence"), F.when(heading, F.array_append(acc["found"], acc["at"])).otherwise(acc["found"]).alias("found"), (acc["at"] + 1).alias("at"))

    # most texts have no fence, and then lines are told one by one
    plain = _where(lines, lambda x, i: x.rlike(r"^ {0,3}#{1,6}\s+\S"))
    return F.when(F.exists(lines, lambda x: x.rlike(r"^ {0,3}(`{3}|~{3})")), F.aggregate(lines, start, step, lambda acc: acc["found"])).otherwise(plain)


def rst_headings(lines: Column) -> Column:
    """Titles that the next line underlines with one repeated mark, as long as the title and three at least."""
    under = lambda i: F.rtrim(F.coalesce(F.get(lines, i + 1), F.lit("")))
    return _where(lines, lambda x, i: x.rlike(r"(?U)\S") & under(i).rlike(r"""^([=\-~^"'`:#*+.<>_])\1{2,}$""") & (F.length(under(i)) >= F.length(F.rtrim(x))) & ~x.rlike(r"""^([=\-~^"'`:#*+.<>_])\1{2,}\s*$"""))


def adoc_headings(lines: Column) -> Column:
    return _where(lines, lambda x, i: x.rlike(r"^\s*={1,6}\s+\S"))


def ini_headings(lines: Column) -> Column:
    return _where(lines, lambda x, i: x.rlike(r"^\s*\[{1,2}[^\[\]]+\]{1,2}\s*$"))


def yaml_keys(lines: Column) -> Column:
    """Unindented lines with a colon that are neither list items nor comments."""
    return _where(lines, lambda x, i: x.rlike(r"^[^\s#\-].*:|^:"))


def blank_separated(lines: Column) -> Column:
    """First lines after blank ones."""
    return _where(lines, lambda x, i: x.rlike(r"(?U)\S") & (i > 0) & ~F.coalesce(F.get(lines, i - 1), F.lit("")).rlike(r"(?U)\S"))


def _depths(lines: Column, opening: str, closing: str) -> Column:
    """Bracket depth before each line."""
    change = lambda x: F.length(F.regexp_replace(x, f"[^{opening}]", "")) - F.length(F.regexp_replace(x, f"[^{closing}]", ""))
    return totals_before(F.transform(lines, change))


def json_keys(lines: Column) -> Column:
    """Lines on which a key of the outermost object begins; strings are blanked before brackets are counted."""
    bare = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, r"\\.", ""), '"[^"]*"', '"'))
    opens = lambda depths: _where(bare, lambda x, i: (F.get(depths, i) == 1) & x.rlike(r'^\s*"\s*:'))
    return let(_depths(bare, r"{\[", r"}\]"), opens)


def sql_statements(lines: Column) -> Column:
    """Lines after one that ends a statement: a semicolon outside brackets, comments, quotes and dollar quotes.

    What is quoted or commented is blanked in the whole text first, line ends kept, so it may span lines.
    """
    quiet = F.regexp_replace(F.array_join(lines, "\n"), r"""(?s)--[^\n]*|/\*.*?\*/|'[^']*'|"[^"]*"|(\$\w*\$).*?\1""", "\u0001$0\u0002")
    # between the two marks only line ends stay
    pieces = F.split(quiet, "\u0002", -1)
    bare = F.array_join(F.transform(pieces, lambda p: F.concat(F.substring_index(p, "\u0001", 1), F.when(p.contains("\u0001"), F.regexp_replace(F.substring_index(p, "\u0001", -1), "[^\n]", "")).otherwise(F.lit("")))), "")
    count = lambda x, mark: F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit("")))

    def ends(rows: Column, depths: Column) -> Column:
        # a line ends a statement if brackets balance before one of its semicolons
        balanced = lambda x, i: F.exists(F.sequence(F.lit(1), F.greatest(count(x, ";"), F.lit(1))), lambda k: x.contains(";") & let(F.call_function("substring_index", x, F.lit(";"), k), lambda before: F.get(depths, i) + count(before, "(") - count(before, ")") <= 0))
        return F.filter(F.transform(_where(rows, balanced), lambda i: i + 1), lambda i: i < F.size(lines))

    return let(F.split(bare, "\n", -1), lambda rows: let(_depths(rows, "(", ")"), lambda depths: ends(rows, depths)))


def _kind(script: bool) -> Column:
    hook = F.col("symbol").rlike("^use[A-Z0-9_]")
    markup = F.col("content").rlike(r"<[A-Za-z/>]")
    component = (F.col("symbol").rlike("^[A-Z]") | ((F.col("symbol") == "default") & F.col("exported") & F.col("content").rlike("/>|</"))) & markup
    kind = F.when(F.col("word") == "class", "class").when(F.col("parent").isNotNull(), "method")
    if script:
        kind = kind.when(hook, "hook").when(component, "component").when(F.col("exported"), "helper")
    return kind.otherwise("function")


def _qualified(found: DataFrame, script: bool) -> DataFrame:
    return found.withColumns({"kind": F.when(F.col("symbol").isNotNull(), _kind(script)), "qualified": F.when(F.col("symbol").isNotNull(), F.concat_ws(".", "parent", "symbol"))})


def symbols(files: DataFrame, language: str) -> DataFrame:
    """One row per declared symbol of the module and its classes: path, symbol, kind, qualified, parent, start_line, end_line, content, exported, calls.

    Decorators belong to what they stand before. See ``code`` for where a symbol ends.
    """
    script = language != "python"
    found = _qualified(declarations(files, script).where("symbol IS NOT NULL AND direct"), script)
    return found.select("path", "symbol", "kind", "qualified", "parent", "start_line", "end_line", "content", "exported", "calls")


# What a class summary's lines begin with.
SUMMARY = ("docstring: ", "class_attributes: ", "fields: ", "methods: ", "nested_classes: ", "class_summary: ")


def _summary(script: bool) -> Column:
    """What a large class is about: head, docstring, attributes and members by name."""
    docstring, attributes, fields, methods, nested, summed = SUMMARY
    named = lambda label, names: F.when(F.size(names) > 0, F.concat(F.lit(label), F.array_join(names, ", ")))
    if script:
        decorators = F.when(F.col("decorators") != "", F.regexp_replace("decorators", r"(?m)^\s*\n", ""))
        return F.concat_ws("\n", decorators, "head", named(fields, "fields"), named(methods, "methods"), F.concat(F.lit(summed), "symbol"))
    doc = F.when(T.collapsed(F.col("doc")) != "", F.concat(F.lit(docstring), T.truncated(T.collapsed(F.col("doc")), 160)))
    return F.concat_ws("\n", "head", doc, named(attributes, "fields"), named(methods, "methods"), named(nested, "nested"))


def _imports(text: Column) -> Column:
    """Modules that a script imports, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"""(?m)^import\s+(?:[^'";]*?\bfrom\s+)?['"]([^'"]+)['"]"""), F.lit(1)))


def _exports(text: Column) -> Column:
    """Names that a script exports: declared ones, then lists and defaults."""
    declared = F.regexp_extract_all(text, F.lit(r"(?m)^export\s+(?:default\s+)?(?:async\s+)?(?:abstract\s+)?(?:function\*?|class|const|let|var|interface|type|enum)\s+([A-Za-z_$][\w$]*)"), F.lit(1))
    lists = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^export\s*\{([^}]*)\}"), F.lit(1)), lambda x: F.split(x, ",")))
    listed = F.filter(F.transform(lists, lambda x: F.trim(F.regexp_replace(T.collapsed(x), r"^.* as ", ""))), lambda x: x != "")
    default = F.regexp_extract_all(text, F.lit(r"(?m)^export\s+default\s+(?!(?:async\s+)?(?:function|class|abstract)\b)([A-Za-z_$][\w$]*)\s*;?\s*$"), F.lit(1))
    return F.array_distinct(F.concat(declared, listed, default))


def symbol_chunks(files: DataFrame, language: str, most: int = 120, overlap: int = 0) -> DataFrame:
    """Chunks of code files: the module's symbols with their calls, and the lines between them.

    A class of more than ``most`` lines that has members is a chunk that sums it up, and its members are chunks. Returns path,
    start_line, end_line, content, symbol, kind, qualified, parent, signature, callees, callers, imports, exports and
    broken; symbol and what depends on it is null for lines between symbols. A text of blank lines has no chunk; one whose
    brackets or strings don't end has windows of ``most`` lines, with broken set.
    """
    script = language != "python"
    none = F.array().cast("array<string>")
    lists = [_imports(F.col("text")), _exports(F.col("text"))] if script else [none, none]
    told = files.select("path", lists[0].alias("imports"), lists[1].alias("exports"), "text")
    rows = _qualified(declarations(told, script, most, overlap).where("symbol IS NULL OR chosen"), script)
    shown = F.when(F.col("summed"), _summary(script)).otherwise(F.col("content")).alias("content")
    # only what a chunk keeps goes through the exchange
    slim = rows.select("path", "start_line", "end_line", shown, "imports", "exports", "broken", "symbol", "kind", "qualified", "parent", F.nullif("head", F.lit("")).alias("signature"), "calls")
    return call_graph(slim).drop("calls")


#: Characters of text whose symbols and calls meet in one task.
TASK_CHARS = 8 << 20


def dealt(texts: DataFrame) -> int:
    """How many tasks the symbols of ``texts`` (text) are dealt to: as many as the session shuffles into, more for much text."""
    # one number
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(_shuffled(texts), -(-chars // TASK_CHARS))


def _shuffled(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def call_graph(found: DataFrame, tasks: int | None = None) -> DataFrame:
    """callees and callers of each symbol, resolved within its file from the names it calls (``calls``).

    A called name is a qualified name, a member of the caller's class (``self.x``, ``this.x``, ``cls.x``), a simple
    name that is unique in the file, or stays as written. Callers are the reverse, without the symbol itself. Rows
    without a symbol have neither.

    A file's symbols and calls meet by ``path`` in one exchange: names are resolved by windows and edges gathered by groups within
    that partitioning, so what made ``found`` is worked out once. A symbol's other columns ride on its own row, not on its calls.
    Rows are dealt to ``tasks`` (see ``dealt``; unless told, as many as the session shuffles into): calls and windows take many times
    a symbol's shuffled bytes, so partitions shouldn't be put together by size.
    """
    told = found.repartition(tasks or _shuffled(found), "path").select(
        "path", F.struct(*[F.col(c) for c in found.columns if c != "path"]).alias("_row"), F.col("qualified").alias("_caller"), F.col("symbol").alias("_symbol"), F.col("start_line").alias("_start"),
        F.when(F.col("kind") == "class", F.col("qualified")).otherwise(F.col("parent")).alias("_owner"), F.coalesce("calls", F.array().cast("array<string>")).alias("_calls"),
    )
    # a row for the symbol itself (its name is null), and one for each call
    itself = F.array(F.struct(F.lit(-1).alias("at"), F.lit(None).cast("string").alias("name")))
    rows = told.withColumn("_c", F.explode(F.concat(itself, F.transform("_calls", lambda x, i: F.struct(i.alias("at"), x.alias("name"))))))
    rows = rows.select("path", F.when(F.col("_c.at") < 0, F.col("_row")).alias("_row"), "_caller", "_symbol", "_start", "_owner", F.col("_c.at").alias("_at"), F.col("_c.name").alias("_name"))
    own = r"^(?:self|this|cls)\."
    wanted = F.when(F.col("_name").rlike(own) & F.col("_owner").isNotNull(), F.concat_ws(".", "_owner", F.regexp_replace("_name", own, ""))).otherwise(F.col("_name"))
    defined = F.col("_at") < 0
    rows = rows.withColumns({"_wanted": F.when(defined, F.col("_caller")).otherwise(wanted), "_simple": F.when(defined, F.col("_symbol")).otherwise(F.col("_name"))})
    same = lambda key: Window.partitionBy("path", key)
    rows = rows.withColumn("_by_name", F.max(F.when(defined, F.col("_caller"))).over(same("_wanted")))
    least, most = (f(F.when(defined, F.col("_caller"))).over(same("_simple")) for f in (F.min, F.max))
    rows = rows.withColumn("_by_symbol", F.when(least == most, least)).withColumn("_start", F.min("_start").over(same("_caller")))
    rows = rows.withColumn("_callee", F.coalesce("_by_name", "_by_symbol", "_name"))
    edge = lambda at, name: F.struct(at.alias("at"), name.alias("name"))
    nothing = F.lit(None).cast("struct<at:int,name:string>")
    end = lambda key, row, callee, caller: F.struct(key.alias("key"), row.alias("row"), callee.alias("callee"), caller.alias("caller"))
    no_row = F.when(F.lit(False), F.col("_row"))
    out, into = end(F.col("_caller"), no_row, edge(F.col("_at"), F.col("_callee")), nothing), end(F.col("_callee"), no_row, nothing, edge(F.col("_start"), F.col("_caller")))
    ends = F.when(defined, F.array(end(F.col("_caller"), F.col("_row"), nothing, nothing))).when(F.col("_caller") == F.col("_callee"), F.array(out)).otherwise(F.array(out, into))
    ordered = lambda edges: F.array_distinct(F.transform(F.array_sort(edges), lambda x: x["name"]))
    met = rows.select("path", F.explode(ends).alias("_e")).groupBy("path", F.col("_e.key").alias("_key"))
    met = met.agg(F.collect_list("_e.row").alias("_rows"), ordered(F.collect_list("_e.callee")).alias("callees"), ordered(F.collect_list("_e.caller")).alias("callers"))
    return met.select("path", F.explode("_rows").alias("_row"), *[F.when(F.col("_key").isNotNull(), F.col(c)).alias(c) for c in ("callees", "callers")]).select("path", "_row.*", "callees", "callers")


def numbered(found: DataFrame) -> DataFrame:
    """chunk_index in order of lines within each path."""
    return found.withColumn("chunk_index", F.row_number().over(Window.partitionBy("path").orderBy("start_line", "end_line")) - 1)


def paragraphs(texts: DataFrame, most: int = 300) -> DataFrame:
    """id, at, piece: texts cut after blank lines and packed up to ``most`` characters; longer pieces by line, then by width.

    Separators stay with what they follow, so the pieces in order give the text again.
    """
    cut = F.filter(F.split("text", r"(?<=\n\n)(?!\n)", -1), lambda p: p != "")
    by_line = lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(F.regexp_extract_all(p, F.lit(r"[^\n]*\n+|[^\n]+"), F.lit(0)))
    small = F.flatten(F.transform(F.flatten(F.transform(cut, by_line)), lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / most).cast("int")), lambda k: F.substring(p, k * most + 1, F.lit(most)))))
    empty = F.array().cast("array<string>")
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(""))
    packed = F.aggregate(small, empty, lambda acc, p: F.when((F.size(acc) > 0) & (F.length(last(acc)) + F.length(p) <= most), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last(acc), p)))).otherwise(F.array_append(acc, p)))
    return texts.select("id", F.posexplode(packed).alias("at", "piece"))
