"""Files to chunk documents: each file goes to the chunker that its path asks for.

``chunk_files`` takes repo, path and text and gives one row per chunk with its identity and texts. Files are independent:
sections, statements and windows are cut in one narrow pass, and only call graphs of code files need an exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import classify as C, text as T
from ..functions.arrays import let
from . import chunks

SCHEMA_VERSION = "v5"
# The strategy that a chunker's chunks carry, and the languages of scripts.
STRATEGIES = {"markdown": "doc_section", "rst": "doc_section", "adoc": "doc_section", "env": "config_section", "ini": "config_section", "yaml": "config_section", "json": "config_section", "whole": "config_section", "sql": "sql_statement", "python": "python_symbol", "script": "ts_symbol", "windows": "line_window"}
SCRIPTS = ("typescript", "typescriptreact", "javascript", "javascriptreact")
_OPENS = {"markdown": chunks.markdown_headings, "rst": chunks.rst_headings, "adoc": chunks.adoc_headings, "env": chunks.blank_separated, "ini": chunks.ini_headings, "yaml": chunks.yaml_keys, "json": chunks.json_keys, "sql": chunks.sql_statements}


def chunker(path: Column, kind: Column, language: Column) -> Column:
    """The chunker for a path: by content type, then by ending; code by language, all else by line windows."""
    ending = T.suffix(path)
    docs = F.when(ending == ".rst", "rst").when(ending == ".adoc", "adoc").otherwise("markdown")
    settings = F.when(F.lower(T.base_name(path)) == ".env", "env").when(ending.isin(".ini", ".cfg", ".conf", ".toml"), "ini").when(ending.isin(".yaml", ".yml"), "yaml").when(ending == ".json", "json").otherwise("whole")
    return F.when(kind == "doc_section", docs).when(kind == "config_block", settings).when(kind == "sql_block", "sql").when(language == "python", "python").when(language.isin(*SCRIPTS), "script").otherwise("windows")


def _told(files: DataFrame) -> DataFrame:
    """With content_type, language and chunker, each worked out once."""
    named = files.withColumns({"content_type": C.content_type(F.col("path")), "language": C.language(F.col("path"))})
    return named.withColumn("chunker", chunker(F.col("path"), F.col("content_type"), F.col("language")))


def classified(files: DataFrame) -> DataFrame:
    """What is known of each file before it is read: repo, path, content_type, hint, language, collection, chunker."""
    return _told(files.select("repo", "path")).select("repo", "path", "content_type", C.doc_hint(F.col("path")).alias("hint"), "language", C.collection(F.col("content_type")).alias("collection"), "chunker")


def _cut(lines: Column, chosen: Column, size: int, overlap: int) -> Column:
    """Sections and statements by chunker; windows for the others and where nothing was cut."""
    opens = F.array().cast("array<int>")
    for name, test in _OPENS.items():
        opens = F.when(chosen == name, test(lines)).otherwise(opens)
    sections = F.when(chosen != "windows", chunks.trimmed(lines, chunks.section_spans(lines, opens)))
    named = lambda pieces, strategy: F.transform(pieces, lambda c: F.struct(c["start_line"].alias("start_line"), c["end_line"].alias("end_line"), c["content"].alias("content"), strategy.alias("strategy")))
    strategy = F.try_element_at(F.create_map(*[F.lit(x) for pair in STRATEGIES.items() for x in pair]), chosen)
    windows = chunks.whole(lines, chunks.window_spans(F.size(lines), size, overlap))
    return let(sections, lambda s: F.when(F.coalesce(F.size(s), F.lit(0)) > 0, named(s, strategy)).otherwise(named(windows, F.lit("line_window"))))


def chunk_files(files: DataFrame, size: int = 120, overlap: int = 20) -> DataFrame:
    """One row per chunk of ``files`` (repo, path, text; a null text has none).

    Returns repo, path, language, content_type, collection, strategy, chunk_id, content_hash, start_line, end_line, content,
    summary_text, context_text, chunk_schema_version, symbol, kind, qualified, parent, signature, callees, callers, imports
    and exports. Symbols of code count as code_symbol; a blank code file has no chunk.
    """
    told = _told(files.where(F.col("text").isNotNull()).select("repo", "path", "text"))
    # what the chunks keep of their file goes along in the key, so that repositories may share paths
    key = F.struct("repo", "path", "content_type", "language").alias("path")
    plain = told.where(~F.col("chunker").isin("python", "script")).select(key, "chunker", T.lines(F.col("text")).alias("_lines"))
    found = plain.select("path", F.explode(_cut(F.col("_lines"), F.col("chunker"), size, overlap)).alias("c")).select("path", "c.*")
    for language in ("python", "script"):
        code = chunks.symbol_chunks(told.where(F.col("chunker") == language).select(key, "text"), language, size, overlap)
        # what can't be walked is cut by windows
        code = code.withColumn("strategy", F.when(F.col("broken"), "line_window").otherwise(F.lit(STRATEGIES[language]))).drop("broken")
        found = found.unionByName(code, allowMissingColumns=True)
    found = found.select("path.*", *[c for c in found.columns if c != "path"])
    found = found.withColumn("content_type", F.when(F.col("symbol").isNotNull() & (F.col("content_type") == "code_context"), "code_symbol").otherwise(F.col("content_type")))
    path, start, end, content, kind, language = (F.col(c) for c in ("path", "start_line", "end_line", "content", "content_type", "language"))
    return found.select(
        "repo", "path", "language", "content_type", C.collection(kind).alias("collection"), "strategy",
        T.chunk_id(path, start, end, language, F.col("qualified"), F.col("kind"), F.col("signature")).alias("chunk_id"), T.content_hash(content).alias("content_hash"),
        "start_line", "end_line", "content",
        T.summary_text(path, language, start, end, kind, content, F.col("qualified"), F.col("kind")).alias("summary_text"),
        T.context_text(path, language, start, end, kind, F.col("strategy"), content).alias("context_text"),
        F.lit(SCHEMA_VERSION).alias("chunk_schema_version"), "symbol", "kind", "qualified", "parent", "signature", "callees", "callers", "imports", "exports",
    )
