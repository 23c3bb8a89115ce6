"""What a path says about its file: content type, language, collection. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import config
from .text import base_name, contains_any, found_in, rooted, suffix


def doc_hint(path: Column) -> Column:
    """The first documentation hint within the path, null if there is none."""
    return F.get(found_in(rooted(path), config.DOC_PATH_HINTS), F.lit(0))


def is_test(path: Column) -> Column:
    name = F.lower(base_name(path))
    return contains_any(rooted(path), config.TEST_PATH_MARKERS) | name.startswith("test_") | contains_any(name, config.TEST_FILE_MARKERS)


def is_config(path: Column) -> Column:
    name, ext = F.lower(base_name(path)), suffix(path)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")
    named = name.isin(*config.CONFIG_FILE_NAMES) | contains_any(stem, config.CONFIG_STEM_MARKERS) | contains_any(rooted(path), config.CONFIG_PATH_MARKERS)
    return (name == ".env") | (ext.isin(*config.CONFIG_SUFFIXES) & named)


def content_type(path: Column) -> Column:
    """Documents before tests before SQL before configuration; all else is code."""
    return (
        F.when(doc_hint(path).isNotNull() | suffix(path).isin(*config.DOC_EXTENSIONS), "doc_section")
        .when(is_test(path), "test_case")
        .when(suffix(path) == ".sql", "sql_block")
        .when(is_config(path), "config_block")
        .otherwise("code_context")
    )


def _lookup(names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])


def language(path: Column) -> Column:
    return F.coalesce(F.try_element_at(_lookup(config.LANGUAGES), suffix(path)), F.lit("text"))


def collection(kind: Column) -> Column:
    """Code or docs; an unknown content type raises."""
    found = F.try_element_at(_lookup(config.COLLECTIONS), kind)
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("unknown content type: "), F.coalesce(kind, F.lit("null")))))


def excluded_from_context(path: Column) -> Column:
    """Whether a path lies in a virtual environment or a cache."""
    return contains_any(F.concat(rooted(path), F.lit("/")), config.EXCLUDED_CONTEXT_PARTS)


def speaks(path: Column, wanted: str) -> Column:
    """Whether a path's ending fits a language's name or an extension."""
    # Extensions of the language names that a request may use.
    endings = {
        "ts": (".ts", ".tsx"), "tsx": (".tsx",), "js": (".js", ".jsx"), "jsx": (".jsx",), "py": (".py",), "md": (".md",),
        "json": (".json",), "yaml": (".yaml", ".yml"), "yml": (".yml", ".yaml"), "txt": (".txt",),
    }
    name = wanted.strip().lower()
    own = (name,) if name.startswith(".") else endings.get(name, (f".{name}",))
    out = F.lit(False)
    for ending in own:
        out = out | F.lower(path).endswith(ending)
    return out
