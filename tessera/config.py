"""Settings as frozen values; lists are fixed values that results depend on."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

# What a scan leaves out and takes in.
IGNORED_DIRS = (".git", "node_modules", "dist", "build", ".next", ".qdrant_storage", "coverage", ".venv", "venv", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache")
ALLOWED_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".py", ".md", ".mdx", ".rst", ".adoc", ".txt", ".json", ".toml", ".ini", ".cfg", ".conf", ".yaml", ".yml", ".sql")
EXCLUDED_CONTEXT_PARTS = ("/.venv/", "/venv/", "/__pycache__/", "/.pytest_cache/", "/.mypy_cache/", "/.ruff_cache/")
# How a path's content type is told.
DOC_EXTENSIONS = (".md", ".mdx", ".rst", ".adoc", ".txt")
DOC_PATH_HINTS = ("/docs/", "/documentation/", "/adr", "/wiki/", "/changelog", "/contributing", "/license", "/readme")
TEST_PATH_MARKERS = ("/tests/", "/test/", "/__tests__/", "/spec/", "/specs/")
TEST_FILE_MARKERS = (".test.", ".spec.", "_test.", "_spec.")
CONFIG_SUFFIXES = (".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf")
CONFIG_PATH_MARKERS = ("/config/", "/configs/", "/conf/", "/settings/")
CONFIG_FILE_NAMES = (".env", "package.json", "pyproject.toml", "tsconfig.json", "jsconfig.json", "nest-cli.json", "docker-compose.yml", "docker-compose.yaml")
CONFIG_STEM_MARKERS = ("config", "settings", "profile", "compose")
# Names of languages and of the two collections.
LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescriptreact", ".js": "javascript", ".jsx": "javascriptreact", ".py": "python", ".md": "markdown", ".mdx": "markdown", ".rst": "rst", ".adoc": "asciidoc",
    ".txt": "text", ".json": "json", ".toml": "toml", ".ini": "ini", ".cfg": "ini", ".conf": "ini", ".yaml": "yaml", ".yml": "yaml", ".sql": "sql",
}
COLLECTIONS = {"doc_section": "docs", "code_context": "code", "code_symbol": "code", "config_block": "code", "sql_block": "code", "test_case": "code"}

CHUNK_LINES, CHUNK_OVERLAP = 120, 20
SCHEMA_VERSION = "v5"


def csv(value: str | None) -> list[str]:
    """Trimmed, non-empty items."""
    return [x for x in (part.strip() for part in (value or "").split(",")) if x]


def positive_int(value: object, default: int) -> int:
    """A positive whole number from text or a number, else the default."""
    try:
        number = int(str(value).strip())
    except ValueError:
        return default
    return number if number > 0 else default


def truth(value: object, default: bool = False) -> bool:
    text = str(value).strip().lower() if value is not None else ""
    return text in ("1", "true", "yes", "on") if text else default


def share(value: object, default: float) -> float:
    """A number in (0, 1], else the default."""
    try:
        number = float(str(value))
    except ValueError:
        return default
    return number if 0 < number <= 1 else default


@dataclass(frozen=True)
class ScanConfig:
    """What a scan takes; extra directories add to the default ones, extensions replace them."""

    ignored_dirs: tuple[str, ...] = IGNORED_DIRS
    extensions: tuple[str, ...] = ALLOWED_EXTENSIONS
    ignored_patterns: tuple[str, ...] = ()
    max_files: int | None = None

    @classmethod
    def load(cls, extra_dirs: tuple[str, ...] = (), extensions: tuple[str, ...] | None = None, patterns: tuple[str, ...] | None = None, env: Mapping[str, str] | None = None) -> ScanConfig:
        env = os.environ if env is None else env
        chosen = patterns if patterns is not None else tuple(csv(env.get("SCAN_IGNORE_PATTERNS")))
        return cls(tuple(dict.fromkeys([*IGNORED_DIRS, *extra_dirs])), tuple(e if e.startswith(".") else f".{e}" for e in extensions) if extensions else ALLOWED_EXTENSIONS, chosen)


@dataclass(frozen=True)
class ChunkConfig:
    lines: int = CHUNK_LINES
    overlap: int = CHUNK_OVERLAP

    def __post_init__(self):
        if self.lines <= 0 or not 0 <= self.overlap < self.lines:
            raise ValueError("lines must be positive and overlap in [0, lines)")


@dataclass(frozen=True)
class DecayConfig:
    """How fast confidence fades by kind, and how much confirmations help."""

    preference: float = 0.08
    convention: float = 0.03
    fact: float = 0.01
    step: float = 0.08
    cap: float = 1.6


@dataclass(frozen=True)
class Scope:
    """Which repositories a search sees: one, several (at most ten), or all."""

    kind: str
    repos: tuple[str, ...] = field(default=())

    @classmethod
    def of(cls, kind: str, repos: list[str] | None = None, allow_all: bool = False) -> Scope:
        names = tuple(dict.fromkeys(r.strip() for r in repos or [] if r.strip()))
        if kind == "all":
            if not allow_all:
                raise ValueError("scope all is not allowed")
            return cls("all")
        if kind not in ("repo", "repos") or not names or kind == "repo" and len(names) != 1:
            raise ValueError("a scope names its repositories")
        if len(names) > 10:
            raise ValueError("at most ten repositories")
        for name in names:
            valid_repo(name)
        return cls(kind, names)


def valid_repo(name: str) -> str:
    if not name or len(name) > 200 or any(x in name for x in ("\0", "/", "\\", "..")):
        raise ValueError(f"not a repository name: {name!r}")
    return name


def valid_path(path: str) -> str:
    """A relative path in normal form; absolute, drive, share and climbing paths raise."""
    import posixpath

    text = path.replace("\\", "/")
    if not text.strip() or "\0" in text or text.startswith("/") or text[1:2] == ":" or ".." in text.split("/"):
        raise ValueError(f"not a relative path: {path!r}")
    return posixpath.normpath(text)


@dataclass(frozen=True)
class SearchRequest:
    """Limits on a search: query of 1 to 500 characters, top k of 1 to 20."""

    query: str
    top_k: int = 10
    path_prefix: str | None = None
    language: str | None = None
    content_type: str = "all"
    strict: bool = False
    min_score: float = 0.6

    @classmethod
    def of(cls, query: str, top_k: float | None = None, default_k: int = 10, **rest) -> SearchRequest:
        text = query.strip()
        if not 1 <= len(text) <= 500:
            raise ValueError("a query has 1 to 500 characters")
        k = default_k if top_k is None else max(1, min(20, int(top_k)))
        made = cls(text, k, **rest)
        if made.content_type not in ("code", "docs", "all"):
            raise ValueError("content type is code, docs or all")
        if len(made.path_prefix or "") > 200 or len(made.language or "") > 32:
            raise ValueError("path prefix or language is too long")
        return made
