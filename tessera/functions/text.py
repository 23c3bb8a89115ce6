"""Column builders for text: all stay in the JVM."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, functions as F

from .arrays import let


def collapsed(text: Column) -> Column:
    """Runs of white space (any Unicode kind) become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def truncated(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last three of a cut text being dots."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 3)), F.lit("..."))).otherwise(text)


def lines(text: Column) -> Column:
    """Lines without their ends; a final line end adds none, and an empty text has none."""
    unified = F.regexp_replace(text, "\r\n?", "\n")
    cut = F.split(F.regexp_replace(unified, "\n\\z", ""), "\n", -1)
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(cut)


def first_useful_line(text: Column, most: int = 120) -> Column:
    """The first line that isn't blank, collapsed and cut; null if there is none."""
    return truncated(F.get(F.filter(F.transform(lines(text), collapsed), lambda x: x != ""), F.lit(0)), most)


def line_range(start: Column, end: Column) -> Column:
    return F.when(start == end, F.concat(F.lit("line "), start.cast("string"))).otherwise(F.concat(F.lit("lines "), start.cast("string"), F.lit("-"), end.cast("string")))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def suffix(path: Column) -> Column:
    """The lower-cased extension of the last path part with its dot; names that begin with their only dot have none."""
    return F.lower(F.regexp_extract(base_name(path), r"(?<=.)(\.[^.]+)$", 1))


def rooted(path: Column) -> Column:
    """Lower case, forward slashes, one slash in front and none behind."""
    return F.concat(F.lit("/"), F.btrim(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), F.lit("/")))


def matches_any(text: Column, globs: list[str]) -> Column:
    """Whether a shell pattern matches the whole text; ``*`` also crosses slashes."""
    if not globs:
        return F.lit(False)
    return text.rlike("|".join(f"^(?:{fnmatch.translate(g).removeprefix('(?s:').removesuffix(r')\Z')})$" for g in globs))


def found_in(text: Column, parts: tuple[str, ...]) -> Column:
    """Those of the parts that the text contains, in their order; the text is worked out once."""
    return let(text, lambda t: F.filter(F.array(*[F.lit(p) for p in parts]), lambda p: t.contains(p)))


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    return F.coalesce(F.size(found_in(text, parts)) > 0, F.lit(False))


def content_hash(text: Column) -> Column:
    """SHA-256 of the text with line ends unified."""
    return F.sha2(F.regexp_replace(text, "\r\n?", "\n").cast("binary"), 256)


def chunk_id(path: Column, start: Column, end: Column, language: Column, qualified: Column | None = None, kind: Column | None = None, signature: Column | None = None) -> Column:
    """Identity of a chunk: by symbol where one is named, else by line range."""
    by_range = F.concat_ws(":", path, start.cast("string"), end.cast("string"), language)
    if qualified is None:
        return F.sha2(by_range.cast("binary"), 256)
    named = lambda value, default: F.lit(default) if value is None else F.coalesce(value, F.lit(default))
    by_symbol = F.concat_ws(":", path, language, qualified, named(kind, "symbol"), named(signature, "no-signature"))
    return F.sha2(F.when(qualified.isNull(), by_range).otherwise(by_symbol).cast("binary"), 256)


def url_uuid(name: Column) -> Column:
    """The name-based (SHA-1) UUID of a name in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), name.cast("binary")))
    # the variant's two leading bits are 10, so its digit is 8, 9, a or b
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.instr(F.lit("0123456789abcdef"), F.substring(digest, 17, 1)), F.lit(1))
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def point_id(repo: Column, root: Column, chunk: Column) -> Column:
    return url_uuid(F.concat_ws(":", repo, root, chunk))


def summary_text(path: Column, language: Column, start: Column, end: Column, kind: Column, content: Column, symbol: Column | None = None, symbol_kind: Column | None = None) -> Column:
    label = lambda name, value: F.concat(F.lit(f"{name}="), value)
    none = F.lit(None).cast("string")
    return F.concat_ws(
        " | ", path, language, line_range(start, end), label("type", F.coalesce(kind, F.lit("unknown"))),
        none if symbol is None else label("symbol", symbol), none if symbol_kind is None else label("symbol_type", symbol_kind), label("first_line", first_useful_line(content)),
    )


def context_text(path: Column, language: Column, start: Column, end: Column, kind: Column, strategy: Column, content: Column) -> Column:
    label = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    preview = truncated(collapsed(content), 280)
    return F.concat_ws(
        "\n", label("Path", path), label("Language", language), label("Range", line_range(start, end)), label("Type", F.coalesce(kind, F.lit("unknown"))),
        label("Chunk strategy", strategy), F.when(preview != "", label("Preview", preview)),
    )


def embedding_input(content: Column, summary: Column, with_summary: bool) -> Column:
    return F.when(F.coalesce(summary, F.lit("")) != "", F.concat(summary, F.lit("\n\n"), content)).otherwise(content) if with_summary else content


def word_set(text: Column) -> Column:
    """Distinct lower-case tokens of ASCII letters, digits and underscores."""
    # \W is [^a-zA-Z0-9_], and Java's matcher goes over it some ten times faster than over the class spelt out
    return F.array_distinct(F.array_remove(F.split(F.lower(text), r"\W+", -1), ""))


def jaccard(left: Column, right: Column) -> Column:
    """Share of common elements; 0 if either set is empty."""
    common, union = F.size(F.array_intersect(left, right)), F.size(F.array_union(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(common / union)


def token_estimate(text: Column) -> Column:
    """1.15 tokens a word, rounded half to even, one at least."""
    words = F.size(F.filter(F.split(collapsed(text), " ", -1), lambda x: x != ""))
    return F.greatest(F.lit(1), F.bround(words * F.lit(1.15)).cast("int"))


def plain_letters(text: Column) -> Column:
    """Lower case without the accents of Latin letters."""
    return F.translate(F.lower(text), "áàâãäåéèêëíìîïóòôõöúùûüçñýÿ", "aaaaaaeeeeiiiiooooouuuucnyy")


def byte_cut(text: Column, most: int) -> Column:
    """The longest prefix of at most ``most`` UTF-8 bytes that ends between characters."""
    data = F.encode(text, "UTF-8")
    # if the next byte continues a character (10xxxxxx), what there is of that character goes
    digits = F.hex(F.substring(data, 1, most))
    inside = F.hex(F.substring(data, most + 1, 1)).rlike("^[89AB]")
    kept = F.when(inside, F.regexp_replace(digits, "[C-F].(?:[89AB].)*$", "")).otherwise(digits)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.unhex(kept), "UTF-8"))
