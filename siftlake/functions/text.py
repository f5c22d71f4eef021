"""Column expressions over code, queries and paths; all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftlake.sources.urls import TRANSPORTS

# They decide which results a search gives.
IDENTIFIER = "[a-zA-Z_][a-zA-Z0-9_]*"
CAMEL_PART = "[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
SYMBOL_QUERY = (
    r"^(?:[A-Za-z_][A-Za-z0-9_]*(?:(?:::|\\|->|\.)[A-Za-z_][A-Za-z0-9_]*)+"
    r"|_[A-Za-z0-9_]*|[A-Za-z][A-Za-z0-9]*[A-Z_][A-Za-z0-9_]*|[A-Z][A-Za-z0-9]*)$"
)
EMBEDDED_SYMBOL = r"\b(?:[A-Z][a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*|[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]+)\b"
STOPWORDS = (
    "a an and are as at be by do does for from has have how if in is it not of on or the to was"
    " what when where which who why with"
).split()
DEFINITION_KEYWORDS = [
    "class", "module", "defmodule", "def", "interface", "struct", "enum", "trait", "type", "func", "function", "object",
    "abstract class", "data class", "fn", "fun", "package", "namespace", "protocol", "record", "typedef",
]
SQL_DEFINITIONS = ["CREATE TABLE", "CREATE VIEW", "CREATE PROCEDURE", "CREATE FUNCTION"]
TEST_FILES = [
    r"test_[^/]*\.py", r"[^/]*_test\.py",
    r"[^/]*_test\.go",
    r"[^/]*Tests?\.java",
    r"[^/]*Test\.php",
    r"[^/]*_spec\.rb", r"[^/]*_test\.rb",
    r"[^/]*\.test\.[jt]sx?", r"[^/]*\.spec\.[jt]sx?",
    r"[^/]*Tests?\.kt", r"[^/]*Spec\.kt",
    r"[^/]*Tests?\.swift", r"[^/]*Spec\.swift",
    r"[^/]*Tests?\.cs",
    r"test_[^/]*\.cpp", r"[^/]*_test\.cpp", r"test_[^/]*\.c", r"[^/]*_test\.c",
    r"[^/]*Spec\.scala", r"[^/]*Suite\.scala", r"[^/]*Test\.scala",
    r"[^/]*_test\.dart", r"test_[^/]*\.dart",
    r"[^/]*_spec\.lua", r"[^/]*_test\.lua", r"test_[^/]*\.lua",
    r"test_helpers?[^/]*\.\w+",
]
TEST_DIR = r"(?:^|/)(?:tests?|__tests__|spec|testing)(?:/|$)"
COMPAT_DIR = r"(?:^|/)(?:compat|_compat|legacy)(?:/|$)"
EXAMPLE_DIR = r"(?:^|/)(?:_?examples?|docs?_src)(?:/|$)"
REEXPORT_FILES = ["__init__.py", "package-info.java"]
PENALTY = {"strong": 0.3, "moderate": 0.5, "mild": 0.7}
ALPHA_SYMBOL, ALPHA_TEXT = 0.3, 0.5


def _lit_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def normal_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def split_identifier(token: Column) -> Column:
    """The identifier in lower case, followed by its parts if it has at least two."""
    lower = F.lower(token)
    snake = F.filter(F.split(lower, "_"), lambda p: p != "")
    camel = F.transform(F.regexp_extract_all(token, F.lit(CAMEL_PART), F.lit(0)), F.lower)
    parts = F.when(F.contains(token, F.lit("_")), snake).otherwise(camel)
    return F.when(F.size(parts) >= 2, F.concat(F.array(lower), parts)).otherwise(F.array(lower))


def identifier_tokens(text: Column) -> Column:
    """All identifiers of a text, each with its parts; an empty array for null."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER), F.lit(0))
    return F.flatten(F.transform(found, split_identifier))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot does not begin a suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def parent_dirs(path: Column) -> Column:
    """Directory names of the path, without ``.`` and ``/``."""
    parts = F.split(path, "/")
    return F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: (p != "") & (p != "."))


def enriched(content: Column, path: Column) -> Column:
    """Text for lexical indexing: content, the stem twice, the last three directories."""
    dirs = parent_dirs(path)
    last = F.slice(dirs, F.greatest(F.size(dirs) - 2, F.lit(1)), 3)
    return F.concat_ws(" ", F.coalesce(content, F.lit("")), stem(path), stem(path), F.array_join(last, " "))


def path_terms(path: Column) -> Column:
    """Terms of the stem and of the directory the file lies in."""
    dirs = parent_dirs(path)
    parent = F.when(F.size(dirs) > 0, F.element_at(dirs, -1))
    own = split_identifier(stem(path))
    return F.array_distinct(F.when(parent.isNotNull() & (parent != ".."), F.concat(own, split_identifier(parent))).otherwise(own))


def path_penalty(path: Column) -> Column:
    """Product of the factors for tests, re-exports, compatibility code, examples and type stubs."""
    p = normal_path(path)
    factor = lambda hit, f: F.when(hit, F.lit(PENALTY[f])).otherwise(F.lit(1.0))
    return (
        factor(p.rlike("(?:^|/)(?:" + "|".join(TEST_FILES) + ")$") | p.rlike(TEST_DIR), "strong")
        * factor(file_name(p).isin(REEXPORT_FILES), "moderate")
        * factor(p.rlike(COMPAT_DIR), "strong")
        * factor(p.rlike(EXAMPLE_DIR), "strong")
        * factor(p.rlike(r"\.d\.ts$"), "mild")
    )


def is_symbol_query(query: Column) -> Column:
    return F.trim(query).rlike(SYMBOL_QUERY)


def resolve_alpha(query: Column, alpha: Column | None = None) -> Column:
    own = F.when(is_symbol_query(query), F.lit(ALPHA_SYMBOL)).otherwise(F.lit(ALPHA_TEXT))
    return own if alpha is None else F.coalesce(alpha, own)


def leaf_symbol(query: Column) -> Column:
    """What follows the last separator, of the first kind of separator that occurs."""
    out = F.trim(query)
    for sep in (".", "->", "\\", "::"):
        out = F.when(F.contains(query, F.lit(sep)), F.substring_index(query, sep, -1)).otherwise(out)
    return out


def embedded_symbols(query: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(query, F.lit(EMBEDDED_SYMBOL), F.lit(0)))


def query_keywords(query: Column) -> Column:
    """Distinct lower-case words of more than two characters that are no stopwords."""
    words = F.array_distinct(F.transform(F.regexp_extract_all(query, F.lit(IDENTIFIER), F.lit(0)), F.lower))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(_lit_array(STOPWORDS), w))


def keyword_matches(keywords: Column, parts: Column) -> Column:
    """Keywords that equal a part, or begin it or begin with it over at least 3 characters."""
    def hit(k: Column, p: Column) -> Column:
        return (k == p) | ((F.least(F.length(k), F.length(p)) >= 3) & (F.startswith(k, p) | F.startswith(p, k)))

    return F.size(F.filter(keywords, lambda k: F.exists(parts, lambda p: hit(k, p))))


def stem_forms(stem_lower: Column) -> Column:
    """The names that a file stem stands for: as it is, without ``_``, without trailing ``s``."""
    bare = F.replace(stem_lower, F.lit("_"), F.lit(""))
    cut = lambda c: F.regexp_replace(c, "s+$", "")
    return F.array_distinct(F.array(stem_lower, bare, cut(stem_lower), cut(bare)))


def definition_pattern(name: Column) -> Column:
    """A regular expression that finds a definition of ``name``; keywords are case-sensitive,
    those of SQL are not."""
    escaped = F.regexp_replace(name, r"([^A-Za-z0-9_])", r"\\$1")
    words = "|".join(DEFINITION_KEYWORDS)
    sql = "|".join(SQL_DEFINITIONS)
    tail = F.concat(F.lit(r")\s+(?:[A-Za-z_][A-Za-z0-9_]*(?:\.|::))*"), escaped, F.lit(r"(?:\s|[<({:\[;]|$)"))
    return F.concat(F.lit("(?mdU)(?:(?:^|(?<=\\s))(?:" + words), tail, F.lit("|(?i:(?:^|(?<=\\s))(?:" + sql), tail, F.lit("))"))


def defines(content: Column, name: Column) -> Column:
    """The cheap containment test comes first and spares most rows the expression."""
    low = F.contains(F.lower(content), F.lower(name))
    return F.coalesce(F.when(low, F.rlike(content, definition_pattern(name))), F.lit(False))


def infer_category(query: Column) -> Column:
    """A single word is a symbol, a question for the how of something is about architecture."""
    single = ~F.contains(F.trim(query), F.lit(" "))
    return F.when(single, "symbol").when(F.startswith(F.lower(query), F.lit("how ")), "architecture").otherwise("semantic")


def snippet(content: Column, lines: int | None) -> Column:
    """The whole text (None), nothing (0) or the first ``lines`` lines."""
    if lines is None:
        return content
    if lines < 0:
        raise ValueError("lines must not be negative")
    return F.array_join(F.slice(F.split(content, "\\R"), 1, lines), "\n") if lines else F.lit("")


def is_git_url(source: Column) -> Column:
    """As :func:`siftlake.sources.urls.is_git_url`, inside the JVM."""
    place = F.substring_index(source, ":", 1)
    scp = F.contains(source, F.lit(":")) & place.rlike("^[0-9A-Za-z_.-]+@[0-9A-Za-z_.-]+$") & ~F.startswith(F.substring(source, F.length(place) + 2, F.lit(1)), F.lit("/"))
    return F.when(F.contains(source, F.lit("://")), F.substring_index(source, "://", 1).isin(TRANSPORTS)).otherwise(scp)
