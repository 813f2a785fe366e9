"""Entities of a text: patterns of nine types and their canonical names.  Null is empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import filled

#: Type, pattern and the group that holds the name, in order.  Fixed values.
PATTERNS = (
    ("file", r"(?U)\b[A-Za-z0-9][A-Za-z0-9_\-]{1,64}\.[A-Za-z][A-Za-z0-9]{0,5}\b", 0),
    ("function", r"(?U)\b[a-z_][a-zA-Z0-9_]*\s*\(", 0),
    ("module", r"(?iuU)\b([A-Za-z][A-Za-z0-9_\- ]{2,})\s+module\b", 1),
    ("class", r"(?U)\b[A-Z][A-Za-z0-9]+(?:[A-Z][A-Za-z0-9]+)+\b", 0),
    ("symbol", r"(?U)\b[a-z][a-z0-9]+_[a-z0-9_]+\b", 0),
    ("user", r"(?iuU)\b(?:user|username|@\w+|I am|my name is)\s+([A-Za-z]\w*)", 1),
    ("task", r"(?iuU)\b(?:task|ticket|issue|bug|pr|story)\s*[#:]?\s*\d+", 0),
    ("variable", r"(?U)\b[A-Z][A-Z0-9_]{2,}\b", 0),
    ("url", r"(?U)https?://\S+", 0),
)
#: What a text must hold (lower-cased) for a match: most texts never meet the costlier patterns.
_NEEDS = {"file": (".",), "function": ("(",), "module": ("module",), "symbol": ("_",), "user": ("user", "@", "i am", "my name is"), "task": ("task", "ticket", "issue", "bug", "pr", "story"), "url": ("http",)}
#: What every match of a type holds, found much sooner than a word's edge and what follows it.
_HOLDS = {"file": r"[A-Za-z0-9_\-]\.[A-Za-z]", "class": "[A-Z][A-Za-z0-9]+[A-Z][A-Za-z0-9]", "variable": "[A-Z][A-Z0-9_]{2}"}
TYPES = tuple(t for t, _, _ in PATTERNS)
#: Words and extensions that are no part of a name.  Fixed values.
GENERIC = ("module", "service", "class", "file", "function", "method", "handler", "controller", "manager", "utility", "util", "utils", "component")
EXTENSIONS = ("py", "js", "ts", "tsx", "jsx", "json", "yaml", "yml", "md", "txt", "csv", "html", "css", "toml", "ini", "cfg", "sh", "bat", "go", "rs", "java", "kt", "rb", "php", "cs", "cpp", "c", "h", "hpp")
STEM_FROM, STEM, SHORTEST = 8, 4, 2


#: What looks like a file's name and is an address, an amount, initials or a version.  Fixed values.
FALSE_FILES = (r"^\d{1,3}(?:\.\d{1,3}){3}$", r"^\$?\d+(?:\.\d+)+$", r"^[A-Za-z](?:\.[A-Za-z])+\.?$", r"^[vV]?\d+(?:\.\d+){1,3}$")


def false_file(name: Column) -> Column:
    """Whether a file's name is none; the file pattern finds no such names, so this serves names from elsewhere."""
    return F.coalesce(name.rlike("|".join(f"(?:{p})" for p in FALSE_FILES)), F.lit(False))


def raw(text: Column, kind: str) -> Column:
    """All matches of a type, as they stand."""
    pattern, group = next((p, g) for t, p, g in PATTERNS if t == kind)
    found = F.regexp_extract_all(filled(text), F.lit(pattern), F.lit(group))
    hint = F.lit(kind not in _NEEDS)
    for part in _NEEDS.get(kind, ()):
        hint = hint | F.lower(filled(text)).contains(part)
    if kind in _HOLDS:
        hint = hint & filled(text).rlike(_HOLDS[kind])
    return F.when(hint, found).otherwise(F.array().cast("array<string>"))


def name_parts(name: Column) -> Column:
    """A name's parts: camel case cut, lower case, without generic words, long ones by their stem."""
    runs = F.regexp_extract_all(name, F.lit("[A-Za-z0-9]+"), F.lit(0))
    parts = F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit("[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+"), F.lit(0))))
    kept = F.filter(F.transform(parts, F.lower), lambda p: ~p.isin(*GENERIC, *EXTENSIONS))
    return F.filter(F.transform(kept, lambda p: F.when(F.length(p) >= STEM_FROM, F.substring(p, 1, STEM)).otherwise(p)), lambda p: F.length(p) >= SHORTEST)


def canonical(name: Column, is_url: bool | Column = False) -> Column:
    """A name's parts joined, or the name itself where it has none (or is a url)."""
    trimmed = F.regexp_replace(name, r"(?U)^\s+|\s+$", "")
    if is_url is True:
        return trimmed
    # bound as a lambda's variable, so the parts are found once
    joined = F.array(F.array_join(name_parts(name), "_"))
    made = F.get(F.transform(joined, lambda j: F.when(j != "", j).otherwise(F.lower(trimmed))), 0)
    return made if is_url is False else F.when(is_url, trimmed).otherwise(made)


def names(text: Column, kind: str) -> Column:
    """Distinct canonical names of a type, in the order they stand."""
    found = F.transform(raw(text, kind), lambda n: canonical(n, kind == "url"))
    return F.array_distinct(F.filter(found, lambda n: n != ""))


def listed(text: Column) -> Column:
    """etype, ord (the type's place), pos and name of every entity.

    The types' matches are gathered first, so that the names are made in one place and not type by type.
    """
    each = F.array(*[F.struct(F.lit(t).alias("etype"), F.lit(k).alias("ord"), raw(text, t).alias("raw")) for k, t in enumerate(TYPES)])
    made = lambda e: F.array_distinct(F.filter(F.transform(e["raw"], lambda n: canonical(n, e["etype"] == "url")), lambda n: n != ""))
    return F.flatten(F.transform(F.filter(each, lambda e: F.size(e["raw"]) > 0), lambda e: F.transform(made(e), lambda name, pos: F.struct(e["etype"], e["ord"], pos.alias("pos"), name.alias("name")))))


def extract(text: Column) -> Column:
    """Type to names; types without a match are left out."""
    entries = F.array(*[F.struct(F.lit(t).alias("key"), names(text, t).alias("value")) for t in TYPES])
    return F.map_from_entries(F.filter(entries, lambda e: F.size(e["value"]) > 0))


def all_names(text: Column) -> Column:
    """The distinct names of all types."""
    plain = F.transform(F.concat(*[raw(text, t) for t in TYPES if t != "url"]), lambda n: canonical(n))
    return F.array_distinct(F.filter(F.concat(plain, F.transform(raw(text, "url"), lambda n: canonical(n, True))), lambda n: n != ""))


def recall(reference: Column, context: Column) -> Column:
    """Which part of the reference's names the context has; 1 if there are none."""
    return F.when(F.size(reference) > 0, F.size(F.array_intersect(reference, context)) / F.size(F.array_distinct(reference))).otherwise(F.lit(1.0))
