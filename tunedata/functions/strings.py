"""Column helpers that reproduce Python string semantics with built-in Spark expressions.

Everything here returns a ``Column`` and stays inside whole-stage codegen (no Python UDFs).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.isspace`` treats as whitespace, written as one
# regex character class (Java and RE2 both accept this syntax).
PY_WHITESPACE_CLASS = (
    r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# The same set as literal characters, for ``translate`` (a per-character map, no regex).
PY_WHITESPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
                       + "\u2028\u2029\u202f\u205f\u3000")
_LEAD_RE = f"^{PY_WHITESPACE_CLASS}+"


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def spaces_for_whitespace(c: str | Column) -> Column:
    """Every Python whitespace character replaced by a plain space (length preserved)."""
    return F.translate(col_(c), PY_WHITESPACE_CHARS, " " * len(PY_WHITESPACE_CHARS))


def py_strip(c: str | Column) -> Column:
    """``s.strip()``: removes Unicode whitespace at both ends (``trim`` only removes spaces).

    Two anchored leading-strips around a ``reverse``: an unanchored ``\\s+$`` would be tried at
    every position of the text."""
    lead = F.regexp_replace(col_(c), _LEAD_RE, "")
    return F.reverse(F.regexp_replace(F.reverse(lead), _LEAD_RE, ""))


def is_blank(c: str | Column) -> Column:
    """``not s.strip()`` for a string that is not null."""
    return F.length(F.trim(spaces_for_whitespace(c))) == 0


def falsy_coalesce(*cols: str | Column, default: str = "") -> Column:
    """``a or b or ... or default`` for strings: null and '' are falsy."""
    parts = [F.nullif(col_(c), F.lit("")) for c in cols]
    return F.coalesce(*parts, F.lit(default))


def capitalize(c: str | Column) -> Column:
    """``s.capitalize()``: first character upper, the rest lower (``initcap`` differs)."""
    c = col_(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def is_empty_value(c: str | Column, kind: str) -> Column:
    """``value in (None, "", [])`` by column kind: 'string', 'array' or anything else."""
    c = col_(c)
    if kind == "string":
        return c.isNull() | (c == F.lit(""))
    if kind == "array":
        return c.isNull() | (F.size(c) == 0)
    return c.isNull()


def slugify(c: str | Column, default: str = "ml-rd-project") -> Column:
    """Lower-case, runs of non ``[a-z0-9]`` to '-', strip '-' at the ends, empty -> default."""
    s = F.regexp_replace(F.lower(col_(c)), "[^a-z0-9]+", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def contains_ci(c: str | Column, needle: str) -> Column:
    """Case-insensitive substring test (``needle in s.lower()``)."""
    return F.lower(col_(c)).contains(needle.lower())
