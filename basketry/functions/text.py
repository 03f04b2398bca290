"""String helpers: whitespace stripping, blank test, search patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: the characters Python's str.strip() removes --------------
# (str.isspace: tab, LF, VT, FF, CR, the four separators 0x1C-0x1F, space,
#  NEL, NBSP, OGHAM SPACE MARK, EN QUAD .. HAIR SPACE, LINE SEPARATOR,
#  PARAGRAPH SEPARATOR, NARROW NBSP, MEDIUM MATHEMATICAL SPACE, IDEOGRAPHIC SPACE)
PY_WHITESPACE_CLASS = (r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                       r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
# ---- end of fixed values ------------------------------------------------------

STRIP_REGEX = f"^{PY_WHITESPACE_CLASS}+|{PY_WHITESPACE_CLASS}+$"


def strip(col) -> Column:
    """Remove leading and trailing whitespace exactly as Python's ``str.strip``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(c, STRIP_REGEX, "")


def is_blank(col) -> Column:
    """True for NULL or whitespace-only text."""
    s = strip(col)
    return s.isNull() | (F.length(s) == 0)


def contains_pattern(text: str) -> str:
    """Build the ``%text%`` ILIKE pattern the search box sends.

    The user text is not escaped: ``%`` and ``_`` stay wildcards and ``\\``
    escapes the next character.  PostgreSQL reads ``\\x`` as a literal ``x``
    for any other ``x``; Spark rejects such escapes, so they are reduced to
    ``x`` here.  A trailing backslash escapes the appended ``%``.
    """
    out, i = [], 0
    while i < len(text):
        ch = text[i]
        if ch == "\\" and i + 1 < len(text):
            nxt = text[i + 1]
            out.append("\\" + nxt if nxt in "%_\\" else nxt)
            i += 2
            continue
        out.append(ch)
        i += 1
    return "%" + "".join(out) + "%"
