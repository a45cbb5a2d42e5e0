"""Scalar text helpers as Column expressions (all JVM built-ins)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The abstention phrase list.
ABSTENTION_PATTERNS = ("insufficient information",)

# Python's str.strip() whitespace = Unicode White_Space plus U+001C..U+001F.
_WS = r"[\s\x{1C}-\x{1F}]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()`` with Python's whitespace set (``trim`` only strips spaces)."""
    return F.regexp_replace(_c(c), rf"(?U)^{_WS}+|{_WS}+$", "")


def is_blank(c) -> Column:
    return F.coalesce(_c(c), F.lit("")).rlike(rf"(?U)^{_WS}*$")


def is_abstention(c, patterns: Sequence[str] = ABSTENTION_PATTERNS) -> Column:
    """Empty after stripping, or contains one of ``patterns`` (lower-cased)."""
    low = F.lower(F.coalesce(_c(c), F.lit("")))
    hit = F.lit(False)
    for p in patterns:
        hit = hit | low.contains(p.lower())
    return is_blank(c) | hit


def doc_id(text) -> Column:
    """Content id ``doc_`` + first 12 hex of md5(text)."""
    return F.concat(F.lit("doc_"), F.substring(F.md5(_c(text)), 1, 12))


def clean_attr_name(c) -> Column:
    """Strip a leading ``custom.`` only, then dots to underscores."""
    return F.translate(F.regexp_replace(_c(c), r"^custom\.", ""), ".", "_")


def glob_to_regex(spec: str) -> str:
    """fnmatch-style glob (``*``, ``?``, ``[...]``) to an anchored Java regex."""
    out, i = [], 0
    while i < len(spec):
        ch = spec[i]
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[":
            j = spec.find("]", i + 2 if i + 1 < len(spec) and spec[i + 1] in "!]" else i + 1)
            if j == -1:
                out.append(re.escape(ch))
            else:
                body = spec[i + 1:j]
                if body.startswith("!"):
                    body = "^" + body[1:]
                out.append("[" + body.replace("\\", "\\\\") + "]")
                i = j
        else:
            out.append(re.escape(ch))
        i += 1
    return "^" + "".join(out) + "$"


def model_name(repo_id) -> Column:
    """Repository basename; a blank id is an error."""
    c = _c(repo_id)
    base = F.element_at(F.split(F.trim(c), "/"), -1)
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.raise_error(F.lit("model id must not be blank"))).otherwise(base)


def collection_name(repo_id, quantization=None, dims=None) -> Column:
    """``name``, ``name__quant`` or ``name__quant__dims``."""
    parts = [model_name(repo_id)]
    if quantization is not None:
        parts.append(_c(quantization))
    if dims is not None:
        parts.append(_c(dims).cast("string"))
    return F.concat_ws("__", *parts)
