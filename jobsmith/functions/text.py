"""Column -> Column text helpers (JVM-side built-ins only, codegen friendly).

Regex dialects: rules are written in Python ``re`` syntax. ``py_regex`` rewrites
the Unicode-sensitive escapes (``\\s``, ``\\d``) into explicit classes that mean
the same thing in Python, Java and RE2, so one body serves Spark and the DuckDB
oracle; only the flag prefix differs (``spark_regex`` / ``duck_regex``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.split()/strip() whitespace set, spelled out for Java and RE2.
WS_BODY = (r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
           r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
WS_CLASS = f"[{WS_BODY}]"
# the same set as literal characters (for btrim, which needs no regex)
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200b))
            + "\u2028\u2029\u202f\u205f\u3000")
DIGIT_CLASS = r"\p{Nd}"


def py_regex(pattern: str) -> str:
    """Rewrite ``\\s`` and ``\\d`` (inside or outside classes) to explicit sets."""
    out = []
    i, in_class = 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt == "s":
                out.append(WS_BODY if in_class else WS_CLASS)
            elif nxt == "d":
                out.append(DIGIT_CLASS)
            else:
                out.append(pattern[i:i + 2])
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return "".join(out)


def spark_regex(pattern: str, ignore_case: bool = False, dotall: bool = False) -> str:
    """Java regex with Python semantics: UNIX_LINES always, Unicode case folding."""
    flags = "d" + ("iu" if ignore_case else "") + ("s" if dotall else "")
    return f"(?{flags}){py_regex(pattern)}"


def duck_regex(pattern: str, ignore_case: bool = False, dotall: bool = False) -> str:
    """RE2 form of the same rule (for the DuckDB oracle)."""
    flags = ("i" if ignore_case else "") + ("s" if dotall else "")
    return (f"(?{flags})" if flags else "") + py_regex(pattern)


def clean_text(c: Column) -> Column:
    """Strip and collapse whitespace exactly like ``' '.join(s.split())``; null -> ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), WS_CLASS + "+", " "))


def py_strip(c: Column) -> Column:
    """``str.strip()`` with Python's whitespace set (``btrim``: no regex per row)."""
    return F.btrim(c, F.lit(WS_CHARS))


def first_line(c: Column) -> Column:
    """``text.split('\\n')[0].strip()``; empty text -> ''."""
    return py_strip(F.split(F.coalesce(c, F.lit("")), "\n", 2).getItem(0))


def is_filled(c: Column, min_len: int = 0, strip: bool = False) -> Column:
    """Truthy-and-long-enough test: ``len(c) > min_len`` with null/'' false."""
    v = py_strip(c) if strip else c
    return F.coalesce(F.length(v) > F.lit(min_len), F.lit(False))


def first_match(text: Column, patterns: Sequence[str], ignore_case: bool = True, group: int = 0,
                strip: bool = True) -> Column:
    """Ranked rules: the first *rule* that matches wins (rank beats position).

    Returns null when no rule matches. Lazily evaluated left to right (coalesce).
    """
    found = []
    for p in patterns:
        rx = F.lit(spark_regex(p, ignore_case))  # one regex run per rule: null when it does not match
        val = F.regexp_substr(text, rx)
        if group:  # the first match only, not all of them
            val = F.when(val.isNotNull(), F.regexp_extract(text, spark_regex(p, ignore_case), group))
        found.append(py_strip(val) if strip else val)
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def contains_any(c: Column, tokens: Sequence[str], lower: bool = True) -> Column:
    """Any token is a substring (lower-cased test when ``lower``)."""
    v = F.lower(c) if lower else c
    cond = F.lit(False)
    for t in tokens:
        cond = cond | v.contains(t.lower() if lower else t)
    return F.coalesce(cond, F.lit(False))


def contains_all(c: Column, tokens: Sequence[str], lower: bool = True) -> Column:
    v = F.lower(c) if lower else c
    cond = F.lit(True)
    for t in tokens:
        cond = cond & v.contains(t.lower() if lower else t)
    return F.coalesce(cond, F.lit(False))


def base_of(url: Column) -> Column:
    """``scheme://host`` of an absolute URL ('' when not absolute)."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def host_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def absolute_url(href: Column, base: Column) -> Column:
    """Only a path starting with '/' is joined to the base; other forms kept."""
    return F.when(href.startswith("/"), F.concat(base, href)).otherwise(href)


def url_key_strict(url: Column, param: str = "jk") -> Column:
    """``[?&]param=([a-f0-9]+)`` group 1, null when absent."""
    rx = rf"[?&]{param}=([a-f0-9]+)"
    return F.when(url.rlike(rx), F.regexp_extract(url, rx, 1))


def url_key_loose(url: Column, param: str = "jk") -> Column:
    """Text after the first ``param=`` up to '&' (any characters), null when absent."""
    tok = f"{param}="
    return F.when(url.contains(tok), F.regexp_extract(url, f"{tok}([^&]*)", 1))


def canonical_url(url: Column, key: Column, fmt: str) -> Column:
    """``fmt`` with ``{key}`` filled when a key exists, else the original url."""
    pre, _, post = fmt.partition("{key}")
    return F.when(key.isNotNull(), F.concat(F.lit(pre), key, F.lit(post))).otherwise(url)


def html_escape(c: Column) -> Column:
    """Same output as Python ``html.escape(s, quote=True)``; '&' first."""
    v = F.replace(c, F.lit("&"), F.lit("&amp;"))
    v = F.replace(v, F.lit("<"), F.lit("&lt;"))
    v = F.replace(v, F.lit(">"), F.lit("&gt;"))
    v = F.replace(v, F.lit('"'), F.lit("&quot;"))
    return F.replace(v, F.lit("'"), F.lit("&#x27;"))


def preview(c: Column, width: int, empty_mark: str | None = None) -> Column:
    """First ``width`` code points; falsy value -> ``empty_mark`` when given."""
    cut = F.substring(c, 1, width)
    if empty_mark is None:
        return cut
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(empty_mark)).otherwise(cut)


def relative_date(c: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Whole match of the relative-date rule, stripped; '' when none."""
    return py_strip(F.regexp_extract(c, spark_regex(pattern, ignore_case), 0))
