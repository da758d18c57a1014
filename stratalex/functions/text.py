"""Text functions: hashes, snippets, formulas, tags, pages."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from stratalex.functions.lexicons import LATEX

#: What a text is trimmed of: all characters up to the space.
CONTROLS = "".join(map(chr, range(33)))

BLOCK = r"\$\$[\s\S]*?\$\$"
COMMAND = rf"(?i)(?<!\$)\\({LATEX})(?![A-Za-z0-9_])"


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def snippet(text: Column, n: int = 150) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def truncated(text: Column, n: int = 50_000, mark: str = "\n...[truncated]") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def formula_blocks(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(BLOCK)), F.lit(0))


def has_latex(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(COMMAND)), F.lit(False))


def has_formula(text: Column) -> Column:
    return has_latex(text) | (formula_blocks(text) > 0)


#: Formulas, and in the first group LaTeX that stands bare.
_SPAN = rf"\$\$[\s\S]*?\$\$|(?<!\$)\$[^$\n<>]+?\$(?!\$)|((?<!\$)\\(?:{LATEX})(?![A-Za-z0-9_])[^$<>]*)"
_WRAP = re.compile(_SPAN)


def wrap_formulas(text: str | None) -> str | None:
    """Puts bare LaTeX of six characters or more into dollar signs; the case counts."""

    def put(m: re.Match) -> str:
        bare = (m[1] or "").strip(CONTROLS)
        return f"$${bare}$$" if len(bare) >= 6 else m[0]

    return text and _WRAP.sub(put, text)


# How formulas stand in pages.
_IN_PAGES = [(r'<script[^>]*type="math/tex[^>]*>([\s\S]*?)</script>', "$$"), (r"<math[^>]*>([\s\S]*?)</math>", "$$"), (r"\\\(([\s\S]*?)\\\)", "$"), (r"\\\[([\s\S]*?)\\\]", "$$")]


def page_formulas(text: str) -> str:
    """MathJax scripts, <math> and backslash brackets to dollar signs, literally, then bare LaTeX; as ``normalise_formulas``."""
    for pattern, mark in _IN_PAGES:
        script = pattern.startswith("<script")
        text = re.sub(pattern, lambda m: m[1].strip(CONTROLS) if script and m[1].strip(CONTROLS).startswith("$") else f"{mark}{m[1].strip(CONTROLS)}{mark}", text)  # noqa: B023
    return wrap_formulas(text) or ""


def wrap_latex(text: Column | str) -> Column:
    """``wrap_formulas`` in the JVM: the text is split at formulas and bare LaTeX, of which the long ones are wrapped."""
    text = F.col(text) if isinstance(text, str) else text
    spans = F.arrays_zip(F.regexp_extract_all(text, F.lit(_SPAN), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(_SPAN), F.lit(1)).alias("bare"))
    bare = lambda s: F.btrim(s["bare"], F.lit(CONTROLS))
    put = lambda s: F.when(F.length(bare(s)) >= 6, F.concat(F.lit("$$"), bare(s), F.lit("$$"))).otherwise(s["whole"])
    joined = F.zip_with(F.split(text, _SPAN), spans, lambda gap, s: F.concat(gap, F.coalesce(put(s), F.lit(""))))
    return F.when(F.rlike(text, F.lit(COMMAND)), F.array_join(joined, "")).otherwise(text)


def normalise_formulas(html: Column) -> Column:
    """MathJax scripts, <math> and backslash brackets to dollar signs, then bare LaTeX."""
    t = F.regexp_replace(html, r'<script[^>]*type="math/tex[^>]*>\s*(\$[\s\S]*?)\s*</script>', "$1")
    t = F.regexp_replace(t, r'<script[^>]*type="math/tex[^>]*>\s*([\s\S]*?)\s*</script>', r"\$\$$1\$\$")
    t = F.regexp_replace(t, r"<math[^>]*>\s*([\s\S]*?)\s*</math>", r"\$\$$1\$\$")
    t = F.regexp_replace(t, r"\\\(\s*([\s\S]*?)\s*\\\)", r"\$$1\$")
    t = F.regexp_replace(t, r"\\\[\s*([\s\S]*?)\s*\\\]", r"\$\$$1\$\$")
    return wrap_latex(t)


def strip_tags(text: Column) -> Column:
    """Without tags, escaped ones too, and without white space around."""
    return F.btrim(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", ""), "&lt;/?[a-zA-Z][^&]*&gt;", ""), F.lit(CONTROLS))


def squeeze(text: Column) -> Column:
    """At most three line ends in a row, one space for runs of spaces and tabs."""
    return F.regexp_replace(F.regexp_replace(text, "\n{4,}", "\n\n\n"), "[ \t]+", " ")


def clean_page(raw: Column, watermark: str = "ISBN|版权所有|翻印|侵权必究") -> Column:
    """Lines of a printed page without blank ones, page numbers, headers, footers, marks.

    A header is a short line among the first 8 % of lines without a full stop, a footer one
    among the last 8 %; chapter names (第 ... 章 or 节) and numbered answers stay.  Line ends
    at the end of the page are no lines.  Null is an empty page.
    """
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), "\n+$", "")
    lines = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(CONTROLS)))

    def keep(x: Column, i: Column, n: Column) -> Column:
        header = (i < n * 0.08) & (F.length(x) < 30) & ~F.contains(x, F.lit(".")) & ~F.rlike(x, F.lit("第.*[章节]$"))
        footer = (i > n * 0.92) & (F.length(x) < 30) & ~F.rlike(x, F.lit(r"\d.*[解证明答]$"))
        return (x != "") & ~F.rlike(x, F.lit(r"^\d{1,4}$")) & ~header & ~footer & ~F.rlike(x, F.lit(watermark))

    once = F.transform(F.array(lines), lambda all_: F.filter(all_, lambda x, i: keep(x, i, F.size(all_))))  # the lines are split once
    joined = F.array_join(F.get(once, 0), "\n")
    return F.regexp_replace(joined, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def percent(part: Column, whole: Column, decimals: int = 1) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part / whole * 100, decimals))


def progress(current: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0)).otherwise((current / total * 100).cast("int"))
