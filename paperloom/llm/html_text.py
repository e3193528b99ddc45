"""What a web page says: its visible text, and the language its markup declares."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_HIDDEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I
)
_TAG = re.compile(r"""<[/!?a-z](?:"[^"]*"|'[^']*'|[^'">])*>""", re.I)
_ROOT = re.compile(r"<html\b[^>]*>", re.I)
_LANG = re.compile(r"""\s(?:xml:)?lang\s*=\s*["']?\s*([a-z]{2,3})(?![a-z])""", re.I)


def visible_text(page: str) -> str:
    """Text without comments, scripts, styles and tags, with its entities decoded."""
    return html.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", page)))


def language_tag(page: str) -> str | None:
    """Main part of the ``lang`` of the html tag: ``en`` of ``en-GB``."""
    root = _ROOT.search(_HIDDEN.sub(" ", page))
    found = root and _LANG.search(root[0])
    return found[1].lower() if found else None


def text_of(page: Column) -> Column:
    @F.pandas_udf("string")
    def texts(pages: pd.Series) -> pd.Series:
        return pages.map(visible_text, na_action="ignore")

    return texts(page)


def declared_language(page: Column) -> Column:
    @F.pandas_udf("string")
    def tags(pages: pd.Series) -> pd.Series:
        return pages.map(language_tag, na_action="ignore")

    return tags(page)
