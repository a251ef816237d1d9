"""JSON embedded in pages, HTML entities: the few steps that need Python per value."""

from __future__ import annotations

import html as html_lib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from rankloom.functions.text import first_group

# Keys of an application state that may hold article HTML.
_ARTICLE_KEYS = {"content", "body", "html", "description"}


def next_data(html: Column) -> Column:
    """Text of the page's data script when it is valid JSON, else null."""
    blob = F.trim(first_group(
        html, r"""(?s)<script[^>]*id=["']__NEXT_DATA__["'][^>]*>(.*?)</script>"""))
    return F.when(F.try_parse_json(blob).isNotNull(), blob)


def _object_at(text: str, start: int) -> str | None:
    """The JSON object that begins at or after ``start``, by the JSON reader itself."""
    begin = text.find("{", start)
    if begin < 0:
        return None
    try:
        _, end = json.JSONDecoder().raw_decode(text, begin)
    except ValueError:
        return None
    return text[begin:end]


def _article(node: object) -> str | None:
    """Longest HTML text with a table under one of the article keys."""
    best, queue = None, [node]
    while queue:
        item = queue.pop()
        if isinstance(item, list):
            queue.extend(item)
        elif isinstance(item, dict):
            for key, value in item.items():
                if isinstance(value, str):
                    if key.lower() in _ARTICLE_KEYS and "<table" in value.lower() \
                            and (best is None or len(value) > len(best)):
                        best = value
                else:
                    queue.append(value)
    return best


_STATE = StructType([StructField("state", StringType()),
                     StructField("article", StringType())])
_MARKER = re.compile(r"window\.INITIAL_STATE\s*=\s*")


@F.pandas_udf(_STATE)
def _state(pages: pd.Series) -> pd.DataFrame:
    out = []
    for page in pages:
        at = _MARKER.search(page) if page else None
        blob = _object_at(page, at.end()) if at else None
        out.append((blob, _article(json.loads(blob)) if blob else None))
    return pd.DataFrame(out, columns=["state", "article"])


def initial_state(html: Column) -> Column:
    """struct(state, article) of a page's application state; nulls if there is none.

    Only pages that carry the marker cross to Python with their text.
    """
    return _state(F.when(html.contains("window.INITIAL_STATE"), html))


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: html_lib.unescape(t) if t is not None else None)


def unescape(c: Column) -> Column:
    """Entities decoded; only texts with an ampersand cross to Python."""
    marked = c.contains("&")
    return F.when(marked, _unescape(F.when(marked, c))).otherwise(c)
