"""Plain text of structured transcriptions in XML."""

from __future__ import annotations

import re
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .batches import in_slices

ROOT = "HistoricalDocument"
_LEFT_OUT = [
    (re.compile(rf"<{name}\b[^>]*>.*?</{name}>", re.DOTALL), re.compile(rf"<{name}\b[^>]*/>"))
    for name in "Description Deletion Illegible Gap".split()
]
_SECTIONS = ("Header", "Body", "Footer")


def _name(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def flatten(text: str) -> str:
    """Lines of the header, body and footer of each page; a text of another kind stays, malformed XML gives ''."""
    if ROOT not in text:
        return text
    for paired, single in _LEFT_OUT:
        text = single.sub("", paired.sub("", text))
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError:
        return ""
    pages = []
    for page in (x for x in root.iter() if _name(x) == "Page"):
        sections = ("\n".join(filter(None, map(str.strip, x.itertext()))) for x in page.iter() if _name(x) in _SECTIONS)
        pages.append("\n".join(filter(None, sections)))
    return "\n\n".join(filter(None, pages)).strip()


@F.arrow_udf(StringType())
def _flatten(text: pa.Array) -> pa.Array:
    some = pc.fill_null(pc.match_substring(text, ROOT), False)
    if not pc.any(some).as_py():
        return text
    return pc.replace_with_mask(text, some, in_slices(lambda ts: pa.array([flatten(t) for t in ts], text.type), text.filter(some)))


def xml_to_text(text: Column) -> Column:
    return _flatten(text)
