"""Nested documents: XML as a tree of maps, secrets in JSON and URLs hidden."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrid.functions.text import SECRET_PATTERNS

# Keys whose values are secret.
SENSITIVE_KEYS = ("api_key", "apikey", "authorization", "cookie", "dsn", "key", "password", "pwd", "secret", "token")
SENSITIVE = re.compile(f"password|secret|token|^api-key$|^({'|'.join(SENSITIVE_KEYS)})$", re.I)


def tree(e: ET.Element) -> dict:
    """name, attributes, and text or children."""
    out: dict = {"name": e.tag.rpartition("}")[2]}
    if e.attrib:
        out["attributes"] = dict(e.attrib)
    if len(e):
        out["children"] = [tree(c) for c in e]
    else:
        out["text"] = (e.text or "").strip()
    return out


@F.pandas_udf(T.StringType())
def xml_tree(s: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        try:
            return json.dumps(tree(ET.fromstring(text)), ensure_ascii=False) if text else None
        except ET.ParseError:
            return None

    return s.map(one)


def hide(v: object) -> object:
    if isinstance(v, dict):
        return {k: "[REDACTED]" if SENSITIVE.search(k.strip()) else hide(x) for k, x in v.items()}
    return [hide(x) for x in v] if isinstance(v, list) else v


def preview(text: str, limit: int = 2000) -> str:
    """A log preview: secrets in JSON, inline and in URLs are hidden, long texts cut."""
    text = text.strip()
    try:
        text = json.dumps(hide(json.loads(text)), separators=(",", ":"), ensure_ascii=False)
    except ValueError:
        text = re.sub(r"(://[^:@/\s]+):[^@/\s]+@", r"\1:[REDACTED]@", text)
    text = text if len(text) <= limit else text[:limit] + "... [truncated]"
    for p in SECRET_PATTERNS:
        text = re.sub(p, r"\1[REDACTED]", text)
    return text
