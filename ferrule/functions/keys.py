"""Text out of JSON, and canonical keys of questions, as Arrow-backed functions."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys whose strings are ids or file links.
LINK_KEYS = frozenset({"id", "report", "viewer", "summary", "pushover", "nlrha", "ddm", "std", "reactions", "bom", "anchors"})
#: The kinds of question by what they may be called; any other name stands for itself.
KINDS = {"section": "exact_section", "eq": "exact_equation", "equation": "exact_equation", "table": "exact_table"}
#: Kinds that ask for an id, where white space counts for nothing.
EXACT = frozenset({"exact_section", "exact_equation", "exact_table", "id"})


def strings_of(text: str, links: frozenset[str] = LINK_KEYS) -> str:
    """Every string of a JSON text in order, one a line, without those under a link's key, at any depth; a text that is not JSON as it is."""

    def found(value: object, key: str | None) -> Iterator[str]:
        if isinstance(value, dict):
            for k, v in value.items():
                yield from found(v, k)
        elif isinstance(value, list):
            for v in value:
                yield from found(v, key)
        elif isinstance(value, str) and key not in links:
            yield value

    try:
        return "\n".join(found(json.loads(text), None))
    except (ValueError, RecursionError):
        return text


@F.pandas_udf(T.StringType())
def json_strings(s: pd.Series) -> pd.Series:
    """``strings_of`` each text; null stays null."""
    return s.map(strings_of, na_action="ignore")


def key_of(q: dict, aliases: dict[str, str]) -> str:
    """The SHA-256 of a question's canonical JSON: sorted keys, no spaces, so that equal questions have one key."""
    kind = (q["type"] or "auto").lower().strip()
    kind = KINDS.get(kind, kind)
    text = unicodedata.normalize("NFKC", q["query"] or "").lower()
    doc = (q["doc"] or "").strip()
    fields = {
        "collection": q["collection"] or "",
        "doc": aliases.get(doc.lower(), doc),
        "neighbors": int(q["neighbors"] or 0),
        "query": re.sub(r"\s+", "" if kind in EXACT else " ", text).strip(),
        "type": kind,
        "want_commentary": bool(q["want_commentary"]),
    }
    return hashlib.sha256(json.dumps(fields, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def canonical_key(aliases: dict[str, str] | None = None) -> Callable[..., Column]:
    """A function of the columns ``type, query, doc, collection, neighbors, want_commentary`` to their key; nulls are defaults."""
    names = aliases or {}

    @F.pandas_udf(T.StringType())
    def key(kind: pd.Series, query: pd.Series, doc: pd.Series, collection: pd.Series, neighbors: pd.Series, commentary: pd.Series) -> pd.Series:
        columns = {"type": kind, "query": query, "doc": doc, "collection": collection, "neighbors": neighbors, "want_commentary": commentary}
        rows = pd.DataFrame({k: v.astype(object).where(v.notna(), None) for k, v in columns.items()})
        return pd.Series([key_of(r, names) for r in rows.to_dict("records")], dtype=object)

    return key
