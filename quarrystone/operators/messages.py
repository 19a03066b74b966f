"""Message logs: redaction of structured values, compaction, and argument checks."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HIDDEN = "[REDACTED]"
# Normalised key names, and endings of them, whose values are hidden.
SECRET_NAMES = frozenset("apikey authorization password passwd secret clientsecret cookie setcookie accesstoken refreshtoken idtoken authtoken".split())
SECRET_ENDINGS = ("apikey", "clientsecret", "accesstoken", "refreshtoken", "idtoken", "authtoken")
# Forms of secrets in running text, in the order in which they are hidden.
TEXT_FORMS = (
    (r"(?i)Bearer\s+[^\s,;\"']+", f"Bearer {HIDDEN}"),
    (r"(?i)\b(api[-_ ]?key|client[-_ ]?secret|access[-_ ]?token|refresh[-_ ]?token|password)\s*[:=]\s*[^\s,;]+", rf"\1={HIDDEN}"),
    (r"\bsk-[A-Za-z0-9_-]{8,}\b", f"sk-{HIDDEN}"),
)
_RULES = [(re.compile(pattern), new) for pattern, new in TEXT_FORMS]
_NAME_SIGNS = re.compile("[^a-z0-9]")


def hides(name: object) -> bool:
    """Whether a key's value is a secret by the key's letters and digits alone."""
    letters = _NAME_SIGNS.sub("", str(name).lower())
    return letters in SECRET_NAMES or any(map(letters.endswith, SECRET_ENDINGS))


def _document(text: str):
    """The list or object that a text is JSON of, else None."""
    if text.lstrip()[:1] not in ("{", "["):
        return None
    try:
        return json.loads(text)
    except ValueError:
        return None


def redact_value(value):
    """A copy of a JSON value without secrets; applying it again changes nothing.

    Places that are still to be looked at lie on a stack, so depth does not
    matter; a text that is itself a document is opened and, once its places
    are done, written back compactly.
    """
    top = [value]
    stack = [(top, 0, False)]
    while stack:
        holder, place, close = stack.pop()
        item = holder[place]
        if close:
            holder[place] = json.dumps(item, ensure_ascii=False, separators=(",", ":"))
            continue
        if isinstance(item, str):
            inner = _document(item)
            if inner is None:
                for rule, new in _RULES:
                    item = rule.sub(new, item)
                holder[place] = item
                continue
            stack.append((holder, place, True))
            item = inner
        if isinstance(item, dict):
            holder[place] = item = {k: HIDDEN if hides(k) else v for k, v in item.items()}
            stack += [(item, k, False) for k in item if not hides(k)]
        elif isinstance(item, list):
            holder[place] = item = list(item)
            stack += [(item, i, False) for i in range(len(item))]
    return top[0]


def redact_plain(column: Column) -> Column:
    """Running text without secrets, by expressions alone; text that begins a JSON object or list is for ``redact_json``."""
    for pattern, new in TEXT_FORMS:
        column = F.regexp_replace(column, pattern, new.replace("\\1", "$1"))
    return column


def compress_value(value, longest: int = 100, most: int = 3):
    """Long strings cut, long lists shortened, at every depth."""
    match value:
        case dict():
            return {k: compress_value(v, longest, most) for k, v in value.items()}
        case list():
            return [compress_value(v, longest, most) for v in value[:most]]
        case str() if len(value) > longest:
            return value[:longest] + "..."
    return value


def _over_json(change):
    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        def one(raw):
            if raw is None:
                return None
            try:
                return json.dumps(change(json.loads(raw)), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                return raw
        return column.map(one)

    return run


def redact_json(column: Column) -> Column:
    """JSON text without secrets; text that is no JSON is redacted as a string."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(redact_value, na_action="ignore")

    return run(column)


def compress_json(column: Column) -> Column:
    return _over_json(compress_value)(column)
