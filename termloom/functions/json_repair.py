"""Reading JSON out of model output: fences, end marks, outer spans, light repairs, salvage from truncation.

Scanners respect string literals and escapes. The column functions run in Arrow batches; what has a built-in form
(end marks, fences) is a Spark column.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the mark that ends a complete answer.
END_MARK = "<<END_JSON>>"
CLOSER = {"{": "}", "[": "]"}


def without_fences(text: str | None) -> str:
    """The text without a leading and a trailing code fence."""
    t = (text or "").strip()
    t = re.sub(r"^```[A-Za-z0-9_-]*\s*", "", t)
    return re.sub(r"\s*```$", "", t).strip()


def _close_of(text: str, start: int) -> int:
    """The place after the bracket that closes the one at start; -1 if it is never closed."""
    stack, quoted, i = [], False, start
    while i < len(text):
        c = text[i]
        if quoted:
            if c == "\\":
                i += 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in CLOSER:
            stack.append(CLOSER[c])
        elif c in "}]":
            if not stack or stack.pop() != c:
                return -1
            if not stack:
                return i + 1
        i += 1
    return -1


def outer_span(text: str | None) -> str | None:
    """The balanced span from the first bracket on; None if that is truncated."""
    t = text or ""
    m = re.search(r"[{\[]", t)
    end = _close_of(t, m.start()) if m else -1
    return t[m.start() : end] if end > 0 else None


def any_span(text: str | None) -> str | None:
    """The first balanced span from any bracket on."""
    t = text or ""
    for m in re.finditer(r"[{\[]", t):
        end = _close_of(t, m.start())
        if end > 0:
            return t[m.start() : end]
    return None


def whole_objects(text: str | None) -> list[str]:
    """All balanced objects, an outer one before those within only if it is whole."""
    t, out, i = text or "", [], 0
    while (i := t.find("{", i)) >= 0:
        end = _close_of(t, i)
        if end > 0:
            out.append(t[i:end])
            i = end
        else:
            i += 1
    return out


def _load(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def salvage_items(text: str | None, keys: tuple[str, ...] = ("ci_text", "condition_text", "contraindication_state_text", "span_text")) -> dict | None:
    """{'items': [...]} of the whole objects that carry one of the keys; None if there is none."""
    items = [o for o in map(_load, whole_objects(text)) if isinstance(o, dict) and any(k in o for k in keys)]
    return {"items": items} if items else None


def extract_json(text: str | None):
    """The JSON value in a text: as it stands, its outer span, with trailing commas dropped, or salvaged; None if none."""
    if not isinstance(text, str) or not text.strip():
        return None
    t = without_fences(trim_end_mark(text, include=False))
    span = outer_span(t)
    for candidate in (t, span, re.sub(r",\s*([\]}])", r"\1", span) if span else None):
        if candidate is not None and (value := _load(candidate)) is not None:
            return value
    return salvage_items(t)


def trim_end_mark(text: str | None, mark: str = END_MARK, include: bool = True) -> str:
    """The text up to the first end mark; all of it if there is none."""
    head, found, _ = (text or "").partition(mark)
    return head + (found if include else "")


def regex_json(text: str | None, default: dict) -> dict:
    """The widest {...} of a text as an object, or the default."""
    m = re.search(r"\{.*\}", text or "", re.S)
    value = _load(m[0]) if m else None
    return value if isinstance(value, dict) else dict(default)


def has_end_mark(text: Column, mark: str = END_MARK, terminal: bool = True) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.rtrim(F.regexp_replace(t, r"\s+$", "")).endswith(mark) if terminal else t.contains(mark)


def up_to_end_mark(text: Column, mark: str = END_MARK, include: bool = True) -> Column:
    t = F.coalesce(text, F.lit(""))
    at = F.instr(t, mark)
    return F.when(at == 0, t).otherwise(F.substring(t, F.lit(1), at - 1 + (len(mark) if include else 0)))


def repaired(text: Column) -> Column:
    """extract_json() as canonical JSON text, for from_json or try_parse_json; null if there is none."""

    @F.pandas_udf("string")
    def run(texts):
        return texts.map(lambda t: None if (v := extract_json(t)) is None else json.dumps(v, ensure_ascii=False))

    return run(text)


def normal_items(value: Column, fields: dict[str, list[str]]) -> Column:
    """An array of string maps as structs: each field from its first key that is there, blank items dropped."""
    pick = lambda m: F.struct(*(F.coalesce(*(F.nullif(F.trim(F.try_element_at(m, F.lit(k))), F.lit("")) for k in keys)).alias(name) for name, keys in fields.items()))
    first = next(iter(fields))
    return F.filter(F.transform(value, pick), lambda s: s[first].isNotNull())
