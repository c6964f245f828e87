"""XML texts in a column, read by parser events in one pass each: entries, trees, and the first broken place."""

from __future__ import annotations

import json
from collections import Counter
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

from ..functions.jscompat import js_string_py


def _parse(text: str, start=None, end=None, chars=None, cdata=None):
    """Run a text through the parser; the error that stops it, or None."""
    p = expat.ParserCreate()
    p.buffer_text = True
    p.ordered_attributes = True
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, chars
    p.StartCdataSectionHandler = cdata
    yield p
    try:
        p.Parse(text.removeprefix("\ufeff").encode("utf-8", "replace"), True)
        yield None
    except expat.ExpatError as e:
        yield e


def broken_place(text: str | None) -> tuple[str, int, int] | None:
    """(what is wrong, line from 1, column from 1) of the first place where a text stops being well-formed XML."""
    if text is None:
        return None
    run = _parse(text)
    next(run)
    e = next(run)
    return None if e is None else (expat.ErrorString(e.code), e.lineno, e.offset + 1)


def entries(text: str | None) -> list[tuple[str, str, str]]:
    """(key, value, type) of the children of the outer element; of a text that breaks off, those before."""
    if not text:
        return []
    data, found, state = text.removeprefix("\ufeff").encode("utf-8", "replace"), [], {"depth": 0}

    def start(name, attrs):
        state["depth"] += 1
        if state["depth"] == 2:
            state.update(name=name, attrs=bool(attrs), text=[], nested=False, at=p.CurrentByteIndex)
        elif state["depth"] > 2:
            state["nested"] = True

    def end(name):
        if state["depth"] == 2:
            inner = ""
            if state["nested"]:
                whole = data[state["at"]:p.CurrentByteIndex]
                inner = whole[_tag_end(whole):].decode("utf-8", "replace")
            found.append((state["name"], inner if state["nested"] else "".join(state["text"]), state["attrs"], state["nested"]))
        state["depth"] -= 1

    def chars(t):
        if state["depth"] == 2:
            state["text"].append(t)

    run = _parse(text, start, end, chars)
    p = next(run)
    next(run)
    times = Counter(f[0] for f in found)
    out = []
    for name, value, attrs, nested in found:
        value = value.strip(" ")
        kind = ("array" if times[name] > 1 else "object" if nested else "null" if not value and not attrs
                else "text" if attrs else "string")
        out.append((name, value, kind))
    return out


def _tag_end(element: bytes) -> int:
    """Where the start tag at the head of an element ends; quoted attribute values may hold its mark."""
    at = 0
    while True:
        mark = min((i for i in (element.find(c, at) for c in (b">", b'"', b"'")) if i >= 0), default=len(element))
        c = element[mark:mark + 1]
        if c in (b">", b""):
            return mark + 1
        at = element.find(c, mark + 1) + 1 or len(element)


def tree(text: str) -> dict:
    """The outer element by name: text alone as text, children as lists by name, attributes under ``$``, text beside
    either under ``_``. Raises where the text is not well-formed."""
    stack: list[tuple[str, dict, list, list]] = []
    root: dict = {}

    def start(name, attrs):
        pairs = dict(zip(attrs[0::2], attrs[1::2]))
        stack.append((name, {"$": pairs} if pairs else {}, [], []))

    def end(name):
        _, node, said, marked = stack.pop()
        words = "".join(said)
        if words.strip() or marked:
            node["_"] = words
        value = words if not node else node["_"] if set(node) == {"_"} else node
        if stack:
            stack[-1][1].setdefault(name, []).append(value)
        else:
            root[name] = value

    def chars(t):
        if stack:
            stack[-1][2].append(t)

    def cdata():
        if stack:
            stack[-1][3].append(True)

    run = _parse(text, start, end, chars, cdata)
    next(run)
    e = next(run)
    if e is not None:
        raise e
    return root


def element(name: str, value, rename=lambda n: n) -> str:
    """A value as an element, the other way round than ``tree``: lists repeat it, null and empty text make it empty."""
    if isinstance(value, list):
        return "".join(element(name, v, rename) for v in value)
    tag, attrs, inner = rename(name), "", ""
    if isinstance(value, dict):
        own = value.get("$")
        if isinstance(own, dict):
            attrs = "".join(f" {rename(k)}={quoteattr(written(v))}" for k, v in own.items())
        inner = "".join(escape(written(v)) if k == "_" and not isinstance(v, (dict, list)) else element(k, v, rename)
                        for k, v in value.items() if k != "$" or v is not own or not isinstance(own, dict))
    elif value is not None:
        inner = escape(written(value))
    return f"<{tag}{attrs}>{inner}</{tag}>" if inner else f"<{tag}{attrs}/>"


def written(value) -> str:
    """A scalar as text; anything nested as JSON."""
    if value is None:
        return ""
    if isinstance(value, (dict, list)):
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return js_string_py(value)


def plain(value):
    """A tree without the marks of the format: single children for lists of one, attributes as children, ``text`` for
    text beside either."""
    if isinstance(value, list):
        return plain(value[0]) if len(value) == 1 else [plain(v) for v in value]
    if not isinstance(value, dict):
        return value
    out = {}
    for k, v in value.items():
        if k == "$":
            out.update((a if a not in value else "_" + a, t) for a, t in v.items())
        else:
            out["text" if k == "_" and "text" not in value else k] = plain(v)
    return out
