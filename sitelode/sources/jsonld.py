"""JSON-LD blocks of a page as its declared nodes."""

from __future__ import annotations

import json
from collections.abc import Iterator

#: Keys under which a node's own nodes are looked for.
NODE_KEYS = frozenset(
    "@graph author publisher creator mainEntity mainEntityOfPage itemListElement item about offers brand hasPart isPartOf review aggregateRating breadcrumb".split()
)
#: Keys that say nothing about the thing itself.
REFERENCE_KEYS = frozenset(["@id", "@type", "@context"])
_DEEPEST = 6


def _no_constant(name: str) -> None:
    raise ValueError(name)


def loads(text: str):
    """JSON by the letter: no NaN and no infinities."""
    return json.loads(text, parse_constant=_no_constant)


def types_of(node: dict) -> list[str]:
    kind = node.get("@type")
    return [kind] if isinstance(kind, str) else [t for t in kind if isinstance(t, str)] if isinstance(kind, list) else []


def typed_nodes(value) -> Iterator[dict]:
    """The typed objects of a value, each before those inside it."""
    stack = [(value, 0)]
    while stack:
        value, depth = stack.pop()
        if depth > _DEEPEST:
            continue
        if isinstance(value, list):
            inner = value
        elif isinstance(value, dict):
            if types_of(value):
                yield value
            inner = [v for k, v in value.items() if k in NODE_KEYS]
        else:
            continue
        stack += [(v, depth + 1) for v in reversed(inner)]


def points(node: dict) -> bool:
    """Whether a node only names another one."""
    return isinstance(node.get("@id"), str) and REFERENCE_KEYS.issuperset(node)


def read(blocks: list[str]) -> tuple[list, int]:
    """The values of a page's blocks, and how many are no JSON."""
    values, broken = [], 0
    for block in blocks:
        try:
            values.append(loads(block))
        except (ValueError, RecursionError):
            broken += 1
    return values, broken


def declared(values: list) -> list[dict]:
    """The typed nodes of a page, without those that only point at one described elsewhere on it."""
    nodes = [n for v in values for n in typed_nodes(v)]
    described = {n["@id"] for n in nodes if isinstance(n.get("@id"), str) and not points(n)}
    return [n for n in nodes if not (points(n) and n["@id"] in described)]


def all_types(values: list) -> list[str]:
    """The different types anywhere in the values, in order."""
    found, stack = {}, list(reversed(values))
    while stack:
        value = stack.pop()
        if isinstance(value, dict):
            found |= dict.fromkeys(types_of(value))
            stack += reversed([v for v in value.values() if isinstance(v, dict | list)])
        elif isinstance(value, list):
            stack += reversed([v for v in value if isinstance(v, dict | list)])
    return [clean(t) for t in found]


def clean(text: str) -> str:
    """Text without halves of surrogate pairs, which JSON can spell and no column can hold."""
    return text.encode("utf-8", "replace").decode()


def modified(values: list) -> str | None:
    """The first date of change that a block, or an element of one that is a list, states itself."""
    tops = [x for v in values for x in (v if isinstance(v, list) else [v]) if isinstance(x, dict)]
    return next((clean(str(x["dateModified"])) for x in tops if x.get("dateModified")), None)


def stated(values: list) -> str | None:
    """The first date of change or else of publication that a block, or an element of one that is a list, states itself as a text."""
    tops = [x for v in values for x in (v if isinstance(v, list) else [v]) if isinstance(x, dict)]
    dates = (x["dateModified"] if x.get("dateModified") is not None else x.get("datePublished") for x in tops)
    return next((clean(d) for d in dates if isinstance(d, str) and d.strip()), None)


def said(node: dict) -> dict[str, str]:
    """What a node says of itself, as JSON texts, without empty values."""
    return {clean(k): json.dumps(v) for k, v in node.items() if v or isinstance(v, dict | list)}


def fields(text: str | None) -> dict[str, str | None] | None:
    """An object's fields: texts as they are, null for null, everything else as a JSON text; null for what is no object."""
    try:
        node = loads(text or "")
    except (ValueError, RecursionError):
        return None
    if not isinstance(node, dict):
        return None
    return {clean(k): clean(v) if isinstance(v, str) else None if v is None else json.dumps(v) for k, v in node.items()}
