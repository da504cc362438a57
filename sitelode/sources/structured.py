"""What pages declare about things, whatever the notation: JSON-LD, microdata and RDFa as one table of items.

Every page is read once, as a tree. A JSON-LD block gives its typed nodes, six levels deep, without those that only point
at a node described elsewhere on the page; a block that is no JSON gives one item without a node. An element with
``itemscope`` or ``typeof`` gives an item: its properties are those of all elements inside it, also of items further in,
each with its ``content``, ``href``, ``src`` or text; a property that comes again becomes an array. With ``nested`` an
item's value is the item itself, which then alone owns what is inside it, and ``itemref`` adds the elements it names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sitelode.sources import jsonld
from sitelode.sources.dom import Page

def _put(item: dict, name: str, value) -> None:
    if name not in item:
        item[name] = value
    elif isinstance(item[name], list):
        item[name].append(value)
    else:
        item[name] = [item[name], value]


def scoped(page: Page, whole: str, scope: str, kind: str, name: str, nested: bool = False) -> Iterator[dict]:
    """The items of elements that have the attribute `scope`, their type in `kind`, their properties' names in `name`."""
    items = [i for i, a in enumerate(page.attrs) if scope in a]
    made = {i: {"@type": page.attrs[i].get(kind, "").removeprefix("https://schema.org/").removeprefix("http://schema.org/") or "Unknown"} for i in items}
    named = [i for i, a in enumerate(page.attrs) if a.get(name)]

    def value(i: int):
        if nested and i in made:
            return made[i]
        found = next((v for k in ("content", "href", "src") if (v := page.attrs[i].get(k))), None)
        return found or page.raw_text(i, whole).strip()

    ids = {a["id"]: i for i, a in reversed(list(enumerate(page.attrs))) if a.get("id")} if nested else {}
    for i in items:
        roots = [(i, False)] + [(ids[r], True) for r in page.attrs[i].get("itemref", "").split() if nested and r in ids and not ids[r] <= i <= page.last[ids[r]]]
        for root, itself in roots:
            for p in named:
                if not (root < p <= page.last[root] or itself and p == root):
                    continue
                if nested and any(root < o < p <= page.last[o] for o in items):
                    continue
                if v := value(p):
                    _put(made[i], page.attrs[p][name], v)
    yield from made.values()


def _items(page: Page, nested: bool) -> Iterator[tuple[str, dict | None]]:
    values, broken = jsonld.read(page.linked_data())
    yield from (("json-ld", None) for _ in range(broken))
    yield from (("json-ld", node) for node in jsonld.declared(values))
    if any("itemscope" in a or "typeof" in a for a in page.attrs):
        whole = "".join(page.raw)
        yield from (("microdata", item) for item in scoped(page, whole, "itemscope", "itemtype", "itemprop", nested))
        yield from (("rdfa", item) for item in scoped(page, whole, "typeof", "typeof", "property", nested))


def _read(batches: Iterator[pa.RecordBatch], nested: bool, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(key, n, form, None if item is None else json.dumps(item)) for key, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for n, (form, item) in enumerate(_items(Page(html or ""), nested))]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.int32(), pa.string(), pa.string()), strict=True)], ["key", "n", "format", "node"])


def items(pages: DataFrame, key: str = "page_id", html: str = "html", nested: bool = False) -> DataFrame:
    """key, n (order on the page), format, node (JSON; null for a block that is none)."""
    from pyspark.sql.pandas.types import to_arrow_type

    field = pages.schema[key].dataType
    out = pages.select(key, html).mapInArrow(lambda it: _read(it, nested, to_arrow_type(field)), f"key {field.simpleString()}, n int, format string, node string")
    return out.withColumnRenamed("key", key)
