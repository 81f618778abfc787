"""XML documents assembled from tables by a definition: elements with fields, attributes and repeated groups, from the leaves up."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import literals as L


@dataclass(frozen=True)
class Field:
    """A value of an element: its name, the column, how it is written (see ``literals.xml_value``)."""

    name: str
    column: str
    kind: str = "identity"
    required: bool = False
    attribute: bool = False


@dataclass(frozen=True)
class Element:
    """An element for each row of a table, in the order of ``order`` below its parent; it has to occur ``least`` to ``most`` times there."""

    name: str
    table: str
    key: str
    order: tuple[str, ...]
    fields: tuple[Field, ...]
    parent_key: str | None = None
    least: int = 0
    most: int | None = None
    children: tuple[Element, ...] = field(default=())


def escaped(x: Column, quoted: bool = False) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"),) if quoted else ())):
        x = F.replace(x, F.lit(plain), F.lit(entity))
    return x


def _opened(element: Element) -> Column:
    out = F.lit(f"<{element.name}")
    for f in element.fields:
        if f.attribute:
            out = F.concat(out, F.coalesce(F.concat(F.lit(f' {f.name}="'), escaped(L.xml_value(F.col(f.column), f.kind), True), F.lit('"')), F.lit("")))
    return F.concat(out, F.lit(">"))


def _fields(element: Element) -> list[Column]:
    tags = ((f, L.xml_value(F.col(f.column), f.kind)) for f in element.fields if not f.attribute)
    return [F.coalesce(F.concat(F.lit(f"<{f.name}>"), escaped(value), F.lit(f"</{f.name}>")), F.lit("")) for f, value in tags]


def assembled(element: Element, tables: dict[str, DataFrame], path: str = "") -> DataFrame:
    """(parent key if there is one, key, order, xml, violations) of each row of the element's table.

    violations: ``path:missing`` for a required value that is null, ``path:too_few`` and ``path:too_many`` for a repeated group, those of
    the parts included; each name once. A group's parts are gathered per parent, so a document has to fit a row.
    """
    path = f"{path}/{element.name}"
    rows = tables[element.table]
    missing = [F.when(F.col(f.column).isNull(), F.lit(f"{path}/{f.name}:missing")) for f in element.fields if f.required]
    names = [*dict.fromkeys([*([element.parent_key] if element.parent_key else []), element.key, *element.order])]
    found = rows.select(*names, _opened(element).alias("__open"), F.concat(F.lit(""), *_fields(element)).alias("__fields"), F.array_compact(F.array(*missing)).cast("array<string>").alias("violations"))
    inner: list[Column] = []
    for i, child in enumerate(element.children):
        parts = assembled(child, tables, path)
        group = parts.groupBy(F.col(child.parent_key).alias(element.key)).agg(
            F.array_sort(F.collect_list(F.struct(*child.order, "xml"))).alias(f"__parts{i}"), F.array_distinct(F.flatten(F.collect_list("violations"))).alias(f"__wrong{i}")
        )
        found = found.join(group, element.key, "left")
        size = F.coalesce(F.size(F.col(f"__parts{i}")), F.lit(0))
        bounds = [F.when(size < child.least, F.lit(f"{path}/{child.name}:too_few"))] + ([F.when(size > child.most, F.lit(f"{path}/{child.name}:too_many"))] if child.most is not None else [])
        wrong = F.coalesce(F.col(f"__wrong{i}"), F.array().cast("array<string>"))
        found = found.withColumn("violations", F.array_union(F.concat("violations", F.array_compact(F.array(*bounds)).cast("array<string>")), wrong))
        inner.append(F.coalesce(F.array_join(F.transform(f"__parts{i}", lambda p: p["xml"]), ""), F.lit("")))
    xml = F.concat("__open", "__fields", *inner, F.lit(f"</{element.name}>"))
    return found.select(*names, xml.alias("xml"), F.array_sort("violations").alias("violations"))
