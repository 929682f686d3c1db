"""The catalog as a table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from weftline.plans.catalog import Catalog, Link, Property
from weftline.plans.elements import Back, Select, To

_NOTES = "array<struct<name:string,value:string>>"
_CONSTRAINTS = f"array<struct<name:string,annotations:{_NOTES}>>"
_SCHEMA = f"""name string, abstract boolean, bases array<string>, annotations {_NOTES},
  properties array<struct<name:string,type:string,required:boolean,multi:boolean,computed:boolean,annotations:{_NOTES},constraints:{_CONSTRAINTS}>>,
  links array<struct<name:string,target:string,required:boolean,multi:boolean,computed:boolean,annotations:{_NOTES},properties:array<struct<name:string,type:string>>>>"""


def object_types(spark: SparkSession, catalog: Catalog) -> DataFrame:
    """One row per object type, with its resolved members and annotations; filter and order it like any DataFrame.

    The property ``id`` of every type is among them. Computed members are properties without a type or, where their
    value is a link, links; a backlink's target is its source, if that is named.
    """
    notes = lambda a: [(k, a[k]) for k in sorted(a)]
    rows = []
    for name, t in sorted(catalog.types.items()):
        inherited: Mapping[str, str] = {}
        for base in catalog.lineage(name):
            inherited = {**inherited, **catalog.types[base].annotations}
        props: list[tuple] = [("id", "uuid", True, False, False, [], [("std::exclusive", [])])]
        links: list[tuple] = []
        for _, m in sorted(catalog.members(name).items()):
            if isinstance(m, Property):
                props.append((m.name, m.type, m.required, m.multi, False, notes(m.annotations), [(c.name, notes(c.annotations)) for c in m.constraints]))
            elif isinstance(m, Link):
                links.append((m.name, m.target, m.required, m.multi, False, notes(m.annotations), [(p.name, p.type) for p in m.props]))
            elif isinstance(m.element, To):
                held = catalog.links(name).get(m.element.link)
                links.append((m.name, held and held.target, False, bool(held and held.multi), True, notes(m.annotations), []))
            elif isinstance(m.element, (Back, Select)):
                links.append((m.name, m.element.source if isinstance(m.element, Back) else m.element.type, False, True, True, notes(m.annotations), []))
            else:
                props.append((m.name, None, False, False, True, notes(m.annotations), []))
        rows.append((name, t.abstract, list(t.bases), notes(inherited), props, links))
    return spark.createDataFrame(rows, _SCHEMA)
