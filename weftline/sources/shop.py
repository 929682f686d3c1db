"""The test tables as an object graph in the module ``shop``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftline.functions.predicates import field
from weftline.functions.stdlib import ISO
from weftline.graph import Graph
from weftline.plans.catalog import Catalog, Computed, Link, ObjectType, Policy, Property, UserFunction
from weftline.plans.elements import Back, Concat, Lit, Ref, Select, To
from weftline.sources.store import Binding, LinkTable


def _text(*names: str) -> tuple[Property, ...]:
    return tuple(Property(n) for n in names)


def _type(name: str, *members, **more) -> ObjectType:
    return ObjectType(f"shop::{name}", members, **more)


def catalog() -> Catalog:
    acctbal = Property("acctbal", "float")
    return Catalog.of(
        _type("Region", Property("name", required=True), Computed("nations", Back("region", "shop::Nation"))),
        _type("Nation", Property("name", required=True), Link("region", "shop::Region")),
        _type("Party", Property("name", required=True), acctbal, Link("nation", "shop::Nation"), abstract=True, annotations={"title": "A party to a trade"}),
        _type(
            "Customer",
            *_text("mktsegment"),
            Computed("label", Concat((Ref("name"), Lit(" ("), Ref("mktsegment"), Lit(")")))),
            Computed("home", To("nation", where=field("name").like("%2%"))),
            bases=("shop::Party",),
            policies=(Policy("own_segment", "allow", ("select",), lambda c: field("mktsegment").eq(c.get("segment"))),),
        ),
        _type("Supplier", bases=("shop::Party",)),
        _type("Part", *_text("name", "brand", "ptype"), Property("size", "int"), Property("retailprice", "float")),
        _type(
            "Order",
            Property("status", "shop::Status"),
            Property("totalprice", "float"),
            Property("orderdate", "datetime"),
            *_text("priority"),
            Link("customer", "shop::Customer"),
            Link("parts", "shop::Part", multi=True, props=(Property("quantity", "float"),)),
        ),
        _type("LineItem", Property("linenumber", "int"), Property("quantity", "float"), Property("extendedprice", "float"), Link("order", "shop::Order"), Link("part", "shop::Part"), Link("supplier", "shop::Supplier")),
        _type("Event", Property("user_id", "int"), *_text("event_type"), Property("value", "float"), Property("props", "json"), Property("ts", "datetime")),
        _type("Document", *_text("text", "lang", "source"), Property("n_chars", "int")),
        _type("Label", Property("quality", "int"), Property("toxic", "int"), Link("document", "shop::Document")),
        _type("Log", *_text("action", "target_name", "change")),
        enums={"shop::Status": ("F", "O", "P"), "shop::Color": ("RED", "GREEN", "BLUE")},
        functions=(
            UserFunction("exclaim", ("word",), lambda word: Concat((word, Lit("!"))), "shop"),
            UserFunction("mark", ("word", "after", "before"), lambda word, after, before: Concat((before, word, after)), "shop", named=("before",), defaults={"after": Lit("!"), "before": Lit("")}),
            UserFunction("nations_like", ("pattern",), lambda g, pattern: Select("Nation", ("name",), where=field("name").like(pattern), order_by="name"), "shop", query=True),
        ),
    )


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """A graph whose tables are the Parquet files of a folder; only the columns that a query uses are read."""
    g = Graph(spark, catalog(), "shop")
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    iso = lambda c: F.date_format(c, ISO)
    items = read("lineitem")
    whole = lambda c: F.col(c).cast("long")
    place = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    links = LinkTable(items, "l_orderkey", "l_partkey", {"quantity": "l_quantity"})
    bindings = {
        "Region": Binding(read("region"), "r_regionkey", {"name": "r_name"}),
        "Nation": Binding(read("nation"), "n_nationkey", {"name": "n_name"}, {"region": "n_regionkey"}),
        "Customer": Binding(read("customer"), "c_custkey", {"name": "c_name", "acctbal": "c_acctbal", "mktsegment": "c_mktsegment"}, {"nation": "c_nationkey"}),
        "Supplier": Binding(read("supplier"), "s_suppkey", {"name": "s_name", "acctbal": "s_acctbal"}, {"nation": "s_nationkey"}),
        "Part": Binding(read("part"), "p_partkey", {"name": "p_name", "brand": "p_brand", "ptype": "p_type", "size": whole("p_size"), "retailprice": "p_retailprice"}),
        "Order": Binding(read("orders"), "o_orderkey", {"status": "o_orderstatus", "totalprice": "o_totalprice", "orderdate": iso("o_orderdate"), "priority": "o_orderpriority"}, {"customer": "o_custkey", "parts": links}),
        "LineItem": Binding(items.withColumn("_place", place), "_place", {"linenumber": whole("l_linenumber"), "quantity": "l_quantity", "extendedprice": "l_extendedprice"}, {"order": "l_orderkey", "part": "l_partkey", "supplier": "l_suppkey"}),
        "Event": Binding(read("events"), "event_id", {"user_id": "user_id", "event_type": "event_type", "value": "value", "props": "props", "ts": iso("ts")}),
        "Document": Binding(read("documents"), "doc_id", {c: c for c in ("text", "lang", "source", "n_chars")}),
        "Label": Binding(read("labels"), "doc_id", {"quality": whole("quality"), "toxic": whole("toxic")}, {"document": "doc_id"}),
    }
    for name, binding in bindings.items():
        g.register(name, binding)
    return g
