"""One query for each operator of the engine, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.predicates import field, linked_from, not_linked_from, type_is
from weftline.graph import Graph, parameter
from weftline.operators.changes import Conflict
from weftline.plans.catalog import ObjectType, Property, Rewrite, Trigger, new, old
from weftline.plans.elements import All, As, Back, Call, Cast, Concat, IfType, Lit, Many, Member, Ref, Select, To, TypeName
from weftline.sources.shop import graph
from weftline.sources.store import shared_dir

_SUITE: dict[str, tuple[Callable[[Graph], DataFrame], str | None]] = {}


def suite(sql: str | None):
    def add(f: Callable[[Graph], DataFrame]):
        _SUITE[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(graph(spark, sf_dir))) for name, (f, _) in _SUITE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _SUITE.items() if sql}


def _ids(items: str, key: str = "id"):
    return F.array_join(F.transform(items, lambda x: x[key]), ",")


# scans, filters, order


@suite("select 'Customer:' || c_custkey as id from customer")
def scan_default_shape(g):
    return g.select("Customer")


@suite("select o_orderstatus as status, o_totalprice as totalprice, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') as orderdate from orders")
def scan_fields(g):
    return g.select("Order", "status", "totalprice", "orderdate")


@suite("select 'Customer:' || c_custkey as id, c_name as name from customer where c_mktsegment = 'HOUSEHOLD'")
def filter_eq(g):
    return g.select("Customer", "id", "name", where=field("mktsegment").eq("HOUSEHOLD"))


@suite("select 'Customer:' || c_custkey as id from customer where c_mktsegment != 'HOUSEHOLD'")
def filter_ne(g):
    return g.select("Customer", where=field("mktsegment").ne("HOUSEHOLD"))


@suite("select c_name as name from customer where c_custkey = 5")
def filter_id(g):
    return g.select("Customer", "name", where=field("id").eq("Customer:5"))


@suite("select 'Part:' || p_partkey as id, p_name as name from part where lower(p_name) like lower('%S%e_%')")
def filter_like(g):
    return g.select("Part", "id", "name", where=field("name").like("%S%e_%"))


@suite("select 'Part:' || p_partkey as id from part where lower(p_type) like lower('%econ%')")
def filter_ilike(g):
    return g.select("Part", where=field("ptype").ilike("%EcOn%"))


@suite("select 'Order:' || o_orderkey as id, o_orderpriority as priority from orders where o_orderpriority in ('1-URGENT', '2-HIGH')")
def filter_in(g):
    return g.select("Order", "id", "priority", where=field("priority").one_of("1-URGENT", "2-HIGH"))


@suite("select 'Order:' || o_orderkey as id from orders where o_orderpriority not in ('1-URGENT', '2-HIGH')")
def filter_not_in(g):
    return g.select("Order", where=field("priority").none_of("1-URGENT", "2-HIGH"))


@suite("select 'Order:' || o_orderkey as id from orders where (o_orderstatus = 'F' and not (o_orderpriority = '5-LOW')) or o_orderpriority like '1%'")
def filter_and_or_not(g):
    return g.select("Order", where=(field("status").eq("F") & ~field("priority").eq("5-LOW")) | field("priority").like("1%"))


@suite("select 'Supplier:' || s_suppkey as id, s_name as name from supplier")
def filter_type_name(g):
    return g.select("Party", "id", "name", where=type_is("shop::Supplier"))


@suite("select 'Order:' || o_orderkey as id, o_totalprice as totalprice from orders order by o_totalprice desc, 'Order:' || o_orderkey limit 10")
def order_limit_topk(g):
    return g.select("Order", "id", "totalprice", order_by="totalprice", desc=True, limit=10)


@suite("select c_name as name from customer order by c_name, 'Customer:' || c_custkey limit 20 offset 30")
def order_offset_limit(g):
    return g.select("Customer", "name", order_by="name", offset=30, limit=20)


@suite("select s_name as name from supplier order by s_name, 'Supplier:' || s_suppkey offset 7")
def offset_only(g):
    return g.select("Supplier", "name", order_by="name", offset=7)


@suite("select min_by(n_name, 'Nation:' || n_nationkey) as name from nation")
def first_value(g):
    return g.first("Nation", "name")


# projections


@suite("select 'Nation:' || n_nationkey as id, n_name as nick from nation")
def computed_alias(g):
    return g.select("Nation", "id", As("nick", Ref("name")))


@suite("select n_name as name, 42 as n, 'x' as s, true as b from nation")
def computed_literal(g):
    return g.select("Nation", "name", As("n", Lit(42)), As("s", Lit("x")), As("b", Lit(True)))


@suite("select name, t from (select c_name as name, 'shop::Customer' as t from customer union all select s_name, 'shop::Supplier' from supplier)")
def computed_type_name(g):
    return g.select("Party", "name", As("t", TypeName())).select("name", F.col("t.name").alias("t"))


@suite("select 'Customer:' || c_custkey as id, c_name as name, c_acctbal as acctbal from customer union all select 'Supplier:' || s_suppkey, s_name, s_acctbal from supplier")
def polymorphic_scan(g):
    return g.select("Party", "id", "name", "acctbal")


@suite("select c_name as name, c_mktsegment as segment from customer union all select s_name, null from supplier")
def polymorphic_field_ref(g):
    return g.select("Party", "name", As("segment", IfType("Customer", "mktsegment")))


@suite("select 'Part:' || p_partkey as id, p_name as name, p_brand as brand, p_type as ptype, p_size::bigint as size, p_retailprice as retailprice from part")
def splat(g):
    return g.select("Part", All())


@suite("select 'Nation:' || n_nationkey as id, n_name as name, 'Region:' || r_regionkey as region_id, r_name as region_name from nation join region on n_regionkey = r_regionkey")
def splat_depth2(g):
    return g.select("Nation", All(deep=True)).select("id", "name", F.col("region.id").alias("region_id"), F.col("region.name").alias("region_name"))


@suite("select 'Customer:' || c_custkey as id, c_name as name, c_acctbal as acctbal, c_mktsegment as mktsegment from customer union all select null, null, null, null from supplier")
def splat_type_intersection(g):
    return g.select("Party", All(only="Customer"))


@suite("select c_custkey, c_name || ' (' || c_mktsegment || ')' as label from customer")
def schema_computed_concat(g):
    return g.select("Customer", "id", "label").select(F.split_part("id", F.lit(":"), F.lit(2)).cast("long").alias("c_custkey"), "label")


@suite("select 'Customer:' || c_custkey as id, case when n_name like '%2%' then 'Nation:' || n_nationkey end as home from customer left join nation on c_nationkey = n_nationkey")
def schema_computed_link_filter(g):
    return g.select("Customer", "id", "home").select("id", F.col("home.id").alias("home"))


@suite("select r_name as name, string_agg('Nation:' || n_nationkey, ',' order by 'Nation:' || n_nationkey) as nations from region left join nation on n_regionkey = r_regionkey group by r_regionkey, r_name")
def schema_computed_backlink(g):
    return g.select("Region", "name", "nations").select("name", _ids("nations").alias("nations"))


# links


@suite("select c_name as name, n_name as nation from customer left join nation on c_nationkey = n_nationkey")
def single_link(g):
    return g.select("Customer", "name", To("nation", ("name",))).select("name", F.col("nation.name").alias("nation"))


@suite("select c_name as name, n_name as nation from customer left join nation on c_nationkey = n_nationkey and n_name != 'NATION_7'")
def single_link_filter_null(g):
    return g.select("Customer", "name", To("nation", ("name",), where=field("name").ne("NATION_7"))).select("name", F.col("nation.name").alias("nation"))


@suite("select 'Order:' || o_orderkey as id, c_name as customer, n_name as nation from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey where o_orderstatus = 'P'")
def two_level_links(g):
    shape = To("customer", ("name", To("nation", ("name",))))
    return g.select("Order", "id", shape, where=field("status").eq("P")).select("id", F.col("customer.name").alias("customer"), F.col("customer.nation.name").alias("nation"))


_PARTS = "(select distinct l_orderkey, l_partkey from lineitem)"


@suite(f"select 'Order:' || o_orderkey as id, string_agg('Part:' || l_partkey, ',' order by 'Part:' || l_partkey) as parts from orders join {_PARTS} on l_orderkey = o_orderkey group by o_orderkey union all select 'Order:' || o_orderkey, '' from orders where o_orderkey not in (select l_orderkey from lineitem)")
def multi_link_junction(g):
    return g.select("Order", "id", "parts").select("id", _ids("parts").alias("parts"))


@suite(f"select 'Order:' || o_orderkey as id, count(p_partkey)::int as n from orders left join {_PARTS} on l_orderkey = o_orderkey left join part on l_partkey = p_partkey and lower(p_brand) like lower('%1') group by o_orderkey")
def multi_link_filter(g):
    return g.select("Order", "id", To("parts", where=field("brand").like("%1"))).select("id", F.size("parts").alias("n"))


@suite(f"select 'Order:' || l_orderkey as id, place, p_name as name from (select l_orderkey, p_name, (row_number() over (partition by l_orderkey order by p_name, 'Part:' || p_partkey))::int as place from {_PARTS} join part on l_partkey = p_partkey) where place <= 2")
def multi_link_order_limit(g):
    found = g.select("Order", "id", To("parts", ("name",), order_by="name", limit=2))
    return found.select("id", F.posexplode("parts").alias("place", "part")).select("id", (F.col("place") + 1).alias("place"), F.col("part.name").alias("name"))


@suite("select o_orderpriority as priority, sum(l_quantity) as quantity from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus = 'P' group by o_orderpriority")
def link_properties(g):
    found = g.select("Order", "priority", To("parts", props=("quantity",)), where=field("status").eq("P"))
    return found.select("priority", F.explode("parts").alias("part")).groupBy("priority").agg(F.sum("part.@quantity").alias("quantity"))


@suite("select l_orderkey as order_key, s_name as supplier from lineitem join supplier on l_suppkey = s_suppkey where l_quantity = 50")
def link_type_intersection(g):
    found = g.select("LineItem", To("order"), To("supplier", ("name",), only="Supplier"), where=field("quantity").eq(50.0))
    return found.select(F.split_part("order.id", F.lit(":"), F.lit(2)).cast("long").alias("order_key"), F.col("supplier.name").alias("supplier"))


@suite("select n_name as name, (select count(*) from customer where c_nationkey = n_nationkey) + (select count(*) from supplier where s_nationkey = n_nationkey) as n from nation")
def backlink_list(g):
    return g.select("Nation", "name", As("parties", Back("nation"))).select("name", F.size("parties").cast("long").alias("n"))


@suite("select n_name as name, (select count(*) from customer where c_nationkey = n_nationkey) + (select count(*) from supplier where s_nationkey = n_nationkey) as n from nation")
def backlink_count(g):
    return g.select("Nation", "name", As("n", Back("nation", count=True)))


@suite("select n_name as name, (select coalesce(string_agg(id, ',' order by id), '') from (select 'Customer:' || c_custkey as id from customer where c_nationkey = n_nationkey order by id limit 3)) as some from nation")
def backlink_limit(g):
    found = g.select("Nation", "name", As("some", Back("nation", "Customer", limit=3)))
    return found.select("name", _ids("some").alias("some"))


@suite("select n_name as name, coalesce(string_agg('Supplier:' || s_suppkey, ',' order by 'Supplier:' || s_suppkey), '') as suppliers from nation left join supplier on s_nationkey = n_nationkey group by n_nationkey, n_name")
def backlink_typed(g):
    return g.select("Nation", "name", As("suppliers", Back("nation", "Supplier"))).select("name", _ids("suppliers").alias("suppliers"))


@suite("select r_name as name from region where exists (select 1 from nation where n_regionkey = r_regionkey and n_nationkey = 3)")
def backlink_filter_eq(g):
    return g.select("Region", "name", where=linked_from("region", "Nation:3", "Nation"))


@suite("select r_name as name from region where not exists (select 1 from nation where n_regionkey = r_regionkey and n_nationkey = 3)")
def backlink_filter_ne(g):
    return g.select("Region", "name", where=not_linked_from("region", "Nation:3", "Nation"))


@suite("select r_name as name from region where exists (select 1 from nation where n_regionkey = r_regionkey and n_nationkey = 3) or r_name = 'ASIA'")
def backlink_filter_in_or(g):
    return g.select("Region", "name", where=linked_from("region", "Nation:3", "Nation") | field("name").eq("ASIA"))


@suite("select n_name as name, (select string_agg(r_name, ',' order by r_name) from region) as regions from nation")
def computed_subquery(g):
    found = g.select("Nation", "name", As("regions", Select("Region", ("name",), order_by="name")))
    return found.select("name", _ids("regions", "name").alias("regions"))


@suite("select quality::bigint as quality, lang, n_chars from labels join documents using (doc_id) where toxic = 0")
def single_link_large_target(g):
    found = g.select("Label", "quality", To("document", ("lang", "n_chars")), where=field("toxic").eq(0))
    return found.select("quality", F.col("document.lang").alias("lang"), F.col("document.n_chars").alias("n_chars"))


@suite("select 'Order:' || o_orderkey as id, 'Customer:' || o_custkey as customer_id from orders where o_custkey = 7")
def filter_link_id(g):
    return g.select("Order", "id", "customer_id", where=field("customer_id").eq("Customer:7"))


@suite("select event_type, count(*) as n, sum(value) as total from events where event_type in ('click', 'purchase') group by event_type")
def filter_then_aggregate(g):
    found = g.select("Event", "event_type", "value", where=field("event_type").one_of("click", "purchase"))
    return found.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


# free objects, expressions, bindings


@suite("select 'x' as s, 42 as n, '1,2,3' as xs, (select string_agg(r_name, ',' order by r_name) from region) as regions, 'RED' as color")
def free_object(g):
    found = g.free(s=Lit("x"), n=Lit(42), xs=Many((1, 2, 3)), regions=Select("Region", ("name",), order_by="name"), color=Member("shop::Color", "RED"))
    return found.select("s", "n", F.array_join(F.col("xs").cast("array<string>"), ",").alias("xs"), _ids("regions", "name").alias("regions"), "color")


@suite("select unnest(['ac', 'ad', 'bc', 'bd']) as value")
def select_expr_set(g):
    return g.values(Concat((Many(("a", "b")), Many(("c", "d")))))


@suite("select unnest(['RED', 'GREEN', 'BLUE']) as value")
def enum_cast_path(g):
    return g.values(Cast("shop::Color", Many(("RED", "GREEN", "BLUE"))))


@suite("select '5' as s, '5' as j")
def casts(g):
    return g.free(s=Cast("str", Lit(5)), j=Cast("json", Lit(5)))


@suite("select 'Customer:' || c_custkey as id from customer where c_mktsegment = 'MACHINERY'")
def with_scalar(g):
    segment = "MACHINERY"
    return g.select("Customer", where=field("mktsegment").eq(segment))


@suite("select c_name as name from customer where c_mktsegment = 'HOUSEHOLD' and c_name like '%1%' order by c_name, 'Customer:' || c_custkey limit 5")
def with_subquery_source(g):
    inner = Select("Customer", ("name",), where=field("mktsegment").eq("HOUSEHOLD"), limit=50)
    return g.select(inner.narrowed(where=field("name").like("%1%"), order_by="name", limit=5))


@suite("select 'Part:' || p_partkey as id from part where p_size = 10")
def with_param(g):
    return g.select("Part", where=field("size").eq(parameter("int64", "size", {"size": 10})))


@suite("select n_name as name from nation")
def with_module_alias(g):
    g = g.in_module("default")
    return g.select(g.catalog.resolve("s::Nation", aliases={"s": "shop"}), "name")


# functions


@suite("select 'Customer:' || c_custkey as id, abs(c_acctbal) as abs, ceil(c_acctbal)::bigint as ceil, floor(c_acctbal)::bigint as floor, round(sin(c_acctbal), 6) as sin, round(cos(c_acctbal), 6) as cos, round(atan(c_acctbal), 6) as atan from customer")
def math_unary(g):
    names = ("abs", "ceil", "floor", "sin", "cos", "atan")
    found = g.select("Customer", "id", *[As(n, Call(f"math::{n}", (Ref("acctbal"),))) for n in names])
    return found.select("id", "abs", "ceil", "floor", *[F.round(n, 6).alias(n) for n in names[3:]])


@suite("select 'Part:' || p_partkey as id, round(ln(p_retailprice), 6) as ln, round(log10(p_retailprice), 6) as lg, round(ln(p_retailprice) / ln(2), 6) as log2, round(exp(p_size), 6) as ex from part where p_size <= 10")
def math_log_family(g):
    price, small = Ref("retailprice"), field("size").one_of(*range(11))
    found = g.select("Part", "id", "size", As("ln", Call("math::ln", (price,))), As("lg", Call("math::lg", (price,))), As("log2", Call("math::log", (price, Lit(2)))), As("ex", Call("math::exp", (Ref("size"),))), where=small)
    return found.select("id", *[F.round(c, 6).alias(c) for c in ("ln", "lg", "log2")], F.round("ex", 6).alias("ex"))


@suite("select 3.0::double as mean, 2.0::double as sd, round(sqrt(8.0 / 3), 9) as sdp, 4.0::double as v, round(8.0 / 3, 9) as vp, null::double as none")
def math_set_aggregates(g):
    xs = (Many((1, 3, 5)),)
    names = {"mean": "mean", "sd": "stddev", "sdp": "stddev_pop", "v": "var", "vp": "var_pop"}
    found = g.free(**{k: Call(f"math::{f}", xs) for k, f in names.items()}, none=Call("math::stddev", (Many((1,)),)))
    return found.select("mean", "sd", F.round("sdp", 9).alias("sdp"), "v", F.round("vp", 9).alias("vp"), "none")


@suite("select round(pi(), 9) as pi, round(exp(1), 9) as e, null::double as acos, round(atan2(1, 2), 9) as atan2, null::double as cot, round(asin(0.5), 9) as asin, round(tan(0.5), 9) as tan")
def math_constants_trig(g):
    call = lambda f, *a: Call(f"math::{f}", tuple(map(Lit, a)))
    found = g.free(pi=call("pi"), e=call("e"), acos=call("acos", 2.0), atan2=call("atan2", 1, 2), cot=call("cot", 0.0), asin=call("asin", 0.5), tan=call("tan", 0.5))
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


@suite("select 'Order:' || o_orderkey as id, year(o_orderdate) as year, month(o_orderdate) as month, day(o_orderdate) as day, epoch(o_orderdate)::bigint as epoch from orders")
def datetime_get(g):
    get = lambda part: Call("std::datetime_get", (Ref("orderdate"), Lit(part)))
    return g.select("Order", "id", As("year", get("year")), As("month", get("month")), As("day", get("day")), As("epoch", get("epochseconds")))


@suite("select 'Order:' || o_orderkey as id, strftime(date_trunc('month', o_orderdate), '%Y-%m-%dT%H:%M:%S.%gZ') as month from orders")
def datetime_truncate(g):
    return g.select("Order", "id", As("month", Call("std::datetime_truncate", (Lit("month"), Ref("orderdate")))))


@suite("select '2024-02-03T04:05:06' as dt, '2024-02-03' as d, '04:05:06' as t, 2024 as y, 5 as m, '2024-02-03T04:05:06.000Z' as i")
def local_date_time_parts(g):
    call = lambda f, *a: Call(f, tuple(map(Lit, a)))
    return g.free(
        dt=call("cal::to_local_datetime", "2024-02-03T04:05:06"),
        d=call("cal::to_local_date", "2024-02-03"),
        t=call("cal::to_local_time", "04:05:06"),
        y=call("cal::date_get", "2024-02-03", "year"),
        m=call("cal::time_get", "04:05:06", "minute"),
        i=call("std::to_datetime", "2024-02-03T04:05:06Z"),
    )


@suite("select 'PT49H125M9S' as d, 49 as h, 'PT49H' as th, 'PT49H125M' as tm, 'PT51H5M9S' as nh, 'P2DT1H125M9S' as nd")
def duration_helpers(g):
    call = lambda f, *a: Call(f, tuple(map(Lit, a)))
    d = "PT49H125M9S"
    return g.free(
        d=call("std::to_duration", d),
        h=call("std::duration_get", d, "hours"),
        th=call("std::duration_truncate", "hours", d),
        tm=call("std::duration_truncate", "minutes", d),
        nh=call("cal::duration_normalize_hours", d),
        nd=call("cal::duration_normalize_days", d),
    )


@suite("select 'Part:' || p_partkey as id, p_size::varchar as size from part")
def to_str(g):
    return g.select("Part", "id", As("size", Call("std::to_str", (Ref("size"),))))


@suite("select n_name as name, n_name || '!' as loud from nation")
def user_function_concat(g):
    return g.select("Nation", "name", As("loud", Call("exclaim", (Ref("name"),))))


@suite("select unnest(['Hello!', 'World!']) as value")
def user_function_set(g):
    return g.values(Call("exclaim", (Many(("Hello", "World")),)))


@suite("select n_name as name, n_name || '!' as one, n_name || '?!' as two, '<' || n_name || '>' as three from nation")
def user_function_defaults(g):
    call = lambda *a, **named: Call("mark", (Ref("name"), *map(Lit, a)), {k: Lit(v) for k, v in named.items()})
    return g.select("Nation", "name", As("one", call()), As("two", call("?!")), As("three", call(">", before="<")))


@suite("select r_name as name, (select string_agg(n_name, ',' order by n_name) from nation where n_name like '%1%') as nations from region")
def user_function_query(g):
    found = g.select("Region", "name", As("nations", Call("nations_like", (Lit("%1%"),))))
    return found.select("name", _ids("nations", "name").alias("nations"))


# policies and changes


@suite("select c_name as name from customer where c_mktsegment = 'AUTOMOBILE'")
def policy_filtered_select(g):
    user = g.as_user(globals={"segment": "AUTOMOBILE"})
    return user.select("Customer", "name", order_by="name")


@suite("select n_name as name, n_regionkey as region from nation union all select 'ATLANTIS', 3")
def insert_then_select(g):
    g.insert("Nation", {"name": "ATLANTIS", "region": Select("Region", where=field("id").eq("Region:3"))})
    return g.select("Nation", "name", To("region")).select("name", F.split_part("region.id", F.lit(":"), F.lit(2)).cast("int").alias("region"))


@suite("select 'Part:' || p_partkey as id, case when p_brand = 'Brand#12' then 'Brand#99' else p_brand end as brand from part")
def update_then_select(g):
    g.update("Part", {"brand": "Brand#99"}, field("brand").eq("Brand#12"))
    return g.select("Part", "id", "brand")


@suite("select 'Part:' || p_partkey as id, case when p_size < 20 then 20 else p_size end::bigint as size from part")
def updates_one_after_another(g):
    for size in range(1, 20):
        g.update("Part", {"size": size + 1}, field("size").eq(size))
    return g.select("Part", "id", "size")


@suite("select 'Supplier:' || s_suppkey as id from supplier where not (s_nationkey = 3 or s_name like '%7')")
def delete_then_select(g):
    g.delete("Supplier", field("name").like("%7") | field("nation_id").eq("Nation:3"))
    return g.select("Supplier")


@suite("select r_name as name, 1::bigint as n_updates from region where r_name != 'ASIA' union all select 'FAR EAST', 1 union all select 'ATLANTIS', 1")
def reopened_folder(g):
    """What one session has changed in a folder, as the next one reads it."""
    folder = f"{shared_dir(g.spark)}/graph-{uuid.uuid4().hex}"
    first = Graph(g.spark, g.catalog, "shop", folder=folder)
    first.insert_rows("Region", g.select("Region", "name"))
    first.insert("Region", {"name": "ATLANTIS"})
    first.update("Region", {"name": "FAR EAST"}, field("name").eq("ASIA"))
    again = Graph(g.spark, g.catalog, "shop", folder=folder)
    return again.select("Region", "name").withColumn("n_updates", F.lit(again.version - 2).cast("long"))


@suite("select r_regionkey, case when r_name = 'ASIA' then 'FAR EAST' else r_name end as name from region union all select null, 'ATLANTIS'")
def conflict_upsert(g):
    g.insert("Region", {"name": "ASIA"}, Conflict("name", update={"name": "FAR EAST"}))
    g.insert("Region", {"name": "AFRICA"}, Conflict("name"))
    g.insert("Region", {"name": "ATLANTIS"}, Conflict("name", update={"name": "x"}))
    key = F.when(F.col("id").startswith("Region:"), F.split_part("id", F.lit(":"), F.lit(2)).try_cast("int"))
    return g.select("Region", "id", "name").select(key.alias("r_regionkey"), "name")


@suite("select r_name as name from region union all select unnest(['N1', 'N2', 'S1', 'S2'])")
def for_union_insert(g):
    g.for_each([a + b for a in "NS" for b in "12"], lambda name: ("Region", {"name": name}))
    return g.select("Region", "name")


@suite("select r_name as name from region union all select n_name from nation where n_regionkey = 1")
def bulk_insert_rows(g):
    g.insert_rows("Region", g.select("Nation", "name", where=field("region_id").eq("Region:1")))
    return g.select("Region", "name")


@suite("select 'Part:' || p_partkey as part from part where p_partkey < 3")
def insert_with_links(g):
    new = g.insert("Order", {"status": "O", "totalprice": 1.5, "customer": "Customer:1", "parts": ["Part:0", "Part:1", Select("Part", where=field("id").eq("Part:2"))]})
    found = g.select("Order", To("parts"), where=field("id").eq(new.id))
    return found.select(F.explode("parts.id").alias("part"))


def _with(g: Graph, name: str, **more) -> Graph:
    known = g.catalog.type(name)
    g.catalog = g.catalog.with_types(ObjectType(known.name, known.members, known.bases, known.abstract, **more))
    g.store.catalog = g.catalog
    return g


@suite("select 'update' as action, n_name as target_name, n_name || '>' || 'GALLIA' as change from nation where n_name = 'NATION_7' union all select 'delete', 'NATION_9', null")
def trigger_log(g):
    g = _with(
        g,
        "shop::Nation",
        triggers=(
            Trigger("renamed", "update", "shop::Log", {"action": "update", "target_name": old("name"), "change": new("name")}, "name"),
            Trigger("gone", "delete", "shop::Log", {"action": "delete", "target_name": old("name")}),
        ),
    )
    g.update("Nation", {"name": "GALLIA"}, field("name").eq("NATION_7"))
    g.update("Nation", {"name": "NATION_4"}, field("name").eq("NATION_4"))
    g.delete("Nation", field("name").eq("NATION_9"))
    found = g.select("Log", "action", "target_name", "change")
    return found.withColumn("change", F.when(F.col("change").isNotNull(), F.concat("target_name", F.lit(">"), "change")))


@suite("select 'Part:' || p_partkey as id, case when p_size = 7 then 8 else p_size end::bigint as size, case when p_size = 7 then 'touched' else p_type end as ptype from part")
def rewrite_literal(g):
    g = _with(g, "shop::Part", rewrites=(Rewrite("ptype", ("insert", "update"), "touched"),))
    g.update("Part", {"size": 8}, field("size").eq(7))
    return g.select("Part", "id", "size", "ptype")


@suite(
    """select * from (values ('shop::Customer', 5, 2, 1), ('shop::Document', 5, 0, 0), ('shop::Event', 6, 0, 0), ('shop::Label', 3, 1, 0), ('shop::LineItem', 4, 3, 0),
    ('shop::Log', 4, 0, 0), ('shop::Nation', 2, 1, 0), ('shop::Order', 5, 2, 0), ('shop::Part', 6, 0, 0), ('shop::Party', 3, 1, 1), ('shop::Region', 2, 1, 0), ('shop::Supplier', 3, 1, 1))
    as t(name, n_properties, n_links, n_annotations)"""
)
def introspection_types(g):
    return g.object_types().select("name", F.size("properties").alias("n_properties"), F.size("links").alias("n_links"), F.size("annotations").alias("n_annotations"))


@suite("select n_name as name, 0::bigint as population from nation")
def migration_add_property(g):
    from weftline.operators import migrate

    known = g.catalog.type("shop::Nation")
    after = g.catalog.with_types(ObjectType(known.name, (*known.members, Property("population", "int", required=True))))
    migrate.apply(g, after, "m1")
    return g.select("Nation", "name", "population")
