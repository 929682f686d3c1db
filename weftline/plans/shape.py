"""Shapes as plans: filters and top-k on the scanned type first, then one join for each link.

A single link joins its target's struct; other links are joined with their targets, put in order and gathered into one
array for each source, and joined once. Nothing is evaluated here: every result is a lazy DataFrame.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.errors import semantic
from weftline.functions import stdlib
from weftline.functions.predicates import Both, Compare, LinkedFrom, Not, Predicate, TypeIs, compare
from weftline.functions.stdlib import Value
from weftline.plans.catalog import Catalog, Computed, Link, Property, qualified
from weftline.plans.elements import All, As, Back, Call, Cast, Concat, IfType, Lit, Many, Member, Ref, Select, To, TypeName
from weftline.sources.store import Store


#: Rows of a subquery that may be gathered in one array beside other rows.
MOST_GATHERED = 100_000


class Shaper:
    """Lowers queries against a store; ``visible(type)`` is the condition of the select policies, or None."""

    def __init__(self, store: Store, module: str = "default", visible: Callable[[str], Column | None] = lambda name: None, run: Any = None):
        self.store, self.catalog, self.module, self.visible, self.run = store, store.catalog, module, visible, run
        self.made = 0
        #: Rows are those of a table that is being changed: ids and link ids are columns of text.
        self.changing = False

    def fresh(self) -> str:
        self.made += 1
        return f"_x{self.made}"

    # queries

    def select(self, q: Select) -> DataFrame:
        df, outs, order = self.lowered(q)
        if order:
            df = df.orderBy(*order)
        return df.select(*[c.alias(n) for n, c in outs])

    @staticmethod
    def paged(q: Select | To) -> bool:
        return q.limit is not None or q.offset > 0

    def lowered(self, q: Select) -> tuple[DataFrame, list[tuple[str, Column]], list[Column]]:
        name = self.catalog.resolve(q.type, self.module)
        arms = self.catalog.concrete(name)
        df = self.rows(name, arms, q.where)
        order: list[Column] = []
        if q.order_by or self.paged(q):
            df = df.withColumn("_by", self.property(name, q.order_by) if q.order_by else F.col("_id"))
            order = [F.col("_by").desc() if q.desc else F.col("_by").asc(), F.col("_id").asc()]
        if self.paged(q):
            df = df.orderBy(*order).offset(q.offset)
            df = df if q.limit is None else df.limit(q.limit)
        df, outs = self.build(df, name, arms, q.shape, q.where is not None or q.limit is not None)
        return df, outs, order

    def rows(self, name: str, arms: list[str], where: Predicate | None) -> DataFrame:
        """The scanned rows of all arms that may be seen and meet the condition."""
        frames = []
        for arm in arms:
            frame = self.store.frame(arm)
            if (seen := self.visible(arm)) is not None:
                frame = frame.where(seen)
            if len(arms) > 1:
                frame = frame.withColumn("_k", F.col("_k").cast("string"))
            if where is not None:
                frame = self.filtered(frame, name, [arm], where, len(arms) > 1)
            frames.append(frame)
        if not frames:
            raise semantic(f"object type '{name}' has no concrete types")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    # conditions

    def filtered(self, df: DataFrame, name: str, arms: list[str], where: Predicate, as_text: bool = False) -> DataFrame:
        for part in _conjuncts(where):
            if isinstance(part, LinkedFrom):
                ids, on = self._linked(part, arms, as_text)
                df = df.join(ids, F.col(on) == F.col("_linked"), "left_anti" if part.negated else "left_semi")
                continue
            flags: dict[LinkedFrom, Column] = {}
            for leaf in part.leaves():
                if isinstance(leaf, LinkedFrom):
                    ids, on = self._linked(leaf, arms, as_text)
                    flag = self.fresh()
                    df = df.join(ids.withColumnRenamed("_linked", f"{flag}j").withColumn(flag, F.lit(True)), F.col(on) == F.col(f"{flag}j"), "left")
                    found = F.coalesce(F.col(flag), F.lit(False))
                    flags[leaf] = ~found if leaf.negated else found
            df = df.where(self.condition(part, name, arms, flags))
        return df

    def condition(self, p: Predicate, name: str, arms: list[str], flags: dict | None = None) -> Column:
        if isinstance(p, Both):
            a, b = self.condition(p.left, name, arms, flags), self.condition(p.right, name, arms, flags)
            return a & b if p.op == "and" else a | b
        if isinstance(p, Not):
            return ~self.condition(p.inner, name, arms, flags)
        if isinstance(p, TypeIs):
            return compare(F.col("_type"), p.op, qualified(p.value))
        if isinstance(p, LinkedFrom):
            return (flags or {})[p]
        assert isinstance(p, Compare)
        values = list(p.value) if p.op in ("in", "not in") else [p.value]
        if p.name == "id" and not self.changing:
            hits = [reduce(lambda a, b: a | b, [(F.col("_type") == arm) & self.store.is_id(arm, F.col("_k"), v) for arm in arms]) for v in values]
            found = reduce(lambda a, b: a | b, hits, F.lit(False))
            return ~found if p.op in ("!=", "not in") else found
        if p.name == "id":
            return compare(F.col("_id"), p.op, p.value)
        member = self.member(name, p.name)
        if (link := p.name[:-3]) in self.catalog.links(name) and p.name.endswith("_id") and not self.changing:
            return self.link_condition(p, arms, link, values)
        if p.op in ("like", "ilike") and member.type not in ("str",):
            raise semantic(f"operator '{p.op}' needs a str, and '{p.name}' is {member.type}")
        for v in values:
            self.check_value(member, v)
        column = F.col(p.name)
        if member.multi:
            return F.coalesce(F.exists(column, lambda x: compare(x, p.op, p.value)), F.lit(False))
        return compare(column, p.op, p.value)

    def link_condition(self, p: Compare, arms: list[str], link: str, values: list[Any]) -> Column:
        """A condition on a link's id: on the key that the row holds where there is one."""
        to = self.store.only_target(link, arms[0])
        keyed = len(arms) == 1 and to is not None and self.store.binding(arms[0]).native
        if not keyed or p.op not in ("=", "!=", "in", "not in"):
            return compare(self.link_id(arms, link), p.op, p.value)
        found = reduce(lambda a, b: a | b, [self.store.is_native_id(to, F.col(f"_l_{link}"), v) for v in values], F.lit(False))
        return ~found & F.col(f"_l_{link}").isNotNull() if p.op in ("!=", "not in") else found

    def check_value(self, member: Property, value: Any) -> None:
        kind = self.catalog.spark_type(member.type)
        good = {"bigint": (int,), "double": (int, float), "boolean": (bool,), "string": (str,)}[kind]
        if value is not None and (not isinstance(value, good) or (kind != "boolean" and isinstance(value, bool))):
            raise semantic(f"value {value!r} does not fit '{member.name}' of type {member.type}")
        if (members := self.catalog.enum(member.type)) and value is not None and value not in members:
            raise semantic(f"invalid input value for enum '{member.type}': {value!r}")

    def member(self, name: str, field: str) -> Property:
        m = self.catalog.members(name).get(field)
        if isinstance(m, Property):
            return m
        if m is None and field.endswith("_id") and isinstance(self.catalog.members(name).get(field[:-3]), Link):
            return Property(field, "uuid")
        raise semantic(f"'{name}' has no property '{field}'")

    def property(self, name: str, field: str) -> Column:
        if field == "id":
            return F.col("_id")
        self.member(name, field)
        if field not in self.catalog.properties(name) and not self.changing:
            return self.link_id(self.catalog.concrete(name), field[:-3])
        return F.col(field)

    def _linked(self, p: LinkedFrom, arms: list[str], as_text: bool) -> tuple[DataFrame, str]:
        """The keys (or ids) of the objects that the object with an id links to, each once."""
        found = []
        for source in self.sources(p.link, p.source, arms):
            pairs = self.store.pairs(source, p.link)
            by_key = pairs.keyed and not as_text and len(arms) == 1
            hit = pairs.rows.where(self.store.is_id(source, F.col("_sk"), p.id))
            found.append((hit.select(F.col("_tk" if by_key else "_tid").alias("_linked")), by_key))
        by_key = all(k for _, k in found)
        if not by_key and any(k for _, k in found):
            return self._linked(p, arms, True)
        return reduce(DataFrame.unionByName, [d for d, _ in found]).distinct(), "_k" if by_key else "_id"

    def sources(self, link: str, source: str | None, arms: list[str]) -> list[str]:
        """Concrete types that have a link of that name to one of the arms."""
        names = self.catalog.concrete(self.catalog.resolve(source, self.module)) if source else sorted(n for n, t in self.catalog.types.items() if not t.abstract)
        out = []
        for n in names:
            held = self.catalog.links(n).get(link)
            if held and any(self.catalog.assignable(arm, qualified(held.target)) for arm in arms):
                out.append(n)
        if not out:
            raise semantic(f"no type has a link '{link}' to {' or '.join(arms)}")
        return out

    # shapes

    def build(self, df: DataFrame, name: str, arms: list[str], shape: tuple, narrowed: bool) -> tuple[DataFrame, list[tuple[str, Column]]]:
        """``df`` joined with what the elements need, and the output columns by name."""
        outs: list[tuple[str, Column]] = []
        elements = self.expanded(name, arms, shape)
        if not elements:
            raise semantic("a shape must not be empty")
        for e in elements:
            df, column, out = self.element(df, name, arms, e, narrowed)
            if any(out == n for n, _ in outs):
                raise semantic(f"duplicate name '{out}' in a shape")
            outs.append((out, column))
        return df, outs

    def expanded(self, name: str, arms: list[str], shape: tuple) -> list[Any]:
        """The shape with its splats written out; names that are there already are skipped."""
        out: list[Any] = []
        taken = {self._name(e) for e in shape if not isinstance(e, All)}
        for e in shape:
            if not isinstance(e, All):
                out.append(e)
                continue
            of = self.catalog.resolve(e.only or e.of, self.module) if e.only or e.of else name
            if e.of and not self.catalog.assignable(name, of):
                raise semantic(f"'{of}' is not a super type of '{name}'")
            if e.only and not self.catalog.assignable(of, name):
                raise semantic(f"'{of}' is not a sub type of '{name}'")
            for n in ["id", *self.catalog.properties(of)]:
                if n not in taken:
                    taken.add(n)
                    out.append(As(n, IfType(of, n)) if e.only else n)
            for n in self.catalog.links(of) if e.deep and (not e.only or of in arms) else ():
                if n not in taken:
                    taken.add(n)
                    out.append(To(n, (All(),)))
        return out

    @staticmethod
    def _name(e: Any) -> str:
        return e if isinstance(e, str) else e.name or e.link if isinstance(e, To) else e.name

    def element(self, df: DataFrame, name: str, arms: list[str], e: Any, narrowed: bool) -> tuple[DataFrame, Column, str]:
        if isinstance(e, str):
            if e == "id":
                return df, F.col("_id"), e
            member = self.catalog.members(name).get(e)
            if isinstance(member, Computed):
                value = member.element
                if isinstance(value, To):
                    return (*self.link(df, arms, value, narrowed), e)
                return (*self.value(df, name, arms, value), e)
            if isinstance(member, Link):
                return (*self.link(df, arms, To(e), narrowed), e)
            if self.member(name, e).multi:
                return df, F.coalesce(F.col(e), F.expr("cast(array() as array<string>)").cast(f"array<{self.catalog.spark_type(member.type)}>")), e
            return df, F.col(e) if member else self.link_id(arms, e[:-3]), e
        if isinstance(e, To):
            return (*self.link(df, arms, e, narrowed), e.name or e.link)
        if isinstance(e, As):
            return (*self.value(df, name, arms, e.value), e.name)
        raise semantic(f"{e!r} is no element of a shape")

    def link_id(self, arms: list[str], link: str) -> Column:
        to = self.store.only_target(link, arms[0])
        native = to is not None and self.store.binding(arms[0]).native
        return self.store.native_id(to, F.col(f"_l_{link}")) if native else F.col(f"_l_{link}")

    def value(self, df: DataFrame, name: str, arms: list[str], v: Any) -> tuple[DataFrame, Column]:
        if isinstance(v, Back):
            return self.back(df, arms, v)
        if isinstance(v, Select):
            return self.constant(df, self.gathered(v))
        if isinstance(v, TypeName):
            return df, F.struct(F.col("_type").alias("name"))
        if isinstance(v, IfType):
            of = self.catalog.resolve(v.type, self.module)
            value = F.col("_id") if v.name == "id" else F.col(v.name)
            self.property(of, v.name)
            return df, F.when(F.col("_type") == of, value)
        got = self.expression(v, lambda field: self.property(name, field), name)
        return self.constant(df, self.gathered(got)) if isinstance(got, Select) else (df, got.col)

    def gathered(self, q: Select) -> DataFrame:
        """A query's rows as one row with an ordered array of structs; an error beyond ``MOST_GATHERED`` rows.

        The first rows are taken where they are, so no task or broadcast holds more than that and one, whatever the
        query finds.
        """
        df, outs, order = self.lowered(q)
        keys = ["_by", "_id"] if order else ["_id"]
        first = df.orderBy(*(order or ["_id"])).select(*keys, F.struct(*[c.alias(n) for n, c in outs]).alias("item")).limit(MOST_GATHERED + 1)
        place = F.row_number().over(Window.orderBy(*(order or ["_id"]))).alias("place")
        many = F.sort_array(F.collect_list(F.struct("place", "item")))
        all_of = first.select(place, "item").agg(many.alias("all"))
        too_many = F.raise_error(F.lit(f"a subquery that is gathered may have {MOST_GATHERED} rows at most; give it a limit"))
        return all_of.select(F.when(F.size("all") > MOST_GATHERED, too_many).otherwise(F.transform("all", lambda x: x["item"])).alias("items"))

    def constant(self, df: DataFrame, one: DataFrame) -> tuple[DataFrame, Column]:
        """A result of one row, of bounded size, beside every row."""
        n = self.fresh()
        return df.crossJoin(F.broadcast(one.toDF(n))), F.col(n)

    def link(self, df: DataFrame, arms: list[str], e: To, narrowed: bool) -> tuple[DataFrame, Column]:
        with_link = [a for a in arms if e.link in self.catalog.links(a)]
        computed = [a for a in arms if isinstance(self.catalog.members(a).get(e.link), Computed)]
        if not with_link or computed:
            raise semantic(f"{' or '.join(arms)} has no link '{e.link}'")
        held = self.catalog.links(with_link[0])[e.link]
        target = self.catalog.resolve(held.target)
        targets = self.catalog.concrete(target)
        if e.only:
            target = self.catalog.resolve(e.only, self.module)
            targets = [t for t in targets if self.catalog.assignable(t, target)]
            if not targets:
                raise semantic(f"link '{e.link}' has no targets of type '{e.only}'")
        n = self.fresh()
        found = self.rows(target, targets, e.where)
        if e.order_by:
            found = found.withColumn("_by", self.property(target, e.order_by))
        found, outs = self.build(found, target, targets, e.shape, e.where is not None)
        whole = len(self.catalog.concrete(self.catalog.resolve(held.target))) == 1
        alike = len({self.store.binding(a).native for a in with_link}) == 1
        inline = not held.multi and alike and all(self.store.inline(a, e.link) for a in with_link)
        pairs = [self.store.pairs(a, e.link) for a in with_link]
        keyed = whole and all(p.keyed for p in pairs)
        item = F.struct(*[c.alias(k) for k, c in outs])
        kind = found.select(item.alias("i")).schema["i"].dataType
        if inline and not e.props:
            if e.offset >= 1 or e.limit == 0:
                return df, F.lit(None).cast(kind)
            on = found.select(F.col("_k" if keyed else "_id").alias(f"{n}j"), item.alias(n))
            own = F.col(f"_l_{e.link}") if keyed else self.link_id(with_link, e.link)
            return df.join(on, own == F.col(f"{n}j"), "left"), F.col(n)
        by_key = len(arms) == 1
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.rows for p in pairs] if by_key else [p.rows.drop("_sk") for p in pairs])
        rows = rows.withColumnRenamed("_sk" if by_key else "_sid", f"{n}s")
        if narrowed:
            rows = rows.join(df.select(F.col("_k" if by_key else "_id").alias("_parent")), F.col(f"{n}s") == F.col("_parent"), "left_semi")
        props = [F.col(f"@{p}") for p in e.props]
        rows = rows.select(f"{n}s", F.col("_tk" if keyed else "_tid").alias("_t"), *props)
        on = found.select(F.col("_k" if keyed else "_id").alias("_to"), *(["_by"] if e.order_by else []), F.col("_id").alias("_toid"), item.alias("_item"))
        # Targets of a multi link may be many, whatever their files' size: as a broadcast each task would hold all of them.
        rows = rows.join(on.hint("merge") if held.multi else on, F.col("_t") == F.col("_to"))
        if props:
            rows = rows.withColumn("_item", F.struct("_item.*", *props))
        listed = self.listed(rows, f"{n}s", e).toDF(f"{n}j", n)
        df = df.join(listed, F.col("_k" if by_key else "_id") == F.col(f"{n}j"), "left")
        if not held.multi:
            return df, F.try_element_at(F.col(n), F.lit(1))
        return df, F.coalesce(F.col(n), F.array().cast(listed.schema[n].dataType))

    def listed(self, rows: DataFrame, source: str, e: To) -> DataFrame:
        """For each source its items in order, in one array. A pair that is there twice counts once, unless it has properties.

        One shuffle by source does it: equal pairs share a rank and fall together in the set that is gathered. Only pages
        and descending orders need ranks, which sort all rows of a task once more.
        """
        order = ["_by"] if e.order_by else []
        if not (self.paged(e) or e.desc):
            gathered = F.collect_list if e.props else F.collect_set
            props = [F.col("_item")[f"@{p}"].alias(f"_p{i}") for i, p in enumerate(e.props)]
            items = F.sort_array(gathered(F.struct(*order, "_toid", *props, "_item")))
        else:
            keys = [F.col("_by").desc() if e.desc else F.col("_by").asc() for _ in order] + [F.col("_toid").asc(), *[F.col("_item")[f"@{p}"] for p in e.props]]
            place = (F.row_number() if e.props else F.dense_rank()).over(Window.partitionBy(source).orderBy(*keys))
            rows = rows.withColumn("_place", place)
            if self.paged(e):
                rows = rows.where(F.col("_place") > e.offset)
                rows = rows if e.limit is None else rows.where(F.col("_place") <= e.offset + e.limit)
            items = F.sort_array(F.collect_set(F.struct("_place", "_item")))
        return rows.groupBy(source).agg(items.alias("items")).select(source, F.transform("items", lambda x: x["_item"]))

    def back(self, df: DataFrame, arms: list[str], e: Back) -> tuple[DataFrame, Column]:
        n = self.fresh()
        found = []
        for source in self.sources(e.link, e.source, arms):
            pairs = self.store.pairs(source, e.link)
            found.append((source, pairs, pairs.keyed and len(arms) == 1))
        by_key = all(k for _, _, k in found)
        rows = [
            p.rows.select(F.col("_tk" if by_key else "_tid").alias(f"{n}j"), F.struct(F.lit(s).alias("type"), F.col("_sid").alias("id")).alias("at"))
            for s, p, _ in found
        ]
        found = reduce(DataFrame.unionByName, rows).distinct() if e.count or e.limit is not None else reduce(DataFrame.unionByName, rows)
        if e.count:
            counted = found.groupBy(f"{n}j").agg(F.count("*").alias(n))
            return df.join(counted, F.col("_k" if by_key else "_id") == F.col(f"{n}j"), "left"), F.coalesce(F.col(n), F.lit(0).cast("long"))
        if e.limit is not None:
            found = found.withColumn("place", F.row_number().over(Window.partitionBy(f"{n}j").orderBy("at"))).where(F.col("place") <= e.limit)
        listed = found.groupBy(f"{n}j").agg(F.sort_array(F.collect_set("at")).alias("all"))
        items = F.transform("all", lambda x: F.struct(x["id"].alias("id"), x["type"].alias("__type__")))
        listed = listed.select(f"{n}j", items.alias(n))
        df = df.join(listed, F.col("_k" if by_key else "_id") == F.col(f"{n}j"), "left")
        return df, F.coalesce(F.col(n), F.array().cast(listed.schema[n].dataType))

    # expressions

    def expression(self, v: Any, ref: Callable[[str], Column] | None = None, name: str | None = None) -> Value:
        if isinstance(v, Value):
            return v
        if isinstance(v, Lit):
            return Value(F.lit(v.value))
        if isinstance(v, Many):
            return Value(F.array(*[F.lit(x) for x in v.values]), "array" if v.array else "set")
        if isinstance(v, Ref):
            if ref is None:
                raise semantic(f"'.{v.name}' has no object here")
            column = ref(v.name)
            multi = name is not None and v.name != "id" and self.member(name, v.name).multi
            return Value(column, "set" if multi else "scalar")
        if isinstance(v, Concat):
            return self.joined(v, ref, name)
        if isinstance(v, Member):
            return Value(F.lit(enum_member(self.catalog, v.enum, v.member)))
        if isinstance(v, Cast):
            return self.cast(v, ref, name)
        if isinstance(v, Call):
            return self.call(v, ref, name)
        if isinstance(v, (str, int, float, bool)) or v is None:
            return Value(F.lit(v))
        raise semantic(f"{v!r} is no expression")

    def joined(self, v: Concat, ref: Callable | None, name: str | None) -> Value:
        for p in v.parts:
            raw = p.value if isinstance(p, Lit) else p
            if isinstance(raw, (int, float)):
                raise semantic(f"operator '++' cannot be applied to operands of type 'std::str' and '{type(raw).__name__}'")
            if isinstance(p, Ref) and name and p.name != "id" and self.catalog.enum(self.member(name, p.name).type):
                raise semantic(f"operator '++' cannot be applied to operands of type '{self.member(name, p.name).type}' and 'std::str'")
            if isinstance(p, (Member, Cast)) and self.catalog.enum(getattr(p, "enum", getattr(p, "type", ""))):
                raise semantic("operator '++' cannot be applied to operands of type enum and 'std::str'")
        return self._elementwise([self.expression(p, ref, name) for p in v.parts], lambda *cols: F.concat(*[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), product=True)

    def _elementwise(self, args: list[Value], f: Callable[..., Column], product: bool) -> Value:
        """``f`` of scalars; over sets, of all combinations (``product``) or of elements at the same place."""
        sets = [a for a in args if a.kind == "set"]
        if not sets:
            return Value(f(*[a.one for a in args]))
        if product:
            rows = F.transform(self._set(args[0]), lambda x: F.array(x.cast("string")))
            for a in args[1:]:
                rows = self._crossed(rows, self._set(a))
            out = F.transform(rows, lambda r: f(*[F.element_at(r, i + 1) for i in range(len(args))]))
            return Value(out, "set")
        size = F.greatest(*[F.size(a.col) for a in sets], F.lit(1)) if len(sets) > 1 else F.size(sets[0].col)
        at = lambda a, i: F.coalesce(F.get(a.col, i), F.lit("")) if a.kind == "set" else a.one
        return Value(F.transform(F.sequence(F.lit(0), size - 1), lambda i: f(*[at(a, i) for a in args])), "set")

    @staticmethod
    def _set(a: Value) -> Column:
        return a.many if a.kind == "set" else F.array(a.one)

    @staticmethod
    def _crossed(rows: Column, many: Column) -> Column:
        return F.flatten(F.transform(rows, lambda r: F.transform(many, lambda x: F.concat(r, F.array(x.cast("string"))))))

    def cast(self, v: Cast, ref: Callable | None, name: str | None) -> Value:
        if members := self.catalog.enum(v.type):
            inner = v.value
            if isinstance(inner, Cast) and inner.type == "json":
                raw = inner.value.value if isinstance(inner.value, Lit) else inner.value
                if raw is not None and not isinstance(raw, str):
                    kind = "boolean" if isinstance(raw, bool) else "number" if isinstance(raw, (int, float)) else type(raw).__name__
                    raise semantic(f"expected JSON string or null; got JSON {kind}")
                inner = Lit(raw)
            for x in inner.values if isinstance(inner, Many) else [inner.value if isinstance(inner, Lit) else inner]:
                if x is not None and x not in members:
                    raise semantic(f"invalid input value for enum '{v.type}': {x!r}")
            return self.expression(inner if isinstance(inner, (Many, Lit)) else Lit(inner), ref, name)
        inner = self.expression(v.value, ref, name)
        if v.type == "str":
            text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
            return Value(F.transform(inner.col, text), "set") if inner.kind == "set" else Value(text(inner.one))
        if v.type == "json":
            if isinstance(v.value, (Lit, Many)):
                raw = v.value.value if isinstance(v.value, Lit) else list(v.value.values)
                return Value(F.lit(json.dumps(raw)))
            return Value(F.to_json(F.struct(inner.col.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(inner.col.alias("v")))) - 6))
        raise semantic(f"cannot cast to '{v.type}' here")

    def call(self, v: Call, ref: Callable | None, name: str | None) -> Value:
        user = self.catalog.function(v.function, v.args, v.named, self.module)
        if not user:
            if v.named:
                raise semantic(f"function '{v.function}' has no such parameters")
            return stdlib.call(v.function, [self.expression(a, ref, name) for a in v.args], self.module)
        f, bound = user
        if f.modifying:
            for param, raw in bound:
                if isinstance(raw, Many) and len(raw.values) > 1:
                    raise semantic("possibly more than one element passed into modifying function")
                if isinstance(raw, Many) and not raw.values and param not in f.optional:
                    raise semantic("possibly an empty set passed as non-optional argument into modifying function")
            bound = [(param, (*raw.values, None)[0] if isinstance(raw, Many) else raw) for param, raw in bound]
        if f.modifying or f.query:
            return self.answer(f.body(self.run, *[raw.value if isinstance(raw, Lit) else raw for _, raw in bound]))
        args = [self.expression(raw, ref, name) if raw is not None else Value(F.lit(None).cast("string")) for _, raw in bound]
        return self._elementwise(args, lambda *cols: self.expression(f.body(*[Value(c) for c in cols])).one, product=False)

    def answer(self, found: Any) -> Any:
        """What a function that runs a query returns: a query stands for the set of its rows, anything else for itself."""
        return Value(F.lit(found)) if isinstance(found, (str, int, float, bool)) or found is None else found


def _conjuncts(p: Predicate) -> list[Predicate]:
    return _conjuncts(p.left) + _conjuncts(p.right) if isinstance(p, Both) and p.op == "and" else [p]


def enum_member(catalog: Catalog, enum: str, member: str) -> str:
    members = catalog.enum(enum)
    if not members:
        raise semantic(f"'{enum}' is no enum")
    if not member:
        raise semantic("enum path expression lacks an enum member name")
    if member not in members:
        raise semantic(f"enum '{enum}' has no member called '{member}'")
    return member
