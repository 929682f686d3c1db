import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from weftline.errors import GraphError
from weftline.functions.predicates import field, linked_from, not_linked_from, type_is
from weftline.graph import Graph, parameter
from weftline.operators import migrate
from weftline.operators.changes import Conflict, Insert, combinations
from weftline.plans.catalog import Catalog, Computed, Constraint, Link, ObjectType, Policy, Property, Rewrite, Trigger, UserFunction, new, old
from weftline.plans.elements import All, As, Back, Call, Cast, Concat, IfType, Lit, Many, Member, Ref, Select, To, TypeName
from weftline.streaming.changes import stream_inserts


def movie_catalog():
    return Catalog.of(
        ObjectType("Person", (Property("name", required=True),), abstract=True),
        ObjectType("Hero", (Property("secret_identity"), Link("villains", "Villain", multi=True)), bases=("Person",)),
        ObjectType("Villain", (Property("rank", "int"), Link("nemesis", "Hero")), bases=("Person",)),
        ObjectType("Movie", (Property("title", required=True), Property("year", "int"), Property("tags", multi=True), Property("color", "Color"), Link("characters", "Person", multi=True))),
        enums={"Color": ("RED", "GREEN")},
    )


@pytest.fixture
def movies(spark):
    g = Graph(spark, movie_catalog())
    green = g.insert("Villain", {"name": "Green Goblin", "rank": 1}).id
    ock = g.insert("Villain", {"name": "Doc Ock", "rank": 2}).id
    spider = g.insert("Hero", {"name": "Spider-Man", "secret_identity": "Peter", "villains": [green, ock]}).id
    iron = g.insert("Hero", {"name": "Iron Man"}).id
    g.insert("Villain", {"name": "Venom", "nemesis": spider})
    g.insert("Movie", {"title": "Spider", "year": 2002, "tags": ["a", "b"], "color": "RED", "characters": [spider, green]})
    return g, {"green": green, "ock": ock, "spider": spider, "iron": iron}


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_nested_shapes(movies):
    g, ids = movies
    got = rows(g.select("Hero", "name", To("villains", ("name", As("nick", Ref("name"))), order_by="name"), order_by="name"))
    assert got == [
        {"name": "Iron Man", "villains": []},
        {"name": "Spider-Man", "villains": [{"name": "Doc Ock", "nick": "Doc Ock"}, {"name": "Green Goblin", "nick": "Green Goblin"}]},
    ]
    got = rows(g.select("Hero", To("villains", ("name",), where=field("name").like("%O%"), order_by="rank", desc=True, offset=1, limit=5), where=field("name").eq("Spider-Man")))
    assert got == [{"villains": [{"name": "Green Goblin"}]}]
    got = rows(g.select("Villain", "name", To("nemesis", ("secret_identity",)), order_by="name"))
    assert [r["nemesis"] for r in got] == [None, None, {"secret_identity": "Peter"}]
    assert rows(g.select("Villain", To("nemesis", limit=0), where=field("name").eq("Venom"))) == [{"nemesis": None}]


def test_polymorphism(movies):
    g, ids = movies
    got = rows(g.select("Person", "name", As("t", TypeName()), As("si", IfType("Hero", "secret_identity")), order_by="name"))
    assert got[4] == {"name": "Venom", "t": {"name": "default::Villain"}, "si": None} and got[3]["si"] == "Peter"
    got = rows(g.select("Movie", To("characters", ("name",), order_by="name")))
    assert [c["name"] for c in got[0]["characters"]] == ["Green Goblin", "Spider-Man"]
    got = rows(g.select("Movie", To("characters", ("secret_identity",), only="Hero")))
    assert got == [{"characters": [{"secret_identity": "Peter"}]}]
    assert len(rows(g.select("Person", where=type_is("Hero")))) == 2


def test_splats(movies):
    g, ids = movies
    got = rows(g.select("Hero", All(deep=True), where=field("id").eq(ids["iron"])))
    assert got == [{"id": ids["iron"], "name": "Iron Man", "secret_identity": None, "villains": []}]
    assert g.select("Hero", "name", All()).columns == ["name", "id", "secret_identity"]
    assert g.select("Villain", All(of="Person")).columns == ["id", "name"]
    with pytest.raises(GraphError):
        g.select("Movie", All(of="Person"))


def test_backlinks(movies):
    g, ids = movies
    got = rows(g.select("Villain", "name", As("heroes", Back("villains", "Hero")), order_by="name"))
    assert got[1]["heroes"] == [{"id": ids["spider"], "__type__": "default::Hero"}] and got[2]["heroes"] == []
    names = lambda p: [r["name"] for r in rows(g.select("Villain", "name", where=p, order_by="name"))]
    assert names(linked_from("villains", ids["spider"])) == ["Doc Ock", "Green Goblin"]
    assert names(not_linked_from("villains", ids["spider"], "Hero")) == ["Venom"]
    assert names(linked_from("villains", ids["spider"]) & field("rank").eq(1)) == ["Green Goblin"]
    assert names(~linked_from("villains", ids["spider"]) | field("rank").eq(2)) == ["Doc Ock", "Venom"]
    with pytest.raises(GraphError):
        names(linked_from("nothing", "x"))


def test_multi_and_enum_properties(movies):
    g, ids = movies
    assert rows(g.select("Movie", "tags", "color")) == [{"tags": ["a", "b"], "color": "RED"}]
    assert len(rows(g.select("Movie", where=field("tags").eq("b")))) == 1
    for bad in ({"title": "x", "color": "PINK"}, {"title": 5}, {"title": "x", "id": "y"}, {"title": "x", "nothing": 1}, {"year": 1}):
        with pytest.raises(GraphError):
            g.insert("Movie", bad)
    with pytest.raises(GraphError, match="invalid input value for enum"):
        g.select("Movie", where=field("color").eq("PINK"))
    with pytest.raises(GraphError, match="abstract"):
        g.insert("Person", {"name": "x"})


def test_expressions(movies):
    g, _ = movies
    got = rows(g.free(a=Lit("x"), b=Many((1, 2)), c=Select("Hero", ("name",), order_by="name"), d=Member("Color", "RED"), e=Cast("str", Lit(None)), f=Cast("Color", Lit("GREEN"))))
    assert got == [{"a": "x", "b": [1, 2], "c": [{"name": "Iron Man"}, {"name": "Spider-Man"}], "d": "RED", "e": "", "f": "GREEN"}]
    assert [r.value for r in g.values(Cast("Color", Many(("RED", "GREEN")))).collect()] == ["RED", "GREEN"]
    assert [r.value for r in g.values(Concat((Many(("a", "b")), Lit("-"), Many(("c", "d"))))).collect()] == ["a-c", "a-d", "b-c", "b-d"]
    for bad in (Member("Color", "PINK"), Member("Color", ""), Cast("Color", Lit("PINK")), Concat((Lit(1), Lit("x"))), Concat((Member("Color", "RED"), Lit("x")))):
        with pytest.raises(GraphError):
            g.values(bad)
    with pytest.raises(GraphError, match="expected JSON string or null; got JSON number"):
        g.values(Cast("Color", Cast("json", Lit(5))))
    with pytest.raises(GraphError, match=r"operator '\+\+'"):
        g.select("Movie", As("x", Concat((Ref("color"), Lit("!")))))


def test_shape_errors(movies):
    g, _ = movies
    for shape in (("nothing",), (), ("name", As("name", Lit(1))), (To("nothing"),)):
        with pytest.raises(GraphError):
            g.select(Select("Hero", shape))
    with pytest.raises(GraphError):
        g.select("Nothing")
    with pytest.raises(GraphError):
        g.select("Hero", where=field("name").eq(5))


def test_inserts_with_links(movies):
    g, ids = movies
    g.insert("Hero", {"name": "Thor", "villains": [Insert("Villain", {"name": "Loki"}), Select("Villain", where=field("name").eq("Venom"))]})
    got = rows(g.select("Hero", To("villains", ("name",), order_by="name"), where=field("name").eq("Thor")))
    assert [v["name"] for v in got[0]["villains"]] == ["Loki", "Venom"]
    before = g.select("Villain").count()
    with pytest.raises(GraphError, match="does not reference an existing object"):
        g.insert("Hero", {"name": "x", "villains": [Insert("Villain", {"name": "y"}), "0" * 32]})
    assert g.select("Villain").count() == before
    with pytest.raises(GraphError, match="expected 'default::Hero', got 'default::Villain'"):
        g.insert("Villain", {"name": "x", "nemesis_id": ids["ock"]})


def test_update_delete_conflict(movies):
    g, ids = movies
    assert g.update("Villain", {"rank": 9}, field("rank").eq(1) | field("rank").eq(2)).changes == 2
    assert g.update("Villain", {"rank": 9}, field("rank").eq(77)).changes == 0
    assert [r["rank"] for r in rows(g.select("Villain", "rank", order_by="name"))] == [9, 9, None]
    assert g.delete("Villain", field("rank").ne(9)).changes == 0
    assert g.delete("Villain", field("rank").eq(9)).changes == 2 and g.select("Villain").count() == 1
    assert g.insert("Movie", {"title": "Spider"}, Conflict("title")).changes == 0
    assert g.insert("Movie", {"title": "Spider", "year": 1}, Conflict("title", update={"year": 2003})).changes == 1
    assert rows(g.select("Movie", "year")) == [{"year": 2003}]
    assert g.insert("Movie", {"title": "Other"}, Conflict()).changes == 1
    assert g.for_each(combinations([("a", "b"), ("1", "2")]), lambda v: ("Hero", {"name": v})).changes == 4
    assert g.select("Hero", where=field("name").one_of("a1", "a2", "b1", "b2")).count() == 4


def test_changes_by_id(movies):
    g, ids = movies
    names = lambda p: sorted(r["name"] for r in rows(g.select("Villain", "name", where=p)))
    assert names(field("nemesis_id").eq(ids["spider"])) == ["Venom"] and names(field("nemesis_id").ne(ids["spider"])) == []
    assert rows(g.select("Villain", "nemesis_id", where=field("name").eq("Venom"))) == [{"nemesis_id": ids["spider"]}]
    assert g.update("Villain", {"rank": 5}, field("id").one_of(ids["green"], ids["ock"])).changes == 2
    assert g.delete("Villain", field("nemesis_id").eq(ids["spider"])).changes == 1 and names(None) == ["Doc Ock", "Green Goblin"]


def test_registered_tables_can_be_changed(spark):
    from weftline.sources.store import Binding

    catalog = Catalog.of(ObjectType("A", (Property("x", "int"),)), ObjectType("B", (Link("a", "A"),)))
    g = Graph(spark, catalog)
    g.register("A", Binding(spark.range(4), "id", {"x": "id"}))
    g.register("B", Binding(spark.range(4).selectExpr("id", "id % 2 as a"), "id", {}, {"a": "a"}))
    assert g.update("A", {"x": 9}, field("id").eq("A:1")).changes == 1 and g.delete("A", field("id").eq("A:3")).changes == 1
    assert sorted((r["id"], r["x"]) for r in rows(g.select("A", "id", "x"))) == [("A:0", 0), ("A:1", 9), ("A:2", 2)]
    assert sorted((r["id"], r["a"]["x"]) for r in rows(g.select("B", "id", To("a", ("x",))))) == [("B:0", 0), ("B:1", 9), ("B:2", 0), ("B:3", 9)]
    assert g.insert("B", {"a": "A:2"}).changes == 1 and g.delete("B", field("a_id").eq("A:2")).changes == 1
    assert sorted(r["id"] for r in rows(g.select("B", where=field("a_id").one_of("A:1", "A:7")))) == ["B:1", "B:3"]


def behaviours():
    return Catalog.of(
        ObjectType("Log", (Property("action", required=True), Property("name"), Property("change"))),
        ObjectType(
            "User",
            (Property("name", required=True), Property("active", "bool"), Property("stamp")),
            triggers=(
                Trigger("made", "insert", "Log", {"action": "insert", "name": new("name")}),
                Trigger("renamed", "update", "Log", {"action": "update", "name": old("name"), "change": new("name")}, "name"),
                Trigger("gone", "delete", "Log", {"action": "delete", "name": old("name")}),
            ),
            rewrites=(Rewrite("stamp", ("insert",), "i"), Rewrite("stamp", ("update",), old("name"))),
        ),
        ObjectType("Timed", (Property("at", "datetime"),), rewrites=(Rewrite("at", ("insert", "update"), Call("std::datetime_of_statement")),)),
    )


def test_triggers_and_rewrites(spark):
    g = Graph(spark, behaviours())
    g.insert("User", {"name": "ann"})
    g.insert("User", {"name": "bob"})
    g.update("User", {"name": "eve"}, field("name").eq("ann"))
    g.update("User", {"active": True})
    g.delete("User", field("name").eq("bob"))
    got = sorted((r["action"], r["name"], r["change"]) for r in rows(g.select("Log", "action", "name", "change")))
    assert got == [("delete", "bob", None), ("insert", "ann", None), ("insert", "bob", None), ("update", "ann", "eve")]
    assert rows(g.select("User", "name", "active", "stamp")) == [{"name": "eve", "active": True, "stamp": "eve"}]
    g.insert("Timed", {})
    assert rows(g.select("Timed", "at"))[0]["at"].endswith("Z")


def test_policies(spark):
    mine = lambda c: field("author_id").eq(c.get("user_id"))
    catalog = Catalog.of(
        ObjectType(
            "Post",
            (Property("title", required=True), Property("author_id", "uuid", required=True)),
            policies=(
                Policy("owner", "allow", ("all",), mine),
                Policy("readers", "allow", ("select",), lambda c: c.get("can_read")),
                Policy("no_x", "deny", ("select", "insert"), field("title").eq("x"), "x is not allowed"),
            ),
        ),
        ObjectType("Secret", (Property("payload"),), policies=(Policy("nobody", "deny", ("all",)),)),
        ObjectType("Note", (Property("text"), Link("post", "Post"))),
    )
    g = Graph(spark, catalog)
    for title, author in (("a", "u1"), ("b", "u2"), ("x", "u1")):
        g.insert("Post", {"title": title, "author_id": author})
    g.insert("Secret", {"payload": "p"})
    g.insert("Note", {"text": "n", "post": Select("Post", where=field("title").eq("b"))})
    who = lambda *more, **known: g.as_user(permissions=frozenset(["sys::perm::data_modification", *more]), globals=known)
    u1 = who(user_id="u1")
    assert [r["title"] for r in rows(u1.select("Post", "title", order_by="title"))] == ["a"]
    assert [r["title"] for r in rows(who("can_read", user_id="u1").select("Post", "title", order_by="title", limit=5))] == ["a", "b"]
    assert rows(u1.select("Note", "text", To("post", ("title",)))) == [{"text": "n", "post": None}]
    assert u1.select("Secret").count() == 0 and g.select("Secret").count() == 1
    assert u1.insert("Post", {"title": "c", "author_id": "u1"}).changes == 1
    with pytest.raises(GraphError, match="Access policy violation.*x is not allowed"):
        u1.insert("Post", {"title": "x", "author_id": "u1"})
    with pytest.raises(GraphError, match="Access policy violation"):
        u1.update("Post", {"author_id": "u2"}, field("title").eq("a"))
    with pytest.raises(GraphError, match="Access policy violation"):
        u1.delete("Post", field("title").eq("b"))
    with pytest.raises(GraphError, match="data_modification"):
        g.as_user(globals={"user_id": "u1"}).delete("Post")


def test_functions(spark):
    def add(graph, name):
        return graph.insert("User", {"name": name}).changes

    catalog = Catalog.of(
        ObjectType("User", (Property("name"),)),
        functions=(UserFunction("shout", ("word", "mark"), lambda w, m: Concat((w, m)), optional=("mark",)), UserFunction("add_user", ("name",), add, modifying=True)),
    )
    g = Graph(spark, catalog)
    assert rows(g.values(Call("shout", (Many(("a", "b")), Many(("!",)))))) == [{"value": "a!"}, {"value": "b"}]
    assert rows(g.values(Call("shout", (Lit("a"),)))) == [{"value": "a"}]
    g.free(n=Call("add_user", (Lit("ann"),)))
    assert rows(g.select("User", "name")) == [{"name": "ann"}]
    with pytest.raises(GraphError, match="possibly more than one element passed into modifying function"):
        g.free(n=Call("add_user", (Many(("a", "b")),)))
    with pytest.raises(GraphError, match="possibly an empty set"):
        g.free(n=Call("add_user", (Many(()),)))


def test_inheritance_rules():
    base = ObjectType("A", (Property("x"), Link("l", "A")), abstract=True)
    Catalog.of(base, ObjectType("B", (Property("x", required=True, overloaded=True), Link("l", "B", overloaded=True)), bases=("A",)))
    for member in (Property("x"), Property("y", overloaded=True), Property("x", "int", overloaded=True), Link("l", "C", overloaded=True)):
        with pytest.raises(GraphError):
            Catalog.of(base, ObjectType("B", (member,), bases=("A",)), ObjectType("C"))
    with pytest.raises(GraphError, match="base type"):
        Catalog.of(ObjectType("B", bases=("Missing",)))
    diamond = Catalog.of(base, ObjectType("B", bases=("A",)), ObjectType("C", bases=("A",)), ObjectType("D", bases=("B", "C")))
    assert diamond.lineage("default::D") == ["default::A", "default::B", "default::C", "default::D"] and diamond.concrete("default::A") == ["default::B", "default::C", "default::D"]


def test_link_storage_may_differ_between_subtypes(spark):
    catalog = Catalog.of(
        ObjectType("C", (Property("val"),)),
        ObjectType("D", (Property("num", "int"), Link("one", "C"))),
        ObjectType("E", (Link("one", "C", props=(Property("lp"),), overloaded=True),), bases=("D",)),
    )
    g = Graph(spark, catalog)
    c1, c2 = (g.insert("C", {"val": v}).id for v in "xy")
    g.insert("D", {"num": 1, "one": c1})
    g.insert("E", {"num": 2, "one": c2})
    g.insert("E", {"num": 3})
    got = rows(g.select("D", "num", To("one", ("val",)), order_by="num"))
    assert got == [{"num": 1, "one": {"val": "x"}}, {"num": 2, "one": {"val": "y"}}, {"num": 3, "one": None}]


def test_computeds(spark):
    catalog = Catalog.of(
        ObjectType("Person", (Property("first"), Property("last"), Property("active", "bool"), Computed("full", Concat((Ref("first"), Lit(" "), Ref("last")))), Computed("clubs", Back("members", "Club")))),
        ObjectType("Club", (Property("name"), Link("members", "Person", multi=True), Computed("active", To("members", where=field("active").eq(True))))),
    )
    g = Graph(spark, catalog)
    a, b = g.insert("Person", {"first": "A", "last": "B", "active": True}).id, g.insert("Person", {"first": "C"}).id
    g.insert("Club", {"name": "club", "members": [a, b]})
    assert [r["full"] for r in rows(g.select("Person", "full", order_by="first"))] == ["A B", "C "]
    assert rows(g.select("Club", "active")) == [{"active": [{"id": a}]}]
    assert len(rows(g.select("Person", "clubs", where=field("id").eq(a)))[0]["clubs"]) == 1


def test_modules_and_parameters(spark):
    g = Graph(spark, Catalog.of(ObjectType("User", (Property("a"),)), ObjectType("analytics::User", (Property("b"),))))
    g.insert("analytics::User", {"b": "x"})
    assert g.in_module("analytics").select("User", "b").count() == 1 and g.select("User", "a").count() == 0
    assert g.catalog.resolve("m::User", aliases={"m": "analytics"}) == "analytics::User"
    assert parameter("local_date", "d", {"d": "2024-02-03"}) == "2024-02-03"
    for kind, value in (("local_date", "3 Feb"), ("int64", "5"), ("bool", 1), ("uuid", "x"), ("datetime", "2024-02-03T00:00:00")):
        with pytest.raises(GraphError, match=r"Cannot cast \$d to"):
            parameter(kind, "d", {"d": value})


def test_migrations(spark):
    first = Catalog.of(ObjectType("A", (Property("x"), Property("y", "int"))), ObjectType("Old"))
    second = Catalog.of(ObjectType("A", (Property("x"), Property("y"), Property("z", "int", required=True), Link("to", "B", multi=True))), ObjectType("B"))
    g = Graph(spark, first)
    g.insert("A", {"x": "v", "y": 1})
    assert [str(s) for s in migrate.plan(first, second)] == ["drop property default::A.y", "add link default::A.to", "add property default::A.y", "add property default::A.z", "create type default::B", "drop type default::Old"]
    session = migrate.Session(g)
    session.populate(second, "two")
    session.savepoint("s")
    session.reset_to_initial()
    session.rollback_to("s")
    assert session.describe()["description"] == "two" and session.commit("m1")
    with pytest.raises(GraphError):
        session.commit("m1")
    assert rows(g.select("A", "x", "y", "z", "to")) == [{"x": "v", "y": None, "z": 0, "to": []}]
    assert migrate.apply(g, second, "m1") is False
    with pytest.raises(GraphError, match="Migration checksum mismatch"):
        migrate.apply(g, first, "m1")


def test_introspection(spark):
    catalog = Catalog.of(ObjectType("A", (Property("x", annotations={"title": "X"}),), annotations={"title": "t"}), ObjectType("B", (Link("l", "A", props=(Property("p"),)),), bases=("A",)))
    got = {r["name"]: r for r in rows(Graph(spark, catalog).object_types())}
    assert got["default::B"]["annotations"] == [{"name": "title", "value": "t"}] and got["default::B"]["links"][0]["properties"] == [{"name": "p", "type": "str"}]
    own = {p["name"]: p for p in got["default::A"]["properties"]}
    assert list(own) == ["id", "x"] and own["id"]["constraints"][0]["name"] == "std::exclusive"
    assert own["x"]["annotations"] == [{"name": "title", "value": "X"}]


def test_stream_inserts(spark, tmp_path):
    
    g = Graph(spark, behaviours())
    spark.createDataFrame([("ann",), ("bob",)], "name string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("name string").parquet(str(tmp_path / "in"))
    query = stream_inserts(g, "User", stream, str(tmp_path / "batches"), str(tmp_path / "checkpoint"))
    query.processAllAvailable()
    query.stop()
    assert sorted(r["name"] for r in rows(g.select("User", "name"))) == ["ann", "bob"] and g.select("Log").count() == 2


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 6)), max_size=15, unique=True), st.integers(0, 2), st.integers(1, 3))
def test_link_lowering_against_loops(spark, links, offset, limit):
    from weftline.sources.store import Binding, LinkTable

    catalog = Catalog.of(ObjectType("P", (Property("n", "int"), Link("cs", "C", multi=True))), ObjectType("C", (Property("v", "int"),)))
    g = Graph(spark, catalog)
    table = spark.createDataFrame(links, "p long, c long")
    g.register("P", Binding(spark.range(5), "id", {"n": "id"}, {"cs": LinkTable(table, "p", "c")}))
    g.register("C", Binding(spark.range(7).selectExpr("id", "id % 3 as v"), "id", {"v": "v"}))
    got = {r["n"]: [c["id"] for c in r["cs"]] for r in rows(g.select("P", "n", To("cs", order_by="v", desc=True, offset=offset, limit=limit)))}
    for p in range(5):
        mine = sorted((-(c % 3), f"C:{c}") for q, c in links if q == p)
        assert got[p] == [c for _, c in mine[offset : offset + limit]]


def test_constraints_and_computeds_are_described(spark):
    low = Constraint("std::min_value", {"title": "not below zero"})
    catalog = Catalog.of(
        ObjectType("A", (Property("n", "int", constraints=(low,)), Computed("loud", Concat((Ref("n"), Lit("!")))), Computed("of", Back("a", "B")))),
        ObjectType("B", (Link("a", "A"), Computed("first", To("a", limit=1)))),
    )
    got = {r["name"]: r for r in rows(Graph(spark, catalog).object_types())}
    props = {p["name"]: p for p in got["default::A"]["properties"]}
    assert props["n"]["constraints"] == [{"name": "std::min_value", "annotations": [{"name": "title", "value": "not below zero"}]}]
    assert props["loud"]["computed"] and props["loud"]["type"] is None and not props["n"]["computed"]
    assert [(k["name"], k["target"], k["computed"]) for k in got["default::A"]["links"]] == [("of", "B", True)]
    assert [(k["name"], k["target"], k["computed"]) for k in got["default::B"]["links"]] == [("a", "A", False), ("first", "A", True)]


def test_many_updates_keep_one_scan(spark):
    g = Graph(spark, movie_catalog())
    g.insert("Villain", {"name": "a", "rank": 0})
    scans = []
    for k in range(20):
        assert g.update("Villain", {"rank": k + 1}, field("rank").eq(k)).changes == 1
        plan = g.select("Villain", "rank")._jdf.queryExecution().optimizedPlan().toString()
        scans.append(plan.count("LogicalRDD") + plan.count("LocalRelation") + plan.count("Relation ["))
    assert rows(g.select("Villain", "name", "rank")) == [{"name": "a", "rank": 20}] and set(scans) <= {1, 2}


def test_update_sees_old_values(spark):
    rewrite = Rewrite("note", ("update",), old("name"))
    catalog = Catalog.of(
        ObjectType("User", (Property("name"), Property("note")), rewrites=(rewrite,), triggers=(Trigger("t", "update", "Log", {"was": old("name"), "is": new("note")}, "name"),)),
        ObjectType("Log", (Property("was"), Property("is"))),
    )
    g = Graph(spark, catalog)
    for n in ("a", "b", None):
        g.insert("User", {"name": n})
    assert g.update("User", {"name": "z"}, field("name").eq("a")).changes == 1
    assert sorted(rows(g.select("User", "name", "note")), key=str) == sorted([{"name": "z", "note": "a"}, {"name": "b", "note": None}, {"name": None, "note": None}], key=str)
    assert rows(g.select("Log", "was", "is")) == [{"was": "a", "is": "a"}]


def test_a_folder_outlives_its_session(spark, tmp_path):
    folder = str(tmp_path / "graph")
    g = Graph(spark, movie_catalog(), folder=folder)
    green = g.insert("Villain", {"name": "Green Goblin", "rank": 1}).id
    spider = g.insert("Hero", {"name": "Spider-Man", "villains": [green]}).id
    g.insert("Villain", {"name": "Venom", "nemesis": spider})
    after = g.catalog.with_types(ObjectType("Villain", (*g.catalog.type("Villain").members, Property("age", "int", required=True)), bases=("Person",)))
    assert migrate.apply(g, after, "m1")
    g.update("Villain", {"rank": 7}, field("name").eq("Green Goblin"))
    again = Graph(spark, after, folder=folder)
    assert rows(again.select("Hero", "name", To("villains", ("name", "rank", "age")))) == [{"name": "Spider-Man", "villains": [{"name": "Green Goblin", "rank": 7, "age": 0}]}]
    assert rows(again.select("Villain", "name", To("nemesis", ("name",)), where=field("name").eq("Venom"))) == [{"name": "Venom", "nemesis": {"name": "Spider-Man"}}]
    assert again.history == g.history and not migrate.apply(again, after, "m1")
    again.delete("Villain", field("name").eq("Venom"))
    with pytest.raises(Exception, match="[Ee]xist"):
        g.insert("Hero", {"name": "too late"})
    third = Graph(spark, after, folder=folder)
    third.kept.vacuum()
    assert sorted(r["name"] for r in rows(third.select("Person", "name"))) == ["Green Goblin", "Spider-Man"]


def test_only_what_changes_is_written(spark, tmp_path):
    g = Graph(spark, movie_catalog(), folder=str(tmp_path))
    g.insert("Hero", {"name": "a"})
    one = set((tmp_path / "tables").iterdir())
    g.insert("Villain", {"name": "b"})
    assert {t.name for t in one} < {t.name for t in (tmp_path / "tables").iterdir()}
    assert g.kept.versions() == [1, 2] and len(set((tmp_path / "tables").iterdir())) - len(one) == 1


def test_ids_of_sessions_differ(spark, tmp_path):
    ids = set()
    for user in (False, True):
        g = Graph(spark, movie_catalog())
        g = g.as_user(permissions=frozenset({"sys::perm::data_modification"})) if user else g
        g.insert_rows("Hero", spark.createDataFrame([("a",), ("b",)], "name string"))
        ids |= {r["id"] for r in rows(g.select("Hero"))}
    assert len(ids) == 4


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    folder, source = str(tmp_path / "graph"), tmp_path / "in"
    for n in (1, 2):
        spark.createDataFrame([(f"hero {n}",)], "name string").write.parquet(str(source / f"part={n}"))
        g = Graph(spark, movie_catalog(), folder=folder)
        stream = spark.readStream.schema("name string").option("recursiveFileLookup", "true").parquet(str(source))
        query = stream_inserts(g, "Hero", stream, str(tmp_path / "batches"), str(tmp_path / "checkpoint"))
        query.processAllAvailable()
        query.stop()
    assert sorted(r["name"] for r in rows(Graph(spark, movie_catalog(), folder=folder).select("Hero", "name"))) == ["hero 1", "hero 2"]
    assert list(g.batches.values()) == [1]


def test_function_arguments(spark):
    def shown(g, name, rank):
        return Select("Villain", ("name",), where=field("name").eq(name) if rank is None else field("rank").eq(rank), order_by="name")

    def add(g, name, alias):
        g.insert("Hero", {"name": name, "secret_identity": alias})
        return name

    catalog = movie_catalog()
    functions = (
        UserFunction("shown", ("name", "rank"), shown, query=True, optional=("rank",)),
        UserFunction("add", ("name", "alias"), add, modifying=True, optional=("alias",)),
        UserFunction("join", ("a", "b", "sep"), lambda a, b, sep: Concat((a, sep, b)), named=("sep",), defaults={"b": Lit("?"), "sep": Lit("-")}),
    )
    g = Graph(spark, Catalog.of(*catalog.types.values(), enums=catalog.enums, functions=functions))
    for k, n in enumerate("abb"):
        g.insert("Villain", {"name": n, "rank": k})
    one = lambda *a, **named: rows(g.free(v=Call("join", tuple(map(Lit, a)), {k: Lit(v) for k, v in named.items()})))[0]["v"]
    assert (one("x"), one("x", "y"), one("x", sep="+"), one("x", "y", sep="")) == ("x-?", "x-y", "x+?", "xy")
    for wrong in (lambda: one(), lambda: one("x", "y", "z"), lambda: one("x", a="y"), lambda: one("x", other="y")):
        with pytest.raises(GraphError, match="does not exist|no such parameters"):
            wrong()
    assert rows(g.free(v=Call("shown", (Lit("b"),))))[0]["v"] == [{"name": "b"}, {"name": "b"}]
    assert rows(g.free(v=Call("shown", (Lit("b"), Lit(0)))))[0]["v"] == [{"name": "a"}]
    g.free(v=Call("add", (Lit("h"), Many(()))))
    assert rows(g.select("Hero", "name", "secret_identity")) == [{"name": "h", "secret_identity": None}]
    with pytest.raises(GraphError, match="possibly an empty set passed as non-optional argument into modifying function"):
        g.free(v=Call("add", (Many(()),)))


def test_subqueries_are_bounded(movies, monkeypatch):
    movies, _ = movies
    from weftline.plans import shape

    monkeypatch.setattr(shape, "MOST_GATHERED", 2)
    with pytest.raises(Exception, match="give it a limit"):
        movies.free(all=Select("Person", ("name",))).collect()
    assert len(rows(movies.free(all=Select("Person", ("name",), order_by="name", limit=2)))[0]["all"]) == 2


def test_counts_and_limits_of_backlinks(movies):
    movies, _ = movies
    got = {r["name"]: r for r in rows(movies.select("Person", "name", As("n", Back("characters", count=True)), As("some", Back("villains", "Hero", limit=1))))}
    listed = {r["name"]: r["all"] for r in rows(movies.select("Person", "name", As("all", Back("characters"))))}
    assert {k: r["n"] for k, r in got.items()} == {k: len(v) for k, v in listed.items()} and any(listed.values())
    assert all(len(r["some"]) <= 1 for r in got.values()) and got["Green Goblin"]["some"] and not got["Iron Man"]["some"]


def test_link_values_of_a_query_are_checked(movies):
    movies, _ = movies
    with pytest.raises(GraphError, match="does not reference an existing object"):
        movies.insert("Hero", {"name": "x", "villains": [Select("Villain"), "nobody"]})
    movies.insert("Hero", {"name": "x", "villains": [Select("Villain"), Select("Villain")]})
    found = rows(movies.select("Hero", To("villains", ("name",)), where=field("name").eq("x")))[0]["villains"]
    assert sorted(v["name"] for v in found) == ["Doc Ock", "Green Goblin", "Venom"]
