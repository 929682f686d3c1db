"""Secret scans with multipart credential linking, in DataFrame functions only.

Base spans (assign, access, hex) stand by themselves. Weak candidates (an identifier, a blob that may be a secret, an
endpoint) mean little alone; an interval join within a document reports them only where the complementary parts of a
credential lie within ``SCOPE`` code points.

A match's position is the sum of the lengths of all gaps and matches before it. Gaps and matches come from one pass of
the pattern each; the sums run over blocks of matches, so a text's cost grows with its length and its matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.scratch import Scratch

#: Code points between two parts of one credential, at most.
SCOPE = 200
#: Matches whose positions are summed up together.
BLOCK = 512

#: Fixed patterns, by kind in the order in which spans at one place are listed.
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
    "ident": r"""(?:client|account|access_key|user)_?id["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}""",
    "blob": r"[A-Za-z0-9+/_-]{24,}",
    "endpoint": r"(?:https?|wss?|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:@/-]+",
}
BASE = ("assign", "access", "hex")
#: A weak candidate of this kind is reported where all of these roles lie within the scope.
NEEDS = {"ident": ("secret",), "blob": ("identifier",), "endpoint": ("identifier", "secret")}
#: The role that a part of this kind plays for others.
ROLES = {"assign": "secret", "hex": "secret", "blob": "secret", "access": "identifier", "ident": "identifier"}

_SPAN = "array<struct<start:int,rank:int,stop:int,kind:string>>"
_FOUND = "array<struct<start:int,rank:int,stop:int,kind:string,piece:string>>"


def steps_of(text: str, kind: str, matches: str) -> Column:
    """For each string that the kind's pattern matches, in order: the code points since the match before, and the string."""
    gaps = F.slice(F.split(text, PATTERNS[kind], -1), 1, F.size(matches))
    steps = F.zip_with(gaps, matches, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("piece")))
    return F.when(F.size(matches) > 0, steps)


def spans_of(kind: str, steps: str) -> Column:
    """The spans of one kind: start, rank of the kind, end (exclusive), kind; in code points.

    Every match moves the ones after it; those that fail the kind's own condition are dropped last. ``steps`` is a
    column that the plan keeps apart, as it is named twice: it must not be made again for every block.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK)), lambda k: F.slice(steps, (k * BLOCK + 1).cast("int"), BLOCK))
    sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda at, x: at + x["gap"] + F.length(x["piece"])))
    running = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    befores = F.aggregate(sums, running, lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])
    rank, none = list(PATTERNS).index(kind), f"cast(array() as {_FOUND})"

    def placed(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        stop = start + F.length(x["piece"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"), F.lit(kind).alias("kind"), x["piece"].alias("piece"))
        return F.struct(stop.alias("at"), F.array_append(a["out"], span).alias("out"))

    found = F.flatten(F.zip_with(blocks, befores, lambda block, before: F.aggregate(block, F.struct(before.alias("at"), F.expr(none).alias("out")), placed, lambda a: a["out"])))
    if kind == "assign":
        found = F.filter(found, lambda s: F.length(F.regexp_extract(s["piece"], PATTERNS[kind], 2)) >= 12)
    if kind == "blob":
        found = F.filter(found, lambda s: s["piece"].rlike("[0-9]") & s["piece"].rlike("[A-Za-z]"))
    spans = F.transform(found, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "rank", "stop", "kind")]))
    return F.when(F.col(steps).isNotNull(), spans).otherwise(F.expr(f"cast(array() as {_SPAN})"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then by kind as listed, comma-joined."""
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, base, linked``, two arrays of (start, rank, stop, kind) in code points.

    Null and empty texts have no spans. Ids may be null or repeated: each row is scanned by itself. A blob that
    overlaps a span of another kind is a part of that one and no candidate. Two parts are in one scope when they do not
    overlap and at most ``scope`` code points lie between them. An empty table gives an empty result; other columns of
    ``docs`` are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    found = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = found.select("*", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"{k}_found") for k, p in PATTERNS.items()])
    found = found.select("doc_id", *[steps_of("text", k, f"{k}_found").alias(f"{k}_steps") for k in PATTERNS])
    found = found.select("doc_id", *[spans_of(k, f"{k}_steps").alias(k) for k in PATTERNS])
    parts = scratch.put(
        found.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.concat(*BASE).alias("base"), F.concat(*NEEDS).alias("weak")), "parts"
    )
    linked = link_parts(parts, scope)
    return parts.join(linked, "uid", "left").select(
        "doc_id", "base", F.coalesce("linked", F.expr(f"cast(array() as {_SPAN})")).alias("linked")
    )


def link_parts(parts: DataFrame, scope: int) -> DataFrame:
    """Rows (uid, linked) for the rows of ``parts`` with weak candidates whose complements are in scope.

    An interval join: both sides fall into bins of ``scope`` code points, a candidate also into those that its scope
    reaches. A bin holds few parts, as a part has some characters; an existence join makes no pairs.
    """
    rows = parts.where(F.size("weak") > 0)
    span = F.col("s")
    spans = without_covered_blobs(rows.select("uid", F.explode(F.concat("base", "weak")).alias("s")))
    role = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    bins = lambda reach: F.explode(
        F.sequence(F.floor((span["start"] - reach) / scope), F.floor((span["stop"] + reach) / scope))
    )
    others = (
        spans.select("uid", "s", role[span["kind"]].alias("role"))
        .where("role is not null")
        .select("uid", bins(0).alias("bin"), "role", span["start"].alias("o_start"), span["stop"].alias("o_stop"))
    )
    needs = F.create_map(*[x for k, v in NEEDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    wanted = (
        spans.where(span["kind"].isin(*NEEDS))
        .select("uid", "s", F.explode(needs[span["kind"]]).alias("role"), F.size(needs[span["kind"]]).alias("roles"))
        .select("uid", "s", "role", "roles", bins(scope).alias("bin"))
    )
    before, after = f"o_stop between w.s.start - {scope} and w.s.start", f"o_start between w.s.stop and w.s.stop + {scope}"
    met = wanted.alias("w").join(others.alias("o"), F.expr(f"w.uid = o.uid and w.bin = o.bin and w.role = o.role and ({before} or {after})"), "left_semi")
    whole = met.groupBy("uid", "s").agg(F.size(F.collect_set("role")).alias("met"), F.max("roles").alias("roles")).where("met = roles")
    return whole.groupBy("uid").agg(F.collect_list("s").alias("linked"))


def without_covered_blobs(spans: DataFrame) -> DataFrame:
    """The rows (uid, s) without the blobs that overlap a span of another kind of their text."""
    cover = F.col("s.kind") != "blob"
    reached = Window.partitionBy("uid").orderBy("s.start").rangeBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("uid").orderBy(F.desc("s.start")).rangeBetween(Window.unboundedPreceding, 0)
    spans = spans.withColumns({"reached": F.max(F.when(cover, F.col("s.stop"))).over(reached), "ahead": F.min(F.when(cover, F.col("s.start"))).over(ahead)})
    inside = F.coalesce(F.col("reached") > F.col("s.start"), F.lit(False)) | F.coalesce(F.col("ahead") < F.col("s.stop"), F.lit(False))
    return spans.where(cover | ~inside).select("uid", "s")


def secret_report(docs: DataFrame) -> DataFrame:
    """The digest of ``scan_secrets``: counts by base kind, the hash of the base spans, and all spans as text."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scan_secrets(docs).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", "linked")).alias("spans"),
        F.size("linked").cast("long").alias("n_linked"),
    )


def secret_sql() -> str:
    """The same in DuckDB, for ids that don't repeat."""
    found = " union all ".join(
        f"select doc_id, '{kind}' as kind, {rank} as rank, unnest(string_split_regex(body, '{p}')) as gap, "
        f"unnest(list_append(regexp_extract_all(body, '{p}'), null)) as piece, generate_subscripts(string_split_regex(body, '{p}'), 1) as nth from rows"
        for rank, (kind, p) in enumerate((k, p.replace("'", "''")) for k, p in PATTERNS.items())
    )
    assign = PATTERNS["assign"].replace("'", "''")
    role = "case kind " + " ".join(f"when '{k}' then '{v}'" for k, v in ROLES.items()) + " end"
    needs = ", ".join(f"('{k}', '{r}', {len(v)})" for k, v in NEEDS.items() for r in v)
    base = ", ".join(f"'{k}'" for k in BASE)
    listed = "coalesce(string_agg(concat_ws(':', kind, start, stop), ',' order by start, rank){}, '')"
    return f"""
with rows as (select doc_id, coalesce(text, '') as body from documents),
found as ({found}),
placed as (
  select *, sum(length(gap) + coalesce(length(piece), 0)) over (partition by doc_id, kind order by nth) as stop from found),
spans as (
  select doc_id, kind, rank, (stop - length(piece))::int as start, stop::int as stop from placed
  where piece is not null and (kind != 'assign' or length(regexp_extract(piece, '{assign}', 2)) >= 12)
    and (kind != 'blob' or (regexp_matches(piece, '[0-9]') and regexp_matches(piece, '[A-Za-z]')))),
clear as (
  select * from spans s where kind != 'blob'
    or not exists (select 1 from spans o where o.doc_id = s.doc_id and o.kind != 'blob' and o.start < s.stop and s.start < o.stop)),
needs(kind, role, roles) as (values {needs}),
met as (
  select s.doc_id, s.kind, s.rank, s.start, s.stop from clear s join needs n on s.kind = n.kind
    join (select *, {role} as role from clear) o on o.doc_id = s.doc_id and o.role = n.role
      and (o.stop between s.start - {SCOPE} and s.start or o.start between s.stop and s.stop + {SCOPE})
  group by s.doc_id, s.kind, s.rank, s.start, s.stop, n.roles having count(distinct n.role) = n.roles),
reported as (
  select doc_id, kind, rank, start, stop, false as weak from clear where kind in ({base}) union all select *, true from met)
select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  sha256({listed.format(" filter (not weak)")}) as base_sha256, {listed.format("")} as spans, count(*) filter (weak) as n_linked
from rows left join reported using (doc_id) group by doc_id"""
