"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

A budget of tokens goes down a tree domain - language - source. At each node it is shared among the children by weight;
what a child cannot take, because its documents end after ``max_epochs`` passes, goes to its siblings by weight, and
only what all of them cannot take is the ancestors' to share. Each leaf then takes whole passes over its documents and
a prefix, in tokens, of one more pass in an order seeded by the pass.

The prefix is found without sorting a leaf in one task: a leaf's order is cut into buckets of about 256 documents and
runs of 4,096 buckets. Sums of runs give the run where the prefix ends, sums of its buckets the bucket, and only that
bucket is put in order.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.scratch import Scratch, spare_prefix

#: Production weights (whole numbers, 0 for nothing); a child that is not named has weight 1.
WEIGHTS = {"domain": {"web": 5, "books": 3, "code": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {}}
#: The budget, in hundredths of the corpus's tokens.
BUDGET_PERCENT = 60
MAX_EPOCHS = 2
SEED = 7
BUCKET_DOCS = 256
#: Buckets are summed in runs of two to this power: a leaf of a billion documents has about 1,000 runs of 4,096 buckets.
RUN_BITS = 12
LEVELS = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    """The production rule: by the number at the end of the source's name (none: 0), modulo 3."""
    number = F.coalesce(F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("long"), F.lit(0))
    return F.element_at(F.array(F.lit("web"), F.lit("books"), F.lit("code")), (number % 3 + 1).cast("int"))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", source_col="source", weights: Mapping = WEIGHTS, budget_percent=BUDGET_PERCENT, max_epochs=MAX_EPOCHS, seed=SEED) -> DataFrame:
    """The rows of ``docs`` that are taken, each with all its columns and a long column ``copies`` (how often; 1 or more).

    Tokens are runs of characters other than space and \\x09-\\x0D. Null languages and sources count as empty strings,
    null texts have no tokens. The order of a pass is by md5 of seed, pass and id; rows with one id are taken together.
    Shares are rounded down to whole tokens, so the mix may fall short of the budget by a few tokens a leaf; so may a
    prefix, as documents are taken whole. An empty table gives an empty result. A column ``copies`` of ``docs`` is
    replaced; other columns may have any name.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    own = {
        "domain": domain_of(F.col(source_col)),
        "lang": F.coalesce(lang_col, F.lit("")),
        "source": F.coalesce(source_col, F.lit("")),
        "id": F.coalesce(F.col(id_col).cast("string"), F.lit("")),
    }
    tokens = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    slim = scratch.put(docs.select(*[v.alias(k) for k, v in own.items()], tokens.alias("tokens")), "slim")
    leaves = scratch.put(slim.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "leaves")
    plan = scratch.put(share_budget(leaves, weights, budget_percent, max_epochs), "plan")
    cuts = scratch.put(plan.join(prefix_ends(scratch, slim, plan, seed), [*LEVELS], "left"), "cuts")
    kept = [c for c in docs.columns if c.lower() != "copies"]
    p = spare_prefix(kept)
    cuts = cuts.toDF(*[f"{p}cut_{c}" for c in cuts.columns])
    rows = docs.select(*kept).withColumns({p + k: v for k, v in own.items()})
    rows = rows.join(cuts, [F.col(p + c) == F.col(f"{p}cut_{c}") for c in LEVELS])
    passes, end = F.col(f"{p}cut_passes"), F.col(f"{p}cut_end_bucket")
    key = _key(seed, passes, F.col(f"{p}id"))
    bucket = _bucket(key, F.col(f"{p}cut_docs"))
    taken = (bucket < end) | ((bucket == end) & (key <= F.col(f"{p}cut_end_key")))
    copies = passes + F.coalesce(taken, F.lit(False)).cast("long")
    return rows.select(*kept, copies.alias("copies")).where("copies > 0")


def _key(seed: int, epoch: Column, doc: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), doc))


def _bucket(key: Column, docs: Column) -> Column:
    """Buckets in the order of the keys, about ``docs`` / 256 of them."""
    place = F.conv(F.substring(key, 1, 7), 16, 10).cast("long")
    return F.shiftright(place * F.greatest(F.lit(1), F.floor(docs / BUCKET_DOCS)), 28)


def share_budget(leaves: DataFrame, weights: Mapping, budget_percent: int, max_epochs: int) -> DataFrame:
    """The leaves with ``tokens`` of supply, whole ``passes`` and the tokens ``rest`` of the pass after them."""
    plan = leaves.withColumns({f"w_{level}": _weight(weights, level) for level in LEVELS})
    open_path = F.least(*[F.col(f"w_{level}") for level in LEVELS]) > 0
    plan = plan.withColumn("cap", F.when(open_path, F.col("tokens") * max_epochs).otherwise(0))
    total = leaves.agg(F.sum("tokens").alias("total"))  # one row
    plan = plan.crossJoin(F.broadcast(total)).withColumn("share", F.expr(f"total * {budget_percent} div 100")).drop("total")
    for depth, level in enumerate(LEVELS):
        parent, path = LEVELS[:depth], LEVELS[: depth + 1]
        child = plan.groupBy(*path).agg(F.sum("cap").alias("cap"), F.first("share").alias("budget"), F.first(f"w_{level}").alias("w"))
        filling = Window.partitionBy(*parent).orderBy(F.try_divide("cap", "w"), level)
        whole = Window.partitionBy(*parent)
        child = child.withColumns(
            {
                "before": F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
                "after": F.sum("w").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
            }
        )
        child = child.withColumn("full", F.expr("cap * after <= w * (budget - before)"))
        child = child.withColumns({"gone": F.sum(F.expr("if(full, cap, 0)")).over(whole), "open": F.sum(F.expr("if(full, 0, w)")).over(whole)})
        child = child.select(*path, F.expr("if(full, cap, w * (budget - gone) div open)").alias("share"))
        plan = plan.drop("share").join(child, [*path])
    passes = F.expr("if(tokens = 0, 0, share div tokens)")
    return plan.withColumn("passes", passes).select(*LEVELS, "tokens", "docs", "passes", F.expr("share - passes * tokens").alias("rest"))


def _weight(weights: Mapping, level: str) -> Column:
    named = F.create_map(*[F.lit(x) for kv in (weights.get(level) or {"": 1}).items() for x in kv])
    return F.coalesce(F.try_element_at(named, F.col(level)), F.lit(1)).cast("long")


def prefix_ends(scratch: Scratch, slim: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """For each leaf the bucket and the key of the last document of its prefix; no row where the rest is 0."""
    keyed = slim.join(plan.where("rest > 0").select(*LEVELS, "docs", "passes", "rest"), [*LEVELS])
    keyed = keyed.withColumn("key", _key(seed, F.col("passes"), F.col("id"))).withColumn("bucket", _bucket(F.col("key"), F.col("docs")))
    sums = scratch.put(keyed.groupBy(*LEVELS, "rest", "bucket").agg(F.sum("tokens").alias("held")), "sums")
    sums = sums.withColumn("run", F.shiftright("bucket", RUN_BITS))
    runs = _crossings(sums.groupBy(*LEVELS, "rest", "run").agg(F.sum("held").alias("held")).withColumn("before", F.lit(0)), "run")
    ends = _crossings(sums.join(runs, [*LEVELS, "run"]), "bucket")
    inside = keyed.join(ends, [*LEVELS, "bucket"]).groupBy(*LEVELS, "bucket", "rest", "before", "key").agg(F.sum("tokens").alias("tokens"))
    order = Window.partitionBy(*LEVELS, "bucket").orderBy("key")
    fits = inside.withColumn("upto", F.col("before") + F.sum("tokens").over(order)).where("upto <= rest")
    last = fits.groupBy(*LEVELS).agg(F.max("key").alias("end_key"))
    return ends.join(last, [*LEVELS], "left").select(*LEVELS, F.col("bucket").alias("end_bucket"), F.coalesce("end_key", F.lit("")).alias("end_key"))


def _crossings(sums: DataFrame, place: str) -> DataFrame:
    """Of each leaf the first ``place`` at which the tokens ``held`` go beyond the rest, and those ``before`` it."""
    upto = F.col("before") + F.sum("held").over(Window.partitionBy(*LEVELS).orderBy(place))
    beyond = sums.withColumn("upto", upto).where("upto > rest").withColumn("before", F.col("upto") - F.col("held"))
    first = beyond.groupBy(*LEVELS).agg(F.min_by(F.struct(place, "before"), place).alias("end"))
    return first.select(*LEVELS, f"end.{place}", "end.before")


#: The same in DuckDB: documents taken, and how often.
_CHILD = """{name} as (
  select *, case when full_ then cap else w * (budget - gone) // open_ end as share from (
    select *, sum(case when full_ then cap else 0 end) over (partition by {parent}) as gone,
      sum(case when full_ then 0 else w end) over (partition by {parent}) as open_ from (
      select *, cap * after_ <= w * (budget - before_) as full_ from (
        select *, coalesce(sum(cap) over (partition by {parent} order by cap / w, {level} rows between unbounded preceding and 1 preceding), 0) as before_,
          sum(w) over (partition by {parent} order by cap / w, {level} rows between current row and unbounded following) as after_
        from ({rows})))))"""


def mix_sql() -> str:
    weight = lambda level: "case " + level + "".join(f" when '{k}' then {v}" for k, v in WEIGHTS[level].items()) + " else 1 end" if WEIGHTS[level] else "1"
    steps, above = [], "(select 1 as root, sum(tokens)::bigint * %d // 100 as share from slim)" % BUDGET_PERCENT
    for depth, level in enumerate(LEVELS):
        path, parent = ", ".join(LEVELS[: depth + 1]), ", ".join(LEVELS[:depth]) or "root"
        join = f"using ({parent})" if depth else "on true"
        rows = f"select c.*, {weight(level)} as w, p.share as budget" + ("" if depth else ", root") + f" from (select {path}, (sum(tokens) * {MAX_EPOCHS})::bigint as cap from slim group by all) c join {above} p {join}"
        steps.append(_CHILD.format(name=f"by_{level}", parent=parent, level=level, rows=rows))
        above = f"(select {path}, share from by_{level})"
    return f"""
with slim as (
  select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as tokens,
    ['web', 'books', 'code'][coalesce(try_cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) as bigint), 0) % 3 + 1] as domain
  from documents),
{", ".join(steps)},
plan as (
  select s.*, share, case when supply = 0 then 0 else (share // supply)::bigint end as passes
  from (select *, sum(tokens) over (partition by domain, lang, source)::bigint as supply from slim) s join by_source using (domain, lang, source)),
keyed as (select *, share - passes * supply as rest, md5(concat_ws(':', '{SEED}', passes::varchar, coalesce(doc_id::varchar, ''))) as key from plan),
taken as (
  select *, passes + (rest > 0 and sum(tokens) over (partition by domain, lang, source order by key range between unbounded preceding and current row) <= rest)::bigint as copies
  from keyed)
select doc_id, domain, lang, source, tokens::bigint as tokens, copies::bigint as copies from taken where copies > 0"""


def mix_report(docs: DataFrame) -> DataFrame:
    """The documents taken: id, leaf, tokens and copies."""
    tokens = F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return mix(docs).select("doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source", tokens.alias("tokens"), "copies")
