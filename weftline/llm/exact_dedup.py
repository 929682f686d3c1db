"""Exact dedup by distributed MSD radix partitioning.

Documents are split by successive digits of their bytes, most significant first, until a group is a singleton or its
texts have ended. A digit is a run of bytes; runs get longer from level to level, so the number of levels grows with
the logarithm of the longest repeated text. Texts are equal because all their digits are; no digest decides anything.

Only members of groups of two or more go on to the next level, with the bytes that they have left. Counts are combined
before the shuffle, and the join that relabels rows meets a written table with one row a group, so that adaptive
execution can split a hot group's rows over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.scratch import Scratch, lower_ascii

FIRST_DIGIT_BYTES = 256
DIGIT_GROWTH = 16
MOST_DIGIT_BYTES = 4 << 20


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z only. Of equal texts the row with the largest id stays.
    Null texts count as empty, and empty texts are equal to each other. A null id is smaller than any other. Repeated
    rows are members like any other; where the largest id occurs twice in a group, exactly one of those rows is kept.
    An empty table gives an empty result. Other columns of ``docs`` are ignored, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    body = lower_ascii(F.col(text_col))
    state = docs.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(body, 256).alias("sha"),
        F.lit(0).cast("long").alias("grp"),
        body.cast("binary").alias("rest"),
    )
    width, level, done = FIRST_DIGIT_BYTES, 0, []
    while True:
        state = split_level(scratch, state, width, level)
        done.append(state.where("n is null or ended").select("uid", "doc_id", "sha", "n", F.lit(level).alias("level"), "grp"))
        state = state.where("n is not null and not ended").select("uid", "doc_id", "sha", "grp", "rest")
        if state.isEmpty():
            break
        width, level = min(width * DIGIT_GROWTH, MOST_DIGIT_BYTES), level + 1
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    equal = rows.where("n is not null")
    keeps = scratch.put(
        equal.groupBy("level", "grp").agg(F.max(F.struct("doc_id", "uid")).alias("keep"), F.count("*").alias("size")), "keeps"
    )
    equal = equal.join(keeps.hint("merge"), ["level", "grp"]).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("uid") == F.col("keep.uid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    single = rows.where("n is null").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    return single.unionByName(equal)


def split_level(scratch: Scratch, state: DataFrame, width: int, level: int) -> DataFrame:
    """Split every group of ``state`` by the next ``width`` bytes.

    The written result has the number ``n`` of rows that share the digit (null for a singleton), whether those texts
    ``ended`` with it, the new group and the bytes that remain, which only rows of unfinished groups keep.
    """
    state = state.withColumns(
        {"digit": F.expr(f"substring(rest, 1, {width})"), "ended": F.octet_length("rest") <= width}
    )
    groups = scratch.put(
        state.groupBy("grp", "digit", "ended")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .withColumn("next_grp", F.monotonically_increasing_id()),
        f"groups{level}",
    )
    joined = state.join(groups.hint("merge"), ["grp", "digit", "ended"], "left")
    uid = F.col("uid") if level else F.monotonically_increasing_id()
    out = scratch.put(
        joined.select(
            uid.alias("uid"),
            "doc_id",
            "sha",
            "n",
            "ended",
            F.col("next_grp").alias("grp"),
            F.when(F.col("n").isNotNull() & ~F.col("ended"), F.expr(f"substring(rest, {width + 1})")).alias("rest"),
        ),
        f"level{level}",
    )
    scratch.drop(f"groups{level}")
    return out


def exact_sql() -> str:
    """The same in DuckDB, for ids that don't repeat."""
    return """
with rows as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as body from documents)
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size, doc_id = max(doc_id) over same as kept, sha256(body) as text_sha256
from rows window same as (partition by body)"""
