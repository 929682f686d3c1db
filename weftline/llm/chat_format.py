"""Chat formatting by quotation linking.

Each message is parsed into its own lines and quoted passages with their nesting levels. Hashes of normalised quoted
passages are joined to those of the messages' own passages in the same conversation, which shows what a message replies
to. Each root and the replies below it become one conversation in reply order, with the quotes left out of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.scratch import Scratch, small_batches

#: Messages in one row of a conversation, about: longer ones span several rows.
PART_MESSAGES = 512
_MARKS = re.compile(r"(?:>[ ]?)+")
_SPACE = re.compile(r"\s+")


def parse(text: str | None) -> tuple[str | None, list[tuple[int, str]], list[str]]:
    """A message's text without quotes, its quoted passages as (level, text), and its own passages.

    A line's level is the number of ``>`` at its start; a passage is a run of lines of one level between blank lines.
    Both a whole passage and each of its lines count, so that a quote of a part is found.
    """
    if text is None:
        return None, [], []
    kept, blocks, level_before = [], [], -1
    for line in text.split("\n"):
        marks = _MARKS.match(line)
        level = marks.group().count(">") if marks else 0
        body = line[marks.end() :] if marks else line
        if not level:
            kept.append(line)
        if not body.strip():
            level_before = -1
            continue
        if level != level_before:
            blocks.append((level, []))
            level_before = level
        blocks[-1][1].append(body)
    quoted, own = set(), set()
    for level, lines in blocks:
        for passage in (*lines, "\n".join(lines)):
            passage = _SPACE.sub(" ", passage).strip().lower()
            if passage:
                quoted.add((level, passage)) if level else own.add(passage)
    clean = re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip("\n") if len(kept) < text.count("\n") + 1 else text
    return clean, sorted(quoted), sorted(own)


_PARSED = "conv_id {conv}, turn {turn}, role {role}, text string, quotes array<struct<level:int,hash:binary,size:int>>, own array<binary>"


def _parse_all(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = lambda s: xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass"))
    quote = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.binary()), ("size", pa.int32())]))
    for batch in batches:
        parsed = [parse(t.as_py()) for t in batch.column(3)]
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:3],
                pa.array([p[0] for p in parsed], pa.string()),
                pa.array([[{"level": n, "hash": digest(s), "size": len(s)} for n, s in p[1]] for p in parsed], quote),
                pa.array([[digest(s) for s in p[2]] for p in parsed], pa.list_(pa.binary())),
            ],
            names=["conv_id", "turn", "role", "text", "quotes", "own"],
        )


def link_quotes(messages: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """One row per row of ``messages``: ``conv_id, turn, role, parent_turn, root_turn, depth, n_quotes, text, chat, row``.

    ``parent_turn`` is the earlier turn of the conversation from which most quoted characters come, at the lowest level
    for which any is found (equal: the latest turn); a passage's origin is the first turn that has it unquoted.
    ``root_turn`` and ``depth`` follow the parents up; a message without a parent is its own root. In the order of
    ``root_turn, turn`` each thread is together and every reply comes after its parent. A passage of any length counts.

    ``row`` numbers the rows, in no order.

    Null texts stay null and link nothing; messages with a null conversation or turn are roots. Repeated turns share
    one parent. Empty texts are kept. An empty table gives an empty result; other columns are ignored.
    """
    spark = messages.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "chat")
    rows = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    kinds = {k: rows.schema[c].dataType.simpleString() for k, c in (("conv", "conv_id"), ("turn", "turn"), ("role", "role"))}
    parsed = rows.mapInArrow(_parse_all, _PARSED.format(**kinds)).withColumn("row", F.monotonically_increasing_id())
    parsed = scratch.put(parsed, "parsed")
    quotes = parsed.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.level", "q.hash", "q.size")
    quoted = scratch.put(quotes.distinct(), "quoted")
    asked = quoted.select("conv_id", "hash").distinct()
    own = parsed.select("conv_id", "turn", F.explode("own").alias("hash")).join(asked, ["conv_id", "hash"], "left_semi")
    origins = scratch.put(own.groupBy("conv_id", "hash").agg(F.min("turn").alias("origin")), "origins")
    met = quoted.join(origins, ["conv_id", "hash"]).where("origin < turn")
    votes = met.groupBy("conv_id", "turn", "level", "origin").agg(F.sum("size").alias("size"))
    best = F.max_by("origin", F.struct(-F.col("level"), "size", "origin"))
    parents = scratch.put(votes.groupBy("conv_id", "turn").agg(best.alias("parent_turn")), "parents")
    threads = thread_roots(scratch, parents)
    said = parsed.join(threads, ["conv_id", "turn"], "left")
    return said.select(
        "conv_id",
        "turn",
        "role",
        "parent_turn",
        F.coalesce("root_turn", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0).cast("long")).alias("depth"),
        F.size("quotes").cast("long").alias("n_quotes"),
        "text",
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n<|end|>\n")).alias("chat"),
        "row",
    )


def thread_roots(scratch: Scratch, parents: DataFrame) -> DataFrame:
    """``parents`` (conv_id, turn, parent_turn) with ``root_turn`` and ``depth``, by pointer doubling."""
    up = parents.select("conv_id", "turn", "parent_turn", F.col("parent_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth"))
    step, moved = 0, True
    while moved:
        step += 1
        above = up.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("higher"), F.col("depth").alias("more"))
        up = scratch.put(
            up.join(above, ["conv_id", "root_turn"], "left").select(
                "conv_id",
                "turn",
                "parent_turn",
                F.coalesce("higher", "root_turn").alias("root_turn"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                F.col("higher").isNotNull().alias("moved"),
            ),
            f"roots{step}",
        )
        moved = not up.where("moved").isEmpty()
        up = up.drop("moved")
    return up


def conversations(linked: DataFrame, part_messages: int = PART_MESSAGES) -> DataFrame:
    """Conversations in reply order from the messages of ``link_quotes``: ``conv_id, root_turn, part, n_parts,
    n_messages, messages, chat``.

    A root and all replies below it are one conversation, ordered by turn: a reply comes after what it replies to.
    One with more than ``part_messages`` turns from first to last spans rows with the next turns each; of a part with
    more rows than that, because turns repeat, rows are dealt to more parts by hash. So no row or task holds a
    conversation of any size. ``messages`` has each message with its ``turn, role, parent_turn, depth, text``; ``chat``
    is their formatted text. Messages with a null turn are in parts of their own, as they have no place in the order.
    """
    scratch = Scratch(linked.sparkSession, "conversations")
    key = ["conv_id", "root_turn", "nth"]
    said = linked.withColumn("nth", F.floor((F.col("turn") - F.col("root_turn")) / part_messages))
    sizes = scratch.put(said.groupBy(*key).agg(F.count("*").alias("n")), "sizes")
    sizes = sizes.toDF(*[f"p_{c}" for c in key], "n").withColumn("slots", F.ceil(F.col("n") / part_messages))
    said = said.join(sizes.hint("merge"), F.expr(" and ".join(f"{c} <=> p_{c}" for c in key)))
    slot = F.pmod(F.xxhash64("row"), F.col("slots"))
    message = F.struct("turn", "role", "parent_turn", "depth", "text", "chat")
    parts = said.withColumn("slot", slot).groupBy(*key, "slot").agg(F.array_sort(F.collect_list(message)).alias("all"))
    places = sizes.select(*[F.col(f"p_{c}").alias(c) for c in key], "slots")
    before = F.sum("slots").over(Window.partitionBy("conv_id", "root_turn").orderBy("nth")) - F.col("slots")
    total = F.sum("slots").over(Window.partitionBy("conv_id", "root_turn"))
    places = scratch.put(places.select(*key, before.alias("before"), total.alias("n_parts")), "places")
    places = places.toDF(*[f"p_{c}" for c in key], "before", "n_parts")
    return parts.join(places.hint("merge"), F.expr(" and ".join(f"{c} <=> p_{c}" for c in key))).select(
        "conv_id",
        "root_turn",
        (F.col("before") + F.col("slot")).alias("part"),
        "n_parts",
        F.size("all").cast("long").alias("n_messages"),
        F.transform("all", lambda m: F.struct(*[m[c].alias(c) for c in ("turn", "role", "parent_turn", "depth", "text")])).alias("messages"),
        F.array_join(F.transform("all", lambda m: m["chat"]), "").alias("chat"),
    )
