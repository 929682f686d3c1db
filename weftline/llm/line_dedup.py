"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line goes if an earlier line, in the order of document id and line number, equals it or is within one edit of it.
Equal lines meet by a 128-bit digest. For lines within one edit, all variants with a character deleted are emitted as
hashed keys; lines with an equal variant are joined, and the edit distance of each pair is verified.

Variants of every line would be as many as there are characters, so pieces that can't be near another line's are left
out first, without loss: of two lines within one edit, cut into segments at the same places from both ends, all but
one segment are the same. Lines that share one half with another go on; they are cut into sixteenths, again and again
while the odd segment is long, and only the odd segments of lines that agree on all the rest emit variants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.bitfilter import bit_table, maybe_in
from weftline.llm.scratch import Scratch, spare_prefix

#: Lines of any length may be within one edit of another; a caller may ask for more characters.
NEAR_CHARS = 1
SEGMENTS = 16
#: Segments up to this length emit their variants.
PIECE_CHARS = 64


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_chars: int = NEAR_CHARS) -> DataFrame:
    """The rows of ``docs`` with repeated lines taken out of their texts, and ``n_lines``, ``n_exact``, ``n_near``.

    Lines end with \\n and are compared without spaces at both ends; the lines that stay keep theirs. Lines without
    other characters always stay and don't count. Lines under ``near_chars`` are compared for equality only; by default
    there are none, so lines of one character are all within one edit of each other. ``n_exact`` counts lines that equal an earlier one, ``n_near`` those
    that are only within one edit of one. Null texts stay null, with counts of 0. A null id is earlier than any other.
    Rows with the same id and text are one document: they lose the same lines. An empty table gives an empty result.
    Columns named like the three counts are replaced; other columns may have any name.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    lines = scratch.put(line_table(docs, id_col, text_col, near_chars), "lines")
    distinct = scratch.put(
        lines.groupBy("digest")
        .agg(F.min(F.struct("doc", "version", "line_no")).alias("first"), F.count("*").alias("n"), F.first("halves").alias("halves"))
        .withColumn("line_id", F.monotonically_increasing_id()),
        "distinct",
    )
    near = near_earlier(scratch, docs, text_col, distinct)
    bad = scratch.put(
        distinct.select("digest", "first", "n", "line_id")
        .join(near.withColumn("near", F.lit(True)), "line_id", "left")
        .where("n > 1 or near")
        .select("digest", "first", F.coalesce("near", F.lit(False)).alias("near")),
        "bad",
    )
    scratch.drop("distinct", "near")
    met = maybe_in(lines.select("doc", "version", "line_no", "digest"), F.xxhash64("digest"), bit_table(scratch, bad, F.xxhash64("digest"), "bad_bits"))
    again = ~F.struct("doc", "version", "line_no").eqNullSafe(F.col("first"))
    drops = met.join(bad, "digest").where(again | F.col("near")).select("doc", "version", "line_no", (F.col("near") & ~again).alias("near"))
    drops = scratch.put(
        drops.groupBy("doc", "version").agg(
            F.collect_set("line_no").alias("drop"), F.count_if(F.expr("not near")).alias("exact"), F.count_if("near").alias("near")
        ),
        "drops",
    )
    scratch.drop("lines", "bad", "bad_bits")
    return without_lines(scratch, docs, drops, id_col, text_col)


def line_table(docs: DataFrame, id_col: str, text_col: str, near_chars: int) -> DataFrame:
    """Every line with a character other than space: its place, its digest, and the hashes of its halves if it is long."""
    line = F.trim("line")
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("version"), F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "line"))
    rows = rows.select("doc", "version", "line_no", line.alias("line")).where("line != ''")
    halves = F.when(F.length("line") >= near_chars, F.array(*_half_hashes(F.col("line"))))
    return rows.select("doc", "version", "line_no", F.unhex(F.md5("line")).alias("digest"), halves.alias("halves"))


def _half_hashes(line: Column) -> list[Column]:
    """Of a line as it is, and as the longer one of a pair: the hash of its first and its last half."""
    out = []
    for base in (F.length(line), F.length(line) - 1):
        half = F.floor(base / 2).cast("int")
        out += [F.xxhash64(F.lit(0), base, F.left(line, half)), F.xxhash64(F.lit(1), base, F.right(line, base - half))]
    return out


def near_earlier(scratch: Scratch, docs: DataFrame, text_col: str, distinct: DataFrame) -> DataFrame:
    """``line_id`` of the distinct lines for which an earlier line is within one edit."""
    keys = distinct.select("line_id", F.explode(F.array_distinct("halves")).alias("key"))
    shared = scratch.put(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared_halves")
    alike = keys.join(shared, "key", "left_semi").select("line_id").distinct()
    alike = scratch.put(distinct.select("line_id", "digest", "first").join(alike, "line_id", "left_semi"), "alike")
    scratch.drop("shared_halves")
    digest = F.unhex(F.md5("line"))
    texts = docs.select(F.explode(F.array_distinct(F.split(text_col, "\n", -1))).alias("line")).select(F.trim("line").alias("line"))
    texts = maybe_in(texts.withColumn("digest", digest), F.xxhash64("digest"), bit_table(scratch, alike, F.xxhash64("digest"), "alike_bits"))
    texts = scratch.put(texts.join(alike, "digest").groupBy("line_id").agg(F.first("line").alias("line"), F.first("first").alias("first")), "texts")
    scratch.drop("alike", "alike_bits")
    rows = texts.select(
        "line_id", F.lit(0).cast("long").alias("key"), F.explode(F.array(F.length("line"), F.length("line") - 1)).alias("base"), F.col("line").alias("piece")
    )
    step, ready = 0, []
    while True:
        step += 1
        cut = scratch.put(cut_pieces(rows), f"cut{step}")
        shared = scratch.put(cut.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), f"shared{step}")
        rows = scratch.put(cut.join(shared, "key", "left_semi"), f"pieces{step}")
        scratch.drop(f"cut{step}", f"shared{step}")
        ready.append(rows.where(F.col("base") <= PIECE_CHARS))
        rows = rows.where(F.col("base") > PIECE_CHARS)
        if rows.isEmpty():
            break
    pieces = ready[0]
    for more in ready[1:]:
        pieces = pieces.unionByName(more)
    variants = pieces.select("line_id", "key", F.explode(_variants()).alias("variant")).distinct()
    variants = scratch.put(variants.join(texts.select("line_id", "first"), "line_id"), "variants")
    met = variants.groupBy("key", "variant").agg(F.min(F.struct("first", "line_id")).alias("best"), F.count("*").alias("n"))
    met = scratch.put(met.where("n > 1").select("key", "variant", F.col("best.line_id").alias("earlier")), "met")
    pairs = variants.join(met, ["key", "variant"]).where("line_id != earlier").select("line_id", "earlier").distinct()
    checked = pairs.join(texts.select("line_id", "line"), "line_id").join(
        texts.select(F.col("line_id").alias("earlier"), F.col("line").alias("other")), "earlier"
    )
    near = scratch.put(checked.where(F.levenshtein("line", "other", 1).between(0, 1)).select("line_id").distinct(), "near")
    scratch.drop("texts", "variants", "met", *[f"pieces{k}" for k in range(1, step + 1)])
    return near


def cut_pieces(rows: DataFrame) -> DataFrame:
    """A row for each segment of each piece: ``key`` hashes all but the segment, which is the new piece.

    ``base`` is the length of the shorter piece of a pair; a piece is as long or one longer. Segments are cut at the
    same places, before the odd one from the left, after it from the right.
    """
    at = lambda g: F.floor(F.col("base") * g / SEGMENTS).cast("int")
    rows = rows.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))))
    rows = rows.select("*", at(F.col("g")).alias("left"), (F.col("base") - at(F.col("g") + 1)).alias("right"))
    return rows.select(
        "line_id",
        F.xxhash64("key", "g", "base", F.left("piece", F.col("left")), F.right("piece", F.col("right"))).alias("key"),
        (F.col("base") - F.col("left") - F.col("right")).alias("base"),
        F.substring("piece", F.col("left") + 1, F.length("piece") - F.col("left") - F.col("right")).alias("piece"),
    )


def _variants() -> Column:
    """Hashes of the piece with each character deleted and, if it may be the shorter one of a pair, of itself.

    What is hashed is what stands before and after the gap: two lines with an equal variant are within one edit, so it
    is enough that each line of a variant meets the earliest one.
    """
    without = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("piece"), F.lit(1))),
        lambda i: F.xxhash64("key", F.left("piece", i - 1), F.substring("piece", i + 1, F.length("piece"))),
    )
    itself = F.transform(
        F.sequence(F.lit(0), F.length("piece")), lambda i: F.xxhash64("key", F.left("piece", i), F.substring("piece", i + 1, F.length("piece")))
    )
    return F.array_distinct(F.concat(without, F.when(F.length("piece") == F.col("base"), itself).otherwise(F.expr("cast(array() as array<bigint>)"))))


def without_lines(scratch: Scratch, docs: DataFrame, drops: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the lines in ``drops``; only rows that may lose lines are shuffled."""
    bits = bit_table(scratch, drops, F.xxhash64("doc", "version"), "drop_bits")
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_exact", "n_near")]
    p = spare_prefix(own)
    drops = drops.toDF(*[p + c for c in drops.columns])
    rows = docs.select(*own).withColumns({f"{p}id": F.col(id_col), f"{p}text": F.xxhash64(text_col)})
    key = F.xxhash64(f"{p}id", f"{p}text")
    some = maybe_in(rows, key, bits).join(drops, F.col(f"{p}id").eqNullSafe(F.col(f"{p}doc")) & (F.col(f"{p}text") == F.col(f"{p}version")), "left")
    none = maybe_in(rows, key, bits, False).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in drops.schema])
    lines, gone = F.split(text_col, "\n", -1), F.col(f"{p}drop")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(gone, i)), "\n")
    clean = F.when(gone.isNull(), F.col(text_col)).otherwise(kept)
    counts = {
        "n_lines": F.when(F.col(text_col).isNotNull(), F.size(F.filter(lines, lambda x: F.trim(x) != ""))),
        "n_exact": F.col(f"{p}exact"),
        "n_near": F.col(f"{p}near"),
    }
    return some.unionByName(none).select(
        *[clean.alias(c) if c == text_col else F.col(c) for c in own],
        *[F.coalesce(v, F.lit(0)).cast("long").alias(k) for k, v in counts.items()],
    )


def line_report(docs: DataFrame) -> DataFrame:
    found = dedup_lines(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def line_sql() -> str:
    """The same in DuckDB: candidates share a half, as text. Its own edit distance counts bytes, so one edit is spelt out."""
    half = lambda side, base: f"{side}(line, {'(' + base + ') // 2' if side == 'left' else '(' + base + ') - (' + base + ') // 2'})"
    keys = " union all ".join(
        f"select *, '{side}' as side, {base} as base, {half(side, base)} as half from firsts where length(line) >= {NEAR_CHARS}"
        for side in ("left", "right")
        for base in ("length(line)", "length(line) - 1")
    )
    return f"""
with parts as (select doc_id, text, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents),
lines as (select doc_id, text, raw, line_no, trim(raw, ' ') as line from parts),
firsts as (select line, min((doc_id, line_no)) as first from lines where line != '' group by line),
keys as ({keys}),
pairs as (
  select distinct a.line, case when length(a.line) < length(b.line) then b.line else a.line end as long, case when length(a.line) < length(b.line) then a.line else b.line end as short
  from keys a join keys b on a.side = b.side and a.base = b.base and a.half = b.half and b.first < a.first),
near as (
  select distinct line from pairs where length(long) - length(short) <= 1
    and len(list_filter(range(length(long)), lambda i: long[:i] = short[:i] and long[i + 2:] = short[i + 2 - (length(long) - length(short)):])) > 0),
marked as (
  select l.*, l.line != '' and f.first != (l.doc_id, l.line_no) as again, l.line != '' and n.line is not null as is_near
  from lines l left join firsts f using (line) left join near n using (line))
select doc_id, count(*) filter (line != '')::bigint as n_lines, count(*) filter (again)::bigint as n_exact, count(*) filter (is_near and not again)::bigint as n_near,
  sha256(coalesce(string_agg(raw, chr(10) order by line_no) filter (not again and not is_near), '')) as text_sha256
from marked group by doc_id"""
