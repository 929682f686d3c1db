"""The pairs of near copies that fingerprints can't tell: a part of SimHash near-dedup.

Near are texts whose shingle sets have at least a given Jaccard similarity. Two such sets share one of their first
shingles, when all sets are put in one order, the shingles that many texts hold last. Pairs that are long enough to be
near are compared by 16 bits of each hash, which can only make them look nearer, and those that then still may be near
by their whole sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.bitfilter import bit_table, maybe_in
from weftline.llm.components import star_labels
from weftline.llm.scratch import Scratch
from weftline.llm.shingles import shingle_hashes, shingle_set

#: Texts in the sample that tells which shingles are common, about. It only orders shingles: no result depends on it.
SAMPLE = 8_000
#: A shingle in so many texts of the sample is common; so many of the commonest are told apart.
COMMON, MOST_COMMON = 4, 1 << 17
#: With which texts before it, of those that share a shingle, a text is compared first. No result depends on it.
NEARBY = (1, 2, 3)
#: And with which of the most typical of them, by rank, in each round: those whose first shingles most texts hold.
TYPICAL = {"few": (1,), "more": (2, 3)}


def prefix_length(n: int, similarity: tuple[int, int]) -> int:
    """So many first shingles of a set of ``n`` hold one that any near set shares."""
    part, whole = similarity
    return n - (n * part + whole - 1) // whole + 1


def common_shingles(texts: DataFrame, shingle_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that are common in a sample of the rows (row, text), and in how many of its texts each is."""
    every = max(1, texts.count() // SAMPLE)

    def sampled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(shingle_hashes(t.as_py(), shingle_words)))], names=["h"])

    picked = texts.where(F.pmod(F.xxhash64("row"), F.lit(every)) == 0).select("text").mapInArrow(sampled, "h long")
    counted = picked.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    found = counted.orderBy(F.desc("n"), "h").limit(MOST_COMMON).toPandas().sort_values("h")
    return found["h"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


def first_shingles(of: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: tuple[int, int]) -> np.ndarray:
    """The prefix of a set in the order of all sets: by how common a shingle is, then by hash."""
    size = prefix_length(of.size, similarity) if of.size else 0
    hashes, counts = common
    if hashes.size:
        at = np.minimum(np.searchsorted(hashes, of), hashes.size - 1)
        of = of[np.lexsort((of, np.where(hashes[at] == of, counts[at], 0)))]
    return of[:size]


def in_common(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two arrays share, at most: exact for sets, an upper bound where elements repeat."""
    small, large = (a, b) if a.size < b.size else (b, a)
    if not small.size:
        return 0
    at = np.minimum(np.searchsorted(large, small), large.size - 1)
    return int((large[at] == small).sum())


def parity_bits(of: np.ndarray) -> np.ndarray:
    """For each remainder of a set's hashes whether an odd number have it, in words of 64 bits: a power of two of bits, one a hash at least."""
    size = max(64, 1 << max(0, of.size - 1).bit_length())
    odd = np.bincount(of & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """In how many elements two sets differ, at least, by their parity bits: one that both have changes no bit of ``x ^ y``."""
    while x.size != y.size:
        if x.size < y.size:
            x, y = y, x
        x = x[: x.size // 2] ^ x[x.size // 2 :]
    return int(np.bitwise_count((x ^ y).view(np.uint64)).sum())


def may_be_near(n: int, m: int, both: int, similarity: tuple[int, int]) -> bool:
    """Whether sets of ``n`` and ``m`` elements that share ``both`` reach the similarity; empty sets are near each other."""
    part, whole = similarity
    return both * whole >= part * (n + m - both) if n and m else n == m


def only(scratch: Scratch, rows: DataFrame, row: str, stay: DataFrame, name: str) -> DataFrame:
    """The rows whose number is in ``stay``. Most are: only those that a bitmap of the others can't clear are shuffled."""
    bits = bit_table(scratch, rows.select(row).join(stay.hint("merge"), row, "left_anti"), F.xxhash64(row), name)
    cleared = maybe_in(rows, F.xxhash64(row), bits, wanted=False)
    return cleared.unionByName(maybe_in(rows, F.xxhash64(row), bits).join(stay.hint("merge"), row, "left_semi"))


def near_links(scratch: Scratch, prints: DataFrame, texts: DataFrame, close: DataFrame, shingle_words: int, similarity: tuple[int, int]) -> DataFrame:
    """Links (u, v) between the rows of ``prints``: enough of them to connect all near ones.

    The pairs in ``close``, which fingerprints propose, are compared first, with those of texts that share a first
    shingle with a few before and the smallest one, by size, and with the most typical one, then those that aren't yet
    connected with a few at random and the next typical ones. Copies with changes of their own are nearer to what they
    were made from than to each other, and that has the first shingles that most of them hold. That joins most of a
    large group with few pairs; in the end every pair that isn't yet connected is compared. Texts that share a first
    shingle and the one ``before`` it, of those that any other text has, meet at an earlier one.
    """
    part, whole = similarity
    met, own = Window.partitionBy("h"), Window.partitionBy("row")
    entries = prints.select("row", "n", F.size("firsts").alias("size"), F.posexplode("firsts").alias("pos", "h"))
    entries = entries.withColumn("texts", F.count("*").over(met)).where("texts > 1")
    entries = entries.withColumns({"before": F.lag("h").over(own.orderBy("pos")), "typical": F.sum("texts").over(own) / F.col("size")})
    entries = scratch.put(entries.drop("size", "texts"), "entries")
    fits = f"least(n, m) * {whole} >= greatest(n, m) * {part}"
    overlap = f"least(n - pos, m - at) * {part + whole} >= (n + m) * {part}"
    once = "coalesce(before != prior, true)"
    other = {"row": "other", "n": "m", "pos": "at", "before": "prior", "root": "top"}
    sets = prints.select("row", F.struct("n", "bits").alias("value"))
    ranked = met.orderBy(F.desc("typical"), "row").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed, links, made = entries.withColumn("root", F.col("row")), None, ["entries"]
    for name, order in (("few", ["n", "row"]), ("more", [F.xxhash64("row"), "row"])):
        place = met.orderBy(*order)
        picks = [(f, place) for f in (*[partial(F.lag, offset=k) for k in NEARBY], F.first)]
        picks += [(partial(F.nth_value, offset=k), ranked) for k in TYPICAL[name]]
        nearby = [F.struct(*[f(c).over(w).alias(to) for c, to in other.items()]) for f, w in picks]
        some = placed.select(*list(other), F.array(*nearby).alias("nearby")).select(*list(other), F.explode("nearby").alias("o")).select(*list(other), "o.*")
        some = some.where(f"root != top and {fits} and {overlap}")
        some = (some.where(once) if links is None else some).select(F.greatest("row", "other").alias("a"), F.least("row", "other").alias("b"))
        found = compared(scratch, some.unionByName(close) if links is None else some, sets, texts, name, shingle_words, similarity)
        links = found if links is None else links.unionByName(found)
        roots = scratch.put(star_labels(links, Scratch(scratch.spark, f"near_{name}")), f"{name}_roots")
        placed = placed.drop("root").join(roots.withColumnRenamed("node", "row").hint("merge"), "row", "left").withColumn("root", F.coalesce("root", "row"))
        placed = scratch.put(placed, f"{name}_placed")
        mixed = placed.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("h")
        placed = scratch.put(placed.join(mixed.hint("merge"), "h", "left_semi"), f"{name}_mixed")
        made += [f"{name}_roots", f"{name}_placed", f"{name}_mixed"]
    others = placed.select("h", *[F.col(c).alias(to) for c, to in other.items()])
    pairs = placed.join(others.hint("merge"), "h").where(f"row > other and root != top and {fits} and {overlap} and {once}")
    rest = compared(scratch, pairs.select(F.col("row").alias("a"), F.col("other").alias("b")), sets, texts, "rest", shingle_words, similarity)
    scratch.drop(*made)
    return links.unionByName(rest)


def only_rows(scratch: Scratch, texts: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """The texts whose row may be among those of ``wanted``, without a shuffle."""
    return maybe_in(texts, F.xxhash64("row"), bit_table(scratch, wanted, F.xxhash64("row"), name))


def compared(scratch: Scratch, pairs: DataFrame, sets: DataFrame, texts: DataFrame, name: str, shingle_words: int, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose texts are near, as links (u, v)."""
    pairs = scratch.put(pairs.distinct(), f"{name}_pairs")

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            a, b, a_text, b_text = batch.columns
            keep = []
            for i, u in enumerate(a.to_pylist()):
                if u != last:
                    last, held = u, shingle_set(shingle_hashes(a_text[i].as_py(), shingle_words))
                other = shingle_set(shingle_hashes(b_text[i].as_py(), shingle_words))
                keep.append(may_be_near(held.size, other.size, in_common(held, other), similarity))
            yield _kept(a, b, keep)

    def roughly(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, *values = batch.columns
            (n, x), (m, y) = [(v.field("n").to_pylist(), [w.values.to_numpy() for w in v.field("bits")]) for v in values]
            most = [(i + j - apart(v, w)) // 2 for i, j, v, w in zip(n, m, x, y, strict=True)]
            yield _kept(a, b, [may_be_near(i, j, both, similarity) for i, j, both in zip(n, m, most, strict=True)])

    maybe = scratch.put(both_sides(pairs, sets).mapInArrow(roughly, "u long, v long"), f"{name}_maybe").toDF("a", "b")
    scratch.drop(f"{name}_pairs")
    asked = only_rows(scratch, texts, maybe.select(F.explode(F.array("a", "b")).alias("row")), f"{name}_bits")
    links = scratch.put(both_sides(maybe, asked).mapInArrow(whole, "u long, v long"), f"{name}_links")
    scratch.drop(f"{name}_maybe")
    return links


def both_sides(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs (a, b) with what ``rows`` (row, value) has for either; the pairs of one ``a`` follow each other."""
    side = lambda c: rows.toDF(c, f"{c}_value").hint("merge")
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "a_value", "b_value")


def _kept(a: pa.Array, b: pa.Array, keep: list[bool]) -> pa.RecordBatch:
    mask = pa.array(keep, pa.bool_())
    return pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["u", "v"])
