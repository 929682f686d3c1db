"""Benchmark decontamination by pigeonhole edit matching.

An item with an error budget of k edits is cut into k + 1 pieces: a text within k edits of it holds at least one piece
unchanged. All pieces are found at once by an Aho-Corasick automaton; where one is found, Myers' bit-parallel
algorithm gives the edit distance between the item and the best-matching part of the text around it. One rule holds
for items of all lengths: ``ERROR_RATE`` edits a character, rounded down; those too short for one edit are searched for
as whole words.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cached_property

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from weftline.llm.scratch import Scratch, small_batches

#: Edits allowed for each character of a normalised item.
ERROR_RATE = 0.08
#: Items are matched in blocks of about this many bytes, each a pass over the documents; its matcher takes some 70 times
#: as much memory in every Python worker.
BLOCK_BYTES = 2 << 20
_TOKEN = re.compile(r"[^\W_]+")


def normalised(text: str | None) -> str:
    """Letters and digits in lower case, in runs parted by one space."""
    return " ".join(_TOKEN.findall(text.lower())) if text else ""


class Pattern:
    """A normalised item with its error budget; the bit masks of its characters are made when a piece of it is found."""

    def __init__(self, text: str, error_rate: float):
        self.text, self.budget = text, int(error_rate * len(text))

    @cached_property
    def masks(self) -> tuple[dict[str, int], dict[str, int]]:
        return _masks(self.text), _masks(self.text[::-1])

    def pieces(self) -> Iterator[tuple[int, str]]:
        """(offset, piece) of budget + 1 pieces of nearly equal length."""
        n, k = len(self.text), self.budget + 1
        for i in range(k):
            yield i * n // k, self.text[i * n // k : (i + 1) * n // k]

    def best(self, text: str) -> tuple[int, int, int] | None:
        """(distance, start, end) of the best-matching part of ``text``, the first of the best; None beyond the budget."""
        if (at := text.find(self.text)) >= 0:
            return 0, at, at + len(self.text)
        forth, back = self.masks
        best, end = min(((d, j) for j, d in enumerate(_distances(forth, len(self.text), text, 0), 1)), default=(self.budget + 1, 0))
        if best > self.budget:
            return None
        before = text[max(0, end - len(self.text) - best) : end][::-1]
        length = min((d, j) for j, d in enumerate(_distances(back, len(self.text), before, 1), 1))[1]
        return best, end - length, end


def _masks(text: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(text):
        masks[c] |= 1 << i
    return dict(masks)


def _distances(masks: dict[str, int], size: int, text: str, gap: int) -> Iterator[int]:
    """Myers: after each character, the distance to the best part that ends there (gap 0), or to the whole (gap 1)."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, distance = full, 0, size
    for c in text:
        same = masks.get(c, 0)
        vertical = same | minus
        across = (((same & plus) + plus) ^ plus) | same
        up, down = minus | (full & ~(across | plus)), plus & across
        distance += bool(up & top) - bool(down & top)
        up, down = (up << 1) | gap, down << 1
        plus, minus = full & (down | ~(vertical | up)), full & up & vertical
        yield distance


class Matcher:
    """Finds the items of one block in normalised texts."""

    def __init__(self, items: list[str], error_rate: float):
        self.patterns = [Pattern(t, error_rate) for t in items]
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, p in enumerate(self.patterns):
            for offset, piece in p.pieces():
                found[piece].append((i, offset))
        self.pieces = ahocorasick.Automaton()
        for piece, places in found.items():
            self.pieces.add_word(piece, (len(piece), places))
        self.pieces.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item, distance, start, end) for every item found, once each with its best place."""
        if not self.patterns:
            return
        starts: dict[int, set[int]] = defaultdict(set)
        words: dict[int, int] = {}
        for end, (size, places) in self.pieces.iter(text):
            for item, offset in places:
                at = end + 1 - size - offset
                if self.patterns[item].budget:
                    starts[item].add(at)
                elif item not in words and text[at - 1 : at] in ("", " ") and text[end + 1 : end + 2] in ("", " "):
                    words[item] = at
        for item, at in sorted(words.items()):
            yield item, 0, at, at + len(self.patterns[item].text)
        for item, at in sorted(starts.items()):
            pattern, best = self.patterns[item], None
            for low, high in _windows(sorted(at), len(pattern.text), pattern.budget):
                low = max(0, low)
                if (hit := pattern.best(text[low:high])) and (best is None or hit[0] < best[0]):
                    best = hit[0], hit[1] + low, hit[2] + low
            if best:
                yield item, *best


def _windows(starts: list[int], size: int, budget: int) -> Iterator[tuple[int, int]]:
    """The stretches of text to look at: each supposed start with the budget to both sides, joined where they overlap."""
    low, high = starts[0] - budget, starts[0] + size + budget
    for s in starts[1:]:
        if s - budget <= high - size:
            high = s + size + budget
        else:
            yield low, high
            low, high = s - budget, s + size + budget
    yield low, high


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The items as (id, normalised text), in lists of bounded size; those without letters and digits are left out."""
    size = items.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(n)) == b).select(id_col, text_col).toLocalIterator()
        block = [(r[0], t) for r in rows if (t := normalised(r[1]))]
        if block:
            yield block


_held: list = []


def _matcher(shared, error_rate: float) -> Matcher:
    """The matcher of a broadcast block, built once in each Python worker.

    The block is held beside it: a later block can't take its place in memory and pass for it.
    """
    block = shared.value
    if not _held or _held[0] is not block:
        _held[:] = block, Matcher([t for _, t in block], error_rate)
    return _held[1]


def edit_hits(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_id_col="item_id", item_text_col="text", error_rate=ERROR_RATE) -> DataFrame:
    """One row for each document row and item found in it: ``doc_id, item_id, distance, start, stop``.

    ``start`` and ``stop`` are code points of the document's normalised text. Null texts are empty and hold nothing;
    items without letters and digits are never found. Ids may be null or repeated: every row is matched by itself, and
    items of one text are all reported. Empty tables give an empty result. Other columns are ignored, whatever their
    names. The hits of a block of items are written before the next block is read, so that the driver and the workers
    hold one block, however many items there are.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "edits")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    item_id = items.schema[item_id_col].dataType
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {item_id.simpleString()}, distance int, start int, stop int"
    id_type = to_arrow_type(item_id)
    out = spark.createDataFrame([], schema)
    for b, block in enumerate(_blocks(items, item_id_col, item_text_col)):
        shared = spark.sparkContext.broadcast(block)

        def hits(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared, error_rate)
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1)
                found = [(k, *hit) for k, t in enumerate(texts) for hit in matcher.find(normalised(t.as_py()))]
                at, item, distance, start, stop = zip(*found, strict=True) if found else ((),) * 5
                item_ids = pa.array([shared.value[i][0] for i in item], id_type)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at, pa.int64())), item_ids, *(pa.array(x, pa.int32()) for x in (distance, start, stop))],
                    names=["doc_id", "item_id", "distance", "start", "stop"],
                )

        out = out.unionByName(scratch.put(rows.mapInArrow(hits, schema), f"hits{b}"))
        shared.destroy()
    return out


def without_leaks(docs: DataFrame, items: DataFrame, text_col="text", item_id_col="item_id", item_text_col="text", error_rate=ERROR_RATE) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns as they are.

    What a block of items leaves is written before the next block is read, but for the last one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "leaks")
    before = None
    for b, block in enumerate(_blocks(items, item_id_col, item_text_col)):
        if before is not None:
            docs = scratch.put(docs, f"left{b}")
            before.destroy()
            scratch.drop(f"left{b - 1}")
        before = shared = spark.sparkContext.broadcast(block)

        def clean(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared, error_rate)
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col))
                yield batch.filter(pa.array([next(matcher.find(normalised(t.as_py())), None) is None for t in texts], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
