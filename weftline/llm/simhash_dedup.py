"""SimHash near-dedup by a binary trie self-join.

Distinct fingerprints are the leaves of a binary trie. Pairs of nodes are traversed together from the root: each step
takes both nodes to their children, adds the differing bits, and drops pairs beyond the error budget. The top of the
traversal is a DataFrame loop over node pairs with their sizes, which goes deeper only where a pair is too large for
one task; each remaining pair of subtries is then finished in a task of its own. A task returns a spanning forest of
the links it finds, never all pairs, and connected components join the forests.

``one_of_each`` asks for a similarity of shingle sets, which fingerprints alone can't decide: at a Jaccard similarity of
0.8 they differ in about ten of 64 bits, give or take three, and a trie with an error budget as wide as that drops no
pairs. There the trie proposes the closest pairs, ``near_copies`` the rest of those that may be near, and whole sets
decide about all of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import near_copies
from weftline.llm.components import star_labels
from weftline.llm.scratch import Scratch, small_batches, spare_prefix
from weftline.llm.shingles import fingerprint, shingle_hashes, shingle_set

SHINGLE_WORDS = 3
ERROR_BUDGET = 2
#: What ``one_of_each`` takes for near copies: shingles of so many words, so great a Jaccard similarity (4/5).
NEAR_WORDS, NEAR = 5, (4, 5)
#: Fingerprints under the two nodes of a pair that one task finishes, at most.
CELL = 8192
_FIRST_BITS, _MORE_BITS = 4, 2
_DIRECT = 16
_FRONTIER = 1 << 17


def simhash(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of a whole text: a bit is 1 if it is set in over half the shingles' hashes; no words: 0."""
    return fingerprint(shingle_hashes(text, shingle_words))


def near_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cell: int = CELL, shingle_words: int = SHINGLE_WORDS, error_budget: int = ERROR_BUDGET
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fp`` (the fingerprint as a long) and ``component_id``.

    Fingerprints that differ in ``error_budget`` bits or fewer are linked; a component's id is the smallest id that
    links reach. Null texts and texts without words have fingerprint zero and are linked like any other. A null id is
    ignored when the smallest is taken; a component of null ids has a null id. Repeated rows are rows of their own in
    one component. An empty table gives an empty result. Other columns of ``docs`` are ignored, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "simhash")

    def fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(t.as_py(), shingle_words) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    prints = scratch.put(rows.mapInArrow(fingerprints, f"doc_id {id_type}, fp long"), "prints")
    labels = star_labels(trie_links(scratch, prints.select("fp").distinct(), cell, error_budget), scratch)
    rooted = scratch.put(
        prints.join(labels.select(F.col("node").alias("fp"), "root").hint("merge"), "fp", "left").select(
            "doc_id", "fp", F.coalesce("root", "fp").alias("root")
        ),
        "rooted",
    )
    smallest = scratch.put(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "smallest")
    return rooted.join(smallest.hint("merge"), "root").select("doc_id", "fp", "component_id")


def one_of_each(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = NEAR_WORDS,
    similarity: tuple[int, int] = NEAR,
    error_budget: int = ERROR_BUDGET,
    cell: int = CELL,
) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component of near pairs the smallest id's row stays, as it is.

    Near are texts whose sets of shingles have at least this Jaccard similarity (a fraction); every such pair is found.
    Rows with equal sets, as texts without words, are copies. Of rows that share an id one stays. A null id is smaller
    than any other. An empty table gives an empty result. Columns may have any names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "one_of_each")
    row = spare_prefix(docs.columns) + "row"
    rows = scratch.put(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    texts = rows.select(F.col(row).alias("row"), F.col(text_col).alias("text"))
    common = near_copies.common_shingles(texts, shingle_words)

    def prints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(t.as_py(), shingle_words) for t in batch.column(1)]
            sets = [shingle_set(h) for h in hashes]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.array([fingerprint(h) for h in hashes], dtype=np.uint64).view(np.int64)),
                    pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([s.size for s in sets], pa.int32()),
                    pa.array([near_copies.first_shingles(s, common, similarity) for s in sets], pa.list_(pa.int64())),
                    pa.array([near_copies.parity_bits(s) for s in sets], pa.list_(pa.int64())),
                ],
                names=["row", "fp", "digest", "n", "firsts", "bits"],
            )

    made = scratch.put(texts.mapInArrow(prints, "row long, fp long, digest binary, n int, firsts array<long>, bits array<long>"), "prints")
    ids = rows.select(F.col(row).alias("row"), F.col(id_col).alias("id"))
    least = made.select("row", "digest").join(ids.hint("merge"), "row").groupBy("digest").agg(F.min(F.struct("id", "row")).alias("least"))
    distinct = scratch.put(least.select(F.col("least.row").alias("row"), F.col("least.id").alias("id")), "distinct")
    each = near_copies.only(scratch, made, "row", distinct.select("row"), "copies").drop("digest")
    close = scratch.put(fingerprint_pairs(scratch, each.select("row", "fp"), cell, error_budget), "close")
    links = near_copies.near_links(scratch, each.drop("fp"), texts, close, shingle_words, similarity)
    scratch.drop("prints")
    roots = distinct.join(star_labels(links, scratch).withColumnRenamed("node", "row").hint("merge"), "row", "left")
    stay = roots.groupBy(F.coalesce("root", "row").alias("root")).agg(F.min(F.struct("id", "row")).alias("least"))
    stay = scratch.put(stay.select(F.col("least.row").alias(row)), "stay")
    return near_copies.only(scratch, rows, row, stay, "gone").drop(row)


def fingerprint_pairs(scratch: Scratch, prints: DataFrame, cell: int, error_budget: int) -> DataFrame:
    """Pairs (a, b) of rows that the trie links: rows with one fingerprint, and the first rows of linked ones."""
    first = scratch.put(prints.groupBy("fp").agg(F.min("row").alias("first"), F.count("*").alias("n")), "firsts_of_prints")
    more = prints.join(first.where("n > 1").hint("merge"), "fp").where("row != first").select(F.col("row").alias("a"), F.col("first").alias("b"))
    found = trie_links(Scratch(scratch.spark, "trie"), first.select("fp"), cell, error_budget)
    of = lambda end, name: first.select(F.col("fp").alias(end), F.col("first").alias(name)).hint("merge")
    linked = found.join(of("u", "x"), "u").join(of("v", "y"), "v").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    return more.unionByName(linked)


def hex_digits(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def trie_links(scratch: Scratch, distinct: DataFrame, cell: int = CELL, error_budget: int = ERROR_BUDGET) -> DataFrame:
    """Links (u, v) between the fingerprints in column ``fp``: enough of them to connect all within the budget."""
    prints = scratch.put(distinct, "distinct")
    pairs = scratch.put(scratch.spark.createDataFrame([(0, 0, 0)], "a long, b long, dist int"), "root")
    depth, bits, members, made = 0, _FIRST_BITS, [], ["root", "distinct"]
    while True:
        depth += bits
        node = F.shiftrightunsigned("fp", 64 - depth)
        under = prints if depth == bits else prints.join(_nodes_of(pairs), F.shiftrightunsigned("fp", 64 - depth + bits) == F.col("node"), "left_semi")
        nodes = scratch.put(under.groupBy(node.alias("node")).agg(F.count("*").alias("n")), f"nodes{depth}")
        pairs = scratch.put(descend(pairs, nodes, bits, error_budget).withColumn("pair", F.monotonically_increasing_id()), f"pairs{depth}")
        made += [f"nodes{depth}", f"pairs{depth}"]
        fits = (F.col("n_a") + F.when(F.col("a") == F.col("b"), 0).otherwise(F.col("n_b")) <= cell) | F.lit(depth == 64)
        ready = pairs.where(fits & ~((F.col("a") == F.col("b")) & (F.col("n_a") == 1)))
        sides = ready.select("pair", F.col("a").alias("node"), (F.col("dist") * 2).alias("flag")).unionByName(
            ready.where("a != b").select("pair", F.col("b").alias("node"), (F.col("dist") * 2 + 1).alias("flag"))
        )
        members.append(
            prints.withColumn("node", node)
            .join(sides, "node")
            .select(F.lit(depth).cast("byte").alias("depth"), "pair", F.col("flag").cast("byte").alias("flag"), "fp")
        )
        pairs = pairs.where(~fits)
        if pairs.isEmpty():
            break
        bits = _MORE_BITS

    def finish(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _finish_pair(key, rows, error_budget)

    links = reduce(DataFrame.unionByName, members).groupBy("depth", "pair").applyInPandas(finish, "u long, v long")
    links = scratch.put(links, "links")
    scratch.drop(*made)
    return links


def _nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def descend(pairs: DataFrame, nodes: DataFrame, bits: int, error_budget: int = ERROR_BUDGET) -> DataFrame:
    """Pairs of children, ``bits`` levels down, of pairs of nodes: only children that exist, within the budget."""
    left = nodes.select(F.col("node").alias("c"), F.col("n").alias("n_a"), F.shiftrightunsigned("node", bits).alias("a"))
    masks = F.array(*[F.lit(m) for m in sorted(range(1 << bits), key=int.bit_count) if m.bit_count() <= error_budget])
    wanted = (
        pairs.select("a", "b", "dist")
        .join(left, "a")
        .withColumn("mask", F.explode(masks))
        .select(
            (F.col("a") == F.col("b")).alias("same"),
            F.col("c").alias("a"),
            (F.shiftleft("b", bits) + F.col("c").bitwiseAND(F.lit((1 << bits) - 1)).bitwiseXOR(F.col("mask"))).alias("b"),
            "n_a",
            (F.col("dist") + F.bit_count("mask")).alias("dist"),
        )
        .where((F.col("dist") <= error_budget) & (~F.col("same") | (F.col("a") <= F.col("b"))))
    )
    return wanted.join(nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b")), "b").select("a", "b", "dist", "n_a", "n_b")


def _finish_pair(key: tuple, rows: pd.DataFrame, error_budget: int) -> pd.DataFrame:
    depth = int(key[0])
    fps, flags = rows["fp"].to_numpy().view(np.uint64), rows["flag"].to_numpy()
    dist, side = int(flags[0]) // 2, flags % 2
    left = np.sort(fps[side == 0])
    right = np.sort(fps[side == 1]) if side.any() else None
    leaves = left if right is None else np.concatenate([left, right])
    root = np.arange(leaves.size)
    for a, b in subtrie_pairs(left, right, depth, error_budget, dist):
        root = _merge(root, a, b if right is None else b + left.size)
    linked = np.flatnonzero(root != np.arange(root.size))
    return pd.DataFrame({"u": leaves[linked].view(np.int64), "v": leaves[root[linked]].view(np.int64)})


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after the links (a, b): each component's smallest place."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up


def subtrie_pairs(left: np.ndarray, right: np.ndarray | None, depth: int, budget: int, dist: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in left, in right) of fingerprints below two nodes at ``depth`` that differ in ``budget`` bits or fewer.

    The budget is for whole fingerprints; ``dist`` of their bits differ above the two nodes. Both arrays are sorted and
    distinct; without ``right`` the node is paired with itself. A node is a range of its array. Node pairs go down
    together, a bit at a time, in blocks of bounded size.
    """
    same = right is None
    right = left if same else right
    ones = {}

    def split(side: int, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
        if (side, bit) not in ones:
            ones[side, bit] = np.append(0, np.cumsum((((right, left)[side] >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)))
        count = ones[side, bit]
        return hi - (count[hi] - count[lo])

    one = np.array([0])
    stack = [(depth, np.stack([one, one + left.size, one, one + right.size, one + dist]))]
    while stack:
        depth, pairs = stack.pop()
        a_lo, a_hi, b_lo, b_hi, dist = pairs
        direct = ((a_hi - a_lo) * (b_hi - b_lo) <= _DIRECT) | (depth == 64)
        if direct.any():
            i, j = _products(*pairs[:4, direct])
            near = np.bitwise_count(left[i] ^ right[j]) <= budget
            if same:
                near &= i < j
            if near.any():
                yield i[near], j[near]
        pairs = pairs[:, ~direct]
        if not pairs.shape[1]:
            continue
        a_lo, a_hi, b_lo, b_hi, dist = pairs
        bit = 63 - depth
        a_mid, b_mid = split(1, a_lo, a_hi, bit), split(0, b_lo, b_hi, bit)
        twin = np.full(a_lo.shape, same) & (a_lo == b_lo) & (a_hi == b_hi)
        more = dist + 1
        down = np.concatenate(
            [
                np.stack([a_lo, a_mid, b_lo, b_mid, dist]),
                np.stack([a_mid, a_hi, b_mid, b_hi, dist]),
                np.stack([a_lo, a_mid, b_mid, b_hi, more]),
                np.stack([a_mid, a_hi, b_lo, b_mid, more])[:, ~twin],
            ],
            axis=1,
        )
        down = down[:, (down[0] < down[1]) & (down[2] < down[3]) & (down[4] <= budget)]
        for at in range(0, down.shape[1], _FRONTIER):
            stack.append((depth + 1, down[:, at : at + _FRONTIER]))


def _products(a_lo, a_hi, b_lo, b_hi) -> tuple[np.ndarray, np.ndarray]:
    """All places (i, j) of each pair of ranges."""
    wide = b_hi - b_lo
    count = (a_hi - a_lo) * wide
    pair = np.repeat(np.arange(count.size), count)
    nth = np.arange(pair.size) - np.repeat(np.cumsum(count) - count, count)
    return a_lo[pair] + nth // wide[pair], b_lo[pair] + nth % wide[pair]
