import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from weftline.llm import bitfilter, components, exact_dedup, line_dedup, near_copies, queries, shingles, simhash_dedup
from weftline.llm.scratch import Scratch


def normal(text):
    return (text or "").encode().lower()


def null_first(x):
    return (x is not None, x or 0)


def test_exact_groups_against_brute_force(odd_docs, odd_rows):
    groups = defaultdict(list)
    for r in odd_rows:
        groups[normal(r[1])].append(r[0])
    got = exact_dedup.exact_groups(odd_docs).collect()
    expected = Counter()
    for text, ids in groups.items():
        for i in ids:
            expected[(i, max(ids, key=null_first), len(ids), hashlib.sha256(text).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_groups_many_levels(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FIRST_DIGIT_BYTES", 2)
    monkeypatch.setattr(exact_dedup, "DIGIT_GROWTH", 2)
    texts = ["abcdefghij" * 4, "abcdefghij" * 4, "abcdefghij" * 4 + "x", "abcdefghij", "ab", "a", "ab"]
    got = exact_dedup.exact_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.keep_id for r in got} == {0: 1, 1: 1, 2: 2, 3: 3, 4: 6, 5: 5, 6: 6}


def test_exact_groups_empty(no_docs):
    assert exact_dedup.exact_groups(no_docs).collect() == []


def brute_simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", normal(text))
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_in_parts(monkeypatch, odd_rows):
    for size in (1, 3, 1000):
        monkeypatch.setattr(shingles, "_AT_ONCE", size)
        assert all(simhash_dedup.simhash(r[1]) == brute_simhash(r[1]) for r in odd_rows if len(r[1] or "") < 10_000)


def brute_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def test_near_components_against_brute_force(odd_docs, odd_rows):
    prints = [brute_simhash(r[1]) for r in odd_rows]
    roots = brute_components(prints)
    least = {}
    for r, root in zip(odd_rows, roots, strict=True):
        if r[0] is not None:
            least[root] = min(least.get(root, r[0]), r[0])
    expected = Counter((r[0], p, least.get(root)) for r, p, root in zip(odd_rows, prints, roots, strict=True))
    for cell in (1, 4, simhash_dedup.CELL):
        got = simhash_dedup.near_components(odd_docs, cell=cell).collect()
        assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == expected


def test_links_across_the_first_bits(spark):
    bases = np.random.default_rng(11).integers(0, 2**63, 64, dtype=np.uint64)
    bits = [(i, j) for i in (63, 62, 61, 60, 58, 33, 0) for j in (62, 60, 57, 20, 1) if i != j]
    pairs = {(int(b), int(b) ^ (1 << i) ^ (1 << j)) for b, (i, j) in zip(bases, bits, strict=False)}
    signed = [(x - (x >> 63 << 64),) for pair in pairs for x in pair]
    for cell in (1, 4, simhash_dedup.CELL):
        links = simhash_dedup.trie_links(Scratch(spark, "test"), spark.createDataFrame(signed, "fp long"), cell).collect()
        assert {frozenset((r.u % 2**64, r.v % 2**64)) for r in links} == set(map(frozenset, pairs))


def test_op2_links_texts_that_differ_in_the_first_bits(spark, tmp_path):
    words = [f"w{x}" for x in np.random.default_rng(7).integers(0, 1000, 200)]
    changed = [" ".join([*words[:at], new, *words[at + 1 :]]) for at, new in ((6, "y"), (17, "z"))]
    texts = [" ".join(words), *changed, "something else"]
    prints = [brute_simhash(t) for t in texts]
    assert all((p ^ prints[0]).bit_count() == 2 and (p ^ prints[0]) >> 60 for p in prints[1:3])
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: (f"{p:016x}", root) for i, (p, root) in enumerate(zip(prints, (0, 0, 0, 3), strict=True))}


def test_no_components_without_rows(no_docs):
    assert simhash_dedup.near_components(no_docs).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=30), st.data())
def test_subtrie_pairs(bases, data):
    flips = data.draw(st.lists(st.tuples(st.sampled_from(bases), st.integers(0, 63), st.integers(0, 63)), max_size=30))
    prints = np.array(sorted({*bases, *(b ^ (1 << i) ^ (1 << j) for b, i, j in flips)}), dtype=np.uint64)
    got = {(i, j) for a, b in simhash_dedup.subtrie_pairs(prints, None, 0, 2) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    assert got == {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if (int(prints[i]) ^ int(prints[j])).bit_count() <= 2}
    left, right = prints[::2], prints[1::2]
    if right.size:
        got = {(i, j) for a, b in simhash_dedup.subtrie_pairs(left, right, 0, 1) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        assert got == {(i, j) for i in range(len(left)) for j in range(len(right)) if (int(left[i]) ^ int(right[j])).bit_count() <= 1}


def test_star_labels_of_a_chain(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)]
    got = components.star_labels(spark.createDataFrame(links, "u long, v long"), Scratch(spark, "test")).collect()
    assert {r.node: r.root for r in got} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100} and len(got) == 43


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute_lines(rows, near_chars):
    """Texts without lines that equal or nearly equal an earlier one."""
    key = lambda d: (d is not None, d or 0)
    places = [(key(d), xxhash.xxh64_intdigest(t), k, line.strip(" "), n) for n, (d, t) in enumerate(rows) if t is not None for k, line in enumerate(t.split("\n"))]
    first = {}
    for d, _, k, line, _ in places:
        if line:
            first[line] = min(first.get(line, (d, k)), (d, k))
    near = {a for a in first for b in first if first[b] < first[a] and min(len(a), len(b)) >= near_chars and abs(len(a) - len(b)) < 2 and edit_distance(a, b) == 1}
    out = []
    for n, (d, t) in enumerate(rows):
        if t is None:
            out.append((d, None, 0, 0, 0))
            continue
        lines = t.split("\n")
        exact = [bool(x.strip(" ")) and first[x.strip(" ")] != (key(d), k) for k, x in enumerate(lines)]
        close = [x.strip(" ") in near and not e for x, e in zip(lines, exact, strict=True)]
        kept = [x for x, e, c in zip(lines, exact, close, strict=True) if not e and not c]
        out.append((d, "\n".join(kept), sum(bool(x.strip(" ")) for x in lines), sum(exact), sum(close)))
    return out


def test_line_dedup_against_brute_force(spark):
    import random

    rng = random.Random(3)
    base = ["".join(rng.choice("abcde é") for _ in range(n)).strip() + "x" for n in (0, 1, 2, 4, 8, 15, 17, 30, 65, 129, 300)]
    rows = []
    for d in range(25):
        lines = []
        for _ in range(rng.randint(0, 5)):
            line = rng.choice(base)
            if rng.random() < 0.7:
                i = rng.randrange(len(line))
                line = line[:i] + rng.choice(["", "z", "z" + line[i : i + 1]]) + line[i + 1 :]
            lines.append(rng.choice(["", " "]) + line)
        rows.append((d, "\n".join(lines + ["", "  "][: rng.randint(0, 2)])))
    rows += [(None, base[6]), (98, None), (99, ""), (100, "q"), (101, "qq"), (102, "ab\nba\nabc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (1, 20):
        got = line_dedup.dedup_lines(docs, near_chars=least).collect()
        assert Counter(map(tuple, got)) == Counter(brute_lines(rows, least))


def test_line_dedup_odd_rows(odd_docs, odd_rows, no_docs):
    got = line_dedup.dedup_lines(odd_docs)
    assert got.columns == [*odd_docs.columns, "n_lines", "n_exact", "n_near"]
    some = [(r[0], r[1]) for r in odd_rows]
    first = min((null_first(d), r) for d, r in some if r == odd_rows[0][1])
    kept = Counter(r.text for r in got.collect())
    assert sum(kept.values()) == len(odd_rows) and kept[first[1]] == sum(r == first[1] and null_first(d) == first[0] for d, r in some)
    assert line_dedup.dedup_lines(no_docs).collect() == []


def test_long_line_within_one_edit(spark):
    line = "".join(chr(97 + i * i % 23) for i in range(20_000))
    rows = [(1, line), (2, line[:9000] + "Z" + line[9000:]), (3, line[:9000] + "ZZ" + line[9001:])]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_near for r in got} == {1: 0, 2: 1, 3: 1}


def test_bit_filter(spark):
    from pyspark.sql import functions as F

    scratch = Scratch(spark, "test")
    bits = bitfilter.bit_table(scratch, spark.range(0, 500, 5), F.xxhash64("id"), "bits")
    rows = spark.range(500)
    there = {r.id for r in bitfilter.maybe_in(rows, F.xxhash64("id"), bits).collect()}
    gone = {r.id for r in bitfilter.maybe_in(rows, F.xxhash64("id"), bits, False).collect()}
    assert there | gone == set(range(500)) and not there & gone and there >= set(range(0, 500, 5)) and len(there) < 110


def brute_near(texts):
    """Kept places: the first of each component of texts whose five-word shingles have a Jaccard similarity of 0.8."""
    sets = []
    for t in texts:
        words = normal(t).split()
        k = min(5, len(words))
        sets.append({b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set())
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return set(root)


def test_near_copies_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [None, "", "a b", "A  b", "a b c"]
    for size in (8, 20, 60, 200):
        for _ in range(6):
            words = [f"w{x}" for x in rng.integers(0, 500, size)]
            texts.append(" ".join(words))
            for changes in (1, 1, 2, 3, 6, 10):
                copy = list(words)
                for at in rng.integers(0, size, changes):
                    copy[at] = "changed"
                texts.append(" ".join(copy + ["x"] * int(rng.integers(0, 3))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = brute_near(texts)
    assert len(set(map(normal, texts))) - 20 > len(expected)
    for common in (3, 10_000):
        monkeypatch.setattr(near_copies, "COMMON", common)
        assert {r.doc_id for r in simhash_dedup.one_of_each(docs).collect()} == expected


def test_near_copies_odd_rows(odd_docs, odd_rows, no_docs):
    got = simhash_dedup.one_of_each(odd_docs)
    assert got.columns == odd_docs.columns and got.count() == len(brute_near([r[1] for r in odd_rows]))
    assert simhash_dedup.one_of_each(no_docs).collect() == []


def test_rough_comparison_only_overrates():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 60, rng.integers(1, 50)) * (1 << 29) + rng.integers(0, 2)) for _ in range(2))
        both = np.intersect1d(a, b).size
        assert near_copies.in_common(a, b) == both
        assert near_copies.in_common(np.sort(a.astype(np.int16)), np.sort(b.astype(np.int16))) >= both


def test_parity_bits_never_overrate_a_difference():
    rng = np.random.default_rng(2)
    pool = rng.integers(-(2**63), 2**63, 3000)
    for n, m in ((0, 0), (0, 5), (1, 1), (64, 65), (100, 120), (100, 3000), (1025, 900)):
        a, b = (np.unique(rng.choice(pool, size, replace=False)) for size in (n, m))
        x, y = map(near_copies.parity_bits, (a, b))
        differ = near_copies.apart(x, y)
        assert differ == near_copies.apart(y, x) <= np.setxor1d(a, b).size and near_copies.apart(x, x) == 0
        assert differ >= 0.1 * np.setxor1d(a, b).size or n + m > 10 * min(n, m)


def test_texts_that_share_a_passage_meet_once(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "COMMON", 10_000)
    made, compared = [], near_copies.compared
    monkeypatch.setattr(near_copies, "compared", lambda scratch, pairs, *more: made.append(pairs.count()) or compared(scratch, pairs, *more))
    passage = [f"p{i}" for i in range(40)]
    texts = [" ".join([*passage, *[f"w{k}_{i}" for i in range(60)]]) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert simhash_dedup.one_of_each(docs).count() == 60 and made[-1] <= 60 * 59 // 2


def test_a_large_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    made, compared = [], near_copies.compared
    monkeypatch.setattr(near_copies, "compared", lambda scratch, pairs, *more: made.append(pairs.distinct().count()) or compared(scratch, pairs, *more))
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 500, 145)]
    texts = [" ".join(base)]
    for k in range(400):
        words = list(base)
        for at in rng.integers(0, 145, 1 + k % 3):
            words[at] = f"x{rng.integers(0, 500)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash_dedup.one_of_each(docs).collect()} == brute_near(texts) and sum(made) <= 8 * len(texts), made


def test_the_trie_proposes_close_pairs(spark):
    from pyspark.sql import functions as F

    prints = [(1, 0), (2, 0), (3, 7), (4, 5), (5, 1 << 40), (6, 255)]
    rows = spark.createDataFrame(prints, "row long, fp long").withColumn("fp", F.col("fp"))
    pairs = simhash_dedup.fingerprint_pairs(Scratch(spark, "test"), rows, 8, 2).distinct().collect()
    root = {k: k for k, _ in prints}
    for p in pairs:
        x, y = root[p.a], root[p.b]
        root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    assert root == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6}


def test_pipeline_drops_near_copies(spark):
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, "something else")], "doc_id long, text string")
    stay = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "")
    assert sorted(r.doc_id for r in stay.collect()) == [1, 3]
