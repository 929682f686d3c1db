import datetime
import hashlib
import math
import random
import re
import tempfile
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import pytest

import corpus_pipeline
from weftline.llm import mixing, queries, scratch, sharding, url_filter

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(rel.columns)
    assert Counter(tuple(r[c] for c in rel.columns) for r in got.collect()) == Counter(rel.fetchall())


def test_all_ten_are_registered():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)]


def share(budget, children):
    """Exact water-filling: children are (weight, capacity); whole tokens at the end."""
    order = sorted(children, key=lambda c: Fraction(c[2], c[1]))
    out, left, weight = {}, budget, sum(c[1] for c in children)
    for k, (name, w, cap) in enumerate(order):
        if cap * weight <= w * left:
            out[name], left, weight = cap, left - cap, weight - w
        else:
            out |= {n: v * left // weight for n, v, _ in order[k:]}
            break
    return out


def test_budgets_against_brute_force(spark):
    leaves = [("web", "en", "s0", 1000), ("web", "en", "s3", 10), ("web", "de", "s0", 5), ("books", "en", "s1", 400), ("books", "fr", "s1", 30), ("code", "en", "s2", 3), ("code", "", "", 0)]
    table = spark.createDataFrame([(*x, 1) for x in leaves], "domain string, lang string, source string, tokens long, docs long")
    for percent in (10, 60, 150, 250):
        plan = mixing.share_budget(table, mixing.WEIGHTS, percent, 2).collect()
        got = {(r.domain, r.lang, r.source): r.passes * r.tokens + r.rest for r in plan}
        budgets = {(): sum(x[3] for x in leaves) * percent // 100}
        for depth, level in enumerate(mixing.LEVELS):
            caps = defaultdict(int)
            for x in leaves:
                caps[x[: depth + 1]] += 2 * x[3]
            for parent, budget in list(budgets.items()):
                if len(parent) == depth:
                    children = [(p, mixing.WEIGHTS[level].get(p[-1], 1), c) for p, c in caps.items() if p[:-1] == parent]
                    budgets |= share(budget, children)
        assert got == {k: v for k, v in budgets.items() if len(k) == 3}


def test_a_weight_of_zero_takes_nothing(spark):
    leaves = [("web", "en", "s0", 100, 1), ("books", "en", "s1", 100, 1), ("books", "de", "s1", 40, 1)]
    table = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long, docs long")
    shares = lambda w, p: {r.domain + r.lang: r.passes * r.tokens + r.rest for r in mixing.share_budget(table, w, p, 1).collect()}
    assert shares({"domain": {"web": 0}}, 50) == {"weben": 0, "booksen": 80, "booksde": 40}
    assert shares({"lang": {"de": 0}}, 90) == {"weben": 100, "booksen": 100, "booksde": 0}


def test_prefixes_do_not_depend_on_buckets(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (i % 7), "en", "src0") for i in range(300)], "doc_id long, text string, lang string, source string")
    taken = lambda: sorted((r.doc_id, r.copies) for r in mixing.mix(docs).collect())
    once = taken()
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 4)
    assert taken() == once and 0 < len(once) < 300
    monkeypatch.setattr(mixing, "RUN_BITS", 2)
    assert taken() == once


def test_rows_of_one_id_are_taken_together(spark):
    rows = [(None, "w w", "en", "src0")] * 40 + [(i, "w", "en", "src0") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = [r for r in mixing.mix(docs, budget_percent=50).collect()]
    assert sum(len(r.text.split()) * r.copies for r in got) <= 240
    assert sum(r.doc_id is None for r in got) in (0, 40)


def test_mix_odd_rows(odd_docs, no_docs):
    got = mixing.mix(odd_docs)
    assert got.columns == [c for c in odd_docs.columns if c != "copies"] + ["copies"] and got.count() > 0
    assert mixing.mix(no_docs).collect() == []


def test_shards_round_trip(spark, odd_docs, no_docs):
    many = odd_docs.repartition(9)
    store = sharding.shard(many, target_bytes=1 << 20, fan_in=3)
    assert store.versions() == [1, 2] and store.manifest().count() < 9
    assert store.read().exceptAll(odd_docs).isEmpty() and odd_docs.exceptAll(store.read()).isEmpty()
    assert store.read().columns == odd_docs.columns
    assert store.append(odd_docs.limit(3)) == 3 and store.read().count() == odd_docs.count() + 3
    assert sharding.shard(no_docs).read().collect() == []


def test_a_version_is_committed_once(spark, odd_docs):
    store = sharding.shard(odd_docs)
    base = store.versions()[-1]
    store.commit(store.manifest(), store.schema(), base)
    with pytest.raises(Exception, match="[Ee]xist"):
        store.commit(store.manifest(), store.schema(), base)


def test_shards_are_packed_to_the_target(spark, odd_docs):
    store = sharding.shard(odd_docs.repartition(12), target_bytes=150_000, fan_in=2)
    rows = store.manifest().collect()
    assert len({r.shard_id for r in rows}) == len(rows) and sum(r.rows for r in rows) == odd_docs.count()


def merged_by_hand(sizes, target, fan_in):
    """The shards (in the order of their ids) that one compaction puts together: sets of places."""
    tier = lambda n: math.floor(math.log(max(n, sharding.SMALLEST_BYTES) / sharding.SMALLEST_BYTES) / math.log(fan_in))
    tiers = defaultdict(list)
    for k, n in enumerate(sizes):
        if n < target / 2:
            tiers[tier(n)].append(k)
    files = defaultdict(set)
    for t, places in tiers.items():
        before = 0
        for k in places if len(places) >= fan_in else []:
            files[t, before // target].add(k)
            before += sizes[k]
    return {frozenset(f) for f in files.values()}


def test_compaction_against_a_model(spark):
    rng = random.Random(8)
    for fan_in, target in ((3, 400_000), (4, 1 << 20), (2, 200_000)):
        store = sharding.ShardStore(spark, tempfile.mkdtemp(prefix="shards-"))
        schema = spark.range(1).selectExpr("id as doc_id", "'' as text").schema
        rows = [(k + 1, f"shards/a-{k:032x}/p.parquet", 1, int(2 ** rng.uniform(12, 20))) for k in range(30)]
        store.commit(spark.createDataFrame(rows, "shard_id long, path string, rows long, bytes long"), schema, 0)
        place = {r[1]: k for k, r in enumerate(rows)}
        files = defaultdict(set)
        for r in store.plan(target, fan_in).collect():
            files[r.merged].add(place[r.path])
        assert {frozenset(f) for f in files.values()} == merged_by_hand([r[3] for r in rows], target, fan_in)


def test_compaction_reads_only_what_is_due(spark, odd_docs, monkeypatch):
    store = sharding.ShardStore(spark, tempfile.mkdtemp(prefix="shards-"))
    for _ in range(3):
        store.append(odd_docs.limit(5).coalesce(1))
    store.append(odd_docs.repartition(1))
    held = {r.path: r.bytes for r in store.manifest().collect()}
    target = max(held.values()) * 2
    due = {r.path for r in store.plan(target, 3).collect()}
    assert due == {p for p, n in held.items() if n < max(held.values())} and len(due) == 3
    read, files = [], sharding.ShardStore.read_files
    monkeypatch.setattr(sharding.ShardStore, "read_files", lambda self, paths, *more: read.append(paths) or files(self, paths, *more))
    assert store.compact(target, 3) and [set(p) for p in read] == [due]
    left = {r.path for r in store.manifest().collect()}
    assert len(left) == 2 and not left & due
    assert store.read().count() == 15 + odd_docs.count()


def test_few_shards_at_a_time(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(sharding, "DUE_SHARDS", 4)
    store = sharding.shard(odd_docs.repartition(9), target_bytes=1 << 20, fan_in=3)
    assert store.versions()[-1] > 2 and store.read().exceptAll(odd_docs).isEmpty() and store.read().count() == odd_docs.count()


def test_shard_report(odd_docs, odd_rows):
    got = sharding.shard_report(odd_docs, *odd_docs.columns).collect()
    sizes = Counter(r.shard_id for r in got)
    assert len(got) == len(odd_rows) and all(r.shard_rows == sizes[r.shard_id] for r in got)


def test_url_filter(spark):
    day = datetime.date
    entries = [("bad.com", "add", day(2024, 1, 10)), ("bad.com", "remove", day(2024, 1, 20)), ("bad.com", "add", day(2024, 1, 20)), ("bad.com", "add", day(2024, 2, 1))]
    entries += [("Ok.org/a/b/", "add", day(2024, 1, 1)), ("x.bad.com", "add", day(2024, 1, 1)), (None, "add", day(2024, 1, 1)), ("net", "add", None)]
    urls = ["http://bad.com/", "https://y.bad.com:80/p?q#f", "http://u@X.bad.com", "http://notbad.com", "http://ok.org/a/b/c", "http://ok.org/a/bc", "http://sub.ok.org/a/b/", None, "", "nonsense"]
    rows = [(k, u, day(2024, 1, d)) for k, (u, d) in enumerate([(u, d) for u in urls for d in (5, 15, 20, 25)])] + [(99, "http://bad.com", None), (100, "http://bad.com", day(2024, 2, 1))]
    captures = spark.createDataFrame(rows, "page_id long, url string, day date").selectExpr("*", "1 as capture", "'x' as pattern")
    from pyspark.sql import functions as F

    got = url_filter.filter_urls(captures, spark.createDataFrame(entries, "pattern string, action string, day date"), day=F.col("day"))
    blocked = {r.page_id: r.pattern for r in got.collect() if r.blocked}
    expected = {}
    for k, u, d in rows:
        listed = d is not None and (day(2024, 1, 10) <= d < day(2024, 1, 20) or d >= day(2024, 2, 1))
        if u in ("http://bad.com/", "http://bad.com", "https://y.bad.com:80/p?q#f") and listed:
            expected[k] = "bad.com"
        if u == "http://u@X.bad.com":
            expected[k] = "x.bad.com"
        if u == "http://ok.org/a/b/c":
            expected[k] = "ok.org/a/b/"
    assert blocked == expected and got.count() == len(rows)
    assert url_filter.url_report(captures.limit(0)).collect() == []


def test_very_long_urls(spark):
    long = "http://" + "a." * 30_000 + "bad.com/" + "s/" * 30_000
    rows = [(1, long), (2, "http://ok.org/a/b/" + "x" * 100_000), (3, "http://" + "a" * 50_000), (4, "http://h.org" + "/" * 50_000)]
    captures = spark.createDataFrame(rows, "page_id long, url string")
    listed = [("bad.com", "add"), ("ok.org/a/b/", "add"), ("ok.org/", "add"), ("h.org///", "add"), ("q" * 300 + ".org", "add"), ("k.org/" + "s/" * 40, "add")]
    entries = spark.createDataFrame(listed, "pattern string, action string").selectExpr("*", "date'2023-01-01' as day")
    got = {r.page_id: r.pattern for r in url_filter.filter_urls(captures, entries).collect()}
    assert got == {1: "bad.com", 2: "ok.org/a/b/", 3: None, 4: "h.org///"}
    assert url_filter.filter_urls(captures, entries.limit(0)).where("blocked").isEmpty()


def test_scratch_needs_a_shared_folder_off_local_mode(spark):
    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        scratch.shared_dir(Cluster)


def test_mix_against_brute_force(spark, odd_docs, odd_rows):
    """Copies of each row: whole passes, and the longest prefix in the order of a pass that fits the rest."""
    leaf = lambda r: (["web", "books", "code"][int((re.search("[0-9]{1,9}$", r[3] or "") or [0])[0]) % 3], r[2] or "", r[3] or "")
    tokens = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    leaves = defaultdict(list)
    for r in odd_rows:
        leaves[leaf(r)].append(r)
    table = spark.createDataFrame([(*k, sum(map(tokens, rows)), len(rows)) for k, rows in leaves.items()], "domain string, lang string, source string, tokens long, docs long")
    expected = Counter()
    for p in mixing.share_budget(table, mixing.WEIGHTS, mixing.BUDGET_PERCENT, mixing.MAX_EPOCHS).collect():
        order = defaultdict(list)
        for r in leaves[p.domain, p.lang, p.source]:
            order[hashlib.md5(f"{mixing.SEED}:{p.passes}:{'' if r[0] is None else r[0]}".encode()).hexdigest()].append(r)
        used, fits = 0, True
        for _, rows in sorted(order.items()):
            used += sum(map(tokens, rows))
            fits = fits and p.rest > 0 and used <= p.rest
            for r in rows:
                expected[r[0], r[1], p.passes + fits] += 1
    got = Counter((r.doc_id, r.text, r.copies) for r in mixing.mix(odd_docs).collect())
    assert got == Counter({k: n for k, n in expected.items() if k[2]})


def test_pipeline(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = stages["language_id"](spark, docs, SF)
    assert known.columns == docs.columns and known.count() > 0.9 * docs.count()
    unique = stages["simhash_near_dedup"](spark, known, SF)
    clean = stages["decontamination"](spark, unique, SF)
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = lambda rows: {r.doc_id for r in rows if any(i in " ".join(r.text.lower().split()) for i in items)}
    before, after = unique.collect(), clean.collect()
    assert not leaks(after) and {r.doc_id for r in before} - {r.doc_id for r in after} == leaks(before)
    mixed = stages["mixing"](spark, clean, SF)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in after}
    got = corpus_pipeline.run(spark, SF)
    assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in mixed.collect())
