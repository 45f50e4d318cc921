import hashlib
import re

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from papyr.llm import common, simhash
from papyr.llm import exact_dedup as exact_dedup_module
from papyr.llm.components import connected_components
from papyr.llm.exact_dedup import drop_copies, exact_dedup
from papyr.llm.simhash import VantageTree, drop_near_duplicates, near_duplicates

from .common_cases import empty_docs, hard_docs, hard_rows


def norm(text):
    return re.sub(r"[\x20\x09-\x0d]+", " ", text or "")


def test_exact_dedup_against_brute_force(spark):
    rows = hard_rows()
    got = exact_dedup(hard_docs(spark)).collect()
    assert len(got) == len(rows)
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r[0])
    want = {}
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        want[hashlib.sha256(text.encode()).hexdigest()] = (min(known) if known else None, len(ids))
    assert {r.text_sha256: (r.keep_id, r.group_size) for r in got} == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups)  # one row a group, repeated rows and null ids included
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_dedup_hot_group_and_empty(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'same text' else concat('t ', id % 700) end as text").repartition(7)
    got = exact_dedup(docs).toPandas()
    assert got.kept.sum() == 701 and (got.kept == (got.doc_id == got.keep_id)).all()
    assert got[got.doc_id == 0].group_size.item() == 1000
    assert exact_dedup(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("piece,batch", [(1 << 16, 10000), (5, 3), (2, 7)])
def test_runs_that_edges_and_pieces_cut(spark, monkeypatch, piece, batch):
    """Few partitions, small batches and small pieces: every run is cut somewhere, and joined again."""
    monkeypatch.setattr(exact_dedup_module, "PIECE", piece)
    rows = [(i, ["same", "same  ", "other", f"t {i % 40}", None][i % 5] if i % 7 else "hot text") for i in range(400)] + [(None, "same"), (None, "null ids only"), (None, "null ids only"), (3, "same"), (3, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    want = {hashlib.sha256(t.encode()).hexdigest(): (min((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}
    for partitions in ("1", "3", "24"):
        with_conf(spark, {"spark.sql.shuffle.partitions": partitions, "spark.sql.execution.arrow.maxRecordsPerBatch": str(batch), "spark.sql.adaptive.coalescePartitions.enabled": "false"})
        got = exact_dedup(docs).collect()
        assert len(got) == len(rows) and {(r.text_sha256, r.keep_id, r.group_size) for r in got} == {(t, *w) for t, w in want.items()}
        kept = [(r.text_sha256, r.doc_id) for r in got if r.kept]
        assert sorted(kept, key=str) == sorted(((t, w[0]) for t, w in want.items()), key=str)


def with_conf(spark, settings):
    for k, v in settings.items():
        spark.conf.set(k, v)


@pytest.fixture(autouse=True)
def settings_as_before(spark):
    names = ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {n: spark.conf.get(n) for n in names}
    yield
    with_conf(spark, before)


def test_operators_keep_columns_that_are_named_like_their_own(spark):
    names = ["_id", "row", "digest", "fp", "n", "text_sha256", "_digest", "kept", "open"]
    rows = [(i, t, *(f"{c}{i}" for c in names)) for i, t in [(1, "one text of some words"), (2, "one  text of some words"), (3, "und noch ein ganz anderer text"), (3, "a repeated id with a text of its own"), (None, "no id")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    for drop in (drop_copies, drop_near_duplicates):
        for some, gone in ((docs, 2), (docs.where("doc_id < 3"), 2)):
            want = [r for r in some.collect() if r.doc_id != gone]
            got = drop(some)
            assert got.columns == docs.columns and sorted(got.collect(), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("parts", [1, 2, 4096])
def test_hot_keys_are_joined_like_the_others(spark, monkeypatch, parts):
    monkeypatch.setattr(common, "HOT_KEYS", parts)
    rows = spark.range(300).selectExpr("case when id % 3 = 0 then 7 else id end as k", "id")
    keyed = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("most"))
    got = sorted(map(tuple, common.join_by_hot_key(rows, keyed, "k", 300).select("k", "id", "most").collect()))
    assert got == sorted(map(tuple, rows.join(keyed.drop("n"), "k").select("k", "id", "most").collect())) and len(got) == 300
    edges = spark.createDataFrame([(0, i) for i in range(1, 60)] + [(i, i + 100) for i in range(50)], "a long, b long")
    assert {r.root for r in connected_components(edges).collect()} == {0}


def test_drop_copies_keeps_columns_and_one_of_each_text(spark):
    docs = hard_docs(spark)
    got = drop_copies(docs)
    assert sorted(got.columns) == sorted(docs.columns)
    assert sorted(norm(r.text) for r in got.collect()) == sorted({norm(r[1]) for r in hard_rows()})


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, ids):
    f = np.array(prints, np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 2
    label = np.array([i if i is not None else 1 << 60 for i in ids])
    while True:
        new = np.array([label[near[i]].min() for i in range(len(f))])
        if (new == label).all():
            return [None if x == 1 << 60 else x for x in label.tolist()]
        label = new


def test_near_duplicates_against_brute_force(spark):
    rows = hard_rows() + [(100 + i, "the quick brown fox jumps over the lazy dog " * 20 + " ".join(f"w{j}" for j in range(i % 5)), "en", "a", 0, True, 0.5, "x") for i in range(40)]
    prints = [brute_fingerprint(r[1]) for r in rows]
    want = sorted(((r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, brute_components(prints, [r[0] for r in rows]), strict=True)), key=str)
    got = near_duplicates(hard_docs(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    assert near_duplicates(empty_docs(spark)).count() == 0


def planted(n, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n).astype(np.uint64)
    for i in range(0, n - 3, 4):
        base[i + 1] = base[i] ^ (np.uint64(1) << np.uint64(i % 64))
        base[i + 2] = base[i + 1] ^ (np.uint64(3) << np.uint64(i % 60))
    base[-60:] = base[0] ^ (np.uint64(1) << np.arange(60, dtype=np.uint64))  # a dense ball
    return np.unique(base)


@pytest.mark.parametrize("shard,leaf,block", [(40, 8, 1 << 17), (40, 8, 64)])
def test_links_survive_every_split(spark, monkeypatch, shard, leaf, block):
    """Small shards, leaves and blocks force many splits: the components stay those of all pairs."""
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "BLOCK", block)
    items = planted(1500)
    frame = spark.createDataFrame([(int(x),) for x in items.view(np.int64)], "fp long")
    got = {r.node: r.root for r in connected_components(simhash.link_fingerprints(frame)).collect()}
    near = np.bitwise_count(items[:, None] ^ items[None, :]) <= 2
    label = items.view(np.int64).copy()
    while True:
        new = np.array([label[near[i]].min() for i in range(len(label))])
        if (new == label).all():
            break
        label = new
    want = {int(a): int(b) for a, b in zip(items.view(np.int64), label, strict=True) if (label == b).sum() > 1}
    assert got == want


def test_tree_routes_every_close_pair_together():
    items = planted(800, seed=5)
    tree = VantageTree.grow(items, 10)
    met = set()
    for _, at, own in tree.route(items, np.ones(len(items), bool)):
        for i in at[own]:
            met |= {(min(i, j), max(i, j)) for j in at}
    near = np.argwhere(np.triu(np.bitwise_count(items[:, None] ^ items[None, :]) <= 2, 1))
    assert {tuple(p) for p in near.tolist()} <= {(int(a), int(b)) for a, b in met}


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 160)] + [(200, 200), (None, 5), (301, 300), (300, 301)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(31)} | {i: 100 for i in range(100, 160)} | {300: 300, 301: 300}
    assert got == want


def test_drop_near_duplicates_keeps_one_of_each_component(spark):
    docs = hard_docs(spark)
    got = drop_near_duplicates(docs)
    assert got.columns == docs.columns
    kept = [r.doc_id for r in got.collect()]
    assert 1 in kept and 2 not in kept and 3 in kept and 4 not in kept and 5 not in kept


def test_drop_near_duplicates_tells_the_rows_of_an_id_apart(spark):
    fox = "the quick brown fox jumps over the lazy dog " * 20
    rows = [
        (3, fox, "first"), (7, fox + "w0", "near 3"),  # a component of two ids
        (7, "der hund und die katze und das haus", "clean"), (9, "der hund  und die katze und das haus", "near 7"),
        (7, "pack my box with five dozen jugs of liquor", "clean"), (7, "pack my  box with five dozen jugs of liquor", "same id and print"),
        (None, "a row without an id", "null"), (None, "a row  without an id", "null"), (None, "a row\nwithout an id", "null"), (None, "a row\nwithout an id", "null"),
        (None, "another row that has no id", "lone null"), (None, fox, "near 3"),
        (11, None, "empty"), (11, "", "empty"), (12, "  ", "empty"),
    ]
    prints = [brute_fingerprint(t) for _, t, _ in rows]
    assert len(set(brute_components(prints, [r[0] for r in rows]))) == 4 and np.bitwise_count(np.uint64(prints[0] ^ prints[1])) <= 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, note string").repartition(3)
    got = [(r.doc_id, r.note) for r in drop_near_duplicates(docs).collect()]
    by_text = {(i, norm(t)) for i, t, _ in ((r.doc_id, r.text, r.note) for r in drop_near_duplicates(docs).collect())}
    assert by_text == {(3, norm(fox)), (7, "der hund und die katze und das haus"), (7, "pack my box with five dozen jugs of liquor"), (None, "a row without an id"), (None, "another row that has no id"), (11, "")}
    assert len(got) == len(by_text)
    assert drop_near_duplicates(empty_docs(spark)).count() == 0
