import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from mapweave.llm import common, components, exact_dedup, similar, simhash
from mapweave.llm.exact_dedup import CuckooIndex


def docs(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + extra)


def test_index_inserts_deletes_and_grows():
    rng = np.random.default_rng(1)
    index, live = CuckooIndex(4), 0
    for k in range(12):
        words = rng.integers(0, 2**63, (3000, 4)).astype(np.uint64)
        index.insert(words, np.arange(3000), np.ones(3000, np.int64))
        assert (index.find(words) >= 0).all()
        if k % 2:
            assert index.delete(words[:1000]).all()
            assert (index.find(words[:1000]) < 0).all() and (index.find(words[1000:]) >= 0).all()
            live -= 1000
        live += 3000
    assert int(index.live.sum()) == live and len(index.prints) > 4


def test_fingerprint_alone_never_decides():
    index = CuckooIndex(4)
    a = np.array([[1, 5 << 48, 7, 9]], np.uint64)
    b = np.array([[1, 5 << 48, 7, 8]], np.uint64)
    index.insert(a, np.array([3]), np.array([1]))
    assert index.find(a)[0] == 0 and index.find(b)[0] == -1


ROWS = [(5, "a"), (2, "a"), (9, "a "), (3, None), (4, ""), (None, "z"), (7, "x" * 300_000), (8, "x" * 300_000), (2, "b")]


def test_copies(spark):
    got = {(r["doc_id"], r["text_sha256"]): r for r in exact_dedup.find_copies(docs(spark, ROWS)).collect()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert len(got) == len(ROWS)
    for i, t in ROWS:
        r = got[i, sha(t)]
        group = [j for j, u in ROWS if (u or "") == (t or "")]
        top = max((j for j in group if j is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (top, len(group), top == i)


def test_drop_copies_keeps_other_columns(spark):
    rows = [(1, "a", "k", 1), (2, "a", "k", 2), (3, "b", None, 3)]
    out = exact_dedup.drop_copies(docs(spark, rows, ", digest string, n int"))
    assert out.columns == ["doc_id", "text", "digest", "n"] and {r["doc_id"] for r in out.collect()} == {2, 3}


def test_deletion_of_digests(spark):
    rows = exact_dedup.digests(docs(spark, [(1, "a"), (2, "a"), (3, "b")]))
    index = exact_dedup.update_index(None, rows)
    later = exact_dedup.update_index(index, exact_dedup.digests(docs(spark, [(9, "c"), (8, "b")])), exact_dedup.digests(docs(spark, [(0, "a")])))
    assert {(r["id"], r["n"]) for r in later.collect()} == {(8, 2), (9, 1)}


def test_empty_tables(spark):
    none = docs(spark, [])
    assert exact_dedup.find_copies(none).count() == 0
    assert simhash.find_near(none).count() == 0


def brute(prints, distance=4):
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(prints)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = [(1000, None), (1001, ""), (1002, "\t "), (1003, "One two"), (1004, "one  TWO"), (1005, "Ä ä b c d")]
    for k in range(30):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([60, 400]))]
        for c in range(6):
            edited = list(words)
            for _ in range(c):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            rows.append((k * 10 + c, " ".join(edited)))
    got = {r["doc_id"]: r for r in simhash.find_near(docs(spark, rows)).collect()}
    prints = {i: simhash.fingerprint(t) for i, t in rows}
    want = brute(prints)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(got[i]["fingerprint"] == f"{p:016x}" for i, p in prints.items())
    assert prints[1000] == prints[1001] == prints[1002] == 0 and prints[1003] == prints[1004]
    assert len(set(want.values())) < len(rows) - 30


def test_prefixes_with_many_rows_are_dealt_anew(spark, monkeypatch):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    prints = {k: base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for k in range(400)}
    uniq = {}
    for i, p in prints.items():
        uniq.setdefault(p, i)
    signed = [(p - (1 << 64) if p >> 63 else p, i) for p, i in uniq.items()]
    nodes = spark.createDataFrame(signed, "fp long, id long")
    monkeypatch.setattr(simhash, "GROUP_ROWS", 30)
    edges = simhash.near_edges(nodes, 4, 8)
    labels = {r["node"]: r["component"] for r in components.components(edges).collect()}
    want = brute({i: p for p, i in uniq.items()})
    assert {i: labels.get(i, i) for i in want} == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 200), (5, 5)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[k] == 100 for k in range(100, 160)) and got[201] == 200


@settings(max_examples=30, deadline=None)
@given(st.text(max_size=60))
def test_fingerprint_folds_ascii_case_only(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    assert simhash.fingerprint(text) == simhash.fingerprint(folded)


def test_ids_tie_no_texts_together(spark):
    """Repeated and null ids name rows of far-apart fingerprints."""
    texts = [" ".join(f"{c}{k}" for k in range(200)) for c in "abcd"]
    rows = [(None, texts[0]), (None, texts[1]), (5, texts[1]), (5, texts[2]), (7, texts[2]), (9, texts[3]), (8, texts[3]), (None, texts[3])]
    got = simhash.find_near(docs(spark, rows))
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got.collect()) == sorted([("None", "None"), ("None", "5"), ("5", "5"), ("5", "5"), ("7", "5"), ("9", "8"), ("8", "8"), ("None", "8")])
    kept = simhash.drop_near(docs(spark, rows).selectExpr("*", "1 as fp", "2 as component_id")).collect()
    assert sorted((str(r["doc_id"]), r["text"][0]) for r in kept) == [("5", "b"), ("5", "c"), ("8", "d"), ("None", "a")]


def test_odd_distance_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.find_near(docs(spark, []), distance=3)


def test_keep_smallest_of_near(spark):
    text = " ".join(f"a{k}" for k in range(500))
    out = simhash.drop_near(docs(spark, [(9, text), (4, text + " tail"), (6, "other words stand here now")]).withColumn("id", F.lit("x")))
    assert {r["doc_id"] for r in out.collect()} == {4, 6} and out.columns == ["doc_id", "text", "id"]


def test_the_stage_drops_similar_texts(spark):
    rng = random.Random(7)
    rows = [(1000, None), (1001, ""), (1002, "One two"), (1003, "one  TWO")]
    for k in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 120, 500]))]
        for c in range(8):
            edited = list(words)
            for _ in range(rng.randrange(1 + len(words) // 40)):
                edited[rng.randrange(len(edited))] = f"x{rng.randrange(5000)}"
            rows.append((k * 10 + c, " ".join(edited)))
    sets = {i: similar.shingles(t) for i, t in rows}
    ids, label = sorted(sets), {}
    for i in ids:  # smallest first, so labels are the smallest of what is linked
        near = {label[j] for j in label if similar.similarity(sets[i], sets[j]) >= 0.8}
        label[i] = min(near, default=i)
        label = {j: label[i] if x in near else x for j, x in label.items()}
    got = {r["doc_id"] for r in corpus_pipeline.near(spark, docs(spark, rows), "").collect()}
    assert got == set(label.values()) and len(got) < len(rows) - 100


def test_a_bucket_starts_from_its_smallest(spark):
    rows = [(1, k) for k in range(6)] + [(2, 9)]
    star = similar._stars(spark.createDataFrame(rows, "key long, node long")).collect()
    assert {(r["u"], r["v"]) for r in star} == {(k, 0) for k in range(1, 6)}


def test_all_members_of_a_large_bucket_with_other_labels_meet(spark, monkeypatch):
    """One label has two thirds of a bucket, others a few members or one; all pairs of blocks hold all pairs of labels, none twice."""
    monkeypatch.setattr(similar, "BLOCK", 8)
    label = {k: 0 if k < 60 else k // 7 if k < 80 else k for k in range(90)}
    small = {k: k // 2 for k in range(200, 206)}
    rows = [(1, v, k) for k, v in label.items()] + [(2, v, k) for k, v in small.items()] + [(3, 5, 300), (3, 5, 301)]
    labelled = spark.createDataFrame(rows, "key long, label long, node long")
    sizes, meetings = similar._blocks(labelled)
    held: dict = {}
    for r in similar._placed(labelled, sizes).collect():
        held.setdefault((r["key"], r["block"]), []).append((r["label"], r["node"]))
    assert max(map(len, held.values())) < 40 and sum(map(len, held.values())) == 96
    got = Counter()
    for r in meetings.collect():
        left, right = held.get((r["key"], r["a"]), []), held.get((r["key"], r["b"]), [])
        pairs = [(x, y) for i, x in enumerate(left) for y in left[:i]] if r["a"] == r["b"] else [(x, y) for x in left for y in right]
        got.update(tuple(sorted((x[1], y[1]))) for x, y in pairs if x[0] != y[0])
    want = {(i, j) for part in (label, small) for i in part for j in part if i < j and part[i] != part[j]}
    assert set(got) == want and set(got.values()) == {1}


def test_links_join_what_is_similar():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 40, 60).astype(np.uint64)) for _ in range(60)] + [np.arange(9000, dtype=np.uint64), np.arange(10000, dtype=np.uint64)]
    want = [[len(np.intersect1d(a, b)) for b in sets[30:]] for a in sets[:30]]
    assert similar.shared(sets[:30], sets[30:]).tolist() == want
    for two in (False, True):
        held = [(int(two and k >= 30), k, k, x) for k, x in enumerate(sets)]
        component = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                if held[i][0] + held[j][0] == int(two) and similar.similarity(sets[i], sets[j]) >= 0.8:
                    component = [component[i] if c == component[j] else c for c in component]
        found = list(range(len(sets)))
        for u, v in similar.links(held):
            assert similar.similarity(sets[u], sets[v]) >= 0.8
            found = [found[u] if c == found[v] else c for c in found]
        assert len(set(zip(component, found, strict=True))) == len(set(component)) == len(set(found)) < len(sets)


def test_the_stage_joins_within_large_buckets(spark, monkeypatch):
    """Blocks of two members give what whole buckets give."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for k in range(60):
        edited = list(base)
        for _ in range(rng.randrange(8)):
            edited[rng.randrange(len(edited))] = f"x{rng.randrange(9)}"
        rows.append((k, " ".join(edited)))
    want = {r["doc_id"] for r in similar.drop_similar(docs(spark, rows)).collect()}
    monkeypatch.setattr(similar, "BLOCK", 2)
    assert {r["doc_id"] for r in similar.drop_similar(docs(spark, rows)).collect()} == want


def test_the_stage_takes_candidates_by_ball_hashing(spark, monkeypatch):
    """Where no band is shared, members of a component of fingerprints still meet, all of them, and are verified."""
    rng = random.Random(11)
    rows = []
    for k in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        for c in range(8):
            edited = list(words)
            for _ in range(c):
                edited[rng.randrange(len(edited))] = f"x{rng.randrange(5000)}"
            rows.append((k * 10 + c, " ".join(edited)))
    rows += [(900, "a b c d e f g h"), (901, "A B c d e f  g h")]  # one set of shingles, so one node
    signed = similar._signed(docs(spark, rows))
    at = {r["node"]: r["key"] for r in similar._balls(signed).collect()}
    node = {r["id"]: r["node"] for r in signed.collect()}
    want = brute({i: simhash.fingerprint(t) for i, t in rows})
    sizes = Counter(want[i] for i in {n: i for i, n in node.items()}.values())
    assert {i for i in want if node[i] in at} == {i for i in want if sizes[want[i]] > 1} and len(at) > 20
    assert len({(want[i], at[node[i]]) for i in want if node[i] in at}) == len({want[i] for i in want if node[i] in at}) == len(set(at.values()))
    sets = {i: similar.shingles(t) for i, t in rows}
    label = {i: i for i in want}
    for i in label:
        for j in list(label):
            if want[i] == want[j] and label[i] != label[j] and similar.similarity(sets[i], sets[j]) >= 0.8:
                low, high = sorted((label[i], label[j]))
                label = {x: low if y == high else y for x, y in label.items()}
    original = similar._signed
    monkeypatch.setattr(similar, "_signed", lambda d: original(d).withColumn("bands", F.array("node")))
    got = {r["doc_id"] for r in corpus_pipeline.near(spark, docs(spark, rows), "").collect()}
    assert got == set(label.values()) and len(got) < len(rows) - 20


def test_only_rows_that_may_be_listed_are_shipped(spark, monkeypatch):
    """A bitmap misses no listed row, passes few others, and decides nothing: with too few bits the result is the same."""
    rows = spark.range(-4000, 4000).selectExpr("id as k", "cast(id % 7 as string) as s", "'x' as _other")
    keys = common.stage(spark.range(-4000, 4000, 40).selectExpr("id as k", "cast(id % 7 as string) as s"), "test")
    want = {k for k in range(-4000, 4000) if k % 40}
    maybe = {r["k"] for r in common.listed(rows, keys, ["k", "s"]).where("_listed").collect()}
    assert set(range(-4000, 4000)) - want <= maybe and len(maybe) < 800
    out = common.unlisted(rows, keys, ["k", "s"])
    assert out.columns == rows.columns and sorted(r["k"] for r in out.collect()) == sorted(want)
    monkeypatch.setattr(common, "BITMAP_BITS", 64)
    assert sorted(r["k"] for r in common.unlisted(rows, keys, ["k", "s"]).collect()) == sorted(want)
    assert common.unlisted(rows, common.stage(keys.limit(0), "test"), ["k", "s"]).count() == 8000


def test_stages_ship_no_text_that_stays(spark):
    """Beyond the threshold of broadcasts, too: before, whole texts were shuffled to be looked up in the list of what goes."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = common.stage(docs(spark, [(k, f"{k} " * 50) for k in range(2000)] + [(5000, "1 " * 50)]), "test")
        for step in (exact_dedup.drop_copies, similar.drop_similar):
            out = step(table)
            assert out.count() == 2000
            plan = out._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("LeftAnti") == 1 and "getbit" in plan.split("LeftAnti")[1]  # what is looked up was filtered
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
