import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.llm import common, simhash


def plain_fingerprint(text, width=4):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius):
    roots = list(range(len(fps)))

    def find(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                roots[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@given(st.text(alphabet="ab É\n\t c|", max_size=60))
def test_fingerprint_is_the_majority_of_shingle_hashes(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_long_text_counts_every_shingle():
    text = " ".join(random.Random(1).choice("abcdefgh") + str(i % 97) for i in range(40_000))
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


@settings(deadline=None, max_examples=40)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5), st.integers(0, 63), st.integers(0, 63)), max_size=60))
def test_linked_spans_the_links_of_each_group(rows):
    base = [0, 2**64 - 1, 0xF0F0F0F0F0F0F0F0, 1, 12345678901234567, 7]
    rows = sorted((g, base[k] ^ (1 << a) ^ (1 << b)) for g, k, a, b in rows)
    fps = np.array([f for _, f in rows], np.uint64)
    parent = simhash.linked(fps, np.array([g for g, _ in rows], np.int64), 4)
    for g in {g for g, _ in rows}:
        at = [i for i, r in enumerate(rows) if r[0] == g]
        want = plain_components([rows[i][1] for i in at], 4)
        assert [parent[i] - at[0] for i in at] == want


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 20, 300]))]
        for k in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(k):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += ["", "  \n ", None, "one", "One", "a b c", texts[0], "x " * 5000]
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


def test_near_duplicates_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 9, "x") for i, t in rows], "doc_id long, text string, fp int, component_id string").repartition(3)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(df).collect()}
    fps = [plain_fingerprint(t or "") for _, t in rows]
    want = {i: (f, rows[c][0]) for (i, _), f, c in zip(rows, fps, plain_components(fps, 4), strict=True)}
    assert got == want
    assert len({c for _, c in got.values()}) < len(rows)


def test_crowded_buckets_are_split_without_losing_links(spark):
    rng = random.Random(2)
    fps = sorted({rng.getrandbits(64) & 0xFFFF | 1 << 40 + k % 3 for k in range(600)})
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, cell=32)).collect()}
    want = plain_components(fps, 4)
    by_class = {}
    for f, c in zip(signed, want, strict=True):
        by_class.setdefault(c, set()).add(roots.get(f, f))
    assert all(len(v) == 1 for v in by_class.values())
    assert len({next(iter(v)) for v in by_class.values()}) == len(by_class)


def test_rows_of_buckets_are_not_broadcast(spark):
    distinct = common.frozen(spark.range(3000).select(F.xxhash64("id").alias("fp")))  # a file of a few KB, as Spark sees it
    found = simhash.links(distinct)
    found.collect()
    joins = re.findall(r"(\w+Join) \[.*__salt", found._jdf.queryExecution().executedPlan().toString())
    assert joins and set(joins) == {"SortMergeJoin"}


def test_a_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 99)], "a long, b long")
    assert {r.node: r.root for r in simhash.components(edges).collect()} == {**{i: 0 for i in range(1, 41)}, 100: 99}


def test_a_long_chain_is_one_component(spark):
    order = list(range(10_001))
    random.Random(3).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long")
    assert {(r.node, r.root) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, 10_001)}


def test_more_blocks_find_the_same_links(spark):
    rng = random.Random(9)
    fps = sorted({rng.getrandbits(64) for _ in range(40)})
    fps = sorted({f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for f in fps for _ in range(6)})
    df = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp long")
    want = plain_components(fps, 4)
    for shared in (2, 3, 4):
        roots = {r.node % 2**64: r.root for r in simhash.components(simhash.links(df, shared=shared)).collect()}
        got = [roots.get(f, f - 2**64 if f >> 63 else f) for f in fps]
        assert [got.index(g) for g in got] == [want.index(w) for w in want]
    assert [simhash.blocks_for(10**k, 4) for k in (3, 6, 8, 10, 13)] == [2, 2, 2, 4, 6]


def test_empty_tables_repeated_rows_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = spark.createDataFrame([(5, "same text"), (5, "same text"), (None, "same text"), (None, "only null here, and longer")], schema)
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.near_duplicates(rows).collect())
    assert got == [(0, 0), (0, 5), (5, 5), (5, 5)]
