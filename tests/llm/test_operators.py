import base64
import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helixframe.llm.common import in_fold, labelled_sample
from helixframe.llm import byte_bpe, encoding, packing, quality_classifier, quality_rules, sharding, token_counts, topk, toxicity, urls

TEXTS = st.text(alphabet="ab Éß1'.\n\tx×’-", max_size=50)
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, score double, spans int, sequence_id string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORD_BPE)


def documents(spark, rows):
    """With columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, None, 1.0, 1, "x") for i, t in rows], SCHEMA)


def odd_rows():
    """Nulls, empty, very long, repeated and equal texts."""
    long = " ".join(f"w{i % 977}é" for i in range(30_000))
    return [(1, "a plain text."), (2, None), (3, ""), (4, " \n "), (5, long), (6, "a plain text."), (6, "a plain text."), (None, "no id"), (7, "x" * 5000), (8, "a <|endoftext|> b<|startoftext|>")]


# --- top-k


def plain_top_k(rows, every, k):
    """rows: (id, list of floats or None)."""
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    pairs = {}
    for q, a in ints:
        if q % every == 0:
            pairs.setdefault(q, []).extend((-sum(x * y for x, y in zip(a, b)), i) for i, b in ints if i != q)
    return {(q, n): (i, -s) for q, scored in pairs.items() for n, (s, i) in enumerate(sorted(scored)[:k], 1)}


def test_top_k_matches_brute_force(spark):
    rng = random.Random(3)
    vectors = [(i, [rng.gauss(0, 0.3) for _ in range(12)]) for i in range(-20, 300)]
    vectors += [(i, [0.25] * 12) for i in range(400, 460)]  # ties
    vectors += [(500, None), (501, [float("nan")] * 12), (502, [1.0, None]), (503, [0.5] * 5), (510, []), (511, [1e3] * 12), (512, [3e6] * 12), (520, [-2e6] * 12)]
    vectors += [(0, vectors[20][1]), (7, [0.9] * 12), (7, [0.9] * 12), (40, [0.3] * 12), (40, [-0.3] * 12), (None, [1.0] * 12)]  # repeated ids
    df = spark.createDataFrame([(*r, "x", 1) for r in vectors], "vec_id long, embedding array<double>, query_id string, rank int").repartition(5)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.exact_top_k(df, every=10, k=5, shard_rows=64, query_rows=16).collect()}
    assert got == plain_top_k(vectors, 10, 5)
    assert topk.exact_top_k(df.limit(0)).count() == 0
    assert topk.exact_top_k(df.where("vec_id = 0")).count() == 0


@settings(deadline=None, max_examples=80)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(1, 6), st.sampled_from([0, 3, 60, 3000, 2**28]))
def test_a_shard_stops_only_on_proof(seed, n, k, spread):
    rng = np.random.default_rng(seed)
    rows, queries = rng.integers(-spread, spread + 1, (n, 8)), rng.integers(-spread, spread + 1, (5, 8))
    own = (np.arange(min(5, n)), np.arange(min(5, n)))
    at_q, at_r = topk.Shard(rows, 4).search(queries, k, own)
    scores = queries @ rows.T
    for q in range(5):
        others = [r for r in range(n) if r != q or q >= len(own[0])]
        possible = at_r[at_q == q].tolist()
        assert len(set(possible)) == len(possible) and set(possible) <= set(others)
        if others:
            least = np.sort(scores[q, others])[::-1][min(k, len(others)) - 1]
            assert {r for r in others if scores[q, r] >= least} <= set(possible)


def test_a_score_of_more_than_64_bits_is_an_error():
    with pytest.raises(OverflowError):
        topk.Shard(np.full((1, 8), 2**40)).scores(np.full((1, 8), 2**40), np.array([0]), np.array([0]))


def test_score_at_a_time_saves_products():
    table = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(table):
        pytest.skip("the tables aren't here")
    x = np.array([np.floor(256 * np.asarray(v, float)) for v in pq.read_table(table)["embedding"].to_pylist()]).astype(np.int64)
    shard, queries = topk.Shard(x), x[::50]
    at_q, at_r = shard.search(queries, 5, (np.arange(len(queries)), np.arange(0, len(x), 50)))
    shard.scores(queries, at_q, at_r)
    assert shard.products < queries.size * len(x)


# --- token counts and the encoder


@settings(deadline=None)
@given(st.lists(st.one_of(TEXTS, st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "a", " ", "'s", "é", "endoftext"]), max_size=8).map("".join)), max_size=6))
def test_encoder_gives_the_library_s_ids(texts):
    t = Tokenizer.from_file(WORD_BPE)
    got = encoding.Encoder(WORD_BPE).encode([x.encode() for x in texts])
    assert got == [np.asarray(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_encoder_forgets_and_tells_equal_keys_apart(tokenizer):
    e = encoding.Encoder(WORD_BPE, remembered=2)
    for text in ("one two three", "four one five", "one two three <|endoftext|> " + "y" * 90):
        assert e.encode([text.encode()])[0] == np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    e = encoding.Encoder(WORD_BPE)
    e.encode([b"alpha beta"])
    e._words[:] = 7  # as if other pre-tokens had these keys
    assert e.encode([b"alpha beta"])[0] == np.asarray(tokenizer.encode("alpha beta", add_special_tokens=False).ids, "<u4").tobytes()


class Counting:
    """The library's tokenizer, with the number of texts that it was given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.given = tokenizer, 0

    def encode_batch_fast(self, texts, **more):
        self.given += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **more)


def test_new_pre_tokens_go_to_the_library_many_to_a_call(tokenizer):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdeéñ#", k=rng.randrange(1, 12))) for _ in range(2000)) for _ in range(3)]
    e = encoding.Encoder(WORD_BPE)
    e._tokenizer = Counting(e._tokenizer)
    counts = e.counts([t.encode() for t in texts])
    assert len(e._keys) > 3000 and e._tokenizer.given < 10
    assert counts == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert e.encode([t.encode() for t in texts]) == [np.asarray(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_pre_tokens_that_the_library_cuts_again_go_to_it_one_by_one(tokenizer):
    texts = [b"one a\xc3 two", b"\xc3\xc3 x", b"", b"a\x00 a a\x1f #\x00"]
    want = [tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids for t in texts]
    e = encoding.Encoder(WORD_BPE)
    assert e.encode(texts) == [np.asarray(ids, "<u4").tobytes() for ids in want]
    assert e.counts(texts) == list(map(len, want)) and e.counts([]) == []


def test_slots_of_the_encoder_s_table_grow(tokenizer):
    e = encoding.Encoder(WORD_BPE)
    e._slots = np.zeros(4, np.int32)
    for k in (1, 2, 40, 3, 500):
        text = " ".join(f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100]}" for i in range(k))
        assert e.counts([text.encode()]) == [len(tokenizer.encode(text, add_special_tokens=False).ids)]
        assert 2 * len(e._keys) <= len(e._slots) and np.count_nonzero(e._slots) == len(e._keys) - 1


def test_other_tokenizer_files_are_left_to_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    t, texts = Tokenizer.from_file(path), ["Two  words, it's\n <|endoftext|> É", "", "x" * 99]
    assert encoding.Encoder(path).encode([x.encode() for x in texts]) == [np.asarray(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_the_whole_table_has_the_library_s_ids(tokenizer):
    table = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(table):
        pytest.skip("the tables aren't here")
    texts = [t or "" for t in pq.read_table(table)["text"].to_pylist()]
    assert encoding.Encoder(WORD_BPE).encode([t.encode() for t in texts]) == [np.asarray(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@settings(deadline=None, max_examples=5)
@given(lengths=st.lists(st.integers(0, 300), min_size=1, max_size=12), quantiles=st.lists(st.sampled_from([0.0, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9, 0.99, 1.0]), min_size=1, max_size=3, unique=True), context=st.lists(st.integers(0, 310), max_size=3, unique=True))
def test_quantiles_and_limits_match_plain_counting(spark, lengths, quantiles, context):
    counts = spark.createDataFrame(list(Counter(lengths).items()), "n_tokens long, n_docs long")
    limits = token_counts.context_limits(counts)
    want = {q: sorted(lengths)[max(0, -(-int(q * 100) * len(lengths) // 100) - 1)] for q in quantiles}
    assert {r["quantile"]: r.n_tokens for r in token_counts.quantile_lengths(limits, quantiles).collect()} == want
    assert {r.context: (r.truncated_total, r.docs_over) for r in token_counts.answers(limits, context).collect()} == {c: (sum(min(n, c) for n in lengths), sum(n > c for n in lengths)) for c in context}


def test_token_counts(spark, tokenizer):
    rows = odd_rows()
    lengths = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    limits = token_counts.context_limits(token_counts.length_histogram(documents(spark, rows))).persist()
    got = {r.n_tokens: r for r in limits.collect()}
    assert {k: r.n_docs for k, r in got.items()} == Counter(lengths)
    for limit, r in got.items():
        assert r.truncated_total == sum(min(n, limit) for n in lengths)
        assert (r.docs_from, r.tokens_from) == (sum(n >= limit for n in lengths), sum(n for n in lengths if n >= limit))
        assert r.docs_over == sum(n > limit for n in lengths) and r.tokens_total == sum(lengths) and r.docs_total == len(rows)
        assert math.isclose(r.quantile, sum(n <= limit for n in lengths) / len(lengths))
    asked = {r.context: (r.truncated_total, r.docs_over) for r in token_counts.answers(limits, [0, 5, 10**6]).collect()}
    assert asked == {c: (sum(min(n, c) for n in lengths), sum(n > c for n in lengths)) for c in (0, 5, 10**6)}
    assert {r["quantile"]: r.n_tokens for r in token_counts.quantile_lengths(limits, [0.5, 1.0]).collect()} == {0.5: sorted(lengths)[math.ceil(len(lengths) / 2) - 1], 1.0: max(lengths)}
    assert token_counts.context_limits(token_counts.length_histogram(documents(spark, []))).count() == 0


# --- URL filters


def plain_verdict(url, rules, otherwise="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else otherwise


RULES = [*urls.RULES, ("allow", "example.org", "/es/a/"), ("block", "b.example.org", "/"), ("block", "net", "/x"), ("allow", "net", "/x"), ("block", "a.com", "/fr")]


def test_url_verdicts(spark):
    rng = random.Random(1)
    hosts = ["org", "example.org", "a.b.example.org", "b.example.org", "fakeexample.org", "A.Com", "x.com", "net", "www.NET", "", "com."]
    paths = ["", "/", "/es/", "/es", "/es/a/b", "/en/1", "/en/123", "/fr/x", "/de/", "/x", "/é\n/"]
    made = [rng.choice(["http://", "ftp://", "", "://"]) + rng.choice(hosts) + rng.choice(paths) + rng.choice(["", "?q=/es/", "#f://x"]) for _ in range(400)]
    made += [None, "", "://", "http://" + "a." * 3000 + "org/", "http://example.org/es/" + "y" * 20_000] + ["http://www.example.org/es/"] * 300
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(made)], "page_id long, url string, host string, rule string").repartition(3)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df, urls.rule_frame(spark, RULES)).collect()}
    assert got == {i: plain_verdict(u, RULES) for i, u in enumerate(made)}
    assert {r.verdict for r in urls.filter_urls(df, urls.rule_frame(spark, []), otherwise="block").collect()} == {"block"}
    twice = df.select(F.lit(5).cast("long").alias("page_id"), "url", "host")
    want = Counter(plain_verdict(u, RULES) for u in made)
    assert Counter((r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(twice, urls.rule_frame(spark, RULES)).collect()) == want
    assert urls.filter_urls(df.limit(0), urls.rule_frame(spark, RULES)).count() == 0


def test_the_sweep_keeps_the_stack_of_open_rules(spark):
    rng = random.Random(6)
    paths = ["", "/", "/a", "/a/", "/a/b", "/ab", "/a/b/c", "/é", "/éa", "/\uffff", "/\U0010ffff", "/\U0010ffffx"]
    rules = [(rng.choice(["allow", "block"]), h, p) for h in ("org", "a.org", "b.a.org") for p in paths if rng.random() < 0.6]
    rules = list({(h, p): (v, h, p) for v, h, p in rules}.values())
    made = ["x://" + h + p + tail for h in ("org", "a.org", "b.a.org", "z.b.a.org", "zorg") for p in paths for tail in ("", "x", "/b/c/d", "\U0010ffff")]
    df = spark.createDataFrame(list(enumerate(made)), "page_id long, url string").repartition(4)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df, urls.rule_frame(spark, rules)).collect()}
    assert got == {i: plain_verdict(u, rules) for i, u in enumerate(made)}


def test_a_hot_host_is_dealt_over_sweeps(spark):
    made = [f"http://h{i % 7}.com/{'fr' if i % 3 else 'xx'}/{i}" for i in range(800)] + [f"http://other{i}.net/" for i in range(100)]
    df = spark.createDataFrame(list(enumerate(made)), "page_id long, url string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = urls.filter_urls(df, urls.rule_frame(spark, urls.RULES))
        plan = found._jdf.queryExecution().toString()
        assert "hashpartitioning(host_key" in plan and re.search(r"hashpartitioning\(host_key#\d+, sweep#\d+, \d+\), REPARTITION_BY_COL", plan)
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {i: plain_verdict(u, urls.RULES) for i, u in enumerate(made)}


# --- toxicity


def test_marginals_match_the_sum_over_all_labellings():
    rng = random.Random(7)
    for _ in range(40):
        n = rng.randint(1, 9)
        at = sorted(rng.sample(range(n), rng.randint(0, n)))
        potentials = [rng.uniform(-3, 5) for _ in at]
        field = toxicity.ToxicField(bias=rng.uniform(-4, 1), stay=rng.uniform(-1, 2))
        z, marginal = 0.0, [0.0] * n
        for y in itertools.product((0, 1), repeat=n):
            s = sum(field.bias + dict(zip(at, potentials)).get(i, 0.0) for i in range(n) if y[i]) + field.stay * sum(a and b for a, b in zip(y, y[1:]))
            z += math.exp(s)
            marginal = [m + math.exp(s) * v for m, v in zip(marginal, y)]
        p, any_toxic, log_z = field.marginals(n, at, potentials)
        assert np.allclose(p, [marginal[i] / z for i in at]) and math.isclose(log_z, math.log(z), rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(any_toxic, 1 - 1 / z, rel_tol=1e-7, abs_tol=1e-9)


def enumerated(chains_docs, theta, penalty, own):
    """The penalised log likelihood by going through all labellings."""
    bias, stay = theta[-2:]
    value = -penalty / 2 * sum(w * w for w in theta)
    for label, n, at, hit, ids in chains_docs:
        potential = [0.0] * n
        suspect = [False] * n
        for h, f in zip(hit, ids):
            potential[at[h]] += theta[f]
            suspect[at[h]] |= bool(own[f])
        score = lambda y: sum(bias + potential[i] for i in range(n) if y[i]) + stay * sum(a and b for a, b in zip(y, y[1:]))
        value += score([int(label and s) for s in suspect]) - math.log(sum(math.exp(score(y)) for y in itertools.product((0, 1), repeat=n)))
    return value


def test_the_field_is_fitted_to_the_likelihood_of_the_token_labels():
    rng = np.random.default_rng(8)
    own = np.array([True, True, False, True])
    docs = []
    for _ in range(14):
        n = int(rng.integers(0, 8))
        at = np.sort(rng.choice(n, int(rng.integers(0, n + 1)), replace=False)) if n else np.empty(0, int)
        pairs = sorted({(h, int(rng.integers(0, 4))) for h in range(len(at)) for _ in range(2)})
        docs.append((int(rng.integers(0, 2)), n, at, np.array([h for h, _ in pairs], int), np.array([f for _, f in pairs], int)))
    chains = toxicity.Chains(docs, 4, own)
    theta = rng.normal(size=6)
    value, gradient = chains.likelihood(theta, 0.3)
    assert math.isclose(value, enumerated(docs, theta, 0.3, own), rel_tol=1e-9)
    for k in range(6):
        step = np.eye(6)[k] * 1e-5
        assert math.isclose(gradient[k], (enumerated(docs, theta + step, 0.3, own) - enumerated(docs, theta - step, 0.3, own)) / 2e-5, rel_tol=1e-3, abs_tol=1e-4)
    best = chains.climb(200, 0.3)
    top = enumerated(docs, best, 0.3, own)
    assert all(enumerated(docs, best + rng.normal(size=6) * 0.2, 0.3, own) < top + 1e-3 for _ in range(50))
    field = toxicity.ToxicField(bias=best[-2], stay=best[-1])
    potentials = chains.potentials(best)
    p = chains.marginals(potentials, chains.forward(potentials, best[-2:-1], best[-1:])[1], *best[-2:])
    for n, first, size in zip(chains.n.tolist(), chains.first.tolist(), chains.size.tolist()):
        mine = slice(first, first + size)
        assert np.allclose(p[mine], field.marginals(n, chains.at[mine].tolist(), potentials[mine].tolist())[0])


def test_neighbours_count_in_the_potential():
    field = toxicity.ToxicField(weights={b"=bad": 2.0, b"<very": 1.0, b">word": 0.5, b">": 0.25})
    assert field.featured(b"very bad word bad") == (4, [1, 3], [3.5, 2.25])
    assert field.featured(b"") == (0, [], [])


def toxic_corpus(n=400):
    rng = random.Random(11)
    words = [f"{a}{b}" for a in "the and of to in is was for on with".split() for b in ("", "ra", "lo", "mi", "ne")]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        toxic = i % 6 == 0
        for _ in range(3 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(["grubling", "snotwit", "Oafhead"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 5 > 0), int(toxic)))
    rare = " ".join(rng.choice(words) + " onlyhere" for _ in range(10))
    return rows + [(n + i, rare) for i in range(60)], labels + [(n + i, 1, 1) for i in range(60)]


def test_toxicity_on_held_out_documents(spark):
    rows, labels = toxic_corpus()
    df, known = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(toxicity.training_rows(df, known))
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, model, with_spans=True).collect()}
    held = [(i, t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 == 0 and i < 400]
    assert sum(got[i].predicted == t for i, t in held) >= len(held) - 1
    text = "ok 'snotwit, é grubling grubling of"
    spans = [text.encode()[a:b].decode() for a, b, _ in model.spans(text.encode())]
    assert spans == ["snotwit", "grubling grubling"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert "onlyhere" not in {f[1:].decode() for f in model.weights}  # copies of one text prove nothing


def test_near_copies_neither_hide_nor_make_toxic_features(spark):
    rows, labels = toxic_corpus()
    rng = random.Random(4)
    one = " ".join(rng.choice(rows[1][1].split()) + rng.choice([" ", " grubling ", " onlyhere "]) for _ in range(60)).split()
    copies = [" ".join("changed" + str(k) if i == k % len(one) else w for i, w in enumerate(one)) for k in range(500)]
    told = [(t, toxic) for (_, t), (_, _, toxic) in zip(rows, labels, strict=True)] + [(t, 1) for t in copies]
    found = toxicity.toxic_features(spark.createDataFrame(told, "text string, label int").repartition(3))
    assert {b"=grubling", b"=snotwit", b"=oafhead"} <= set(found)
    assert not {b"=onlyhere", b"^change"} & set(found)


def test_toxicity_without_labels_and_on_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = documents(spark, odd_rows())
    model = toxicity.fit(toxicity.training_rows(df, none))
    assert {r.predicted for r in toxicity.score_toxicity(df, model).collect()} == {0}
    assert toxicity.score_toxicity(df.limit(0), model).count() == 0
    labels = spark.createDataFrame([(1, 1, 1), (5, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score_toxicity(df, toxicity.fit(toxicity.training_rows(df, labels, held_out=99))).count() == len(odd_rows())


# --- packing


@settings(deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80), st.integers(1, 6))
def test_best_fit_fills_bins_without_gaps(items, most):
    pack, bins, fresh = packing.BestFit(50, most), {}, 0
    for n in items:
        b, at = pack.place(n, fresh)
        fresh += b == fresh
        assert at == sum(bins.get(b, []))
        bins.setdefault(b, []).append(n)
    assert all(sum(b) <= 50 for b in bins.values())
    left = pack.still_open()
    assert len(left) <= most and all(sum(bins[b]) == used < 50 for b, used in left)


def test_the_tightest_bin_is_taken_and_the_fullest_closes():
    pack = packing.BestFit(10, 2)
    assert [pack.place(n, new) for n, new in ((5, 0), (7, 1), (3, 2), (4, 2), (9, 2))] == [(0, 0), (1, 0), (1, 7), (0, 5), (2, 0)]
    assert pack.place(8, 3) == (3, 0) and [b for b, _ in pack.still_open()] in ([0, 3], [3, 0])  # bin 2 (9 of 10) closed


def test_bins_left_open_take_the_small_ones_that_come_last(spark):
    left = [(k, 30 if k % 2 else 20, k % 64) for k in range(512)]
    df = spark.createDataFrame(left, "bin long, used long, part long")
    assert packing.repacked(df, 50, 8, 64).select("sequence_id").distinct().count() == 256


def test_packing(spark, tokenizer):
    rng = random.Random(5)
    rows = odd_rows() + [(100 + i, " ".join(f"word{rng.randrange(500)}" for _ in range(rng.randrange(300)))) for i in range(300)]
    df = documents(spark, rows).repartition(9)
    got = packing.best_fit_packing(df, capacity=512, open_bins=4, fan_in=2).collect()
    pieces = Counter()
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 512)):
            part = ids[at : at + 512]
            pieces[i, k, at, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 512
    assert len(bins) <= 1.1 * sum(r.length for r in got) / 512 + 2
    assert packing.best_fit_packing(df.limit(0)).count() == 0


# --- byte-level BPE


def reference_codec():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own_codec():
    return byte_bpe.ByteBPE(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@settings(deadline=None, max_examples=300)
@given(text=st.text(alphabet="ab  \n\t't1é。\u00a0x,!\x1c", max_size=40))
def test_ids_are_tiktoken_s(own_codec, text):
    ids = own_codec.encode(text)
    assert ids == CODEC.encode_ordinary(text)
    assert own_codec.decode(ids) == text.encode()


@settings(deadline=None, max_examples=100)
@given(text=st.text(alphabet="ab \n1é", max_size=30))
def test_other_patterns_match_in_the_whole_text(text):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), r"[a-z ]+\n?|\S|\s"
    plain = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=CODEC._mergeable_ranks, special_tokens={})
    assert byte_bpe.codec(path, pattern).encode(text) == plain.encode_ordinary(text)


def test_bytes_that_are_not_utf8_are_read_as_the_replacement_character(spark):
    df = spark.sql("SELECT 1L AS doc_id, CAST(unhex('61FF2062') AS STRING) AS text")
    (r,) = byte_bpe.round_trip_digests(df).collect()
    ids = CODEC.encode_ordinary("a\ufffd b")
    assert (r.n_tokens, r.decoded_sha256) == (len(ids), hashlib.sha256("a\ufffd b".encode()).hexdigest())
    assert quality_rules.quality_rules(df).collect()[0].word_chars == 3


CODEC = reference_codec()


def test_digests(spark, own_codec):
    rows = odd_rows() + [(50, "q" * 300 + "é" * 300), (51, "  two  spaces \n\n and\tmore  ")]
    got = Counter(tuple(r) for r in byte_bpe.round_trip_digests(documents(spark, rows)).collect())
    want = Counter()
    for i, t in rows:
        ids = CODEC.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    encoded = byte_bpe.encode_documents(documents(spark, rows))
    assert Counter(bytes(r.decoded) for r in byte_bpe.decode_documents(encoded).collect()) == Counter((t or "").encode() for _, t in rows)
    assert byte_bpe.round_trip_digests(documents(spark, [])).count() == 0


# --- quality classifier


def quality_corpus(n=500):
    rng = random.Random(2)
    words = "the river and a small house of stone was there for years with some trees".split()
    rows, labels = [], []
    for i in range(n):
        good = i % 4 > 0
        text = " ".join(rng.choice(words) for _ in range(rng.randint(20, 150))) + "."
        rows.append((i, text if good else " ".join(w.upper() + "!!" if i % 8 else w + "###" for w in text.split())))
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality_on_held_out_documents(spark):
    rows, labels = quality_corpus()
    df, known = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(quality_classifier.training_rows(df, known))
    got = {r.doc_id: r for r in quality_classifier.score_quality(df, model).collect()}
    held = [(i, q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].predicted == q for i, q in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = quality_classifier.keep_predicted(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_quality_without_labels_and_on_odd_rows(spark):
    df = documents(spark, odd_rows())
    for labels in ([], [(1, 1, 0), (5, 1, 0)], [(1, 1, 0), (5, 0, 0), (None, 0, 0)]):
        known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        model = quality_classifier.fit(quality_classifier.training_rows(df, known, held_out=99))
        assert quality_classifier.score_quality(df, model).count() == len(odd_rows())
    assert quality_classifier.score_quality(df.limit(0), model).count() == 0


@settings(deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 1)), min_size=1, max_size=40), st.randoms())
def test_calibration_is_the_least_squares_fit_in_any_order(points, shuffled):
    x, y = np.array([p[0] for p in points], float), np.array([p[1] for p in points], float)
    different = sorted(set(x.tolist()))
    mean, number = [y[x == v].mean() for v in different], [(x == v).sum() for v in different]
    # the fit at a point is the greatest over starts of the least over ends of the means between
    block = lambda a, b: np.average(mean[a : b + 1], weights=number[a : b + 1])
    want = [max(min(block(a, b) for b in range(k, len(different))) for a in range(k + 1)) for k in range(len(different))]
    centre, value, n = quality_classifier.pooled(x, y)
    assert np.allclose(np.repeat(value, n.astype(int)), np.repeat(want, number))
    knots, values = quality_classifier.isotonic(x, y)
    assert (np.diff(knots) > 0).all() and (np.diff(values) >= 0).all() and 0 < values.min() and values.max() < 1
    shuffled.shuffle(points)
    again = quality_classifier.isotonic(np.array([p[0] for p in points], float), np.array([p[1] for p in points], float))
    assert np.array_equal(knots, again[0]) and np.array_equal(values, again[1])


def test_the_fit_matches_plain_code(spark):
    rows, labels = quality_corpus(120)
    rows, labels = rows + [(900 + k, *rows[1][1:]) for k in range(30)], labels + [(900 + k, 1, 0) for k in range(30)]  # repeated texts
    df, known = documents(spark, rows).repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(quality_classifier.training_rows(df, known))
    used = [(i, t, q) for (i, t), (_, q, _) in zip(rows, labels, strict=True) if zlib.crc32(str(i).encode()) % 4 != 2]
    x = np.array([quality_classifier.statistics(t.encode()) for _, t, _ in used])
    y = np.array([float(q) for _, _, q in used])
    assert np.allclose(model.centre, x.mean(axis=0)) and np.allclose(model.scale, np.maximum(x.std(axis=0), 1e-3))
    z = np.cos(np.clip((x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-3), -6, 6) @ model.frequencies + model.phases) * np.sqrt(2 / len(model.phases))
    z = np.hstack([z, np.ones((len(x), 1))])
    w = np.where(y == 1, np.sqrt(len(y) / y.sum()), np.sqrt(len(y) / (len(y) - y.sum())))
    a = (z * w[:, None]).T @ z
    want = np.linalg.solve(a + (1e-3 * np.trace(a) / len(a) + 1e-9) * np.eye(len(a)), (z * w[:, None]).T @ y)
    assert np.allclose(z @ model.weights, z @ want, atol=1e-6)
    scores = {r.doc_id: r.score for r in quality_classifier.score_quality(df, model).collect()}
    assert np.allclose([scores[i] for i, _, _ in used], np.interp(z @ want, model.knots, model.values), atol=1e-5)


def test_a_null_id_is_in_no_fold(spark):
    df = spark.createDataFrame([(None,), (1,), (2,), (3,), (5,)], "doc_id long")
    got = {r[0]: r[1] for r in df.select("doc_id", in_fold("doc_id", 4, 2)).collect()}
    assert got == {None: False, **{i: zlib.crc32(str(i).encode()) % 4 == 2 for i in (1, 2, 3, 5)}}


def test_the_sample_is_bounded_and_without_contradictions(spark):
    docs = documents(spark, [(i, "text " * i) for i in range(1, 40)] + [(1, "another text of the same id")] * 5)
    known = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 40)] + [(7, 1, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    rows = labelled_sample(docs, known, "toxic", 5, 0, 10).collect()
    assert len(rows) <= 10 and len({r.doc_id for r in rows}) == len(rows)
    every = labelled_sample(docs, known, "toxic", 5, 0, 1000).collect()
    assert {r.doc_id for r in every} == {i for i in range(1, 40) if i != 7 and zlib.crc32(str(i).encode()) % 5}
    few = labelled_sample(docs, known, "toxic", 5, 0, 1000, most_bytes=300).collect()
    assert 0 < sum(len(r.text) for r in few) <= 300


# --- sharding


def check_shards(rows, got, shards, tolerance):
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    sizes = [sum(r["size"] for r in got if r.shard == s) for s in range(shards)]
    assert max(sizes) - min(sizes) <= tolerance


def test_shards_are_near_equal_and_keep_groups(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(80)))) for i in range(3000)] + [(9000 + i, "a copy") for i in range(90)] + [(None, "no id"), (5, None), (6, ""), (7, None)]
    got = sharding.vector_shards(documents(spark, rows)).collect()
    check_shards(rows, got, 8, 300)
    groups = {}
    for r in got:
        groups.setdefault((r["size"], r.text_crc32), set()).add(r.shard)
    assert all(len(s) == 1 for s in groups.values())
    assert sharding.vector_shards(documents(spark, [])).count() == 0


def test_placement_matches_plain_code(spark, tokenizer):
    rng = random.Random(18)
    rows = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(60))) + "é" * rng.randrange(3)) for i in range(400)]
    rows += [(1000 + i, rows[i][1]) for i in range(0, 60, 2)] + [(2000 + i, "once more") for i in range(30)] + [(None, None), (3, "")]
    sizes = {}
    for _, t in rows:
        t = t or ""
        old = sizes.get(t, (0, 0, 0))
        sizes[t] = old[0] + len(t.encode()) + 1, old[1] + len(tokenizer.encode(t, add_special_tokens=False).ids), old[2] + 1
    total = [sum(v[d] for v in sizes.values()) for d in range(3)]
    digest = {t: hashlib.md5(t.encode()).digest() for t in sizes}
    share = {t: [v[d] / (total[d] / 4) for d in range(3)] for t, v in sizes.items()}
    heavy = {t for t, v in sizes.items() if any(v[d] * 50 > total[d] for d in range(3))}
    left, want = [[1.0] * 3 for _ in range(4)], {}
    for t in sorted(sizes, key=lambda t: (t not in heavy, -max(share[t]), digest[t])):
        fits = [s for s in range(4) if left[s][0] >= share[t][0] - 1e-12]
        s = max(fits, key=lambda s: (round(sum(w * a * b for w, a, b in zip(sharding.WEIGHTS, left[s], share[t])), 12), -s)) if fits else max(range(4), key=lambda s: (left[s][0], -s))
        left[s], want[t] = [a - b for a, b in zip(left[s], share[t])], s
    got = {(r["size"], r.text_crc32): (r.shard, r.tokens) for r in sharding.vector_shards(documents(spark, rows), shards=4, heavy_part=50).collect()}
    assert 0 < len(heavy) < len(sizes)
    assert {(len(t.encode()) + 1, zlib.crc32(t.encode())): (s, sizes[t][1] // sizes[t][2]) for t, s in want.items()} == got


def test_light_groups_are_placed_by_many_tasks(spark):
    rng = random.Random(19)
    rows = [(i, " ".join(f"w{rng.randrange(999)}" for _ in range(rng.randrange(1, 60)))) for i in range(3000)]
    got = sharding.vector_shards(documents(spark, rows), groups_per_task=200).collect()
    check_shards(rows, got, 8, 1500)
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) < 1.1 * min(counts.values())
    tokens = [sum(r.tokens for r in got if r.shard == s) for s in range(8)]
    assert max(tokens) < 1.1 * min(tokens)


def test_a_group_larger_than_a_shard_is_split(spark):
    rows = [(None if i % 2 else i, "the same text for a third of the rows") for i in range(1000)] + [(5000 + i, f"text number {i} of the others") for i in range(2000)]
    check_shards(rows, sharding.vector_shards(documents(spark, rows)).collect(), 8, 500)


# --- quality rules


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = (text or "").split("\n")
    duplicates = sum(bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:i] for i, line in enumerate(lines))
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), duplicates, len(repeated)


@given(st.text(alphabet="ab #é\n\t|", max_size=80))
def test_base_statistics(text):
    assert quality_rules.base_statistics(text.encode()) == plain_statistics(text)


def test_quality_rules(spark):
    rows, labels = quality_corpus()
    rows = [(i, t + " " + " ".join(f"more{j}" for j in range(60))) for i, t in rows] + odd_rows()
    df = documents(spark, rows)
    got = quality_rules.quality_rules(df).collect()
    want = Counter()
    for i, t in rows:
        s = plain_statistics(t)
        want[(i, *s, s[0] < 50 or 100 * s[4] > 50 * s[0])] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)
    assert quality_rules.quality_rules(df.limit(0)).count() == 0


def plain_posteriors(rows):
    """Expectation-maximisation over documents one by one; a row of votes for each."""
    post = [0.05 if 2 in r else 0.95 for r in rows]
    for _ in range(5000):
        model = []
        for side, lean in ((1, (0.5, 0.45, 0.05)), (0, (0.5, 0.2, 0.3))):
            weight = [p if side else 1 - p for p in post]
            rates = []
            for k in range(len(rows[0])):
                sums = [lean[v] + sum(w for w, r in zip(weight, rows, strict=True) if r[k] == v) for v in range(3)]
                rates.append([s / sum(sums) for s in sums])
            model.append(((sum(weight) + 1) / (len(rows) + 2), rates))
        new = []
        for r in rows:
            good, bad = (math.log(share) + sum(math.log(rates[k][v]) for k, v in enumerate(r)) for share, rates in model)
            new.append(1 / (1 + math.exp(min(500, max(-500, bad - good)))))
        if max(abs(a - b) for a, b in zip(new, post, strict=True)) < 1e-9:
            return new
        post = new


def test_posteriors_and_verdicts_match_plain_code(spark):
    rng = random.Random(12)
    words = [f"{a}{b}" for a in "ra lo mi ne su ta vo ki".split() for b in "da fe gi ho ju".split()]
    rows = []
    for i in range(150):
        text = [rng.choice(words) for _ in range(rng.randint(40, 160))]
        kind = rng.choice(["fine", "fine", "fine", "symbols", "capitals", "repeated", "bare", "mixed", "long"])
        text = {"symbols": [w + "###" for w in text], "capitals": [w.upper() + "!" for w in text], "repeated": text[:9] * 9, "bare": [x for w in text for x in (w, "|")], "mixed": [w + "$" * (k % 9 == 0) for k, w in enumerate(text)], "long": [w * 5 for w in text]}.get(kind, text)
        rows.append((i, " ".join(text) + "\n" + "one line more\n" * rng.choice([0, 0, 0, 2])))
    rows += odd_rows()
    bases = [plain_statistics(t) for _, t in rows]
    voted = [quality_rules.votes((t or "").encode(), b) for (_, t), b in zip(rows, bases, strict=True)]
    post = plain_posteriors(voted)
    want = Counter((i, round(p, 6), p >= 0.5 and b[0] >= 50 and 100 * b[4] <= 50 * b[0]) for (i, _), p, b in zip(rows, post, bases, strict=True))
    got = Counter((r.doc_id, round(r.quality, 6), r.kept) for r in quality_rules.quality_rules(documents(spark, rows)).collect())
    assert got == want and 20 < sum(n for (_, _, kept), n in got.items() if kept) < 150


def test_rules_vote_both_ways():
    text = " ".join(f"word{i}" for i in range(60)).encode()
    assert set(quality_rules.votes(text, quality_rules.base_statistics(text))) == {1}
    assert quality_rules.votes(b"", quality_rules.base_statistics(b"")) == [0] * len(quality_rules.RULES)
    assert quality_rules.base_statistics(b"a \xff\xfe b") == (3, 4, 0, 0, 0)


def test_expectation_maximisation_finds_the_accuracies():
    rng = np.random.default_rng(4)
    good = rng.random(20_000) < 0.8
    votes = np.zeros((len(good), 5), int)
    for r, (miss, false) in enumerate([(0.3, 0.0), (0.5, 0.01), (0.6, 0.0), (0.4, 0.02), (0.9, 0.3)]):
        votes[:, r] = 2 * (rng.random(len(good)) < np.where(good, false, 1 - miss))
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post = quality_rules.expectation_maximisation(patterns, counts.astype(float))[inverse.ravel()]
    assert ((post >= 0.5) == good).mean() > 0.95
    assert (quality_rules.expectation_maximisation(np.zeros((1, 5), int), np.array([9.0])) >= 0.5).all()
