import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import DataFrameWriter

import corpus_pipeline
from helixframe.llm import common, packing, quality_classifier, quality_rules, simhash


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    words = [f"{a}{b}" for a in "ra lo mi ne su ta vo ki".split() for b in "da fe gi ho ju".split()]
    rows, labels = [], []
    for i in range(160):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(60, 200))) + "."
        bad = i % 5 == 0
        rows.append((i, " ".join(w + "###" for w in text.split()) if bad else text, "en", f"src{i % 3}", len(text)))
        labels.append((i, int(not bad), 0))
    for k in range(12):
        rows.append((1000 + k, rows[1][1] if k % 2 else rows[2][1].replace(".", f" {words[k]}."), "en", "src0", 9))
    rows += [(2000, None, None, None, None), (2001, "", "en", "s", 0), (2002, "too short", "en", "s", 9), (None, rows[3][1] + " and more words without any id at all", "en", "s", 1)]
    out = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def test_stages_match_plain_code(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = docs.collect()
    expected = {r.doc_id: r.text for r in rows}
    verdicts = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs).collect()}
    expected = {i: t for i, t in expected.items() if verdicts[i]}
    one = corpus_pipeline.reject_by_rules(spark, docs, folder)
    assert one.columns == docs.columns and {r.doc_id: r.text for r in one.collect()} == expected
    assert not any(i % 5 == 0 for i in expected if i is not None and i < 160)

    model = quality_classifier.fit(quality_classifier.training_rows(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    expected = {i: t for i, t in expected.items() if model.score([t.encode()])[0] >= 0.7}
    two = corpus_pipeline.reject_by_classifier(spark, one, folder)
    assert two.columns == docs.columns and {r.doc_id: r.text for r in two.collect()} == expected

    fps = {i: simhash.fingerprint(t.encode()) for i, t in expected.items()}
    groups = []
    for i in fps:  # plain components
        near = [g for g in groups if any((fps[i] ^ fps[j]).bit_count() <= 4 for j in g)]
        groups = [g for g in groups if g not in near] + [[i, *(j for g in near for j in g)]]
    first = {min((j for j in g if j is not None), default=None) for g in groups}
    three = corpus_pipeline.one_of_each_group(spark, two, folder)
    assert three.columns == docs.columns and sorted(r.doc_id if r.doc_id is not None else -1 for r in three.collect()) == sorted(i if i is not None else -1 for i in first)
    assert len(first) < len(expected)

    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == first
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "near-duplicates", "packing"]


def test_empty_and_repeated_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
    twice = docs.where("doc_id IN (1, 2)").union(docs.where("doc_id IN (1, 2)"))
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each_group(spark, twice, folder).collect()) == [1, 2]


@pytest.mark.parametrize("most", [0, 1000])
def test_rows_that_share_an_id_or_have_none_are_documents_of_their_own(spark, most):
    schema = "doc_id long, `lang.code` string, text string, __votes string"
    texts = ["first text of some words here", "quite another text with other words", "a third one"]
    rows = [(7, "en", texts[0], "a"), (7, "en", texts[1], "a"), (8, "en", texts[2], None), (None, "en", texts[2], "c"), (None, "x", "nameless words only in here", "d"), (None, "y", "nameless words only in here", "d")]
    rows += [(9, None, texts[0], "b"), (7, None, texts[0], None), (7, "en", texts[1], "a"), (7, "en", texts[1], "a"), (12, "en", "", "e"), (11, "en", None, "e")]
    df = spark.createDataFrame(rows, schema).repartition(3)
    got = simhash.one_of_each_component(df, most_broadcast=most)
    assert got.columns == df.columns
    kept = [tuple(r) for r in got.collect()]
    assert sorted((r[0] or 0, r[2] or "") for r in kept) == sorted([(7, texts[0]), (7, texts[1]), (8, texts[2]), (0, "nameless words only in here"), (11, "")]) and set(kept) <= set(rows)
    assert set(simhash.one_of_each_component(df.repartition(1), most_broadcast=most).collect()) == set(map(tuple, kept))
    voted = quality_rules.keep_good(df)
    assert voted.columns == df.columns and voted.count() == 0


def test_texts_reach_workers_in_small_batches(spark, folder, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    write = DataFrameWriter.parquet

    def spy(self, path, *args, **kwargs):
        seen.append(int(spark.conf.get(key)) if "MapInArrow" in self._df._jdf.queryExecution().optimizedPlan().toString() else 0)
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", spy)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        seen.clear()
        stage(spark, docs, folder).write.parquet(f"{folder}/small-{name.replace(' ', '-')}")
        assert any(seen), name
        of_texts = [n for n in seen if n][:1]  # what comes after works on fingerprints or bins
        assert max(of_texts) <= (packing.BATCH_ROWS if name == "packing" else common.BATCH_ROWS) and seen[-1] == 0, name  # nothing is left to the caller's write
        assert spark.conf.get(key) == "10000", name
    spark.conf.set(key, "70")
    try:
        with common.small_batches(spark):
            assert spark.conf.get(key) == "70"
        assert spark.conf.get(key) == "70"
    finally:
        spark.conf.unset(key)


def test_slices_hold_the_same_rows():
    texts = ["a" * 10, None, "", "b" * 5000, *["c" * 90] * 50, None]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts})
    got = list(common.slices([batch, batch.slice(0, 0)], 1000))
    assert pa.Table.from_batches(got).to_pydict() == batch.to_pydict()
    assert len(got) > 6 and all(len(b) == 1 or sum(map(len, filter(None, b["text"].to_pylist()))) <= 6000 for b in got)
    assert all(sum(len(t or "") for t in b["text"].to_pylist()[:-1]) <= 1000 for b in got)


def test_pairs_of_words_are_not_all_held():
    words = [b"one", b"two"] * 100_000
    tracemalloc.start()
    try:
        share = quality_classifier.repeated_pairs(words)
        assert tracemalloc.get_traced_memory()[1] < 1_000_000
    finally:
        tracemalloc.stop()
    assert share == 1 - 2 / 199_999 and quality_classifier.repeated_pairs([b"one"]) == quality_classifier.repeated_pairs([]) == 0
