import pytest
from pyspark.sql import functions as F

from helixframe.metrics import report
from helixframe.pipeline import Pipeline
from helixframe.schema import DataError, with_ordinal

P = Pipeline


def rows(df, *names):
    out = [{k: v for k, v in r.asDict(True).items() if v is not None and k != "__ord"} for r in df.collect()]
    return sorted(({k: r.get(k) for k in names} for r in out) if names else out, key=str)


@pytest.fixture(scope="module")
def stream(spark):
    data = [(0, "test1", "atcg", 4, None), (1, "test2", "DSEQM", 5, None), (2, None, None, None, "SEQ")]
    return spark.createDataFrame(data, "__ord long, SEQ_NAME string, SEQ string, SEQ_LEN long, FOO string")


def test_grab_modes(stream, tmp_path):
    names = lambda p: sorted(r.SEQ_NAME or "alien" for r in p.run(stream).collect())
    assert names(P().grab(select="est1")) == ["test1"]
    assert names(P().grab(select="SEQ")) == ["alien", "test1", "test2"]
    assert names(P().grab(select="SEQ", keys_only=True)) == ["test1", "test2"]
    assert names(P().grab(select="SEQ", values_only=True)) == ["alien", "test2"]
    assert names(P().grab(reject="SEQ", keys_only=True)) == ["alien"]
    assert names(P().grab(select="dseqm", ignore_case=True, keys="SEQ", values_only=True)) == ["test2"]
    assert names(P().grab(select="SEQ", keys="SEQ")) == ["alien", "test1", "test2"]  # the name of a key asked for counts
    assert names(P().grab(select=[4], keys="SEQ_LEN", exact=True)) == ["test1"]
    assert names(P().grab(select=["4"], keys="SEQ_LEN", exact=True)) == []
    assert names(P().grab(evaluate=":SEQ_LEN > 4")) == ["test2"]
    assert names(P().grab(evaluate=":SEQ_LEN > 3 && :SEQ_NAME == 'test1'")) == ["test1"]
    assert names(P().grab(evaluate=":NO_SUCH > 4")) == []
    f = tmp_path / "patterns"
    f.write_text("test1\nDSEQM\n\n")
    assert names(P().grab(select_file=str(f), exact=True)) == ["test1", "test2"]
    assert names(P().grab(reject_file=str(f), exact=True)) == ["alien"]
    assert names(P().grab(reject_file=str(f))) == ["alien"]


def test_unique_and_its_inverse_make_up_the_input(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, None), (4, "a")], "__ord long, V0 string")
    first, rest = (sorted(r[0] for r in P().unique_values(key="V0", invert=i).run(df).collect()) for i in (False, True))
    assert (first, rest) == ([0, 1, 3], [2, 3, 4])
    assert P().unique_values(key="NONE").run(df).count() == 5


def test_counts(spark):
    df = spark.createDataFrame([(0, "H", "a"), (1, "H", "b"), (2, "C", "a"), (3, None, None)], "__ord long, V0 string, V1 string")
    got = {r["__ord"]: (r.V0_COUNT, r.V1_COUNT) for r in P().count_values(keys="V0,V1,FOO").run(df).collect()}
    assert got == {0: (2, 2), 1: (2, 1), 2: (1, 2), 3: (None, None)}
    assert rows(P().count().run(df).where("RECORD_TYPE = 'count'")) == [{"RECORD_TYPE": "count", "COUNT": 4}]


def test_values(spark):
    df = spark.createDataFrame([(0, "FOO:count=10", 5), (1, "FOO_10_20", None), (2, "A_x_1__", 1)], "__ord long, ID string, COUNT long")
    assert rows(P().split_values(key="ID").run(df), "ID_0", "ID_1", "ID_2") == sorted([{"ID_0": None, "ID_1": None, "ID_2": None}, {"ID_0": "FOO", "ID_1": 10, "ID_2": 20}, {"ID_0": "A", "ID_1": None, "ID_2": 1}], key=str)
    assert rows(P().split_values(key="ID", delimiter=":count=", keys="x,y").run(df), "x", "y")[0] == {"x": "FOO", "y": 10}
    assert [r.ID for r in P().merge_values(keys="COUNT,ID", delimiter=":").run(df).orderBy("__ord").collect()] == ["FOO:count=10", "FOO_10_20", "A_x_1__"]
    assert [r.COUNT for r in P().merge_values(keys="COUNT,ID", delimiter=":").run(df).orderBy("__ord").collect()] == ["5:FOO:count=10", None, "1:A_x_1__"]
    assert [r.K for r in P().add_key(key="K", prefix="N").run(df).orderBy("__ord").collect()] == ["N0", "N1", "N2"]


def test_random_is_exact_and_keeps_pairs(spark):
    df = spark.range(0, 101).withColumnRenamed("id", "__ord")
    assert P().random(number=30).run(df).count() == 30
    picked = sorted(r[0] for r in P().random(number=20, pairs=True).run(df).collect())
    assert len(picked) == 20 and all(b == a + 1 and a % 2 == 0 for a, b in zip(picked[::2], picked[1::2], strict=True))
    assert P().random(number=500).run(df).count() == 101


def test_merge_table(spark, tmp_path):
    f = tmp_path / "t.tab"
    f.write_text("#ID ORGANISM\n1 one\n2 two\n3 three\n4 four\n")
    df = spark.createDataFrame([(i, i, i * 10) for i in range(1, 6)], "__ord long, ID long, COUNT long")
    got = {r.ID: r.ORGANISM for r in P().merge_table(input=str(f), key="ID").run(df).collect()}
    assert got == {1: "one", 2: "two", 3: "three", 4: "four", 5: None}
    f.write_text("#ID X\n1 a\n1 b\n")
    with pytest.raises(DataError):
        P().merge_table(input=str(f), key="ID").run(df)


def test_sort_and_ends(spark, capsys):
    df = spark.createDataFrame([(0, "a", 4), (1, "b", 21), (2, "c", 2), (3, "d", 9)], "__ord long, NAME string, COUNT long")
    assert [r.COUNT for r in P().sort(key="COUNT").run(df).collect()] == [2, 4, 9, 21]
    assert [r.COUNT for r in P().sort(key="COUNT", reverse=True, block_size=10).run(df).collect()] == [21, 9, 4, 2]
    assert [r.NAME for r in P().dump(last=2).run(df).collect()] == ["c", "d"]
    assert [r.NAME for r in P().dump(first=1).run(df).collect()] == ["a"]
    assert "'NAME': 'c'" in capsys.readouterr().out


def test_otus(spark):
    hits = [(0, "H", "otu1", "s0", 2, None), (1, "H", "otu1", "S1", None, None), (2, "H", "otu2", "s0", 1, None), (3, "C", "otu2", "s1", 9, None), (4, None, None, None, None, 1)]
    df = spark.createDataFrame(hits, "__ord long, TYPE string, S_ID string, SAMPLE string, SEQ_COUNT long, one long")
    got = rows(P().collect_otus().run(df).where("RECORD_TYPE = 'OTU'"), "OTU", "S0_COUNT", "S1_COUNT")
    assert got == [{"OTU": "otu1", "S0_COUNT": 2, "S1_COUNT": 1}, {"OTU": "otu2", "S0_COUNT": 1, "S1_COUNT": 0}]
    otus = spark.createDataFrame([(0, "o1", 3352, "S(100);R(100)"), (1, "o2", 881, "S(100);R(50)"), (2, "o3", 228, "T(100)"), (3, "o4", None, None)], "__ord long, OTU string, A_COUNT long, TAXONOMY string")
    got = rows(P().collapse_otus().run(otus), "OTU", "A_COUNT", "TAXONOMY")
    assert got == sorted([{"OTU": "o1", "A_COUNT": 4233, "TAXONOMY": "S(100);R(100)"}, {"OTU": "o3", "A_COUNT": 228, "TAXONOMY": "T(100)"}, {"OTU": "o4", "A_COUNT": None, "TAXONOMY": None}], key=str)


def test_ordinals_are_dense_in_order(spark):
    df = spark.range(0, 5000).select(((F.col("id") * 7919) % 5003).alias("k")).repartition(7)
    got = with_ordinal(df, "n", "k").orderBy("k").collect()
    assert [r.n for r in got] == list(range(5000))


def test_status(spark, tmp_path):
    df = spark.createDataFrame([(0, "acgt"), (1, "aaaaaa"), (2, None)], "__ord long, SEQ string")
    p = P().reverse_seq().grab(select="t", keys="SEQ", values_only=True)
    p.run(df, status=True).collect()
    last = p.metrics[-1].status()
    assert (last["records_in"], last["records_out"], last["sequences_delta"], last["residues_out"]) == (3, 1, -1, 4)
    assert "grab" in report(p.metrics, str(tmp_path / "r.html"), "html")


def test_ordinals_take_one_shuffle(spark):
    keys = [None, 5, 5, 1, None, 7, -2, *range(10, 200)]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, v int")
    numbered = with_ordinal(df, "n", "k")
    got = [(r.n, r.k) for r in numbered.orderBy("n").collect()]
    assert got == list(enumerate(sorted(keys, key=lambda k: (k is not None, k or 0))))
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "hashpartitioning" not in plan and "Window" not in plan
    assert with_ordinal(df.limit(0), "n", "k").collect() == []
