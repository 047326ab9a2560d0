import bz2
import gzip

import pytest

from helixframe.pipeline import Pipeline as P
from helixframe.schema import DataError
from helixframe.sinks.text import newick


def records(df, *names):
    return [tuple(r[n] for n in names) for r in df.orderBy("__ord").collect()]


@pytest.fixture
def fasta(tmp_path):
    f = tmp_path / "a.fasta"
    f.write_text(">test1 >x\natgc\nagcac\n>test2\nacagcactgA\n")
    return f


def test_fasta(spark, fasta, tmp_path):
    df = P().read_fasta(input=str(fasta)).run(spark=spark)
    assert records(df, "SEQ_NAME", "SEQ", "SEQ_LEN") == [("test1 >x", "atgcagcac", 9), ("test2", "acagcactgA", 10)]
    (tmp_path / "b.fasta").write_text(">test3\nAC\n")
    both = P().read_fasta(input=str(tmp_path / "*.fasta")).run(spark=spark)
    assert [r[0] for r in records(both, "SEQ_NAME")] == ["test1 >x", "test2", "test3"]
    assert [r[0] for r in records(P().read_fasta(input=str(tmp_path / "*.fasta"), last=2).run(spark=spark), "SEQ_NAME")] == ["test2", "test3"]
    chained = P().read_fasta(input=str(tmp_path / "b.fasta")).read_fasta(input=str(fasta), first=1).run(spark=spark)
    assert [r[0] for r in records(chained, "SEQ_NAME")] == ["test3", "test1 >x"]
    for bad in (">\nACGT\n", "ACGT\n>x\nAC\n"):
        (tmp_path / "bad").write_text(bad)
        with pytest.raises(Exception, match="FASTA"):
            P().read_fasta(input=str(tmp_path / "bad")).run(spark=spark).collect()


@pytest.mark.parametrize("kind,opener", [("gzip", gzip.open), ("bzip2", bz2.open), (None, open)])
def test_fasta_round_trip(spark, fasta, tmp_path, kind, opener):
    out = str(tmp_path / ("o.fa" + {"gzip": ".gz", "bzip2": ".bz2", None: ""}[kind]))
    df = P().read_fasta(input=str(fasta)).write_fasta(output=out, wrap=4, **({kind: True} if kind else {})).run(spark=spark)
    with opener(out, "rt") as f:
        assert f.read() == ">test1 >x\natgc\nagca\nc\n>test2\nacag\ncact\ngA\n"
    assert records(P().read_fasta(input=out).run(spark=spark), "SEQ") == records(df, "SEQ")


@pytest.mark.parametrize("opener,name", [(gzip.open, "a.fasta"), (bz2.open, "a"), (gzip.open, "a.bz2"), (open, "a.gz")])
def test_compression_is_told_by_content(spark, tmp_path, opener, name):
    with opener(tmp_path / name, "wt") as f:
        f.write("".join(f">s{i}\nAC\nGT\n" for i in range(200_000)))
    (tmp_path / "z.fasta").write_text(">last\nA\n")
    rows = P().read_fasta(input=[str(tmp_path / name), str(tmp_path / "z.fasta")]).run(spark=spark)
    assert [r[0] for r in records(rows, "SEQ_NAME")] == [*(f"s{i}" for i in range(200_000)), "last"]
    assert {r[0] for r in records(rows, "SEQ")} == {"ACGT", "A"}


def test_fastq(spark, tmp_path):
    one, two = tmp_path / "1.fq", tmp_path / "2.fq"
    one.write_text("@a/1\nATCG\n+\n!IJ@\n@b/1\nGG\n+b/1\n@I\n")
    two.write_text("@a/2\nAAC\n+\n!!I\n@b/2\nT\n+\n#\n")
    df = P().read_fastq(input=str(one)).run(spark=spark)
    assert records(df, "SEQ_NAME", "SEQ", "SEQ_LEN", "SCORES") == [("a/1", "ATCG", 4, "!II@"), ("b/1", "GG", 2, "@I")]
    mates = P().read_fastq(input=str(one), input2=str(two), reverse_complement=True).run(spark=spark)
    assert records(mates, "SEQ_NAME", "SEQ", "SCORES") == [("a/1", "ATCG", "!II@"), ("a/2", "GTT", "I!!"), ("b/1", "GG", "@I"), ("b/2", "A", "#")]
    out = str(tmp_path / "64.fq")
    P().read_fastq(input=str(one)).write_fastq(output=out, encoding="base_64").run(spark=spark)
    assert records(P().read_fastq(input=out).run(spark=spark), "SCORES") == records(df, "SCORES")
    one.write_text("@a\nACG\n+\n!\n")
    with pytest.raises(Exception, match="no FASTQ entry"):
        P().read_fastq(input=str(one)).run(spark=spark).collect()


def test_table(spark, tmp_path):
    f = tmp_path / "t"
    f.write_text("#ID COUNT\n# note\nTCMID104 12\n\nTCMID105 123\nTCMID106  2\n")
    read = lambda **o: P().read_table(input=str(f), **o).run(spark=spark)
    assert records(read(), "ID", "COUNT") == [("TCMID104", 12), ("TCMID105", 123), ("TCMID106", 2)]
    assert [c for c in read(select="COUNT,ID").columns if c != "__ord"] == ["COUNT", "ID"]
    assert [c for c in read(reject="0").columns if c != "__ord"] == ["COUNT"]
    assert records(read(keys="A", first=1), "A", "COUNT") == [("TCMID104", 12)]
    f.write_text("\nHuman;1;2.5\nDog;x;1\n")
    assert records(read(delimiter=";", first=1), "V0", "V1", "V2") == [("Human", 1, 2.5)]
    assert records(read(delimiter=";", mode="lenient"), "V1") == [(1,), (0,)]
    assert [c for c in read(delimiter=";", select="2,1", mode="lenient").columns if c != "__ord"] == ["V2", "V1"]
    with pytest.raises(Exception):
        read(delimiter=";").collect()
    f.write_text("a b\nc\n")
    with pytest.raises(Exception, match="fields expected"):
        read().collect()


def test_write_table(spark, tmp_path, capsys):
    df = spark.createDataFrame([(0, "Human", 23524), (1, "Dog", 5), (2, None, None)], "__ord long, ORGANISM string, COUNT long")
    out = str(tmp_path / "t")
    P().write_table(output=out, header=True).run(df)
    assert open(out).read() == "#ORGANISM\tCOUNT\nHuman\t23524\nDog\t5\n"
    P().write_table(output=out, force=True, keys="COUNT,ORGANISM", delimiter=";", last=2).run(df)
    assert open(out).read() == "5;Dog\n"
    P().write_table(pretty=True, commify=True, header=True).run(df)
    assert "| Human    | 23,524 |" in capsys.readouterr().out


def test_boxed_tables_hold_every_record(spark, tmp_path):
    out = str(tmp_path / "t")
    P().write_table(output=out, pretty=True).run(spark.range(12_345).selectExpr("id AS __ord", "id AS N", "concat('n', id) AS NAME"))
    lines = open(out).read().splitlines()
    assert lines[1:-1] == [f"| {i:>5} | {f'n{i}':<6} |" for i in range(12_345)]
    assert lines[0] == lines[-1] == "+-------+--------+"


def test_files_that_the_driver_does_not_see_and_drawings_that_are_too_large_are_errors(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(0, 1, "a"), (1, 3, "b")], "__ord long, LEN long, value string")
    P().write_table(output=str(tmp_path / "parts"), single=False).run(df)
    assert (tmp_path / "parts" / "_SUCCESS").exists()
    monkeypatch.setattr("helixframe.sinks.text.os.path.exists", lambda p: False)
    with pytest.raises(DataError, match="see"):
        P().write_table(output=str(tmp_path / "one"), keys="LEN").run(df)
    monkeypatch.undo()
    with pytest.raises(DataError, match="more than 2"):
        P().plot_histogram(key="LEN", most=2).run(df)
    with pytest.raises(DataError, match="reaches"):
        P().plot_histogram(key="LEN").run(spark.range(1).selectExpr("1000000000000 AS LEN"))


def test_uc(spark, tmp_path):
    f = tmp_path / "x.uc"
    f.write_text("S\t0\t10\t*\t.\t*\t*\t*\tq1\t*\nH\t0\t10\t97.5\t+\t0\t0\t10M\tq2\tq1\nC\t0\t2\t*\t*\t*\t*\t*\tq1\t*\n")
    got = records(P().read_uc(input=str(f)).run(spark=spark), "TYPE", "CLUSTER_SIZE", "SEQ_LEN", "IDENT", "S_ID")
    assert got == [("S", None, 10, None, None), ("H", None, 10, 97.5, "q1"), ("C", 2, None, None, None)]


def test_plots_and_tree(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, "ac", "I!"), (1, 3, "aa", "II")], "__ord long, LEN long, SEQ string, SCORES string")
    for name, options in (("plot_histogram", {"key": "LEN"}), ("plot_scores", {}), ("plot_residue_distribution", {}), ("plot_heatmap", {})):
        out = str(tmp_path / f"{name}.svg")
        assert P().add(name, output=out, **options).run(df).count() == 2
        assert open(out).read()
    from helixframe.operators import plots

    assert {r.key: r.n for r in plots.histogram(df, "LEN").collect()} == {0: 0, 1: 1, 2: 0, 3: 1}
    m = spark.createDataFrame([(0, 5, 1, 6, "+"), (2, 4, 3, 9, "-")], "Q_BEG long, Q_END long, S_BEG long, S_END long, STRAND string")
    assert sorted(tuple(r) for r in plots.match_vectors(m).collect()) == [(0, 1, 5, 6, "forward"), (2, 9, 4, 3, "reverse")]
    assert newick(["a", "b", "c"], ["AAAA", "AAAT", "TTTT"]).count(":") == 4
