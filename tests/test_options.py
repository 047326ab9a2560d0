import pytest

from helixframe import options as O
from helixframe.pipeline import Pipeline


def test_unknown_missing_and_conflicting_options_raise_when_written_down():
    p = Pipeline()
    for name, options in (
        ("grab", {}),
        ("grab", {"select": "a", "reject": "b"}),
        ("grab", {"select": "a", "keys_only": True, "values_only": True}),
        ("grab", {"select": "a", "ignore_case": True, "exact": True}),
        ("grab", {"select": "a", "foo": 1}),
        ("grab", {"select_file": "/no/such/file"}),
        ("add_key", {"key": "K"}),
        ("add_key", {"key": "K", "value": 1, "prefix": "p"}),
        ("merge_values", {}),
        ("merge_values", {"keys": "a,a"}),
        ("mask_seq", {"mask": "no"}),
        ("mask_seq", {"quality_min": 41}),
        ("trim_seq", {"mode": "middle"}),
        ("trim_seq", {"length_min": 0}),
        ("mean_scores", {"window_size": 1}),
        ("random", {"number": 0}),
        ("assemble_pairs", {"mismatch_percent": 101}),
        ("assemble_pairs", {"merge_unassembled": True, "allow_unassembled": True}),
        ("clip_primer", {"primer": "ATG"}),
        ("clip_primer", {"primer": "ATG", "direction": "up"}),
        ("read_fasta", {"input": "/no/such/file"}),
        ("read_fastq", {"input": __file__, "encoding": "base_1"}),
        ("read_table", {"input": __file__, "select": "a", "reject": "b"}),
        ("write_fasta", {"output": __file__}),
        ("write_table", {"commify": True}),
        ("dump", {"first": 1, "last": 1}),
        ("usearch_global", {"database": __file__, "identity": 1.5}),
        ("genecall", {"tool": "no-such-program"}),
    ):
        with pytest.raises(O.OptionError):
            p.add(name, **options)


def test_zero_is_a_given_constant():
    assert len(Pipeline().add_key(key="K", value=0)) == 1


def test_pipelines_are_values():
    a, b = Pipeline().grab(select="x"), Pipeline().sort(key="k").reverse_seq()
    both = a + b
    assert (len(a), len(b), len(both), len(a | b)) == (1, 2, 3, 3)
    rest, last = both.pop()
    assert len(rest) == 2 and last.command.name == "reverse_seq"
    assert "grab(select='x'" in both.describe()
    with pytest.raises(AttributeError):
        a.no_such_operator()
    with pytest.raises(O.OptionError):
        Pipeline().run()


def test_layers_numbers_and_patterns(tmp_path):
    rc = tmp_path / "rc"
    rc.write_text("trim_seq quality_min 25\nother quality_min 1\n")
    assert O.read_configuration(str(rc), "trim_seq") == {"quality_min": 25}
    assert O.layered({"a": None, "b": 1}, {"a": 2, "b": 3, "c": 4}, {"c": 5}) == {"a": 2, "b": 1, "c": 5}
    assert [O.to_number(x) for x in ("1", "1.5", "x")] == [1, 1.5, "x"]
    for n in ("b.fa", "a.fa"):
        (tmp_path / n).write_text("")
    assert [p[-4:] for p in O.expand(f"{tmp_path}/*.fa")] == ["a.fa", "b.fa"]
    p = Pipeline(configuration=str(rc)).trim_seq()
    assert p.stages[0].options["quality_min"] == 25


def test_registered_operator(spark):
    Pipeline.register("twice", lambda df, key: df.union(df), key=None)
    df = spark.createDataFrame([(1,)], "a long")
    assert Pipeline().twice(key="a").run(df).count() == 2
