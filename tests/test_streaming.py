import pytest

from helixframe.options import OptionError
from helixframe.pipeline import Pipeline
from helixframe.streaming import run_stream


def test_stateless_pipeline_on_a_stream(spark, tmp_path):
    data = spark.createDataFrame([("a", "ATCGA", "IIII!"), ("b", "GGGG", "IIII"), ("c", None, None)], "SEQ_NAME string, SEQ string, SCORES string")
    data.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    p = Pipeline().grab(reject="^b$", keys="SEQ_NAME", values_only=True).mask_seq().reverse_seq()
    query = run_stream(p, stream).writeStream.format("memory").queryName("masked").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    want = {(r.SEQ_NAME, r.SEQ) for r in p.run(data).collect()}
    assert {(r.SEQ_NAME, r.SEQ) for r in spark.table("masked").collect()} == want == {("a", "aGCTA"), ("c", None)}
    with pytest.raises(OptionError):
        run_stream(Pipeline().sort(key="SEQ"), stream)
