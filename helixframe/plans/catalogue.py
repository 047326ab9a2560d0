"""The registered queries and the SQL that they are held against.

Sequences are derived from whole document texts in the same way in both engines: letters are mapped onto nucleotides, and
onto scores. Every query works on its whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alphabet as A
from ..functions import search
from ..functions import sequence as S
from ..operators import aggregate, plots, taxonomy
from ..operators.join import maximal_matches
from ..operators.order import first_records, last_records
from ..pipeline import Pipeline
from ..schema import ORD, shared_folder

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_AS_DNA = ("acgt" * 7)[:26]
_AS_SCORES = "!#%*+-/02468:;<=>?@ABCDEGI"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = _SEQS + sql if "FROM seqs" in sql else sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as sequences with scores, in the order of doc_id."""
    only = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    seq, scores = F.translate(only, _LETTERS, _AS_DNA), F.translate(only, _LETTERS, _AS_SCORES)
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias(ORD), F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("SEQ_NAME"), seq.alias("SEQ"), scores.alias("SCORES"))
    return rows.withColumn("SEQ_LEN", F.length("SEQ").cast("long"))


_SEQS = f"""
WITH seqs AS (
  SELECT doc_id AS ord, 'D' || doc_id AS SEQ_NAME, translate(o, '{_LETTERS}', '{_AS_DNA}') AS SEQ, translate(o, '{_LETTERS}', '{_AS_SCORES}') AS SCORES, length(o) AS SEQ_LEN
  FROM (SELECT doc_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS o FROM documents)
) """


def _named(df: DataFrame) -> DataFrame:
    """Without the order column, which SQL doesn't have."""
    return df.drop(ORD)


# --- files: written to the shared folder, in parts, and read back


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@_query("SELECT SEQ_NAME, SEQ, SEQ_LEN FROM seqs WHERE SEQ_LEN > 0")
def fasta_written_and_read(spark, sf_dir):
    folder = _folder(spark)
    Pipeline().write_fasta(output=folder, wrap=70, single=False).run(sequences(spark, sf_dir).where("SEQ_LEN > 0"))
    return _named(Pipeline().read_fasta(input=folder).run(spark=spark))


@_query("SELECT SEQ_NAME, SEQ, SEQ_LEN, SCORES FROM seqs WHERE SEQ_LEN > 0")
def fastq_written_and_read(spark, sf_dir):
    folder = _folder(spark)
    Pipeline().write_fastq(output=folder, encoding="base_64", single=False).run(sequences(spark, sf_dir).where("SEQ_LEN > 0"))
    return _named(Pipeline().read_fastq(input=folder, encoding="base_64").run(spark=spark))


@_query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def table_written_and_read(spark, sf_dir):
    folder = _folder(spark)
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(ORD), "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    Pipeline().write_table(output=folder, header=True, gzip=True, delimiter=";", single=False).run(orders)
    return _named(Pipeline().read_table(input=folder, delimiter=";").run(spark=spark))


@_query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS n FROM orders")
def file_order(spark, sf_dir):
    """Records keep, through a file of parts, the order in which a sort left them."""
    folder = _folder(spark)
    orders = Pipeline().add_key(key=ORD, prefix="", order_by=["o_totalprice", "o_orderkey"]).run(_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"))
    Pipeline().write_table(output=folder, keys="o_orderkey", single=False).run(orders.withColumn(ORD, F.col(ORD).cast("long")))
    rows = Pipeline().read_table(input=folder, keys="o_orderkey").run(spark=spark)
    return rows.select("o_orderkey", F.col(ORD).alias("n"))


@_query("SELECT SEQ_NAME, SEQ, SEQ_LEN FROM seqs WHERE SEQ_LEN > 0")
def fasta_read_by_pattern(spark, sf_dir):
    """Compressed parts, each of them a file that a pattern names."""
    folder = _folder(spark)
    Pipeline().write_fasta(output=folder, bzip2=True, single=False).run(sequences(spark, sf_dir).where("SEQ_LEN > 0"))
    return _named(Pipeline().read_fasta(input=f"{folder}/part-*").run(spark=spark))


@_query("""
, h AS (SELECT ord, SEQ_NAME, SEQ, SCORES, (SEQ_LEN + 1) // 2 AS half FROM seqs WHERE SEQ_LEN > 1)
SELECT 2 * row_number() OVER (ORDER BY ord) - 2 AS n, SEQ_NAME || '/1' AS SEQ_NAME, left(SEQ, half) AS SEQ, left(SCORES, half) AS SCORES FROM h
UNION ALL SELECT 2 * row_number() OVER (ORDER BY ord) - 1, SEQ_NAME || '/2', reverse(translate(right(SEQ, half), 'acgt', 'tgca')), reverse(right(SCORES, half)) FROM h""")
def fastq_mates(spark, sf_dir):
    """Mates of two files, one after the other, the second ones turned."""
    folder = _folder(spark)
    half = F.floor((F.col("SEQ_LEN") + 1) / 2).cast("int")
    seqs = sequences(spark, sf_dir).where("SEQ_LEN > 1")
    for k, at in ((1, F.lit(1)), (2, F.length("SEQ") - half + 1)):
        mates = seqs.select(ORD, F.concat("SEQ_NAME", F.lit(f"/{k}")).alias("SEQ_NAME"), *[F.substring(F.col(c), at, half).alias(c) for c in ("SEQ", "SCORES")])
        Pipeline().write_fastq(output=f"{folder}/{k}", single=False).run(mates)
    rows = Pipeline().read_fastq(input=f"{folder}/1", input2=f"{folder}/2", encoding="base_33", reverse_complement=True).run(spark=spark)
    return rows.select(F.col(ORD).alias("n"), "SEQ_NAME", "SEQ", "SCORES")


@_query("""
SELECT row_number() OVER (ORDER BY event_id) - 1 AS n, CASE event_type WHEN 'click' THEN 'H' WHEN 'view' THEN 'C' ELSE 'S' END AS "TYPE", user_id AS "CLUSTER", CASE event_type WHEN 'view' THEN event_id END AS "CLUSTER_SIZE",
  CASE event_type WHEN 'view' THEN NULL ELSE event_id END AS "SEQ_LEN", CASE event_type WHEN 'click' THEN 97.5::DOUBLE END AS "IDENT", CASE event_type WHEN 'view' THEN NULL ELSE '+' END AS "STRAND", 'Q' || event_id AS "Q_ID", CASE event_type WHEN 'click' THEN 'S' || user_id END AS "S_ID" FROM events""")
def uc_read(spark, sf_dir):
    """Lines of the .uc format, made of events."""
    folder = _folder(spark)
    kind = F.when(F.col("event_type") == "click", "H").when(F.col("event_type") == "view", "C").otherwise("S")
    hit, text = F.col("event_type") == "click", lambda c: F.col(c).cast("string")
    fields = [kind, text("user_id"), text("event_id"), F.when(hit, "97.5").otherwise("*"), F.lit("+"), F.lit("0"), F.lit("0"), F.lit("*"), F.concat(F.lit("Q"), text("event_id")), F.when(hit, F.concat(F.lit("S"), text("user_id"))).otherwise("*")]
    _table(spark, sf_dir, "events").orderBy("event_id").select(F.concat_ws("\t", *fields).alias("value")).write.text(folder)
    rows = Pipeline().read_uc(input=folder).run(spark=spark)
    return rows.select(F.col(ORD).alias("n"), "TYPE", "CLUSTER", "CLUSTER_SIZE", "SEQ_LEN", "IDENT", "STRAND", "Q_ID", "S_ID")


@_query("SELECT event_id, user_id FROM events WHERE event_type IN ('click', 'view')")
def select_file(spark, sf_dir):
    """Exact values from a file that another operator wrote."""
    folder = _folder(spark)
    wanted = spark.createDataFrame([(0, "click"), (1, "view")], f"{ORD} long, event_type string")
    Pipeline().write_table(output=folder, single=False).run(wanted)
    return Pipeline().grab(select_file=folder, keys="event_type", exact=True, values_only=True).run(_events(spark, sf_dir)).select("event_id", "user_id")


# --- filters


@_query("""SELECT o.*, count(*) OVER (PARTITION BY o_orderpriority) AS "o_orderpriority_COUNT" FROM orders o WHERE o_totalprice > 100000""")
def flagship(spark, sf_dir):
    """Large orders with the frequency of their priority, sorted."""
    orders = _table(spark, sf_dir, "orders")
    return Pipeline().grab(evaluate=":o_totalprice > 100000").count_values(keys="o_orderpriority").sort(key="o_orderkey").run(orders)


@_query("SELECT * FROM part WHERE regexp_matches(p_name, '^(red|blue).*(bolt|ring)$')")
def grab_regex_keys(spark, sf_dir):
    return Pipeline().grab(select="^(red|blue).*(bolt|ring)$", keys="p_name").run(_table(spark, sf_dir, "part"))


@_query("SELECT * FROM part WHERE NOT (regexp_matches(p_type, 'S') OR regexp_matches(p_brand, '#1'))")
def grab_reject(spark, sf_dir):
    return Pipeline().grab(reject=["S", "#1"], keys="p_type,p_brand", values_only=True).run(_table(spark, sf_dir, "part"))


@_query("SELECT * FROM customer WHERE regexp_matches(c_acctbal::VARCHAR, '77') OR regexp_matches(c_custkey::VARCHAR, '77') OR regexp_matches(c_name, '77') OR regexp_matches(c_nationkey::VARCHAR, '77') OR regexp_matches(c_mktsegment, '77')")
def grab_any_column(spark, sf_dir):
    return Pipeline().grab(select="77").run(_table(spark, sf_dir, "customer"))


@_query("SELECT * FROM customer WHERE regexp_matches(c_mktsegment, '(?i)mach|AUTO')")
def grab_ignore_case(spark, sf_dir):
    return Pipeline().grab(select="mach|auto", keys="c_mktsegment", ignore_case=True, values_only=True).run(_table(spark, sf_dir, "customer"))


@_query("SELECT r_regionkey, r_name FROM region")
def grab_keys_only(spark, sf_dir):
    return Pipeline().grab(select="_name$", keys_only=True).run(_table(spark, sf_dir, "region"))


@_query("SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('click', 'purchase')")
def grab_exact(spark, sf_dir):
    return Pipeline().grab(select=["click", "purchase"], keys="event_type", exact=True).run(_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"))


@_query("SELECT * FROM lineitem WHERE l_quantity >= 10 AND l_discount < 0.05 AND (l_returnflag = 'R' OR l_linestatus = 'O')")
def grab_evaluate(spark, sf_dir):
    return Pipeline().grab(evaluate=":l_quantity >= 10 && :l_discount < 0.05 && (:l_returnflag == 'R' || :l_linestatus == 'O')").run(_table(spark, sf_dir, "lineitem"))


_EVENTS = "SELECT event_id, user_id, event_type FROM events"


def _events(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")


@_query(f"{_EVENTS} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def unique_values(spark, sf_dir):
    return Pipeline().unique_values(key="user_id", order_by="event_id").run(_events(spark, sf_dir))


@_query(f"{_EVENTS} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1")
def unique_values_invert(spark, sf_dir):
    return Pipeline().unique_values(key="user_id", invert=True, order_by="event_id").run(_events(spark, sf_dir))


@_query("SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 100")
def random_n(spark, sf_dir):
    return Pipeline().random(number=100, order_by="o_orderkey").run(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))


@_query("""
WITH n AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 2 AS pair FROM orders),
drawn AS (SELECT pair FROM n GROUP BY pair HAVING count(*) = 2 ORDER BY md5('42|' || pair::BIGINT), pair LIMIT 25)
SELECT o_orderkey FROM n WHERE pair IN (SELECT pair FROM drawn)""")
def random_pairs(spark, sf_dir):
    return Pipeline().random(number=50, pairs=True, order_by="o_orderkey").run(_table(spark, sf_dir, "orders").select("o_orderkey"))


# --- projections


@_query("SELECT *, 'x' AS \"KEY\" FROM nation")
def add_key_value(spark, sf_dir):
    return Pipeline().add_key(key="KEY", value="x").run(_table(spark, sf_dir, "nation"))


@_query("SELECT o_orderkey, 'ID_' || (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS \"ID\" FROM orders")
def add_key_index(spark, sf_dir):
    return Pipeline().add_key(key="ID", prefix="ID_", order_by="o_orderkey").run(_table(spark, sf_dir, "orders").select("o_orderkey"))


@_query("SELECT n_name || ':' || n_regionkey || ':' || n_nationkey AS n_name, n_regionkey, n_nationkey FROM nation")
def merge_values(spark, sf_dir):
    return Pipeline().merge_values(keys="n_name,n_regionkey,n_nationkey", delimiter=":").run(_table(spark, sf_dir, "nation"))


@_query("SELECT s_suppkey, s_name, string_split(s_name, '#')[1] AS a, string_split(s_name, '#')[2]::BIGINT AS b FROM supplier")
def split_values(spark, sf_dir):
    return Pipeline().split_values(key="s_name", keys="a,b", delimiter="#", order_by="s_suppkey").run(_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"))


@_query("SELECT SEQ_NAME, reverse(SEQ) AS SEQ, reverse(SCORES) AS SCORES, SEQ_LEN FROM seqs")
def reverse_seq(spark, sf_dir):
    return _named(Pipeline().reverse_seq().run(sequences(spark, sf_dir)))


@_query("SELECT SEQ_NAME, translate(SEQ, 'acgt', 'tgca') AS SEQ FROM seqs")
def complement_seq(spark, sf_dir):
    return Pipeline().complement_seq(type="dna").run(sequences(spark, sf_dir)).select("SEQ_NAME", "SEQ")


@_query("SELECT SEQ_NAME, CASE WHEN SEQ_LEN - 10 < 5 THEN '' ELSE substr(SEQ, 6, greatest(0, SEQ_LEN - 14)) END AS SEQ FROM seqs")
def slice_seq(spark, sf_dir):
    return Pipeline().slice_seq(start=5, stop=-10).run(sequences(spark, sf_dir)).select("SEQ_NAME", "SEQ")


@_query("SELECT SEQ_NAME, replace(SEQ, 'a', '') AS SEQ, length(replace(SEQ, 'a', '')) AS SEQ_LEN, array_to_string([SCORES[i] FOR i IN range(1, SEQ_LEN + 1) IF SEQ[i] <> 'a'], '') AS SCORES FROM seqs")
def degap_seq(spark, sf_dir):
    gapped = sequences(spark, sf_dir).withColumn("SEQ", F.translate("SEQ", "a", "-"))
    return _named(Pipeline().degap_seq().run(gapped))


@_query("""
WITH a AS (SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 24, '-') AS s FROM orders), w AS (SELECT max(length(o_orderkey::VARCHAR)) AS w FROM orders)
SELECT o_orderkey, substr(s, 25 - w) AS SEQ, w AS SEQ_LEN FROM a, w""")
def degap_columns(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.lpad(F.col("o_orderkey").cast("string"), 24, "-").alias("SEQ"))
    return Pipeline().degap_seq(columns_only=True).run(orders)


@_query("SELECT o_orderkey, substr(lpad(o_orderkey::VARCHAR, 12, '-'), 5, 7) AS SEQ, 7::BIGINT AS SEQ_LEN FROM orders")
def slice_align(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.lpad(F.col("o_orderkey").cast("string"), 12, "-").alias("SEQ"))
    return Pipeline().slice_align(start=4, stop=10).run(orders)


_MASKED = "SELECT SEQ_NAME, array_to_string([CASE WHEN ascii(SCORES[i]) - 33 < 20 THEN {low} ELSE upper(SEQ[i]) END FOR i IN range(1, SEQ_LEN + 1)], '') AS SEQ FROM seqs"


@_query(_MASKED.format(low="lower(SEQ[i])"))
def mask_soft(spark, sf_dir):
    return Pipeline().mask_seq().run(sequences(spark, sf_dir)).select("SEQ_NAME", "SEQ")


@_query(_MASKED.format(low="'N'"))
def mask_hard(spark, sf_dir):
    return Pipeline().mask_seq(mask="hard").run(sequences(spark, sf_dir)).select("SEQ_NAME", "SEQ")


_TRIMMED = (
    ", t AS (SELECT *, instr(regexp_replace(regexp_replace(SCORES, '[5-I]', 'G', 'g'), '[^G]', 'B', 'g'), 'GGG') AS l, instr(reverse(regexp_replace(regexp_replace(SCORES, '[5-I]', 'G', 'g'), '[^G]', 'B', 'g')), 'GGG') AS r FROM seqs) "
    "SELECT SEQ_NAME, {seq} AS SEQ FROM t"
)


@_query(_TRIMMED.format(seq="CASE WHEN l = 0 THEN '' ELSE substr(SEQ, l, SEQ_LEN - r + 2 - l) END"))
def trim_both(spark, sf_dir):
    return Pipeline().trim_seq().run(sequences(spark, sf_dir)).select("SEQ_NAME", "SEQ")


@_query(_TRIMMED.format(seq="CASE WHEN l = 0 THEN '' ELSE substr(SEQ, l) END"))
def trim_left(spark, sf_dir):
    return Pipeline().trim_seq(mode="left").run(sequences(spark, sf_dir)).select("SEQ_NAME", "SEQ")


@_query(_TRIMMED.format(seq="substr(SEQ, 1, CASE WHEN r = 0 THEN 1 ELSE SEQ_LEN - r + 2 END)"))
def trim_right(spark, sf_dir):
    return Pipeline().trim_seq(mode="right").run(sequences(spark, sf_dir)).select("SEQ_NAME", "SEQ")


_SUM = "list_sum([ascii(SCORES[i]) - 33 FOR i IN range(1, SEQ_LEN + 1)])::BIGINT"


@_query(f"SELECT SEQ_NAME, CASE WHEN SEQ_LEN = 0 THEN NULL ELSE ((200 * {_SUM} + SEQ_LEN) // (2 * SEQ_LEN)) / 100 END AS SCORES_MEAN FROM seqs")
def mean_scores(spark, sf_dir):
    return Pipeline().mean_scores().run(sequences(spark, sf_dir)).select("SEQ_NAME", "SCORES_MEAN")


@_query("""
, v AS (SELECT SEQ_NAME, SEQ_LEN, [ascii(SCORES[i]) - 33 FOR i IN range(1, SEQ_LEN + 1)] AS q FROM seqs)
SELECT SEQ_NAME, CASE WHEN SEQ_LEN >= 5 THEN list_min([(q[i] + q[i + 1] + q[i + 2] + q[i + 3] + q[i + 4]) // 5 FOR i IN range(1, SEQ_LEN - 3)])::DOUBLE END AS SCORES_MEAN_LOCAL FROM v""")
def mean_scores_local(spark, sf_dir):
    return Pipeline().mean_scores(local=True).run(sequences(spark, sf_dir)).select("SEQ_NAME", "SCORES_MEAN_LOCAL")


_PRIMER = "gtacc"


@_query(f"""
, p AS (SELECT *, instr(SEQ, '{_PRIMER}') AS i FROM seqs)
SELECT SEQ_NAME, CASE WHEN i > 0 THEN substr(SEQ, i + 5) ELSE SEQ END AS SEQ, CASE WHEN i > 0 THEN 'FORWARD' END AS "CLIP_PRIMER_DIR", CASE WHEN i > 0 THEN i - 1 END AS "CLIP_PRIMER_POS" FROM p""")
def clip_primer_exact(spark, sf_dir):
    return Pipeline().clip_primer(primer=_PRIMER, direction="forward").run(sequences(spark, sf_dir)).select("SEQ_NAME", "SEQ", "CLIP_PRIMER_DIR", "CLIP_PRIMER_POS")


@_query("""
SELECT SEQ_NAME, CASE WHEN starts_with(SEQ, 'gtac') THEN substr(SEQ, 5) WHEN starts_with(SEQ, 'tac') THEN substr(SEQ, 4) WHEN starts_with(SEQ, 'ac') THEN substr(SEQ, 3) ELSE SEQ END AS SEQ,
  CASE WHEN starts_with(SEQ, 'gtac') THEN 4 WHEN starts_with(SEQ, 'tac') THEN 3 WHEN starts_with(SEQ, 'ac') THEN 2 END::BIGINT AS "TRIM_PRIMER_LEN" FROM seqs""")
def trim_primer_exact(spark, sf_dir):
    return Pipeline().trim_primer(primer="gtac", direction="forward", overlap_min=2).run(sequences(spark, sf_dir)).select("SEQ_NAME", "SEQ", "TRIM_PRIMER_LEN")


@_query(f"""
, p AS (SELECT *, list_min([i FOR i IN range(1, SEQ_LEN - 8) IF hamming(substr(SEQ, i, 10), 'gtaccgatcg') <= 2]) AS i FROM seqs)
SELECT SEQ_NAME, CASE WHEN i > 0 THEN substr(SEQ, 1, i - 1) ELSE SEQ END AS SEQ, CASE WHEN i > 0 THEN i - 1 ELSE SEQ_LEN END AS SEQ_LEN, i - 1 AS "CLIP_PRIMER_POS", substr(SEQ, i, 10) AS "CLIP_PRIMER_PAT" FROM p""")
def clip_primer_mismatches(spark, sf_dir):
    """What comes before the first place that differs from a primer in a fifth of it at most."""
    found = Pipeline().clip_primer(primer="gtaccgatcg", direction="reverse", mismatch_percent=20).run(sequences(spark, sf_dir))
    return found.select("SEQ_NAME", "SEQ", "SEQ_LEN", "CLIP_PRIMER_POS", "CLIP_PRIMER_PAT")


#: Length of a primer's part and the mismatches that are a quarter of it, rounded.
_TRIM = "gtaccgat"
_TRIM_PARTS = [(n, int(n / 4 + 0.5)) for n in range(len(_TRIM), 3, -1)]


@_query(f"""
, p AS (SELECT *, CASE {" ".join(f"WHEN SEQ_LEN >= {n} AND hamming(left(SEQ, {n}), '{_TRIM[-n:]}') <= {e} THEN {n}" for n, e in _TRIM_PARTS)} END::BIGINT AS n FROM (SELECT SEQ_NAME, SEQ_LEN, rpad(SEQ, greatest(8, SEQ_LEN)::INTEGER, ' ') AS SEQ FROM seqs))
SELECT SEQ_NAME, rtrim(substr(SEQ, coalesce(n, 0) + 1)) AS SEQ, n AS "TRIM_PRIMER_LEN", left(SEQ, n) AS "TRIM_PRIMER_PAT" FROM p""")
def trim_primer_mismatches(spark, sf_dir):
    found = Pipeline().trim_primer(primer=_TRIM, direction="forward", overlap_min=4, mismatch_percent=25).run(sequences(spark, sf_dir))
    return found.select("SEQ_NAME", "SEQ", "TRIM_PRIMER_LEN", "TRIM_PRIMER_PAT")


# --- joins and aggregations


@_query("SELECT o.o_orderkey, o.o_custkey, c.c_name, c.c_mktsegment FROM orders o LEFT JOIN customer c ON o_custkey = c_custkey")
def merge_table(spark, sf_dir):
    customers = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return Pipeline().merge_table(input=customers, key="o_custkey").run(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))


@_query("SELECT doc_id, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def merge_table_nonmatch(spark, sf_dir):
    return Pipeline().merge_table(input=_table(spark, sf_dir, "labels"), key="doc_id").run(_table(spark, sf_dir, "documents").select("doc_id", "n_chars"))


@_query("SELECT n_name, NULL AS \"RECORD_TYPE\", NULL::BIGINT AS \"COUNT\" FROM nation UNION ALL SELECT NULL, 'count', count(*) FROM nation")
def count_records(spark, sf_dir):
    return Pipeline().count().run(_table(spark, sf_dir, "nation").select("n_name"))


@_query("SELECT event_id, user_id, event_type, count(*) OVER (PARTITION BY user_id) AS \"user_id_COUNT\", count(*) OVER (PARTITION BY event_type) AS \"event_type_COUNT\" FROM events")
def count_values(spark, sf_dir):
    return Pipeline().count_values(keys="user_id,event_type").run(_events(spark, sf_dir))


@_query("SELECT min(doc_id) AS doc_id, text AS SEQ, count(*) AS \"SEQ_COUNT\" FROM documents GROUP BY text")
def dereplicate(spark, sf_dir):
    return Pipeline().dereplicate_seq(order_by="doc_id").run(_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("SEQ")))


@_query("SELECT min(doc_id) AS doc_id, arg_min(text, doc_id) AS SEQ, count(*) AS \"SEQ_COUNT\" FROM documents GROUP BY lower(text)")
def dereplicate_ignore_case(spark, sf_dir):
    return Pipeline().dereplicate_seq(ignore_case=True, order_by="doc_id").run(_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("SEQ")))


_OTU_TYPES = ("click", "view", "purchase", "signup", "error", "scroll")


@_query("""SELECT user_id::VARCHAR AS "OTU", """ + ", ".join(f"""sum(CASE WHEN event_type = '{t}' THEN 1 ELSE 0 END)::BIGINT AS "{t.upper()}_COUNT" """ for t in _OTU_TYPES) + " FROM events GROUP BY user_id")
def collect_otus(spark, sf_dir):
    hits = _table(spark, sf_dir, "events").select(F.col("event_id").alias(ORD), F.lit("H").alias("TYPE"), F.col("user_id").cast("string").alias("S_ID"), F.col("event_type").alias("SAMPLE"))
    return Pipeline().collect_otus(samples=list(_OTU_TYPES)).grab(select="^OTU$", keys="RECORD_TYPE", values_only=True).run(hits).select("OTU", *[f"{t.upper()}_COUNT" for t in _OTU_TYPES])


@_query("""SELECT min(p_partkey) AS p_partkey, arg_min(p_type || '(' || p_size || ');' || p_brand || '(100)', p_partkey) AS "TAXONOMY", sum(p_size)::BIGINT AS "S_COUNT" FROM part GROUP BY p_type, p_brand""")
def collapse_otus(spark, sf_dir):
    size = F.col("p_size").cast("string")
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.concat("p_type", F.lit("("), size, F.lit(");"), "p_brand", F.lit("(100)")).alias("TAXONOMY"), F.col("p_size").cast("long").alias("S_COUNT"))
    return Pipeline().collapse_otus(order_by="p_partkey").run(rows)


@_query(", p AS (SELECT unnest(range(SEQ_LEN)) AS pos, SEQ FROM seqs) SELECT pos, upper(SEQ[pos + 1]) AS residue, count(*) AS n FROM p GROUP BY ALL")
def residue_counts(spark, sf_dir):
    return aggregate.residue_counts(sequences(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))


_PLACES = """
WITH p AS (SELECT unnest(range(1, length(n_name) + 1)) AS pos, upper(n_name) AS s FROM nation), w AS (SELECT pos, s[pos] AS r FROM p), t AS (SELECT pos, count(*) AS total FROM w GROUP BY pos), c AS (SELECT pos, r, count(*) AS n FROM w GROUP BY ALL)
SELECT all_r.r AS residue, 'V' || t.pos AS place, {value} AS n FROM (SELECT DISTINCT r FROM w) all_r CROSS JOIN t LEFT JOIN c ON c.r = all_r.r AND c.pos = t.pos"""


def _distribution(spark, sf_dir, **options):
    """Every column of the operator's records, as rows."""
    out = Pipeline().analyze_residue_distribution(**options).run(_table(spark, sf_dir, "nation").select(F.col("n_name").alias("SEQ"))).where("V0 IS NOT NULL")
    return out.unpivot([F.col("V0").alias("residue")], [c for c in out.columns if c.startswith("V") and c != "V0"], "place", "n")


@_query(_PLACES.format(value="coalesce(n, 0)"))
def residue_distribution(spark, sf_dir):
    return _distribution(spark, sf_dir)


@_query(_PLACES.format(value="coalesce(100 * n // total, 0)"))
def residue_distribution_percent(spark, sf_dir):
    return _distribution(spark, sf_dir, percent=True)


@_query(""", p AS (SELECT unnest(range(SEQ_LEN)) AS pos, upper(SEQ) AS s FROM seqs), c AS (SELECT pos, s[pos + 1] AS residue, count(*) AS n FROM p GROUP BY ALL)
SELECT pos, residue, 100.0::DOUBLE * n / sum(n) OVER (PARTITION BY pos) AS percent, 100.0::DOUBLE * sum(n) OVER (PARTITION BY pos) / (SELECT count(*) FROM seqs) AS depth FROM c""")
def residue_plot(spark, sf_dir):
    """What the plot of residues draws."""
    return plots.residue_distribution(sequences(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))


@_query("SELECT l_linenumber::BIGINT AS key, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT 0, 0")
def histogram_count(spark, sf_dir):
    return plots.histogram(_table(spark, sf_dir, "lineitem"), "l_linenumber")


@_query("SELECT l_returnflag AS key, sum(l_linenumber)::BIGINT AS n FROM lineitem GROUP BY 1")
def histogram_sum(spark, sf_dir):
    return plots.histogram(_table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linenumber")


@_query(", p AS (SELECT unnest(range(SEQ_LEN)) AS pos, SCORES FROM seqs) SELECT pos, sum(ascii(SCORES[pos + 1]) - 33)::DOUBLE / count(*) AS mean, count(*) AS n FROM p GROUP BY pos")
def mean_score_by_pos(spark, sf_dir):
    return plots.score_profile(sequences(spark, sf_dir)).select(F.col("pos").cast("long").alias("pos"), "mean", "n")


@_query("""
WITH s AS (SELECT n_chars AS len, sum(n_chars) OVER (ORDER BY n_chars DESC) AS so_far, sum(n_chars) OVER () AS total FROM documents)
SELECT max(CASE WHEN 2 * so_far >= total THEN len END) AS contig_n50, min(len) AS contig_min, max(len) AS contig_max FROM s""")
def n50(spark, sf_dir):
    return aggregate.n50(_table(spark, sf_dir, "documents"), "n_chars")


# --- order and pairs


@_query("SELECT o_orderkey, o_totalprice FROM orders")
def sort_asc(spark, sf_dir):
    return Pipeline().sort(key="o_totalprice").run(_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"))


@_query("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 100")
def last_records_by_price(spark, sf_dir):
    return last_records(_table(spark, sf_dir, "orders"), 100, ["o_totalprice", "o_orderkey"])


@_query("SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100")
def first_records_by_price(spark, sf_dir):
    return first_records(_table(spark, sf_dir, "orders"), 100, ["o_totalprice", "o_orderkey"])


def _halves(spark, sf_dir):
    half = F.floor(F.col("SEQ_LEN") / 2)
    return sequences(spark, sf_dir).withColumn("SEQ_NAME", F.concat("SEQ_NAME", F.lit("/1"))).withColumn("SEQ_LEN_LEFT", half).withColumn("SEQ_LEN_RIGHT", F.col("SEQ_LEN") - half)


@_query("""
SELECT SEQ_NAME || '/1' AS SEQ_NAME, substr(SEQ, 1, SEQ_LEN // 2) AS SEQ, substr(SCORES, 1, SEQ_LEN // 2) AS SCORES, SEQ_LEN // 2 AS SEQ_LEN FROM seqs
UNION ALL SELECT SEQ_NAME || '/2', substr(SEQ, SEQ_LEN // 2 + 1), substr(SCORES, SEQ_LEN // 2 + 1), SEQ_LEN - SEQ_LEN // 2 FROM seqs""")
def split_pairs(spark, sf_dir):
    return _named(Pipeline().split_pair_seq().run(_halves(spark, sf_dir)))


@_query("SELECT SEQ_NAME || '/1' AS SEQ_NAME, SEQ, SCORES, SEQ_LEN, SEQ_LEN // 2 AS \"SEQ_LEN_LEFT\", SEQ_LEN - SEQ_LEN // 2 AS \"SEQ_LEN_RIGHT\" FROM seqs")
def merge_pairs(spark, sf_dir):
    return _named(Pipeline().split_pair_seq().merge_pair_seq().run(_halves(spark, sf_dir)))


@_query()
def assemble_pairs(spark, sf_dir):
    seqs = sequences(spark, sf_dir).where("SEQ_LEN > 0")
    part = lambda k, f: F.struct((2 * F.col(ORD) + k).alias(ORD), F.concat("SEQ_NAME", F.lit(f"/{k + 1}")).alias("SEQ_NAME"), f("SEQ").alias("SEQ"), f("SCORES").alias("SCORES"))
    cut = F.ceil(F.col("SEQ_LEN") * 0.6).cast("int")
    mates = seqs.select(F.explode(F.array(part(0, lambda c: F.substring(F.col(c), F.lit(1), cut)), part(1, lambda c: F.substring(F.col(c), F.length(c) - cut + 1, cut)))).alias("m")).select("m.*")
    return _named(Pipeline().assemble_pairs(mismatch_percent=5, overlap_min=3, allow_unassembled=True).run(mates))


# --- sequence functions


@_query(", k AS (SELECT SEQ_NAME, unnest(list_distinct([substr(SEQ, i, 8) FOR i IN range(1, SEQ_LEN - 6)])) AS k FROM seqs WHERE SEQ_LEN >= 8) SELECT upper(k) AS oligo, count(*) AS n FROM k GROUP BY 1")
def kmer_sharing(spark, sf_dir):
    """How many sequences have each 8-mer."""
    return S.kmer_counts(sequences(spark, sf_dir), "SEQ", 8).select(S.kmer_oligo("kmer", 8).alias("oligo"), "n")


@_query("SELECT c_custkey, hamming(c_mktsegment, reverse(c_mktsegment)) AS d FROM customer")
def hamming(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", S.hamming("c_mktsegment", F.reverse("c_mktsegment")).cast("long").alias("d"))


@_query("SELECT p_partkey, levenshtein(upper(p_name), upper(p_type)) AS d FROM part")
def edit_distance(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", S.edit_distance("p_name", "p_type").cast("long").alias("d"))


@_query(", r AS (SELECT SEQ_NAME, unnest(string_split(upper(SEQ), '')) AS residue FROM seqs WHERE SEQ_LEN > 0) SELECT SEQ_NAME, residue, count(*) AS n FROM r WHERE residue <> '' GROUP BY ALL")
def composition(spark, sf_dir):
    return sequences(spark, sf_dir).select("SEQ_NAME", F.explode(S.composition("SEQ")).alias("residue", "n")).withColumn("n", F.col("n").cast("long"))


@_query("SELECT p_partkey, round(100.0 * (length(p_name) - length(replace(upper(p_name), 'N', ''))) / length(p_name), 2) AS hard, round(100.0 * length(regexp_replace(p_name, '[^a-z]', '', 'g')) / length(p_name), 2) AS soft FROM (SELECT p_partkey, translate(p_name, '-._~', '') AS p_name FROM part)")
def mask_percentages(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", S.hard_mask("p_name").alias("hard"), S.soft_mask("p_name").alias("soft"))


@_query("SELECT SEQ_NAME, regexp_matches(SCORES, '[!-:]') AS low, regexp_matches(SCORES, '[K-h]') AS high, [chr((ascii(SCORES[i]) + 31)::INTEGER) FOR i IN range(1, SEQ_LEN + 1)].array_to_string('') AS scores64 FROM seqs")
def score_encodings(spark, sf_dir):
    return sequences(spark, sf_dir).select("SEQ_NAME", S.is_base_33("SCORES").alias("low"), S.is_base_64("SCORES").alias("high"), S.scores_convert("SCORES", 33, 64).alias("scores64"))


@_query("SELECT SEQ_NAME, '>' || SEQ_NAME || chr(10) || rtrim(regexp_replace(SEQ, '(.{60})', '\\1' || chr(10), 'g'), chr(10)) AS entry FROM seqs")
def fasta_entries(spark, sf_dir):
    return sequences(spark, sf_dir).select("SEQ_NAME", S.to_fasta("SEQ_NAME", "SEQ", 60).alias("entry"))


@_query("SELECT o_orderkey, format('{:,}', o_orderkey * 1000) AS text FROM orders")
def commify(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", S.commify(F.col("o_orderkey") * 1000).alias("text"))


@_query("""
, r AS (SELECT SEQ_NAME, unnest(range(SEQ_LEN)) AS pos, unnest(string_split(upper(SEQ), '')) AS r FROM seqs WHERE SEQ_LEN > 0),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY SEQ_NAME, r ORDER BY pos) AS island FROM r)
SELECT SEQ_NAME, repeat(r, count(*)) AS pattern, count(*)::INTEGER AS length, min(pos)::INTEGER AS pos FROM g GROUP BY SEQ_NAME, r, island HAVING count(*) >= 4""")
def homopolymers(spark, sf_dir):
    return sequences(spark, sf_dir).select("SEQ_NAME", F.explode(search.homopolymers("SEQ", 4)).alias("h")).select("SEQ_NAME", "h.*")


@_query("""
, p AS (SELECT SEQ_NAME, SEQ, unnest([i FOR i IN range(1, SEQ_LEN - 10) IF hamming(substr(SEQ, i, 12), 'gtaccgatcgta') <= 3]) AS i FROM seqs WHERE SEQ_LEN >= 12)
SELECT SEQ_NAME, (i - 1)::INTEGER AS pos, 12 AS length, substr(SEQ, i, 12) AS match FROM p""")
def patscan_mismatches(spark, sf_dir):
    return sequences(spark, sf_dir).select("SEQ_NAME", F.explode(search.patscan("SEQ", "gtaccgatcgta", 3)).alias("m")).select("SEQ_NAME", "m.*")


@_query()
def patscan_fuzzy(spark, sf_dir):
    return sequences(spark, sf_dir).select("SEQ_NAME", search.patmatch("SEQ", "gtaccgatcgtaag", 2, 1, 1).alias("m")).select("SEQ_NAME", "m.*")


#: Start codons and the stop codon that comes next, in any frame (or with ``frame`` in the same), of the sequences ``strands``.
_CODONS = """, shifted AS (SELECT SEQ_NAME, strand, unnest([0, 1, 2]) AS shift, s FROM strands), framed AS (SELECT SEQ_NAME, strand, shift, regexp_extract_all(substr(s, shift + 1), '.{{3}}') AS cs FROM shifted),
codons AS (SELECT SEQ_NAME, strand, shift + 3 * unnest(range(len(cs))) AS pos, unnest(cs) AS c FROM framed),
starts AS (SELECT *{frame} FROM codons WHERE c IN ('atg', 'gtg')), stops AS (SELECT *{frame} FROM codons WHERE c IN ('taa', 'tga', 'tag')),
pairs AS (SELECT a.SEQ_NAME, a.strand, a.pos AS a, z.pos + 2 AS z FROM starts a ASOF JOIN stops z ON a.SEQ_NAME = z.SEQ_NAME AND a.strand = z.strand{same} AND a.pos <= z.pos) """
_PLUS = ", strands AS (SELECT SEQ_NAME, '+' AS strand, SEQ AS s, SEQ_LEN FROM seqs)"
_NEXT = _CODONS.format(frame="", same="")
_OPEN = "JOIN strands USING (SEQ_NAME, strand) WHERE (z - a + 1) % 3 = 0 AND z - a + 1 >= 60 AND a < SEQ_LEN - 60"


@_query(f"""{_PLUS}{_NEXT}, longest AS (SELECT SEQ_NAME, min(a) AS a, z, any_value(s) AS s FROM pairs {_OPEN} GROUP BY SEQ_NAME, z)
SELECT SEQ_NAME, a::INTEGER AS start, z::INTEGER AS stop, substr(s, a + 1, z - a + 1) AS seq FROM longest""")
def orfs(spark, sf_dir):
    return sequences(spark, sf_dir).select("SEQ_NAME", F.explode(search.orfs("SEQ", size_min=60, longest=True)).alias("o")).select("SEQ_NAME", "o.*")


@_query("""
, parts AS (SELECT SEQ_NAME, SEQ, SEQ_LEN, string_split(SEQ, 'gaattc') AS p FROM seqs WHERE SEQ_LEN > 0),
edges AS (SELECT SEQ_NAME, SEQ, list_concat([0], [list_sum([length(p[j]) FOR j IN range(1, i + 1)]) + 6 * (i - 1) + 1 FOR i IN range(1, len(p))], [SEQ_LEN])::BIGINT[] AS e FROM parts),
pieces AS (SELECT SEQ_NAME, SEQ, e, unnest(range(1, len(e))) AS i FROM edges)
SELECT SEQ_NAME, e[i]::INTEGER AS begin, (e[i + 1] - 1)::INTEGER AS "end", substr(SEQ, e[i] + 1, e[i + 1] - e[i]) AS seq FROM pieces
UNION ALL SELECT SEQ_NAME, 0, -1, '' FROM seqs WHERE SEQ_LEN = 0""")
def digest(spark, sf_dir):
    return sequences(spark, sf_dir).select("SEQ_NAME", F.explode(search.digest("SEQ", "GAATTC", 1)).alias("f")).select("SEQ_NAME", "f.*")


_AMINO = "MAP {" + ", ".join(f"'{c.lower()}': '{a}'" for c, a in A.CODONS.items()) + "}"


@_query(f"""{_PLUS}{_NEXT}, genes AS (SELECT SEQ_NAME, a AS start, substr(s, a + 1, z - a + 1) AS g FROM pairs {_OPEN})
SELECT SEQ_NAME, start::INTEGER AS start, 'M' || array_to_string([{_AMINO}[substr(g, 3 * i + 1, 3)] FOR i IN range(1, length(g) // 3 - 1)], '') AS protein FROM genes""")
def proteins(spark, sf_dir):
    genes = sequences(spark, sf_dir).select("SEQ_NAME", F.explode(search.orfs("SEQ", size_min=60)).alias("o"))
    return genes.select("SEQ_NAME", "o.start", S.translate("o.seq").alias("protein"))


@_query(f"""
, strands AS (SELECT SEQ_NAME, '+' AS strand, SEQ AS s, SEQ_LEN FROM seqs UNION ALL SELECT SEQ_NAME, '-', reverse(translate(SEQ, 'acgt', 'tgca')), SEQ_LEN FROM seqs)
{_CODONS.format(frame=", pos % 3 AS frame", same=" AND a.frame = z.frame")}, longest AS (SELECT SEQ_NAME, strand, min(a) AS a, z, any_value(s) AS s, any_value(SEQ_LEN) AS n FROM pairs JOIN strands USING (SEQ_NAME, strand) GROUP BY SEQ_NAME, strand, z)
SELECT SEQ_NAME, substr(s, a + 1, z - a + 1) AS SEQ, z - a + 1 AS "SEQ_LEN", CASE strand WHEN '+' THEN a + 1 ELSE n - z END AS "S_BEG", CASE strand WHEN '+' THEN z + 1 ELSE n - a END AS "S_END", z - a + 1 AS "S_LEN", strand AS "STRAND"
FROM longest WHERE z - a + 1 >= 120""")
def genecall(spark, sf_dir):
    found = Pipeline().genecall(size_min=120).run(sequences(spark, sf_dir)).where("RECORD_TYPE = 'genecall'")
    return found.select("SEQ_NAME", "SEQ", "SEQ_LEN", "S_BEG", "S_END", "S_LEN", "STRAND")


# --- taxonomy and similarity


def _taxa(spark, sf_dir):
    name = lambda c: F.regexp_replace(c, "[^A-Za-z0-9]+", "_")
    taxon = F.concat(F.lit("K#"), name("p_brand"), F.lit(";P#"), name("p_type"), F.lit(";C#"), name("p_name"), F.lit(";O#;F#;G#;S#"))
    seq = F.translate(F.regexp_replace(F.lower(F.concat("p_name", "p_type", "p_brand")), "[^a-z]", ""), _LETTERS, _AS_DNA)
    return _table(spark, sf_dir, "part").select("p_partkey", taxon.alias("SEQ_NAME"), seq.alias("SEQ"))


_AS_NODE = "regexp_replace({}, '[^A-Za-z0-9]+', '_', 'g')"
_TAXA = f"""
WITH taxa AS (SELECT [{", ".join(map(_AS_NODE.format, ("p_brand", "p_type", "p_name")))}] AS names, translate(regexp_replace(lower(p_name || p_type || p_brand), '[^a-z]', '', 'g'), '{_LETTERS}', '{_AS_DNA}') AS s FROM part),
steps AS (SELECT s, names, unnest(range(0, 4)) AS depth FROM taxa),
node_kmers AS (SELECT DISTINCT depth, array_to_string(names[1:depth], ';') AS path, unnest([substr(s, i, 8) FOR i IN range(1, length(s) - 6)]) AS k FROM steps) """


@_query(f"""{_TAXA}, nodes AS (SELECT depth, array_to_string(names[1:depth], ';') AS path, CASE depth WHEN 0 THEN 'R' ELSE 'KPC'[depth] END AS level, CASE depth WHEN 0 THEN 'root' ELSE names[depth] END AS name,
  CASE WHEN depth < 2 THEN '' ELSE array_to_string(names[1:depth - 1], ';') END AS parent, min('K#' || names[1] || ';P#' || names[2] || ';C#' || names[3] || ';O#;F#;G#;S#') AS seq_id FROM steps GROUP BY ALL)
SELECT path, nodes.depth::INTEGER AS depth, level, name, parent, seq_id, kmers FROM nodes LEFT JOIN (SELECT path, count(*) AS kmers FROM node_kmers GROUP BY path) USING (path)""")
def index_taxonomy(spark, sf_dir):
    nodes, kmers = taxonomy.build_index(_taxa(spark, sf_dir), 8)
    return nodes.join(kmers.groupBy("path").agg(F.count("*").alias("kmers")), "path", "left")


@_query(f"""{_TAXA}, asked AS (SELECT s, unnest(list_distinct([substr(s, i, 8) FOR i IN range(1, length(s) - 6)])) AS k FROM (SELECT DISTINCT s FROM taxa)),
sizes AS (SELECT s, count(*) AS n FROM asked GROUP BY s),
shared AS (SELECT s, depth, path, count(*) AS common FROM asked JOIN node_kmers USING (k) GROUP BY ALL),
enough AS (SELECT s, depth, path, common FROM shared JOIN sizes USING (s) WHERE common >= n * 0.9::DOUBLE),
best AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY s ORDER BY depth DESC, common DESC) AS place FROM enough) WHERE place = 1 QUALIFY row_number() OVER (PARTITION BY s ORDER BY path) <= 50),
hits AS (SELECT s, count(*) AS hits FROM best GROUP BY s),
levels AS (SELECT s, unnest(range(depth)) AS level, string_split(path, ';') AS names FROM best),
words AS (SELECT s, level, unnest(range(len(string_split(names[level + 1], '_')))) AS pos, string_split(names[level + 1], '_') AS w FROM levels),
counted AS (SELECT s, level, pos, w[pos + 1] AS word, count(*) AS c FROM words GROUP BY ALL),
agreed AS (SELECT s, level, string_agg(word, ' ' ORDER BY pos, c DESC, word) AS names, string_agg((100 * c // hits)::VARCHAR, '/' ORDER BY pos, c DESC, word) AS percents FROM counted JOIN hits USING (s) WHERE c >= hits * 0.51::DOUBLE GROUP BY s, level),
unbroken AS (SELECT * FROM agreed QUALIFY level = row_number() OVER (PARTITION BY s ORDER BY level) - 1),
texts AS (SELECT s, string_agg('KPC'[level + 1] || '#' || names || '(' || percents || ')', ';' ORDER BY level) AS t FROM unbroken GROUP BY s)
SELECT d.s AS seq, coalesce(t, 'Unclassified') AS "TAXONOMY", coalesce(hits, 0) AS "TAXONOMY_HITS" FROM (SELECT DISTINCT s FROM taxa) d LEFT JOIN hits USING (s) LEFT JOIN texts USING (s)""")
def classify_seq(spark, sf_dir):
    taxa = _taxa(spark, sf_dir)
    _, kmers = taxonomy.build_index(taxa, 8)
    return taxonomy.classify(taxa.select(F.col("SEQ").alias("seq")), kmers, 8)


_ITEMS = f"(SELECT item_id, 'B' || item_id AS name, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{_LETTERS}', '{_AS_DNA}') AS s FROM benchmark)"


@_query(f"""
, q AS (SELECT item_id, unnest(range(length(s) - 59)) AS q_pos, s FROM {_ITEMS} WHERE length(s) >= 60), d AS (SELECT ord, unnest(range(SEQ_LEN - 59)) AS s_pos, SEQ AS s FROM seqs WHERE SEQ_LEN >= 60),
seeds AS (SELECT item_id, ord, q_pos, s_pos - q_pos AS diagonal FROM (SELECT item_id, q_pos, substr(s, q_pos + 1, 60) AS k FROM q) JOIN (SELECT ord, s_pos, substr(s, s_pos + 1, 60) AS k FROM d) USING (k)),
islands AS (SELECT *, q_pos - row_number() OVER (PARTITION BY item_id, ord, diagonal ORDER BY q_pos) AS island FROM seeds)
SELECT item_id AS q_id, ord AS s_id, 'forward' AS dir, min(q_pos)::INTEGER AS q_beg, (min(q_pos) + diagonal)::INTEGER AS s_beg, count(*) + 59 AS hit_len FROM islands GROUP BY item_id, ord, diagonal, island""")
def maximal_exact_matches(spark, sf_dir):
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), _LETTERS, _AS_DNA).alias("seq"))
    documents = sequences(spark, sf_dir).select(F.col(ORD).alias("id"), F.col("SEQ").alias("seq"))
    return maximal_matches(items, documents, 60, "forward")


@_query()
def uclust(spark, sf_dir):
    return _named(Pipeline().uclust(identity=0.9).run(_items(spark, sf_dir)))


@_query()
def uclust_align(spark, sf_dir):
    """Clusters of the passages and of the same with a residue replaced, aligned."""
    both = _items(spark, sf_dir).unionByName(_mutated(spark, sf_dir).withColumn(ORD, F.col(ORD) + (1 << 40)))
    return _named(Pipeline().uclust(identity=0.9, align=True).run(both))


def _items(spark, sf_dir):
    """The benchmark passages as sequences."""
    seq = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), _LETTERS, _AS_DNA)
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias(ORD), F.concat(F.lit("B"), F.col("item_id").cast("string")).alias("SEQ_NAME"), seq.alias("SEQ"))


def _mutated(spark, sf_dir):
    """The same with a residue near the end replaced, where there are ten at least."""
    changed = F.concat(F.expr("substring(SEQ, 1, length(SEQ) - 3)"), F.lit("n"), F.expr("right(SEQ, 2)"))
    return _items(spark, sf_dir).withColumn("SEQ", F.when(F.length("SEQ") >= 10, changed).otherwise(F.col("SEQ"))).withColumn("SEQ_NAME", F.concat(F.lit("M"), "SEQ_NAME"))


@_query(f"""
WITH q AS (SELECT 'M' || name AS q_id, CASE WHEN length(s) >= 10 THEN left(s, -3) || 'n' || right(s, 2) ELSE s END AS q FROM {_ITEMS} WHERE s <> ''),
pairs AS (SELECT q_id, q, name, 1 - levenshtein(q, s)::DOUBLE / greatest(length(q), length(s)) AS ident FROM q JOIN {_ITEMS} ON length(s) BETWEEN 0.8 * length(q) AND 1.25 * length(q))
SELECT q_id AS "Q_ID", name AS "S_ID", round(100 * ident, 1) AS "IDENT", '+' AS "STRAND", length(q) AS "SEQ_LEN" FROM pairs WHERE ident >= 0.9::DOUBLE QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY ident DESC, name) = 1""")
def usearch_global(spark, sf_dir):
    out = Pipeline().usearch_global(database=_items(spark, sf_dir), identity=0.9).run(_mutated(spark, sf_dir))
    return out.where("RECORD_TYPE = 'usearch'").select("Q_ID", "S_ID", "IDENT", "STRAND", "SEQ_LEN")


@_query()
def usearch_local(spark, sf_dir):
    part = _items(spark, sf_dir).withColumn("SEQ", F.expr("if(length(SEQ) >= 40, substring(SEQ, 11, length(SEQ) - 20), SEQ)"))
    out = Pipeline().usearch_local(database=_items(spark, sf_dir), identity=0.9, strand="both").run(part)
    return out.where("RECORD_TYPE = 'usearch'").select("Q_ID", "S_ID", "IDENT", "STRAND", "SEQ_LEN")


@_query()
def cluster_otus(spark, sf_dir):
    both = _items(spark, sf_dir).unionByName(_mutated(spark, sf_dir))
    return _named(Pipeline().dereplicate_seq().cluster_otus(identity=0.95).run(both))


@_query(f"""
, refs AS (SELECT s FROM {_ITEMS} UNION ALL SELECT reverse(translate(s, 'acgt', 'tgca')) FROM {_ITEMS}),
known AS (SELECT DISTINCT unnest([substr(s, i, 12) FOR i IN range(1, length(s) - 10)]) AS k FROM refs),
mine AS (SELECT SEQ, unnest(list_distinct([substr(SEQ, i, 12) FOR i IN range(1, SEQ_LEN - 10)])) AS k FROM (SELECT DISTINCT SEQ, SEQ_LEN FROM seqs)),
near AS (SELECT SEQ FROM mine LEFT JOIN known USING (k) GROUP BY SEQ HAVING count(known.k) >= 0.2::DOUBLE * count(*))
SELECT SEQ_NAME, SEQ_LEN FROM seqs WHERE SEQ NOT IN (SELECT SEQ FROM near)""")
def filter_rrna(spark, sf_dir):
    """The documents that share few k-mers with the benchmark passages."""
    return Pipeline().filter_rrna(ref_fasta=_items(spark, sf_dir), shared=0.2).run(sequences(spark, sf_dir)).select("SEQ_NAME", "SEQ_LEN")


@_query()
def uchime_ref(spark, sf_dir):
    return Pipeline().uchime_ref(database=_items(spark, sf_dir)).run(_mutated(spark, sf_dir)).select("SEQ_NAME")


@_query()
def align_seq_mothur(spark, sf_dir):
    return Pipeline().align_seq_mothur(template_file=_items(spark, sf_dir)).run(_mutated(spark, sf_dir)).select("SEQ_NAME", "SEQ", "SEQ_LEN")


@_query()
def classify_seq_mothur(spark, sf_dir):
    taxa = _taxa(spark, sf_dir).select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("SEQ_NAME"), "SEQ", F.regexp_replace("SEQ_NAME", "[KPC]#|;[OFG]#;?|;?S#", "").alias("taxon"))
    found = Pipeline().classify_seq_mothur(database=taxa, taxonomy=taxa).run(taxa.select("SEQ_NAME", "SEQ"))
    return found.select("SEQ_NAME", "TAXONOMY")


def _reads(spark, sf_dir):
    """Overlapping reads of the benchmark passages; assemblers take them by their own lengths of k-mers."""
    return _items(spark, sf_dir).select("SEQ_NAME", F.explode(S.naive_kmers("SEQ", 60, 10)).alias("SEQ"))


@_query()
def assemble_seq(spark, sf_dir):
    return Pipeline().assemble_seq_spades().run(_reads(spark, sf_dir))


@_query()
def assemble_seq_idba(spark, sf_dir):
    return Pipeline().assemble_seq_idba().run(_reads(spark, sf_dir))


@_query("SELECT event_id, user_id, CASE WHEN event_type = 'click' THEN 'forward' ELSE 'reverse' END AS dir FROM events WHERE event_type IN ('click', 'view')")
def match_vectors(spark, sf_dir):
    events = _table(spark, sf_dir, "events").where("event_type IN ('click', 'view')")
    strand = F.when(F.col("event_type") == "click", "+").otherwise("-")
    rows = events.select(F.col("event_id").alias("Q_BEG"), F.col("event_id").alias("Q_END"), F.col("user_id").alias("S_BEG"), F.col("user_id").alias("S_END"), strand.alias("STRAND"))
    return plots.match_vectors(rows).select(F.col("x0").alias("event_id"), F.col("y0").alias("user_id"), "dir")


@_query("SELECT p_partkey, CASE WHEN p_size >= 25 THEN p_brand || '(100);' || p_type || '(' || p_size || ')' ELSE p_brand || '(100)' END AS \"TAXONOMY\" FROM part")
def filter_taxonomy(spark, sf_dir):
    name = F.concat("p_brand", F.lit("(100);"), "p_type", F.lit("("), F.col("p_size").cast("string"), F.lit(")"))
    return Pipeline().filter_taxonomy(confidence=25).run(_table(spark, sf_dir, "part").select("p_partkey", name.alias("TAXONOMY")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name -> function of (spark, sf_dir)."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """Query name -> DuckDB SQL with the same columns."""
    return dict(_SQL)
