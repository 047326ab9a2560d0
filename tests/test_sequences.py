import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.functions import search
from helixframe.functions import sequence as S
from helixframe.operators.aggregate import residue_counts
from helixframe.operators.cluster import greedy_centroids
from helixframe.operators.external import _path_ranks, align_pair
from helixframe.operators.join import maximal_matches, similar
from helixframe.operators.taxonomy import build_index, classify
from helixframe.pipeline import Pipeline as P
from helixframe.schema import DataError


def value(spark, expression, **columns):
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns))
    return df.select(expression.alias("x")).first().x


def seqs(spark, *data):
    return spark.createDataFrame([(i, f"s{i}", s, q) for i, (s, q) in enumerate(data)], "__ord long, SEQ_NAME string, SEQ string, SCORES string")


def one(df, *names):
    return tuple(df.orderBy("__ord").select(*names).first())


def test_kmers(spark):
    q = "aNacCGactGAtacACGTAC"
    plain = sorted({int("".join("0123"["ATCG".index(c)] for c in w), 4) for i in range(len(q) - 4) if "N" not in (w := q.upper()[i : i + 5])})
    assert value(spark, S.kmers("s", 5), s=q) == plain
    assert len(value(spark, S.kmers("s", 5, 2), s=q)) == 7
    assert value(spark, S.kmers("s", 5), s="acg") == []
    assert value(spark, S.kmers("s", 3, 1, "q", 40), s="acgtac", q="IIIIHI") == sorted({int("0123"["ATCG".index(a)] + "0123"["ATCG".index(b)] + "0123"["ATCG".index(c)], 4) for a, b, c in ("ACG", "CGT")})
    assert value(spark, S.kmer_oligo(S.kmers("s", 4)[0], 4), s="GTCA") == "GTCA"


def test_scalar_functions(spark):
    v = lambda e, **c: value(spark, e, **c)
    assert [v(S.type_guess("s"), s=x) for x in ("atcg", "aucg", "atcgp")] == ["dna", "rna", "protein"]
    assert v(S.reverse_complement("s"), s="ATCGRYn") == "nRYCGAT"
    assert v(S.complement("s", "rna"), s="AUCG") == "UAGC"
    assert v(S.hamming("a", "b"), a="ATCG", b="atgg") == 1
    assert v(S.hamming("a", "b", True), a="ATCG", b="atng") == 0
    assert v(S.hamming("a", "b"), a="ATCG", b="atc") is None
    assert v(S.edit_distance("a", "b"), a="ATCG", b="tgccg") == 3
    assert v(search.ambiguous_edit_distance("a", "b"), a="ATCG", b="tgncg") == 2
    assert v(S.to_key("s"), s="ACGT") == 0b00011011
    assert v(S.hard_mask("s"), s="--NNAaATC") == 28.57
    assert v(S.soft_mask("s"), s="--NNAaATC") == 14.29
    assert v(S.composition("s"), s="aAc-") == {"A": 2, "C": 1, "-": 1}
    assert v(S.translate("s"), s="atggccgaatga") == "MAE"
    assert v(S.translate("s"), s="gccatgtga") is None
    assert v(S.indels("s"), s="A-.T~_") == 4
    assert v(S.scores_mean("q"), q="!I") == 20.0
    assert (v(S.scores_min("q"), q="!I"), v(S.scores_max("q"), q="!I")) == (0, 40)
    assert v(S.scores_convert("q", 64, 33), q="@Jh") == "!+I"
    assert v(S.scores_coerce("q"), q="!IJ~") == "!III"
    assert [v(S.scores_valid("q"), q=x) for x in ("!I", "J")] == [True, False]
    assert v(S.commify("n"), n="1234567.25") == "1,234,567.25"
    assert v(S.slice_seq("s", -4), s="ATCGAT") == "C"
    assert v(S.slice_seq("s", 1, 3, True), s="ATCGAT") == "TC"
    assert v(S.slice_seq("s", 9, 12), s="ATCGAT") == ""
    assert v(S.exact_position("s", "GNT"), s="aacgatt") == 3
    assert v(S.pair_base("s"), s="read 1:N:0:14") == "read" and v(S.pair_base("s"), s="r/2") == "r" and v(S.pair_base("s"), s="r") is None
    assert len(S.generate_oligos(3)) == 64
    assert len(v(S.generate(12, "dna", 1), s="x")) == 12 and sorted(v(S.shuffle_seq("s", 1), s="abc")) == ["a", "b", "c"]


def test_degap(spark):
    assert one(P().degap_seq().run(seqs(spark, ("AT--C.G~", "IIIIIIII"))), "SEQ", "SEQ_LEN", "SCORES") == ("ATCG", 4, "IIII")
    columns = P().degap_seq(columns_only=True).run(seqs(spark, ("ATA-C.G~", None), ("AT--C.G.", None)).drop("SCORES"))
    assert [r.SEQ for r in columns.orderBy("__ord").collect()] == ["ATACG", "AT-CG"]
    odd = P().degap_seq(columns_only=True).run(seqs(spark, ("-._~", None), (None, None), ("~~~~", None)).drop("SCORES"))
    assert [(r.SEQ, r.SEQ_LEN) for r in odd.orderBy("__ord").collect() if r.SEQ is not None] == [("", 0), ("", 0)] and odd.count() == 3
    assert P().degap_seq(columns_only=True).run(seqs(spark, (None, None)).drop("SCORES")).count() == 1
    with pytest.raises(DataError):
        P().degap_seq(columns_only=True).run(seqs(spark, ("AT", None), ("ATC", None)))


def test_scores(spark):
    df = seqs(spark, ("a" * 20, "I" * 20), ("a" * 20, "!" * 5 + "I" * 15), ("a" * 20, "I" * 10 + "!" * 5 + "I" * 5))
    assert [r.SCORES_MEAN for r in P().mean_scores().run(df).orderBy("__ord").collect()] == [40.0, 30.0, 30.0]
    assert [r.SCORES_MEAN_LOCAL for r in P().mean_scores(local=True).run(df).orderBy("__ord").collect()] == [40.0, 0.0, 0.0]
    assert [r.SCORES_MEAN_LOCAL for r in P().mean_scores(local=True, window_size=10).run(df).orderBy("__ord").collect()] == [40.0, 20.0, 20.0]


def test_trim_and_mask(spark):
    df = seqs(spark, ("gatcgatcgtacgagcag", "!!!IIIIIII5!!III!!"))
    assert one(P().trim_seq().run(df), "SEQ", "SCORES", "SEQ_LEN") == ("cgatcgtacgagc", "IIIIIII5!!III", 13)
    assert one(P().trim_seq(mode="left").run(df), "SEQ") == ("cgatcgtacgagcag",)
    assert one(P().trim_seq(mode="right").run(df), "SEQ") == ("gatcgatcgtacgagca",)  # one residue more
    none = seqs(spark, ("acgt", "!!!!"))
    assert [one(P().trim_seq(mode=m).run(none), "SEQ")[0] for m in ("both", "left", "right")] == ["", "", "a"]
    assert one(P().mask_seq().run(seqs(spark, ("aC-gt", "!I!!I"))), "SEQ") == ("aC-gT",)
    assert one(P().mask_seq(mask="hard").run(seqs(spark, ("aC-gt", "!I!!I"))), "SEQ") == ("NC-NT",)


def test_involutions(spark):
    df = seqs(spark, ("ATCGRYKMBVDHNSW", "I" * 15))
    twice = P().reverse_seq().complement_seq(type="dna").reverse_seq().complement_seq(type="dna").run(df)
    assert one(twice, "SEQ") == ("ATCGRYKMBVDHNSW",)
    with pytest.raises(Exception, match="no complement of a protein"):
        P().complement_seq().run(seqs(spark, ("FLPQ", None))).collect()


def test_primers(spark):
    df = seqs(spark, ("actgactgaTCGTATGCCGTCTTCTGCTTactacgt", "I" * 36), ("aaaa", "IIII"))
    hit = one(P().clip_primer(primer="TGACTACGACTACGACTACT", direction="forward", mismatch_percent=0).run(df), "SEQ", "CLIP_PRIMER_POS")
    assert hit == ("actgactgaTCGTATGCCGTCTTCTGCTTactacgt", None)
    assert one(P().clip_primer(primer="TCGTATGCCGTCTTCTGCTT", direction="forward").run(df), "SEQ", "SEQ_LEN", "CLIP_PRIMER_DIR", "CLIP_PRIMER_POS", "CLIP_PRIMER_LEN", "CLIP_PRIMER_PAT") == ("actacgt", 7, "FORWARD", 9, 20, "TCGTATGCCGTCTTCTGCTT")
    assert one(P().clip_primer(primer="TCGTATGCCGTCTTCTGCTT", direction="reverse").run(df), "SEQ") == ("actgactga",)
    assert one(P().clip_primer(primer="AAGCAGAAGACGGCATACGA", direction="reverse", reverse_complement=True).run(df), "SEQ") == ("actgactga",)
    assert one(P().clip_primer(primer="TCGTATGCCGTCTTCTGCTA", direction="forward", mismatch_percent=10).run(df), "SEQ") == ("actacgt",)
    assert one(P().clip_primer(primer="ACTGACTGA", direction="forward", search_distance=9).run(df), "CLIP_PRIMER_POS") == (0,)
    assert one(P().clip_primer(primer="ACTACGT", direction="forward", search_distance=9).run(df), "CLIP_PRIMER_POS") == (None,)
    assert one(P().trim_primer(primer="ggactga", direction="forward").run(df), "SEQ", "TRIM_PRIMER_LEN") == ("ctgaTCGTATGCCGTCTTCTGCTTactacgt", 5)
    assert one(P().trim_primer(primer="acgtgg", direction="reverse", overlap_min=2).run(df), "SEQ", "TRIM_PRIMER_POS", "TRIM_PRIMER_PAT") == ("actgactgaTCGTATGCCGTCTTCTGCTTact", 32, "acgt")


def test_slice_align(spark):
    df = seqs(spark, ("CCGCATACG-------CCCTGAGGGG----", None), ("CCGCATGAT-------ACCTGAGGGT----", None)).drop("SCORES")
    assert one(P().slice_align(start=14, stop=27).run(df), "SEQ") == ("--CCCTGAGGGG--",)
    assert [r.SEQ for r in P().slice_align(forward="CGCATACG", reverse="GAGGGG", max_mismatches=0, max_insertions=0, max_deletions=0).run(df).orderBy("__ord").collect()] == ["CGCATACG-------CCCTGAGGGG", "CGCATGAT-------ACCTGAGGGT"]
    with pytest.raises(DataError):
        P().slice_align(forward="TTTTTTTTTT", reverse="GAGGGG").run(df)


def plain_matches(p, seq):
    bits = search._BITS[list(seq.encode())].tolist()
    hits = ((at, p._end(bits, len(bits), len(p._pattern), at, 0, *p._budget, "", set())) for at in range(len(bits)))
    return [(at, end - at) for at, end in hits if end]


@settings(max_examples=300, deadline=None)
@given(st.text("acgtnr", min_size=1, max_size=8), st.text("acgt-", min_size=1, max_size=40), st.tuples(*[st.integers(0, 2)] * 3))
def test_fuzzy_search_tries_every_place_that_can_match(pattern, seq, budget):
    p = search.FuzzyPattern(pattern, *budget)
    assert p.all(seq) == plain_matches(p, seq)


def test_search_columns(spark):
    m = value(spark, search.patmatch("s", "ATNG", 0, 0, 0), s="ggatcgatcg")
    assert (m.pos, m.length, m.match) == (2, 4, "atcg")
    assert [x.pos for x in value(spark, search.patscan("s", "atcg"), s="ggatcgatcg")] == [2, 6]
    assert value(spark, search.patmatch("s", "aaaa", 1), s="gggg") is None
    with pytest.raises(ValueError):
        search.patmatch("s", "a!c")
    with pytest.raises(ValueError):
        search.patmatch("s", "acg", 6)
    assert [tuple(x) for x in value(spark, search.edit_matches("s", "acgt", 0), s="ttacgtt")] == [(2, 4, 0, 0, 0)]
    assert [(o.start, o.stop) for o in value(spark, search.orfs("s"), s="aatgccgtgaaatgtaa")] == [(1, 9), (11, 16)]
    assert [(f.begin, f.end, f.seq) for f in value(spark, search.digest("s", "GAATTC", 1), s="ccgaattcaa")] == [(0, 2, "ccg"), (3, 9, "aattcaa")]
    assert [(h.pattern, h.length, h.pos) for h in value(spark, search.homopolymers("s", 3), s="aaccctttt")] == [("CCC", 3, 2), ("TTTT", 4, 5)]


def test_genes_end_at_the_next_stop_in_frame():
    rng = random.Random(14)
    for _ in range(200):
        s = "".join(rng.choice("ACGT") for _ in range(rng.randint(3, 120)))
        want = {}
        for i in range(len(s) - 2):
            if s[i : i + 3] in ("ATG", "GTG"):
                stop = next((e for e in range(i, len(s) - 2, 3) if s[e : e + 3] in ("TAA", "TGA", "TAG")), None)
                if stop is not None and stop + 3 - i >= 12 and stop not in want:
                    want[stop] = (i, stop + 2)
        assert search.genes_of(s, 12) == sorted(want.values())


def test_digests_hold_every_residue(spark):
    s = "cgatcgatcGGATCCgagagggtgtgtagtgGAATTCcgctgc"
    v = lambda pattern, cut: [(f.begin, f.end, f.seq) for f in value(spark, search.digest("s", pattern, cut), s=s)]
    assert v("GGATCC", 1) == [(0, 9, "cgatcgatcG"), (10, 42, "GATCCgagagggtgtgtagtgGAATTCcgctgc")]
    assert v("CGATCG", -1) == [(0, 42, s)] and v("AATTCcgctgc", 15) == [(0, 42, s)]
    assert [f[2] for f in v("GAATTC", 11)] == [s[:-1], s[-1]]  # a cut before the last residue
    rng = random.Random(2)
    for _ in range(200):
        t = "".join(rng.choice("AC") for _ in range(rng.randint(0, 12)))
        cut = rng.randint(-3, 5)
        pieces = search.fragments_of(t, rng.choice(["A", "CA", "AAC"]), cut)
        assert "".join(t[a:b] for a, b in pieces) == t and all(a < b for a, b in pieces) or not t


def test_masks_and_counts_of_odd_sequences(spark):
    assert value(spark, S.mask("s", "q", 20), s="aT-éG", q="!I!!") == "aT-éG"
    assert value(spark, S.mask("s", "q", 20, True), s="aT-éGc", q="!I!I") == "NT-ÉGC"
    assert value(spark, S.mask("s", "q", 20), s=None, q="I") is None and value(spark, S.mask("s", "q", 20), s="", q="") == ""
    rows = [("acé",), ("aC",), (None,), ("",), ("x" * 5000,)]
    found = {(r.pos, r.residue): r.n for r in residue_counts(spark.createDataFrame(rows, "SEQ string").repartition(1), block=4).collect()}
    want = {}
    for (t,) in rows:
        for k, c in enumerate((t or "").upper()):
            want[k, c] = want.get((k, c), 0) + 1
    assert found == want
    counts = {r.kmer: r.n for r in S.kmer_counts(spark.createDataFrame([("acgt",), ("acg",), (None,), ("nn",)], "SEQ string"), "SEQ", 3).collect()}
    assert sorted(counts.values()) == [1, 2]


def test_open_reading_frames_are_those_with_the_next_stop_in_frame():
    rng = random.Random(4)
    for _ in range(300):
        s = "".join(rng.choice("ACGT") for _ in range(rng.randint(3, 60)))
        stops = [i for i in range(len(s) - 2) if s[i : i + 3] in ("TAA", "TGA", "TAG")]
        want = [(i, e + 2) for i in range(len(s)) if s[i : i + 3] in ("ATG", "GTG") and (e := next((x for x in stops if x >= i), None)) is not None and (e - i) % 3 == 0]
        assert search.orfs_of(s) == want


def test_pairs(spark):
    df = spark.createDataFrame([(0, "x/1", "aaaaaaaagagtcat", "I" * 15), (1, "x/2", "gagtcataaaaaaaa", "!" * 15), (2, "y/1", "aaaa", "IIII"), (3, "y/2", "cccc", "IIII"), (4, "z/1", "tt", "II")], "__ord long, SEQ_NAME string, SEQ string, SCORES string")
    got = P().assemble_pairs(mismatch_percent=0, overlap_min=3).run(df).orderBy("__ord").collect()
    assert (got[0].SEQ_NAME, got[0].SEQ, got[0].SCORES, got[0].OVERLAP_LEN, got[0].HAMMING_DIST) == ("x/1:overlap=7:hamming=0", "aaaaaaaaGAGTCATaaaaaaaa", "IIIIIIII5555555!!!!!!!!", 7, 0)
    assert [r.SEQ_NAME for r in got[1:]] == ["z/1"]
    merged = P().assemble_pairs(mismatch_percent=0, overlap_min=3, merge_unassembled=True).run(df).orderBy("__ord").collect()
    assert (merged[1].SEQ, merged[1].OVERLAP_LEN, merged[1].HAMMING_DIST) == ("aaaacccc", 0, 8)
    assert P().assemble_pairs(mismatch_percent=0, overlap_min=3, allow_unassembled=True).run(df).count() == 4
    both = P().merge_pair_seq().split_pair_seq().run(df).orderBy("__ord").collect()
    assert sorted((r.SEQ_NAME, r.SEQ, r.SCORES) for r in both) == sorted((r.SEQ_NAME, r.SEQ, r.SCORES) for r in df.collect())
    assert search.assembled("ggacgtcc", "acgt", None, None, 0, 4, None)[0] == "ggACGTcc"
    with pytest.raises(Exception, match="names don't match"):
        P().merge_pair_seq().run(df.where("__ord IN (1, 2)")).collect()


def test_dereplicate_and_residues(spark):
    df = seqs(spark, ("ATCG", None), ("ATCG", None), ("atcg", None), ("GG", None)).drop("SCORES")
    assert sorted((r.SEQ, r.SEQ_COUNT) for r in P().dereplicate_seq().run(df).collect()) == [("ATCG", 2), ("GG", 1), ("atcg", 1)]
    assert sorted((r.SEQ, r.SEQ_COUNT) for r in P().dereplicate_seq(ignore_case=True).run(df).collect()) == [("ATCG", 3), ("GG", 1)]
    wide = P().analyze_residue_distribution(percent=True).run(df).where("V0 IS NOT NULL").collect()
    assert {r.V0: (r.V1, r.V2, r.V3, r.V4) for r in wide} == {"A": (75, 0, 0, 0), "T": (0, 75, 0, 0), "C": (0, 0, 100, 0), "G": (25, 25, 0, 100)}


def test_taxonomy(spark):
    names = ["K#a;P#b;C#;O#;F#;G#;S#", "K#a;P#c;C#d;O#;F#;G#;S#", "K#a;P#c;C#d_1;O#;F#;G#;S#", "K#a;P#c;C#d_1_2;O#;F#;G#;S#"]
    df = spark.createDataFrame(list(zip(names, ["aagc", "aagag", "aagag", "aagaa"], strict=True)), "SEQ_NAME string, SEQ string")
    nodes, kmers = build_index(df, 3)
    assert {(r.level, r.path) for r in nodes.collect()} == {("R", ""), ("K", "a"), ("P", "a;b"), ("P", "a;c"), ("C", "a;c;d"), ("C", "a;c;d_1"), ("C", "a;c;d_1_2")}
    ask = lambda s, *o: tuple(classify(spark.createDataFrame([(s,)], "seq string"), kmers, 3, 1, *o).first())[1:]
    assert ask("aaga", 5, 0.0, 1.0, False) == ("K#a(100);P#c(100);C#d 1 2(100/66/33)", 3)
    assert ask("aagat", 5, 0.0, 1.0, False) == ("Unclassified", 0)
    assert ask("aaga", 2, 0.0, 0.0, False) == ("K#a(100);P#c(100);C#d 1(100/50)", 2)
    assert ask("aaga", 5, 0.34, 0.0, False) == ("K#a(100);P#c(100);C#d 1(100/66)", 3)
    with pytest.raises(Exception, match="no taxonomy name"):
        build_index(spark.createDataFrame([("K#a;P#;C#x;O#;F#;G#;S#", "aagc")], "SEQ_NAME string, SEQ string"), 3)[0].collect()


def test_taxonomy_files(spark, tmp_path):
    df = spark.createDataFrame([("1 K#a;P#b;C#;O#;F#;G#;S#", "aagcttagcattag")], "SEQ_NAME string, SEQ string")
    P().index_taxonomy(output_dir=str(tmp_path), kmer_size=4).run(df)
    got = P().classify_seq(dir=str(tmp_path), kmer_size=4).run(df).first()
    assert (got.TAXONOMY, got.TAXONOMY_HITS) == ("K#a(100);P#b(100)", 1)


def test_clusters_and_searches(spark, tmp_path):
    base = "ACCGACTGATACACGTACGTACGTACTTGGCATTACGA"
    other = "TTTTGGGGCCCCAAAATTTTGGGGACGTCAGTCAGTCA"
    near = base[:20] + "C" + base[21:]
    df = seqs(spark, (base, None), (near, None), (other, None), (base, None)).drop("SCORES")
    got = {r["__ord"]: (r.CLUSTER, r.TYPE) for r in P().uclust(identity=0.9).run(df).collect()}
    assert got == {0: (0, "S"), 1: (0, "H"), 2: (1, "S"), 3: (0, "S")}
    otus = P().dereplicate_seq().cluster_otus(identity=0.9).run(df).collect()
    assert sorted((r.SEQ, r.SEQ_COUNT) for r in otus) == sorted([(base, 3), (other, 1)])
    fasta = tmp_path / "db.fasta"
    fasta.write_text(f">x\n{base}\n>y\n{other}\n")
    hits = P().usearch_global(database=str(fasta), identity=0.9).run(df).where("RECORD_TYPE = 'usearch'").collect()
    assert {(r.Q_ID, r.S_ID) for r in hits} == {("s0", "x"), ("s1", "x"), ("s2", "y"), ("s3", "x")}
    assert {r.SEQ for r in P().filter_rrna(ref_fasta=str(fasta)).run(seqs(spark, (base, None), ("A" * 30, None))).collect()} == {"A" * 30}
    assert P().uchime_ref(database=str(fasta)).run(seqs(spark, (base, None), (base[:19] + other[19:], None))).count() == 1
    found = maximal_matches(spark.createDataFrame([("q", "GG" + base[:25])], "id string, seq string"), spark.createDataFrame([("t", base)], "id string, seq string"), 20, "forward").collect()
    assert [(r.q_beg, r.s_beg, r.hit_len) for r in found] == [(2, 0, 25)]


def test_no_sequence_stays_undecided(spark):
    chain = [(i, "G" * i + "A" * (10 - i), i) for i in range(6)]  # each is similar to the one before
    df = spark.createDataFrame(chain, "id long, seq string, rank long")
    assert sorted((r.id, r.centroid) for r in greedy_centroids(df, 0.9).collect()) == [(0, 0), (1, 0), (2, 2), (3, 2), (4, 4), (5, 4)]
    with pytest.raises(DataError, match="undecided"):
        greedy_centroids(df, 0.9, rounds=2)


def plain_distance(a, b, anywhere=False):
    row = [0] * (len(b) + 1) if anywhere else list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return min(row) if anywhere else row[-1]


@pytest.mark.parametrize("identity", [0.5, 0.8, 0.9, 1.0])
@pytest.mark.parametrize("letters", ["ACGT", "ACDEFGHIKLMNPQRSTVWY"])
def test_similar_pairs_are_those_of_brute_force(spark, identity, letters):
    rng = random.Random(2)
    found = ["A", "AC", "ACGTACG"]
    for n in (3, 6, 10, 12, 15, 22, 31, 60, 100):
        one = [rng.choice(letters) for _ in range(n)]
        found.append("".join(one))
        for share in (0.06, 0.1, 0.2):
            turned = [rng.choice(letters) if i % max(1, round(1 / share)) == 1 else x for i, x in enumerate(one)]
            found += ["".join(turned), "".join(turned[: max(1, n - round(share * n))])]
    rows = list(enumerate(dict.fromkeys(found)))
    q, s = spark.createDataFrame(rows, "q_id long, q string"), spark.createDataFrame(rows, "s_id long, s string")
    got = [(r.q_id, r.s_id) for r in similar(q, s, identity).collect()]
    assert sorted(got) == [(i, j) for i, a in rows for j, b in rows if 1 - plain_distance(a, b) / max(len(a), len(b)) >= identity]
    within = {(r.q_id, r.s_id): r.ident for r in similar(q, s, identity, local=True).collect()}
    fits = {(i, j): 1 - fewest / len(a) for i, a in rows for j, b in rows if 1 - (fewest := plain_distance(a, b, anywhere=True)) / len(a) >= identity - 1e-9}
    assert within == pytest.approx(fits)


def test_aligned_clusters_keep_every_residue(spark):
    given = ["ACGTACGTACGTACGTACGT", "ACGTACGTTACGTACGTACGT", "ACGTACGTACGTACGTACG", "GGACGTACGTACGTACGTACGT", "TTTTTTTTTTTTTTTTTTTT", "AAAATTTTTTTTTTTTTTTTTTTT"[4:] + "C"]
    df = spark.createDataFrame([(i, f"s{i}", s, len(s)) for i, s in enumerate(given)], "__ord long, SEQ_NAME string, SEQ string, SEQ_LEN long")
    rows = P().uclust(identity=0.85, align=True).run(df).orderBy("__ord").collect()
    assert [r.SEQ.replace("-", "") for r in rows] == given
    assert [r.CLUSTER for r in rows] == [0, 0, 0, 0, 1, 1]
    assert {r.CLUSTER: r.SEQ_LEN for r in rows} == {0: 23, 1: 21} and all(len(r.SEQ) == r.SEQ_LEN for r in rows)
    turned = spark.createDataFrame([(0, "a", "AACCGTTTACGATTACAGGA"), (1, "b", S.A.reverse_complement("AACCGTTACGATTACAGGA"))], "__ord long, SEQ_NAME string, SEQ string")
    both = P().uclust(identity=0.9, strand="both", align=True).run(turned).orderBy("__ord").collect()
    assert [r.STRAND for r in both] == ["+", "-"] and both[1].SEQ.replace("-", "") == "AACCGTTACGATTACAGGA" and len(both[1].SEQ) == 20


def test_assembly_and_alignment(spark):
    genome = "ATGCGTACGTTAGCCGATCGGATCCATTGCAACTG"
    reads = spark.createDataFrame([(i, f"r{i}", genome[i : i + 15]) for i in range(len(genome) - 14)], "__ord long, SEQ_NAME string, SEQ string")
    contigs = [r.SEQ for r in P().assemble_seq_spades(kmers="11").run(reads).collect()]
    assert contigs in ([genome], [S.A.reverse_complement(genome)])
    ring = spark.createDataFrame([(0, "r", "ACGTTGCA" * 4)], "__ord long, SEQ_NAME string, SEQ string")
    assert P().assemble_seq_spades(kmers="7").run(ring).count() >= 1
    assert align_pair("ACGT", "A-CGGT") in ("A-CG-T", "A-C-GT")
    genes = P().genecall(size_min=9).run(seqs(spark, ("CCATGAAATAACC", None))).where("RECORD_TYPE = 'genecall'").collect()
    assert [(r.S_BEG, r.S_END, r.STRAND, r.SEQ) for r in genes] == [(3, 11, "+", "ATGAAATAA")]


def test_paths_and_rings_are_ranked(spark):
    def name(kind, i):
        return f"{kind}{i:04d}"

    rings, paths = {"a": 1, "b": 2, "c": 97}, {"x": 1, "y": 2, "z": 150}
    edges = [(name(k, i), name(k, (i + 1) % n)) for k, n in rings.items() for i in range(n) if n > 1]
    edges += [(name(k, i), name(k, i + 1)) for k, n in paths.items() for i in range(n - 1)]
    kmers = [(name(k, i),) for k, n in (rings | paths).items() for i in range(n)]
    ranked, ringed = _path_ranks(spark.createDataFrame(kmers, "kmer string"), spark.createDataFrame(edges, "a string, b string"))
    assert sorted(r.b for r in ringed.collect()) == [name("b", 0), name("c", 0)]
    found = {r.kmer: (r.up, r.dist) for r in ranked.collect()}
    assert all(found[name(k, i)] == (name(k, 0), i) for k, n in paths.items() for i in range(n))
    assert len(found) == len(kmers)
