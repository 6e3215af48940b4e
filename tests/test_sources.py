"""Text formats on small literal inputs."""

import gzip

import pytest

from karyospark.sources import formats as T


def lines(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_hits_keep_their_first_line_and_string_ids(spark, tmp_path):
    path = tmp_path / "hits"
    path.write_text("1\t2\t50.5\t10\t0\t0\t1\t10\t2\t11\t1e-9\t200.0\n1\t3\t40\t9\t0\t0\t1\t9\t2\t10\t0.5\t90\n")
    rows = T.read_blast6(spark, str(path)).collect()
    assert [(r.qseqid, r.sseqid, r.evalue) for r in rows] == [("1", "2", 1e-9), ("1", "3", 0.5)]


def test_profile_hits(spark):
    hit = "geneA - G1.aligned - 1e-30 99.5 0.1 1 1 0.1 1.0 1 0 0 1 1 1 1 -"
    rows = T.parse_hmm_tblout(lines(spark, ["# comment", "", "  ", hit])).collect()
    assert [(r.qseqid, r.sseqid, r.evalue, r.bitscore, r.pident) for r in rows] == [("G1", "geneA", 1e-30, 99.5, 50.0)]
    with pytest.raises(Exception, match="19 fields"):
        T.parse_hmm_tblout(lines(spark, ["a b c"])).collect()


def test_fasta_with_carriage_returns(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(b">id1\r\nAC\r\nGT\r\n>id2 some\ttext\t \r\nAA\r\n")
    assert sorted((r.id, r.desc, r.seq) for r in T.read_fasta(spark, str(tmp_path / "a.fa")).collect()) == [("id1", "", "ACGT"), ("id2", "some\ttext", "AA")]


def test_fasta_files(spark, tmp_path):
    path = tmp_path / "a.fa.gz"
    with gzip.open(path, "wt") as f:
        f.write(">one first > record\nACG\nT\n>empty\n>two\nGG G\n\n")
    rows = T.read_fasta(spark, str(path)).collect()
    assert [(r.id, r.desc, r.seq) for r in rows] == [("one", "first > record", "ACGT"), ("two", "", "GGG")]


@pytest.mark.parametrize("wrap", [80, 3, 0, None])
def test_fasta_wrapping_round_trip(spark, tmp_path, wrap):
    df = spark.createDataFrame([("a", "x y", "ACGTACG"), ("b", None, "ACG"), ("c", "", "A" * 160)], "id string, desc string, seq string")
    T.write_fasta(df, str(tmp_path / "out"), wrap)
    back = {r.id: r.seq for r in T.read_fasta(spark, str(tmp_path / "out")).collect()}
    assert back == {"a": "ACGTACG", "b": "ACG", "c": "A" * 160}
    text = [r.value for r in T.fasta_text(df.where("id = 'a'"), 3).collect()]
    assert text == [">a x y\nACG\nTAC\nG"]


def test_gff_takes_scaffold_and_strand_of_the_first_line(spark):
    cds = "{}\tRefSeq\tCDS\t{}\t{}\t.\t{}\t0\tID=cds-X;protein_id={};x=1"
    rows = [cds.format("NC1", 200, 300, "-", "XP1"), cds.format("NC2", 100, 150, "+", "XP1"), "NC1\tRefSeq\tgene\t1\t2\t.\t+\t0\tprotein_id=no", "#c", cds.format("NC3", 5, 9, "+", "XP2")]
    df = spark.createDataFrame(list(enumerate(rows)), "line int, value string")
    assert sorted(map(tuple, T.parse_ncbi_gff(df).collect())) == [("XP1", "NC1", "-", 100, 300), ("XP2", "NC3", "+", 5, 9)]


def test_nulls_of_ortholog_tables(spark):
    df = spark.createDataFrame([("r1", "None", "None", "nan", "12.0"), ("r2", None, "g", "", "x")], "rbh string, gene_group string, A_gene string, A_scaf string, A_pos string")
    assert [tuple(r) for r in T.normalise_rbh(df).collect()] == [("r1", "None", None, None, 12), ("r2", "None", "g", None, None)]


def test_group_lists_from_text(spark):
    df = spark.createDataFrame([("2", "['a', nan]", "x"), ("1", '["b"]', "['y']")], "count string, rbh string, alg string")
    assert [tuple(r) for r in T.parse_groupby(df, ["rbh", "alg"]).collect()] == [(2, ["a", None], ["x", "x"]), (1, ["b"], ["y"])]


def test_coordinates_last_row_of_a_protein_and_middle(spark):
    df = spark.createDataFrame([("p", "s1", "+", 10, 21), ("p", "s2", "-", 100, 200)], T.CHROM_SCHEMA)
    assert [tuple(r) for r in T.chrom_with_middle(df).collect()] == [("p", "s2", "-", 100, 200, 150)]


def test_last_line_of_a_protein_stays(spark, tmp_path):
    lines = [("p1", "s9", "+", 90, 95), ("p2", "s1", "-", 5, 8)] + [(f"q{k}", "s", "+", k, k + 1) for k in range(2000)] + [("p1", "s1", "-", 10, 15)]
    path = tmp_path / "genes.chrom"
    path.write_text("".join("\t".join(map(str, r)) + "\n" for r in lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        got = T.read_chrom(spark, str(path))
        assert got.count() == 2002 and got.columns == ["protein", "scaf", "strand", "start", "stop", "middle"]
        assert tuple(got.where("protein = 'p1'").first()) == ("p1", "s1", "-", 10, 15, 12)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
