"""Readers and sinks on small files written by hand."""

import gzip

import pytest
from pyspark.sql import functions as F

from lociframe.sources import lines as L
from lociframe.sources import records as R
from lociframe.sources import tables as S


def test_matrix_file(spark, tmp_path):
    p = tmp_path / "m.tsv"
    p.write_text("GeneID\tA\tB\ng1\t1\tx\ng2\tNA\t\ng3\t2.5\t3\n")
    got = {(r["feature"], r["sample"]): r["value"] for r in S.read_matrix(spark, str(p)).collect()}
    assert got == {("g1", "A"): 1.0, ("g1", "B"): None, ("g3", "A"): 2.5, ("g3", "B"): 3.0}
    turned = S.read_matrix(spark, str(p), orient="sample").where("sample = 'g1'").count()
    assert turned == 2


def test_beta_columns_come_from_metadata(spark, tmp_path):
    p = tmp_path / "b.csv"
    p.write_text("CpG_ID,chr,position,s1,s2\ncg1,1,100000,0.2,0.4\ncg2,1,200000,0.9,\n")
    rows = S.read_beta_matrix(spark, str(p), ["s1", "s2"]).collect()
    assert {r["sample"] for r in rows} == {"s1", "s2"} and max(r["value"] or 0 for r in rows) == 0.9


def test_metadata_and_column_lookup(spark):
    df = spark.createDataFrame([("a", "x")], "Sample_ID string, Group string")
    assert S.sample_metadata(df).columns == ["sample", "grp"]
    with pytest.raises(ValueError):
        S.sample_metadata(df, "batch")
    assert S.resolve_column(df, ["group"]) == "Group" and S.resolve_column(df, ["zzz"], False) is None


def test_null_check_fails_the_job(spark):
    df = spark.createDataFrame([("f", "s", None)], "feature string, sample string, value double")
    with pytest.raises(Exception, match="missing values"):
        S.assert_no_nulls(df).collect()


def test_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("p1", "ACGT"), ("p2", "GGCC")], "id string, seq string")
    S.write_fasta(df, str(tmp_path / "out"), "id", "seq")
    got = {r["header"]: r["seq"] for r in L.read_fasta(spark, str(tmp_path / "out")).collect()}
    assert got == {"p1": "ACGT", "p2": "GGCC"}


def test_gct_and_series_files(spark, tmp_path):
    g = tmp_path / "x.gct.gz"
    with gzip.open(g, "wt") as f:
        f.write("#1.2\n2\t2\nName\tDescription\tS1\tS2\nENSG1\tTP53\t1.5\t2\nENSG2\tX\t0\tNA\n")
    got = {(r["feature"], r["sample"]): r["value"] for r in L.gct(L.read_lines(spark, str(g))).collect()}
    assert got["ENSG1", "S1"] == 1.5 and got["ENSG2", "S2"] is None and len(got) == 4
    m = tmp_path / "series.txt"
    m.write_text('!Series_title = "My series"\n!Sample_title\t"a"\t"b"\n!series_matrix_table_begin\n"ID_REF"\t"G1"\t"G2"\n"p1"\t1\t2\n!series_matrix_table_end\n')
    matrix, series, attrs = L.series_matrix(L.read_lines(spark, str(m)))
    assert {(r["sample"], r["value"]) for r in matrix.collect()} == {("G1", 1.0), ("G2", 2.0)}
    assert L.series_summary(series, ["title"]).first()["title"] == "My series"
    assert {r["title"] for r in L.sample_attributes(attrs, ["title"]).collect()} == {"a", "b"}


def test_intervals_and_lists(spark, tmp_path):
    b = tmp_path / "p.bed"
    b.write_text("# c\nchr1\t10\t20\nchr1\t30\t40\tn\t5\t+\t7\t1\t2\t3\n")
    rows = L.read_intervals(spark, str(b)).orderBy("start").collect()
    assert rows[0]["score"] == 0.0 and rows[0]["name"].startswith("peak_") and rows[1]["signal"] == 7.0 and rows[1]["peak"] == 3
    (tmp_path / "lists").mkdir()
    (tmp_path / "lists" / "A.txt").write_text("tp53 x\nTP53\n\nmyc\n")
    got = {(r["set_id"], r["item"]) for r in L.read_gene_lists(spark, str(tmp_path / "lists")).collect()}
    assert got == {("A", "TP53"), ("A", "MYC")}


def test_landed_directory_and_cached_copy(spark, tmp_path):
    d = tmp_path / "expr"
    d.mkdir()
    for s, v in (("s1", 1), ("s2", 5)):
        (d / f"{s}.tsv").write_text(f"# x\ngene\ttpm\ng1\t{v}\ng1\t99\ng2\t2\n")
    got = {(r["feature"], r["sample"]): r["value"] for r in S.read_expression_dir(spark, str(d), "gene", "tpm").collect()}
    assert got == {("g1", "s1"): 1.0, ("g1", "s2"): 5.0, ("g2", "s1"): 2.0, ("g2", "s2"): 2.0}
    first = S.cached_copy(spark, spark.range(3), str(tmp_path / "copy"))
    assert first.count() == 3 and S.cached_copy(spark, spark.range(9), str(tmp_path / "copy")).count() == 3
    assert S.cached_copy(spark, spark.range(9), str(tmp_path / "copy"), refresh=True).count() == 9


def test_article_file(spark, tmp_path):
    x = tmp_path / "a.xml"
    x.write_text(
        '<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID Version="1">7</PMID><Article><Journal><JournalIssue><PubDate>'
        "<MedlineDate>2019 Jan</MedlineDate></PubDate></JournalIssue><Title>J</Title></Journal><ArticleTitle>T</ArticleTitle>"
        "<AuthorList><Author><LastName>Doe</LastName><Initials>A</Initials></Author></AuthorList></Article></MedlineCitation></PubmedArticle>"
        "<PubmedArticle><MedlineCitation><Article><ArticleTitle>no id</ArticleTitle></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>")
    rows = R.article_rows(R.read_articles(spark, str(x))).collect()
    assert [(r["pmid"], r["year"], r["authors"]) for r in rows] == [("7", "2019", ["Doe A"])]


def test_table_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    S.write_table(df, str(tmp_path / "t"))
    S.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "t")).first()["k"] == "a"
    assert spark.read.json(str(tmp_path / "j")).first()["v"] == 1


def test_variants(spark):
    df = spark.createDataFrame([("A12V", None), ("x", None), ("R5*", None)], "token string, z string").drop("z")
    got = {(r["raw"], r["impact_class"]) for r in L.variants(df).collect()}
    assert got == {("A12V", "custom"), ("R5*", "stop")}
    wide = spark.range(1).select(F.explode(L.labelled_lists(F.lit("A:x,y,B:z"))).alias("s"))
    assert {(r["s"]["set_id"], r["s"]["item"]) for r in wide.collect()} == {("A", "X"), ("A", "Y"), ("B", "Z")}
