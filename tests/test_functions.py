"""Distribution functions and text functions against known values."""

import math

import pytest
from pyspark.sql import functions as F

from lociframe.functions import special as S
from lociframe.functions import text as T


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize("t,df,p", [(2.0, 10.0, 0.07338803), (1.0, 3.0, 0.39100222), (0.5, 100.0, 0.61817319), (12.706205, 1.0, 0.05)])
def test_student_t(spark, t, df, p):
    assert one(spark, S.student_t_two_sided(F.lit(t), F.lit(df))) == pytest.approx(p, abs=2e-5)


def test_student_t_of_fractional_df_by_quadrature(spark):
    t, df = 6.0, 4.7
    # Two-sided tail = 2C times the integral of cos^(df-1) from atan(t / sqrt(df)) to pi/2.
    a, n = math.atan(t / math.sqrt(df)), 200_000
    step = (math.pi / 2 - a) / n
    area = sum(math.cos(a + (i + 0.5) * step) ** (df - 1) for i in range(n)) * step
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    assert one(spark, S.student_t_two_sided(F.lit(t), F.lit(df))) == pytest.approx(2 * c * area, rel=1e-7)


def test_student_quantile_inverts_the_tail(spark):
    assert one(spark, S.student_t_quantile(F.lit(0.975), F.lit(10.0))) == pytest.approx(2.228138852, abs=1e-7)


@pytest.mark.parametrize("x,k,p", [(3.841458821, 1, 0.05), (5.991464547, 2, 0.05), (7.814727903, 3, 0.05), (18.30703805, 10, 0.05), (24.99579014, 15, 0.05)])
def test_chi2(spark, x, k, p):
    assert one(spark, S.chi2_sf(F.lit(x), F.lit(k))) == pytest.approx(p, abs=1e-6)


def test_hypergeometric_by_counting(spark):
    a, n, k, t = 3, 8, 7, 40
    want = sum(math.comb(k, i) * math.comb(t - k, n - i) for i in range(a, min(n, k) + 1)) / math.comb(t, n)
    assert one(spark, S.hypergeom_sf(F.lit(a), F.lit(n), F.lit(k), F.lit(t))) == pytest.approx(want, abs=1e-12)


def test_beta_of_whole_shapes_is_a_binomial_tail(spark):
    x, a, b = 0.37, 3, 5
    n = a + b - 1
    want = sum(math.comb(n, j) * x**j * (1 - x) ** (n - j) for j in range(a, n + 1))
    assert one(spark, S.beta_cdf_int(F.lit(x), F.lit(a), F.lit(b))) == pytest.approx(want, abs=1e-12)


def test_lgamma(spark):
    for z in (0.5, 1.0, 3.7, 20.0, 1e5):
        assert one(spark, S.lgamma(F.lit(z))) == pytest.approx(math.lgamma(z), rel=1e-11, abs=1e-11)


def test_sentences_and_excerpt(spark):
    text = "First one.  Second two! Third three? Fourth. Fifth."
    assert one(spark, T.split_sentences(F.lit(text))) == ["First one.", "Second two!", "Third three?", "Fourth.", "Fifth."]
    assert one(spark, T.sentence_excerpt(F.lit(text), 2)) == "First one. Second two!"
    assert one(spark, T.sentence_excerpt(F.lit("abcdefghij"), 2, 5)) == "abcde"


def test_sections(spark):
    text = ("Short start. We used sequencing here. It was found to rise 5%. Something else. The end is near. Done.")
    s = one(spark, T.abstract_sections(F.lit(text)))
    assert s["background"] == "Short start. We used sequencing here."
    assert s["methods"] == "We used sequencing here."
    assert s["results"] == "It was found to rise 5%."
    assert s["conclusions"] == "The end is near. Done."


def test_statistics_and_genes(spark):
    text = "TP53 and BRCA1 rose 2.5-fold (p < 0.05, n = 120); THE END"
    assert one(spark, T.p_values(F.lit(text))) == ["0.05"]
    assert one(spark, T.fold_changes(F.lit(text))) == ["2.5"]
    assert one(spark, T.sample_sizes(F.lit(text))) == [120]
    assert one(spark, T.gene_mentions(F.lit(text))) == ["TP53", "BRCA1", "END"]


def test_markup_and_space(spark):
    assert one(spark, T.strip_markup(F.lit("<p>a &amp; b</p>\n<b>c</b>"))) == "a & b c"


def test_concise_summary(spark):
    first = "Binds the promoter of many genes."
    second = "A completely different sentence about kinases."
    assert one(spark, T.concise_summary(F.lit(first), F.lit(second))) == (
        "Binds the promoter of many genes; a completely different sentence about kinases.")
    assert one(spark, T.concise_summary(F.lit("Short."), F.lit(None).cast("string"))) == ""
    assert one(spark, T.with_domain_class(F.lit("Does x."), F.lit("kinase"))) == "Does x. Functional class: kinase."


def test_abstract_from_inverted_index(spark):
    idx = F.create_map(F.lit("world"), F.array(F.lit(1)), F.lit("hello"), F.array(F.lit(0), F.lit(2)))
    assert one(spark, T.rebuild_abstract(idx)) == "hello world hello"


def test_p_label(spark):
    assert one(spark, T.p_label(F.lit(1.234e-5))) == "p = 1.2e-05"
    assert one(spark, T.p_label(F.lit(0.03))) == "p = 0.0300"
    assert one(spark, T.stars(F.lit(0.004))) == "**"


def test_rule_tables(spark):
    assert one(spark, T.domain_classes(F.lit("Zinc finger and Tudor KINASE"))) == ["reader", "kinase", "transcription factor"]
    assert one(spark, T.domain_classes(F.lit("nothing"))) == []
    got = one(spark, T.protein_class(F.lit("Receptor tyrosine kinase")))
    assert (got["protein_class"], got["druggability"]) == ("kinase", "potentially_druggable")
    got = one(spark, T.protein_class(F.lit("chromatin")))
    assert (got["protein_class"], got["druggability"]) == ("chromatin regulator", "")
    got = one(spark, T.protein_class(F.lit("")))
    assert (got["protein_class"], got["druggability"]) == ("other", "")
    assert one(spark, T.significance_text(F.lit("a map of rivers"), F.lit("map"), [("map", "charts"), ("river", "water"), ("sea", "salt")])) == "terms: map; charts; water"
    assert one(spark, T.significance_text(F.lit("plain"), F.lit(""), [("map", "charts")])) == "no rule applies"
