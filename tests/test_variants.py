import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from varloom.functions import variants as vx


def one(spark, expr, **values):
    schema = ", ".join(
        f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}"
        for k, v in values.items()
    )
    return spark.createDataFrame([tuple(values.values())], schema).select(expr.alias("x")).first()[0]


def test_id_text_is_the_python_list_text(spark):
    key = F.col("c"), F.col("p"), F.col("r"), F.col("a")
    for alts in (["A"], ["G", "T"], ["GT", "T"], []):
        got = one(spark, vx.variant_id(*key), c="chr1", p=10, r="A", a=alts)
        assert got == f"1:10:A:{alts}"
        got = one(spark, vx.variant_id(*key, chr_word=True), c="1", p=10, r="A", a=alts)
        assert got == f"chr1:10:A:{alts}"


def test_id_from_comma_joined_alleles(spark):
    key = F.col("c"), F.col("p"), F.col("r"), F.col("a")
    got = one(spark, vx.variant_id_from_alt(*key), c="Y", p=7, r="CA", a="A,GT")
    assert got == "Y:7:CA:" + str("A,GT".split(","))


def test_parsing_keeps_long_alleles_and_letters_as_chromosome(spark):
    long_ref = "ACGT" * 30
    for chrom, alts in (("Y", ["GT"]), ("X", ["GT", "T"]), ("17", ["A" * 50])):
        text = f"{chrom}:123456789:{long_ref}:{alts}"
        got = one(spark, vx.parse_variant_id(F.col("v")), v=text)
        assert (got.chrom, got.pos, got.ref, got.alts) == (chrom, 123456789, long_ref, alts)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(
            st.sampled_from(["1", "22", "X", "Y", "MT"]),
            st.integers(1, 2**31 - 2),
            st.text("ACGTN", min_size=1, max_size=40),
            st.lists(st.text("ACGTN", min_size=1, max_size=20), min_size=1, max_size=4),
        ),
        min_size=1,
        max_size=30,
    )
)
def test_id_to_parts_to_id_is_the_identity(spark, variants):
    df = spark.createDataFrame(variants, "chrom string, pos int, ref string, alts array<string>")
    vid = vx.variant_id(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alts"))
    back = df.withColumn("p", vx.parse_variant_id(vid))
    fields = ["chrom", "pos", "ref", "alts"]
    assert [tuple(r["p"]) for r in back.collect()] == [tuple(r) for r in df.select(*fields).collect()]


def test_interval_bases_differ(spark):
    from_id = one(spark, vx.interval_from_id(F.col("v")), v="3:100:ACG:['T']")
    assert tuple(from_id) == ("chr3", 100, 101)
    span = vx.interval_from_vcf(F.col("c"), F.col("p"), F.col("r"))
    assert tuple(one(spark, span, c="3", p=100, r="ACG")) == ("3", 99, 102)


def test_region_and_line_take_the_first_allele(spark):
    vid = "X:5:A:['GT', 'T']"
    assert tuple(one(spark, vx.region_from_id(F.col("v")), v=vid)) == ("X", 5, "A", "GT")
    line = one(spark, vx.vcf_line_from_id(F.col("v"), F.lit(0)), v=vid)
    assert line == "X\t5\tv1\tA\tGT"


@pytest.mark.parametrize(
    ("csq", "expected"),
    [("12.5|0.3|x,9|9|y", (12.5, 0.3)), ("|0.3", (None, 0.3)), ("1|", (1.0, None)), ("1", (1.0, None))],
)
def test_annotation_scores(spark, csq, expected):
    info = f"AC=2;CSQ={csq};DP=1"
    got = one(spark, vx.first_annotation_scores(vx.info_entry(F.col("i"), "CSQ")), i=info)
    assert tuple(got) == expected


def test_missing_annotation_is_null(spark):
    assert one(spark, vx.info_entry(F.col("i"), "CSQ"), i="XCSQ=1;AC=2") is None


def test_repeated_gtf_keys_are_all_kept(spark):
    text = 'gene_id "G1"; tag "CCDS"; tag "basic"; exon_number "2";'
    got = one(spark, vx.gtf_attributes(F.col("t")), t=text)
    assert [tuple(a) for a in got] == [
        ("gene_id", "G1"), ("tag", "CCDS"), ("tag", "basic"), ("exon_number", "2"),
    ]
    assert one(spark, vx.gtf_attribute(F.col("t"), "exon_number"), t=text) == "2"
