"""Functions of the claim graph on the fixtures that their rules name."""

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import dates, python, sentences, text
from ledgerline.plans.sql import SEED_EPISODE


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "candidate, want",
    [
        ("Is it up?", "interrogative_final"), ('He asked "why?" and left.', None), ("# Setup", "heading_fragment"), ("Setup", "heading_fragment"), ("Other", None),
        ("CASH FLOW The firm pays", "heading_fragment"), ("Cash Flow", "heading_fragment"), ("Home > Docs", "nav_boilerplate"), ("a | b | c", "nav_boilerplate"), ("- next steps", "nav_boilerplate"),
        ("1. The cache holds entries.", None), ("See chapter 3 for details.", "nav_boilerplate"), ("The following chapter", "nav_boilerplate"), ("CASH", None), ("The Firm pays", None), ("", None),
        ("3.5 litres of fuel", "nav_boilerplate"), ("-next steps", "nav_boilerplate"), ("12)go", "nav_boilerplate"), ("•", "nav_boilerplate"), ("+ One. Two", None), ("7 pears", None), ("2) one two three four five six seven", None),
        ("U.S.A N.A.S.A The firm pays", "heading_fragment"), ("A1 B2 the firm", None),
    ],
)
def test_shapes(spark, candidate, want):
    assert one(spark, text.shape(F.col("t"), text.headings(F.col("e"))), t=candidate, e=SEED_EPISODE) == want


def test_hedges_stand_free(spark):
    assert one(spark, text.hedges(F.col("t")), t="It MAY_be; maybe not, could Seem. Estimates!") == ["may", "could", "estimates"]
    lost = text.dropped_hedges(text.collapse(F.col("e")), text.hedges(F.col("e")), F.col("s"))
    assert one(spark, lost, e="Profits may vary", s="Profits vary") == ["may"]
    assert one(spark, lost, e="Profits  may vary now", s="Profits may vary") == []


def test_forms(spark):
    assert one(spark, text.normalize(F.col("t")), t=" A \u0085b C ") == "a b c"
    assert one(spark, text.stripped(F.col("t")), t="it is not up, no never not,") == "it is up, not,"
    assert one(spark, F.array(*[text.numeral(F.lit(x)) for x in ("30", "3.5", "30.", "30%", "-3", "")])) == [True, True, False, False, False, False]
    assert one(spark, text.grams(F.col("t")), t="abcde ab éééé abcd") == ["abcd", "bcde", "éééé"]
    assert one(spark, text.content_form(F.col("t")), t="Profits may, Vary (possibly)") == "profits vary"
    assert one(spark, text.slug(F.col("t")), t="  Hello,  Wörld! ") == "hello-w-rld"


def test_dates(spark):
    day = lambda s: one(spark, dates.days_from_iso(F.col("d")), d=s)
    assert day("1970-01-02") == 1 and day("2023-02-30") == day("2023-03-02")
    assert [day(s) for s in ("May 2026", "2023-13-01", "2023-00-10", "2023-01-32", "2023-1-01", None)] == [None] * 6
    assert one(spark, dates.iso_from_days(F.lit(20088))) == "2024-12-31"
    assert one(spark, dates.civil_date(F.col("d")), d="2023-02-30") is None and one(spark, dates.civil_date(F.col("d")), d="2023-02-28") == "2023-02-28"
    assert one(spark, dates.usd_micros(F.lit(1e-9))) == 1 and one(spark, dates.usd_micros(F.lit(0.02))) == 20000
    assert one(spark, dates.queue_age(F.lit(10), 5)) == 0


def test_python_functions(spark):
    df = spark.createDataFrame([("é",), ("abc",), (None,)], "s string")
    assert [r[0] for r in df.select(python.nfc("s")).collect()] == ["é", "abc", None]
    assert python.fnv1a([]) == "cbf29ce484222325" and python.fnv1a(["a", "b"]) == "78ed6781f136a14e" and python.fnv1a(["a", "b"]) != python.fnv1a(["ab"])  # over the bytes 97, 10, 98, 10
    assert python.strip_json_fence('```json\n{"a": 1}\n```') == '{"a": 1}'
    assert "".join(python.llm_chunks("abcdefg", 514, list, "".join)) == "abcdefg"
    assert [python.backoff_seconds(n) for n in (1, 2, 9)] == [2.0, 4.0, 60.0]


def test_units():
    assert len(sentences.units("Dr. Smith went to Washington. He arrived at 3.5 p.m. on time.")) == 2
    assert len(sentences.units("A long sentence that stands by itself here. Short one.")) == 1
    u = sentences.units("; ".join(["x" * 110] * 3))
    assert len(u) == 3 and u[0].endswith(";") and not u[2].endswith(";")
    assert len(sentences.units("x" * 400 + ".")) == 1 and sentences.units("") == []


def test_boundaries_follow_the_rules():
    split = lambda t: [t[a:b] for a, b in zip([0, *sentences.boundaries(t)], sentences.boundaries(t), strict=False)]
    assert split("One. Two") == ["One. ", "Two"]
    assert split("a.b and U.S. law etc. is") == ["a.b and U.S. law etc. is"]
    assert split("He said (yes!) Then") == ["He said (yes!) ", "Then"]
    assert split("x\r\ny") == ["x\r\n", "y"] and split("Hm... no?! Yes") == ["Hm... no?! ", "Yes"]
    assert split("3.14 is pi, ok") == ["3.14 is pi, ok"]
