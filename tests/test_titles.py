from pyspark.sql import functions as F

from lexiweave.functions.titles import canonical_title

CASES = {
    "Wojna_X": "Wojna_X", " kategoria:Hasła do sprawdzenia": "Hasła_do_sprawdzenia", "Category: a  b_ |x|y": "A_b", "KATEGORIA:łan|": "Łan",
    "Kategoria:Kategoria:a": "Kategoria:a", "": "", "  ": "", "|x": "", "_a__b_": "A_b", "a\tb": "A_b", None: None,
}


def test_canonical_title(spark):
    rows = spark.createDataFrame([(k,) for k in CASES], "t string").select("t", canonical_title(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in rows} == CASES
