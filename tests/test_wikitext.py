from pyspark.sql import functions as F

from lexiweave.functions import wikitext as w


def values(spark, texts, make):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(make(F.col("t"))).collect()]


NOISY = (
    "A <ref>foo</ref> http://x.pl/a_b?c=1 2015-10-02 123456 [[Kategoria:A b|x]] [[Kategoria:B]]\n"
    "żółw [[Plik:x.jpg|opis]]koniec {{Przypisy}} https://q.pl <sup>{{Ujednoznacznienie}}"
)


def test_tokens(spark):
    got = values(spark, [NOISY, "foo[[Plik:x]]bar", "", None], lambda t: w.tokens(w.strip_noise(t)))
    assert got[0] == ["ref", "foo", "ref", "2015-10-02", "1234", "żółw", "koniec", "https", "pl"]
    assert got[1:] == [["foobar"], [], None]


def test_categories(spark):
    texts = [NOISY, "[[Kategoria:A]] [[Kategoria:B]]", "[[Kategoria:Miasta {{x}}|Łódź]]", "[[Kategoria:|x]]", "[[Kategoria:A]]\n[[Kategoria:A]]", "[[Kategoria: \tA\tb\t]]"]
    assert values(spark, texts, lambda t: w.category_names(w.strip_noise(t))) == [["A b"], ["A B"], ["Miasta "], [], ["A", "A"], ["A b"]]


def test_titles(spark):
    assert values(spark, ['Kat: "a"/b\\c d'], w.sanitize_title) == ["Kat__a_b_c_d"]
    assert values(spark, ["U.S.A.", "Foo_vol._2", "plain"], w.base_name) == ["U.S.A", "Foo_vol", "plain"]


def test_hash_and_folds(spark):
    texts = ["Word_Count", "Łódź", "Zażółć_gęślą", "a", "", "\U0001f600x"]
    want = [-522750054, 9799912, 589508518, 97, 0, ((0xD83D * 31 + 0xDE00) * 31 + ord("x") + (1 << 31)) % (1 << 32) - (1 << 31)]
    assert values(spark, texts, w.string_hash) == want
    assert values(spark, ["Word_Count", "Zażółć_gęślą", "a"], lambda t: w.fold_number(t, 10, 10)) == [5, 1, 9]
