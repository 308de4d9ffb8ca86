import random
import re
import unicodedata

from pyspark.sql import functions as F

from lexiweave.llm.leakage import WuManber, leaked_passages, plain_words, runs

WORDS = "ala ma kota żółw łąka Gęś straße nine x a bardzo długie słowo 1234 über İstanbul Ćma".split()


def words_of(text):
    t = unicodedata.normalize("NFD", text.lower().replace("ł", "l"))
    return re.findall(r"[^\W_]+", "".join(c for c in unicodedata.normalize("NFC", "".join(c for c in t if not unicodedata.combining(c)))))


def brute(docs, items):
    out = set()
    for d, t in docs:
        text = " " + " ".join(words_of(t or "")) + " "
        for i, *ps in items:
            for p in ps:
                w = words_of(p or "")
                if any(f" {' '.join(w[j : j + 12])} " in text for j in range(len(w) - 11)):
                    out.add((d, i))
    return out


def find(spark, docs, items, **how):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    i = spark.createDataFrame(items, "item_id int, context string, question string")
    return leaked_passages(d, i, "doc_id", "text", "item_id", ["context", "question"], **how)


def test_against_brute_force(spark):
    rng = random.Random(4)
    say = lambda n: [rng.choice(WORDS) for _ in range(n)]
    items = [(i, " ".join(say(rng.randint(5, 40))), " ".join(say(rng.randint(0, 20)))) for i in range(20)] + [(20, None, "krótkie")]
    items.append((21, items[0][1], None))
    docs = []
    for d in range(150):
        t = say(rng.randint(0, 60))
        if rng.random() < 0.6:
            w = (rng.choice(items)[rng.choice([1, 2])] or "").split()
            a = rng.randint(0, max(0, len(w) - 11))
            piece = [x.upper() if rng.random() < 0.3 else x for x in w[a : a + rng.randint(10, 14)]]
            at = rng.randint(0, len(t))
            t = t[:at] + piece + t[at:]
        docs.append((d, "".join(x + rng.choice([" ", ", ", "\n", " – [[", "''' ", "_"]) for x in t)))
    docs += [(900, ""), (901, None), (902, "\x00"), (3, docs[3][1])]
    want = brute(docs, items)
    got = find(spark, docs, items)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want) and len(want) > 20
    blocks = find(spark, docs, items, block_bytes=200)
    assert {tuple(r) for r in blocks.collect()} == want


def test_long_text(spark):
    rng = random.Random(1)
    p = "zupełnie inne zdanie które ma dokładnie tyle słów ile trzeba aby przeciekło dalej"
    filler = " ".join(rng.choice(WORDS) for _ in range(200_000))
    assert {tuple(r) for r in find(spark, [(1, filler + " " + p.upper()), (2, p[:30] + filler), (3, p + filler)], [(7, p, None)]).collect()} == {(1, 7), (3, 7)}


def test_empty(spark):
    assert find(spark, [], [(1, "a " * 20, None)]).count() == 0
    assert find(spark, [(1, "a " * 20)], []).count() == 0
    assert find(spark, [(1, "a " * 20)], [(1, "a " * 5, None)]).count() == 0


def test_plain_words(spark):
    got = [r[0] for r in spark.createDataFrame([("Łódź, éa''b''_c",), ("",), (None,)], "t string").select(plain_words(F.col("t"))).collect()]
    assert got == [" lodz ea b c ", " ", None]
    assert runs(got[0], 3) == [" lodz ea b ", " ea b c "]


def test_machine():
    import numpy as np

    m = WuManber({b"abcdefghijklmnopqr": [1], b"abcdefghijklmnop!!": [2], b"zzzzzzzzzzzzzzzzzz": [3]})
    text = b"xx" + b"abcdefghijklmnopqr" + b"z" * 20 + b"abcdefghijklmnop!!"
    data = np.frombuffer(text, np.uint8)
    assert sorted(m.search(data, np.array([0]), np.array([len(text)]))) == [(0, 0), (0, 1), (0, 2), (0, 2), (0, 2)]
    assert list(m.search(data, np.array([0, 20]), np.array([19, 20]))) == []
