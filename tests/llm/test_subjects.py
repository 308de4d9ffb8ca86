import random

import numpy as np

from lexiweave.llm.subjects import Block, Settings, features, subject_areas

NOUNS = {"sport": "bramka puchar trener mecz zawodnik".split(), "law": "sąd wyrok ustawa umowa adwokat".split(), "music": "nuta chór opera akord rytm".split(),
         "cuisine": "sos farsz owoc placek zupa".split(), "history": "wojna król zamek traktat najazd".split(), "software": "plik kod serwer skrypt moduł".split()}
COMMON = "rok strona forma część plan okres zbiór opis dzień temat".split()


def sentence(rng, subject=None):
    a, b, c = rng.sample(COMMON, 3)
    if not subject:
        return f"Ten {a} oraz {b} wymaga opisu jako {c}."
    x, y = rng.sample(NOUNS[subject], 2)
    return f"Inny {a} mówi o {x}ie oraz {y} i {b}."


def corpus(spark, n=600, seed=1):
    rng = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        own = rng.sample(sorted(NOUNS), rng.choice([0, 1, 1, 1, 2]))
        s = [sentence(rng, x) for x in own for _ in range(4)] + [sentence(rng) for _ in range(4)]
        rng.shuffle(s)
        docs.append((i, i % 50, f"'''Tytuł''' – {' '.join(s)}\n[[Kategoria:X]]"))
        truth[i] = set(own)
    labels = [(i, s) for i in range(n // 2) for s in (truth[i] or {None}) if i % 29]
    return docs, truth, labels


def run(spark, docs, labels, cats=(), **how):
    t = spark.createDataFrame(docs, "doc_id bigint, page_id bigint, text string")
    found, model = subject_areas(
        t, spark.createDataFrame(labels, "doc_id bigint, subject string"), spark.createDataFrame([(s, 1) for s in NOUNS] + [(None, 2)], "subject string, doc_id int"),
        spark.createDataFrame(list(cats), "page_id bigint, title string"), Settings(**{"shards": 2, **how}),
    )
    out = {}
    for r in found.collect():
        assert r.subject not in out.setdefault(r.doc_id, set())
        out[r.doc_id].add(r.subject)
    return out, model


def test_held_out_accuracy(spark):
    docs, truth, labels = corpus(spark)
    docs += [(9001, 777, "Ten plan oraz rok wymaga opisu."), (9002, 778, None), (9003, None, ""), (9004, 779, "Ten plan oraz rok wymaga opisu.")]
    cats = [(777, "Kategoria:Wyrok_Xyzzy"), (777, "Artykuły_bez_nuta"), (778, "opera Xyzzy|y"), (779, "Plan_Qwerty"), (None, "x"), (1, None)]
    cats += [(10_000 + i, f"{w.title()}_Abc{i}") for i in range(4) for ws in NOUNS.values() for w in ws]
    cats += [(i, f"{COMMON[i % 10].title()}_Def{i}") for i in range(50)]  # links of labelled pages, without a subject
    got, model = run(spark, docs, labels, cats)
    held = range(300, 600)
    assert sum(got.get(i, set()) == truth[i] for i in held) / 300 > 0.95
    assert model.losses[-1] < 0.7 * model.losses[0]
    assert got.get(9001) == {"law"} and got.get(9002) == {"music"} and 9003 not in got and 9004 not in got


def test_lines_of_one_article_count_together(spark):
    docs, truth, labels = corpus(spark)
    rng = random.Random(9)
    lines = [(5000, 1, sentence(rng, "sport")) for _ in range(9)] + [(5000, 1, sentence(rng, "law"))]
    got, _ = run(spark, docs + lines, labels)
    assert got[5000] == {"sport"}


def test_long_text_is_read_to_its_end(spark):
    docs, truth, labels = corpus(spark)
    rng = random.Random(3)
    long_text = " ".join(sentence(rng) for _ in range(3000)) + " " + sentence(rng, "music")
    got, _ = run(spark, [*docs, (6000, 1, long_text), (6001, 1, long_text), (6001, 1, long_text)], labels)
    assert "music" in got[6000] and got[6000] == got[6001]


def test_without_labels_or_texts(spark):
    docs, _, labels = corpus(spark, 40)
    assert run(spark, docs, [])[0] == {}
    assert run(spark, [], labels)[0] == {}


def test_words_that_occur_once_count(spark):
    docs, _, labels = corpus(spark)
    docs += [(7000, 888, "Trenerami zawodnikowi pucharowej."), (7001, 889, "Wyrokiem ustawach adwokatami.")]
    got, _ = run(spark, docs, labels)
    assert got.get(7000) == {"sport"} and got.get(7001) == {"law"}


def test_words_never_seen_count_by_their_stems(spark):
    """No word of the text is in the training sample, only other forms of its stems are."""
    docs, _, labels = corpus(spark)
    text = "Zawodnikowaniem trenerowaniem bramkarzowych. Meczowanie pucharowatymi zawodnikarsko."
    seen = {w for _, _, t in docs for w in t.lower().replace(".", " ").split()}
    assert not seen & set(text.lower().replace(".", " ").split())
    got, model = run(spark, [*docs, (7500, 1, text)], labels)
    assert got.get(7500) == {"sport"} and min(model.held) < model.held[0]


def test_features():
    both, n = features(["kot", "żółw", "ab"], 1 << 15)
    assert list(n) == [1 + 3 + 2 + 1, 1 + 4 + 3 + 2, 1 + 2 + 1]
    alone = [list(features([w], 1 << 15)[0]) for w in ("kot", "żółw", "ab")]
    assert list(both) == sum(alone, []) and set(features(["kotek"], 1 << 15)[0]) & set(alone[0]) and len(features([], 8)[0]) == 0


def test_gradient_against_differences():
    """The gradient of the loss over the sentences to learn from, by finite differences."""
    rng = np.random.default_rng(0)
    b = Block([["ala", "kot"], ["kot", "pies", "kot"], ["ala"]], np.array([[1.0, 0], [0, 1], [1, 1]]), np.array([True, True, False]), 40)
    b = Block.unpack(b.pack(), 2)
    e, w, bias = rng.normal(size=(40, 3)), rng.normal(size=(3, 2)), rng.normal(size=2)
    ge, gw, gb, loss = b.gradient(e, w, bias)
    for p, g in ((e, ge), (w, gw), (bias, gb)):
        for at in list(np.ndindex(p.shape))[:25]:
            kept = p[at]
            p[at] = kept + 1e-4
            up = b.gradient(e, w, bias)[3][0]
            p[at] = kept - 1e-4
            down = b.gradient(e, w, bias)[3][0]
            p[at] = kept
            assert abs((float(up) - float(down)) / 2e-4 - g[at]) < 2e-2
    assert loss[1] > 0
