from lexiweave import cli
from lexiweave.sources import dump, tables

XML = "<mediawiki>" + "".join(
    f"<page><title>{t}</title><revision><id>1</id><text xml:space='preserve'>{b}</text></revision></page>"
    for t, b in [("Kot", "kot pies [[Kategoria:Z]]"), ('A "b"', "kot kot ryba\n[[Kategoria:Z]]"), ("C/d", "pies ryba\n[[Kategoria:R]]"), ("Kot", "kot pies pies\n[[Kategoria:Z]]")]
) + "</mediawiki>"


def test_dump_sample_and_upsert(spark, tmp_path):
    (tmp_path / "d.xml").write_text(XML, encoding="utf-8")
    d = dump.read_dump(spark, str(tmp_path / "d.xml"))
    assert [(r["index"], r.title) for r in d.orderBy("index").collect()] == [(0, "Kot"), (1, 'A "b"'), (2, "C/d"), (3, "Kot")]
    got = {r.title: r.body for r in dump.upsert_articles(d).collect()}
    assert sorted(got) == ["A_b", "C_d", "Kot"] and "pies pies" in got["Kot"]


def test_positional_sample(spark):
    d = spark.range(10).withColumnRenamed("id", "index")
    pick = lambda *a: [r[0] for r in dump.positional_sample(d, *a).orderBy("index").collect()]
    assert pick(1, 2, 8) == [1, 4, 7]
    assert pick() == list(range(10)) and pick(-1, 3, -1) == list(range(10)) and pick(7) == [7, 8, 9] and pick(-1, -1, 2) == [0, 1]


def test_number_rows(spark):
    d = dump.number_rows(spark.range(0, 50, 1, 7), "n").orderBy("id")
    assert [r.n for r in d.collect()] == list(range(50))
    assert dump.number_rows(spark.range(0)).count() == 0


def test_dictionary(spark, tmp_path):
    (tmp_path / "dict.txt").write_text("koty\tkot\nkoty\tkocur\nx\n\ty\npsy\tpies\tmore\n", encoding="utf-8")
    assert {tuple(r) for r in tables.read_dictionary(spark, str(tmp_path / "dict.txt")).collect()} == {("koty", "kocur"), ("psy", "pies")}


def test_term_rows_round_trip(spark, tmp_path):
    tf = spark.createDataFrame([("t", "a", 2)], "title string, term string, cnt bigint")
    cats = spark.createDataFrame([("t", 'x "y"'), ("t", "z")], "title string, category string")
    tables.write_term_rows(tf, cats, str(tmp_path / "o"))
    a, b = tables.read_term_rows(spark, str(tmp_path / "o"))
    assert [tuple(r) for r in a.collect()] == [("t", "a", 2)] and {r.category for r in b.collect()} == {'x "y"', "z"}


def test_folds_are_pruned(spark, tmp_path):
    d = spark.createDataFrame([("a", 0), ("b", 1), ("c", 10)], "title string, fold int")
    tables.write_folds(d, str(tmp_path / "f"))
    assert [r.title for r in tables.read_folds(spark, str(tmp_path / "f"), test=1).collect()] == ["b"]
    train = tables.read_folds(spark, str(tmp_path / "f"), train=1)
    assert sorted(r.title for r in train.collect()) == ["a", "c"]
    assert "PartitionFilters: [isnotnull(fold" in train._jdf.queryExecution().toString()


def test_article_folder(spark, tmp_path):
    (tmp_path / "U.S.A.").write_text("x")
    (tmp_path / "plain").write_text("a\nb")
    got = {r.title: r.body for r in dump.read_article_folder(spark, str(tmp_path)).collect()}
    assert got == {"U.S.A": "x", "plain": "a\nb"}


def test_command_line(spark, tmp_path, capsys):
    p = lambda x: str(tmp_path / x)
    (tmp_path / "d.xml").write_text(XML, encoding="utf-8")
    assert cli.run(["dump", p("d.xml"), p("articles"), "--push"], spark) == 0
    assert cli.run(["wordcount", p("articles"), p("counts")], spark) == 0
    assert cli.run(["classify", p("counts"), p("counts"), p("sim")], spark) == 0
    assert cli.run(["bestCategories", p("sim"), "2"], spark) == 0
    assert "Kot\tZ" in capsys.readouterr().out
    assert cli.run(["fold", p("counts"), p("folds")], spark) == 0
    assert cli.run(["crossvalidate", p("folds"), p("cv")], spark) == 0
    assert cli.run(["crossvalidate", "--pairs", p("folds"), p("pairs")], spark) == 0
    pairs = spark.read.parquet(p("pairs"))
    assert pairs.columns == ["test", "train", "similarity", "fold"] and pairs.filter("test = train").count() == 0 and pairs.count() > 0
    (tmp_path / "pipeline.properties").write_text("classifyRepetitions=2\n")
    assert cli.run(["classify", p("counts"), p("counts"), p("sim"), "--properties", p("pipeline.properties")], spark) == 0
    assert capsys.readouterr().err.count("neighbours in") == 2
    assert cli.run(["bestCategories", p("sim"), "2"], spark) == 0
    assert cli.run(["cvscores", p("cv"), p("folds"), p("scores")], spark) == 0
    assert cli.run(["cvaverage", p("scores"), p("avg")], spark) == 0
    assert cli.run(["crossvalidate", "--auto", p("articles"), p("work")], spark) == 0
    assert cli.run(["cvscores", "--auto", p("work")], spark) == 0 and cli.run(["cvscores", "--auto", p("none")], spark) == 1
    assert cli.run(["classify", "--auto", p("articles"), p("articles"), p("auto")], spark) == 0
    assert "Kot\tZ" in capsys.readouterr().out


def test_an_interrupted_stage_runs_again(spark, tmp_path):
    """Word counts without the mark of a finished table are counted again."""
    (tmp_path / "d.xml").write_text(XML, encoding="utf-8")
    assert cli.run(["dump", str(tmp_path / "d.xml"), str(tmp_path / "articles"), "--push"], spark) == 0
    (tmp_path / "work" / "counts" / "cats").mkdir(parents=True)
    assert cli.run(["crossvalidate", "--auto", str(tmp_path / "articles"), str(tmp_path / "work")], spark) == 0
    assert (tmp_path / "work" / "counts" / "cats" / "_SUCCESS").exists()


def test_article_folder_round_trip(spark, tmp_path):
    rows = [("A/C", "x"), ("100% ż.txt", None), ("50% ż.txt", "z"), ("a.b.c", "y\n"), ("", "no"), (None, "no")]
    d = spark.createDataFrame(rows, "title string, body string")
    assert dump.write_article_folder(d, str(tmp_path / "f")) == 4
    assert {tuple(r) for r in dump.read_article_folder(spark, str(tmp_path / "f"), strip_extension=False).collect()} == {("A_C", "x"), ("a.b.c", "y\n"), ("50% ż.txt", "z")}
