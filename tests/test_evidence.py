import pytest

from tidemark.operators import evidence, extract, report


@pytest.mark.parametrize(
    "text, want",
    [
        ("We run postgres 14 here", [("database", "PostgreSQL 14")]),
        ("MySQL 8.0 and pg 9", [("database", "MySQL 8.0")]),
        ("Run the tests with `make test`", [("test_command", "make test")]),
        ("We deploy from the `main` branch", [("deploy_branch", "main")]),
        ("staging is at staging-7.internal", [("staging_hostname", "staging-7.internal")]),
        ("nothing of note", []),
        ("", []),
        (None, []),
    ],
)
def test_rule_claims(spark, text, want):
    rows = extract.rule_claims(spark.createDataFrame([("e1", text)], "event_id string, content string"))
    assert [(r.slot, r.value) for r in rows.orderBy("rule_no").collect()] == want


def test_routed_slots(spark):
    rows = spark.createDataFrame([(1, "Which db and which host?"), (2, "the database_x"), (3, None)], "id int, text string")
    assert {(r.id, r.slot) for r in extract.routed_slots(rows, "id", "text").collect()} == {(1, "database"), (1, "staging_hostname")}


def test_numbers_do_not_depend_on_ranges(spark):
    rows = spark.range(50).selectExpr("id * 7 AS k")
    for width in (1, 10, 1000):
        assert [r.no for r in evidence.numbered(rows, "k", width).orderBy("k").collect()] == list(range(1, 51))


def test_subphrases(spark):
    rows = spark.createDataFrame([("main",), ("the main road",), ("remain",), ("a  b",), ("x A b y",), (None,), ("",)], "value string")
    assert {tuple(r) for r in evidence.subphrases(rows).collect()} == {("main", "the main road"), ("a  b", "x A b y")}


def test_identity_counts_lost_rows(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "y"), (4, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, None), (3, "n"), (5, "z")], "k int, v string")
    assert tuple(report.identity(a, b, "k", "v").first()) == (2, 1, 1, 1)


def test_kappa(spark):
    rows = spark.createDataFrame([("g", 1, 1)] * 29 + [("g", 0, 0)] * 30 + [("g", 0, 1)] + [("h", 1, 1)], "c string, j int, h int")
    got = {r.c: r for r in report.agreement(rows, "c", "j", "h").collect()}
    assert (got["g"].agreement, got["g"].kappa, got["g"].yes_no, got["g"].no_yes) == (0.983333, 0.966667, 0, 1)
    assert got["h"].kappa is None


PHRASES = ["To this nt", "to THIS, nt", "this", "a", "x y z", "--", "...", "- -", "o'er the", "l'été, né", "straſse", "ΟΔΟΣ", "σ", " ", " ", "", "(a b)", "b) c", "é", "1.5 2", "C++", "+ +", "İ", None, "a b c d e f g h i j k l m n o p q r", "a b c d e f g h i j k l m n o p q s"]
TEXTS = ["To  this\nnt.", "to this, nt", "To thiss nt", "x y  z", "xx y z", "x yz", "a--b -- c", "...", "wait....", "- -", "o'er\tthe", "L'ÉTÉ, NÉ!", "STRASSE strasse", "οδος ΟΔΟΣ", "Σ", "a b", "((a b) c)", "é", "11.5 2", "1.5 2", "c++", "C+++", "+  +", "i̇", "", None, "A b c d e f g h i j k l m n o p q r", "a " * 40]


@pytest.mark.parametrize("bitmap_keys, runs", [(1 << 23, 1 << 17), (0, 1 << 17), (1 << 23, 3)])
def test_phrase_pairs_are_all_that_the_pattern_accepts(spark, monkeypatch, bitmap_keys, runs):
    from pyspark.sql import functions as F

    from tidemark.functions.text import mentions

    monkeypatch.setattr(evidence, "BITMAP_KEYS", bitmap_keys, raising=False)
    monkeypatch.setattr(evidence, "RUNS", runs, raising=False)
    texts = spark.createDataFrame([(i, i % 2, t) for i, t in enumerate(TEXTS * 2 + TEXTS[::-1])], "id int, u int, t string")
    phrases = spark.createDataFrame([(u, p) for p in PHRASES for u in (0, 1) if (len(p or "") + u) % 3], "u int, phrase string")
    want = texts.join(phrases, "u").where(mentions(F.col("t"), F.col("phrase"))).select("u", "id", "phrase").distinct()
    got = evidence.phrase_pairs(texts, "id", "t", phrases, "u")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    free = phrases.select("phrase")
    want = texts.join(free.distinct()).where(mentions(F.col("t"), F.col("phrase"))).select("id", "phrase").distinct()
    assert sorted(map(tuple, evidence.phrase_pairs(texts, "id", "t", free).collect())) == sorted(map(tuple, want.collect()))


def test_phrases_of_one_first_word_meet_only_their_texts(spark):
    """Texts and phrases that share a first word were all paired; the rows that the
    joins make grew with the square."""
    rows = spark.range(300).selectExpr("id", "concat('the x', id, ' y') AS t")
    found = evidence.phrase_pairs(rows, "id", "t", rows.selectExpr("t AS phrase"))
    assert found.count() == 300
    found.collect()

    def made(node):
        name = node.nodeName()
        if "AdaptiveSparkPlan" in name:
            return made(node.executedPlan())
        if "QueryStage" in name:
            return made(node.plan())
        own = [node.metrics().apply("numOutputRows").value()] if "Join" in name and node.metrics().contains("numOutputRows") else []
        return own + [x for i in range(node.children().size()) for x in made(node.children().apply(i))]

    joins = made(found._jdf.queryExecution().executedPlan())
    assert joins and max(joins) <= 400
