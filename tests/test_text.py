"""Row-level definitions against small cases written by hand."""

import pytest
from pyspark.sql import functions as F

from vellumine.functions import audit as A, bounds as L, entities as E, patterns as P, text as T


def values(spark, column, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_words_and_sentences(spark):
    texts = ["", "   ", "one", "a b　c", "p is 0.05. Yes! No?", None]
    assert values(spark, T.word_count, texts) == [0, 0, 1, 3, 5, 0]
    assert values(spark, T.sentences, texts)[4] == ["p is 0", "05", "Yes", "No"]


def test_cleaning(spark):
    assert values(spark, T.sanitize, ["a​b c\U000e0041", "e͏́", None, "…“x”"]) == ["ab c", "é", "", "…“x”"]
    assert values(spark, lambda c: T.sanitize(c, quotes=True), ["…“x” ‘y’ «z»"]) == ["...\"x\" 'y' \"z\""]
    stats = values(spark, T.sanitize_stats, ["a​​b c"])[0]
    assert (stats.removed_invisibles, stats.normalized_spaces, stats.normalized_quotes) == (2, 1, 0)
    once = values(spark, T.sanitize, ["x​y  z"])[0]
    assert values(spark, T.sanitize, [once]) == [once]


def test_markers(spark):
    assert values(spark, T.clean_markers, ["word—phrase -- end", "a,, b,.", "| --- | --- |", "x  y"]) == ["word, phrase, end", "a, b.", "|, - |, - |", "x y"]


def test_output(spark):
    body = "This is a sufficiently long text that has more than fifty characters in it."
    texts = [f"```text\n{body}\n```", f'"{body}"', '"short"', f"Here is the revised version: {body}", f"{body}\n\nLet me know if you need more.", f"{body} turn0search1"]
    assert values(spark, T.clean_output, texts) == [body, body, '"short"', body, body, body]


def test_tails(spark):
    text = "# Title here now\n\nFirst sentence is long enough. Second one too is long! Ok."
    assert values(spark, T.tail_sentence, [text, "# only", None]) == ["Ok", "", ""]
    assert values(spark, T.last_long_sentence, [text, "Ok.", ""]) == ["Second one too is long!", "Ok.", ""]


def test_audit(spark):
    text = "Moreover, the robust paradigm serves as a beacon — a testament to human ingenuity. I don't delve; I think not only x but also y, underscoring z!"
    df = spark.createDataFrame([(text,), ("",), (None,), ("turn0search1 US don't can't",)], "t string")
    rows = df.select(*(c.alias(n) for n, c in A.audit(F.col("t")).items())).withColumn("triggers", A.triggers()).withColumn("score", A.score()).withColumn("level", A.level()).collect()
    first = rows[0]
    assert first.transitions == ["moreover"]
    assert first.buzzwords == ["delve", "testament", "beacon", "underscoring", "paradigm", "robust"]
    assert first.qualifiers == ["serves as", "a testament to", "testament to human ingenuity"]
    assert (first.contractions, first.opinions, first.negative_parallelisms, first.trailing_participles, first.exclamations) == (1, 1, 1, 1, 1)
    assert first.triggers == 3 + 12 + 9 + 2 + 2 + 2 + 4 and first.score == 100.0
    assert [r.level for r in rows] == ["High AI Probability", "Clean / Human-like", "Clean / Human-like", "High AI Probability"]
    assert rows[3].first_second_person == 1 and rows[3].contractions == 2


def test_density_switch(spark):
    words = lambda n: " ".join(["delve"] + ["word"] * (n - 1))
    df = spark.createDataFrame([(words(49),), (words(50),)], "t string")
    scores = [r.score for r in df.select(*(c.alias(n) for n, c in A.audit(F.col("t")).items())).withColumn("triggers", A.triggers()).withColumn("score", A.score()).collect()]
    assert scores == [48.0, 48.0]


def test_rhythm(spark):
    r = values(spark, A.rhythm, ["One two three. One.", "Only one", None])
    assert (r[0].sentences, r[0].mean_length, r[0].deviation, r[0].label) == (2, 2.0, 1.4, "low")
    assert (r[1].sentences, r[1].mean_length) == (1, None) and r[2].sentences == 0


@pytest.mark.parametrize(
    ("column", "text", "found"),
    [
        (E.p_values, "p < 0.05, p = 0.001, p <= 0.01 and P-value > 0.2", ["P-value > 0.2", "p < 0.05", "p = 0.001"]),
        (lambda c: E.p_values(c, wide=True), "p <= 0.01", ["p <= 0.01"]),
        (E.percentages, "94.36% of and 3%x", ["3%"]),
        (lambda c: E.percentages(c, wide=True), "94.36% of", ["94.36%"]),
        (E.unit_metrics, "−8.6 kJ/mol, 2.85 Å, 5 mm, 12.4 µM", ["-8.6 kj/mol", "12.4 µm", "2.85 å", "5 mm"]),
        (E.raw_numbers, "–8.6 then 7, 12, 3.5, +2 and 1e-5", ["+2", "-8.6", "12", "3.5"]),
        (E.figures, "Figure 3 (A) shows, fig. 2.1, FIGURE 3.1a", ["Fig. 2.1", "Figure 3", "Figure 3.1A"]),
        (E.tables, "Table 1a and table  2.1 here", ["Table 2.1"]),
        (E.residues, "Cys166 binds PDB: 2WYA", ["Cys166", "PDB: 2WYA"]),
        (E.years, "in 1999 and 2024, not 1899", ["1999", "2024"]),
    ],
)
def test_entities(spark, column, text, found):
    assert values(spark, column, [text, None]) == [found, []]


def test_citations(spark):
    assert [(c.num, c.raw) for c in values(spark, E.citations, ["see [3-5], [1, 2] and [3]"])[0]] == [(3, "[3-5]"), (1, "[1, 2]"), (3, "[3]")]


def test_captions(spark):
    from vellumine.operators.structure import caption

    got = values(spark, lambda c: caption(c, P.FIGURE_CAPTION), ["Figure 7", "Figure shows", "Fig. 2a: Yield", "As Figure 1"])
    assert [(g.id, g.text) if g else None for g in got] == [(None, "7"), (None, "shows"), ("2a", "Yield"), None]


def test_bounds(spark):
    df = spark.createDataFrame([(10,), (99,), (100,), (240,)], "w int")
    assert [tuple(r.b) for r in df.select(L.bounds(F.col("w")).alias("b")).collect()] == [(20, 35), (84, 124), (85, 125), (225, 265)]
    assert [tuple(r.b) for r in df.select(L.abstract_bounds(F.col("w")).alias("b")).collect()] == [(20, 35), (84, 124), (200, 250), (220, 270)]
    assert df.select(L.bounds(F.col("w"), "concise").alias("b")).first().b.low == 30


def test_digits_of_other_scripts(spark):
    assert [c.num for c in values(spark, E.citations, ["[９] and [१२]"])[0]] == [9, 12]
