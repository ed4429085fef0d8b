"""The splitter that learns abbreviations: what stays whole, what still ends, and odd texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfseek.operators import chunking
from shelfseek.operators import sentences as S


@pytest.fixture(scope="module")
def texts():
    people = ["Smith", "Jones", "Miller", "Brown", "Ross", "Hill", "Ford", "Lane"]
    rows = []
    for i in range(120):
        name = people[i % len(people)]
        rows.append(f"Then Dr. {name} came home. The report was long, e.g. this part of it. Nobody read version v. {i % 9}.0 at all! "
                    f"The door opened on May {i % 28}. It was late. Was it over? The end came soon for {name}. "
                    f"All late guests at home paid {i} coins and {i + 3} pounds to the house of {name} in this long hour.")
    return rows


@pytest.fixture(scope="module")
def model(spark, texts):
    docs = spark.createDataFrame([(i, text) for i, text in enumerate([*texts, None, "", " \n "])], "product_id bigint, text string")
    return S.learn(docs.repartition(3))


def split(spark, model, text):
    return spark.createDataFrame([(text,)], "t string").select(S.split_sentences(F.col("t"), model)).first()[0]


def test_what_is_learned(model):
    assert {"dr", "e.g", "v"} <= set(model.abbreviations)
    assert not {"home", "soon", "late", "all", "it"} & set(model.abbreviations)
    assert "the" in model.starters and "smith" not in model.starters


def test_abbreviations_stay_whole(spark, model, texts):
    assert split(spark, model, texts[1]) == [
        "Then Dr. Jones came home.", "The report was long, e.g. this part of it.", "Nobody read version v. 1.0 at all!",
        "The door opened on May 1.", "It was late.", "Was it over?", "The end came soon for Jones.",
        "All late guests at home paid 1 coins and 4 pounds to the house of Jones in this long hour.",
    ]


@pytest.mark.parametrize(
    ("text", "expected"),
    [(None, None), ("", []), (" \n\t ", []), ("J. Smith met K. Hill. They spoke.", ["J. Smith met K. Hill.", "They spoke."]),
     ("He saw the Dr. The end.", ["He saw the Dr.", "The end."]), ("One", ["One"]), ("aa  bb.\n\ncc", ["aa bb.", "cc"]), ("?! Oh. No.", ["?!", "Oh.", "No."])],
)
def test_texts_of_all_kinds(spark, model, text, expected):
    assert split(spark, model, text) == expected


def test_without_a_model_it_is_the_plain_rule_but_for_initials(spark):
    none = S.SentenceModel()
    for text in ("Dr. Smith came. He left.", "Is it? Yes! So.", "x y"):
        plain = spark.createDataFrame([(text,)], "t string").select(chunking.sentences(F.col("t"))).first()[0]
        assert split(spark, none, text) == plain


def test_paragraphs_follow_the_splitter(spark, model):
    text = "Then Dr. Smith came home. The door opened."
    docs = spark.createDataFrame([(1, text)], "product_id bigint, text string")
    whole = chunking.paragraph_chunks(docs, 5, lambda c: S.split_sentences(c, model)).orderBy("chunk_idx").collect()
    assert [r.chunk_text for r in whole] == ["Then Dr. Smith came home.", "The door opened."]
    plain = chunking.paragraph_chunks(docs, 5).orderBy("chunk_idx").collect()
    assert [r.chunk_text for r in plain] == ["Then Dr. Smith came home.", "The door opened."] or len(plain) == 2


def test_nothing_to_learn_from(spark):
    assert S.learn(spark.createDataFrame([(1, None)], "product_id bigint, text string")) == S.SentenceModel()
    assert S.learn(spark.createDataFrame([], "product_id bigint, text string")) == S.SentenceModel()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_typed_after_they_are_counted(spark, texts):
    """Each different word once, not each word of every text; nor is a text cut twice."""
    docs = spark.createDataFrame([(text,) for text in texts], "text string")
    for counted in (S.type_counts(docs), S.first_counts(docs, ["dr"])):
        typing, _, counting = _plan(counted).partition("HashAggregate(keys=[word")
        assert "RLIKE" in typing and "##" in typing
        assert counting.count("Generate explode") == 1 and "size(" not in counting
    assert "##" not in _plan(S.type_counts(docs)).partition("HashAggregate(keys=[word")[2]


def test_many_starters_are_one_constant(spark):
    """The plan has a look-up in buckets and no list to be gone through; every type is found in its bucket."""
    many = tuple(sorted({f"wort{i}" for i in range(5000)} | {"é'ß\"", "the"}))
    model = S.SentenceModel(("dr",), many)
    text = "Dr. Wort77 came. Wort5001 Dr. Wort4999 Dr. Ross Dr. The end. É'ß\" it is."
    assert split(spark, model, text) == ["Dr.", "Wort77 came.", "Wort5001 Dr.", "Wort4999 Dr. Ross Dr.", "The end.", "É'ß\" it is."]
    plan = _plan(spark.createDataFrame([(text,)], "t string").select(S.split_sentences(F.col("t"), model)))
    assert " IN " not in plan and "INSET" not in plan
