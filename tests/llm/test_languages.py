"""Held-out accuracy of profiles and of the encoding model; edge cases of both in Spark."""

import os

import pytest

from pagequern.llm import encoding, language

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def samples(spark):
    return spark.read.parquet(f"{DATA}/lang_samples.parquet")


def test_held_out_accuracy(samples):
    train, test = samples.where("sample_id % 4 <> 0"), samples.where("sample_id % 4 = 0").collect()
    p = language.fit(train)
    got = language.segments(p, [r.text for r in test])
    assert len({g[0] for g in got}) == len(test)
    assert sum(g[4] == test[g[0]].lang for g in got) / len(got) > 0.97
    assert sum(g[2] == test[g[0]].lang for g in got) / len(got) > 0.97


def test_labels_and_mixtures(spark, samples):
    rows = {r.lang: r.text for r in samples.collect()}
    a = spark.createDataFrame(
        [
            (1, "en", rows["en"], 0), (2, "de", rows["en"], 0), (3, "EN_us", rows["en"], 0), (4, "English", rows["en"], 0), (5, None, rows["ja"], 0), (6, "fr", rows["fr"] + " " + rows["ru"], 0), (7, "en", None, 0), (8, "xx", " ", 0), (9, "unknown", rows["th"], 0),
            (1, "en", rows["en"], 0), (10, "ja", "12 34 !!", 0),
        ],
        "page_id long, language string, description string, lang int",
    )
    got = {tuple(r) for r in language.wrong_or_mixed(language.language_segments(a, samples)).collect()}
    assert got == {(2, "en"), (5, "ja"), (6, "fr"), (6, "ru"), (9, "th")}
    assert language.language_segments(a.where("page_id < 0"), samples).count() == 0
    assert language.language_segments(a, samples.where("sample_id < 0")).count() == 0


def test_garbled_fields(spark, samples):
    g = encoding.garble
    every = samples.collect()
    r = {x.lang: x.text for x in every}
    r["ru"] = next(x.text for x in every if x.lang == "ru" and g(x.text, ("koi8_r", "cp1251")))
    rows = [
        (1, r["fr"], "<p>" + r["fr"] + "</p>", 1), (2, g(r["fr"] + " été à la forêt", ("utf-8", "cp1252")), None, 1), (3, None, "<p>" + g(r["ru"], ("koi8_r", "cp1251")) + "</p>", 1), (4, "plain ascii", "", 1), (5, r["ja"], r["zh"], 1), (6, "El peque�o museo", None, 1),
        (7, "beside a small Ã and a Ð.", None, 1), (2, g(r["fr"] + " été à la forêt", ("utf-8", "cp1252")), None, 1),
    ]
    df = spark.createDataFrame(rows, "page_id long, title string, clean_html string, written int")
    got = {(x.page_id, x.field_name): x for x in encoding.affected(df, samples).collect()}
    assert set(got) == {(2, "title"), (3, "clean_html"), (6, "title")}
    assert got[(2, "title")].original == r["fr"] + " été à la forêt" and got[(2, "title")].restored
    assert got[(3, "clean_html")].original == "<p>" + r["ru"] + "</p>" and not got[(6, "title")].restored
    assert encoding.affected(df, samples.where("sample_id < 0")).count() == 0
