"""Hand cases of the scalar operators."""

import pytest
from pyspark.sql import functions as F

from pagequern.functions import summary as S
from pagequern.functions import text as T
from pagequern.functions import voting


def values(spark, fn, items):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "fn, cases",
    [
        (T.clean, {"a \n  b": "a\nb", "a\t\tb": "a b", "a\tb": "a\tb", None: None}),
        (T.norm_title, {"News — «Big» day!": "News Big day", "": ""}),
        (T.cleaned_title, {"12.05.2015  News": "News", "12-05 News": "News", "12:30 News": "News", "Site News |": "Site News"}),
        (T.clean_entities, {"a&nbsp;b &amp; &#8212;": "a b &amp; —"}),
        (T.charset_alias, {"GB2312": "gb18030", "ASCII": "utf-8", "MacCyrillic": "maccyrillic", "utf-8": "utf-8"}),
        (T.vocabulary_weight, {"content-main": 25, "my-content": 0, "Comment": -25, "contact": -25}),
        (T.clean_description, {"a  &quot;b&quot;\n c": 'a "b" c'}),
        (voting.language, {"the cat and the dog is in that house": "en", "der Hund und die Katze ist nicht mit dem": "de", "кот и пес": "ru", "犬はここにいます": "ja", "123": None}),
    ],
)
def test_scalars(spark, fn, cases):
    assert values(spark, fn, list(cases)) == list(cases.values())


def test_shingles_and_similarity(spark):
    import zlib

    got = values(spark, T.shingles, ["ab", "abcd"])
    assert got == [[], [zlib.crc32(b"a b c"), zlib.crc32(b"b c d")]]
    df = spark.createDataFrame([(1, "abcd", "abc"), (2, "aaaa", "aaa"), (3, "a", "b")], "i int, a string, b string")
    sims = [r.s for r in df.select("i", T.similarity(T.shingles(F.col("a")), T.shingles(F.col("b"))).alias("s")).orderBy("i").collect()]
    assert [round(x, 2) if x is not None else None for x in sims] == [66.67, 133.33, None]


def test_unlikely(spark):
    df = spark.createDataFrame([(1, "sidebar"), (2, "sidebar main"), (3, "brand-menu"), (4, None)], "i int, c string")
    assert [r.u for r in df.select("i", T.unlikely(F.col("c"), F.lit(None).cast("string"), F.lit("div")).alias("u")).orderBy("i").collect()] == [True, False, False, False]


def test_paragraph_score(spark):
    got = values(spark, T.paragraph_score, ["x" * 98 + ",,", "y" * 400])
    assert got == [5.0, 5.0]


def test_sentences(spark):
    got = values(spark, S.sentences, ["One here. Two there! Dr. Who came.\nLast", "", None])
    assert got == [["One here.", "Two there!", "Dr. Who came.", "Last"], [], None]
    assert values(spark, S.complete, ["2015.", "Hello", "Hello.", "Wait…", "— Hello.", "-5 degrees.", "Well - yes."]) == [False, False, True, True, False, False, True]


def test_ranks(spark):
    three = [{"a", "b"}, {"a", "b"}, {"a", "b"}]
    assert [round(r, 6) for _, r in S.ranked_order(three)] == [round(1 / 3, 6)] * 3
    assert S.ranked_order([{"a"}]) == [] and S.summarise(["One."], "en", 5) == ""
    sents = ["The cat sat down.", "The cat ran off.", "A dog and the cat."]
    assert S.summarise(sents, "en", 9) == " ".join(sents)
    total = sum(r for _, r in S.ranked_order([{"a", "b"}, {"b", "c"}, {"c", "d", "a"}]))
    assert abs(total - 1) < 1e-6
    df = spark.createDataFrame([([["a", "b"], ["b", "c"], ["c", "d", "a"], ["z"]],)], "s array<array<string>>")
    pr = df.select(S.ranks(F.col("s"), 60).alias("r")).first().r
    want = dict(S.ranked_order([{"a", "b"}, {"b", "c"}, {"c", "d", "a"}, {"z"}]))
    assert pr[3] is None and all(abs(pr[i] - want[i]) < 1e-4 for i in range(3))


def test_stems():
    assert S.stem("walking", "en") == "walk" and S.stem("walks", "xx") == "walk" and S.stem("is", "en") == "is"


def test_ranks_without_a_matrix(monkeypatch):
    import random

    rnd = random.Random(4)
    sets = [set(rnd.sample("abcdefghijklmnop", rnd.randint(0, 6))) for _ in range(60)] + [{"zz"}, set()]
    want = S.ranked_order(sets)
    monkeypatch.setattr(S, "DENSE", 0)
    monkeypatch.setattr(S, "WIDE", 50)
    got = S.ranked_order(sets)
    assert [i for i, _ in got] == [i for i, _ in want] and all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(got, want))


def test_a_long_text_is_ranked_in_little_memory():
    import random

    rnd = random.Random(5)
    sets = [{"the", *(f"w{rnd.randint(0, 9000)}" for _ in range(rnd.randint(3, 20)))} for _ in range(20_000)]
    assert len(S.ranked_order(sets, most=3)) == 20_000


TEXTS = ["the cat and the dog is in that house", "der Hund und die Katze ist nicht mit dem", "кот и пес", "犬はここにいます", "我们的城市", "123", "", None, "jeg har også været der og skal ikke til efter", "jeg har også vært der og skal ikke til etter av", "hän on myös kun se oli niin", "a ház és az ember nem volt meg egy", "แมว", "यह घर", "och det är inte en"]


def test_vote_of_plain_strings_agrees_with_the_column(spark):
    got = values(spark, voting.language, TEXTS)
    assert got == [voting.vote(t) for t in TEXTS] and {"da", "no", "fi", "hu", "sv", "th", "hi", "zh"} <= set(got)


def test_plain_operators_agree_with_columns(spark):
    from pagequern.functions import plain as P

    texts = ["  a \n\n b\t\tc  d ", "News — «Big» day! &quot;x&quot;", "\u2003x\xa0y\u3000", "", "ab", "The big, big story: part-2"]
    assert values(spark, T.clean, texts) == [P.clean_text(t) for t in texts]
    assert values(spark, T.norm_title, texts) == [P.norm_title(t) for t in texts]
    assert values(spark, T.grams, texts) == [P.grams(t) for t in texts]
    assert P.similarity(P.grams("abcd"), P.grams("abc")) == pytest.approx(200 / 3) and P.similarity([], []) is None
    assert P.best_title("abcdef", [(1, "abcdef"), (2, "abcdef"), (3, "zzzz")], 50)[1:] == (2, "abcdef") and P.best_title("abc", [], 50) is None


def test_absolute_urls_as_the_standard_library_makes_them(spark):
    from urllib.parse import urljoin

    bases = ["http://a.example/p/q?r=1#s", "http://a.example", "https://a.example/p/q/"]
    urls = ["x", "/x", "../x", "./x", "../../../x/./y", "//c.example/x", "http://b.example/../x", "?a=1", "#top", "", "a/../b?c=../d", "..", "mailto:a@b.example"]
    df = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate((u, b) for u in urls for b in bases)], "i int, u string, b string")
    for r in df.select("u", "b", T.absolute_url(F.col("u"), F.col("b")).alias("x")).collect():
        assert r.x == urljoin(r.b, r.u) or (r.u == "" and r.x == r.b), (r.u, r.b, r.x, urljoin(r.b, r.u))


def test_image_url_in_a_query(spark):
    cases = {"http://a.example/i.php?u=http://b.example/c.jpg&w=3": "http://b.example/c.jpg", "http://a.example/d.png?x=http://b.example/c.jpg": "http://a.example/d.png?x=http://b.example/c.jpg", "http://a.example/i.php?u=none": "http://a.example/i.php?u=none"}
    assert values(spark, T.embedded_image_url, list(cases)) == list(cases.values())


SRCSETS = [("a.jpg 300w, b.jpg 800w", None, "http://h.example/b.jpg"), ("a.jpg 300w, b.jpg 400w", None, "http://h.example/a.jpg"), ("a.jpg", "c.png", "http://h.example/c.png"), ("a.jpg foo", "d.png", "http://h.example/d.png"), (None, "/x/e.jpeg?q=1", "http://h.example/x/e.jpeg?q=1"), ("a.webp 900w", "f.gif", None)]


def test_srcset_and_headers(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(SRCSETS)], "i int, srcset string, src string")
    got = [r.u for r in df.select("i", T.image_url(F.col("src"), F.col("srcset"), F.array().cast("array<string>"), F.lit("http://h.example/")).alias("u")).orderBy("i").collect()]
    assert got == [x for _, _, x in SRCSETS]
    from pagequern.operators import decoding

    heads = ["89504E470D0A1A0A0000000D4948445200000280000001E0", "474946383961400101F0", "474946383761800280020000", "FFD8FFE000104A464946", "", "FFD8FFE000104A46494600010100000100010000FFC0001108" + "01E0" + "0280" + "03012200021101031101"]
    df = spark.createDataFrame(list(enumerate(heads)), "i int, h string").withColumn("b", F.unhex("h"))
    s = F.coalesce(T.png_size(F.col("b")), T.gif_size(F.col("b")), decoding.jpeg_column(F.col("b")))
    assert [(r.s and (r.s.width, r.s.height)) for r in df.select("i", s.alias("s")).orderBy("i").collect()] == [(640, 480), (320, 61441), (640, 640), (None, None), (None, None), (640, 480)]


RU = "Городской совет закрыл старый мост, потому что весной вода поднялась выше обычного. Жители недовольны решением."
ZH = "市议会关闭了旧桥,因为春天的水位比平时高。居民对这个决定不满意,他们要求尽快修好。"
BYTES = [
    (RU, "windows-1251"), (RU, "koi8-r"), (RU, "iso-8859-5"), (RU, "ibm866"), (ZH, "gb18030"), ("市議會關閉了舊橋,因為春天的水位比平時高。居民對這個決定不滿意,他們要求盡快修好。", "big5"),
    ("市議会は古い橋を閉鎖しました。春の水位がいつもより高かったからです。住民は決定に不満です。", "shift_jis"), ("市議会は古い橋を閉鎖しました。春の水位がいつもより高かったからです。住民は決定に不満です。", "euc-jp"),
    ("시의회는 봄에 물이 평소보다 높아져 오래된 다리를 폐쇄했다. 주민들은 결정에 불만이다.", "windows-949"), ("Το δημοτικό συμβούλιο έκλεισε την παλιά γέφυρα την άνοιξη.", "windows-1253"), ("מועצת העיר סגרה את הגשר הישן באביב.", "windows-1255"),
    ("أغلق مجلس المدينة الجسر القديم في الربيع.", "windows-1256"), ("สภาเมืองปิดสะพานเก่าในฤดูใบไม้ผลิ", "windows-874"), ("Le conseil a fermé le vieux pont à l’été; les élèves n’ont pas été prévenus.", "windows-1252"), ("Der Gemeinderat schloß die Brücke; für Fußgänger öffnet sie später.", "windows-1252"),
    ("Belediye köprüyü kapattı; çünkü ırmağın suyu yükseldi, ağaçlar için şaşırtıcıydı.", "windows-1254"), ("Rada města zavřela starý most, protože řeka v létě příliš stoupla; žáci čekají.", "windows-1250"), ("Zażółć gęślą jaźń, proszę państwa; środa i wtorek są wolne.", "windows-1250"),
    (RU, "utf-8"), (RU, "utf-16-le"), ("plain", "utf-8"), ("", "utf-8"), ("市議会は古い橋", "iso-2022-jp"),
]


@pytest.mark.parametrize("text, name", BYTES)
def test_charset_detection(text, name):
    from pagequern.functions.charsets import PYTHON, detect

    page = f"<html><head><title>{text}</title></head><body><p>{text}</p></body></html>"
    for x in (page, text):
        if len(x) and (name != "utf-16-le" or x is page):
            assert detect(x.encode(PYTHON.get(name, name))) == name


def test_marks_and_broken_bytes():
    from pagequern.functions.charsets import detect

    assert detect("\ufeffx".encode("utf-8")) == "utf-8" and detect("\ufeffé".encode("utf-16-le")) == "utf-16-le"
    assert detect(b"\x00") == "utf-8" and detect(bytes(range(128, 256)))
    assert detect((RU + "ю").encode("utf-8")[:-1]) == "utf-8" and detect(b"\x93quoted\x94") == "windows-1252"


STEMS = {
    "en": {"generously": "generous", "consistency": "consist", "knightly": "knight", "skies": "sky", "hopping": "hop", "hoping": "hope", "happy": "happi", "ties": "tie", "cries": "cri", "relational": "relat", "nationally": "nation", "troubles": "troubl", "agreed": "agre", "by": "by", "say": "say", "communism": "communism", "herring": "herring", "controlling": "control", "adjustable": "adjust"},
    "de": {"häuser": "haus", "aufeinanderfolge": "aufeinanderfolg", "kategorien": "kategori", "straße": "strass", "freundlichkeit": "freundlich", "zeitungen": "zeitung"},
    "sv": {"jaktkarlarne": "jaktkarl", "klostergården": "klostergård", "möjligheten": "möj"}, "da": {"undersøgelse": "undersøg", "indtage": "indtag"}, "no": {"havnedistriktene": "havnedistrikt", "opning": "opning"},
    "fr": {"chantées": "chant"}, "ru": {"книгами": "книг"}, "xx": {"walks": "walk"},
}


@pytest.mark.parametrize("lang", sorted(STEMS))
def test_stems_of_languages(lang):
    assert {w: S.stem(w, lang) for w in STEMS[lang]} == STEMS[lang]


@pytest.mark.parametrize("lang", ["en", "de", "sv", "da", "no", "fr", "fi"])
def test_stems_never_grow_or_vanish(lang):
    import random

    rnd = random.Random(6)
    for _ in range(3000):
        w = "".join(rnd.choice("abcdeghilnorstuyäöåéæøn") for _ in range(rnd.randint(1, 12)))
        assert 0 < len(S.stem(w, lang)) <= len(w) + 1
