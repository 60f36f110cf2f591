import re

from pyspark.sql import functions as F

from seekspark.functions import text as T
from seekspark.functions.stem import with_stem


def one(spark, col, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"x {dtype}").select(col.alias("y")).first()["y"]


def test_clean_string_golden(spark):
    s = "В Москве и  не 12 Ёлка-ёлка"
    assert one(spark, T.clean_string("x"), s) == "москве не ёлка ёлка"
    # the capital 'В' is not in the list; the length rule removes it
    assert one(spark, T.clean_string("x", ["и", "не", "в"]), s) == "москве ёлка ёлка"


def test_clean_drops_long_tokens(spark):
    s = "ab " + "x" * 31 + " " + "y" * 30 + " c"
    assert one(spark, T.clean_tokens("x"), s) == ["ab", "y" * 30]
    assert one(spark, T.clean_tokens("x"), "") == []
    assert one(spark, T.clean_tokens("x"), "1 2 3 !!") == []


def test_word_count_and_stub(spark):
    assert one(spark, T.word_count("x"), "") == 1
    assert one(spark, T.word_count("x"), "a b") == 2
    df = T.fill_stub(spark.createDataFrame([(None, "a")], "u string, v string"))
    assert df.first()["u"] == "stub"


def test_heading_and_section_url(spark):
    assert one(spark, T.heading_text("x"), "1.2 Ранние годы") == "Ранние годы."
    assert one(spark, T.heading_text("x"), "История") == "История."
    df = spark.createDataFrame([("u", "Ранние годы."), ("u", "")], "url string, h string")
    got = [r[0] for r in df.select(T.section_url("url", "h")).collect()]
    assert got == ["u#Ранние_годы", "u"]


def test_toc_headings(spark):
    html = ('<div><nav><ul><li><a href="/x">1 Начало</a></li><li><a>2 Конец</a></li>'
            '<li><a>1 Начало</a></li></ul></nav></div>')
    assert one(spark, T.toc_headings("x"), html) == ["Начало.", "Конец."]
    assert one(spark, T.toc_headings("x"), "<p>no toc</p>") is None


def test_strip_tags_url_lines(spark):
    assert one(spark, T.strip_tags("x"), "<b>a</b> <i\n>c") == "a <i\n>c"
    assert one(spark, T.first_url("x"), '<doc url="https://a.b/c?d=1" t="x">') == "https://a.b/c?d=1"
    assert one(spark, T.first_url("x"), "none") == ""
    assert one(spark, T.line_at("x", 1), "<doc>\nTitle\nbody") == "Title"
    assert one(spark, T.remove_strings("x", ["\n\n"]), "a\n\nb c") == "ab c"


def test_title_and_body(spark):
    df = spark.createDataFrame([("\nTitle\n\nbody",)], "x string")
    t, b = T.title_and_body("x")
    r = df.select(t.alias("t"), b.alias("b")).first()
    assert r["t"] == "Title" and r["b"] == "\n\nbody"


def test_request_queries(spark):
    assert one(spark, T.request_path_query("x"), "/как_дела%3F+1") == "как дела?+1"
    assert one(spark, T.request_body_query("x"), bytearray("вопрос".encode()), "binary") == "вопрос"


def test_stop_word_lists():
    ru, en = T.stop_words("russian"), T.stop_words("english")
    assert len(ru) == 151 and len(en) == 181
    assert len(T.stop_words("russian", "english")) == len(set(ru) | set(en))


STEMS = {"вазы": "ваз", "красивая": "красив", "бегавший": "бега", "книги": "книг", "читала": "чита",
         "обучения": "обучен", "машинного": "машин", "модель": "модел", "нейронных": "нейрон",
         "сетей": "сет", "искусственный": "искусствен", "теория": "теор", "программирования": "программирован",
         "ёлка": "елк", "величайшие": "величайш", "сильнейшая": "сильн", "бегая": "бег", "hello": "hello"}


def test_russian_stemmer(spark):
    df = with_stem(spark.createDataFrame([(w,) for w in STEMS], "w string"), "w", "s")
    got = {r.w: r.s for r in df.collect()}
    assert got == STEMS


def test_letters_with_and_without_cyrillic(spark):
    """Texts without Cyrillic take the narrow class (F11), and every text the same letters as the wide one."""
    texts = [None, "", " ", "a", "Don't stop. 42x", "Été À la carte", "KKelvin İx", "Ёлка и ёж, word", "Ѐђ Ґ ѿ a", "中文 mixed Ж",
             "Ð Ñ Đ", "x퟿y", "\U0001f600a\U00010451b", "၁ࡑz‑q"] + [f"a{chr(i)}B" for i in (*range(0x3c0, 0x500), 0x1d0, 0x1d1)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    cleaned = T.keep_letters("t")
    assert "[^a-zA-Z]+" in rows.select(cleaned)._jdf.queryExecution().analyzed().toString()
    got = [r.x for r in rows.select("i", cleaned.alias("x")).orderBy("i").collect()]
    assert got == [t if t is None else re.sub(f"[^{T.LETTER_CLASS}]+", " ", t) for t in texts]
