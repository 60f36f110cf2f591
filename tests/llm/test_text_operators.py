import pytest
from pyspark.sql import functions as F

from seekspark.llm import lineblock as B
from seekspark.llm import zlang as Z
from tests.llm import cases

WORDS = {"en": "the house and a garden with some people who were walking through there",
         "de": "das haus und ein garten mit leuten die dort nicht gegangen sind",
         "fr": "la maison et un jardin avec des gens qui marchaient dans cette rue"}


def labelled(spark):
    import random
    rng = random.Random(1)
    return spark.createDataFrame([(i, " ".join(rng.choices(WORDS[k].split(), k=60)), k) for i in range(90)
                                  for k in [sorted(WORDS)[i % 3]]], "doc_id long, text string, lang string")


def test_language_of_new_texts(spark):
    dictionaries = Z.fit(labelled(spark))
    assert [k for k, _ in dictionaries] == ["de", "en", "fr"] and all(len(d) <= Z.DICTIONARY_BYTES for _, d in dictionaries)
    texts = [(1, "people walking with the garden"), (2, "LEUTE MIT DAS HAUS UND GARTEN!"), (3, None), (4, "123 ... 45"), (5, ""),
             (6, "gens avec des jardin " * 20_000)]
    got = {r.doc_id: r["__lang"] for r in Z.identify(cases.docs(spark, texts), dictionaries).collect()}
    assert [got[i].lang_pred for i in range(1, 7)] == ["en", "de", "und", "und", "und", "fr"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[6].accepted and not got[3].accepted


def test_narrow_margin_is_rejected_but_guessed(spark):
    own = Z.Compressors([("aa", b" same sample of words "), ("bb", b" same sample of words ")])
    assert own.predict("words of sample") == ("aa", 0.5, False)


def test_nothing_labelled(spark):
    dictionaries = Z.fit(cases.empty(spark))
    assert dictionaries == []
    assert {r["__lang"].lang_pred for r in Z.identify(cases.docs(spark), dictionaries).collect()} == {"und"}
    assert Z.identify(cases.empty(spark), Z.fit(labelled(spark))).count() == 0


def test_sample_is_bounded_and_skips_nulls(spark):
    rows = labelled(spark).unionByName(spark.createDataFrame([(900, None, "de"), (901, "x", None)], labelled(spark).schema))
    assert [k for k, _ in Z.fit(rows)] == ["de", "en", "fr"]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">One</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site, please agree to all of them now.</p></div>%s
<aside><p>Read this too</p></aside><footer>&copy; us</footer></body></html>"""


def test_article_with_everything_around_it():
    body = """<article><header><h1>A &amp; B</h1></header><p>First <b>par</b>agraph
      with&nbsp;space.<br>After break</p><div class="ad"><div>Buy</div>now</div><p>Hm.</p><p>x < y &lt;b&gt; &eacute;</p>
      <form><label>Mail</label><input name="q"></form><section id="comments"><p>Great post!</p></section></article>"""
    assert B.main_text(PAGE % body) == "A & B\nFirst paragraph with space.\nAfter break\nHm.\nx < y <b> é"


def test_page_without_article_mark():
    long = "A sentence that belongs to the story and is told at some length here. "
    body = f"<div><p>{long}</p><p>Short.</p><p>{long}</p></div><div>Lone</div>"
    assert B.main_text(PAGE % body).startswith(f"{long.strip()}\nShort.\n{long.strip()}")
    assert "cookies" not in B.main_text(PAGE % body) and "us" != B.main_text(PAGE % body)[-2:]


def test_broken_and_empty_pages():
    assert B.main_text(None) == B.main_text("") == B.main_text("<html><nav>x</nav>") == ""
    assert B.main_text("<p>only text") == "only text"
    assert B.main_text("<article><p><b>bold<br><p>next</article><footer>f") == "bold\nnext"
    assert B.main_text("<div class=ad>ad text<p>story of the page") == "story of the page"
    assert B.main_text("<article><p>a</p><!-- <p>no</p> --><script>x</article><p>") == "a"
    assert B.main_text("<article>" + "<p>w</p>" * 20_000 + "</article>").count("\n") == 19_999


def test_layout_around_the_article_and_names_inside_it():
    for around in ('<div class="content-sidebar-wrap">%s</div>', '<div class="layout with-sidebar">%s</div>', "<form id=f>%s</form>",
                   '<div class="sidebar">x<div>%s</div></div>', '<section class="post has-comments"><main>%s</main></section>'):
        assert "story" in B.main_text(PAGE % (around % "<article><p>story</p></article>")), around
    for inside in ('<h2 id="related-work">%s</h2>', '<section id="social-impact"><p>%s</p></section>', '<p class="notice">%s</p>',
                   '<section id="search-results"><p>%s</p></section>', '<section class="post has-comments"><p>%s</p></section>'):
        assert B.main_text(PAGE % f"<article><p>a</p>{inside % 'kept'}<p>b</p></article>") == "a\nkept\nb", inside
    for inside in ('<p class="ad">%s</p>', '<div class="ad-wrapper">%s</div>', '<div id="ad-slot-1">%s</div>',
                   '<section id="comments"><article class="comment-body">%s</article></section>', "<aside><article>%s</article></aside>",
                   '<div class="related-posts"><article>%s</article></div>'):
        assert B.main_text(PAGE % f"<article><p>a</p>{inside % 'gone'}<p>b</p></article>") == "a\nb", inside
    assert B.main_text('<section class="post has-comments"><p>only text') == "only text"


def test_head_and_embedded_elements_without_a_close():
    story = "<article><p>one</p><p>two %s three</p><p>four</p></article>"
    assert B.main_text("<head><title>t</title><meta charset=x><body>" + story % "and") == "one\ntwo and three\nfour"
    assert B.main_text("<head><title>t<!-- t</title><script>'<p>no'</script>" + story % "and") == "one\ntwo and three\nfour"
    for inside in ('<svg viewBox="0 0 1 1"/>', "<iframe src='x'/>", "<object>", "<button/>", "<svg><svg/><path/></svg>",
                   "<svg><svg><text>no</text></svg>no</svg>", "<button>no</button>", "<iframe/><iframe>no</iframe>"):
        assert B.main_text("<html><body>" + story % inside + "<svg><text>x</text></svg>") == "one\ntwo three\nfour", inside


def test_marks_stay_with_their_letters():
    """Scripts that write vowels and tones as marks: the words stay whole, and the languages are told apart."""
    assert Z._image("हिन्दी 42 भाषा!").decode() == " हिन्दी भाषा "
    assert Z._image("ภาษาไทย ที่ น้ำ").decode() == " ภาษาไทย ที่ น้ำ "
    assert Z._image("Crème_brûlée 3x") == " crème brûlée x ".encode()
    hindi = "यह एक सरल वाक्य है और हम इसे पढ़ते हैं। किताब मेज़ पर रखी हुई है और बच्चे बाहर खेल रहे हैं। "
    marathi = "हे एक साधे वाक्य आहे आणि आपण ते वाचतो. पुस्तक टेबलावर ठेवले आहे आणि मुले बाहेर खेळत आहेत. "
    thai = "นี่คือประโยคง่ายๆ และเราอ่านมัน หนังสือวางอยู่บนโต๊ะ และเด็กๆ กำลังเล่นอยู่ข้างนอก "
    by = Z.Compressors([(k, Z._image(t * 3)) for k, t in (("hi", hindi), ("mr", marathi), ("th", thai))])
    for lang, t in (("hi", "बच्चे किताब पढ़ते हैं और बाहर खेल रहे हैं"), ("mr", "मुले पुस्तक वाचतो आणि बाहेर खेळत आहेत"), ("th", "เด็กๆ อ่านหนังสือ และเล่นอยู่ข้างนอก")):
        assert by.predict(t)[0] == lang


def test_names_with_a_topic_and_paragraphs_of_links():
    for inside in ('<div class="share-price">%s</div>', '<div class="comments-analysis">%s</div>', '<section class="social-history">%s</section>',
                   '<div id="reply-letters">%s</div>', '<p><a href="/x">%s</a></p>', '<ul><li><a href=x>%s</a></li></ul>', "<pre>%s</pre>"):
        assert B.main_text(PAGE % f"<article><p>a</p>{inside % 'kept'}<p>b</p></article>") == "a\nkept\nb", inside
    for inside in ('<div class="share-buttons">%s</div>', '<div class="comment-list">%s</div>', '<div class="related-posts">%s</div>',
                   '<div class="ad-slot-2">%s</div>', '<section id="comments">%s</section>'):
        assert B.main_text(PAGE % f"<article><p>a</p>{inside % 'gone'}<p>b</p></article>") == "a\nb", inside
    long = "A sentence that belongs to the story and is told at some length here, with more to come."
    story = f"<div><p>{long}</p><p><a href='/s'>A paragraph that is a link.</a></p><p>{long}</p></div>"
    assert B.main_text(PAGE % story) == f"{long}\nA paragraph that is a link.\n{long}"
    assert "Home" not in B.main_text(PAGE % f"<p><a href=x>Home</a></p>{story}<p><a href=y>Home again</a></p>")
    assert B.main_text("<article><pre>a  b\n c</pre></article>") == "a b c"


def test_the_distribution_decides_whether_a_mark_is_believed():
    """A page whose article elements are cards for other pages, and one whose article is short."""
    long = "A sentence that belongs to the story and is told at some length here, with more to come. "
    body = f"<div><h1>Head</h1>{'<p>' + long * 3 + '</p>'}{'<p>' + long * 4 + '</p>'}<p>End.</p></div>"
    cards = "".join(f"<article><h3>Card {i}</h3></article>" for i in range(4))
    assert B.main_text(f"<body>{body}<div><div>{cards}</div></div>").startswith("Head\n" + (long * 3).strip())
    assert "End." in B.main_text(f"<body>{body}<div><div>{cards}</div></div>")
    assert B.main_text(f"<body><div>{long}</div><article><p>Short story of a few words here.</p></article>") == "Short story of a few words here."
    assert B.main_text(f"<body>{body}<article></article>").startswith("Head\n")


def _plain(page):
    """The text of article elements by the standard parser: blocks on lines, no advert boxes, no scripts."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.lines, self.line, self.inside, self.dead = [], [], 0, []

        def flush(self):
            text = " ".join("".join(self.line).split())
            self.lines += [text] if text else []
            self.line = []

        def handle_starttag(self, tag, attrs):
            if tag in B.BLOCKS:
                self.flush()
            self.inside += tag == "article"
            if self.dead or tag in ("script", "style", "aside", "nav", "form") or dict(attrs).get("class") in ("ad", "share", "comments"):
                if tag not in B.VOID:
                    self.dead.append(tag)

        def handle_endtag(self, tag):
            if tag in B.BLOCKS:
                self.flush()
            self.inside -= tag == "article" and self.inside > 0
            if self.dead and self.dead[-1] == tag:
                self.dead.pop()

        def handle_data(self, data):
            if self.inside and not self.dead:
                self.line.append(data)
    reader = Reader()
    reader.feed(page)
    reader.close()
    reader.flush()
    return "\n".join(reader.lines)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_pages_against_a_plain_parser(sf):
    import pyarrow.parquet as pq
    pages = pq.read_table(f"/root/testdata/{sf}/pages.parquet").to_pylist()
    assert len(pages) >= 50
    for p in pages:
        assert B.main_text(p["html"]) == _plain(p["html"]), p["page_id"]


def test_extract_column(spark):
    pages = spark.createDataFrame([(1, None, "t"), (2, "<article><p>a</article>", "t"), (2, "<article><p>a</article>", "t")],
                                  "page_id long, html string, text string")
    got = pages.select("page_id", B.extract(F.col("html")).alias("main")).collect()
    assert sorted((r.page_id, r.main) for r in got) == [(1, ""), (2, "a"), (2, "a")]
    assert pages.limit(0).select(B.extract(F.col("html"))).count() == 0
