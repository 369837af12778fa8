"""Quality, language and HTML: exact pieces by brute force, and held-out
accuracy on the given tables."""

import itertools
import math
import random

import numpy as np
import pytest

from ledgerlens.llm import html_text, langid, quality, queries

SF = "/root/testdata/sf0.01"


def test_marginals_equal_enumeration():
    rng = random.Random(1)
    for _ in range(20):
        n = rng.randint(1, 6)
        scores = [rng.uniform(-3, 3) for _ in range(n)]
        a = [[rng.uniform(-1, 1) for _ in range(2)] for _ in range(2)]
        field = quality.LineField(None, None, None, a)
        weight = {}
        for y in itertools.product((0, 1), repeat=n):
            s = sum(v for v, k in zip(scores, y) if k) + sum(a[p][q] for p, q in zip(y, y[1:]))
            weight[y] = math.exp(s)
        z = sum(weight.values())
        want = [sum(w for y, w in weight.items() if y[i]) / z for i in range(n)]
        assert np.allclose(field.marginals(scores), want)


def test_features_of_a_line_and_its_neighbours():
    x, sizes = quality.line_features("AB 12|\n\nab ab".encode())
    assert sizes.tolist() == [6, 0, 5] and x.shape[0] == 3
    own = quality._OWN
    assert x[0][1] == pytest.approx(2 / 6) and x[0][2] == pytest.approx(2 / 6)
    assert x[2][4] == pytest.approx(0.5)              # one of two words repeated
    assert (x[1][own:2 * own] == x[0][:own]).all()    # line before
    assert (x[1][2 * own:3 * own] == x[2][:own]).all()


def test_run_of_a_long_text_has_the_features_of_the_whole():
    rng = random.Random(3)
    starts = set()
    for k in range(40):
        text = "\n".join(rng.choice(["ab cd", "AB 1|", "", "ab cd ef"])
                         for _ in range(6 + k % 9)).encode()
        whole = quality.line_features(text)[0]
        run = quality.run_features(text, 5)
        at = [i for i in range(len(whole) - 4) if (whole[i:i + 5] == run).all()]
        assert at
        starts.update(at)
    assert len(starts) > 3


def test_quality_learns_from_long_documents_only(spark, docs):
    good = "A plain line of words about the weather and the town."
    bad = "$$ 12|34 || BUY BUY BUY !!"
    texts = [(i, "\n".join([f"{good if i % 2 else bad} {i} {j}" for j in range(300)]))
             for i in range(12)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    field = quality.fit(docs(texts), labels)
    assert field is not None
    found = {r.doc_id: r.score for r in quality.score(docs(texts), field).collect()}
    assert all((found[i] > 0.5) == (i % 2 == 1) for i in range(12))


def test_labels_without_documents_take_no_place_in_the_sample(spark, docs):
    rows = [(i, "good words here" if i % 2 else "$$ || 99") for i in range(6)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    assert quality.fit(docs(rows), labels, max_docs=6) is not None


def test_quality_held_out(spark):
    rows = queries.op5_quality(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    held = rows.join(labels, "doc_id").where("held_out").collect()
    assert len(held) > 50
    right = sum(r.predicted == r.quality for r in held) / len(held)
    assert right >= 0.95
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def plain_kneser_ney(texts: list[str], order: int):
    """Interpolated Kneser-Ney of one language by dictionaries."""
    grams = [("".join(c if c.isalpha() else " " for c in t.lower())).split() for t in texts]
    padded = [" " * (order - 1) + " " + " ".join(g) + " " for g in grams if g]
    counts = {order: {}}
    for p in padded:
        for i in range(order, len(p)):
            g = p[i - order + 1:i + 1]
            counts[order][g] = counts[order].get(g, 0) + 1
    for k in range(order - 1, 0, -1):
        counts[k] = {}
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1
    letters = len(counts[1]) + 1

    def prob(g):
        k = len(g)
        if k == 0:
            return 1 / letters
        table = counts[k]
        n1 = sum(v == 1 for v in table.values())
        n2 = sum(v == 2 for v in table.values())
        d = n1 / (n1 + 2 * n2) if n1 else 0.5
        same = [v for h, v in table.items() if h[:-1] == g[:-1]]
        if not same:
            return prob(g[1:])
        return (max(table.get(g, 0) - d, 0) if g in table else 0) / sum(same) \
            + d * len(same) / sum(same) * prob(g[1:])
    return prob, padded


@pytest.mark.parametrize("order", [2, 4])
def test_kneser_ney_equals_the_formula(spark, order):
    texts = ["The cat sat; on the MAT!", "a cat, a hat", "", "tea for two"]
    rows = spark.createDataFrame([("en", t) for t in texts], "lang string, text string")
    model = langid.fit(rows, order=order)
    prob, _ = plain_kneser_ney(texts, order)
    for text in ("the hat", "zzz", "cat sat tea"):
        p = " " * order + text + " "
        want = -sum(math.log(prob(p[i - order + 1:i + 1])) for i in range(order, len(p)))
        got, size = model.entropies([text])
        assert size[0] == len(text) + 1
        assert got[0][0] * size[0] == pytest.approx(want, rel=1e-6)


def test_languages_held_out(spark):
    found = queries.op10_langid(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 150
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_fewer_types_lower_the_order(spark):
    rows = spark.createDataFrame([("en", "the cat sat on the mat"), ("de", "das ist gut")],
                                 "lang string, text string")
    assert langid.fit(rows, max_types=25).order < 4
    assert langid.fit(rows).order == 4


def test_many_types_keep_the_order_in_blocks(spark):
    """The model of several blocks is the formula of order 4, as that of one is."""
    texts = ["The cat sat; on the MAT!", "a cat, a hat", "", "tea for two"]
    other = ["das ist gut", "日本語の文", "die Katze"]
    rows = spark.createDataFrame([("en", t) for t in texts] + [("xx", t) for t in other],
                                 "lang string, text string")
    one, many = langid.fit(rows), langid.fit(rows, block_values=60)
    assert one.order == many.order == 4
    assert len(one.blocks) == 1 and len(many.blocks) > 5
    asked = ["the hat", "zzz", "cat sat tea", "Katze 日本", "", None]
    want, sizes = one.entropies(asked)
    got, again = many.entropies(asked)
    assert (sizes == again).all() and np.allclose(got, want, rtol=1e-9)
    docs = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    a, b = (langid.identify(docs, m).orderBy("doc_id").collect() for m in (one, many))
    assert [(r.doc_id, r.lang_pred, r.rejected) for r in a] \
        == [(r.doc_id, r.lang_pred, r.rejected) for r in b]
    alone = langid.fit(rows.where("lang = 'en'"), block_values=20)
    prob, _ = plain_kneser_ney(texts, 4)
    p = "    cat sat tea "
    want = -sum(math.log(prob(p[i - 3:i + 1])) for i in range(4, len(p)))
    got, size = alone.entropies(["cat sat tea"])
    assert len(alone.blocks) > 1 and got[0][0] * size[0] == pytest.approx(want, rel=1e-6)


def test_languages_in_groups(spark, monkeypatch):
    """More languages than a group holds give the model that one group gives."""
    rows = spark.createDataFrame(
        [(f"l{i:02d}", " ".join(f"{a}{chr(97 + i)}{b}" for a in "aeiou" for b in "nrst"))
         for i in range(7)] + [("zz", "𠀀𠀁 𐐨x")], "lang string, text string")
    one = langid.fit(rows)
    monkeypatch.setattr(langid, "LANG_GROUP", 3)
    many = langid.fit(rows)
    assert len({first for first, _, _ in many.blocks}) == 3 and one.langs == many.langs
    asked = ["aan", "edr edr", "𠀀", "xyz 𐐨"]
    assert np.allclose(one.entropies(asked)[0], many.entropies(asked)[0], rtol=1e-9)
    assert many.langs[int(many.entropies(["𠀀𠀁"])[0].argmin())] == "zz"


def test_letters_beyond_the_basic_plane_are_told_apart():
    """U+20041 is not U+0041 (its lower 16 bits), nor U+10041."""
    keys = [tuple(langid.grams([t], 1)[0].tolist()) for t in ("a", "\U00020061", "\U00010400")]
    assert len(set(keys)) == 3 and len(keys[1]) == 3 and keys[0][0] == ord("a")
    codes, stops = langid.codes_of(["\U00020061b", "", "c"])
    assert stops.tolist() == [3, 4, 6]
    assert codes[:3].tolist() == [0xD840, 0xDC61, ord("b")]


def test_no_number_of_types_lowers_the_order_by_itself():
    import inspect
    assert inspect.signature(langid.fit).parameters["max_types"].default is None


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="<p>x</p>";</script></head>
<body><header><h1>Site</h1></header><nav><ul><li>Home</li></ul></nav>
<div id="cookie-notice">We use cookies</div>
<%s><h2>Title &amp; more</h2><p>First paragraph of the article, with a good number of words
  in it &mdash; and a <b>bold</b> one.<p>Second one with <a href="x">a link</a> in the text, also
long enough to count as text.</p><p>Short.</p><aside>See also</aside>
<div class="ad">Buy now, this is a very good offer for all of you</div></%s>
<section class="comments"><p>I liked this article very much, thank you for it.</p></section>
<form><p>Subscribe to the letter</p><input></form><footer>&copy; Site</footer></body></html>"""
WANT = ("Title & more\n\nFirst paragraph of the article, with a good number of words in it — "
        "and a bold one.\n\nSecond one with a link in the text, also long enough to count as "
        "text.\n\nShort.")


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_article_without_what_is_around_it(tag):
    assert html_text.extract(PAGE % (tag, tag)) == WANT


LONG = "This paragraph goes on for long about what the page is there to tell its readers. " * 4
LONG = LONG.strip()


def test_main_text_in_a_div_beside_teaser_articles():
    cards = "".join(f'<article><h3><a href="/{i}">Card {i}</a></h3></article>' for i in range(3))
    page = f"<body><div class='text'><p>{LONG}</p><p>{LONG}</p><p>End.</p></div>" \
           f"<div class='cards'>{cards}</div></body>"
    assert html_text.extract(page) == f"{LONG}\n\n{LONG}\n\nEnd."
    page = f"<body><div class='cards'>{cards}</div><div><p>{LONG}</p><p>{LONG}</p></div></body>"
    # the card next to the text is lifted by the smoothing
    assert html_text.extract(page) == f"Card 2\n\n{LONG}\n\n{LONG}"


def test_long_and_short_article():
    short = "The bridge is open again since Monday, the town said."
    many = "".join(f"<p>{LONG}</p>" for _ in range(6))
    page = f"<body><article>{many}</article><div><ul><li><a href='a'>More</a></li>" \
           f"<li><a href='b'>Less</a></li><li><a href='c'>Help</a></li></ul></div>" \
           f"<article><h2>Roads</h2><p>{short}</p></article></body>"
    assert html_text.extract(page) == "\n\n".join([LONG] * 6 + ["Roads", short])


def test_a_div_around_every_paragraph():
    """Short blocks between the long ones stay, also directly in the body."""
    blocks = [LONG, "Yes.", LONG, LONG, "No, not at all.", LONG]
    inner = "".join(f"<div><p>{b}</p></div>" for b in blocks)
    for around in ("<div id=story>%s</div>", "%s", "<table><tr><td>%s</td></tr></table>"):
        page = f"<body><nav>Menu</nav>{around % inner}<div class=related>More</div>" \
               "<div><a href=1>a</a><a href=2>b</a><a href=3>c</a></div></body>"
        assert html_text.extract(page) == "\n\n".join(blocks), around


def test_title_beside_the_story():
    page = f"<body><div><h1>The title</h1></div><div><a href=x>1</a> <a href=y>2</a></div>" \
           f"<div class=story><p>{LONG}</p><p>{LONG}</p></div><footer>f</footer></body>"
    assert html_text.extract(page) == f"The title\n\n{LONG}\n\n{LONG}"
    results = f"<body><div class='search-results'><p>{LONG}</p><p>{LONG}</p></div></body>"
    assert html_text.extract(results) == f"{LONG}\n\n{LONG}"


def test_the_clusters_decide(monkeypatch):
    """With all lines or none called content, the same pages come out otherwise."""
    story = f"<div id=a><div><p>{LONG}</p></div><div><p>Yes.</p></div><div><p>{LONG}</p></div></div>"
    links = "<div id=b>" + "".join(f"<p><a href={i}>n {i}</a></p>" for i in range(8)) + "</div>"
    pages = [f"<body>{story}{links}</body>", f"<body>{links}{story}</body>",
             f"<article><p>{LONG}</p></article>{links}"]
    want = [f"{LONG}\n\nYes.\n\n{LONG}"] * 2 + [LONG]
    assert [html_text.extract(p) for p in pages] == want
    monkeypatch.setattr(html_text, "content_lines", lambda r, sigma: (np.ones(len(r), bool),) * 2)
    assert all(html_text.extract(p) != w for p, w in zip(pages, want))
    monkeypatch.setattr(html_text, "content_lines", lambda r, sigma: (np.zeros(len(r), bool),) * 2)
    assert [html_text.extract(p) for p in pages] == [""] * 3


def test_broken_pages():
    assert html_text.extract("") == ""
    assert html_text.extract("plain &lt;text") == "plain <text"
    assert html_text.extract("<article><p>cut off in the mid") == "cut off in the mid"
    assert html_text.extract("<nav>only a menu</nav>") == ""
    assert html_text.extract("<p>a<br>b</p></div></p>") == "a b"


def test_pages_against_their_markup(spark):
    """The given pages keep their text in one article element."""
    import html
    import re
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r.text for r in queries.op6_html(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = re.split(r"</?(?:h1|p)>", body)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks]
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)
