"""Hand-written pages with the text that a reader would call the article, and the parser against the standard library's."""

import random
from html.parser import HTMLParser

import pytest

from driftlens.llm.html import BLOCKS, SILENT, VOID, blocks, main_text

A = "The harbour was quiet when the first boats came back, and nobody on the pier spoke."
B = "By noon the council had met twice, and the mayor promised an answer within a week."
C = "Fishermen say that the new rules were written without them. They want a vote."
NAV = "<nav><ul><li><a href=/>Home</a></li><li><a href=/news>News</a></li><li><a href=/sport>Sport</a></li></ul></nav>"
FOOT = "<footer><p>&copy; 2024 Harbour Post. All rights reserved.</p></footer>"
ASIDE = "<aside class=sidebar><h3>Most read</h3><ul><li><a href=/1>Storm warning</a></li><li><a href=/2>Ferry prices</a></li></ul></aside>"
COMMENTS = "<section id=comments><h2>Comments</h2><div class=comment><p>I agree with the mayor on this one.</p></div><div class=comment><p>Nobody asked us either.</p></div></section>"
COOKIE = "<div class=cookie-notice>We use cookies to improve this site. <button>Accept</button></div>"

#: (name, html, expected text)
PAGES = [
    ("plain article", f"<html><body>{NAV}<article><h1>Harbour news</h1><p>{A}</p><p>{B}</p></article>{FOOT}</body></html>", f"Harbour news\n{A}\n{B}"),
    ("main without article", f"<body><header class=masthead><div>Harbour Post</div></header>{NAV}<main><h1>Harbour news</h1><p>{A}</p><p>{C}</p></main>{FOOT}", f"Harbour news\n{A}\n{C}"),
    ("divs alone", f'<body><div class="menu"><ul><li><a href=/a>Home</a></li><li><a href=/b>About</a></li></ul></div><div id="content"><p>{A}</p><p>{B}</p></div><div class="footer">Copyright 2024 Harbour Post</div>', f"{A}\n{B}"),
    ("sidebar behind", f"<body>{NAV}<article><p>{A}</p><p>{B}</p><p>{C}</p></article>{ASIDE}{FOOT}", f"{A}\n{B}\n{C}"),
    ("sidebar before", f"<body>{ASIDE}<article><h1>Harbour news</h1><p>{A}</p></article>{FOOT}", f"Harbour news\n{A}"),
    ("comments behind", f"<body>{NAV}<article><h1>Harbour news</h1><p>{A}</p><p>{B}</p></article>{COMMENTS}{FOOT}", f"Harbour news\n{A}\n{B}"),
    ("cookie notice first", f"<body>{COOKIE}{NAV}<article><p>{A}</p><p>{B}</p></article>", f"{A}\n{B}"),
    ("advert within", f"<body>{NAV}<article><p>{A}</p><div class=ad>Buy a new boat today.</div><p>{B}</p></article>{FOOT}", f"{A}\n{B}"),
    ("end tags left out", f"<body>{NAV}<article><h1>Harbour news</h1><p>{A}<p>{B}<p>{C}</article>{FOOT}", f"Harbour news\n{A}\n{B}\n{C}"),
    ("list in the article", f"<body>{NAV}<article><p>{A}</p><ul><li>Boats need a licence.<li>Nets need a tag.</ul><p>{B}</p></article>{FOOT}", f"{A}\nBoats need a licence.\nNets need a tag.\n{B}"),
    ("table in the article", f"<body><article><p>{A}</p><table><tr><td>Boat</td><td>Catch</td></tr><tr><td>Alma</td><td>40 kg</td></tr></table><p>{C}</p></article>{FOOT}", f"{A}\nBoat\nCatch\nAlma\n40 kg\n{C}"),
    ("links in a paragraph", f"<body>{NAV}<article><p>{A} <a href=/x>Read the report</a> for the figures.</p><p>{B}</p></article>", f"{A} Read the report for the figures.\n{B}"),
    ("quote marks in tags", f"<body>{NAV}<article><p title=it's>{A}</p><p data-x='a>b'>{B}</p></article>{FOOT}", f"{A}\n{B}"),
    ("scripts and styles", f"<body><script>if (a < b && c > d) document.write('<p>no</p>')</script><style>p > a {{}}</style>{NAV}<article><p>{A}</p><script src=x/>var a</script><p>{B}</p></article>", f"{A}\n{B}"),
    ("references", "<body><article><p>Fish &amp; chips cost &pound;4 &#8211; &#x201C;too much&#x201D;, says the cook&hellip; AT&<b>amp;</b></p></article>", "Fish & chips cost £4 – “too much”, says the cook… AT&amp;"),
    ("white space", "<body><article><p>\n  The   harbour\twas\n quiet&nbsp;when   boats came,\n and nobody spoke. </p></article>", "The harbour was quiet when boats came, and nobody spoke."),
    ("inline marks", "<body><article><p>The <b>har</b>bour <em>was <i>very</i></em> quiet, and <span>no</span>body spoke that day.</p></article>", "The harbour was very quiet, and nobody spoke that day."),
    ("line breaks", "<body><article><p>The harbour was quiet,<br>and nobody on the pier spoke.</p></article>", "The harbour was quiet, and nobody on the pier spoke."),
    ("comments of the source", f"<body><!-- <p>not this</p> --><article><p>{A}<!-- nor > this --></p><!--><p>{B}</p></article>", f"{A}\n{B}"),
    ("upper case tags", f"<BODY>{NAV.upper().replace('HREF=/', 'HREF=/')}<ARTICLE><P>{A}</P><P>{B}</P></ARTICLE>", f"{A}\n{B}"),
    ("forms", f"<body><form class=search><p><label>Search<input name=q></p></form><article><p>{A}</p><p>{B}</p></article><form class=signup><p>Your e-mail<input></p></form>", f"{A}\n{B}"),
    ("newsletter", f"<body>{NAV}<article><p>{A}</p><p>{B}</p></article><div class=newsletter>Get our letter each Monday.</div>{FOOT}", f"{A}\n{B}"),
    ("breadcrumbs", f"<body><div class=breadcrumbs><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></div><article><h1>Harbour news</h1><p>{A}</p></article>", f"Harbour news\n{A}"),
    ("headings inside", f"<body>{NAV}<article><h1>Harbour news</h1><p>{A}</p><h2>The vote</h2><p>{C}</p></article>{FOOT}", f"Harbour news\n{A}\nThe vote\n{C}"),
    ("block quote", f"<body>{NAV}<article><p>{A}</p><blockquote>We will not wait for another winter.</blockquote><p>{B}</p></article>{FOOT}", f"{A}\nWe will not wait for another winter.\n{B}"),
    ("self-closing slashes", f"<body>{NAV}<article><p>{A}<br/></p><hr/><p>{B}</p><img src=a/></article>{FOOT}", f"{A}\n{B}"),
    ("unclosed bold", f"<body>{NAV}<article><h1>Harbour news</h1><p><b>{A}<br><p>{B}</p></article>{FOOT}", f"Harbour news\n{A}\n{B}"),
    ("accents", "<body><nav><ul><li><a href=/>Accueil</a></li></ul></nav><article><p>Le port était calme, et personne sur le quai n’a parlé.</p><p>À midi, la mairie s’est réunie deux fois.</p></article>", "Le port était calme, et personne sur le quai n’a parlé.\nÀ midi, la mairie s’est réunie deux fois."),
    ("drawing", f"<body><article><p>{A}</p><svg viewBox='0 0 1 1'><title>boat</title><text>a drawing</text></svg><p>{B}</p></article>", f"{A}\n{B}"),
    ("everything at once", f"<!DOCTYPE html><html><head><title>Harbour</title><meta charset=utf-8></head><body>{COOKIE}<header class=site><h1>Harbour Post</h1></header>{NAV}<article><h1>Harbour news</h1><p>{A}</p><p>{B}</p><p>{C}</p></article>{ASIDE}{COMMENTS}{FOOT}</body></html>", f"Harbour news\n{A}\n{B}\n{C}"),
    ("nothing to read", f"<body>{NAV}{FOOT}</body>", ""),
]


def test_hand_written_pages(spark):
    rows = spark.createDataFrame([(k, name, page) for k, (name, page, _) in enumerate(PAGES)], "page_id long, url string, html string")
    got = {r.url: r for r in main_text(rows).collect()}
    assert {n: got[n].text for n, _, _ in PAGES} == {n: want for n, _, want in PAGES}
    assert all(r.n_chars == len(r.text) for r in got.values())


class Plain(HTMLParser):
    """Text blocks by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out, self.parts, self.silent = [], [], None

    def flush(self):
        text = " ".join("".join(self.parts).split())
        self.out += [text] if text else []
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if self.silent:
            return
        if tag in BLOCKS:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")
        if tag in SILENT and tag not in VOID:
            self.silent = tag

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == self.silent:
            self.silent = None
        elif not self.silent:
            if tag in BLOCKS:
                self.flush()
            elif tag == "br":
                self.parts.append(" ")

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)

    def handle_entityref(self, name):
        from html import unescape

        self.handle_data(unescape(f"&{name};"))

    def handle_charref(self, name):
        from html import unescape

        self.handle_data(unescape(f"&#{name};"))


def by_library(page):
    p = Plain()
    p.feed(page)
    p.close()
    p.flush()
    return p.out


@pytest.mark.parametrize("seed", range(4))
def test_the_parser_agrees_with_the_standard_librarys(seed):
    r = random.Random(seed)
    bits = [
        "<p>", "</p>", "<div class=\"a b\">", "</div>", "<a href=/x/>", "</a>", "<b>", "</b>", "<br>", "<br/>", "<li>", "<h1 id='t>u'>", "</h1>", "<p title=it's>", "<p data-a=\"it's > all\">", "<img src=a/>",
        "words ", "don't ", "&amp; ", "&lt;b&gt; ", "&#233;", "a > b ", "\n", "<!-- <p>x</p> -->", "<script>if (a<b) '</p>'</script>", "<style>p{}</style>", "<span class=x/y>", "</span>", "<td>", "<input disabled value='>'>", "=", "\"", "'",
    ]
    for _ in range(300):
        page = "".join(r.choice(bits) for _ in range(r.randrange(1, 40)))
        assert [b.text for b in blocks(page)] == by_library(page), page


def test_whole_pages_agree_with_the_standard_librarys(spark):
    for row in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect():
        assert [b.text for b in blocks(row.html)] == by_library(row.html)


def test_clashing_names_and_odd_rows(spark):
    name, page, want = PAGES[0]
    rows = [(1, "u", page, "clash", 5, "n"), (1, "u", page, "clash", 5, "n"), (None, None, page, None, None, None), (2, "v", None, "x", 1, "n"), (3, "w", "", "x", 1, "n"), (4, "x", "<p", "x", 1, "n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, path string")
    out = main_text(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(((r.page_id is None, r.page_id or 0, r.url, r.text, r.n_chars) for r in out.collect()), key=str)
    n = len(want)
    assert got == sorted([(False, 1, "u", want, n)] * 2 + [(True, 0, None, want, n)] + [(False, k, u, "", 0) for k, u in ((2, "v"), (3, "w"), (4, "x"))], key=str)
    assert main_text(df.where("page_id = 99")).count() == 0

