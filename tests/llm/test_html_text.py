from breakwater.llm import html_text
from breakwater.llm.html_text import main_text

PARA = "This paragraph has enough text to be taken for the content of a page, as it goes on for a while. "


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_marked_article():
    html = page(
        "<nav><ul><li><a href='/'>Home</a></ul></nav><div class='ad'>Buy!</div><article><h1>A  title</h1>"
        "<p>Fish &amp; chips&nbsp;&eacute;&#8217;s<br>next <b>bo</b>ld</p><div class='ad'>Inside ad</div><p>Hi."
        "<script>var a = '<p>no</p>';</script><!-- <p>no</p> --></p><p></p><form><p>Your mail?</p></form></article>"
        "<section id='comments'><article><p>First!</p></article></section><footer>&copy; us</footer>"
    )
    assert main_text(html) == "A title\n\nFish & chips é’s next bold\n\nHi."


def test_unmarked_page_by_distribution():
    html = page(
        "<div><a href=1>One</a> <a href=2>Two</a></div><ul><li><a href=3>Three</a></li></ul>"
        f"<div class='sidebar'><p>{PARA}</p></div><h2>Head</h2><p>{PARA}</p><p>Short.</p><p>{PARA}</p>"
        "<div role='contentinfo'>About</div><p>ok</p>"
    )
    assert main_text(html) == f"Head\n\n{PARA.strip()}\n\nShort.\n\n{PARA.strip()}"


def test_broken_markup():
    assert main_text("<p>One<p>Two <b>and</i> more") == "One\n\nTwo and more"
    assert main_text("<div class=\"x>Text</div>") != None  # noqa: E711  an open quote ends somewhere
    assert main_text("a < b and c > d") == "a < b and c > d"
    assert main_text("<script>never ends") == ""
    assert main_text(f"<nav>menu<article><p>{PARA}</p></article>") == PARA.strip()
    assert main_text("<p>" * 3000 + "deep") == "deep"


def test_a_marked_teaser_does_not_displace_the_text():
    html = page(f"<div><p>{PARA}</p><p>{PARA * 3}</p></div><article class='card'>Short teaser.</article>")
    assert main_text(html).startswith(f"{PARA.strip()}\n\n{(PARA * 3).strip()}")


def test_the_distribution_decides_inside_articles_too():
    """Without surges and dives, text far from the rest would be kept."""
    gap = "<form>x</form>" * 3
    html = page(f"<p>{PARA}</p><p>{PARA}</p>{gap}<p>so</p>")
    assert main_text(html) == f"{PARA.strip()}\n\n{PARA.strip()}"
    assert main_text(html.replace("<body>", "<body><article>").replace("</body>", "</article></body>")).endswith("so")


def test_a_story_by_its_name():
    inside = f"<article><div id='subscribe-story'><p>{PARA}</p></div><div class='subscribe-box'><p>{PARA}</p></div></article>"
    assert main_text(page(inside)) == PARA.strip()


def test_stray_end_tags_take_linear_time():
    import time

    start = time.perf_counter()
    assert main_text("<div>" * 40_000 + "</b>" * 40_000 + PARA) == PARA.strip()
    assert time.perf_counter() - start < 3


def test_two_articles_and_a_short_one():
    assert main_text(page(f"<article><p>{PARA}</p></article><hr><article><p>x</p></article>")) == f"{PARA.strip()}\n\nx"
    assert main_text(page("<p>Tiny page.</p>")) == "Tiny page."


def test_spans_by_hand():
    assert html_text.spans([0, 50, 0, 60, 0, 0, 0, 5, 0, 0, 0], 3) == [(1, 4)]
    assert html_text.spans([]) == [] and html_text.spans([0, 0, 0]) == []
    assert html_text.spans([1, 1]) == [(0, 2)]


def test_table(spark):
    rows = [(1, "u", page(f"<article><p>{PARA}</p></article>")), (2, None, None), (None, "v", ""), (1, "u", page("<article></article>"))]
    rows.append((5, "w", page("<article>" + f"<p>{PARA}</p>" * 5000 + "</article>")))
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, n_chars string")
    got = sorted((tuple(r) for r in html_text.extract(df).collect()), key=str)
    long = "\n\n".join([PARA.strip()] * 5000)
    want = [(1, "u", PARA.strip()), (2, None, ""), (None, "v", ""), (1, "u", ""), (5, "w", long)]
    assert got == sorted(((*w, len(w[2])) for w in want), key=str)
    assert html_text.extract(df.limit(0)).collect() == []


def test_given_pages(spark):
    import html as h
    import re

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<b>", "").replace("</b>", "")
        blocks = [" ".join(h.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert main_text(r.html) == "\n\n".join(b for b in blocks if b)
        # the distribution alone finds the same
        assert main_text(re.sub(r"</?article>", "", r.html)) == main_text(r.html)
