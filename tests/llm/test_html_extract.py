import html
import random
import re

from catalogspark.llm import html_extract as he


def plain(page: str) -> str:
    """The article of a page of the test tables by plain means."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [re.sub(r"[ \t\n\r\f\v]+", " ", html.unescape(re.sub(r"</?b>", "", b))).strip(" ") for b in re.split(r"</?(?:p|h1|br)>", body)]
    return "\n".join(b for b in blocks if b)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: plain(r.html) for r in pages.collect()}
    got = he.extract_pages(pages).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


W = {"div": 12.0, "p": 0.1, "li": 20.0, "a": 20.0, "ul": 20.0, "b": 0.1, "td": 8.0}


def test_region_without_article():
    text = "one two three four five six seven eight nine ten " * 5
    page = f"<html><body><ul><li><a href=x>Home</a><li><a>About us now</a></ul><div>{text}</div><div id='text'><p>{text}<p>Second &amp; last<br>line &#233;&nbsp;x</p></div><div class='side-bar ads'>{text * 4}</div><ul><li>a b c</ul>"
    got = he.extract(page, W)
    assert "Home" not in got and "a b c" not in got and "Second & last\nline é\xa0x" in got
    assert got.count("ten") == 10


def test_boilerplate_inside_article():
    page = """<nav><p>menu words</p><article class="post"><header><h1>Title</h1></header><p>Body <i>text</i>
      here.<aside>side</aside><form>mail <input></form><div class="advert">buy</div><div role="alert">note</div>
      <section id="comments"><article class="comment">first!</article></section><!-- <p>gone</p> --><script>if (a<b) "</p>"</script>
      <p>End.<footer>foot</footer></article><footer>all rights</footer>"""
    assert he.extract(page, W) == "Title\nBody text here.\nEnd."


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "   "), (4, None, "just words"), (5, "u", "<p>unclosed <b>bold"), (6, "u", "a < b and <3 & &am x"), (7, "u", "<article></article>"), (None, "u", "<p>x</p>"), (1, "u", "<p>x"), (9, "u", "<article><p>" + "w " * 200_000 + "</article>"), (10, "u", "<!-- never closed <p>x</p>"), (11, "u", "<script>var a"), (12, "u", "<p>a</p></div></p><p>b</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' AS text")
    got = [(r.page_id, r.text) for r in he.extract_pages(df, W).collect()]
    want = ["", "", "", "just words", "unclosed bold", "a < b and <3 & &am x", "", "x", "x", ("w " * 200_000).strip(), "", "", "a\nb"]
    assert [t for _, t in got] == want and [k for k, _ in got] == [r[0] for r in rows]
    assert he.extract_pages(df.limit(0)).count() == 0


def test_scan():
    assert he.best_region([-1.0, 2, -1, 3, -5, 4]) == (1, 4)
    assert he.best_region([-1.0]) == (0, 0)
    assert he.best_region([1.0, -1.0, 1.0]) == (0, 1)


def test_layout_classes_around_the_content():
    story = "<h1>Title</h1><p>Body of the story here.</p>"
    for mark in ("class='site has-sidebar'", "class=no-sidebar", "class='page-with-comments'", "class='menu-open'", "id='page-skip'", "class='widget'", "id=overlay class='modal x'"):
        for page in (f"<article>{story}</article>", f"<main>{story}</main>", f"<main><p>a</p><article>{story}</article></main>"):
            got = he.extract(f"<body><div {mark}><div class='cookie-banner'>We use cookies on all of these pages</div>{page}<section class=related><article>One other card</article></section></div></body>", W)
            assert got.endswith("Title\nBody of the story here.") and "cookies" not in got and "card" not in got, (mark, page)
        text = "one two three four five six seven eight nine ten " * 5
        assert he.extract(f"<div {mark}><div class=ads>buy this</div><p>{text}</p></div>", {}) == text.strip()
    comments = "<section id=comments><article id=comment-1>first comment, and a long one</article><article class=c2>second</article></section>"
    assert he.extract(f"<article>{story}{comments}</article>", W) == he.extract(f"<article>{story}</article>{comments}", W) == "Title\nBody of the story here."


def test_scan_against_all_regions():
    rnd = random.Random(3)
    for _ in range(300):
        s = [rnd.choice([-3.0, -1.0, -0.5, 0.0, 1.0, 2.0]) for _ in range(rnd.randrange(0, 14))]
        best = max((sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=0.0)
        b, e = he.best_region(s)
        assert sum(s[b:e]) == max(best, 0.0)
        if best > 0:  # the first of the best ones
            assert min((j, i) for i in range(len(s)) for j in range(i + 1, len(s) + 1) if sum(s[i:j]) == best)[0] == e


def test_the_scan_decides(spark, monkeypatch):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").limit(40).collect()]
    text = "one two three four five six seven eight nine ten " * 5
    bare = f"<body><div><a>Home</a><a>News</a><a>Shop</a></div><div><div>{text}</div><div>{text}</div></div><div><a>Terms</a><a>Privacy</a><a>Contact</a></div>"
    weights = {"a": 2.0, "div": 1.0}
    mine = [he.extract(p, weights) for p in (*pages, bare)]
    assert mine[-1] == f"{text.strip()}\n{text.strip()}"
    monkeypatch.setattr(he, "best_region", lambda s: (0, len(s)))
    assert all(he.extract(p, weights) != t for p, t in zip((*pages, bare), mine, strict=True))


def test_weights_come_from_labelled_pages(spark):
    rows = [(i, "u", f"<div><span>menu</span></div><main><p>text {i} of the page</p><p>more</p></main><footer><span>end</span></footer>") for i in range(20)] + [(99, "u", "<div>no mark</div>"), (100, None, None)]
    w = he.fit_weights(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert w["span"] > w["p"] == 0.1 and w["div"] > 0.1 and "main" not in w
    assert he.fit_weights(spark.createDataFrame(rows[-1:], "page_id long, url string, html string")) == {}


def test_related_work_and_teasers():
    page = "<main><h1>Paper</h1><section class='related-work'><p>Others did this before.</p></section><p>We do that.</p></main>"
    assert he.extract(page, W) == "Paper\nOthers did this before.\nWe do that."
    long = "a real text that runs on and on over many words of its own " * 6
    page = f"<div class=content><p>{long}</p><p>{long}</p></div><article class=card>tiny</article><article class=card>small card</article>"
    assert he.extract(page, {}).count("over many words") == 12


LANGUAGES = {
    "en": ("The title of it", "An article goes on for a good many words, and then it ends here.", "Its second paragraph is as long as the first one was, or nearly."),
    "zh": ("标题在这里", "这是一篇很长的文章的第一段，没有任何空格，但是有很多字，而且还在继续写下去。", "第二段也一样长，一样没有空格，读者还是应该能读到它的全部内容，直到最后一个字。"),
    "ja": ("題名はここです", "これは長い記事の最初の段落で、空白はひとつもありませんが、文字はたくさんあります。", "二番目の段落も同じくらい長く、最後の一文字まで読めるはずです。終わりまで残ります。"),
    "th": ("หัวเรื่องอยู่ที่นี่", "นี่คือย่อหน้าแรกของบทความที่ยาวมากซึ่งไม่มีช่องว่างเลยแต่มีตัวอักษรมากมายและยังเขียนต่อไป", "ย่อหน้าที่สองก็ยาวพอๆกันและไม่มีช่องว่างเช่นกันผู้อ่านควรได้อ่านทั้งหมดจนจบ"),
}


def learned(pages):
    total = he.Counter()
    for page in pages:
        total.update(he.count_page(page) or {})
    return he.weights_of(total)


def test_scripts_without_blanks_with_and_without_a_mark(spark):
    given = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    menus = ("<nav><ul>{}</ul></nav>", "<ul>{}</ul>", "<div class=menu>{}</div>", "<div>{}</div>")
    links = "".join(f"<li><a href=/{x}>{x}</a>" for x in ("Home", "About us", "News and more", "Shop", "Contact"))
    for weights in ({}, learned(given)):
        for title, first, second in LANGUAGES.values():
            body = f"<h1>{title}</h1><p>{first}</p><p>{second}</p>"
            for menu in menus:
                for mark in ("article", "main", "div", "section"):
                    page = f"<html><body>{menu.format(links)}<{mark}>{body}</{mark}><footer>Seven English words stand in this footer</footer></body></html>"
                    assert he.extract(page, weights) == f"{title}\n{first}\n{second}", (mark, menu)


def test_short_article_beside_a_long_block_and_lists():
    short, long = "a short article " * 9, "a long block of something else that nobody asked for " * 15
    for page in (f"<article><p>{short}</p></article><div>{long}</div>", f"<div>{long}</div><article><p>{short}</p></article>"):
        assert he.extract(page, {}) == short.strip()
    items = [f"item number {i}" for i in range(30)]
    page = f"<body><h2>A list</h2><ul>{''.join(f'<li>{x}</li>' for x in items)}</ul></body>"
    assert he.extract(page, {}) == "\n".join(["A list", *items])
    assert he.extract("<article><h1>T</h1><ul><li>a<li>b</ul><div class=ad>" + "buy " * 200 + "</div><p>end</p></article>", {"li": 50.0, "div": 50.0}) == "T\na\nb\nend"


def test_class_names_around_all_of_a_page():
    text = "words that go on and on for a while " * 4
    page = f"<div class=widget><div class=modal><p>{text}</p><div class=ads>buy this now</div><p>{text}</p></div></div><p>2020</p>"
    assert he.extract(page, {}) == f"{text.strip()}\n{text.strip()}"
    assert he.extract("<div class=ads>buy</div><p>x</p>", {}) == "x"  # nothing longer anywhere: as few names as give any text


def test_learned_worth_and_weights_decide(spark):
    junk = "junk that no list of names knows, and quite a lot of it at that"
    label = [f"<body><section><i>{junk} {i}</i></section><section><i>{junk}</i></section><article><h1>t {i}</h1><p>text of the page, long enough {i}</p></article></body>" for i in range(30)]
    weights = learned(label)
    assert weights[he.TEXT_IN + "i"] < 0 < weights[he.TEXT_IN + "p"] and weights["section"] > weights["p"]
    page = f"<body><section><i>{junk}</i></section><div><h1>Title</h1><p>The text of it.</p></div><section><i>{junk}</i></section></body>"
    assert he.extract(page, weights) == "Title\nThe text of it." and junk in he.extract(page, {})
    # the pages of the tables without any telling name: what is learned finds the content, wherever it stands
    bare = lambda x: re.sub(r"<(/?)(nav|footer)", r"<\1section", x).replace(' class="ad"', "")
    given = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    weights = learned(bare(x) for x in given)
    for page in given:
        hidden = bare(page).replace("<article>", "<td>").replace("</article>", "</td>")
        assert he.extract(hidden, weights) == plain(page) != he.extract(hidden, {})


def test_the_scan_and_not_the_first_and_last_words_decide(monkeypatch):
    text = "one two three four five six seven eight nine ten " * 5
    page = f"<body><div>Some words</div><hr><table><tr><td>of</td><td>a</td><td>header</td></tr></table><div><p>{text}</p><p>{text}</p></div><table><tr><td>and</td><td>so</td><td>on</td></tr></table><div>The end</div></body>"
    weights = {"td": 8.0, "tr": 8.0, "table": 8.0}
    row = he.tokens(page)
    scores = he.token_scores(row, weights, -1, 0)
    begin, end = he.best_region(scores)
    sums = {(i, j): sum(scores[i:j]) for i in range(len(row)) for j in range(i + 1, len(row) + 1)}
    assert sums[begin, end] == max(sums.values())  # all regions of the page
    mine = he.extract(page, weights)
    assert mine == f"{text.strip()}\n{text.strip()}"
    monkeypatch.setattr(he, "best_region", lambda s: (min(i for i, x in enumerate(s) if x > 0), max(i for i, x in enumerate(s) if x > 0) + 1))
    assert he.extract(page, weights) != mine


def test_given_pages_against_all_regions(spark):
    """The result of the query's operator on whole pages: no region of a page scores more than the one that is taken."""
    given = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").limit(25).collect()]
    weights = learned(given)
    for page in (*given, *(x.replace("<article>", "<div>").replace("</article>", "</div>") for x in given)):
        row = he.tokens(page)
        begin, end, _, scores = he.region(row, weights)
        total = [0.0]
        for s in scores:
            total.append(total[-1] + s)
        best = max(total[j] - total[i] for i in range(len(total)) for j in range(i, len(total)))
        assert abs(total[end] - total[begin] - best) < 1e-6


def test_links_in_a_paragraph_stay():
    weights = {he.TEXT_IN + "a": -0.9, "a": 5.0}
    text = "words of a paragraph that is long enough for links in it " * 2
    assert he.extract(f"<p>{text}<a href=x>a link</a> {text}</p><p><a>only links here</a></p><p>{text}</p>", weights) == f"{text}a link {text.strip()}\n{text.strip()}"
