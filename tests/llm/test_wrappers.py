from tierbook.llm import wrappers
from tierbook.llm.pages import parsed

SHELL = (
    '<!DOCTYPE html><html><head><title>{t}</title><style>p>b{{}}</style><script>var a="</p><article>";</script></head><body class="ad-free">'
    '<header><h1>Site</h1></header><nav><ul><li><a href=/>Home {k}</a><li><a href=/x>News</a></ul></nav><!-- <p>no</p> -->'
    '<div class="cookie-notice">We use cookies {k}</div><div class="ad">Buy {k} now</div>{body}'
    '<aside id=sidebar>Also {k}</aside><form><p>Mail?</p><input></form><section class="comments"><article class="comment"><p>First! {k}</p></article></section>'
    "<footer>&copy; Site {k}</footer></body></html>"
)


def page(k, body):
    return SHELL.format(t=f"Title {k}", k=k, body=body)


def run(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int").repartition(3)
    return [(r["page_id"], r["url"], r["text"]) for r in wrappers.extracted(frame).collect()]


def test_article_without_the_rest(spark):
    article = "<article><h1>Head {k}</h1><p>Fish &amp; chips,<br>tea&nbsp;&#233; {k}\n\n  now <b>bold</b></p><div class=share>Share!</div><p>Last <script>x()</script>{k}</article>"
    rows = [(k, f"http://h.example/{k}", page(k, article.format(k=k))) for k in range(6)]
    got = {k: t for k, _, t in run(spark, rows)}
    assert got == {k: f"Head {k}\n\nFish & chips, tea é {k} now bold\n\nLast {k}" for k in range(6)}


def test_constant_text_is_template_and_copies_prove_nothing(spark):
    body = "<main><p>Story number {k} tells of {k} things.</p><p><i>Written for this site.</i></p><div>Story {k} ends.</div></main>"
    rows = [(k, "https://u:p@H.example:8080/a", page(k, body.format(k=k * 7919))) for k in range(8)]
    got = {k: t for k, _, t in run(spark, rows)}
    assert all(t == f"Story number {k * 7919} tells of {k * 7919} things.\n\nStory {k * 7919} ends." for k, t in got.items())
    copies = [(k, "http://copies.example/", rows[0][2]) for k in range(50)]
    assert {t for _, _, t in run(spark, copies)} == {"Story number 0 tells of 0 things.\n\nWritten for this site.\n\nStory 0 ends."}


def test_defined_for_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "no url", "plain <b>text"), (4, "http://h/", "<p>open <p>second <b>bold<p>third"), (None, "http://h/", "<div>no id</div>"),
            (5, "http://h/", "<p>open <p>second <b>bold<p>third"), (6, "http://h/", "<" * 3000), (7, "http://h/", "<div>" * 5000 + "deep"),
            (8, "http://h/", "<p>a < b and c > d &lt;p&gt; &bogus; &#x41;</p>"), (9, "http://h/", "<article><p>" + "word " * 60_000 + "</article>"),
            (10, "http://h/", "<a title='x>y'>link</a><p>text with <a href=\"b>c\">link</a>"), (11, "http://h/", "<!-- open"), (12, "http://h/", "<script>never closed")]
    got = {k: t for k, _, t in run(spark, [*rows, rows[3]])}
    assert len(run(spark, [*rows, rows[3]])) == len(rows) + 1
    assert (got[1], got[2], got[3], got[None]) == ("", "", "plain text", "no id")
    assert got[4] == got[5] == "open\n\nsecond bold\n\nthird"
    assert got[7] == "deep" and got[8] == "a < b and c > d <p> &bogus; A" and got[9] == ("word " * 60_000).strip()
    assert got[11] == "" and got[12] == ""
    assert run(spark, []) == []


def test_tree_matching_counts_the_largest_alignment():
    a, b = (wrappers.shape_of(h)[1] for h in ("<div><h1>t</h1><p>x</p><ul><li>1</ul></div>", "<div><p>y</p><em>z</em><ul><li>2<li>3</ul></div>"))
    size, pairs = wrappers.matched(a, b)
    assert size == 5 and {x.label for x, _ in pairs} == {"#page", "div", "p", "ul", "li"}
    assert all(x.label == y.label for x, y in pairs)
    assert [n.tag for n in parsed("<ul><li>a<li>b</ul>").children[0].children] == ["li", "li"]


def test_an_article_in_sections_is_taken_whole():
    part = lambda k: f"<div class=part><h2>Part {k}</h2><p>{'text ' * 30}{k}</p></div>"
    links = "<div class=x>" + "<a href=/>some link</a> " * 30 + "</div>"
    html = f"<body><div>{links}</div><div class=page><div class=story>{part(1)}{part(2)}{part(3)}</div></div><div class=y>short end</div></body>"
    root, shape = wrappers.shape_of(html)
    text = wrappers.main_text(root, shape, None, set())
    assert text == "\n\n".join(f"Part {k}\n\n{('text ' * 30)}{k}" for k in (1, 2, 3))


def plain(html):
    root, shape = wrappers.shape_of(html)
    return wrappers.main_text(root, shape, None, set())


def test_marks_are_whole_names_and_never_hold_the_article():
    for name in ("content-sidebar-wrap", "has-sidebar", "with-comments", "no-ads", "widget", "sidebar-wrap"):
        assert plain(f"<body><div class='{name}'><article><p>Story</p></article></div></body>") == "Story"
        assert plain(f"<body><div class='{name}'><p>{'story ' * 50}</p></div><div class=ad>Buy</div></body>") == ("story " * 50).strip()
    body = "<h2 id=discussion>Discussion</h2><section id=related><p>Work</p></section><p id=text-search>Search</p><p class=share-price>9</p>"
    assert plain(f"<article>{body}<div class='share-buttons'>Tweet</div><div id=comments>First</div></article>") == "Discussion\n\nWork\n\nSearch\n\n9"
    assert plain("<form id=aspnetform><main><p>Story</p></main></form>") == "Story"
    teasers = "<div class=related>" + "<article>Teaser</article>" * 3 + "</div>"
    assert plain(f"<body><div><p>The story</p></div>{teasers}</body>") == "The story"


def test_template_that_outweighs_the_article(spark):
    frame = "<body><div class=x>" + "".join(f"<p class=c{k}>{'house rule ' * 20}{k}</p>" for k in range(5)) + "</div><div class=y><p>Story {k} is short.</p></div></body>"
    rows = [(k, "http://short.example/", frame.format(k=k)) for k in range(9)]
    assert {k: t for k, _, t in run(spark, rows + rows[:1] * 30)} == {k: f"Story {k} is short." for k in range(9)}


def test_sections_of_uneven_size_and_a_separate_title():
    links = "<div class=x>" + "<a href=/>some link</a> " * 30 + "</div>"
    story = f"<div class=body><p>{'long ' * 800}</p></div><div class=end><p>{'close ' * 150}</p></div>"
    want = ["A title", "long " * 799 + "long", "close " * 149 + "close"]
    assert plain(f"<body><div>{links}</div><div class=page><div class=title>A title</div>{story}</div></body>") == "\n\n".join(want)
    assert plain(f"<body><h1><a href=/>A title</a></h1>{links}<div class=page>{story}</div></body>") == "\n\n".join(want)


def test_end_tags_and_marks_at_any_depth():
    deep = lambda n, inner="": "<div>" * n + inner + "</div>" * n
    assert plain(f"<body><div><article>{deep(160)}<p>rest</p></article></div></body>") == "rest"
    assert plain(f"<body><article><p>text</p>{deep(5000, '<div class=ad>Buy</div><p>low</p>')}<p>rest</p></article></body>") == "text\n\nlow\n\nrest"
    page = wrappers.shape_of(deep(3000, "<p>low</p>"))[1]
    assert wrappers.matched(page, page)[0] == 3002


def test_reading_is_linear_and_loses_no_text():
    import time

    from tierbook.llm.pages import parsed

    def text(node):
        return "".join(c if isinstance(c, str) else text(c) for c in node.children)

    shapes = ["<a " * 350_000, "<a \"'>" * 150_000, "<title>" * 150_000, "<svg>" * 200_000, "<!" * 500_000, "<" * 1_000_000, "<a href='" * 120_000 + ">", "<!--" * 250_000,
              "<p><b" * 200_000 + ">"]
    for html in shapes:
        began = time.process_time()
        parsed(html)
        assert time.process_time() - began < 6, html[:20]
    assert text(parsed("a < b <a href='x>y'>c</a> <!-- d > --> e <? f > g <1 h <b")) == "a < b c  e  g <1 h <b"
    assert text(parsed("<p>Let <math><mi>x</mi> = <mn>2</mn></math> hold<script>no</script>.")) == "Let x = 2 hold."


def test_alignment_is_the_heaviest_of_all():
    import random

    from tierbook.llm.pages import Node
    from tierbook.llm.wrappers import Shape, matched

    def bare(label):
        return Shape(label, [Node("b", {})])

    def tree(rng, depth):
        node = bare("x")
        labels = rng.sample("abcdefgh", rng.randrange(0, 6)) if depth else []
        for label in labels:
            child = tree(rng, depth - 1)
            child.label = label
            node.children.append(child)
        return node

    def plain(a, b):
        best = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
        for i, x in enumerate(a.children, 1):
            for j, y in enumerate(b.children, 1):
                both = best[i - 1][j - 1] + (plain(x, y) if x.label == y.label else -1)
                best[i][j] = max(best[i - 1][j], best[i][j - 1], both)
        return 1 + best[-1][-1]

    rng = random.Random(5)
    for _ in range(300):
        a, b = tree(rng, 3), tree(rng, 3)
        size, pairs = matched(a, b)
        assert size == plain(a, b) == len(pairs) and pairs[0] == (a, b)
        assert all(x.label == y.label for x, y in pairs)
    wide = [bare("x") for _ in range(2)]
    for node in wide:
        node.children = [bare(f"n{k}") for k in rng.sample(range(20_000), 20_000)]
    assert matched(*wide)[0] > 200


def test_cards_beside_the_article_are_left_out():
    from tierbook.llm.pages import parsed
    from tierbook.llm.wrappers import main_regions

    page = parsed("<main><article><h1>T</h1><p>" + "long text " * 40 + "</p></article><section class='more-stories'><article class='card'><h3>Other</h3><p>short</p></article></section></main>")
    assert len(main_regions(page)) == 1
    halves = parsed("<article><p>" + "one half " * 30 + "</p></article><article><p>" + "other half " * 30 + "</p></article>")
    assert len(main_regions(halves)) == 2
