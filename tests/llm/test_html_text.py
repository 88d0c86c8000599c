import random

import pytest

from tidemark.llm import html_text as H


def page(body, extra=""):
    return (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';if(a<b){}</script></head><body>"
        "<nav><ul><li><a href='/'>Home</a></li><li><a>News</a></li></ul></nav><!-- <p>no</p> --><div class=\"ad\">Buy now</div>"
        f"<article><h1>Head &amp; line</h1>{body}</article>{extra}<footer>&copy; us</footer></body></html>"
    )


@pytest.fixture(scope="module")
def weights(spark):
    rng = random.Random(2)
    rows = [(i, page("".join(f"<p>{'word ' * rng.randint(5, 60)}</p>" for _ in range(rng.randint(1, 6))))) for i in range(60)]
    return H.learn(spark.createDataFrame(rows, "page_id long, html string"))


def test_article(weights):
    got = H.extract(page("<p>One <b>two</b>\n three.<br>four<p>five &lt;six&gt; &eacute;</p><ul><li>a</li><li>b c</li></ul>"), weights)
    assert got == "Head & line\n\nOne two three.\n\nfour\n\nfive <six> é\n\na\n\nb c"


def test_what_is_not_the_article_goes(weights):
    noise = (
        "<aside>side words here</aside><form><input><label>your mail</label></form><div class='cookie-notice'>we use cookies</div>"
        "<section id=comments><p>first comment of a reader</p></section><div role=navigation>next page</div><noscript>js</noscript>"
    )
    body = "<p>" + "good text " * 30 + "</p>"
    want = "Head & line\n\n" + ("good text " * 30).strip()
    assert H.extract(page(body + noise, noise), weights) == want


def test_pages_without_marks(weights):
    text = " ".join(f"w{i}" for i in range(120))
    plain = f"<html><body><div><a>Home</a> <a>About</a> <a>More</a></div><div id=x><p>{text}</p><p>{text}</p></div><div><a>Imprint</a><a>Mail</a></div></body></html>"
    assert H.extract(plain, weights) == f"{text}\n\n{text}"


@pytest.mark.parametrize("html", [None, "", "   ", "<", "<p", "<!--", "<script>x", "<p></p>", "</p></div>", "<a href='", "&", "<nav>menu</nav>"])
def test_broken_pages(weights, html):
    assert isinstance(H.extract(html, weights), str)


def test_empty_results(weights):
    for html in (None, "", "<nav>menu</nav>", "<script>x</script>"):
        assert H.extract(html, weights) == ""


def test_region_has_the_highest_sum(weights):
    rng = random.Random(8)
    names = ["p", "div", "a", "li", "b"]
    for _ in range(150):
        html = "".join(rng.choice([f"<{rng.choice(names)}>", f"</{rng.choice(names)}>", "some words here ", "x "]) for _ in range(rng.randint(0, 25)))
        scored = H._scored(html)
        value = [weights.get(f, weights["word" if k == "text" else "tag"]) * n for k, _, _, f, n in scored]
        a, b = H.region(scored, weights)
        best = max([0.0, *(sum(value[i:j]) for i in range(len(value)) for j in range(i + 1, len(value) + 1))])
        assert abs(sum(value[a:b]) - best) < 1e-9


def test_table(spark, weights):
    rows = [(1, "u", page("<p>text</p>")), (1, "u", page("<p>text</p>")), (None, None, None), (2, None, ""), (3, "v", page("<p>" + "long " * 100_000 + "</p>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = sorted(H.main_text(df, weights).collect(), key=lambda r: (r.page_id is not None, r.page_id or 0))
    assert [(r.page_id, r.url) for r in got] == [(None, None), (1, "u"), (1, "u"), (2, None), (3, "v")]
    assert [r.text for r in got[:4]] == ["", "Head & line\n\ntext", "Head & line\n\ntext", ""]
    assert all(r.n_chars == len(r.text) for r in got) and got[4].n_chars > 400_000


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    weights = H.learn(none)
    assert weights == H.PRIOR
    assert H.main_text(none, weights).count() == 0


def test_bounded_sample_of_pages(spark):
    rows = [(i, page(f"<p>{'word ' * 40} {i}</p>")) for i in range(200)]
    few = H.learn(spark.createDataFrame(rows, "page_id long, html string"), most=50)
    assert few["word in p"] > 0 > few["tag nav"]


def test_region_is_not_shrunk_to_one_article(weights):
    one, two = "first " * 80, "second " * 50
    html = f"<html><body><nav>menu</nav><article><h2>A</h2><p>{one}</p></article><article><h2>B</h2><p>{two}</p></article></body></html>"
    assert H.extract(html, weights) == f"A\n\n{one.strip()}\n\nB\n\n{two.strip()}"


def test_teaser_does_not_replace_the_region(weights):
    text = "long " * 200
    html = f"<html><body><div><p>{text}</p><article><p>see this too</p></article><p>{text}</p></div></body></html>"
    assert H.extract(html, weights) == f"{text.strip()}\n\nsee this too\n\n{text.strip()}"


def test_article_around_what_is_cut(weights):
    text = "good " * 60
    html = f"<html><body><article><h1>T</h1><aside>{'side ' * 90}</aside><p>{text}</p></article><p>{'more ' * 9}</p></body></html>"
    assert H.extract(html, weights) == f"T\n\n{text.strip()}"


@pytest.mark.parametrize("wrapper", ['class="content has-sidebar"', 'class="site header-fixed"', "id=with-comments"])
@pytest.mark.parametrize("element", ["article", "main", "div"])
def test_marked_wrapper_is_not_cut(weights, wrapper, element):
    text = "good " * 60
    html = f"<html><body><div {wrapper}><nav>menu</nav><{element}><p>{text}</p></{element}></div></body></html>"
    assert H.extract(html, weights) == text.strip()


def test_sections_of_an_article_stay(weights):
    parts = [("section", "related-work"), ("section", "social-impact"), ("h2", "related-work"), ("h3", "comments")]
    body = f"<p>{'start ' * 40}</p>" + "".join(f"<{e} id='{i}'>kept {n} {'more ' * 5}</{e}>" for n, (e, i) in enumerate(parts)) + f"<p>{'end ' * 40}</p>"
    got = H.extract(page(body), weights)
    assert [f"kept {n}" in got for n in range(len(parts))] == [True] * len(parts)


def test_marked_elements_beside_and_inside(weights):
    text = "good " * 60
    teasers = "<div class='related posts'><article><p>one other</p></article><article><p>two other</p></article></div>"
    thread = f"<div class=comments><p>{'reply ' * 300}</p></div>"
    assert H.extract(page(f"<p>{text}</p><div class=ad>buy</div><p>{text}</p>", teasers + thread), weights) == f"Head & line\n\n{text.strip()}\n\n{text.strip()}"


@pytest.mark.parametrize(
    "part",
    ['<a "', "<div>", "</b>", '<div class="ad">', "<article></main>", "<b><p></i>", "<p><div><b>", "<a href='", '<a x="', "<!--", "<", "&#9", "<script>", "</div>", "<x y=", "<h1></p>", "<form>"],
)
def test_hostile_pages_take_linear_time(weights, part):
    import time

    began = time.perf_counter()
    H.extract(part * (400_000 // len(part)), weights)
    H.extract("<p><div>" + "<b>" * 40_000 + "<p>x</p>" * 20_000, weights)
    assert time.perf_counter() - began < 15


def test_content_in_a_form_or_under_a_header(weights):
    text = "good " * 60
    for html in (
        f"<html><body><form action=x><input name=v><h1>T</h1><p>{text}</p><button>go</button></form></body></html>",
        f"<html><body><nav>menu</nav><article><header><h1>T</h1></header><p>{text}</p></article><footer>us</footer></body></html>",
        f"<html><body><article><div class='post-header'><h1>T</h1></div><p>{text}</p></article></body></html>",
        f"<html><body><header><h2>Site</h2><nav>menu</nav></header><article><h1>T</h1><p>{text}</p></article></body></html>",
        f"<html><body><form><header>Site</header><main><h1>T</h1><p>{text}</p></main></form></body></html>",
    ):
        assert H.extract(html, weights) == f"T\n\n{text.strip()}", html
    got = H.extract(page(f"<p>{text}</p><p class=related>it is related</p><form><label>mail</label> join our letter</form><p>{text}</p>"), weights)
    assert got == f"Head & line\n\n{text.strip()}\n\nit is related\n\n{text.strip()}"


def test_quotes_count_after_an_equals_sign(weights):
    text = "good " * 30
    assert H.extract(page(f"<p a\">{text}<a href=\"x>y\" title='>'>link</a></p>"), weights) == f"Head & line\n\n{text}link"
    assert H.extract(f"<article><p>{text}</p><p title=\"open>{text}</p></article>", weights) == f"{text.strip()}\n\n{text.strip()}"
    assert H.extract("<article><p>a &#" + "9" * 9000 + "; b &#x" + "f" * 50 + "; c</p></article>", weights) == "a \ufffd b \ufffd c"


def brute_text(html, weights):
    """The whole extraction with the region by trying all."""
    scored = H._scored(html)
    value = [weights.get(f, weights["word" if k == "text" else "tag"]) * n for k, _, _, f, n in scored]
    sums = [0.0]
    for v in value:
        sums.append(sums[-1] + v)
    best = max([0.0, *(sums[j] - sums[i] for i in range(len(value)) for j in range(i + 1, len(value) + 1))])
    found = [(i, j) for i in range(len(value)) for j in range(i + 1, len(value) + 1) if best > 0 and abs(sums[j] - sums[i] - best) < 1e-9]
    out = set()
    for i, j in found or [(0, 0)]:
        blocks, run = [], ""
        for kind, v, cut, _, _ in [*scored[i:j], ("open", "p", False, "", 1)]:
            if kind == "text" and not cut:
                run += v
            elif kind != "text" and v in H.BLOCK:
                blocks.append(" ".join(run.split()))
                run = ""
        out.add("\n\n".join(b for b in blocks if b))
    return out


def test_whole_extraction_against_brute_force(spark, weights):
    rng = random.Random(12)
    names = ["p", "div", "a", "li", "b", "article", "section", "form", "aside", "div class=ad"]
    rows = []
    for i in range(200):
        parts = []
        for _ in range(rng.randint(0, 30)):
            n = rng.choice(names)
            parts.append(rng.choice([f"<{n}>", f"</{n.split()[0]}>", "some words here ", f"x{i} ", "a few more words of content "]))
        rows.append((i, "u", "".join(parts)))
    got = H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), weights).collect()
    for r in got:
        assert r.text in brute_text(rows[r.page_id][2], weights) and r.n_chars == len(r.text)


def test_long_threads_of_comments_go(weights):
    text, talk = "good " * 60, "<div><p>" + "reply here " * 40 + "</p></div>"
    want = f"Head & line\n\n{text.strip()}"
    for thread in (
        f"<div class='comments'>{talk * 20}</div>", f"<section id=comments>{talk * 20}</section>",
        "<ol class=comment-list>" + f"<li><article class='comment-body'>{talk}</article></li>" * 20 + "</ol>",
        "".join(f"<article class='comment'>{talk}</article>" for _ in range(20)),
    ):
        assert H.extract(page(f"<p>{text}</p>{thread}"), weights) == want, thread[:40]
        assert H.extract(page(f"<p>{text}</p>", thread), weights) == want, thread[:40]
    # a page that is made of it keeps it
    assert "reply here" in H.extract(f"<html><body><div id=comments>{talk * 5}</div></body></html>", weights)
