"""Trie token counts against a plain forward pass, and page text against known articles."""

import math

import public_tokenizers
import pytest

from folioweave.llm import html_extract, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def plain_forward(model, word):
    text = token_counts.WORD_START + word
    best = [(0.0, 0)]
    longest = max(map(len, model.log_probs))
    for end in range(1, len(text) + 1):
        size = len(text[end - 1].encode())
        options = [(best[end - 1][0] + size * model.byte, -best[end - 1][1] - size)]
        for start in range(max(0, end - longest), end):
            value = model.log_probs.get(text[start:end])
            if value is not None:
                options.append((best[start][0] + value, -best[start][1] - 1))
        score, n = max(options)
        best.append((score, -n))
    return best[-1]


def test_counts_match_a_forward_pass_per_text(spark):
    model = token_counts.Unigram(token_counts.load_pieces(PIECES))
    assert math.isclose(sum(map(math.exp, model.log_probs.values())), 1.0)
    texts = ["the theatre there then", "The\x0bTHE  the", None, "", "日本語 🙂 é\x00", "x" * 700, "the theatre there then", "zz" * 40 + " a"]
    docs = spark.createDataFrame([(i % 7, t, 5) for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens int")
    got = sorted((r.n_words, r.n_tokens, round(r.log_prob, 6)) for r in token_counts.count_tokens(docs, PIECES).collect())
    want = []
    for t in texts:
        words = [w.decode() for w in token_counts.pre_tokens(t)]
        each = [plain_forward(model, w) for w in words]
        want.append((len(words), sum(n for _, n in each), round(sum(s for s, _ in each), 6)))
    assert [w[:2] for w in got] == [w[:2] for w in sorted(want)]
    assert [w[2] for w in got] == pytest.approx([w[2] for w in sorted(want)])
    assert token_counts.count_tokens(docs.limit(0), PIECES).count() == 0


ARTICLE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{a}</style><script>var t="</p>";</script></head><body class="nav">
<nav><ul><li><a href="/a>b">menu</a></li></ul></nav><div class="ad big">buy <div>now</div></div><article id="main"><h1>Head&amp;line</h1>
<p><b>One <i>t</i>wo<br><p>three&nbsp;&#233; a < b</p><div class="comments"><p>I disagree</p></div><aside>side</aside>
<form><input value="x">send</form><ul><li>four<li>five</ul><!-- <p>no</p> --></article><footer>&copy; f</footer>"""


def rows(spark):
    common = "<div>all rights reserved by the large company of this host since long ago</div>"
    plain = lambda i: f"<body>{common}<p>{i} page own words</p><p>more of {i}</p>{common}</body>"
    shared = "<article><p>" + "the same long passage stands in two articles of one host " * 3 + "</p></article>"
    data = [
        (1, "http://h/1", ARTICLE), (2, "http://H/2", plain(2)), (3, "http://h:/x", plain(3)), (4, "http://h/4", plain(4)), (5, "http://h/5", shared),
        (6, "http://h/6", shared), (7, None, None), (8, "u", ""), (8, "u", "<p>twice"), (9, "http://other/9", plain(9)), (None, "http://h/7", "a &lt;b&gt; <b>c</b>d"),
    ]
    return spark.createDataFrame([(*d, "x") for d in data], "page_id bigint, url string, html string, text string").repartition(2)


def test_pages(spark):
    got = {(r.page_id, r.url): r for r in html_extract.extract_text(rows(spark)).collect() if r.page_id != 8}
    texts = {k[0]: r.text for k, r in got.items()}
    assert texts[1] == "Head&line One two three é a < b four five"
    assert texts[2] == "2 page own words more of 2"
    assert texts[4] == "4 page own words more of 4"
    assert texts[9].startswith("all rights") and texts[9].endswith("long ago")  # no other page of that host
    assert texts[5] == texts[6] and texts[5].count("passage") == 3  # articles stay whole
    assert texts[7] == "" and texts[None] == "a <b> cd"
    assert all(r.n_chars == len(r.text) for r in got.values())
    both = sorted(r.text for r in html_extract.extract_text(rows(spark)).collect() if r.page_id == 8)
    assert both == ["", "twice"]
    assert html_extract.extract_text(rows(spark).limit(0)).count() == 0


def plain_cover(streams, long):
    """Tokens of streams inside any string of ``long`` or more tokens that another page repeats."""
    out = []
    for p, mine in enumerate(streams):
        gone = set()
        for i in range(len(mine) - long + 1):
            if any(mine[i : i + long] == o[j : j + long] for q, o in enumerate(streams) if q != p for j in range(len(o) - long + 1)):
                gone |= set(range(i, i + long))
        out.append([w for i, w in enumerate(mine) if i not in gone])
    return out


def test_covered_runs_match_brute_force(spark):
    import random

    rnd = random.Random(4)
    streams = [[rnd.choice("abc") for _ in range(rnd.randint(0, 40))] for _ in range(12)]
    pages = spark.createDataFrame([(i, "http://h/", " ".join(s)) for i, s in enumerate(streams)], "page_id int, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract_text(pages, long=5).collect()}
    assert [got[i] for i in range(12)] == [" ".join(s) for s in plain_cover(streams, 5)]


def test_copies_of_an_unmarked_page_and_pages_without_a_host_stay(spark):
    body = "<p>a page of twelve words that stands twice on its one host</p>"
    menu = "<div>one menu of eight words for all pages here</div>"
    data = [(1, "http://h/1", body), (1, "http://h/1", body), (2, "http://h/2", body), (3, None, body), (4, None, body + "more"), (5, "/x", body + "yet"),
            (6, "http://g/6", menu + body), (7, "http://g/7", menu + body), (8, "http://g/8", menu + "<p>other</p>")]
    pages = spark.createDataFrame(data, "page_id bigint, url string, html string").repartition(3)
    text = "a page of twelve words that stands twice on its one host"
    got = sorted((r.page_id, r.text) for r in html_extract.extract_text(pages).collect())
    assert got == [(1, text), (1, text), (2, text), (3, text), (4, text + " more"), (5, text + " yet"), (6, text), (7, text), (8, "other")]


def test_repeats_decide_beside_an_article_too(spark):
    words = lambda name, n: " ".join(f"{name}{j}" for j in range(n))
    card = f"<article class='card'><p>{words('card', 9)}</p></article>"
    notice = f"<div>{words('notice', 20)}</div>"
    note = lambda i: f"<article><h2>short</h2><p>own note {i}</p></article>"
    data = [(i, f"http://h/{i}", f"<body><nav>{words('menu', 9)}</nav>{card}<div><p>{words(f'lead{i}x', 30)}</p></div>") for i in (1, 2, 3)]
    data += [(i, f"http://n/{i}", notice + note(i) + f"<footer>{i}</footer>") for i in (4, 5)]
    data += [(6, "http://alone/", notice + note(6)), (7, "http://few/", note(7) + f"<p>{words('beside', 7)}</p>")]
    pages = spark.createDataFrame(data, "page_id bigint, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html_extract.extract_text(pages).collect()}
    # a card on all pages of its host goes, the words beside it are the text
    assert [got[i] for i in (1, 2, 3)] == [words(f"lead{i}x", 30) for i in (1, 2, 3)]
    # more words than the article's, but the host repeats them; on a host with one page it does not
    assert [got[i] for i in (4, 5)] == ["short own note 4", "short own note 5"]
    assert got[6] == words("notice", 20) + " short own note 6"
    assert got[7] == "short own note 7"  # too few words to be called repeated or not


def test_neighbours_across_ranges_and_batches(spark):
    import random

    rnd = random.Random(11)
    streams = [[rnd.choice("abcd") for _ in range(rnd.randint(0, 30))] + ["all", "pages", "say", "so"] * rnd.randint(0, 2) for _ in range(60)]
    pages = spark.createDataFrame([(i, "http://h/", " ".join(s)) for i, s in enumerate(streams)], "page_id int, url string, html string")
    settings = {"spark.sql.shuffle.partitions": "37", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "3"}
    kept = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = {r.page_id: r.text for r in html_extract.extract_text(pages, long=4).collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert [got[i] for i in range(60)] == [" ".join(s) for s in plain_cover(streams, 4)]


def test_articles_show_what_their_host_repeats(spark):
    words = lambda name, n: " ".join(f"{name}{j}" for j in range(n))
    offer, text = words("offer", 9), {i: words(f"text{i}x", 20) for i in range(1, 8)}
    marked = lambda i, *more: f"<main><p>{text[i]}</p>{''.join(f'<p>{m}</p>' for m in more)}</main><footer>{i}</footer>"
    data = [
        (1, "http://h/1", marked(1, offer)), (2, "http://h/2", marked(2, offer)), (3, "http://h/3", f"<p>{text[3]}</p><p>{offer}</p>"),
        # print versions of an article, which is there twice, and of one that has the offer
        (4, "http://h/4", marked(4)), (5, "http://h/5", marked(4) + "<p>beside</p>"), (6, "http://h/6", f"<p>{text[4]}</p>"), (7, "http://h/7", f"<p>{text[1]}</p><p>{offer}</p>"),
        # one article alone, and two on another host
        (8, "http://g/8", marked(5, offer)), (9, "http://g/9", f"<p>{text[6]}</p><p>{offer}</p>"),
    ]
    pages = spark.createDataFrame(data, "page_id bigint, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html_extract.extract_text(pages).collect()}
    assert [got[i] for i in (1, 2)] == [f"{text[i]} {offer}" for i in (1, 2)] and got[4] == got[5] == text[4]  # articles stay whole
    assert got[3] == text[3] and got[7] == text[1]
    assert got[6] == text[4] and got[9] == f"{text[6]} {offer}"
    for i, own in ((3, text[3]), (7, text[1])):
        alone = spark.createDataFrame([d for d in data if d[0] in (1, 2, i)], "page_id bigint, url string, html string")
        assert {r.page_id: r.text for r in html_extract.extract_text(alone).collect()}[i] == own
