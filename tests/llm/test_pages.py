"""URL filters, HTML extraction, WARC archives and the mix: brute force, round trips, edge cases."""

import base64
import hashlib
import io
import re
from html.parser import HTMLParser

import pytest
from check import connect, differences
from conftest import SF
from pyspark.sql import functions as F

import __spark_entry__ as entry
from claimweave.llm import html_text, mixing, url_filter, warc
from claimweave.llm.oracle import ORACLE


@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_sql(spark, name):
    assert differences(spark, connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF) == ""


# ---------------------------------------------------------------- URL filters

URLS = [
    None, "", "example.net/en/", "http://EXAMPLE.net/en/x?y#z", "http://a.example.net/en", "https://net/", "http://net", "http://x.net?q=/",
    "http://example.com/de/", "http://badexample.com/de/", "http://www.example.com/DE/", "http://w.org/fr/#t", "ftp://casino-win.com/x",
    "http://casinos.com/", "http://x.com/a/pills/b", "http://spam-farm.org/fr/1", "http://x.com/://net/", "http://a\nb.net/x", "http://net:80/",
]


def test_index_gives_what_all_rules_give(spark):
    rules = [*url_filter.RULES, url_filter.Rule("block", "x.com/a"), url_filter.Rule("block", "*ill*", True), url_filter.Rule("allow", "net")]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r for r in url_filter.judge(frame, rules).collect()}
    for i, url in enumerate(URLS):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host, path = re.fullmatch(r"([^/?#]*)([^?#]*).*", rest, re.S).groups()
        host = host.lower()
        fits = [r for r in rules if re.search(r.regex(), host + path, re.S)]
        prefix, pattern = ([*sorted((r for r in fits if r.pattern == p), key=url_filter.Rule.rank), None][0] for p in (False, True))
        chosen = prefix or pattern
        r = got[i]
        assert (r["host"], r["path"]) == (host, path), url
        assert (r["rule"], r["pattern"]) == (prefix and prefix.text, pattern and pattern.text), url
        assert r["verdict"] == (chosen.verdict if chosen else url_filter.DEFAULT)
    assert sum(r["tried"] for r in got.values()) < len(URLS) * len(rules) / 2
    assert url_filter.judge(frame.limit(0)).collect() == []


def test_prefix_rules_fit_whole_hosts_only():
    fits = lambda rule, at: bool(re.search(url_filter.Rule("block", rule).regex(), at, re.S))
    assert fits("example.net/en/", "a.example.net/en/x") and not fits("example.net/en/", "badexample.net/en/x")
    assert not fits("net/", "net") and fits("net", "net") and fits("net", "a.net/x") and not fits("net", "a.net:80/x")


def test_rules_are_kept_under_their_rarest_token():
    rule = url_filter.Rule("block", "example.net/en/")
    assert rule.tokens() == {"example", "net", "en"}
    assert url_filter.Rule("block", "x.org/ab").tokens() == {"x", "org"}
    assert url_filter.Rule("block", "a*b^c^", True).tokens() == {"c"}
    assert url_filter.indexed([rule], {"example": 9, "net": 5, "en": 7}) == {"net": [rule]}


# ---------------------------------------------------------------- main text


class Article(HTMLParser):
    """Text of the article by another parser; for pages of the test tables."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1", "br"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in ("p", "h1"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data

    def text(self):
        return "\n".join(b for b in (" ".join(x.split()) for x in self.blocks) if b)


def test_articles_equal_another_parser(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = html_text.extract(pages).collect()
    assert len(rows) == pages.count()
    for r in rows:
        parser = Article()
        parser.feed(r["html"])
        parser.close()
        assert r["text"] == parser.text(), r["page_id"]


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><a href=x>Home</a> Site</header>
<div id="cookie-notice">We use <b>cookies</b></div><nav>Menu</nav><main><header><h1>Title &amp; more</h1></header><p>Short.</p>
<aside>Other stories</aside><p>A &lt;b&gt; c <i>it</i>alic<br>next<div class="advert-box"><div>buy</div></div>
<p>Last <a href="x">link</a>  para</p><script>var a="</p>";</script><ul><li>item one<li>item two</ul></main>
<section class="comments"><p>First! a comment that is rather long and goes on and on</p></section><form><input>Name</form><footer>&copy;</footer></body></html>"""


def test_boilerplate_goes_and_short_blocks_stay():
    assert html_text.main_text(PAGE) == "Title & more\nShort.\nA <b> c italic\nnext\nLast link para\nitem one\nitem two"


def test_surge_and_dive_without_marked_articles():
    links = "".join(f"<li><a href={i}>Link {i}</a></li>" for i in range(30))
    body = "".join(f"<p>{'words of a long paragraph ' * 5}{i}</p>" for i in range(4))
    page = f"<ul>{links}</ul><div>{body}<p>Short end.</p></div><ul>{links}</ul><div>Tiny.</div>"
    lines = html_text.main_text(page).split("\n")
    assert len(lines) == 5 and lines[-1] == "Short end."


def test_short_parts_of_a_text_stay_without_marked_articles():
    long = "words of a long paragraph " * 20
    links = "".join(f"<li><a href={i}>Link {i}</a></li>" for i in range(9))
    kept = ["Title", long.strip(), "Short last paragraph."]
    page = f"<h1>Title</h1><div class=share>Share</div><p>{long}</p><div class=advert>Buy</div><p>Short last paragraph.</p>"
    assert html_text.main_text(page).split("\n") == kept
    # Lists of links part regions, which then share their container or the page.
    page = f"<h1>Title</h1><ul>{links}</ul><p>{long}</p><ul>{links}</ul><p>Short last paragraph.</p>"
    for whole in (page, f"<ul>{links}</ul><div>Tiny.</div><ul>{links}</ul><div>{page}</div><ul>{links}</ul><div>Tiny.</div>"):
        assert html_text.main_text(whole).split("\n") == kept


@pytest.mark.parametrize("start", [
    'p aria-hidden="false"', "p data-hidden=1", 'p title="hidden gems"', 'div class="content with-sidebar"', "div class=no-comments",
    "div id=has-banner", 'div class="x side-by-side"', "div class=skip-none",
])
def test_text_is_not_taken_for_boilerplate(start):
    tag = start.split()[0]
    for page in (f"<article><p>One</p><{start}>Two</{tag}></article>", f"<p>One</p><{start}>Two</{tag}>"):
        assert html_text.main_text(page) == "One\nTwo"


@pytest.mark.parametrize("start", [
    'p aria-hidden="true"', "p hidden", "p HIDDEN=''", 'div class="x side-bar"', "div id=cookieNotice", "div class='ad-slot-3'", "form"])
def test_boilerplate_by_whole_names(start):
    tag = start.split()[0]
    assert html_text.main_text(f"<article><p>One and more</p><{start}>Two</{tag}></article>") == "One and more"


def test_wrappers_and_links_of_the_text_stay():
    for start in ("div class=sidebar", "form action=x", "div id=related"):
        tag = start.split()[0]
        assert html_text.main_text(f"<{start}><div class=ad>Buy</div><article><p>One and more</p></article></{tag}>") == "One and more"
        assert html_text.main_text(f"<div>Site</div><{start}><div class=ad>Buy</div><p>One and more of it</{tag}>").endswith("One and more of it")
    assert html_text.main_text("<div class=social>Ab</div><div class=related>Cd</div>") == "Ab\nCd"
    assert html_text.main_text("<article><h1><a href=x>Headline</a></h1><p>Text.</p><ol><li><a href=y>Source</a></ol></article>") == (
        "Headline\nText.\nSource")


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), (" \n", ""), ("<p>", ""), ("a < b and c > d", "a < b and c > d"), ("<div><p>Only text", "Only text"),
    ("<p>x<!-- open", "x"), ("<script>var a", ""), ("<article><p>One</article>tail", "One"), ("<p>&nbsp;a&#8217;b&lt;</p>", "a’b<"),
    ("<p>x</p>" * 20_000, "\n".join("x" * 20_000)),
])
def test_edges_of_extraction(html, text):
    assert html_text.main_text(html) == text


def test_extraction_takes_time_in_proportion():
    for piece in ("<a \"", "<script ", "<!--", "<p><div>", "</nav>", "<nav>"):
        html_text.main_text(piece * 20_000)


def test_extraction_of_frames(spark):
    frame = spark.createDataFrame([(1, None, "old"), (1, None, "old"), (2, "<p>x", "old")], "page_id long, html string, text string")
    assert [r["text"] for r in html_text.extract(frame).orderBy("page_id").collect()] == ["", "", "x"]
    assert html_text.extract(frame.limit(0)).collect() == []


# ---------------------------------------------------------------- WARC


def test_archives_give_back_every_page(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    copies = pages.limit(20).withColumn("page_id", F.col("page_id") + 10**15 + 1)
    odd = [(-5, None, None), (None, "u", ""), (-6, "http://a\r\nb", "퟿ ä" * 100_000), (10**17 + 1, "http://c", "x"), (10**17 + 2, "c", "x")]
    frame = pages.union(copies).union(spark.createDataFrame(odd, pages.schema)).withColumn("payload", F.lit("clash")).repartition(3)
    manifest = warc.write(frame)
    got = {r["page_id"]: r for r in warc.read(manifest).collect()}
    rows = {r["page_id"]: r for r in frame.collect()}
    assert got.keys() == rows.keys() and manifest.agg(F.sum("records")).first()[0] == len(rows)
    first = {}
    for i in sorted(rows, key=lambda i: (i is None, i or 0)):
        first.setdefault(rows[i]["html"] or "", i)
    for i, r in rows.items():
        payload, g = (r["html"] or "").encode(), got[i]
        one = first[r["html"] or ""]
        assert g["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode() and g["payload_bytes"] == len(payload)
        assert (g["record_type"], g["refers_to"]) == (("response", None) if i == one else ("revisit", one))
        assert g["payload"] == (payload if i == one else None)
        assert g["url"] == (r["url"] and r["url"].replace("\r", "%0D").replace("\n", "%0A"))
    assert manifest.agg(F.sum("bytes")).first()[0] < 0.5 * sum(len(r["html"] or "") for r in rows.values())


def test_dictionary_stands_in_front_and_frames_are_records():
    records = [warc.record(i, f"http://x/{i}", b"<html>some common text %d</html>" % i * 40, None, warc.RESPONSE) for i in range(200)]
    out = io.BytesIO()
    n, size = warc.write_archive(out, iter(records))
    data = out.getvalue()
    assert n == 200 and size == len(data) and data[:4] == (0x184D2A5D).to_bytes(4, "little")
    assert list(warc.read_archive(io.BytesIO(data))) == records
    assert len(data) < sum(map(len, records)) / 3
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(data[:-3])))


def test_archives_of_few_records_and_of_none(spark):
    out = io.BytesIO()
    assert warc.write_archive(out, iter([b"x"]))[0] == 1 and list(warc.read_archive(io.BytesIO(out.getvalue()))) == [b"x"]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.write(empty)).collect() == []
    twice = spark.createDataFrame([(1, "u", "h"), (1, "u", "h"), (2, "u", "h")], "page_id long, url string, html string")
    got = sorted((r["page_id"], r["record_type"]) for r in warc.read(warc.write(twice)).collect())
    assert got == [(1, "response"), (1, "response"), (2, "revisit")]
    least = warc.read(warc.write(twice, least_bytes=2)).collect()
    assert {r["record_type"] for r in least} == {"response"}


# ---------------------------------------------------------------- mix


def brute_targets(sizes):
    """Share by weight, cap, and share the excess again until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    limit = {s: 3 * sizes[s] for s in order}
    done, rest, free = {}, sum(sizes.values()), set(order)
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > limit[s]}
        if not above:
            return done | share
        done |= {s: limit[s] for s in above}
        rest -= sum(limit[s] for s in above)
        free -= above
    return done


def mixed_table(spark):
    rows = [(i, "w " * (1 + i * 7 % 90), f"s{i % 4}") for i in range(600)]
    rows += [(1000 + i, "w " * 50, "big") for i in range(3000)] + [(5000, "w", "Tiny"), (5001, None, "Tiny"), (5002, "", "empty")]
    rows += [(6000 + i % 5, "w w w", None) for i in range(100)] + [(None, "w " * 9, "Ä"), (None, "w " * 8, "Ä")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit(-1), "p": F.lit("x")})


def test_mix_meets_targets(spark):
    docs = mixed_table(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = brute_targets(sizes)
    for s in sizes:
        of = [r for r in rows if r["source"] == s]
        assert {r["source_size"] for r in of} == {sizes[s]}
        assert of[0]["target"] == pytest.approx(want[s])
        taken = sum(r["taken"] for r in of)
        assert abs(taken - want[s]) <= max(r["size"] for r in of)
        assert all(r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"] for r in of)
        wanted = want[s] / sizes[s] if sizes[s] else 0
        assert all(int(wanted) * r["size"] <= r["taken"] <= (int(wanted) + 1) * r["size"] for r in of)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mix_misses_less_than_the_least_document_left(spark):
    """Shallow sources beside one that goes a level deeper, and one with a very long document."""
    rows = [(i, "w " * (1 + i * 7 % 149), "shallow") for i in range(300)]
    rows += [(10_000 + i, "w " * (4 + i % 3), "deep") for i in range(4500)]
    rows += [(20_000 + i, "w " * (1 + i % 30), "long") for i in range(200)] + [(30_000, "w " * 5000, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    of = {}
    for r in mixing.mix(docs).collect():
        of.setdefault(r["source"], []).append(r)
    for rows in of.values():
        want, size = rows[0]["target"], rows[0]["source_size"]
        missed = want - sum(r["taken"] for r in rows)
        assert want % size
        left = [r["size"] for r in rows if r["copies"] == int(want / size + 1e-9)]
        assert -0.51 <= missed < (min(left) if left else 0.51), (rows[0]["source"], missed)


def test_rounding_is_unbiased(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 20), f"s{i % 2}") for i in range(200)], "doc_id long, text string, source string")
    taken = [0] * 200
    for seed in range(4):
        for r in mixing.mix(docs, seed=seed).collect():
            taken[r["doc_id"]] += r["copies"]
    # Sources have weights 1 and 2: about two thirds of a copy of the one, four thirds of the other.
    assert sum(taken[::2]) / 400 == pytest.approx(2 / 3, abs=0.1) and sum(taken[1::2]) / 400 == pytest.approx(4 / 3, abs=0.1)


def test_mix_of_nothing(spark):
    assert mixing.mix(mixed_table(spark).limit(0)).collect() == []
    only = spark.createDataFrame([(1, None, None), (1, "", None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix(only).collect()] == [0, 0]


def test_tags_that_never_close_take_time_in_proportion():
    import time

    from claimweave.llm.html_text import main_text

    for quotes in ('x="1" ', "x='1' ", "x=\"' ", '" '):
        page = "<article><p>Text that stays here.</p></article><a " + quotes * 10_000 + "<b>end</b>"
        start = time.perf_counter()
        assert "Text that stays here." in main_text(page)
        assert time.perf_counter() - start < 1, quotes


def test_a_slash_at_the_end_of_a_value_closes_no_link():
    from claimweave.llm.html_text import main_text

    long = "This is the long text of the page, which goes on for a while and then some more. " * 4
    menu = "<div>" + "".join(f"<a href=/{w}/>{w}</a> " for w in ("Home", "News", "Sport")) + "</div>"
    assert main_text(f"<body>{menu}<p>{long}</p></body>") == long.strip()
    assert main_text(f"<article><div/><p>{long}</p><p>last<br/>line</p></article>") == f"{long.strip()}\nlast\nline"


def test_what_readers_wrote_goes_by_names_that_end_so():
    from claimweave.llm.html_text import main_text

    long = "This is the long text of the page, which goes on for a while and then some more. " * 4
    for name in ("article-comments", "post-comments", "postComments", "entry-replies"):
        assert main_text(f"<article><p>{long}</p><div class='{name}'><p>I liked it.</p></div></article>") == long.strip(), name
    for name in ("no-comments", "has-comments", "commentary"):
        assert main_text(f"<article><div class='{name}'><p>Short one.</p></div><p>{long}</p></article>").startswith("Short one."), name
