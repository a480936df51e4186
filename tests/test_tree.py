"""The tree: any markup, selectors, serialising, bytes, sessions."""

import random
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from extractspark.deploy import shared_dir, spread
from extractspark.functions import similarity
from extractspark.operators import adaptive, css, detect, flexible, replay, rules, select
from extractspark.sources import fetch, html
from pyspark.sql import functions as F

LIST = '<div id=a class="x y"><p>1</p><p title="a,b">2</p><span>3</span><p></p></div><div><ul><li lang=en-GB>a<li>b</ul></div>'


def table(spark, *pages):
    return spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")


@pytest.mark.parametrize(("selector", "found"), [
    ("p", [1, 2, 4]), ("div > p", [1, 2, 4]), ("div p:first-child", [1]), ("p:nth-of-type(2)", [2]), ("[title='a,b']", [2]), ('[title="a,b"], span', [2, 3]), ("p:not([title])", [1, 4]),
    ("div:has(> span)", [0]), ("div:has(li)", [5]), ("p + span", [3]), ("p ~ p", [2, 4]), ("p:empty", [4]), ("#a.x p:last-of-type", [4]), ("div:nth-child(odd)", [0]), ("div:nth-last-child(1)", [5]),
    ("p:contains('2')", [2]), (":root", [0, 5]), ("div:is(.x, .z) p:nth-child(n+2)", [2, 4]), ("p:not(:nth-child(2n))", [1]), ("[lang|=en]", [7]), ("[class~=Y i]", [0]), ("[title!='a,b'].x", [0]),
    ("span:only-of-type", [3]), ("ul:only-child", [6]), ("P", [1, 2, 4]), ("*:has(+ div)", [0]), ("p:nth-child(-n+1)", [1]),
])
def test_selectors(spark, selector, found):
    root = html.parse(LIST)
    assert [e.number for e in css.select(root, selector)] == found
    assert [r["node_id"] for r in select.select_pages(table(spark, LIST), selector, ["node_id"], limit=2).collect()] == found[:2]


@pytest.mark.parametrize("wrong", ["", "p >", "> p", "p,,q", "p:unknown", "p:nth-child(x)", "[a", "p:not(", "a > > b", "p:not()"])
def test_what_is_no_selector(wrong):
    with pytest.raises(ValueError, match="selector"):
        css.parse(wrong)


def test_relational_selectors_know_commas_in_quotes(spark):
    nodes = html.nodes(table(spark, LIST))
    assert [r["node_id"] for r in select.select(nodes, '[title="a,b"], div > ul > li[lang]').orderBy("node_id").collect()] == [2, 7]
    with pytest.raises(ValueError, match="select_pages"):
        select.select(nodes, "p:first-child")


def test_looking_up_and_around():
    root = html.parse(LIST)
    item = css.select_one(root, "li")
    assert css.closest(item, "div").number == 5 and css.closest(item, "li") is item and css.closest(item, "table") is None
    assert css.matches(item, "ul > li") and [e.number for e in css.filtered(item.parent.parent, "ul")] == [6] and css.select_one(root, "table") is None
    assert item["lang"] == "en-GB" and "lang" in item and "id" not in item and item.get("id", "-") == "-" and root.elements[0].get_list("class") == ["x", "y"] and item.get_list("id") == []


def test_no_markup_stops_the_parser():
    rng = random.Random(0)
    parts = ["<", ">", "![", "[", "foo[", "]]", "-", "/", "a", '="', "'", "&", "#", "x", "?", "!", "--", "CDATA[", " ", "DOCTYPE", "p"]
    for _ in range(20_000):
        page = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        for unescape in (True, False):
            html.parse(page, unescape).markup()


def test_rejected_declarations_are_leaves(spark):
    for page in ("<p>a<![foo[ x ]]>b</p><i>c</i>", "<p>a&lt;![foo[ x ]]&gt;b</p><i>c</i>"):
        root = html.parse(page)
        assert root.text().startswith("a") and root.text().endswith("c") and [e.name for e in root.walk()] == ["p", "i"]
    kinds = [(r["kind"], r["text"], r["parent_id"]) for r in html.strings(table(spark, "<!DOCTYPE html><p>a<![foo[ x ]><!-- c --><b>d</b><?pi?></p><script>s</script>")).collect()]
    assert kinds == [("doctype", "html", -1), ("text", "a", 0), ("declaration", "foo[ x ]", 0), ("comment", " c ", 0), ("text", "d", 1), ("pi", "pi?", 0), ("script", "s", 2)]


def test_deep_and_wide_pages_take_time_by_their_length():
    deep, wide = html.parse("<div>" * 20_000 + "x"), html.parse("".join(f"<p class=c{i}>{i}</p>" for i in range(20_000)))
    began = time.perf_counter()
    columns = ["page_id", "node_id", "parent_id", "last_desc", "depth", "name", "own_text", "tag_ord"]
    assert sum(1 for _ in html._rows(1, "", deep, lambda e: True, columns)) == sum(1 for _ in html._rows(1, "", wide, lambda e: True, columns)) == 20_000
    assert detect.repeated(wide) == [] and deep.markup().count("<div>") == 20_000
    assert css.select(deep, "div:empty") == [] and len(css.select(wide, "p:nth-child(2n)")) == 10_000
    assert time.perf_counter() - began < 10


def test_items_of_one_long_list_take_time_by_its_length():
    root = html.parse("<div>" + "".join(f"<div class=card><h2>n{i}</h2><span>{i % 7}</span></div>" for i in range(12_000)) + "</div>")
    card = root.elements[0].elements[3]
    fields = [rules.rule_for(rules.Match(e), group_index=0, attr_index=a) for a, e in enumerate(card.elements)]
    began = time.perf_counter()
    assert rules.replay_grouped(fields, root) == [[f"n{i}", str(i % 7)] for i in range(12_000)]
    assert time.perf_counter() - began < 4


def test_serialising():
    p = html.parse("<p title='a\"b' class='x y'>5 &lt; é<br><!--c--><script>a<b</script></p>", unescape=False)
    assert p.markup() == "<p title='a\"b' class=\"x y\">5 &lt; é<br/><!--c--><script>a<b</script></p>"
    assert "&eacute;" in p.markup("html") and "5 < é" in p.markup(None)
    assert html.quoted("a\"b'c") == '"a&quot;b\'c"' and html.escaped("a & b") == "a &amp; b"
    assert html.parse("<div><p>a<b>c</b></p></div>").markup(pretty=True) == "<div>\n <p>\n  a\n  <b>\n   c\n  </b>\n </p>\n</div>\n"
    again = html.parse(p.markup(), unescape=False)
    assert [e.attrs for e in again.walk()] == [e.attrs for e in p.walk()] and again.text() == p.text()
    with pytest.raises(ValueError, match="formatter"):
        p.markup("xml")


@pytest.mark.parametrize(("body", "charset", "text"), [
    ("é".encode("utf-16"), None, "é"), ("é".encode("utf-8-sig"), "latin-1", "é"), ("é".encode("utf-32"), None, "é"), ("<meta charset=latin-1>é".encode("latin-1"), None, "<meta charset=latin-1>é"),
    ("é".encode("latin-1"), "latin-1", "é"), (b"\x93x\x94", None, "“x”"), ("é".encode(), "no-such", "é"), ("é".encode(), "ascii", "é"), (b"", None, ""), ("<?xml version='1.0' encoding='koi8-r'?>я".encode("koi8-r"), None, "<?xml version='1.0' encoding='koi8-r'?>я"),
])
def test_bytes(body, charset, text):
    assert html.decode(body, charset) == text


def test_pages_stored_as_bytes(spark):
    pages = spark.createDataFrame([(1, "<h1>é</h1>".encode("utf-16")), (2, None), (3, b"<h1>\x93</h1>")], "page_id long, html binary")
    assert {r["page_id"]: r["text_strip"] for r in html.nodes(pages, names=["h1"], columns=["page_id", "text_strip"]).collect()} == {1: "é", 3: "“"}


def test_sessions_keep_connections_and_pauses():
    asked, peers = [], set()

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_GET(self):  # noqa: N802
            asked.append((self.path, time.monotonic()))
            peers.add(self.client_address)
            code = 302 if self.path == "/moved" else 503 if self.path == "/busy" and len(asked) % 2 else 404 if self.path == "/no" else 200
            body = b"ok" if code == 200 else b""
            self.send_response(code)
            if code == 302:
                self.send_header("Location", "/there")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    with fetch.Session(retries=2, backoff=0.0, pause=0.05) as session:
        assert [session.get(base + p) for p in ("/a", "/moved", "/no", "/busy", "/é x")] == [("ok", 200, None), ("ok", 200, None), (None, 404, "RuntimeError: HTTP error 404"), ("ok", 200, None), ("ok", 200, None)]
    assert len(peers) == 1 and asked[-1][1] - asked[0][1] > 0.045 * (len(asked) - 1)
    assert fetch.fetch_one(base + "/a", max_bytes=1)[2] == "RuntimeError: the page is too large" and fetch.fetch_one("ftp://x")[2] == "ValueError: only http and https"
    server.shutdown()
    server.server_close()
    assert "ConnectionError" in fetch.fetch_one(base, retries=0, timeout=1.0)[2]


def test_fingerprints_of_tables_and_of_values_agree(spark):
    for values in (["$1,299.99", "$5", "€ 12"], ["one two", "three  four five", "x" * 120, "é1²"], ["4.5 / 5", "3/5"], ["https://a.b/c"] * 3, ["12", "١٢"]):
        (own,) = flexible.fingerprint_of(values)
        made = flexible.fingerprint(spark.createDataFrame(list(enumerate(values)), "at long, value string"), order="at").first().asDict()
        assert all(own[k] == pytest.approx(v) if isinstance(v, float) else own[k] == v for k, v in made.items())


def test_bounds_are_no_less_than_the_ratio():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcd ") for _ in range(rng.randrange(0, 30)))
    for _ in range(500):
        a, b, limit = word(), word(), rng.random()
        assert similarity.bound(a, b) >= similarity.ratio(a, b) and similarity.reaches(a, b, limit) == (similarity.ratio(a, b) >= limit)
    elements = list(html.parse(LIST.replace("3", word() * 3)).walk())
    for e in elements:
        for f in elements:
            a, b = adaptive.signature(e), adaptive.signature(f)
            assert similarity.signature_score(a, b, like=similarity.bound) >= similarity.signature_score(a, b)


def test_similar_text_over_columns(spark):
    pairs = [("Thing one", "thing  ONE"), ("abcdefgh", "abcdefgx"), ("abc", "xyz"), ("a", "a" * 40), ("", "a"), (None, "a"), ("abcd", "dcba")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity.text_like(F.col("a"), F.col("b"), 0.8).alias("like")).collect()
    assert [r["like"] for r in got] == [similarity.fuzzy_match(a, b, 0.8) for a, b in pairs]


def test_small_tables_are_spread_and_large_ones_left(spark, monkeypatch):
    few = spark.range(10).coalesce(1)
    assert spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr("extractspark.deploy.SMALL", 1)
    assert spread(few).rdd.getNumPartitions() == 1


def test_shared_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_pages_without_a_value_go_to_the_fallback(spark):
    learned, _, _ = rules.learn("<body><p class=a>x</p><b>other</b></body>", {"v": ["x"]})
    rows = replay.similar(table(spark, "<body><p class=a>y</p><b>other</b></body>", "<body><i>z</i></body>"), learned, otherwise=lambda i, url, root: iter([(i, "none", "", 0, 0, root.text())]))
    assert sorted((r["page_id"], r["stack_id"] == "none", r["value"]) for r in rows.collect()) == [(0, False, "y"), (1, True, "z")]


def test_matchers_and_detectors_as_objects(spark):
    from test_engine import PAGE, RICH

    text = similarity.TextMatcher(0.7)
    assert text.matches("Title", "titles") and not text.matches("a", "zzz") and text.ratio("a", "A") == 1 and text.best("Title A", ["x", "Title B", "title a"]) == ("title a", 1.0) and text.best("q", ["x"]) is None
    root = html.parse(PAGE)
    first, *rest = css.select(root, "h2")
    matcher = adaptive.ElementMatcher(0.5)
    assert matcher.score(first, first) == 1 and [e for e, _ in matcher.similar(root, first)] == rest and matcher.best(root, adaptive.signature(first))[0][0] is first
    assert adaptive.ElementMatcher(weights={k: float(k == "tag_name") for k in similarity.WEIGHTS}).score(first, rest[0]) == 1
    page = detect.PageDetector(RICH, "https://e.com/x")
    assert page.tables()[0]["headers"] == ["Name", "Age"] and page.csv().startswith('"Name"') and page.pagination()["current"] == 2 and page.page_urls(1) == ["https://e.com/page/1"]
    assert page.structured()["json_ld"] == [{"@type": "Product"}] and len(page.cards()) == 2 and len(page.lists()) >= 2
