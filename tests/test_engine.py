"""The engine on small pages, with results worked out by hand."""

import json
import re

import pytest
from extractspark.functions import regex, similarity, text, typed, urls
from extractspark.operators import adaptive, detect, flexible, replay, rules, select
from extractspark.plans.session import Extractor
from extractspark.sources import fetch, html, models
from extractspark.streaming import pages as streams
from pyspark.sql import functions as F

ITEMS = "".join(f'<article class="post"><h2 class="title">Title {c}</h2><p class="summary">Sum {c}</p><a href="/article/{i}">Read</a></article>' for i, c in enumerate("ABC", 1))
PAGE = f"<html><head><title> News </title></head><body><div>{ITEMS}</div></body></html>"
NEW = PAGE.replace("Title A", "Fresh A").replace("Sum B", "Other B")
SHOP = '<html><body><ul class="shop">' + "".join(f'<li class="row"><b class="n">Thing number {i}</b> <span class="cost">${i}9.50</span></li>' for i in range(1, 6)) + "</ul></body></html>"


@pytest.fixture
def session(spark):
    return Extractor(spark)


def table(spark, *pages):
    return spark.createDataFrame([(i, "https://www.example.com/a/b", p) for i, p in enumerate(pages)], "page_id long, url string, html string")


# Parsing


def names(root):
    return [(e.name, e.parent.name) for e in root.walk()]


def test_unclosed_elements_take_in_what_follows():
    root = html.parse("<p>a<b>b<p>c</p>d")
    assert names(root) == [("p", html.DOCUMENT), ("b", "p"), ("p", "b")]
    assert root.text() == "abcd"


def test_void_elements_and_stray_end_tags():
    root = html.parse("<div>a<br>b</br>c<img src=x>d</div></i>e")
    assert names(root) == [("div", html.DOCUMENT), ("br", "div"), ("img", "div")]
    assert root.elements[0].text() == "abcd"


def test_two_flavours_of_text():
    p = html.parse("<p><b>Bold</b> and <i>normal</i>\n</p>").elements[0]
    assert (p.text().strip(), p.tight(), p.own(), p.single()) == ("Bold and normal", "Boldandnormal", "and", None)


def test_blank_runs_collapse_but_not_in_pre():
    root = html.parse("<a>x</a> \n <pre> \n </pre><a>y</a>   <a>z</a>")
    assert root.text() == "x\n \n y z"


def test_scripts_comments_and_references():
    root = html.parse('<script>var t="</p>";</script><!-- no --><p>5 &lt; 6 &amp;amp; &#233;</p>', unescape=False)
    assert root.text() == "5 < 6 &amp; é"
    assert root.elements[0].text() == 'var t="</p>";'


def test_references_are_decoded_before_parsing():
    assert [e.name for e in html.parse("<p>a &lt;ceo&gt; b</p>").walk()] == ["p", "ceo"]


def test_attributes():
    e = html.parse('<a CLASS="x  y" rel="next nofollow" href=1 href=2 hidden>z</a>').elements[0]
    assert e.attrs == {"class": ["x", "y"], "rel": ["next", "nofollow"], "href": "2", "hidden": ""}


def test_intervals_hold_for_malformed_pages(spark):
    rows = html.nodes(table(spark, PAGE, "<b><p>x<td>y</b><li>z<li>w", "", "<<>&&</", None)).collect()
    by = {(r["page_id"], r["node_id"]): r for r in rows}
    for r in rows:
        assert r["last_desc"] >= r["node_id"] and len(r["chain"]) == r["depth"] + 1 == len(r["path"].split("/"))
        if r["parent_id"] >= 0:
            up = by[r["page_id"], r["parent_id"]]
            assert up["node_id"] < r["node_id"] <= r["last_desc"] <= up["last_desc"]


def test_equal_content_has_equal_digests():
    a, b, c = html.parse('<p id="1" title="x">t<b>u</b></p><p title="x" id="1">t<b>u</b></p><p>t<b>u</b></p>').elements
    assert a.digest() == b.digest() != c.digest()


# Rules


def test_similar_and_exact(session):
    assert session.build(PAGE, ["Title A"]) == ["Title A", "Title B", "Title C"]
    assert session.get_result_similar(NEW) == ["Fresh A", "Title B", "Title C"]
    assert session.get_result_exact(NEW) == ["Fresh A"]
    assert session.get_result(NEW) == (["Fresh A", "Title B", "Title C"], ["Fresh A"])


def test_leaf_is_pinned_unless_siblings_are_wanted(session):
    page = "<ul>" + "".join(f"<li>Item {i}</li>" for i in range(1, 51)) + "</ul>"
    assert session.build(page, ["Item 1"]) == ["Item 1"]
    assert len(session.get_result_similar(page, contain_sibling_leaves=True)) == 50
    assert session.build(page, ["Item 3"]) == ["Item 3"]
    assert session.get_result_similar("<ul><li>only</li></ul>") == ["only"]


def test_attributes_full_addresses_patterns_and_own_text(session):
    assert session.build(PAGE, ["/article/2"]) == ["/article/1", "/article/2", "/article/3"]
    assert session.build(PAGE, ["https://example.com/article/1"], url="https://example.com/") == [f"https://example.com/article/{i}" for i in (1, 2, 3)]
    assert session.build(PAGE, [re.compile(r"Sum [AB]")])[0].startswith("Sum")
    assert session.build("<div><p>own <b>bold</b></p></div>", ["own"]) == ["own"]


def test_aliases_grouping_and_rule_management(session):
    session.build(PAGE, wanted_dict={"title": ["Title A"], "sum": "Sum C"})
    assert session.get_result_similar(NEW, group_by_alias=True) == {"title": ["Fresh A", "Title B", "Title C"], "sum": ["Sum A", "Other B", "Sum C"]}
    first = session.rules[0].stack_id
    session.set_rule_aliases({first: "t"})
    session.keep_rules([first])
    assert [r.alias for r in session.rules] == ["t"]
    with pytest.raises(KeyError):
        session.set_rule_aliases({"rule_none": "x"})
    session.remove_rules([first])
    assert session.rules == [] and session.get_result_similar(NEW) == []


def test_stored_pages_beyond_the_cap_on_fetching_are_read_whole(spark, session):
    page = NEW.replace("</body>", "<p>" + "word " * (html.MAX_BYTES // 5) + "</p><nav><a href=/end>End</a></nav></body>")
    assert len(page) > html.MAX_BYTES
    assert session.build(page, ["Title B"]) == ["Fresh A", "Title B", "Title C"]
    pages = table(spark, NEW, page)
    assert session.get_result_similar(page) == ["Fresh A", "Title B", "Title C"]
    for rows in (session.get_result_similar(pages=pages), session.get_result_exact(pages=pages)):
        short, long = (r["values"] for r in rows.orderBy("page_id").collect())
        assert short == long
    links = html.nodes(pages, names=["a"], columns=["page_id", "text_strip"]).collect()
    assert [r["text_strip"] for r in links if r["page_id"] == 1] == ["Read"] * 3 + ["End"]
    cards = detect.detect_cards(pages).groupBy("page_id").count().collect()
    assert len(cards) == 2 and cards[0]["count"] == cards[1]["count"]


def test_no_targets(session):
    for wrong in ([], None):
        with pytest.raises(ValueError, match="example value"):
            session.build(PAGE, wrong)
    with pytest.raises(ValueError, match="list of lists"):
        session.build_grouped(PAGE, ["x"])


def test_grouped_items_with_gaps(session):
    page = PAGE.replace('<p class="summary">Sum B</p>', "")
    assert session.build_grouped(PAGE, [["Title A", "Sum A", "/article/1"]]) == [[f"Title {c}", f"Sum {c}", f"/article/{i}"] for i, c in enumerate("ABC", 1)]
    assert session.get_result_grouped(page, output_format="tuple")[1] == ("Title B", "", "/article/2")
    assert session.group_rules[0]["container_tag"] == "article"


def test_fuzzy_text_and_classes(session):
    assert session.build(PAGE, ["Titel A"], text_fuzz_ratio=0.8)[0] == "Title A"
    session.build(PAGE, ["Title A"])
    other = PAGE.replace('"title"', '"titles"')
    assert session.get_result_similar(other) == []
    assert session.get_result_similar(other, attr_fuzz_ratio=0.7) == ["Title A", "Title B", "Title C"]


def test_replay_agrees_on_any_partitions(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    learned, _, _ = rules.learn(PAGE.replace("<div>", "<article>"), {"": ["Title A"]})
    first = pages.first()["html"]
    some = [e for e in html.parse(first).walk() if e.name in ("h1", "li", "p")][:6]
    learned += [rules.rule_for(rules.Match(e)) for e in some]
    learned = rules.distinct(learned)
    key = lambda df: sorted(map(tuple, df.collect()))
    tree = key(replay.similar(pages.repartition(8), learned))
    assert tree and tree == key(replay.similar(pages.coalesce(1), learned))


def test_flexible_finds_the_same_content_elsewhere(session):
    session.build(SHOP, ["$19.50"])
    other = '<html><body><div class="grid">' + "".join(f"<section><h3>Some other thing {i}</h3><em>${i}1.25</em></section>" for i in range(1, 6)) + "</div></body></html>"
    assert session.get_result_similar(other) == []
    assert sorted(session.get_result_flexible(other)) == [f"${i}1.25" for i in range(1, 6)]


def test_adaptive_finds_moved_elements(spark):
    session = Extractor(spark, adaptive=True)
    session.adaptive_build(PAGE, wanted_dict={"first": ["Title A"]}, url="https://example.com/x")
    moved = PAGE.replace("<div>", '<section><div class="wide">').replace("</div>", "</div></section>")
    assert session.get_result_adaptive(moved, "https://www.example.com/y", identifiers=["first"], group_by_identifier=True)["first"] == ["Title A"]
    element, score, every = session.adaptive_find("first", moved, "https://example.com/y")
    assert element.tight() == "Title A" and 0.5 < score <= 1 and len(every) == 3
    assert [e.tight() for e, _ in session.find_similar_elements(element, moved)] == ["Title B", "Title C"]
    assert session.get_result_similar(moved, "https://example.com/y") != []


def test_signature_scores():
    root = html.parse(PAGE)
    a, b = [e for e in root.walk() if e.name == "h2"][:2]
    assert similarity.signature_score(adaptive.signature(a), adaptive.signature(a)) == 1
    assert 0.5 < similarity.signature_score(adaptive.signature(a), adaptive.signature(b)) < 1


# Detectors

RICH = (
    '<html><head><title>Shop</title><meta name="description" content="d"><meta property="og:title" content="o1"><meta property="og:title" content="o2"><meta name="x" content="y">'
    '<script type="application/ld+json">{"@type": "Product"}</script><script type="application/ld+json">{bad</script></head><body>'
    '<div itemscope itemtype="T"><span itemprop="n">A</span><span itemprop="n">B</span><a itemprop="u" href="/u">x</a><time itemprop="t">now</time></div>'
    '<ul><li>a</li><li>b</li><li>c<ul><li>no</li></ul></li></ul>'
    + "".join(f'<div class="product-card"><h3>P{i}</h3><span class="price">${i}</span><p>text</p><img data-src="i{i}"><a href="/p{i}">go</a></div>' for i in range(3))
    + '<table><thead><tr><th>Name</th><th>Age</th></tr></thead><tbody><tr><td>J  D</td><td>1</td></tr><tr><td>K"</td><td>2</td><td>more</td></tr></tbody></table>'
    '<nav class="pagination"><a href="/page/1">1</a><span class="active">2</span><a href="/page/3">3</a><a href="/page/3">›</a><a href="/page/1" rel="prev">back</a></nav></body></html>'
)


def test_structured_data(session):
    found = session.extract_structured_data(RICH)
    assert found["json_ld"] == [{"@type": "Product"}]
    assert found["meta_tags"] == {"standard": {"description": "d", "title": "Shop"}, "og": {"title": "o2"}, "twitter": {}, "other": {"x": "y"}}
    assert found["microdata"] == [{"type": "T", "properties": {"n": ["A", "B"], "u": "/u", "t": "now"}}]


def test_lists_cards_tables_pagination(session):
    kinds = [(x["type"], x["tag"], x["count"]) for x in session.detect_lists(RICH)]
    assert ("html_list", "ul", 3) in kinds and ("repeated_pattern", "div", 3) in kinds
    cards = session.detect_cards(RICH)
    assert [c["indicator"] for c in cards] == ["card", "product"]
    assert cards[0]["sample_fields"] == {"title": "P0", "price": "$0", "description": "text", "image": "i0", "link": "/p0"}
    (t,) = session.extract_tables(RICH)
    assert t["headers"] == ["Name", "Age"] and t["rows"] == [["J D", "1"], ['K"', "2", "more"]] and t["as_dicts"][1]["col_2"] == "more"
    assert session.extract_table_to_csv(RICH) == '"Name","Age"\r\n"J D","1"\r\n"K""","2","more"\r\n' and session.extract_table_to_csv(RICH, table_index=3) == ""
    assert session.detect_pagination(RICH, url="https://e.com/x") == {"next": "https://e.com/page/3", "prev": "https://e.com/page/1", "pages": [{"number": 1, "url": "https://e.com/page/1"}, {"number": 3, "url": "https://e.com/page/3"}], "current": 2, "total_pages": 3}
    assert session.get_all_page_urls(RICH, max_pages=1) == ["/page/1"]


def test_detectors_over_tables(spark, session):
    pages = table(spark, RICH, "", None)
    assert {r["bucket"]: r["content"] for r in detect.meta_tags(pages).where("name = 'title'").collect()} == {"standard": "Shop", "og": "o2"}
    assert detect.json_ld(html.nodes(pages)).count() == 1
    assert detect.extract_tables(pages).count() == 5 and detect.detect_cards(pages).count() == 2
    smart = detect.smart_extract(pages).orderBy("page_id").collect()
    assert json.loads(smart[0]["structured_data"])["json_ld"] == [{"@type": "Product"}] and smart[1]["pagination"]["next"] is None
    assert detect.all_page_urls(pages).where("page_id = 0").count() == 2


def test_css_and_axes(spark):
    nodes = html.nodes(table(spark, RICH)).persist()
    count = lambda s: select.select(nodes, s).count()
    assert (count("div.product-card > h3"), count("ul li"), count("body > ul > li"), count("[itemprop=n], time"), count("h3 + span"), count("h3 ~ a")) == (3, 4, 3, 3, 3, 3)
    assert select.find_all(nodes, "a", {"href": re.compile("^/p[0-9]")}).count() == 3 and select.find_all(nodes, "a", string="›").count() == 1
    assert select.find_all(nodes, "li", limit=2).count() == 2
    cards = select.find_all(nodes, "div", {"class": "product-card"})
    assert select.related(cards, nodes, "descendants").count() == 15 and select.related(cards, nodes, "ancestors").where("name = 'body'").count() == 3
    with pytest.raises(ValueError, match="axis"):
        select.related(cards, nodes, "beside")


# Text


@pytest.mark.parametrize(("price", "number"), [("$1,299.99", 1299.99), ("1.299,50 €", 1299.5), ("12,50", 12.5), ("1,234", 1234.0), ("1,234,56", None), ("abc", None), ("$5", 5.0), ("5.", 5.0), ("1.2.3", None)])
def test_prices(spark, price, number):
    assert spark.createDataFrame([(price,)], "p string").select(typed.parse_price(F.col("p"))).first()[0] == number


def test_typed_values_as_the_standard_library_finds_them(spark):
    lines = ["mail a.b@c.co or x@y", "+1 (555) 123-4567 on 2024-01-02, Jan 5th, 2024 at 10:30 PM", "4.5/5 ★★ 12% $1,000.50 20 USD #tag @me 10.0.0.1 12345-6789", "https://e.com/a?b=c. ١٢٣ 9é", ""]
    rows = spark.createDataFrame([(x,) for x in lines], "t string").select("t", typed.extract_all(F.col("t")).alias("m")).collect()
    for r in rows:
        assert r["m"] == {k: v for k, p in typed.PATTERNS.items() if (v := re.findall(p, r["t"]))}
    with pytest.raises(ValueError, match="no type"):
        typed.extract_type(F.col("t"), "colour")


def test_cleaning(spark, session):
    one = lambda column: spark.createDataFrame([("  <b>Hello</b>\t &amp;  you \n\n\n There!  ",)], "t string").select(column).first()[0]
    assert one(text.clean(F.col("t"))) == "<b>Hello</b> & you \n\n There!"
    assert one(text.clean(F.col("t"), strip_html_tags=True, lowercase=True, remove_punctuation=True)).split() == ["hello", "you", "there"]
    assert spark.createDataFrame([("One. Two!  Three? four",)], "t string").select(text.sentences(F.col("t"))).first()[0] == ["One.", "Two!", "Three?", "four"]
    cut = spark.createDataFrame([("word " * 20,), ("x" * 40,), ("short",)], "t string").select(text.truncate(F.col("t"), 30)).collect()
    assert [r[0] for r in cut] == ["word word word word word...", "x" * 27 + "...", "short"]
    assert spark.createDataFrame([(" ﬁ é ",)], "t string").select(text.normalize(F.col("t"))).first()[0] == "fi e\u0301"


def test_regex_links_and_ratios(spark):
    df = spark.createDataFrame([("k=1; q=22", "https://www.a.com:80/x/y", "z")], "t string, u string, v string")
    assert df.select(regex.extract(F.col("t"), r"\w=\d+")).first()[0] == ["k=1", "q=22"]
    assert [tuple(g) for g in df.select(regex.extract(F.col("t"), r"(\w)=(\d+)")).first()[0]] == [("k", "1"), ("q", "22")]
    assert df.select(regex.extract_named(F.col("t"), r"(?P<a>\w)=(?P<b>2)?")).first()[0] == [{"a": "k", "b": None}, {"a": "q", "b": "2"}]
    assert df.select(regex.replace(F.col("t"), r"(\w)=(\d)", r"\2$\1")).first()[0] == "1$k; 2$q2"
    assert df.select(urls.extract_domain(F.col("u")), urls.resolve(F.col("u"), F.col("v")), urls.resolve(F.col("u"), F.lit("#"))).first() == ("a.com", "https://www.a.com:80/x/z", None)
    assert urls.domain_of("") == "default" and urls.domain_of("a.com/b") == "a.com"
    assert similarity.fuzzy_ratio("Hello  World", "hello world") == 1 and similarity.fuzzy_match("iPhone 15", "the iphone 15 pro") and not similarity.fuzzy_match("", "x")


# Models, pages over HTTP, streams, SQL


@pytest.mark.parametrize("name", ["m.json", "m.db", "m.sqlite3", "m.parquet"])
def test_models_survive_saving(spark, tmp_path, name):
    session, again = Extractor(spark, adaptive=True), Extractor(spark)
    session.build_grouped(PAGE, [["Title A", "/article/1"]])
    session.fingerprints = flexible.fingerprint_of(["a", "b"])
    session.save(str(tmp_path / name))
    again.load(str(tmp_path / name))
    assert again.rules == session.rules and again.fingerprints == session.fingerprints and again.group_rules == session.group_rules
    assert again.store.export_all().keys() == session.store.export_all().keys()
    assert again.get_result_grouped(NEW) == session.get_result_grouped(NEW)


def test_bare_rule_lists_and_missing_files(tmp_path):
    bare = [{"content": [["[document]", {"class": "", "style": ""}, 0], ["html", {"class": "", "style": ""}, 1], ["p", {"class": ["a"], "style": ""}]], "wanted_attr": None, "is_full_url": False, "is_non_rec_text": False, "url": "", "hash": "h", "stack_id": "rule_h"}]
    (tmp_path / "old.json").write_text(json.dumps(bare))
    (rule,) = models.load(str(tmp_path / "old.json")).rules
    assert rule.path == "html/p" and rule.levels[1] == rules.Level("p", ("a",), "", 1)
    for name in ("none.json", "none.db"):
        with pytest.raises(FileNotFoundError):
            models.load(str(tmp_path / name))


def test_fetching(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            self.send_response(404 if self.path == "/no" else 200)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write(PAGE.encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    rows = spark.createDataFrame([(1, base + "/a"), (2, base + "/no"), (3, "ftp://x/y"), (4, None)], "page_id long, url string")
    got = {r["page_id"]: (r["html"], r["status"], r["error"]) for r in fetch.fetch(rows, retries=0, timeout=5.0).collect()}
    server.shutdown()
    assert got[1] == (PAGE, 200, None) and got[2][1:] == (404, "RuntimeError: HTTP error 404") and "http" in got[3][2] and got[4][2]


def test_streams_equal_batches(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages.repartition(3).write.parquet(str(tmp_path / "in"))
    operator = lambda p: detect.html_lists(p).select("page_id", "count")
    query = streams.extract_stream(streams.read_pages(spark, str(tmp_path / "in"), max_files=1), operator, str(tmp_path / "out"), str(tmp_path / "marks"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("page_id", "count")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, operator(pages).collect()))


def test_sql_functions(spark):
    from extractspark.plans.registry import register_functions

    register_functions(spark)
    table(spark, PAGE).createOrReplaceTempView("some_pages")
    assert spark.sql("select t.text_strip from some_pages, lateral html_nodes(html) t where t.name = 'h2' order by t.node_id").collect()[0][0] == "Title A"
    assert spark.sql("select fuzzy_ratio('a b', 'A  B'), url_domain('http://www.x.org/y')").first() == (1.0, "x.org")
