"""Operators on whole tables: sharding, URL filter, WARC, HTML, components."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from html import unescape
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from orderloom.llm import html_text, linkage, url_filter, warc
from orderloom.llm.components import connected_components
from orderloom.llm.pairing import linking_pairs
from orderloom.llm.sharding import proportional_shards
from tests.conftest import rows
from tests.llm.conftest import TEXTS

DATA = "/root/testdata/sf0.001"
HTML = [
    "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav>menu</nav>"
    "<article><h1>Head &amp; more</h1><p>One <b>two</b>\n three<p>Four<br>five"
    "<div class='comments'>no</div><aside>no</aside><form>no<input></form></article>"
    "<footer>foot</footer></body></html>",
    None, "", "<p>plain", "no markup &lt;at&gt; all &amp", "<article></article>", "<div hidden>x</div>",
    "<!-- <p>not</p> --><main><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></main>",
    "<article><p>" + "long " * 30_000 + "</p></article>", "<p unclosed 'quote", "<<>><p></p></p>",
]
TEXT = [
    "Head & more\nOne two three\nFour five", "", "", "plain", "no markup <at> all &", "", "",
    "a\nb\nc\nd", ("long " * 30_000).strip(), "<p unclosed 'quote", "<<>>",
]


@pytest.fixture(scope="session")
def pages(spark):
    """Pages with nulls, repeated rows, a very long one, and clashing extra columns."""
    data = [(i, f"http://h{i % 3}.example.com/a/{i}", h, "k", 1) for i, h in enumerate(HTML)]
    data += [(7, None, HTML[0], "k", 1), (None, "no scheme", HTML[0], "k", 1)] + data[:1] * 2
    return spark.createDataFrame(
        data, "page_id bigint, url string, html string, key string, _first int"
    ).repartition(3)


TWINS = ["op1_ngram_join", "op2_warc", "op5_line_dedup", "op7_sharding", "op12_collocations", "op13_merkle"]


@pytest.mark.parametrize("name", TWINS)
def test_query_against_its_twin(spark, name):
    oracle = duckdb.connect()
    for table in ("documents", "pages"):
        oracle.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    df = queries()[name](spark, DATA)
    found = oracle.execute(oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted(found.fetchall(), key=repr)
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=repr) == expected


def test_shards_hold_the_mixture(spark):
    # A third of the rows in one source, many sources of a single row.
    docs = spark.range(3000).selectExpr(
        "id AS doc_id", "concat('t', id % 50) AS text",
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN concat('s', id % 7) ELSE concat('one', id) END AS source",
    )
    placed = proportional_shards(docs, rows_per_cell=100).collect()
    assert len(placed) == 3000
    by_shard = defaultdict(list)
    for r in placed:
        by_shard[r.shard].append(r)
    for shard in range(8):
        assert sorted(r.slot for r in by_shard[shard]) == list(range(375))
        hot = sum(r.source == "hot" for r in by_shard[shard])
        # Sources of a single row fall where they fall and shift the cuts a little.
        assert abs(hot - 125) <= 8
    # The number of cells is no part of the result.
    again = proportional_shards(docs, rows_per_cell=7)
    assert rows(again) == sorted((tuple(r) for r in placed), key=repr)
    other = proportional_shards(docs, seed="1")
    assert rows(other) != rows(again)


def test_shards_of_odd_rows(spark, odd, no_docs):
    placed = proportional_shards(odd, shards=4)
    found = Counter((r.doc_id, r["size"], r.text_crc32) for r in placed.collect())
    assert found == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in TEXTS
    )
    counts = Counter(r.shard for r in placed.collect())
    assert sorted(counts) == [0, 1, 2, 3] and max(counts.values()) - min(counts.values()) <= 1
    assert proportional_shards(no_docs).isEmpty()


URLS = {
    "http://A.Example.NET/en/x?q=1": ("a.example.net", "/en/x", "example.net/en/", "allow"),
    "https://example.net/de/": ("example.net", "/de/", "net/", "block"),
    "http://notexample.net": ("notexample.net", "", None, "allow"),
    "http://example.com/de/1#x": ("example.com", "/de/1", "example.com/de/", "block"),
    "http://badexample.com/de/1": ("badexample.com", "/de/1", None, "allow"),
    "http://x.org/fr/?a": ("x.org", "/fr/", "org/fr/", "allow"),
    "x://y://z/": ("y:", "//z/", None, "allow"),
    "no scheme": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "http://É.Net/p": ("É.net", "/p", "net/", "block"),
    "http://h.com?x://y": ("h.com", "", None, "allow"),
}


def test_fixed_url_rules(spark):
    df = spark.createDataFrame(
        [(i, u, "r") for i, u in enumerate(URLS)] * 2, "page_id int, url string, rule string"
    )
    none = url_filter.MinedRules(spark.createDataFrame([], url_filter.NO_RULES), ())
    found = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, none).collect())
    assert found == Counter((i, *v) for i, v in enumerate(URLS.values()) for _ in (0, 1))
    assert url_filter.filter_urls(df.where("false"), none).isEmpty()


def test_mined_url_rules(spark):
    rng = random.Random(1)
    data, marks = [], []
    for i in range(2000):
        casino, win = i % 4 == 0, rng.random() < 0.3
        host = "casino.example.com" if casino else f"h{i % 9}.example.com"
        url = f"http://{host}/{'win' if win else 'news'}/{i}?ref=x"
        data.append((i, url))
        # Only the combination is bad, and one label in twenty is wrong.
        marks.append((i, int((casino and win) == (rng.random() < 0.05))))
    df = spark.createDataFrame(data + [(None, "http://casino.example.com/win/1"), (5000, None)], "page_id int, url string")
    labels = spark.createDataFrame(marks[::2] + marks[::4] + [(None, 0)], "doc_id int, quality int")
    mined = url_filter.mine_rules(df, labels)
    assert [sorted(r["items"]) for r in mined.table.collect()] == [["host:casino", "path:win"]]
    verdicts = {r.page_id: r.verdict for r in url_filter.filter_urls(df, mined).collect()}
    assert verdicts == {i: "block" if "casino" in u and "win" in u else "allow" for i, u in data} | {
        None: "block", 5000: "allow",
    }
    assert url_filter.mine_rules(df, labels.where("false")).vocabulary == ()


@pytest.mark.parametrize("vocabulary", [1000, 2])
def test_mined_rules_of_one_host_among_many_and_of_four_tokens(spark, monkeypatch, vocabulary):
    monkeypatch.setattr(url_filter, "VOCABULARY", vocabulary)
    # A host of 8 bad URLs among 1,208; the path and three host labels are bad only together.
    bad = [f"http://lone.com/{i}" for i in range(8)] + [f"http://w.x.y/win/{i}" for i in range(1200)]
    good = [f"http://{h}/{p}/{i}" for h, p in
            [("w.x.z", "win"), ("w.u.y", "win"), ("v.x.y", "win"), ("w.x.y", "news")] for i in range(1200)]
    data = list(enumerate(bad + good + ["http://a.com/1"] * 50))
    df = spark.createDataFrame(data, "page_id int, url string")
    labels = df.selectExpr("page_id AS doc_id", f"int(page_id >= {len(bad)}) AS quality")
    mined = url_filter.mine_rules(df, labels)
    found = {tuple(r["items"]): r.support for r in mined.table.collect()}
    assert found == {("host:lone",): 8, ("host:w", "host:x", "host:y", "path:win"): 1200}
    assert (mined.vocabulary is None) == (vocabulary == 2)
    blocked = url_filter.filter_urls(df, mined).where("verdict = 'block'")
    assert sorted(r.page_id for r in blocked.collect()) == list(range(len(bad)))


def test_urls_with_many_tokens_in_common(spark):
    # 30 tokens in the same six bad URLs would be 2^30 sets; they are one item, any of them enough.
    common = "&".join(f"k{i}=v" for i in range(30))
    bad = [f"http://six.com/{i}?{common}&n{i}" for i in range(6)]
    # 5 of 6 may be chance.
    chance = [f"http://chance.com/{i}" for i in range(6)]
    data = list(enumerate(bad + chance + [f"http://good.com/{i}" for i in range(50)]))
    df = spark.createDataFrame(data, "page_id int, url string").selectExpr("*", "'x' AS _tokens", "1 AS _bad")
    labels = df.selectExpr("page_id AS doc_id", "int(page_id >= 11) AS quality", "0 AS _rows", "'t' AS token")
    mined = url_filter.mine_rules(df, labels)
    assert [(r["items"], r.support, r.confidence) for r in mined.table.collect()] == [(["host:six"], 6, 1.0)]
    assert {r.token for r in mined.members.collect()} == {"host:six", *(f"query:k{i}=v" for i in range(30))}
    new = [(0, "http://other.org/?k7=v"), (1, "http://chance.com/9"), (2, "http://six.com/"), (None, None)]
    new.append((3, "http://long.org/" + "a/" * 500_000 + "?k3=v"))
    found = url_filter.filter_urls(spark.createDataFrame(new, "page_id int, url string"), mined)
    verdicts = {r.page_id: (r.verdict, r.mined) for r in found.collect()}
    block, allow = ("block", "host:six"), ("allow", "")
    assert verdicts == {0: block, 1: allow, 2: block, 3: block, None: allow}


def test_url_rules_against_a_loop(spark):
    """Mining on small random URLs, against all token sets one by one."""
    rng = random.Random(12)
    data, bad = [], {}
    for i in range(240):
        words = sorted(rng.sample("abcdef", rng.randrange(1, 5)))
        data.append((i, "x://h/" + "/".join(words)))
        bad[i] = rng.random() < (0.9 if {"a", "b"} <= set(words) or "f" in words else 0.2)
    df = spark.createDataFrame(data, "page_id int, url string")
    labels = spark.createDataFrame([(i, int(not b)) for i, b in bad.items()], "doc_id int, quality int")
    tokens = {i: frozenset(f"path:{w}" for w in u[6:].split("/")) | {"host:h", "scheme:x"} for i, u in data}
    # Both of these are in every URL: one item, named by the first.
    names = ["host:h", *(f"path:{w}" for w in "abcdef")]
    share = {}
    for n in range(1, 8):
        for chosen in combinations(names, n):
            rows = [bad[i] for i, t in tokens.items() if t.issuperset(chosen)]
            if sum(rows) >= 5:
                share[chosen] = (sum(rows), len(rows))
    expected = {}
    for chosen, (hits, tries) in share.items():
        p = hits / tries
        low = (p + 1.96**2 / 2 / tries - 1.96 * (p * (1 - p) / tries + (1.96 / 2 / tries) ** 2) ** 0.5)
        smaller = [share[s] for n in range(1, len(chosen)) for s in combinations(chosen, n)]
        if low / (1 + 1.96**2 / tries) >= 0.6 and all(a / b < p for a, b in smaller):
            expected[chosen] = hits
    found = {tuple(r["items"]): r.support for r in url_filter.mine_rules(df, labels).table.collect()}
    assert found == expected and len(expected) > 2


def test_archives_of_odd_pages(spark, pages, tmp_path):
    folder = str(tmp_path / "archives")
    manifest = warc.write_archives(warc.plan_records(pages, min_revisit_bytes=100), folder, archive_bytes=2000)
    assert manifest.count() > 1
    back = warc.read_archives(manifest, payload=True)
    given = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    groups = defaultdict(list)
    for i, payload in given:
        groups[payload].append(i)
    expected = Counter()
    for i, payload in given:
        first = max((x for x in groups[payload] if x is not None), default=None)
        revisit = len(payload) >= 100 and first is not None and i != first
        expected[
            i, len(payload), hashlib.sha1(payload).hexdigest(),
            "revisit" if revisit else "response", first if revisit else None,
            None if revisit else payload,
        ] += 1
    found = Counter(
        (r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to,
         None if r.payload is None else bytes(r.payload))
        for r in back.collect()
    )
    assert found == expected
    empty = warc.archive_pages(pages.where("false"), str(tmp_path / "none"))
    assert empty.isEmpty()


def test_an_archive_starts_with_its_dictionary_and_shows_damage():
    records = [
        warc.record_bytes(i, "http://x/\r\nInjected: 1", b"<p>%d</p>" % i * 50, hashlib.sha1(b"<p>%d</p>" % i * 50).hexdigest(), None, "2024-01-01T00:00:00Z")
        for i in range(300)
    ]
    archive = b"".join(warc.archive_frames(records))
    assert archive[:4] == (0x184D2A5D).to_bytes(4, "little")
    assert list(warc.records_of(archive)) == records
    assert len(archive) < sum(map(len, records)) / 3
    assert warc.parse_record(records[3]).url == "http://x/%0D%0AInjected:%201"
    with pytest.raises(ValueError, match="damaged"):
        warc.parse_record(records[3].replace(b"<p>3", b"<p>4"))
    for few in (records[:1], records[:2]):
        assert list(warc.records_of(b"".join(warc.archive_frames(few)))) == few


def test_main_text(spark, pages):
    found = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_text.extract_text(pages).collect()}
    for i, text in enumerate(TEXT):
        assert found[i, f"http://h{i % 3}.example.com/a/{i}"] == (text, len(text)), i
    assert found[7, None] == found[None, "no scheme"] == (TEXT[0], len(TEXT[0]))
    assert html_text.extract_text(pages).count() == pages.count()
    assert html_text.extract_text(pages.where("false")).isEmpty()


def test_main_text_of_the_table(spark):
    """Against the plain shape of the benchmark pages: one article, no nesting."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    for r in pages.join(html_text.extract_text(pages), "page_id").collect():
        article = re.search(r"(?s)<article>(.*)</article>", r.html).group(1)
        blocks = [
            " ".join(unescape(re.sub(r"<[^>]*>", " " if "<br" in x else "", x)).split())
            for x in re.split(r"</?(?:p|h1)>", article)
        ]
        assert r.text == "\n".join(b for b in blocks if b)


def test_pages_without_a_region_lose_what_they_share(spark):
    def page(i):
        return f"<div>Menu one</div><div>Log in</div><div>Story {i} begins</div><p>and ends {i}</p><div>Terms</div>"

    data = [(i, f"http://a.com/{'x' if i < 4 else 'y'}/{i}", page(i)) for i in range(8)]
    # A large group of copies is one content: it has the next page as its partner.
    data += [(100 + i, f"http://b.com/{i}", page(9)) for i in range(40)] + [(200, "http://b.com/z", page(3))]
    data += [(300, "http://alone.com/", page(5)), (301, "http://marked.com/1", "<article>" + page(1) + "</article>")]
    df = spark.createDataFrame(data, "page_id int, url string, html string").repartition(5)
    found = {r.page_id: r.text for r in html_text.extract_text(df).collect()}
    for i in range(8):
        assert found[i] == f"Story {i} begins\nand ends {i}"
    assert {found[100 + i] for i in range(40)} == {"Story 9 begins\nand ends 9"}
    assert found[300].startswith("Menu one") and found[301].startswith("Menu one")


def test_a_region_that_pages_repeat_is_no_main_text(spark):
    box = "<article><p>See our offers</p><p>of this week</p></article>"

    def page(i):
        return f"<div>Menu one</div>{box}<div>Story {i} begins here and goes on for a while</div><p>and ends {i}</p>"

    def article(i):
        return f"<div>Menu one</div><article><p>Passage that all have</p><p>Own {i}</p></article><div>Open line {i} " + "x" * 90 + "</div>"

    data = [(i, f"http://a.com/{i}", page(i)) for i in range(6)]
    data += [(10 + i, f"http://b.com/{i}", article(i)) for i in range(6)]
    data += [(20, "http://alone.com/", page(20))]
    df = spark.createDataFrame(data, "page_id int, url string, html string").repartition(4)
    found = {r.page_id: r.text for r in html_text.extract_text(df).collect()}
    for i in range(6):
        assert found[i] == f"Story {i} begins here and goes on for a while\nand ends {i}"
        # A region with a line of its own stands, with the passage that it shares.
        assert found[10 + i] == f"Passage that all have\nOwn {i}"
    assert found[20] == "See our offers\nof this week"


def test_common_subsequence_against_a_table():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in (0, 1))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found = html_text.common_lines(np.array(a, np.int64), np.array(b, np.int64))
        assert len(found) == table[-1][-1] and found == sorted(set(found))
        rest = iter(b)
        assert all(a[i] in rest for i in found)


@pytest.mark.parametrize("attributes,chrome", [
    ('style="overflow:hidden"', False), ("href='/hidden/gems'", False), ('title="hidden costs"', False),
    ("href=/p?class=ad", False), ('data-id="share"', False), ('href="/p?id=search"', False),
    ('title="a role=search b"', False), ('aria-hidden="false"', False), ("data-hidden", False),
    ("hidden", True), ('style="x"hidden', True), ("/hidden", True), ("HIDDEN=''", True),
    ('aria-hidden = "true"', True), ("title='x' ID=share", True), ("class = 'big ad-box'", True),
    ('title="id=x" role="search"', True),
])
def test_only_whole_attributes_make_chrome(attributes, chrome):
    lines = html_text.page_lines(f"<article><p>a</p><div {attributes}>b</div><p>c</p></article>")
    assert html_text.main_lines(lines) == (["a", "c"] if chrome else ["a", "b", "c"])


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(200)]
    edges += [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    assert rows(connected_components(df)) == sorted(((x, find(x)) for x in parent), key=repr)
    assert connected_components(df.where("false")).isEmpty()


def test_linkage_closes_groups_that_no_star_closes(spark, monkeypatch):
    """Numbers link if they are at most 2 apart; all of them share one signature."""
    monkeypatch.setattr(linkage, "BLOCK", 8)
    rng = random.Random(8)
    numbers = sorted(rng.sample(range(900), 300))
    signatures = spark.createDataFrame([(1, n) for n in numbers] + [(2, n) for n in numbers[::3]] + [(3, 5000)], "key bigint, node bigint")
    items = spark.createDataFrame([(n, n, [0]) for n in [*numbers, 5000]], "node bigint, size bigint, sketch array<bigint>")
    found = linkage.linked_components(
        signatures, items,
        lambda a, b: F.expr(f"abs({a}_size - {b}_size) <= 3"),
        lambda size, sketch, sizes, sketches: np.abs(size - sizes) <= 3,
        lambda pairs: pairs.where("abs(a - b) <= 2"),
    )
    expected, start = {}, None
    for before, n, after in zip([None, *numbers], numbers, [*numbers[1:], None]):
        if before is None or n - before > 2:
            start = n
        if start != n or (after is not None and after - n <= 2):
            expected[n] = start
    assert dict(map(tuple, found.collect())) == expected


def test_pairs_of_a_hot_item_are_spread(spark):
    pairs = spark.createDataFrame([(1, i) for i in range(2, 2000)] + [(2, 3)], "a bigint, b bigint")
    payloads = spark.createDataFrame([(i, str(i).encode()) for i in range(2000)], "node bigint, payload binary")

    def compare(mine, others):
        return np.array([len(o) == len(mine) for o in others])

    found = rows(linking_pairs(pairs, payloads, compare))
    assert found == sorted([(1, i) for i in range(2, 10)] + [(2, 3)], key=repr)
    assert linking_pairs(pairs.where("false"), payloads, compare).isEmpty()


def _main_text(html):
    return html_text.main_lines(html_text.page_lines(html))


@pytest.mark.parametrize(
    "inside, expected",
    [
        # A quote after a value starts a name; after one never closed, tags end at the first bracket.
        ('<p>one <a href="x"">two</a> three <b class="y">four</b></p>', ["one two three four"]),
        ('<p>one</p><p><a title="x>two</p><p>three</p>', ["one", "two", "three"]),
        ('<p>one</p><p>two <a title="x>y</a> z" href=q>three</a></p>', ["one", "two three"]),
        ("<p>one <a href=it's>two</a> <b>it's</b></p>", ["one two it's"]),
        ("<p>a < b, b <3 c <> d</p>", ["a < b, b <3 c <> d"]),
        ("<p>one<!-->two<!-- x > y -->three</p>", ["onetwothree"]),
        ('<script a=">">x</script><p>one</p><script>if (a</b/) "</p>"</script >', ["one"]),
        ("<p>one <svg/> two</p>", ["one two"]),
        ('<div class="entry-header"><h1>Title</h1></div><p>x</p>', ["Title", "x"]),
        ('<p class="search-results">one</p><p id="social">two</p>', ["one", "two"]),
        ('<div class="share-price">one</div><h2 id="comments">two</h2>', ["one", "two"]),
        ('<div class="site-header">no</div><p>x</p><div class="comment-list">no</div>', ["x"]),
        ('<div id="comments">no</div><p>x</p><div class="c-ad ad-1">no</div>', ["x"]),
        ('<ul><li class="ad"><p>no<li>yes</ul>', ["yes"]),
    ],
)
def test_markup_of_all_kinds(inside, expected):
    assert _main_text(f"<body><article>{inside}</article></body>")[: len(expected)] == expected
    assert not any("no" == t or "<a" in t for t in _main_text(f"<body><article>{inside}</article></body>"))


def test_teasers_are_no_main_region():
    body = "<div><p>" + "The text of the page itself. " * 20 + "</p></div>"
    teasers = "".join(f"<article><p>teaser {i}</p></article>" for i in range(3))
    assert not html_text.has_region(html_text.page_lines(body + teasers))
    assert any(line.startswith("The text") for line in _main_text(body + teasers))
    # Articles that hold the text, and any main, stay regions.
    parts = "<article><p>" + "One part of several. " * 9 + "</p></article>"
    assert len(_main_text("<p>around</p>" + parts * 2)) == 2
    assert _main_text(f"<main><p>x</p></main>{body}{teasers}")[0] == "x"


@pytest.mark.parametrize(
    "piece", ['<a "', "<a '", '<a b="', "<", "<!--", "</", "<b>", "</b>", "<i><div></i>", "<p>", "<li>",
              "<script>", "<a =", "<a b= ", "<article>", "&amp"],
)
def test_broken_markup_costs_no_more_than_its_length(piece):
    page = "<article><p>text</p>" + piece * (1_000_000 // len(piece))
    start = time.process_time()
    assert _main_text(page)[0].startswith("text")
    small = "<article><p>text</p>" + piece * (250_000 // len(piece))
    spent = time.process_time() - start
    start = time.process_time()
    _main_text(small)
    assert spent < 1 or spent < 8 * (time.process_time() - start)
