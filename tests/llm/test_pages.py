"""Main text, WARC derivatives, URL filter and language evidence on small pages."""

import gzip
import hashlib
import itertools
import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shopstream.llm import language_id, url_filter, warc
from shopstream.llm.main_text import extract_main_text, main_text

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head>
<body><header><h2>Site</h2></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- <p>comment</p> -->
<div class="ad">Buy this now, really, a very long advert text that goes on and on and on and on and on.</div>
<article><h1>Title &lt;1&gt;</h1><p><b>First  line<br><p>Second&nbsp;line &amp; more</p><p></p><aside>Side bar</aside><p>x</p>
<form><input value="q"><p>form text</p></form><div class="comments"><article><p>Reader says</p></article></div><p class="notice">Cookies!<p>Last.</p></article>
<footer>&copy; foot</footer></body></html>"""


def test_article_without_its_surroundings():
    assert main_text(PAGE) == "Title <1>\nFirst line\nSecond line & more\nx\nLast."


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("   ", ""), ("<p>", ""), ("plain text only", "plain text only"), ("<p>short</p>", "short"),
    ("<article>", ""), ("<article><p>cut off &am", "cut off &am"), ("<article><p>a</p><script>never ends", "a"),
    ("<nav>menu <article>text</article>", "text"), ("<article>a<!-- open", "a"), ("<article>1 < 2 <b", "1 < 2"),
    ("<article><p title='a>b'>quoted</p>", "quoted"), ('<article><p title="open>unbalanced</p>', "unbalanced"),
])
def test_odd_pages(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("open_tag", [
    '<div class="content has-sidebar">', '<div id="main" class="with-comments">', '<div class="no-ads tag-notice">',
    '<article class="post comments-open">', '<article class="post category-notice">', '<article class="notice">',
    '<main class="sidebar">', '<main><article class="post comments-open">'])
def test_wrappers_named_after_other_parts_keep_their_text(open_tag):
    long = ("words " * 30).strip()
    names = [t.split()[0].strip("<>") for t in open_tag.split("><")]
    page = (f"<body>{open_tag}<p>{long}</p><div class='sidebar'>{long} aside</div><article class='comment-body'><p>reader</p></article>"
            if names[0] != "div" else f"<body>{open_tag}<p>{long}</p><div class='sidebar'>{long} aside</div>")
    assert main_text(page + "".join(f"</{n}>" for n in reversed(names))) == long


def test_line_blocks_without_article_marks():
    long = "words " * 30
    page = ("<body><ul>" + "<li><a href=/>link text here</a></li>" * 9 + f"</ul><div>{long}</div><p>short one</p><p>{long}</p>"
            + "<ul>" + "<li><a href=/>more links</a></li>" * 9 + "</ul><p>tail</p>")
    assert main_text(page) == "\n".join([long.strip(), "short one", long.strip()])


def test_extraction_of_rows(spark):
    rows = [(1, "u", PAGE), (2, None, None), (1, "u", PAGE), (3, "v", "<article>" + "<p>é x</p>" * 5000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' AS text", "1 AS n_chars", "9 AS other")
    got = extract_main_text(df).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) and r["other"] == 9 for r in got)
    assert {r["page_id"]: r["n_chars"] for r in got}[3] == 5000 * 4 - 1
    assert extract_main_text(df.limit(0)).collect() == []


def response(body: bytes, extra: str = "") -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{extra}\r\n".encode() + body


def test_derived_records_are_linked_and_digested(spark):
    blocks = [response(PAGE.encode()), response(gzip.compress(PAGE.encode()), "Content-Encoding: gzip\r\n"),
              response(b"5\r\n<p>ab\r\n3\r\ncd \r\n0\r\n\r\n", "Transfer-Encoding: chunked\r\n"), b"", None, b"\xff\xfe no http",
              response("é".encode("latin-1")).replace(b"utf-8", b"latin-1")]
    rows = [(f"<urn:uuid:{i}>", f"http://h/{i}", "2024-05-05T00:00:00Z", {"WARC-Type": "response", "X": str(i)}, b) for i, b in enumerate(blocks)]
    df = spark.createDataFrame(rows, "record_id string, target_uri string, date string, headers map<string,string>, block binary")
    got = warc.derived(df).collect()
    assert len(got) == 2 * len(blocks)
    for r in got:
        i = int(r["target_uri"].rsplit("/", 1)[1])
        other = next(x for x in got if x["record_id"] == r["concurrent_to"])
        assert r["refers_to"] == f"<urn:uuid:{i}>" == other["refers_to"] and other["concurrent_to"] == r["record_id"]
        raw = r["block"].encode()
        assert r["content_length"] == len(raw) and r["block_digest"] == warc.digest(raw)
        assert r["source_headers"] == {"WARC-Type": "response", "X": str(i)} and r["date"] == "2024-05-05T00:00:00Z"
        assert r["source_block_digest"] == warc.digest(blocks[i] or b"")
    text = {r["target_uri"][-1]: r["block"] for r in got if r["record_type"] == "conversion"}
    assert text["0"] == text["1"] and "Second line & more" in text["0"] and "var a" not in text["0"]
    assert text["2"] == "abcd" and text["3"] == text["4"] == "" and text["6"] == "é"
    meta = json.loads(next(r["block"] for r in got if r["record_type"] == "metadata" and r["target_uri"][-1] == "0"))
    html_meta = meta["HTTP-Response-Metadata"]["HTML-Metadata"]
    assert html_meta["Title"] == "T & t" and html_meta["Links"][0] == {"path": "A@/href", "url": "/x"}
    assert meta["WARC-Header-Metadata"]["X"] == "0"


def test_records_survive_a_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/é", PAGE), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    records = warc.derived(warc.responses_of(pages), ["page_id"])
    members = warc.warc_members(records).collect()
    want = {(r["record_id"], r["refers_to"], r["block_digest"], r["block"]) for r in records.collect()}
    data = b"".join(bytes(m["member"]) for m in members)
    got = {(h["WARC-Record-ID"], h["WARC-Refers-To"], h["WARC-Block-Digest"], b.decode()) for h, b in warc.parsed_records(data)}
    assert got == want and len(members) == 6
    # responses written as a file are read back and give the same derivatives
    out = b""
    for r in warc.responses_of(pages).collect():
        head = "\r\n".join([warc.VERSION, *(f"{k}: {v}" for k, v in r["headers"].items())]).encode()
        out += gzip.compress(head + b"\r\n\r\n" + bytes(r["block"]) + b"\r\n\r\n")
    (tmp_path / "x.warc.gz").write_bytes(out)
    back = warc.derived(warc.read_responses(spark, str(tmp_path))).collect()
    assert {(r["record_id"], r["block"]) for r in back} == {(r["record_id"], r["block"]) for r in records.collect()}


def test_digests_are_sha1_in_base32():
    import base64
    assert warc.digest(b"x") == "sha1:" + base64.b32encode(hashlib.sha1(b"x").digest()).decode()


URLS = ["http://Blog.Example.NET/en/1?x", "https://example.net/en", "http://net", "http://net/", "ftp://a.b.example.com/de/",
        "http://xexample.com/de/", "http://a.org/fr/#f", "http://a.org?/fr/", "no scheme", None, "", "http://", "x://h:80/p?q#r", "http://foo.net//en/"]


def test_host_path_and_rules(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    host, path = url_filter.url_parts(df["url"])
    rule, verdict = url_filter.rule_of(host, path)
    got = [tuple(r)[1:] for r in df.select("page_id", host.alias("h"), path.alias("p"), rule.alias("r"), verdict.alias("v")).orderBy("page_id").collect()]
    assert got == [
        ("blog.example.net", "/en/1", "example.net/en/", "allow"), ("example.net", "/en", "net/", "block"), ("net", "", None, None),
        ("net", "/", "net/", "block"), ("a.b.example.com", "/de/", "example.com/de/", "block"), ("xexample.com", "/de/", None, None),
        ("a.org", "/fr/", "org/fr/", "allow"), ("a.org", "", None, None), ("", "", None, None), ("", "", None, None), ("", "", None, None),
        ("", "", None, None), ("h:80", "/p", None, None), ("foo.net", "//en/", "net/", "block")]


def test_viterbi_is_the_best_split():
    counts = {"cheap": 50, "pills": 30, "pill": 60, "s": 5, "che": 2, "ap": 9, "news": 80, "new": 90, "sroom": 1, "room": 70}
    total = 1000
    for name in ("cheappills", "newsroom", "xyz", "cheapnews", "a"):
        known = {(i, j): counts[name[i:j]] for i in range(len(name)) for j in range(i + 1, len(name) + 1) if name[i:j] in counts}
        got = url_filter.split_name(name, known, total)
        cost = lambda ws: sum(math.log(counts[w] / total) if w in counts else math.log(10 / total) - len(w) * math.log(10) for w in ws)
        every = [[name[a:b] for a, b in itertools.pairwise((0, *cut, len(name)))]
                 for k in range(len(name)) for cut in itertools.combinations(range(1, len(name)), k)]
        assert "".join(got) == name and cost(got) == pytest.approx(max(map(cost, every)))
    assert url_filter.split_name("cheappills", {(0, 5): 50, (5, 10): 30}, total) == ["cheap", "pills"]


def test_url_verdicts(spark):
    rows = [(i, f"http://{h}.{d}/{p}") for i, (h, d, p) in enumerate(itertools.product(
        ("cheappills", "freecasino", "gardennews", "newsroom"), ("example.org", "example.com", "example.net"), ("en/1", "de/2", "fr/3")))]
    rows += [(100 + i, u) for i, u in enumerate(URLS)] + [(0, rows[0][1])]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' AS verdict", "1 AS host")
    counts = url_filter.unigrams(spark.createDataFrame([("<p>Cheap pills free casino garden news room cheap free news</p>",), (None,)], "html string"), "html")
    got = url_filter.judged(pages, counts).collect()
    assert len(got) == len(rows)
    by = {r["url"]: r for r in got}
    assert by["http://cheappills.example.org/en/1"]["host_words"] == ["cheap", "pills"]
    assert by["http://cheappills.example.org/en/1"]["verdict"] == by["http://freecasino.example.com/en/1"]["verdict"] == "block"
    assert by["http://gardennews.example.org/en/1"]["verdict"] == "allow" == by["http://cheappills.example.org/fr/3"]["verdict"]
    assert by[None]["verdict"] == by["no scheme"]["verdict"] == "allow"
    assert url_filter.judged(pages.limit(0), counts).collect() == []


def test_url_odds_equal_a_plain_multinomial_model(spark):
    """Odds by plain counters: learning once per host, class and token; scoring as often as a token occurs."""
    names = ("cheappills", "pillspills", "casinonews", "gardennews", "newsnews", "room")
    urls = [f"http://{h}.{d}/{lang}/{p}" for h in names for d in ("example.org", "example.com", "example.net")
            for lang in ("en", "de", "fr", "es") for p in ("sale/sale/7", "garden", "12", "a" * 5000 + "/x")]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    text = "<p>cheap pills pills casino garden news news room example org com net</p>"
    counts = url_filter.unigrams(spark.createDataFrame([(text,)], "html string"), "html")
    split = {"cheappills": ["cheap", "pills"], "pillspills": ["pills", "pills"], "casinonews": ["casino", "news"],
             "gardennews": ["garden", "news"], "newsnews": ["news", "news"], "room": ["room"]}

    def tokens(url):
        host, _, path = url.split("://")[1].partition("/")
        behind = path.split("/")[1:]
        return split[host.split(".")[0]], [s for s in behind if any(c.isalpha() for c in s)]

    got = {r["url"]: r for r in url_filter.judged(pages, counts).collect()}
    assert len(got) == len(urls)
    seen = set()
    for u, r in got.items():
        words, path = tokens(u)
        assert r["host_words"] == sorted(words)
        cls = "block" if set(words) & set(url_filter.SEED_WORDS) else r["verdict"] if r["by_rule"] else None
        seen |= {(cls, r["host"], t) for t in words + path if cls}
    n = {c: Counter(t for k, _, t in seen if k == c) for c in ("block", "allow")}
    v = len(set(n["block"]) | set(n["allow"]))
    p = lambda c, t: math.log((n[c][t] + 1) / (sum(n[c].values()) + v + 1))     # noqa: E731
    known = set(n["block"]) | set(n["allow"])
    for u, r in got.items():
        words, path = tokens(u)
        want = sum(p("block", t) - p("allow", t) for t in words + path if t in known)
        assert r["log_odds"] == pytest.approx(want, abs=1e-6)
    # the language in a path decides nothing beside the rules
    for lang in ("en", "de", "fr"):
        for u in (u for u in urls if "/es/" in u):
            assert got[u]["log_odds"] == got[u.replace("/es/", f"/{lang}/")]["log_odds"]


def test_language_evidence(spark):
    from cases import DOCUMENTS
    rows = [(i, t, l, s, 0) for i, (t, l, s) in enumerate([
        *[("the cat and the dog are in the house with that thing " + str(i), "en-GB", "a.uk") for i in range(20)],
        *[("der hund und die katze sind nicht in dem haus mit ding " + str(i), "DE", "b.de") for i in range(20)],
        ("der hund und die katze", "en", "b.de"), ("in", "de", "b.de"), ("in", "en", "a.uk"), ("in", None, "b.de"), ("haus", "xx", None),
        ("", "en", "a.uk"), (None, "de", "b.de"), ("123 *** !!", "en", "a.uk"), ("qxzj vkwq zzxq jjqx wvkz qqxj zxvw kqjz" * 20, "en", "a.uk")])]
    df = spark.createDataFrame(rows, DOCUMENTS).selectExpr("*", "1 AS confidence")
    model = language_id.train(df.filter("doc_id < 40").selectExpr("repeat(text, 60) AS text", "lang"))
    assert model.languages == ["de", "en"]
    got = language_id.identified(df, model, "text", F.col("lang"), F.col("source"), language_id.suffix_of(F.col("source"))).orderBy("doc_id").collect()
    assert [r["lang_id"] for r in got] == ["en"] * 20 + ["de"] * 20 + ["de", "de", "en", "de", "de", "und", "und", "und", "und"]
    assert [r["rejected"] for r in got] == [False] * 45 + [True] * 4
    none = language_id.train(df.filter("lang IS NULL"))
    assert {r["lang_id"] for r in language_id.identified(df, none, "text", F.col("lang"), F.col("source"), F.col("source")).collect()} == {"und"}
    assert language_id.identified(df.limit(0), model, "text", F.col("lang"), F.col("source"), F.col("source")).collect() == []


def chunked(*parts: bytes) -> bytes:
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


@pytest.mark.parametrize("body,payload", [
    (chunked(b"<p>one", b" two</p>"), b"<p>one two</p>"),
    (b"6;x=y\n<p>one\n4\n two\n0\n\n", b"<p>one two"),
    (b"<p>plain, only labelled chunked</p>", b"<p>plain, only labelled chunked</p>"),
    (b"6\r\n<p>one\r\nBROKEN\r\nrest</p>", b"<p>oneBROKEN\r\nrest</p>"),
    (b"ffff\r\ncut off", b"cut off"),
    (b"", b""),
])
def test_chunked_bodies_lose_nothing(body, payload):
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    assert warc.http_parts(head + body)[2] == payload


def test_bare_line_feeds_and_missing_heads():
    assert warc.http_parts(b"HTTP/1.0 200 OK\nContent-Type: text/html\n\n<p>x\r\n\r\ny") == (
        "HTTP/1.0 200 OK", {"Content-Type": "text/html"}, b"<p>x\r\n\r\ny")
    assert warc.http_parts(b"<p>no head") == ("", {}, b"<p>no head")
    assert warc.http_parts(b"HTTP/1.0 204 No") == ("HTTP/1.0 204 No", {}, b"")


def test_payload_digest_is_of_the_transferred_payload():
    packed = gzip.compress(b"<title>T</title><p>text</p>", mtime=0)
    for body, text in ((packed, "text"), (packed[:-12], None), (b"<p>not packed</p>", "not packed")):
        rows = warc.derivatives("id", "u", "d", {}, b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + body)
        names = [x.split()[0] for x in warc.RECORD.split(", ")]
        got = [dict(zip(names, r)) for r in rows]
        assert all(r["payload_digest"] == warc.digest(body) for r in got)
        assert text is None or text in got[1]["block"]


def test_damaged_files_keep_earlier_records():
    records = [b"WARC/1.1\r\nWARC-Record-ID: %d\r\nContent-Length: 300000\r\n\r\n" % i + bytes(str(i), "ascii") * 300000 + b"\r\n\r\n" for i in range(4)]
    members = [gzip.compress(r, 1, mtime=0) for r in records]
    whole = b"".join(members)
    assert [len(b) for _, b in warc.parsed_records(whole)] == [300000] * 4
    assert [len(b) for _, b in warc.parsed_records(whole[:-len(members[-1])] + members[-1][:40])][:3] == [300000] * 3
    broken = whole[:len(members[0])] + b"\x1f\x8bgarbage" + whole[len(members[0]):]
    assert [h["WARC-Record-ID"] for h, _ in warc.parsed_records(broken)] == ["0"]
    cut = b"".join(records)[:-200000]
    fields, block = list(warc.parsed_records(cut))[-1]
    assert fields["WARC-Truncated"] == "unspecified" and len(block) < 300000
    assert list(warc.parsed_records(b"WARC/1.1\nContent-Length: x\n\nWARC/1.1\nContent-Length: 2\n\nab"))[1][1] == b"ab"


def test_kept_columns_named_like_fields_give_way(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x")], "page_id long, url string, html string")
    got = warc.derived(warc.responses_of(pages), ["page_id", "date", "record_id"])
    assert got.columns.count("date") == 1 and got.columns.count("record_id") == 1 and got.count() == 2
    assert warc.derived(warc.responses_of(pages.limit(0)), ["page_id"]).count() == 0


@pytest.mark.parametrize("partitions", [1, 6])
def test_more_declared_languages_than_a_model_has(spark, monkeypatch, partitions):
    monkeypatch.setattr(language_id, "LANGUAGES", 2)
    rows = [("the cat and the dog", "en")] * 5 + [("le chat et le chien", "fr")] * 4 + [("der hund", "de")] * 3 + [("x", f"a{c}") for c in "bcdef"]
    rows += [("word " * 30_000, "en"), (None, "en"), ("", None), ("text", "no tag at all")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(partitions)
    model = language_id.train(docs)
    assert model.languages == ["en", "fr"]
    out = language_id.identified(docs, model, "text", F.col("lang"), F.lit("host"), F.lit("suffix")).collect()
    assert len(out) == len(rows) and {r["lang_id"] for r in out} <= {"en", "fr", "und"}
