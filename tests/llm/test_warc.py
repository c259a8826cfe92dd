"""Plain text of pages whose end tags are missing."""

import base64
import collections
import encodings.aliases
import hashlib
import html
import random

from sievework.llm.warc import ENCODINGS, charset, derivatives, derived, links, plain_text, response_block, title


def test_head_without_end_tag():
    assert plain_text("<head><title>t</title><body><p>text") == "text"
    assert plain_text("<html><head><meta charset=utf-8><style>p{}</style><p>one<p>two") == "one\ntwo"
    assert plain_text("<head><title>t</title><link rel=x></head><body>text</body>") == "text"


def test_only_raw_text_runs_to_the_end():
    for tag in ("noscript", "template", "svg"):
        assert plain_text(f"<p>a</p><{tag}><p>b</p>") == "a\nb"
        assert plain_text(f"<p>a</p><{tag}>gone</{tag}><p>b</p>") == "a\nb"
    assert plain_text("<svg/><p>a</p><svg><path/></svg><p>b</p>") == "a\nb"
    for tag in ("script", "style", "title"):
        assert plain_text(f"<p>a</p><{tag}>x <p>y</p>") == "a"


def test_record_has_the_text():
    block = b"HTTP/1.1 200 OK\r\n\r\n<head><title>t</title><body><p>text"
    assert derived("<urn:a>", None, None, block)[1]["block"] == b"text"


def test_unclosed_elements_of_long_pages():
    assert plain_text("<p>if a < b then</p><svg><path></p><p>after</p>") == "if a < b then\nafter"
    assert plain_text("<html><head><title>x</title><body><p>hello world</p>") == "hello world"
    assert plain_text("<svg>a" * 50_000).count("a") == 50_000
    assert plain_text("<!--a" * 50_000 + "-->b") == "b" and plain_text("x<!-- y") == "x"
    assert plain_text("<a" * 50_000) == "<a" * 50_000
    late = f"<p>{'x' * 9000}<meta charset=latin-1>".encode() + b"\xe9"
    assert charset([], late) == "latin-1" and charset([("Content-Type", "text/html; charset=utf-8")], late) == "utf-8"
    assert links("<a x='1' href='u'>t</a><a data-href='no'><a href=v>" + "<a x " * 50_000) == ["u", "v"]


def test_repeated_rows_and_clashing_columns(spark):
    page = response_block("<title>T</title><p>text")
    rows = [("<urn:1>", "u", "d", page, "mine")] * 2 + [(None, None, None, None, None), ("<urn:2>", "u", "d", b"no header", "x")]
    docs = spark.createDataFrame(rows, "record_id string, target_uri string, date string, block binary, headers string")
    found = derivatives(docs).collect()
    assert len(found) == 8 and collections.Counter(r["record_type"] for r in found) == {"metadata": 4, "conversion": 4}
    same = [r for r in found if r["refers_to"] == "<urn:1>"]
    assert len(same) == 4 and len({r["record_id"] for r in same}) == 2
    by_id = {r["record_id"]: r for r in found}
    assert all(by_id[r["concurrent_to"]]["concurrent_to"] == r["record_id"] for r in found)
    for r in found:
        assert r["block_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(r["block"]).digest()).decode() and r["content_length"] == len(r["block"])
    clash = derivatives(docs.withColumnRenamed("headers", "block_digest"), keep=("block_digest",))
    assert clash.columns.count("block_digest") == 1 and clash.count() == 8


def test_every_codec_name_and_random_bytes():
    """Codecs that are no page's, that decode to surrogates or not to text, or that don't exist: none stops a page."""
    r = random.Random(1)
    names = {*encodings.aliases.aliases, *encodings.aliases.aliases.values(), "idna", "punycode", "utf-7", "unicode_escape", "raw_unicode_escape", "undefined", "mbcs", "no-such", "utf-8", "..", "latin-1"}
    for name in sorted(names):
        for where in ("header", "meta"):
            body = b"<p>a+2AA-\\ud800 \xe9" + r.randbytes(60)
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={name}\r\n\r\n" if where == "header" else "HTTP/1.1 200 OK\r\n\r\n"
            block = head.encode() + (b"" if where == "header" else f"<meta charset={name}>".encode()) + body
            for record in derived("<urn:a>", None, None, block):
                record["block"].decode("utf-8")
    assert charset([("content-type", "text/html; charset=idna")], b"") == "utf-8" and charset([("content-type", "x; charset=Windows-1252")], b"") == "Windows-1252"
    assert {"utf-8", "cp1252", "shift_jis"} <= ENCODINGS and not {"utf-7", "idna", "rot13"} & ENCODINGS


def test_quoted_ends_of_tags():
    assert plain_text('<p title="a > b">hello</p>') == "hello" and plain_text('<img alt="1>0">t') == "t"
    assert plain_text("<p title=it's>a</p><p>b's</p>") == "a\nb's" and plain_text('<p title="x>a</p>') == "a"
    assert links('<a title="x>y" href="u">t</a>') == ["u"] and title('<title lang="a>b">T</title>') == "T"
    assert plain_text('<p a="' * 50_000 + ">").count("p") < 50_001


def brute_text(page):
    """Letter by letter; hidden elements are closed."""
    out, at, hidden = [], 0, None
    while at < len(page):
        if page.startswith("<!--", at) and not hidden:
            at = page.index("-->", at) + 3
            out.append(" ")
            continue
        if page[at] != "<" or not (page[at + 1].isalpha() or page[at + 1] == "/"):
            out += [] if hidden else [page[at]]
            at += 1
            continue
        end, quote = at, None
        while quote or page[end] != ">":
            if quote:
                quote = None if page[end] == quote else quote
            elif page[end] in "\"'" and page[end - 1] == "=":
                quote = page[end]
            end += 1
        name = page[at + 1 : end].split(" ")[0].lower()
        if hidden:
            if name == "/" + hidden:
                hidden = None
                out.append(" ")
        elif name in ("script", "style", "svg"):
            hidden = name
        elif name.strip("/") in ("p", "div", "br", "li"):
            out.append("\n")
        at = end + 1
    return "\n".join(x for line in "".join(out).split("\n") if (x := " ".join(html.unescape(line).split())))


def test_text_by_brute_force():
    r = random.Random(2)
    pieces = ["one", " ", "&amp;", "a < b", "it's", "\n", "<p>", "</p>", "<br/>", "<b>", "</b>", '<p title="x > y">', "<i a='>' b=2>", "<DIV class=c>", "</div>", "<!-- c > d -->", "<script>if (a > b) '<p>'</script>", '<style type="a>b">p{}</style>', "<svg><p>gone</p></svg>", "<li>", "&#x41;"]
    for _ in range(3000):
        page = "".join(r.choice(pieces) for _ in range(r.randint(0, 25)))
        assert plain_text(page) == brute_text(page), page
