"""What alignment takes for a host's template, and what it leaves as text."""



from sievework.llm import wrappers as W

WORDS = "alder birch cedar dogwood elm fir gorse hazel ivy juniper kelp larch maple nettle oak pine".split()


def words(i, n=12):
    return " ".join(WORDS[(i * 7 + j * (i + 3)) % 16] + str(i) for j in range(n))


def wrapper(pages):
    trees = [W.parsed(p) for p in pages]
    return W.read(W.written(W.inferred([W.form_of(t, W.likeness(t)) for t in trees])))


def texts(pages):
    found = wrapper(pages)
    return [W.main_text(p, found) for p in pages]


NOTICED = [f'<body><article><h1>{words(i, 3)}</h1><div class="x1">We moved</div><p>{words(i)}</p><h2>Abstract</h2><p>{words(i + 20)}</p></article>' for i in range(5)]


def test_text_of_all_pages_is_the_template():
    assert texts(NOTICED) == [f"{words(i, 3)} {words(i)} Abstract {words(i + 20)}" for i in range(5)]


def test_the_wrapper_decides():
    other = wrapper([p.replace("We moved", f"Note {i}") for i, p in enumerate(NOTICED)])
    assert "We moved" in W.main_text(NOTICED[0], other)
    assert "We moved" in W.main_text(NOTICED[0], ["e", "", []])
    assert "We moved" not in W.main_text(NOTICED[0], wrapper(NOTICED))


def test_optional_forms_give_way():
    form = ["e", "", [["?", ["e", "p", [W.TEXT]]], ["?", ["e", "h1", [W.TEXT]]], ["e", "p", [W.TEXT]]]]
    assert [t for _, t, _ in W.matched(form, W.parsed("<p>a</p>"))] == ["a"]
    assert [t for _, t, _ in W.matched(form, W.parsed("<p>a</p><h1>b</h1><p>c</p>"))] == ["a", "b", "c"]
    assert W.matched(form, W.parsed("<h1>b</h1>")) is None


def test_order_and_number_of_pages_do_not_count():
    assert wrapper(NOTICED) == wrapper(NOTICED[::-1]) == wrapper(NOTICED * 3)


def test_spark_gives_the_same(spark):
    rows = [(i, "http://h.example/", p) for i, p in enumerate(NOTICED)]
    found = W.extracted(spark.createDataFrame(rows, "page_id int, url string, html string").repartition(3)).orderBy("page_id").collect()
    assert [r["text"] for r in found] == texts(NOTICED)
    assert [r["n_chars"] for r in found] == [len(x) for x in texts(NOTICED)]


def test_copies_on_a_small_host_stay_whole(spark):
    copy = f"<body><div><p>{words(1, 4)}</p></div><div>{words(2, 4)}</div>"
    others = [f"<body><div><p>{words(i, 4)}</p></div><div>{words(i + 9, 4)}</div>" for i in (3, 4)]
    whole = f"{words(1, 4)} {words(2, 4)}"
    assert texts([copy] * 3) == [whole] * 3
    assert texts([copy] * 3 + others)[:3] == [whole] * 3
    rows = [(i, "http://h.example/", copy) for i in range(3)]
    assert [r["text"] for r in W.extracted(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()] == [whole] * 3


def test_long_template_text_of_two_pages_goes():
    long = "This site was moved to a new place. " * 8
    pages = [f"<body><div><div>{long}</div><h1>{words(i, 3)}</h1><p>{words(i, 60)}</p><h2>Ingredients</h2><p>{words(i + 9)}</p></div>" for i in (1, 2)]
    assert texts(pages) == [f"{words(i, 3)} {words(i, 60)} Ingredients {words(i + 9)}" for i in (1, 2)]


def test_near_copies_are_like_each_other():
    a, b = (f"<body><div>{words(1, 200)}</div><div>{x} at last</div>" for x in ("one", "two"))
    assert texts([a, b]) == [f"{words(1, 200)} one at last", f"{words(1, 200)} two at last"]


def test_deep_long_and_unclosed_pages():
    for page, text in (
        ("<div>x" * 5000, " ".join("x" * 5000)),
        ("<article><div class='post'>x" * 3000, " ".join("x" * 3000)),
        ("<option>a" * 100_000 + "<p>end", "a" * 100_000 + " end"),
        ("<p>word" * 20_000, " ".join(["word"] * 20_000)),
        ("</div>" * 50_000 + "<p>x", "x"),
        ("<a" * 50_000, ""),
    ):
        tree = W.parsed(page)
        with W.deep():
            form = W.read(W.written(W.form_of(tree)))
        assert W.main_text(page, form).replace("a a", "aa").replace("a a", "aa") == text
        assert W.main_text(page, ["e", "", []]).replace("a a", "aa").replace("a a", "aa") == text


def test_a_host_of_many_shapes(spark):
    """More shapes than one step aligns: the wrapper is that of all, in any partitioning."""
    pages = ["<body>" + "".join(f"<{tag}>{words(i, 9)} {k}</{tag}>" for k, tag in enumerate(("p", "ul", "pre", "dl", "section", "blockquote", "table")) if i >> k & 1) + "<div>Same notice</div></body>" for i in range(1, 100)]
    rows = [(i, "http://h.example/", p) for i, p in enumerate(pages)]
    docs = spark.createDataFrame(rows, "page_id int, url string, html string")
    one, many = (W.wrappers(d, "url", "html").collect() for d in (docs.coalesce(1), docs.repartition(7)))
    assert len(one) == 1 and one == many
    assert all(W.matched(W.read(one[0]["wrapper"]), W.parsed(p)) is not None for p in pages)
    found = W.extracted(docs).collect()
    assert len(found) == 99 and not any("notice" in r["text"] for r in found)


def test_odd_pages(spark):
    rows = [(None, None, None, 1, "c"), (2, "not an address", "", 1, "c"), (3, "http://x.example", "no markup at all", 1, "c"), (3, "http://x.example", "no markup at all", 1, "c"), (4, "", "<p>a", 1, "c")]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string, n_chars int, text string")
    found = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in W.extracted(pages).collect())
    assert found == [(0, "", 0), (2, "", 0), (3, "no markup at all", 16), (3, "no markup at all", 16), (4, "a", 1)]
    assert W.extracted(pages.limit(0)).count() == 0


def plain_texts(pages):
    """A small host by brute force: pages of one shape, as lists of (tag, text); a text all pages have at a place is the template's."""
    return [" ".join(x for k, (_, x) in enumerate(p) if len({q[k][1] for q in pages}) > 1) for p in pages]


def test_small_hosts_by_brute_force():
    import random

    for seed in range(30):
        draw = random.Random(seed)
        tags = [draw.choice(("div", "p", "pre", "section", "blockquote")) for _ in range(draw.randint(2, 6))]
        tags = [t for k, t in enumerate(tags) if t not in tags[:k]]
        fixed = [draw.random() < 0.4 for _ in tags]
        fixed[-1] = False
        pages = [[(t, f"Notice {k}" if fixed[k] else words(i * 31 + k, 40)) for k, t in enumerate(tags)] for i in range(1, 5)]
        assert texts(["<body>" + "".join(f"<{t}>{x}</{t}>" for t, x in p) + "</body>" for p in pages]) == plain_texts(pages)
