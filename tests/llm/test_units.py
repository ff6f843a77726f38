"""The operators' parts, against plain Python, without Spark."""

import json
import hashlib
import os

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import _bytes, components, exactspans, extraction, nearest, passages, sharding, simhash, toxicity


def test_range_hashes_depend_on_content_only():
    data = np.frombuffer(b"abcabcabd", dtype=np.uint8)
    h = _bytes.ranges(_bytes.prefix_sums(data), np.array([0, 3, 6]), np.array([3, 6, 9]))
    assert h[0] == h[1] != h[2]


@given(st.lists(st.integers(0, 50), min_size=1, max_size=60), st.integers(1, 12))
def test_leftmost_minima(values, width):
    width = min(width, len(values))
    v = np.array(values, dtype=np.uint64) << np.uint64(40)
    want = [i + values[i : i + width].index(min(values[i : i + width])) for i in range(len(values) - width + 1)]
    assert _bytes.leftmost_minima(v, width).tolist() == want


def test_fingerprint_is_a_majority_of_bits():
    text = "The quick brown fox\tJUMPS over the lazy dog the quick brown fox jumps"
    words = text.lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(text.encode(), 4) == want
    assert simhash.fingerprint(b" \t", 4) == 0
    one = xxhash.xxh64_intdigest(b"a b", 42)
    assert simhash.fingerprint(b"A b", 4) == one


def test_anchors_cover():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**32, size=3000, dtype=np.uint64)
    y = x ^ (np.uint64(1) << rng.integers(0, 32, 3000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 32, 3000, dtype=np.uint64))
    (ax, a), (ay, b) = simhash.anchors(x, 1), simhash.anchors(y, 1)
    near = set(zip(ax.tolist(), a.tolist(), strict=True))
    assert {i for i, k in zip(ay.tolist(), b.tolist(), strict=True) if (i, k) in near} == set(range(3000))
    assert len(a) < 12 * len(x)


def test_forest_spans_what_links():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, size=8, dtype=np.uint64)
    fp = np.concatenate([base ^ (np.uint64(1) << np.uint64(i)) for i in range(5)])
    key = np.zeros(len(fp), dtype=np.int64)
    a, b = simhash.links_of_sorted(key, fp, 4)
    label = components.local(len(fp), a, b)
    full = [(i, j) for i in range(len(fp)) for j in range(i) if bin(int(fp[i] ^ fp[j])).count("1") <= 4]
    want = components.local(len(fp), np.array([i for i, _ in full]), np.array([j for _, j in full]))
    assert (label == want).all()


@settings(deadline=None, max_examples=30)
@given(st.lists(st.tuples(st.integers(1, 1000), st.integers(0, 200)), min_size=1, max_size=300))
def test_packing_is_even(items):
    w = np.array([(b, t, 1) for b, t in items], dtype=float)
    shards = sharding.pack(w, np.tile(w.sum(0) / 4, (4, 1)))
    rows = np.bincount(shards, minlength=4)
    load = np.bincount(shards, w[:, 0], 4)
    assert set(shards) <= set(range(4)) and load.max() - load.min() <= 2 * w[:, 0].max() + 2 * w[:, 0].sum() / len(w) + 1e-6 and rows.sum() == len(w)


def test_one_bit_codes_find_neighbours():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1000, 64))
    x[900:950] = x[7]
    ids = np.arange(1000)
    q = ids % 20 == 0
    codes, norm, fit = nearest.encode(x)
    a, b, s = nearest.best(ids[q], x[q], ids, x, codes, norm, fit, 20, 3.5)
    full = x[q] @ x.T
    full[np.arange(q.sum()), ids[q]] = -np.inf
    hits = 0
    for i, row in zip(ids[q], full, strict=True):
        order = np.lexsort((ids, -np.round(row, 9)))[:20]
        got = b[a == i]
        hits += len(set(got) & set(order))
        assert np.allclose(s[a == i], np.sort(row[got])[::-1])
    assert hits >= 0.97 * 20 * q.sum()


def test_repeated_spans_of_contexts():
    text = hashlib.sha512(b"x").hexdigest()[:120].encode()
    contexts = [text, b"y" * 10 + text]
    found = exactspans.repeated(contexts, np.array([40, 50]), np.array([0, 1]))
    assert found == [[], [(10, 130)]]


def test_columns_give_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(6)
    texts = [bytes(rng.integers(97, 100, rng.integers(0, 30)).astype(np.uint8)) for _ in range(80)]
    columns = np.zeros((30, 80), dtype=np.uint16)
    for i, t in enumerate(texts):
        columns[: len(t), i] = np.frombuffer(t, np.uint8).astype(np.uint16) + 1
    order, common = np.arange(80), np.zeros(80, dtype=np.int16)
    for c in range(29, -1, -1):
        order, common = exactspans.inserted(columns[c], order, common)
        suffix = [texts[i][c:] for i in order]
        assert suffix == sorted(suffix)
        want = [0] + [len(os.path.commonprefix([x, y])) for x, y in zip(suffix, suffix[1:], strict=False)]
        assert common.tolist() == want


def test_chain_is_collinear_and_scored():
    x, y = [0, 5, 10, 12, 200, 205], [100, 105, 110, 3, 300, 305]
    out = passages.chains(x, y)
    assert [[x[i] for i in c] for c in out] == [[0, 5, 10], [200, 205]]


def test_alignment_bridges_an_edit():
    a = np.arange(60, dtype=np.uint32)
    b = np.concatenate([a[:30], np.array([999], np.uint32), a[31:]])
    assert passages.aligned(np.array([2, 40]), np.array([2, 40]), a, b) == [(0, 60, 0, 60, 59)]
    assert passages.aligned(np.array([40]), np.array([40]), a, b) == [(0, 60, 0, 60, 59)]


ARTICLE = "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li>Home<li>About</ul></nav><div class='cookie-notice'>We use cookies</div><article><h1>Ti&amp;tle</h1><p>One <b>bold\n word</b>.<br>Two<p>Three<div class=ad>Buy</div><p>{}</article><div id='comments'><p>First!</p></div><aside>Side</aside><form><input>Go</form><script>var a='</p>'</script><footer>Foot</footer></body></html>"


def wrapper_of(pages):
    w = None
    for p in pages:
        s = extraction.plain(extraction.skeleton(extraction.parse(p), p))
        w = extraction.merged(w, s, True) if w else s
    return extraction.Wrapper(w)


def test_extraction_leaves_the_article():
    pages = [ARTICLE.replace("{}", f"Last {i}") for i in range(4)]
    w = wrapper_of(pages)
    assert extraction.extract(pages[0], None) == "Ti&tle\nOne bold word. Two\nThree\nLast 0"
    # on four pages the title is the same, but headings of an article stay; the paragraphs are one repeated node, a slot
    assert extraction.extract(pages[2], w) == "Ti&tle\nOne bold word. Two\nThree\nLast 2"
    assert extraction.extract(pages[2], wrapper_of(pages[:2])).split("\n")[0] == "Ti&tle"


def test_extraction_without_article_goes_by_mass():
    page = "<body><div class=menu><a>a</a></div><div><div><p>" + "Long text here. " * 20 + "</p><p>More &lt;b&gt; text.</p></div><div class='sidebar'>x</div></div></body>"
    out = extraction.extract(page, None)
    assert out.startswith("Long text here.") and out.endswith("More <b> text.") and "x" not in out.split("\n")
    assert extraction.extract("", None) == "" and extraction.extract("plain  text", None) == "plain text"
    assert extraction.extract("<p>a<p>b <", None) == "a\nb <"


def test_marks_never_empty_a_page():
    text = "The article has a good number of words."
    for tag in ("<body class='nav-open home sidebar-right'><article>", "<body><article class=promotion>", "<body><main id=popup-root>", "<body><div class='modal overlay'><article>", "<body><form id=aspnetForm><div>", "<body><div class='has-sidebar with-comments'>", "<body><div class='share widget'>"):
        page = f"<html>{tag}<p>{text}</p><p>Second.</p></html>"
        assert extraction.extract(page, None) == f"{text}\nSecond."
        assert extraction.extract(page, wrapper_of([page, page.replace("Second", "Third")])) == f"{text}\nSecond."
    # comments are left out however long they are, and teasers beside the article
    page = f"<body><div class=post><p>{text}</p></div><section class=comments><article class=comment><p>{'So true. ' * 90}</p></article></section>"
    assert extraction.extract(page, None) == text
    page = f"<body><article><p>{text}</p></article><article class='related card'><p>{'Read on. ' * 90}</p></article>"
    assert extraction.extract(page, None) == text


def test_nothing_of_an_article_is_dropped():
    page = "<article><p>Let <math><mi>x</mi></math> be <label>a name</label>.</p><object>Fallback</object><svg/><p>After</p><ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul></article>"
    assert extraction.extract(page, None).split("\n") == ["Let x be a name.", "Fallback", "After", "One", "Two", "Three"]
    lead = "<body><div class=intro><p>" + "Lead text. " * 10 + "</p></div><div class=rest><p>" + "Rest of it. " * 40 + "</p></div></body>"
    assert extraction.extract(lead, None).startswith("Lead text.") and extraction.extract(lead, None).endswith("Rest of it.")
    menu = "<body><div><ul><li><a>Home</a><li><a>News</a><li><a>Sport</a></ul></div><div><p>Story.</p></div></body>"
    assert extraction.extract(menu, None) == "Story."


def test_words_of_classes_leave_nothing_out_inside_an_article():
    kept = "<header><p>Standfirst {0}.</p></header><h2 class=section-header>Part {0}</h2><section class=related-work><p>Others {0}.</p></section><div class=ad-hoc-analysis><p>We looked {0}.</p></div><table class=share-prices><tr><td>9.5 {0}</table><div id=menu-of-the-day><p>Soup {0}.</p></div><menu><li>Step {0}</menu>"
    left = "<div class=ad>Buy {0}</div><div class='cookie-notice'>Notice {0}</div><div class=comment-list><p>First {0}!</p></div><nav>Top</nav><aside>Aside {0}</aside><form>Sign</form>"
    page = lambda i: f"<body><div class=section-header>Site</div><article>{kept.format(i)}{left.format(i)}<p>End {i}.</p></article></body>"
    pages = [page(i) for i in range(6)]
    want = lambda i: f"Standfirst {i}.\nPart {i}\nOthers {i}.\nWe looked {i}.\n9.5 {i}\nSoup {i}.\nStep {i}\nEnd {i}."
    w = wrapper_of(pages)
    assert [extraction.extract(p, x) for p in pages for x in (w, None)] == [want(i) for i in range(6) for _ in range(2)]


def test_headings_that_all_articles_have_stay():
    page = lambda i, tag: f"<body><div class=top>Site of news</div><{tag}><h2>Abstract</h2><p>What {i}.</p><h2>Methods</h2><p>How {i}.</p><table><tr><th>Year<td>{i}</table></{tag}></body>"
    for tag in ("article", "section"):
        w = wrapper_of([page(i, tag) for i in range(6)])
        assert extraction.extract(page(9, tag), w) == "Abstract\nWhat 9.\nMethods\nHow 9.\nYear\n9"


def test_lists_of_links_without_an_article():
    book = lambda i, j: f"<li><a>{j}. A long title of the book number {i}, by someone</a>"
    page = lambda i: f"<body><div><ul><li><a>Home</a><li><a>All of our latest news</a><li><a>A page about all of us</a></ul></div><div><p>Text {i}.</p><ol>{''.join(book(i, j) for j in range(4))}</ol></div></body>"
    w = wrapper_of([page(i) for i in range(6)])
    got = extraction.extract(page(3), w).split("\n")
    assert got == ["Text 3.", *[f"{j}. A long title of the book number 3, by someone" for j in range(4)]]


def test_a_class_for_each_page_is_no_more_markup():
    import time

    page = lambda i: f"<body><div class='tag-{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100 % 10]}{'efghijklmn'[i // 1000]}'><p>Lead {i}.</p></div><article class='post'><h1>T {i}</h1><div class='x{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100 % 10]}{'efghijklmn'[i // 1000]}'><p>Body {i}.</p></div><p>Share this on all networks.</p><p class=last>Last {i}.</p></article></body>"
    took, size = {}, {}
    for n in (500, 2500, 5000):
        began = time.process_time()
        w = None
        for i in range(n):
            one = extraction.plain(extraction.skeleton(extraction.parse(page(i)), page(i)))
            w = extraction.merged(w, one, True) if w else one
        took[n], size[n] = time.process_time() - began, len(json.dumps(w))
    assert size[5000] < 1.5 * size[500] < 20_000 and took[5000] < 15 * took[500]
    assert extraction.extract(page(77), extraction.Wrapper(w)) == "T 77\nBody 77.\nLast 77."


def test_copies_make_no_template():
    quoted = "<article><h1>T</h1><blockquote class=rare>Quoted words.</blockquote><p>Body of it.</p></article>"
    others = [f"<article><h1>Title {i}</h1><p>Body {i}.</p></article>" for i in range(3)]
    w = wrapper_of([quoted, quoted, quoted, *others])
    assert extraction.extract(quoted, w) == "T\nQuoted words.\nBody of it."
    w = wrapper_of([f"<article><p>Body {i}.</p><blockquote>All rights.</blockquote></article>" for i in range(12)])
    assert extraction.extract("<article><p>Body 99.</p><blockquote>All rights.</blockquote></article>", w) == "Body 99."
    assert extraction.distinct(sorted(range(0, 1 << 32, 1 << 26))[:8]) > 50


def test_pages_are_matched_with_the_expression():
    """Optional nodes, repeated nodes and repeated groups: each element takes the part of the node that it aligns with."""
    item = lambda n, extra="": f"<h2>Head {n}</h2><p>Par {n} a</p><p>Par {n} b</p>{extra}"
    page = lambda i, k, extra="": f"<article><div>Issue of today</div>{''.join(item(f'{i}.{j}') for j in range(k))}{extra}<div>The end</div></article>"
    pages = [page(0, 1), page(1, 3), page(2, 2, "<table><tr><td>Cell 2</table>"), page(3, 1), page(4, 4)]
    w = wrapper_of(pages)
    assert extraction.extract(pages[1], w).split("\n") == [x for j in range(3) for x in (f"Head 1.{j}", f"Par 1.{j} a", f"Par 1.{j} b")]
    assert extraction.extract(pages[2], w).split("\n")[-1] == "Cell 2"
    assert extraction.extract(page(9, 6), w).split("\n")[:2] == ["Head 9.0", "Par 9.0 a"]
    article = w.root[extraction.CHILDREN][0]
    sigs = [n[extraction.SIG] for n in article[extraction.CHILDREN]]
    assert sigs == ["div", "(h2 p)", "table", "div"]
    group, table = article[extraction.CHILDREN][1:3]
    assert group[extraction.REPEATED] and group[extraction.CHILDREN][1][extraction.REPEATED] and table[extraction.OPTIONAL] and not article[extraction.CHILDREN][0][extraction.OPTIONAL]


def test_misspellings_share_vectors():
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("aeioulnrst"), 5)) for _ in range(200)]
    good = [" ".join(rng.choice(vocabulary, 30)) for _ in range(150)]
    bad = [g + " " + rng.choice(["horrible", "horribly", "idiots"]) + " horrible" for g in good[:70]]
    s = toxicity.Settings(buckets=1 << 14, epochs=12)
    m = toxicity.fit([*good[70:], *bad], [0] * 80 + [1] * 70, s, 0.4)
    new = m.score([good[0], good[1] + " horribble horrible", "", None])
    assert new[1] > new[0] and 0 <= new.min() and new.max() <= 1 and new[2] == new[3]
    one_class = toxicity.fit(good[:3], [0, 0, 0], s, 0.0)
    assert one_class.score(["a"])[0] < 0.01


def test_extraction_of_deep_trees():
    page = "<article><p>First</p>" + "<div>" * 5000 + "In the deep<div>and deeper</div>again<nav>no<div>no</div>no</nav><b>bold</b>" + "</div>" * 5000 + "<p>Last</p></article><footer>Foot</footer>"
    assert extraction.extract(page, wrapper_of([page])).split("\n") == ["First", "In the deep", "and deeper", "again", "bold", "Last"]
    assert extraction.extract("<nav>" * 3000 + "Menu", None) == ""
    assert extraction.extract("<b>" * 3000 + "Bold", None) == "Bold"


def test_each_document_but_the_first_has_a_row_for_a_common_passage(spark):
    import random

    rng = random.Random(3)
    fresh = lambda n: [f"z{rng.randrange(10**9)}" for _ in range(n)]
    passage, other = fresh(60), fresh(60)
    docs = [[*fresh(20), *passage, *fresh(10)] for _ in range(25)] + [[*other, *fresh(9), *(passage if i == 0 else [])] for i in range(9)] + [fresh(90)]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    got = passages.classed(passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))).collect()
    assert {r.doc_id for r in got if r.end - r.start >= 60} == set(range(1, 34)) and {r.class_id for r in got} == {0}
    assert {r.doc_id for r in got if r.ref_doc_id == 0} == set(range(1, 26))


def test_a_task_hands_on_a_forest():
    """Whatever links a task finds again and again, it hands on those of a spanning forest, and holds a bounded number."""
    rng = np.random.default_rng(4)
    nodes = rng.integers(-(2**62), 2**62, 300)
    pairs = [(x := rng.integers(0, 250, 2000), (x + 10 * rng.integers(1, 6, 2000)) % 250) for _ in range(20)]
    want = components.local(300, np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs]))
    for most in (1 << 19, 4000, 100):
        forest, out = components.Forest(most), []
        for a, b in pairs:
            out += list(forest.add(nodes[a], nodes[b]))
            assert forest.held <= most + 2000
        out += list(forest.rest())
        a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        place = {n: i for i, n in enumerate(nodes.tolist())}
        got = components.local(300, np.array([place[n] for n in a.tolist()]), np.array([place[n] for n in b.tolist()]))
        assert (got == want).all() and (a < b).all()
        assert most == 100 or len(a) == 300 - len(set(want.tolist()))
    assert [len(x) for x in next(components.Forest().rest())] == [0, 0]
