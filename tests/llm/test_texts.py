"""Operators that read one text at a time: BPE, token counts, decontamination, licenses, main text."""

import hashlib
import random
import re

import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from specula.llm import bpe, contamination, licenses, mainhtml, tokencount

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, n_tokens string, words array<string>"


def odd_texts():
    draw = random.Random(3)
    letters = "abé日本 \n\t'sß🎉０٣▁<s>\0.,"
    return ([None, "", " ", "   a", "\n\n", "a" * 30_000, "ab" * 4000, " " * 700, "the the the", "the the the", "don't we'll I'M", "x y", "<s> </s> <unk>"]
            + ["".join(draw.choice(letters) for _ in range(120)) for _ in range(60)] + ["".join(draw.choice("thesaion ") for _ in range(300)) for _ in range(30)])


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash", ["x"]) for i, t in enumerate(texts)], SCHEMA)


def test_ids_are_those_of_the_library(spark):
    tokens = bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    texts = odd_texts()
    df = frame(spark, texts)
    made = bpe.encode(df, "text", RANKS, public_tokenizers.PATTERN, ["doc_id", "n_tokens"], ("ids", "n_tokens", "ids_sha256", "decoded_sha256"))
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(made, "ids", RANKS, ["doc_id"]).collect()}
    rows = made.collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = library.encode_ordinary(texts[r.doc_id] or "")
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in want)).hexdigest()
        assert back[r.doc_id] == (texts[r.doc_id] or "").encode()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert bpe.encode(df.limit(0), "text", RANKS, public_tokenizers.PATTERN, ["doc_id"]).count() == 0


def test_merges_by_brute_force_on_a_small_vocabulary():
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abc", b"aa", b"aab", b"abab", b"ca"]
    left, right = bpe.last_merges(tokens)
    encoder = bpe.Encoder(tokens, left, right)
    rank = {t: i for i, t in enumerate(tokens)}
    draw = random.Random(1)
    for _ in range(3000):
        data = bytes(draw.choice(b"abc") for _ in range(draw.randint(1, 14)))
        parts = [data[i:i + 1] for i in range(len(data))]
        while True:
            pairs = [(rank.get(a + b, 999), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            if not pairs or min(pairs)[0] == 999:
                break
            i = min(pairs)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        want = [rank[data]] if data in rank else [rank[p] for p in parts]
        assert encoder.piece(data) == want


def test_token_counts_are_those_of_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = odd_texts()
    df = frame(spark, texts)
    for r in tokencount.count(df, "text", PIECES, ["doc_id", "n_tokens"], 60).collect():
        want = len(library.encode(texts[r.doc_id] or ""))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (want, len((texts[r.doc_id] or "").encode()), want > 60)
    assert tokencount.count(df.limit(0), "text", PIECES, ["doc_id"], 60).count() == 0


def test_every_shortcut_is_one_token():
    score = tokencount.vocabulary(PIECES)
    pattern, whole = tokencount.shortcuts(score)
    assert len(whole) > 1000 and all(tokencount.size(p, score) == 1 for p in list(whole)[::97])
    assert all("".join(re.findall(pattern, t)) == t for t in (tokencount.SPACE + "a, b\n▁c.d", "12 x"))


def brute(text, items, length=13):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for name, item in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), item or ""))
        for i in range(max(1, len(w) - length + 1) if w else 0):
            part = w[i:i + length]
            for j in range(len(words) - len(part) + 1):
                if words[j:j + len(part)] == part:
                    hit.update(range(j, j + len(part)))
                    found.add(str(name))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [8_000_000, 300])
def test_decontamination_by_brute_force(spark, block_bytes):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(12)] + ["É", "日本", "x-y"]
    prose = lambda n: " ".join(draw.choice(words) for _ in range(n))
    items = [(i, prose(draw.choice([3, 7, 13, 14, 30]))) for i in range(12)] + [(90, None), (91, ""), (92, "!!"), (93, "the"), (94, "the"), (95, "The " * 40)]
    texts = [prose(40) + ". " + (draw.choice(items)[1] or "").upper() + " " + prose(draw.randint(0, 60)) for _ in range(40)]
    texts += [None, "", "?!", "the", "the " * 3000, texts[0], texts[0], items[4][1], " ".join(t for _, t in items if t)]
    df = frame(spark, texts)
    held = spark.createDataFrame(items, "item_id int, text string")
    out = contamination.contaminated(contamination.match(df, "text", held, "item_id", "text", ["doc_id", "words"], block_bytes=block_bytes)).collect()
    assert len(out) == len(texts)
    for r in out:
        n, hit, found = brute(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r["items"]) == (n, hit, found), texts[r.doc_id]
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
    assert contamination.match(df.limit(0), "text", held, "item_id", "text", ["doc_id"]).count() == 0
    none = contamination.contaminated(contamination.match(df, "text", held.limit(0), "item_id", "text", ["doc_id"]))
    assert none.filter(F.col("contaminated") | (F.size("items") > 0)).count() == 0


def test_proximity(spark):
    df = frame(spark, ["alpha one two beta three gamma", "alpha " + "x " * 50 + "beta gamma", "gamma beta alpha", None])
    items = spark.createDataFrame([(1, "Alpha beta gamma")], "item_id int, text string")
    got = {r.doc_id: r.near for r in contamination.match(df, "text", items, "item_id", "text", ["doc_id"], span=8).collect()}
    assert got == {0: ["1"], 1: [], 2: ["1"], 3: []}


def test_proximity_does_not_depend_on_neighbours(spark):
    items = spark.createDataFrame([(1, "Alpha beta gamma delta"), (None, "alpha beta")], "item_id int, text string")
    # delta is frequent in all documents, but alone in the first one
    df = frame(spark, ["alpha beta x gamma", "delta " * 40, "alpha " + "x " * 50 + "beta gamma delta"])
    for parts in (1, 3):
        out = contamination.match(df.repartition(parts, "doc_id"), "text", items, "item_id", "text", ["doc_id"], span=8, span_terms=3).collect()
        assert {r.doc_id: r.near for r in out} == {0: [None, "1"], 1: [], 2: []}
        assert {r.doc_id: r["items"] for r in out} == {0: [None], 1: [], 2: []}


def test_licenses(spark):
    prose = " ".join(f"word{i}" for i in range(60))
    texts = [f"{prose}\nReleased under the MIT License.\n{prose}", f"{prose} licensed UNDER the *Apache* license, version 2.0 {prose}", prose, None, "",
             "released under license", f"{prose} Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following terms are met {prose}",
             "Licensed under CC BY-NC 4.0. " * 300]
    df = frame(spark, texts + [texts[0]])
    got = {r.doc_id: [h.name for h in r.licenses] for r in licenses.scan(df, "text", ["doc_id", "words"]).collect()}
    assert got == {0: ["MIT"], 1: ["Apache-2.0"], 2: [], 3: [], 4: [], 5: [], 6: ["BSD-3-Clause"], 7: ["CC-BY-NC-4.0"], 8: ["MIT"]}
    assert licenses.scan(df.limit(0), "text", ["doc_id"]).count() == 0


def test_license_windows_by_brute_force():
    matcher = licenses.Matcher(licenses.TEMPLATES, 5, 0.8, 1e-6)
    draw = random.Random(2)
    for _ in range(300):
        name, text = draw.choice(licenses.TEMPLATES)
        words = licenses.words_of(text)
        if draw.random() < 0.5 and len(words) > 14:
            words[draw.choice([0, len(words) - 1])] = "other"
        around = [f"w{draw.randint(0, 99)}" for _ in range(draw.randint(0, 90))]
        at = draw.randint(0, len(around))
        text = " ".join(around[:at] + words + around[at:])
        assert name in [h[0] for h in matcher.scan(text)]


def test_every_place_of_a_license():
    texts = dict(licenses.whole_texts())
    matcher = licenses.Matcher(licenses.TEMPLATES + list(texts.items()), 5, 0.8, 1e-6)
    prose = lambda n: " ".join(f"word{i}" for i in range(n))
    line = "Released under the MIT License."
    got = matcher.scan(" ".join([prose(10), line, prose(5000), line, prose(85_000), line]))
    assert [h[0] for h in got] == ["MIT"] * 3
    for (_, start, size, share), at in zip(got, (10, 5015, 90_020)):
        assert start <= at and at + 5 <= start + size and size <= 15 and share == 1
    for name, text in texts.items():
        assert name in {h[0] for h in matcher.scan(f"{prose(700)} {text} {prose(300)}")}
    only = lambda text: [h[0] for h in matcher.scan(f"{prose(40)} {text} {prose(500)}")]
    for name in ("MIT", "ISC", "Unlicense", "BSD-2-Clause", "BSD-3-Clause"):
        assert only(texts[name]) == [name]
    assert only(texts["MIT"].split("restriction,", 1)[1]) == ["MIT"]
    for name, text in licenses.TEMPLATES[-5:]:
        assert only(text) == [name]


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body><header><p>Site name, site name, site name, site name</p></header>
<nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav><div class="cookie-notice"><p>We use cookies, many of them, really.</p></div>
%s<aside><p>Aside, aside, aside, aside.</p></aside><form><p>Name</p><input></form><div id="comments"><p>I agree, I do, I do.</p></div>
<footer>&copy; 2024</footer><script>var t="</p>";</script></body></html>"""


@pytest.mark.parametrize("body, want", [
    ("<article><h1>Title</h1><p>First &amp; second,\n third.<p><b>Bold<br> end</p></article>", "Title\n\nFirst & second, third.\n\nBold end"),
    ("<div class=post><h1>T</h1><div class=body><p>A text, with commas, that is long enough to be read.</p><p>And more.</p><ul><li>one<li>two</ul></div></div>",
     "T\n\nA text, with commas, that is long enough to be read.\n\nAnd more.\n\none\n\ntwo"),
    ("<div><div><p>Part one, which is a text of some length, and more.</p></div><div><p>Part two, which is a text of some length, and more.</p></div></div>",
     "Part one, which is a text of some length, and more.\n\nPart two, which is a text of some length, and more."),
    ("<article><p>Only&nbsp;this.</p><div class='ad'>Buy, buy, buy, buy now!</div></article>", "Only this."),
])
def test_main_text(body, want):
    assert mainhtml.extract(PAGE % body) == want


TEXT = "A text, with commas, that is long enough to be read, and it goes on, so that it is no short one."


@pytest.mark.parametrize("body, want", [
    (f'<div class="content no-sidebar"><p>{TEXT}</p><p>{TEXT}</p></div>', [TEXT, TEXT]),
    (f'<div id="page" class="has-sidebar"><p>{TEXT}</p><p>{TEXT}</p></div>', [TEXT, TEXT]),
    (f'<article><div class="article-header"><h1>Title</h1></div><p>{TEXT}</p></article>', ["Title", TEXT]),
    (f'<div class="post"><div class="article-header"><h1>Title</h1></div><div class="text"><p>{TEXT}</p><p>{TEXT}</p></div></div>', ["Title", TEXT, TEXT]),
    (f'<article><p class="margin-bottom-20">{TEXT}</p><p>End, all of it.</p></article>', [TEXT, "End, all of it."]),
    (f'<div class="entry follow-up more"><p>{TEXT}</p></div>', [TEXT]),
    (f'<div class="sidebar"><p>{TEXT}</p><p>{TEXT}</p></div>', [TEXT, TEXT]),
    (f'<article><p>{TEXT}</p><div class="related-posts"><a href=x>Other</a> <a href=y>Another</a></div><div class="widget">Vote, now!</div></article>', [TEXT]),
    (f'<div><h1>T</h1><p>{TEXT}</p></div><div class="comments">' + f"<p>I, too, say: {TEXT}</p>" * 5 + "</div>", ["T", TEXT]),
])
def test_names_of_wrappers(body, want):
    assert mainhtml.extract(PAGE % body) == "\n\n".join(want)


def test_main_text_table(spark):
    long = "<article>" + "<p>some words, and more</p>" * 20_000
    pages = [None, "", "   ", "<p>a", "no markup &lt;b&gt;", PAGE % "<article><p>x, y</p></article>", PAGE % "<article><p>x, y</p></article>", long, "<" * 1000, "<div" * 1000]
    df = spark.createDataFrame([(i, f"u{i}", h, "clash") for i, h in enumerate(pages)], "page_id int, url string, html string, text string")
    got = {r.page_id: r for r in mainhtml.main_text(df, "html", ["page_id", "url", "text"]).collect()}
    assert [got[i].text for i in (0, 1, 2, 3, 4, 5, 6)] == ["", "", "", "a", "no markup <b>", "x, y", "x, y"]
    assert got[7].text.count("\n\n") == 19_999 and all(r.n_chars == len(r.text) for r in got.values())
    assert mainhtml.main_text(df.limit(0), "html", ["page_id"]).count() == 0


LONG_TEXT = "A sentence of the article, with commas, and enough words to be scored as a paragraph of its own, as articles have them."
LAYOUTS = {
    "a page within a form": (f'<body><form action="x"><nav>Menu</nav><main><article><h1>Title</h1><p>{LONG_TEXT}</p><p>{LONG_TEXT}</p></article></main><input value="z"></form></body>', ["Title", LONG_TEXT, LONG_TEXT]),
    "a form in an article": (f'<article><h1>Title</h1><p>{LONG_TEXT}</p><form><label>Mail</label><p>Subscribe to us, now.</p></form></article>', ["Title", LONG_TEXT]),
    "a header in a post": (f'<body><header>Site</header><div class="post"><header><h1>Title</h1></header><div class="entry-content"><p>{LONG_TEXT}</p><p>{LONG_TEXT}</p></div></div></body>', ["Title", LONG_TEXT, LONG_TEXT]),
    "a list between containers": (f'<body><div id="c"><div><p>{LONG_TEXT}</p><p>{LONG_TEXT}</p></div><ul><li>first step</li><li>second step</li></ul><blockquote>said</blockquote><div><p>{LONG_TEXT}</p></div><ul><li>after</li></ul></div></body>',
                                  [LONG_TEXT, LONG_TEXT, "first step", "second step", "said", LONG_TEXT, "after"]),
    "two articles": (f'<main><article><h2>One</h2><p>{LONG_TEXT}</p></article><article><h2>Two</h2><p>{LONG_TEXT}</p></article><article><a href="x">teaser</a></article></main>', ["One", LONG_TEXT, "Two", LONG_TEXT]),
    "comments in lists": (f'<article><h1>Title</h1><p>{LONG_TEXT}</p><ol class="comment-list"><li>First! {LONG_TEXT}</li></ol><ul class="user-comments-list"><li>Second!</li></ul></article>', ["Title", LONG_TEXT]),
    "an advert in a slot": (f'<article><p>{LONG_TEXT}</p><div class="ad-slot">Buy this now</div><p>{LONG_TEXT}</p></article>', [LONG_TEXT, LONG_TEXT]),
}


@pytest.mark.parametrize("layout", sorted(LAYOUTS))
def test_layouts_of_pages(layout):
    html, want = LAYOUTS[layout]
    assert mainhtml.extract(html).split("\n\n") == want


def test_plain_article_pages_by_a_plain_pattern():
    """Pages whose article holds nothing but paragraphs, against what a regular expression takes from them."""
    draw = random.Random(6)
    for _ in range(100):
        inside = "".join(f"<p>{' '.join(draw.choice(['word', 'Wort,', '&amp;', '<b>bold</b>', 'naïve']) for _ in range(draw.randint(5, 60)))}</p>" for _ in range(draw.randint(1, 8)))
        page = f"<html><head><title>t</title></head><body><nav><a>x</a></nav><article>{inside}</article><footer>f</footer></body></html>"
        want = [re.sub("<.*?>", "", p).replace("&amp;", "&") for p in re.findall("<p>(.*?)</p>", page)]
        assert mainhtml.extract(page).split("\n\n") == want
