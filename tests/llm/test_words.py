"""Sources' divergences and spelling variants against plain loops."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from specula.llm import divergence, spelling


def brute_divergences(rows, least, top):
    docs = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in d[2])
        kept = sorted(t for t in df if df[t] >= least)
        v, count = len(kept), defaultdict(Counter)
        for _, source, words in own:
            count[source].update({t: n for t, n in words.items() if df[t] >= least})
        total = {s: sum(c.values()) for s, c in count.items()}
        whole = sum(total.values())
        p = {s: {t: 1 + 10**9 * (count[s][t] + 2) // (total[s] + 2 * v) for t in kept} for s in total}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in total:
            pairs = [(r, sum(f(p[s][t], p[r][t]) for t in kept)) for r in total if r != s]
            q = {t: 1 + 10**9 * (sum(count[r][t] for r in total) + 2) // (whole + 2 * v) for t in kept}
            terms = [(t, f(p[s][t], q[t])) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(items[:limit])]
    return sorted(out)


@pytest.mark.parametrize("entries, most", [(300_000, 100_000), (7, 0)])
def test_divergences_by_brute_force(spark, entries, most, monkeypatch):
    draw = random.Random(5)
    words = [f"{a}{b}" for a in ("wor", "Été", "日本", "x", "don") for b in ("d", "s", "É", "ÿ")]
    rows = [(" ".join(draw.choice(words[:draw.randint(1, 20)]) + draw.choice(["", "7", "'s", "\n", "\0"]) for _ in range(draw.randint(0, 40))),
             draw.choice(["en", "de", None, ""]), draw.choice(["a", "b", "é", None, "c" * 30])) for _ in range(120)]
    rows += [(None, "en", "only null"), ("", "fr", "empty"), (None, "fr", None), ("common " * 3000 + "rare", "en", "a")] + [("same text here", "en", "b")] * 12
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, n int, term string").repartition(5)
    plain = divergence.stripes
    monkeypatch.setattr(divergence, "stripes", lambda *a: plain(*a, entries=entries))
    got = divergence.divergences(df, "text", "lang", "source", least=4, top=3, most=most)
    assert sorted(tuple(r) for r in got.collect()) == brute_divergences(rows, 4, 3)
    assert divergence.divergences(df.limit(0), "text", "lang", "source").count() == 0


def test_shares_are_exact_for_large_counts():
    import numpy as np
    draw = random.Random(1)
    for _ in range(2000):
        total = draw.randint(1, 9 * 10**15)
        count = draw.randint(0, total)
        assert int(divergence._share(np.array([count]), np.array([total]))[0]) == 1 + 10**9 * count // total


def near(a, b):
    return (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1) or any(
        len(y) == len(x) + 1 and any(y[:i] + y[i + 1:] == x for i in range(len(y))) for x, y in ((a, b), (b, a)))


def brute_variants(counts, ratio):
    by = {w: sorted((-m, o) for o, m in counts.items() if near(w, o)) for w in counts}
    form = {w: (x[0][1] if x and -x[0][0] >= ratio * counts[w] else None) for w, x in by.items()}
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(by[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def odd_words(draw, n):
    found = {}
    for _ in range(n // 8):
        word = "".join(draw.choice("abcdé÷Àÿz") for _ in range(draw.randint(6, 11)))
        found[word] = draw.choice([5, 40, 300, 300])
        for _ in range(8):
            i, other = draw.randrange(len(word)), draw.choice("abcdéÀqr")
            made = draw.choice([word[:i] + word[i + 1:], word[:i] + other + word[i:], word[:i] + other + word[i + 1:]])
            found.setdefault(made, draw.choice([5, 5, 8, 60]))
            word = draw.choice([word, made])
    return found | {"a" * 300: 9, "a" * 299: 50, "a" * 299 + "b": 9, "b" * 6: 7, "abcdefghij": 6, "jihgfedcba": 6}


@pytest.mark.parametrize("most", [5_000, 20, 1])
def test_variants_by_brute_force(spark, most):
    counts = odd_words(random.Random(most), 400)
    counts |= {"".join(p): 6 for p in ("abcabcd", "abcabdc", "bacabcd", "cbaabcd", "abacbcd", "abccbad")}  # one vector, more than a key may hold
    df = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n bigint, form string").repartition(3)
    got = spelling.variants(df, 5, most)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_variants(counts, 5)
    assert spelling.variants(df.limit(0)).count() == 0


def test_words_lose_letters_by_their_checksum(spark):
    draw = random.Random(4)
    texts = [None, "", "a b c", "x" * 50_000, "Àÿ÷×abc ABCDEF"] + [" ".join(draw.choice(["Straße", "letters", "wörterbuch", "ABCDEFG", "short"]) for _ in range(40)) for _ in range(60)]
    rows = list(enumerate(texts)) + [(None, "letters letters"), (5, texts[5]), (5, texts[5])]
    want = Counter()
    for own, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if own is None else own}:{run}".encode())
            if h % 7 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            want[run] += 1
    df = spark.createDataFrame([(i, t, "w") for i, t in rows], "doc_id bigint, text string, word string").repartition(4)
    for entries in (300_000, 2):
        got = spelling.words(df, "doc_id", "text", 6, 5, 7, entries).collect()
        assert {r.word: r.n for r in got} == {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    assert spelling.words(df.limit(0), "doc_id", "text").count() == 0
