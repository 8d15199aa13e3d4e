"""Repeated passages against plain loops over all substrings."""

import hashlib
import random

import numpy as np
import pytest

from specula.llm import repeats


def brute(rows, length, keep):
    """rows of (id, text): {(id, text): [(removed, spans, sha)]} by a table of all substrings."""
    texts = sorted({(t or "").encode() for _, t in rows}, key=lambda b: hashlib.sha256(b).digest()[:16])
    where = {}
    for d, body in enumerate(texts):
        for i in range(len(body) - length + 1):
            where.setdefault(body[i:i + length], []).append((d, i))
    gone = [bytearray(len(b)) for b in texts]
    for places in where.values():
        for d, i in (places[1:] if keep == "first" else places if len(places) > 1 else []):
            gone[d][i:i + length] = b"\1" * length
    out = []
    for key, text in rows:
        body = (text or "").encode()
        mask = gone[texts.index(body)]
        same = [k for k, t in rows if (t or "").encode() == body]
        if len(same) > 1 and len(body) >= length and (keep is None or key != min(same)):
            mask = b"\1" * len(body)
        kept = bytes(c for c, m in zip(body, mask) if not m)
        spans = [(i, next((j for j in range(i, len(mask)) if not mask[j]), len(mask))) for i in range(len(mask)) if mask[i] and (i == 0 or not mask[i - 1])]
        out.append((key, len(body), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def texts(draw):
    letters = lambda n, a="abcdefgh é日": "".join(draw.choice(a) for _ in range(n))
    passages = [letters(n) for n in (39, 40, 41, 45, 70, 120, 300)]
    found = [None, "", "short", "x" * 39, "x" * 40, "x" * 500, "ab" * 300, "abc" * 90, letters(700, "ab"), letters(700, "ab"), letters(39) + "é", passages[4]]
    for _ in range(40):
        found.append("".join(draw.choice([letters(draw.randint(1, 90)), draw.choice(passages), draw.choice(passages)[draw.randint(0, 9):]]) for _ in range(draw.randint(1, 6))))
    line = letters(30)  # a common line shorter than the length, and one just longer, among other words
    found += [letters(50) + line + letters(50) for _ in range(40)] + [letters(20) + passages[1] + letters(20) for _ in range(30)]
    for t in found[-6:]:  # near copies
        found += [t[:60] + letters(1) + t[60:], t[:31] + t[32:]]
    return found + found[14:17] + ["same " * 30] * 5


@pytest.mark.parametrize("keep", [None, "first"])
@pytest.mark.parametrize("most, chunk, small", [(20_000, 1 << 20, 500_000), (4, 700, 0), (0, 100, 0)])
def test_repeats_by_brute_force(spark, keep, most, chunk, small):
    draw = random.Random(most + chunk)
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts(draw))]
    rows += [rows[20], (2000, None)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, digest string, start int").repartition(5)
    got = repeats.without_repeats(df, "doc_id", "text", 40, keep, anchor=16, most=most, small=small, chunk=chunk).collect()
    assert sorted((r.id, r.n_bytes, r.n_removed, [tuple(s) for s in r.spans], r.kept_sha256) for r in got) == brute(rows, 40, keep)


def test_kept_texts_and_empty_tables(spark):
    passage = "".join(chr(97 + i * i % 26) for i in range(150))
    df = spark.createDataFrame([(1, "one " + passage + " end"), (2, "two " + passage + " else")], "id int, text string")
    got = {bytes(r.kept) for r in repeats.repeats(df, "text", 60, None, anchor=20).collect()}
    assert got == {b"onend", b"twolse"}  # the blanks beside the passage and one letter are equal too
    assert repeats.repeats(df.limit(0), "text").count() == 0 and repeats.without_repeats(df.limit(0), "id", "text").count() == 0
    with pytest.raises(ValueError):
        repeats.repeats(df, "text", 60, "last")


def test_hot_anchors_are_split_until_their_runs_are_few():
    draw = random.Random(1)
    line = bytes(draw.choice(b"abcdef") for _ in range(30))
    bodies = [bytes(draw.choice(b"abcdefgh") for _ in range(60)) + line + bytes(draw.choice(b"abcdefgh") for _ in range(60)) for _ in range(300)]
    data, ends = np.frombuffer(b"".join(bodies), np.uint8), np.cumsum([len(b) for b in bodies])
    hot = np.zeros(0, np.uint64)
    for _ in range(9):
        key, first, last = repeats.cut(data, ends, 40, 16, hot)
        assert (last - first + 1).sum() == 300 * (150 - 40 + 1)  # every suffix once
        names, n = np.unique(key, return_counts=True)
        if n.max() <= 10:
            break
        hot = np.union1d(hot, names[n > 10])
    assert len(hot) and n.max() <= 10


def test_previous_factors_by_brute_force():
    draw = random.Random(2)
    for _ in range(60):
        data = bytes(draw.choice(b"ab") for _ in range(draw.randint(30, 90)))
        length = draw.choice([9, 11, 16, 21])
        places = np.arange(len(data) - length + 1)
        position = np.array(draw.sample(range(len(places)), len(places)))
        earlier, source = repeats.previous_factors(np.frombuffer(data, np.uint8), places, position, length)
        for i in places:
            others = [j for j in places if data[j:j + length] == data[i:i + length] and position[j] < position[i]]
            assert earlier[i] == bool(others) and (source[i] in others if others else source[i] == -1)
