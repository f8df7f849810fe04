import random

import numpy as np

from sievecraft.llm import repeated_spans as rs
from sievecraft.llm.factors import longest_previous_factor, repeats

DOCS = "doc_id long, text string, lang string, begin int"


def plain(rows, least, first_stays=False):
    """Covered bytes by brute force: index of row -> set of bytes."""
    seen = {}
    for k, (_, text) in enumerate(rows):
        data = (text or "").encode()
        for i in range(len(data) - least + 1):
            seen.setdefault(data[i : i + least], []).append((k, i))
    covered = {k: set() for k in range(len(rows))}
    for spots in seen.values():
        for k, i in spots[1:] if first_stays else spots if len(spots) > 1 else []:
            covered[k].update(range(i, i + least))
    return covered


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randint(1, 6)))
    shared = [" ".join(word() for _ in range(r.randint(3, 30))) for _ in range(6)]
    texts = [None, "", "x", "a" * 90, "ab" * 60]
    for _ in range(60):
        texts.append(" ".join(r.choice(shared) if r.random() < 0.3 else word() for _ in range(r.randint(1, 12))))
    texts += r.sample(texts, 15)
    return list(enumerate(texts))


def spans_of(found, rows):
    at = {i: k for k, (i, _) in enumerate(rows)}
    covered = {k: set() for k in range(len(rows))}
    for s in found:
        covered[at[s.doc_id]].update(range(s.begin, s.end))
    return covered


def test_spans_match_brute_force_for_any_group_size(spark, monkeypatch):
    monkeypatch.setattr(rs, "BLOCK", 64)
    rs._tables.cache_clear()
    rows = corpus(1)
    docs = spark.createDataFrame([(i, t, "en", 1) for i, t in rows], DOCS).repartition(5)
    for least, window, group, first in ((24, 16, 2000, False), (24, 16, 1, False), (24, 16, 2000, True), (30, 9, 2, True)):
        found = rs.repeated_spans(docs, least, window, first, group).collect()
        assert spans_of(found, rows) == plain(rows, least, first), (least, window, group, first)
    rs._tables.cache_clear()


def test_small_arrays_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(rs, "ARRAY", 50)
    rows = corpus(2)
    docs = spark.createDataFrame([(i, t, "en", 1) for i, t in rows], DOCS)
    assert spans_of(rs.repeated_spans(docs, 24, 16).collect(), rows) == plain(rows, 24)


def test_whole_rows_and_empty_tables(spark):
    long = " ".join(f"word{i}" for i in range(20000))
    rows = [(1, "start " + long[:500] + " end"), (2, long), (2, long), (None, long[300:900]), (5, None), (6, "q" * 450), (7, "é" * 100)]
    docs = spark.createDataFrame([(i, t, None, None) for i, t in rows], DOCS)
    want = []
    for k, cov in plain(rows, 200).items():
        data = (rows[k][1] or "").encode()
        runs = sum(1 for i in cov if i - 1 not in cov)
        want.append((rows[k][0], len(data), len(cov), runs, bytes(b for i, b in enumerate(data) if i not in cov)))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rs.without_repeats(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert rs.without_repeats(docs.limit(0)).count() == 0


def test_longest_previous_factor():
    for text in (b"", b"a", b"aaaa", b"abcabcxabc", bytes(random.Random(3).choices(b"ab", k=60))):
        want = [max([0, *(next((k for k in range(len(text)) if i + k >= len(text) or text[i + k] != text[j + k]), len(text) - i) for j in range(i))]) for i in range(len(text))]
        assert longest_previous_factor(text).tolist() == want
    starts, previous, other = repeats([b"abcdx", b"", b"bcd", b"zzzz"], 3)
    assert starts.tolist() == [0, 5, 5, 8]
    assert np.flatnonzero(previous).tolist() == [5, 9] and np.flatnonzero(other).tolist() == [1, 5, 8, 9]
