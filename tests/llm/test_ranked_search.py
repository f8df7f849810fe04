import math
import random
import re
from collections import Counter

import numpy as np

from sievecraft.llm import ranked_search
from sievecraft.llm.ranked_search import Tree, rank


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, most=10):
    docs = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for doc_id, c in docs:
            m = 10 + 90 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 8 * m)) for w in set(terms(text)) if c[w])
            if score > 0:
                found.append((-score, doc_id is None, doc_id))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, k, x[2], -x[0]) for k, x in enumerate(found[:most], 1)]
    return sorted(out, key=repr)


def made():
    r = random.Random(8)
    words = [f"{a}{b}" for a in "abcdEF" for b in ["", "x", "É", "é", "1", "q2"]]
    line = lambda n: r.choice([" ", "; ", "\t"]).join(r.choices(words, [1 / (k + 1) for k in range(len(words))], k=n))
    docs = [(k, line(r.randint(0, 60))) for k in range(300)]
    docs += [(1000 + k, docs[7][1]) for k in range(40)]  # ties
    docs += [(5, docs[7][1]), (5, docs[7][1]), (None, docs[7][1]), (None, None), (400, None), (401, ""), (402, "..."), (403, "ax " * 400_000 + "rare"), (-3, "DX dx")]
    items = [(k, line(r.randint(1, 25))) for k in range(12)] + [(20, docs[7][1]), (20, docs[7][1]), (21, None), (22, ""), (23, "nowhere"), (24, "RARE"), (None, "dx")]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame([(*x, "a", 1) for x in docs], "doc_id long, text string, item string, shard int").repartition(3)
    return d, spark.createDataFrame([(*x, "b") for x in items], "item_id long, text string, rank string")


def test_ranks_match_brute_force(spark, monkeypatch):
    docs, items = made()
    d, i = frames(spark, docs, items)
    want = plain(docs, items)
    assert sorted(map(tuple, rank(d, i).collect()), key=repr) == want
    monkeypatch.setattr(ranked_search, "TERMS_AT_ONCE", 30)
    assert sorted(map(tuple, rank(d, i).collect()), key=repr) == want
    assert sorted(map(tuple, rank(d, i, 3).collect()), key=repr) == plain(docs, items, 3)


def test_empty_tables(spark):
    docs, items = made()
    d, i = frames(spark, docs, items)
    assert rank(d.limit(0), i).count() == 0 and rank(d, i.limit(0)).count() == 0
    assert rank(d.where("doc_id = 401"), i).columns == ["item_id", "rank", "doc_id", "score"]


def test_tree_finds_the_best_and_leaves_nodes_closed():
    rng = np.random.default_rng(2)
    n = 4096
    dense = rng.integers(0, 5, (6, n)) * (rng.random((6, n)) < 0.2)
    dense[2, 100] = dense[3, 100] = dense[2, 3000] = dense[3, 3000] = 1000
    term, place = np.nonzero(dense)
    tree = Tree(term.astype(np.int32), place.astype(np.int32), dense[term, place].astype(np.int64), n)
    opened = []
    leaves = tree.leaves
    tree.leaves = lambda rows, node: opened.append(node) or leaves(rows, node)
    for rows in (np.array([0]), np.array([2, 3]), np.arange(6)):
        sums = dense[rows].sum(axis=0)
        order = sorted(range(n), key=lambda i: (-sums[i], i))[:10]
        got = tree.search(rows, list(range(n)), 10, 0)
        assert [(x[2], -x[0]) for x in got] == [(i, sums[i]) for i in order]
        assert [x[2] for x in tree.search(rows, list(range(n)), 10, 1000)] == [i for i in order if sums[i] >= 1000]
    opened.clear()
    tree.search(np.array([2, 3]), list(range(n)), 2, 0)
    assert sorted(opened) == [100 // 16, 3000 // 16]
    assert not len(tree.rows(np.array([9, 50]))) and Tree(*[np.zeros(0, np.int64)] * 3, 5).rows(np.array([1])).size == 0
