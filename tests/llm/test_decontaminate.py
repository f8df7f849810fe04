import hashlib
import random
import re

from sievecraft.llm import decontaminate as dc

DOCS = "doc_id long, text string, w string, print string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items):
    windows = []
    for item, text in items:
        w = words(text)
        windows += [(item, w[i : i + 10]) for i in range(max(1, len(w) - 9)) if w]
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, p in windows:
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    ids.add(item)
        listed = ",".join(sorted(str(i) for i in ids if i is not None))
        out.append((doc_id, len(w), len(hit), len(ids - {None}), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def made():
    r = random.Random(4)
    word = lambda: r.choice("abcdefghij") + r.choice(["", "x", "É", "é", "1"])
    items = [(k, " ".join(word() for _ in range(r.randint(1, 25)))) for k in range(14)] + [(20, ""), (21, None), (None, "zz q"), (22, "zz q"), (22, "zz q")]
    docs = [(k, "; ".join([" ".join(word() for _ in range(r.randint(0, 30))), (r.choice(items)[1] or "").upper()])) for k in range(60)]
    docs += [(100, None), (101, ""), (102, "zz--Q"), (102, "zz--Q"), (None, "ZZ q"), (103, "zz q " * 3000), (104, "...")]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, "w", None) for i, t in docs], DOCS).repartition(3), spark.createDataFrame(items, "item_id long, text string")


def test_hits_match_brute_force(spark, monkeypatch):
    docs, items = made()
    d, b = frames(spark, docs, items)
    want = plain(docs, items)
    assert sorted(map(tuple, dc.contamination(d, b).collect()), key=repr) == want
    monkeypatch.setattr(dc, "BLOCK_WORDS", 12)
    assert sorted(map(tuple, dc.contamination(d, b).collect()), key=repr) == want
    clean = dc.drop_contaminated(d, b)
    assert clean.columns == d.columns
    bad = {x[0] for x in want if x[5]}
    assert sorted(repr(r.doc_id) for r in clean.collect()) == sorted(repr(i) for i, _ in docs if i not in bad)


def test_empty_tables(spark):
    docs, items = made()
    d, b = frames(spark, docs, items)
    assert all(r.n_hit == 0 and not r.contaminated for r in dc.contamination(d, b.limit(0)).collect())
    assert dc.contamination(d.limit(0), b).count() == 0
    assert dc.drop_contaminated(d, b.limit(0)).count() == len(docs)


def test_proximity(spark):
    d, b = frames(spark, [(1, "b filler a c"), (2, "a b c"), (3, "a b")], [(7, "a b c")])
    (index, sought), = dc.indexed(d, b, slack=5)
    assert {r.doc_id for r in dc.proximity_matches(index, sought).collect()} == {1, 2}
    assert {r.doc_id for r in dc.exact_matches(index, sought).collect()} == {2}
