import random
import re

from pyspark.sql import functions as F

from sievecraft.llm import prefix_trees
from sievecraft.llm.common import word_lists
from sievecraft.llm.prefix_trees import Hasher, internal_nodes, places, without_repeated_words


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain(docs, least):
    """Compares every window with the windows of all documents of smaller ids."""
    first = {}
    for doc_id, text in docs:
        w = words(text)
        for i in range(len(w) - least + 1):
            key = tuple(w[i : i + least])
            known = first.get(key)
            if doc_id is not None and (known is None or doc_id < known):
                first[key] = doc_id
    out = []
    for doc_id, text in docs:
        w, gone = words(text), set()
        for i in range(len(w) - least + 1):
            smallest = first.get(tuple(w[i : i + least]))
            if smallest is not None and (doc_id is None or doc_id > smallest):
                gone.update(range(i, i + least))
        out.append((doc_id, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def made():
    r = random.Random(6)
    word = lambda: r.choice(["a", "b", "c", "é", "W", "w", "x-1"])
    base = [word() for _ in range(120)]
    docs = []
    for k in range(70):
        a = r.randrange(100)
        kind = k % 5
        text = [word() for _ in range(r.randrange(40))] + base[a : a + r.randrange(40)] if kind < 3 else list(base)
        if kind == 4:
            text[r.randrange(len(text))] = "edit"
        docs.append((k if r.random() < 0.9 else None, r.choice([" ", "\t", "\n ", "\x0b"]).join(text)))
    docs += [(200 + k, " ".join(base)) for k in range(30)] + [(-7, " ".join(base[30:60])), (300, "a " * 500), (301, "a " * 400 + "b"), (302, None), (303, ""), (304, " \n")]
    docs += [(305, " ".join(base)), (None, " ".join(base)), (5, "q " * 30), (5, "q " * 40), (5, "q " * 30), (306, " ".join(base[:20]))]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(*x, "a", 3) for x in docs], "doc_id long, text string, anchor string, found int").repartition(4)


def test_kept_words_match_brute_force(spark, monkeypatch):
    docs = made()
    want = plain(docs, 8)
    for leaves, together in ((2000, 20_000), (5, 40), (1, 1)):
        monkeypatch.setattr(prefix_trees, "TOGETHER", together)
        got = without_repeated_words(frame(spark, docs), least=8, gram=3, leaves=leaves).collect()
        assert sorted(map(tuple, got), key=repr) == want
    assert without_repeated_words(frame(spark, docs).limit(0)).count() == 0


def test_string_ids_and_long_texts(spark, monkeypatch):
    r = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(60))
    docs = [("b", " ".join(f"w{r.randrange(9)}{k}" for k in range(20_000)) + " " + passage), ("a", passage + " tail"), ("c", "x " * 20_000)]
    monkeypatch.setattr(prefix_trees, "BLOCK", 1000)
    rows = without_repeated_words(spark.createDataFrame(docs, "doc_id string, text string")).collect()
    assert sorted(map(tuple, rows)) == plain(docs, 13)


def test_every_window_has_one_place_and_equal_windows_equal_anchors():
    r = random.Random(1)
    texts = [" ".join(r.choice("abcd") for _ in range(n)).encode() for n in (3000, 0, 6, 7, 8, 40, 500)]
    ids = [Hasher().words(t) for t in texts]
    parts = [(k, b, x[b : b + 257 + 6]) for k, x in enumerate(ids) for b in range(0, len(x), 257)]
    seen, anchors = {k: [] for k in range(len(ids))}, {}
    for row, a, c, i, j in zip(*(x.tolist() for x in places(parts, 7, 3)), strict=True):
        seen[row] += range(i, j + 1)
        for k in range(i, j + 1):
            assert anchors.setdefault(tuple(ids[row][k : k + 7].tolist()), a) == a
        assert anchors.setdefault((a, c), tuple(ids[row][i : j + 7].tolist())) == tuple(ids[row][i : j + 7].tolist())
    assert all(places == list(range(max(0, len(ids[k]) - 6))) for k, places in seen.items())


def test_filter_passes_every_key_and_few_others(spark):
    rows = spark.range(60_000).select(F.xxhash64("id").alias("anchor"), "id")
    kept = prefix_trees._perhaps(rows, rows.where("id < 5000").select("anchor"), 5000)
    assert kept.where("id < 5000").count() == 5000 and kept.count() < 5000 + 0.08 * 55_000


def test_words_of_long_texts_come_in_pieces(monkeypatch):
    r = random.Random(2)
    text = b"ab  c " * 5000 + b"x" * 3000 + b" y\t\xc3\xa9\n" + b" ".join(bytes(r.choice(b"abc") for _ in range(r.randint(1, 9))) for _ in range(3000))
    whole = Hasher().words(text)
    known = {}
    assert all(known.setdefault(w, h) == h for w, h in zip(text.split(), whole.tolist(), strict=True)) and len(set(known.values())) == len(known)
    monkeypatch.setattr("sievecraft.llm.common.PIECE", 64)
    monkeypatch.setattr(prefix_trees, "PIECE", 64)
    assert [w for part in word_lists(text) for w in part] == text.split()
    assert Hasher().words(text).tolist() == whole.tolist()
    assert [x.tolist() for x in Hasher().of([b"", b"ab c", b" ", b"", b"c"])] == [[], [known[b"ab"], known[b"c"]], [], [], [known[b"c"]]]


def test_internal_nodes_are_those_of_the_tree():
    r = random.Random(5)
    suffixes = sorted("".join(r.choice("ab") for _ in range(6)) for _ in range(60))
    common = [0] + [next((k for k in range(6) if x[k] != y[k]), 6) for x, y in zip(suffixes, suffixes[1:])]
    want = set()
    for depth in range(1, 7):
        for prefix in {s[:depth] for s in suffixes}:
            leaves = [k for k, s in enumerate(suffixes) if s.startswith(prefix)]
            if len(leaves) > 1 and (depth == 6 or len({suffixes[k][: depth + 1] for k in leaves}) > 1):
                want.add((depth, leaves[0], leaves[-1] + 1))
    assert set(internal_nodes(common)) == want and list(internal_nodes([0])) == []


def test_query_over_the_driver_tables(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = without_repeated_words(base).select("doc_id", "n_words", "n_removed", "kept")
    assert sorted(map(tuple, rows.collect()), key=repr) == plain([tuple(x) for x in base.collect()], 13)
    assert rows.agg(F.sum("n_removed")).first()[0] > 0


def test_only_suffixes_of_full_prefixes_meet_the_next(spark):
    # 12 of 30 begin alike, so the others are done with after the first prefix
    word = lambda k: k.to_bytes(8, "big")
    rows = [(k, k, k, 0, word(1) * 2 + word(k % 2) * 6) for k in range(12)] + [(k, k, k, 0, word(k) * 8) for k in range(20, 38)]
    suffixes = spark.createDataFrame(rows, "doc_id long, anchor long, context long, window int, words binary")
    scratch = prefix_trees.Scratch(spark, "words")
    found = prefix_trees._repeated(suffixes, 8, 4, "bigint", scratch)
    assert sorted(r.anchor for r in found.collect()) == list(range(2, 12))
    assert "LeftOuter" not in found._jdf.queryExecution().optimizedPlan().toString()
    # the tables of full prefixes of 2, 6 and 8 words with the suffixes below each: 12, 12 and 12 of 30
    assert [spark.read.parquet(f"{scratch.path}/{k}").count() for k in (2, 4, 6)] == [12, 12, 12]
    scratch.drop()
