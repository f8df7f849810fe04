import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
from tokenizers import Tokenizer

from sievecraft.llm import packing
from sievecraft.llm.packing import TOKENIZER, _Ids, fullest, minimum_bin_slack, pack

DOCS = "doc_id long, text string, length string, rank int"


def test_fullest_matches_enumeration():
    r = random.Random(1)
    for _ in range(60):
        items = [r.randint(1, 12) for _ in range(r.randint(0, 7))]
        room = r.randint(0, 30)
        best = max(sum(c) for k in range(len(items) + 1) for c in combinations(items, k) if sum(c) <= room)
        counts = Counter(items)
        used = fullest(counts, sorted(counts, reverse=True), room)
        assert sum(a * b for a, b in used) == best and all(n <= counts[k] for k, n in used)


def test_plan_uses_everything_within_capacity():
    r = random.Random(2)
    counts = Counter(r.randint(1, 100) for _ in range(5000))
    counts[100] += 7000
    plan = minimum_bin_slack(counts, 100)
    used = Counter()
    for c in plan:
        assert sum(a * b for a, b in zip(c.lengths, c.many, strict=True)) <= 100
        used.update({a: b * c.times for a, b in zip(c.lengths, c.many, strict=True)})
    assert used == counts
    space, bins = [0] * 101, 0  # first-fit decreasing by least space
    for length in sorted(counts.elements(), reverse=True):
        s = next((s for s in range(length, 101) if space[s]), None)
        if s is None:
            bins += 1
            space[100 - length] += 1
        else:
            space[s] -= 1
            space[s - length] += 1
    assert sum(c.times for c in plan) <= bins
    assert minimum_bin_slack({}) == []


def test_words_have_the_ids_of_the_whole_text():
    ids = _Ids(TOKENIZER)
    for c in map(chr, range(0x180)):
        for text in (c, f"a{c}b", c + c, f"1{c}2", f".{c}.", f"A{c}", f"{c}A", f"It's{c}'LL x", c + "\u0301", f"é{c} \n{c}É"):
            assert ids.of(text) == ids.encode(text), repr(text)


def test_words_go_to_the_merges_without_the_rest_of_the_tokenizer(monkeypatch):
    text = "It's l'Élan, naïve 42% \x1f\x7f\u00ad!!ÿ\u00a0\u00b5 ofthedannt"
    want = _Ids(TOKENIZER).encode(text)
    monkeypatch.setattr(_Ids, "encode", lambda *_: 1 / 0)
    assert _Ids(TOKENIZER).of(text) == want


def test_pieces_and_places(spark):
    texts = [None, "", "Hello World", "it's  been\tA long\u00a0day\n", "x<|endoftext|> y", "e\u0301 É ǅ İ", "word " * 900, "é" * 50, "same text"] + ["same text"] * 40
    r = random.Random(3)
    texts += [" ".join(r.choice(["alpha", "Beta9", "γάμμα", "!!", "d'être"]) for _ in range(r.randint(1, 80))) for _ in range(60)]
    rows = [(i if i != 5 else None, t, "x", 0) for i, t in enumerate(texts)]
    capacity = 64
    got = pack(spark.createDataFrame(rows, DOCS).repartition(4), capacity).collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = []
    for i, t, *_ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
    assert sorted(map(repr, (tuple(x)[:5] for x in got))) == sorted(map(repr, want))
    sequences = {}
    for x in got:
        sequences.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) <= -(-sum(x.length for x in got) // capacity) + 1
    assert pack(spark.createDataFrame([], DOCS), capacity).count() == 0


def test_ranks_of_a_hot_length_are_gapless_over_groups(spark):
    rows = [(k % 7 if k % 5 else None, k, 0, 4096 if k % 3 else k % 11, k) for k in range(300)]
    cut_up = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(6)
    counts = {}
    for r in rows:
        counts[r[3]] = counts.get(r[3], 0) + 1
    for group in (1, 7, 1000):
        found = {}
        for r in packing.ranked(cut_up, counts, group).collect():
            found.setdefault(r.length, []).append(r.rank)
        assert {k: sorted(v) for k, v in found.items()} == {k: list(range(n)) for k, n in counts.items()}
