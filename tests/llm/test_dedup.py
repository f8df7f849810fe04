import hashlib
import random
import re

import numpy as np
import xxhash

from sievecraft.llm.components import components
from sievecraft.llm.exact_dedup import exact_groups
from sievecraft.llm.simhash import BITS, RADIUS, covering_masks, fingerprint, near_duplicates, near_pairs

DOCS = "doc_id long, text string, lang string, print string, rank int"
HARD = [None, "", " \n\t", "a", " a ", "a b", "a b", "ab", "a\x0bb", "x y z w", "é è", "É È", "x y z w", "y" * 70000]


def rows_of(texts):
    return [(i, t, "en", "p", 1) for i, t in enumerate(texts)]


def test_exact_groups_match_brute_force(spark):
    texts = HARD * 3 + ["copy  of it"] * 40 + ["copy of it"] * 40 + [f"text {i}" for i in range(50)]
    rows = rows_of(texts) + [(None, "a", None, None, None), (3, "a", "en", "p", 1)]
    found = exact_groups(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    assert len(found) == len(rows)
    kept = {}
    for r in found:
        key = next(k for k in groups if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        assert (r.group_size, r.keep_id) == (len(groups[key]), min(groups[key])[-1])
        kept[key] = kept.get(key, 0) + r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}
    assert exact_groups(spark.createDataFrame([], DOCS)).count() == 0


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_spark_hash_agree(spark):
    for t in [*HARD, "One two THREE four five one two three", "a b c d e f g h i j k " * 40]:
        assert fingerprint((t or "").encode()) == plain_fingerprint(t)
    assert spark.sql("select xxhash64('x y z') h").first().h % 2**64 == fingerprint(b"x y z")


def test_every_small_set_of_positions_is_missed_by_a_mask():
    masks = covering_masks(list(range(BITS)))
    assert len(masks) == 2 ** (RADIUS + 1) - 1
    for _ in range(3000):
        bits = sum(1 << p for p in random.sample(range(BITS), RADIUS))
        assert any(m & bits == 0 for m in masks)


def plain_pairs(prints):
    return {(a, b) for a in prints for b in prints if a < b and bin((a ^ b) % 2**64).count("1") <= RADIUS}


def test_near_pairs_at_every_bucket_size(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 3)
    near = {int(b) ^ sum(1 << int(k) for k in rng.choice(40, rng.integers(0, 5), False)) for b in base for _ in range(60)}
    prints = sorted(near | {int(x) for x in rng.integers(0, 2**63, 50)} | {0, -1, 1})
    rows = spark.createDataFrame([(x,) for x in prints], "fp long")
    for bucket in (1000, 8, 1):
        assert {(r.u, r.v) for r in near_pairs(rows, bucket).collect()} == plain_pairs(prints)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, -3)]
    roots = {r.vertex: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert roots == {i: -3 for i in range(41)} | {100: 90, 95: 90}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates(spark):
    text = " ".join(f"w{i % 97}x{i}" for i in range(3000))
    rows = rows_of([*HARD, text, text + " tail", "head " + text, text.upper()]) + [(None, text, None, None, None)]
    found = near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    prints = {i: plain_fingerprint(t) for i, t, *_ in rows}
    assert all(int(r.fingerprint, 16) == prints[r.doc_id] for r in found) and len(found) == len(rows)
    label = {i: i for i in prints if i is not None}
    for _ in label:
        for a in label:
            for b in label:
                if bin(prints[a] ^ prints[b]).count("1") <= 3:
                    label[a] = label[b] = min(label[a], label[b])
    assert all(r.component_id == label[r.doc_id if r.doc_id is not None else len(HARD)] for r in found)
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
