import random
import re
from itertools import permutations

from sievecraft.llm.filter_audit import audit, matrices, outcomes, text_filters


def fails(rows):
    out = []
    for doc_id, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        found = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text))}
        found["E"] = doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows)
        out.append((lang or "", doc_id, {k for k, v in found.items() if v}))
    return out


def plain(rows, labels):
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    tagged, want = fails(rows), {}
    for part in {x[0] for x in tagged}:
        own = [x for x in tagged if x[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                out = [x for x in left if f in x[2]]
                gone = [x for x in own if f in x[2] and x[2] & set(order[: step - 1])]
                left = [x for x in left if f not in x[2]]
                total[f] += len(out)
                want[part, "".join(order), step] = [len(left), len(out), len(gone), sum(x[2] == {f} for x in own), sum(x[1] in good for x in out), sum(x[1] in toxic for x in out)]
        for key, x in want.items():
            if key[0] == part:
                x.append(total[key[1][key[2] - 1]])
    return want


def made():
    r = random.Random(3)
    rows = []
    for k in range(60):
        words = r.choices([f"w{i}" for i in range(r.choice([20, 400]))], k=r.choice([0, 150, 199, 200, 260]))
        text = " \t".join(w.upper() if r.random() < 0.05 else w for w in words) + r.choice(["", "", " $5", "|"])
        rows.append((k, text, r.choice(["en", "de", None])))
    rows += [(100 + k, rows[r.randrange(60)][1], r.choice(["en", "fr"])) for k in range(30)]
    rows += [(None, rows[0][1], "en"), (None, None, None), (200, None, "de"), (201, "", "fr"), (202, "x" * 300_000, "fr"), rows[5], rows[5], (-4, " ".join(["é"] * 300), "en")]
    labels = [(k, r.randrange(2), r.randrange(2)) for k in range(0, 130, 2)] + [(0, 1, 1), (0, 0, 0), (None, 1, 1), (3, None, None)]
    return rows, labels


def test_outcomes_match_brute_force_with_clashing_names(spark):
    rows, labels = made()
    docs = spark.createDataFrame([(*x, "a", 7) for x in rows], "doc_id long, text string, lang string, digest string, mask int").repartition(4)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit(docs, known, text_filters(), copies="E").collect()
    want = plain(rows, labels)
    assert len(got) == len(want) == 600 * 4
    for r in got:
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] == want[r.part, r.filter_order, r.step]
    assert audit(docs.limit(0), known, text_filters(), copies="E").count() == 0
    assert audit(docs, known.limit(0), text_filters()).count() == 24 * 4 * 4


def test_matrices_share_out_every_mask():
    columns, tables = matrices("ABCDE")
    assert all(m.shape == (32, 600) for m in tables.values())
    assert (tables["shapley"].sum(axis=1)[1:] == 120 * 120).all() and not tables["shapley"][0].any()
    last = [k for k, (_, step) in enumerate(columns) if step == 5]
    assert tables["kept"][:, last].sum() == 120 and (tables["removed"].sum(axis=1)[1:] == 120).all()


def test_too_many_filters_are_refused(spark):
    try:
        outcomes(spark.createDataFrame([], "part string, masks array<struct<mask:int,n:long,good:long,toxic:long>>"), "ABCDEFG")
    except ValueError:
        return
    raise AssertionError
