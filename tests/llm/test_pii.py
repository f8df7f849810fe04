import hashlib
import random
import re

from sievecraft.llm.pii import find_personal_data, op4_pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain(text):
    found = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                (kind == "ip" and any(int(x) > 255 for x in m[0].split(".")))
                or (kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)))
                or (kind == "phone" and not 10 <= len(digits) <= 15)
            ):
                continue
            found.append((m.start(), rank, m.end(), kind))
    return sorted(found)


HARD = [
    None, "", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "a.b@c.d.e@f.g", "+1 234 567 8901-", "x" * 5000 + "@", " 4111 1111 1111 1111 ", "0004.1.1.300 000255.1.1.1",
    "😀 a@b.co +49 (30) 1234567 iban GB82 WEST 1234 5698 7654 32", "a@b.c " * 700, "x@" + "a." * 4000 + "b", "1.1.1.1 " * 300, "ssn 123-45-6789", "number 123-45-6789",
]


def test_base_spans_match_brute_force(spark):
    r = random.Random(3)
    texts = HARD + ["".join(r.choice("ab1 20.@+-_(%é\n45") for _ in range(r.randint(1, 100))) for _ in range(600)]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(3)
    got = {x.doc_id: [(s.start, s["rank"], s.end, s.kind) for s in x.spans] for x in find_personal_data(docs).collect()}
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s[1] < 4] == plain(t), t
    extra = {i: [t[s[0] : s[2]] for s in got[i] if s[1] >= 4] for i, t in enumerate(texts) if t}
    assert extra[9] == ["GB82 WEST 1234 5698 7654 32"] and extra[13] == ["123-45-6789"] and extra[14] == []
    assert find_personal_data(docs.limit(0)).count() == 0


def test_query(spark, tmp_path):
    rows = [(1, "mail a@b.co, ip 10.0.0.1"), (2, None), (2, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(op4_pii(spark, str(tmp_path)).collect(), key=lambda r: r.doc_id)
    assert (got[0].n_email, got[0].n_ip, got[0].n_card, got[0].spans) == (1, 1, 0, "email:5:11,ip:16:24")
    assert got[0].base_sha256 == hashlib.sha256(b"email:5:11,ip:16:24").hexdigest()
    assert [r.base_sha256 for r in got[1:]] == [hashlib.sha256(b"").hexdigest()] * 2
