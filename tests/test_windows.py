import random
import re

from sievecraft.operators import windows as W

SLOT = {name: (W.SLOTS[section], 0) for name, section in W.HEADERS.items()}


def header(line):
    line = line.strip(" ")
    m = re.match(r"\[previous turn -(\d+)\]$", line)
    return (f"prev({int(m[1])})", (0, int(m[1]))) if m else (W.HEADERS[line], SLOT[line]) if line in W.HEADERS else (None, None)


def rules(lines, mark, begin, end):
    """Lines of rules between blank lines inside [begin, end), of neighbours that share a blank line the first."""
    found = []
    for k in range(begin + 2, end - 2):
        if lines[k] == mark and lines[k - 1] == "" == lines[k + 1] and (not found or found[-1] != k - 2):
            found.append(k)
    return found


def plain(text):
    """(piece, section, kind, lines) by one walk down the lines."""
    lines = text.split("\n")
    opens = lambda x: bool(re.match(r"REPORT FROM\b", x.strip(" "))) or x.strip(" ") == W.REGION
    breaks = rules(lines, "===", 0, len(lines))
    # neighbours share a blank line: of a chain of rules only the first is one
    breaks = [k for k in breaks if not (k - 2 >= 2 and lines[k - 2] == "===" and lines[k - 3] == "" == lines[k - 1])]
    parts, highest, frozen = [], None, False
    for k, line in enumerate(lines):
        name, slot = header(line)
        behind = k - 2 in breaks
        begins = None
        if name and not frozen and (k == 0 or behind or (highest is not None and name.startswith("prev("))) and (highest is None or slot > highest):
            begins, highest = name, slot
        elif k == 0 or (behind and name is None and not frozen and highest is None):
            begins = "unknown"
        if begins:
            if behind:
                parts[-1][2] = k - 3
            parts.append([begins, k, len(lines), bool(name) and begins == name])
        frozen = frozen or opens(line) or line.strip(" ") in W.CUTS
    out = []
    for i, (section, begin, end, headed) in enumerate(parts):
        end = min(end, parts[i + 1][1]) if i + 1 < len(parts) else end
        if headed:
            out.append((section, "header", [begin]))
            begin += 1
        kind, starts = "receipt", {begin}
        if section in W.LINEWISE:
            kind, starts = ("fact" if section == "receipts" else "claim"), set(range(begin, end))
        turn = None if section in W.LINEWISE + W.REPORTED else next((k for k in range(begin, end) if opens(lines[k]) or lines[k].strip(" ") in W.CUTS), None)
        kinds = {}
        if section in W.REPORTED:
            kind, turn = "claim", begin
        elif section not in W.LINEWISE:
            found = [k for k in rules(lines, "---", begin, end) if turn is None or k < turn]
            starts |= {k + 2 for k in found if not (k - 2 - begin >= 2 and lines[k - 2] == "---" and lines[k - 3] == "" == lines[k - 1])}
        if turn is not None and turn < end:
            starts.add(turn)
            claims = section in W.REPORTED or opens(lines[turn])
            kinds = dict.fromkeys(range(turn, end), "claim" if claims else "mixed")
            region = section not in W.REPORTED and lines[turn].strip(" ") == W.REGION
            if region:
                kinds[turn] = "header"
                starts.add(turn + 1)
            if claims:
                starts |= {k for k in range(turn, end) if re.match(r"REPORT FROM\b", lines[k].strip(" ")) and (k == begin or not lines[k - 1].strip(" ") or (region and k == turn + 1))}
        starts = sorted(x for x in starts if begin <= x < end)
        for a, b in zip(starts, [*starts[1:], end]):
            own = list(range(a, b))
            while own and re.match(r"(={3,}|-{3,})?$", lines[own[-1]].strip(" ")):
                own.pop()
            if own:
                out.append((section, kinds.get(a, kind), own))
    return [(section, kind, own[0], own[-1], "\n".join(lines[k] for k in own)) for section, kind, own in out]


PIECES = ["[current turn]", "[session receipts]", "[current turn reports]", "[relayed reports in previous turns]", "[contributed by check arms]", "[previous turn -1]", "[previous turn -2]", "REPORT FROM al (unverified worker claim)", "REPORT FROMx", W.REGION, *W.CUTS]


def fuzz(r):
    n = r.randint(1, 12)
    line = lambda: r.choice(PIECES) if r.random() < 0.35 else r.choice(["a", "b c", "", " ", "MERGED PR #5", "---", "==="])
    return "".join(line() + r.choice(["\n", "\n", "\n\n===\n\n", "\n\n---\n\n", "\n\n"]) for _ in range(n)) + line()


def test_pieces_match_a_walk_down_the_lines(spark):
    r = random.Random(12)
    texts = [fuzz(r) for _ in range(1500)] + ["", None, "x", "===\n\n[current turn]", "[current turn]\n\n---\n\nx"]
    frame = spark.createDataFrame(list(enumerate(texts)), "window_id int, text string").repartition(4)
    lines = W.window_lines(frame).cache()
    got = {}
    for p in W.pieces(lines).collect():
        got.setdefault(p.window_id, []).append(p)
        assert p.trusted == (p.kind in ("fact", "receipt"))
    for k, text in enumerate(texts):
        own = [(p.section, p.kind, p.first_line, p.last_line, p.text) for p in sorted(got.get(k, []), key=lambda p: p.piece)]
        assert own == (plain(text) if text else []), text
        # no trusted item stands behind a report label; receipts are lines of the composer's own
        first = next((i for i, x in enumerate((text or "").split("\n")) if re.match(r"REPORT FROM\b", x.strip(" "))), 10**9)
        assert all(p.last_line < first for p in got.get(k, []) if p.kind == "receipt")
    # each line is of one piece or glue
    assert lines.count() == sum(t.count("\n") + 1 for t in texts if t)
    assert lines.select("window_id", "line").distinct().count() == lines.count()


COMMAND = "[from: gh pr merge 7 @ /w]"


def verdict(spark, text, draft="PR #7 was merged."):
    lines = W.window_lines(spark.createDataFrame([(1, text)], "window_id int, text string"))
    rows = W.state_verdicts(spark.createDataFrame([(1, draft)], "window_id int, draft string"), W.state_signals(lines)).collect()
    return [(r.number, r.blocked, r.raw_state, r.rule) for r in rows]


def test_verdicts_on_a_merge(spark):
    json = '{"number": 7, "state": "OPEN"}'
    rule = "\n\n===\n\n"
    assert verdict(spark, f"[session receipts]\n{json}{rule}[current turn]\nMERGED PR #7") == [("7", False, None, None)]
    assert verdict(spark, f"[session receipts]\nMERGED PR #7{rule}[current turn]\n{json}") == [("7", True, "open", "C")]
    assert verdict(spark, f"[current turn]\nMERGED PR #7\n\n---\n\n{json}") == [("7", True, "open", "A")]
    assert verdict(spark, f"MERGED PR #7{rule}{json}") == [("7", True, "open", "A")]
    assert verdict(spark, f"[current turn]\ndone {COMMAND}\n\n---\n\n#7 is still open") == [("7", True, "open", "B")]
    assert verdict(spark, f"[current turn]\ndone {COMMAND}") == [("7", False, None, None)]
    assert verdict(spark, f"[session receipts]\n{json}{rule}[current turn reports]\nREPORT FROM a (unverified worker claim)\nMERGED PR #7") == [("7", True, "open", "C")]
    assert verdict(spark, "[current turn]\nMERGED PR #8") == [] and verdict(spark, "[current turn]\nMERGED PR #7", "PR #7 is done") == []


def test_sources_sections_and_newest(spark):
    text = "[previous turn -2]\n$ ls [from: ls @ /tmp]\n#7 x\n\n===\n\n[session receipts]\nMERGED (#7) [from: gh pr merge 7]\nno change\n\n===\n\n[current turn reports]\nREPORT FROM bo (unverified worker claim)\n#7"
    lines = W.window_lines(spark.createDataFrame([(1, text)], "window_id int, text string"))
    parts = W.pieces(lines)
    assert [(p.kind, p.source) for p in parts.orderBy("piece").collect() if p.kind != "header"] == [("receipt", "ls @ /tmp"), ("fact", "gh pr merge 7"), ("fact", None), ("claim", "bo")]
    assert [r.section for r in W.sections(parts).orderBy("place").collect()] == ["prev(2)", "receipts", "reports"]
    assert [(r.number, r.section) for r in W.receipts_for(parts).orderBy("place").collect()] == [("7", "receipts"), ("7", "prev(2)")]
    assert W.newest(parts).first().text.startswith("REPORT FROM bo") and W.by_kind(parts, "claim").count() == 1
    assert W.select_lines(lines, kinds=("header",)).count() == 3 and W.select_lines(lines, section="receipts", trusted=True).count() == 2
