"""Sections raised out of body text, found in served pages and merged over sources: plain loops over all blocks, families by hand, odd input."""

import re
from itertools import groupby

import pytest

from ferrule.operators import synthesis as S
from ferrule.plans import synthesis as plan

SF = "/root/testdata/sf0.01"
BLOCK = "doc string, family string, page long, pos long, y double, part string, label string, layer string, text string, orig string"


def clean(t):
    return re.sub(r"\s+", " ", t or "").strip(" ")


def parse(t):
    t = clean(t)
    if not t or t.lower().startswith(S.NO_HEADING):
        return None
    t = re.sub(r"^#{1,6}\s*", "", t).strip(" ")
    for p in S.HEADINGS:
        if m := re.match(p, t):
            return m[1], (m[2] or "").strip(" ")
    return None


def parent(sid):
    if "." in sid:
        return sid.rsplit(".", 1)[0]
    m = re.match(r"((?:C-)?[A-Z])\d", sid)
    return m[1] if m else None


def capitals(title):
    letters = [c for c in title if c.isalpha()]
    return len(letters), sum(c.isupper() for c in letters) / max(1, len(letters))


def no_bullet(t):
    return re.sub(r"^[-*•]\s*", "", clean(t))


def raised(rows):
    """(part, sid, title, page, parent, synthetic, pos) of one document's blocks, block by block."""
    rows = sorted((r for r in rows if r.layer == "body"), key=lambda r: r.pos)
    out = [(r.part or "standard", *h, r.page, parent(h[0]), False, r.pos) for r in rows if r.label == "section_header" and (h := parse(r.text))]
    family, seen, above = rows[0].family if rows else None, {x[:2] for x in out}, {}

    def add(r, sid, title, up):
        part = r.part or "standard"
        if (part, sid) not in seen:
            seen.add((part, sid))
            out.append((part, sid, title, r.page, up, True, r.pos))

    if family in ("implied", "implied decimal"):
        for r in sorted(rows, key=lambda r: (10**9 if r.page is None else r.page, -(r.y or 0), r.pos)):
            if r.label not in S.IMPLIED_LABELS:
                continue
            part, h = r.part or "standard", parse(r.text)
            if h and not h[0].isdigit():
                sid, (n, share) = h[0], capitals(h[1])
                if re.fullmatch(r"[A-Z]\d+[a-z]?", sid):
                    if n < 4 or share >= 0.75:
                        above[part] = sid
                elif m := re.match(r"[A-Z]\d+[a-z]?", sid):
                    above[part] = m.group()
                elif family == "implied decimal" and re.match(r"\d+\.\d+", sid):
                    above[part] = sid
            elif (m := re.match(S.SUBHEAD, clean(r.text))) and part in above and 0 < len(m[2].strip(" ")) <= 140:
                add(r, f"{above[part]}.{m[1]}", m[2].strip(" "), above[part])
    elif family in S.SHAPES:
        for labels in [("section_header",), S.LABELS] if family == "numeric" else [S.LABELS]:
            for r in rows:
                h = parse(no_bullet(r.orig)) or parse(no_bullet(r.text)) if r.label in labels else None
                if not h or not re.match(S.SHAPES[family], h[0]) or (family == "lettered" and re.search(r"\.{4}|…", r.text or "")) or (family == "numeric" and not h[1] and h[0].count(".") > 1):
                    continue
                add(r, h[0], h[1][:200].rstrip(" "), parent(h[0]))
            if len(out) >= 5:
                break
    return out


def finished(rows):
    """Without previews, with children."""
    kept = []
    for x in rows:
        m = re.match(S.ROOT, x[1])
        if x[0] == "standard" and x[3] is not None and m and m.group() != x[1]:
            tops = [(capitals(y[2]), y[3]) for y in rows if y[0] == "standard" and y[1] == m.group() and y[3] is not None]
            body = [p for (n, share), p in tops if n >= 3 and share >= 0.75] or [p for _, p in tops]
            if body and x[3] < min(body):
                continue
        kept.append(x)
    last = {x[:2]: i for i, x in enumerate(kept)}
    return [(*x, ",".join(dict.fromkeys(y[1] for y in kept if (y[0], y[4]) == x[:2])) if last[x[:2]] == i else "") for i, x in enumerate(kept)]


def by_doc(df):
    rows = sorted(df.collect(), key=lambda r: r.doc)
    return {k: list(g) for k, g in groupby(rows, key=lambda r: r.doc)}


@pytest.fixture(scope="module")
def blocks(spark):
    from ferrule.shared import stored

    return stored(plan.blocks(spark, SF), "test-")


def test_families_of_all_blocks_against_a_plain_loop(spark, blocks):
    got = S.sections(blocks).collect()
    want = {(doc, *x) for doc, rows in by_doc(blocks).items() for x in finished(raised(rows))}
    assert len(got) == len(want) > 500
    assert {(r.doc, r.part, r.sid, r.title, r.page, r.parent, r.synthetic, r.place.pos, ",".join(r.children)) for r in got} == want
    assert {r.synthetic for r in got} == {True, False} and sum(bool(r.children) for r in got) > 50


def test_pages_against_a_plain_loop(spark, blocks):
    known = S.synthesised(blocks)
    pages = plan.served(spark, SF)
    have = {(r.doc, r.part, r.sid) for r in known.collect()}
    want = set()
    for doc, rows in by_doc(pages).items():
        for edition in (1, 2):
            found = {}
            for r in sorted((r for r in rows if r.edition == edition), key=lambda r: r.page):
                if len(re.findall(S.GARBLED, r.text[:2000])) > 20:
                    continue
                for pos, line in enumerate(r.text.split("\n")):
                    t = no_bullet(line)
                    h = parse(t) or next(((m[1], (m[2] or "").strip(" ")) for p in S.LOOSE if (m := re.match(p, re.sub(r"^#{1,3}\s*", "", t)))), None)
                    if h and re.match(S.SHAPES["numeric"], h[0]) and (title := h[1][:200].rstrip(" ")).count(" ") <= 18 and (doc, r.part, h[0]) not in have:
                        found.setdefault((r.part, h[0]), (title, r.page, parent(h[0]), pos))
            if found:
                want |= {(doc, *k, *v) for k, v in found.items()}
                break
    got = [(r.doc, r.part, r.sid, r.title, r.page, r.parent, r.place.pos) for r in S.from_pages(known, pages).collect()]
    assert set(got) == want and len(got) == len(want) > 20


def made(spark, rows):
    """Blocks of (doc, family, page, label, text[, orig]) from top to bottom."""
    return spark.createDataFrame([(r[0], r[1], r[2], i, 700.0 - i, None, r[3], "body", r[4], r[5] if len(r) > 5 else None) for i, r in enumerate(rows)], BLOCK)


def test_each_family_by_hand(spark):
    rows = [
        ("i", "implied", 1, "section_header", "D1. LIMIT STATES"), ("i", "implied", 1, "title", "D4. H-Piles"), ("i", "implied", 2, "text", "2a. Net Area"), ("i", "implied", 2, "section_header", "D1.2 Full"), ("i", "implied", 3, "text", "3. Yielding"), ("i", "implied", 3, "text", "3. Again"),
        ("d", "implied decimal", 1, "section_header", "5.3. PREQUALIFICATION"), ("d", "implied decimal", 1, "text", "1. Beam Limitations"), ("d", "implied decimal", 1, "text", "User note 2. none"),
        ("a", "dotted", 1, "list_item", "Capacity-Limited Effect", "12.4.3.2 Capacity-Limited Effect"), ("a", "dotted", 1, "text", "- C1.1 SCOPE"), ("a", "dotted", 1, "table", "12.9 No"),
        ("l", "lettered", 1, "text", "D5.1.2 Welding...... 7"), ("l", "lettered", 2, "text", "D5.1.2 Welding inspection"), ("l", "lettered", 2, "text", "D5 Alone"),
        ("n", "numeric", 1, "section_header", "?", "SECTION 1 GENERAL"), ("n", "numeric", 1, "text", "1.1 Scope"), ("n", "numeric", 2, "paragraph", "5 65 S0"), ("n", "numeric", 2, "paragraph", "Table 7.1 Values"),
        ("m", "numeric", 1, "text", "9 Never Read"), *[("m", "numeric", 1, "section_header", f"{k}. Title") for k in range(1, 6)],
    ]
    got = {(r.doc, r.sid, r.synthetic, r.parent) for r in S.sections(made(spark, rows)).collect()}
    assert got == {
        ("i", "D1", False, "D"), ("i", "D1.2", False, "D1"), ("i", "D1.2a", True, "D1"), ("i", "D1.3", True, "D1"), ("d", "5.3", False, "5"), ("d", "5.3.1", True, "5.3"), ("a", "12.4.3.2", True, "12.4.3"), ("a", "C1.1", True, "C1"),
        ("l", "D5.1.2", True, "D5.1"), ("n", "1", True, None), ("n", "1.1", True, "1"), *[("m", str(k), False, None) for k in range(1, 6)],
    }


def test_previews_go_and_the_last_of_equal_ids_has_the_children(spark):
    rows = [("s", None, 1, "section_header", "I1.2 Compression"), ("s", None, 2, "section_header", "I1 listing of it"), ("s", None, 9, "section_header", "I1 COMPRESSION"), ("s", None, 9, "section_header", "I1.1 Scope"), ("s", None, None, "section_header", "I1.2 Nowhere"), ("s", None, 9, "text", None)]
    got = {(r.sid, r.page): r.children for r in S.sections(made(spark, rows)).collect()}
    assert got == {("I1", 2): [], ("I1", 9): ["I1.1", "I1.2"], ("I1.1", 9): [], ("I1.2", None): []}


def test_sources_of_headings_by_hand(spark):
    rows = [
        ("layout", "1", 1), ("layout", "2", 8), ("served", "2", 3), ("served", "1", 2), ("layout", "3", 8), ("served", "3", 9), ("served", "4", 8), ("served", "4", 5), ("manual", "1.1", 1), ("manual", "1.1", 2),
        ("old", "1.2", 4), ("old", "1.2.1", 4), ("old", "2.1.1", 4), ("old", "2.1", 4), ("old", "1.41", 4), ("old", "7", 4), ("old", "3.a", 4), ("old", "1", 4), ("old", "1.2", 5), (None, "1.3", 4), ("old", None, 4), ("layout", "5", None),
    ]
    heads = spark.createDataFrame([("d", o, i, s, f"t{i}", p, "x") for i, (o, s, p) in enumerate(rows)], "doc string, origin string, pos long, sid string, title string, page long, sheet string")
    amended = spark.createDataFrame([("d", 8), ("d", 9), ("d", None), ("d", 8)], "doc string, page long")
    got = {r.sid: (r.title, r.source, r.sheet_page) for r in S.merged(heads, amended).collect()}
    assert got == {
        "1": ("t0", "layout", None), "2": ("t2", "served, amendment consolidated", 8), "3": ("t4", "layout", None), "4": ("t7", "served, amendment consolidated", 8), "1.1": ("t9", "manual", None),
        "1.2": ("t10", "old", None), "1.2.1": ("t11", "old", None), "2.1": ("t13", "old", None), "5": ("t21", "layout", None),
    }


def test_nothing_in_nothing_out(spark):
    none = spark.createDataFrame([], BLOCK)
    assert S.sections(none).count() == 0
    assert S.from_pages(S.synthesised(none), spark.createDataFrame([("n", 1, 1, None, None), ("n", 1, 2, None, "")], "doc string, edition int, page long, part string, text string")).count() == 0
    assert S.merged(spark.createDataFrame([], "doc string, origin string, pos long, sid string, title string, page long"), spark.createDataFrame([], "doc string, page long")).count() == 0
