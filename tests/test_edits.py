"""Block inserts and splices against plain loops, and that twice is once."""

import re

from ferrule.operators import edits as E
from ferrule.plans import edits as plan

SF = "/root/testdata/sf0.001"


def by_loop(text, todo):
    missing = []
    for _, tag, body, anchor, supersede, after_image in sorted(todo, key=lambda e: e[0]):
        text = re.sub(rf"(?s)\n*<!-- {re.escape(tag)}:start -->.*?<!-- {re.escape(tag)}:end -->\n*", "\n\n", text)
        lines = text.split("\n")
        junk = [x for x in lines if any(re.search(p, x) for p in supersede or [])]
        if junk and E.ASIDE not in lines:
            lines = [x for x in lines if x not in junk] + [E.ASIDE] + [x.replace("--", "- -") for x in junk] + ["-->"]
        at = next((i for i, x in enumerate(lines) if re.search(anchor, x.strip(" "))), None)
        if at is None:
            missing.append(tag)
            text = "\n".join(lines)
            continue
        if after_image:
            at = next((i for i in range(at + 1, min(at + 6, len(lines))) if lines[i] == E.IMAGE), at)
        rest = lines[at + 1 :]
        while rest and not rest[0].strip(" "):
            rest.pop(0)
        text = "\n".join([*lines[: at + 1], "", f"<!-- {tag}:start -->\n{body.strip(' ')}\n<!-- {tag}:end -->", "", *rest])
    return text, missing


ENTRY = "doc string, page long, ord int, tag string, body string, anchor string, supersede array<string>, after_image boolean"


def test_blocks_by_loop_and_twice_is_once(spark):
    pages = [("d", 1, "Fig. 1 map\ntext\n\n\nmore"), ("d", 2, f"a\n Fig. 2 x\nb\n{E.IMAGE}\n@@ noise -- 1\n@@ noise 2\nend"), ("d", 3, "no anchor @@\nhere"), ("d", 4, "untouched"), ("d", 5, None), ("d", 6, "Fig. 6"), ("e", 1, "Fig. 1\n\n<!-- K:e1:start -->\nold $1 \\ text\n<!-- K:e1:end -->\n\nafter")]
    entries = [
        ("d", 1, 1, "K:1", " new (body) $0 ", "^Fig\\. 1", None, None), ("d", 1, 2, "K:1b", "second", "^Fig\\. 1", None, False), ("d", 2, 1, "K:2", "two\nlines", "^Fig\\. 2", ["^@@"], True),
        ("d", 3, 1, "K:3", "x", "^Fig", ["@@"], False), ("d", 5, 1, "K:5", "x", "a", None, False), ("d", 6, 1, "K:6", "x", "^Fig", None, True), ("e", 1, 1, "K:e1", "new", "^Fig", None, False), ("z", 9, 1, "K:z", "x", "a", None, False),
    ]
    want = {}
    for doc, page, text in pages:
        todo = [e[2:] for e in entries if e[:2] == (doc, page)]
        want[doc, page] = (text, []) if text is None else by_loop(text, todo)
    todo = spark.createDataFrame(entries, ENTRY)
    once = E.insert_blocks(spark.createDataFrame(pages, "doc string, page long, text string"), todo)
    assert {(r.doc, r.page): (r.text, r.missing) for r in once.collect()} == want
    assert want["d", 3][1] == ["K:3"] and "old" not in want["e", 1][0] and want["d", 2][0].index("image") < want["d", 2][0].index("K:2")
    again = E.insert_blocks(once.select("doc", "page", "text"), todo).collect()
    assert {(r.doc, r.page): (r.text, r.missing) for r in again} == want


def test_inserted_blocks_of_whole_documents_by_loop(spark):
    import hashlib

    todo = {}
    for r in plan.entries(spark, SF).collect():
        todo.setdefault((r.doc, r.page), []).append((r.ord, r.tag, r.body, re.sub(r"^\^\\Q(.*)\\E$", lambda m: "^" + re.escape(m[1]), r.anchor, flags=re.S), r.supersede, r.after_image))
    want = {}
    for r in plan.pages(spark, SF).collect():
        text, missing = by_loop(r.text, todo.get((r.doc, r.page), []))
        want[r.doc, r.page] = (hashlib.sha256(text.encode()).hexdigest(), ",".join(missing))
    assert {(r.doc, r.page): (r.digest, r.missing) for r in plan.inserted_blocks(spark, SF).collect()} == want and any(m for _, m in want.values())


def test_splices_once(spark):
    pages = spark.createDataFrame([("d", 1, "see (1.2-1) here \n\n"), ("d", 2, "none"), ("d", 3, None)], "doc string, page long, text string")
    census = spark.createDataFrame([("d", 1, 1, "1.2-1", None), ("d", 1, 2, "1.2-2", "( 1.2-2 )"), ("d", 1, 3, "1.2-3", "Eq 1.2-3"), ("d", 1, 4, "1.2-3", None), ("d", 3, 1, "9", None), ("d", 4, 1, "8", "(8)"), ("d", 4, 2, "", "(x)")], "doc string, page long, ord long, id string, verbatim string")
    want = {1: "see (1.2-1) here\n( 1.2-2 ) (1.2-3)\n", 2: "none", 3: "\n(9)\n", 4: "\n(8)\n"}
    once = E.splice_tokens(pages, census)
    assert {r.page: r.text for r in once.collect()} == want and {r.page: r.spliced for r in once.collect()} == {1: 2, 2: 0, 3: 1, 4: 1}
    assert {(r.page, r.text, r.spliced) for r in E.splice_tokens(once.select("doc", "page", "text"), census).collect()} == {(p, t, 0) for p, t in want.items()}
