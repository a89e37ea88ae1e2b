"""Exact sections: one row of contents and body, parts, the retry with commentary, scope, order."""

from ferrule.operators.lookup import exact_sections


def test_parts_duplicates_and_the_retry(spark):
    shape = "ord long, id string, doc string, part string, collection string, section_id string, children boolean, synthetic boolean, page long, title string"
    sections = [
        (1, "a", "D", "standard", "specification", "7.6", False, False, 3, "contents"), (2, "b", "D", "standard", "specification", "7.6", True, False, 2, "body"), (3, "c", "D", "commentary", "specification", "7.6", None, None, 90, "note"),
        (4, "d", "E", "standard", "specification", "7.6", False, False, 5, "same"), (5, "e", "E", "standard", "specification", "7.6", False, False, 5, "longer"), (6, "f", "E", None, "manual", "7.6", False, False, 1, "m"), (7, "g", "E", None, "manual", "7.6", False, False, 1, "m"),
        (8, "h", "D", "commentary", "specification", "9.1", False, False, 1, "only"), (9, "i", "E", "standard", "specification", "8", False, False, None, None), (10, "j", "E", "standard", "specification", "8", False, False, None, None),
    ]
    asked = [(1, "Clause 7.6.", None, False), (2, "7.6", "D", True), (3, "9.1", None, None), (4, "9.1", "E", False), (5, "h", None, False), (6, "8", None, False), (7, None, None, False), (8, "7.6", "E", True)]
    got = exact_sections(spark.createDataFrame(asked, "qid int, text string, doc string, commentary boolean"), spark.createDataFrame(sections, shape)).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.qid, r["rank"])):
        found.setdefault(r.qid, []).append(r.id)
    assert found == {1: ["b", "e", "f", "g"], 2: ["c"], 3: ["h"], 5: ["h"], 6: ["j"], 8: ["f", "g"]}
