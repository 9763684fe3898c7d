
from marginalia.operators import extraction as E
from marginalia.plans import catalogue

WORDS = ["none", "rivers in winter", "stones and ice", "wind over hills", "paper and ink", "trains"]


class GOOD:
    @staticmethod
    def format(n):
        return f"These are plain English sentences about {WORDS[n]}."


def test_pages_that_could_not_be_read_and_more_than_ocr_may_take(spark):
    rows = [("a", 1, GOOD.format(1), None), ("a", 2, None, None), ("a", 3, "\n" * 30, GOOD.format(3)), ("a", 4, "", GOOD.format(4)), ("a", 5, "x", GOOD.format(5)), ("b", 1, None, None), ("b", 2, None, None), ("c", 1, GOOD.format(1), None)]
    raw = spark.createDataFrame(rows, "doc string, page_no int, text string, ocr_text string")
    final = E.final_pages(E.with_ocr(raw, 3))
    got = {r["doc"]: (r["n_text"], r["error"], r["warnings"]) for r in E.document_status(raw, final, True, 3).collect()}
    assert got["b"] == (0, E.DAMAGED, []) and got["c"] == (1, None, [])
    assert got["a"][:2] == (3, None) and [w.split(" ")[0] for w in got["a"][2]] == ["1", "Only", "2", "2"] and "first 3 " in got["a"][2][1]


def test_good_page_among_white_space_pages_is_kept(spark):
    from marginalia.operators import pages as P

    rows = [("d", 1, GOOD.format(1)), ("d", 2, "\n" * 30), ("d", 3, " \t\n" * 30)]
    got = {r["page_no"]: (r["readable"], r["doc_quality"] > 0.3) for r in P.scored(spark.createDataFrame(rows, "doc string, page_no int, text string")).collect()}
    assert got == {1: (True, True), 2: (False, True), 3: (False, True)}


def test_reports_say_how_they_were_made(spark, sf_dir):
    bodies = [r["body"] for r in catalogue.QUERIES["corpus_reports"](spark, sf_dir).collect()]
    assert bodies and all("by extractive (single-pass, 1 chunk(s)" in b or "by extractive (map-reduce, " in b for b in bodies)
