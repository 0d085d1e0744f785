"""Sectioning: documents by hand, and properties of random ones."""

import random

from pyspark.sql import functions as F

from scrivano.operators import sections as sec
from scrivano.operators.front_matter import remove_front_matter

LINES = [
    "", " ", "Contents", "Table of Contents", "Subject Page", "Preface", "Preface ..... 51",
    "Shari'ah Standard No. (1): Trading", "Shari’ah Standard No. (2)", "shari'ah standard no. 3",
    "Shari'ah Standard No. (4) ...... 9", "Statement of the Standard", "Statement of the Standard .... 3",
    "Scope ...... 12", "Note: see .... 4", "2//1 Title one", "2//1//3 Deep title", "2//1//1//1 x",
    "2019 was a year", "1. Scope of it", "2//1", "3//1 Title ..... 9 more", "3//2 Title .... 9",
    "2//1,2//1,Default ....... 88,89", "2//1//2,2//1,Default", "1. Scope ..... 88",
    "Appendix (a): History ..... 5", "Appendix", "Appendices", "(Revised Standard)", "plain text",
    "more plain text that is long enough to be a paragraph of its own in some section, well above "
    "one hundred characters in total", "  indented  ", "dots ... 5 inside", "4 Four", "5//2   Five",
    "a\x0cb", "x\x1cy", "9//9 t z",
]


def documents(n=500):
    rng = random.Random(11)
    out = []
    for _ in range(n):
        pool = rng.sample(LINES, rng.randrange(3, len(LINES)))
        body = [rng.choice(pool) for _ in range(rng.randrange(0, 40))]
        if rng.random() < 0.85:
            body.insert(rng.randrange(len(body) + 1), "Shari'ah Standard No. (1): Trading")
        out.append(rng.choice(["\n", "\n", "\r\n"]).join(body) + rng.choice(["", "\n"]))
    return out


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


DOCUMENT = """lost
Shari'ah Standard No. (1): Trading
Contents
Scope ...... 12
Note: see .... 4
Preface

2//1 Title one
first line
Scope ...... 12
  second line
2//1//3 Deep title
deep text
2//1,2//1,Default ....... 88,89
(Revised Standard)
Appendix
last"""


def test_cleaning_by_hand(spark):
    texts = [DOCUMENT, "no standard here", "Shari'ah Standard No. (1)\nContents\n2//9 Late .... 5\nend"]
    cut = sec.cut_to_first_standard(frame(spark, texts))
    got = {r.doc_id: r.text for r in sec.drop_contents_lines(cut).collect()}
    assert got[0].startswith("Shari'ah Standard No. (1): Trading") and "lost" not in got[0]
    assert "Scope ......" not in got[0] and "second line" in got[0]
    assert 1 not in got


def test_sections_by_hand(spark):
    rows = sec.sectionize(frame(spark, [DOCUMENT])).orderBy("line_number").collect()
    assert [(r.section_path, r.section_number) for r in rows] == [("2//1", "2//1"), ("2//1//3", "2//1//3")]
    assert rows[0].content.startswith("Title one") and rows[0].content.endswith("second line")
    assert rows[1].content == "Deep title\ndeep text\nlast"


def test_a_header_with_a_leader_emits_the_open_section(spark):
    text = "Shari'ah Standard No. (1)\n2//1 One\nbody\n3//1 Title ..... 9 more\nafter"
    rows = sec.extract_sections(frame(spark, [text])).orderBy("content_length").collect()
    assert len(rows) == 2 and rows[1].content.startswith(rows[0].content)
    assert {r.line_number for r in rows} == {2}
    assert sec.extract_sections(frame(spark, [text]), emit_prefixes=False).count() == 1


def test_kept_lines_come_from_the_document_in_order(spark):
    texts = documents(200)
    cleaned = sec.drop_contents_lines(sec.cut_to_first_standard(frame(spark, texts)))
    for r in cleaned.collect():
        left = iter(line.strip() for line in texts[r.doc_id].splitlines())
        assert all(line.strip() in left for line in r.text.splitlines() if line.strip())
        assert "\n\n\n" not in r.text
    again = sec.cut_to_first_standard(cleaned)
    assert again.count() <= cleaned.count()


def test_section_rows_are_consistent(spark):
    cleaned = sec.drop_contents_lines(sec.cut_to_first_standard(frame(spark, documents(200))))
    lines = {r.doc_id: [x.strip() for x in r.text.splitlines()] for r in cleaned.collect()}
    by_start = {}
    for r in sec.extract_sections(cleaned).collect():
        assert r.section_number == r.section_path and r.content_length == len(r.content) > 0
        header = lines[r.doc_id][r.line_number - 1]
        assert header.startswith(r.section_path) and r.content.split("\n")[0] in header
        by_start.setdefault((r.doc_id, r.line_number), []).append(r.content)
    assert any(len(parts) > 1 for parts in by_start.values())
    for parts in by_start.values():
        parts.sort(key=len)
        assert all(b.startswith(a) for a, b in zip(parts, parts[1:]))
    longest = sec.extract_sections(cleaned, emit_prefixes=False)
    assert longest.count() == len(by_start)
    assert sec.drop_toc_sections(longest).exceptAll(longest).count() == 0


def test_front_matter_by_hand(spark):
    texts = ["", "Preface", "Shari'ah Standard No. (1)\nPreface\n\nwords\nStatement of the Standard\n2//1 Body\ntext"]
    got = {r.doc_id: r.text for r in remove_front_matter(frame(spark, texts)).collect()}
    assert got[0] == "" and "words" not in got[2] and got[2].endswith("2//1 Body\ntext")


def test_no_shuffle_and_no_python(spark):
    df = frame(spark, documents(20))
    plan = sec.sectionize(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Sort" not in plan


def test_totals(spark):
    rows = sec.sectionize(frame(spark, ["Shari'ah Standard No. (1)\n2//1 Abc\n2//2 Defg"]))
    total = sec.corpus_totals(rows).first()
    assert (total.sections, total.total_length) == (2, 7)
    assert [r.section_number for r in sec.first_sections(rows, 1).collect()] == ["2//1"]
    assert sec.corpus_totals(rows.filter(F.lit(False))).first().total_length == 0
