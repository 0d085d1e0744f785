"""Cleaning columns on hand-made rows."""

from pyspark.sql import functions as F

from scrivano.functions import text as tx

TERMINATED = ["", "\n", "a\n", "a\r\nb", "a\x0cb\x1cc\x85d e\n\n", " \t x\x1f ", "x\u2028y", "\xa0 z \x0b"]

LETTERS = [  # doubled texts, by hand
    ("aabbccddeeffgghhiijjkkllmmnnoopp", "abcdefghijklmnop"),
    ("aabbccddeeffgghhiijjkkllmmnnoo", "aabbccddeeffgghhiijjkkllmmnnoo"),  # thirty are too few
    ("aabbccddeeffgghhiijjkkllmmnnooppéé 11", "abcdefghijklmnopé 1"),
    ("ab" * 40, "ab" * 40),
    ("x " * 3000 + "aabb " * 2000, "x " * 3000 + "ab " * 2000),  # the fault starts late
]

MARKS = [
    ("a,, b.. c:: d;; e", "a, b. c: d; e"),
    ("one '' two `` three (( four )) five ’’", "one ' two ` three ( four ) five ’"),
    ("3//11 a--b--c - -- x", "3//11 a-b--c - -- x"),
    ("...", ".."),
    ("x" * 4000 + ",, y--z", "x" * 4000 + ", y-z"),  # the fault starts late
]

CLEAN = [
    ("page 3 OF 9 x", "x"),
    ("a\r\nb\rc", "a\n\nb\nc"),
    ("a\n\n 12 \n\n\nb", "a\n\nb"),
    ("\t\xa0 text \n", "text"),
    ("", ""),
]


def both(spark, pairs, apply):
    df = spark.createDataFrame([(i, before) for i, (before, _) in enumerate(pairs)], "id long, text string")
    got = {r.id: r.text for r in apply(df).collect()}
    assert got == {i: after for i, (_, after) in enumerate(pairs)}


def test_lines_and_strip_follow_unicode(spark):
    df = spark.createDataFrame(list(enumerate(TERMINATED)), "id long, text string")
    t = F.col("text")
    for r in df.select("text", tx.strip(t).alias("s"), tx.lines_of(t).alias("l"), tx.line_count(t).alias("n")).collect():
        assert (r.s, r.l, r.n) == (r.text.strip(), r.text.splitlines(), len(r.text.splitlines()))


def test_lines_are_counted_without_copies_of_them(spark):
    texts = [None, "", "\r", "\n\r", "a\r\n\r\n", "a\r\r\nb", "\x1c", "a\x1e\u2029b\x85", "é\u2028", "\x1f", "a\tb"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("text", tx.line_count(F.col("text")).alias("n"))
    assert [r.n for r in df.collect()] == [None if x is None else len(x.splitlines()) for x in texts]
    # No pattern that runs over the text of a line: only boundaries are matched.
    assert "[^" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_doubled_letters(spark):
    both(spark, LETTERS, tx.with_collapsed_letters)


def test_doubled_marks(spark):
    both(spark, MARKS, tx.with_collapsed_marks)


def test_clean_text(spark):
    both(spark, CLEAN, tx.clean_text)


def test_null_text_and_switches(spark):
    df = spark.createDataFrame([(1, None), (2, "aabb" * 20 + ",,")], "id long, text string")
    assert [r.text for r in tx.clean_text(df).orderBy("id").collect()] == [None, "ab" * 20 + ","]
    kept = tx.clean_text(df, fix_doubles=False, fix_punctuation=False).orderBy("id").collect()
    assert kept[1].text == "aabb" * 20 + ",,"


def test_previews_and_sizes(spark):
    df = spark.createDataFrame([("x" * 500,), ("y" * 501,), ("",)], "t string")
    t = F.col("t")
    rows = df.select(
        tx.preview(t, 500, "if_cut").alias("a"),
        tx.preview(t, 200, "always").alias("b"),
        tx.preview(t, 60).alias("c"),
        *[c.alias(n) for n, c in tx.size_change(t, F.substring(t, 1, 100)).items()],
    ).collect()
    assert [len(r.a) for r in rows] == [500, 503, 0]
    assert rows[2].b == "..." and len(rows[0].c) == 60
    assert rows[0].removed_chars == 400 and rows[0].removed_pct == 80.0 and rows[2].removed_pct == 0.0


def test_cleaning_references_the_text_once_per_step(spark):
    df = spark.createDataFrame([(1, "a")], "id long, text string")
    plan = tx.clean_text(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") <= 4 and len(plan) < 20_000
