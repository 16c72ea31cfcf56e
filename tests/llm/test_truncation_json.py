from __future__ import annotations

from emberline.llm import truncation


def test_json_cut_behind_its_last_brace(spark):
    """Inside the closing fence, before it, and inside the note that follows; whole answers of each form stay whole."""
    note = "Two objects were looked at. No other object is in view."
    fenced = [(i, "k", f'```json\n{{"a": {i}}}\n```' + (f"\n{note}" if i % 3 == 0 else "")) for i in range(60)]
    bare = [(100 + i, "k", f'{{"a": {i}}}') for i in range(20)]
    broken = [(200, "k", '```json\n{"a": 1}\n``'), (201, "k", '```json\n{"a": 1}'), (202, "k", f'```json\n{{"a": 1}}\n```\n{note[:45]}'), (203, "k", '```json\n{"a": {"b": 1}')]
    df = spark.createDataFrame(fenced + bare + broken, "id int, kind string, text string")
    assert {r["id"] for r in truncation.find_cut(df).filter("is_cut").collect()} == {200, 201, 202, 203}


def test_brackets_inside_strings_do_not_count(spark):
    """A brace in a string, an escaped quote, a list left open behind whole objects, and a string left open."""
    whole = ['{"t": "a } b", "l": [1, 2]}', '{"t": "say \\"{\\" twice", "l": []}', 'Note: {"t": "x"} and a "quote', '{"t": "ends in \\\\"}']
    broken = ['{"l": [{"t": "a"}, {"t": "b"}', '{"t": "a } b', '{"t": "it said \\"}', '{"t": "}}}"', "{"]
    df = spark.createDataFrame([(t,) for t in whole + broken], "t string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(truncation.left_open(F.col("t"))).collect()] == [False] * len(whole) + [True] * len(broken)


def test_json_cut_inside_by_what_others_have_there(spark):
    """Cut in a string, behind a whole object of a list, and behind a comma; the brace in the string misleads nobody."""
    text = lambda i: f'{{"found": [{{"t": "The tank {{no {i}}} stands near the wall, so act."}}, {{"t": "All else is clear, so wait."}}], "risk": "LOW"}}'
    rows = [(i, "k", text(i)) for i in range(60)]
    at = [text(7).index("near the") + 5, text(7).index("}, {") + 1, text(7).index('"risk"') - 1, text(7).index('LOW') + 2]
    rows += [(100 + j, "k", text(7)[:n]) for j, n in enumerate(at)]
    got = truncation.find_cut(spark.createDataFrame(rows, "id int, kind string, text string")).filter("is_cut").collect()
    assert {r["id"] for r in got} == {100, 101, 102, 103}
