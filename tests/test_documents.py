"""Page layout and chat transcripts."""

from corpusloom.sources import chats, layout


def test_layout(spark):
    items = [(1, 50.0, 700.0, 20.0, "Two"), (1, 75.0, 701.0, 20.0, "words"), (1, 50.0, 680.0, 20.0, "a"), (1, 200.0, 680.0, 20.0, "b|c"), (1, 52.0, 660.0, 20.0, "1"), (1, 205.0, 660.5, 20.0, "2"), (1, 50.0, 600.0, 20.0, "end"), (1, 0.0, 10.0, 1.0, "  "), (2, 1.0, None, 1.0, "lost"), (3, 1.0, 1.0, None, "x")]
    df = spark.createDataFrame([("f", *i) for i in items], "file string, page int, x double, y double, width double, text string")
    got = {r["page"]: r["markdown"] for r in layout.page_markdown(df).collect()}
    assert got == {1: "Two words\n\n| a | b\\|c |\n| --- | --- |\n| 1 | 2 |\n\nend", 3: "x"}


def test_transcripts_come_back(spark):
    said = [(1, 0, "user", "hi\n\nyou", "t0", "Notes: a.md"), (1, 1, "ai", "<!--AGENT_REASONING:x-->\n\n\n\nanswer ", None, None), (1, 2, "user", None, "t2", None), (2, 700, "user", "[Timestamp: mine]\nmore", "t", None)]
    m = spark.createDataFrame(said, "chat int, ord int, sender string, message string, at string, context string")
    t = chats.transcripts(m)
    assert {(r["chat"], r["part"], r["messages"]) for r in t.collect()} == {(1, 0, 3), (2, 1, 1)}
    back = [tuple(r) for r in chats.parse_transcripts(t).orderBy("chat", "part", "pos").collect()]
    assert back == [(1, 0, 0, "user", "hi\n\nyou", "t0", "Notes: a.md"), (1, 0, 1, "ai", "answer", None, None), (1, 0, 2, "user", "", "t2", None), (2, 1, 0, "user", "[Timestamp: mine]\nmore", "t", None)]
