from seekspark.operators.evaluate import title_leak
from seekspark.operators.generate import lemmatize, parse_reply, query_prompts


def test_lemmatize_keeps_order_and_unknown(spark):
    df = spark.createDataFrame([(1, ["кошки", "спят", "кошки", "x"])], "id long, t array<string>")
    lem = spark.createDataFrame([("кошки", "кошка"), ("спят", "спать")], "form string, lemma string")
    assert lemmatize(df, ["id"], "t", lem).first()["lemmas"] == ["кошка", "спать", "кошка", "x"]


def test_reply_parser_and_leak(spark):
    df = spark.createDataFrame([("Sure!\n1. Who built it?\n2) When?\n\n3. Where is Rome?", "Rome")],
                               "reply string, title string")
    out = parse_reply(df).first()["queries"]
    assert out == ["Who built it?", "When?", "Where is Rome?"]
    leak = title_leak(parse_reply(df), "title", "queries").first()["leak"]
    assert leak is False
    p = query_prompts(spark.createDataFrame([("T", "body")], "title string, article string")).first()["prompt"]
    assert "T" in p and "body" in p
