"""Edge rows from FIXTURES.md section 4 not covered elsewhere."""

from pyspark.sql import functions as F

from ragloom.operators import langdetect, lexical


def test_stop_word_only_query_matches_nothing(spark):
    ch = spark.createDataFrame([(1, "the cat and the hat", "English")],
                               "chunk_id long, content string, config string")
    q = spark.createDataFrame([(1, "the and", "English"), (2, "cat", "English"), (3, "the", "simple")],
                              "query_id long, query_text string, config string")
    got = {r.query_id for r in lexical.lexical_match(ch, q, config_col="config", query_config_col="config").collect()}
    # "the" is a stop word of the chunk's configuration, so even a 'simple' query cannot find it
    assert got == {2}


def test_language_detection_failure_without_letters(spark):
    train = spark.createDataFrame([("en", "the quick brown fox jumps over the lazy dog"),
                                   ("fr", "le renard brun saute par dessus le chien paresseux")], "lang string, text string")
    model = langdetect.train(train)
    texts = spark.createDataFrame([(1, "123 456 !!"), (2, "the dog jumps"), (3, "le chien saute")], "id long, text string")
    got = {r.id: (r.lang, r.config) for r in langdetect.with_config(langdetect.detect(texts, model, ["id"])).collect()}
    assert got[1] == (None, "simple")
    assert got[2] == ("en", "English") and got[3] == ("fr", "French")


def test_language_model_is_bounded_and_texts_meet_it_without_exchanging_trigrams(spark):
    train = spark.createDataFrame([("en", "the quick brown fox"), ("fr", "le renard brun"), (None, "lost"), ("de", None)], "lang string, text string")
    model = langdetect.train(train)
    rows = model.collect()
    assert len(rows) <= langdetect.SLOTS and {tuple(c.lang for c in r.weights) for r in rows} == {("en", "fr")}
    slots = spark.createDataFrame([("the",), (" é ",), ("😀a ",)], "g string").select(langdetect.slot("g").alias("s")).collect()
    assert [r.s for r in slots] == [(ord(g[0]) * 961 + ord(g[1]) * 31 + ord(g[2])) % langdetect.SLOTS for g in ("the", " é ", "😀a ")]
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "the fox " * 5000), (4, "le renard"), (4, "le renard")], "id long, text string")
    got = sorted((r.id, r.lang or "") for r in langdetect.detect(texts, model, ["id"]).collect())
    assert got == [(1, ""), (2, ""), (3, "en"), (4, "fr"), (4, "fr")]
    assert {r.lang for r in langdetect.detect(texts, model.limit(0), ["id"]).collect()} == {None}
    plan = langdetect.detect(texts, model, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert not any("_gram" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
