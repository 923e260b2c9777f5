"""Leaks among inconsistent variants of the same question."""

from test_operators import docs_of

from linkatlas.llm import decontam


def test_a_leak_among_inconsistent_variants_is_held(spark):
    ask = "If {} has 12 apples and buys 30 kg of pears then how many pieces of fruit does {} carry home today"
    question, torn = ask.format("Tom", "Tom"), [ask.format(*p) for p in (("Ann", "Bob"), ("Eva", "Max"), ("Leo", "Ida"))]
    spread = question.replace("pieces of", "pieces in all of")
    bench = spark.createDataFrame([(1, question)], "item_id long, text string")
    rows = [(1, " So. ".join([question, *torn])), (2, " So. ".join([*torn, question])), (3, " So. ".join(torn)), (4, " So. ".join([torn[0], spread, *torn[1:]])), (None, " So. ".join([question, *torn])), (5, torn[0])]
    got = {r.doc_id for r in decontam.leaks(docs_of(spark, rows, extra=True), bench).collect()}
    assert got == {1, 2, 4, None}
