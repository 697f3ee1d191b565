from factgrid.llm import decontam


def test_items_of_few_words_are_found_whole(spark):
    items = [(1, "Heliotrope quince"), (2, "Who sang? Nobody."), (3, "zymurgy"), (4, "..."), (5, "one two three four five six seven")]
    docs = [(1, "we saw HELIOTROPE, quince and more"), (2, "quince before heliotrope"), (3, "who sang nobody knows"), (4, "nobody knows who sang"), (5, "zymurgy"), (6, "a b c"), (7, "..."), (8, "one two three four five six seven")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.matches(d, b).collect()} == {(1, 1), (3, 2), (5, 3), (8, 5)}
    assert {r["doc_id"] for r in decontam.filtered(d, b).collect()} == {2, 4, 6, 7}
