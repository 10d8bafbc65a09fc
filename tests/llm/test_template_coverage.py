"""Items that are dense in slots or capitalised, verbatim and with other values."""

import pytest

from tripmill.llm import templates

PENS = "If Anna buys 12 pens at 3 dollars and Ben buys 7 pens at 4 dollars"
SUM = "What is 12 plus 30 dollars"
TITLE = "the old man went to the market and sold all of his red apples there"
GERMAN = "der alte Mann brachte den Korb mit Obst zum Markt und kaufte dort Brot und Milch"
LIST = "add 3 8 1 9 4 4 7 2 6 5 11 15 20 21 33 14"
# Fewer literals than any template may have.
SCORES = "Anna 12 Ben 7 Carl 9 Dora 4"


def kinds(spark, text, item):
    docs = spark.createDataFrame([(1, f"Some words go first here. {text}. And more follows.")],
                                 "doc_id long, text string")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    return [r["kind"] for r in templates.contaminated(docs, bench).collect()]


@pytest.mark.parametrize("item", [PENS, SUM, TITLE, GERMAN, LIST, SCORES])
@pytest.mark.parametrize("case", [str, str.title, str.lower])
def test_verbatim_items_are_found_in_any_case(spark, item, case):
    assert kinds(spark, case(item), item) == ["exact"]


@pytest.mark.parametrize(
    ("item", "text"),
    [
        (PENS, "If Maria buys 15 pens at 8 dollars and Tom buys 6 pens at 9 dollars"),
        (SUM, "What is 71 plus 9 dollars"),
        (GERMAN, "der alte Hirte brachte den Sack mit Mehl zum Hafen und kaufte dort Salz und Honig"),
    ],
)
def test_slot_dense_items_are_found_with_other_values(spark, item, text):
    assert kinds(spark, text, item) == ["reparameterised"]


def test_slots_alone_match_nothing_else(spark):
    assert kinds(spark, "Maria 1 Tom 2 Paul 3 Lea 5", SCORES) == []
    assert kinds(spark, "1 2 3 5 6 7 8 9 10 12 13 14", LIST) == []
