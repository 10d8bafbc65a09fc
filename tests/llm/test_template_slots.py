"""Values that fall together or deviate once do not hide the rest of an item."""

from tripmill.llm import templates

COINS = "Yesterday the trader put 5 boxes of tea and 7 coins of silver on the old table"
PLAIN = ("the old man went to the market and sold all of his red apples there before he walked "
         "home along the river and sat down under a tall tree to count the money he had made")  # fmt: skip
TWICE = f"he paid 12 coins at the gate and {PLAIN} and then he paid 12 coins at the other gate"


def rows(spark, text, item):
    docs = spark.createDataFrame([(1, f"Some words go first here. {text}. And more follows.")],
                                 "doc_id long, text string")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    return templates.contaminated(docs, bench).collect()


def test_different_values_may_become_equal(spark):
    found = rows(spark, COINS.replace("5", "3").replace("7", "3"), COINS)
    assert [r["kind"] for r in found] == ["reparameterised"]


def test_one_value_may_not_become_two(spark):
    item = COINS.replace("7", "5")
    assert rows(spark, item.replace("5 boxes", "3 boxes").replace("5 coins", "9 coins"), item) == []


def test_a_deviating_repeat_only_costs_its_windows(spark):
    text = TWICE[: TWICE.rindex("12")] + "71" + TWICE[TWICE.rindex("12") + 2 :]
    (found,) = rows(spark, text, TWICE)
    # Of the windows only those with the second 12 are lost, five words before the end.
    assert found["item_windows"] - found["windows"] == 6
    assert found["kind"] == "exact"


def test_most_places_choose_the_value(spark):
    item = f"{TWICE} where he paid 12 coins to the guard of the house"
    text = item.replace("12", "40")
    text = text[: text.rindex("40")] + "71" + text[text.rindex("40") + 2 :]
    (found,) = rows(spark, text, item)
    assert found["kind"] == "reparameterised"
    assert found["item_windows"] - found["windows"] == 8
