"""Marks that only the border of two parts makes, and columns that have no order."""

import pytest
from pyspark.sql import functions as F

from tripmill.llm import chat, simhash

PART = f"conv_id long, turn long, role string, parts {chat.PART_TYPE}"


def text(part):
    return ("text", part, None, None)


@pytest.mark.parametrize("mark", chat.CONTROLS)
def test_marks_split_over_parts_stay_text(spark, mark):
    """A turn whose parts join to a control string reads back as that turn, however it is split."""
    splits = [[mark[:k], mark[k:]] for k in range(1, len(mark))] + [list(mark), [mark[:1], None, "", mark[1:]]]
    image = ("image", None, "a.png", 7)
    rows = [(k, 0, "user", [text(p) for p in parts]) for k, parts in enumerate(splits)]
    rows += [(100 + k, 0, "user", [text(parts[0]), image, *[text(p) for p in parts[1:]]]) for k, parts in enumerate(splits)]
    rows = [r for r in rows] + [(r[0], 1, "assistant", r[3]) for r in rows]
    turns = chat.format_turns(spark.createDataFrame(rows, PART), "conv_id", "turn", "role", F.col("parts"))
    read = turns.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), "attachments").collect()
    assert len(read) == 2 * len(splits)
    for row in read:
        parts = splits[row["conv_id"] % 100]
        joined = "".join(p or "" for p in parts)
        assert [t["role"] for t in row["turns"]] == ["user", "assistant"]
        if row["conv_id"] < 100:
            assert [t["text"] for t in row["turns"]] == [joined] * 2 and not row["attachments"]
        else:
            whole = (parts[0] or "") + chat.MEDIA["image"] + "".join(p or "" for p in parts[1:])
            assert [t["text"] for t in row["turns"]] == [whole] * 2 and len(row["attachments"]) == 2


def test_copies_with_columns_that_have_no_order(spark):
    words = "one two three four five six seven eight"
    rows = [(1, words, {"a": 1}), (1, words, {"a": 1}), (1, words, {"a": 2}), (2, words, None), (3, "other words here now", {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, marks map<string,int>")
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    alone = docs.where("doc_id <> 1")
    assert sorted(r["doc_id"] for r in simhash.deduplicate(alone).collect()) == [2, 3]
