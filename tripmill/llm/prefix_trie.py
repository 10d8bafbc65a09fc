"""Prefix trie of conversations, kept as a z-fast trie: compacted nodes in a hash table.

A conversation is a string of turns.  Every prefix has a key, a digest of two running sums of 64-bit
hashes over (place, role, text), so a key of any depth is found by the pair (conversation, depth).
A compacted node stands for the edge of plain prefixes of the depths (p, e]; it is stored under its
*handle*, the key at the two-fattest depth of that range (the one that most powers of two divide).

Equal conversations are collapsed first.  The others come in batches.  A batch finds the exit
node of each of its conversations by fat binary search: a hit at the two-fattest depth of the open
range moves its lower end to the depth of the node found, a miss moves the upper end below the probe,
so the rounds of joins follow the logarithm of the longest conversation.  What lies beyond the exit
is new: edges that are left in their middle are split there, ends and branchings of the new parts
become nodes, and their handles go to the table.  At last edges are expanded to plain prefixes.

Counts of subtrees come from the nodes each conversation passes, combined before they are
shuffled.  A sum over the nodes of a subtree gives each node to the smallest conversation in
it: whatever passes a node brings all it was given, less what the smallest was given above.

Null conversation ids belong to no conversation, so their rows are left out; null roles and texts are
empty.  Turns are ordered by turn (null first), role and text, so equal rows are turns of their own.
An empty table gives an empty result.  Other columns are ignored, whatever their names.  One
conversation, turn or end may hold most rows: places and running sums are made range by range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmill.llm.common import written

# Shares of the conversations that have come by the end of each batch.
BATCHES = (1 / 64, 1 / 8, 1.0)
# Turns whose running sums one window makes; depths that one row expands to; ids joined in one text.
CHUNK = 1024
IDS_AT_ONCE = 1 << 16
ROOT = ""
NODE = "key string, s long, p long, e long, handle string, first string, parent string"


def ordered_turns(
    rows: DataFrame, id_column: str = "conv_id", turn_column: str = "turn",
    role_column: str = "role", text_column: str = "text",
) -> DataFrame:
    """``conv, pos, role, text``; pos from 1.  A global sort numbers the rows, so no key is one task."""
    turns = rows.where(F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("conv"),
        F.col(turn_column).alias("turn"),
        F.coalesce(F.col(role_column), F.lit("")).alias("role"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )
    order = [F.asc("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    at = F.monotonically_increasing_id()
    placed = written(turns.orderBy(*order).withColumn("at", at), "trie-order")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    parts = placed.groupBy("conv", "part").agg(F.min("at").alias("from"), F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return placed.join(parts, ["conv", "part"]).select(
        "conv", (F.col("at") - F.col("from") + F.col("before") + 1).alias("pos"), "role", "text"
    )


def spliced(turns: DataFrame, modulus: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """All conversations, and their turns with the first h replaced by those of conversation c - c % modulus.

    h is the crc32 of the id's decimal digits modulo ``most``.
    """
    turns = written(turns, "trie-turns")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    every = turns.select("conv").distinct()
    heads = turns.where(F.col("pos") < most)
    lengths = heads.groupBy(F.col("conv").alias("base")).agg(F.max("pos").alias("length"))
    base = F.col("conv") - F.col("conv") % modulus
    plans = written(
        every.withColumns({"h": h, "base": base})
        .join(lengths, "base", "left")
        .select("conv", "h", "base", F.least("h", F.coalesce("length", F.lit(0))).alias("taken")),
        "trie-plans",
    )
    given = heads.select(F.col("conv").alias("base"), "pos", "role", "text")
    lent = plans.join(given, "base").where("pos <= h").select("conv", "pos", "role", "text")
    own = turns.join(plans.select("conv", "h", "taken"), "conv").where("pos > h")
    own = own.select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "role", "text")
    return every, lent.unionByName(own)


def prefix_keys(turns: DataFrame) -> DataFrame:
    """``conv, d, key, parent, chars, total`` of every turn; total is the running sum of chars."""
    places = turns.select(
        "conv", F.col("pos").alias("d"), F.expr(f"(pos - 1) div {CHUNK}").alias("chunk"),
        F.char_length("text").cast("long").alias("chars"),
        F.xxhash64(F.lit(1), "pos", "role", "text").cast("decimal(20,0)").alias("x"),
        F.xxhash64(F.lit(2), "text", "pos", "role").cast("decimal(20,0)").alias("y"),
    )
    places = written(places, "trie-places")
    sums = {"x": "sx", "y": "sy", "chars": "total"}
    chunks = places.groupBy("conv", "chunk").agg(*(F.sum(a).alias("all_" + a) for a in sums))
    earlier = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(
        "conv", "chunk", *(F.coalesce(F.sum("all_" + a).over(earlier), F.lit(0)).alias("all_" + a) for a in sums)
    )
    so_far = Window.partitionBy("conv", "chunk").orderBy("d")
    running = places.withColumns({b: F.sum(a).over(so_far) for a, b in sums.items()})
    running = running.join(chunks, ["conv", "chunk"]).withColumns(
        {b: F.col(b) + F.col("all_" + a) for a, b in sums.items()}
    )

    def key(x: Column, y: Column, d: Column) -> Column:
        digits = F.concat_ws(":", *(c.cast("decimal(38,0)").cast("string") for c in (x, y)), d.cast("string"))
        return F.when(d == 0, ROOT).otherwise(F.md5(digits))

    x, y, d = F.col("sx"), F.col("sy"), F.col("d")
    return running.select(
        "conv", "d", key(x, y, d).alias("key"), key(x - F.col("x"), y - F.col("y"), d - 1).alias("parent"),
        "chars", F.col("total").cast("long").alias("total"),
    )


def two_fattest(low: str, high: str) -> str:
    """The number in (low, high] that the greatest power of two divides."""
    zeros = f"(length(bin({low} ^ {high})) - 1)"
    return f"shiftleft(shiftright({high}, {zeros}), {zeros})"


def at_depth(prefixes: DataFrame, depth: str, **names: str) -> DataFrame:
    """Prefix rows with their depth under another name, to be joined on (s, depth)."""
    return prefixes.select("s", F.col("d").alias(depth), *(F.col(a).alias(b) for a, b in names.items()))


def exits(strings: DataFrame, prefixes: DataFrame, inserted: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of each string of a batch, ``depth`` shared with the trie and the edge it leaves in its middle.

    ``edge`` is null for a string that leaves at a node.
    """
    by_handle = nodes.select("handle", F.col("key").alias("node"), F.col("s").alias("r"), F.col("p").alias("np"),
                             F.col("e").alias("ne"))
    none = {"edge": "string", "r": "long", "np": "long", "ne": "long"}
    state = strings.select("s", "length", F.lit(0).cast("long").alias("low"), F.col("length").alias("high"),
                           *(F.lit(None).cast(t).alias(n) for n, t in none.items()))
    found = []
    while True:
        state = written(state, "trie-search")
        found.append(state.where("low >= high OR edge IS NOT NULL"))
        state = state.where("low < high AND edge IS NULL")
        if state.isEmpty():
            break
        probed = (
            state.drop(*none)
            .withColumn("f", F.expr(two_fattest("low", "high")))
            .join(at_depth(prefixes, "f", key="handle"), ["s", "f"])
            .join(by_handle, "handle", "left")
        )
        whole = at_depth(prefixes, "ne", key="reached")
        probed = probed.join(whole, ["s", "ne"], "left").withColumn("within", F.expr("reached <=> node"))
        state = probed.select(
            "s", "length",
            F.expr("CASE WHEN node IS NULL THEN low WHEN within THEN ne ELSE f END").alias("low"),
            F.expr("IF(node IS NULL, f - 1, high)").alias("high"),
            F.expr("IF(node IS NOT NULL AND NOT within, node, NULL)").alias("edge"), "r", "np", "ne",
        )
    done = found[0]
    for more in found[1:]:
        done = done.unionByName(more)
    # No probe hit the edge that is left above its handle: it begins with the next turn.
    open_ = done.where("edge IS NULL AND low < length").drop(*none).withColumn("next", F.col("low") + 1)
    by_first = nodes.select("first", F.col("key").alias("edge"), F.col("s").alias("r"), F.col("p").alias("np"),
                            F.col("e").alias("ne"))
    begun = open_.join(at_depth(prefixes, "next", key="first"), ["s", "next"]).join(by_first, "first", "left")
    columns = ["s", "length", "low", *none]
    known = written(
        done.where("edge IS NOT NULL OR low >= length").select(*columns).unionByName(begun.select(*columns)),
        "trie-exits",
    )
    # How far the edge's own turns agree.
    there = at_depth(inserted.withColumnRenamed("s", "r").withColumn("s", F.col("r")), "d", r="r", key="its").drop("s")
    along = (
        known.where("edge IS NOT NULL").select("s", "r", "low", "ne")
        .join(prefixes.select("s", "d", "key"), "s").where("d > low AND d <= ne")
        .join(there, ["r", "d"]).where("key = its").groupBy("s").agg(F.max("d").alias("agreed"))
    )
    return written(
        known.join(along, "s", "left").select(
            "s", "length", F.coalesce("agreed", "low").alias("depth"), "edge", "r", "np", "ne"
        ),
        "trie-exits",
    )


def with_handles(nodes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Nodes (key, s, p, e) with the keys of their handle, their first turn and their parent."""
    deep = nodes.withColumns({"f": F.expr(two_fattest("p", "e")), "next": F.col("p") + 1})
    firsts = at_depth(prefixes, "next", key="first", parent="parent")
    found = deep.join(at_depth(prefixes, "f", key="handle"), ["s", "f"]).join(firsts, ["s", "next"])
    return found.select("key", "s", "p", "e", "handle", "first", "parent")


def inserted_batch(
    strings: DataFrame, prefixes: DataFrame, inserted: DataFrame, nodes: DataFrame
) -> DataFrame:
    """The nodes after a batch of strings; ``inserted`` holds the prefixes of this and earlier batches."""
    left = exits(strings, prefixes, inserted, nodes)
    beyond = prefixes.join(left.select("s", "length", "depth"), "s").where("d >= depth")
    new = beyond.where("d > depth")
    branching = new.where("d - 1 > depth").groupBy(F.col("parent").alias("key")).agg(
        F.min("key").alias("least"), F.max("key").alias("most")
    )
    marks = (
        branching.where("least <> most").select("key")
        .unionByName(new.where("d = length").select("key")).distinct().withColumn("marked", F.lit(True))
    )
    # Rows where a string meets the trie stand for the parents of its topmost new nodes.
    passed = beyond.join(marks, "key", "left").where("marked OR d = depth").select("s", "d", "key", "depth")
    above = F.lag("d", 1, 0).over(Window.partitionBy("s").orderBy("d"))
    fresh = passed.withColumn("p", above).where("d > depth").groupBy("key").agg(
        F.min("s").alias("s"), F.min("p").alias("p"), F.min("d").alias("e")
    )
    # Edges that were left in their middle: a piece down to each place, and the rest.
    broken = left.where("edge IS NOT NULL")
    middles = broken.join(at_depth(prefixes, "depth", key="key"), ["s", "depth"]).select(
        "edge", "r", "np", F.col("depth").alias("e"), "key"
    )
    ends = broken.select("edge", "r", "np", F.col("ne").alias("e"), F.col("edge").alias("key"))
    cuts = middles.unionByName(ends).distinct()
    upper = F.lag("e").over(Window.partitionBy("edge").orderBy("e"))
    pieces = cuts.select("key", F.col("r").alias("s"), F.coalesce(upper, "np").alias("p"), "e")
    untouched = nodes.join(broken.select(F.col("edge").alias("key")).distinct(), "key", "left_anti")
    changed = written(fresh.unionByName(pieces), "trie-changed")
    return written(untouched.unionByName(with_handles(changed, inserted)), "trie-nodes")


def joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, conv): the decimal ids of a key in texts of many."""
    key, ids = None, []

    def flush() -> Iterator[pa.RecordBatch]:
        if ids:
            row = [[key], [ids[0]], [",".join(map(str, ids))]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(row, (pa.string(), pa.int64(), pa.string()))],
                names=["key", "least", "ids"],
            )
            ids.clear()

    for batch in batches:
        for k, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key or len(ids) >= IDS_AT_ONCE:
                yield from flush()
                key = k
            ids.append(conv)
    yield from flush()


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, least): the digest of all texts of a key, joined by commas, read as a stream."""
    key, state = None, None

    def flush() -> Iterator[pa.RecordBatch]:
        if state is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([key], pa.string()), pa.array([state.hexdigest()], pa.string())], names=["key", "ends_sha256"]
            )

    for batch in batches:
        for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if state is not None and k == key:
                state.update(b",")
            else:
                yield from flush()
                key, state = k, hashlib.sha256()
            state.update(text.encode())
    yield from flush()


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each key (key, conv), ascending and joined by commas.

    A digest is read in order by nature; the ids of a hot end are joined by many tasks before.
    """
    texts = ends.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(
        joined_ids, "key string, least long, ids string"
    )
    return texts.repartition("key").sortWithinPartitions("key", "least").mapInArrow(
        digests, "key string, ends_sha256 string"
    )


def built(strings: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The compacted nodes of all strings, inserted batch by batch."""
    place = F.shiftrightunsigned(F.xxhash64("s"), 11) / F.lit(float(1 << 53))
    nodes = strings.sparkSession.createDataFrame([], NODE)
    before = 0.0
    for upto in BATCHES:
        now = (place >= before) & (place < upto)
        nodes = inserted_batch(strings.where(now), prefixes.where(now), prefixes.where(place < upto), nodes)
        before = upto
    return nodes


def prefix_trie(every: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for each distinct prefix of the conversations ``every`` (conv) with ``turns`` (conv, pos, role, text)."""
    everything = written(prefix_keys(turns), "trie-prefixes")
    last = everything.groupBy("conv").agg(F.max(F.struct("d", "key")).alias("last"))
    ends = written(
        every.join(last, "conv", "left").select(
            "conv", F.coalesce("last.d", F.lit(0)).alias("length"), F.coalesce("last.key", F.lit(ROOT)).alias("key")
        ),
        "trie-ends",
    )
    strings = written(
        ends.where("length > 0").groupBy("key", "length").agg(F.min("conv").alias("s"), F.count("*").alias("members")),
        "trie-strings",
    )
    prefixes = written(
        everything.join(strings.select(F.col("s").alias("conv")), "conv").withColumnRenamed("conv", "s"),
        "trie-prefixes",
    )
    nodes = built(strings.select("s", "length"), prefixes)

    children = nodes.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    # Strings with what they bring to every node they pass.
    carried = strings.join(children, "key", "left").select(
        "s", "members", F.expr("IF(n_children IS NULL, 1L, 0L)").alias("leaf")
    )
    path = written(
        prefixes.join(nodes.select("key"), "key").select("key", "s", "d").join(carried, "s"), "trie-paths"
    )
    totals = path.groupBy("key").agg(
        F.sum("members").alias("n_convs"), F.min("s").alias("conv_id"), F.sum("leaf").alias("n_leaves")
    )
    last_of = at_depth(prefixes, "e", total="total")
    first_of = at_depth(prefixes, "next", total="first_total", chars="first_chars")
    counted = (
        nodes.join(totals, "key").withColumn("next", F.col("p") + 1)
        .join(last_of, ["s", "e"]).join(first_of, ["s", "next"])
        .withColumn("weight", F.expr("(n_convs - 1) * (total - first_total + first_chars)"))
        .select("key", "parent", "p", "e", "n_convs", "conv_id", "n_leaves", "total", "weight")
    )
    counted = written(counted, "trie-counted")
    given = counted.groupBy(F.col("conv_id").alias("s")).agg(F.sum("weight").alias("given"))
    brought = path.join(given, "s").groupBy("key").agg(F.sum("given").alias("brought"))
    above = Window.partitionBy("conv_id").orderBy("e").rowsBetween(Window.unboundedPreceding, 0)
    below = F.col("brought") - F.sum("weight").over(above)
    summed = counted.join(brought, "key").withColumn("below", below).join(children, "key", "left")

    # The root has no turns; its row is made of sums over the tables.
    whole = ends.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).first()
    leaves = strings.join(children, "key", "left_anti").count()
    saved = counted.agg(F.sum("weight")).first()[0] or 0
    tops = nodes.where(F.col("parent") == ROOT).count()
    values = [(whole["conv_id"], whole["n_convs"], max(1, leaves), saved, tops)] if whole["n_convs"] else []
    root = every.sparkSession.createDataFrame(
        values, "conv_id long, n_convs long, n_leaves long, saved_tokens long, n_children long"
    )
    parents = counted.select(F.col("key").alias("parent"), F.col("conv_id").alias("above_id")).unionByName(
        root.select(F.lit(ROOT).alias("parent"), F.col("conv_id").alias("above_id"))
    )
    # Edges to plain prefixes, by ranges of depths.
    ranges = summed.join(parents, "parent").withColumn(
        "range", F.explode(F.expr(f"sequence((p + 1) div {CHUNK}, e div {CHUNK})"))
    )
    depths = F.expr(f"sequence(greatest(p + 1, range * {CHUNK}), least(e, range * {CHUNK} + {CHUNK - 1}))")
    plain = (
        ranges.withColumn("depth", F.explode(depths)).withColumnRenamed("total", "end_total")
        .withColumn("s", F.col("conv_id"))
        .join(at_depth(prefixes, "depth", total="total", chars="chars"), ["s", "depth"])
    )
    digest = end_digests(ends.select("key", "conv"))
    rows = plain.select(
        F.expr("IF(depth = e, key, NULL)").alias("key"), "conv_id", "depth",
        F.expr("IF(depth = p + 1, above_id, conv_id)").alias("parent_conv_id"), "n_convs",
        F.expr("IF(depth = e, coalesce(n_children, 0), 1)").cast("long").alias("n_children"), "n_leaves",
        F.expr("below + (n_convs - 1) * (end_total - total + chars)").alias("saved_tokens"),
    ).unionByName(
        root.select(F.lit(ROOT).alias("key"), "conv_id", F.lit(0).cast("long").alias("depth"),
                    F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
                    "n_leaves", "saved_tokens")
    )
    nothing = hashlib.sha256().hexdigest()
    return rows.join(digest, "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )
