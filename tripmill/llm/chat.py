"""Chat formatting of typed content parts, with DataFrame functions only.

A turn is a list of parts: text, image, audio or document.  A visitor per kind turns a part into
characters of the formatted conversation: text is escaped, every other kind becomes a
placeholder in its place, and its reference and expanded token count are recorded in order.

Escaping is reversible: a backslash is doubled, and inside a control string a backslash follows
the first character.  Text parts that follow each other are joined before they are escaped, so no
control string of the template, or of other well-known templates, can come from a text or from
the border of two.

Nulls: a null role or text is empty, a null part is skipped, a null list has no parts.  Turns are
ordered by number, role and text, so repeated numbers have one order; a repeated row is another
turn.  A null conversation id is one conversation.  An empty table gives an empty result.  Other
columns are ignored.  A conversation is one row of the output, so it is one group here too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template's own marks, then control strings of other templates.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
MEDIA = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>", "<|im_start|>", "<|im_end|>")
CONTROLS = (TURN, BODY, END, *MEDIA.values(), *FOREIGN)
# Expanded tokens of a part that does not state its own.
PART_TOKENS = {"image": 576, "audio": 750, "document": 1024}
LOSS_ROLE = "assistant"
PART_TYPE = "array<struct<kind:string,text:string,ref:string,tokens:bigint>>"


def literal(text: str) -> str:
    """The text as a regular expression."""
    return "".join("\\" + c if c in "|[]/<>" else c for c in text)


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    inside = "|".join(f"(?<={literal(c[0])})(?={literal(c[1:])})" for c in CONTROLS)
    return F.regexp_replace(doubled, inside, r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def visit_text(part: Column) -> Column:
    return escape(F.coalesce(part["text"], F.lit("")))


def visit(part: Column) -> Column:
    """The characters of a part; an unknown kind is its escaped text."""
    found = None
    for kind, mark in MEDIA.items():
        test = part["kind"] == kind
        found = F.when(test, mark) if found is None else found.when(test, mark)
    return found.otherwise(visit_text(part))


def is_media(part: Column) -> Column:
    return F.coalesce(part["kind"].isin(*MEDIA), F.lit(False))


def text_runs(parts: Column) -> Column:
    """Text parts (and parts of unknown kinds) that follow each other as one part."""

    def joined(runs: Column, part: Column) -> Column:
        last = F.get(runs, F.size(runs) - 1)
        text = F.concat(F.coalesce(last["text"], F.lit("")), F.coalesce(part["text"], F.lit("")))
        none = F.lit(None)
        whole = F.struct(
            F.lit("text").alias("kind"), text.alias("text"), none.cast("string").alias("ref"), none.cast("bigint").alias("tokens")
        )
        longer = F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(whole))
        alone = F.concat(runs, F.array(part))
        return F.when(F.size(runs) == 0, alone).when(is_media(last) | is_media(part), alone).otherwise(longer)

    runs = F.aggregate(parts, F.array().cast(PART_TYPE), joined)
    return F.when(F.size(parts) < 2, parts).otherwise(runs)


def expanded_tokens(part: Column) -> Column:
    known = F.create_map(*[F.lit(x) for item in PART_TOKENS.items() for x in item])
    return F.coalesce(part["tokens"], known[part["kind"]].cast("bigint"), F.lit(0).cast("bigint"))


def text_parts(text: Column) -> Column:
    return F.array(
        F.struct(
            F.lit("text").alias("kind"),
            text.cast("string").alias("text"),
            F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("bigint").alias("tokens"),
        )
    )


def format_turns(
    messages: DataFrame, conversation: str, turn: str, role: str, parts: Column
) -> DataFrame:
    """One row per conversation: the formatted text, its loss spans and its attachments.

    ``loss`` lists start and length (code points) of every assistant content; ``attachments``
    the ordinal, kind, reference, expanded tokens and position of every placeholder, in order.
    """
    listed = F.filter(F.coalesce(parts, F.array().cast(PART_TYPE)), lambda p: p.isNotNull())
    rows = messages.select(
        F.col(conversation).alias("conversation"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        listed.alias("parts"),
    ).select(
        "conversation",
        "turn",
        "role",
        F.array_join(F.transform(text_runs(F.col("parts")), visit), "").alias("content"),
        F.filter("parts", lambda p: p["kind"].isin(*MEDIA)).alias("media"),
    )
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))
    pieces = rows.withColumns({"head": head, "piece": F.concat(head, "content", F.lit(END))})
    order = Window.partitionBy("conversation").orderBy("turn", "role", "content")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    placed = pieces.withColumns(
        {
            "position": F.row_number().over(order),
            "offset": F.coalesce(F.sum(F.char_length("piece")).over(before), none),
            "earlier": F.coalesce(F.sum(F.size("media")).over(before), none),
        }
    )
    span = F.struct(
        "position",
        (F.col("offset") + F.char_length("head")).alias("start"),
        F.char_length("content").cast("bigint").alias("length"),
    )
    attachments = F.transform(
        "media",
        lambda p, k: F.struct(
            (F.col("earlier") + k).alias("ordinal"),
            F.col("position").alias("position"),
            p["kind"].alias("kind"),
            p["ref"].alias("ref"),
            expanded_tokens(p).alias("tokens"),
        ),
    )
    grouped = placed.groupBy("conversation").agg(
        F.array_sort(F.collect_list(F.struct("position", "piece"))).alias("pieces"),
        F.array_sort(F.collect_list(F.when(F.col("role") == LOSS_ROLE, span))).alias("loss"),
        F.array_sort(F.flatten(F.collect_list(attachments))).alias("attachments"),
    )
    return grouped.select(
        F.col("conversation").alias(conversation),
        F.array_join("pieces.piece", "").alias("formatted"),
        F.transform("loss", lambda s: F.struct(s["start"], s["length"])).alias("loss"),
        "attachments",
        F.aggregate("attachments.tokens", none, lambda a, b: a + b).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """Role and text of every turn, from the formatted text alone."""
    pieces = F.split(formatted, literal(END), -1)
    turns = F.slice(pieces, 1, F.size(pieces) - 1)
    role = lambda t: F.substring_index(t, BODY, 1)
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape(F.replace(role(t), F.lit(TURN), F.lit(""))).alias("role"),
            unescape(F.substring_index(t, BODY, -1)).alias("text"),
        ),
    )


def read_back(conversations: DataFrame, conversation: str) -> DataFrame:
    """What a trainer would see: turns, and the text under the loss mask, with digests."""
    turns = read_turns(F.col("formatted"))
    under = F.array_join(
        F.transform(
            "loss",
            lambda s: unescape(
                F.col("formatted").substr((s["start"] + 1).cast("int"), s["length"].cast("int"))
            ),
        ),
        "",
    )
    read = conversations.select(
        conversation, "formatted", turns.alias("turns"), under.alias("under")
    )
    each = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        conversation,
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(each, ""), 256).alias("turns_sha256"),
        F.char_length("under").cast("bigint").alias("loss_chars"),
        F.sha2("under", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )
