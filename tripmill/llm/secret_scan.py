"""Secret scan with corpus-wide ownership: who else has the same credential?

Base patterns give spans.  Every candidate value is hashed, and its hash is counted over the
distinct repositories and owners of the whole corpus.  A value that several owners hold is a
copied example; one that a single owner holds in a few repositories looks live.  Long mixed
tokens that no base pattern covers become spans of kind ``owned`` when they look live.

Only DataFrame functions run.  Positions are counted in code points: a text is split by the
pattern, and running sums over its pieces and matches give the starts, row by row, so a text
with very many matches is never one array that is rebuilt for each of them.

Nulls: a null text has no spans; a null owner is one owner; a null repository is one repository
of its owner; a null id is a value like any other.  Rows with the same id and text give the same
result; a value repeated inside one text counts its repository once.  An empty table gives an
empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmill.llm.common import whole_text, written

# Kinds in the order of the output, with the pattern, the group of the value, and its least length.
BASE_KINDS = (
    (
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
# Runs of the same letters that are too short fail as a whole, so these find the same spans.
QUICK = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
OWNED = "owned"
OWNED_PATTERN = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}"
# A live-looking value has at most so many owners and repositories, and so many different letters.
LIVE_OWNERS = 1
LIVE_REPOSITORIES = 3
DIFFERENT_LETTERS = 10
# What a row is known by: rows of one id with another text are other rows.
KEY = ("key_id", "key_text")


def candidate_rows(docs: DataFrame) -> DataFrame:
    """A row for each match of any kind: key, owner, repository, kind, rank, at, gap, match."""
    kinds = [(name, QUICK.get(name, pattern)) for name, pattern, _, _ in BASE_KINDS]
    kinds.append((OWNED, OWNED_PATTERN))
    found = docs.select(
        *KEY,
        "owner",
        "repository",
        "text",
        *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(name) for name, p in kinds],
    ).where(reduce(lambda a, b: a | b, [F.size(name) > 0 for name, _ in kinds]))
    scans = F.array(
        *[
            F.struct(
                F.lit(rank).alias("rank"),
                F.when(
                    F.size(name) > 0,
                    F.arrays_zip(
                        F.transform(F.slice(F.split("text", p, -1), 1, F.size(name)), F.char_length)
                        .alias("gap"),
                        F.col(name).alias("match"),
                    ),
                ).alias("hits"),
            )
            for rank, (name, p) in enumerate(kinds)
        ]
    )
    one = found.select(*KEY, "owner", "repository", F.explode(scans).alias("scan"))
    return one.select(
        *KEY, "owner", "repository", "scan.rank", F.posexplode("scan.hits").alias("at", "hit")
    ).select(*KEY, "owner", "repository", "rank", "at",
             "hit.gap", "hit.match")


def value_of(rank: Column, match: Column) -> Column:
    pattern = BASE_KINDS[0][1]
    return F.when(rank == 0, F.regexp_extract(match, pattern, BASE_KINDS[0][2])).otherwise(match)


def different_letters(value: Column) -> Column:
    return F.size(F.array_distinct(F.split(value, "")))


def spans_of(rows: DataFrame) -> DataFrame:
    """Starts and ends, then the matches that pass; the value only leaves as a hash."""
    running = Window.partitionBy(*KEY, "owner", "repository", "rank").orderBy("at").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    length = F.char_length("match")
    end = F.sum(F.col("gap") + length).over(running)
    value = value_of(F.col("rank"), F.col("match"))
    least = reduce(
        lambda rest, k: F.when(F.col("rank") == k, BASE_KINDS[k][3]).otherwise(rest),
        range(len(BASE_KINDS)),
        F.lit(0),
    )
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (
        different_letters(value) >= DIFFERENT_LETTERS
    )
    return (
        rows.withColumns({"end": end, "start": end - length, "value": value})
        .where(F.char_length("value") >= least)
        .where((F.col("rank") < len(BASE_KINDS)) | mixed)
        .select(*KEY, "owner", "repository", "rank", "start", "end",
                F.sha2("value", 256).alias("hash"))
    )


def has_rank(rank: int) -> Callable[[Column], Column]:
    return lambda span: span["rank"] == rank


def ownership(spans: DataFrame) -> DataFrame:
    """Distinct owners and repositories of every hash; hot hashes are reduced before each shuffle."""
    holders = spans.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    owners = holders.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    return owners.groupBy("hash").agg(
        F.count("*").alias("owners"), F.sum("repositories").alias("repositories")
    )


def scan(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    owner: Column | None = None,
    repository: Column | None = None,
) -> DataFrame:
    """One row per document: counts, spans, and how many values look live or copied."""
    owner = F.col("source") if owner is None else owner
    repository = F.col(id_column) if repository is None else repository
    base = docs.select(
        F.col(id_column).alias("key_id"),
        F.xxhash64(whole_text(text_column)).alias("key_text"),
        owner.cast("string").alias("owner"),
        repository.cast("string").alias("repository"),
        whole_text(text_column).alias("text"),
    )
    # A repeated row has the same matches: the first of each place is enough.
    matches = candidate_rows(base).dropDuplicates([*KEY, "owner", "repository", "rank", "at"])
    held = written(spans_of(matches), "secret-spans")
    # One id and text may have several owners; its places count once.
    spans = held.dropDuplicates([*KEY, "rank", "start"])
    judged = spans.join(ownership(held), "hash")
    live = (F.col("owners") <= LIVE_OWNERS) & (F.col("repositories") <= LIVE_REPOSITORIES)
    names = F.array(*[F.lit(k[0]) for k in BASE_KINDS], F.lit(OWNED))
    is_base = F.col("rank") < len(BASE_KINDS)
    place = F.struct("start", "rank", "end", live.alias("live"))
    grouped = judged.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.when(is_base, place))).alias("base"),
        F.array_sort(F.collect_list(F.when(~is_base & live, place))).alias("added"),
    )
    free = F.filter(
        "added",
        lambda a: ~F.exists("base", lambda b: (b["start"] < a["end"]) & (a["start"] < b["end"])),
    )
    text = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", names[s["rank"]], s["start"], s["end"])), ","
    )
    count = lambda spans, test: F.size(F.filter(spans, test)).cast("bigint")
    per_key = grouped.withColumn("added", free).select(
        *KEY,
        *[count("base", has_rank(k)).alias("n_" + kind[0]) for k, kind in enumerate(BASE_KINDS)],
        text(F.col("base")).alias("base_text"),
        text(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("bigint").alias("n_owned"),
        count("base", lambda s: s["live"]).alias("n_live"),
        count("base", lambda s: ~s["live"]).alias("n_copied"),
    )
    keys = base.select(*KEY)
    same = keys["key_id"].eqNullSafe(per_key["key_id"]) & (keys["key_text"] == per_key["key_text"])
    numbers = ["n_assign", "n_access", "n_hex", "n_owned", "n_live", "n_copied"]
    none = F.lit("")
    return keys.join(per_key, same, "left").select(
        keys["key_id"].alias(id_column),
        *[F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in numbers[:3]],
        F.sha2(F.coalesce("base_text", none), 256).alias("base_sha256"),
        F.coalesce("spans", none).alias("spans"),
        *[F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in numbers[3:]],
    )

