"""Source divergence audit: how far the sources of a language differ in their terms.

Identical texts of a language are collapsed to one with the multiplicity of each source, so a text
is cut into terms once however often it was copied.  Its counts are added with those weights:
occurrences for each source, documents for the language.  Terms of too few documents go.

Every group (language, source) gives each kept term a share p = 1 + floor(SCALE * (count + 1) / (N + V)),
an integer, and the difference of two shares is f(p, q) = floor((p - q)^2 / q).  The sum of f over
all V terms is never written out for a pair of sources.  A term that neither has adds the same to
every pair; one that only one of them has depends on its count alone, so a histogram of counts for
each source serves all its pairs; only terms that both have are evaluated one by one, inside the
task that holds the term.

Nulls in text, language and source count as empty strings.  A language without kept terms has
pairs of value 0 and no terms; a source alone in its language has no pair.  Repeated rows count as
often as they occur; ties of value are ordered by the bytes of the item; an empty table gives an
empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmill.llm.common import bounded_batches, slices, whole_text, written

# Documents that a kept term needs, the scale of shares, ranks of the term part.
LEAST_DOCUMENTS = 3
SCALE = 1_000_000_000
TERM_RANKS = 200
# ASCII letters in lower case and every byte above ASCII belong to terms; the rest separates.
TO_TERMS = bytes(
    k + 32 if 65 <= k <= 90 else k if 97 <= k <= 122 or k > 127 else 32 for k in range(256)
)
# Distinct counts that a task keeps before it hands them on.
HELD_COUNTS = 400_000
# Pairs of (term, source) rows that are evaluated at once, and sums of pairs kept in a task.
PAIRS_AT_ONCE = 1 << 20
HELD_PAIRS = 200_000
# Tables of one row for each group of at most this many rows may be broadcast.
SMALL_ROWS = 50_000


def collapsed(docs: DataFrame, text_column: str, language_column: str, source_column: str) -> DataFrame:
    """``lang``, ``text`` and ``held``, the sources of the text with their multiplicities."""
    rows = docs.select(
        whole_text(language_column).cast("string").alias("lang"),
        whole_text(source_column).cast("string").alias("source"),
        whole_text(text_column).alias("text"),
    )
    # Multiplicities go by digest, so whole texts are shuffled once, a row for each task and text.
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    copies = rows.groupBy("lang", "digest", "source").agg(F.count("*").alias("copies"))
    held = copies.groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "copies")).alias("held"))
    texts = rows.groupBy("lang", "digest").agg(F.first("text").alias("text"))
    return texts.join(held, ["lang", "digest"]).select("lang", "text", "held")


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted counts of a task for each source: occurrences ``n``, and ``documents`` with the term."""
    seen: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, documents) in seen.items():
            terms = pa.array(list(counts), pa.binary()).cast(pa.string())
            sums = [pa.array(list(counts.values()), pa.int64()),
                    pa.array([documents[term] for term in counts], pa.int64())]
            same = [pa.repeat(pa.scalar(x, pa.string()), len(terms)) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays(
                [same[0], terms, same[1], *sums], names=["lang", "term", "source", "n", "documents"]
            )
        seen.clear()

    for whole in batches:
        for batch in slices(whole):
            columns = (batch.column(k).to_pylist() for k in range(3))
            for lang, text, held in zip(*columns):
                words = text.encode().translate(TO_TERMS).split()
                once = Counter(words) if any(part["copies"] > 1 for part in held) else set(words)
                for part in held:
                    counts, documents = seen[lang, part["source"]]
                    if (copies := part["copies"]) == 1:
                        counts.update(words)
                        documents.update(once if isinstance(once, set) else once.keys())
                        continue
                    for word, n in once.items():
                        counts[word] += n * copies
                        documents[word] += copies
            if sum(len(counts) for counts, _ in seen.values()) > HELD_COUNTS:
                yield from flush()
    yield from flush()


def kept_counts(texts: DataFrame, least_documents: int) -> DataFrame:
    """``lang, term, source, n`` of the kept terms, and ``total``, the term's count in its language."""
    bounded_batches(texts.sparkSession)
    counted = texts.mapInArrow(
        count_terms, "lang string, term string, source string, n long, documents long"
    )
    # Tasks have combined their counts; one shuffle by term serves the sums and the windows.
    summed = counted.repartition("term", "lang").groupBy("term", "lang", "source").agg(
        F.sum("n").alias("n"), F.sum("documents").alias("documents")
    )
    term = Window.partitionBy("term", "lang")
    both = summed.withColumns(
        {"documents": F.sum("documents").over(term), "total": F.sum("n").over(term)}
    )
    return both.where(F.col("documents") >= least_documents).select("lang", "term", "source", "n", "total")


def share(count: str, mass: str, terms: str) -> Column:
    """p of a count, exact; null where the language has no terms."""
    above = f"CAST({count} + 1 AS DECIMAL(20, 0)) * CAST({SCALE} AS DECIMAL(10, 0))"
    below = f"CAST(nullif({mass} + {terms}, 0) AS DECIMAL(20, 0))"
    return F.expr(f"IF({terms} > 0, 1 + ({above}) div {below}, NULL)")


def difference(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div ({q})"


def checked(df: DataFrame) -> DataFrame:
    """The table with a broadcast hint where its counted rows are few; else joins may shuffle it."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def divided(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def shared_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What terms held by both sources of a pair add beyond what each of them alone accounts for.

    Rows come sorted by term and language; a term whose rows go on in the next batch waits for it.
    """
    sums: dict[tuple[str, str, str], int] = defaultdict(int)

    def flush() -> Iterator[pa.RecordBatch]:
        keys = list(sums)
        columns = [pa.array([key[k] for key in keys], pa.string()) for k in range(3)]
        columns.append(pa.array([Decimal(sums[key]) for key in keys], pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "item", "value"])
        sums.clear()

    def evaluate(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        code = np.array(
            [groups.setdefault(g, len(groups)) for g in zip(rows["lang"].to_pylist(), rows["source"].to_pylist())]
        )
        names = list(groups)
        p, p0 = rows["p"].to_numpy(), rows["p0"].to_numpy()
        lengths = np.diff(np.append(starts, len(code)))
        first, size = np.repeat(starts, lengths), np.repeat(lengths, lengths)
        ends = np.cumsum(size)
        at = 0
        while at < len(code):
            # A row's pairs are never more than the sources of its language.
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
            own = np.repeat(np.arange(at, upto), size[at:upto])
            begun = np.repeat(np.cumsum(size[at:upto]) - size[at:upto], size[at:upto])
            other = first[own] + np.arange(len(own)) - begun
            own, other = own[own != other], other[own != other]
            value = divided(p[own], p[other]) - divided(p[own], p0[other])
            value += divided(p0[own], p0[other]) - divided(p0[own], p[other])
            pair = code[own] * len(names) + code[other]
            order = np.argsort(pair, kind="stable")
            pair, value = pair[order], value[order]
            heads = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else []
            if len(heads):
                high = np.add.reduceat(value >> 32, heads)
                low = np.add.reduceat(value & 0xFFFFFFFF, heads)
                for k, h, l in zip(pair[heads].tolist(), high.tolist(), low.tolist()):
                    (lang, source), (_, item) = names[k // len(names)], names[k % len(names)]
                    sums[lang, source, item] += (h << 32) + l
            if len(sums) > HELD_PAIRS:
                yield from flush()
            at = upto

    waiting = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([waiting, rows]) if waiting is not None else rows
        if not len(rows):
            continue
        lang, term = rows["lang"].combine_chunks(), rows["term"].combine_chunks()
        new = np.ones(len(rows), bool)
        for column in (lang, term):
            same = pc.equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            new[1:] = ~same if column is lang else new[1:] | ~same
        starts = np.flatnonzero(new)
        done = int(starts[-1])
        waiting = rows.slice(done)
        if done:
            yield from evaluate(rows.slice(0, done), starts[:-1])
    if waiting is not None and len(waiting):
        yield from evaluate(waiting, np.zeros(1, np.int64))
    yield from flush()


def audit(
    docs: DataFrame,
    text_column: str = "text",
    language_column: str = "lang",
    source_column: str = "source",
    least_documents: int = LEAST_DOCUMENTS,
    term_ranks: int = TERM_RANKS,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: pairs of sources, and terms above their language.

    Part ``pair`` has every other source of the language; part ``term`` the terms that a source
    holds with a greater share than its language, up to ``term_ranks``.
    """
    texts = collapsed(docs, text_column, language_column, source_column)
    kept = written(kept_counts(texts, least_documents), "divergence-terms")
    vocabulary = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(
        F.count("*").alias("terms"), F.sum("n").alias("lang_mass")
    )
    masses = kept.groupBy("lang", "source").agg(F.sum("n").alias("mass"))
    every = docs.select(
        whole_text(language_column).cast("string").alias("lang"),
        whole_text(source_column).cast("string").alias("source"),
    ).distinct()
    groups = written(
        every.join(masses, ["lang", "source"], "left")
        .join(vocabulary, "lang", "left")
        .na.fill(0, ["mass", "terms", "lang_mass"])
        .withColumn("p0", share("0", "mass", "terms")),
        "divergence-groups",
    )
    few = checked(groups)
    shares = kept.join(few, ["lang", "source"]).withColumn("p", share("n", "mass", "terms"))

    above = shares.withColumn("q", share("total", "lang_mass", "terms")).where("p > q")
    terms = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                         F.expr(difference("p", "q")).alias("value"))

    group, ranking = ["lang", "source"], [F.desc("value"), F.asc("item")]
    ranked = Window.partitionBy(*group).orderBy(*ranking)
    top = terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= term_ranks)

    others = few.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    exact = "decimal(38,0)"
    # What any term adds that neither source has, for all V terms.
    base = groups.join(others, "lang").where("source <> item").select(
        "lang", "source", "item",
        F.coalesce(F.expr(difference("p0", "q0")).cast(exact) * F.col("terms"), F.lit(0)).cast(exact).alias("value"),
    )
    # How much more a term adds that the first has (alone), and one that the second has.
    counts = shares.groupBy("lang", "source", "n", "p", "p0").agg(F.count("*").alias("times"))
    sided = counts.join(others, "lang").where("source <> item")
    forth = sided.select(
        "lang", "source", "item",
        ((F.expr(difference("p", "q0")) - F.expr(difference("p0", "q0"))).cast(exact) * F.col("times")).cast(exact).alias("value"),
    )
    back = sided.select(
        "lang", F.col("item").alias("source"), F.col("source").alias("item"),
        ((F.expr(difference("q0", "p")) - F.expr(difference("q0", "p0"))).cast(exact) * F.col("times")).cast(exact).alias("value"),
    )
    both = (
        shares.select("lang", "term", "source", "p", "p0")
        .repartition("term", "lang")
        .sortWithinPartitions("term", "lang")
        .mapInArrow(shared_terms, "lang string, source string, item string, value decimal(38,0)")
    )
    pairs = base.unionByName(forth).unionByName(back).unionByName(both).groupBy("lang", "source", "item").agg(
        F.sum("value").cast("bigint").alias("value")
    )
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value",
                         F.row_number().over(ranked).alias("rank"))
    return pairs.unionByName(top)
