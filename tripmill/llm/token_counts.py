"""Token counts: Arrow functions that return lengths only.

Batches are balanced by bytes, long texts are split at safe boundaries (``pieces``), and the
library sees each distinct piece once a task memory.  No ids leave the worker.

Nulls count as empty texts (0 bytes, 0 tokens); an empty table gives an empty result; a repeated
row gives a repeated result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tripmill.llm.common import bounded_batches, slices, whole_text, worker_memory
from tripmill.llm.pieces import PieceCounter

TOKEN_LIMIT = 512


def library_counts(path: str) -> Callable[[list[str]], Sequence[int]]:
    """Counts of a batch of texts by the library that reads the vocabulary file."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(path)
    vocabulary.no_truncation()
    vocabulary.no_padding()
    return lambda texts: [
        len(e.ids) for e in vocabulary.encode_batch_fast(texts, add_special_tokens=False)
    ]


def count_tokens(
    docs: DataFrame,
    vocabulary_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    limit: int = TOKEN_LIMIT,
) -> DataFrame:
    """Id, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every whole text.

    The pieces are safe for byte-level vocabularies (``.json``).  A ``.model`` vocabulary marks
    the start of each call, so its texts are encoded whole.
    """
    bounded_batches(docs.sparkSession)
    by_piece = vocabulary_path.endswith(".json")

    def counter() -> Callable[[list[str]], Sequence[int]]:
        counts = library_counts(vocabulary_path)
        return PieceCounter(counts) if by_piece else counts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = worker_memory("token_counts:" + vocabulary_path, counter)
        for whole in batches:
            for batch in slices(whole):
                texts = batch.column(1)
                tokens = pa.array(counted(texts.to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pc.binary_length(texts).cast(pa.int64()),
                        tokens,
                        pc.greater(tokens, limit),
                    ],
                    names=[id_column, "n_bytes", "n_tokens", "over_limit"],
                )

    source = docs.select(id_column, whole_text(text_column).alias(text_column))
    schema = T.StructType(
        [
            source.schema[0],
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
        ]
    )
    return source.mapInArrow(count, schema)
