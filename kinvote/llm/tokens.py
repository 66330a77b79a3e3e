"""Token counts of texts under a public byte-level tokenizer."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rank file of the tokenizer: a path, or a name among the installed public ones.
VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary_path(vocabulary: str) -> str:
    """A path as it is; a bare file name is looked up among the installed public tokenizers."""
    if os.path.sep in vocabulary:
        return vocabulary
    import public_tokenizers

    return str(public_tokenizers.path(vocabulary))


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """The tokenizer of a rank file, once per worker process."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(column: pa.Array, size: int = 128) -> Iterator[str | None]:
    """The values of a text column, of which only a few are Python objects at a time."""
    for lo in range(0, len(column), size):
        yield from column.slice(lo, size).to_pylist()


def spread(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``documents`` in at least as many partitions as there are task slots.

    A table of few files (or row groups) is read by few tasks, however many
    slots there are; its rows are then spread by a hash of ``key`` and text. Tables
    with rows in enough partitions stay as they are, so a large corpus is never shuffled.
    """
    slots = documents.sparkSession.sparkContext.defaultParallelism
    filled = documents.select(F.spark_partition_id().alias("p")).distinct().count()
    return documents if filled >= slots else documents.repartition(slots, F.xxhash64(key, text))


def measured(documents: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``documents`` without ``text`` but with ``n_tokens`` and ``content``.

    ``n_tokens`` counts the tokens of the whole text (null and empty: 0).
    ``content`` is a hash of the text ignoring case and white space, equal for
    exact copies; null for texts without a visible character. Other columns
    are kept; those named like an added one are replaced. Each text
    is encoded once; texts cross to Python in Arrow batches and stay there.
    """
    path = vocabulary_path(vocabulary)
    rest = [f for f in documents.schema.fields if f.name != text and f.name.lower() not in ("n_tokens", "content")]
    schema = T.StructType([*rest, T.StructField("n_tokens", T.LongType()), T.StructField("content", T.LongType())])
    arrow = to_arrow_schema(schema)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        encode = encoder(path).encode_ordinary
        for batch in batches:
            sizes, hashes = [], []
            for value in pieces(batch.column(text)):
                words = value.lower().split() if value else ()
                sizes.append(len(encode(value)) if value else 0)
                hashes.append(xxhash.xxh3_64_intdigest(" ".join(words)) - (1 << 63) if words else None)
            columns = [batch.column(f.name).cast(arrow.field(f.name).type) for f in rest]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, "i8"), pa.array(hashes, "i8")], schema=arrow)

    return documents.mapInArrow(measure, schema)
