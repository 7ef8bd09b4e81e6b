"""Problem 7: the token ids of every text by a public byte-level BPE tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstruct.scale import spread

from docstruct.llm.bpe import text_encoder

#: Where the vocabulary file lies by default; every function takes another path.
BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.json"
#: Characters of text a worker encodes at a time (a longer text is encoded alone).
SLICE_CHARS = 4_000_000


def vocabulary(spark: SparkSession, path: str = BYTE_BPE_50K):
    """The vocabulary file as a broadcast variable; its size is fixed by the tokenizer (about 1.6 MB)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts have about SLICE_CHARS characters together."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= SLICE_CHARS:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_texts(df: DataFrame, key: str, text: str, path: str = BYTE_BPE_50K) -> DataFrame:
    """One row per row of ``df``: ``key`` and ``ids``, the ids of ``text`` without special tokens.

    An empty and a null text both give an empty list; a null key stays null;
    repeated rows give repeated rows; the spelling of a special token inside a
    text is ordinary text. Only the two columns are read, nothing is shuffled.
    """
    vocab = vocabulary(df.sparkSession, path)
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(vocab.value)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts):
                ends, ids = encoder.encode(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), lists], names=[key, "ids"])

    return spread(df.select(F.col(key), F.col(text))).mapInArrow(run, schema)


def count_tokens(df: DataFrame, key: str, text: str, path: str = BYTE_BPE_50K) -> DataFrame:
    """One row per row of ``df``: ``key`` and ``n_tokens`` (0 for an empty and a null text)."""
    vocab = vocabulary(df.sparkSession, path)
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(vocab.value)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts):
                ends, _ = encoder.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.array(ends[1:] - ends[:-1])], names=[key, "n_tokens"])

    return spread(df.select(F.col(key), F.col(text))).mapInArrow(run, schema)
