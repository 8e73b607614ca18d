"""Text embeddings: a pluggable encoder, and a built-in hashed one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import IDF, CountVectorizerModel, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import text_blocks
from ..functions.models import EncoderFactory
from ..functions.patterns import WORD
from ..functions.text import parse_vector
from ..sources.scratch import settle

HASH_DIGITS = 2


def embed_with(
    df: DataFrame, encoder: EncoderFactory, text_col: str = "text", out: str = "embeddings"
) -> DataFrame:
    """Adds the encoder's vectors.  The encoder is made once on each worker task.

    Only the text goes to Python; a missing text is encoded as an empty one.  The encoder
    gets about a megabyte of text at a time.
    """

    @F.arrow_udf("array<float>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = encoder()
        for texts in text_blocks(batches):
            yield pa.array([np.asarray(v, np.float32) for v in model(texts)], pa.list_(pa.float32()))

    return df.withColumn(out, encode(F.col(text_col)))


def embed_hashed(
    df: DataFrame, text_col: str = "text", out: str = "embeddings", hash_digits: int = HASH_DIGITS
) -> DataFrame:
    """Adds word counts hashed to 16^digits places, weighted by idf, of unit length.

    Words are placed by the first hex digits of their MD5, so the vocabulary is
    the list of those digits and nothing has to be learnt for it.  All steps run
    in the JVM; only the document frequencies are aggregated over the table.
    """
    places = [f"{i:0{hash_digits}x}" for i in range(16**hash_digits)]
    words = F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit(WORD), F.lit(0))
    hashed = df.withColumn(
        "_places", F.transform(words, lambda w: F.substring(F.md5(w.cast("binary")), 1, hash_digits))
    )
    counter = CountVectorizerModel.from_vocabulary(places, inputCol="_places", outputCol="_tf")
    # Written once: fitting and weighting would each cut and hash all words again.
    counts = settle(counter.transform(hashed).drop("_places"), "word_counts")
    idf = IDF(inputCol="_tf", outputCol="_tfidf").fit(counts)
    unit = Normalizer(inputCol="_tfidf", outputCol="_unit", p=2.0)
    return (
        unit.transform(idf.transform(counts))
        .withColumn(out, vector_to_array("_unit", "float32"))
        .drop("_tf", "_tfidf", "_unit")
    )


def stored_vectors(df: DataFrame, column: str = "embeddings", out: str = "embeddings") -> DataFrame:
    """Vectors that a table has as text such as ``"[0.1, 0.2]"``; rows without one are left out."""
    return df.withColumn(out, parse_vector(F.col(column))).where(F.col(out).isNotNull())
