"""Token counts of whole texts by rank-synchronous array merging."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder, slices
from .common import arrow


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``n_bytes``, ``n_tokens`` and ``over_limit``.

    ``vocabulary`` is the path of a byte-level BPE file on every worker.  One
    pass over the two columns, without a shuffle; a worker holds one slice of a
    batch and a bounded cache.  Null text counts as empty (0 bytes, 0 tokens);
    a null id, ties and repeated rows pass through, one row out for each row
    in; extra columns are not read; an empty table gives none.
    """

    def count(batches):
        e = encoder(vocabulary, ids=False)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [c for a, b in slices(texts) for c in e.batch(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.octet_length(F.coalesce(docs[text_col], F.lit(""))).cast("long").alias("n_bytes"))
    kind = dict(slim.dtypes)["id"]
    out = arrow(slim, count, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
