"""Documents that arrive in chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "doc_id long, html string"


def assemble(chunks: DataFrame) -> DataFrame:
    """Batch: chunks (doc_id, seq, chunk) as whole documents."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "chunk")))
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["chunk"]), "").alias("html"))


def assemble_stream(chunks: DataFrame) -> DataFrame:
    """Stream: chunks (doc_id, seq, chunk, is_last) are held until those up to the last are there, then the document is emitted."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, parts, last = state.get if state.exists else ([], [], -1)
        have = dict(zip(seqs, parts, strict=True))
        for b in batches:
            for seq, chunk, is_last in zip(b["seq"], b["chunk"], b["is_last"], strict=True):
                have[int(seq)] = chunk
                last = int(seq) if is_last else last
        if last >= 0 and len(have) == last + 1:
            state.remove()
            yield pd.DataFrame({"doc_id": [key[0]], "html": ["".join(have[i] for i in range(last + 1))]})
        else:
            state.update((list(have), list(have.values()), last))

    return chunks.groupBy("doc_id").applyInPandasWithState(step, OUT, "seqs array<int>, parts array<string>, last int", "append", GroupStateTimeout.NoTimeout)
