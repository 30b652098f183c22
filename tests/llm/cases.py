"""Small tables with the hard cases: nulls, empty and long texts, ties, repeated rows."""

import pyarrow.parquet as pq

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"
SMALL = "/root/testdata/sf0.001"


def rows(texts):
    """Rows with ids from 0; a null id, a repeated row and null columns come last."""
    out = [(i, t, "en", f"s{i % 4}" if i % 5 else None, len(t or ""), "x") for i, t in enumerate(texts)]
    return out + [out[0], (None, texts[0], None, None, None, None), (None, None, None, None, None, None)]


def frame(spark, texts):
    return spark.createDataFrame(rows(texts), SCHEMA).coalesce(3)


def documents():
    t = pq.read_table(f"{SMALL}/documents.parquet").to_pydict()
    return list(zip(t["doc_id"], t["text"], t["source"], strict=True))
