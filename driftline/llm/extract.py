"""The main text of web pages: leaf blocks, labelled by a conditional random field."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm import crf, labelled
from driftline.llm.blocks import leaf_blocks
from driftline.llm.common import in_tasks, slices


@lru_cache(maxsize=1)
def fitted() -> crf.Crf:
    """The model of the labelled pages that come with the package; it takes a few seconds, on the driver."""
    return crf.train(labelled.marked(labelled.pages()))


def extract(html: str, model: crf.Crf) -> str:
    blocks = leaf_blocks(html)
    return " ".join([b.text for b, main in zip(blocks, model.decode(blocks), strict=True) if main])


def main_text(pages: DataFrame, model: crf.Crf, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) per row: the blocks that are main, in order, joined by a space; ``n_chars`` counts
    code points. A null or empty page, and one without a main block, has an empty text. Other columns are not
    looked at."""
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            texts = [extract(html, sent.value) if html else "" for html in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return in_tasks(rows, run, "id long, url string, text string, n_chars long")
