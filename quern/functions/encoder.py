"""Dense text embeddings by a model that each worker loads once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import prefix

#: A model by the name under which a worker keeps it.
_LOADED: dict[str, Callable[[list[str]], np.ndarray]] = {}


def model_encoder(name: str, load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 256, length: int | None = 200) -> Callable[..., DataFrame]:
    """An embedder ``(df, id_col, text_col) -> id_col, embedding`` for a model that ``load`` returns: texts in, a matrix out.

    The model is loaded on first use, once for each worker process, on whatever device ``load`` picks there. Texts go in by
    ``batch``; of each text the first ``length`` characters count (None: all), null is empty. Vectors are L2-normalised
    float; a zero vector stays zero. ``cached_embeddings`` keeps the results.
    """

    def embed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, batch):
                    part = b.slice(at, batch)
                    if name not in _LOADED:
                        _LOADED[name] = load()
                    v = np.asarray(_LOADED[name](part.column(1).to_pylist()), "float64")
                    length_of = np.sqrt((v * v).sum(1, keepdims=True))
                    v = (v / np.where(length_of == 0, 1.0, length_of)).astype("float32")
                    ends = pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32())
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(v.ravel()))], names=["id", "embedding"])

        text = F.coalesce(F.col(text_col), F.lit("")) if length is None else prefix(F.col(text_col), length)
        kind = dict(df.dtypes)[id_col]
        return df.select(F.col(id_col).alias("id"), text.alias("t")).mapInArrow(run, f"id {kind}, embedding array<float>").withColumnRenamed("id", id_col)

    return embed
