"""Chunk-at-a-time encoding of a stream of samples (an extension: signals there are finite files)."""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tidegrid.functions.dtypes import sample_type, to_numpy
from tidegrid.operators.codec import CHUNK_SCHEMA, compress_chunk
from tidegrid.plans.config import CodecConfig


def encode_stream(samples: DataFrame, dtype: str, n_channels: int, size: int, config: CodecConfig | None = None, n_samples: int | None = None) -> DataFrame:
    """Chunk rows of a streaming (t, samples) DataFrame, each as soon as its last sample has come.

    State is one unfinished chunk per key, bounded by the chunk size; samples may come in any order within
    a chunk and repeated ones count once. The chunk at the end of a signal is full with what is left of
    ``n_samples``; where that isn't known, an unfilled last chunk stays in the state.
    """
    config, kind = config or CodecConfig(), sample_type(dtype)

    def step(key, frames, state):
        held: dict[int, list] = pickle.loads(state.get[0]) if state.exists else {}
        if held is None:  # the chunk is out already
            return
        for f in frames:
            held.update(zip(f["t"].tolist(), (list(x) for x in f["samples"]), strict=True))
        if len(held) < (size if n_samples is None else min(size, n_samples - key[0] * size)):
            state.update((pickle.dumps(held),))
            return
        state.update((pickle.dumps(None),))
        order = sorted(held)
        rows = to_numpy([held[t] for t in order], kind).reshape(len(order), n_channels)
        payload = compress_chunk(rows, config.do_time_diff, config.do_spatial_diff, config.chunk_order, config.comp_level)
        yield pd.DataFrame({"chunk_idx": np.array([key[0]], "i4"), "t0": [order[0]], "t1": [order[-1] + 1], "byte_length": [len(payload)], "sha1": [hashlib.sha1(payload).hexdigest()], "sha1_raw": [hashlib.sha1(rows.tobytes("C")).hexdigest()], "payload": [payload]})

    own = samples.select(F.floor(F.col("t") / size).cast("int").alias("chunk_idx"), "t", "samples")
    return own.groupBy("chunk_idx").applyInPandasWithState(step, CHUNK_SCHEMA, "held binary", "append", GroupStateTimeout.NoTimeout)
