"""Extension hooks (K family): user-supplied token counters, scorers and aggregators.

The default path stays in JVM expressions; these hooks are the Arrow-batched escape hatches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunedata.functions.text import whitespace_token_count


#: Bytes of text that a user's counter sees at once.
SLICE_BYTES = 1 << 20


def token_counter(counter: Callable[[pd.Series], pd.Series] | None = None) -> Callable[[Column], Column]:
    """Column -> token count. Default: whitespace split as a built-in expression; otherwise the
    user's vectorised function (e.g. a tokenizer's batch encode) over slices of an Arrow batch of about
    ``SLICE_BYTES`` of text, one longer text by itself, so that a task's memory does not grow with batch and texts."""
    if counter is None:
        return whitespace_token_count

    @F.arrow_udf(T.LongType())
    def _count(a: pa.Array) -> pa.Array:
        counts = [pa.array(counter(part.to_pandas().fillna("")).astype("int64"), pa.int64()) for part in text_slices(a)]
        return pa.concat_arrays(counts) if counts else pa.array([], pa.int64())

    return _count


def text_slices(a: pa.Array, size: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive parts of an array of texts, of at most ``size`` bytes or one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(a), 0).to_numpy(zero_copy_only=False))
    at = done = 0
    while at < len(a):
        end = max(at + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield a.slice(at, end - at)
        at, done = end, int(ends[end - 1])


def whitespace_counter(s: pd.Series) -> pd.Series:
    """A pandas counterpart of ``str.split()`` length (used to check the UDF path)."""
    return s.map(lambda t: len(t.split()) if isinstance(t, str) else 0)  # the words of one text at a time


def score_with(df: DataFrame, make_scorer: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
               schema: str) -> DataFrame:
    """Batch scoring with ``mapInPandas``: the scorer is built once per task (model load) and
    applied to Arrow batches; the output feeds the F-family aggregates."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for b in batches:
            yield scorer(b)

    return df.mapInPandas(run, schema)


def longest_choice_scorer() -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The baseline that a model has to beat: a choice scores by its length. A model's scorer has the
    same shape: built once per task, it turns a batch of items into one logit per choice."""
    def score(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"item_id": b["item_id"], "answer": b["answer"],
                             "choice_logits": [[float(len(c)) for c in choices] for choices in b["choices"]]})

    return score


#: Partials that a task holds before it combines them.
HELD = 32
#: Groups that the partials of one key are dealt over before the last merge.
SALTS = 64


def two_phase_aggregate(df: DataFrame, key: str, partial: Callable[[pd.DataFrame], pd.DataFrame],
                        merge: Callable[[pd.DataFrame], pd.DataFrame], partial_schema: str,
                        out_schema: str, combine: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """Pluggable aggregator without holding a group in one task: ``partial`` summarises each
    Arrow batch per key on the map side, ``merge`` turns the partial rows of one key into its result.

    ``combine`` makes one partial row per key out of several. With it a task sends one row per key, however many
    batches it reads, and the rows of a hot key are first combined in ``SALTS`` groups: the last merge of a key sees at
    most so many. Without it a key has one row per batch."""
    def map_side(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            if len(b):
                held.append(partial(b))
            if combine is None:
                yield from held
                held = []
            elif len(held) >= HELD:
                held = [combine(pd.concat(held, ignore_index=True))]
        if held:
            yield combine(pd.concat(held, ignore_index=True))

    partials = df.mapInPandas(map_side, partial_schema)
    if combine is not None:
        salted = partials.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
        partials = salted.groupBy(key, "_salt").applyInPandas(lambda p: combine(p.drop(columns="_salt")), partial_schema)
    return partials.groupBy(key).applyInPandas(merge, out_schema)
