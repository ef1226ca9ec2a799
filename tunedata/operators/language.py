"""Language of texts by character trigrams: profiles learned by grouped counts, texts scored by log likelihood.

A text is read as letters of ``ALPHABET``: lower-cased, any other character a blank. A language's profile is
its smoothed log share of each of the ``len(ALPHABET) ** 3`` trigrams, so its size does not grow with the
corpus. Counting and scoring work on whole texts, in numpy over the characters of an Arrow batch at once; the
counts are summed by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunedata.functions.text import md5_bucket

#: Blank first: what every other character counts as.
ALPHABET = " abcdefghijklmnopqrstuvwxyzàáâäåæçèéêëìíîïñòóôöøœùúûüýßąćęłńśźż"
SMOOTHING = 0.5
#: Shares of ten thousand of the rows (by hash of their id) that profiles are not learned from.
HELD_OUT = 2000
#: Characters that are read at once, but for a longer text.
CHUNK_CHARS = 1 << 20


def _letters() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for i, c in enumerate(ALPHABET):
        table[ord(c)] = i
        if len(c.upper()) == 1:
            table[ord(c.upper())] = i
    return table


def _trigrams(texts: list[str | None], letters: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, last row + 1, trigram numbers, offsets)`` of runs of texts; null counts as empty."""
    width, at = len(ALPHABET), 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= CHUNK_CHARS):
            size += len(texts[end] or "")
            end += 1
        part = [t or "" for t in texts[at:end]]
        codes = letters[np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
        lengths = np.array([len(t) for t in part])
        starts = np.cumsum(lengths) - lengths
        grams = np.zeros(len(codes), np.int32)
        if len(codes) > 2:
            grams[:-2] = (codes[:-2] * width + codes[1:-1]) * width + codes[2:]
        keep = np.ones(len(codes), bool)  # a trigram lies in one text
        for back in (1, 2):
            last = starts + lengths - back
            keep[last[lengths >= back]] = False
        sizes = np.maximum(lengths - 2, 0)
        yield at, end, grams[keep], np.concatenate([[0], np.cumsum(sizes)])
        at = end


def profile_counts(df: DataFrame, text: str, lang: str) -> DataFrame:
    """``lang, gram, n`` over all rows with a language; one row per language and trigram that occurs. Each
    task sends its sums, at most one per language and trigram."""
    letters, width = _letters(), len(ALPHABET) ** 3

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for first, end, grams, offsets in _trigrams(batch.column(0).to_pylist(), letters):
                row = np.repeat(langs[first:end], np.diff(offsets))
                for name in set(row):
                    sums[name] = sums.get(name, 0) + np.bincount(grams[row == name], minlength=width)
        for name, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())],
                                             names=["lang", "gram", "n"])

    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    return rows.mapInArrow(count, "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn_profiles(df: DataFrame, text: str, lang: str) -> tuple[list[str], np.ndarray]:
    """Languages in order and their log shares ``[gram, language]``: at most ``len(ALPHABET) ** 3`` numbers per
    language reach the driver."""
    rows = profile_counts(df, text, lang).toPandas()
    langs = sorted(set(rows["lang"]))
    counts = np.zeros((len(ALPHABET) ** 3, len(langs)))
    for k, name in enumerate(langs):
        mine = rows[rows["lang"] == name]
        counts[mine["gram"].to_numpy(), k] = mine["n"].to_numpy()
    return langs, np.log10((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * len(counts)))


def detect(df: DataFrame, keep: list[str], text: str, langs: list[str], profiles: np.ndarray) -> DataFrame:
    """``keep`` and ``detected, margin, n_grams`` per row: the likeliest language (of equal ones the first by
    name), by how many decimal logs per trigram it leads, and the trigrams read. A text of under three characters, or
    without a profile to compare, is not judged (null)."""
    letters = _letters()
    schema = df.select(*keep).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, grams, offsets in _trigrams(batch.column(len(keep)).to_pylist(), letters):
                sizes = np.diff(offsets)
                total = np.zeros((end - first, len(langs)))
                if len(grams) and langs:
                    for k in range(len(langs)):
                        sums = np.concatenate([[0.0], np.cumsum(profiles[grams, k])])
                        total[:, k] = sums[offsets[1:]] - sums[offsets[:-1]]
                judged = (sizes > 0) & bool(langs)
                best = total.argmax(axis=1) if langs else np.zeros(end - first, int)
                lead = np.partition(total, -2, axis=1) if len(langs) > 1 else None
                margin = (lead[:, -1] - lead[:, -2]) / np.maximum(sizes, 1) if lead is not None else np.zeros(end - first)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(first, end - first) for i in range(len(keep))],
                     pa.array([langs[b] if j else None for b, j in zip(best, judged)], pa.string()),
                     pa.array(margin, pa.float64(), mask=~judged), pa.array(sizes, pa.int64())],
                    names=[*keep, "detected", "margin", "n_grams"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(score, f"{out}, detected string, margin double, n_grams bigint")


def detect_languages(df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``id_col, lang, detected, margin, n_grams, held_out`` of every row. Profiles are learned from the rows
    that are not held out; a null id is learned from."""
    out = F.coalesce(md5_bucket(F.col(id_col), "lang") < HELD_OUT, F.lit(False))
    langs, profiles = learn_profiles(df.where(~out), text, lang)
    found = detect(df.select(id_col, F.col(lang).cast("string").alias("lang"), out.alias("held_out"), F.col(text).alias("text")),
                   [id_col, "lang", "held_out"], "text", langs, profiles)
    return found.select(id_col, "lang", "detected", F.round("margin", 6).alias("margin"), "n_grams", "held_out")
