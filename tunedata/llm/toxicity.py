"""Toxicity by compression distance: two zstandard dictionaries, compared window by window."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunedata.llm.common import materialize

#: Labelled documents of each class that the model is fitted on, at most (the first in hash order).
TRAIN_DOCS = 4000
#: Dictionary bytes: ordinary content of both dictionaries, and what only the toxic one holds.
ORDINARY_BYTES, TOXIC_BYTES = 16384, 4096
WINDOW_BYTES = 96
GRAM = 5
#: Grams and segments of toxic text, and ordinary windows, that reach the driver, at most.
MAX_GRAMS, MAX_SEGMENTS, MAX_WINDOWS = 4096, 2000, 16000
#: Savings in bytes at which a window counts for the document.
CUTS = (2, 3, 4, 6)
#: Texts are lower-cased (A-Z), on their bytes.
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_FILL = 1


def held_out(id_col: str, folds: int = 5) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0


def windows(text: str | None, size: int = WINDOW_BYTES) -> list[bytes]:
    """The whole text as windows of at most ``size`` bytes that end at a blank where there is one."""
    data = (text or "").encode().translate(_LOWER).replace(b"\n", b" ")
    out, at, n = [], 0, len(data)
    while at < n:
        end = min(n, at + size)
        if end < n:
            blank = data.rfind(b" ", at + size // 2, end)
            end = blank + 1 if blank > 0 else end
        out.append(data[at:end])
        at = end
    return out


def _grams(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = len(raw) - GRAM + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(GRAM if n > 0 else 0):
        out = (out << np.uint64(8)) | raw[j:n + j]
    return out


def _gram_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        parts = {0: [], 1: []}
        for text, y in zip(batch["text"], batch["y"]):
            parts[int(y)].append(np.unique(_grams((text or "").encode().translate(_LOWER).replace(b"\n", b" "))))
        for y, found in parts.items():
            if found:
                gram, n = np.unique(np.concatenate(found), return_counts=True)
                yield pd.DataFrame({"gram": gram.view(np.int64), "toxic": n * y, "ordinary": n * (1 - y)})


def _segments(grams: np.ndarray, text: str | None) -> Iterator[bytes]:
    """Runs of bytes that three overlapping toxic grams cover, without the blanks and stops around."""
    data = (text or "").encode().translate(_LOWER).replace(b"\n", b" ")
    at = np.flatnonzero(np.isin(_grams(data), grams))
    cover = np.zeros(len(data) + 2, np.int64)
    np.add.at(cover, at + 1, 1)
    np.add.at(cover, at + 1 + GRAM, -1)
    edges = np.flatnonzero(np.diff((np.cumsum(cover) >= 3).astype(np.int8)))
    for a, b in zip(edges[::2], edges[1::2]):
        part = data[a:b].strip(b" .,;:!?#$%&*|\"'()")
        if len(part) >= 4:
            yield part


def _compressor(content: bytes) -> zstd.ZstdCompressor:
    p = zstd.ZstdCompressionParameters(
        window_log=16, hash_log=16, chain_log=16, search_log=7, min_match=4, target_length=32,
        strategy=zstd.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=p)
    return zstd.ZstdCompressor(dict_data=d, compression_params=p)


class Scorer:
    """Window savings of the toxic over the ordinary dictionary, and a document's features of them."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        # The same length, so that offsets into the shared content cost the same in both.
        self.ordinary = _compressor(ordinary + bytes([_FILL]) * len(toxic))
        self.toxic = _compressor(ordinary + toxic)

    @staticmethod
    def _lengths(compressor: zstd.ZstdCompressor, parts: list[bytes]) -> np.ndarray:
        if len(parts) == 1:
            return np.array([len(compressor.compress(parts[0]))])
        done = compressor.multi_compress_to_buffer(parts, threads=0)
        return np.fromiter((len(done[i]) for i in range(len(parts))), np.int64, len(parts))

    def features(self, texts: list[str | None], group: int = 4096) -> np.ndarray:
        out = np.zeros((len(texts), 3 + 2 * len(CUTS)))
        held: list[bytes] = []
        owner: list[int] = []

        def done():
            if held:
                saved = self._lengths(self.ordinary, held) - self._lengths(self.toxic, held)
                who = np.array(owner)
                np.add.at(out[:, 0], who, 1)
                np.maximum.at(out[:, 1], who, np.maximum(saved, 0))
                np.add.at(out[:, 2], who, np.maximum(saved, 0))
                for k, cut in enumerate(CUTS):
                    np.add.at(out[:, 3 + k], who, saved >= cut)
                held.clear()
                owner.clear()

        for i, text in enumerate(texts):
            for w in windows(text):
                held.append(w)
                owner.append(i)
                if len(held) >= group:
                    done()
        done()
        n = np.maximum(out[:, 0], 1)[:, None]
        counts = out[:, 3:3 + len(CUTS)].copy()
        out[:, 3:3 + len(CUTS)] = np.log1p(counts)
        out[:, 3 + len(CUTS):] = np.sqrt(counts / n)
        out[:, 2] = np.log1p(out[:, 2] / n[:, 0])
        out[:, 0] = np.log1p(out[:, 0])
        return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = np.full(len(w), ridge)
        penalty[-1] = 1e-6
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        train_docs: int = TRAIN_DOCS) -> dict | None:
    """Dictionaries and thresholds, from at most ``train_docs`` labelled documents of each class that
    are not held out. One half of them makes the dictionaries, the other calibrates the score.

    * Ordinary dictionary: zstandard's trainer over windows of ordinary documents.
    * Toxic dictionary: the same content, and behind it the segments that the toxic documents repeat
      and the ordinary ones lack (byte grams with a significant excess of document frequency, joined
      to segments, most frequent nearest). Ordinary windows thus compress alike with both.

    Returns None when a class has no labelled document."""
    spark = docs.sparkSession
    known = (labels.filter(F.col(label_col).isNotNull() & ~held_out(id_col))
             .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("y")))
    order = F.xxhash64("_id", F.lit(11))
    chosen = known.filter("y = 1").orderBy(order).limit(train_docs).unionByName(
        known.filter("y = 0").orderBy(order).limit(train_docs))  # bounded, so broadcast below
    sample = materialize(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
                         .join(F.broadcast(chosen), F.col("id") == F.col("_id"))
                         .select("y", "text", (F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(2)) == 0).alias("dictionary"))
                         .repartition(max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))), "toxic-sample")
    sizes = {(r["y"], r["dictionary"]): r["n"] for r in sample.groupBy("y", "dictionary").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic_n, ordinary_n = sizes.get((1, True), 0), sizes.get((0, True), 0)
    if not toxic_n or not ordinary_n:
        return None
    half = sample.filter("dictionary").select("text", "y")
    counts = (half.mapInPandas(_gram_counts, "gram bigint, toxic bigint, ordinary bigint")
              .groupBy("gram").agg(F.sum("toxic").alias("t"), F.sum("ordinary").alias("o")))
    rate = (F.col("o") + 1) / (ordinary_n + 2)
    z = (F.col("t") - rate * toxic_n) / F.sqrt(rate * toxic_n + 1)
    least_z = min(8.0, 0.5 * toxic_n ** 0.5 + 1)  # what a small sample can show
    hot = (counts.filter("t >= 3").withColumn("z", z).filter((F.col("z") >= least_z) & (F.col("t") / toxic_n >= 6 * rate))
           .orderBy(F.desc("z"), "gram").limit(MAX_GRAMS).select("gram").collect())
    grams = np.sort(np.array([r["gram"] for r in hot], np.int64).view(np.uint64))

    def segments(batches):
        for batch in batches:
            found = [s for text in batch["text"] for s in _segments(grams, text)]
            yield pd.DataFrame({"segment": pd.Series(found, dtype=object)})

    parts = (half.filter("y = 1").mapInPandas(segments, "segment binary").groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
             .filter(F.col("n") >= 2).orderBy(F.desc("n"), "segment").limit(MAX_SEGMENTS).collect())
    kept: list[bytes] = []
    for r in parts:
        s = bytes(r["segment"])
        if not any(s in k for k in kept) and sum(map(len, kept)) + len(kept) + len(s) < TOXIC_BYTES:
            kept.append(s)
    toxic = b"".join(s + bytes([_FILL]) for s in reversed(kept)) or bytes([_FILL])

    def cut(batches):
        for batch in batches:
            yield pd.DataFrame({"w": pd.Series([w for text in batch["text"] for w in windows(text, 192)], dtype=object)})

    ordinary_windows = [bytes(r["w"]) for r in half.filter("y = 0").mapInPandas(cut, "w binary")
                        .orderBy(F.xxhash64("w"), "w").limit(MAX_WINDOWS).collect()]
    try:
        ordinary = zstd.train_dictionary(ORDINARY_BYTES, ordinary_windows).as_bytes()
    except zstd.ZstdError:  # too few windows for the trainer: they are the dictionary themselves
        ordinary = b"".join(ordinary_windows)[-ORDINARY_BYTES:]
    model = {"ordinary": ordinary, "toxic": toxic}

    def measure(batches):
        scorer = Scorer(ordinary, toxic)
        for batch in batches:
            x = scorer.features(list(batch["text"]))
            yield pd.DataFrame({"y": batch["y"].to_numpy(), "x": list(x)})

    rows = sample.filter("not dictionary").select("text", "y").mapInPandas(measure, "y int, x array<double>").collect()
    if len({r["y"] for r in rows}) < 2:
        return None
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float)
    share = known.agg(F.avg("y")).first()[0]  # the sample's classes count as they occur among labels
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    mean, spread = x.mean(0), x.std(0) + 1e-9
    model["weights"], model["mean"], model["spread"] = _logistic((x - mean) / spread, y, weight), mean, spread
    return model


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``id, held_out, score, predicted`` for every row, over all windows of its whole text.

    The score is a logistic function of the windows' savings: how large the largest is, how many
    windows save at least each of ``CUTS`` bytes, and the same as shares. Only texts enter it.

    Defined cases: null and empty texts have no windows and get the score of a text without savings;
    null labels are ignored, of several labels of one id the largest counts; repeated rows are scored
    alike; without labels of both classes every score is 0; an empty table gives no rows; other
    columns are ignored. The model (about 25 KB) is broadcast."""
    model = fit(docs, labels, id_col, text_col, label_col, train_docs)
    blob = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = pickle.loads(blob.value)
        scorer = Scorer(m["ordinary"], m["toxic"]) if m else None
        for batch in batches:
            if m:
                x = (scorer.features(list(batch["text"])) - m["mean"]) / m["spread"]
                p = 1 / (1 + np.exp(-np.clip(x @ m["weights"][:-1] + m["weights"][-1], -30, 30)))
            else:
                p = np.zeros(len(batch))
            yield pd.DataFrame({"id": batch["id"], "held_out": batch["held_out"], "score": p})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"),
                       F.col(text_col).alias("text"))
    return (rows.mapInPandas(run, f"id {kind}, held_out boolean, score double")
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
