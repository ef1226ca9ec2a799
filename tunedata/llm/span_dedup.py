"""Removal of long passages that an earlier document has: run-length BWT indexes over the windows'
shared neighbourhoods, dealt by content."""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunedata.llm.common import materialize
from tunedata.llm.rindex import RunIndex
from tunedata.llm.tokens import chunks, mix64, powers

WINDOW = 50
#: A window is dealt by the smallest hash of its strings of ANCHOR bytes.
ANCHOR = 24
#: Windows of one segment at most: its WINDOW + 26 bytes stay below the depth of the index.
SEGMENT_WINDOWS = 27
#: Bytes of text of one flush of a map task, of text per shard, and of one index.
FLUSH_BYTES, SHARD_BYTES, INDEX_BYTES = 6 << 20, 6 << 20, 1 << 20
KEY_BITS = 40
TEXT, KEYS, SHARED, SEGMENTS, VERDICTS, WHOLE, COPIES = range(7)
_ALL = np.uint32(0xFFFFFFFF)
_ROW = "shard int, kind int, flush bigint, blob binary"
_SCHEMA = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("flush", pa.int64()), ("blob", pa.binary())])


def _pack(*arrays) -> bytes:
    return zstd.compress(pickle.dumps(arrays, protocol=5), 3)


def _unpack(blob: bytes) -> tuple:
    return pickle.loads(zstd.decompress(blob))


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SCHEMA)], schema=_SCHEMA)


def _packed_keys(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as differences, in as few bytes as they need."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    return gaps.astype(np.uint32) if not len(gaps) or gaps.max() < 1 << 32 else gaps


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def _order(ids: pa.Array) -> np.ndarray:
    """Ids as numbers to compare, null before all others."""
    return np.array([-(1 << 63) if i is None else i for i in ids.to_pylist()], np.int64)


class Runs:
    """Runs of neighbouring windows with one key, in the texts of one chunk."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        n = len(raw)
        self.raw, none = raw, np.zeros(0, np.int64)
        self.start = self.count = self.text = none
        self.key = np.zeros(0, np.uint64)
        if n < WINDOW:
            return
        p, self.inverse = powers(n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p[:n], out=self.total[1:])
        low = mix64((self.total[ANCHOR:] - self.total[:-ANCHOR]) * self.inverse[:n - ANCHOR + 1])
        width, want = 1, WINDOW - ANCHOR + 1
        while width < want:  # sliding minimum, the last two halves overlapping
            step = min(width, want - width)
            low = np.minimum(low[:-step], low[step:])
            width += step
        # Windows that leave their text are none.
        sizes = np.diff(offsets)
        windows = np.maximum(sizes - WINDOW + 1, 0)
        texts = np.flatnonzero(windows)
        if not len(texts):
            return
        valid = np.zeros(n + 1, np.int8)
        valid[offsets[texts]] = 1
        valid[offsets[texts] + windows[texts]] -= 1
        valid = np.cumsum(valid[:len(low)], dtype=np.int8).astype(bool)
        first = valid.copy()
        first[1:] &= (low[1:] != low[:-1]) | ~valid[:-1]
        first[offsets[texts]] = True
        start = np.flatnonzero(first)
        stop = np.flatnonzero(valid & ~np.concatenate([valid[1:] & ~first[1:], [False]])) + 1
        self.start, self.count = start, stop - start
        self.text = np.searchsorted(offsets, start, side="right") - 1
        # texts of no bytes share an offset with the next one: the last of them is the owner
        self.key = mix64(low[start] + np.uint64(1)) >> np.uint64(64 - KEY_BITS)

    def segments(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(start, windows, text, key, hash)`` of the chosen runs, in pieces of SEGMENT_WINDOWS."""
        start, count = self.start[chosen], self.count[chosen]
        pieces = -(-count // SEGMENT_WINDOWS)
        which = np.repeat(np.arange(len(start)), pieces)
        number = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = start[which] + number * SEGMENT_WINDOWS
        windows = np.minimum(count[which] - number * SEGMENT_WINDOWS, SEGMENT_WINDOWS)
        if not len(at):
            return at, windows, at, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        size = windows + WINDOW - 1
        digest = mix64((self.total[at + size] - self.total[at]) * self.inverse[at] + size.astype(np.uint64))
        return at, windows, self.text[chosen][which], self.key[chosen][which], digest


def _flushes(batches, limit: int) -> Iterator[tuple[int, pa.Array, pa.Array]]:
    """``(number, ids, texts)`` of runs of rows of about ``limit`` bytes and 65535 rows at most. The numbers
    depend on the input partition and its rows alone, so every pass finds the same."""
    number = TaskContext.get().partitionId() << 24
    held, size, n = [], 0, 0
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
        for begin, end, raw, _ in chunks(texts):
            if held and (size + len(raw) > limit or n + end - begin > 65535):
                yield number, pa.concat_arrays([h[0] for h in held]), pa.concat_arrays([h[1] for h in held])
                held, size, n, number = [], 0, 0, number + 1
            held.append((batch.column(0).slice(begin, end - begin), texts.slice(begin, end - begin)))
            size, n = size + len(raw), n + end - begin
    if held:
        yield number, pa.concat_arrays([h[0] for h in held]), pa.concat_arrays([h[1] for h in held])


def _deal_keys(shards: int, flush_bytes: int):
    """The distinct keys of each flush, by shard; and the digests of its whole texts, by theirs."""
    def run(batches):
        for number, ids, texts in _flushes(batches, flush_bytes):
            whole = np.array([hashlib.blake2b(t.as_buffer() or b"", digest_size=16).digest() for t in texts], "S16").view(np.uint64).reshape(-1, 2)
            place = (whole[:, 0] % np.uint64(shards)).astype(np.int64)
            owner = _order(ids)
            for s in np.unique(place).tolist():
                mine = np.flatnonzero(place == s)
                yield from _rows([(s, WHOLE, number, _pack(whole[mine], owner[mine], mine.astype(np.uint16)))]).to_batches()
            found = [_distinct(Runs(raw, offsets).key) for _, _, raw, offsets in chunks(texts)]
            keys = _distinct(np.concatenate(found)) if found else np.zeros(0, np.uint64)
            shard = (keys % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            edges = np.searchsorted(shard[order], np.arange(shards + 1))
            rows = [(s, KEYS, number, _pack(_packed_keys(keys[order[a:b]])))
                    for s, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
            if rows:
                yield from _rows(rows).to_batches()

    return run


def _copies(flushes: list[int], parts: list[tuple]) -> list[tuple]:
    """Which texts of each flush equal a text of a smaller id."""
    whole, owner = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    at = np.lexsort((owner, whole[:, 1], whole[:, 0]))
    w = whole[at]
    new = np.concatenate([[True], (w[1:] != w[:-1]).any(axis=1)])
    least = np.empty(len(owner), np.int64)
    least[at] = owner[at][np.flatnonzero(new)][np.cumsum(new) - 1]
    rows, begin = [], 0
    for flush, p in zip(flushes, parts):
        n = len(p[1])
        gone = p[2][p[1] > least[begin:begin + n]]
        begin += n
        if len(gone):
            rows.append((0, COPIES, flush, _pack(gone)))
    return rows


def _shared_keys(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Which keys of each flush another flush has too, and which of its texts are copies."""
    kinds = np.array(table["kind"].to_pylist())
    every_flush, blobs = table["flush"].to_pylist(), table["blob"]
    wholes = np.flatnonzero(kinds == WHOLE)
    copies = _copies([every_flush[i] for i in wholes], [_unpack(blobs[i].as_py()) for i in wholes]) if len(wholes) else []
    which = np.flatnonzero(kinds == KEYS)
    if not len(which):
        return _rows(copies)
    flushes = [every_flush[i] for i in which]
    keys = [np.cumsum(_unpack(blobs[i].as_py())[0], dtype=np.uint64) for i in which]
    every = np.sort(np.concatenate(keys))  # each flush has a key once
    often = _distinct(every[1:][every[1:] == every[:-1]])
    rows = []
    for flush, k in zip(flushes, keys):
        at = np.minimum(np.searchsorted(often, k), max(len(often) - 1, 0))
        hit = k[often[at] == k] if len(often) else often
        if len(hit):
            rows.append((0, SHARED, flush, _pack(_packed_keys(hit))))
    return _rows(rows + copies)


def _texts(flush_bytes: int):
    """Each flush packed: ids, sizes and bytes."""
    def run(batches):
        for number, ids, texts in _flushes(batches, flush_bytes):
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1])
            data = b"".join(raw.tobytes() for _, _, raw, _ in chunks(texts))
            yield from _rows([(0, TEXT, number, _pack(ids.to_pylist(), sizes, data))]).to_batches()

    return run


def _split(data: bytes, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


class Flush:
    """The texts of one flush and the places of their segments around shared keys."""

    def __init__(self, table: pa.Table):
        shared, copies, self.verdicts = [], [], []
        for kind, blob in zip(table["kind"].to_pylist(), table["blob"]):
            part = _unpack(blob.as_py())
            if kind == TEXT:
                self.ids, self.sizes, self.data = part
            elif kind == SHARED:
                shared.append(np.cumsum(part[0], dtype=np.uint64))
            elif kind == COPIES:
                copies.append(part[0])
            else:
                self.verdicts.append(part)
        self.order = np.array([-(1 << 63) if i is None else i for i in self.ids], np.int64)
        self.copy = np.zeros(len(self.ids), bool)
        self.copy[np.concatenate(copies).astype(np.int64) if copies else []] = True
        texts = _split(self.data, self.sizes)
        self.parts = [(begin, Runs(raw, offsets), offsets) for begin, _, raw, offsets in chunks(texts)]
        live = [(r.key, r.text + b) for b, r, _ in self.parts]
        key, text = np.concatenate([x[0] for x in live]), np.concatenate([x[1] for x in live])
        mine = ~self.copy[text]
        # A key that two texts of this flush have is shared too.
        pairs = _distinct((key[mine] << np.uint64(24)) | text[mine].astype(np.uint64)) >> np.uint64(24)
        keys = _distinct(np.concatenate([*shared, pairs[1:][pairs[1:] == pairs[:-1]]]))
        found = []
        for begin, r, offsets in self.parts:
            at = np.minimum(np.searchsorted(keys, r.key), max(len(keys) - 1, 0))
            hit = (keys[at] == r.key) & ~self.copy[r.text + begin] if len(keys) else np.zeros(len(r.key), bool)
            start, windows, owner, k, digest = r.segments(np.flatnonzero(hit))
            found.append((start, windows, owner + begin, k, digest, start - offsets[owner]))
        self.start, self.windows, self.owner, self.key, digest, self.place = (np.concatenate([f[i] for f in found]) for i in range(6))
        self.chunk = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
        self.digest, self.first, self.at = np.unique(digest, return_index=True, return_inverse=True)
        self.least = np.full(len(self.digest), (1 << 63) - 1, np.int64)
        np.minimum.at(self.least, self.at, self.order[self.owner])

    def bytes_of(self, which: np.ndarray) -> np.ndarray:
        """The bytes of segments, one behind the other."""
        length = self.windows[which] + WINDOW - 1
        out = np.empty(int(length.sum()), np.uint8)
        to = np.cumsum(length) - length
        for c in np.unique(self.chunk[which]):
            mine = np.flatnonzero(self.chunk[which] == c)
            n = length[mine]
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(to[mine], n) + inner] = self.parts[c][1].raw[np.repeat(self.start[which[mine]], n) + inner]
        return out


def _cut_segments(shards: int):
    """Of one flush: the segments around shared keys, each distinct one once with its smallest id, by shard."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        f = Flush(table)
        shard = (f.key[f.first] % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(shards + 1))
        rows = []
        for s, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            if b > a:
                part = order[a:b]
                which = f.first[part]
                rows.append((s, SEGMENTS, key[0].as_py(), _pack(
                    part.astype(np.uint32), f.key[which], f.digest[part], f.least[part], f.windows[which].astype(np.uint8), f.bytes_of(which))))
        return _rows(rows)

    return run


def _match(index_bytes: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _match_shard(table, index_bytes)

    return run


def _match_shard(table: pa.Table, index_bytes: int) -> pa.Table:
    """Of one shard: which windows of each distinct segment an earlier document has."""
    flushes = table["flush"].to_pylist()
    parts = [_unpack(b.as_py()) for b in table["blob"]]
    k, digest, least, windows = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3, 4))
    windows = windows.astype(np.int64)
    length = windows + WINDOW - 1
    data = np.concatenate([p[5] for p in parts])
    begin = np.cumsum(length) - length
    # Equal segments are one, of the smallest id.
    distinct, first, at = np.unique(digest, return_index=True, return_inverse=True)
    owner = np.full(len(distinct), (1 << 63) - 1, np.int64)
    np.minimum.at(owner, at, least)
    mask = np.zeros(len(distinct), np.uint32)
    dk = k[first]
    # A key with one segment has nothing else to match. The others are indexed, key by key together.
    values, inverse, variants = np.unique(dk, return_inverse=True, return_counts=True)
    todo = np.flatnonzero(variants[inverse] > 1)
    todo = todo[np.lexsort((owner[todo], dk[todo]))]
    sizes = np.cumsum(length[first[todo]] + 1)
    cut, last = [0], 0
    for e in np.flatnonzero(np.diff(dk[todo], append=np.uint64(0)) != 0) + 1 if len(todo) else ():
        if sizes[e - 1] - last >= index_bytes:
            cut.append(int(e))
            last = sizes[e - 1]
    if cut[-1] != len(todo):
        cut.append(len(todo))
    for a, b in zip(cut[:-1], cut[1:]):
        part = todo[a:b]
        part = part[np.argsort(owner[part], kind="stable")]
        n = length[first[part]]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        index = RunIndex(data[np.repeat(begin[first[part]], n) + inner], n, owner[part], WINDOW)
        mask[part] = index.earlier(n, owner[part], WINDOW)
    rows, at_row = [], 0
    for flush, p in zip(flushes, parts):
        d = at[at_row:at_row + len(p[0])]
        at_row += len(p[0])
        # A later document loses the segment whole; its first owner what still earlier ones have.
        verdict = np.where(p[3] > owner[d], _ALL, mask[d])
        rows.append((0, VERDICTS, flush, _pack(p[0], verdict.astype(np.uint32))))
    return _rows(rows)


def _remove(id_kind: pa.DataType, with_text: bool):
    schema = pa.schema([("id", id_kind), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                        ("kept_sha256", pa.string()), *([("text", pa.string())] if with_text else [])])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        f = Flush(table)  # the same segments, in the same order, as when they were cut
        ids, sizes, data = f.ids, f.sizes, f.data
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        mask = np.zeros(len(f.digest), np.uint32)
        for which, verdict in f.verdicts:
            mask[which] = verdict
        # Within the flush only the smallest id can be the first owner.
        mine = np.where(f.order[f.owner] > f.least[f.at], _ALL, mask[f.at])
        edge = np.zeros(len(data) + 1, np.int32)
        base = offsets[f.owner] + f.place
        for j in range(SEGMENT_WINDOWS):
            hit = base[(j < f.windows) & (mine >> np.uint32(j) & np.uint32(1) == 1)] + j
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + WINDOW, -1)
        # A copy of an earlier text goes whole, if there is a window in it.
        whole = np.flatnonzero(f.copy & (sizes >= WINDOW))
        np.add.at(edge, offsets[whole], 1)
        np.add.at(edge, offsets[whole + 1], -1)
        gone = np.cumsum(edge) > 0
        raw = np.frombuffer(data, np.uint8)
        removed, spans, digests, kept_texts = [], [], [], []
        total = np.concatenate([[0], np.cumsum(gone[:len(data)])])
        before = np.concatenate([[False], gone[:-1]])
        before[offsets[:-1]] = False
        begins = np.concatenate([[0], np.cumsum((gone & ~before)[:len(data)])])
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            r = int(total[b] - total[a])
            left = raw[a:b][~gone[a:b]].tobytes() if r else data[a:b]
            removed.append(r)
            spans.append(int(begins[b] - begins[a]))
            digests.append(hashlib.sha256(left).hexdigest())
            if with_text:
                kept_texts.append(left.decode(errors="ignore"))
        out = [pa.array(ids, id_kind), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests)]
        return pa.Table.from_arrays(out + ([pa.array(kept_texts, pa.string())] if with_text else []), schema=schema)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False,
                   flush_bytes: int = FLUSH_BYTES, shard_bytes: int = SHARD_BYTES, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``text``, what is left) for every row.

    A byte is removed when a string of WINDOW bytes over it also starts in a document of a smaller id.

    1. Each window has a key, the smallest hash of the ANCHOR-byte strings in it: equal windows have
       equal keys. Neighbouring windows mostly share a key. The distinct keys of each flush of about
       ``flush_bytes`` go to the key's shard, which tells every flush what keys others have too.
    2. The flush cuts out the segments around shared keys. Distinct segments, with the smallest id that
       has each, go to the key's shard.
    3. There segments of keys with several are put into run-length BWT indexes of about ``index_bytes``, in order of their
       owners, and streamed through them: for each window the class of rows that agree on it gives
       the smallest owner.
    4. The verdicts go back to the flush, which cuts the bytes.

    Whole texts that equal one of a smaller id are found by their digests in step 1 and go whole. A key
    that a third of all documents hold counts once per flush, and so does a segment; exact and near
    copies thus cost what they cost to read. The last step cuts its segments anew, as in step 2. The text is shuffled twice, packed. ``docs`` is read three times and
    has to have the same partitions each time, as a table has; materialize anything else first.

    Defined cases: null texts count as empty; texts under WINDOW bytes lose nothing; among rows that
    repeat an id none is smaller; a null id is smaller than all others; an empty table gives
    no rows; other columns are ignored. Ids are integers. A cut inside a character drops the rest of
    it from ``text``, while the digest is of the bytes."""
    spark = docs.sparkSession
    kind = pa.int64()
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, math.ceil(size / shard_bytes), min(parts, math.ceil(size / (1 << 20))))
    keys = rows.mapInArrow(_deal_keys(shards, flush_bytes), _ROW).repartition(shards, "shard")
    shared = keys.groupBy("shard").applyInArrow(_shared_keys, _ROW)
    texts = rows.mapInArrow(_texts(flush_bytes), _ROW)
    flushes = max(1, math.ceil(size / flush_bytes), min(parts, math.ceil(size / (1 << 20))))
    shared = materialize(shared, "span-shared")
    verdicts = (texts.unionByName(shared).repartition(flushes, "flush").groupBy("flush").applyInArrow(_cut_segments(shards), _ROW)
                .repartition(shards, "shard").groupBy("shard").applyInArrow(_match(index_bytes), _ROW))
    last = texts.unionByName(shared).unionByName(verdicts).repartition(flushes, "flush")
    schema = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", text string" if with_text else "")
    return last.groupBy("flush").applyInArrow(_remove(kind, with_text), schema)
