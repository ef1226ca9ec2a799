"""Personal data: exact patterns, and a conditional random field over word shapes for what they miss.

The patterns are greedy and never retried, so a phone number with a card number behind it is one run of
digits that fits neither; spellings such as ``name (at) host (dot) org`` fit none. The field labels
tokens by their shapes and their neighbours' and adds such spans."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata.llm import crf
from tunedata.llm.pii_examples import examples
from tunedata.llm.tokens import chunks

KINDS = ("email", "ip", "card", "phone")
#: Labelled rows that training takes at most: of more, those of the smallest text hashes.
TRAIN_ROWS = 4000
#: Tokens on either side of a digit, an ``@`` or a spelled ``at`` or ``dot`` that may be part of a span.
REACH = 8
CHUNK = 1 << 22

_LABELS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(rb"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")

_BLANK, _LETTER, _DIGIT, _SIGN = range(4)
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[:33] = _CLASS[127] = _BLANK
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = _LETTER
#: Shapes: letters by case and length, digits by length and check, signs one by one.
_N_SHAPES, _PAIRS = 160, 4096
_EDGE = 2 * _N_SHAPES
_OFFSETS = range(-3, 4)
_WORD_OFFSETS = range(-2, 2)


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = d - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


# -- exact patterns ---------------------------------------------------------------------------------

def base_spans(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    """``(row, start, end, kind)`` in bytes of the patterns' matches in all rows of a chunk. Digits, ``@`` and
    ``+`` are found for the whole chunk at once; only what is around them is looked at one by one."""
    buf, found = raw.tobytes(), []

    def row_of(at: np.ndarray) -> np.ndarray:
        return np.searchsorted(offsets, at, side="right") - 1

    hits = np.flatnonzero(raw == 64)
    last = {}
    for at, row in zip(hits.tolist(), row_of(hits).tolist()):
        low, end = max(int(offsets[row]), last.get(row, 0)), int(offsets[row + 1])
        start = at
        while start > low and buf[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(buf, at + 1, end) if start < at else None
        if m:
            last[row] = m.end()
            found.append((row, start, m.end(), 0))

    hits = np.flatnonzero(raw == 43)
    for at, row in zip(hits.tolist(), row_of(hits).tolist()):
        m = _PHONE.match(buf, at, int(offsets[row + 1]))
        if m and 9 <= sum(48 <= c <= 57 for c in m.group()) <= 15:
            found.append((row, at, m.end(), 3))

    digits = np.flatnonzero(_CLASS[raw] == _DIGIT)
    if len(digits):
        rows, gap = row_of(digits), np.diff(digits)
        between = raw[np.minimum(digits[:-1] + 1, len(raw) - 1)]
        same = rows[1:] == rows[:-1]

        def groups(joins: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
            """Runs of digits that one joining sign at most parts, of ``least`` digits or more."""
            cut = np.flatnonzero(~(same & ((gap == 1) | (gap == 2) & joins))) + 1
            first, after = np.concatenate([[0], cut]), np.concatenate([cut, [len(digits)]])
            for i in np.flatnonzero(after - first >= least).tolist():
                yield int(rows[first[i]]), int(digits[first[i]]), int(digits[after[i] - 1]) + 1

        for row, start, end in groups((between == 32) | (between == 45), 12):
            number = buf[start:end].replace(b" ", b"").replace(b"-", b"")
            if len(number) <= 19 and luhn(number):
                found.append((row, start, end, 2))
        for row, start, end in groups(between == 46, 4):
            for m in _IP.finditer(buf, start, end):
                if all(len(p.lstrip(b"0")) < 4 and int(p) < 256 for p in m.group().split(b".")):
                    found.append((row, m.start(), m.end(), 1))
    return found


# -- tokens and features ----------------------------------------------------------------------------

@dataclass(frozen=True)
class Items:
    """Tokens that may be part of a span, chain by chain: byte ends, row, features."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    features: np.ndarray
    chain: np.ndarray
    length: np.ndarray


def n_features(words: np.ndarray) -> int:
    return len(_OFFSETS) * (_EDGE + 1) + 2 * _PAIRS + len(_WORD_OFFSETS) * (len(words) + 1)


def _pack_words(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Lower-cased words of up to 8 bytes as integers, 0 for others."""
    out = np.zeros(len(start), np.uint64)
    for i in range(8):
        c = raw[np.minimum(start + i, len(raw) - 1)]
        c = np.where((c > 64) & (c < 91), c + 32, c).astype(np.uint64)
        out = np.where(i < size, (out << np.uint64(8)) | c, out)
    return np.where(size <= 8, out, np.uint64(0))


def _shapes(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    first = raw[start]
    kind = _CLASS[first]
    upper = lambda c: (c > 64) & (c < 91)
    case = np.where(first > 127, 3, np.where(upper(first), np.where(upper(raw[start + size - 1]), 2, 1), 0))
    letters = case * 6 + np.searchsorted([1, 2, 3, 5, 8], size)
    value = np.zeros(len(start), np.int64)
    for i in range(3):
        value = np.where(i < size, value * 10 + raw[np.minimum(start + i, len(raw) - 1)].astype(np.int64) - 48, value)
    right = np.where(size <= 3, value < 256, False)
    long = np.flatnonzero((kind == _DIGIT) & (size >= 12) & (size <= 19))
    for i in long.tolist():
        right[i] = luhn(raw[start[i]:start[i] + size[i]].tobytes())
    digits = 24 + 2 * np.searchsorted([1, 2, 3, 4, 5, 6, 7, 9, 11, 19], size) + right
    return np.where(kind == _LETTER, letters, np.where(kind == _DIGIT, digits, 52 + np.minimum(first, 107)))


def items_of(raw: np.ndarray, offsets: np.ndarray, words: np.ndarray) -> Items:
    """Tokens (runs of letters, runs of digits, single signs) near an anchor, with their features: the shapes of the
    token and three on either side, with the blank before each; two pairs of shapes; words of the table."""
    kind = _CLASS[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    change = edge[:-1] | (kind == _SIGN)
    change[1:] |= kind[1:] != kind[:-1]
    at = np.flatnonzero(change)
    size = np.diff(np.append(at, len(raw)))
    solid = kind[at] != _BLANK
    gap = np.zeros(len(at), bool)
    gap[1:] = ~solid[:-1] & ~edge[at[1:]]
    start, size, gap = at[solid], size[solid], gap[solid]
    n = len(start)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
    anchor = (kind[start] == _DIGIT) | (raw[start] == 64)
    short = np.flatnonzero((kind[start] == _LETTER) & (size >= 2) & (size <= 3))
    packed = _pack_words(raw, start[short], size[short])
    code = lambda w: np.uint64(int.from_bytes(w, "big"))
    open_ = np.isin(raw[start[np.maximum(short - 1, 0)]], np.frombuffer(b"([{", np.uint8)) & (short > 0)
    anchor[short[(packed == code(b"dot")) | ((packed == code(b"at")) & open_)]] = True

    found = np.flatnonzero(anchor)
    near = np.zeros(n, bool)
    for o in range(-REACH, REACH + 1):
        j = found + o
        ok = (j >= 0) & (j < n)
        ok[ok] = row[j[ok]] == row[found[ok]]
        near[j[ok]] = True
    pick = np.flatnonzero(near)
    fresh = np.ones(len(pick), bool)
    fresh[1:] = (np.diff(pick) > 1) | (row[pick[1:]] != row[pick[:-1]])
    chain = np.flatnonzero(fresh)

    # Shapes also of the neighbours that features look at.
    seen = near.copy()
    for o in _OFFSETS:
        j = pick + o
        seen[j[(j >= 0) & (j < n)]] = True
    seen = np.flatnonzero(seen)
    shape = np.full(n, _EDGE)
    shape[seen] = 2 * _shapes(raw, start[seen], size[seen]) + gap[seen]
    # Four groups of four digits with a right check sum: the first of them has a shape of its own.
    four = (kind[start] == _DIGIT) & (size == 4)
    head = np.flatnonzero(four[:max(n - 3, 0)] & four[1:n - 2] & four[2:n - 1] & four[3:] & gap[1:n - 2] & gap[2:n - 1] & gap[3:]) if n > 3 else []
    for i in head:
        if row[i] == row[i + 3] and luhn(b"".join(raw[start[j]:start[j] + 4].tobytes() for j in range(i, i + 4))):
            shape[i] += 2
    word = np.zeros(n, np.int64)
    if len(words):
        p = np.where(kind[start[seen]] == _LETTER, _pack_words(raw, start[seen], size[seen]), np.uint64(0))
        k = np.minimum(np.searchsorted(words, p), len(words) - 1)
        word[seen] = np.where(words[k] == p, k + 1, 0)

    def other(values: np.ndarray, o: int, none: int) -> np.ndarray:
        j = np.clip(pick + o, 0, max(n - 1, 0))
        ok = (pick + o >= 0) & (pick + o < n) & (row[j] == row[pick])
        return np.where(ok, values[j], none)

    by = {o: other(shape, o, _EDGE) for o in _OFFSETS}
    columns, base = [], 0
    for o in _OFFSETS:
        columns.append(base + by[o])
        base += _EDGE + 1
    for a, b in ((0, 1), (-1, 0)):
        columns.append(base + (by[a] * 31 + by[b] * 1009) % _PAIRS)
        base += _PAIRS
    for o in _WORD_OFFSETS:
        columns.append(base + other(word, o, 0))
        base += len(words) + 1
    length = np.diff(np.append(chain, len(pick)))
    return Items(start[pick], (start + size)[pick], row[pick], np.stack(columns, axis=1).astype(np.int32), chain, length)


# -- the field --------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Field:
    model: crf.Crf
    words: np.ndarray


def allowed_moves() -> np.ndarray:
    """The inside of a kind follows its begin or inside only."""
    ok = np.ones((_LABELS, _LABELS), bool)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        ok[:, inside] = False
        ok[[inside - 1, inside], inside] = True
    return ok


def fit(rows: list[tuple[str, list[tuple[str, int, int]]]], least: int = 3) -> Field:
    """A field from ``(text, [(kind, start, end)])``; words that ``least`` rows hold are features of their own."""
    texts = [t.encode() for t, _ in rows]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    count: dict[int, int] = {}
    for t in texts:
        for w in {w.lower() for w in re.findall(rb"[A-Za-z\x80-\xff]{2,8}", t)}:
            count[int.from_bytes(w, "big")] = count.get(int.from_bytes(w, "big"), 0) + 1
    words = np.array(sorted(w for w, c in count.items() if c >= least), np.uint64)
    items = items_of(raw, offsets, words)
    gold = np.zeros(len(items.start), np.int64)
    for i, (text, spans) in enumerate(rows):
        for kind, a, b in spans:
            lo, hi = (int(offsets[i]) + len(text[:x].encode()) for x in (a, b))
            inside = np.flatnonzero((items.start >= lo) & (items.end <= hi))
            gold[inside] = 2 + 2 * KINDS.index(kind)
            gold[inside[:1]] -= 1
    return Field(crf.train(items.features, gold, items.chain, items.length, n_features(words), allowed_moves()), words)


def fit_table(labelled: DataFrame, text_col: str = "text", spans_col: str = "spans", limit: int = TRAIN_ROWS) -> Field:
    """A field from a table of texts with ``kind:start:end`` spans, comma-joined; nulls are passed over."""
    rows = (labelled.select(F.col(text_col).alias("t"), F.coalesce(F.col(spans_col), F.lit("")).alias("s")).filter("t is not null")
            .orderBy(F.xxhash64("t"), "t", "s").limit(limit).collect())
    return fit([(r["t"], [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["s"].split(",") if s)]) for r in rows])


def labelled_table(spark: SparkSession) -> DataFrame:
    """The table that the operator learns from unless it is given another."""
    return spark.createDataFrame([(t, ",".join(f"{k}:{a}:{b}" for k, a, b in s)) for t, s in examples()], "text string, spans string")


def _plausible(kind: int, text: str) -> bool:
    digits = re.sub(r"[^0-9]", "", text)
    if kind == 0:
        spelled = re.sub(r"\s*[(\[{<]\s*at\s*[)\]}>]\s*|\s+at\s+", "@", text, flags=re.I)
        spelled = re.sub(r"\s*[(\[{<]\s*(?:dot|\.)\s*[)\]}>]\s*|\s+dot\s+", ".", spelled, flags=re.I)
        return _EMAIL.fullmatch(re.sub(r"\s*([@.])\s*", r"\1", spelled)) is not None
    if kind == 1:
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) < 4 and int(p) < 256 for p in parts)
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits.encode())
    return 9 <= len(digits) <= 15


def added_spans(raw: np.ndarray, offsets: np.ndarray, field: Field, base: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans that the field finds where no pattern matched, and whose digits or spelling can be of their kind."""
    items = items_of(raw, offsets, field.words)
    if not len(items.start):
        return []
    labels = crf.viterbi(field.model, items.features, items.chain, items.length)
    begin = np.flatnonzero(labels % 2 == 1)
    taken = np.zeros(len(raw) + 1, bool)
    for _, a, b, _kind in base:
        taken[a:b] = True
    heads = np.zeros(len(labels), bool)
    heads[items.chain] = True
    out = []
    for i in begin.tolist():
        j, inside = i + 1, labels[i] + 1
        while j < len(labels) and labels[j] == inside and not heads[j]:
            j += 1
        a, b, kind = int(items.start[i]), int(items.end[j - 1]), int(labels[i] - 1) // 2
        if not taken[a:b].any() and _plausible(kind, raw[a:b].tobytes().decode("utf-8", "replace")):
            out.append((int(items.row[i]), a, b, kind))
    return out


# -- tables -----------------------------------------------------------------------------------------

def _by_row(raw: np.ndarray, offsets: np.ndarray, spans: list[tuple[int, int, int, int]]) -> dict[int, list[tuple[int, int, int]]]:
    """Spans of each row that has any, in code points, by start, then kind."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    for row, a, b, kind in spans:
        rows.setdefault(row, []).append((a, b, kind))
    for row, found in rows.items():
        lo = int(offsets[row])
        points = np.concatenate([[0], np.cumsum((raw[lo:offsets[row + 1]] & 0xC0) != 0x80)])
        rows[row] = sorted(((int(points[a - lo]), int(points[b - lo]), k) for a, b, k in found), key=lambda s: (s[0], s[2], s[1]))
    return rows


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """One row per document: ``id, n_email, n_ip, n_card, n_phone, base, spans, n_added``. The counts and ``base``
    are the patterns'; ``spans`` holds them and what the field adds, ``n_added`` many. Offsets are code points.

    Whole texts are scanned in chunks of ``CHUNK`` bytes of several texts (a longer text is a chunk of its own),
    without a shuffle; a task that is lost is repeated by itself. The model, some hundred kilobytes, goes
    with the tasks; its size follows the labelled table, of which ``TRAIN_ROWS`` rows are taken at most.

    Defined cases: a null text counts as empty and has no spans; matches of two kinds may overlap, an added
    span overlaps no pattern's; the first of equal Viterbi scores is taken, by label; null and
    repeated ids each keep their row; an empty table gives no rows; an empty labelled table adds nothing;
    other columns are ignored."""
    field = fit_table(labelled if labelled is not None else labelled_table(docs.sparkSession))
    names = ["id", *[f"n_{k}" for k in KINDS], "base", "spans", "n_added"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, raw, offsets in chunks(batch.column(1), CHUNK):
                base = base_spans(raw, offsets)
                added = added_spans(raw, offsets, field, base)
                exact, every = _by_row(raw, offsets, base), _by_row(raw, offsets, base + added)
                n = end - begin
                counts = np.zeros((len(KINDS) + 1, n), np.int64)
                for row, _, _, kind in base:
                    counts[kind, row] += 1
                for row, *_ in added:
                    counts[-1, row] += 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, n), *[pa.array(c) for c in counts[:-1]],
                     pa.array([_joined(exact.get(i, [])) for i in range(n)]), pa.array([_joined(every.get(i, [])) for i in range(n)]),
                     pa.array(counts[-1])], names=names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = dict(rows.dtypes)["id"]
    return rows.mapInArrow(scan, f"id {id_type}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base string, spans string, n_added bigint")


def redact_personal(docs: DataFrame, text_col: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """``docs``, all columns, with every span (of overlapping ones: their union, under the first's kind)
    replaced by its kind in angle brackets. Null texts stay null; the cases are those of ``find_personal``."""
    field = fit_table(labelled if labelled is not None else labelled_table(docs.sparkSession))
    at = docs.columns.index(text_col)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for begin, _, raw, offsets in chunks(batch.column(at), CHUNK):
                base = base_spans(raw, offsets)
                for row, spans in _by_row(raw, offsets, base + added_spans(raw, offsets, field, base)).items():
                    text, out, done = texts[begin + row], [], 0
                    for a, b, kind in spans:
                        if a >= done:
                            out += [text[done:a], f"<{KINDS[kind]}>"]
                        done = max(done, b)
                    texts[begin + row] = "".join([*out, text[done:]])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(mask, docs.schema)
