"""LM scoring: a backed-off bigram model over all training tokens, held and queried as Elias-Fano
n-gram tries, one per shard of contexts."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunedata.llm.common import materialize
from tunedata.llm.ngram_trie import NgramTrie
from tunedata.llm.tokens import chunks, lowered, mix64, word_hashes

#: Hashes that stand for the beginning and the end of a text.
BEGIN, END = np.uint64(0x1234567890ABCDEF), np.uint64(0x0FEDCBA098765432)
#: Tokens that one flush of a map task holds, and records that one shard holds, about.
FLUSH_TOKENS, SHARD_TOKENS = 1_500_000, 1_000_000
#: A token with more than this share of all tokens is dealt over several shards.
HOT_SHARE = 1 / 1024
#: Frequent tokens that the blobs between tasks name by their place in a table instead of by their
#: hash, and whose counts every task knows. The table decides only how records are written.
CODED = 1 << 16
#: Taken off the count of every pair seen, for the pairs not seen.
DISCOUNT = 0.8
#: Kinds of rows between the stages.
PAIRS, DOCS, SUMS, COUNTS, UNSEEN, HOT = range(6)
_ROW = "shard int, kind int, flush bigint, blob binary"
_SCHEMA = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("flush", pa.int64()), ("blob", pa.binary())])


def held_out(id_col: str, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def _pack(*arrays) -> bytes:
    return zstd.compress(pickle.dumps(arrays, protocol=5), 1)


def _unpack(blob: bytes) -> tuple:
    return pickle.loads(zstd.decompress(blob))


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SCHEMA)], schema=_SCHEMA)


def _streams(batch: pa.RecordBatch, text: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, tokens, bounds)`` of runs of a batch's texts: the words' hashes, each text led by
    BEGIN and closed by END; text i has ``tokens[bounds[i]:bounds[i + 1]]``."""
    for begin, end, raw, offsets in chunks(batch.column(text)):
        h, _, _, at = word_hashes(lowered(raw), offsets)
        n = end - begin
        bounds = at + 2 * np.arange(n + 1)
        out = np.empty(len(h) + 2 * n, np.uint64)
        out[np.arange(len(h)) + 1 + 2 * np.repeat(np.arange(n), np.diff(at))] = h
        out[bounds[:-1]] = BEGIN
        out[bounds[1:] - 1] = END
        yield begin, out, bounds


def _code(words: np.ndarray, book: np.ndarray) -> tuple:
    """Ascending hashes: which are in the book, the steps between their places, and the others by byte planes."""
    at = np.minimum(np.searchsorted(book, words), max(len(book) - 1, 0))
    known = book[at] == words if len(book) else np.zeros(len(words), bool)
    rest = np.ascontiguousarray(words[~known].view(np.uint8).reshape(-1, 8).T)
    return np.packbits(known), np.diff(at[known], prepend=0).astype(np.uint16), rest


def _decode(coded: tuple, book: np.ndarray) -> np.ndarray:
    flags, steps, rest = coded
    out = np.empty(len(steps) + rest.shape[1], np.uint64)
    known = np.unpackbits(flags, count=len(out)).astype(bool)
    out[known] = book[np.cumsum(steps, dtype=np.int64)] if len(steps) else 0
    out[~known] = np.ascontiguousarray(rest.T).view(np.uint64).ravel()
    return out


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """The CODED most frequent tokens, about, ascending; those among them with more than HOT_SHARE of
    all tokens (there can be no more than 1 / HOT_SHARE of them); and the number of tokens. Both lists
    decide only how records are dealt and written. A task keeps at most 4 * CODED tokens and hands on CODED."""
    def most(token: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        token, at = np.unique(token, return_inverse=True)
        n = np.bincount(at, n, len(token)).astype(np.int64)
        if len(token) > k:
            best = np.sort(np.argpartition(-n, k)[:k])
            token, n = token[best], n[best]
        return token, n

    def run(batches):
        held, counts, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for batch in batches:
            for _, tokens, _ in _streams(batch, 0):
                u, n = np.unique(tokens, return_counts=True)
                held, counts = most(np.concatenate([held, u]), np.concatenate([counts, n]), 4 * CODED)
                total += len(tokens)
        held, counts = most(held, counts, CODED)
        often = counts > 1  # a token met once in a task gains nothing from the table
        held, counts = held[often], counts[often]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held.view(np.int64), 0)), pa.array(np.append(counts, 0)),
                                          pa.array(np.append(np.zeros(len(held), np.int64), total))], names=["token", "n", "total"])

    counts = docs.select("text").mapInArrow(run, "token bigint, n bigint, total bigint").groupBy("token").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"))
    counts = materialize(counts, "lm-frequent")
    total = counts.agg(F.sum("total")).first()[0] or 0
    rows = counts.filter("n > 0").orderBy(F.desc("n"), "token").limit(CODED).select("token", "n").collect()  # 16 bytes a row
    book = np.array([r["token"] for r in rows], np.int64).view(np.uint64)
    n = np.array([r["n"] for r in rows], np.int64)
    return np.sort(book), np.sort(book[n > max(1, total * HOT_SHARE)]), total


def _exact_counts(docs: DataFrame, book: np.ndarray) -> tuple[np.ndarray, int, int, np.ndarray]:
    """Of the training texts: the book's tokens' counts, the number of tokens and of texts. Of all texts:
    the book's tokens' counts."""
    keys = np.append(book, np.uint64(0xFFFFFFFFFFFFFFFF))

    def run(batches):
        train, every, tokens_n, texts_n = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), 0, 0
        for batch in batches:
            learn = ~np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
            for begin, tokens, bounds in _streams(batch, 0):
                at = np.searchsorted(keys, tokens)
                at[keys[np.minimum(at, len(keys) - 1)] != tokens] = len(keys) - 1
                mine = np.repeat(learn[begin:begin + len(bounds) - 1], np.diff(bounds))
                train += np.bincount(at[mine], minlength=len(keys))
                every += np.bincount(at, minlength=len(keys))
                tokens_n += int(mine.sum())
                texts_n += int(learn[begin:begin + len(bounds) - 1].sum())
        met = np.flatnonzero(every[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(met, [-1, -2])), pa.array(np.append(train[met], [tokens_n, texts_n])),
                                          pa.array(np.append(every[met], [0, 0]))], names=["k", "n", "m"])

    rows = docs.select("text", "held").mapInArrow(run, "k bigint, n bigint, m bigint").groupBy("k").agg(
        F.sum("n").alias("n"), F.sum("m").alias("m")).collect()  # at most CODED + 2 rows
    count, every = np.zeros(len(book), np.int64), np.zeros(len(book), np.int64)
    tokens = texts = 0
    for k, n, m in rows:
        if k >= 0:
            count[k], every[k] = n, m
        elif k == -1:
            tokens = n
        else:
            texts = n
    return count, tokens - texts, texts, every  # BEGIN is no token


def _deal(docs: DataFrame, book: np.ndarray, book_count: np.ndarray, hot: np.ndarray, spread: np.ndarray, shards: int) -> DataFrame:
    """The (context, word, text, count) records of every text, packed by shard. The shard is that of
    the context; a hot context has several, by the word."""
    def flush(held: list, number: int) -> Iterator[pa.RecordBatch]:
        tokens = np.concatenate([h[0] for h in held])
        sizes = np.concatenate([h[1] for h in held])
        ids = [i for h in held for i in h[2]]
        out = np.concatenate([h[3] for h in held])
        texts = np.repeat(np.arange(len(sizes)), sizes)
        vocabulary, at = np.unique(tokens, return_inverse=True)
        starts = np.flatnonzero(tokens[:-1] != END)  # END is a word, never a context
        context, word, text = at[starts], at[starts + 1], texts[starts]
        if len(vocabulary) < 1 << 24:
            key = (context.astype(np.uint64) << np.uint64(40)) | (word.astype(np.uint64) << np.uint64(16)) | text.astype(np.uint64)
            key, count = np.unique(key, return_counts=True)
            context, word = (key >> np.uint64(40)).astype(np.int64), ((key >> np.uint64(16)) & np.uint64(0xFFFFFF)).astype(np.int64)
            text = (key & np.uint64(0xFFFF)).astype(np.uint16)
        else:  # one text of very many different words
            order = np.lexsort((text, word, context))
            context, word, text = context[order], word[order], text[order].astype(np.uint16)
            first = np.flatnonzero(np.append(True, (np.diff(context) != 0) | (np.diff(word) != 0) | (text[1:] != text[:-1])))
            count = np.diff(np.append(first, len(context)))
            context, word, text = context[first], word[first], text[first]
        where = np.searchsorted(hot, vocabulary)
        is_hot = hot[np.minimum(where, len(hot) - 1)] == vocabulary if len(hot) else np.zeros(len(vocabulary), bool)
        ways = np.where(is_hot, spread[np.minimum(where, len(hot) - 1)], 1) if len(hot) else np.ones(len(vocabulary), np.int64)
        shard = ((mix64(vocabulary) >> np.uint64(11)).astype(np.int64)[context]
                 + (mix64(vocabulary + np.uint64(77)) >> np.uint64(11)).astype(np.int64)[word] % ways[context]) % shards
        order = np.argsort(shard, kind="stable")
        shard = shard[order]
        b_at = np.minimum(np.searchsorted(book, vocabulary), max(len(book) - 1, 0))
        there = (book[b_at] == vocabulary if len(book) else np.zeros(len(vocabulary), bool)) & (vocabulary != BEGIN) & (vocabulary != END)
        c = np.where(there, book_count[b_at] if len(book) else 0, 0)  # the base of the book's words needs no shard
        rows = [(number % shards, DOCS, number, _pack(ids, out, sizes - 1, np.bincount(texts, np.log10(c + 1)[at], len(sizes)),
                                                      np.bincount(texts, (c > 0)[at], len(sizes))))]
        edges = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
        flags = np.packbits(out)
        for a, b in zip(edges[:-1], edges[1:]):
            part = order[a:b]
            cu, cn = np.unique(context[part], return_counts=True)  # records are in context order
            wu, wi = np.unique(word[part], return_inverse=True)
            rows.append((int(shard[a]), PAIRS, number, _pack(
                flags, _code(vocabulary[cu], book), cn.astype(np.uint32), _code(vocabulary[wu], book),
                wi.astype(np.uint16 if len(wu) < 1 << 16 else np.uint32), text[part], count[part].astype(np.uint32))))
            if len(rows) >= 16:
                yield from _rows(rows).to_batches()
                rows = []
        if rows:
            yield from _rows(rows).to_batches()

    def run(batches):
        number = TaskContext.get().partitionId() << 24
        held, size, n = [], 0, 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
            for begin, tokens, bounds in _streams(batch, 1):
                k = len(bounds) - 1
                if held and (size + len(tokens) > FLUSH_TOKENS or n + k > 65535):
                    yield from flush(held, number)
                    held, size, n, number = [], 0, 0, number + 1
                    pa.default_memory_pool().release_unused()
                held.append((tokens, np.diff(bounds), ids[begin:begin + k], out[begin:begin + k]))
                size, n = size + len(tokens), n + k
        if held:
            yield from flush(held, number)

    return docs.select("id", "text", "held").mapInArrow(run, _ROW)


#: Steps of the partial sums of scores and of bases: 2 ** -24 and 2 ** -36.
SCORE_BITS, BASE_BITS = 24, 36


def _fixed(x: np.ndarray, bits: int) -> np.ndarray:
    """Numbers in steps of 2 ** -bits, by byte planes, the sign in the lowest bit."""
    v = np.rint(np.ldexp(x, bits)).astype(np.int64)
    return np.ascontiguousarray(((v << 1) ^ (v >> 63)).view(np.uint8).reshape(-1, 8).T)


def _floating(planes: np.ndarray, bits: int) -> np.ndarray:
    v = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
    return np.ldexp(((v >> np.uint64(1)).astype(np.int64) ^ -(v & np.uint64(1)).astype(np.int64)).astype(float), -bits)


def _sums(flush: int, text: np.ndarray, base: np.ndarray, known: np.ndarray, score: np.ndarray, backed: np.ndarray) -> tuple:
    """The sums of one flush's texts, those that have any; base and known of those with words known here."""
    n = int(text.max()) + 1
    there = np.flatnonzero(np.bincount(text, minlength=n))
    add = lambda x: np.bincount(text, x, n)
    k = add(known).astype(np.uint32)
    rare = np.flatnonzero(k)
    return (int(flush % (1 << 31)), SUMS, flush, _pack(
        np.diff(there, prepend=0).astype(np.uint16), _fixed(add(score)[there], SCORE_BITS), add(backed)[there].astype(np.uint32),
        np.diff(rare, prepend=0).astype(np.uint16), _fixed(add(base)[rare], BASE_BITS), k[rare]))


def _shard_model(book: np.ndarray, book_count: np.ndarray, hot: np.ndarray, hot_count: np.ndarray, end_count: int, shards: int):
    """Counts, trie and scores of one shard's records."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows, parts, flushes = [], [], []
        for kind, flush, blob in zip(table["kind"].to_pylist(), table["flush"].to_pylist(), table["blob"]):
            if kind == DOCS:
                rows.append((flush % (1 << 31), DOCS, flush, blob.as_py()))
            else:
                part = _unpack(blob.as_py())
                parts.append((part[0], _decode(part[1], book), part[2], _decode(part[3], book), *part[4:]))
                flushes.append(flush)
        if not parts:
            return _rows(rows)
        contexts, ci = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
        words, wi = np.unique(np.concatenate([p[3] for p in parts]), return_inverse=True)
        c_at = np.cumsum([0] + [len(p[1]) for p in parts])
        w_at = np.cumsum([0] + [len(p[3]) for p in parts])
        context = np.concatenate([np.repeat(ci[a:b], p[2]) for p, a, b in zip(parts, c_at[:-1], c_at[1:])])
        word = np.concatenate([wi[a:b][p[4]] for p, a, b in zip(parts, w_at[:-1], w_at[1:])])
        count = np.concatenate([p[6] for p in parts]).astype(np.int64)
        learn = np.concatenate([np.unpackbits(p[0])[p[5]] == 0 for p in parts])
        pairs, at = np.unique((context.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64), return_inverse=True)
        pair_c, pair_w = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        seen = np.bincount(at, count * learn, len(pairs))
        total = np.bincount(context, count * learn, len(contexts))
        kinds = np.bincount(pair_c, seen > 0, len(contexts))
        h_at = np.searchsorted(hot, contexts)
        is_hot = hot[np.minimum(h_at, len(hot) - 1)] == contexts if len(hot) else np.zeros(len(contexts), bool)
        full = np.where(is_hot, hot_count[np.minimum(h_at, len(hot) - 1)], total) if len(hot) else total
        node = np.flatnonzero(seen)
        trie = NgramTrie(pair_c[node], pair_w[node], np.log10((seen[node] - DISCOUNT) / full[pair_c[node]]), len(contexts), len(words))
        logs = trie.lookup(pair_c, pair_w)[at]
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.where(full > 0, np.log10(DISCOUNT * kinds / full), 0.0)  # a context without counts gives way wholly
        weight[is_hot] = 0.0  # summed over the context's shards, and added in the last step
        rows += [(int(key[0].as_py()), HOT, -1, _pack(h_at[is_hot], DISCOUNT * kinds[is_hot]))] if is_hot.any() else []
        is_begin = contexts == BEGIN
        in_book = np.isin(contexts, book)
        counted = (total > 0) & ~in_book & ~is_begin
        rows.append((int(key[0].as_py()), COUNTS, -1, _pack(_code(contexts[counted], book), total[counted].astype(np.int64))))
        base = np.where(is_begin | in_book, 0.0, np.log10(full + 1))[context]  # the book's words were counted by their flush
        known = ((full > 0) & ~is_begin & ~in_book)[context]
        back = np.isnan(logs)
        # The lower order of a backed-off word: known here for the book's words and END, else asked of the word's shard.
        b_at = np.minimum(np.searchsorted(book, words), max(len(book) - 1, 0))
        here = book[b_at] == words if len(book) else np.zeros(len(words), bool)
        lower = np.log10(np.where(here, book_count[b_at], 0) + 1) if len(book) else np.zeros(len(words))
        here = here | (words == END)
        lower[words == END] = math.log10(end_count + 1)
        context_hot = is_hot[context]
        value = np.where(back, weight[context] + np.where(here[word], lower[word], 0.0), logs)
        r_at = np.cumsum([0] + [len(p[5]) for p in parts])
        w_shard = ((mix64(words) >> np.uint64(11)).astype(np.int64)) % shards
        asked: dict[int, list] = {}
        for p, flush, a, b in zip(parts, flushes, r_at[:-1], r_at[1:]):
            text, c = p[5].astype(np.int64), count[a:b]
            rows.append(_sums(flush, text, c * base[a:b], c * known[a:b], c * value[a:b], c * back[a:b]))
            ask = np.flatnonzero(back[a:b] & (~here[word[a:b]] | context_hot[a:b])) + a
            for s in np.unique(w_shard[word[ask]]) if len(ask) else ():
                asked.setdefault(int(s), []).append((flush, ask[w_shard[word[ask]] == s], a))
        text_all = np.concatenate([p[5] for p in parts])
        for s, groups in asked.items():
            which = np.concatenate([g[1] for g in groups])
            wu, wx = np.unique(word[which], return_inverse=True)
            rows.append((s, UNSEEN, -1, _pack(
                np.array([g[0] for g in groups], np.int64), np.array([len(g[1]) for g in groups], np.uint32), _code(words[wu], book), here[wu],
                wx.astype(np.uint16 if len(wu) < 1 << 16 else np.uint32), np.where(is_hot, h_at, -1)[context[which]].astype(np.int16), text_all[which], count[which].astype(np.uint32))))
        return _rows(rows)

    return run


def _resolve(book: np.ndarray, hot_weight: np.ndarray):
    """Adds what backed-off words need from their own shard: their counts, and hot contexts' weights."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows, counts, asked = [], [], []
        for kind, blob in zip(table["kind"].to_pylist(), table["blob"]):
            (counts if kind == COUNTS else asked).append(_unpack(blob.as_py()))
        words = np.concatenate([_decode(c[0], book) for c in counts]) if counts else np.zeros(0, np.uint64)
        n = np.concatenate([c[1] for c in counts]) if counts else np.zeros(0, np.int64)
        order = np.argsort(words)
        words, n = np.append(words[order], np.uint64(0)), np.append(n[order], 0)
        sums: dict[int, list] = {}  # one row a flush, however many shards asked
        for flush, sizes, wu, here, wx, hot, text, count in asked:
            wu = _decode(wu, book)
            at = np.minimum(np.searchsorted(words[:-1], wu), len(words) - 1)
            lower = np.where(here, 0.0, np.log10(np.where(words[at] == wu, n[at], 0) + 1))[wx]
            value = count * (lower + np.where(hot >= 0, hot_weight[np.maximum(hot, 0)], 0.0))
            ends = np.cumsum(sizes)
            for f, b, size in zip(flush.tolist(), ends.tolist(), sizes.tolist()):
                part = slice(b - size, b)
                mine = np.bincount(text[part], value[part])
                there = np.unique(text[part])
                sums.setdefault(f, []).append((there, mine[there]))
        for f, found in sums.items():
            text, value = (np.concatenate(x) for x in zip(*found))
            zero = np.zeros(len(text))
            rows.append(_sums(f, text.astype(np.int64), zero, zero, value, zero))
        return _rows(rows)

    return run


def _gather(end_count: int, kind: pa.DataType):
    schema = pa.schema([("id", kind), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("base", pa.float64()), ("log", pa.float64()), ("backed", pa.int64())])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, out, sizes, base, known, sums = [], None, None, None, None, []
        for k, blob in zip(table["kind"].to_pylist(), table["blob"]):
            if k == DOCS:
                ids, out, sizes, base, known = _unpack(blob.as_py())
            else:
                sums.append(_unpack(blob.as_py()))
        n = len(ids)
        total = np.zeros((4, n))
        total[:2] = base, known
        for there, score, backed, rare, more, k in sums:  # the texts of one blob are distinct
            there, rare = np.cumsum(there, dtype=np.int64), np.cumsum(rare, dtype=np.int64)
            total[0][rare] += _floating(more, BASE_BITS)
            total[1][rare] += k
            total[2][there] += _floating(score, SCORE_BITS)
            total[3][there] += backed
        return pa.Table.from_arrays([
            pa.array(ids, kind), pa.array(out), pa.array(np.asarray(sizes, np.int64)),
            pa.array(total[1].astype(np.int64) + int(end_count > 0)), pa.array(total[0] + math.log10(end_count + 1)),
            pa.array(total[2]), pa.array(total[3].astype(np.int64))], schema=schema)

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    The model learns from all texts that are not held out. ``log10 P(w | c)`` is
    ``log10((n(c, w) - d) / n(c))``, d being DISCOUNT, where the pair was seen and otherwise the context's left-over mass
    ``d * kinds(c) / n(c)`` times the word's add-one unigram (that of ``base_score``); a context never
    seen gives way to the unigram wholly. Mass is left over for seen words too, so probabilities sum
    to at most one. Every text's first word has a begin mark as context, its end is a token.

    Every token of the corpus goes to the shard of its context, packed and counted per text, once:
    there the shard counts its pairs, builds its trie and scores the very same records. A context
    that holds more than HOT_SHARE of the tokens is dealt over shards by its words. Backed-off words
    are asked of their own shard in a second, smaller exchange. The number of shards follows the
    number of tokens; the driver sees the counts of the CODED most frequent tokens. Those are written as
    places in a table that every task has, the others as hashes, and their counts need not be asked for.

    Defined cases: null, empty and blank texts are one token, the end; rows that repeat an id or a text
    are texts of their own; null ids are learned from and scored; if nothing is to learn from, scores
    are those of an empty count; an empty table gives no rows; other columns are ignored."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       (held_out(id_col) if held is None else held).alias("held"))
    kind = pa.array([], pa.int64()).type if rows.schema["id"].dataType.typeName() in ("long", "integer", "short", "byte") else pa.string()
    rows = rows.withColumn("id", F.col("id").cast("bigint" if kind == pa.int64() else "string"))
    book, hot, tokens = _frequent(rows)
    book_count, train_tokens, texts, every = _exact_counts(rows, book)
    hot_count, every = book_count[np.searchsorted(book, hot)], every[np.searchsorted(book, hot)]
    shards = max(1, math.ceil(tokens / SHARD_TOKENS), int(spark.conf.get("spark.sql.shuffle.partitions")) if tokens > SHARD_TOKENS else 1)
    spread = np.maximum(1, np.ceil(every / max(tokens, 1) * shards * 4)).astype(np.int64)  # a quarter of a shard each
    spread = np.minimum(spread, shards)
    dealt = _deal(rows, book, book_count, hot, spread, shards).repartition(max(shards, 1), "shard")
    scored = materialize(dealt.groupBy("shard").applyInArrow(_shard_model(book, book_count, hot, hot_count, texts, shards), _ROW), "lm-shards")

    left, kinds = np.zeros(len(hot)), 0
    for r in scored.filter(F.col("kind") == HOT).select("blob").toLocalIterator():  # a few numbers per shard and hot context
        at, mass = _unpack(r["blob"])
        np.add.at(left, at, mass)
    with np.errstate(divide="ignore"):
        weight = np.where(hot_count > 0, np.log10(np.maximum(left, 1e-12) / np.maximum(hot_count, 1)), 0.0)

    def count_kinds(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(_unpack(b.as_py())[1]) for b in batch.column(0))], pa.int64())], names=["n"])

    kinds = scored.filter(F.col("kind") == COUNTS).select("blob").mapInArrow(count_kinds, "n bigint").agg(F.sum("n")).first()[0] or 0
    distinct = kinds + int(((book_count > 0) & (book != BEGIN) & (book != END)).sum()) + int(texts > 0)
    second = (scored.filter(F.col("kind").isin(COUNTS, UNSEEN)).repartition(max(shards, 1), "shard").groupBy("shard")
              .applyInArrow(_resolve(book, np.append(weight, 0.0)), _ROW))
    parts = scored.filter(F.col("kind").isin(SUMS, DOCS)).unionByName(second)
    out = parts.groupBy("flush").applyInArrow(_gather(texts, kind), f"id {'bigint' if kind == pa.int64() else 'string'}, held_out boolean, "
                                              "n_tokens bigint, n_known bigint, base double, log double, backed bigint")
    size = math.log10(train_tokens + distinct + 1)
    return out.select("id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("bigint").alias("train_tokens"),
                      (F.col("base") - F.col("n_tokens") * size).alias("base_score"),
                      (F.col("log") - F.col("backed") * size).alias("score"))
