"""MinHash near-dedup with an LSH forest: sorted signature orders, neighbours as candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunedata.llm.common import key_filter, mark_maybe, materialize, without_ids
from tunedata.llm.tokens import chunks, lowered, mix64, word_hashes
from tunedata.operators.components import connected_components
from tunedata.operators.dedup import candidates, postings

SHINGLE_WORDS = 5
#: Orders of the forest, minhashes in the key of each, and the common prefix that candidates need.
TREES, DEPTH, MIN_DEPTH = 16, 8, 4
#: Neighbours that each document meets on either side of it in each order.
REACH = 4
#: Rounds of pivots go on while at least one in so many of a round's pairs is a link.
LINKED = 10
#: Documents are linked when 100 * common shingles >= PERCENT * all shingles of the two.
PERCENT = 80
_SALTS = 32


def _shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer than k words are one shingle."""
    h, _, _, bounds = word_hashes(lowered(raw), offsets)
    weights = mix64(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    rolled = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    for j in range(k if len(rolled) else 0):
        rolled += h[j:len(h) - k + 1 + j] * weights[j]
    rolled = mix64(rolled)
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= k:
            yield np.unique(rolled[a:b - k + 1])
        elif b > a:
            yield mix64(np.array([(h[a:b] * weights[:b - a]).sum() + np.uint64(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def _signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    low = np.full(len(a), 0xFFFFFFFF, np.uint64)
    for i in range(0, len(shingles), 2048):
        low = np.minimum(low, ((shingles[i:i + 2048, None] * a + b) >> np.uint64(32)).min(axis=0))
    return low.astype(">u4").tobytes()  # big-endian, so that bytes sort like numbers


def signatures(docs: DataFrame, trees: int, depth: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """``id, n, h1, h2, sig``: size and two 64-bit digests of the shingle set, and its minhashes."""
    a = mix64(np.arange(1, trees * depth + 1, dtype=np.uint64)) | np.uint64(1)
    b = mix64(np.arange(1, trees * depth + 1, dtype=np.uint64) + np.uint64(1 << 40))

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for _, _, raw, offsets in chunks(batch.column(1)):
                for s in _shingle_sets(raw, offsets, k):
                    rows.append((len(s), int(s.sum().view(np.int64)), int(mix64(s).sum().view(np.int64)),
                                 _signature(s, a, b) if len(s) else None))
            n, h1, h2, sig = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()),
                                              pa.array(h2, pa.int64()), pa.array(sig, pa.binary())],
                                             names=["id", "n", "h1", "h2", "sig"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n bigint, h1 bigint, h2 bigint, sig binary")


def _shingles(docs: DataFrame, k: int, id_type: str) -> DataFrame:
    """``id, h1, s``: the shingle set of each row with its digest."""
    def run(batches):
        for batch in batches:
            at, values = [0], []
            for begin, end, raw, offsets in chunks(batch.column(1)):
                for s in _shingle_sets(raw, offsets, k):
                    values.append(s)
                    at.append(at[-1] + len(s))
            flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([int(s.sum().view(np.int64)) for s in values], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))], names=["id", "h1", "s"])

    return docs.select("id", "text").mapInArrow(run, f"id {id_type}, h1 bigint, s array<bigint>")


def _neighbours(ordered: DataFrame, reach: int, depth: int, min_depth: int, percent: int, edges_out: bool) -> DataFrame:
    """Pairs of rows at most ``reach`` apart in the order that agree on ``min_depth`` minhashes and
    whose sizes allow the similarity, with the region that they share. With ``edges_out`` also the first and last rows of each
    partition, whose neighbours lie in the partition beside it, and the rows of crowded regions
    (``region, n, id, near``): more than ``reach + 1`` rows that agree on ``min_depth`` or on all
    minhashes, or any number at the partition's ends. ``near`` counts the rows with the same key."""
    def run(batches):
        names = ["a", "b", "tree", "key", "n", "id", "region", "near"]
        held: pa.Table | None = None
        first = True
        #: Parts of the region that the last batch ended in, and whether it is the partition's first.
        open_run: list[tuple] = []
        leading = True
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            if edges_out:
                part = _columns(now)
                starts = np.flatnonzero(_changes(*part[:2], min_depth)) + 1
                if open_run and (open_run[-1][0][-1] != part[0][0] or (open_run[-1][1][-1, :min_depth] != part[1][0, :min_depth]).any()):
                    starts = np.concatenate([[0], starts])
                if len(starts):
                    if open_run or starts[0]:
                        yield from _crowd([*open_run, tuple(c[:starts[0]] for c in part)], leading, names)
                        leading = False
                    yield from _crowd([tuple(c[starts[0]:starts[-1]] for c in part)], leading, names)
                    open_run = [tuple(c[starts[-1]:] for c in part)]
                else:
                    open_run.append(part)
            table = pa.concat_tables([held, now]) if held is not None else now
            fresh = len(table) - len(now)
            yield from _pairs(table.combine_chunks(), fresh, names)
            if first and edges_out:
                yield from _edge(table.slice(0, reach), names)
            first = False
            held = table.slice(max(0, len(table) - reach))
        if held is not None and edges_out:
            yield from _edge(held, names)
            yield from _crowd(open_run, True, names)

    def _columns(table: pa.Table) -> tuple:
        keys = np.frombuffer(b"".join(table.column("key").to_pylist()), ">u4").reshape(len(table), depth)
        return table.column("tree").to_numpy(), keys, table.column("n").to_numpy(), table.column("id").to_numpy()

    def _changes(tree: np.ndarray, keys: np.ndarray, levels: int) -> np.ndarray:
        return (tree[1:] != tree[:-1]) | (keys[1:, :levels] != keys[:-1, :levels]).any(axis=1)

    def _crowd(parts: list[tuple], at_end: bool, names):
        tree, keys, n, ids = (np.concatenate(c) for c in zip(*parts))
        if not len(ids):
            return
        sizes = {}
        for levels in {min_depth, depth}:
            ends = np.concatenate([[0], np.flatnonzero(_changes(tree, keys, levels)) + 1, [len(ids)]])
            sizes[levels] = np.repeat(np.diff(ends), np.diff(ends))
        region = mix64(tree.astype(np.uint64) + np.uint64(1))
        for level in range(depth):
            region = mix64(region ^ keys[:, level].astype(np.uint64))
            if level + 1 not in sizes:
                continue
            at = np.flatnonzero((sizes[level + 1] > reach + 1) | at_end)
            near = sizes[depth][at] if level + 1 == min_depth else np.zeros(len(at), np.int64)
            nul = pa.nulls(len(at))
            yield pa.RecordBatch.from_arrays(
                [nul.cast(pa.int64()), nul.cast(pa.int64()), nul.cast(pa.int32()), nul.cast(pa.binary()), pa.array(n[at], pa.int64()),
                 pa.array(ids[at], pa.int64()), pa.array(region[at].view(np.int64)), pa.array(near, pa.int64())], names=names)

    def _pairs(table: pa.Table, fresh: int, names):
        n = len(table)
        tree, keys, size, ids = _columns(table)
        for lag in range(1, reach + 1):
            i = np.arange(max(0, fresh - lag), n - lag)
            if not len(i):
                continue
            j = i + lag
            small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            ok = ((tree[i] == tree[j]) & (keys[i, :min_depth] == keys[j, :min_depth]).all(axis=1)
                  & (100 * small >= percent * large) & (ids[i] != ids[j]))
            i, j = i[ok], j[ok]
            x, y = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
            nul = pa.nulls(len(i))
            region = mix64(tree[i].astype(np.uint64) + np.uint64(1))
            for level in range(min_depth):
                region = mix64(region ^ keys[i, level].astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), nul.cast(pa.int32()), nul.cast(pa.binary()),
                                              *[nul.cast(pa.int64())] * 2, pa.array(region.view(np.int64)), nul.cast(pa.int64())], names=names)

    def _edge(table: pa.Table, names):
        nul = pa.nulls(len(table)).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([nul, nul, *[table.column(c).combine_chunks() for c in ("tree", "key", "n", "id")], nul, nul], names=names)

    return ordered.select("tree", "key", "n", "id").mapInArrow(
        run, "a bigint, b bigint, tree int, key binary, n bigint, id bigint, region bigint, near bigint")


def _crowded_pairs(crowd: DataFrame, labels: DataFrame, used: DataFrame | None, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of the rows of each crowded region with its next pivot, and all pivots so far (``region, id``).

    A pivot is the row of its component with most rows around it: the one that the others of a family
    are copies of has the largest ``score``. As a score counts all orders, the regions of one family name the
    same row. A component that had none yet gives it; rows of the pivot's own component do not meet it.
    Regions of one component are finished."""
    at = materialize(crowd.join(labels, F.col("id") == F.col("node"), "left").select(
        "region", "id", "n", "score", F.coalesce("component", "id").alias("comp")), "near-regions")
    best = materialize(at.groupBy("region", "comp").agg(F.max(F.struct("score", (-F.col("id")).alias("neg"), "n")).alias("best")), "near-best")
    unmet = best
    if used is not None:
        had = used.join(labels, F.col("id") == F.col("node"), "left").select("region", F.coalesce("component", "id").alias("comp")).distinct()
        unmet = best.join(had, ["region", "comp"], "left_anti")
    several = best.groupBy("region").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("region")
    pivots = materialize(unmet.groupBy("region").agg(F.max(F.struct("best", "comp")).alias("top"))
                         .join(several, "region"), "near-pivots")
    # One row for each row of a region; a pivot that a row meets in several regions counts once.
    salted = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    met = (at.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(_SALTS)).cast("int")).join(salted, ["region", "salt"])
           .filter((F.col("top.comp") != F.col("comp")) & (
               100 * F.least("n", "top.best.n") >= percent * F.greatest("n", "top.best.n")))
           .groupBy("id").agg(F.collect_set(-F.col("top.best.neg")).alias("pivots"))
           .select("id", F.explode("pivots").alias("pivot")))
    pairs = met.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    now = pivots.select("region", (-F.col("top.best.neg")).alias("id"))
    return materialize(pairs, "near-pairs"), materialize(now if used is None else used.unionByName(now), "near-used")


def _rest(crowd: DataFrame, labels: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The exact way for what rounds leave: pairs of different components among the rows of regions that still hold
    several. A prefix filter on the full sets, so that no pair that reaches the similarity is missing."""
    at = crowd.join(labels, F.col("id") == F.col("node"), "left").select("region", "id", F.coalesce("component", "id").alias("component"))
    several = at.groupBy("region").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("region")
    left = materialize(at.join(several, "region", "left_semi").select(F.col("id").alias("doc_id"), "component").distinct(), "near-open")
    sets = full.select(F.col("id").alias("doc_id"), F.col("s").alias("sh")).join(left, "doc_id", "left_semi")
    posts = postings(materialize(sets, "near-open-sets"), percent / 100).join(left, "doc_id")
    posts = materialize(posts, "near-open-prefixes")
    pairs = candidates(posts, posts, percent / 100, F.col("component_a") < F.col("component_b"))
    return materialize(pairs.select(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b")).distinct(), "near-rest")


def near_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS,
               percent: int = PERCENT, trees: int = TREES, depth: int = DEPTH, min_depth: int = MIN_DEPTH,
               reach: int = REACH) -> tuple[DataFrame, DataFrame]:
    """``(members, links)``. ``members``: ``id, n, rep`` for each row, ``rep`` the smallest id with the
    same shingle set (null for an empty set). ``links``: ``a, b, common, similarity`` between
    representatives, verified on the full shingle sets; members of one set are not expanded into pairs.

    Each of ``trees`` orders sorts the representatives by its own ``depth`` minhashes. A document's
    candidates are its ``reach`` neighbours on either side in each order that share at least ``min_depth``
    minhashes with it, those with the longest common prefix first. The orders are dealt over the
    cluster by range, ties in hash order, so that a family may span partitions.

    Where more rows share those minhashes, neighbours alone do not tie a family together whose copies are
    like one text and not like each other. There all rows of the region also meet its pivots, the rows with
    most others around them (``_crowded_pairs``), in rounds while they find links. A round's pairs grow
    with the rows, not with their square. The rows of regions that still hold several components are then compared
    exactly (``_rest``), so that no two rows of a region that reach the similarity are left apart. Candidates are found with a
    probability only in that similar rows may share no region. ``links`` of a crowded region tie its rows
    together; of two rows that others tie, the link itself may not be listed."""
    return _links(docs, id_col, text_col, k, percent, trees, depth, min_depth, reach)[:2]


def _links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS,
           percent: int = PERCENT, trees: int = TREES, depth: int = DEPTH, min_depth: int = MIN_DEPTH,
           reach: int = REACH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``near_links`` and the components (``node, component``) of its links."""
    id_type = docs.schema[id_col].dataType.simpleString()
    sig = materialize(signatures(docs, trees, depth, k, id_col, text_col)
                      .withColumn("id", F.col("id").cast("bigint")), "minhash")
    sets = (sig.filter("n > 0").groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"))
            .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))))
    members = (sig.select("id", "n", "h1", "h2").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(_SALTS)).cast("int"))
               .join(sets.drop("n"), ["h1", "h2", "salt"], "left").select("id", "n", F.when(F.col("n") > 0, F.col("rep")).alias("rep")))
    members = materialize(members, "near-members")
    reps = members.filter("id = rep").select("id").distinct()
    # Of an id with several texts, the row with the smallest digest stands for it.
    rep_sig = (sig.join(reps, "id", "left_semi").groupBy("id").agg(F.min(F.struct("h1", "h2", "n", "sig")).alias("r"))
               .select("id", "r.h1", "r.n", "r.sig"))
    rep_sig = materialize(rep_sig, "near-signatures")
    # Its other texts tie their representatives to the first.
    same_id = (members.filter("rep is not null").groupBy("id").agg(F.collect_set("rep").alias("reps")).filter("size(reps) > 1")
               .select(F.array_min("reps").alias("a"), F.explode("reps").alias("b")).filter("a <> b"))

    forest = (rep_sig.select("id", "n", "sig", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
              .withColumn("key", F.expr(f"substring(sig, tree * {depth * 4} + 1, {depth * 4})")).drop("sig")
              .withColumn("tie", F.xxhash64("id", "tree")))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = forest.repartitionByRange(parts, "tree", "key", "tie").sortWithinPartitions("tree", "key", "tie")
    found = materialize(_neighbours(ordered, reach, depth, min_depth, percent, True), "near-candidates")
    # A few rows per partition: neighbours across the partitions' edges.
    seams = (found.filter("key is not null").select("tree", "key", "n", "id").distinct().withColumn("tie", F.xxhash64("id", "tree"))
             .repartition(1).sortWithinPartitions("tree", "key", "tie"))
    crowd = found.filter("region is not null and a is null").select("region", "id", "n", "near")
    # Neighbours of a crowded region are left to its pivots and the exact rest, which together compare whole regions.
    dense = materialize(crowd.select(F.col("region").alias("dense")).distinct(), "near-dense")
    pairs = (found.filter("a is not null").select("a", "b", "region")
             .unionByName(_neighbours(seams, reach, depth, min_depth, percent, False).select("a", "b", "region")))
    pairs = (pairs.join(dense, F.col("region") == F.col("dense"), "left").groupBy("a", "b").agg(F.max("dense").alias("dense"))
             .filter("dense is null").select("a", "b"))
    pairs = materialize(pairs, "near-pairs")

    # Rows that share all minhashes of an order with it, over all orders: about how many are like a row.
    scores = crowd.groupBy("id").agg(F.sum("near").alias("score"))
    crowd = materialize(crowd.join(scores, "id").select("region", "id", "n", "score"), "near-crowd")

    # The shingle sets of all rows that any round may compare: the texts are read once more, not once a round.
    wanted = (pairs.select(F.col("a").alias("w")).unionByName(pairs.select(F.col("b").alias("w")))
              .unionByName(crowd.select(F.col("id").alias("w"))).distinct())
    wanted = materialize(wanted.join(rep_sig.select(F.col("id").alias("w"), F.col("h1").alias("wh")), "w"), "near-wanted")
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    texts = mark_maybe(texts, F.xxhash64("id"), key_filter(wanted, F.xxhash64("w")), "_maybe").filter("_maybe")
    full = (_shingles(texts, k, "bigint").join(wanted, (F.col("id") == F.col("w")) & (F.col("h1") == F.col("wh")), "left_semi")
            .dropDuplicates(["id"]).select("id", "s"))
    full = materialize(full, "near-shingles")

    def verified(pairs: DataFrame) -> DataFrame:
        both = (pairs.join(full.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
                .join(full.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b"))
        links = (both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("common"))
                 .filter(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common")))
                 .select("a", "b", "common", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("similarity")))
        return materialize(links, "near-links")

    def tied(labels: DataFrame, more: DataFrame) -> DataFrame:
        return connected_components(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
                                    .unionByName(more.select("a", "b")), "a", "b")

    links = verified(pairs)
    labels = connected_components(links.select("a", "b").unionByName(same_id), "a", "b")
    # A pivot a region ties most of a family together; what is left meets another, while that finds links enough.
    used, rounds = None, True
    while True:
        if rounds:
            pairs, used = _crowded_pairs(crowd, labels, used, percent)
        else:
            pairs = _rest(crowd, labels, full, percent)
        met = pairs.count()
        found_now = 0
        if met:
            more = verified(pairs)
            found_now = more.count()
        if found_now:
            links = links.unionByName(more)
            labels = connected_components(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
                                          .unionByName(more.select("a", "b")), "a", "b")
        if not rounds:
            break
        rounds = found_now * LINKED >= met > 0
    return members, links, labels


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: ``id, n_shingles, component_id, kept``.

    ``component_id`` is the smallest id reachable over links (itself included); the row that has it is kept.

    Defined cases: null, empty and blank texts have no shingles, are linked with nothing and kept; a
    text of fewer words than a shingle is one shingle; texts of any length are read whole; rows that repeat an id
    are one document and labelled alike: the row with the smallest digest is compared, and rows equal
    to its other texts are linked with it; rows with a null id keep a null component and
    are kept; an empty table gives no rows; other columns are ignored. Ids are integers."""
    members, _, labels = _links(docs, id_col, text_col, **options)
    labels = labels.select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    comp = F.coalesce("comp", "rep", "id")
    return members.join(labels, "rep", "left").select(
        "id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.col("id").eqNullSafe(comp).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs``, all columns, with one document of each component left (the one with the smallest id)."""
    gone = materialize(near_components(docs, id_col, text_col, **options).filter("not kept").select(
        F.col("id").alias(id_col)), "near-gone")
    return without_ids(docs, gone, id_col)
