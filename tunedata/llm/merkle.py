"""Merkle manifest of a table whose parents keep the SHA-256 states that they had before each child.

A parent's digest is the hash of its children's digests as hex text. Beside it the manifest keeps the
state of that hash before each child slot (before the first it is the constant start). A changed
child is folded in by resuming the state of its slot with the new digest and the siblings to its
right; what is to its left is in the state already.

Nodes are kept in pages: ``fanout ** height`` consecutive nodes of a level with all levels above them, up
to one top. A page's top is one node of the next band of pages, so a table of n rows has about
n / 1024 pages in the first band and a handful of bands whatever n."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunedata.llm import midstate as ms
from tunedata.llm.common import materialize

FANOUT = 2
#: Nodes of a page's lowest level, at most.
PAGE_NODES = 1024
LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PAGE = "tree string, page bigint, size bigint, m int, steps int, digests binary, states binary, top binary"
_PATH = "tree string, page bigint, subroot binary, up_states array<binary>, up_left array<binary>, up_right array<binary>"


def levels_of(size: int, fanout: int) -> int:
    """Levels above the leaves of a tree: how often runs are hashed until one node remains."""
    steps = 0
    while size > 1:
        size, steps = -(-size // fanout), steps + 1
    return steps


def page_height(fanout: int) -> int:
    height = 1
    while fanout ** (height + 1) <= PAGE_NODES:
        height += 1
    return height


# -- one page, in numpy ---------------------------------------------------------------------------

def climb(digests: np.ndarray, steps: int, fanout: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Digests of each level, the lowest first and the top last, and for each level the states
    ``uint32[fanout, 8, parents]`` that its parents had before each child slot."""
    levels, kept = [digests], []
    for _ in range(steps):
        nodes = levels[-1]
        parents = -(-len(nodes) // fanout)
        blocks = ms.hex_blocks(nodes)
        state, before = ms.start(parents), []
        for slot in range(fanout):
            before.append(state.copy())
            present = len(range(slot, len(nodes), fanout))
            if present:
                state[:, :present] = ms.absorb(state[:, :present], blocks[slot::fanout])
        above = ms.finish(state, fanout)
        last = len(nodes) - (parents - 1) * fanout
        if last < fanout:
            above[-1:] = ms.finish(state[:, -1:], last)
        levels.append(above)
        kept.append(np.stack(before))
    return levels, kept


def _pack_page(levels: list[np.ndarray], kept: list[np.ndarray]) -> tuple[bytes, bytes, bytes]:
    """Digests below the top, states of the slots after the first (that one's is the constant start), top."""
    return (b"".join(x.tobytes() for x in levels[:-1]),
            b"".join(ms.pack(k[slot]) for k in kept for slot in range(1, len(k))), levels[-1].tobytes())


def _unpack_page(m: int, steps: int, digests: bytes, states: bytes, fanout: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    levels, kept, at, seen, n = [], [], 0, 0, m
    for _ in range(steps):
        parents = -(-n // fanout)
        levels.append(np.frombuffer(digests[at:at + 32 * n], np.uint8).reshape(-1, 32))
        slots = [ms.start(parents)]
        for _slot in range(1, fanout):
            slots.append(ms.unpack(states[seen:seen + 32 * parents]))
            seen += 32 * parents
        kept.append(np.stack(slots))
        at, n = at + 32 * n, parents
    return levels, kept


def resume(now: np.ndarray, index: np.ndarray, levels: list[np.ndarray], kept: list[np.ndarray], fanout: int) -> np.ndarray:
    """Tops of a page after node ``index[i]`` of its lowest level became ``now[i]``, each on its own."""
    for nodes, states in zip(levels, kept):
        parent, slot = index // fanout, index % fanout
        blocks, children = ms.hex_blocks(nodes), np.minimum(len(nodes) - parent * fanout, fanout)
        state = ms.absorb(states[slot, :, parent].T, ms.hex_blocks(now))
        for s in range(1, fanout):  # siblings to the right of the changed child only
            rest = np.flatnonzero((slot < s) & (s < children))
            if len(rest):
                state[:, rest] = ms.absorb(state[:, rest], blocks[parent[rest] * fanout + s])
        now = np.empty_like(now)
        for n in np.unique(children):
            some = children == n
            now[some] = ms.finish(state[:, some], int(n))
        index = parent
    return now


def resume_path(now: np.ndarray, states: list[bytes], left: list[bytes], right: list[bytes]) -> np.ndarray:
    """``now`` folded up a path that all its rows share."""
    for state, before, after in zip(states, left, right):
        run = ms.absorb(np.repeat(ms.unpack(state), len(now), axis=1), ms.hex_blocks(now))
        rest = ms.hex_blocks(np.frombuffer(after, np.uint8).reshape(-1, 32))
        for block in rest:
            run = ms.absorb(run, block[None, :])
        now = ms.finish(run, len(before) // 32 + 1 + len(rest))
    return now


def _siblings(index: int, nodes: np.ndarray, fanout: int) -> tuple[bytes, bytes]:
    first = index - index % fanout
    return nodes[first:index].tobytes(), nodes[index + 1:first + fanout].tobytes()


# -- tables ---------------------------------------------------------------------------------------

def field_text(col: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field_text(c) for c in fields]), 256))


def number_within(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` (with a column ``tree``, without nulls) in the shared folder, with ``pos``, the place of a
    row in its tree by ``order``, and ``size``, the rows of the tree.

    Rows are dealt by range over (tree, order), and a row's place within its range is fixed by the table
    written; counts per range and tree, at most ranges plus trees, give the offsets. No window covers a
    tree, however large."""
    dealt = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    dealt = materialize(dealt.withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33)
    counts = dealt.groupBy("tree", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    counts = counts.groupBy("tree").agg(F.sum("n").alias("size"), F.sort_array(F.collect_list(F.struct("part", "n", "first"))).alias("parts"))
    # A tree's ranges, at most as many as partitions, in order with what lies before each.
    offsets = counts.select("tree", "size", F.posexplode("parts").alias("i", "p"), "parts").select(
        "tree", "size", F.col("p.part").alias("part"),
        (F.aggregate(F.slice("parts", 1, F.col("i")), F.lit(0).cast("bigint"), lambda s, x: s + x["n"]) - F.col("p.first")).alias("shift"))
    return (dealt.withColumn("part", part).join(offsets, ["tree", "part"])
            .withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift"))


def _pages(nodes: DataFrame, fanout: int, name: str) -> DataFrame:
    """One row per page of ``nodes (tree, pos, size, digest)``; written, as later steps read it twice."""
    height = page_height(fanout)
    width = fanout ** height

    def build(group: pa.Table) -> pa.Table:
        rows = group.sort_by("pos")
        size, pos = rows["size"][0].as_py(), rows["pos"][0].as_py()
        steps = min(height, levels_of(size, fanout))
        digests = np.frombuffer(b"".join(rows["digest"].to_pylist()), np.uint8).reshape(-1, 32)
        levels, kept = climb(digests, steps, fanout)
        below, states, top = _pack_page(levels, kept)
        one = lambda v, t: pa.array([v], t)
        return pa.table({"tree": one(rows["tree"][0].as_py(), pa.string()), "page": one(pos // width, pa.int64()),
                         "size": one(size, pa.int64()), "m": one(len(digests), pa.int32()), "steps": one(steps, pa.int32()),
                         "digests": one(below, pa.binary()), "states": one(states, pa.binary()), "top": one(top, pa.binary())})

    grouped = nodes.select("tree", F.floor(F.col("pos") / width).cast("bigint").alias("page"), "pos", "size", "digest")
    return materialize(grouped.groupBy("tree", "page").applyInArrow(build, _PAGE), name)


def _bands(nodes: DataFrame, fanout: int, name: str) -> list[DataFrame]:
    """Page tables from the leaves up to one page per tree. Their number follows from the largest tree."""
    width = fanout ** page_height(fanout)
    largest = nodes.agg(F.max("size").alias("n")).first()["n"] or 0
    bands = []
    while True:
        bands.append(_pages(nodes, fanout, f"{name}-{len(bands)}"))
        if largest <= width:
            return bands
        largest = -(-largest // width)
        nodes = bands[-1].select("tree", F.col("page").alias("pos"), F.ceil(F.col("size") / width).cast("bigint").alias("size"),
                                 F.col("top").alias("digest"))


def _child_paths(pages: DataFrame, paths: DataFrame, fanout: int) -> DataFrame:
    """Paths of the nodes below ``pages``, from the paths of those pages: for each level a state before
    the node's slot and its siblings on either side. ``page`` is the node's place in its level."""
    width = fanout ** page_height(fanout)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tree", "page", "subroot", "up_states", "up_left", "up_right"]
        types = [pa.string(), pa.int64(), pa.binary(), *[pa.list_(pa.binary())] * 3]
        for batch in batches:
            for row in batch.to_pylist():
                levels, kept = _unpack_page(row["m"], row["steps"], row["digests"], row["states"], fanout)
                out = [[] for _ in names]
                for j in range(row["m"]):
                    states, left, right, index = [], [], [], j
                    for nodes, slots in zip(levels, kept):
                        states.append(ms.pack(slots[index % fanout][:, index // fanout][:, None]))
                        before, after = _siblings(index, nodes, fanout)
                        left.append(before)
                        right.append(after)
                        index //= fanout
                    for col, v in zip(out, (row["tree"], row["page"] * width + j, row["subroot"], states + row["up_states"],
                                            left + row["up_left"], right + row["up_right"])):
                        col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    return pages.join(paths, ["tree", "page"]).mapInArrow(walk, _PATH)


@dataclass(frozen=True)
class Manifest:
    """``leaves (tree, pos, size, digest, ...)``; ``bands``: page tables of each tree from the leaves up;
    ``paths``: for each lowest page its tree's ``subroot`` and the steps from its top to the root;
    ``root``: 32 bytes, None of an empty table."""

    leaves: DataFrame
    bands: list[DataFrame]
    paths: DataFrame
    root: bytes | None
    fanout: int


def build_manifest(docs: DataFrame, fields: tuple[str, ...] = LEAF_FIELDS, tree_col: str = "lang", id_col: str = "doc_id",
                   changed: dict[str, Column] | None = None, when: Column | None = None, fanout: int = FANOUT) -> Manifest:
    """Manifest of ``docs``: a leaf per row, a tree per value of ``tree_col``, and a tree over their roots.

    Leaves ascend by ``id_col``; trees by ``tree_col``, bytewise, null first. Every ``fanout`` consecutive nodes become
    their hash, a shorter last run too, while a level has several nodes. With ``changed`` the leaves also
    get ``replacement``, the digest that a row has with these columns in place of its own, where ``when`` holds.

    Texts are hashed by the scan, natively; the shuffle by range moves ids and 32-byte digests.

    Defined cases: a null field is hashed as ``-``; empty and long texts are hashed whole; null ids come
    first in their tree; rows that repeat an id are leaves of their own, in the order of their digests
    (equal rows are interchangeable); an empty table has no leaves and the root None; other columns are
    ignored, whatever their names."""
    own = [F.col(f) for f in fields]
    other = [(changed or {}).get(f, F.col(f)) for f in fields]
    replacement = F.when(F.lit(True) if when is None else when, leaf_digest(other)) if changed else F.lit(None).cast("binary")
    tree = F.col(tree_col).cast("string")
    rows = docs.select(F.coalesce(F.concat(F.lit("="), tree), F.lit("")).alias("tree"), F.col(id_col).alias("id"),
                       leaf_digest(own).alias("digest"), replacement.alias("replacement"))
    leaves = number_within(rows, ["id", "digest"], "merkle-leaves")
    bands = _bands(leaves, fanout, "merkle-pages")
    roots = bands[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("digest"))
    forest = number_within(roots, ["name"], "merkle-roots")
    above = _bands(forest, fanout, "merkle-forest")
    top = above[-1].select("top").first()

    none = F.array().cast("array<binary>")
    paths = above[-1].select("tree", "page", "top", none.alias("up_states"), none.alias("up_left"), none.alias("up_right"))
    paths = paths.withColumnRenamed("top", "subroot")
    for band in reversed(above):
        paths = _child_paths(band, paths, fanout)
    paths = (forest.select(F.col("pos").alias("page"), F.col("name"), F.col("digest").alias("subroot"))
             .join(paths.drop("tree", "subroot"), "page")
             .select(F.col("name").alias("tree"), F.lit(0).cast("bigint").alias("page"), "subroot", "up_states", "up_left", "up_right"))
    for band in reversed(bands[1:]):
        paths = _child_paths(band, paths, fanout)
    return Manifest(leaves, bands, paths, bytes(top["top"]) if top else None, fanout)


def check_leaves(manifest: Manifest) -> DataFrame:
    """One row per leaf: ``id, leaf, subroot, root, proof_sha256, folded_root, verified``, digests as hex.

    ``proof_sha256`` is the hash of the leaf's siblings, level by level up to the root, left to right;
    ``folded_root`` is the root that the states of the leaf's path give when resumed with its ``replacement``
    (without one, with the leaf itself). Leaves meet their page in one group of at most ``PAGE_NODES``."""
    fanout, root = manifest.fanout, manifest.root
    width = fanout ** page_height(fanout)
    id_type = dict(manifest.leaves.dtypes)["id"]
    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def fold(rows: pa.Table, page: pa.Table) -> pa.Table:
        p = page.to_pylist()[0]
        levels, kept = _unpack_page(p["m"], p["steps"], p["digests"], p["states"], fanout)
        index = rows["pos"].to_numpy() - p["page"] * width
        leaf = rows["digest"].to_pylist()
        now = [new or old for new, old in zip(rows["replacement"].to_pylist(), leaf)]
        now = np.frombuffer(b"".join(now), np.uint8).reshape(-1, 32)
        folded = resume(now, index, levels, kept, fanout)
        folded = resume_path(folded, p["up_states"], p["up_left"], p["up_right"])
        above = b"".join(x for pair in zip(p["up_left"], p["up_right"]) for x in pair).hex().encode()
        proofs = []
        for at in index.tolist():
            h = hashlib.sha256()
            for nodes in levels:
                before, after = _siblings(at, nodes, fanout)
                h.update((before + after).hex().encode())
                at //= fanout
            h.update(above)
            proofs.append(h.hexdigest())
        folded = [x.tobytes() for x in folded]
        n = len(leaf)
        return pa.table([rows["id"], pa.array([x.hex() for x in leaf]), pa.array([p["subroot"].hex()] * n), pa.array([root.hex()] * n),
                         pa.array(proofs), pa.array([x.hex() for x in folded]), pa.array([x == root for x in folded])], names=names)

    rows = manifest.leaves.select("tree", F.floor(F.col("pos") / width).cast("bigint").alias("page"), "pos", "id", "digest", "replacement")
    pages = manifest.bands[0].select("tree", "page", "m", "steps", "digests", "states").join(manifest.paths, ["tree", "page"])
    keys = ("tree", "page")
    return rows.groupBy(*keys).cogroup(pages.groupBy(*keys)).applyInArrow(
        fold, f"id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
