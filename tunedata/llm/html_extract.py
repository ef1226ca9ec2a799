"""HTML extraction: text blocks by page structure, site boilerplate by suffix arrays over the hosts'
token streams, their counts added up for each host."""

from __future__ import annotations

import hashlib
import html as entities
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunedata.llm.common import filter_words, key_filter, mark_maybe, materialize, maybe_keys
from tunedata.llm.tokens import mix64
from tunedata.llm.url_filter import url_host

#: Elements whose content is never text of the page.
SKIPPED = frozenset("script style noscript template svg math head title iframe object canvas select option "
                    "datalist textarea button form fieldset nav header footer aside menu dialog audio video map".split())
#: Of these, the ones that hold raw text: markup in them is no markup.
RAW = frozenset("script style title textarea iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that do not end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
#: An open element of the left kind ends where one of the right kinds begins.
CLOSED_BY = {"p": frozenset("p div ul ol dl table section article aside header footer nav main h1 h2 h3 h4 h5 h6 "
                            "blockquote pre form figure hr fieldset address details".split()),
             "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
             "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
             "option": frozenset(["option"])}
MAIN = frozenset(["article", "main"])
#: Words in class, id or role that mark menus, banners, notices, adverts, forms and comments.
BOILER_WORDS = frozenset("""ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs captcha comment comments
    consent cookie cookies copyright disclaimer disqus feedback footer gdpr header login menu modal nav navbar navigation newsletter
    notice notices notification overlay pagination pager popup promo promoted promotion related recommended reply replies respond
    search share sharing sidebar signup social sponsor sponsored subscribe subscription tags toolbar toc widget complementary
    contentinfo navigation dialog alert alertdialog reactions discussion responses hidden paywall""".split())
LAYOUT_WORDS = frozenset("has have with without no not is".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s>]+))?""")
_WORD = re.compile(r"[a-z]+")
_BLANKS = re.compile(r"\s+")
_BREAKS = frozenset(["br"])

#: A run has this many tokens of one block, or is a whole block of fewer but MIN_BLOCK. It is boilerplate of its host
#: where it stands on MIN_PAGES different pages.
MIN_RUN, MIN_BLOCK = 10, 4
MIN_PAGES = 3
#: In ``article`` and ``main`` it must also stand on this share of the host's different articles.
MAIN_PERCENT = 50
#: Token budget of one suffix array. Its counts are added to those of the others, so that it decides nothing.
GROUP_TOKENS = 1 << 19
#: Articles of a host lie thick where about this many of them meet in one array without being moved. Others, and copies, are
#: dealt by host and, from DEALT articles on, by buckets of about so many. Both decide what moves, not what counts.
THICK, DEALT = 12, 256


def _boilerplate(name: str, attrs: str) -> bool:
    if name in SKIPPED:
        return True
    if not attrs or name in ("body", "html") or name in MAIN and "role" not in attrs:
        return False
    for key, value in _ATTR.findall(attrs):
        key = key.lower()
        if key in ("class", "id", "role"):
            for token in value.strip("\"'").lower().split():
                words = _WORD.findall(token)
                # "with-sidebar" or "no-ads" tells of the layout around, not of the element.
                if words and words[0] not in LAYOUT_WORDS and BOILER_WORDS.intersection(words):
                    return True
        if key == "hidden" or key == "aria-hidden" and "true" in value.lower() or (
                key == "style" and "display:none" in value.lower().replace(" ", "")):
            return True
    return False


def page_blocks(page: str) -> list[tuple[str, bool, bool]]:
    """``(text, in main content, in boilerplate)`` of each block in page order: character references
    decoded, white space one space, trimmed, empty blocks left out. Missing end tags are fine."""
    blocks: list[tuple[str, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # name, in main content, in boilerplate
    buffer: list[str] = []
    main = boiler = False
    at, size = 0, len(page)

    def flush():
        if buffer:
            text = _BLANKS.sub(" ", entities.unescape("".join(buffer))).strip()
            if text:
                blocks.append((text, main, boiler))
            buffer.clear()

    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            buffer.append(page[at:])
            break
        if m.start() > at:
            buffer.append(page[at:m.start()])
        at = m.end()
        if m[1] is not None:
            buffer.append(m[1])
            continue
        if m[3] is None:
            continue
        name = m[3].lower()
        if name in INLINE and not (m[4] and not m[2] and _boilerplate(name, m[4])):
            if not m[2] or not any(x[0] == name for x in stack):
                continue
        if name in _BREAKS:
            buffer.append(" ")
            continue
        flush()
        if name in VOID:
            continue
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            main, boiler = stack[-1][1:] if stack else (False, False)
            continue
        while stack and name in CLOSED_BY.get(stack[-1][0], ()):
            stack.pop()
        main, boiler = stack[-1][1:] if stack else (False, False)
        if m[4].rstrip().endswith("/") and name in ("svg", "math"):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        main, boiler = main or name in MAIN, boiler or _is_boiler(name, m[4], main)
        stack.append((name, main, boiler))
    flush()
    return blocks


def _is_boiler(name: str, attrs: str, in_main: bool) -> bool:
    """A header inside the article holds its title, so it counts as content there."""
    if in_main:
        return _boilerplate("div" if name == "header" else name, re.sub(r"(?i)header", "", attrs))
    return _boilerplate(name, attrs)


def run_starts(tokens: np.ndarray, min_run: int) -> np.ndarray:
    """The places from which ``min_run`` tokens lie in one block."""
    last = len(tokens) - min_run + 1
    if last < 1:
        return np.zeros(0, np.int64)
    sep = np.cumsum(tokens < 0)
    return np.flatnonzero((sep[min_run - 1:] == sep[:last]) & (tokens[:last] >= 0))


def run_classes(tokens: np.ndarray, min_run: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of ``min_run`` tokens of one block begin, and the number of each one's class: equal runs are
    neighbours, by place.

    ``tokens`` are ids of 0 or more, with -1 between blocks. The suffix array is sorted by prefix
    doubling up to ``min_run`` tokens, all that the question needs; suffixes that agree on that many
    tokens are neighbours in it."""
    n = len(tokens)
    if n < min_run:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = np.asarray(tokens, np.int64) + 1
    if rank.max() > n:  # so that two ranks fit into one key
        rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    length = 1
    while length < min_run:
        step = min(length, min_run - length)  # overlapping halves at the last step
        ahead = np.full(n, -1, np.int64)
        ahead[:n - step] = rank[step:]
        key = rank * (n + 2) + ahead + 1
        order = np.argsort(key)
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        length += step
    suffix = np.argsort(rank, kind="stable")
    inside = np.zeros(n, bool)
    inside[run_starts(tokens, min_run)] = True
    suffix = suffix[inside[suffix]]
    return suffix, rank[suffix]


def page_ranks(cls: np.ndarray, page: np.ndarray) -> np.ndarray:
    """For each run of ``run_classes`` with its page, the number of its page in the class from 0, or -1 where the
    class had that page before. Positions are in page order."""
    if not len(cls):
        return np.zeros(0, np.int64)
    start = np.concatenate([[True], cls[1:] != cls[:-1]])
    first = start | np.concatenate([[True], page[1:] != page[:-1]])
    seen = np.cumsum(first)
    rank = seen - np.maximum.accumulate(np.where(start, seen, 0))
    return np.where(first, rank, -1)


def run_cover(n: int, starts: np.ndarray, min_run: int) -> np.ndarray:
    """Which of ``n`` tokens lie in a run that begins at one of ``starts``."""
    edge = np.zeros(n + min_run + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + min_run, -1)
    return np.cumsum(edge[:n]) > 0


def repeated_cover(tokens: np.ndarray, page: np.ndarray, min_run: int = MIN_RUN, min_pages: int = MIN_PAGES) -> np.ndarray:
    """Which tokens lie in a run of ``min_run`` tokens that ``min_pages`` distinct pages of one array share."""
    suffix, cls = run_classes(tokens, min_run)
    pages = np.zeros(int(cls.max()) + 1 if len(cls) else 0, np.int64)
    np.maximum.at(pages, cls, page_ranks(cls, page[suffix]) + 1)
    return run_cover(len(tokens), suffix[pages[cls] >= min_pages], min_run)


class _Stream:
    """Token ids of blocks, one array for all, with -1 between them, and 64-bit hashes of the words of each host."""

    def __init__(self, min_run: int, min_block: int):
        self.min_run, self.min_block = min_run, min_block
        self.vocabulary: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(number.__next__))
        self.tokens: list[int] = []
        self.weights = mix64(np.arange(1, min_run + 1, dtype=np.uint64)) | np.uint64(1)
        number = itertools.count()

    def add(self, host: str, block: str) -> tuple[int, int]:
        """The begin and end of the block's words. A short block is filled up to one run, which is the whole block."""
        words = block.split(" ")
        begin = len(self.tokens)
        fill = self.min_run - len(words) if self.min_block <= len(words) < self.min_run else 0
        self.tokens.extend(map(self.vocabulary[host].__getitem__, words + [""] * fill))
        self.tokens.append(-1)
        return begin, begin + len(words)

    def hashes(self, starts: np.ndarray) -> np.ndarray:
        """The hash of each run that begins at one of ``starts``, which is the same for all arrays of a host."""
        tokens = np.array(self.tokens, np.int64)
        size = sum(len(ids) for ids in self.vocabulary.values())
        used = np.zeros(size, bool)
        for j in range(self.min_run if len(starts) else 0):
            used[tokens[starts + j]] = True
        wanted, digests = used.tolist(), [bytes(8)] * size
        for h, ids in self.vocabulary.items():
            for w, i in ids.items():
                if wanted[i]:
                    digests[i] = hashlib.blake2b(f"{h}\n{w}".encode(), digest_size=8).digest()
        words = np.frombuffer(b"".join(digests), "<u8")
        hashed = np.zeros(len(starts), np.uint64)
        for j in range(self.min_run if len(starts) else 0):
            hashed += words[tokens[starts + j]] * self.weights[j]
        return mix64(hashed).view(np.int64)

    def starts(self) -> np.ndarray:
        """Where runs begin."""
        return run_starts(np.array(self.tokens, np.int64), self.min_run)

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """Where runs begin, and their classes."""
        return run_classes(np.array(self.tokens, np.int64), self.min_run)


def _parsed(pages: DataFrame, id_type: str) -> DataFrame:
    """``id, url, host, page, marked, words, blocks``: of pages that mark their content the blocks in there, of others the blocks
    outside boilerplate; ``words`` is their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [page_blocks(page) for page in batch.column("html").to_pylist()]
            marked = [any(main and not boiler for _, main, boiler in blocks) for blocks in found]
            kept = [[t for t, main, boiler in blocks if not boiler and main >= m] for blocks, m in zip(found, marked)]
            words = [sum(t.count(" ") + 1 for t in blocks) for blocks in kept]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "url", "host", "page")], pa.array(marked, pa.bool_()),
                                              pa.array(words, pa.int64()), pa.array(kept, pa.list_(pa.string()))],
                                             names=["id", "url", "host", "page", "marked", "words", "blocks"])

    return pages.mapInArrow(run, f"id {id_type}, url string, host string, page bigint, marked boolean, words bigint, blocks array<string>")


def _host_runs(pages: DataFrame, min_run: int, min_block: int, min_pages: int, group_tokens: int) -> DataFrame:
    """``run, page``: the runs of all blocks of the pages. A suffix array gives at most ``min_pages`` different pages of a
    run, since more than that many are never asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            starts, cls = stream.classes()
            rank = page_ranks(cls, np.array(owner, np.int64)[starts])
            starts = starts[(rank >= 0) & (rank < min_pages)]
            at = np.array(owner, np.int64)[starts]
            return pa.RecordBatch.from_arrays([pa.array(stream.hashes(starts)), pa.array(np.array(numbers, np.int64)[at])], names=["run", "page"])

        stream, owner, numbers, seen = _Stream(min_run, min_block), [], [], set()
        for batch in batches:
            for host, page, text in zip(*[batch.column(c).to_pylist() for c in ("host", "page", "html")]):
                if page in seen:  # a copy of a page is no other page
                    continue
                seen.add(page)
                for block, _, _ in page_blocks(text):
                    stream.add(host, block)
                owner.extend([len(numbers)] * (len(stream.tokens) - len(owner)))
                numbers.append(page)
                if len(stream.tokens) >= group_tokens:
                    yield done()
                    stream, owner, numbers, seen = _Stream(min_run, min_block), [], [], set()
        if stream.tokens:
            yield done()

    return pages.mapInArrow(run, "run bigint, page bigint")


def _frequent_runs(rows: DataFrame, min_run: int, min_block: int, percent: int, group_tokens: int) -> DataFrame:
    """``run, site``: of ``site, host, page, blocks``, copies side by side, the runs that may stand on ``percent`` of a host's
    different articles. Each article is in one array, so what reaches the share over all of them reaches it in one array at least."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            starts, cls = stream.classes()
            page = np.array(owner, np.int64)[starts]
            rank = page_ranks(cls, page)
            having = np.bincount(cls[rank >= 0], minlength=len(stream.tokens))[cls]
            articles = np.unique(np.array(sites, np.int64), return_inverse=True, return_counts=True)
            at = (rank == 0) & (100 * having >= percent * articles[2][articles[1]][page])
            return pa.RecordBatch.from_arrays([pa.array(stream.hashes(starts[at])), pa.array(np.array(sites, np.int64)[page[at]])],
                                              names=["run", "site"])

        stream, owner, sites, before = _Stream(min_run, min_block), [], [], None
        for batch in batches:
            for site, host, page, blocks in zip(*[batch.column(c).to_pylist() for c in ("site", "host", "page", "blocks")]):
                if page == before:
                    continue
                before = page
                for block in blocks:
                    stream.add(host, block)
                owner.extend([len(sites)] * (len(stream.tokens) - len(owner)))
                sites.append(site)
                if len(stream.tokens) >= group_tokens:
                    yield done()
                    stream, owner, sites = _Stream(min_run, min_block), [], []
        if stream.tokens:
            yield done()

    return rows.select("site", "host", "page", "blocks").mapInArrow(run, "run bigint, site bigint")


def _page_runs(rows: DataFrame, min_run: int, min_block: int, group_tokens: int, wanted: DataFrame) -> DataFrame:
    """``page, run``: the runs of each page's ``blocks`` that pass the key filter ``wanted``."""
    found = filter_words(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            starts = stream.starts()
            hashed = stream.hashes(starts)
            maybe = maybe_keys(hashed, found)
            page, hashed = np.array(owner, np.int64)[starts[maybe]], hashed[maybe]
            order = np.lexsort((hashed, page))
            page, hashed = page[order], hashed[order]
            new = np.concatenate([[True], (page[1:] != page[:-1]) | (hashed[1:] != hashed[:-1])])[:len(page)]
            return pa.RecordBatch.from_arrays([pa.array(page[new]), pa.array(hashed[new])], names=["page", "run"])

        stream, owner = _Stream(min_run, min_block), []
        for batch in batches:
            for host, page, blocks in zip(*[batch.column(c).to_pylist() for c in ("host", "page", "blocks")]):
                for block in blocks:
                    stream.add(host, block)
                owner.extend([page] * (len(stream.tokens) - len(owner)))
                if len(stream.tokens) >= group_tokens:
                    yield done()
                    stream, owner = _Stream(min_run, min_block), []
        if stream.tokens:
            yield done()

    return rows.select("host", "page", "blocks").mapInArrow(run, "page bigint, run bigint")


def _without_runs(rows: DataFrame, id_type: str, min_run: int, min_block: int) -> DataFrame:
    """``id, url, text`` of ``id, url, host, marked, blocks, runs``: the words of the blocks outside those runs. An article
    of nothing else repeats others and keeps them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for host, marked, blocks, runs in zip(*[batch.column(c).to_pylist() for c in ("host", "marked", "blocks", "runs")]):
                if not runs:
                    texts.append(" ".join(blocks))
                    continue
                stream = _Stream(min_run, min_block)
                at = [stream.add(host, block) for block in blocks]
                starts = stream.starts()
                cover = run_cover(len(stream.tokens), starts[np.isin(stream.hashes(starts), runs)], min_run)
                left = [" ".join(w for w, c in zip(block.split(" "), cover[b:e]) if not c) for block, (b, e) in zip(blocks, at)]
                text = " ".join(t for t in left if t)
                texts.append(text if text or not marked else " ".join(blocks))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], names=["id", "url", "text"])

    return rows.mapInArrow(run, f"id {id_type}, url string, text string")


def _article_runs(marked: DataFrame, min_run: int, min_block: int, min_pages: int, percent: int, group_tokens: int) -> DataFrame:
    """``page, run``: of pages that mark their content, the runs on ``min_pages`` different articles of the host and ``percent`` of them.

    All articles go through suffix arrays, those of hosts with many articles where they lie; the runs that reach the share in one
    array are counted over the whole host, so that only they are shuffled."""
    marked = marked.withColumn("site", F.xxhash64("host"))
    articles = marked.groupBy("site", "page").count()
    sites = articles.groupBy("site").agg(F.count(F.lit(1)).alias("articles")).filter(F.col("articles") >= min_pages)
    rows = mark_maybe(marked, F.col("site"), key_filter(sites, F.col("site")), "_maybe").filter("_maybe").drop("_maybe")
    # One row for DEALT articles at most.
    large = F.broadcast(sites.filter(F.col("articles") >= DEALT))
    placed = (mark_maybe(rows, F.col("page"), key_filter(articles.filter("count > 1"), F.col("page")), "copied")
              .join(large, "site", "left").crossJoin(F.broadcast(marked.agg(F.sum("words").alias("all_words"))))
              .withColumn("stays", F.expr(f"not copied and coalesce(articles * {group_tokens} >= {THICK} * all_words, false)"))
              .withColumn("bucket", F.expr(f"pmod(page, 1 + coalesce(articles, 0) div {DEALT})")))
    columns = ("site", "host", "page", "blocks")
    dealt = placed.filter("not stays").repartition("site", "bucket").sortWithinPartitions("site", "bucket", "page")
    arrays = placed.filter("stays").select(*columns).unionByName(dealt.select(*columns))
    frequent = materialize(_frequent_runs(arrays, min_run, min_block, percent, group_tokens).distinct(), "frequent-runs")

    def having(runs: DataFrame) -> DataFrame:
        near = mark_maybe(rows, F.col("site"), key_filter(runs.select("site").distinct(), F.col("site")), "_maybe").filter("_maybe")
        return _page_runs(near, min_run, min_block, group_tokens, key_filter(runs, F.col("run")))

    counted = (having(frequent).groupBy("run", "page").count().groupBy("run").agg(F.count(F.lit(1)).alias("pages"))
               .filter(F.col("pages") >= min_pages).join(frequent, "run").join(sites, "site"))
    repeated = materialize(counted.filter(100 * F.col("pages") >= percent * F.col("articles")).select("run", "site"), "article-runs")
    return having(repeated).join(repeated, "run", "left_semi")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_run: int = MIN_RUN,
                 min_pages: int = MIN_PAGES, group_tokens: int = GROUP_TOKENS, min_block: int = MIN_BLOCK,
                 main_percent: int = MAIN_PERCENT) -> DataFrame:
    """``id, url, text``: the main text of every page.

    Blocks inside menus, headers, footers, side bars, notices, adverts, forms, comments and hidden elements are
    left out by their markup. Of the others, those of a page that marks its content with ``article`` or ``main`` are the blocks
    in there. Of what is left, the text that its site repeats goes: runs of ``min_run`` tokens, and whole blocks of ``min_block``
    tokens or more. On a page without a mark these are the runs that stand on ``min_pages`` different pages of the host, in blocks
    of any kind. Articles may quote one another, so in ``article`` and ``main`` they are the runs that stand in ``min_pages``
    different articles of the host and in ``main_percent`` per cent of them or more; an article that would be left without
    words keeps all.

    All articles, and all pages of hosts that have a page without a mark, go through suffix arrays of about ``group_tokens`` tokens. For pages without a mark each array gives its runs with up to ``min_pages`` pages, for articles the
    runs that reach the share among its own; a shuffle by run counts the different pages over all arrays of the host. So neither
    the size of an array nor that of a host or table changes what counts as repeated. The runs found come back to the pages by a join.

    Defined cases: null or empty html, and html without text, give the empty text; a null url has
    the empty host; rows of one host with the same html count as one page, and those with the same blocks in ``article`` and
    ``main`` as one article; other columns are ignored."""
    id_type = pages.schema[id_col].dataType.simpleString()
    n = max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    chosen = pages.select(F.coalesce(url_host(F.col(url_col)), F.lit("")).alias("host"), F.col(id_col).alias("id"),
                          F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    chosen = chosen.withColumn("page", F.xxhash64("host", "html"))
    article = F.when(F.col("marked"), F.xxhash64("host", "blocks")).otherwise(F.col("page"))
    parsed = materialize(_parsed(chosen, id_type).withColumn("page", article), "page-blocks")
    plain = parsed.filter("not marked")
    # The filter may let other hosts through; a run's hash holds its host.
    hosts = key_filter(plain.select("host").distinct(), F.xxhash64("host"))
    near = mark_maybe(chosen.select("host", "page", "html"), F.xxhash64("host"), hosts, "_maybe").filter("_maybe").select("host", "page", "html")
    runs = _host_runs(near, min_run, min_block, min_pages, group_tokens).repartition(n, "run")
    repeated = materialize(runs.groupBy("run", "page").count().groupBy("run").agg(F.count(F.lit(1)).alias("pages"))
                           .filter(F.col("pages") >= min_pages).select("run"), "page-runs")
    found = (_page_runs(plain, min_run, min_block, group_tokens, key_filter(repeated, F.col("run"))).join(repeated, "run", "left_semi")
             .unionByName(_article_runs(parsed.filter("marked"), min_run, min_block, min_pages, main_percent, group_tokens))
             .groupBy("page").agg(F.collect_set("run").alias("runs")))
    found = materialize(found, "found-runs")
    # Only pages that lose a run are shuffled to their runs.
    marked = mark_maybe(parsed, F.col("page"), key_filter(found, F.col("page")), "_maybe")
    rest = (marked.filter("_maybe").drop("_maybe").join(found, "page", "left")
            .unionByName(marked.filter("not _maybe").drop("_maybe").withColumn("runs", F.lit(None).cast("array<bigint>"))))
    return _without_runs(rest.select("id", "url", "host", "marked", "blocks", "runs"), id_type, min_run, min_block)
