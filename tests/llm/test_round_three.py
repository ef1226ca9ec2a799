"""Personal data, whitening and the Merkle manifest against brute force, with awkward rows."""

import decimal
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

# -- personal data ------------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def brute_base(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and not all(int(p) <= 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and brute_luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind))
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)]


PII_TEXTS = [
    None, "", "no data", "é ü a.b@c.de, x", "a@b.c@d.e", "a@@b.c a@b x@y..z q@w.e-", "mail me at jo@ho.org.", "1.2.3.4.5.6.7.8", "300.1.1.1 0001.2.3.004",
    "4465758382889437", "4465758382889437 4465758382889437", "4465-7583-8288-9437", "4465 7583  8288 9437", "+1 (743) 555-3824", "+1 (743) 555-3824 4465758382889437",
    "+12 +1234567890123456 +123456789", "ok\x00a@b.cd\x00+1 222 333 4444", "9" * 5000, "1." * 3000, "a" * 20000 + "@b.cc", "x " * 30000 + "+1 (743) 555-3824 4465758382889437",
    "😀 é a@b.cc 1.2.3.4 + 1.2.3.4.", "+1 (", "@", "a@", "+", "12345678901237", "((((+1 (222) 333-4444))))", "call (743) 555-3824 now", "write jo.ann (at) lorter (dot) org today",
    "on 2024-01-15 at 10:30 we had 1,234.50 and 17 of 1999", "isbn 978-3-16-148410-0 v 1.2.3",
]


@pytest.fixture(scope="module")
def pii_docs(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(PII_TEXTS)] + [(None, "p@q.rs", "x", "y"), (3, PII_TEXTS[3], "x", "y")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, id string, spans string").repartition(3)


def test_personal_base(pii_docs):
    from tunedata.llm.pii import find_personal

    rows = find_personal(pii_docs).collect()
    assert len(rows) == len(PII_TEXTS) + 2
    for r in rows:
        text = "p@q.rs" if r["id"] is None else PII_TEXTS[r["id"]] or ""
        base = brute_base(text)
        assert r["base"] == ",".join(base), text[:60]
        for kind in PATTERNS:
            assert r[f"n_{kind}"] == sum(b.startswith(kind) for b in base)
        every = [s for s in r["spans"].split(",") if s]
        assert set(base) <= set(every) and len(every) == len(base) + r["n_added"]
        ends = [(int(s.split(":")[1]), list(PATTERNS).index(s.split(":")[0])) for s in every]
        assert ends == sorted(ends)


def test_personal_added(pii_docs):
    """The field's part: runs of numbers that the patterns drop, and spelled addresses; nothing in clean rows."""
    from tunedata.llm.pii import find_personal

    got = {r["id"]: r["spans"].split(",") for r in find_personal(pii_docs).collect() if r["id"] is not None}

    def words(i):
        return {(s.split(":")[0], PII_TEXTS[i][int(s.split(":")[1]):int(s.split(":")[2])]) for s in got[i] if s}

    assert words(14) == {("phone", "+1 (743) 555-3824"), ("card", "4465758382889437")}
    assert words(20) == words(14)
    assert words(10) == {("card", "4465758382889437")} and len(got[10]) == 2
    assert words(28) == {("phone", "(743) 555-3824")}
    assert words(29) == {("email", "jo.ann (at) lorter (dot) org")}
    assert words(30) == set() and words(2) == set()


def test_personal_held_out():
    """Sentences made with other words and digits: what the patterns miss is found."""
    import pyarrow as pa

    from tunedata.llm import pii
    from tunedata.llm.pii_examples import examples
    from tunedata.llm.tokens import chunks

    field, test = pii.fit(examples()), examples(6, seed=99)
    right = lost = wrong = 0
    for begin, _, raw, offsets in chunks(pa.array([t for t, _ in test]), pii.CHUNK):
        base = pii.base_spans(raw, offsets)
        exact = pii._by_row(raw, offsets, base)
        added = pii._by_row(raw, offsets, pii.added_spans(raw, offsets, field, base))
        for i, (text, spans) in enumerate(test[begin:begin + len(offsets) - 1]):
            done = [(a, b) for a, b, _ in exact.get(i, [])]
            want = {(k, a, b) for k, a, b in spans if not any(a < y and x < b for x, y in done)}
            found = {(pii.KINDS[k], a, b) for a, b, k in added.get(i, [])}
            right, lost, wrong = right + len(want & found), lost + len(want - found), wrong + len(found - want)
    assert right > 100 and right / (right + lost) > 0.95 and right / (right + wrong) > 0.95


def test_personal_tables(spark, pii_docs):
    from tunedata.llm.pii import find_personal, redact_personal

    assert find_personal(pii_docs.limit(0)).count() == 0
    nothing = spark.createDataFrame([], "text string, spans string")
    assert find_personal(pii_docs, labelled=nothing).agg(F.sum("n_added")).first()[0] == 0
    left = redact_personal(pii_docs)
    assert left.columns == pii_docs.columns
    texts = {r["doc_id"]: r["text"] for r in left.collect()}
    assert texts[14] == "<phone> <card>" and texts[0] is None and texts[2] == "no data" and texts[3] == "é ü <email>, x"


def test_viterbi_brute():
    """Batched decoding equals trying all labellings."""
    import itertools

    from tunedata.llm import crf

    rng = np.random.default_rng(3)
    for trial in range(20):
        k, lengths = 3, rng.integers(1, 6, 4)
        model = crf.Crf(rng.normal(size=(7, k)), rng.normal(size=(k, k)))
        starts = np.cumsum(lengths) - lengths
        features = rng.integers(0, 7, (int(lengths.sum()), 2))
        got = crf.viterbi(model, features, starts, lengths)
        for s, n in zip(starts, lengths):
            def score(path):
                edges = [0, *path, 0]
                return sum(model.move[a, b] for a, b in zip(edges, edges[1:])) + sum(model.emit[f, p].sum() for f, p in zip(features[s:s + n], path))
            assert score(got[s:s + n]) == pytest.approx(max(score(p) for p in itertools.product(range(k), repeat=int(n))))


# -- whitening ----------------------------------------------------------------------------------------

def brute_whitening(vectors, dim):
    x = np.array([[int(np.floor(256.0 * c)) for c in v] + [0] * (dim - len(v)) for v in vectors], dtype=np.int64).reshape(-1, dim)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    v = (fit - s / n).T @ (fit - s / n) / n
    e, q = np.linalg.eigh(v)
    return n, ((n * x - s).astype(object) ** 2).sum(axis=1), (x - s / n) @ q[:, ::-1], e[::-1], e[::-1] / max(np.trace(v), 1e-300)


def test_whitening(spark):
    from tunedata.llm.whitening import whiten

    rng = np.random.default_rng(5)
    good = [[float(np.float32(c)) for c in v] for v in rng.normal(size=(60, 6)) * [3, 2, 1.5, 1, 0.5, 0.1]]
    good += [good[0]] * 30 + [good[1][:4], []]
    bad = [None, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]]
    rows = [(i, v, "x", "y") for i, v in enumerate(good)] + [(900 + i, v, "x", "y") for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, id string, x string").repartition(3)
    got = whiten(df).collect()
    n, deviation, projected, values, shares = brute_whitening(good, 6)
    assert len(got) == 4 * len(good)
    for k in range(4):
        w = {r["id"]: r for r in got if r["component"] == k + 1}
        mine = np.array([w[i]["whitened"] for i in range(len(good))])
        theirs = projected[:, k] / np.sqrt(values[k])
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-9
        assert all(w[i]["deviation"] == decimal.Decimal(deviation[i]) and w[i]["n"] == n for i in w)
        assert all(abs(w[i]["explained"] / shares[k] - 1) < 1e-9 and w[i]["identity_error"] < 1e-9 for i in w)


def test_whitening_few_and_equal(spark):
    from tunedata.llm.whitening import whiten

    schema = "vec_id bigint, embedding array<double>"
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, []), (2, None)], schema)).count() == 0
    one = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0])], schema)).collect()
    assert len(one) == 4 and all(r["whitened"] is None and r["n"] == 1 and r["deviation"] == 0 and r["explained"] == 0 for r in one)
    # A cross: equal eigenvalues, any orthonormal pair will do.
    cross = [(i, v) for i, v in enumerate([[1.0, 0.0], [-1.0, 0.0], [0.0, 1.0], [0.0, -1.0]])]
    got = whiten(spark.createDataFrame(cross, schema)).collect()
    w = np.array([[r["whitened"] for r in sorted(got, key=lambda r: r["id"]) if r["component"] == k] for k in (1, 2)])
    assert np.abs(w @ w.T / 4 - np.eye(2)).max() < 1e-9 and all(r["explained"] == 0.5 for r in got)
    # Entries far beyond doubles' exact products.
    big = [(i, [float(v * 10 ** 9), float(i)]) for i, v in enumerate((3, -7, 11, 2))]
    n, deviation, *_ = brute_whitening([v for _, v in big], 2)
    got = {r["id"]: r["deviation"] for r in whiten(spark.createDataFrame(big, schema)).collect()}
    x = np.array([[int(256 * c) for c in v] for _, v in big], dtype=object)
    assert got == {i: decimal.Decimal(int(((4 * x[i] - x.sum(axis=0)) ** 2).sum())) for i in range(4)}


def test_characteristic_polynomial():
    from tunedata.llm import charpoly as cp

    rng = np.random.default_rng(8)
    for dim in (1, 2, 3, 7):
        a = rng.integers(-9, 9, (dim, 2)).astype(object)  # rank 2: eigenvalues 0
        m = a @ a.T
        primes = cp.primes_below(1 << 31, cp.coefficient_bits([int(m[i, i]) for i in range(dim)]) // 30 + 2)
        found = [cp.charpoly_mod(np.array(m % p, dtype=np.int64), p) for p in primes]
        poly = [cp.combine([f[k] for f in found], primes) for k in range(dim + 1)]
        # Faddeev and LeVerrier in integers.
        want, step = [1], np.zeros((dim, dim), dtype=object)
        for k in range(1, dim + 1):
            step = m @ (step + want[-1] * np.eye(dim, dtype=int).astype(object)) if k > 1 else m.copy()
            want.append(-sum(step[i, i] for i in range(dim)) // k)
        assert poly == want[::-1]
        roots = [at / 2 ** shift for at, shift, _ in cp.top_roots(poly, dim, 120)]
        assert np.allclose(roots, np.linalg.eigvalsh(m.astype(float))[::-1], atol=1e-6)


# -- Merkle manifest ----------------------------------------------------------------------------------

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows, fanout=2):
    """rows: (doc_id, text, lang, source, n_chars) -> list of result tuples, by trying."""
    def leaf(doc_id, text, lang, source, n_chars):
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][i:i + fanout]) for i in range(0, len(out[-1]), fanout)])
        return out

    def path(tree, i):
        return [(tree[h][(j := i // fanout ** h) - j % fanout:j], tree[h][j + 1:j - j % fanout + fanout]) for h in range(len(tree) - 1)]

    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    for t in names:
        trees[t].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
    grown = {t: levels([leaf(*r) for r in trees[t]]) for t in names}
    forest = levels([grown[t][-1][0] for t in names])
    out = []
    for k, t in enumerate(names):
        for i, r in enumerate(trees[t]):
            steps = path(grown[t], i) + path(forest, k)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now = leaf(*r[:4], r[4] + 1) if hit and r[4] is not None else leaf(*r)
            for left, right in steps:
                now = sha(*left, now, *right)
            proof = sha(*[x for left, right in steps for x in [*left, *right]])
            out.append((str(r[0]), leaf(*r), grown[t][-1][0], forest[-1][0], proof, now, now == forest[-1][0]))
    return sorted(out)


AWKWARD = [(None, "a", "en", None, 1), (None, None, None, None, None), (3, "", None, "s", 0), (5, "x" * 100000, "en", "s", 100000), (5, "y", "en", "s", None),
           (5, "y", "en", "s", None), (-4, "ü😀", "Zü", "é", 2), (6, "z", "", "s", 1)]


@pytest.mark.parametrize("fanout,page,n", [(2, 1024, 70), (2, 4, 70), (3, 9, 61), (2, 4, 0), (4, 4, 17)])
def test_merkle(spark, monkeypatch, fanout, page, n):
    from tunedata.llm import merkle

    monkeypatch.setattr(merkle, "PAGE_NODES", page)
    rows = [(i * 3, f"text {i}", ["en", "de", "en", "en"][i % 4], f"s{i % 3}", i) for i in range(n)] + (AWKWARD if n != 17 else [])
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, tree string, id string, pos string")
    made = merkle.build_manifest(df.repartition(4), changed={"n_chars": F.col("n_chars") + 1},
                                 when=F.crc32(F.col("doc_id").cast("string")) % 7 == 0, fanout=fanout)
    got = sorted((str(r[0]), *r[1:]) for r in merkle.check_leaves(made).collect())
    assert got == brute_manifest(rows, fanout)


def test_merkle_empty_and_single(spark):
    from tunedata.llm import merkle

    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    none = merkle.build_manifest(spark.createDataFrame([], schema))
    assert none.root is None and merkle.check_leaves(none).count() == 0
    one = merkle.build_manifest(spark.createDataFrame([(1, "a", "en", "s", 1)], schema))
    row = merkle.check_leaves(one).first()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["verified"] and row["proof_sha256"] == sha("")


def test_midstates():
    from tunedata.llm import midstate as ms

    rng = np.random.default_rng(2)
    for blocks in (1, 2, 3, 9):
        digests = rng.integers(0, 256, (blocks, 5, 32)).astype(np.uint8)
        state = ms.start(5)
        for d in digests:
            state = ms.unpack(ms.pack(ms.absorb(state, ms.hex_blocks(d))))
        assert [x.tobytes().hex() for x in ms.finish(state, blocks)] == [sha(*[d[i].tobytes().hex() for d in digests]) for i in range(5)]


# -- repeated rows of earlier operators ---------------------------------------------------------------

def test_decontamination_repeated_rows(spark):
    from tunedata.llm.decontaminate import contamination_hits, decontaminate

    passage = " ".join(f"p{i}" for i in range(15))
    bench = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    rows = [(1, passage), (1, passage), (1, "clean words"), (2, None), (2, None), (None, passage)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted((str(r["id"]), r["n_words"], r["n_hit"]) for r in contamination_hits(docs, bench).collect())
    assert got == [("1", 2, 0), ("1", 15, 15), ("1", 15, 15), ("2", 0, 0), ("2", 0, 0), ("None", 15, 15)]
    assert decontaminate(docs, bench, mode="spans").count() == len(rows)
    assert contamination_hits(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("flip", [False, True])
def test_near_dedup_repeated_ids(spark, flip):
    """Rows with one id and two texts give the same labels in any order, and all rows of an id the same."""
    from tunedata.llm.minhash_dedup import near_components

    a = [f"a{i}" for i in range(60)]
    b = [f"b{i}" for i in range(60)]
    rows = [(1, " ".join(a)), (2, " ".join(a[:58])), (2, " ".join(b)), (3, " ".join(b)), (4, " ".join(b[:57])), (5, "other words here"), (5, "other words here")]
    docs = spark.createDataFrame(rows[::-1] if flip else rows, "doc_id bigint, text string").coalesce(1)
    got = {}
    for r in near_components(docs).collect():
        got.setdefault(r["id"], set()).add(r["component_id"])
    assert all(len(c) == 1 for c in got.values()) and got[2] == got[3] and got[5] == {5} and got[1] <= {1}
    assert got == test_near_dedup_repeated_ids.seen.setdefault("first", got)


test_near_dedup_repeated_ids.seen = {}
