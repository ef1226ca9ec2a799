"""Near copies that only one text of their family ties together."""

import numpy as np
import pytest


def star(seed: int, copies: int, first: int) -> dict[int, str]:
    """A text and independently edited copies of it, each at 0.87 to it and at about 0.76 to the others."""
    rng = np.random.default_rng(seed)
    hub = [f"s{seed}w{i}" for i in range(300)]
    texts = {first + copies: " ".join(hub)}  # not the smallest id
    for k in range(copies):
        words = list(hub)
        for at in rng.choice(48, 4, replace=False) * 6 + 5:
            words[at] = f"s{seed}e{k}at{at}"
        texts[first + k] = " ".join(words)
    return texts


@pytest.mark.parametrize("sizes", [[3000], [300, 30, 800]])
def test_star(spark, sizes):
    from tunedata.llm.minhash_dedup import drop_near_copies, near_components

    texts, want = {}, {}
    for seed, copies in enumerate(sizes):
        first = len(texts)
        family = star(seed, copies, first)
        texts |= family
        want |= dict.fromkeys(family, first)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(8)
    got = {r["id"]: r["component_id"] for r in near_components(docs).collect()}
    lost = sum(got[i] != want[i] for i in want)
    assert lost == 0, f"{lost} of {len(want)} outside their family, {len(set(got.values()))} components"
    if sizes == [3000]:
        assert [r["doc_id"] for r in drop_near_copies(docs).collect()] == [0]


def test_stage_links_from_four_fifths_on(spark):
    """Planted pairs between 0.75 and 0.90, most of them from 0.80 to 0.85, against brute force."""
    import corpus_pipeline

    texts = {}
    for k in range(60):
        words = [f"p{k}w{i}" for i in range(204)]
        texts[2 * k] = " ".join(words)
        # e words changed, 5 of 200 shingles each: (200 - 5e) / (200 + 5e), 0.818 for 4 of them.
        edits = (4, 4, 4, 3, 5, 2)[k % 6]
        for e in range(edits):
            words[20 + 30 * e + k % 7] = f"p{k}e{e}"
        texts[2 * k + 1] = " ".join(words)
    sets = {i: {tuple(t.split()[j:j + 5]) for j in range(200)} for i, t in texts.items()}
    near = {i + 1 for i in range(0, 120, 2) if 100 * len(sets[i] & sets[i + 1]) >= 80 * len(sets[i] | sets[i + 1])}
    assert 0 < len(near) < 60
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    left = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert left == set(texts) - near


def test_crowded_regions_are_compared_exactly(spark):
    """Pairs of near copies among rows that share a passage: orders of one minhash put 150 pairs into few regions, in any order."""
    from tunedata.llm.minhash_dedup import near_components

    passage = [f"p{i}" for i in range(60)]
    texts = {}
    for k in range(150):
        own = [f"k{k}w{i}" for i in range(60)]
        texts[k] = " ".join(passage + own)
        texts[1000 + k] = " ".join(passage + own[:-1] + [f"other{k}"])
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    got = {r["id"]: r["component_id"] for r in near_components(docs, trees=4, depth=1, min_depth=1, reach=1).collect()}
    lost = sum(got[k] != k % 1000 for k in texts)
    assert lost == 0, f"{lost} of {len(texts)} outside their pair"
