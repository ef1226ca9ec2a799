"""What a site repeats in most of its articles is no text of theirs; what articles share is."""

import random

import pytest

NOTICE = "all prices of this shop are without tax and may change on any day"


def _own(i):
    return f"story {i} is told by writer {i * i} on " + " ".join(f"w{i}x{k}" for k in range(20))


def test_notice_inside_articles_goes(spark):
    from tunedata.llm.html_extract import extract_text

    rows = [(i, f"http://five.org/{i}", f"<nav>Menu</nav><article><p>{_own(i)}</p><p>{NOTICE}</p><p>The end</p></article>") for i in range(5)]
    # One in ten articles quotes the passage: it is theirs.
    rows += [(100 + i, f"http://sixty.org/{i}", f"<main><p>{_own(i)} {NOTICE if i % 10 == 0 else ''}</p></main>") for i in range(60)]
    # Copies of one article under other adverts are one article.
    rows += [(200 + i, f"http://copy.org/{i}", f"<div class=ad>Buy {i}</div><article>{NOTICE}</article>") for i in range(5)]
    got = {r["id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i in range(5):
        assert got[i] == f"{_own(i)} The end"
        assert got[200 + i] == NOTICE
    for i in range(60):
        assert got[100 + i] == f"{_own(i)} {NOTICE if i % 10 == 0 else ''}".strip()


def _expected(pages, min_run, min_block, min_pages, percent):
    """Brute force on ``{id: (host, blocks)}``."""
    def runs(block):
        w = block.split(" ")
        if min_block <= len(w) < min_run:
            return [(0, tuple(w))]
        return [(k, tuple(w[k:k + min_run])) for k in range(len(w) - min_run + 1)]

    articles = {}
    for host, blocks in pages.values():
        articles.setdefault(host, set()).add(blocks)
    want = {}
    for i, (host, blocks) in pages.items():
        left = []
        for block in blocks:
            words = block.split(" ")
            gone = set()
            for k, run in runs(block):
                having = sum(any(run == r for b in a for _, r in runs(b)) for a in articles[host])
                if having >= min_pages and 100 * having >= percent * len(articles[host]):
                    gone.update(range(k, k + len(run)))
            left.append(" ".join(w for k, w in enumerate(words) if k not in gone))
        want[i] = " ".join(t for t in left if t) or " ".join(blocks)
    return want


@pytest.mark.parametrize("percent", [20, 50, 80])
@pytest.mark.parametrize("tokens, parts, lies", [(20, 3, 256), (20, 12, 2), (1 << 19, 1, 2)])
def test_brute_force(spark, monkeypatch, tokens, parts, lies, percent):
    """The dealing of pages to arrays, copies among them, changes nothing."""
    from tunedata.llm import html_extract
    from tunedata.llm.html_extract import extract_text

    # With 2, hosts of two articles stay where they lie or go to buckets of two.
    monkeypatch.setattr(html_extract, "DEALT", lies)
    monkeypatch.setattr(html_extract, "THICK", 0 if lies == 2 else 12)
    rng = random.Random(4)
    phrases = [" ".join(rng.choice("abcd") for _ in range(rng.randint(2, 7))) for _ in range(6)]
    pages = {}
    for i in range(90):
        host = f"h{min(rng.randint(0, 8), rng.randint(0, 8))}.org"
        blocks = tuple(phrases[min(rng.randint(0, 5), rng.randint(0, 5))] + (f" u{i}" if rng.random() < 0.3 else "") for _ in range(rng.randint(1, 4)))
        pages[i] = (host, blocks)
        if i % 4 == 3:
            pages[i] = pages[rng.randint(0, i - 1)]
    rows = [(i, f"http://{host}/{i}", f"<p class=ad>{i}</p><article>{''.join(f'<p>{b}</p>' for b in blocks)}</article>") for i, (host, blocks) in pages.items()]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(parts)
    got = {r["id"]: r["text"] for r in extract_text(df, min_run=4, min_block=3, group_tokens=tokens, main_percent=percent).collect()}
    want = _expected(pages, 4, 3, 3, percent)
    assert got == want
    assert percent == 80 or 10 < sum(want[i] != " ".join(blocks) for i, (_, blocks) in pages.items())
