"""Boilerplate of a host is counted over all of the host's pages, however they are dealt."""

import pytest

NOTICE = "all prices of this shop are without tax and may change on any day"


def _pages():
    rows = []
    for i in range(60):
        # One page in ten has the notice; the pages between fill the groups.
        own = " ".join(f"w{i}x{k}" for k in range(300))
        rows.append((i, f"http://shop.org/{i}", f"<div>Our little shop</div><div>{own} {NOTICE if i % 10 == 0 else 'the end'} of {i}</div><div>Sold by shop {i}</div>"))
    # Copies of one page are one page: nothing of it is repeated by others.
    rows += [(100 + i, f"http://copy.org/{i}", f"<p>{NOTICE} and so on to the end</p>") for i in range(5)]
    return rows


@pytest.mark.parametrize("tokens", [200, 1 << 19])
@pytest.mark.parametrize("parts", [1, 24])
def test_counts_are_of_the_host(spark, tokens, parts):
    from tunedata.llm.html_extract import extract_text

    pages = spark.createDataFrame(_pages(), "page_id bigint, url string, html string").repartition(parts)
    got = {r["id"]: r["text"] for r in extract_text(pages, group_tokens=tokens).collect()}
    assert len(got) == 65
    for i in range(60):
        own = " ".join(f"w{i}x{k}" for k in range(300))
        # The notice and the word that follows it everywhere go; "Our little shop" has too few words to be a run.
        tail = f"{i}" if i % 10 == 0 else f"the end of {i}"
        assert got[i] == f"Our little shop {own} {tail} Sold by shop {i}"
    for i in range(5):
        assert got[100 + i] == f"{NOTICE} and so on to the end"


def test_ids_beside_a_null(spark):
    from tunedata.llm.html_extract import extract_text

    big = (1 << 60) + 1
    pages = spark.createDataFrame([(big, "u", "<p>a</p>"), (None, "u", "<article>b</article>")], "page_id bigint, url string, html string").coalesce(1)
    assert sorted((r["text"], r["id"]) for r in extract_text(pages).collect()) == [("a", big), ("b", None)]
