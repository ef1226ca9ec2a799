"""Quality classifier: hierarchical empirical Bayes over document, site section and site.

Here a document's ``source`` is its site (host) and ``source`` with ``lang`` the section of the site
(path); for tables with urls the two columns can be any host and path expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunedata.llm.common import BLANKS, materialize, text_of, without_ids

#: Bins of a feature: equal steps up to 1, one bin beyond.
BINS = 20
#: Pseudo-counts that smooth a bin's likelihood ratio, spread as the bin's neighbours lie.
BIN_PRIOR = 2.0
REJECT_BELOW = 0.5
#: Evidence of one feature is held within +- this many nats, so that none decides alone for ever.
MAX_EVIDENCE = 6.0


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def features(text: Column) -> dict[str, Column]:
    """Shares between 0 and 1 of the whole text, but for ``size`` (log of its length, over 16)."""
    chars = F.char_length(text)
    left = lambda pattern: F.char_length(F.regexp_replace(text, pattern, ""))
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    n = F.size(words)
    # Neighbours that are the same word: loops such as "the the the".
    same = F.size(F.filter(F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))),
                                      lambda a, b: a == b), lambda x: x))
    lines = F.filter(F.split(text, r"[\n.!?]+ ?"), lambda x: F.char_length(x) > 1)
    return {
        "symbols": _share(chars - left(r"[#$%&*@^~<>{}\[\]=_\\]"), chars) * 4,
        "bars": _share(chars - left(r"[|/;:+]"), chars) * 8,
        "shouts": _share(chars - left(r"[A-Z!]"), chars) * 2,
        "digits": _share(chars - left(r"[0-9]"), chars) * 2,
        "loops": _share(same, n),
        "fresh_words": _share(F.size(F.array_distinct(words)), n),
        "fresh_lines": _share(F.size(F.array_distinct(lines)), F.size(lines)),
        "size": F.log(chars + 1.0) / 16,
    }


def _bin(value: Column) -> Column:
    return F.least(F.floor(F.greatest(value, F.lit(0.0)) * BINS), F.lit(BINS)).cast("int")


def _logit(p: Column) -> Column:
    return F.log(p) - F.log(1 - p)


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def bin_table(binned: DataFrame, names: list[str], label: str) -> DataFrame:
    """``(feature, bin, evidence)``: log likelihood ratio of good to bad, by grouped aggregation over
    all labelled rows; ``len(names) * (BINS + 1)`` rows whatever the input."""
    counts = (binned.filter(F.col(label).isNotNull())
              .select(F.col(label).cast("int").alias("y"), F.explode(F.map_from_arrays(
                  F.array(*[F.lit(n) for n in names]), F.array(*[F.col(f"_bin_{n}") for n in names]))).alias("feature", "bin"))
              .groupBy("feature", "bin").agg(F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("bad")))
    totals = counts.groupBy("feature").agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"))
    rate_good, rate_bad = F.col("all_good") + BIN_PRIOR, F.col("all_bad") + BIN_PRIOR
    # A bin that few rows have is drawn to a ratio of 1.
    prior_good = BIN_PRIOR * rate_good / (rate_good + rate_bad)
    evidence = (F.log((F.col("good") + prior_good) / rate_good) - F.log((F.col("bad") + BIN_PRIOR - prior_good) / rate_bad))
    return counts.join(totals, "feature").select("feature", "bin", F.greatest(F.lit(-MAX_EVIDENCE), F.least(
        F.lit(MAX_EVIDENCE), evidence)).alias("evidence"))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  site_col: str = "source", section_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """One row per document: ``id, evidence, site_prior, section_prior, quality, keep``.

    * Evidence: the features are binned, and each bin's log likelihood ratio is counted over all
      labelled rows. The sum is scaled by one slope, fitted on all labelled rows from grouped counts,
      as the features are not independent.
    * Priors: a document counts as ``sigmoid(evidence + global logit)`` good documents. The good
      share of a site is shrunk to the global one, that of a section to its site's, each by a
      strength estimated by moments from the spread of the shares. Sparse sites thus lie near the
      global prior, rich ones at their own share.
    * Quality: ``sigmoid(evidence + logit(section prior))``; kept at ``REJECT_BELOW`` or more. The
      prior of a section is bounded away from 0 and 1 by the shrinkage, and counts each document
      itself in; a bad section can thus make its doubtful documents go, not its clearly good ones.

    Each level is a grouped aggregation with map-side combine; priors are joined by section, and the
    rows of a large section are split by adaptive execution or go past the small broadcast side.

    Defined cases: null texts count as empty; null sites and sections are a site and a section of
    their own; labels that are null or without a document are ignored, several labels of one id
    are averaged and rounded up; repeated rows are scored alike, each counting in its site; without any
    label evidence is 0 and every document has quality 0.5 and is kept; an empty table gives
    no rows; other columns are ignored."""
    text = text_of(text_col)
    made = features(text)
    names = sorted(made)
    y = (labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_lid"))
         .agg(F.round(F.avg(label_col)).cast("int").alias("y")))
    binned = materialize(docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("s"), F.col(site_col).cast("string")), F.lit("-")).alias("site"),
        F.coalesce(F.concat(F.lit("s"), F.col(section_col).cast("string")), F.lit("-")).alias("section"),
        *[_bin(made[n]).alias(f"_bin_{n}") for n in names]), "quality-bins")
    labelled = binned.join(y, binned["id"] == y["_lid"], "left").drop("_lid")
    labelled = materialize(labelled, "quality-labelled")

    # len(names) * (BINS + 1) numbers at most: taken to the plan as a constant.
    table: dict[str, dict[int, float]] = {n: {} for n in names}
    for r in bin_table(labelled, names, "y").collect():
        table[r["feature"]][r["bin"]] = r["evidence"]

    def evidence_of(n: str) -> Column:
        return reduce(lambda o, kv: F.when(F.col(f"_bin_{n}") == kv[0], F.lit(kv[1])).otherwise(o),
                      sorted(table[n].items()), F.lit(0.0))

    scored = labelled.select("id", "site", "section", "y", sum((evidence_of(n) for n in names), F.lit(0.0)).alias("raw"))
    slope, base = _calibrate(scored)
    scored = scored.withColumn("evidence", F.col("raw") * slope).withColumn("good", _sigmoid(F.col("evidence") + base))
    scored = materialize(scored.drop("raw"), "quality-scored")

    sections = scored.groupBy("site", "section").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("g"))
    sections = materialize(sections, "quality-sections")
    sites = sections.groupBy("site").agg(F.sum("n").alias("site_n"), F.sum("g").alias("site_g"))
    overall = sites.agg(F.sum("site_n").alias("n"), F.sum("site_g").alias("g")).first()
    mean = min(max((overall["g"] or 0.5) / (overall["n"] or 1), 0.01), 0.99)
    k_site = _strength(sites.select(F.col("site_n").alias("n"), (F.col("site_g") / F.col("site_n")).alias("share")), F.lit(mean))
    sites = sites.withColumn("site_prior", (F.col("site_g") + k_site * mean) / (F.col("site_n") + k_site))
    sections = sections.join(sites.select("site", "site_prior"), "site")
    k_section = _strength(sections.select("n", (F.col("g") / F.col("n")).alias("share"), "site_prior"), F.col("site_prior"))
    sections = sections.withColumn("section_prior", (F.col("g") + k_section * F.col("site_prior")) / (F.col("n") + k_section))
    out = scored.join(sections.select("site", "section", "site_prior", "section_prior"), ["site", "section"])
    quality = _sigmoid(F.col("evidence") + _logit(F.least(F.greatest(F.col("section_prior"), F.lit(0.01)), F.lit(0.99))))
    if base == 0.0 and slope == 0.0:  # no label to learn from
        quality = F.lit(0.5)
    return (out.withColumn("quality", quality)
            .select("id", "evidence", "site_prior", "section_prior", "quality", (F.col("quality") >= REJECT_BELOW).alias("keep")))


def _calibrate(scored: DataFrame, steps: int = 20) -> tuple[float, float]:
    """Slope and base of ``sigmoid(slope * raw + base)`` by Newton's method on grouped counts: raw
    evidence in steps of 1/8 nat, bounded by MAX_EVIDENCE per feature, so a few hundred rows."""
    import numpy as np

    rows = (scored.filter("y is not null").groupBy((F.round(F.col("raw") * 8) / 8).alias("x"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("g")).collect())
    if not rows:
        return 0.0, 0.0
    x, n, g = (np.array([float(r[c]) for r in rows]) for c in ("x", "n", "g"))
    total, good = n.sum(), g.sum()
    base = float(np.log((good + 1) / (total - good + 1)))
    a, b = 1.0, base
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        grad = np.array([(x * (g - n * p)).sum() - (a - 1), (g - n * p).sum() - (b - base)])  # ridge towards (1, base)
        w = n * p * (1 - p)
        hess = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 1]])
        a, b = np.clip(np.array([a, b]) + np.linalg.solve(hess, grad), [0.05, -20], [3.0, 20])
    return float(a), float(b)


def _strength(groups: DataFrame, prior: Column) -> float:
    """Pseudo-counts of a beta prior, by moments: how far shares spread beyond what their sizes tell."""
    m = groups.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.avg(prior).alias("mean"),
                   F.sum(F.col("n") * (F.col("share") - prior) ** 2).alias("spread")).first()
    if not m["k"] or m["k"] < 2:
        return 10.0
    noise = max(m["mean"] * (1 - m["mean"]), 1e-3)
    # E[sum n (share - prior)^2] = k * noise + between * (n - ...), between = noise / (strength + 1)
    between = max((m["spread"] - m["k"] * noise) / max(m["n"] - m["k"], 1), noise * 1e-3)
    return float(min(max(noise / between - 1, 5.0), 1000.0))


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **columns: str) -> DataFrame:
    """``docs``, all columns, without the documents that the classifier rejects."""
    scored = score_quality(docs, labels, id_col, **columns)
    gone = materialize(scored.filter("not keep").select(F.col("id").alias(id_col)), "low-quality")
    return without_ids(docs, gone, id_col)
