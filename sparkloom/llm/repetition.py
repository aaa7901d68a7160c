"""Problem 2: repetition inside a single document, and thresholds with a bounded risk.

``repetition_profile`` measures each document. ``select_cutoffs`` turns labelled holdout documents into
one cutoff per stratum: the lowest score at which documents may be rejected while the exact binomial
(Clopper-Pearson) upper bound of the false rejection rate stays under ``alpha``, with the error
probability ``delta`` divided among all strata and cutoffs tried. The score is the largest share of repeated
runs, sentences and lines; the label is the share of words that belong to a repeat. All pages are labelled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import WORD, page_text
from sparkloom.session import checkpoint

RUN = 5
PROFILE = "page_id long, n_words long, repeated_words long, repeated_runs long, n_lines long, repeated_lines long, n_sentences long, repeated_sentences long"
_WORD = re.compile(WORD)
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|\n+")


def repeated_runs(words: list[str], run: int = RUN) -> tuple[int, int]:
    """Runs of ``run`` words equal to a run that starts earlier, and words that lie in such a run."""
    seen: set[tuple[str, ...]] = set()
    runs = count = upto = 0
    for i, gram in enumerate(zip(*(words[k:] for k in range(run)))):
        if gram in seen:
            runs += 1
            count += i + run - max(i, upto)
            upto = i + run
        else:
            seen.add(gram)
    return runs, count


def repeated_words(words: list[str], run: int = RUN) -> int:
    """Words that lie in a run of ``run`` words equal to a run that starts earlier."""
    return repeated_runs(words, run)[1]


def _repeats(parts: list[str]) -> tuple[int, int]:
    parts = [p for p in (x.strip() for x in parts) if p]
    return len(parts), len(parts) - len(set(parts))


def repetition_profile(pages: DataFrame) -> DataFrame:
    """Counts of all and of repeated words, lines and sentences of each page with non-null ``blocks``.

    Empty texts count zero words. A repeated row of a page is measured again and left out afterwards, so
    texts are never shuffled. Null page ids are left out.
    """
    texts = pages.where("page_id is not null and blocks is not null").select("page_id", page_text(F.col("blocks")).alias("text"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page, text in zip(pdf["page_id"], pdf["text"]):
                low = text.lower()
                words = _WORD.findall(low)
                again, inside = repeated_runs(words)
                rows.append((page, len(words), inside, again, *_repeats(low.split("\n")), *_repeats(_SENTENCE.split(low))))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in PROFILE.split(", ")])

    return texts.mapInPandas(measure, PROFILE).dropDuplicates(["page_id"])


def word_share(profile: DataFrame) -> Column:
    """Share of words in a repeat; 0 for a text without words."""
    return F.when(profile["n_words"] > 0, profile["repeated_words"] / profile["n_words"]).otherwise(F.lit(0.0))


def stratum(n_words: Column) -> Column:
    """Strata by length: short texts repeat by chance in another way than long ones."""
    return F.when(n_words < 150, "short").when(n_words < 600, "medium").otherwise("long")


def binomial_upper(failures: int, trials: int, error: float) -> float:
    """Exact one-sided upper bound of a rate, from ``failures`` in ``trials``, by bisection on the tail.

    At rates over the observed one the terms of the tail fall from ``failures`` downwards, so it is summed
    from there until a term no longer counts: about the root of ``trials`` terms, also for millions of trials.
    """
    if trials == 0 or failures >= trials:
        return 1.0
    ways = math.lgamma(trials + 1) - math.lgamma(failures + 1) - math.lgamma(trials - failures + 1)

    def tail(p: float) -> float:
        total, term, k = 0.0, 1.0, failures
        while term > total * 1e-17:
            total += term
            term *= k / (trials - k + 1) * (1 - p) / p
            k -= 1
        return total * math.exp(ways + failures * math.log(p) + (trials - failures) * math.log1p(-p))

    low, high = failures / trials, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(min(max(mid, 1e-15), 1 - 1e-15)) > error else (low, mid)
    return high


def select_cutoffs(holdout: DataFrame, grid: int = 50, alpha: float = 0.02, delta: float = 0.05, default: float = 1.0) -> dict[str, float]:
    """Cutoff of each stratum, from ``holdout(stratum, score, bad)``.

    The false rejection rate at a cutoff is the share of good documents at or over it. Candidates are the
    multiples of ``1/grid``, tried from 1 downwards (a fixed sequence); the last whose exact bound, at the
    error ``delta`` divided by the number of strata and candidates (Bonferroni), is within ``alpha`` is
    taken; where none is, ``default``. Only strata x ``grid`` counts reach the driver. Null scores and
    labels are left out; a null stratum is a stratum named ''.
    """
    bins = F.least(F.floor(F.col("score") * grid + 1e-9), F.lit(grid)).cast("int")
    counted = holdout.where("score is not null and bad is not null").groupBy(F.coalesce("stratum", F.lit("")).alias("stratum"), bins.alias("bin")).agg(F.count_if(~F.col("bad")).alias("good")).collect()
    by: dict[str, dict[int, int]] = {}
    for row in counted:
        by.setdefault(row["stratum"], {})[row["bin"]] = row["good"]
    error, out = delta / max(1, len(by) * (grid + 1)), {}
    for name, goods in by.items():
        total, over, cutoff = sum(goods.values()), 0, default
        for b in range(grid, -1, -1):
            over += goods.get(b, 0)
            if total == 0 or binomial_upper(over, total, error) > alpha:
                break
            cutoff = b / grid
        out[name] = cutoff
    return out


def repetition_score(profile: DataFrame) -> Column:
    """Largest share of repeated runs of words, sentences and lines; 0 for a text without words.

    At least a fifth of the share of words in repeats, as each repeated run has five words.
    """
    shares = [F.when(profile[n] > 0, profile[k] / profile[n]).otherwise(F.lit(0.0)) for k, n in (("repeated_sentences", "n_sentences"), ("repeated_lines", "n_lines"))]
    runs = profile["n_words"] - (RUN - 1)
    return F.greatest(F.when(runs > 0, profile["repeated_runs"] / runs).otherwise(F.lit(0.0)), *shares)


def judged(pages: DataFrame, limit: float = 0.3, alpha: float = 0.02, delta: float = 0.05, holdout: int | None = None) -> DataFrame:
    """Each page with words: ``page_id, share, score, cutoff, rejected, confirmed``.

    Every page is labelled by the definition (``share`` of words in a repeat at least ``limit``: ``confirmed``), and all
    of them select a cutoff of the score for each stratum of length; a page at or over the cutoff of its stratum is
    ``rejected``. Where no cutoff can be supported, as in a small collection, it is a fifth of ``limit``, which no page of
    the definition is under. A cutoff bounds the rate of good pages that are rejected, not of others that are missed.
    With ``holdout`` only so many pages, those with the least hash of their id, select the cutoffs.
    """
    profile = repetition_profile(pages)
    scored = profile.where("n_words > 0").select("page_id", word_share(profile).alias("share"), repetition_score(profile).alias("score"), stratum(F.col("n_words")).alias("stratum"))
    scored = checkpoint(scored)
    labelled = scored if holdout is None else scored.orderBy(F.xxhash64("page_id"), "page_id").limit(holdout)
    cutoffs = select_cutoffs(labelled.select("stratum", "score", (F.col("share") >= limit).alias("bad")), alpha=alpha, delta=delta, default=limit / RUN)
    pick = F.lit(limit / RUN)
    for name, cutoff in sorted(cutoffs.items()):
        pick = F.when(F.col("stratum") == name, F.lit(cutoff)).otherwise(pick)
    scored = scored.withColumn("cutoff", pick)
    return scored.select("page_id", "share", "score", "cutoff", (F.col("score") >= F.col("cutoff")).alias("rejected"), (F.col("share") >= limit).alias("confirmed"))


def repetitive(pages: DataFrame, limit: float = 0.3, alpha: float = 0.02, delta: float = 0.05, holdout: int | None = None) -> DataFrame:
    """Pages that the cutoffs of ``judged`` reject: ``page_id, share, score, cutoff, confirmed``.

    ``confirmed`` if the definition holds for the page. Pages without words are never rejected.
    """
    return judged(pages, limit, alpha, delta, holdout).where("rejected").drop("rejected")
