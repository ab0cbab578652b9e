"""Mixing sources to target weights."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dissimap.llm.encoding import TOKENIZERS, count_tokens
from dissimap.session import cut

#: The most sources that a mix may name; their plan is made on the driver.
MAX_SOURCES = 10_000


def source_name(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def capped_mean(rate: float, cap: int) -> float:
    """The mean of a Poisson number of mean `rate`, cut at cap."""
    p, below, mean = math.exp(-rate), 0.0, 0.0
    for k in range(cap):
        below += p
        mean += k * p
        p *= rate / (k + 1)
    return mean + cap * (1 - below)


def rate_for(mean: float, cap: int) -> float:
    """The rate whose capped_mean() is `mean`; infinite where the cap is needed in full."""
    if mean >= cap * (1 - 1e-9):
        return math.inf
    low, high = 0.0, 1.0
    while capped_mean(high, cap) < mean and high < 700:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if capped_mean(mid, cap) < mean else (low, mid)
    return high


def thresholds(mean: float, cap: int) -> list[float]:
    """The distribution function of the capped Poisson number at 0 .. cap-1: a uniform number u stands for as many repeats
    as there are thresholds at or below it."""
    rate = rate_for(mean, cap)
    if math.isinf(rate):
        return [0.0] * cap
    p, below, out = math.exp(-rate), 0.0, []
    for k in range(cap):
        below += p
        out.append(below)
        p *= rate / (k + 1)
    return out


def source_plan(sizes: DataFrame, targets: DataFrame, total: str = "all") -> DataFrame:
    """From sizes(source, n_tokens) of documents and targets(source, target_share, max_repeats):
    (source, n_documents, n_tokens, max_repeats, target_share, target_tokens, planned_tokens, mean_repeats, short).

    total 'all': the mix is as large as all documents of the named sources used once, and a source that cannot fill its
    share within max_repeats is short and used max_repeats times whole; 'feasible': the largest mix in which none is.
    Sources are compared trimmed and in lower case. A source without documents has n_tokens 0 and is short if it
    has a share; documents of null or other sources do not count. Rows of targets that name a source again add up their shares
    (the least max_repeats holds).
    """
    t = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null")
    t = t.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    s = sizes.select(source_name(F.col("source")).alias("source"), "n_tokens").groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_tokens").alias("n_tokens"))
    got = t.join(s, "source", "left").limit(MAX_SOURCES + 1).collect()
    if len(got) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    have = {r.source: r.n_tokens or 0 for r in got}
    size = float(sum(have.values()))
    if total == "feasible":
        size = min((have[r.source] * r.max_repeats / r.target_share for r in got if r.target_share > 0), default=0.0)
    rows = []
    for r in sorted(got, key=lambda r: r.source):
        want, n = r.target_share * size, have[r.source]
        mean = min(want / n, float(r.max_repeats)) if n else 0.0
        rows.append((r.source, r.n_documents or 0, n, r.max_repeats, r.target_share, want, mean * n, mean, n * r.max_repeats < want))
    return sizes.sparkSession.createDataFrame(
        rows,
        "source string, n_documents bigint, n_tokens bigint, max_repeats int, target_share double, target_tokens double, planned_tokens double, mean_repeats double, short boolean",
    )


def document_sizes(documents: DataFrame, targets: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents of the named sources, written to the shared folder: texts are
    encoded once. Only texts of named sources are encoded; the join is with the few targets."""
    d = documents.select("doc_id", source_name(F.col("source")).alias("source"), "text")
    names = [r[0] for r in targets.where("source is not null").select(source_name(F.col("source"))).distinct().limit(MAX_SOURCES + 1).collect()]
    if len(names) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    d = d.where(F.col("source").isin(names))
    key = F.struct("doc_id", "source").alias("key")
    n = count_tokens(d.select(key, "text"), "key", "text", tokenizer, folder)
    return cut(n.select("key.doc_id", "key.source", "n_tokens"))


def mix(sizes: DataFrame, plan: DataFrame, seed: int = 17) -> DataFrame:
    """The mixed corpus as rows (doc_id, source, copy int from 1, n_tokens, place bigint), shuffled: partitions are ranges of place, in its order.

    Each document gets a Poisson number of copies, capped at its source's max_repeats, whose mean is the source's
    mean_repeats: the inverse distribution function at a uniform number hashed from (seed, doc_id). The number does not
    depend on partitions or retries. place is a hash of (seed, doc_id, copy): ordering by it shuffles globally.
    Documents without id or of no named source have no copies.
    """
    rows = [(r.source, thresholds(r.mean_repeats, r.max_repeats)) for r in plan.collect()]
    steps = sizes.sparkSession.createDataFrame(rows, "source string, steps array<double>")
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11).cast("double") / F.lit(float(1 << 53))
    d = sizes.where("doc_id is not null").withColumn("source", source_name(F.col("source"))).join(F.broadcast(steps), "source")  # one row for each source, MAX_SOURCES at most
    n = F.size(F.filter("steps", lambda s: s <= u))
    d = d.select("doc_id", "source", "n_tokens", n.alias("n")).where("n > 0").select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    d = d.select("doc_id", "source", "copy", "n_tokens", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("copy")).alias("place"))
    return d.repartitionByRange("place").sortWithinPartitions("place")


def report(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan with what the mix reached: actual_tokens, actual_share, most_repeats, n_copies."""
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("actual_tokens"), F.count(F.lit(1)).alias("n_copies"), F.max("copy").alias("most_repeats"))
    out = plan.join(got, "source", "left").na.fill(0, ["actual_tokens", "n_copies", "most_repeats"])
    whole = out.agg(F.sum("actual_tokens")).first()[0] or 0
    return out.withColumn("actual_share", F.when(F.lit(whole > 0), F.col("actual_tokens") / F.lit(float(max(whole, 1)))).otherwise(F.lit(0.0)))


def short_sources(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, target_tokens, actual_tokens) of the sources that did not reach their target in a mix planned for 'all' though each of their documents is in it
    max_repeats times. Raises RuntimeError if the mix has other tokens of such a source than were planned."""
    got = report(mixed, plan).where(F.col("n_copies") == F.col("n_documents") * F.col("max_repeats"))
    out = cut(got.where(F.col("actual_tokens") < F.col("target_tokens")).select("source", "target_tokens", "actual_tokens", "short"))
    wrong = out.where(~F.col("short")).count() + plan.where("short").join(out, "source", "left_anti").count()
    if wrong:
        raise RuntimeError(f"{wrong} sources of the mix are not as planned")
    return out.drop("short")
