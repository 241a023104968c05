"""Quality rules with host verdicts: rule failures by host, shrunk by an empirical beta prior."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import add_values, map_values, table

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of words
MOST_SYMBOLS = 10  # symbols per hundred words
MOST_DUPLICATE_LINES = 30  # per cent of lines with a word
MOST_UPPER = 60  # per cent of words
TRUST, WATCH = 0.5, 2.0  # a host's shrunk failure rate, by that of all documents
REJECT = 0.9  # a host's shrunk failure rate
STRICT = 2  # the limits of watched hosts are lower by this factor
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words that stand in a ``window``-word passage found twice or more in the text, its first place included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    span, same = 1, ids
    while span < window:  # numbers of passages of doubled length, exactly
        step = min(span, window - span)
        pair = same[: len(same) - step] * np.int64(len(words) + 1) + same[step:]
        same = np.unique(pair, return_inverse=True)[1].reshape(-1)
        span += step
    often = np.bincount(same)[same] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(often)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = _WORD.findall(text)
    seen: set[str] = set()
    lines = repeats = 0
    for line in text.split("\n"):
        if _WORD.search(line):
            lines += 1
            repeats += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(_SYMBOL.findall(text)), repeats, repeated_words(words), lines, sum(map(str.isupper, words))


def flags() -> tuple[Column, Column, Column]:
    """base_failed, rule_failed and strict_failed from the counts; each implies the next."""
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))

    def soft(factor: int) -> Column:
        return (100 * factor * F.col("n_symbols") > MOST_SYMBOLS * F.col("n_words")) | (100 * factor * F.col("n_dup_lines") > MOST_DUPLICATE_LINES * F.col("n_lines")) | (100 * factor * F.col("n_upper") > MOST_UPPER * F.col("n_words"))

    return base, base | soft(1), base | soft(STRICT)


def verdicts(rows: DataFrame, trust: float = TRUST, watch: float = WATCH, reject: float = REJECT) -> DataFrame:
    """(host, host_rate, host_verdict) of rows (host, rule_failed).

    The beta prior has the mean rate of all documents and the variance between hosts that is left when the sampling noise of each host's own
    documents is taken off (moments of the beta-binomial, hosts weighing by their documents). Hosts that differ no more than chance would have them get the mean.
    """
    hosts = table(rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if("rule_failed").alias("failed")))
    totals = hosts.agg(F.sum("n").alias("all"), F.sum("failed").alias("all_failed"), F.count(F.lit(1)).alias("hosts"))  # one row
    mean = F.col("all_failed") / F.col("all")
    off = F.col("failed") / F.col("n") - mean
    spread = hosts.join(F.broadcast(totals)).agg(F.first("all").alias("all"), F.first(mean).alias("mean"), F.first("hosts").alias("hosts"), F.sum(F.col("n") * off * off).alias("squares"), F.sum((1 - F.col("n") / F.col("all")) * (F.col("n") - 1)).alias("room"))
    noise = F.col("mean") * (1 - F.col("mean"))
    shared = (F.col("squares") - noise * (F.col("hosts") - 1)) / (noise * F.col("room"))
    prior = spread.select("mean", F.when((noise > 0) & (F.col("room") > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), shared))).otherwise(0.0).alias("shared"))
    # (failed + a) / (n + a + b) with a + b = 1 / shared - 1 and a = mean * (a + b), without the division by zero
    rate = (F.col("failed") * F.col("shared") + F.col("mean") * (1 - F.col("shared"))) / (F.col("n") * F.col("shared") + 1 - F.col("shared"))
    rated = hosts.join(F.broadcast(prior)).select("host", rate.alias("host_rate"), "mean")
    verdict = F.when(F.col("host_rate") > reject, "reject").when(F.col("host_rate") > watch * F.col("mean"), "watch").when(F.col("host_rate") < trust * F.col("mean"), "trust").otherwise("ordinary")
    return table(rated.select("host", "host_rate", verdict.alias("host_verdict")))


def with_verdict(rows: DataFrame, of_hosts: DataFrame, host: str) -> DataFrame:
    """Joins host verdicts back; the written table of hosts is broadcast by the optimizer where it is small."""
    joined = rows.alias("r").join(of_hosts.alias("v"), F.expr(f"r.`{host}` <=> v.host"), "left").select("r.*", "v.host_rate", "v.host_verdict")
    base, rule, strict = flags()
    gone = base | (F.col("host_verdict") == "reject") | ((F.col("host_verdict") == "ordinary") & rule) | ((F.col("host_verdict") == "watch") & strict)
    return joined.withColumn("kept", ~gone)


def judged(docs: DataFrame, host: str = "source", **settings) -> DataFrame:
    """(doc_id, text_hash, host, counts..., base_failed, rule_failed, host_rate, host_verdict, kept) for each row.

    base_failed: too few words or too much repeated. rule_failed: that, or too many symbols, duplicate lines or capitals. A host's failure rate is
    (failed + a) / (documents + a + b) with an empirical beta prior (a, b), see ``verdicts``. By that rate a host is trusted (half the mean rate: only base failures
    go), ordinary (documents that fail any rule go), watched (twice the mean: the limits are halved) or rejected (0.9: all its documents go).

    Null text: no words, base_failed. Null host: a host of its own. Null doc_id: kept in the result. Repeated rows: rows of their own.
    Empty table: empty result. One host only: its rate is the mean, so it is ordinary or rejected.
    """
    schema = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
    keep = [F.col("doc_id"), F.xxhash64("text").alias("text_hash"), F.col(host).alias("host")]
    base, rule, _ = flags()
    rows = table(map_values(docs, keep, F.col("text"), counts, schema).withColumn("base_failed", base).withColumn("rule_failed", rule))
    return with_verdict(rows, verdicts(rows.select("host", "rule_failed"), **settings), "host")


def keep_good(docs: DataFrame, host: str = "source", **settings) -> DataFrame:
    """``docs`` without the rows that the rules reject.

    The rules are counted once for the hosts' rates and once more beside the texts as they pass, so that no text is shuffled.
    """
    schema = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
    _, rule, _ = flags()
    failed = map_values(docs, [F.col(f"`{host}`").alias("host")], F.col("text"), counts, schema).select("host", rule.alias("rule_failed"))
    of_hosts = verdicts(failed, **settings)
    # the counts have names of their own beside the columns of docs
    named = docs.select(*(F.col(f"`{c}`").alias(f"d_{c}") for c in docs.columns))
    good = with_verdict(add_values(named, "d_text", counts, schema), of_hosts, f"d_{host}").where("kept")
    return good.select(*(F.col(f"`d_{c}`").alias(c) for c in docs.columns))
