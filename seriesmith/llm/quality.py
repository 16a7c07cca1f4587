"""Quality rules with host verdicts.

Each document is measured and tested against rules. The failures are summed by host (the column ``source``); each host's
rate of failure for each rule is shrunk towards the mean by a beta prior that is fitted to all hosts (moments of the
beta-binomial distribution), so that hosts with few documents aren't judged by chance. A host fails where a shrunk rate
is above ``host_rate``; its documents are then rejected with those that fail a base rule themselves.

Defined cases: a null text has no words and fails; null hosts form one host; repeated rows count each; a table without
rows gives none; with one host, or hosts that all have the same rate, the prior is as strong as ``MAX_STRENGTH``; columns
whose names clash with those made here are replaced in score() and untouched by keep().
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmith.llm.common import SPACES, boxed, materialize, unboxed, without

SYMBOLS = "#*$%&|<>"
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = T.StructType([T.StructField(name, T.LongType()) for name in METRICS])
WINDOW = 5
MAX_STRENGTH = 1e6
_ARROW = pa.struct([(name, pa.int64()) for name in METRICS])


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """The METRICS of a text."""
    text = text or ""
    words = text.encode().split()  # bytes are split at just the six characters of SPACES
    n = len(words)
    seen: set[str] = set()
    repeated = 0
    for line in text.split("\n"):
        if line in seen:
            repeated += 1
        elif line.strip(SPACES):
            seen.add(line)
    return n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), repeated, _repeat_words(words)


def _repeat_words(words: list[bytes]) -> int:
    windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    covered, end = 0, 0
    for i, window in enumerate(windows):
        if times[window] > 1:
            covered += i + WINDOW - max(i, end)
            end = i + WINDOW
    return covered


@F.arrow_udf(SCHEMA)
def measured(texts: pa.Array) -> pa.Array:
    rows = zip(*(measure(t.as_py()) for t in texts), strict=True) if len(texts) else [()] * len(METRICS)
    return pa.StructArray.from_arrays([pa.array(values, pa.int64()) for values in rows], fields=list(_ARROW))


def rules(m: str = "_m") -> dict[str, Column]:
    """Name of each rule to the condition under which a document fails it; the first two are the base rules."""
    of = lambda name: F.col(f"{m}.{name}")
    words = of("n_words")
    return {
        "few_words": words < 10,
        "repeats": 100 * of("n_repeat_words") > 20 * words,
        "symbols": 10 * of("n_symbols") > words,
        "same_lines": 20 * of("n_dup_lines") > words,
        "word_length": (of("word_chars") < 2 * words) | (of("word_chars") > 14 * words),
    }


def base_failed(m: str = "_m") -> Column:
    by = rules(m)
    return by["few_words"] | by["repeats"]


def prior(p: float, n: float, hosts: float, squares: float, fails_by_n: float) -> tuple[float, float]:
    """alpha, beta of the beta prior: p is the overall rate, n the documents, squares the sum of n_i**2 over hosts, fails_by_n
    that of f_i**2 / n_i."""
    noise = (hosts - 1) / n
    spread = p * (1 - p) * (1 - squares / n**2 - noise)
    rho = (fails_by_n / n - p * p - p * (1 - p) * noise) / spread if spread > 0 else 0.0
    strength = 1 / min(max(rho, 1 / (MAX_STRENGTH + 1)), 1 - 1e-6) - 1
    return p * strength, (1 - p) * strength


def host_verdicts(scored: DataFrame, host: str, host_rate: float) -> DataFrame:
    """A row for each host: host, host_docs, a shrunk rate for each rule, host_kept. scored has the metrics in _m."""
    names = list(rules())
    hosts = scored.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("host_docs"), *(F.count(F.when(fails, 1)).alias(f"n_{name}") for name, fails in rules().items())
    )
    hosts = materialize(hosts, "hosts")
    n = F.col("host_docs").cast("double")
    sums = [
        x
        for name in names
        for x in (F.sum(f"n_{name}").alias(f"f_{name}"), F.sum(F.pow(f"n_{name}", F.lit(2)) / n).alias(f"q_{name}"))
    ]
    total = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.sum(n).alias("n"), F.sum(n * n).alias("squares"), *sums).first()
    rates = {}
    for name in names:
        a, b = prior(total[f"f_{name}"] / total["n"], total["n"], total["hosts"], total["squares"], total[f"q_{name}"]) if total["n"] else (1.0, 1.0)
        rates[name] = (F.col(f"n_{name}") + a) / (n + (a + b))
    worst = F.greatest(*rates.values())
    return hosts.select("host", "host_docs", *(x.alias(f"rate_{name}") for name, x in rates.items()), (worst <= host_rate).alias("host_kept"))


def score(docs: DataFrame, text: str = "text", host: str = "source", host_rate: float = 0.5) -> DataFrame:
    """docs without the text, with METRICS, base_failed, host_kept and kept; the text is read once, in one pass."""
    rest = without(docs.columns, [*METRICS, "base_failed", "host_kept", "kept", text])
    scored = materialize(docs.select(*boxed(rest), F.col(host).alias("_of"), measured(F.col(text)).alias("_m")), "quality")
    verdicts = host_verdicts(scored, "_of", host_rate).select(F.col("host").alias("_host"), "host_kept")
    judged = scored.join(verdicts, F.col("_of").eqNullSafe(F.col("_host")), "left")
    return judged.select(*unboxed(rest), "_m.*", base_failed().alias("base_failed"), "host_kept", (~base_failed() & F.col("host_kept")).alias("kept"))


def keep(docs: DataFrame, text: str = "text", host: str = "source", host_rate: float = 0.5) -> DataFrame:
    """The documents that pass, with their own columns."""
    scored = materialize(docs.select(*boxed(docs.columns), F.col(host).alias("_of"), measured(F.col(text)).alias("_m")), "quality")
    verdicts = host_verdicts(scored, "_of", host_rate).filter("host_kept").select(F.col("host").alias("_host"))
    return scored.filter(~base_failed()).join(verdicts, F.col("_of").eqNullSafe(F.col("_host")), "left_semi").select(*unboxed(docs.columns))
