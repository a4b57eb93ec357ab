"""Quality rules judged per document and per host.

Each document is measured and put to a few rules. Failures are summed by host, the
rates are shrunk towards the corpus with a beta prior that is estimated from the
hosts themselves, and a host whose shrunk rate of some rule is above ``max_rate`` is
rejected with all its documents.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import WORD, rows
from quillstack.session import materialise

WINDOW = 5
SYMBOL = re.compile(r"[#*$%&|<>]")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")
RULES = ("short", "repeats", "symbols", "dup_lines")


def repeat_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside windows that are found twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    _, key = np.unique(ids, return_inverse=True)
    for k in range(1, window):  # exact numbers of ever longer windows
        _, key = np.unique(key[:n + window - 1 - k] * len(number) + ids[k:n + window - 1], return_inverse=True)
    twice = np.bincount(key)[key] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[window:] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure_text(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(MEASURES)
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(SYMBOL.findall(text)),
            len(lines) - len(set(lines)), len(lines), repeat_words(words))


def measure(docs: DataFrame, host: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, host, <measures>)``, one row for each row of ``docs``; zeros for a null
    or empty text."""
    def run(batches):
        for part in rows(batches, "t"):
            found = np.array([measure_text(t) for t in part.column("t").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("i"), part.column("h"), *map(pa.array, found.reshape(-1, len(MEASURES)).T)],
                [id_col, "host", *MEASURES],
            )

    picked = docs.select(docs[id_col].alias("i"), docs[host].alias("h"), docs[text_col].alias("t"))
    kinds = dict(picked.dtypes)
    schema = f"`{id_col}` {kinds['i']}, host {kinds['h']}, " + ", ".join(f"{m} long" for m in MEASURES)
    return picked.mapInArrow(run, schema)


def add_rules(measured: DataFrame, max_symbols: float = 0.1, max_dup_lines: float = 0.3) -> DataFrame:
    """One boolean for each rule, true where the document fails it."""
    c = F.col
    return measured.withColumns({
        "short": c("n_words") < 10,
        "repeats": 100 * c("n_repeat_words") > 20 * c("n_words"),
        "symbols": c("n_symbols") > max_symbols * c("word_chars"),
        "dup_lines": c("n_dup_lines") > max_dup_lines * c("n_lines"),
    })


def host_rates(judged: DataFrame) -> DataFrame:
    """``(host, n_docs, <rule>_rate)``: failure rates shrunk by an empirical beta prior.

    The prior of a rule has the mean m of the hosts' rates and the strength s that
    explains their variance beyond chance, s = m(1-m)/v - 1 with
    v = var(rates) - m(1-m)·mean(1/n). Without such variance the rate of every host
    is m. Rows without a host take no part."""
    c = F.col
    per_host = judged.filter(c("host").isNotNull()).groupBy("host").agg(
        F.count("*").alias("n_docs"),
        *(F.sum(c(r).cast("long")).alias(f"{r}_failed") for r in RULES),
    )
    prior = per_host.agg(
        F.avg(1 / c("n_docs")).alias("inverse"),
        *(F.avg(c(f"{r}_failed") / c("n_docs")).alias(f"{r}_m") for r in RULES),
        *(F.var_pop(c(f"{r}_failed") / c("n_docs")).alias(f"{r}_v") for r in RULES),
    )
    # The prior is one row; the aggregates it is joined with are one row per host.
    joined = per_host.join(F.broadcast(prior))
    out = []
    for r in RULES:
        chance = c(f"{r}_m") * (1 - c(f"{r}_m"))
        v = c(f"{r}_v") - chance * c("inverse")
        s = F.greatest(chance / v - 1, F.lit(0.0))
        out.append(F.when(v > 0, (c(f"{r}_failed") + s * c(f"{r}_m")) / (c("n_docs") + s))
                   .otherwise(c(f"{r}_m")).alias(f"{r}_rate"))
    return joined.select("host", "n_docs", *out)


def judge(docs: DataFrame, host: str = "source", id_col: str = "doc_id", text_col: str = "text",
          max_rate: float = 0.5) -> DataFrame:
    """``(id, host, <measures>, base_failed, host_rejected, kept)``.

    A document is kept if it passes the base rules (ten words, at most a fifth of
    them in repeated windows) and its host is not rejected; without a host the base
    rules decide alone. Repeated rows are judged each by itself and all count for
    their host. Other columns of ``docs`` are not looked at."""
    judged = materialise(add_rules(measure(docs, host, id_col, text_col)), "host-measures")
    verdicts = materialise(host_rates(judged).select(
        "host", F.greatest(*(F.col(f"{r}_rate") for r in RULES)).alias("worst_rate")), "host-verdicts")
    rejected = F.coalesce(F.col("worst_rate") > max_rate, F.lit(False))
    base = F.col("short") | F.col("repeats")
    # Stored first, so that its size is known: few hosts are sent to all tasks, many
    # are joined by host, where a frequent host is split.
    return judged.join(verdicts, "host", "left").select(
        id_col, "host", *MEASURES, base.alias("base_failed"), rejected.alias("host_rejected"),
        (~base & ~rejected).alias("kept"),
    )
