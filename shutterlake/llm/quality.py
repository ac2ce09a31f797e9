"""Quality rules, and verdicts on whole hosts from the failures of their documents.

Base measures of a text are computed in one vectorised pass (mapInArrow). The rule failures are then summed
by host (partial sums on the map side, so a host with a third of all rows costs no more than any other), each
host's failure rates are shrunk towards a Beta prior fitted to all hosts by moments, and the verdict is joined
back to the documents. Measures are written once, since both the sums and the join need them.

Defined results: a null or empty text has no words and fails the base rule; a null host forms a host of its
own, whose verdict is joined null-safely; repeated rows are judged like any others; an empty table gives an empty result;
columns of the input other than id, text and host are not looked at, whatever their names are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import numbered, small_batches, table, written

#: Fixed values of the base rule.
FEW_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 20, 8, 30
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

#: A host is rejected if the shrunk failure rate of some rule is above this.
HOST_LIMIT = 0.6
RULES = ("few_words", "repeats", "symbols", "dup_lines")
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def _repeated_words(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Per text, the words that lie in a window found twice or more in that text."""
    first, keys = K.windows(h, of, REPEAT_WINDOW)
    if not len(first):
        return np.zeros(len(of) - 1, np.int64)
    owner = np.searchsorted(of, first, "right") - 1
    keys = K.mix(keys + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(of) - 1, np.int64)
    at = first[np.isin(keys, np.unique(twice))]
    edge = np.zeros(len(h) + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + REPEAT_WINDOW, -1)
    return K.per_text(np.cumsum(edge[:-1]) > 0, of)


def measure(texts: pa.Array) -> list[np.ndarray]:
    """The columns of MEASURES for each text."""
    out: list[list[np.ndarray]] = []
    for _, _, data, offsets in K.slices(texts):
        w = K.words(data, offsets)
        n = len(offsets) - 1
        chars = K.per_text(~K.SPACE[data] & ((data & 0xC0) != 0x80), offsets)
        text, line, worded = K.lines(data, offsets)
        lines = np.bincount(text[worded], minlength=n)
        keys = np.unique(K.mix(line[worded] + text[worded].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
        distinct = np.bincount(text[worded][keys], minlength=n)
        out.append([w.counts, chars, K.per_text(_SYMBOL[data], offsets), lines - distinct, _repeated_words(w.hashes(False), w.of), lines])
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 6


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = measure(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("host"), *(pa.array(c, pa.int64()) for c in columns)], ["id", "host", *(x.split()[0] for x in MEASURES.split(", "))])


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, host, measures, one boolean per rule, base_failed) of each document."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    rows = rows.mapInArrow(_measured, f"id long, host string, {MEASURES}")
    rules: dict[str, Column] = {
        "few_words": F.col("n_words") < FEW_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
    }
    return rows.withColumns({f"fails_{k}": v for k, v in rules.items()}).withColumn("base_failed", F.col("fails_few_words") | F.col("fails_repeats"))


def host_verdicts(measured: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """(host, host_docs, rate per rule shrunk by an empirical Beta prior, host_rejected).

    The prior of a rule has the mean m and variance v of the hosts' raw rates: strength m (1 - m) / v - 1, at least 0.
    If all hosts have one rate (v = 0), the prior alone decides: every host gets that rate.
    """
    hosts = measured.groupBy("host").agg(F.count("*").alias("host_docs"), *(F.sum(F.col(f"fails_{r}").cast("long")).alias(r) for r in RULES))
    rate = {r: F.col(r) / F.col("host_docs") for r in RULES}
    prior = hosts.agg(*(F.avg(rate[r]).alias(f"m_{r}") for r in RULES), *(F.var_pop(rate[r]).alias(f"v_{r}") for r in RULES))
    both = hosts.crossJoin(F.broadcast(prior))  # prior: one row

    def shrunk(r: str) -> Column:
        m, v = F.col(f"m_{r}"), F.col(f"v_{r}")
        strength = F.greatest(m * (1 - m) / v - 1, F.lit(0.0))
        return F.when(v > 0, (F.col(r) + m * strength) / (F.col("host_docs") + strength)).otherwise(m)

    both = both.select("host", "host_docs", *(shrunk(r).alias(f"rate_{r}") for r in RULES))
    return both.withColumn("host_rejected", F.greatest(*(F.col(f"rate_{r}") for r in RULES)) > limit)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """One row per document: id, host, measures, base_failed, the host's shrunk rates and kept."""
    measured = written(measures(docs, id_col, text_col, host_col), "quality-measures")
    hosts = written(host_verdicts(measured, limit), "quality-hosts").withColumnRenamed("host", "of_host")
    joined = measured.join(hosts, F.col("host").eqNullSafe(F.col("of_host")), "left").drop("of_host")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def _fails_base(texts: pa.Array) -> pa.Array:
    n_words, _, _, _, n_repeat, _ = measure(texts)
    return pa.array((n_words < FEW_WORDS) | (100 * n_repeat > REPEAT_PERCENT * n_words))


def filtered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of docs that quality() keeps, whole. Texts do not move: they meet only the hosts' verdicts."""
    hosts = written(host_verdicts(measures(docs, id_col, text_col, host_col), limit), "quality-hosts")
    bad = hosts.where("host_rejected").select("host")
    rows, names = numbered(docs)
    text, host = (F.col(names[docs.columns.index(c)]).cast("string") for c in (text_col, host_col))
    good = rows.where(~F.arrow_udf(_fails_base, "boolean")(text))
    return good.join(bad, host.eqNullSafe(F.col("host")), "left_anti").toDF(*docs.columns)


def op1(spark, sf_dir: str) -> DataFrame:
    rates = [F.round(f"rate_{r}", 9).alias(f"rate_{r}") for r in RULES]
    return quality(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *rates)
