"""Quality from a document classifier and hierarchical empirical Bayes over its site.

A logistic classifier on a text's surface (shape, not words) gives each
document's evidence as log odds.  Sites and paths within them get posterior
quality rates: the summed evidence of the other documents in them, as
expected counts, is shrunk toward the level above by a Beta prior whose
strength is fitted, for each level, from how far its rates differ from those
above (method of moments).  A document's score adds its own evidence to the
log odds of its path, less those of the corpus, so sparse sites say little.
Both levels are grouped sums with a combine before the shuffle; rows of heavy
paths are joined where they are read, as one site may hold a third of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import SEPARATOR, bag, batch_of, heavy_keys, materialize, on_keys, row_slices, slices, utf8
from folioflow.llm.toxicity import fit_sample, fitted

FEATURES = 12


def features(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Shape of each text: lengths, shares of character kinds, repetition of words and lines."""
    rows = len(at) - 1
    n = np.maximum(np.diff(at), 1).astype(float)
    total = lambda x: (np.concatenate([[0], np.cumsum(x)])[at[1:]] - np.concatenate([[0], np.cumsum(x)])[at[:-1]]) / n
    upper = (raw >= 0x41) & (raw <= 0x5A)
    digit = (raw >= 0x30) & (raw <= 0x39)
    plain = upper | ((raw >= 0x61) & (raw <= 0x7A)) | (raw >= 0x80)
    odd = ~(plain | digit | SEPARATOR[raw] | np.isin(raw, np.frombuffer(b".,'\"?!;:()-", np.uint8)))
    h, row, a, b = bag(raw, at)
    count = np.bincount(row, minlength=rows).astype(float)
    some = np.maximum(count, 1)
    pair = np.unique(np.stack([row.astype(np.uint64), h]), axis=1) if len(h) else np.zeros((2, 0), np.uint64)
    kinds = np.bincount(pair[0].astype(np.int64), minlength=rows)
    same = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=rows) if len(h) > 1 else np.zeros(rows)
    length = np.bincount(row, b - a, rows) / some
    stops = total(np.isin(raw, np.frombuffer(b".!?", np.uint8)))
    return np.stack([np.log1p(count), length / 8, total(upper), total(digit) * 10, total(odd) * 10, total(raw == 0x0A) * 20, kinds / some, np.log(np.maximum(kinds, 1)) / np.log(some + 1.5), same / some, stops * 10, total(raw == 0x21) * 10, total(raw == 0x7C) * 10], 1)


class Logistic:
    """A linear logistic model of standardised features and their squares, fitted by Newton steps with a ridge."""

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Logistic:
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
        z = self._wide(x)
        self.w = np.zeros(z.shape[1])
        for _ in range(25 if 0 < y.sum() < len(y) else 0):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            H = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(z.shape[1])
            self.w -= np.linalg.solve(H, z.T @ (p - y) + ridge * self.w)
        return self

    def _wide(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.ones((len(z), 1)), z, z**2 / 3], 1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._wide(x) @ self.w, -12, 12)


def train(docs: DataFrame, labels: DataFrame, keep) -> Logistic:
    def fit(texts, ys):
        x = np.concatenate([np.zeros((0, FEATURES)), *(features(raw, at) for _, _, raw, at in row_slices(*utf8(pa.array(texts, pa.large_string()))))])
        return Logistic().fit(x, np.asarray(ys, float))

    return fitted(fit_sample(docs, labels, "quality", keep), fit)


def url_host(url: Column) -> Column:
    """Host of a URL in lower case, without a leading ``www.``; null and empty give ''."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1)), "^www\\.", ""), F.lit(""))


def url_path(url: Column) -> Column:
    """First path segment of a URL ('' where there is none)."""
    return F.coalesce(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+/([^/?#]*)", 1), F.lit(""))


def _strength(rate_mean: float, rate_var: float, noise: float) -> float:
    """Strength of a Beta prior whose spread is the observed one less the sampling noise."""
    spread = max(rate_var - noise, 1e-5)
    return float(min(max(rate_mean * (1 - rate_mean) / spread - 1, 2.0), 10_000.0))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def site_quality(docs: DataFrame, model: Logistic, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, host, path, doc_score, host_rate, path_rate, score, kept; one row per input row.

    Null text counts as empty; null hosts and paths are the site ''; null ids
    stay null; repeated rows count each; other columns are ignored; an empty
    table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("evidence", pa.float64())])
        for batch in batches:
            for part, raw, at in slices(batch, "text"):
                yield batch_of(schema, *(part.column(c) for c in ("doc_id", "host", "path")), shared.value.logits(features(raw, at)))

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), F.col(text_col).alias("text"))
    rows = materialize(rows.mapInArrow(run, "doc_id bigint, host string, path string, evidence double"), "evidence")
    chance = 1 / (1 + F.exp(-F.col("evidence")))
    paths = materialize(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(chance).alias("good")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("good").alias("hgood"))
    rates = materialize(paths.join(hosts, "host"), "rates")
    # five numbers: the corpus rate, and how far sites differ from it and paths from their sites
    site, inner = F.col("hgood") / F.col("hn"), F.col("good") / F.col("n") - F.col("hgood") / F.col("hn")
    g = hosts.agg(F.sum("hn").alias("n"), F.sum("hgood").alias("good"), F.var_pop(site).alias("var"), F.avg(1 / F.col("hn")).alias("inv")).first()
    p = rates.agg(F.avg(inner * inner).alias("var"), F.avg(1 / F.col("n")).alias("inv")).first()
    mean = float(g["good"] / g["n"]) if g["n"] else 0.5
    host_prior, path_prior = (_strength(mean, float(x["var"] or 0.0), mean * (1 - mean) * float(x["inv"] or 0.0)) for x in (g, p))
    out = on_keys(rows, rates, ["host", "path"], heavy_keys(paths, ["host", "path"], 1))
    # a document's own evidence counts once: its site and path speak for the others in them
    out = out.withColumn("host_rate", (F.col("hgood") - chance + host_prior * mean) / (F.col("hn") - 1 + host_prior))
    out = out.withColumn("path_rate", (F.col("good") - chance + path_prior * F.col("host_rate")) / (F.col("n") - 1 + path_prior))
    score = F.col("evidence") + _logit(F.col("path_rate")) - float(np.log(mean / (1 - mean)) if 0 < mean < 1 else 0.0)
    out = out.withColumn("score", 1 / (1 + F.exp(-score)))
    return out.select("doc_id", "host", "path", chance.alias("doc_score"), "host_rate", "path_rate", "score", (F.col("score") >= threshold).alias("kept"))
