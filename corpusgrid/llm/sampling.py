"""Bounded samples of labelled rows, logistic curves fitted on them, and names for internal columns."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(df: DataFrame, *wanted: str) -> tuple[str, ...]:
    """The wanted names, with as many underscores before them as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    mark = "_"
    while any((mark + w).lower() in taken for w in wanted):
        mark += "_"
    return tuple(mark + w for w in wanted)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts`` (a null id counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts)).cast("int")


def per_label(rows: DataFrame, label: str, most: int, seed: int, *by: str) -> DataFrame:
    """About ``most`` rows of each label at most, drawn by a hash of the columns ``by``.

    Rows whose hash falls under their label's threshold are drawn, the smallest hashes first where
    they are more than 1.2 times as many as expected, so the sample is the same in every run:
    rows that tie on the hash are equal in ``by``.
    """
    counts = rows.groupBy(label).count().collect()
    if not counts:
        return rows.limit(0)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r[0], min(1.0, most / r["count"]))])
    bound = math.ceil(1.2 * sum(min(most, r["count"]) for r in counts)) + 16
    lot = F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(1 << 40))
    drawn = rows.withColumn("_lot", lot).filter(F.col("_lot") / F.lit(float(1 << 40)) < F.try_element_at(share, F.col(label)))
    return drawn.orderBy("_lot").limit(bound).drop("_lot")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, base: float = 1e-6, rounds: int = 100) -> np.ndarray:
    """Weights (last: constant) of a logistic curve, held by ``ridge`` (the constant by ``base``), by
    Newton's method; a step is halved until it lowers the loss, so it settles also where
    the classes part cleanly."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.array([ridge] * (x.shape[1] - 1) + [base])

    def loss(w: np.ndarray) -> float:
        at = x @ w
        return float(np.logaddexp(0, at).sum() - y @ at + penalty @ (w * w) / 2)

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), slope)
        size = 1.0
        while size > 1e-9 and loss(w - size * step) >= now:
            size /= 2
        if size <= 1e-9:
            break
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-10 * max(1.0, before):
            break
    return w
