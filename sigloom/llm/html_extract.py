"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks (operator 3).

A page is a row of leaf blocks; each has features of its ancestor tags (with their class and id words), its own text and
its neighbours. The model has a weight per feature and label (article or not) and per pair of labels in a row. It is
trained on labelled pages by stochastic gradient steps on the conditional log-likelihood (forward-backward), and the
best row of labels is found by Viterbi. Pages are independent: the operator is one pass without a shuffle.

Defined results: a null or empty page, and one without text, give an empty text; broken markup is read as far as it
makes sense; a line break ends a block; scripts, styles and hidden parts never count as text; repeated rows give equal
results, however many there are; a very long or deeply nested page is read whole, as one value of one row; columns named
text and n_chars are replaced, all others pass through; ties between labels go to "not the article"; an empty table gives
an empty result.
"""

from __future__ import annotations


from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm._common import read_table, text_batches
from sigloom.llm.html_blocks import Block, blocks, features
from sigloom.llm.html_training import labelled_pages

TRAIN_PAGES = 1600
EPOCHS = 5
SEED = 11


class ChainModel:
    """A conditional random field with labels 0 and 1."""

    def __init__(self, names: dict[str, int]):
        self.names = names
        self.w = np.zeros((len(names), 2))
        self.pair = np.zeros((2, 2))

    def _ids(self, feats: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        ids, starts = [], []
        for f in feats:
            starts.append(len(ids))
            ids += [self.names[x] for x in f if x in self.names]
        return np.array(ids), np.array(starts)

    def scores(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.w[ids], starts)

    def marginals(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(label) of each block, and P(pair of labels) summed over neighbours."""
        n = len(s)
        e = np.exp(s - s.max(1, keepdims=True)).tolist()
        (t00, t01), (t10, t11) = np.exp(self.pair).tolist()
        x, y = e[0]  # plain numbers: two labels are too few for arrays
        fwd = [(x / (x + y), y / (x + y))]
        for a, b in e[1:]:
            x, y = fwd[-1]
            x, y = (x * t00 + y * t10) * a, (x * t01 + y * t11) * b
            fwd.append((x / (x + y), y / (x + y)))
        bwd = [(0.5, 0.5)]
        for a, b in e[:0:-1]:
            x, y = bwd[-1]
            x, y = t00 * a * x + t01 * b * y, t10 * a * x + t11 * b * y
            bwd.append((x / (x + y), y / (x + y)))
        f, g = np.array(fwd), np.array(bwd[::-1])
        one = f * g
        one /= one.sum(1, keepdims=True)
        two = f[:-1, :, None] * np.exp(self.pair) * (np.array(e)[1:] * g[1:])[:, None, :]
        return one, (two / two.sum((1, 2), keepdims=True)).sum(0) if n > 1 else np.zeros((2, 2))

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], epochs: int, rate: float = 0.25, l2: float = 1e-5) -> ChainModel:
        rows = [(*self._ids(f), np.array(y)) for f, y in pages]
        g_w, g_p = np.full_like(self.w, 1e-2), np.full_like(self.pair, 1e-2)  # AdaGrad
        for epoch in range(epochs):
            for k in np.random.default_rng(epoch).permutation(len(rows)):
                ids, starts, y = rows[k]
                one, two = self.marginals(self.scores(ids, starts))
                d = -one
                d[np.arange(len(y)), y] += 1
                step = np.repeat(d, np.diff(np.r_[starts, len(ids)]), axis=0)
                grad = np.stack([np.bincount(ids, c, len(self.w)) for c in step.T], axis=1) - l2 * self.w
                g_w += grad**2
                self.w += rate * grad / np.sqrt(g_w)
                seen = np.zeros((2, 2))
                np.add.at(seen, (y[:-1], y[1:]), 1)
                seen -= two
                g_p += seen**2
                self.pair += rate * seen / np.sqrt(g_p)
        return self

    def decode(self, feats: list[list[str]]) -> list[int]:
        """The most likely row of labels (Viterbi)."""
        if not feats:
            return []
        s = self.scores(*self._ids(feats)).tolist()
        (p00, p01), (p10, p11) = self.pair.tolist()
        a, b = s[0]
        back = []
        for x, y in s[1:]:
            from0, from1 = a + p00 >= b + p10, a + p01 >= b + p11
            back.append((0 if from0 else 1, 0 if from1 else 1))
            a, b = x + max(a + p00, b + p10), y + max(a + p01, b + p11)
        out = [int(b > a)]
        for pick in reversed(back):
            out.append(pick[out[-1]])
        return out[::-1]


@lru_cache(maxsize=2)
def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> ChainModel:
    rows = [(features(row), y) for row, y in labelled_pages(pages, seed)]
    seen: dict[str, int] = {}
    for feats, _ in rows:
        for f in feats:
            for x in f:
                seen[x] = seen.get(x, 0) + 1
    names = {x: k for k, x in enumerate(sorted(x for x, n in seen.items() if n >= 3))}
    return ChainModel(names).fit(rows, epochs)


def article_blocks(page: str | None, model: ChainModel) -> list[Block]:
    row = [b for b in blocks(page) if not b.hidden]
    return [b for b, y in zip(row, model.decode(features(row)), strict=True) if y]


def main_text(page: Column, model: ChainModel) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(b.text for b in article_blocks(p, model)) for p in pages], dtype="object")

    return run(page)


def extract(pages: DataFrame, model: ChainModel | None = None) -> DataFrame:
    """pages with text and n_chars."""
    text_batches(pages.sparkSession)
    model = model or trained()
    out = pages.withColumn("text", main_text(F.col("html"), model))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
