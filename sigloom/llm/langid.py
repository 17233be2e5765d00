"""Language identification by multilingual mixture inference (operator 6).

A language is a distribution over hashed byte trigrams of lower-cased letter runs, learnt from labelled documents. A
document is a mixture of languages: expectation-maximisation finds the proportions under which its trigrams are most
likely, and languages enter the set one by one as long as each raises the log-likelihood by more than
`penalty` * ln(number of trigrams). The language with the largest share is predicted.

Learning sees at most about `train_docs` documents of a language, whole texts, chosen by a hash of their id, and the
`max_langs` languages that have most documents (ties by name). Its counts and the model are BUCKETS numbers of 4 bytes a
language, so each takes 128 MB at most, however dirty the column is. The driver holds both, and the counts of AT_ONCE
languages as rows (32 MB) while it reads them; executors get the model.

Defined results: a text that is null or has no letter (numerals such as 2, ½ and Ⅷ are none) is `und` with score 0;
without any labelled document all others are `und` as well; a null id counts as the empty text when rows are held out;
repeated rows are predicted alike; ties between languages go by their names; a very long text is read whole; a column
named as the prediction is replaced, all others pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm._common import discard, materialize, read_table, text_batches, uniform

BUCKETS = 1 << 16
TRAIN_DOCS = 3000
MAX_LANGS = 512
AT_ONCE = 32
PENALTY = 4.0
_LETTERS = regex.compile(r"\p{L}+")
_OUT = "lang_pred string, score double, langs array<string>, shares array<double>"


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count) of the trigrams of a text; two empty arrays if it has no letter."""
    words = _LETTERS.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = np.frombuffer(f" {' '.join(words)} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint64)
    code = b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]
    bucket = ((code * np.uint64(2654435761)) & np.uint64(0xFFFFFFFF)) >> np.uint64(16)
    return np.unique(bucket.astype(np.int64), return_counts=True)


def _em(p: np.ndarray, c: np.ndarray, goal: float = -np.inf, start: np.ndarray | None = None, gap: float = 1e-2, rounds: int = 500) -> tuple[np.ndarray, float, float]:
    """Shares of the rows of p (likelihood of each gram), their log-likelihood, and a bound that no shares exceed.

    The bound is Jensen's: with gain_k the mean of p_k over the mixture, no mixture is better by more than
    n * ln(max gain). EM ends when it is within `gap` of the bound, or when the bound shows that `goal` is out of reach.
    """
    n, share = c.sum(), np.full(len(p), 1 / len(p)) if start is None else start
    for _ in range(rounds):
        each = share @ p
        now, gain = float(c @ np.log(each)), p @ (c / each) / n
        bound = now + n * float(np.log(gain.max()))
        if bound - now < gap or bound <= goal:
            break
        share = share * gain
    return share, now, bound


class MixtureModel:
    def __init__(self, langs: list[str], counts: np.ndarray, alpha: float = 0.5):
        """counts: languages x BUCKETS."""
        self.langs = langs
        self.logp = np.empty(counts.shape, np.float32)
        for k, row in enumerate(counts):  # one at a time: only the model itself is as large as the counts
            p = row + alpha
            self.logp[k] = np.log(p / p.sum())

    def infer(self, text: str | None, penalty: float = PENALTY) -> tuple[str, float, list[str], list[float]]:
        ids, c = grams(text)
        if not len(ids) or not self.langs:
            return "und", 0.0, [], []
        logp = self.logp[:, ids].astype(np.float64)
        base = logp.max(0)
        p, c = np.exp(logp - base), c.astype(np.float64)
        alone = (logp - base) @ c
        best = int(alone.argmax())
        chosen, share, ll = [best], np.ones(1), float(alone[best])
        need = penalty * np.log(c.sum() + 1)
        if len(p) > 1 and -ll > need:  # no mixture is likelier than 0
            first = np.full(len(p), 0.1 / (len(p) - 1))
            first[best] = 0.9
            # where all languages together do not pay, none does: the bound settles most texts in a few rounds
            while len(chosen) < len(p) and _em(p, c, ll + need, first)[2] > ll + need:
                tried = [(*_em(p[[*chosen, k]], c, ll + need), k) for k in range(len(p)) if k not in chosen]
                more = max(tried, key=lambda t: t[1])
                if more[1] - ll <= need:
                    break
                share, ll, chosen = more[0], more[1], [*chosen, more[3]]
        order = np.argsort(-share, kind="stable")
        top = chosen[order[0]]
        sure = 1 / np.exp(np.minimum(alone - alone[top], 0)).sum() if len(chosen) == 1 else 1.0
        return self.langs[top], float(np.clip(share[order[0]] * sure, 0, 1)), [self.langs[chosen[k]] for k in order], [float(share[k]) for k in order]


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(labelled: DataFrame, train_docs: int = TRAIN_DOCS, max_langs: int = MAX_LANGS) -> MixtureModel:
    """labelled: doc_id, text, lang; rows without a lang teach nothing."""
    text_batches(labelled.sparkSession)
    labelled = labelled.where(F.col("lang").isNotNull())
    per = {r[0]: r[1] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()}
    if not per:
        return MixtureModel([], np.zeros((0, BUCKETS)))
    langs = sorted(per)
    share = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, train_docs / per[k]))]), F.col("lang"))  # null beyond max_langs
    some = labelled.where(uniform(F.lit("train"), F.col("doc_id").cast("string")) < share).select("lang", "text")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.lang, batch.text, strict=True):
                ids, c = grams(text)
                np.add.at(sums.setdefault(lang, np.zeros(BUCKETS, np.int64)), ids, c)
        for lang, row in sums.items():
            at = np.flatnonzero(row)
            yield pd.DataFrame({"lang": lang, "gram": at, "n": row[at]})

    place = F.element_at(F.create_map(*[x for i, k in enumerate(langs) for x in (F.lit(k), F.lit(i))]), F.col("lang"))
    table = some.mapInPandas(count, "lang string, gram long, n long").groupBy(place.alias("lang"), "gram").agg(F.sum("n").alias("n"))
    table = materialize(table, "grams")
    counts = np.zeros((len(langs), BUCKETS), np.uint32)
    for lo in range(0, len(langs), AT_ONCE):
        part = table.where(F.col("lang").between(lo, lo + AT_ONCE - 1)).toArrow()
        counts[part["lang"].to_numpy(), part["gram"].to_numpy()] = part["n"].to_numpy()
    discard(table)
    return MixtureModel(langs, counts)


def predict(docs: DataFrame, model: MixtureModel, penalty: float = PENALTY) -> DataFrame:
    """docs with the struct _l of predictions."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS numbers of 4 bytes

    @F.pandas_udf(_OUT)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.infer(t, penalty) for t in texts], columns=["lang_pred", "score", "langs", "shares"])

    return docs.withColumn("_l", run("text"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out()))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "_l.lang_pred", "_l.score", "_l.langs", "_l.shares")
