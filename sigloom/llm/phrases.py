"""Phrase collocation mining by Apriori passes (operator 13).

Level k counts phrases of k words. A pass goes over all texts and emits a k-word phrase only where both overlapping
phrases of k - 1 words are frequent (at least `least` occurrences in their language); what is emitted is counted exactly,
and those that are frequent make the table of level k. Levels end at `longest` words or when one has no phrases.

What a pass needs of the levels below is broadcast as one bitmap a level, built from the level's table over the cluster.
A bitmap has 32 bits for each phrase in the table and MAX_BITS (32 MB) at most, whatever the corpus: false hits only let
a phrase be counted that then falls below `least`, so results are exact at any size and only pruning weakens.

A task reads texts in chunks of about `chunk` bytes, language by language, numbers the words of the chunk, and counts the
phrases of the chunk by exact numbers (no hashes), so a phrase leaves a chunk as one row, however common. These rows are
pre-aggregated again before the shuffle. The number of all words of a language travels as the count of the null phrase.

Each candidate (2 words or more) is then cut after each word; both parts are looked up in the level tables by joins, and
the least score counts (exact decimals, floored). A candidate inside a longer one that is as frequent is dropped: it is
enough to look at those one word longer. The best `top` of each language are taken by rank, with a limit in each task.

Defined results: a null text is empty, a null language is `und` (and is one with the language of that name); A-Z are
lower-cased, other letters stay; repeated rows count each time; ties of the score go to the shorter first part; an empty
table, or one without frequent phrases, gives an empty result; a very long text is one chunk of its own; only the named
columns are read, so columns of any name may be there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.llm._common import discard, materialize, read_table, text_batches

LEAST, LONGEST, TOP = 100, 5, 2000
CHUNK_BYTES = 8 << 20
MAX_BITS = 1 << 28
_PARTED = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"\xff" * 10)  # a byte that UTF-8 has not
_BREAK = b"\xff"
_LEVEL = "lang string, phrase string, n long"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(29))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _start(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")))


def _more(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The hashes of phrases from those of the phrases without the last word."""
    return _mix(h + words * np.uint64(0x9E3779B97F4A7C15))


class Chunk:
    """The words of some texts in one language; a break stands between pieces."""

    def __init__(self, lang: str, texts: list[bytes]):
        tokens = (b" " + _BREAK + b" ").join(t.lower().translate(_PARTED) for t in texts).replace(_BREAK, b" \xff ").split()
        coded = pa.array(tokens, pa.binary()).dictionary_encode()
        self.vocabulary: list[bytes] = coded.dictionary.to_pylist()
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.lang, self.hashes = lang, _word_hashes(self.vocabulary)
        self.words = pa.array([w.decode("utf-8", "replace") for w in self.vocabulary], pa.string())
        self.word = np.array([w != _BREAK for w in self.vocabulary], bool)

    def places(self, k: int, bitmaps: list[np.ndarray]) -> np.ndarray:
        """Where a phrase of k words begins whose two overlapping phrases of k - 1 words may be frequent."""
        if k == 1:
            return np.flatnonzero(self.word[self.ids])
        h = _more(_start(self.lang), self.hashes)
        one = self.word & _holds(bitmaps[0], h)
        n = len(self.ids)
        fit = np.append(one[self.ids], np.zeros(k, bool))
        at = np.flatnonzero(fit[:n] & fit[1 : n + 1])
        h = h[self.ids[at]] if k > 2 else h
        for j in range(2, k):  # at: places whose overlapping phrases of j - 1 words are all right
            h = _more(h, self.hashes[self.ids[at + j - 1]])
            good = _holds(bitmaps[j - 1], h)
            fit = np.zeros(n + k, bool)
            fit[at[good]] = True
            go = good & fit[at + 1]
            at, h = at[go], h[go]
        return at

    def counts(self, k: int, bitmaps: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
        """The phrases of k words at these places, and how often each is there."""
        at, many = self.places(k, bitmaps), max(1, len(self.vocabulary))
        code, size, short = self.ids[at], many, {}
        for j in range(1, k):
            if size > (1 << 62) // many:  # numbers get too long: the phrases so far are numbered anew
                short[j], _ = _distinct(code)
                code, size = np.searchsorted(short[j], code), len(short[j])
            code, size = code * many + self.ids[at + j], size * many
        code, n = _distinct(code)
        words = []
        for j in range(k - 1, 0, -1):
            code, last = np.divmod(code, many)
            code = short[j][code] if j in short else code
            words.append(last)
        each = [self.words.take(pa.array(w)) for w in (code, *reversed(words))]
        return (pc.binary_join_element_wise(*each, " ") if k > 1 else each[0]), n


def _distinct(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in order, and how often each is there."""
    code = np.sort(code)
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    return code[first], np.diff(np.r_[first, len(code)])


def _holds(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _counted(k: int, bitmaps: list[Broadcast], limit: int):
    def rows(per: dict[str, list[bytes]]) -> pa.RecordBatch:
        langs, phrases, counts = [], [], []
        for lang, texts in per.items():
            chunk = Chunk(lang, texts)
            found, n = chunk.counts(k, [b.value for b in bitmaps])
            if k == 1:
                found, n = pa.concat_arrays([found, pa.array([None], pa.string())]), np.append(n, n.sum())
            langs.append(pa.repeat(pa.scalar(lang, pa.string()), len(found)))
            phrases.append(found)
            counts.append(n)
        return pa.RecordBatch.from_arrays([pa.concat_arrays(langs), pa.concat_arrays(phrases), pa.array(np.concatenate(counts), pa.int64())], names=["lang", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_buffer().to_pybytes()
                per.setdefault(lang, []).append(text)
                size += len(text)
                if size >= limit:
                    yield rows(per)
                    per, size = {}, 0
        if per:
            yield rows(per)

    return run


def _bitmap(level: DataFrame, n: int) -> np.ndarray:
    """The level's phrases as a bitmap of a power of two of bits, MAX_BITS at most; built over the cluster."""
    bits = min(max(1 << 16, 1 << (32 * n - 1).bit_length()), MAX_BITS)

    @F.pandas_udf("long")
    def place(langs: pd.Series, phrases: pd.Series) -> pd.Series:
        split = [p.encode("utf-8", "surrogatepass").split(b" ") for p in phrases]
        h = np.array([_start(x) for x in langs], np.uint64)
        for j in range(len(split[0]) if split else 0):
            h = _more(h, _word_hashes([w[j] for w in split]))
        return pd.Series((h & np.uint64(bits - 1)).astype(np.int64))

    at = place("lang", "phrase")
    cells = level.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits"))
    got = cells.toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[got.column("cell").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def levels(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, chunk: int = CHUNK_BYTES) -> tuple[list[DataFrame], DataFrame]:
    """docs (lang, text) -> the tables (lang, phrase, n) of frequent phrases of 1, 2, ... words, and (lang, n) of all words."""
    spark = docs.sparkSession
    text_batches(spark)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text")).where("text is not null")
    tables, bitmaps, totals = [], [], None
    for k in range(1, longest + 1):
        counted = texts.mapInArrow(_counted(k, list(bitmaps), chunk), _LEVEL).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        level = materialize(counted.where((F.col("n") >= least) | F.col("phrase").isNull()), f"level{k}")
        if k == 1:
            totals = level.where("phrase is null").select("lang", "n")
        level = level.where("phrase is not null")
        n = level.count()
        if not n:
            break
        tables.append(level)
        if k < longest:
            bitmaps.append(spark.sparkContext.broadcast(_bitmap(level, n)))
    for b in bitmaps:
        b.unpersist()
    return tables, totals


def scored(tables: list[DataFrame], totals: DataFrame) -> DataFrame:
    """(lang, phrase, k, a, l, r, n, score) of all phrases of two words or more, by their worst cut."""
    frequent = tables[0]
    for t in tables[1:]:
        frequent = frequent.unionByName(t)
    cuts = None
    for k, table in enumerate(tables[1:], 2):
        words = F.split("phrase", " ", -1)
        parts = [F.struct(F.lit(j).alias("cut"), F.array_join(F.slice(words, 1, j), " ").alias("first"), F.array_join(F.slice(words, j + 1, k - j), " ").alias("rest")) for j in range(1, k)]
        one = table.select("lang", "phrase", F.lit(k).alias("k"), F.col("n").alias("a"), F.explode(F.array(*parts)).alias("c")).select("lang", "phrase", "k", "a", "c.*")
        cuts = one if cuts is None else cuts.unionByName(one)
    with_l = cuts.join(frequent.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    with_r = with_l.join(frequent.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"]).join(totals, "lang")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", (F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(15,0)")).cast("decimal(19,0)") * whole("n"), whole("l") * whole("r"))
    worst = with_r.withColumn("score", score).groupBy("lang", "phrase", "k", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    return worst.select("lang", "phrase", "k", "a", "m.l", "m.r", "n", "m.score")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, chunk: int = CHUNK_BYTES) -> DataFrame:
    """docs (lang, text) -> (lang, rank, phrase, a, l, r, n, score): each language's best phrases."""
    tables, totals = levels(docs, least, longest, chunk)
    if len(tables) < 2:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    inside = None
    for k, table in enumerate(tables[2:], 3):
        words = F.split("phrase", " ", -1)
        both = table.select("lang", F.explode(F.array(*[F.array_join(F.slice(words, j, k - 1), " ") for j in (1, 2)])).alias("phrase"), F.col("n").alias("a"))
        inside = both if inside is None else inside.unionByName(both)
    best = scored(tables, totals)
    if inside is not None:
        best = best.join(inside, ["lang", "phrase", "a"], "left_anti")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents").select("lang", "text"))


OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS n
  FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w CROSS JOIN generate_series(1, 5) AS t(k) WHERE len(w) >= k)
  GROUP BY ALL
),
f AS (SELECT *, string_split(phrase, ' ') AS w FROM g WHERE n >= 100),
t AS (SELECT lang, sum(n) AS n FROM g WHERE k = 1 GROUP BY lang),
cut AS (
  SELECT c.lang, c.phrase, c.k, c.n AS a, j, array_to_string(c.w[1:j], ' ') AS first, array_to_string(c.w[j + 1:], ' ') AS rest
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM f WHERE k > 1) AS c
),
s AS (
  SELECT cut.lang, cut.phrase, cut.k, a, j, x.n AS l, y.n AS r, t.n AS n, (1000::HUGEINT * a * t.n) // (x.n::HUGEINT * y.n) AS score
  FROM cut JOIN f AS x ON x.lang = cut.lang AND x.phrase = first JOIN f AS y ON y.lang = cut.lang AND y.phrase = rest JOIN t ON t.lang = cut.lang
),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (
  SELECT DISTINCT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, n
  FROM (SELECT lang, w, k, n, m, unnest(generate_series(1, k - m + 1)) AS i FROM f CROSS JOIN generate_series(2, 4) AS u(m) WHERE k > m)
),
r AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM b WHERE NOT EXISTS (SELECT 1 FROM longer AS o WHERE o.lang = b.lang AND o.phrase = b.phrase AND 100 * o.n >= 100 * b.a)
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 2000
"""
