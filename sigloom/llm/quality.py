"""Quality rules with host verdicts (operator 2).

Each document is tested against rules. The failures are summed by host (the source column) and each rule's rate at a
host is shrunk towards the rate of all hosts by a beta prior that is fitted to the hosts' own rates (method of moments):
a host with few documents says little, one with many speaks for itself. The verdicts go back to the documents:

* a host whose shrunk rate of failing documents is above `host_rate` loses all its documents;
* a host whose shrunk rate for one rule is above `rule_rate` loses the documents that fail this rule;
* a document that fails the base rules is dropped whatever its host.

Defined results: a null text has no words and fails; a null source is no host, so its documents are judged by the base
rules alone; repeated rows count each; rates that are equal to a limit do not exceed it; a very long text is read whole, as
one row; columns of any name pass through quality_filter() unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm._common import identified, keep_rows, materialize, read_table, text_batches

_SYMBOL = re.compile(r"[#*$%&|<>]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_STATS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
#: Documents fail a rule where it is true. The base rules hold for each document alone.
BASE = {"short": "n_words < 50", "repeats": "100 * n_repeat_words > 50 * n_words"}
RULES = BASE | {"symbols": "10 * n_symbols > n_words", "lines": "100 * n_dup_lines > 30 * n_lines", "word_length": "word_chars < 3 * n_words OR word_chars > 12 * n_words"}


def stats_of(text: str | None) -> tuple[int, int, int, int, int, int]:
    text = text or ""
    words = _WORD.findall(text)
    n = len(words)
    first: dict[tuple[str, str, str], int] = {}
    repeats, covered = 0, -1  # covered: the last word counted so far
    windows = list(zip(words, words[1:], words[2:], strict=False))
    often = {w for w, c in Counter(windows).items() if c > 1}
    if often:
        for i, w in enumerate(windows):
            if w in often:
                repeats += i + 2 - max(covered, i - 1)
                covered = i + 2
    lines = Counter(x for x in text.split("\n") if _WORD.search(x))
    total = lines.total()
    return n, sum(map(len, words)), len(_SYMBOL.findall(text)), total, total - len(lines), repeats


def stats(text: Column) -> Column:
    @F.pandas_udf(_STATS)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([stats_of(t) for t in texts], columns=[x.split()[0] for x in _STATS.split(", ")])

    return run(text)


def scored(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` of docs with the struct _s of statistics and the struct _f of rule failures."""
    text_batches(docs.sparkSession)
    with_stats = docs.select(*keep, stats(F.col("text")).alias("_s"))
    fails = F.struct(*[F.expr(re.sub(r"\b([a-z]\w+)\b", r"_s.\1", rule)).alias(name) for name, rule in RULES.items()])
    return with_stats.withColumn("_f", fails)


def host_rates(docs: DataFrame, host: str = "source") -> DataFrame:
    """(host, docs, rate_<rule> and rate_any: shrunk shares of failing documents)."""
    names = [*RULES, "any"]
    fails = {r: F.col(f"_f.{r}") for r in RULES}
    fails["any"] = F.greatest(*fails.values())
    per = docs.where(F.col(host).isNotNull()).groupBy(host).agg(F.count("*").alias("docs"), *[F.sum(fails[r].cast("long")).alias(f"n_{r}") for r in names])
    per = materialize(per, "hosts")
    # moments over the hosts: the mean rate m, and the spread of the rates beyond what sampling makes
    n = F.count("*")
    sums = per.agg(n.alias("hosts"), F.sum("docs").alias("docs"), F.avg(1 / F.col("docs")).alias("inv"), *[x for r in names for x in (F.sum(f"n_{r}").alias(f"s_{r}"), F.coalesce(F.var_samp(F.col(f"n_{r}") / F.col("docs")), F.lit(0.0)).alias(f"v_{r}"))]).first()
    out = [F.col(host), F.col("docs")]
    for r in names:
        m = (sums[f"s_{r}"] or 0) / (sums["docs"] or 1)
        noise = m * (1 - m) * (sums["inv"] or 0)
        between = max(sums[f"v_{r}"] - noise, 1e-4)
        strength = max(m * (1 - m) / between - 1, 2.0)
        out.append(((F.col(f"n_{r}") + F.lit(m * strength)) / (F.col("docs") + F.lit(strength))).alias(f"rate_{r}"))
    return per.select(*out)


def with_verdicts(docs: DataFrame, host: str = "source", host_rate: float = 0.6, rule_rate: float = 0.4) -> DataFrame:
    """Scored docs with base_failed, host_rejected and kept."""
    hosts = host_rates(docs, host)
    bad = F.struct(*[(F.col(f"rate_{r}") > rule_rate).alias(r) for r in RULES])
    verdict = materialize(hosts.select(F.col(host).alias("_host"), (F.col("rate_any") > host_rate).alias("host_rejected"), bad.alias("_bad"), F.col("rate_any").alias("host_fail_rate")), "verdicts")
    base = F.greatest(*[F.col(f"_f.{r}") for r in BASE])
    out = docs.join(verdict, F.col(host) == F.col("_host"), "left").drop("_host")
    hit = F.coalesce(F.greatest(*[F.col(f"_f.{r}") & F.col(f"_bad.{r}") for r in RULES]), F.lit(False))
    rejected = F.coalesce("host_rejected", F.lit(False))
    return out.withColumns({"base_failed": base, "host_rejected": rejected, "kept": ~base & ~rejected & ~hit})


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, all columns kept."""
    rows, ids = identified(docs, "quality")
    return keep_rows(rows, ids, with_verdicts(materialize(scored(rows, *ids, "source"), "scored")).where("kept"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = with_verdicts(materialize(scored(docs, "doc_id", "source"), "scored"))
    return out.select("doc_id", *[f"_s.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept", "host_rejected", F.round("host_fail_rate", 6).alias("host_fail_rate"))


def _sql() -> str:
    words = r"regexp_extract_all(x, '[^\x20\x09-\x0D]+')"
    names = [*RULES, "any"]
    fails = ", ".join(f"{rule} AS f_{name}" for name, rule in RULES.items())
    sums = ", ".join(f"sum(CAST(f_{r} AS BIGINT)) AS n_{r}" for r in names)
    figures = ", ".join(f"sum(n_{r}) / sum(docs) AS m_{r}, coalesce(var_samp(n_{r} / docs), 0) AS v_{r}" for r in names)
    # the prior of a rule: mean m and strength k
    strength = "greatest(m_{0} * (1 - m_{0}) / greatest(v_{0} - m_{0} * (1 - m_{0}) * inv, 1e-4) - 1, 2.0) AS k_{0}"
    rates = ", ".join(f"(n_{r} + m_{r} * k_{r}) / (docs + k_{r}) AS rate_{r}" for r in names)
    hit = " OR ".join(f"(f_{r} AND coalesce(rate_{r} > 0.4, FALSE))" for r in RULES)
    return rf"""WITH t AS (SELECT doc_id, source, coalesce(text, '') AS x FROM documents), w AS (SELECT doc_id, source, x, {words} AS w, row_number() OVER () AS rid FROM t),
p AS (SELECT rid, k, array_to_string(w[k:k+2], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS k FROM w)),
c AS (SELECT rid, count(DISTINCT k + j) AS n FROM (SELECT rid, k, count(*) OVER (PARTITION BY rid, g) AS c FROM p), range(0, 3) AS r(j) WHERE c > 1 GROUP BY rid),
l AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT y) AS n_dup FROM (SELECT rid, unnest(string_split(x, chr(10))) AS y FROM w) WHERE regexp_matches(y, '[^ 	-
]') GROUP BY rid),
s AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(x, '[ 	-
]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(n_lines, 0) AS n_lines, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN c USING (rid) LEFT JOIN l USING (rid)),
f AS (SELECT *, {fails} FROM s), a AS (SELECT *, {" OR ".join(f"f_{r}" for r in RULES)} AS f_any FROM f),
h AS (SELECT source, count(*) AS docs, {sums} FROM a WHERE source IS NOT NULL GROUP BY 1), m AS (SELECT avg(1 / docs) AS inv, {figures} FROM h), k AS (SELECT *, {", ".join(strength.format(r) for r in names)} FROM m),
v AS (SELECT source, {rates} FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f_short OR f_repeats AS base_failed, NOT (f_short OR f_repeats OR coalesce(rate_any > 0.6, FALSE) OR {hit}) AS kept, coalesce(rate_any > 0.6, FALSE) AS host_rejected, round(rate_any, 6) AS host_fail_rate FROM a LEFT JOIN v USING (source)"""


OP2_SQL = _sql()
