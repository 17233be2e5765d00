"""Operators 11 to 13 beside plain versions: chunk fingerprints, hard negatives, phrases."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from sigloom.llm import fingerprints, negatives, phrases

from .fixtures import COLUMNS, edge_rows, sample, words, write

# ---------------------------------------------------------------- 11


def plain_chunks(data: bytes) -> list[bytes]:
    out, start = [], 0
    gear = [xxhash.xxh64_intdigest(bytes([b]), 16) % 65536 for b in range(256)]

    def zero(end, bits):
        h = sum(gear[b] << k for k, b in enumerate(reversed(data[max(0, end - 16) : end])))
        return h % 65536 >> (16 - bits) == 0

    while start < len(data):
        end = start + 12
        while end < len(data) and end < start + 128 and not zero(end, 5 if end < start + 32 else 4):
            end += 1
        out.append(data[start : min(end, len(data))])
        start = min(end, len(data))
    return out


def plain_weights(text: str) -> dict[str, int]:
    w: dict[str, int] = {}
    for c in plain_chunks(text.encode()):
        d = xxhash.xxh64_hexdigest(c)[:12]
        w[d] = w.get(d, 0) + len(c)
    return w


def plain_fingerprint(text: str) -> str:
    return "".join(f"{d}{n:08x}" for d, n in sorted(plain_weights(text).items()))


def plain_containment(a: str, b: str) -> float:
    x, y = plain_weights(a), plain_weights(b)
    return sum(min(n, y.get(d, 0)) for d, n in x.items()) / sum(x.values()) if x else float(not y)


def test_chunks_are_those_of_a_plain_loop(monkeypatch):
    rng = random.Random(5)
    texts = [b"", b"a", b"x" * 16, b"x" * 17, b"x" * 1000, bytes(rng.randrange(256) for _ in range(5000)), " ".join(words(rng, 900)).encode()]
    for block in (1 << 22, 700):
        monkeypatch.setattr(fingerprints, "_BLOCK", block)
        for t in texts:
            ends = fingerprints.boundaries(t)
            assert [t[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=False)] == plain_chunks(t)


def test_fingerprints_read_back_and_move_with_the_text():
    rng = random.Random(6)
    for _ in range(20):
        text = " ".join(words(rng, 400))
        w = fingerprints.weights(text.encode())
        assert all((a == b).all() for a, b in zip(fingerprints.decode(fingerprints.encode(*w)), w, strict=True))
        assert w[1].sum() == len(text.encode())
        cut = rng.randrange(len(text))
        other = fingerprints.weights((text[:cut] + " put in between " + text[cut:]).encode())
        assert fingerprints.contained(w, other) > 0.85


def check_rows(got, rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = []
    for k, r in enumerate(order):
        text, after = r[1] or "", order[(k + 1) % len(order)][1] or ""
        other = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        want.append((r[0], len(text), hashlib.sha256(other.encode()).hexdigest(), plain_fingerprint(text), plain_fingerprint(other), round(plain_containment(text, other), 9), round(plain_containment(text, after), 9)))
    key = lambda r: tuple(map(str, r))
    assert sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("extra", [False, True])
def test_op11_is_the_plain_walk(spark, tmp_path, extra):
    rows = [*sample(150, 3), (None, "last of all, as nulls are", None, None, None), (10**6, " ".join(f"w{k % 700}" for k in range(30000)), "aa", "s0", 0), (-5, "语文 é ü " * 30, "aa", "s0", 0), (2**62, "far away", None, None, 0), (2**62 + 1, "farther", None, None, 0)]
    check_rows(fingerprints.op11_fingerprints(spark, write(spark, tmp_path, rows, extra=extra)).collect(), rows)


def test_op11_one_row_and_none(spark, tmp_path):
    for rows in ([], [(3, "only one document, its own next one", "aa", "s0", 1)], [(None, None, None, None, None)]):
        check_rows(fingerprints.op11_fingerprints(spark, write(spark, tmp_path / str(len(rows)), rows)).collect(), rows)


def test_op11_many_rows_of_one_id_are_dealt_out(spark, tmp_path):
    rows = [(7, "same text in all of these rows, copied out many times", "aa", "s0", 1)] * 300 + [(None, "no id at all", None, None, None)] * 300
    path = write(spark, tmp_path, rows)
    got = fingerprints.op11_fingerprints(spark, path).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == {(7, 53): 300, (None, 12): 300}
    parts = fingerprints.with_next(spark.read.parquet(f"{path}/documents.parquet"), 8).where("extra = 0").groupBy("part").count().collect()
    assert len(parts) > 4 and max(r["count"] for r in parts) < 250


def test_containment_as_columns(spark):
    df = spark.createDataFrame([("a b c d e f g h i j k l m n o p", None), (None, ""), ("", "x")], "a string, b string")
    got = df.select(fingerprints.containment(fingerprints.fingerprint("a"), fingerprints.fingerprint("a")).alias("s"), fingerprints.containment(fingerprints.fingerprint("a"), fingerprints.fingerprint("b")).alias("c")).collect()
    assert [tuple(r) for r in got] == [(1.0, 0.0), (1.0, 1.0), (1.0, 0.0)]


# ---------------------------------------------------------------- 12

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_negatives(rows):
    fit = []
    for k, v, label in rows:
        if k is None or v is None or label is None or any(x is None or x != x or abs(x) == float("inf") for x in v):
            continue
        if k % 7 == 0:
            label = int(np.fmod(label + 1, 10))
        c = [max(-(2**63), min(2**63 - 1, int(np.floor(256 * float(np.float32(x)))))) for x in v]
        fit.append((k, label, c))
    cut = lambda s: max(-(2**63), min(2**63 - 1, s))
    out = []
    for i, (k, label, c) in enumerate(fit):
        if k % 100:
            continue
        scores = [(sum(a * b for a, b in zip(c, d, strict=True)), m, other) for j, (m, other, d) in enumerate(fit) if j != i and len(d) == len(c)]
        for p, m, _ in sorted((s for s in scores if s[2] == label), key=lambda s: (-s[0], s[1]))[:5]:
            near = [s for s in scores if s[2] != label and 80 * p <= 100 * s[0] <= 100 * p]
            out += [(k, m, r + 1, n, cut(p), cut(s)) for r, (s, n, _) in enumerate(sorted(near, key=lambda s: (-s[0], s[1]))[:5])]
    return sorted(out)


def vectors(seed=1, n=900, dims=8, labels=4):
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 0.3, (n, dims)).astype(np.float32)
    v[n // 2 :: 3] = v[: len(v[n // 2 :: 3])]  # equal vectors
    return [(i, v[i].tolist(), int(rng.integers(labels)) if rng.random() > 0.3 else 0) for i in range(n)]


def op12(spark, path, rows, extra=False):
    df = spark.createDataFrame(rows, VECTORS)
    if extra:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit("mine").alias(c) for c in ("id", "c", "rid", "anchor", "rank", "nth", "cell", "windows")])
    df.write.mode("overwrite").parquet(f"{path}/embeddings.parquet")
    return sorted(map(tuple, negatives.op12_hard_negatives(spark, str(path)).collect()))


@pytest.mark.parametrize("extra", [False, True])
def test_op12_is_the_plain_search(spark, tmp_path, extra):
    rows = vectors()
    rows += rows[:120]  # repeated rows, anchors too
    rows += [(None, [0.1] * 8, 1), (2000, None, 1), (2100, [0.1] * 8, None), (2200, [0.1, None] * 4, 1), (2300, [float("nan")] * 8, 1), (2400, [float("inf")] * 8, 1), (2500, [0.3] * 3, 1), (2501, [0.2] * 3, 1), (2502, [0.2] * 3, 2), (2600, [], 1), (2601, [], 1), (2602, [], 3), (-700, [0.2] * 8, -1), (2700, [0.0] * 8, 2)]
    got = op12(spark, tmp_path, rows, extra)
    assert got == plain_negatives(rows) and len(got) > 50


def test_op12_groups_and_huge_components(spark, tmp_path, monkeypatch):
    rows = [(k * 20, [1e30 * x for x in v] if k % 9 == 0 else [1e6 * x for x in v] if k % 2 else v, lab) for k, v, lab in vectors(4, 300)]
    monkeypatch.setattr(negatives, "GROUP", 7)
    df = spark.createDataFrame(rows, VECTORS)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    fit = df.selectExpr("vec_id AS id", "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label", "embedding", "vec_id % 100 = 0 AS anchor")
    got = negatives.hard_negatives(fit.withColumn("c", negatives.components_of(fit.embedding)), group=7)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows)


def test_op12_empty(spark, tmp_path):
    assert op12(spark, tmp_path, []) == []


def test_bounds_hold_every_score():
    rng = np.random.default_rng(2)
    for n in (1, 3, 64, 500):
        v = rng.integers(-300, 300, (n, 16))
        block = negatives.Block(np.arange(n), np.arange(n), np.zeros(n, np.int64), v)
        q = rng.integers(-300, 300, (20, 16))
        low, high = block.bounds(q, np.int64)
        score = v @ q.T
        assert (low <= score).all() and (score <= high).all()
        if n == 500:
            assert (high - low).mean() < 0.2 * score.std() * 4  # the bounds are of use


# ---------------------------------------------------------------- 13


def plain_phrases(rows, least=100, longest=5, top=2000):
    import re

    f, n = {}, Counter()
    for _, text, lang, *_ in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    key = lang, tuple(w[i : i + k])
                    f[key] = f.get(key, 0) + 1
    f = {k: v for k, v in f.items() if v >= least}
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or any(g == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in f.items()):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, left, right, n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    rank = Counter()
    final = []
    for lang, p, a, left, right, total, score in out:
        rank[lang] += 1
        if rank[lang] <= top:
            final.append((lang, rank[lang], p, a, left, right, total, score))
    return final


def phrase_rows(seed=2):
    rng = random.Random(seed)
    pool = ["Ab", "ab", "c", "É", "é", "d:e", "x\x0by", "\x1cq", "f", "g.", "h", "'", "语", "ff\tg"]
    rows = []
    for i in range(200):
        text = " ".join(rng.choices(pool, k=rng.randint(0, 60)))
        if rng.random() < 0.4:
            text += " one fixed phrase of six words " + rng.choice(["", ". more", "once"])
        rows.append((i, text, rng.choice(["aa", "aa", "bb", None, "und"]), "s", 0))
    return [*rows, (None, None, None, None, None), (1, "", "", None, 0), (2, "a a a a a a a a a a", "cc", None, 0), *[(9, "again and again we say it", "dd", "s", 0)] * 40]


@pytest.mark.parametrize("chunk", [1 << 20, 300])
def test_phrases_are_those_of_a_plain_count(spark, chunk):
    rows = phrase_rows()
    got = phrases.collocations(spark.createDataFrame(rows, COLUMNS).select("lang", "text"), least=5, top=40, chunk=chunk).collect()
    want = plain_phrases(rows, 5, top=40)
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 80


def test_phrases_with_full_bitmaps(spark, monkeypatch):
    """False hits cost counts, never results."""
    monkeypatch.setattr(phrases, "_bitmap", lambda level, n: np.full(1, ~np.uint64(0)))
    rows = phrase_rows(3)
    got = phrases.collocations(spark.createDataFrame(rows, COLUMNS), least=5).collect()
    assert sorted(map(tuple, got)) == sorted(plain_phrases(rows, 5))


def test_bitmap_holds_its_level(spark):
    docs = spark.createDataFrame(phrase_rows(), COLUMNS)
    tables, _ = phrases.levels(docs, least=5)
    for t in tables:
        bitmap = phrases._bitmap(t, t.count())
        for r in t.collect():
            h = np.array([phrases._start(r.lang)])
            for w in r.phrase.encode().split(b" "):
                h = phrases._more(h, phrases._word_hashes([w]))
            assert phrases._holds(bitmap, h).all()


def test_op13_edges(spark, tmp_path):
    rows = edge_rows()
    got = phrases.op13_phrases(spark, write(spark, tmp_path / "a", rows, extra=True)).collect()
    assert sorted(map(tuple, got)) == sorted(plain_phrases(rows))
    assert phrases.op13_phrases(spark, write(spark, tmp_path / "b", [])).collect() == []


def test_scores_past_64_bits(spark):
    big = 10**12
    one = spark.createDataFrame([("aa", "x", 9 * big), ("aa", "y", 7 * big)], "lang string, phrase string, n long")
    two = spark.createDataFrame([("aa", "x y", 5 * big)], "lang string, phrase string, n long")
    got = phrases.scored([one, two], spark.createDataFrame([("aa", 123456 * big)], "lang string, n long")).first()
    assert got.score == 1000 * 5 * big * 123456 * big // (9 * big * 7 * big)
