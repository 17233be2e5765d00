"""Operators without SQL beside plain versions: converged EM, best fit by looking at all bins, pivoting one by one, the ring."""

from __future__ import annotations

import random
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from sigloom.llm import langid, mixing, packing, sharding

# ---------------------------------------------------------------- 6


@pytest.fixture(scope="module")
def labelled(data):
    import pyarrow.parquet as pq

    return [r for r in pq.read_table(f"{data}/documents.parquet", columns=["text", "lang"]).to_pylist() if r["lang"] and r["text"]]


@pytest.fixture(scope="module")
def model(labelled):
    langs = sorted({r["lang"] for r in labelled})
    counts = np.zeros((len(langs), langid.BUCKETS))
    for r in labelled[::2]:
        ids, c = langid.grams(r["text"])
        counts[langs.index(r["lang"]), ids] += c
    return langid.MixtureModel(langs, counts)


def plain_mixture(model, text, rounds=3000):
    """{language: share}: sets grown one by one, each fitted until EM no longer moves."""
    ids, c = langid.grams(text)
    p = np.exp(model.logp[:, ids].astype(np.float64))

    def fitted(some):
        share = np.full(len(some), 1 / len(some))
        for _ in range(rounds):
            post = share[:, None] * p[some]
            new = (post / post.sum(0) * c).sum(1) / c.sum()
            if np.abs(new - share).max() < 1e-12:
                break
            share = new
        return float(c @ np.log(share @ p[some])), share

    some = [max(range(len(p)), key=lambda k: fitted([k])[0])]
    while len(some) < len(p):
        more = max((k for k in range(len(p)) if k not in some), key=lambda k: fitted([*some, k])[0])
        if fitted([*some, more])[0] - fitted(some)[0] <= langid.PENALTY * np.log(c.sum() + 1):
            break
        some.append(more)
    return dict(zip((model.langs[k] for k in some), fitted(some)[1], strict=True))


def test_mixtures_are_those_of_a_converged_em(model, labelled):
    rng = random.Random(3)
    per = defaultdict(list)
    for r in labelled[1::2]:
        per[r["lang"]].append(r["text"].split())
    sizes = Counter()
    for _ in range(60):
        langs = rng.sample(sorted(per), rng.choice([1, 2, 2, 3]))
        text = " ".join(" ".join(rng.choice(per[k])[: rng.choice([2, 6, 15, 60, 200])]) for k in langs)
        if not len(langid.grams(text)[0]):
            continue
        want = plain_mixture(model, text)
        top, _, langs, shares = model.infer(text)
        assert set(langs) == set(want) and want[top] >= max(want.values()) - 0.02
        assert all(abs(want[k] - s) < 0.02 for k, s in zip(langs, shares, strict=True))
        sizes[len(langs)] += 1
    assert len(sizes) >= 2


def test_bound_holds():
    rng = np.random.default_rng(1)
    for _ in range(50):
        p, c = rng.random((4, 30)) + 1e-3, rng.integers(1, 5, 30).astype(float)
        best = langid._em(p, c, gap=1e-9, rounds=20000)[1]
        for rounds in (1, 3, 10):
            _, now, bound = langid._em(p, c, rounds=rounds)
            assert now <= best + 1e-6 <= bound + 2e-6


def test_numerals_are_no_letters(model):
    for text in (None, "", "12 ½ ² Ⅷ ٣ _", "… !"):
        assert model.infer(text)[:2] == ("und", 0.0)
    assert model.infer("½ " + "the words of a text " * 5)[0] != "und"


def test_languages_beyond_the_bound_teach_nothing(spark):
    rows = [(k, f"abc def ghi {k}", "aa") for k in range(6)] + [(k + 10, f"xyz uvw rst {k}", "bb") for k in range(4)] + [(20, "klm nop", "cc")]
    assert langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_langs=2).langs == ["aa", "bb"]


# ---------------------------------------------------------------- 9


@pytest.mark.parametrize("seed, capacity, per_source", [(1, 50, 1), (2, 50, 3), (3, 200, 8)])
def test_each_piece_goes_to_the_tightest_bin_that_agrees(seed, capacity, per_source):
    rng = random.Random(seed)
    rows = [(k, rng.choice(["s0", "s0", "s1", None]), rng.randrange(150), rng.randrange(int(1.5 * capacity))) for k in range(300)]
    of = {r[0]: r for r in rows}
    used, clusters, sources = [], [], []
    for doc_id, _, _, n, b, offset in packing.pack_rows(rows, capacity, per_source):
        if b is None:
            assert n == 0
            continue
        _, source, cluster, _ = of[doc_id]
        fit = [k for k in range(len(used)) if used[k] + n <= capacity and cluster not in clusters[k] and sources[k][source] < per_source]
        if b == len(used):
            assert not fit
            used.append(0)
            clusters.append(set())
            sources.append(Counter())
        else:
            assert b in fit and used[b] == max(used[k] for k in fit)
        assert offset == used[b]
        used[b] += n
        clusters[b].add(cluster)
        sources[b][source] += 1
    assert sum(used) == sum(r[3] for r in rows)


# ---------------------------------------------------------------- 4


def spark_hash(*values):
    """xxhash64 of Spark over an int and longs."""
    h = xxhash.xxh64(struct.pack("<i", values[0]), seed=42).intdigest()
    for v in values[1:]:
        h = xxhash.xxh64(struct.pack("<q", v), seed=h).intdigest()
    return h


def plain_pivotal(rows, seed):
    """{rid: taken}: rows (rid, key, source, w, p) meet one by one, chunk by chunk, level by level."""
    out = {}
    for source in {r[2] for r in rows}:
        mine = [r for r in rows if r[2] == source]
        n = -(-len(mine) // mixing.CHUNK)
        chunks = defaultdict(list)
        for rid, key, _, w, p in mine:
            h = spark_hash(seed, key)
            chunks[(h - (1 << 64) if h >> 63 else h) % n].append((float(w), key, rid, p))
        while True:
            rest = defaultdict(list)
            for chunk, items in chunks.items():
                hand = None
                for x in sorted(items, reverse=True):
                    if hand is None:
                        hand = x
                        continue
                    (wa, ka, ra, pa), (wb, kb, rb, pb) = hand, x
                    rise, fall = min((1 - pa) * wa, pb * wb), min(pa * wa, (1 - pb) * wb)
                    if (spark_hash(seed, ka, kb) >> 11) / (1 << 53) * (rise + fall) < fall:
                        pa, pb = (1.0 if (1 - pa) * wa <= pb * wb else pa + pb * wb / wa), (0.0 if (1 - pa) * wa >= pb * wb else pb - (1 - pa) * wa / wb)
                    else:
                        pa, pb = (0.0 if pa * wa <= (1 - pb) * wb else pa - (1 - pb) * wb / wa), (1.0 if pa * wa >= (1 - pb) * wb else pb + pa * wa / wb)
                    open_ = []
                    for item in ((wa, ka, ra, pa), (wb, kb, rb, pb)):
                        if 0 < item[3] < 1:
                            open_.append(item)
                        else:
                            out[item[2]] = int(item[3])
                    assert len(open_) < 2
                    hand = open_[0] if open_ else None
                if hand:
                    rest[chunk // mixing.CHUNK].append(hand)
            if n == 1:
                out |= {x[2]: int(x[3] >= 0.5) for items in rest.values() for x in items}
                break
            n, chunks = -(-n // mixing.CHUNK), rest
    return out


def test_pivoting_is_that_of_a_plain_loop(spark):
    rng = random.Random(5)
    n = {"a": 900, "b": 70, "c": 1}
    rows = [(k, rng.randrange(-(1 << 62), 1 << 62), s, rng.randrange(1, 400), rng.uniform(0.05, 0.95)) for k, s in enumerate(s for s, m in n.items() for _ in range(m))]
    df = spark.createDataFrame([(*r, n[r[2]]) for r in rows], "rid long, key long, source string, w long, p double, n long")
    got = {r.rid: r.taken for r in mixing.pivotal_round(df, 7, 900).collect()}
    assert got == plain_pivotal(rows, 7)


# ---------------------------------------------------------------- 10


@pytest.mark.parametrize("epsilon", [0.0, 0.1])
def test_rows_go_clockwise_past_full_shards_only(spark, epsilon):
    shards, vnodes, n = 5, 16, 2000
    ids = spark.createDataFrame([(k if k % 3 else 6,) for k in range(n)], "doc_id long")
    out = sharding.shard_bounded(ids, "doc_id", shards, vnodes, epsilon).select("doc_id", "shard", "slot", sharding.cell_of("doc_id").alias("cell")).collect()
    points = sharding.ring(shards, vnodes)
    load = Counter(r.shard for r in out)
    room = sharding.capacities(n, shards, epsilon)
    assert len(out) == n and all(load[s] <= room[s] for s in range(shards))
    moved = 0
    for r in out:
        k = next((k for k, (at, _) in enumerate(points) if at >= r.cell), 0)
        while points[k][1] != r.shard:
            assert load[points[k][1]] == room[points[k][1]]
            k, moved = (k + 1) % len(points), moved + 1
    assert moved
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
