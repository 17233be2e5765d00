"""Tables in which a third of all rows are one row, equal in every column: no task may get them all."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sigloom.llm import _common, mixing, packing, sharding

N, HOT = 3000, 1000


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("hot"))
    rows = [(7, "the same words in one text of twelve words that comes back often", "aa", "s0", 64)] * HOT
    rows += [(k, " ".join(f"w{k}_{j}" for j in range(1 + k % 40)), "aa", f"s{k % 3}", 0) for k in range(1000, 1000 + N - HOT)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(8).write.parquet(f"{path}/documents.parquet")
    return path


def test_rows_alike_are_numbered(spark, docs):
    rows = _common.with_row_id(spark.read.parquet(f"{docs}/documents.parquet").select("doc_id", "source"), "t")
    out = _common.told_apart(rows, ["doc_id", "source"], "_rid").collect()
    per = defaultdict(list)
    for r in out:
        per[r.doc_id].append(r._nth)
    assert len(out) == N and sorted(per.pop(7)) == list(range(HOT)) and set(map(tuple, per.values())) == {(0,)}


def test_mixing_spreads_them(spark, docs, monkeypatch):
    seen, fold = [], mixing.pivotal_round

    def watched(rows, seed, n_max):
        chunks = F.greatest(F.lit(1), F.ceil(F.col("n") / mixing.CHUNK))
        seen.append(max(r[0] for r in rows.groupBy("source", F.pmod(F.xxhash64(F.lit(seed), "key"), chunks)).count().select("count").collect()))
        return fold(rows, seed, n_max)

    monkeypatch.setattr(mixing, "pivotal_round", watched)
    out = mixing.op4_mixing(spark, docs).collect()
    assert len(out) == N and seen[0] < 2 * mixing.CHUNK
    taken = Counter()
    for r in out:
        taken[r.source] += r.taken
        assert r.taken in (0, r["size"], 2 * r["size"])
    assert all(abs(taken[r.source] - r.target) <= 40 for r in out)
    again = Counter((r.doc_id, r.taken) for r in mixing.op4_mixing(spark, docs).collect())
    assert again == Counter((r.doc_id, r.taken) for r in out)


def test_packing_spreads_them(spark, docs, monkeypatch):
    out = packing.pack(spark.read.parquet(f"{docs}/documents.parquet"), 64, 8, pack_size=100).collect()
    hot = Counter(r.bin_id >> 24 for r in out if r.doc_id == 7)
    assert len(hot) == N // 100 and max(hot.values()) < 3 * HOT / len(hot)
    assert max(Counter(r.bin_id for r in out if r.doc_id == 7).values()) == 1


def test_sharding_spreads_them(spark, docs):
    table = spark.read.parquet(f"{docs}/documents.parquet")
    rows, ids = _common.identified(table, "t")
    run = sharding._ranked(rows.select(*ids, "doc_id"), "doc_id", (), ids, 12)
    assert max(r[0] for r in run.groupBy("_part").count().select("count").collect()) < 2 * N / 12
    out = sharding.op10_sharding(spark, docs).collect()
    per = defaultdict(list)
    for r in out:
        per[r.shard].append(r.slot)
    assert len(out) == N and all(sorted(s) == list(range(N // 8)) for s in per.values())


@pytest.mark.parametrize("epsilon", [0.0, 0.25])
def test_the_walk_by_brute_force(epsilon):
    """Row by row: none passes a shard that has room, and none is lost."""
    import random

    rng = random.Random(4)
    counts = {rng.randrange(sharding.POSITIONS): rng.choice([1, 1, 2, 300]) for _ in range(400)}
    plan = sharding.walk(counts, 8, 32, epsilon)
    points, total = sharding.ring(8, 32), sum(counts.values())
    own, room = sharding.owners(points), sharding.capacities(total, 8, epsilon)
    load, parts = Counter(), defaultdict(list)
    for cell, lo, hi, slot, shard in plan:
        assert slot == load[shard]
        load[shard] += hi - lo
        parts[cell].append((lo, hi, shard))
    assert all(load[s] <= room[s] for s in range(8)) and load.total() == total
    for cell, n in counts.items():
        assert sorted(x for lo, hi, _ in parts[cell] for x in range(lo, hi)) == list(range(n))
        for _, _, shard in parts[cell]:
            at = own[cell]
            while points[at % len(points)][1] != shard:
                assert load[points[at % len(points)][1]] == room[points[at % len(points)][1]]
                at += 1


def test_best_fit_by_brute_force():
    """Against a plain search over all bins for the tightest that agrees."""
    import random

    rng = random.Random(8)
    bins, plain = packing.Bins(50, 2), []
    for n in sorted((rng.randint(1, 50) for _ in range(600)), reverse=True):
        cluster, source = rng.randrange(150), rng.randrange(9)
        got, offset = bins.place(n, cluster, source)
        fits = [b for b in plain if b["room"] >= n and cluster not in b["clusters"] and b["sources"][source] < 2]
        if fits:
            room = min(b["room"] for b in fits)
            assert plain[got]["room"] == room and plain[got] in fits
        else:
            assert got == len(plain)
            plain.append({"room": 50, "clusters": set(), "sources": Counter()})
        assert offset == 50 - plain[got]["room"]
        plain[got]["room"] -= n
        plain[got]["clusters"].add(cluster)
        plain[got]["sources"][source] += 1


def test_columns_named_as_results_are_replaced(spark):
    rows = spark.createDataFrame([(k, "x", 5, 6, 7) for k in range(20)], "doc_id long, shard string, slot long, grown_shard long, _row long")
    out = sharding.shard_bounded(rows, "doc_id", 4)
    assert out.columns == ["doc_id", "grown_shard", "_row", "shard", "slot"] and {r.shard for r in out.collect()} == {0, 1, 2, 3}
    out = sharding.shard_by_key(rows, "doc_id", 4)
    assert out.columns == ["doc_id", "slot", "_row", "shard", "grown_shard"] and {r.slot for r in out.collect()} == {5}
