"""Every operator against a plain version on small tables, and on odd rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from sigloom.llm import exact_dedup, langid, mixing, near, packing, pii, quality, sharding, simhash, substring
from sigloom.llm.queries import queries

from . import fixtures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    return fixtures.sample()


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    return fixtures.write(spark, tmp_path_factory.mktemp("docs"), rows)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return fixtures.write(spark, tmp_path_factory.mktemp("odd"), fixtures.edge_rows(), extra=True)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return fixtures.write(spark, tmp_path_factory.mktemp("empty"), [], extra=True)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


class Sets:
    def __init__(self, n):
        self.p = list(range(n))

    def find(self, x):
        while self.p[x] != x:
            x = self.p[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.p[max(a, b)] = min(a, b)


# ---------------------------------------------------------------- 1


def plain_fingerprint(text, k=3):
    w = WORD.findall(lower(text))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark, rows, folder):
    fps = [plain_fingerprint(r[1]) for r in rows]
    sets = Sets(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                sets.join(i, j)
    out = by_id(simhash.op1_simhash(spark, folder))
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in out.items()} == {r[0]: (f"{fps[k]:016x}", rows[sets.find(k)][0]) for k, r in enumerate(rows)}


@pytest.mark.parametrize("leaf", [3, 4096])
def test_hamming_links_at_any_depth(spark, leaf):
    import random

    rng = random.Random(5)
    fps = []
    for _ in range(40):
        x = rng.getrandbits(64)
        fps += [x] + [x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for _ in range(6)]
    fps = sorted(set(fps))
    sets = Sets(len(fps))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                sets.join(i, j)
    signed = [simhash._signed(f) for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    from sigloom.llm._common import components

    got = {r.node: r.root for r in components(simhash.links(df, 2, leaf)).collect()}
    groups = defaultdict(set)
    for k, f in enumerate(signed):
        groups[sets.find(k)].add(f)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(x for x in got if got[x] == r) for r in set(got.values())}


def test_gray_rank_orders_neighbours():
    import numpy as np

    x = np.arange(256, dtype=np.uint64)
    codes = x ^ (x >> np.uint64(1))
    assert (simhash.gray_rank(codes) == x).all()


# ---------------------------------------------------------------- 1, as the stage


def plain_near(rows, k=5, least=0.8):
    """doc_ids that stay."""
    sets = []
    for r in rows:
        w = lower(r[1]).split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if WORD.findall(r[1] or "") else set())
    joined = Sets(len(rows))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) >= least * len(a | b) > 0:
                joined.join(i, j)
    return sorted({rows[joined.find(k)][0] for k in range(len(rows))})


@pytest.mark.parametrize("leaf", [2, 2048])
def test_near_dedup(spark, rows, folder, leaf):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = near.near_dedup(docs, leaf=leaf)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == plain_near(rows)


# ---------------------------------------------------------------- 2


def test_quality_base(spark, rows, folder):
    out = by_id(quality.op2_quality(spark, folder))
    for i, text, *_ in rows:
        w = WORD.findall(text or "")
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + d for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines, seen = 0, set()
        for x in (text or "").split("\n"):
            if WORD.search(x):
                lines += x in seen
                seen.add(x)
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), lines, len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and (not r.base_failed or not r.kept)


def test_host_verdicts(spark, tmp_path):
    """A host whose documents nearly all fail loses the rest; one bad document says little about a small host."""
    good = " ".join(f"word{k}" for k in range(60))
    junk = " ".join(f"word{k} ### $$$" for k in range(60))
    rows = [(k, junk if k % 20 else good, "aa", "bad", 0) for k in range(200)] + [(1000 + k, good, "aa", f"h{k % 10}", 0) for k in range(400)]
    rows += [(5000, junk, "aa", "tiny", 0), (5001, good, "aa", "tiny", 0), (6000, good, "aa", None, 0)]
    out = by_id(quality.op2_quality(spark, fixtures.write(spark, tmp_path, rows)))
    assert not any(out[k].kept for k in range(200)) and all(out[1000 + k].kept for k in range(400))
    assert out[5001].kept and out[6000].kept
    rates = {r.source: r for r in quality.host_rates(quality.scored(spark.read.parquet(f"{tmp_path}/documents.parquet"), "source")).collect()}
    assert 0 < rates["h0"].rate_any < 0.1 and rates["bad"].rate_any > 0.85 and rates["tiny"].rate_any < rates["bad"].rate_any


# ---------------------------------------------------------------- 4


def test_mixing(spark, rows, folder):
    out = by_id(mixing.op4_mixing(spark, folder))
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    assert {i: r["size"] for i, r in out.items()} == size
    total = Counter()
    for r in rows:
        total[r[3]] += size[r[0]]
    names = sorted((s for s in total if s), key=lambda s: s.encode()) + [None] * (None in total)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full, target = set(), {}
    while True:
        level = (1.5 * sum(total.values()) - sum(2 * total[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and level * weight[s] >= 2 * total[s]}
        if not more:
            break
        full |= more
    target = {s: 2.0 * total[s] if s in full else level * weight[s] for s in names}
    taken = Counter()
    for r in rows:
        o = out[r[0]]
        assert o.target == pytest.approx(target[r[3]]) and o.source_size == total[r[3]] and o.taken in (0, size[r[0]], 2 * size[r[0]])
        taken[r[3]] += o.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= max(size[r[0]] for r in rows if r[3] == s)
    again = by_id(mixing.op4_mixing(spark, folder))
    assert {i: r.taken for i, r in again.items()} == {i: r.taken for i, r in out.items()}


def test_mixing_is_fair(spark):
    """Over many seeds a document is taken as often as its probability says."""
    rows = spark.createDataFrame([(k, k * 7 + 1, "s", 10 + k % 5) for k in range(200)], "rid long, key long, source string, size long").cache()
    taken = Counter()
    df = rows.select("rid", "key", "source", F.col("size").alias("w"), F.lit(0.3).alias("p"), F.lit(200).cast("long").alias("n"))
    for seed in range(6):
        got = mixing.pivotal_round(df, seed, 200).collect()
        assert len(got) == 200 and abs(sum((10 + r.rid % 5) * r.taken for r in got) - 0.3 * sum(10 + k % 5 for k in range(200))) <= 14
        for r in got:
            taken[r.rid] += r.taken
    assert 0.2 < sum(taken.values()) / 1200 < 0.4 and len([k for k in taken if taken[k]]) > 120


# ---------------------------------------------------------------- 5


@pytest.mark.parametrize("chunk_bytes, entries, start", [(1 << 20, 1_000_000, 4), (700, 40, 4), (700, 40, 1), (5000, 300, 13)])
def test_substring(spark, rows, folder, chunk_bytes, entries, start):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = by_id(substring.repeated_windows(docs, 13, chunk_bytes, entries, start))
    first = {}
    texts = [(r[0], WORD.findall(r[1] or "")) for r in rows]
    for i, w in texts:
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, w in texts:
        gone = {k + d for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for d in range(13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (out[i].n_words, out[i].n_removed, out[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_windows_double_until_none_survive(spark, tmp_path):
    assert substring.levels(13, 4) == [4, 8, 13] and substring.levels(13, 1) == [1, 2, 4, 8, 13] and substring.levels(8, 4) == [4, 8] and substring.levels(3, 4) == [3]
    alone = [(k, " ".join(f"w{k}_{j}" for j in range(40)), "aa", "s0", 0) for k in range(6)]
    docs = spark.read.parquet(f"{fixtures.write(spark, tmp_path, alone)}/documents.parquet")
    assert {(r.n_words, r.n_removed) for r in substring.repeated_windows(docs).collect()} == {(40, 0)}


def test_documents_are_dealt_out_once(spark, rows, folder):
    """No exchange over the chunks in the last cogroup: the bucketed table is read as it lies."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = substring.repeated_windows(docs)._jdf.queryExecution().executedPlan().toString()
    cogroup = plan[plan.index("FlatMapCoGroups") :]
    assert "Bucketed: true" in cogroup and cogroup.count("Exchange hashpartitioning(chunk") == 1


# ---------------------------------------------------------------- 6


def test_language_on_held_out_documents(spark, data):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    out = [r for r in langid.op6_langid(spark, data).collect()]
    assert len(out) == len(lang) and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    seen = [r for r in out if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in seen) >= 0.97 * len(seen)


def test_mixture_of_languages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = langid.train(docs)
    per = {r.lang: r.text for r in docs.where("length(text) > 2000").dropDuplicates(["lang"]).collect()}
    a, b = per["en"][:1500], per["de"][:1500]
    top, score, langs, shares = model.infer(a + " " + b)
    assert set(langs) == {"en", "de"} and sum(shares) == pytest.approx(1, abs=1e-6) and min(shares) > 0.3
    assert model.infer(a)[2] == ["en"] and model.infer("12 !? 3")[0] == "und" and model.infer(None)[1] == 0.0


# ---------------------------------------------------------------- 7


@pytest.fixture(scope="module")
def private(spark, tmp_path_factory):
    texts = [
        "write to anna.k@mail.example.org or ANNA.K@MAIL.EXAMPLE.ORG now", "call +1 (222) 555-7713, +1 (222) 555-7713!", "card 4111111111111111 and 4111 1111 1111 1111, not 4111111111111112", "at 10.1.2.3 and 8.8.4.4, version 1.2.3.4.5 or 300.1.1.1",
        'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" TOKEN 24BE64439E3E49CF46B2D7C90F3602A3D0B907FF', "Mrs. Clara Schmidt met Herr Bruno Weiß and Mrs. Clara Schmidt; Г-н Иван Петров", "nothing private here 12345 2024-01-02", "", None,
        "DE89 3704 0044 0532 0130 00 and DE89370400440532013000",
    ]
    path = fixtures.write(spark, tmp_path_factory.mktemp("pii"), [(k, t, "aa", "s", 0) for k, t in enumerate(texts)])
    return texts, {i: (r.text, r.n_pii) for i, r in by_id(pii.op7_pii(spark, path)).items()}


def test_surrogates(private):
    texts, out = private
    for gone in ("anna.k", "ANNA.K", "555-7713", "4111111111111111", "4111 1111", "10.1.2.3", "8.8.4.4", "24be64", "24BE64", "Schmidt", "Weiß", "Иван", "Петров", "DE89"):
        assert not any(gone in (t or "") for t, _ in out.values()), gone
    assert out[6] == (texts[6], 0) and out[7] == ("", 0) and out[8] == (None, 0)
    assert "4111111111111112" in out[2][0] and "1.2.3.4.5" in out[3][0] and "300.1.1.1" in out[3][0]


def test_surrogates_refer_to_one_another(private):
    _, out = private
    low, up = re.findall(r"\S+@\S+", out[0][0])
    assert low.upper() == up and re.fullmatch(r"[a-z]{4}\.[a-z]@\w+\.example\.org", low)
    a, b = re.findall(r"\+\d \(\d{3}\) \d{3}-\d{4}", out[1][0])
    assert a == b and a.startswith("+1")
    plain, spaced = re.findall(r"4\d{15}", out[2][0])[0], re.findall(r"\d{4} \d{4} \d{4} \d{4}", out[2][0])[0]
    assert plain == spaced.replace(" ", "")
    digits = [int(c) for c in plain[::-1]]
    assert sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0
    inside, outside = re.findall(r"\d+(?:\.\d+){3}", out[3][0])[:2]
    assert inside.startswith("10.") and not outside.startswith("10.") and all(int(x) < 256 for x in (inside + "." + outside).split("."))
    h, H = re.findall(r"\b[0-9a-fA-F]{40}\b", out[4][0])
    assert h.upper() == H and h == h.lower()
    women = re.findall(r"Mrs\. (\w+) (\w+)", out[5][0])
    assert women[0] == women[1] and women[0][0] in pii.NAMES["f", "latin"]
    assert re.search(r"Herr (\w+) ", out[5][0])[1] in pii.NAMES["m", "latin"] and re.search(r"Г-н (\w+) ([А-Я][а-я]+)", out[5][0])[1] in pii.NAMES["m", "cyrillic"]
    one, two = out[9][0].split(" and ")
    assert one.replace(" ", "") == two and re.fullmatch(r"DE\d{2}( \d{4}){4} \d\d", one)


def test_surrogates_stay_distinct(spark):
    """More persons than the names allow without a second try."""
    ents = spark.createDataFrame([("person", f"f:{chr(65 + k % 26)}{chr(97 + k // 26)}") for k in range(300)] + [("ip", f"8.8.{k % 8}.{k // 8}") for k in range(400)], "kind string, canon string")
    got = pii.surrogate_table(ents).collect()
    assert len(got) == 700 and len({(r.kind, r.new) for r in got}) == 700
    assert not {(r.kind, r.new) for r in got} & {(r.kind, r.canon) for r in got}


# ---------------------------------------------------------------- 8


def plain_exact(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    return {i: (min(g)[1], len(g), min(g)[1] == i, hashlib.sha256(x.encode()).hexdigest()) for x, g in groups.items() for _, i in g}


def test_exact_dedup(spark, rows, folder):
    out = {i: tuple(r)[1:] for i, r in by_id(exact_dedup.op8_exact_dedup(spark, folder)).items()}
    assert out == plain_exact(rows)


def test_digest_index_persists(spark):
    index = exact_dedup.DigestIndex(spark, "test_digests", 3)
    index.drop()
    batch = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    kept = lambda df: sorted(r.doc_id for r in exact_dedup.exact_dedup(df, exact_dedup.DigestIndex(spark, "test_digests", 3)).collect())
    assert kept(batch((1, "a b"), (2, "ab "), (3, "c"), (4, None), (5, ""))) == [1, 3, 4]
    spark.sql("DROP TABLE test_digests")  # as a later session, which knows only the files
    assert kept(batch((6, "ab"), (7, "d"), (8, "d"))) == [7]
    assert exact_dedup.DigestIndex(spark, "test_digests").buckets == 3 and spark.table("test_digests").count() == 4
    plan = spark.table("test_digests").alias("x").join(spark.table("test_digests").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


# ---------------------------------------------------------------- 9


@pytest.mark.parametrize("capacity, per_source", [(64, 2), (2048, 8)])
def test_packing(spark, rows, folder, capacity, per_source):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = packing.pack(docs, capacity, per_source, pack_size=40).collect()
    text = {r[0]: re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in rows}
    source = {r[0]: r[3] for r in rows}
    words = Counter()
    bins = defaultdict(list)
    for r in out:
        words[r.doc_id] += r.n_words
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    assert words == Counter({r[0]: len(WORD.findall(r[1] or "")) for r in rows})
    for b in bins.values():
        b.sort(key=lambda r: r.bin_offset)
        assert [r.bin_offset for r in b] == [sum(x.n_words for x in b[:k]) for k in range(len(b))] and sum(r.n_words for r in b) <= capacity
        assert len({text[r.doc_id] for r in b}) == len(b) and max(Counter(source[r.doc_id] for r in b).values()) <= per_source


def test_best_fit_takes_the_tightest_bin_that_agrees():
    bins = packing.Bins(10, 2)
    assert [bins.place(n, c, s) for n, c, s in ((7, 0, 0), (6, 1, 0), (3, 0, 1), (3, 2, 0), (1, 1, 0))] == [(0, 0), (1, 0), (1, 6), (0, 7), (2, 0)]


# ---------------------------------------------------------------- 10


def test_sharding(spark, rows, folder):
    out = sharding.op10_sharding(spark, folder).collect()
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    slots = defaultdict(list)
    for r in out:
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]), "rows", None)
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_bounded_loads_and_movement(spark):
    rows = spark.range(4000).withColumnRenamed("id", "doc_id")
    at = lambda k, eps: {r.doc_id: r.shard for r in sharding.shard_bounded(rows, "doc_id", k, 64, eps).collect()}
    eight, nine = at(8, 0.1), at(9, 0.1)
    assert max(Counter(eight.values()).values()) <= 550 and len(eight) == 4000
    assert sum(eight[k] != nine[k] for k in eight) < 0.35 * 4000
    keys = sharding.shard_by_key(rows, "doc_id", 8, 64).collect()
    assert all(r.shard == r.grown_shard or r.grown_shard == 8 for r in keys) and any(r.grown_shard == 8 for r in keys)
    assert sharding.walk({}, 8, 64, 0.0) == []


# ---------------------------------------------------------------- odd and empty tables


DOCUMENT_QUERIES = sorted(k for k in queries() if k not in ("op3_html", "op12_hard_negatives", "op13_phrases"))  # of the last two: test_mining.py


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_odd_rows(spark, odd, name):
    out = queries()[name](spark, odd).collect()
    assert len(out) >= len(fixtures.edge_rows()), name


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_empty_tables(spark, empty, name):
    assert queries()[name](spark, empty).count() == 0


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, odd, empty, stage):
    f = dict(corpus_pipeline.STAGES)[stage]
    for path, n in ((odd, len(fixtures.edge_rows())), (empty, 0)):
        docs = spark.read.parquet(f"{path}/documents.parquet")
        for given in (docs, docs.where("true").select("*").union(docs.limit(0))):  # files, and a table that is none
            out = f(spark, given, path)
            rows = out.collect()
            assert stage == "packing" or out.columns == docs.columns
            assert len(rows) == 0 if not n else stage == "quality" or len(rows) > 0


def test_columns_of_any_name_stay(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet").drop("shard", "slot")
    for out in (pii.replace_pii(docs).drop("n_pii"), sharding.shard_bounded(docs, "doc_id", 4).drop("shard", "slot"), sharding.shard_by_key(docs, "doc_id", 4).drop("shard", "grown_shard")):
        assert out.columns == docs.columns and out.count() == docs.count() and out.where("digest <> 'mine' OR _rid <> 'mine' OR _cell <> 'mine'").count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, rows, folder):
    """Stage by stage: quality, exact and near copies as plain versions have them; mix and packing whole."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    now = [r for r in rows]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder)
        if name != "packing":
            path = f"{folder}/{name}.parquet"
            docs.write.mode("overwrite").parquet(path)
            docs = spark.read.parquet(path)
        ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
        if name == "quality":
            kept = {i for i, r in by_id(quality.op2_quality(spark, folder)).items() if r.kept}
            now = [r for r in now if r[0] in kept]
        elif name == "exact_dedup":
            keep = plain_exact(now)
            now = [r for r in now if keep[r[0]][2]]
        elif name == "near_dedup":
            stay = set(plain_near(now))
            now = [r for r in now if r[0] in stay]
        elif name == "mixing":
            assert set(ids) <= {r[0] for r in now} and max(Counter(ids).values()) <= 2
            continue
        else:
            words = sum(r.n_words for r in docs.collect())
            assert words == sum(len(WORD.findall(r.text or "")) for r in before.collect())
            continue
        assert ids == sorted(r[0] for r in now), name
