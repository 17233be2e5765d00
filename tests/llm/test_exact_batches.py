"""The registered query of exact dedup uses its index: the second batch is anti-joined to what the first one left."""

from __future__ import annotations

from sigloom.llm import exact_dedup

from . import fixtures


def test_query_goes_through_the_index(spark, tmp_path, monkeypatch):
    texts = ["a b c d e f", "abc def", "abcdef", "long text " * 9, "x", "", None, "x"]
    folder = fixtures.write(spark, tmp_path, [(k, t, "aa", "s", 0) for k, t in enumerate(texts)])
    known, append = [], exact_dedup.DigestIndex.append

    def watched(self, winners, batch):
        known.append(self.exists())
        out = append(self, winners, batch)
        self_rows.append(spark.table(self.table).select("digest").collect())
        return out

    self_rows = []
    monkeypatch.setattr(exact_dedup.DigestIndex, "append", watched)
    rows = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.op8_exact_dedup(spark, folder).collect()}
    assert known == [False, True]
    assert rows == {0: (0, 3, True), 1: (0, 3, False), 2: (0, 3, False), 3: (3, 1, True), 4: (4, 2, True), 7: (4, 2, False), 5: (5, 2, True), 6: (5, 2, False)}
    last = [bytes(r.digest) for r in self_rows[-1]]
    assert len(last) == len(set(last)) == 4  # each text once, though batches share one


def test_a_batch_run_again_gives_the_same_rows(spark):
    """Also one whose job died after the index was written, or in the middle of that."""
    index = lambda: exact_dedup.DigestIndex(spark, "test_again", 3)
    index().drop()
    docs = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c"), (4, "d")], "doc_id long, text string")
    kept = lambda df, **more: sorted(r.doc_id for r in exact_dedup.exact_dedup(df, index(), **more).collect())
    exact_dedup.exact_dedup(docs, index())  # never used
    assert spark.table("test_again").count() == 3
    assert kept(docs) == [1, 3, 4] and kept(docs) == [1, 3, 4] and spark.table("test_again").count() == 3
    assert kept(docs, batch="another") == [] and kept(docs.where("doc_id = 3")) == []
    index().drop()
    exact_dedup.exact_dedup(docs.limit(3), index(), batch="half")  # as if the rest had not been written
    assert kept(docs, batch="half") == [1, 3, 4] and spark.table("test_again").count() == 3


def test_the_plan_of_a_batch_is_an_anti_join_by_sort_merge(spark):
    index = exact_dedup.DigestIndex(spark, "test_plan", 3)
    index.drop()
    index.create("bigint")
    spark.createDataFrame([(b"x", 1, 1, "old")], "digest binary, keep_id long, keep_len long, batch string").write.format("parquet").mode("append").bucketBy(3, "digest").sortBy("digest").option("path", index.location).saveAsTable("test_plan")
    new = index.unseen(spark.createDataFrame([(b"x", 5), (b"y", 6)], "digest binary, win_id long"))
    assert [r.win_id for r in new.collect()] == [6]
    plan = new._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and plan.count("Exchange") == 1  # of the batch alone, not of the index


def test_batches_agree_with_one(spark, tmp_path):
    rows = fixtures.sample(200, seed=9)
    docs = spark.read.parquet(f"{fixtures.write(spark, tmp_path, rows)}/documents.parquet")
    stays = []
    for n in (1, 2, 5):
        index = exact_dedup.query_index(spark, "test")
        stays.append(sorted(r.doc_id for r in exact_dedup.exact_dedup(docs, index, batches=n).collect()))
        assert index.exists()
        index.drop()
        assert not index.exists()
    assert stays[0] == stays[1] == stays[2]
