"""Near dedup where many texts share much: masses of copies, templates, common passages."""

from __future__ import annotations

import random

from sigloom.llm import near


def fresh(rng, n, mark="w"):
    return [f"{mark}{rng.getrandbits(60):x}" for _ in range(n)]


def kept(spark, texts, **options):
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(8)
    return sorted(r.doc_id for r in near.near_dedup(df, **options).collect())


def test_mass_of_varied_copies_is_joined_whole(spark):
    """5,000 copies of one text, each with a similarity of 90 / 110 to it and most of less to each other: one row stays."""
    rng = random.Random(5)
    base, copies = fresh(rng, 104), []
    for _ in range(5000):
        copy = list(base)
        for at in (rng.randrange(5, 45), rng.randrange(55, 98)):  # each word is in five shingles
            copy[at] = fresh(rng, 1)[0]
        copies.append(copy)
    assert kept(spark, [base, *copies]) == [0]


def on_template(rng, template, own, shared=()):
    """A text of a template, a tail that it shares with some, and words of its own."""
    return [*template, *shared, *fresh(rng, own - len(shared))]


def test_pair_among_many_that_are_nearly_similar(spark):
    """Texts of one template (similarity 0.755 to each other) hide pairs that have 0.82: those are found, no others."""
    rng = random.Random(6)
    template = fresh(rng, 404)
    texts = [on_template(rng, template, 65) for _ in range(900)]
    for _ in range(50):
        tail = fresh(rng, 20)
        texts += [on_template(rng, template, 65, tail) for _ in range(2)]
    assert kept(spark, texts) == sorted([*range(900), *range(900, 1000, 2)])


def test_pairs_within_a_common_passage(spark):
    """Near copies are found in nodes that are large since all texts share one passage."""
    rng = random.Random(7)
    passage = fresh(rng, 304)
    texts = [on_template(rng, passage, 200) for _ in range(600)]
    copies = [[*t[:460], *fresh(rng, 44)] for t in texts[:60]]  # 456 / 544
    assert kept(spark, [*texts, *copies], leaf=16) == list(range(600))


def test_no_link_rests_on_fingerprints_alone(spark):
    """2,000 texts of one template, of similarity 0.787 at most: by fingerprints some would pass, but all stay."""
    rng = random.Random(8)
    template = fresh(rng, 404)
    texts = [on_template(rng, template, 54) for _ in range(2000)]  # 400 / 508
    assert kept(spark, texts) == list(range(2000))
