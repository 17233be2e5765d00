"""Surrogates of persons in any script, and of persons named again without a title."""

from __future__ import annotations

import re

import pytest

from sigloom.llm import pii


@pytest.fixture(scope="module")
def told(spark):
    texts = ["Mrs Żądło met Herr Şimşek", "Mr Źł, Г-н Її and Mr Աբգ", "Mr John Smith came. John Smith and Smith left, John too; Smithson, smith and Johnny stay", "Tell Smith that John is not known here", "John Smith wrote this"]
    rows = pii.replace_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.doc_id: (r.text, r.n_pii) for r in rows}


def test_letters_of_any_script_change(told):
    assert not set("Żąłżş") & set(told[0][0]) and "Şimşek" not in told[0][0] and re.fullmatch(r"Mrs [A-Z][a-z]{4} met Herr [A-Z][a-z]{5}", told[0][0])
    assert re.fullmatch(r"Mr [A-Z][a-z], Г-н [А-Я][а-я] and Mr [Ա-Ֆ][ա-ֆ]{2}", told[1][0])


def test_names_that_are_all_taken_get_longer(spark):
    ents = spark.createDataFrame([("person", f"m:{chr(65 + k)}'") for k in range(26)], "kind string, canon string")
    got = pii.surrogate_table(ents).collect()
    assert len({r.new for r in got}) == 26 and not {r.new for r in got} & {r.canon for r in got}


def test_persons_named_again_without_title(told):
    text, n = told[2]
    first, last = re.match(r"Mr (\w+) (\w+) came", text).groups()
    assert (first, last) != ("John", "Smith") and last != "Smith"
    assert text == f"Mr {first} {last} came. {first} {last} and {last} left, {first} too; Smithson, smith and Johnny stay" and n == 4
    assert told[3] == ("Tell Smith that John is not known here", 0)
    assert told[4] == (f"{first} {last} wrote this", 1)  # a listed given name and a surname, the same person


def test_introduced_persons(spark):
    texts = ["My name is Anna Kowalska and I live here", "Dear Anna, hello", "Contact Zbigniew Nowak at once. Nowak knows", "Dear Customer, contact Support or Sales", "je m'appelle Zoé Dupond", "Mein Name ist Uwe Kranz"]
    out = {r.doc_id: (r.text, r.n_pii) for r in pii.replace_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    first, last = re.fullmatch(r"My name is ([A-Z]\w+) ([A-Z]\w+) and I live here", out[0][0]).groups()
    assert first in pii.NAMES["f", "latin"] and last != "Kowalska"
    assert re.fullmatch(r"Dear [A-Z]\w+, hello", out[1][0]) and "Anna" not in out[1][0]
    assert re.fullmatch(r"Contact ([A-Z]\w+) ([A-Z]\w+) at once. \2 knows", out[2][0]) and "Nowak" not in out[2][0]
    assert out[3] == (texts[3], 0)
    assert "Zoé" not in out[4][0] and "Dupond" not in out[4][0] and "Kranz" not in out[5][0]
