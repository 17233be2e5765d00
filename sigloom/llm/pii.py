"""Surrogates for personal data (operator 7). DataFrame functions only.

Entities are e-mail, IP (4 and 6) and MAC addresses, phone, card and social security numbers, IBANs, secrets (long
hexadecimal strings, keys of common services, web tokens, private keys, what follows password= and the like) and person
names: behind a title, behind words that introduce a person (CUES) if there are two of them, or two words of which the
first is a listed given name. Each is brought
to a canonical form (case, separators and titles do not count), and each canonical form gets a surrogate of its type
from a keyed hash: digits for digits with the same grouping (a card, an IBAN and a social security number stay valid, a
phone number keeps its country code, an address keeps to octets, private ones stay private), letters for letters in the same script and case, given names from a
list of the same gender and script. Equal entities get equal surrogates wherever they stand (coreference). A person is
two entities, the given name and the surname, so "Mr Smith", "Mr JOHN SMITH" and "John Smith" stay one person, and a
family keeps one name. A letter of a script without a pool here becomes a Latin one of its case. In a document that names
a person with a title, the name and each of its words are replaced without the title too.

Different entities get different surrogates: in rounds, a surrogate that two entities of any type share, or that is
itself an entity of the corpus, stays with one of them at most and the others are hashed anew with a higher attempt
number. From some attempt on surrogates grow (an IP address becomes one of version 6, numbers and keys get more digits),
so rounds end however full a form is. Addresses of version 6 and private keys have more forms than a corpus has rows.

Only documents with entities are shuffled; the text of the others passes through. An entity in a third of all rows is
one row of the table of entities (pre-aggregated), and its join with the mentions may be split. A very long text is one
row; its mentions are looked up by joins, not within the row.

Defined results: a null text stays null, an empty one empty; equal rows get equal texts, so ties cannot differ; a null id
is kept as it is; a column n_pii is replaced, all other names pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm._common import as_row, discard, materialize, read_table, with_row_id

KEY = "surrogate-key"

#: Titles by gender (n: either), and given names by gender and script.
TITLES = {
    "m": ["Mr", "Mister", "Sir", "Herr", "Sr", "Señor", "Monsieur", "Г-н", "Господин"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Sra", "Señora", "Madame", "Mme", "Mlle", "Г-жа", "Госпожа"],
    "n": ["Dr", "Doctor", "Doktor", "Prof", "Professor"],
}
NAMES = {
    ("m", "latin"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Noah Oscar Paul Robert Simon Thomas Victor".split(),
    ("f", "latin"): "Alice Bertha Clara Diana Emma Flora Grace Helena Irene Julia Karla Laura Maria Nora Olga Paula Rosa Sofia Teresa Vera".split(),
    ("n", "latin"): "Alex Andrea Ariel Ashley Casey Charlie Dana Devin Eden Jamie Jordan Kim Lee Morgan Noel Quinn Robin Sam Sascha Toni".split(),
    ("m", "cyrillic"): "Алексей Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Сергей Тимур".split(),
    ("f", "cyrillic"): "Алиса Белла Вера Галина Дарья Елена Жанна Ирина Ксения Лидия Мария Нина Ольга Полина Раиса Софья".split(),
    ("n", "cyrillic"): "Валя Женя Саша Слава Шура".split(),
}

#: What introduces a person by name.
CUES = ["My name is", "my name is", "My name's", "my name's", "Mein Name ist", "mein Name ist", "Je m'appelle", "je m'appelle", "Me llamo", "me llamo", "Mi nombre es", "mi nombre es", "Dear", "Liebe", "Lieber", "Chère", "Cher", "Estimada", "Estimado", "Contact", "contact", "Signed,", "Regards,", "regards,"]
#: More given names, by gender, that are seldom other words: a name of two words needs no title if it begins with one.
GIVEN = {
    "m": "Alexander Andrew Anthony Benjamin Brian Christopher Daniel Edward Francisco François Gustav Hans Heinrich James Javier Jean John José Joseph Juan Jürgen Kevin Klaus Luis Manuel Michael Miguel Patrick Peter Philippe Pierre Richard Stefan Stephen Timothy Wilhelm William Wolfgang".split(),
    "f": "Amanda Anna Barbara Carmen Catherine Céline Christine Deborah Dorothy Elizabeth Emily Françoise Gabriele Ingrid Isabelle Jennifer Jessica Karen Katharina Linda Lisa Lucía Margaret Mary Michelle Monique Nancy Patricia Rebecca Sabine Sandra Sarah Stephanie Susan Ursula".split(),
}
#: Countries' calling codes, by their beginnings.
_CALLING = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

_W = r"\p{L}\p{N}"


def _any_word(words: set[str]) -> str:
    """One of the words, longer ones first, by their first letters: at most places one look ahead is all."""
    first: dict[str, list[str]] = {}
    for w in sorted(words, key=lambda w: (-len(w), w)):
        first.setdefault(w[0], []).append(w[1:])
    return f"(?=[{''.join(sorted(first))}])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(first.items())) + ")"


def _one_of(titles: list[str]) -> str:
    # in capitals too, but for "MS", which is more often something else
    return _any_word({x for t in titles for x in (t, t if t == "Ms" else t.upper())})


_TITLE = _one_of([t for row in TITLES.values() for t in row])
_BEFORE = rf"(?:{_TITLE}\.? ){{1,3}}(?:\p{{Lu}}\. ?){{0,3}}"
_CUE = _any_word(set(CUES)) + " "
#: Given names that are common words as well need a title.
_LISTED = _any_word({n for (g, script), row in NAMES.items() if g != "n" and script == "latin" for n in row} - {"Grace", "Rosa", "Victor", "Flora"} | {n for row in GIVEN.values() for n in row})
#: What stands before a name in a mention.
_LEAD = rf"(?:{_BEFORE}|{_CUE})"
_NAME = r"(?:\p{Lu}\p{L}{1,30}+|\p{Lu}(?=['’]))(?:['’\-](?!s(?![\p{L}\p{N}]))\p{L}{1,30}+){0,2}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_H = r"[0-9A-Fa-f]{1,4}"
_LABEL = r"(?:(?i:password|passwd|pwd)[\"']?\s{0,2}(?:=|:(?=\s{0,2}[\"']?[^\s\"']{0,64}[\d!@#$%^&*_\-]))|(?i:secret|api[_\-]?key|access[_\-]?key|auth[_\-]?token|token)[\"']?\s{0,2}[=:](?=\s{0,2}[\"']?[^\s\"']{0,64}\d))\s{0,2}[\"']?"
_HEX = r"(?=[a-zA-Z]{0,127}+\d)(?:[0-9a-f]{32,128}+|[0-9A-F]{32,128}+)"
#: In the order in which they are tried at one place. All start where no letter or digit is before them; possessive
#: runs and bounded repeats keep the scan linear.
PATTERNS = {
    "email": rf"(?<![._%+\-])[{_W}_][{_W}._%+\-]{{0,63}}+@(?:[{_W}\-]{{1,63}}+\.){{1,126}}\p{{L}}{{2,24}}(?![{_W}])",
    "password": rf"(?=[pPsSaAtT]){_LABEL}(?![<{{$])[^\s\"'<>,;]{{4,128}}+",
    "key": rf"(?=[Agsx])(?:(?:AKIA|ASIA)[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{36,80}}+|sk-[A-Za-z0-9_\-]{{20,100}}+|xox[abprs]-[A-Za-z0-9\-]{{10,80}}+|AIza[0-9A-Za-z_\-]{{35}})(?![{_W}])",
    "private": r"(?=-----B)-----BEGIN (?:[A-Z]{2,12} ){0,3}PRIVATE KEY-----[A-Za-z0-9+/=\s\\:,]{16,16384}+-----END (?:[A-Z]{2,12} ){0,3}PRIVATE KEY-----",
    "jwt": r"(?=eyJ)eyJ[A-Za-z0-9_\-]{8,4096}+\.[A-Za-z0-9_\-]{8,8192}+\.[A-Za-z0-9_\-]{8,2048}+",
    "mac": rf"(?<![:\-])[0-9A-Fa-f]{{2}}(?:(?::[0-9A-Fa-f]{{2}}){{5}}|(?:-[0-9A-Fa-f]{{2}}){{5}})(?![{_W}:\-])",
    "ip": rf"(?<!\.)(?:{_OCTET}\.){{3}}{_OCTET}(?![{_W}]|\.\d)",
    "ipv6": rf"(?<!:)(?=[0-9A-Fa-f:]{{0,38}}\d)(?:(?:{_H}:){{7}}{_H}|(?:{_H}:){{1,6}}(?::{_H}){{1,6}})(?![{_W}:])",
    "iban": rf"[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?![{_W}])",
    "secret": rf"{_HEX}(?![{_W}])",
    "card": rf"(?<![.+])\d{{4}}(?:[ \-]?\d{{4}}){{2}}[ \-]?\d{{1,7}}(?![{_W}])",
    "ssn": rf"(?<![.+\-])(?!000|666|9\d\d)\d{{3}}-(?!00)\d{{2}}-(?!0000)\d{{4}}(?![{_W}]|-\d)",
    "phone": rf"(?:\+\d{{1,3}}[ .\-]?(?:\(\d{{1,4}}\)[ .\-]?)?\d{{2,4}}(?:[ .\-]?\d{{2,4}}){{1,4}}|\(\d{{3}}\)[ .\-]?\d{{3}}[ .\-]\d{{4}}|\d{{3}}[.\-]\d{{3}}[.\-]\d{{4}})(?![{_W}])",
    "person": rf"(?=\p{{Lu}}|m[eiy]|je |co|re)(?:{_BEFORE}{_NAME}(?: {_NAME})?|{_CUE}(?:{_NAME} {_NAME}|{_LISTED}(?![\p{{L}}\p{{N}}]))|{_LISTED} {_NAME})",
}
#: One look back for all, so most places of a text cost one step.
ANY = rf"(?<![{_W}])(?:" + "|".join(PATTERNS.values()) + ")"
#: A secret key's first letters tell whose it is.
_ISSUER = r"^(?:AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|AIza)"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, the last one counted once."""
    each = F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _mod97(iban: Column) -> Column:
    """The remainder of an IBAN without blanks, as its check digits are made: 1 if they are right."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    step = lambda a, c: F.when(c.rlike(r"^\d$"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(_chars(turned), F.lit(0), step)


def kind_of(mention: Column) -> Column:
    """The type of a mention; null if it is no entity after all (a long number that is no card)."""
    digits, whole = _digits(mention), {k: mention.rlike(f"^(?:{p})$") for k, p in PATTERNS.items()}
    card = whole["card"] & F.length(digits).between(13, 19)
    whole["card"] = card & (_luhn_sum(digits) % 10 == 0)
    whole["phone"] &= ~card
    whole["iban"] &= _mod97(F.regexp_replace(mention, " ", "")) == 1
    return reduce(lambda w, k: w.when(whole[k], F.lit(k)), list(whole)[1:], F.when(whole["email"], F.lit("email")))


def _value(mention: Column) -> Column:
    """What a label stands for."""
    return F.regexp_replace(mention, rf"^{_LABEL}", "")


def _expanded(ip: Column) -> Column:
    """An address of version 6 as eight groups of four digits."""
    side = lambda part: F.transform(F.filter(F.split(part, ":"), lambda g: g != ""), lambda g: F.lpad(F.lower(g), 4, "0"))
    left = side(F.substring_index(ip, "::", 1))
    right = F.when(ip.contains("::"), side(F.substring_index(ip, "::", -1))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(left, F.array_repeat(F.lit("0000"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right))), right), ":")


def _name_words(mention: Column) -> Column:
    return F.split(F.regexp_replace(mention, f"^{_LEAD}", ""), " ")


def _gender(mention: Column, given: Column) -> Column:
    listed = lambda g: F.array(*[F.lit(n.lower()) for (k, _), row in [*NAMES.items(), *(((k, ""), row) for k, row in GIVEN.items())] if k == g for n in row])
    titled = lambda g: mention.rlike(rf"^(?:{_TITLE}\.? )*{_one_of(TITLES[g])}\.? ")
    return F.when(titled("f"), "f").when(titled("m"), "m").when(F.array_contains(listed("f"), given), "f").when(F.array_contains(listed("m"), given), "m").otherwise("n")


def entities_of(kind: Column, mention: Column) -> Column:
    """(kind, canon) of the entities of a mention, in order: two for a person of two names, none if it is no entity."""
    ref = lambda k, canon: F.struct(k.alias("kind"), canon.alias("canon"))
    words = F.transform(_name_words(mention), lambda w: F.lower(w))
    given = F.concat(_gender(mention, words[0]), F.lit(":"), words[0])
    person = F.when(F.size(words) > 1, F.array(ref(F.lit("given"), given), ref(F.lit("surname"), words[1]))).otherwise(F.array(ref(F.lit("surname"), words[0])))
    value = _value(mention)
    hexed = value.rlike(f"^{_HEX}$")
    canon = F.when(kind.isin("card", "ssn"), _digits(mention)).when(kind == "phone", F.concat(F.regexp_extract(mention, r"^\+", 0), _digits(mention))).when(kind.isin("jwt", "private"), mention).when(kind == "mac", F.lower(F.regexp_replace(mention, "[:-]", ""))).when(kind == "iban", F.regexp_replace(mention, " ", "")).when(kind == "ipv6", _expanded(mention)).when(kind == "key", mention)
    canon = canon.when(kind == "password", F.when(hexed, F.lower(value)).otherwise(value)).otherwise(F.lower(mention))
    one = F.array(ref(F.when((kind == "password") & hexed, F.lit("secret")).otherwise(kind), canon))
    return F.when(kind.isNull(), F.array().cast("array<struct<kind:string,canon:string>>")).when(kind == "person", person).otherwise(one)


def _stream(seed: Column, n: int) -> list[Column]:
    """n independent hexadecimal strings of 64 digits from a seed."""
    return [F.sha2(F.concat(seed, F.lit(f"/{k}")), 256) for k in range(n)]


def _numbers(seed: Column) -> Column:
    """An array of 64 numbers from 0 to 255."""
    return F.transform(F.regexp_extract_all(F.concat(*_stream(seed, 2)), F.lit(".."), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("int"))


def _like(text: Column, numbers: Column) -> Column:
    """text with each letter and digit replaced by one of its own class: case, script and all else stay."""
    pools = ((r"\d", "0123456789"), (r"[a-zß-öø-ÿ]", "abcdefghijklmnopqrstuvwxyz"), (r"[A-ZÀ-ÖØ-Þ]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (r"[а-яё]", "абвгдежзийклмнопрстуфхцчшщэюя"), (r"[А-ЯЁ]", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЭЮЯ"), (r"[α-ω]", "αβγδεζηθικλμνξοπρστυφχψω"), (r"[Α-Ω]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"))
    # all other letters and digits, by script and case; the last ones take what has no pool
    pools += ((r"[\p{Lu}&&\p{IsCyrillic}]", pools[4][1]), (r"[\p{L}&&\p{IsCyrillic}]", pools[3][1]), (r"[\p{Lu}&&\p{IsGreek}]", pools[6][1]), (r"[\p{L}&&\p{IsGreek}]", pools[5][1]))
    pools += ((r"[\p{Lu}&&\p{IsArmenian}]", "ԱԲԳԴԵԶԷԸԹԺԻԼԽԾԿՀՁՂՃՄՅՆՇՈՉՊՋՌՍՎՏՐՑՓՔՕՖ"), (r"[\p{L}&&\p{IsArmenian}]", "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցփքօֆ"), (r"[\p{Lu}\p{Lt}]", pools[2][1]), (r"\p{L}", pools[1][1]), (r"\p{N}", pools[0][1]))

    def one(c: Column, i: Column) -> Column:
        n = F.element_at(numbers, (i % 64 + 1).cast("int"))
        pick = lambda pool: F.substring(F.lit(pool), n % len(pool) + 1, F.lit(1))
        return reduce(lambda w, p: w.when(c.rlike(f"^{p[0]}$"), pick(p[1])), pools[1:], F.when(c.rlike(f"^{pools[0][0]}$"), pick(pools[0][1]))).otherwise(c)

    return F.array_join(F.transform(_chars(text), one), "")


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The canonical form of the surrogate."""
    seed = F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string"))
    # worked out once: in the expressions below it is a variable
    return F.element_at(F.transform(F.array(F.struct(seed.alias("seed"), _numbers(seed).alias("num"))), lambda x: _made(kind, canon, attempt, x.seed, x.num)), 1)


def _cases(kind: Column, of: dict[str, Column], other: Column) -> Column:
    """By kind, one of these."""
    return reduce(lambda w, k: w.when(kind == k, of[k]), list(of)[1:], F.when(kind == next(iter(of)), next(iter(of.values())))).otherwise(other)


def _made(kind: Column, canon: Column, attempt: Column, seed: Column, num: Column) -> Column:
    """The surrogate of an entity: the part whose characters change in their classes, and what a form is longer by (so that
    there is always a surrogate left), are made first; they are variables in the expression of the form."""
    tail = lambda k: F.substring(canon, F.lit(k), F.length(canon))
    # a country's code stays, or the first digit of a number without one
    code = F.when(canon.startswith("+"), F.regexp_extract(canon, _CALLING, 0)).otherwise(F.substring(canon, 1, 1))
    text = {
        "email": F.substring_index(canon, "@", 1), "card": F.substring(canon, F.lit(2), F.length(canon) - 2), "iban": tail(5), "key": F.regexp_replace(canon, _ISSUER, ""), "phone": F.substring(canon, F.length(code) + 1, F.length(canon)),
        "jwt": F.element_at(F.split(canon, r"\."), 2), **dict.fromkeys(("ip", "ipv6", "ssn", "secret", "mac", "private", "given"), F.lit("")),
    }
    letter = F.when(canon.rlike(r"\p{IsCyrillic}"), "а").otherwise("a")
    longer = lambda sign, per, after=0: F.repeat(F.lit(sign) if isinstance(sign, str) else sign, F.greatest(F.lit(0), F.floor((attempt - after) / per)).cast("int"))
    more = {**dict.fromkeys(("card", "iban", "ssn", "secret", "key", "password", "phone", "mac"), longer("0", 8)), "given": longer(letter, 1, 2), **dict.fromkeys(("email", "ip", "ipv6", "jwt", "private"), F.lit(""))}
    parts = F.struct(_like(_cases(kind, text, canon), num).alias("main"), _like(_cases(kind, more, longer(letter, 4)), F.reverse(num)).alias("more"), code.alias("code"))
    return F.element_at(F.transform(F.array(parts), lambda p: _form(kind, canon, attempt, seed, num, p)), 1)


def _form(kind: Column, canon: Column, attempt: Column, seed: Column, num: Column, part: Column) -> Column:
    at = lambda k: F.element_at(num, k)
    digit = lambda k, n=10, low=0: (at(k) % n + low).cast("string")
    main, more = part.main, part.more
    digest = F.sha2(seed, 256)
    email = F.concat(main, F.lit("@"), F.substring(digest, F.lit(1), F.least(F.lit(40), 6 + attempt)), F.lit(".example."), F.element_at(F.split(canon, r"\."), -1))
    private = canon.rlike(r"^(?:10\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.)")
    first = F.when(private, F.lit(10)).otherwise(F.lit(11) + at(1) % 90)
    ipv6 = F.concat(F.lit("2001:0db8"), F.array_join(F.transform(F.regexp_extract_all(F.substring(digest, 1, 24), F.lit("...."), F.lit(0)), lambda g: F.concat(F.lit(":"), g)), ""))
    ip = F.when(attempt < 8, F.concat_ws(".", first.cast("string"), *[at(k).cast("string") for k in (2, 3, 4)])).otherwise(ipv6)
    body = F.concat(F.substring(canon, F.lit(1), F.lit(1)), main, more)
    card = F.concat(body, ((10 - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    account = F.concat(main, more)
    iban = F.concat(F.substring(canon, 1, 2), F.lpad((98 - _mod97(F.concat(F.substring(canon, 1, 2), F.lit("00"), account))).cast("string"), 2, "0"), account)
    ssn = F.concat(digit(1, 5, 1), digit(2), digit(3), digit(4, 9, 1), digit(5), digit(6, 9, 1), *[digit(k) for k in (7, 8, 9)], more)
    secret = F.concat(F.substring(F.concat(*_stream(seed, 2)), F.lit(1), F.length(canon)), more)
    token = F.concat(F.regexp_extract(canon, _ISSUER, 0), main, more)
    # addresses given out locally have 2 as their second digit
    mac = F.concat(F.substring(digest, 1, 1), F.lit("2"), F.substring(digest, 3, 10), more)
    # 64 numbers turn round in a long text, so the seed's digits stand in it as well
    jwt = F.concat(F.lit("eyJ"), F.substring(digest, 1, 32), F.lit("."), main, F.lit("."), F.substring(digest, 33, 32))
    private_key = F.concat(F.regexp_extract(canon, r"^-----BEGIN [A-Z ]*PRIVATE KEY-----\s*", 0), digest, F.regexp_extract(canon, r"\s*-----END [A-Z ]*PRIVATE KEY-----$", 0))
    gender, cyr = F.substring(canon, 1, 1), canon.rlike(r"\p{IsCyrillic}")
    names = {k: F.array(*[F.lit(n.lower()) for n in row]) for k, row in NAMES.items()}
    lists = reduce(lambda w, k: w.when((gender == k[0]) & (cyr if k[1] == "cyrillic" else ~cyr), names[k]), names, F.when(F.lit(False), names["n", "latin"])).otherwise(names["n", "latin"])
    given = F.concat(gender, F.lit(":"), F.element_at(lists, (at(64) % F.size(lists) + 1).cast("int")), more)
    forms = {"email": email, "ip": ip, "ipv6": ipv6, "card": card, "iban": iban, "ssn": ssn, "secret": secret, "key": token, "phone": F.concat(part.code, main, more), "given": given, "mac": mac, "jwt": jwt, "private": private_key}
    return _cases(kind, forms, F.concat(main, more))


def _fill(mention: Column, digits: Column) -> Column:
    """mention with its digits replaced by the given ones, in order; more digits go to the end."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))

    def step(a: Column, c: Column) -> Column:
        d = c.rlike(r"^\d$")
        return F.struct(F.concat(a.s, F.when(d, F.substring(digits, a.k, F.lit(1))).otherwise(c)).alias("s"), (a.k + d.cast("int")).alias("k"))

    return F.aggregate(_chars(mention), start, step, lambda a: F.concat(a.s, F.substring(digits, a.k, F.length(digits))))


def _grouped(mention: Column, flat: Column) -> Column:
    """flat with the blanks of mention; more characters go to the end."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))
    step = lambda a, c: F.struct(F.concat(a.s, F.when(c == " ", c).otherwise(F.substring(flat, a.k, F.lit(1)))).alias("s"), (a.k + (c != " ").cast("int")).alias("k"))
    return F.aggregate(_chars(mention), start, step, lambda a: F.concat(a.s, F.substring(flat, a.k, F.length(flat))))


def _paired(mention: Column, flat: Column) -> Column:
    """flat with the sign of mention between pairs of digits."""
    return F.call_function("array_join", F.regexp_extract_all(flat, F.lit("..?"), F.lit(0)), F.substring(mention, 3, 1))


def _upper(s: Column) -> Column:
    return (s == F.upper(s)) & (s != F.lower(s))


def _cased(word: Column, new: Column) -> Column:
    """new in the case of word: capitals where it has them, all over if it has nothing else."""
    high = lambda i: F.substring(word, i + 1, F.lit(1)).rlike(r"^\p{Lu}$")
    return F.when(_upper(word) & (F.length(word) > 1), F.upper(new)).otherwise(F.array_join(F.transform(_chars(new), lambda c, i: F.when(high(i), F.upper(c)).otherwise(c)), ""))


def written(kind: Column, mention: Column, new: Column) -> Column:
    """The canonical forms of a mention's surrogates in the format of the mention."""
    one = new[0]
    words = _name_words(mention)
    # a given name is one word with one capital, whatever the old one looked like
    name = F.when(F.size(words) > 1, F.concat(_cased(words[0], F.when(_upper(words[0]) & (F.length(words[0]) > 1), F.substring(one, F.lit(3), F.length(one))).otherwise(F.initcap(F.substring(one, F.lit(3), F.length(one))))), F.lit(" "), _cased(words[1], new[1]))).otherwise(_cased(words[0], one))
    person = F.concat(F.regexp_extract(mention, f"^{_LEAD}", 0), name)
    value = _value(mention)
    password = F.concat(F.substring(mention, F.lit(1), F.length(mention) - F.length(value)), F.when(_upper(value) & value.rlike(f"^{_HEX}$"), F.upper(one)).otherwise(one))
    shown = F.when(kind.isin("phone", "card", "ssn"), _fill(mention, F.ltrim(one, F.lit("+")))).when(kind.isin("jwt", "private"), one).when(kind == "mac", _paired(mention, F.when(mention.rlike("[A-F]"), F.upper(one)).otherwise(one))).when(kind == "iban", _grouped(mention, one)).when(kind == "person", person).when(kind == "password", password)
    return shown.when(kind == "key", one).when(_upper(mention), F.upper(one)).otherwise(one)


def _shown(kind: Column, canon: Column) -> Column:
    """What of a canonical form can be seen in a text."""
    return F.when(kind == "given", F.substring(canon, F.lit(3), F.length(canon))).otherwise(canon)


def surrogate_table(entities: DataFrame, key: str = KEY) -> DataFrame:
    """entities (kind, canon: distinct) with new: no two look alike, and none like an entity itself."""
    real = entities.select(_shown(F.col("kind"), F.col("canon")).alias("seen")).distinct().withColumn("real", F.lit(True))
    todo, done = entities.select("kind", "canon").withColumn("attempt", F.lit(0)), None
    while True:
        made = todo.withColumn("new", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key))
        tried = materialize(made.withColumn("seen", _shown(F.col("kind"), F.col("new"))), "tried")
        best = tried.groupBy("seen").agg(F.min(F.struct("kind", "canon")).alias("first"))
        if done is not None:
            best = best.join(done.select("seen"), "seen", "left_anti")
        best = best.join(real, "seen", "left").where("real IS NULL").select("seen", "first")
        won = materialize(tried.join(best, "seen").where("kind = first.kind AND canon = first.canon").select("kind", "canon", "new", "seen"), "won")
        done = won if done is None else done.unionByName(won)
        last = todo
        todo = materialize(tried.join(won.select("kind", "canon"), ["kind", "canon"], "left_anti").select("kind", "canon", (F.col("attempt") + 1).alias("attempt")), "again")
        discard(tried)
        discard(last)
        if todo.isEmpty():
            discard(todo)
            return materialize(done.select("kind", "canon", "new"), "surrogates")


def _any_of(forms: Column) -> Column:
    """The pattern of these words, longer ones first; null if there is none. Names have no signs that patterns use."""
    sizes = F.sort_array(F.array_distinct(F.transform(forms, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("old")))))
    return F.when(F.size(forms) > 0, F.concat(F.lit(rf"(?<![{_W}])(?:"), F.array_join(F.transform(sizes, lambda x: x.old), "|"), F.lit(rf")(?![{_W}])")))


def _forms(spots: Column) -> Column:
    """How the persons of a document may be written without a title: whole names and their words, in three cases."""
    people = F.transform(F.filter(spots, lambda x: x.kind == "person"), lambda x: _name_words(x.m))
    every = F.flatten(F.transform(people, lambda w: F.concat(F.array(F.array_join(w, " ")), w)))
    return F.array_distinct(F.flatten(F.transform(every, lambda w: F.array(w, F.upper(w), F.initcap(w)))))


def _untitled(piece: Column, names: Column, pattern: Column) -> Column:
    """(s, n): a piece of text with n names replaced. names: (given, old, new) of the document."""

    def renamed(word: Column, given: Column) -> Column:
        same = F.filter(names, lambda x: x.old == F.lower(word))
        fit = F.coalesce(F.try_element_at(F.filter(same, lambda x: x.given == given), F.lit(1)), F.try_element_at(same, F.lit(1)))
        plain = fit.given & ~(_upper(word) & (F.length(word) > 1))
        return F.coalesce(_cased(word, F.when(plain, F.initcap(fit.new)).otherwise(fit.new)), word)

    hits = F.regexp_extract_all(piece, pattern, F.lit(0))
    put = F.transform(hits, lambda m: F.array_join(F.transform(F.split(m, " "), lambda w, i: renamed(w, (i == 0) & m.contains(" "))), " "))
    woven = F.array_join(F.transform(F.split(piece, pattern, -1), lambda q, i: F.concat(q, F.coalesce(F.get(put, i), F.lit("")))), "")
    return F.when(pattern.isNull(), F.struct(piece.alias("s"), F.lit(0).alias("n"))).otherwise(F.struct(woven.alias("s"), F.size(hits).alias("n")))


def replace_pii(docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs with surrogates in text, and n_pii: how many mentions were replaced."""
    spots = F.transform(F.regexp_extract_all("text", F.lit(ANY), F.lit(0)), lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    has = F.col("text").rlike(ANY)
    rows = with_row_id(docs.where(has).select(as_row(docs), spots.alias("_spots")), "pii")
    each = rows.select("_rid", F.posexplode("_spots").alias("pos", "x")).select("_rid", "pos", F.posexplode_outer(entities_of(F.col("x.kind"), F.col("x.m"))).alias("part", "e"))
    own = materialize(each.select("_rid", "pos", "part", "e.kind", "e.canon"), "mentions")
    real = own.where("kind IS NOT NULL")
    table = surrogate_table(materialize(real.select("kind", "canon").distinct(), "entities"), key)
    told = materialize(real.join(table, ["kind", "canon"]), "told")
    given = F.col("kind") == "given"
    names = told.where(F.col("kind").isin("given", "surname")).groupBy("_rid").agg(F.collect_set(F.struct(given.alias("given"), _shown(F.col("kind"), F.col("canon")).alias("old"), _shown(F.col("kind"), F.col("new")).alias("new"))).alias("_names"))
    put = told.select("_rid", "pos", "part", "new").unionByName(own.where("kind IS NULL").select("_rid", "pos", "part", F.lit(None).cast("string").alias("new")))
    put = put.groupBy("_rid", "pos").agg(F.sort_array(F.collect_list(F.struct("part", "new"))).alias("news"))
    put = put.groupBy("_rid").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "news"))), lambda x: x.news.new).alias("_new"))
    rows = rows.join(put, "_rid").join(names, "_rid", "left")
    # a title with one word that the document has as a given name elsewhere: "Frau Maria" beside "Frau Maria Klein"
    known = F.coalesce("_names", F.array().cast("array<struct<given:boolean,old:string,new:string>>"))
    rows = rows.withColumn("_names", F.sort_array(known)).withColumn("_pattern", _any_of(_forms(F.col("_spots"))))

    def replaced(x: Column, i: Column) -> Column:
        word = _name_words(x.m)
        first = F.try_element_at(F.filter("_names", lambda n: n.given & (x.kind == "person") & (F.size(word) == 1) & (n.old == F.lower(word[0]))), F.lit(1)).new
        new = F.when(first.isNotNull(), F.array(first)).otherwise(F.element_at("_new", (i + 1).cast("int")))
        return F.coalesce(written(x.kind, x.m, new), x.m)

    rows = rows.withColumn("_put", F.transform("_spots", replaced))
    rows = rows.withColumn("_pieces", F.transform(F.split("_row.text", F.lit(ANY), -1), lambda p: _untitled(p, F.col("_names"), F.col("_pattern"))))
    woven = F.transform("_pieces", lambda p, i: F.concat(p.s, F.coalesce(F.get("_put", i), F.lit(""))))
    n = F.size(F.filter("_spots", lambda x: x.kind.isNotNull())) + F.aggregate("_pieces", F.lit(0), lambda a, p: a + p.n)
    names = [c for c in docs.columns if c.lower() != "n_pii"]
    rows = rows.select(*[F.array_join(woven, "").alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in names], n.cast("long").alias("n_pii"))
    rest = docs.where(~F.coalesce(has, F.lit(False))).select(*[F.col(f"`{c}`") for c in names], F.lit(0).cast("long").alias("n_pii"))
    return rows.unionByName(rest)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
