from __future__ import annotations

import random

import pytest

from tidemark.llm.names import lcs_length, lcs_ratio, link_people, read_person, same_person_pairs, token_roots


def pairs(spark, rows):
    df = spark.createDataFrame(rows, "value string, name string, mail string, machine boolean")
    return {tuple(r) for r in same_person_pairs(link_people(df, "value", "name", "mail", "machine")).collect()}


def slow_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            best[i][j] = best[i - 1][j - 1] + 1 if x == y else max(best[i - 1][j], best[i][j - 1])
    return best[-1][-1]


def test_lcs():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(9))) for _ in range(2))
        assert lcs_length(a, b) == slow_lcs(a, b)
    assert lcs_ratio("", "") == 1.0 and lcs_ratio("ab", "") == 0.0


def known(**forms):
    """What the corpus would know: formal names, and the short forms of each."""
    out = {}
    for formal, shorts in forms.items():
        for w in [formal, *shorts.split()]:
            out[w] = (3.0, out.get(w, (0, frozenset()))[1] | {formal}, frozenset())
    return out


KNOWN = known(katherine="kathy", joseph="", margaret="", nicholas="nick", dominic="nick", jurgen="juergen")


@pytest.mark.parametrize(
    ("name", "mail", "family", "givens", "initial"),
    [
        ("Kathy Miranona", "katherine.mirmanona@x.org", "mirmanona", ["katherine"], ""),
        ("Levsanapen, Joseph", "ci@x.org", "levsanapen", ["joseph"], ""),
        ("Levsanapen, Unheard", "ci@x.org", "levsanapen", ["unheard"], ""),
        ("MargaretJorpulisa", "cat42@x.org", "jorpulisa", ["margaret"], ""),
        ("C. Kolbilizen", "kolbilizenc@x.org", "kolbilizen", [], "c"),
        ("Nick Giskakotis (QA)", "zap1@x.org", "giskakotis", ["dominic", "nicholas"], ""),
        ("Nick Sovpasijen", "dsovpasijen@x.org", "sovpasijen", ["dominic"], ""),
        ("Margaret", "yutdudaha.margaret@x.org", "yutdudaha", ["margaret"], ""),
        ("Jürgen Kemlunaga", "juergen.kemlunaga@x.org", "kemlunaga", ["jurgen"], ""),
        ("Иван Петровский", "zap1@x.org", "петровскии", ["иван"], ""),
        ("王 小明", None, "小明", [], "王"),
    ],
)
def test_reading(name, mail, family, givens, initial):
    *_, readings = read_person(name, mail, KNOWN)
    assert readings == [(family, givens, initial)]


def test_a_word_that_name_and_address_spell_alike_is_no_slip():
    slip = {"victor": (1.0, frozenset(), frozenset(["victoria"]))}
    assert read_person("Victor Fenfifusen", "ci@x.org", slip)[3] == [("fenfifusen", ["victoria"], "")]
    assert read_person("Victor Fenfifusen", "victor.fenfifusen@x.org", slip)[3] == [("fenfifusen", ["victor"], "")]


def test_order_by_use():
    use = {"smith": (-2.0, frozenset(), frozenset()), "david": (2.0, frozenset(), frozenset())}
    assert read_person("Smith David", None, use)[3] == read_person("David Smith", None, use)[3] == [("smith", ["david"], "")]


def test_reading_nothing():
    assert read_person(None, None, {}) == ("", "", False, [])
    assert read_person("", "root@builder.invalid", {})[3] == []


def invented_people(seed, families, names):
    """Rows of people with given names and short forms that no list holds, and the true pairs."""
    rng = random.Random(seed)
    syllable = lambda: rng.choice("bdfgklmnprstvz") + rng.choice("aeiou")
    rows, true = [], set()
    given = list(names)
    for k in range(families):
        family = ("".join(syllable() for _ in range(4)) + rng.choice(["ski", "man", "sen", "vic"])).capitalize()
        full = given[k % len(given)]
        short = rng.choice(names[full]) if names[full] else full
        plain = full.lower()
        own = [
            (f"{full} {family}", f"{plain}.{family.lower()}@a.org"),
            (f"{short} {family}", f"{plain}.{family.lower()}@b.org"),
            (f"{family}, {full}", f"x{k}9@c.org"),
            (f"{short} {family[:4] + family[5:]}", f"y{k}8@d.org"),
            (f"{full[0]}. {family}", "ci@e.org"),
            (f"{family} {full}", f"z{k}7@f.org"),
        ]
        values = [f"{n} <{m}>" for n, m in own]
        rows += [(v, n, m, False) for v, (n, m) in zip(values, own, strict=True)]
        true |= {(min(a, b), max(a, b)) for a in values for b in values if a != b}
    return rows, true


def test_names_and_short_forms_that_no_list_holds(spark):
    names = {"David": ["Dov"], "Anna": ["Nusha"], "Paulina": ["Linka"], "Susan": ["Zuzu"], "Ivan": ["Vanya"], "Emma": [], "Wei": [], "Laura": ["Lolly"], "Yevgeny": ["Zhenya"], "Tomasz": ["Tomek"]}
    rows, true = invented_people(3, 120, names)
    got = pairs(spark, rows)
    assert len(got & true) >= 0.95 * len(true) and len(got & true) >= 0.95 * len(got)


def test_family_name_that_very_many_bear(spark):
    rows = [(f"A{k:02}", f"Given{chr(97 + k % 26)}{chr(97 + k // 26)} Hotfamily", f"given{chr(97 + k % 26)}{chr(97 + k // 26)}.hotfamily@a.org", False) for k in range(60)]
    rows += [("Z1", "G. Hotfamily", "q1@b.org", False), ("Z2", "hotfamily", "q2@b.org", False)]
    assert pairs(spark, rows) == set()


def background(names):
    """Other people from whom given names and short forms can be learned."""
    rows = []
    for k, (full, short) in enumerate(names.items()):
        for f in ("Olmgrund", "Pestrovak", "Quintamber", "Rowesnik"):
            family, box = f"{f}{chr(97 + k)}x", f"{full.lower()}.{f.lower()}{chr(97 + k)}x"
            rows += [(f"{full} {family}", f"{full} {family}", f"{box}@m.org", False), (f"{short} {family}", f"{short} {family}", f"{box}@n.org", False)]
    return rows


def test_variants_of_one_person(spark):
    rows = [
        ("A", "Katherine Mirmanona", "katherine.mirmanona@a.org", False),
        ("B", "Kathy Miranona", "fox12@b.org", False),
        ("C", "Mirmanona, K", "kmirmanona@c.org", False),
        ("D", "kmirmanona", "kmirmanona@d.org", False),
        ("E", "Katherine", "fox12@b.org", False),
        ("F", "Peter Mirmanona", "build@a.org", False),
        ("G", "Walter Olgrudiva", "build@a.org", False),
        ("H", "bot[bot]", "fox12@b.org", True),
        ("I", "Katherine", "katherine@e.org", False),
        ("J", None, None, False),
        (None, "Katherine Mirmanona", "x@y.org", False),
    ]
    rows += rows[:3]
    one = "ABCDE"
    got = pairs(spark, rows + background({"Katherine": "Kathy", "Peter": "Pete", "Walter": "Wally"}))
    assert {p for p in got if len(p[0]) == 1} == {(a, b) for a in one for b in one if a < b}


def test_initial_that_fits_two_stays_alone(spark):
    rows = [
        ("A", "Charles Brinfadofen", "charles.brinfadofen@a.org", False),
        ("B", "Charlotte Brinfadofen", "charlotte.brinfadofen@a.org", False),
        ("C", "C. Brinfadofen", "owl7@b.org", False),
        ("D", "cbrinfadofen", "cbrinfadofen@c.org", False),
        ("E", "Charles Brinfadofen", "cbrinfadofen@d.org", False),
    ]
    assert pairs(spark, rows) == {("A", "E"), ("A", "D"), ("D", "E")}


@pytest.mark.parametrize("limit", [10, 2])
def test_common_suffixes_are_refined_not_lost(spark, limit):
    rng = random.Random(2)
    known = ["".join(rng.choice("bdgklmnprstv") + rng.choice("aeiou") for _ in range(4)) + "kotis" for _ in range(150)]
    slips = [w[:3] + w[4:] for w in known[:40]]
    rows = [(w, 5, ["a", "b"]) for w in dict.fromkeys(known)] + [(w, 1, ["a"]) for w in dict.fromkeys(slips) if w not in known]
    df = spark.createDataFrame(rows, "token string, support long, initials array<string>")
    got = {r["token"]: r["root"] for r in token_roots(df, common=limit).collect()}
    for w, s in zip(known, slips, strict=False):
        assert lcs_ratio(got[s], s) >= 0.86 and (got[s] == w or lcs_ratio(w, s) <= lcs_ratio(got[s], s) or got[s] in known)


def test_empty(spark):
    assert pairs(spark, []) == set()
