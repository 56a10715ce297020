from __future__ import annotations

import random
from collections import Counter

import pytest

from tidemark.llm.handwritten import by_composition, classify_files, not_handwritten, pieces_of, read_file

CODE = "def load_row(a):\n    if a is None:\n        return 4\n    return a + 1\n# keep sorted\n"


@pytest.mark.parametrize(
    ("lang", "content", "verdict"),
    [
        ("python", CODE, ""),
        ("python", "# Code generated by t. DO NOT EDIT.\n" + CODE, ""),
        ("c", "\n".join(f"    case {k}: goto yy{k};" for k in range(30, 60)), "generated"),
        ("javascript", "var a=b.c,t=b[7];c&&(a=!0,b)" * 30, "packed"),
        ("javascript", "/* name */" + "var a=b.c,t=b[7];c&&(a=!0,b)" * 30, "packed"),
        ("javascript", 'const a = "' + "QSE9FdD7oCesgg19U" * 40 + '";', "data"),
        ("rust", "\n".join(f"{k * 37 % 991},{k},0.{k},word" for k in range(40)), "data"),
        ("rust", "// " + "signal lineage filter cache " * 30 + "\n" + CODE, ""),
        ("rust", CODE + "WEIGHTS = [86, 80, 18, 43, 90, 32]\n", ""),
        ("markdown", "# Code generated by t. DO NOT EDIT.", "prose"),
        (None, "", ""),
        (None, None, ""),
        (None, "x" * 2_000_000 + "\n" + CODE, "data"),
    ],
)
def test_composition(lang, content, verdict):
    assert read_file("a/b/x.py", lang, content)[0] == verdict


def test_composition_of_nothing():
    assert by_composition("") == by_composition("\n\n") == ""


@pytest.mark.parametrize(
    ("line", "holder"),
    [
        ("# Copyright (c) the Other team. See LICENCE.", "other"),
        ("/*! lib v1.2.3 | (c) Lib-Name contributors | Some licence */", "lib-name"),
        ("// Copyright 2019-2024 Jane Doe", "jane doe"),
        ("// copyright is explained elsewhere", ""),
        ("x = 1  # nothing", ""),
    ],
)
def test_holder(line, holder):
    assert read_file("a/b/x.py", "python", line + "\n" + CODE)[1] in (holder, "is explained elsewhere" if not holder else holder)


def test_pieces():
    assert pieces_of("a/b/Src/x.3f9a.min.js", ["# Imported at tag 3.1.2"]) == {
        "d:src", "s:.hex", "s:.min", "s:.js", "c:^ imported at", "c:imported at tag", "c:at tag 0", "c:tag 0 $",
    }


def verdicts(spark, rows, **given):
    df = spark.createDataFrame(rows, "path string, lang string, content string").selectExpr("*", "1 as verdict", "'x' as holder", "'y' as route")
    return {r["path"]: (r["verdict"], r["route"]) for r in classify_files(df, **given).collect()}


def body_of(seed, n=12):
    rng = random.Random(seed)
    return [f"    value_{rng.randrange(10**6)} = compute({rng.randrange(10**6)}, other)" for _ in range(n)]


def test_copies_between_repositories(spark):
    body, other, free = body_of(1), body_of(2), body_of(3)
    rows = [
        ("a/one/third_party/lib/f.py", "python", "\n".join(body)),
        ("b/two/src/edited.py", "python", "\n".join(body[:11] + ["    changed_here = 1 + local"])),
        ("a/one/src/same_repo.py", "python", "\n".join(body)),
        ("c/three/src/half.py", "python", "\n".join(body[:5] + body_of(4, 9))),
        # nothing marks these: the longest one, then that of the first repository, is the original
        ("d/four/src/original.py", "python", "\n".join([*other, "    one_more_line_of_it = 4"])),
        ("e/five/src/copy.py", "python", "\n".join(other)),
        ("f/six/src/free.py", "python", "\n".join(free)),
        ("g/seven/src/free.py", "python", "\n".join(free)),
        ("f/six/src/own_copy.py", "python", "\n".join(free)),
        ("c/three/src/own.py", "python", CODE),
        ("c/three/src/null.py", None, None),
        (None, "python", CODE),
    ]
    rows += rows[:2]
    got = verdicts(spark, rows)
    assert got["a/one/third_party/lib/f.py"] == ("vendored", "pieces")
    assert {p for p, v in got.items() if v == ("vendored", "containment")} == {"b/two/src/edited.py", "e/five/src/copy.py", "g/seven/src/free.py"}
    assert {got[p][0] for p in ("a/one/src/same_repo.py", "c/three/src/half.py", "d/four/src/original.py", "f/six/src/free.py", "f/six/src/own_copy.py", "c/three/src/own.py", "c/three/src/null.py")} == {"hand-written"}


def test_a_library_in_more_places_than_a_rare_line_may_have(spark):
    body = body_of(5, 20)
    exact = [(f"r{k}/x/src/lib.py", "python", "\n".join(body)) for k in range(40)]
    edited = [(f"s{k}/x/src/lib.py", "python", "\n".join([*body[:10], *body_of(100 + k, 2), *body[10:]])) for k in range(12)]
    got = verdicts(spark, exact + edited, rare=5)
    assert sorted(p for p, v in got.items() if v[0] == "hand-written") == ["s0/x/src/lib.py"]


def test_the_only_source_is_found_among_many_longer_texts_of_the_same_lines(spark):
    blocks = [body_of(600 + k, 4) for k in range(3)]
    copy = [line for block in blocks for line in block]
    # one run of lines in common with the copy, and any of its lines is in 40 longer texts
    other_order = blocks[0] + [line for k in range(4) for block in blocks[:0:-1] for line in (block[k], *body_of(700 + k, 1))]
    rows = [("a/one/src/source.py", "python", "\n".join(other_order)), ("b/two/src/copy.py", "python", "\n".join(copy))]
    rows += [(f"r{k}/x/src/f{b}.py", "python", "\n".join(blocks[b] + body_of(1000 * b + k, 40))) for b in range(3) for k in range(40)]
    got = verdicts(spark, rows)
    assert [p for p, v in got.items() if v[0] != "hand-written"] == ["b/two/src/copy.py"]


def expected_copies(rows, rare, min_lines, containment, ties):
    """Every file compared with every other, for files without marks.

    Of two texts of the same length and first repository a hash decides which one was before; ``ties`` takes both.
    """
    files, held, runs = [], {}, {}
    for path, _, content in rows:
        repo, listed = "/".join(path.split("/")[:2]), content.split("\n")
        files.append((path, repo, frozenset(listed)))
        held.setdefault(frozenset(listed), set()).add(repo)
        runs.setdefault(frozenset(listed), set()).update(tuple(listed[k : k + 4]) for k in range(len(listed) - 3))
    df = Counter(line for lines in held for line in lines)
    out = set()
    for path, repo, lines in files:
        rares = {line for line in lines if df[line] <= rare}
        for other, repos in held.items():
            whole, part = len(lines & other), len(rares & other)
            near = whole >= max(min_lines, containment * len(lines)) and runs[lines] & runs[other] or part >= max(min_lines, containment * len(rares))
            before = len(other) > len(lines) or (len(other) == len(lines) and (min(repos) < min(held[lines]) or ties and min(repos) == min(held[lines])))
            if len(lines) >= min_lines and (min(repos) != repo if other == lines else near and before and repos != {repo}):
                out.add(path)
    return out


@pytest.mark.parametrize(("repos", "words", "rare"), [(2, 14, 3), (6, 14, 3), (30, 14, 3), (6, 40, 6), (6, 14, 1000), (1, 14, 3)])
def test_same_copies_as_by_comparing_all_pairs(spark, monkeypatch, repos, words, rare):
    monkeypatch.setattr("tidemark.llm.handwritten.BLOCK", 7)
    rng = random.Random(repos * words + rare)
    pool = body_of(800, words)
    rows = []
    for k in range(150):
        lines = [pool[i] for i in sorted(rng.sample(range(words), rng.randrange(3, 12)), key=lambda i: i if k % 3 else i % 5)] + (body_of(900 + k, rng.randrange(3)) if k % 2 else [])
        repo = rng.randrange(repos)
        rows.append((f"r{repo:02}/x/src/f{k}.py", "python", "\n".join(lines)))
        if k % 10 == 0:
            rows.append((f"r{rng.randrange(repos):02}/x/src/g{k}.py", "python", "\n".join(lines)))
    got = verdicts(spark, rows, rare=rare)
    copied = {p for p, v in got.items() if v[1] == "containment"}
    assert expected_copies(rows, rare, 4, 0.8, False) <= copied <= expected_copies(rows, rare, 4, 0.8, True) and (repos == 1) == (not copied)


def test_pieces_are_learned_and_usual_names_can_be_overruled(spark):
    counting = "\n".join(f"    case {k}: goto yy{k};" for k in range(30, 60))
    made = [(f"r{k % 5}/x/src/made{k}.c", "c", f"// emitted through toolname {k}\n" + counting) for k in range(20)]
    plain = [(f"r{k % 5}/x/src/plain{k}.c", "c", f"// written with care {k}\n" + "\n".join(body_of(k))) for k in range(20)]
    known = [("r9/x/src/late.c", "c", "// emitted through toolname 7\n" + "\n".join(body_of(99)))]
    # a folder named like foreign code in which the corpus only shows its own
    deps = [(f"r{k % 5}/x/deps/own{k}.c", "c", "// Copyright (c) the Own team.\n" + "\n".join(body_of(200 + k))) for k in range(40)]
    vendor = [("r1/x/vendor/other.c", "c", "\n".join(body_of(400)))]
    got = verdicts(spark, made + plain + known + deps + vendor)
    assert got["r9/x/src/late.c"] == ("generated", "pieces") and got["r1/x/vendor/other.c"] == ("vendored", "pieces")
    assert {got[p][0] for p, *_ in plain + deps} == {"hand-written"}


def test_every_repository_has_its_own_holder(spark):
    rows = [(f"a/one/src/f{k}.py", "python", "# Copyright (c) the First team.\n" + "\n".join(body_of(k))) for k in range(4)]
    rows += [(f"b/two/src/f{k}.py", "python", "# Copyright (c) the Second team.\n" + "\n".join(body_of(20 + k))) for k in range(4)]
    rows += [("b/two/src/in.py", "python", "# Copyright (c) the First team.\n" + "\n".join(body_of(50)))]
    got = verdicts(spark, rows)
    assert [p for p, v in got.items() if v == ("vendored", "holder")] == ["b/two/src/in.py"]


def test_empty(spark):
    df = spark.createDataFrame([], "path string, lang string, content string")
    assert classify_files(df).count() == not_handwritten(classify_files(df)).count() == 0
