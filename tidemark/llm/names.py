"""Variant spellings of people's names, linked by suffix blocking and LCS ratio.

1. Every raw (name, address) is cut into words. Which word is the given name is read from the corpus: how
   often a word stands first or last in names, and beside how many others. There is no list of names.
2. Given names that stand for each other (short forms, nicknames) are learned as well: two of them belong
   together if, for several family names, one stands in a name and the other in its own address, or in
   two names that one canonical value already unites. The one that is used more often, or that addresses
   are made of, is the formal name. Misspelt given names take the nearest formal ones.
3. All suffixes, above a minimum length, of the family-name tokens and of the reversed tokens (so that a
   slip near the end does not hide a pair) form an inverted index over *distinct* tokens. A suffix that
   is too common is refined, first with the initials it occurs with, then with the token's length, and
   only then discarded; tokens that lost a suffix meet by their forms with letters left out instead, which
   finds every pair within the ratio. Pairs from one key are compared by their
   longest-common-subsequence ratio; rare spellings point to the best supported spelling within reach, and
   pointer doubling gives each token its root.
4. A person is a family-name root with a formal given name. Spellings with a nickname of several names,
   an initial or a login take the person that alone fits; if several fit, the one whose mailbox name is
   the same; otherwise they stay alone. A spelling without a family name takes the person who alone uses
   its mailbox. Mailboxes that many share (roles) say nothing.

No step gathers a group in one task or on the driver, and no pair of raw rows is ever compared: counts per
token are combined map-side, only tokens of one refined key meet, and every row is read with what the
corpus knows of its own words.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.hierarchy import resolve_hierarchy
from tidemark.session import drop_staged, settled, stage_table

# Mailboxes of a role or a machine.
_ROLES = frozenset("admin build builder ci contact dev devnull git hello info mail nobody no-reply noreply office root support team webmaster".split())
#: Least number of different families, or of addresses, that make a given name or a pair of them known.
FAMILIES, FORMAL_USES, FORMAL_BOXES = 2, 8, 2
#: Least ratio of a misspelt given name, and of two family names that speak of one person.
GIVEN_RATIO, FAMILY_RATIO = 0.79, 0.8
#: By how much the second word must look more like a given name than the first to turn them round.
TURN = 1.0

_BRACKETS = regex.compile(r"[(\[{<][^)\]}>]*[)\]}>]?")
_CAMEL = regex.compile(r"(?<=\p{Ll})(?=\p{Lu})")
_WORD = regex.compile(r"[^\W\d_]+")
_DIGIT = regex.compile(r"\d")
_LETTERS = str.maketrans({"ß": "ss", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "æ": "ae", "Æ": "Ae", "œ": "oe"})

Known = dict[str, tuple[float, frozenset[str], frozenset[str]]]
"""Of a word: how much it looks like a given name, the formal names it stands for, and those it may be a slip of."""


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over the shorter string."""
    if len(a) > len(b):
        a, b = b, a
    at: dict[str, int] = {}
    for k, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & at.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def lcs_ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths; 1 for two empty strings."""
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def fold_letters(text: str) -> str:
    """Letters of any script without accents, in lower case."""
    text = unicodedata.normalize("NFKD", text.translate(_LETTERS))
    return "".join(ch for ch in text if not unicodedata.combining(ch)).lower()


def name_words(name: str | None) -> tuple[list[str], bool]:
    """The words of a typed name that are read, given name first where a comma says so, and whether it does.

    Of more than two words, the first and the last that are no initials are read; those between are further
    given names or initials.
    """
    plain = _BRACKETS.sub(" ", name or "").strip()
    comma = "," in plain
    if comma:
        family, given = plain.split(",", 1)
        plain = f"{given} {family}"
    elif " " not in plain:
        plain = _CAMEL.sub(" ", plain)
    words = _WORD.findall(fold_letters(plain))
    if len(words) > 2:
        long_words = [w for w in words if len(w) > 1]
        words = [long_words[0], long_words[-1]] if len(long_words) > 1 else words[:2]
    return words, comma and len(words) == 2


def address_words(address: str | None) -> tuple[str, str, list[str]]:
    """``(mailbox, local part, its words)``; empty for a role mailbox or a reserved domain, no words with digits."""
    local, at, domain = fold_letters((address or "").strip()).partition("@")
    local = local.split("+", 1)[0]
    if not at or not local or local in _ROLES or domain.endswith((".invalid", "localhost")):
        return "", "", []
    if _DIGIT.search(local):
        return f"{local}@{domain}", local, []
    return f"{local}@{domain}", local, _WORD.findall(local)


def login_parts(word: str) -> list[str]:
    """The beginnings and ends of a word that may be a given name beside a family name of five letters."""
    return [part for k in range(3, len(word) - 4) for part in (word[:k], word[len(word) - k :])]


def formal_names(word: str, known: Known, slips: bool = True) -> frozenset[str]:
    """The formal given names that a word may stand for; with ``slips`` also when it is misspelt."""
    _, exact, near = known.get(word, (0.0, frozenset(), frozenset()))
    return exact or (near if slips else frozenset())


Reading = tuple[str, frozenset[str], str]
"""``(family, givens, initial)``; the family name may be empty."""


def _split_login(word: str, known: Known) -> list[Reading]:
    """Readings of one word such as ``kmiller``, ``millerk``, ``katemiller``."""
    readings: list[Reading] = []
    for k in range(len(word) - 5, 2, -1):
        for given, family in ((word[:k], word[k:]), (word[len(word) - k :], word[: len(word) - k])):
            formal = formal_names(given, known, slips=False)
            if formal and (k >= 6 or (k >= 4 and given in formal)):
                readings.append((family, formal, ""))
    if len(word) >= 6:
        readings += [(word[1:], frozenset(), word[0]), (word[:-1], frozenset(), word[-1])]
    return readings


def _turned(a: str, b: str, known: Known) -> bool:
    """Whether the second word is the given name, by how both are used."""
    return known.get(b, (0.0,))[0] - known.get(a, (0.0,))[0] > TURN


def _read_two(a: str, b: str, known: Known, comma: bool = False) -> list[Reading]:
    """Readings of two words of which one is the family name."""
    if len(a) == 1 or len(b) == 1:
        initial, family = (a, b) if len(a) == 1 else (b, a)
        return [(family, frozenset(), initial)] if len(family) > 1 else []
    if not comma:
        for slips in (False, True):
            first, second = formal_names(a, known, slips), formal_names(b, known, slips)
            if first and second:
                break
            if first:
                return [(b, first, "")]
            if second:
                return [(a, second, "")]
        if _turned(a, b, known):
            a, b = b, a
    return [(b, formal_names(a, known) or frozenset([a]), "")]


def read_name(name: str | None, known: Known) -> list[Reading]:
    """Readings of a typed name."""
    words, comma = name_words(name)
    if not words:
        return []
    if len(words) == 2:
        return _read_two(*words, known, comma)
    if formal_names(words[0], known, slips=False):
        return [("", formal_names(words[0], known), "")]
    if (name or "").strip()[:1].isupper():  # a name, no login
        return [("", formal_names(words[0], known) or frozenset(words[:1]), "")]
    return _split_login(words[0], known) or ([("", formal_names(words[0], known), "")] if formal_names(words[0], known) else [])


def read_address(address: str | None, known: Known) -> tuple[str, str, list[Reading]]:
    """``(mailbox, local part, readings)``."""
    mailbox, local, words = address_words(address)
    if len(words) == 2:
        return mailbox, local, _read_two(*words, known)
    return mailbox, local, _split_login(words[0], known) if len(words) == 1 else []


def read_person(name: str | None, address: str | None, known: Known) -> tuple[str, str, bool, list[tuple[str, list[str], str]]]:
    """``(mailbox, local part, sure, readings)`` of one raw identity.

    Addresses are spelt with more care than names, so their spelling is preferred where both tell the same.
    A word that both spell alike is no slip. ``sure`` says that the family name was seen as a word of its own.
    """
    for word in set(name_words(name)[0]) & set(address_words(address)[2]) & known.keys():
        known = {**known, word: (*known[word][:2], frozenset())}
    mailbox, local, by_address = read_address(address, known)
    by_name = read_name(name, known)
    best: list[tuple[float, str, frozenset[str], str]] = []
    for family, givens, initial in by_name:
        for a_family, a_givens, a_initial in by_address:
            if family and a_family and lcs_ratio(family, a_family) >= 0.8:
                if a_initial and not a_givens:
                    # an initial in the address chooses among the names a short form may stand for
                    givens = frozenset(g for g in givens if g[0] == a_initial) or givens
                together = givens & a_givens or a_givens or givens
                letter = "" if together else (a_initial or initial)
                if letter and not givens and not a_givens and a_initial and initial and a_initial != initial:
                    continue
                if together and initial and not givens and not any(g[0] == initial for g in together):
                    continue
                if together and a_initial and not a_givens and not any(g[0] == a_initial for g in together):
                    continue
                best.append((lcs_ratio(family, a_family), a_family, together, letter))
            elif not family and a_family:
                fits = (givens & a_givens) or givens
                best.append((0.5 if fits else 0.3, a_family, fits or a_givens, "" if fits or a_givens else a_initial))
    if best:
        top = max(b[0] for b in best)
        readings = [(f, g, i) for r, f, g, i in best if r == top]
    else:
        readings = by_name or by_address
    sure = len(readings) == 1 and bool(readings[0][0])
    return mailbox, local, sure, [(f, sorted(g), i) for f, g, i in dict.fromkeys(readings)]


_READING = T.StructType(
    [
        T.StructField("mailbox", T.StringType()),
        T.StructField("local", T.StringType()),
        T.StructField("sure", T.BooleanType()),
        T.StructField(
            "readings",
            T.ArrayType(
                T.StructType(
                    [T.StructField("family", T.StringType()), T.StructField("givens", T.ArrayType(T.StringType())), T.StructField("initial", T.StringType())]
                )
            ),
        ),
    ]
)


_TEXTS = T.ArrayType(T.StringType())
_WORDS = T.StructType([T.StructField("words", _TEXTS), T.StructField("comma", T.BooleanType()), T.StructField("box", _TEXTS), T.StructField("asked", _TEXTS)])
_USE = T.ArrayType(T.StructType([T.StructField("given", T.StringType()), T.StructField("family", T.StringType()), T.StructField("boxed", T.BooleanType())]))


@F.pandas_udf(_WORDS)
def _cut(names: pd.Series, addresses: pd.Series) -> pd.DataFrame:
    rows = []
    for name, address in zip(names, addresses, strict=True):
        words, comma = name_words(name)
        box = address_words(address)[2]
        asked = {*words, *box, *(p for w in (words, box) if len(w) == 1 for p in login_parts(w[0]))}
        rows.append((words, comma, box, sorted(asked)))
    return pd.DataFrame(rows, columns=["words", "comma", "box", "asked"])


def _known(entries) -> Known:
    return {e["word"]: (e["score"], frozenset(e["formal"]), frozenset(e["near"])) for e in (entries if entries is not None else ())}


@F.pandas_udf(_USE)
def _uses(words: pd.Series, commas: pd.Series, boxes: pd.Series, known: pd.Series) -> pd.Series:
    """Given and family name of a row's name and of its address, as far as both are words of their own."""
    out = []
    for name, comma, box, entries in zip(words, commas, boxes, known, strict=True):
        about, uses = _known(entries), []
        if len(name) == 2 and min(map(len, name)) > 1:
            a, b = name if comma or not _turned(*name, about) else (name[1], name[0])
            uses.append((a, b, False))
        if len(box) == 2 and min(map(len, box)) > 1:
            a, b = (box[1], box[0]) if _turned(*box, about) else box
            if uses and lcs_ratio(uses[0][1], b) < FAMILY_RATIO <= lcs_ratio(uses[0][1], a):
                a, b = b, a
            uses.append((a, b, True))
        out.append([{"given": g, "family": f, "boxed": x} for g, f, x in uses])
    return pd.Series(out)


@F.pandas_udf(_READING)
def _read(names: pd.Series, addresses: pd.Series, known: pd.Series) -> pd.DataFrame:
    rows = [read_person(n, a, _known(k)) for n, a, k in zip(names, addresses, known, strict=True)]
    return pd.DataFrame(
        [(m, loc, s, [{"family": f, "givens": g, "initial": i} for f, g, i in r]) for m, loc, s, r in rows],
        columns=["mailbox", "local", "sure", "readings"],
    )


@F.pandas_udf(T.DoubleType())
def lcs_ratio_of(a: pd.Series, b: pd.Series) -> pd.Series:
    """Vectorised :func:`lcs_ratio`."""
    return pd.Series([lcs_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _about(rows: DataFrame, words: DataFrame) -> DataFrame:
    """``rows`` with what is known of each one's own words: ``known``, at most a few dozen entries."""
    asked = rows.select("id", F.explode("asked").alias("word")).join(words, "word")
    known = asked.groupBy("id").agg(F.collect_list(F.struct("word", "score", "formal", "near")).alias("known"))
    return rows.join(known, "id", "left")


def word_scores(rows: DataFrame) -> DataFrame:
    """How much each word of two-word names looks like a given name: ``word``, ``score``.

    It grows with the share of first places (a comma counts three times) and with the number of other words
    it stands beside, as few given names serve very many families. A word beside an initial is a family name.
    """
    two = rows.where(F.size("words") == 2).select("value", F.col("words")[0].alias("a"), F.col("words")[1].alias("b"), "comma").distinct()
    weight = F.when(F.col("comma"), 3).otherwise(1)
    lone = (F.length("a") == 1) | (F.length("b") == 1)
    places = two.select(
        F.explode(
            F.when(lone, F.array(F.struct(F.when(F.length("a") == 1, F.col("b")).otherwise(F.col("a")).alias("word"), F.lit("").alias("beside"), F.lit(0).alias("first"), F.lit(1).alias("last")))).otherwise(
                F.array(
                    F.struct(F.col("a").alias("word"), F.col("b").alias("beside"), weight.alias("first"), F.lit(0).alias("last")),
                    F.struct(F.col("b").alias("word"), F.col("a").alias("beside"), F.lit(0).alias("first"), weight.alias("last")),
                )
            )
        ).alias("p")
    ).select("p.*")
    per = places.where("length(word) > 1").groupBy("word", "beside").agg(F.sum("first").alias("first"), F.sum("last").alias("last"))
    total = per.groupBy("word").agg(F.sum("first").alias("first"), F.sum("last").alias("last"), F.count_if(F.col("beside") != "").alias("beside"))
    return total.select("word", (F.log((F.col("first") + 0.5) / (F.col("last") + 0.5)) + 0.5 * F.log(1.0 + F.col("beside"))).alias("score"))


def learned_forms(uses: DataFrame) -> DataFrame:
    """The formal given names each given name stands for: ``word``, ``formal`` (array).

    ``uses``: ``value``, ``row``, ``given``, ``family``, ``boxed``. Two given names are evidence for each other in
    the name and the address of one row, and in any row against the first full name of its value, if the
    families are near. Linear in the rows, as every row meets two others at most.
    """
    plain = uses.where("not boxed").select("value", "row", "given", "family")
    boxed = uses.where("boxed").select("row", F.col("given").alias("other"), F.col("family").alias("its"))
    lead = plain.groupBy("value").agg(F.min(F.struct("given", "family")).alias("l")).select("value", F.col("l.given").alias("other"), F.col("l.family").alias("its"))
    met = plain.join(boxed, "row").select("given", "family", "other", "its").unionByName(uses.join(lead, "value").select("given", "family", "other", "its"))
    near = met.where("given <> other").distinct().where(lcs_ratio_of("family", "its") >= FAMILY_RATIO)
    pairs = near.select(F.least("given", "other").alias("a"), F.greatest("given", "other").alias("b"), "its").distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("families")).where(F.col("families") >= FAMILIES)
    counts = stage_table(
        uses.select("value", "given", "family", "boxed").distinct().groupBy("given").agg(F.count_distinct("value").alias("n"), F.count_distinct(F.when(F.col("boxed"), F.col("family"))).alias("boxes"), F.count_distinct("family").alias("families"))
    )
    known = counts.where((F.col("families") >= 3) & ((F.col("n") >= FORMAL_USES) | (F.col("boxes") >= FORMAL_BOXES)))
    a = counts.select(F.col("given").alias("a"), F.col("n").alias("na"), F.col("boxes").alias("xa"))
    b = counts.select(F.col("given").alias("b"), F.col("n").alias("nb"), F.col("boxes").alias("xb"))
    often = lambda n, x: (F.col(n) >= FORMAL_USES) | (F.col(x) >= FORMAL_BOXES)
    sized = pairs.join(a, "a").join(b, "b").where((often("na", "xa") & often("nb", "xb")) | (lcs_ratio_of("a", "b") < FAMILY_RATIO))
    less = F.struct("xa", "na", "a") < F.struct(F.col("xb").alias("xa"), F.col("nb").alias("na"), F.col("b").alias("a"))
    step = stage_table(sized.select(F.when(less, F.col("a")).otherwise(F.col("b")).alias("short"), F.when(less, F.col("b")).otherwise(F.col("a")).alias("long")))
    # a long form may itself stand for another one
    onward = step.join(step.select(F.col("short").alias("long"), F.col("long").alias("longer")), "long", "left").select(F.col("short").alias("word"), F.coalesce("longer", "long").alias("formal"))
    alone = known.select(F.col("given").alias("word"), F.col("given").alias("formal")).join(step.select(F.col("short").alias("word")), "word", "left_anti")
    reached = step.select(F.col("long").alias("word"), F.col("long").alias("formal")).join(step.select(F.col("short").alias("word")), "word", "left_anti")
    out = stage_table(onward.unionByName(alone).unionByName(reached).distinct().groupBy("word").agg(F.sort_array(F.collect_set("formal")).alias("formal")))  # a few names
    drop_staged(counts, step)
    return out


def near_names(words: DataFrame, forms: DataFrame) -> DataFrame:
    """The formal names that unknown words are slips of: ``word``, ``near`` (array).

    Words of four letters and more meet known ones by the first or last three letters, or by the first and
    the last letter and a length that differs by one at most; the greatest ratio decides.
    """
    def keyed(df: DataFrame, name: str, reach: int) -> DataFrame:
        w = F.col(name)
        ends = F.concat_ws("|", w.substr(1, 1), F.substring(w, -1, 1))
        keys = [F.concat(F.lit("<"), w.substr(1, 3)), F.concat(F.lit(">"), F.substring(w, -3, 3)), *[F.concat_ws("|", ends, (F.length(w) + k).cast("string")) for k in range(-reach, reach + 1)]]
        return df.where(F.length(w) >= 4).select("*", F.explode(F.array(*keys)).alias("key"))

    unknown = keyed(words.join(forms.select("word"), "word", "left_anti"), "word", 0)
    named = keyed(forms.select(F.col("word").alias("name"), "formal"), "name", 1)
    met = unknown.join(named, "key").where(F.abs(F.length("word") - F.length("name")) <= 2).select("word", "name", "formal").distinct()
    rated = met.withColumn("ratio", lcs_ratio_of("word", "name")).where(F.col("ratio") >= GIVEN_RATIO)
    best = rated.groupBy("word").agg(F.max("ratio").alias("ratio"))
    return rated.join(best, ["word", "ratio"]).select("word", F.explode("formal").alias("formal")).groupBy("word").agg(F.sort_array(F.collect_set("formal")).alias("near"))


@F.pandas_udf(_TEXTS)
def _deleted(tokens: pd.Series, most: pd.Series) -> pd.Series:
    def forms(token: str, k: int) -> list[str]:
        found = last = {token}
        for _ in range(k):
            last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
            found = found | last
        return sorted(found)

    return pd.Series([forms(t, k) for t, k in zip(tokens, most, strict=True)])


def _deletions(token, min_ratio: float):
    """The token and its forms with as many letters left out as a pair within the ratio may leave unmatched.

    Of a pair with lengths ``a <= b`` and ratio ``r``, ``b`` leaves at most ``b - r (a + b) / 2`` letters and ``a``
    fewer; with ``a >= b r / (2 - r)`` that is at most ``2 b (1 - r) / (2 - r)``.
    """
    most = F.floor(2 * F.length(token) * (1 - min_ratio) / (2 - min_ratio) + 1e-9).cast("int")
    return _deleted(token, most)


@settled
def token_roots(tokens: DataFrame, min_suffix: int = 4, min_ratio: float = 0.86, common: int = 100) -> DataFrame:
    """The best supported spelling within reach of every token.

    ``tokens``: ``token`` (distinct), ``support`` (long), ``initials`` (array). Result: ``token``, ``root``,
    ``support`` of the root.
    """
    tokens = stage_table(tokens)
    both = tokens.select("token", "support", "initials", F.explode(F.array("token", F.concat(F.lit("<"), F.reverse("token")))).alias("text"))
    # suffixes of at least `min_suffix` letters; the reversed word keeps its mark at the front of the key
    marked = F.when(F.col("text").startswith("<"), "<").otherwise("")
    body = F.regexp_replace("text", "^<", "")
    postings = (
        both.select("token", "support", "initials", marked.alias("mark"), body.alias("body"))
        .where(F.length("body") >= min_suffix)
        .select(
            "token",
            "support",
            "initials",
            F.explode(
                F.transform(F.sequence(F.lit(1), F.length("body") - min_suffix + 1), lambda k: F.concat("mark", F.col("body").substr(k, F.length("body"))))
            ).alias("suffix"),
        )
    )
    sizes = postings.groupBy("suffix").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counted = postings.join(sizes, "suffix")
    plain = counted.where(F.col("n") <= common).select("token", "support", F.col("suffix").alias("key"))
    fine = counted.where(F.col("n") > common).select("token", "support", "suffix", F.explode("initials").alias("letter")).select("token", "support", F.concat_ws("|", "suffix", "letter").alias("key"))
    fine_sizes = fine.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    fine_counted = fine.join(fine_sizes, "key")
    # lengths that differ by up to two meet in one key
    finer = (
        fine_counted.where(F.col("n") > common)
        .select("token", "support", "key", F.explode(F.array(*[F.length("token") + k for k in range(3)])).alias("size"))
        .select("token", "support", F.concat_ws("|", "key", F.col("size").cast("string")).alias("key"))
    )
    finer_sizes = finer.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    finer_counted = stage_table(finer.join(finer_sizes, "key"))
    # what is still too common is discarded; its tokens meet by their forms with letters left out: a ratio of
    # `min_ratio` leaves at most so many letters of either token unmatched
    dropped = finer_counted.where(F.col("n") > common).select("token", "support").distinct()
    left_out = dropped.select("token", "support", F.explode(_deletions(F.col("token"), min_ratio)).alias("key")).select("token", "support", F.concat(F.lit("-"), "key").alias("key"))
    blocks = (
        plain.unionByName(fine_counted.where(F.col("n") <= common).select("token", "support", "key"))
        .unionByName(finer_counted.where(F.col("n") <= common).select("token", "support", "key"))
        .unionByName(left_out)
    )
    blocks = stage_table(blocks)
    a, b = blocks.alias("a"), blocks.alias("b")
    reach = F.floor((F.length("x") + F.length("y")) * (1 - min_ratio)).cast("int")
    pairs = (
        a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.token") < F.col("b.token")))
        .where(F.abs(F.length("a.token") - F.length("b.token")) <= F.floor((F.length("a.token") + F.length("b.token")) * (1 - min_ratio)))
        .select(F.col("a.token").alias("x"), F.col("b.token").alias("y"), F.col("a.support").alias("sx"), F.col("b.support").alias("sy"))
        .distinct()
        # edits never exceed the letters outside the common subsequence, so this bound loses no pair
        .where(F.levenshtein("x", "y") <= reach)
        .where(lcs_ratio_of("x", "y") >= min_ratio)
    )
    x_wins = (F.col("sx") > F.col("sy")) | ((F.col("sx") == F.col("sy")) & (F.col("x") < F.col("y")))
    links = (
        pairs.select(
            F.when(x_wins, F.col("y")).otherwise(F.col("x")).alias("token"),
            F.when(x_wins, F.struct("sx", "x")).otherwise(F.struct(F.col("sy").alias("sx"), F.col("y").alias("x"))).alias("target"),
        )
        .groupBy("token")
        .agg(F.max("target").alias("target"))
        .select("token", F.col("target.x").alias("up"))
    )
    rooted = resolve_hierarchy(links, "token", "up").select(F.col("node").alias("token"), "root")
    support = tokens.select(F.col("token").alias("root"), "support")
    out = stage_table(tokens.select("token").join(rooted, "token", "left").withColumn("root", F.coalesce("root", "token")).join(support, "root").select("token", "root", "support"))
    return out


@settled
def link_people(identities: DataFrame, value: str, name: str, address: str, machine: str | None = None) -> DataFrame:
    """One row per value with the person it denotes: ``value``, ``person``.

    ``identities`` has one row per use of a value with a raw name and address; ``machine`` may name a
    boolean column.

    Defined cases: null values get no row; a value that ever is a machine's, has no name and mailbox, or
    cannot be told from several people, is a person of its own (``person`` is null for machines and for
    values without any evidence); repeated rows count once; an empty input gives no rows; other columns
    are ignored.
    """
    flagged = identities.select(
        F.col(value).alias("value"),
        F.col(name).alias("name"),
        F.col(address).alias("address"),
        (F.coalesce(F.col(machine), F.lit(False)) if machine else F.lit(False)).alias("machine"),
    ).where("value is not null")
    raw = stage_table(flagged.groupBy("value", "name", "address").agg(F.bool_or("machine").alias("machine")))
    bots = raw.groupBy("value").agg(F.bool_or("machine").alias("machine")).where("machine").select("value")
    human = stage_table(raw.join(bots, "value", "left_anti").select("value", "name", "address", _cut("name", "address").alias("c")).select(F.monotonically_increasing_id().alias("id"), "value", "name", "address", "c.*"))
    scores = stage_table(word_scores(human).select("word", "score", F.array().cast("array<string>").alias("formal"), F.array().cast("array<string>").alias("near")))
    both = F.size("words") + F.size("box") > 1
    uses = stage_table(_about(human.where(both), scores).select("value", F.col("id").alias("row"), F.explode(_uses("words", "comma", "box", "known")).alias("u")).select("value", "row", "u.*"))
    forms = learned_forms(uses)
    known_word = forms.select("word", F.lit(True).alias("known"))
    # slips are looked for where none of a row's words is known
    bare = human.select("id", F.explode(F.array_union("words", "box")).alias("word")).where("length(word) > 1")
    strange = bare.join(known_word, "word", "left").groupBy("id").agg(F.count("known").alias("n")).where("n = 0").select("id")
    near = near_names(bare.join(strange, "id", "left_semi").select("word").distinct(), forms)
    words = stage_table(
        scores.select("word", "score").join(forms, "word", "full").join(near, "word", "full").select("word", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("formal", F.array().cast("array<string>")).alias("formal"), F.coalesce("near", F.array().cast("array<string>")).alias("near"))
    )
    read = (
        _about(human, words)
        .select("value", _read("name", "address", "known").alias("r"))
        .select("value", "r.mailbox", "r.local", "r.sure", F.explode_outer("r.readings").alias("reading"))
        .select("value", "mailbox", "local", "sure", "reading.family", "reading.givens", "reading.initial")
    )
    read = stage_table(read)
    letters = F.when(F.size("givens") > 0, F.transform("givens", lambda g: F.substring(g, 1, 1))).otherwise(F.array("initial"))
    tokens = (
        read.where("family <> ''")
        .select("family", "value", "sure", F.explode(letters).alias("letter"))
        .groupBy("family")
        .agg(
            F.count_distinct(F.when(F.col("sure"), F.col("value"))).alias("support"),
            F.collect_set("letter").alias("initials"),  # at most one entry per letter
        )
        .select(F.col("family").alias("token"), "support", "initials")
    )
    roots = token_roots(tokens)
    # of several readings of one raw identity, those whose family name others use as a word of its own
    placed = read.where("family <> ''").join(roots.select(F.col("token").alias("family"), "root", F.col("support").alias("known")), "family")
    strength = F.when(F.col("sure"), F.lit(3)).when((F.col("known") > 0) & (F.col("root") == F.col("family")), F.lit(2)).when(F.col("known") > 0, F.lit(1)).otherwise(F.lit(0))
    placed = placed.withColumn("strength", strength)
    best = placed.groupBy("value", "mailbox", "local").agg(F.max("strength").alias("best"))
    kept = stage_table(
        placed.join(best, ["value", "mailbox", "local"])
        .where(F.col("strength") == F.col("best"))
        .select("value", "mailbox", "local", "root", "givens", "initial", "strength")
        .distinct()
    )
    # people: a family name with one formal given name
    full = kept.where((F.size("givens") == 1) & (F.col("strength") > 0)).select("value", "local", "mailbox", "root", F.col("givens")[0].alias("given"))
    own = full.groupBy("value", "root", "given").agg(F.count(F.lit(1)).alias("n"))
    choice = own.groupBy("value").agg(F.max(F.struct("n", "root", "given")).alias("c")).select("value", F.col("c.root").alias("root"), F.col("c.given").alias("given"))
    people = choice.select("root", "given").distinct()
    unsure = kept.join(choice.select("value"), "value", "left_anti")
    people = stage_table(people)
    # how many people of a family root fit: by given name, by initial, or all; one row for each, so that a
    # family name that very many bear is never joined with all its people
    of_letter = people.groupBy("root", F.substring("given", 1, 1).alias("initial")).agg(F.count(F.lit(1)).alias("n"), F.max("given").alias("given"))
    of_root = people.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.max("given").alias("given"))
    asks = unsure.select("value", "root", "givens", "initial").distinct()
    by_given = asks.where(F.size("givens") > 0).select("value", "root", F.explode("givens").alias("given")).distinct().join(people, ["root", "given"]).select("value", "root", "given", F.lit(1).cast("long").alias("n"))
    by_letter = asks.where((F.size("givens") == 0) & (F.col("initial") != "")).select("value", "root", "initial").distinct().join(of_letter, ["root", "initial"]).select("value", "root", "given", "n")
    by_root = asks.where((F.size("givens") == 0) & (F.col("initial") == "")).select("value", "root").distinct().join(of_root, "root").select("value", "root", "given", "n")
    options = stage_table(by_given.unionByName(by_letter).unionByName(by_root))
    chosen = F.struct("root", "given")
    counted = options.groupBy("value").agg(F.max("n").alias("most"), F.max(chosen).alias("c"), F.min(chosen).alias("least"))
    one = (F.col("most") == 1) & (F.col("c") == F.col("least"))
    single = counted.where(one).select("value", "c.root", "c.given")
    # several fit: the one that uses the same mailbox name elsewhere
    locals_of = full.where("local <> ''").select("root", "given", "local").distinct()
    fits = ((F.size("givens") > 0) & F.array_contains("givens", F.col("given"))) | ((F.size("givens") == 0) & ((F.col("initial") == "") | (F.col("initial") == F.substring("given", 1, 1))))
    same_local = (
        unsure.join(counted.where(~one).select("value"), "value", "left_semi")
        .where("local <> ''")
        .select("value", "root", "local", "givens", "initial")
        .distinct()
        .join(locals_of, ["root", "local"])
        .where(fits)
        .join(people, ["root", "given"], "left_semi")
        .groupBy("value")
        .agg(F.min(chosen).alias("least"), F.max(chosen).alias("c"))
        .where("c = least")
        .select("value", "c.root", "c.given")
    )
    found = choice.unionByName(single).unionByName(same_local).select("value", F.concat_ws(" ", "given", "root").alias("person"))
    # nobody with a full name fits: equal readings belong together
    alone = (
        unsure.join(options.select("value").distinct(), "value", "left_anti")
        .select("value", F.concat_ws(" ", F.when(F.size("givens") > 0, F.concat_ws("/", "givens")).otherwise(F.concat("initial", F.lit("."))), "root").alias("person"), "strength")
        .groupBy("value")
        .agg(F.max(F.struct("strength", "person")).alias("c"))
        .select("value", "c.person")
    )
    found = stage_table(found.unionByName(alone))
    # no family name at all: the mailbox decides, if one person only uses it
    rest = read.where("mailbox <> ''").join(found.select("value"), "value", "left_anti").select("value", "mailbox", "givens").distinct()
    users = (
        read.where("mailbox <> ''")
        .select("value", "mailbox")
        .distinct()
        .join(found, "value")
        .groupBy("mailbox")
        .agg(F.count_distinct("person").alias("n"), F.max("person").alias("person"))
    )
    by_box = (
        rest.join(users, "mailbox", "left")
        .where("n is null or n = 1")
        .select("value", F.coalesce("person", F.concat(F.lit("@"), F.col("mailbox"))).alias("person"))
        .groupBy("value")
        .agg(F.max("person").alias("person"))
    )
    everyone = raw.select("value").distinct()
    out = stage_table(everyone.join(found.unionByName(by_box), "value", "left").select("value", "person"))
    return out


def same_person_pairs(people: DataFrame) -> DataFrame:
    """Pairs ``a`` < ``b`` of different values of one person, from :func:`link_people`."""
    known = people.where("person is not null")
    several = known.groupBy("person").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("person")
    kept = known.join(several, "person")
    a, b = kept.alias("a"), kept.alias("b")
    return a.join(b, (F.col("a.person") == F.col("b.person")) & (F.col("a.value") < F.col("b.value"))).select(F.col("a.value").alias("a"), F.col("b.value").alias("b"))


__all__ = ["fold_letters", "lcs_ratio", "link_people", "read_person", "same_person_pairs", "token_roots"]
