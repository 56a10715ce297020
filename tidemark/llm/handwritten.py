"""Generated, packed, vendored and data files among source files.

1. Every file is read once, whole. The composition of its tokens tells generated, packed and data files;
   a copyright holder that is not the repository's own tells foreign ones. These files are the seeds.
2. An inverted index over *all* files holds the hashes of their lines, and of the pieces of their comments
   and paths (three words of a comment in a row, a folder, the end of a file name). Two things are read
   from it:

   * containment: a file of which at least ``containment`` of the rare lines, or of all lines with ``RUN`` of
     them in a row, occur in one file of another repository was copied in, whether or not either carries a
     mark. Exact copies count as one text, so that a library copied a million times keeps its lines rare.
     Of a family of equal texts that nothing marks, the longest (then that of the first repository) is taken
     for the original.
   * association: a piece that stands mostly in seeds, in several repositories, is evidence for its class.
     Common folder and file names start with a few imagined files in favour of their class, which the
     corpus overrules when it says otherwise.
3. Files that stay without evidence are hand-written.

Rare are lines in at most ``rare`` texts; for them whole posting lists meet. For all lines, common ones
included, so many of a text's least frequent lines are looked up that the remaining ones are too few for a
copy. The ``HUBS`` most promising texts with such a line are tried first; a text that is no copy of theirs
meets every text of other repositories with such a line.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import drop_staged, stage_table

# Languages that hold prose or settings.
PROSE = ("markdown", "text", "toml", "yaml", "json", "ini", "rst", "xml")
# Usual names of folders (d:), ends of file names (s:) and comments (c:) of files that nobody
# writes by hand. Weak evidence: each counts as a few imagined files.
USUAL = {
    "vendored": "d:vendor d:vendored d:third_party d:third-party d:thirdparty d:3rdparty d:node_modules d:bower_components d:external d:externals d:deps",
    "generated": "d:gen d:generated d:autogen d:generated-sources s:.pb s:_pb2 s:.g s:.generated s:.designer s:.lock",
    "packed": "d:dist s:.min s:-min s:.bundle s:.chunk",
}
USUAL_COMMENTS = {"generated": ("^ code generated", "^ auto generated", "^ autogenerated file", "^ generated by")}
IMAGINED = 6
CLASSES = ("generated", "packed", "data", "vendored")
#: Least share of seeds among the files with a piece, by class: composition sees most made files, a holder only some foreign ones.
BROAD = {"generated": 0.3, "packed": 0.3, "data": 0.3, "vendored": 0.15}
NARROW = dict.fromkeys(CLASSES, 0.5)
RUN = 4
#: Texts of a line that are tried before all of them.
HUBS = 4
#: Texts of a line and repository that one task joins.
BLOCK = 4096

_HOLDER = regex.compile(
    r"(?:copyright|\(c\)|©)(?:\s*\([cC]\))?(?:\s*\d{4}(?:\s*-\s*\d{4})?,?)?(?:\s+by)?(?:\s+the)?\s+([^\W\d][\w -]*?)(?=\s+(?:team|authors?|contributors|maintainers|developers|project)\b|\s*[,.;|*]|\s*$)",
    regex.IGNORECASE,
)
_COMMENT = regex.compile(r"^\s*(?://|/\*|\*|#(?!include)|--|;|<!--|\"\"\"|%)")
_NUMBER = regex.compile(r"0x[0-9a-fA-F]+|\d+(?:\.\d+)?")
_PIECE = regex.compile(r"0x[0-9a-fA-F]+|\d+(?:\.\d+)?|[A-Za-z_]\w*|\S")
_VERSION = regex.compile(r"\d+(?:\.\d+)*")
_WORD = regex.compile(r"[^\W\d_]+|0")
_ENDING = regex.compile(r"[._-][^._-]+")
_HEX = regex.compile(r"(?=.*\d)[0-9a-f]{4,}")


def _counting_lines(lines: Sequence[str]) -> int:
    """How often a line repeats the one before it with a number that is greater by one."""
    hits, last, last_number = 0, None, None
    for line in lines:
        first = _NUMBER.search(line)
        shape = _NUMBER.sub("#", line)
        number = int(first[0]) if first and first[0].isdigit() and len(first[0]) < 18 else None
        if number is not None and shape == last and last_number is not None and number == last_number + 1:
            hits += 1
        last, last_number = shape, number
    return hits


def by_composition(text: str) -> str:
    """The verdict of the token composition: ``generated``, ``packed``, ``data`` or empty."""
    lines = [line for line in text.splitlines() if line.strip()]
    code = [line for line in lines if not _COMMENT.match(line)]
    # a comment in front of packed code does not hide it
    packed_head = [line[line.find("*/") + 2 :] for line in lines if line.lstrip().startswith("/*") and 0 <= line.find("*/") < len(line) - 200]
    code += packed_head
    if not code:
        return ""
    if len(code) >= 5 and _counting_lines(lines) >= max(4, len(code) // 3):
        return "generated"
    longest = max(code, key=len)
    if len(longest) >= 300 and len(longest) >= 0.5 * sum(map(len, code)):
        pieces = _PIECE.findall(longest)
        values = sum(len(p) for p in pieces if p[0].isdigit())
        widest = max(map(len, pieces))
        quoted = longest.count('"') + longest.count("'")
        numbers = sum(p[0].isdigit() for p in pieces)
        if widest >= 200 or values >= 0.3 * len(longest) or numbers >= 0.15 * len(pieces) and quoted >= 0.08 * len(pieces):
            return "data"
        if sum(ch.isspace() for ch in longest) < 0.1 * len(longest):
            return "packed"
    rows = [line.split(",") for line in code if line.count(",") >= 2]
    if len(code) >= 5 and len(rows) >= 0.8 * len(code):
        cells = [c.strip() for row in rows for c in row]
        if sum(bool(_NUMBER.fullmatch(c)) for c in cells) >= 0.5 * len(cells) and len({len(r) for r in rows[:-1]}) <= 2:
            return "data"
    return ""


def comment_of(line: str) -> str:
    """The text of a comment line, without what follows a closed block; empty for code."""
    if not _COMMENT.match(line):
        return ""
    end = line.find("*/")
    return line if end < 0 else line[:end]


def pieces_of(path: str, comments: Sequence[str], repo_depth: int = 2) -> set[str]:
    """What the index holds of a path and its comments: folders, ends of the name, three words in a row."""
    *folders, name = path.lower().split("/")
    out = {f"d:{f}" for f in folders[repo_depth:]}
    for end in _ENDING.findall(name):
        out.add(f"s:{end[0]}{'hex' if _HEX.fullmatch(end[1:]) else end[1:]}")
    for text in comments:
        words = ["^", *_WORD.findall(_VERSION.sub("0", text.lower())), "$"]
        out.update("c:" + " ".join(words[k : k + 3]) for k in range(len(words) - 2))
    return out


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


_READ = T.StructType(
    [T.StructField("made", T.StringType()), T.StructField("holder", T.StringType())]
    + [T.StructField(name, T.ArrayType(T.LongType())) for name in ("lines", "runs", "pieces")]
)


def read_file(path: str, lang: str | None, content: str | None, shortest: int = 16) -> tuple[str, str, list[int], list[int], list[int]]:
    """Composition verdict, copyright holder, and hashes of lines, runs of lines and pieces of one file.

    Prose and settings are never cases. A null content leaves the path to decide.
    """
    if lang in PROSE:
        return "prose", "", [], [], []
    lines = (content or "").splitlines()
    comments = [c for c in map(comment_of, lines) if c]
    holder = next((m[1].strip().lower() for m in map(_HOLDER.search, comments) if m), "")
    pieces = sorted(map(_hash, pieces_of(path, comments)))
    made = by_composition(content) if content else ""
    if made:
        return made, holder, [], [], pieces
    body = [_hash(s) for line in lines if len(s := line.strip()) >= shortest]
    runs = {_hash(repr(body[k : k + RUN])) for k in range(len(body) - RUN + 1)}
    return "", holder, sorted(set(body)), sorted(runs), pieces


@F.pandas_udf(_READ)
def _read(paths: pd.Series, langs: pd.Series, contents: pd.Series) -> pd.DataFrame:
    rows = [read_file(p, lang, c) for p, lang, c in zip(paths, langs, contents, strict=True)]
    return pd.DataFrame(rows, columns=["made", "holder", "lines", "runs", "pieces"])


def _usual(spark) -> DataFrame:
    """The usual names and comments as pieces with their class: some forty rows."""
    rows = [(_hash(p), c) for c, names in USUAL.items() for p in names.split()] + [(_hash(f"c:{p}"), c) for c, texts in USUAL_COMMENTS.items() for p in texts]
    return spark.createDataFrame(rows, "piece long, usual string")


def _own_holders(files: DataFrame, usual: DataFrame) -> DataFrame:
    """The own copyright holder of every repository that names one: ``repo``, ``own``.

    It is the holder most of its files name, files in folders for foreign code apart. Where fewer than three
    files name it, the holder that most repositories name is preferred if this repository names it as well.
    """
    foreign = files.select("path", F.explode("pieces").alias("piece")).join(F.broadcast(usual.where("usual = 'vendored'")), "piece").select("path").distinct()
    named = files.where("holder <> '' and made = ''").join(foreign, "path", "left_anti").groupBy("repo", "holder").agg(F.count(F.lit(1)).alias("n"))
    spread = named.groupBy("holder").agg(F.count(F.lit(1)).alias("repos"))
    ranked = named.join(spread, "holder")
    order = F.struct(F.least("n", F.lit(3)).alias("a"), "repos", "n", "holder")
    return ranked.groupBy("repo").agg(F.max_by("holder", order).alias("own"))


def _associated(files: DataFrame, usual: DataFrame, least: dict[str, float], min_files: int, min_repos: int) -> DataFrame:
    """Pieces that are evidence for a class: ``piece``, ``class``.

    The lower 95 % bound of the share of files of the class among those with the piece decides; it must also
    exceed three times the share among all files (at most 0.8 is asked for). Usual pieces
    have ``IMAGINED`` files of their class on top and need no minimum. Counts are combined map-side, per
    repository first.
    """
    marked = [F.count_if(F.col("class") == c).alias(c) for c in CLASSES]
    per_repo = files.where("made <> 'prose'").select("repo", "class", F.explode("pieces").alias("piece")).groupBy("piece", "repo").agg(F.count(F.lit(1)).alias("n"), *marked)
    total = per_repo.groupBy("piece").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repos"), *[F.sum(c).alias(c) for c in CLASSES])
    joined = usual.join(total, "piece", "full").na.fill(0, ["n", "repos", *CLASSES])
    best = F.greatest(*[F.struct((F.col(c) + F.when(F.col("usual") == c, IMAGINED).otherwise(0)).alias("k"), F.lit(c).alias("class")) for c in CLASSES])
    n = (F.col("n") + F.when(F.col("usual").isNotNull(), IMAGINED).otherwise(0)).cast("double")
    p, z = F.col("best.k") / F.col("size"), 1.96
    lower = (p + z * z / 2 / F.col("size") - z * F.sqrt(p * (1 - p) / F.col("size") + z * z / 4 / F.col("size") / F.col("size"))) / (1 + z * z / F.col("size"))
    everywhere = files.where("made <> 'prose'").agg(*[F.coalesce(F.avg((F.col("class") == c).cast("double")), F.lit(0.0)).alias(f"share_{c}") for c in CLASSES])
    rate = F.coalesce(*[F.when(F.col("best.class") == c, F.greatest(F.lit(r), F.least(F.lit(0.8), 3 * F.col(f"share_{c}")))) for c, r in least.items()])
    scored = joined.join(F.broadcast(everywhere)).withColumn("best", best).withColumn("size", n).withColumn("lower", lower)
    return scored.where((F.col("usual").isNotNull() | ((F.col("n") >= min_files) & (F.col("repos") >= min_repos))) & (F.col("lower") >= rate)).select("piece", F.col("best.class").alias("class"))


def _by_pieces(files: DataFrame, evidence: DataFrame) -> DataFrame:
    """``files`` with the class most of their pieces speak for where they had none yet."""
    votes = files.where("class = ''").select("path", F.explode("pieces").alias("piece")).join(evidence.withColumnRenamed("class", "vote"), "piece")
    best = F.greatest(*[F.struct(F.count_if(F.col("vote") == c).alias("k"), F.lit(c).alias("c")) for c in CLASSES])
    said = votes.groupBy("path").agg(best.alias("b")).select("path", F.col("b.c").alias("said"))
    joined = files.join(said, "path", "left")
    took = (F.col("class") == "") & F.col("said").isNotNull()
    return joined.withColumn("route", F.when(took, "pieces").otherwise(F.col("route"))).withColumn("class", F.when(took, F.col("said")).otherwise(F.col("class"))).drop("said")


def _may_be_source() -> Column:
    """Whether the text ``b`` (``size_b``, ``first_b``, ...) can be what the text ``a`` of the repository ``first`` was copied from."""
    before = (F.col("size_b") > F.col("size")) | ((F.col("size_b") == F.col("size")) & (F.struct("first_b", "b") < F.struct("first", "a")))
    return (before & (_differs("first_b", "first") | _differs("last_b", "first"))) | _differs("v_first", "first") | _differs("v_last", "first")


def _differs(side: str, repo: str) -> Column:
    return F.coalesce(F.col(side) != F.col(repo), F.lit(False))


def _contained(asked: DataFrame, partners: DataFrame, on: list[str], texts: DataFrame) -> DataFrame:
    """The texts of ``asked`` that have lines enough, and a run of them, in common with one partner."""
    candidates = asked.join(partners, on).where(F.col("size_b") >= F.col("need")).where(_may_be_source()).select("a", "b").distinct()
    return (
        candidates.join(texts.select(F.col("text").alias("a"), "need", F.col("lines").alias("la"), F.col("runs").alias("ra")), "a")
        .join(texts.select(F.col("text").alias("b"), F.col("lines").alias("lb"), F.col("runs").alias("rb")), "b")
        .where(F.arrays_overlap("ra", "rb"))
        .where(F.size(F.array_intersect("la", "lb")) >= F.col("need"))
        .select(F.col("a").alias("text"))
        .distinct()
    )


def _copied(files: DataFrame, rare: int, min_lines: int, containment: float) -> tuple[DataFrame, list[DataFrame]]:
    """Paths of files that were copied in from another repository, by exact containment of their lines.

    A text that several repositories hold is copied everywhere but in the first of them, so that one question
    is left for each text: whether its file in the first repository has a source elsewhere.
    """
    plain, vendored = (F.when(F.col("class") == c, F.col("repo")) for c in ("", "vendored"))
    body = files.where("class in ('', 'vendored')").where(F.size("lines") >= min_lines).select("path", "repo", "class", "lines", "runs", F.xxhash64("lines").alias("text"))
    # one row for each distinct text, with the runs of all orders that its lines stand in
    texts = stage_table(
        body.groupBy("text")
        .agg(
            F.first("lines").alias("lines"),
            F.array_distinct(F.flatten(F.collect_set("runs"))).alias("runs"),
            F.min("repo").alias("first"),
            F.max("repo").alias("last"),
            F.min(plain).alias("plain"),
            F.min(vendored).alias("v_first"),
            F.max(vendored).alias("v_last"),
        )
        .withColumn("size", F.size("lines"))
        .withColumn("need", F.ceil(F.greatest(F.lit(float(min_lines)), containment * F.col("size"))).cast("int"))
    )
    about = texts.select(F.col("text").alias("b"), F.col("size").alias("size_b"), F.col("first").alias("first_b"), F.col("last").alias("last_b"), "v_first", "v_last")
    # lines of several texts; abroad are those that a text in another repository has as well
    ids = [F.xxhash64(c).alias(c) for c in ("first", "last")]
    lines = texts.select("text", *ids, F.explode("lines").alias("h"))
    counted = lines.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min(F.least("first", "last")).alias("lo"), F.max(F.greatest("first", "last")).alias("hi")).where("df > 1")
    shared = stage_table(lines.select("text", "h", F.col("first").alias("id")).join(counted, "h").select("text", "h", "df", F.expr("lo <> id or hi <> id").alias("abroad")))
    counts = shared.groupBy("text").agg(
        F.count_if("abroad").alias("n"), F.count_if(F.col("abroad") & (F.col("df") <= rare)).alias("n_rare"), F.count_if(F.col("df") > rare).alias("common")
    )
    asking = stage_table(
        texts.where((F.col("plain") == F.col("first")) & ~_differs("v_first", "first") & ~_differs("v_last", "first"))
        .join(counts.where(F.col("n") >= min_lines), "text")
        .select("text", "size", "need", "first", "n", "n_rare", F.greatest(F.lit(float(min_lines)), containment * (F.col("size") - F.col("common"))).alias("need_rare"))
    )
    rares = shared.where(F.col("df") <= rare)
    met = (
        rares.where("abroad")
        .join(asking.where("n_rare >= need_rare").select("text"), "text")
        .select("h", F.col("text").alias("a"))
        .join(rares.select("h", F.col("text").alias("b")), "h")
        .where("a <> b")
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("shared"))
        .where(F.col("shared") >= min_lines)
    )
    by_rare = stage_table(met.join(asking.withColumnRenamed("text", "a"), "a").where("shared >= need_rare").join(about, "b").where(_may_be_source()).select(F.col("a").alias("text")).distinct())
    # All lines: of n lines found abroad any n - need + 1 hold one that a source has; the least frequent ones are taken.
    left = asking.where("n >= need").join(by_rare, "text", "left_anti").select("text", "size", "need", "first", "n")
    least = F.slice(F.sort_array(F.collect_list(F.struct("df", "h"))), F.lit(1), (F.first("n") - F.first("need") + 1).cast("int"))
    keys = stage_table(
        shared.where("abroad").join(left, "text").groupBy("text", "size", "need", "first").agg(least.alias("least")).select(F.col("text").alias("a"), "size", "need", "first", F.explode("least.h").alias("h"))
    )
    partners = stage_table(shared.join(keys.select("h").distinct(), "h", "left_semi").select("h", F.col("text").alias("b")).join(about, "b"))
    # first the marked ones, then those that come before all others
    best = F.min(F.struct(F.col("v_first").isNull().alias("plain"), (-F.col("size_b")).alias("order"), "first_b", "b", "size_b", "last_b", "v_first", "v_last")).alias("hub")
    hubs = partners.groupBy("h", F.pmod(F.xxhash64("first_b"), F.lit(HUBS))).agg(best).select("h", "hub.*")
    by_hubs = stage_table(_contained(keys, hubs, ["h"], texts))
    # what no hub contains meets all texts that another repository holds, a repository's texts dealt to cells
    places = partners.withColumn("site", F.explode(F.array_distinct(F.array_compact(F.array("first_b", "last_b", "v_first", "v_last")))))
    cells = places.groupBy("h", "site").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("cells"))
    dealt = places.join(cells, ["h", "site"]).withColumn("cell", F.pmod(F.xxhash64("b"), "cells").cast("int")).drop("cells")
    asked = keys.join(by_hubs.withColumnRenamed("text", "a"), "a", "left_anti").join(cells, "h").where("site <> first").withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    by_all = stage_table(_contained(asked, dealt, ["h", "site", "cell"], texts))
    found = by_rare.unionByName(by_hubs).unionByName(by_all).withColumn("found", F.lit(True))
    held = texts.select("text", "first", "v_first", "v_last").join(found, "text", "left")
    copied = F.col("found").isNotNull() | _differs("first", "repo") | _differs("v_first", "repo") | _differs("v_last", "repo")
    out = stage_table(body.where("class = ''").select("path", "repo", "text").join(held, "text").where(copied).select("path"))
    return out, [texts, shared, asking, by_rare, keys, partners, by_hubs, by_all]


def classify_files(
    files: DataFrame,
    path: str = "path",
    lang: str = "lang",
    content: str = "content",
    repo_depth: int = 2,
    rare: int = 30,
    min_lines: int = 4,
    containment: float = 0.8,
    min_files: int = 5,
    min_repos: int = 3,
) -> DataFrame:
    """``path``, ``verdict`` and ``route`` of every file: generated, packed, vendored, data, prose or hand-written.

    The repository of a file is its first ``repo_depth`` folders. ``route`` tells what decided: composition,
    holder, pieces (associated pieces of comments or path), containment, or nothing.

    Defined cases: null paths are left out; of repeated paths the one with the longest content counts, a
    null content last; null language and content are allowed; empty files are hand-written unless their
    path says otherwise; other columns are ignored; an empty input gives no rows.
    """
    spark = files.sparkSession
    one = stage_table(
        files.select(F.col(path).alias("path"), F.col(lang).alias("lang"), F.col(content).alias("content"))
        .where("path is not null")
        .groupBy("path")
        .agg(F.max(F.struct(F.length("content").alias("n"), "content", "lang")).alias("f"))
        .select("path", F.substring_index("path", "/", repo_depth).alias("repo"), _read("path", "f.lang", "f.content").alias("r"))
        .select("path", "repo", "r.*")
    )
    usual = _usual(spark)
    own = _own_holders(one, usual)
    foreign = (F.col("holder") != "") & F.col("own").isNotNull() & (F.col("holder") != F.col("own"))
    made = F.col("made").isin("generated", "packed", "data")
    seeds = one.join(own, "repo", "left").select(
        "path",
        "repo",
        "made",
        "lines",
        "runs",
        "pieces",
        F.when(made, F.col("made")).when(foreign, "vendored").otherwise("").alias("class"),
        F.when(made, "composition").when(foreign, "holder").otherwise("").alias("route"),
    )
    seeds = stage_table(seeds)
    drop_staged(one)
    prose = stage_table(seeds.where("made = 'prose'").select("path", F.lit("prose").alias("verdict"), F.lit("").alias("route")))
    # a broad first reading of the pieces, then a narrow one with all files it found
    first = stage_table(_by_pieces(seeds.where("made <> 'prose'"), _associated(seeds, usual, BROAD, min_files, min_repos)))
    drop_staged(seeds)
    second = stage_table(_by_pieces(first, _associated(first, usual, NARROW, min_files, min_repos)))
    drop_staged(first)
    copied, used = _copied(second, rare, min_lines, containment)
    joined = second.select("path", "class", "route").join(copied.withColumn("copied", F.lit(True)), "path", "left")
    took = (F.col("class") == "") & F.col("copied").isNotNull()
    found = joined.select(
        "path",
        F.when(took, "vendored").when(F.col("class") == "", "hand-written").otherwise(F.col("class")).alias("verdict"),
        F.when(took, "containment").otherwise(F.col("route")).alias("route"),
    )
    out = stage_table(found.unionByName(prose))
    drop_staged(prose, second, copied, *used)
    return out


def not_handwritten(verdicts: DataFrame) -> DataFrame:
    """The paths of :func:`classify_files` that are no hand-written source of the project, prose apart."""
    return verdicts.where(~F.col("verdict").isin("prose", "hand-written")).select("path")
