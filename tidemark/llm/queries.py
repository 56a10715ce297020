"""Queries of the training-data operators and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.contamination import leaked_items, without_leaks
from tidemark.llm.cooccurrence import cooccurrence
from tidemark.llm.handwritten import classify_files, not_handwritten
from tidemark.llm.names import link_people, same_person_pairs
from tidemark.llm.packing import pack_documents
from tidemark.llm.quantiles import ERROR_BOUND, bisect_percentiles, merge_partials, partial_counts, percentiles
from tidemark.llm.ranking import ideal_point_ranking
from tidemark.llm.topn import top_n_per_group
from tidemark.llm.visual import visual_classes, visual_pairs
from tidemark.session import read_table, stage_table

_PERCENTS = (50, 90, 99)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of paths that change together at least eight times and five times as often as by chance."""
    pairs = cooccurrence(read_table(spark, sf_dir, "changes"), "rev", "path", min_support=8, min_lift=5)
    return pairs.select(F.col("item_a").alias("path_a"), F.col("item_b").alias("path_b"))


def p1_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs with their counts, lift and pointwise mutual information."""
    pairs = cooccurrence(read_table(spark, sf_dir, "changes"), "rev", "path", min_support=8, min_lift=5)
    return pairs.select(
        F.col("item_a").alias("path_a"), F.col("item_b").alias("path_b"), "n_a", "n_b", "n_ab", "n", F.round("lift", 6).alias("lift"), F.round("pmi", 6).alias("pmi")
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three authors with the greatest share of every path."""
    best = top_n_per_group(read_table(spark, sf_dir, "knowledge_shares"), "path", "author", "k_norm", n=3)
    return best.select(F.col("group").alias("path"), F.col("item").alias("author"), "pos")


def _distinct_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "commits").select("rev", "canonical_author", "la", "date").distinct()


def p3_commit_la(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of the added lines per author; repeated rows count once."""
    return percentiles(_distinct_commits(spark, sf_dir), ["canonical_author"], "la", _PERCENTS)


def p3_change_loc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of the added lines per kind of change; repeated rows count once."""
    rows = read_table(spark, sf_dir, "changes").select("rev", "path", "change_type", "loc_added").distinct()
    return percentiles(rows, ["change_type"], "loc_added", _PERCENTS)


def p3_strata_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One quantile curve, by ten percent, per language, size class and metric from all measured rows.

    Each value of a row's array stands for an equal part of the row's functions (in millionths); a row's
    curve is known to one step of its array, which is the error of the joint curve.
    """
    rows = read_table(spark, sf_dir, "strata").select("artifact_id", "lang", "sloc_min", "sample_functions", F.explode("metrics").alias("m")).distinct()
    values = (
        rows.select("lang", "sloc_min", "m.metric", "sample_functions", F.filter("m.quantiles", lambda x: x.isNotNull() & ~F.isnan(x)).alias("q"))
        .where(F.size("q") > 0)
        .select("lang", "sloc_min", "metric", F.floor(F.col("sample_functions") * 1_000_000 / F.size("q")).cast("long").alias("weight"), F.explode("q").alias("value"))
    )
    return percentiles(values, ["lang", "sloc_min", "metric"], "value", tuple(range(0, 101, 10)), weight="weight")


def p3_portions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles joined from the partial counts of every quarter of a year, against the exact ones."""
    rows = stage_table(_distinct_commits(spark, sf_dir).withColumn("portion", F.quarter("date")))
    partials = partial_counts(rows, ["portion", "canonical_author"], "la")
    merged = merge_partials([partials.where(f"portion = {k}").drop("portion") for k in (1, 2, 3, 4)] + [partials.where("portion is null").drop("portion")], ["canonical_author"])
    joined = bisect_percentiles(merged, ["canonical_author"], _PERCENTS).withColumnRenamed("value", "joined").drop("weight")
    exact = percentiles(rows, ["canonical_author"], "la", _PERCENTS)
    same = F.col("e.canonical_author").eqNullSafe(F.col("j.canonical_author")) & (F.col("e.percent") == F.col("j.percent"))
    return exact.alias("e").join(joined.alias("j"), same, "left").select(
        "e.canonical_author",
        "e.percent",
        "e.value",
        F.coalesce(F.abs(F.col("j.joined") - F.col("e.value")) <= ERROR_BOUND * F.abs("e.value"), F.lit(False)).alias("within_error"),
    )


def commit_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every canonical author of commits with the raw names and addresses it was seen with."""
    commits = read_table(spark, sf_dir, "commits").where("canonical_author is not null").groupBy("canonical_author", "author_name", "author_email").agg(F.lit(False).alias("machine"))
    aliases = read_table(spark, sf_dir, "author_aliases").select(F.col("canonical").alias("canonical_author"), F.col("raw_name").alias("author_name"), F.col("raw_email").alias("author_email"), F.col("is_bot").alias("machine"))
    occurring = commits.select("canonical_author").distinct()
    written = occurring.select(
        "canonical_author",
        F.regexp_extract("canonical_author", r"^(.*?)\s*<", 1).alias("author_name"),
        F.regexp_extract("canonical_author", r"<([^>]*)>\s*$", 1).alias("author_email"),
        F.lower("canonical_author").contains("[bot]").alias("machine"),
    )
    return commits.unionByName(aliases.join(occurring, "canonical_author", "left_semi")).unionByName(written)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of canonical authors that denote the same human."""
    people = link_people(commit_identities(spark, sf_dir), "canonical_author", "author_name", "author_email", "machine")
    return same_person_pairs(people).select(F.col("a").alias("author_a"), F.col("b").alias("author_b"))


def p4_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The person each canonical author denotes; null for machines and nameless authors."""
    people = link_people(commit_identities(spark, sf_dir), "canonical_author", "author_name", "author_email", "machine")
    return people.select(F.col("value").alias("canonical_author"), "person")


def p5_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place for every revision by lines added, developers and entropy together, riskiest first."""
    ranked = ideal_point_ranking(read_table(spark, sf_dir, "commits"), "rev", {"la": 1.0, "ndev": 1.0, "entropy": 1.0})
    return ranked.select(F.col("key").alias("rev"), "place", F.round("closeness", 6).alias("closeness"))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of every distinct path of changes, by its blob where there is one."""
    paths = read_table(spark, sf_dir, "changes").where("path is not null").select("path").distinct()
    return classify_files(paths.join(read_table(spark, sf_dir, "blobs").select("path", "lang", "content"), "path", "left"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of changes whose file is generated, packed, copied in or data."""
    return not_handwritten(_verdicts(spark, sf_dir))


def p6_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of changes that describe hand-written work, prose and settings included."""
    changes = read_table(spark, sf_dir, "changes").select("rev", "path", "change_type", "loc_added", "loc_deleted").where("path is not null")
    return changes.distinct().join(not_handwritten(_verdicts(spark, sf_dir)), "path", "left_anti")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document or piece, 2,048 tokens each."""
    return pack_documents(read_table(spark, sf_dir, "documents"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are: tokens, containers, and the fewest that could hold the tokens."""
    used = p8_containers(spark, sf_dir).groupBy("container").agg(F.sum("n_tokens").alias("used"))
    return used.agg(F.sum("used").alias("tokens"), F.count(F.lit(1)).alias("containers"), F.ceil(F.sum("used") / 2048).alias("fewest"), F.max("used").alias("fullest"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the held-out items they give away."""
    return leaked_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of the documents that give nothing away."""
    docs = read_table(spark, sf_dir, "documents")
    leaks = leaked_items(docs, read_table(spark, sf_dir, "eval_items"))
    return without_leaks(docs.select("doc_id").distinct(), leaks)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents with different text that show the same."""
    return visual_pairs(read_table(spark, sf_dir, "documents"))


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document that is not blank, and how many different texts it holds."""
    return visual_classes(read_table(spark, sf_dir, "documents")).select("doc_id", F.hex("shown").alias("class_id"), "variants")


QUERIES = {
    "p1_found": p1_found,
    "p1_lift": p1_lift,
    "p2_found": p2_found,
    "p3_commit_la": p3_commit_la,
    "p3_change_loc": p3_change_loc,
    "p3_strata_curves": p3_strata_curves,
    "p3_portions": p3_portions,
    "p4_found": p4_found,
    "p4_people": p4_people,
    "p5_ranking": p5_ranking,
    "p6_found": p6_found,
    "p6_remaining": p6_remaining,
    "p8_containers": p8_containers,
    "p8_fill": p8_fill,
    "p9_found": p9_found,
    "p9_clean": p9_clean,
    "p10_found": p10_found,
    "p10_classes": p10_classes,
}

_PAIRS = """
WITH d AS (SELECT DISTINCT rev, path FROM changes WHERE rev IS NOT NULL AND path IS NOT NULL),
n AS (SELECT count(DISTINCT rev) AS n FROM d),
s AS (SELECT path, count(*) AS n FROM d GROUP BY path),
e AS (SELECT d.* FROM d JOIN s USING (path) WHERE s.n >= 8),
p AS (SELECT a.path AS path_a, b.path AS path_b, count(*) AS n_ab FROM e a JOIN e b ON a.rev = b.rev AND a.path < b.path GROUP BY 1, 2 HAVING count(*) >= 8)
"""
_RANK = """
SELECT {g}, percent, min(v) AS value, max(total) AS weight FROM (
  SELECT {g}, v, sum(w) OVER (PARTITION BY {g} ORDER BY v)::BIGINT AS upto, sum(w) OVER (PARTITION BY {g})::BIGINT AS total
  FROM (SELECT {g}, {v} AS v, sum({w})::BIGINT AS w FROM ({rows}) GROUP BY ALL)) c,
  (SELECT unnest({p})::INTEGER AS percent)
WHERE upto >= greatest(1, (total * percent + 99) // 100) GROUP BY ALL
"""
_LA = "SELECT DISTINCT rev, canonical_author, la FROM commits WHERE la IS NOT NULL"

_PLACES = f"""
WITH raw AS (SELECT rev, {", ".join(f"CASE WHEN isfinite({c}::DOUBLE) THEN round_even(greatest(-9e12, least(9e12, {c}::DOUBLE)) * 1000000, 0)::BIGINT END AS {c}" for c in ("la", "ndev", "entropy"))} FROM commits WHERE rev IS NOT NULL),
it AS MATERIALIZED (SELECT rev, la, ndev, entropy FROM (SELECT *, row_number() OVER (PARTITION BY rev ORDER BY la DESC NULLS LAST, ndev DESC NULLS LAST, entropy DESC NULLS LAST) AS k FROM raw) WHERE k = 1),
{", ".join(f"q_{c} AS (SELECT min(v) FILTER (k * 100 >= n) AS lo, min(v) FILTER (k * 100 >= 50 * n) AS mid, min(v) FILTER (k * 100 >= 99 * n) AS hi FROM (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) AS k, count(*) OVER () AS n FROM it WHERE {c} IS NOT NULL))" for c in ("la", "ndev", "entropy"))},
cap AS MATERIALIZED (SELECT rev, {", ".join(f"greatest(q_{c}.lo, least(q_{c}.hi, coalesce(it.{c}, q_{c}.mid))) AS {c}" for c in ("la", "ndev", "entropy"))} FROM it, q_la, q_ndev, q_entropy),
len AS (SELECT {", ".join(f"1.0::DOUBLE / sqrt(sum({c}::HUGEINT * {c})::DOUBLE) AS {c}" for c in ("la", "ndev", "entropy"))} FROM cap),
d AS (SELECT rev, {", ".join(f"(q_{c}.hi - cap.{c})::DOUBLE * len.{c} AS n_{c}, (cap.{c} - q_{c}.lo)::DOUBLE * len.{c} AS f_{c}" for c in ("la", "ndev", "entropy"))} FROM cap, len, q_la, q_ndev, q_entropy),
s AS (SELECT rev, sqrt(n_la * n_la + n_ndev * n_ndev + n_entropy * n_entropy) AS n, sqrt(f_la * f_la + f_ndev * f_ndev + f_entropy * f_entropy) AS f FROM d),
c AS (SELECT rev, round(CASE WHEN n + f > 0 THEN f / (n + f) ELSE 0 END, 12) AS closeness FROM s)
SELECT rev, row_number() OVER (ORDER BY closeness DESC, rev) AS place, round(closeness, 6) AS closeness FROM c"""

SQL = {
    "p1_found": _PAIRS + "SELECT path_a, path_b FROM p JOIN s a ON a.path = path_a JOIN s b ON b.path = path_b, n WHERE n_ab * n.n >= 5 * a.n * b.n",
    "p1_lift": _PAIRS
    + """SELECT path_a, path_b, a.n AS n_a, b.n AS n_b, n_ab, n.n AS n, round(n_ab::DOUBLE * n.n / (a.n::DOUBLE * b.n), 6) AS lift,
 round(ln(n_ab::DOUBLE * n.n / (a.n::DOUBLE * b.n)), 6) AS pmi
 FROM p JOIN s a ON a.path = path_a JOIN s b ON b.path = path_b, n WHERE n_ab * n.n >= 5 * a.n * b.n""",
    "p2_found": """
SELECT path, author, pos FROM (
  SELECT path, author, row_number() OVER (PARTITION BY path ORDER BY k DESC, author) AS pos FROM (
    SELECT path, author, max(k_norm) AS k FROM knowledge_shares
    WHERE author IS NOT NULL AND k_norm IS NOT NULL AND NOT isnan(k_norm) AND path IS NOT NULL GROUP BY 1, 2)) WHERE pos <= 3""",
    "p3_commit_la": _RANK.format(g="canonical_author", v="la", w="1", rows=_LA, p="[50, 90, 99]"),
    "p3_change_loc": _RANK.format(
        g="change_type", v="loc_added", w="1", rows="SELECT DISTINCT rev, path, change_type, loc_added FROM changes WHERE loc_added IS NOT NULL", p="[50, 90, 99]"
    ),
    "p3_strata_curves": _RANK.format(
        g="lang, sloc_min, metric",
        v="value",
        w="weight",
        rows="""SELECT lang, sloc_min, metric, floor(sample_functions * 1000000 / len(q))::BIGINT AS weight, unnest(q) AS value FROM (
  SELECT lang, sloc_min, sample_functions, m.metric AS metric, list_filter(m.quantiles, lambda x: x IS NOT NULL AND NOT isnan(x)) AS q
  FROM (SELECT DISTINCT artifact_id, lang, sloc_min, sample_functions, unnest(metrics) AS m FROM strata)) WHERE len(q) > 0""",
        p="range(0, 101, 10)",
    ),
    "p5_ranking": _PLACES,
    "p3_portions": "SELECT canonical_author, percent, value, true AS within_error FROM ("
    + _RANK.format(g="canonical_author", v="la", w="1", rows=_LA, p="[50, 90, 99]")
    + ")",
}
