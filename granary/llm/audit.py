r"""Audit of filters that interact: what each order of five filters keeps, removes and loses, from one pass over the texts.

A document's failures are a mask of five bits. For each part and label the pass aggregates 32 signed sums, one for each
set of filters: a document counts +1 if it fails an even number of the set's filters, else -1. That is the Walsh-Hadamard
transform of the 32 cells of masks; a second transform, divided by 32, gives the cells back exactly, as all sums are whole
numbers. All 120 orders are then evaluated from the cells, with no further look at a document. Of a cell of k failures
each failing filter is the first of them in 120 / k orders, so Shapley sums have a closed form.

Whether an equal text has a smaller id is the only question across documents. Equal texts are found by their SHA-256: the
least id of each digest, combined before the shuffle, then joined by digest and id, so that a text which a third of
all documents share meets one document a key. Texts are read once; what is kept of them is a digest and a mask.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import columns_kept, cut, read

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_COUNTS = ("n", "good", "toxic")


def text_failures(text: Column) -> Column:
    """The first four bits of a text's mask: too few words, too few distinct, too many capitals, a sign of markup."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, _LETTERS, ""))
    fails = [n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * F.length(text), text.rlike("[#$%&*|]")]
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)])


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) of every row of ``docs``."""
    own = columns_kept(docs, {c: c for c in ("doc_id", "text", "lang")})
    text = F.coalesce("text", F.lit(""))
    seen = cut(own.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text_failures(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest")))
    named = seen.filter("doc_id IS NOT NULL")
    firsts = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = columns_kept(labels, {c: c for c in ("doc_id", "quality", "toxic")}).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    copy = F.when(F.col("first"), 0).otherwise(1 << 4)
    known = named.join(firsts, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    rows = known.select("part", F.col("mask").bitwiseOR(copy).alias("mask"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    return rows.unionByName(seen.filter("doc_id IS NULL").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic")))


def _sign(mask: Column, subset: Column) -> Column:
    return 1 - 2 * (F.bit_count(mask.bitwiseAND(subset)) % 2)


def spectrum(rows: DataFrame) -> DataFrame:
    """(part, good, toxic, w): the 32 signed sums of each part and label, ``w[s]`` that of the set of filters ``s``."""
    sums = [F.sum(_sign(F.col("mask"), F.lit(s)).cast("long")).alias(f"w{s}") for s in range(CELLS)]
    return rows.groupBy("part", "good", "toxic").agg(*sums).select("part", "good", "toxic", F.array(*[F.col(f"w{s}") for s in range(CELLS)]).alias("w"))


def _total(cells: Column, weight: Column) -> Column:
    """The sum of cells times weights."""
    return F.aggregate(F.zip_with(cells, weight, lambda c, x: c * x), F.lit(0).cast("long"), lambda a, x: a + x)


def cells(sums: DataFrame) -> DataFrame:
    """(part, n, good, toxic): of each part the documents in each of the 32 cells, and those of them that are good and toxic."""
    every = F.sequence(F.lit(0), F.lit(CELLS - 1))
    back = lambda w: F.transform(every, lambda m: _total(w, F.transform(every, lambda s: _sign(m, s).cast("long"))))
    # the transform is linear: labels are added before it is inverted
    add = lambda name, where: [F.sum(F.when(where, F.col("w")[s]).otherwise(0)).alias(f"{name}{s}") for s in range(CELLS)]
    merged = sums.groupBy("part").agg(*add("n", F.lit(True)), *add("good", F.col("good")), *add("toxic", F.col("toxic")))
    whole = merged.select("part", *[F.array(*[F.col(f"{name}{s}") for s in range(CELLS)]).alias(name) for name in _COUNTS])
    return whole.select("part", *[F.transform(back(F.col(name)), lambda x: F.shiftright(x, 5)).alias(name) for name in _COUNTS])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows a part.

    A null text is empty, a null language the empty part. A document without an id is no copy, makes no other one a copy
    and has no label; rows that repeat an id and a text are no copies of one another. Labels may repeat: one that says 1
    is enough. Texts are read whole, however long; no tie matters; other columns don't matter, whatever their names. An
    empty table of documents gives no rows; an empty one of labels loses nothing.
    """
    steps = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(sum(1 << FILTERS.index(f) for f in o[:k])).alias("before"), F.lit(1 << FILTERS.index(o[k])).alias("own")) for o in ORDERS for k in range(len(o))])
    at = cells(spectrum(masks(docs, labels))).select("part", *_COUNTS, F.inline(steps))
    every = F.sequence(F.lit(0), F.lit(CELLS - 1))
    own, before = F.col("own"), F.col("before")
    fails = lambda m: m.bitwiseAND(own) > 0
    free = lambda m: m.bitwiseAND(before) == 0
    over = lambda name, where: _total(F.col(name), F.transform(every, lambda m: where(m).cast("long")))
    removed = lambda m: fails(m) & free(m)
    firsts = F.transform(every, lambda m: F.when(fails(m), F.lit(len(ORDERS)) / F.greatest(F.bit_count(m), F.lit(1))).otherwise(0).cast("long"))
    return at.select(
        "part",
        "filter_order",
        "step",
        over("n", lambda m: m.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
        over("n", removed).alias("removed"),
        over("n", lambda m: fails(m) & ~free(m)).alias("redundant"),
        F.col("n")[own].alias("unique_fails"),
        over("good", removed).alias("good_lost"),
        over("toxic", removed).alias("toxic_lost"),
        _total(F.col("n"), firsts).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), marks AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
), failing AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
    100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false) AS e
  FROM texts LEFT JOIN marks USING (doc_id)
), cells AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask,
    count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM failing GROUP BY ALL
), orders AS (
  SELECT '' AS o UNION ALL
  SELECT o || f FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE length(o) < 5 AND NOT contains(o, f)
), steps AS (
  SELECT o AS filter_order, s::INT AS step, o[s:s] AS f,
    (1 << (ascii(o[s:s]) - 65)) AS own,
    list_sum([0] || list_transform(range(1, s), lambda k: 1 << (ascii(o[k:k]) - 65)))::INT AS before
  FROM orders, range(1, 6) t(s) WHERE length(o) = 5
), told AS (
  SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (WHERE mask & (own | before) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE mask & own > 0 AND mask & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE mask & own > 0 AND mask & before > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE mask = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & own > 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE mask & own > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM told
"""
