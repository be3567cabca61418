"""Exact search by the first letters of words: anywhere in a line, or at its start.

Lines are (line_id, letters, codes). A table of suffix tokens (token, line_id, pos), written in ranges of the token,
turns "anywhere" into a range of strings that Parquet's statistics can skip by. A token holds at most ``MOST`` letters, so
the table grows with the letters of a line and not with their square; a longer query is checked on the line itself.

The table is worth its room where one corpus is asked very often. The functions ``.._in_lines`` give the same from the lines:
of those that hold the query's letters the ones with signs or other scripts among theirs are cut into tokens, in the task that
reads them, and no row is shuffled to be found.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.letters import OPERATORS, VARIANTS, char_codes, once, suffix_tokens, typed_keys, variant_codes

MOST = 16
_PLAIN = r"^[A-Za-z^&|\\]*\z"


def encode(lines: DataFrame, letters_col: str = "letters") -> DataFrame:
    return lines.withColumn("codes", char_codes(F.col(letters_col)))


def tokens(lines: DataFrame) -> DataFrame:
    """(token, line_id, pos, n) of every suffix of every line; ``n`` is the number of the line's letters."""
    return lines.select("line_id", F.length("letters").alias("n"), F.posexplode(suffix_tokens(F.col("codes"), MOST)).alias("pos", "token")).select("token", "line_id", "pos", "n")


def in_order(token_rows: DataFrame, files: int) -> DataFrame:
    """Tokens in ranges, so that a search reads few row groups; a token that many lines have lies in several files."""
    return token_rows.repartitionByRange(files, "token", "line_id").sortWithinPartitions("token", "line_id")


def write_tokens(lines: DataFrame, path: str, files: int) -> None:
    in_order(tokens(lines), files).write.parquet(path)


def query_string(keys: str) -> str:
    """The codes of a query in keys or in letters of the script."""
    return "".join(c if c in OPERATORS else f",{'0' if ord(c) < 100 else ''}{ord(c)}" for c in typed_keys(keys))


def _dotted(q: str) -> str:
    return ",".join(VARIANTS.get(c, c) for c in q.split(","))


def in_ranges(col: str | Column, keys: str) -> Column | None:
    """The range, or the two with the dotted variant, that a query selects; None for an empty query."""
    q = query_string(keys)
    if not q:
        return None
    c, variant = F.col(col) if isinstance(col, str) else col, _dotted(q)
    found = c.between(q, q + ",z")
    return found if variant == q else found | c.between(variant, variant + ",z")


def _long(keys: str) -> Column | None:
    """What a line must hold if the query is longer than a token."""
    q = query_string(keys)
    if len(typed_keys(keys)) <= MOST:
        return None
    return F.contains("codes", F.lit(q)) | F.contains("codes", F.lit(",".join(VARIANTS.get(c, c) for c in q.split(","))))


def _head(keys: str) -> str:
    return typed_keys(keys)[:MOST]


def anywhere(token_rows: DataFrame, lines: DataFrame, keys: str, limit: int | None = 20) -> DataFrame:
    """Lines that hold the letters in a row, with the first place; the shortest lines first, then by id."""
    cond, rest = in_ranges("token", _head(keys)), _long(keys)
    hit = token_rows.filter(F.lit(False) if cond is None else cond).groupBy("line_id").agg(F.min("pos").alias("match_pos"), F.min("n").alias("__n"))
    if limit is not None and rest is None:  # the best are known from the tokens alone; then their lines are read by id
        best = hit.orderBy("__n", "line_id").limit(limit).select("line_id", "match_pos").collect()  # 1000 at most
        if not best:
            return lines.limit(0).withColumn("match_pos", F.lit(0))
        own = lines.sparkSession.createDataFrame(best, "line_id long, match_pos int")
        return lines.filter(F.col("line_id").isin([r.line_id for r in best])).join(F.broadcast(own), "line_id").orderBy(F.length("letters"), "line_id")
    found = lines.join(hit.drop("__n"), "line_id")
    if rest is not None:  # the place is that of the whole query
        q = query_string(keys)
        variant = ",".join(VARIANTS.get(c, c) for c in q.split(","))
        place = F.least(*[F.when(F.instr("codes", x) > 0, F.instr("codes", x)) for x in (q, variant)])
        found = found.filter(rest).withColumn("match_pos", F.size(F.split(F.substring("codes", F.lit(1), place - 1), ",")) - 1)
    out = found.orderBy(F.length("letters"), "line_id")
    return out if limit is None else out.limit(limit)


def start(lines: DataFrame, keys: str, limit: int | None = 20) -> DataFrame:
    cond = in_ranges("codes", keys)
    out = lines.filter(F.lit(False) if cond is None else cond).withColumn("match_pos", F.lit(0)).orderBy(F.length("letters"), "line_id")
    return out if limit is None else out.limit(limit)


def count_anywhere(token_rows: DataFrame, keys: str, lines: DataFrame | None = None) -> DataFrame:
    """The number of lines that :func:`anywhere` would give without a limit. A query of over MOST letters needs the lines."""
    if len(typed_keys(keys)) > MOST:
        if lines is None:
            raise ValueError(f"a count by tokens alone takes at most {MOST} letters")
        return anywhere(token_rows, lines, keys, None).agg(F.count("*").alias("n"))
    cond = in_ranges("token", keys)
    return token_rows.filter(F.lit(False) if cond is None else cond).agg(F.countDistinct("line_id").alias("n"))


def _spelled(keys: str) -> list[str]:
    """The letters of a query and of its dotted variant: what no line is without that it selects."""
    q = query_string(keys)
    return list(dict.fromkeys(re.sub(r",(\d+)", lambda m: chr(int(m[1])), x) for x in (q, _dotted(q))))


def first_place(letters: Column, keys: str) -> Column:
    """Place, from 0, of the first suffix token of a line's letters that a query selects; null if there is none."""
    if not query_string(keys):
        return F.lit(None).cast("int")
    q, head = query_string(keys), _head(keys)

    def of_codes(codes: Column) -> Column:
        place = F.array_position(F.transform(suffix_tokens(codes, MOST), lambda t: in_ranges(t, head)), F.lit(True))
        if len(typed_keys(keys)) <= MOST:
            return F.when(place > 0, (place - 1).cast("int"))
        at = F.least(*[F.when(F.instr(codes, x) > 0, F.instr(codes, x)) for x in (q, _dotted(q))])  # the place is that of the whole query
        return F.when(at.isNotNull() & (place > 0), F.size(F.split(F.substring(codes, F.lit(1), at - 1), ",")) - 1)

    def of(s: Column) -> Column:
        holds = F.greatest(*[F.contains(s, F.lit(x)) for x in _spelled(head)], F.lit(False))
        # where every letter has a code of three digits and none is an operator, tokens begin with a query's codes where its letters stand
        at = F.array_min(F.filter(F.array(*[F.instr(s, F.lit(x)) for x in _spelled(keys)]), lambda i: i > 0))
        return F.when(holds, F.when(s.rlike(_PLAIN), at - 1).otherwise(once(char_codes(s), of_codes)))

    return once(letters, of)


def anywhere_in_lines(lines: DataFrame, keys: str, limit: int | None = 20) -> DataFrame:
    """As :func:`anywhere`, from (line_id, letters) alone."""
    found = lines.withColumn("match_pos", first_place(F.col("letters"), keys)).filter("match_pos IS NOT NULL")
    out = found.orderBy(F.length("letters"), "line_id")
    return out if limit is None else out.limit(limit)


def start_in_lines(lines: DataFrame, keys: str, limit: int | None = 20) -> DataFrame:
    """As :func:`start`, from (line_id, letters) alone."""
    cond = F.lit(False)
    if query_string(keys):
        begins = lambda s: F.greatest(*[F.startswith(s, F.lit(x)) for x in _spelled(keys)], F.lit(False))
        cond = once(F.col("letters"), lambda s: F.when(begins(s), once(char_codes(s), lambda c: in_ranges(c, keys))))
    out = lines.filter(cond).withColumn("match_pos", F.lit(0)).orderBy(F.length("letters"), "line_id")
    return out if limit is None else out.limit(limit)


def count_in_lines(lines: DataFrame, keys: str) -> DataFrame:
    """As :func:`count_anywhere`, from (line_id, letters) alone."""
    return lines.filter(first_place(F.col("letters"), keys).isNotNull()).agg(F.countDistinct("line_id").alias("n"))


def postings(numbered: DataFrame, length: int = 2) -> DataFrame:
    """(head, bucket, lines): of each run of ``length`` letters that is in any line, the lines that hold it, as bitmaps of 32,768 lines each.
    ``numbered`` has the codes and the number of each line, from 0 without gaps. The runs are combined before the shuffle."""
    heads = numbered.select("number", F.explode(suffix_tokens(F.col("codes"), length)).alias("head")).filter(F.length("head") == 4 * length)
    return heads.groupBy("head", F.bitmap_bucket_number("number").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("lines"))


def count_postings(heads: DataFrame, queries: DataFrame) -> DataFrame:
    """As :func:`count_batch`, from :func:`postings`: a count is a sum of bits, and only for a query of two heads are bitmaps put together."""
    codes = queries.select("keys", char_codes(F.col("keys")).alias("head")).withColumn("dotted", variant_codes(F.col("head")))
    one = heads.join(codes.filter("dotted IS NULL").select("keys", "head"), "head").select("keys", F.bitmap_count("lines").alias("n"))
    both = codes.filter("dotted IS NOT NULL").select("keys", F.explode(F.array("head", "dotted")).alias("head"))
    met = heads.join(both, "head").groupBy("keys", "bucket").agg(F.bitmap_or_agg("lines").alias("lines"))
    return one.unionByName(met.select("keys", F.bitmap_count("lines").alias("n"))).groupBy("keys").agg(F.sum("n").alias("n"))


def count_batch_in_lines(lines: DataFrame, queries: DataFrame, length: int) -> DataFrame:
    """As :func:`count_batch`, from lines' letters alone, for queries without operators: each line tells which runs of letters it has,
    and which of these beside their dotted variants, so that a line with both counts once. They are counted before the shuffle, which
    has a row a run and task."""
    plain, dotted = ("".join(chr(int(c)) for c in x) for x in zip(*VARIANTS.items(), strict=True))
    variant = lambda h: F.translate(h, plain, dotted)
    row = lambda h, both: F.struct(h.alias("run"), F.lit(both).alias("both"))
    rows = lambda runs: F.transform(runs, lambda h: row(h, False))
    twice = lambda runs: F.transform(F.filter(runs, lambda h: (variant(h) != h) & F.array_contains(runs, variant(h))), lambda h: row(h, True))

    def of(s: Column) -> Column:
        runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - length + 1), lambda i: F.substring(s, i, F.lit(length))))
        no_dots = F.translate(s, dotted, "") == s
        return F.when(F.length(s) >= length, once(runs, lambda r: F.when(no_dots, rows(r)).otherwise(F.concat(rows(r), twice(r)))))

    met = lines.select(F.explode(once(F.col("letters"), of)).alias("m")).groupBy("m.run", "m.both").agg(F.count("*").alias("n"))
    k, v = F.col("keys"), variant(F.col("keys"))
    sums = F.concat(F.array(F.struct(row(k, False).alias("m"), F.lit(1).alias("sign"))), F.when(v != k, F.array(F.struct(row(v, False).alias("m"), F.lit(1).alias("sign")), F.struct(row(k, True).alias("m"), F.lit(-1).alias("sign")))).otherwise(F.array()))
    asked = queries.select("keys").distinct().select("keys", F.explode(sums).alias("a")).select("keys", "a.m.run", "a.m.both", "a.sign")
    return met.join(asked, ["run", "both"]).groupBy("keys").agg(F.sum(F.col("n") * F.col("sign")).alias("n"))


def count_batch(token_rows: DataFrame, queries: DataFrame, length: int) -> DataFrame:
    """(keys, n) for many queries (keys) of one length: codes have a fixed width, so a range of tokens is an equal head,
    and the search is an equi-join with partial counts. A query with letters that have dotted variants has two heads.
    Queries that nothing meets are left out."""
    direct = queries.select("keys", char_codes(F.col("keys")).alias("head"))
    dotted = direct.select("keys", variant_codes(F.col("head")).alias("head")).filter("head IS NOT NULL")
    heads = token_rows.select("line_id", F.substring("token", 1, 4 * length).alias("head"))
    met = heads.join(direct.unionByName(dotted), "head").select("keys", "line_id").distinct()
    return met.groupBy("keys").agg(F.count("*").alias("n"))
