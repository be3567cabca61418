"""A faceted catalogue: counts by facet, filters of which a parent covers its children, text modes, pages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions.letters import VARIANTS, once
from granary.functions.text import fold_native_text, letter_classes, loose_roman_text
from granary.operators import lexical
from granary.operators.scan import hold

PAGE, MOST, LONGEST = 20, 100, 120


def facet_counts(items: DataFrame, facets: Sequence[str]) -> DataFrame:
    """(facet, key, n) of all facets in one pass; null keys don't count."""
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("key")) for f in facets])
    return items.select(F.explode(pairs).alias("p")).select("p.facet", "p.key").filter("key IS NOT NULL").groupBy("facet", "key").agg(F.count("*").alias("n"))


def covers(child: str, parent: str, wanted: object) -> Column:
    return (F.col(child) == wanted) | (F.col(parent) == wanted)


def filtered(items: DataFrame, conditions: Sequence[Column | None]) -> DataFrame:
    """Only the conditions that are given hold."""
    given = [c for c in conditions if c is not None]
    return items.filter(reduce(lambda a, b: a & b, given)) if given else items


def page(items: DataFrame, order: Sequence[Column], k: int | None = None, number: int = 1) -> tuple[DataFrame, dict[str, int]]:
    """One page, and total, pages and the page's number held within them. Its size is 20 by default, 100 at most."""
    size = max(1, min(MOST, PAGE if k is None else k))
    total = items.count()
    pages = max(1, -(-total // size))
    at = min(max(1, number), pages)
    return items.orderBy(*order).offset((at - 1) * size).limit(size), {"total": total, "pages": pages, "page": at}


def granth_order(own: Column, parent: Column) -> Column:
    """A facet's own order, else its parent's, else 99; zero counts as missing."""
    return F.coalesce(F.nullif(own, F.lit(0)), F.nullif(parent, F.lit(0)), F.lit(99))


def with_images(items: DataFrame, images: DataFrame, key: str) -> DataFrame:
    """``thumb``: the small image's address or path, else the full one's; null without either."""
    one = images.filter("n = 1")
    for kind in ("thumb", "full"):
        side = one.filter(F.col("kind") == kind).groupBy(key).agg(F.min(F.struct("url", "path")).alias(kind))
        items = items.join(side, key, "left")
    return items.withColumn("image", F.coalesce("thumb.url", "thumb.path", "full.url", "full.path")).drop("thumb", "full")


#: Vowels typed whole, and the letters that carry them.
CARRIERS = str.maketrans("ਆਐਔਇਈਏਉਊਓ", "ਅਅਅੲੲੲੳੳੳ")


def letters_mode(query: str) -> bool:
    """A query without spaces, or of two or more single Latin letters with spaces between."""
    parts = query.split()
    return len(parts) == 1 or len(parts) >= 2 and all(len(p) == 1 and p.isascii() and p.isalpha() for p in parts)


def match_test(query: str, *, native: str, loose: str | None = None, letters: str | None = None, codes: str | None = None) -> Column:
    """Whether a line is found, from its folds: a folded part of it; a loose spelling of its transliteration, if the query
    has a space; and in letters mode, from two letters on, the first letters of consecutive words, by their codes with
    the dotted variant or, if they are Latin, by letters that sound alike."""
    folded = fold_native_text(query)
    if not folded:
        return F.lit(False)
    tests = [F.contains(F.col(native), F.lit(folded))]
    if loose and " " in folded and (spelled := loose_roman_text(folded)):
        tests.append(F.contains(F.col(loose), F.lit(spelled)))
    bare = "".join(query.split())
    if letters_mode(query) and len(bare) >= 2:
        if codes and (q := lexical.query_string(bare.translate(CARRIERS))):
            variant = ",".join(VARIANTS.get(c, c) for c in q.split(","))
            tests.append(once(F.col(codes), lambda c: reduce(lambda a, b: a | b, [F.contains(c, F.lit(x)) for x in dict.fromkeys((q, variant))])))
        if letters and bare.isascii() and bare.isalpha():
            tests.append(F.col(letters).rlike(letter_classes(bare)))
    return reduce(lambda a, b: a | b, tests)


def match_lines(lines: DataFrame, group: str, position: str, query: str, *, shown: str, **folds: str | None) -> DataFrame:
    """(group, matched_line): each group's first line that :func:`match_test` finds by the columns ``folds``."""
    hit = lines.filter(match_test(query, **folds))
    return hit.groupBy(group).agg(F.min(F.struct(position, shown))[shown].alias("matched_line"))


def raag_facet(items: DataFrame, raags: DataFrame, notes: DataFrame) -> DataFrame:
    """(key, english, used, prescribed, noted, place) of every raag that is used, prescribed or has notes.

    Those of the book come first, by their own or their parent's order, parents before children, then by name.
    """
    used = items.groupBy(F.col("raag_used_key").alias("key")).agg(F.count("*").alias("used"))
    prescribed = items.groupBy(F.col("raag_shabad_key").alias("key")).agg(F.count("*").alias("prescribed"))
    noted = notes.groupBy(F.col("raag_key").alias("key")).agg(F.count("*").alias("noted"))
    parents = raags.select(F.col("key").alias("parent_key"), F.col("ggs_order").alias("parent_order"))
    r = raags.join(parents, "parent_key", "left")
    for counts in (used, prescribed, noted):
        r = r.join(counts, "key", "left")
    r = r.fillna(0, ["used", "prescribed", "noted"]).filter("used + prescribed + noted > 0")
    order = [F.desc("in_ggs"), granth_order(F.col("ggs_order"), F.col("parent_order")), F.col("parent_key").isNotNull(), F.asc("english")]
    place = F.row_number().over(Window.orderBy(*order))  # a vocabulary's rows
    return r.select("key", "english", "used", "prescribed", "noted", place.cast("long").alias("place"))


def ranked(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """A vocabulary's rows with their ``place``."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


def taal_facet(items: DataFrame, taals: DataFrame) -> DataFrame:
    """(key, english, n, place) of the taals that items have, the most frequent first, then by key."""
    n = items.filter("taal_key IS NOT NULL").groupBy(F.col("taal_key").alias("key")).agg(F.count("*").alias("n"))
    named = n.join(taals.select("key", "english"), "key", "left").withColumn("english", F.coalesce("english", "key"))
    return ranked(named, [F.desc("n"), F.asc("key")]).select("key", "english", "n", "place")


def author_facet(items: DataFrame, authors: DataFrame) -> DataFrame:
    """(key, name, n, place) of authors by name."""
    n = items.filter("author_key IS NOT NULL").groupBy(F.col("author_key").alias("key")).agg(F.count("*").alias("n"))
    named = n.join(authors.select(F.col("author_key").alias("key"), "name"), "key", "left").withColumn("name", F.coalesce("name", "key"))
    return ranked(named, [F.asc("name"), F.asc("key")]).select("key", "name", "n", "place")


def book_facet(items: DataFrame, books: DataFrame) -> DataFrame:
    """(key, title, n, place) of all books, by author, part (none first) and title."""
    n = items.groupBy("book_key").agg(F.count("*").alias("n"))
    rows = books.join(n, "book_key", "left").fillna(0, ["n"])
    return ranked(rows, [F.asc("author_key"), F.coalesce("part", F.lit(0)), F.asc("title")]).select(F.col("book_key").alias("key"), "title", "n", "place")


def summary(items: DataFrame, books: DataFrame) -> DataFrame:
    """One row: items, groups, books, and the verified items that the books state."""
    i = items.agg(F.count("*").alias("items"), F.count_distinct("shabad_id").alias("groups"))
    return i.crossJoin(books.agg(F.count("*").alias("books"), F.sum(F.coalesce("verified", F.lit(0))).cast("long").alias("verified")))  # one row each


def listed(items: DataFrame, lines: DataFrame | None = None, *, q: str | None = None, folds: dict[str, str] | None = None, group: str = "group_id", position: str = "pos", shown: str = "line", k: int | None = None, number: int = 1, **filters: object) -> tuple[DataFrame, dict[str, int]]:
    """A page of the items that filters and a text let through, and what goes with it. A text that nothing meets gives no
    rows and no number of pages."""
    matched = None
    if (text := (q or "").strip()[:LONGEST]) and lines is not None:
        matched = hold(match_lines(lines, group, position, text, shown=shown, **(folds or {})).withColumnRenamed(group, "shabad_id"))  # a row a group; read several times
        if not matched.limit(1).count():
            return items.limit(0), {"total": 0, "page": 1}
    return page(list_items(items, matched=matched, **filters), item_order(), k, number)


def raag_notes(notes: DataFrame, key: str) -> DataFrame:
    """A raag's notes in the order of books and of places in them."""
    return ranked(notes.filter(F.col("raag_key") == key), [F.asc("book_key"), F.asc("n")])


def known_key(texts: DataFrame, text: str, vocabulary: DataFrame) -> DataFrame:
    """``texts`` with the ``key`` that a text is, or is an alias of; null without either. (key, alias) is small."""
    exact = vocabulary.select(F.col("key").alias("__exact")).distinct()
    alias = vocabulary.groupBy(F.col("alias").alias("__alias")).agg(F.min("key").alias("__key"))
    met = texts.join(exact, F.col(text) == F.col("__exact"), "left").join(alias, F.col(text) == F.col("__alias"), "left")
    return met.withColumn("key", F.coalesce("__exact", "__key")).drop("__exact", "__alias", "__key")


def group_heads(lines: DataFrame, group: str, position: str, shown: str, *more: str) -> DataFrame:
    """A group's first line and what else its first row says."""
    return lines.groupBy(group).agg(F.min(F.struct(position, shown, *more)).alias("h")).select(group, F.col(f"h.{shown}").alias("first_line"), *[F.col(f"h.{c}").alias(c) for c in more])


def list_items(items: DataFrame, *, raag: str | None = None, raag_shabad: str | None = None, author: str | None = None, book: str | None = None, taal: str | None = None, shabad: int | None = None, verified: bool | None = None, matched: DataFrame | None = None) -> DataFrame:
    """The items that all given filters let through. ``matched`` (shabad_id, matched_line) keeps those of matched groups
    and shows the line where it isn't the item's own first line."""
    same = lambda c, v: None if v is None else F.col(c) == v
    out = filtered(items, [None if raag is None else covers("raag_used_key", "raag_used_parent_key", raag), same("raag_shabad_key", raag_shabad), same("author_key", author), same("book_key", book), same("taal_key", taal), same("shabad_id", shabad), None if verified is None else F.col("verified") == int(verified)])
    if matched is None:
        return out
    out = out.join(matched.dropDuplicates(["shabad_id"]), "shabad_id")
    return out.withColumn("matched_line", F.when(~F.col("matched_line").eqNullSafe(F.col("first_line")), F.col("matched_line")))


def item_order() -> list[Column]:
    """Items without a group last, then by page, book and place in it."""
    return [F.col("shabad_id").isNull(), F.asc_nulls_last("ang"), F.asc("book_key"), F.asc("ordinal")]


def cards(items: DataFrame, names: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Items with names for their keys: for each column (table, key, name), a column ``<column>_name``; the key itself
    where the table has no such name."""
    for column, (table, key, name) in names.items():
        side = table.select(F.col(key).alias("__k"), F.col(name).alias("__n")).dropDuplicates(["__k"])
        items = items.join(side, F.col(column) == F.col("__k"), "left").withColumn(f"{column}_name", F.coalesce("__n", column)).drop("__k", "__n")
    return items


def item(items: DataFrame, images: DataFrame, key: str, value: str) -> DataFrame:
    """One item with its images in order and the number of others of its group."""
    own = items.filter(F.col(key) == value)
    others = items.groupBy("shabad_id").agg((F.count("*") - 1).alias("others"))
    pics = images.filter(F.col(key) == value).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "kind", "url", "path"))).alias("images"))
    return own.join(pics, key, "left").join(others, "shabad_id", "left").fillna(0, ["others"])
