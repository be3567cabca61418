"""Reading in order: hydrate by ids, first lines, refrain stanzas, translations by preference, attached values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions.numeric import round_half_up
from granary.operators import scan

#: A line ends a stanza if it closes with numbered dandas.
STANZA_END = "॥\\s*[੦-੯]+(?:\\s*॥\\s*[੦-੯]+)*\\s*॥\\s*$"


def hydrate(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows for the ids of ``wanted`` (ord, key), with their ord: order kept, unknown ids left out."""
    return rows.join(wanted.select("ord", key), key)


def is_stanza_end(text: Column) -> Column:
    return F.trim(text).rlike(STANZA_END)


def stanza_flags(lines: DataFrame, group: str, position: str, kind: str, ends: Column) -> DataFrame:
    """``in_stanza``: a refrain line, or a plain line with none but plain lines, that end no stanza, up to the next
    refrain line. The window runs backwards, so its frame only grows: the work is linear in a group's lines."""
    w = Window.partitionBy(group).orderBy(F.desc(position)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    breaker = (F.col(kind) != "line") | ends
    following = F.last(F.when(breaker, F.col(kind)), ignorenulls=True).over(w)
    return lines.withColumn("in_stanza", (F.col(kind) == "rahao") | (~breaker & F.coalesce(following == "rahao", F.lit(False))))


def stanza_flags_in_ranges(lines: DataFrame, group: str, position: Sequence[str], kind: str, ends: Column, parts: int) -> DataFrame:
    """As :func:`stanza_flags`, for groups that may be larger than a task: lines are dealt by ranges of (group, position), backwards, and what
    the next breaker is goes from range to range."""
    breaker = (F.col(kind) != "line") | ends
    x = lines.withColumn("__breaker", F.when(breaker, F.col(kind)))
    held = scan.hold(scan.in_ranges(x, parts, group, [F.desc(p) for p in position]))
    done = scan.filled(held, group, "__breaker", "__next")
    flag = (F.col(kind) == "rahao") | (F.col("__breaker").isNull() & F.coalesce(F.col("__next") == "rahao", F.lit(False)))
    return done.withColumn("in_stanza", flag).drop("__breaker", "__next")


def first_of(rows: DataFrame, group: str, value: str, position: str, where: Column | None = None, name: str | None = None) -> DataFrame:
    """(group, value): the value at the least position among the rows that ``where`` selects; groups without one have
    a null."""
    v = F.when(where, F.struct(position, value)) if where is not None else F.struct(position, value)
    return rows.groupBy(group).agg(F.min(v)[value].alias(name or value))


def attach_preferred(rows: DataFrame, key: str, texts: DataFrame, source: str, text: str, views: dict[str, Sequence[str]]) -> DataFrame:
    """For each view, the first non-empty text in its order of sources; null where it has none."""
    aggregates = []
    for view, order in views.items():
        rank = F.array_position(F.lit(list(order)), F.col(source))
        aggregates.append(F.min(F.when((rank > 0) & (F.col(text) != ""), F.struct(rank.alias("r"), F.col(text).alias("t"))))["t"].alias(f"tr_{view}"))
    return rows.join(texts.groupBy(key).agg(*aggregates), key, "left")


def views_available(texts: DataFrame, source: str, text: str, views: dict[str, Sequence[str]]) -> DataFrame:
    """(view, available): whether any of a view's sources has a text at all, in one pass."""
    has = [F.struct(F.lit(v).alias("view"), F.coalesce(F.bool_or(F.col(source).isin(*order) & (F.col(text) != "")), F.lit(False)).alias("available")) for v, order in views.items()]
    return texts.agg(F.array(*has).alias("views")).select(F.inline("views"))


def with_lines(groups: DataFrame, key: str, lines: DataFrame, position: str, fields: Sequence[str], name: str = "lines") -> DataFrame:
    """Groups with their lines in order, and those that only lines speak of; a group with neither isn't there."""
    kids = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(position, *[f for f in fields if f != position]))).alias(name))
    empty = F.array().cast(kids.schema[name].dataType)
    return groups.join(kids, key, "full").withColumn(name, F.coalesce(name, empty))


def load_units(units: DataFrame, works: DataFrame, citations: DataFrame, wanted: DataFrame, *, unit: str = "unit_row", work: str = "work_id", place: str = "place", cited: Sequence[str] = ()) -> DataFrame:
    """Units for (ord, unit) in the order asked for, with their work and what they cite, in order; unknown ones are left
    out. An older table's missing section is null."""
    own = hydrate(units if "section" in units.columns else units.withColumn("section", F.lit(None).cast("string")), wanted, unit)
    met = own.join(works, work)
    return nest(met, unit, citations.join(wanted.select(unit).distinct(), unit, "left_semi"), [place], [place, *cited], "cites")


def corpus_roster(units: DataFrame, work: str, part: str, works: DataFrame) -> DataFrame:
    """Works with their parts (JSON, as (part, units) in order), and how many units they hold."""
    parts = units.groupBy(work, part).agg(F.count("*").alias("n")).groupBy(work).agg(F.sum("n").alias("units"), F.to_json(F.array_sort(F.collect_list(F.struct(F.col(part).alias("part"), F.col("n").alias("units"))))).alias("parts"))
    return works.join(parts, work, "left").fillna(0, ["units"])


def attach_agreement(rows: DataFrame, key: str, agreement: DataFrame, against: str, value: str) -> DataFrame:
    """A map of finite values to three places; null where a row has none."""
    finite = agreement.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")))
    maps = finite.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(against), round_half_up(F.col(value), 3))))).alias("agreement"))
    return rows.join(maps, key, "left")


def attach_counts(rows: DataFrame, key: str, items: DataFrame, name: str = "n") -> DataFrame:
    """The number of items by key; null where there is none."""
    return rows.join(items.groupBy(key).agg(F.count("*").alias(name)), key, "left")


def nest(parents: DataFrame, key: str, children: DataFrame, order: Sequence[str], fields: Sequence[str], name: str) -> DataFrame:
    """Children as an ordered array on their parent, empty where there are none."""
    kids = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias(name))
    empty = F.array().cast(kids.schema[name].dataType)
    return parents.join(kids, key, "left").withColumn(name, F.coalesce(name, empty))


def cited_sources(hits: DataFrame, citations: DataFrame, key: str, cited: str) -> DataFrame:
    """(cited, ord): what the hits (ord, key) cite, each once, in the order in which it is first met."""
    met = hits.join(citations.select(key, cited, "place"), key).filter(F.col(cited).isNotNull())
    return met.groupBy(cited).agg(F.min(F.struct("ord", "place")).alias("first")).select(cited, F.col("first.ord").alias("ord"), F.col("first.place").alias("place"))


def group_context(units: DataFrame, topics: DataFrame, group: str) -> DataFrame:
    """Per group: its first ``bhav``, its ``arth`` stanzas in order with what they cover (one at least), its topics by
    code. Groups with none of these have no row."""
    covers = F.greatest(F.lit(1), F.coalesce(F.col("en_covers").try_cast("int"), F.lit(1)))
    u = units.groupBy(group).agg(
        F.min(F.when(F.col("kind") == "bhav", F.struct("ord", "text")))["text"].alias("bhav"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "arth", F.struct("ord", "stanza", "text", covers.alias("covers"))))).alias("stanzas"),
    )
    t = topics.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("code", "topic"))).alias("topics"))
    return u.join(t, group, "full").filter(F.col("bhav").isNotNull() | (F.size("stanzas") > 0) | (F.size("topics") > 0))
