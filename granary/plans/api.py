"""Request-shaped queries: parameters checked in the order that callers rely on, then one plan.

Each function gives an :class:`Answer`: rows and what goes with them, or a refusal with its code. Nothing runs before the
rows are asked for, except counts that the answer states.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.letters import highlight_words, typed_keys
from granary.operators import fusion, lexical, reading, vectors
from granary.operators.encode import Encoder
from granary.plans.catalog import Refusal, pick

LONGEST_QUERY = 200


@dataclass
class Answer:
    rows: DataFrame | None = None
    told: dict[str, Any] = field(default_factory=dict)
    code: int = 200


@dataclass
class Loaded:
    """An index that is loaded: its rows, what it is for, and what it reads."""

    rows: DataFrame
    roles: Sequence[str] = ("neighbours", "text", "ask")
    scripts: Sequence[str] = ("latin",)
    encoder: Encoder | None = None
    weight: float = 1.0


def bounded(value: str | None, least: int, most: int, fallback: int) -> int:
    t = (value or "").strip()
    return max(least, min(most, int(t))) if re.fullmatch(r"[+-]?\d{1,15}", t) else fallback


def non_negative(value: str | None) -> int | None:
    t = (value or "").strip()
    return int(t) if re.fullmatch(r"\d{1,15}", t) else None


def answered(call: Callable[[], Answer]) -> Answer:
    try:
        return call()
    except Refusal as e:
        return Answer(None, {"error": e.reason}, e.code)


def first_letters(lines: DataFrame, tokens: DataFrame, q: str | None, mode: str | None = None, limit: str | None = None, *, text: str | None = None, texts: DataFrame | None = None, views: dict[str, Sequence[str]] | None = None, langs: str | None = None) -> Answer:
    """Lines by letters, 25 by default and 100 at most. The total is that of all lines for a search anywhere, that of the
    rows given for one at the start. With ``text`` (a column of lines as typed) each row says which words to light up; with
    ``texts`` (line_id, source, text) and ``views`` it has the translations that ``langs`` asks for."""
    q = q or ""
    if len(q) > LONGEST_QUERY:
        return Answer(None, {"error": "the query is too long"}, 400)
    n = bounded(limit, 1, 100, 25)
    if mode == "start":
        rows = lexical.start(lines, q, n)
        told = {"mode": "start", "total": rows.count()}
    else:
        rows = lexical.anywhere(tokens, lines, q, n)
        told = {"mode": "anywhere", "total": lexical.count_anywhere(tokens, q, lines).first()["n"]}
    if text:
        rows = rows.withColumn("highlight", highlight_words(F.col(text), F.lit(typed_keys(q))))
    asked = {v: views[v] for v in dict.fromkeys(x.strip() for x in (langs or "").split(",")) if views and v in views}
    if texts is not None and asked:
        rows = reading.attach_preferred(rows, "line_id", texts, "source", "text", asked)
    return Answer(rows, told)


def group(pages: DataFrame, key: str, value: str | None) -> Answer:
    """One group as a page (see ``reading.with_lines``): an id that is no number is refused, an unknown one isn't there."""
    at = non_negative(value)
    if at is None:
        return Answer(None, {"error": "the id is no number"}, 400)
    rows = pages.filter(F.col(key) == at)
    return Answer(rows) if rows.limit(1).count() else Answer(None, {"error": "no such group"}, 404)


def _several(indexes: Mapping[str, Loaded], names: Sequence[str], run: Callable[[Loaded, int], DataFrame], k: int, key: Column) -> Answer:
    """One index answers with its own scores; several are fused from three times as many hits each."""
    if len(names) == 1:
        return Answer(run(indexes[names[0]], k), {"index": names[0], "score_kind": "cosine"})
    lists = [fusion.as_list(run(indexes[n], 3 * k), n, n, "item", key, indexes[n].weight) for n in sorted(names)]
    return Answer(fusion.fuse_by(fusion.union_lists(lists), k), {"index": "all", "score_kind": "rrf"})


def similar(indexes: Mapping[str, Loaded], known: Sequence[str], default: str, asked: str | None, item: str | None, k: str | None = None) -> Answer:
    """Neighbours of an item in one index, or fused over several; 10 by default and 50 at most."""

    def go() -> Answer:
        names = pick(known, {n: i.roles for n, i in indexes.items()}, asked, "neighbours", default)
        at = non_negative(item)
        if at is None:
            raise Refusal(400, "the id is no number")
        return _several(indexes, names, lambda i, n: vectors.similar_to(i.rows, at, n), bounded(k, 1, 50, 10), F.col("id"))

    return answered(go)


def _reads(index: Loaded, text: str) -> bool:
    return ("gurmukhi" if re.search("[਀-੿]", text) else "latin") in index.scripts


def text(indexes: Mapping[str, Loaded], known: Sequence[str], default: str, asked: str | None, q: str | None, k: str | None = None) -> Answer:
    """Free text. With one index: too long 400, no encoder 503, empty nothing, unreadable script 400. With several: empty
    nothing, and 503 if none can answer."""

    def go() -> Answer:
        names = pick(known, {n: i.roles for n, i in indexes.items()}, asked, "text", default)
        words, n = (q or "").strip(), bounded(k, 1, 50, 15)
        if len(words) > LONGEST_QUERY:
            raise Refusal(400, "the query is too long")
        if len(names) == 1 and indexes[names[0]].encoder is None:
            raise Refusal(503, "the index has no encoder")
        if not words:
            return Answer(None, {"results": 0})
        able = [x for x in names if indexes[x].encoder is not None and _reads(indexes[x], words)]
        if not able:
            raise Refusal(400 if len(names) == 1 else 503, "no index reads the query")
        return _several(indexes, able, lambda i, m: vectors.search(i.rows, i.encoder.query(words), m), n, F.col("id"))

    return answered(go)


def writings(corpora: Mapping[str, Loaded], asked: str | None, q: str | None, k: str | None = None, work: str | None = None, least: float = 0.0, ratio: float = 0.0) -> Answer:
    """Passages of one corpus by cosine, or of several fused, each floored by itself. Corpora keep the order they are
    declared or asked for in, and have id spaces of their own: the key is (place of the corpus, row)."""

    def go() -> Answer:
        names = list(corpora) if asked in (None, "all") else list(dict.fromkeys(x.strip() for x in asked.split(",") if x.strip()))
        if not names:
            raise Refusal(400, "no corpus is named")
        if unknown := [n for n in names if n not in corpora]:
            raise Refusal(400, f"unknown: {', '.join(unknown)}")
        if work and len(names) > 1:
            raise Refusal(400, "a work is in one corpus")
        words, n = (q or "").strip(), bounded(k, 1, 50, 10)
        if len(words) > LONGEST_QUERY:
            raise Refusal(400, "the query is too long")
        if not words:
            return Answer(None, {"results": 0})
        able = [x for x in names if corpora[x].encoder is not None and _reads(corpora[x], words)]
        if not able:
            raise Refusal(503 if len(names) > 1 or corpora[names[0]].encoder is None else 400, "no corpus reads the query")

        def run(c: Loaded, depth: int) -> DataFrame:
            where = F.col("work_id") == work if work else None
            return vectors.score_floor(vectors.search(c.rows, c.encoder.query(words), depth, where=where), least, ratio)

        if len(able) == 1:
            return Answer(run(corpora[able[0]], n), {"corpora": able, "score_kind": "cosine"})
        lists = [fusion.as_list(run(corpora[c], 2 * n), c, c, "text", F.col("row")).withColumn("corpus", F.lit(i)).withColumnRenamed("key", "unit") for i, c in enumerate(able)]
        return Answer(fusion.fuse_by(fusion.union_lists(lists), n, ("corpus", "unit")), {"corpora": able, "score_kind": "rrf"})

    return answered(go)


def retrieve_groups(indexes: Mapping[str, tuple[DataFrame, DataFrame, DataFrame]], queries: Mapping[str, Sequence[Sequence[float]]], owner: DataFrame, k: int = 20, depth: int = 40, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Groups for several query vectors over several indexes of (lines, groups, refrains): three lists an index and
    query. A line votes for the group that ``owner`` (id, group_id) gives it; lines without one keep their rank."""
    lists = []
    for name in sorted(indexes):
        own = indexes[name]
        for i, q in enumerate(queries[name]):
            tag = f":q{i}" if len(queries[name]) > 1 else ""
            for via, rows in zip(("line", "group", "refrain"), own, strict=True):
                hits = vectors.search(rows, q, depth)
                key = F.col("id")
                if via == "line":
                    hits, key = hits.join(owner, "id", "left"), F.col("group_id")
                lists.append(fusion.as_list(hits, f"{name}/{via}{tag}", name, via + tag, key, (weights or {}).get(name)))
    return fusion.fuse_by(fusion.union_lists(lists), k)


def related_groups(indexes: Mapping[str, tuple[DataFrame, DataFrame, DataFrame]], group: int, line_ids: Sequence[int], owner: DataFrame, k: int = 20, depth: int = 40) -> DataFrame:
    """Groups related to a group by its lines, itself and its refrain. It is left out after the k best are taken, so one
    fewer may come back."""
    lists = []
    for name in sorted(indexes):
        rows, groups, refrains = indexes[name]
        for x in line_ids:
            lists.append(fusion.as_list(vectors.similar_to(rows, x, depth).join(owner, "id", "left"), f"{name}/line:{x}", name, f"line:{x}", F.col("group_id")))
        for via, other in (("group", groups), ("refrain", refrains)):
            lists.append(fusion.as_list(vectors.similar_to(other, group, depth), f"{name}/{via}", name, via, F.col("id")))
    return fusion.fuse_by(fusion.union_lists(lists), k).filter(F.col("key") != group)
