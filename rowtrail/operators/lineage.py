"""Deriving lineage: follow hidden ids from result rows back to the registered sources."""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, functions as F

from rowtrail.operators.frame import Group, Tag, TracedFrame
from rowtrail.operators.influence import All
from rowtrail.operators.keyed import col, null_safe_join
from rowtrail.scratch import materialize

if TYPE_CHECKING:
    from rowtrail.sources.registry import Source

RID = "rid"


@dataclass
class Reached:
    """Input ids of one source; ``unique`` when no (carried columns, rid) pair repeats."""

    source: "Source"
    ids: DataFrame
    unique: bool


@dataclass
class Visit:
    """Rows of one stage a trace went through (for per-stage counts)."""

    depth: int
    stage: str
    rows: DataFrame
    unique: bool


def resolve(frame: TracedFrame, rows: DataFrame, tags: set[Tag], carry: list[str], stored: bool = False,
            complete: bool = False, visits: list[Visit] | None = None, depth: int = 1) -> list[Reached]:
    """Ids of the source rows behind ``rows`` (rows of ``frame`` with extra columns ``carry``).

    ``stored``: ``rows`` is a written table, so Catalyst knows its size.  ``complete``: ``rows``
    holds every row of the frame, so the stage below needs no filter by group key.
    """
    reached: list[Reached] = []
    wanted: dict[tuple, set[str | None]] = {}
    for tag in sorted(tags, key=str):
        wanted.setdefault((tag.id, tag.when), set()).add(tag.part)
    for (id_column, when), parts in wanted.items():
        if parts == wanted.get((id_column, frozenset())) and when:
            continue  # asked for without a condition as well
        origin = frame.origins[id_column]
        present = rows.where(col(id_column).isNotNull())
        for choice, values in when:
            present = present.where(col(choice).isin(sorted(values)))
        if not isinstance(origin, Group):
            found = present.select(*[col(c) for c in carry], col(id_column).alias(RID))
            reached.append(Reached(origin, found, frame.unique))
            continue
        parent = origin.parent
        all_groups = complete and not when and frame.whole_group is origin
        link = _links(origin, present, id_column, carry, stored and not when, frame.unique, all_groups)
        for influence, value, parent_tags in origin.demands(parts):
            kept = _group_rows(origin, link, influence, value, carry, all_groups, parent_tags)
            if visits is not None:
                visits.append(Visit(depth, parent.name, kept.select(*[col(i) for i in parent.origins]),
                                    parent.unique))
            reached += resolve(parent, kept, parent_tags, carry, False,
                               all_groups and isinstance(influence, All), visits, depth + 1)
    return reached


def _link_names(group: Group) -> dict[str, str]:
    return {k: f"__k{i}" for i, k in enumerate(group.keys)}


def _links(group: Group, present: DataFrame, id_column: str, carry: list[str], stored: bool, unique: bool,
           all_groups: bool) -> DataFrame | None:
    """Which groups are wanted, and for which carried output columns: (carry..., key fields).

    The table is written (unless it is part of a written one): joins with the raw rows then see its
    real size, and a small one is broadcast instead of shuffling the raw rows.
    """
    if all_groups and not carry:
        return None
    link = present.select(*[col(c) for c in carry], *[
        col(id_column).getField(k).alias(f) for k, f in _link_names(group).items()])
    if not (unique and not carry):
        link = link.distinct()
    return link if stored and unique else materialize(link, "links")


def _row_ids(parent: TracedFrame, tags: set[Tag]) -> list[str]:
    """Columns an influence operator must keep: the ids, and the choices that the tags ask about."""
    return [*parent.origins, *sorted({choice for tag in tags for choice, _ in tag.when})]


def _group_rows(group: Group, link: DataFrame | None, influence, value: str | None, carry: list[str],
                all_groups: bool, tags: set[Tag]) -> DataFrame:
    """The influential input rows of the wanted groups, with the carried columns attached."""
    parent, keys, names = group.parent, list(group.keys), list(_link_names(group).values())
    base = parent.full
    everything = isinstance(influence, All)
    if not all_groups and not (carry and everything):
        wanted = link.select(*names).distinct() if carry else link
        base = null_safe_join(base, wanted, keys, "left_semi", names)
    kept = base if everything else influence.keep(
        base, keys, col(value) if value else F.lit(None), _row_ids(parent, tags))
    return null_safe_join(kept, link, keys, "inner", names) if carry else kept


def merged(reached: list[Reached], carry: list[str]) -> dict[str, DataFrame]:
    """Distinct ids per source; the distinct is skipped where ids cannot repeat."""
    by_source: dict[str, list[Reached]] = {}
    for item in reached:
        by_source.setdefault(item.source.name, []).append(item)
    out = {}
    for name, items in by_source.items():
        ids = items[0].ids
        for item in items[1:]:
            ids = ids.unionByName(item.ids)
        out[name] = ids if len(items) == 1 and items[0].unique else ids.distinct()
    return out


def _edge_ids(frame: TracedFrame, keep: list[str], tags: set[Tag]) -> tuple[list[Reached], list[str]]:
    group = frame.whole_group
    carry = [f"__c{i}" for i in range(len(keep))]
    if group is not None and set(keep) <= set(group.keys) and tags <= {
            Tag(i, p) for i in frame.origins for p in [None, *group.aggs, *group.keys]}:
        # the output is the group and the key identifies it: the input rows carry the key already
        reached: list[Reached] = []
        parts = {tag.part for tag in tags}
        for influence, value, parent_tags in group.demands(parts):
            parent = group.parent
            kept = influence.keep(parent.full, list(group.keys), col(value) if value else F.lit(None),
                                  _row_ids(parent, parent_tags))
            carried = kept.withColumns({c: col(k) for c, k in zip(carry, keep)})
            reached += resolve(parent, carried, parent_tags, carry, complete=isinstance(influence, All))
        return reached, carry
    rows = frame.full.withColumns({c: col(k) for c, k in zip(carry, keep)})
    return resolve(frame, rows, tags, carry, complete=group is not None), carry


def edges(frame: TracedFrame, keep: list[str] | None, by_column: bool | list[str]) -> DataFrame:
    group = frame.whole_group
    if keep is None:
        keep = list(group.keys) if group and set(group.keys) <= set(frame.columns) else frame.columns
    if by_column is False:
        requests = {None: frame.row_tags()}
    else:
        columns = by_column if isinstance(by_column, list) else [c for c in frame.columns if c not in keep]
        requests = {c: frame.tags_of([c]) for c in columns}
    # columns with the same lineage are derived once
    shared: dict[frozenset, list] = {}
    for out_col, tags in requests.items():
        shared.setdefault(frozenset(tags), []).append(out_col)
    parts: list[tuple[str, DataFrame]] = []
    for tags, out_cols in shared.items():
        reached, carry = _edge_ids(frame, keep, set(tags))
        for source, ids in merged(reached, carry).items():
            found = ids.withColumnsRenamed(dict(zip(carry, keep)))
            if out_cols != [None]:
                found = found.withColumn("out_col", F.explode(F.array(*[F.lit(c) for c in out_cols])))
            parts.append((source, found))
    taken = {"src", RID, *([] if by_column is False else ["out_col"])} & set(keep)
    if taken:
        raise ValueError(f"lineage has columns of its own with these names, rename yours: {sorted(taken)}")
    common = common_id_type([df for _, df in parts])
    labels = [*keep, *([] if by_column is False else ["out_col"])]
    result = None
    for source, df in parts:
        one = df.select(*[col(c) for c in labels], F.lit(source).alias("src"),
                        (col(RID) if common else _as_text(df)).alias(RID))
        result = one if result is None else result.unionByName(one)
    return result


def common_id_type(frames: list[DataFrame]) -> bool:
    return len({df.schema[RID].dataType for df in frames}) == 1


def _as_text(df: DataFrame):
    """Ids of different types meet in one column as text (a struct as JSON)."""
    kind = df.schema[RID].dataType.typeName()
    return F.to_json(col(RID)) if kind == "struct" else col(RID).cast("string")
