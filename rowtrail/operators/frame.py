"""TracedFrame: a plain DataFrame plus what is needed to derive its lineage later.

Row ids of the sources (and, after an aggregation, the group key) ride along as hidden columns.
An aggregation runs without them: Catalyst prunes the ids, so an untraced job is the plain job.
Lineage is a second, on-demand query that follows the ids back (see ``lineage``).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING, NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from rowtrail.operators.aggregates import Agg
from rowtrail.operators.influence import All, Bottom, Influence, Top
from rowtrail.operators.keyed import col, null_safe_join
from rowtrail.scratch import materialize

if TYPE_CHECKING:
    from rowtrail.operators.trace import Trace
    from rowtrail.sources.registry import TraceContext


class Tag(NamedTuple):
    """A hidden id column, the result column of that group (None: the whole row), and when it counts:
    pairs of a hidden choice column and the choices of a row under which the input contributes."""

    id: str
    part: str | None = None
    when: frozenset[tuple[str, frozenset[int]]] = frozenset()

    def under(self, choice: str, values: frozenset[int]) -> "Tag":
        return self._replace(when=self.when | {(choice, values)})

    def renamed(self, names: dict[str, str]) -> "Tag":
        return Tag(names.get(self.id, self.id), self.part, frozenset((names.get(c, c), v) for c, v in self.when))


@dataclass(frozen=True, eq=False)
class Group:
    """One aggregation step: where its rows come from and which of them count."""

    parent: "TracedFrame"
    keys: tuple[str, ...]
    aggs: dict[str, Agg]
    influence: Influence | None
    value: str | None

    def demands(self, parts: set[str | None]) -> list[tuple[Influence, str | None, set[Tag]]]:
        """What to follow for the requested result columns: (influence, value, parent tags)."""
        if self.influence is not None or not self.parent.column_lineage:
            return [(self.influence or All(), self.value, self.parent.row_tags())]
        wanted = set(self.aggs) if None in parts else parts & set(self.aggs)
        merged: dict[tuple[Influence, str | None], set[Tag]] = {}
        for name in sorted(wanted):
            agg = self.aggs[name]
            value = agg.uses[0] if agg.uses else None
            tags = self.parent.tags_of(agg.uses) if agg.uses else self.parent.row_tags()
            merged.setdefault((agg.influence, value), set()).update(tags)
        if parts & set(self.keys) or not merged:
            merged.setdefault((All(), None), set()).update(self.parent.tags_of(self.keys))
        return [(influence, value, tags) for (influence, value), tags in merged.items()]


class TracedFrame:
    def __init__(self, ctx: "TraceContext", full: DataFrame, columns: list[str], origins: dict,
                 tags: dict[str, frozenset[Tag]], unique: bool, column_lineage: bool, name: str,
                 whole_group: Group | None = None, ordinals: tuple[str, ...] = (), choices: tuple[str, ...] = ()):
        self.ctx, self.full, self.columns, self.origins = ctx, full, columns, origins
        self.tags, self.unique, self.column_lineage = tags, unique, column_lineage
        self.name, self.whole_group = name, whole_group
        # hidden columns: element ordinals, which with the ids identify a row; choices that tags refer to
        self.ordinals, self.choices = ordinals, choices

    # -- plain results ---------------------------------------------------------------------

    @property
    def df(self) -> DataFrame:
        """The result without ids: what the plain Spark job returns."""
        return self.full.select(*[col(c) for c in self.columns])

    def collect(self):
        return self.df.collect()

    def take(self, n: int):
        return self.df.take(n)

    def count(self) -> int:
        return self.df.count()

    def sources(self) -> list[str]:
        """Names of all inputs this result may depend on."""
        found: set[str] = set()
        for origin in self.origins.values():
            found.update(origin.parent.sources() if isinstance(origin, Group) else [origin.name])
        return sorted(found)

    def row_tags(self) -> set[Tag]:
        return {Tag(id_column) for id_column in self.origins}

    def tags_of(self, columns) -> set[Tag]:
        return set().union(*[self.tags[c] for c in columns])

    def _unless_key(self, names) -> Group | None:
        """``whole_group``, unless one of its key columns is replaced."""
        group = self.whole_group
        return None if group is not None and set(names) & set(group.keys) else group

    def _same_context(self, other: "TracedFrame") -> None:
        """Hidden id columns are only unique within a context."""
        if self.ctx is not other.ctx:
            raise ValueError("both frames must come from one TraceContext")

    def hidden(self) -> list[str]:
        return [*self.origins, *self.ordinals, *self.choices]

    def _ids(self) -> list[Column]:
        return [col(c) for c in self.hidden()]

    def _with(self, full: DataFrame, **changes) -> "TracedFrame":
        state = dict(columns=self.columns, origins=self.origins, tags=self.tags, unique=self.unique,
                     column_lineage=self.column_lineage, name=self.name, whole_group=self.whole_group,
                     ordinals=self.ordinals, choices=self.choices)
        state.update(changes)
        return TracedFrame(self.ctx, full, **state)

    # -- one row in, one row (or none, or many) out ----------------------------------------

    def where(self, condition: Column | str) -> "TracedFrame":
        return self._with(self.full.where(condition), whole_group=None)

    def select(self, *names: str, **expressions: Column) -> "TracedFrame":
        """Keep ``names`` and add computed columns (which depend on the whole row)."""
        kept = self.full.select(*[col(n) for n in names],
                                *[e.alias(n) for n, e in expressions.items()], *self._ids())
        row = frozenset(self.row_tags())
        tags = {n: self.tags[n] for n in names} | {n: row for n in expressions}
        return self._with(kept, columns=[*names, *expressions], tags=tags,
                          whole_group=self._unless_key(expressions))

    def with_columns(self, expressions: dict[str, Column],
                     uses: list[str] | None = None) -> "TracedFrame":
        """Add or replace columns; ``uses`` names their inputs, by default the whole row."""
        inputs = frozenset(self.row_tags() if uses is None else self.tags_of(uses))
        columns = self.columns + [n for n in expressions if n not in self.columns]
        return self._with(self.full.withColumns(expressions), columns=columns,
                          tags=self.tags | {n: inputs for n in expressions},
                          whole_group=self._unless_key(expressions))

    def derive(self, name: str, expression: Column, uses: list[str]) -> "TracedFrame":
        """A column computed from ``uses``: its lineage is the union of theirs."""
        return self.with_columns({name: expression}, uses)

    def derive_when(self, name: str, branches: list[tuple[Column, Column]], otherwise: Column,
                    uses: list[str]) -> "TracedFrame":
        """A column chosen by conditions.  ``uses`` must name the columns of the conditions too:
        a constant picked by a branch depends on the values the branch looked at."""
        (condition, value), *rest = branches
        chosen = F.when(condition, value)
        for condition, value in rest:
            chosen = chosen.when(condition, value)
        return self.with_columns({name: chosen.otherwise(otherwise)}, uses)

    def _chosen(self, name: str, index: Column, value: Column, inputs: dict[int, set[Tag]]) -> "TracedFrame":
        """A column whose lineage depends on the row: input sets by the number of the choice."""
        choice = self.ctx.origin_column()
        when: dict[Tag, set[int]] = {}
        for number, tags in inputs.items():
            for tag in tags:
                when.setdefault(tag, set()).add(number)
        everywhere = frozenset(inputs)
        tags = frozenset(t if numbers == everywhere else t.under(choice, frozenset(numbers)) for t, numbers in when.items())
        columns = self.columns if name in self.columns else [*self.columns, name]
        return self._with(self.full.withColumns({choice: index, name: value}), columns=columns, tags=self.tags | {name: tags},
                          choices=(*self.choices, choice), whole_group=self._unless_key([name]))

    def derive_least(self, name: str, columns: list[str], largest: bool = False) -> "TracedFrame":
        """The smallest (largest) of several columns, explained by the column it comes from; of equal
        ones by the first.  Nulls are skipped; where all are null, the first column explains it."""
        values = [col(c) for c in columns]
        value = (F.greatest if largest else F.least)(*values)
        index = F.coalesce(F.array_position(F.array(*values), value) - 1, F.lit(0)).cast("int")
        return self._chosen(name, index, value, {i: self.tags_of([c]) for i, c in enumerate(columns)})

    def derive_greatest(self, name: str, columns: list[str]) -> "TracedFrame":
        return self.derive_least(name, columns, largest=True)

    def derive_branch(self, name: str, branches: list[tuple[Column, Column, list[str], list[str]]], otherwise: Column,
                      otherwise_uses: list[str]) -> "TracedFrame":
        """A column chosen by conditions, explained by the branch taken.

        A branch is (condition, value, columns the condition looks at, columns of the value).  The
        lineage of a row has the value's columns of its branch and the columns of all conditions up to the
        one that held; inputs of other branches are left out.  Compare :meth:`derive_when`.
        """
        index, value = F.lit(len(branches)), otherwise
        for i, (condition, result, _, _) in reversed(list(enumerate(branches))):
            index = F.when(condition, i).otherwise(index)
            value = F.when(condition, result).otherwise(value)
        looked: set[Tag] = set()
        inputs = {}
        for i, (_, _, condition_uses, uses) in enumerate(branches):
            looked = looked | self.tags_of(condition_uses)
            inputs[i] = looked | self.tags_of(uses)
        inputs[len(branches)] = looked | self.tags_of(otherwise_uses)
        return self._chosen(name, index, value, inputs)

    def explode(self, name: str, array: Column, uses: list[str] | None = None) -> "TracedFrame":
        """One row per array element; every child keeps the ids of its parent row and has its ordinal."""
        inputs = frozenset(self.row_tags() if uses is None else self.tags_of(uses))
        columns = self.columns if name in self.columns else [*self.columns, name]
        ordinal = self.ctx.origin_column()
        kept = [col(c) for c in self.full.columns if c != name]
        return self._with(self.full.select(*kept, F.posexplode(array).alias(ordinal, name)), columns=columns,
                          tags=self.tags | {name: inputs}, unique=False, whole_group=None, ordinals=(*self.ordinals, ordinal))

    def explode_function(self, function, arguments: list[str], names: list[str], uses: list[str] | None = None) -> "TracedFrame":
        """One row per row that a user-defined table function returns for ``arguments``.

        ``function`` is a table function (``pyspark.sql.functions.udtf``) called once per row, laterally; its
        result columns become ``names``.  Children keep the ids of their row.  A function without
        result rows drops the row.
        """
        inputs = frozenset(self.row_tags() if uses is None else self.tags_of(uses))
        clash = set(names) & set(self.columns)
        if clash:
            raise ValueError(f"name other columns: {sorted(clash)}")
        made = function(*[col(a).outer() for a in arguments]).toDF(*names)
        return self._with(self.full.lateralJoin(made), columns=[*self.columns, *names],
                          tags=self.tags | {n: inputs for n in names}, unique=False, whole_group=None)

    def promote(self, columns: list[str] | None = None) -> "TracedFrame":
        """Switch to column-level lineage: each named column starts with the row's whole lineage."""
        row = frozenset(self.row_tags())
        return self._with(self.full, tags=self.tags | {c: row for c in columns or self.columns},
                          column_lineage=True)

    def named(self, name: str) -> "TracedFrame":
        return self._with(self.full, name=name)

    # -- several rows in -------------------------------------------------------------------

    def join(self, other: "TracedFrame", on: str | list[str]) -> "TracedFrame":
        """Inner equi-join; a result row descends from both of its parents."""
        self._same_context(other)
        on = [on] if isinstance(on, str) else list(on)
        clash = (set(self.columns) & set(other.columns)) - set(on)
        if clash:
            raise ValueError(f"rename before the join: {sorted(clash)}")
        renamed = {c: self.ctx.origin_column() for c in other.hidden() if c in self.hidden()}
        right = other.full.withColumnsRenamed(renamed)
        right_tags = {c: frozenset(t.renamed(renamed) for t in ts) for c, ts in other.tags.items()}
        origins = self.origins | {renamed.get(c, c): o for c, o in other.origins.items()}
        tags = self.tags | {c: (self.tags[c] | ts if c in on else ts) for c, ts in right_tags.items()}
        columns = [*on, *[c for c in self.columns if c not in on],
                   *[c for c in other.columns if c not in on]]
        return self._with(self.full.join(right, on), columns=columns, origins=origins, tags=tags,
                          unique=False, name=f"{self.name}+{other.name}", whole_group=None,
                          ordinals=(*self.ordinals, *[renamed.get(c, c) for c in other.ordinals]),
                          choices=(*self.choices, *[renamed.get(c, c) for c in other.choices]),
                          column_lineage=self.column_lineage or other.column_lineage)

    def union(self, other: "TracedFrame") -> "TracedFrame":
        """Rows of both frames (same columns); each row keeps the ids of its own side, and the side
        itself where both sides descend from one source."""
        self._same_context(other)
        if set(self.columns) != set(other.columns):
            raise ValueError("a union needs the same columns on both sides")
        shared = set(self.origins) & set(other.origins)
        tags = {c: self.tags[c] | other.tags[c] for c in self.columns}
        left, right, ordinals = self.full, other.full, dict.fromkeys([*self.ordinals, *other.ordinals])
        if shared:
            side = self.ctx.origin_column()
            left, right, ordinals = left.withColumn(side, F.lit(0)), right.withColumn(side, F.lit(1)), ordinals | {side: None}
        both = left.unionByName(right, allowMissingColumns=True)
        return self._with(both, ordinals=tuple(ordinals), choices=tuple(dict.fromkeys([*self.choices, *other.choices])), origins=self.origins | other.origins, tags=tags, whole_group=None,
                          unique=self.unique and other.unique and not shared,
                          column_lineage=self.column_lineage or other.column_lineage)

    def distinct(self, columns: list[str] | None = None) -> "TracedFrame":
        """Distinct values of ``columns``; each descends from all of its duplicates."""
        return self.group_agg(columns or self.columns, {})

    def group_agg(self, keys: str | list[str], aggs: dict[str, Agg],
                  influence: Influence | None = None, value: str | None = None,
                  name: str | None = None) -> "TracedFrame":
        """Aggregate by key.

        With ``influence`` every result column is explained by the rows it keeps, judged by
        ``value`` (default: the first input of the first aggregate).  Without it: all rows of the
        group or, under column-level lineage, what each aggregate declares.
        """
        keys = [keys] if isinstance(keys, str) else list(keys)
        if not keys:
            raise ValueError("group_agg needs at least one key column")
        if influence is not None and value is None:
            value = next((a.uses[0] for a in aggs.values() if a.uses), None)
            if value is None and not isinstance(influence, All):
                raise ValueError("name the value column the influence looks at")
        grouped = self.full.groupBy(*[col(k) for k in keys])
        if aggs:
            plain = grouped.agg(*[a.expr.alias(n) for n, a in aggs.items()])
        else:
            plain = self.full.select(*[col(k) for k in keys]).distinct()
        return self._grouped(plain, keys, aggs, influence, value, name)

    def fold_agg(self, keys: str | list[str], state: dict[str, Column], combine, results: dict[str, Column],
                 uses: list[str], influence: Influence | None = None, name: str | None = None) -> "TracedFrame":
        """A keyed fold of one's own (see ``folds.fold``).  ``results`` are computed from the final
        state; ``uses`` are the input columns, the first being the value influences look at."""
        from rowtrail.operators.folds import fold  # pandas is needed only here

        keys = [keys] if isinstance(keys, str) else list(keys)
        folded = fold(self.full, keys, state, combine)
        plain = folded.select(*[col(k) for k in keys], *[e.alias(n) for n, e in results.items()])
        aggs = {n: Agg(e, tuple(uses)) for n, e in results.items()}
        return self._grouped(plain, keys, aggs, influence, uses[0] if influence else None, name)

    def _grouped(self, plain: DataFrame, keys, aggs, influence, value, name) -> "TracedFrame":
        group = Group(self, tuple(keys), dict(aggs), influence, value)
        id_column = self.ctx.origin_column()
        tags = {c: frozenset({Tag(id_column, c)}) for c in [*keys, *aggs]}
        return TracedFrame(self.ctx, plain.withColumn(id_column, F.struct(*[col(k) for k in keys])),
                           [*keys, *aggs], {id_column: group}, tags, unique=True,
                           column_lineage=self.column_lineage,
                           name=name or f"{self.name} by {', '.join(keys)}", whole_group=group)

    def top_bottom_mean(self, keys: str | list[str], value: str, low: int = 5, high: int = 5,
                        names: tuple[str, str] = ("low_mean", "high_mean"),
                        name: str | None = None) -> "TracedFrame":
        """Means of the ``low`` smallest and the ``high`` largest values of each group; each mean
        is explained by exactly the values it averages."""
        keys = [keys] if isinstance(keys, str) else list(keys)
        ids = list(self.origins)
        sides = []
        for chosen, flag in ((Bottom(low), 0), (Top(high), 1)):
            kept = chosen.keep(self.full, keys, col(value), ids)
            sides.append(kept.select(*[col(k) for k in keys], col(value).alias("__v"),
                                     F.lit(flag).alias("__side")))
        means = [F.avg(F.when(col("__side") == flag, col("__v"))).alias(n)
                 for flag, n in enumerate(names)]
        plain = sides[0].unionByName(sides[1]).groupBy(*[col(k) for k in keys]).agg(*means)
        aggs = {names[0]: Agg(F.avg(col(value)), (value,), Bottom(low)),
                names[1]: Agg(F.avg(col(value)), (value,), Top(high))}
        return self._grouped(plain, keys, aggs, None, value, name)

    # -- storage ---------------------------------------------------------------------------

    def stored(self) -> "TracedFrame":
        """Write this stage (with its ids) so that later traces start from it."""
        return self._with(materialize(self.full, "frame"))

    def persist(self) -> "TracedFrame":
        return self._with(self.full.persist())

    def unpersist(self) -> "TracedFrame":
        return self._with(self.full.unpersist())

    # -- lineage ---------------------------------------------------------------------------

    def edges(self, keep: list[str] | None = None, by_column: bool | list[str] = False) -> DataFrame:
        """Long-form lineage ``(keep..., [out_col], src, rid)``, one row per output and input row.

        ``keep`` are the visible columns that identify an output (default: the group key, or all).
        """
        from rowtrail.operators.lineage import edges

        return edges(self, keep, by_column)

    def identified(self, name: str = "out_id") -> "TracedFrame":
        """The frame with a visible column that tells its rows apart, equal ones too.

        An output row is identified by the ids of the rows it is made of and the ordinals of the
        array elements: a struct with a field per input (named after it) and ``element``, ``element_2``, ….  It
        needs no shuffle and does not depend on partitioning.
        """
        fields: dict[str, Column] = {}
        for hidden in [*self.origins, *self.ordinals]:
            base = self.origins[hidden].name if hidden in self.origins and not isinstance(self.origins[hidden], Group) else (
                "group" if hidden in self.origins else "element")
            label, k = base, 2
            while label in fields:
                label, k = f"{base}_{k}", k + 1
            fields[label] = col(hidden)
        made = self.full.withColumn(name, F.struct(*[c.alias(label) for label, c in fields.items()]))
        return self._with(made, columns=[name, *[c for c in self.columns if c != name]],
                          tags=self.tags | {name: frozenset(self.row_tags())}, unique=True)

    def with_provenance(self, identity: str | None = None) -> DataFrame:
        """Every output row with each of its input ids.

        ``identity`` names a column that tells output rows apart (see :meth:`identified`): each output then
        has a set of its own.  Without it, equal outputs share one set.
        """
        frame = self if identity is None else self.identified(identity)
        return frame.edges(keep=frame.columns)

    def with_provenance_size(self, name: str = "ids") -> DataFrame:
        """The groups of an aggregation with the number of their distinct input rows.

        Where all rows of a group count and they come from one source, that is one aggregate beside the
        others: one scan, no lineage query.  Otherwise the sizes are counted from the edges and joined.
        """
        group = self.whole_group
        if group is None or not set(group.keys) <= set(self.columns):
            raise ValueError("sizes belong to the groups of an aggregation with its keys")
        parent = group.parent
        origins = list(parent.origins.values())
        plain = not parent.column_lineage and isinstance(group.influence or All(), All)
        if plain and len(origins) == 1 and not isinstance(origins[0], Group) and set(self.columns) == {*group.keys, *group.aggs}:
            ids = F.count_distinct(*[col(c) for c in parent.origins]).alias(name)
            return (parent.full.groupBy(*[col(k) for k in group.keys]).agg(*[a.expr.alias(n) for n, a in group.aggs.items()], ids)
                    .select(*[col(c) for c in [*self.columns, name]]))
        from rowtrail.operators.provenance import provenance_size

        sizes = provenance_size(self.edges(keep=list(group.keys)), list(group.keys)).withColumnRenamed("ids", name)
        return null_safe_join(self.df, sizes, list(group.keys), "left").na.fill(0, [name])

    def take_with_provenance(self, n: int, identity: str | None = None) -> DataFrame:
        """``with_provenance`` for ``n`` output rows."""
        return self._with(materialize(self.full.limit(n), "taken"), whole_group=None).with_provenance(identity)

    def trace(self, where: Column | str | None = None, columns: list[str] | None = None,
              rules: list[tuple[Column, list[str]]] | None = None) -> "Trace":
        """Trace the outputs that satisfy ``where`` back to their inputs.

        ``columns`` restricts the trace to the lineage of those result columns; ``rules`` picks
        columns per output: each (condition, columns) applies to the outputs that satisfy it.
        """
        from rowtrail.operators.trace import Trace

        return Trace(self, where, columns, rules)
