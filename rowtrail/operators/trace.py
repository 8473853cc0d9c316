"""Backward tracing of chosen outputs, and scoring a trace against known faults."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from rowtrail.operators.frame import Group, TracedFrame
from rowtrail.operators.keyed import col, fits_broadcast, null_safe_join
from rowtrail.operators.lineage import RID, Reached, Visit, merged, resolve
from rowtrail.operators.provenance import BITMAP_BYTES, bitmap_semi_join, id_bitmaps
from rowtrail.scratch import materialize


class Trace:
    def __init__(self, frame: TracedFrame, where, columns: list[str] | None,
                 rules: list[tuple[Column, list[str]]] | None):
        if columns is not None and rules is not None:
            raise ValueError("give columns or rules, not both")
        self.frame, self.where, self.columns, self.rules = frame, where, columns, rules
        self._stored: dict[str, DataFrame] = {}

    @cached_property
    def _target_rows(self) -> DataFrame:
        chosen = self.frame.full if self.where is None else self.frame.full.where(self.where)
        return materialize(chosen, "targets") if self._grouped else chosen

    @property
    def _grouped(self) -> bool:
        return any(isinstance(o, Group) for o in self.frame.origins.values())

    @property
    def targets(self) -> DataFrame:
        """The outputs under suspicion."""
        return self._target_rows.select(*[col(c) for c in self.frame.columns])

    def _requests(self):
        if self.rules is not None:
            return [(self._target_rows.where(condition), self.frame.tags_of(columns), False)
                    for condition, columns in self.rules]
        tags = self.frame.row_tags() if self.columns is None else self.frame.tags_of(self.columns)
        return [(self._target_rows, tags, self.where is None)]

    def _resolve(self, visits: list[Visit] | None = None) -> list[Reached]:
        reached: list[Reached] = []
        for rows, tags, complete in self._requests():
            reached += resolve(self.frame, rows, tags, [], self._grouped, complete, visits)
        return reached

    @cached_property
    def _reached(self) -> dict[str, DataFrame]:
        return merged(self._resolve(), [])

    def _stored_ids(self, source: str) -> DataFrame:
        """Ids of one source, written when first asked for."""
        if source not in self._stored:
            self._stored[source] = materialize(self._reached[source], "traced-ids")
        return self._stored[source]

    def _source(self, name: str | None):
        names = self.frame.sources()
        if name is None and len(names) != 1:
            raise ValueError(f"name the source to resolve: {names}")
        return self.frame.ctx.sources[name or names[0]]

    def ids(self, source: str | None = None) -> DataFrame:
        """Key columns of the traced rows of one source."""
        src = self._source(source)
        if src.name not in self._reached:
            return src.df.select(*[col(k) for k in src.keys]).limit(0)
        found = self._stored_ids(src.name)
        if src.scalar_id:
            return found.select(col(RID).alias(src.keys[0]))
        return found.select(*[col(RID).getField(k).alias(k) for k in src.keys])

    def rows(self, source: str | None = None) -> DataFrame:
        """The traced rows of one source, with all of its columns."""
        src = self._source(source)
        ids = self.ids(src.name)
        if src.integral_id():
            # the id range as literals reaches the scan and skips files and row groups outside it
            key = src.keys[0]
            low, high = ids.agg(F.min(col(key)), F.max(col(key))).first()
            found = src.df.where(F.lit(False) if low is None else col(key).between(low, high))
            if not fits_broadcast(ids):
                buckets = ids.select(F.bitmap_bucket_number(key).alias("bucket")).distinct().count()
                if buckets * BITMAP_BYTES <= self.bitmap_limit:
                    return bitmap_semi_join(found, key, id_bitmaps(ids, key))
            return self._match(src, ids, "left_semi", found)
        return self._match(src, ids, "left_semi")

    #: Bitmaps of traced ids up to so many bytes are sent to the scan of the source; beyond, both are shuffled by id.
    bitmap_limit = 64 << 20

    @staticmethod
    def _match(src, ids: DataFrame, how: str, rows: DataFrame | None = None) -> DataFrame:
        """Source rows joined with ids.  One key column is compared plainly (a row without id is
        never traced), so that a source bucketed by its key needs no shuffle."""
        rows = src.df if rows is None else rows
        if src.scalar_id:
            joined = rows.join(ids, src.keys[0], how)
            return joined.select(*[col(c) for c in src.df.columns], *[
                col(c) for c in ids.columns if c not in src.keys and how != "left_semi"])
        return null_safe_join(rows, ids, list(src.keys), how)

    def _faults(self, src, fault: Column) -> DataFrame:
        return src.df.where(F.coalesce(fault, F.lit(False)))

    def metrics(self, fault: Column, source: str | None = None, count_outputs: bool = True) -> DataFrame:
        """One row: counts, precision, recall and yield of the trace against ``fault``.

        The source is scanned for its counts and for its faults; only the faults' keys are joined with
        the traced ids, so the source is not shuffled.  Counting all outputs runs the job once
        more; ``count_outputs=False`` leaves it null.
        """
        src = self._source(source)
        ids = self.ids(src.name)
        counts = src.df.agg(F.count(F.lit(1)).alias("input_count"), F.count_if(F.coalesce(fault, F.lit(False))).alias("fault_count"))
        keys = [col(k) for k in src.keys]
        hit = self._keys_match(src, self._faults(src, fault).select(*keys), ids, "left_semi")
        outputs = (self.frame.full.agg(F.count(F.lit(1))).scalar() if count_outputs
                   else F.lit(None).cast("bigint"))
        counts = counts.select(
            "input_count", outputs.alias("output_count"), self._target_rows.agg(F.count(F.lit(1))).scalar().alias("target_count"),
            "fault_count", ids.agg(F.count(F.lit(1))).scalar().alias("trace_count"), hit.agg(F.count(F.lit(1))).scalar().alias("correct_count"))
        correct = col("correct_count")
        return counts.select(
            "input_count", "output_count", "target_count", "fault_count", "trace_count", "correct_count",
            (col("fault_count") - correct).alias("missing_count"),
            (col("trace_count") - correct).alias("extra_count"),
            F.try_divide(correct.cast("double"), col("trace_count")).alias("precision"),
            F.try_divide(correct.cast("double"), col("fault_count")).alias("recall"),
            correct.alias("yield"))

    @staticmethod
    def _keys_match(src, rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        return rows.join(ids, src.keys[0], how) if src.scalar_id else null_safe_join(rows, ids, list(src.keys), how)

    def diff(self, fault: Column, source: str | None = None) -> DataFrame:
        """Source rows on which trace and fault disagree: ``kind`` untraced_fault or false_trace.

        Faults are looked up among the traced ids, traced rows are judged: the other rows take no part.
        """
        src = self._source(source)
        columns = [col(c) for c in src.df.columns]
        missed = self._keys_match(src, self._faults(src, fault), self.ids(src.name), "left_anti")
        wrong = self.rows(src.name).where(~F.coalesce(fault, F.lit(False)))
        return (missed.select(F.lit("untraced_fault").alias("kind"), *columns)
                .unionByName(wrong.select(F.lit("false_trace").alias("kind"), *columns)))

    def diff_values(self, fault: Column, columns: list[str], source: str | None = None) -> DataFrame:
        """The same comparison by value (multiset difference) instead of by row id."""
        src = self._source(source)
        faults = src.df.where(fault).select(*[col(c) for c in columns])
        found = self.rows(src.name).select(*[col(c) for c in columns])
        return (faults.exceptAll(found).select(F.lit("untraced_fault").alias("kind"), *columns)
                .unionByName(found.exceptAll(faults).select(F.lit("false_trace").alias("kind"), *columns)))

    def show(self, fault: Column, source: str | None = None, limit: int = 10) -> None:
        """Print up to ``limit`` targets, traced rows and disagreements, and the metrics."""
        for title, df in (("targets", self.targets), ("traced rows", self.rows(source)),
                          ("disagreements", self.diff(fault, source))):
            print(f"{title} (at most {limit})")
            df.show(limit, truncate=False)
        self.metrics(fault, source).show(vertical=True)

    def stage_counts(self) -> DataFrame:
        """Rows the trace touches at every stage, from the targets (stage 0) to the sources."""
        visits: list[Visit] = []
        self._resolve(visits)
        stages = [(0, self.frame.name, self._target_rows.agg(F.count(F.lit(1)).alias("rows")))]
        by_stage: dict[tuple[int, str], list[Visit]] = {}
        for visit in visits:
            by_stage.setdefault((visit.depth, visit.stage), []).append(visit)
        for (depth, name), group in sorted(by_stage.items()):
            rows = group[0].rows
            for visit in group[1:]:
                rows = rows.unionByName(visit.rows, allowMissingColumns=True)
            if len(group) > 1 or not group[0].unique:
                rows = rows.distinct()
            stages.append((depth, name, rows.agg(F.count(F.lit(1)).alias("rows"))))
        out = None
        for depth, name, counted in stages:
            one = counted.select(F.lit(depth).alias("stage"), F.lit(name).alias("name"), "rows")
            out = one if out is None else out.unionByName(one)
        return out
