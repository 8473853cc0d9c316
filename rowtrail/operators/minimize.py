"""Finding a minimal failing input by delta debugging over Spark jobs.

The candidates are stored sorted by a contiguous position.  A subset is a short list of position
intervals, so testing one is a range filter on that table (pushed to the scan).  Only when a
subset has fallen into many intervals are its rows written again.  Equal rows stay different
candidates.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from rowtrail.operators.keyed import col, null_safe_join
from rowtrail.scratch import materialize
from rowtrail.sources.ids import with_position

POS = "__pos"
#: A subset of more intervals is written and numbered anew, so that it is one interval again.
MAX_INTERVALS = 32
#: So many removals at once are kept as intervals; more are a table that the candidates are joined with.
FEW = 16
#: Numbers of so many parts are put in order by one task.
MANY_PARTS = 1 << 16
#: So many consecutive chunks of a key are folded by one task; a key with more is folded by block.
BLOCK_BITS = 12
Interval = tuple[int, int]  # [from, to)


def size_of(intervals: list[Interval]) -> int:
    return sum(hi - lo for lo, hi in intervals)


def inside(intervals: list[Interval]) -> Column:
    return reduce(lambda a, b: a | b, [(col(POS) >= lo) & (col(POS) < hi) for lo, hi in intervals],
                  F.lit(False))


def ranks_between(intervals: list[Interval], start: int, stop: int) -> list[Interval]:
    """The part of ``intervals`` that holds its rows number ``start`` to ``stop`` - 1."""
    out, seen = [], 0
    for lo, hi in intervals:
        first, last = max(start - seen, 0), min(stop - seen, hi - lo)
        if first < last:
            out.append((lo + first, lo + last))
        seen += hi - lo
    return out


def chunk_bounds(total: int, parts: int) -> list[int]:
    """Row number where each of ``parts`` equal runs begins (and the end)."""
    return [-(-j * total // parts) for j in range(parts + 1)]


@dataclass(frozen=True)
class Fold:
    """A mergeable partial aggregate: ``expr`` per chunk, combined by ``merge``."""

    expr: Column
    merge: str = "sum"  # sum, min or max


@dataclass(frozen=True)
class FoldedProgram:
    """A program of the form prepare, group, fold, test.

    ``prepare`` works row by row and keeps the columns it does not know (add with
    ``withColumns``, drop rows with ``where``); ``failing`` is a predicate on the folded columns.
    """

    keys: list[str]
    folds: dict[str, Fold]
    failing: Column
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df


_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def own_partials(rows: DataFrame, chunk: str, program: FoldedProgram) -> DataFrame:
    """The folds of every (key, chunk)."""
    return rows.groupBy(*[col(k) for k in program.keys], chunk).agg(
        F.count(F.lit(1)).alias("__n"), *[f.expr.alias(name) for name, f in program.folds.items()])


def _merged(a: Column, b: Column, merge: str) -> Column:
    """Two folds as one; a null fold is one over no rows."""
    if merge == "sum":
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    return (F.least if merge == "min" else F.greatest)(a, b)


def _sides(rows: DataFrame, keys: list[str], order: str, merges: dict[str, str], after: str, before: str | None, whole: str | None) -> DataFrame:
    """Adds the folds of a key's rows after and before each row and of all, in one task per key.  Both sides run along their
    frame, up and down the order: a frame that ends at the last row would be folded anew for every row."""
    key = Window.partitionBy(*[col(k) for k in keys])
    frames = {after: key.orderBy(col(order).desc()).rowsBetween(Window.unboundedPreceding, -1),
              before: key.orderBy(col(order).asc()).rowsBetween(Window.unboundedPreceding, -1), whole: key}
    for prefix, frame in frames.items():
        if prefix is not None:
            rows = rows.withColumns({prefix + name: _MERGE[m](name).over(frame) for name, m in merges.items()})
    return rows


def running_folds(rows: DataFrame, keys: list[str], order: str, merges: dict[str, str], numbers: int, after: str, before: str | None = None,
                  whole: str | None = None) -> DataFrame:
    """Adds to rows with one number ``order`` each per key, below about ``numbers``, the folds of the key's later and earlier
    ones and of all, under the given prefixes.

    With many numbers, blocks of consecutive ones are folded in tasks of their own, and a row's folds are those of its
    block's other rows and of the other blocks, of which there are few.
    """
    if numbers <= 4 << BLOCK_BITS:
        return _sides(rows, keys, order, merges, after, before, whole)
    blocked = rows.withColumn("__block", F.shiftright(order, BLOCK_BITS))
    sides = [prefix for prefix in (after, before) if prefix is not None]
    outer = {prefix: "__outer" + prefix for prefix in sides}
    blocks = blocked.groupBy(*[col(k) for k in keys], "__block").agg(*[_MERGE[m](name).alias(name) for name, m in merges.items()])
    around = _sides(blocks, keys, "__block", merges, outer[after], outer.get(before), whole).drop(*merges)
    inner = _sides(blocked, [*keys, "__block"], order, merges, after, before, None)
    joined = null_safe_join(inner, around, [*keys, "__block"])
    return joined.withColumns({p + name: _merged(col(p + name), col(outer[p] + name), m) for p in sides for name, m in merges.items()}).drop(
        "__block", *[outer[p] + name for p in sides for name in merges])


def _merges(program: FoldedProgram) -> dict[str, str]:
    return {"__n": "sum"} | {name: f.merge for name, f in program.folds.items()}


def chunk_partials(partial: DataFrame, chunk: str, program: FoldedProgram, chunks: int = 1) -> DataFrame:
    """Adds to :func:`own_partials` the folds of the whole (``all_``) and of all other of about ``chunks`` chunks
    (``rest_``).  The rest is merged from running folds on both sides, so no inverse is needed and
    the work is linear in the number of chunks.  ``__first`` marks the first chunk of a key."""
    merges = _merges(program)
    sides = running_folds(partial, program.keys, chunk, merges, chunks, "__right_", "__left_", "all_")
    return (sides.withColumns({f"rest_{name}": _merged(col(f"__left_{name}"), col(f"__right_{name}"), m) for name, m in merges.items()})
            .withColumn("__first", col("__left___n").isNull())
            .drop(*[f"{p}{name}" for p in ("__left_", "__right_") for name in merges]))


@dataclass(frozen=True)
class Removal:
    """Chunks that can go together: their numbers, or a table (``__chunk``) if there are many."""

    count: int
    chunks: list[int] | DataFrame


@dataclass
class Minimal:
    """``rows``: the minimal failing input.  ``rounds``: one log row per round; ``part`` is the number
    of the part found, or how many parts were taken out at once."""

    rows: DataFrame
    size: int
    failed: bool
    rounds: list[tuple] = field(default_factory=list)

    def log(self) -> DataFrame:
        schema = T.StructType([
            T.StructField("round", T.IntegerType()), T.StructField("size", T.LongType()),
            T.StructField("parts", T.LongType()), T.StructField("found", T.StringType()),
            T.StructField("part", T.LongType()), T.StructField("seconds", T.DoubleType())])
        return self.rows.sparkSession.createDataFrame(self.rounds, schema)


def store_candidates(candidates: DataFrame, ids: list[str]) -> DataFrame:
    positioned = with_position(candidates, ids, POS)
    return materialize(positioned, "candidates")


def minimize(candidates: DataFrame, ids: list[str], program, failing: Column | None = None,
             threshold: int = 1) -> Minimal:
    """Shrink ``candidates`` to a minimal subset on which the program still fails.

    ``program`` is a :class:`FoldedProgram` or a function ``DataFrame -> DataFrame`` tested with
    ``failing`` (several tests a job).  Order of the search: parts from first to last, then
    complements from first to last, then twice as many parts (more at first: a round of four costs as
    much as one of 16); it ends at ``threshold`` rows or
    when nothing smaller fails.

    Parts that can go one by one are taken out together, as many of them from the first on as leave a
    failing input.  Every input gone on with has been seen to fail, and at the end no single row can
    go; where several minimal inputs exist, another search order may find another one.

    With a folded program one job answers several rounds of halving at once, and otherwise all
    parts of a round (and, if none fails, all complements in a second job).  The folds are kept for
    chunks up to 64 times finer than a round asks for (``_FoldedSearch``), so finer rounds read no rows.
    """
    table = store_candidates(candidates, ids)
    total = table.count()
    if isinstance(program, FoldedProgram):
        search = _FoldedSearch(table, program)
    else:
        search = _TestedSearch(table, program, failing)

    current: list[Interval] = [(0, total)]
    rounds: list[tuple] = []
    started = time.time()
    failed = total > 0 and search.fails(current)
    rounds.append((0, total, 1, "whole" if failed else "none", None, time.time() - started))
    parts = 2
    while failed and size_of(current) > threshold:
        n = size_of(current)
        parts = min(parts, n)
        started = time.time()
        found = search.next(current, parts)
        kind, j = found if found else ("none", None)
        if kind == "complement":
            removal, j = j, j.count
            if isinstance(removal.chunks, list):
                current = without(current, parts, removal.chunks)
            else:
                rows = search.chunked(current, parts).join(removal.chunks, "__chunk", "left_anti").drop("__chunk", POS)
                table = store_candidates(rows, ids)
                current = [(0, table.count())]
                search.restart(table)
        rounds.append((len(rounds), n, parts, kind, j, time.time() - started))
        if found is None:
            if parts >= n:
                break
            parts = min(n, max(parts * 2, search.wide))
        elif kind == "part":
            current, parts = part_of(current, parts, j), 2
        else:
            parts = max((parts - j) * 2, search.wide)  # finer at once; single rows are tried again until none can go
        if len(current) > MAX_INTERVALS:
            table = store_candidates(table.where(inside(current)).drop(POS), ids)
            current = [(0, size_of(current))]
            search.restart(table)
    kept = table.where(inside(current) if failed else F.lit(False)).drop(POS)
    return Minimal(kept, size_of(current) if failed else 0, failed, rounds)


def part_of(current: list[Interval], parts: int, j: int) -> list[Interval]:
    bounds = chunk_bounds(size_of(current), parts)
    return ranks_between(current, bounds[j], bounds[j + 1])


def without(current: list[Interval], parts: int, chunks: list[int]) -> list[Interval]:
    """The subset less some of its ``parts`` equal runs."""
    n = size_of(current)
    bounds = chunk_bounds(n, parts)
    out, at = [], 0
    for j in sorted(chunks):
        out += ranks_between(current, at, bounds[j])
        at = bounds[j + 1]
    return _joined(out + ranks_between(current, at, n))


def _joined(intervals: list[Interval]) -> list[Interval]:
    out: list[Interval] = []
    for lo, hi in intervals:
        if out and out[-1][1] == lo:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def _rank(current: list[Interval]) -> Column:
    """Number of a row within the current subset, from its position."""
    rank, seen = None, 0
    for lo, hi in current:
        here = col(POS) - F.lit(lo - seen)
        rank = here if rank is None else F.when(col(POS) >= lo, here).otherwise(rank)
        seen += hi - lo
    return rank


#: Tests of an arbitrary program that one job runs side by side.
TESTS = 16


class _TestedSearch:
    """An arbitrary program: each job runs the program on up to ``TESTS`` subsets, as branches of a union."""

    wide = TESTS  # parts of a round once halves do not fail: one job tests as many

    def __init__(self, table: DataFrame, program: Callable[[DataFrame], DataFrame], failing: Column):
        self.table, self.program, self.failing = table, program, failing

    def restart(self, table: DataFrame) -> None:
        self.table = table

    def failing_of(self, subsets: list[list[Interval]]) -> list[int]:
        """Numbers of the subsets that fail."""
        branches = []
        for number, intervals in enumerate(subsets):
            out = self.program(self.table.where(inside(intervals)).drop(POS))
            branches.append(out.where(self.failing).select(F.lit(number).alias("test")).limit(1))
        return sorted(r["test"] for r in reduce(DataFrame.unionAll, branches).collect())

    def fails(self, intervals: list[Interval]) -> bool:
        return bool(self.failing_of([intervals]))

    def next(self, current: list[Interval], parts: int) -> tuple | None:
        for start in range(0, parts, TESTS):
            batch = range(start, min(start + TESTS, parts))
            failing = self.failing_of([part_of(current, parts, j) for j in batch])
            if failing:
                return "part", batch[failing[0]]
        for start in range(0, parts if parts > 2 else 0, TESTS):  # the complement of one half is the other
            batch = range(start, min(start + TESTS, parts))
            failing = [batch[i] for i in self.failing_of([without(current, parts, [j]) for j in batch])]
            if len(failing) == parts:
                failing.pop()  # something must stay
            if failing:
                longer = self.failing_of([without(current, parts, failing[:k]) for k in range(2, len(failing) + 1)]) if len(failing) > 1 else []
                chunks = failing[:longer[-1] + 2 if longer else 1]
                return "complement", Removal(len(chunks), chunks)
        return None


HALVINGS = 6


class _FoldedSearch:
    """A folded program: partial folds per chunk decide many subsets in one job.

    The folds of a subset are stored as a dyadic table: for the finest chunks of up to ``2 ** HALVINGS`` times
    as many parts as asked for.  Chunks of twice as many parts nest, so a coarser round merges neighbours of
    that table and reads no candidates.
    """

    wide = 32  # parts of a round once halves do not fail: no dearer than four

    def __init__(self, table: DataFrame, program: FoldedProgram):
        self.table, self.program = table, program
        self.keys = [col(k) for k in program.keys]
        self.known: dict[tuple[Interval, ...], bool] = {}  # halves judged ahead
        self.fine: tuple | None = None  # (subset, parts, stored folds)

    def restart(self, table: DataFrame) -> None:
        """Go on with the survivors, under new positions."""
        self.table, self.known, self.fine = table, {}, None

    def fails(self, intervals: list[Interval]) -> bool:
        if tuple(intervals) not in self.known:
            self._judge_halves(intervals)
        return self.known[tuple(intervals)]

    def next(self, current: list[Interval], parts: int) -> tuple | None:
        if parts == 2:
            halves = [part_of(current, 2, j) for j in range(2)]
            if tuple(halves[0]) not in self.known:
                self._judge_halves(current)
            return next((("part", j) for j in range(2) if self.fails(halves[j])), None)
        return self._round(current, parts)

    def _judge_halves(self, current: list[Interval]) -> None:
        """Judge ``current``, its halves, their halves and so on, from one scan.

        Rows are folded per smallest piece; every piece then counts for all pieces around it.
        Pieces are numbered like a binary heap, so the piece around n is n // 2.
        """
        pieces: dict[int, list[Interval]] = {1: current}
        starts = {1: 0}

        def cut(node: int, depth: int) -> Column:
            n = size_of(pieces[node])
            if depth == HALVINGS or n < 2:
                return F.lit(node)
            left, right = 2 * node, 2 * node + 1
            pieces[left], pieces[right] = part_of(pieces[node], 2, 0), part_of(pieces[node], 2, 1)
            starts[left], starts[right] = starts[node], starts[node] + size_of(pieces[left])
            return F.when(col("__rank") < starts[right], cut(left, depth + 1)).otherwise(cut(right, depth + 1))

        smallest = cut(1, 0)
        rows = (self.table.where(inside(current)).withColumn("__rank", _rank(current))
                .withColumn("__piece", smallest).drop("__rank", POS))
        partial = own_partials(self.program.prepare(rows), "__piece", self.program)
        around = F.explode(F.array(*[F.shiftright("__piece", i) for i in range(HALVINGS + 1)]))
        folds = self.program.folds
        outputs = (partial.withColumn("__node", around).where(col("__node") > 0).groupBy(*self.keys, "__node")
                   .agg(*[_MERGE[f.merge](name).alias(name) for name, f in folds.items()]))
        failing = outputs.where(self.program.failing).select("__node").distinct()
        found = {r["__node"] for r in failing.collect()}  # at most 2 ** (HALVINGS + 1) numbers
        self.known = {tuple(piece): node in found for node, piece in pieces.items()}

    def chunked(self, current: list[Interval], parts: int) -> DataFrame:
        """The rows of a subset with the number of their chunk."""
        rows = self.table.where(inside(current)).withColumn("__rank", _rank(current))
        return rows.withColumn("__chunk", F.expr(f"__rank * {parts}L div {size_of(current)}L")).drop("__rank")

    def _partials(self, current: list[Interval], parts: int) -> DataFrame:
        """The folds of every (key, chunk), from the dyadic table if it has them."""
        subset = tuple(current)
        if self.fine is None or self.fine[0] != subset or self.fine[1] % parts or (self.fine[1] // parts).bit_count() > 1:
            finest = parts
            while finest * 2 <= size_of(current) and finest < parts << HALVINGS:
                finest *= 2
            rows = self.program.prepare(self.chunked(current, finest).drop(POS))
            self.fine = (subset, finest, materialize(own_partials(rows, "__chunk", self.program), "dyadic"))
        _, finest, table = self.fine
        if finest == parts:
            return table
        merged = {"__n": F.sum("__n")} | {name: _MERGE[f.merge](name) for name, f in self.program.folds.items()}
        coarser = table.withColumn("__chunk", F.shiftright("__chunk", (finest // parts).bit_length() - 1))
        return coarser.groupBy(*self.keys, "__chunk").agg(*[e.alias(n) for n, e in merged.items()])

    def _round(self, current: list[Interval], parts: int) -> tuple | None:
        """All parts in one job; if none fails, all complements in another, and a third for how many parts
        can go at once.  A few numbers reach the driver."""
        program, keys = self.program, self.keys
        partial = self._partials(current, parts)
        first = partial.where(program.failing).agg(F.min("__chunk").alias("part")).first()["part"]
        if first is not None:
            return "part", first

        names = ["__n", *program.folds]
        # candidate outputs per (key, chunk): everything but the chunk, and everything
        sides = [F.struct(F.lit(prefix).alias("side"), *[col(f"{prefix}_{name}").alias(name) for name in names])
                 for prefix in ("rest", "all")]
        outputs = chunk_partials(partial, "__chunk", program, parts).select(
            *keys, "__chunk", "__first", F.explode(F.array(*sides)).alias("__out"))
        failing = (outputs.select(*keys, "__chunk", "__first", "__out.*")
                   .where(col("__n") > 0).where(program.failing))
        per_chunk = failing.groupBy("__chunk").agg(
            F.count_if(col("side") == "rest").alias("rest"), F.count_if(col("side") == "all").alias("whole"),
            F.count_if((col("side") == "all") & col("__first")).alias("__keys"))
        failing_keys = per_chunk.agg(F.coalesce(F.sum("__keys"), F.lit(0)))
        # A failing key without rows in a chunk fails in that chunk's complement as well, so every
        # chunk is judged, also those in which nothing fails.
        every = self.table.sparkSession.range(parts).withColumnRenamed("id", "__chunk")
        judged = every.join(per_chunk, "__chunk", "left").na.fill(0).withColumn("keys", failing_keys.scalar())
        loose = judged.where(col("rest") + col("keys") - col("whole") > 0).select("__chunk")
        return self._several(partial, loose, parts)

    def _several(self, partial: DataFrame, loose: DataFrame, parts: int) -> tuple | None:
        """How many of the chunks that can go one by one can go together, from the first on.

        Per key, the chunks that stay are one fold; suffix folds over the loose ones give the output
        after each removal, which holds until the key loses its next chunk.  The last count at which
        some key fails is the answer.
        """
        program, keys = self.program, self.keys
        if parts <= MANY_PARTS:  # so few numbers are ranked in one task
            ranked = materialize(loose.withColumn("__turn", F.row_number().over(Window.orderBy("__chunk")).cast("bigint") - 1), "loose")
        else:
            ranked = with_position(loose.withColumnRenamed("__chunk", "__loose"), ["__loose"], "__turn").withColumnRenamed("__loose", "__chunk")
        total = ranked.count()
        if total == 0:
            return None
        merges = _merges(program)
        turns = (partial.join(ranked, "__chunk", "left").withColumn("__turn", F.coalesce("__turn", F.lit(total)))
                 .groupBy(*keys, "__turn").agg(*[_MERGE[m](name).alias(name) for name, m in merges.items()]))
        start = turns.select(*keys).distinct().withColumn("__turn", F.lit(-1).cast("bigint"))
        following = {"__next": "min", **merges}
        every = turns.unionByName(start, allowMissingColumns=True).withColumn("__next", col("__turn"))
        states = running_folds(every, program.keys, "__turn", following, total, "__after_").select(
            *keys, F.coalesce("__after___next", F.lit(total)).alias("__until"), *[col(f"__after_{name}").alias(name) for name in merges])
        count = states.where(col("__n") > 0).where(program.failing).agg(F.max("__until").alias("count")).first()["count"]
        if not count:
            return None
        gone = ranked.where(col("__turn") < count).select("__chunk")
        return "complement", Removal(count, [r["__chunk"] for r in gone.collect()] if count <= FEW else gone)


def minimize_trace(trace, program, failing: Column | None = None, source: str | None = None,
                   threshold: int = 1) -> tuple[Minimal, DataFrame]:
    """Trace suspicious outputs, minimize the traced rows, and report in one row what it took."""
    src = trace._source(source)
    began = time.time()
    candidates = materialize(trace.rows(src.name), "traced-rows")
    traced = candidates.count()
    trace_seconds = time.time() - began
    minimal = minimize(candidates, list(src.keys), program, failing, threshold)
    report = src.df.agg(F.count(F.lit(1)).alias("input_rows")).select(
        "input_rows", F.lit(traced).cast("bigint").alias("trace_rows"),
        F.lit(minimal.size).cast("bigint").alias("minimal_rows"),
        F.lit(len(minimal.rounds)).alias("rounds"), F.lit(trace_seconds).alias("trace_seconds"),
        F.lit(sum(r[-1] for r in minimal.rounds)).alias("minimize_seconds"))
    return minimal, report
