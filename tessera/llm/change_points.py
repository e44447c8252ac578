"""Penalised change points of daily series by divide and conquer (CDQ) over the segmentation's dynamic programme.

f(j) is the best key of a series' first j days: f(j) = min over i <= j - SHORTEST of f(i) + cost(i, j) + PENALTY for a
cut at i. The programme of [l, r) is solved for the left half, whose values are then pushed to the right half by
min-plus kernels over blocks of (start, end), and the right half follows. Keys are lexicographic: cost, then number of
segments, then the earliest predecessor. Cost and number share an integer; starts are met in ascending order and only
a smaller key replaces one, so the earliest stays. Many series go through the kernels side by side.

Spark sums the rows by series and day before anything meets in a task, so a series of a third of all rows is a row for
each of its days like any other; a task holds BATCH days of series at a time. Time grows with the square of a series'
calendar span and not with its rows. Integers are exact: series whose products leave 64 bits use Python's.

Results for odd input: rows without a quantity, a day or one of the taken flags are left out; rows without a vendor
are a series of their own; repeated rows count again; negative quantities are summed as they are; a series of fewer
than SHORTEST days is one segment; an empty table gives no rows. Only the four named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import sorted_groups

SHORTEST = 5
PENALTY = 10_000
FLAGS = ("kept", "swapped")
#: Days of the series that go through the kernels together, and cells of a block of (series, start, end).
BATCH = 1 << 15
CELLS = 1 << 18
UNREACHED = 1 << 61
SCHEMA = "vendor_id long, segment_no int, first_day long, n_days long, total long, spread long, cost long, n_segments long, best_cost long"


def scaled_logs(v: np.ndarray) -> np.ndarray:
    """floor(1000 ln v) in double; where a vectorised logarithm's last digit could matter, the C library's decides."""
    x = 1000.0 * np.log(v.astype(np.float64))
    near = (np.abs(x - np.rint(x)) < 1e-6) & (x != 0)
    out = np.floor(x).astype(np.int64)
    for at in zip(*np.nonzero(near), strict=True):
        out[at] = math.floor(1000.0 * math.log(float(v[at])))
    return out


class Programme:
    """The dynamic programmes of series of like length, as rows of one matrix; a shorter row is padded behind its end."""

    def __init__(self, series: list[np.ndarray], shortest: int = SHORTEST, penalty: int = PENALTY):
        self.n = max(map(len, series))
        self.shortest, self.penalty = shortest, penalty
        self.unit = self.n + 1  # a key is cost * unit + segments
        largest = max(float(np.abs(s).max()) for s in series)
        kind = np.int64 if (self.n + 1) ** 2 * largest * largest < 2.0 ** 62 else object
        x = np.zeros((len(series), self.n), kind)
        for row, s in zip(x, series, strict=True):
            row[:len(s)] = s
        zero = np.zeros((len(series), 1), kind)
        self.sums = np.concatenate([zero, np.cumsum(x, axis=1, dtype=kind)], axis=1)
        self.squares = np.concatenate([zero, np.cumsum(x * x, axis=1, dtype=kind)], axis=1)
        self.key = np.full((len(series), self.n + 1), UNREACHED, np.int64)
        self.key[:, 0] = 0
        self.back = np.zeros((len(series), self.n + 1), np.int64)
        self.solve(0, self.n + 1)

    def solve(self, left: int, right: int) -> None:
        if right - left <= self.shortest:
            return  # no two of these places are a segment's length apart
        mid = (left + right) // 2
        self.solve(left, mid)
        self.push(left, mid, mid, right)
        self.solve(mid, right)

    def push(self, i0: int, i1: int, j0: int, j1: int) -> None:
        """Offers every start in [i0, i1) to every end in [j0, j1), in blocks of ascending starts."""
        rows = len(self.key)
        side = max(8, math.isqrt(CELLS // max(1, rows)))
        for a in range(i0, i1, side):
            b = min(i1, a + side)
            for c in range(max(j0, a + self.shortest), j1, side):
                self.kernel(a, b, c, min(j1, c + side))

    def kernel(self, i0: int, i1: int, j0: int, j1: int) -> None:
        start, end = np.arange(i0, i1)[:, None], np.arange(j0, j1)[None, :]
        days = end - start
        fits = days >= self.shortest
        n = np.where(fits, days, 1)
        total = self.sums[:, None, j0:j1] - self.sums[:, i0:i1, None]
        spread = (n * (self.squares[:, None, j0:j1] - self.squares[:, i0:i1, None]) - total * total) // (n * n) + 1
        cost = n * scaled_logs(np.where(fits, spread, 1)) + self.penalty * (start > 0)
        key = self.key[:, i0:i1, None] + cost * self.unit + 1
        key[:, ~fits] = UNREACHED
        first = key.argmin(axis=1)
        best = np.take_along_axis(key, first[:, None, :], axis=1)[:, 0]
        better = best < self.key[:, j0:j1]
        self.key[:, j0:j1][better] = best[better]
        self.back[:, j0:j1][better] = first[better] + i0

    def segments(self, row: int, n: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
        """(first day, days, total, spread, cost) of each segment of a row's first n days, and the whole's best cost."""
        cuts = [n]
        while cuts[-1] > 0:
            cuts.append(int(self.back[row, cuts[-1]]) if n >= self.shortest else 0)
        cuts.reverse()
        out, whole = [], self.penalty * (len(cuts) - 2)
        for a, b in zip(cuts, cuts[1:], strict=False):
            days, s, q = b - a, int(self.sums[row, b] - self.sums[row, a]), int(self.squares[row, b] - self.squares[row, a])
            v = 1 + (days * q - s * s) // (days * days)
            cost = days * math.floor(1000.0 * math.log(v))
            out.append((a, days, s, v, cost))
            whole += cost
        return out, whole


def _dense(day: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros(int(day[-1] - day[0]) + 1, np.int64)
    out[day - day[0]] = x
    return out


def _solved(batch: list[tuple[int | None, int, np.ndarray]], shortest: int, penalty: int) -> pa.RecordBatch:
    programme = Programme([s for _, _, s in batch], shortest, penalty)
    rows = []
    for k, (vendor, first, s) in enumerate(batch):
        segments, whole = programme.segments(k, len(s))
        rows += [(vendor, no, first + a, days, total, spread, cost, len(segments), whole) for no, (a, days, total, spread, cost) in enumerate(segments, 1)]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int32() if c.endswith("int") else pa.int64() for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def segments_of(daily: DataFrame, shortest: int = SHORTEST, penalty: int = PENALTY) -> DataFrame:
    """The segments of every series. daily: vendor_id, day, x, at most one row for each series and day."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, int, np.ndarray]] = []
        days = longest = 0
        for groups in sorted_groups(batches, 2):
            at = [*groups["_start"].tolist(), len(groups["day"])]
            for a, b in zip(at, at[1:], strict=False):
                day = groups["day"][a:b]
                span = int(day[-1] - day[0]) + 1
                if held and max(longest, span) * (len(held) + 1) > BATCH:
                    yield _solved(held, shortest, penalty)
                    held, longest = [], 0
                held.append((None if groups["unnamed"][a] else int(groups["vendor_id"][a]), int(day[0]), _dense(day, groups["x"][a:b])))
                longest = max(longest, span)
        if held:
            yield _solved(held, shortest, penalty)

    keys = [F.col("vendor_id").isNull().alias("unnamed"), F.coalesce("vendor_id", F.lit(0)).cast("long").alias("vendor_id"), F.col("day").cast("long").alias("day"), F.col("x").cast("long").alias("x")]
    dealt = daily.select(*keys).repartition("unnamed", "vendor_id").sortWithinPartitions("unnamed", "vendor_id", "day")
    return dealt.mapInArrow(run, SCHEMA)


def change_points(lines: DataFrame, shortest: int = SHORTEST, penalty: int = PENALTY) -> DataFrame:
    """A row for each segment of each vendor's daily series of taken quantities, see SCHEMA."""
    taken = lines.where(F.col("flag").isin(*FLAGS) & F.col("quantity").isNotNull() & F.col("shipped_at").isNotNull())
    daily = taken.groupBy("vendor_id", F.unix_date(F.to_date("shipped_at")).alias("day")).agg(F.sum(F.col("quantity").cast("long")).alias("x"))
    return segments_of(daily, shortest, penalty)


#: The same programme as a recursion over prefixes, with lists for prefix sums, keys (cost * 1000000 + segments) and predecessors.
ORACLE = """
WITH RECURSIVE taken AS (
  SELECT vendor_id, CAST(shipped_at AS DATE) - DATE '1970-01-01' AS day, CAST(sum(quantity) AS HUGEINT) AS x
  FROM sale_lines WHERE flag IN ('kept', 'swapped') AND quantity IS NOT NULL AND shipped_at IS NOT NULL GROUP BY ALL),
spans AS (SELECT vendor_id, min(day) AS lo, max(day) - min(day) + 1 AS n FROM taken GROUP BY vendor_id),
days AS (SELECT vendor_id, lo, n, unnest(range(lo, lo + n)) AS day FROM spans),
filled AS (
  SELECT d.vendor_id, d.lo, d.n, d.day, coalesce(t.x, 0) AS x
  FROM days d LEFT JOIN taken t ON t.vendor_id IS NOT DISTINCT FROM d.vendor_id AND t.day = d.day),
summed AS (
  SELECT *, sum(x) OVER w AS s, sum(x * x) OVER w AS q FROM filled WINDOW w AS (PARTITION BY vendor_id ORDER BY day)),
prefixes AS (
  SELECT vendor_id, lo, n, list_prepend(CAST(0 AS HUGEINT), list(CAST(s AS HUGEINT) ORDER BY day)) AS s,
         list_prepend(CAST(0 AS HUGEINT), list(CAST(q AS HUGEINT) ORDER BY day)) AS q
  FROM summed GROUP BY vendor_id, lo, n),
programme AS (
  SELECT vendor_id, lo, n, s, q, CAST(0 AS BIGINT) AS j, [CAST(0 AS HUGEINT)] AS f, [CAST(0 AS BIGINT)] AS b FROM prefixes
  UNION ALL
  SELECT vendor_id, lo, n, s, q, j, list_append(f, coalesce(list_min(c), CAST(1000000000000000000000000000000 AS HUGEINT))),
         list_append(b, CAST(coalesce(list_position(c, list_min(c)), 1) - 1 AS BIGINT))
  FROM (
    SELECT vendor_id, lo, n, s, q, j + 1 AS j, f, b,
           list_transform(range(0, CASE WHEN n < 5 THEN 1 ELSE greatest(0, j + 1 - 4) END), lambda i:
             f[i + 1] + 1 + 1000000 * CAST(CASE WHEN i > 0 THEN 10000 ELSE 0 END + (j + 1 - i) * floor(1000 * ln(CAST(
               1 + ((j + 1 - i) * (q[j + 2] - q[i + 1]) - (s[j + 2] - s[i + 1]) * (s[j + 2] - s[i + 1])) // ((j + 1 - i) * (j + 1 - i)) AS DOUBLE)))
             AS HUGEINT)) AS c
    FROM programme WHERE j < n)),
solved AS (SELECT * FROM programme WHERE j = n),
traced AS (
  SELECT vendor_id, lo, n, s, q, f, b, b[n + 1] AS first, n AS past FROM solved
  UNION ALL
  SELECT vendor_id, lo, n, s, q, f, b, b[first + 1], first FROM traced WHERE first > 0),
parts AS (
  SELECT vendor_id, lo, first, past - first AS days, s[past + 1] - s[first + 1] AS total,
         1 + ((past - first) * (q[past + 1] - q[first + 1]) - (s[past + 1] - s[first + 1]) * (s[past + 1] - s[first + 1])) // ((past - first) * (past - first)) AS v,
         f[n + 1] AS key FROM traced)
SELECT vendor_id, CAST(row_number() OVER (PARTITION BY vendor_id ORDER BY first) AS INTEGER) AS segment_no, CAST(lo + first AS BIGINT) AS first_day,
       CAST(days AS BIGINT) AS n_days, CAST(total AS BIGINT) AS total, CAST(v AS BIGINT) AS spread,
       CAST(days * floor(1000 * ln(CAST(v AS DOUBLE))) AS BIGINT) AS cost, CAST(key % 1000000 AS BIGINT) AS n_segments, CAST(key // 1000000 AS BIGINT) AS best_cost
FROM parts
"""
