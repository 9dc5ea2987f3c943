"""Distance joins over dense vectors, exact unless asked otherwise.

Every vector belongs to the cell of its nearest pivot. A cell is cut into blocks, so neither a dense region nor a popular cell
ends up in one task. Within a radius (:func:`near_map`) a block is one row that holds its vectors, and the rows of the table of blocks
meet by a nested loop, which reads that table again and shuffles nothing; blocks that are too far apart by the triangle inequality do
not meet. For nearest neighbours a vector visits the cells that may hold one of its ``k`` nearest, and each pair of blocks is one group.
The number of blocks is bounded, so a row is copied a bounded number of times however many rows there are. Two blocks
are worked on by small tiles and emit results only, never candidate pairs.

The approximate mode takes buckets of random projections for cells, in several tables; a popular bucket is cut into
blocks in the same way.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewloom.operators.joins import null_safe_join
from reviewloom.session import materialize

BLOCK_ROWS = 1024
#: Blocks that a table or cell is cut into, as long as a block has at most ``LARGEST_BLOCK`` rows.
MAX_BLOCKS = 20
LARGEST_BLOCK = 65536
MAX_PIVOTS = 256
#: Result rows that a group holds before it reduces or emits them.
HELD_ROWS = 200_000
#: Blocks up to which the nearest neighbours are looked for in all of them.
FEW_BLOCKS = 8
#: Tables of random projections at most; a copy of every row goes to each.
MAX_TABLES = 48


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 1))


def _frame(**columns) -> pd.DataFrame:
    """A result frame whose strings stay plain objects."""
    def series(values):
        values = np.asarray(values)
        plain = values.dtype.kind in "OUS" or not len(values)
        return pd.Series(values, dtype=object if plain else values.dtype)

    return pd.DataFrame({name: series(values) for name, values in columns.items()})


def grown(n: int, block_rows: int) -> int:
    """Rows of a block: ``block_rows``, or more where ``n`` rows would make more than ``MAX_BLOCKS``."""
    return max(block_rows, min(LARGEST_BLOCK, -(-n // MAX_BLOCKS)))


def pick_pivots(points: DataFrame, n: int, block_rows: int = BLOCK_ROWS) -> np.ndarray:
    """At most ``MAX_PIVOTS`` vectors, the lowest by hash of their id."""
    count = min(MAX_PIVOTS, max(1, n // block_rows))
    rows = points.orderBy(F.xxhash64("id"), "id").limit(count).select("vector").collect()
    return np.array([r["vector"] for r in rows], dtype=float)


def blocked(points: DataFrame, eps: float, n: int | None = None,
            block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of ``points`` (group_key, id, vector, ...) copied to the block pairs they take part in.

    Adds ``cell, bi, bj, role``; role 0 is the left block, 1 the right one. Every unordered pair of
    points within ``eps`` and the same group meets in exactly one (group_key, cell, bi, bj).
    """
    n = points.count() if n is None else n
    block_rows = grown(n, block_rows)
    if n == 0:
        pivots = np.zeros((1, 1))
    else:
        pivots = pick_pivots(points, n, block_rows)
    slack = 2 * eps + 1e-9

    @F.pandas_udf("struct<home:int,visits:array<int>>")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        square = (pivots ** 2).sum(axis=1)
        for batch in batches:
            x = _matrix(batch)
            gap = np.sqrt(np.maximum((x ** 2).sum(axis=1)[:, None] + square - 2 * x @ pivots.T, 0))
            home = gap.argmin(axis=1)
            near = gap <= (gap.min(axis=1) + slack + 1e-6)[:, None]
            # A pair that spans two cells is looked at in the lower one only.
            near &= np.arange(len(pivots))[None, :] < home[:, None]
            yield pd.DataFrame({"home": home.astype("int32"),
                                "visits": [np.flatnonzero(r).astype("int32") for r in near]})

    if len(pivots) == 1:
        cells = points.withColumns({"cell": F.lit(0), "guest": F.lit(0)})
    else:
        placed = points.withColumn("_p", place("vector"))
        visits = F.concat(
            F.array(F.struct(F.col("_p.home").alias("cell"), F.lit(0).alias("guest"))),
            F.transform("_p.visits", lambda c: F.struct(c.alias("cell"), F.lit(1).alias("guest"))))
        cells = placed.select(*points.columns, F.inline(visits))

    # One row per group and pivot.
    blocks = cells.groupBy("group_key", "cell").agg(
        F.ceil(F.sum(1 - F.col("guest")) / block_rows).cast("int").alias("n_home"),
        F.ceil(F.sum("guest") / block_rows).cast("int").alias("n_guest"))
    sized = null_safe_join(cells, blocks, ["group_key", "cell"]).where("n_home > 0")
    spread = F.xxhash64("id")
    mine = F.when(F.col("guest") == 0, F.pmod(spread, F.col("n_home"))).otherwise(
        F.col("n_home") + F.pmod(spread, F.col("n_guest"))).cast("int")
    own = sized.withColumn("_b", mine)
    as_left = F.when(F.col("guest") == 0, F.transform(
        F.sequence(F.col("_b"), F.col("n_home") + F.col("n_guest") - 1),
        lambda j: F.struct(F.col("_b").alias("bi"), j.alias("bj"), F.lit(0).alias("role"))))
    last_left = F.least(F.col("_b"), F.col("n_home")) - 1
    as_right = F.when(last_left >= 0, F.transform(
        F.sequence(F.lit(0), F.greatest(last_left, F.lit(0))),
        lambda i: F.struct(i.alias("bi"), F.col("_b").alias("bj"), F.lit(1).alias("role"))))
    empty = F.array().cast("array<struct<bi:int,bj:int,role:int>>")
    return own.select(*points.columns, "cell", F.inline(
        F.concat(F.coalesce(as_left, empty), F.coalesce(as_right, empty))))


def within(left: np.ndarray, right: np.ndarray, eps: float, measured: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Index pairs at Euclidean distance ``<= eps`` (to nine digits) and the distances.

    The product form only preselects, with a slack that grows with the squares it is a difference of; the
    reported distance comes from the differences. Without ``measured`` no distances are reported, and only pairs within the
    slack of ``eps`` are measured.
    """
    a2, b2 = (left ** 2).sum(axis=1), (right ** 2).sum(axis=1)
    # Squares are two more coordinates, so that the matrix is written once.
    approx = (np.column_stack([-2 * left, a2, np.ones(len(left))]) @ np.column_stack([right, np.ones(len(right)), b2]).T).ravel()
    slack = 1e-6 + max(1e-13, 1e-15 * left.shape[1]) * (a2.max(initial=0.0) + b2.max(initial=0.0))
    found = np.flatnonzero(approx <= eps * eps + slack)
    open_ = np.arange(len(found)) if measured else np.flatnonzero(approx[found] >= eps * eps - slack)
    i, j = np.divmod(found, max(1, len(right)))
    near, dist = np.ones(len(found), bool), np.zeros(len(found))
    for s in range(0, len(open_), 65536):
        part = open_[s:s + 65536]
        dist[part] = np.sqrt(((left[i[part]] - right[j[part]]) ** 2).sum(axis=1))
        near[part] = np.round(dist[part], 9) <= eps
    return i[near], j[near], dist[near] if measured else None


def block_map(blocks: DataFrame, kernel: Callable, schema: str, reduced: Callable | None = None) -> DataFrame:
    """Apply ``kernel(left, right, same)`` to every block pair, a pair of tiles of ``BLOCK_ROWS`` rows at a time.

    ``same`` marks a tile with itself. Every pair of rows of a block pair meets in one call. ``reduced`` makes fewer rows of the rows
    that several calls gave, so that a group holds and emits little; it may be applied to its own results again.
    """
    def run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, _, bi, bj = key
        frame = pd.concat(list(batches), ignore_index=True)

        def tiles(rows: pd.DataFrame) -> list[pd.DataFrame]:
            return [rows.iloc[s:s + BLOCK_ROWS] for s in range(0, len(rows), BLOCK_ROWS)]

        left = tiles(frame[frame["role"] == 0])
        right = left if bi == bj else tiles(frame[frame["role"] == 1])
        yield from _reduced((kernel(a, b, bi == bj and i == j) for i, a in enumerate(left) for j, b in enumerate(right)
                             if bi != bj or i <= j), reduced)

    return blocks.groupBy("group_key", "cell", "bi", "bj").applyInPandas(run, schema)


def _reduced(results: Iterator[pd.DataFrame], reduced: Callable | None) -> Iterator[pd.DataFrame]:
    """What the calls of a pair of blocks gave, emitted or reduced whenever much of it is held."""
    held, rows, limit = [], 0, HELD_ROWS
    for found in results:
        if not len(found):
            continue
        held.append(found)
        rows += len(found)
        if rows < limit:
            continue
        whole = pd.concat(held, ignore_index=True)
        if reduced is None:
            yield whole
            held, rows = [], 0
        else:
            held = [reduced(whole)]
            rows = len(held[0])
            limit = max(HELD_ROWS, 2 * rows)
    if held:
        whole = pd.concat(held, ignore_index=True)
        yield whole if reduced is None else reduced(whole)


class Tile(NamedTuple):
    """Some rows of one group: ids, vectors and, where there is one, a number of each."""

    key: Any
    ids: np.ndarray
    x: np.ndarray
    more: np.ndarray | None = None

    def part(self, some) -> Tile:
        return Tile(self.key, self.ids[some], self.x[some], None if self.more is None else self.more[some])

    def tiles(self) -> list[Tile]:
        return [self.part(slice(s, s + BLOCK_ROWS)) for s in range(0, len(self.ids), BLOCK_ROWS)]


def _gaps(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x ** 2).sum(axis=1)[:, None] + (pivots ** 2).sum(axis=1) - 2 * x @ pivots.T, 0))


def near_map(points: DataFrame, eps: float, kernel: Callable, schema: str, reduced: Callable | None = None,
             more: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows that ``kernel(left, right, same)`` gives for pairs of tiles (:class:`Tile`) of one group.

    Every pair of rows of a group within ``eps`` meets in exactly one call; ``same`` marks a tile with itself. ``points``: group_key, id,
    vector, and ``more``, a column of whole numbers that tiles carry. ``reduced`` is as in :func:`block_map`. A group of at most a block
    is one group of rows; larger ones, of which there are no more than blocks, are packed (:func:`packed_blocks`).
    """
    rows = points.select("group_key", "id", "vector", *([more] if more else []))
    n = rows.count()
    block_rows = grown(n, block_rows)
    sizes = rows.groupBy("group_key").agg(F.count("*").alias("_rows"))
    # One row per group of more than a block.
    large = materialize(sizes.where(F.col("_rows") > block_rows), "large-groups")
    many = large.agg(F.count("*"), F.coalesce(F.sum("_rows"), F.lit(0))).first()
    parts = []
    if many[0]:
        whole = rows if many[1] == n else null_safe_join(rows, F.broadcast(large), ["group_key"]).drop("_rows")
        parts.append(_met(packed_blocks(whole, many[1], more, block_rows), eps, kernel, schema, reduced))
    if many[1] < n or not n:
        small = null_safe_join(rows, F.broadcast(large), ["group_key"], "left").where("_rows IS NULL").drop("_rows")

        def tile(frame: pd.DataFrame) -> Tile:
            return Tile(frame["group_key"].iloc[0], frame["id"].to_numpy(), _matrix(frame["vector"]), frame[more].to_numpy() if more else None)

        # One block a group.
        parts.append(block_map(blocked(small, eps, min(n, 1), block_rows),
                               lambda left, right, same: kernel(tile(left), tile(right), same), schema, reduced))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


class Blocks(NamedTuple):
    """A table of blocks, a row each, and what the driver knows of them: number, group, cell and radius."""

    table: DataFrame
    about: list
    pivots: np.ndarray


def packed_blocks(points: DataFrame, n: int, more: str | None, block_rows: int) -> Blocks:
    """Blocks of at most about ``block_rows`` rows of one group and cell: (no, group_key, cell, ids, data, more, radius).

    A vector is shuffled once. ``data`` holds the vectors in single precision if they are exact in it, else in double.
    """
    pivots = pick_pivots(points, n, block_rows)

    @F.pandas_udf("int")
    def home(batch: pd.Series) -> pd.Series:
        return pd.Series(_gaps(_matrix(batch), pivots).argmin(axis=1).astype("int32"))

    placed = points.withColumn("cell", home("vector"))
    # One row per large group and pivot.
    first, cells = 0, []
    for r in placed.groupBy("group_key", "cell").agg(F.count("*").alias("n")).collect():
        pieces = -(-r["n"] // block_rows)
        cells.append((r["group_key"], r["cell"], first, pieces))
        first += pieces
    kinds = {c: points.schema[c].dataType.simpleString() for c in ("group_key", "id")}
    listed = points.sparkSession.createDataFrame(cells, f"group_key {kinds['group_key']}, cell int, first int, pieces int").coalesce(1)
    dealt = null_safe_join(placed, F.broadcast(listed), ["group_key", "cell"]).withColumn(
        "no", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("pieces"))).cast("int")).drop("first", "pieces")

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        x = _matrix(table.column("vector").to_pandas())
        cell = table.column("cell")[0].as_py()
        radius = float(_gaps(x, pivots[cell:cell + 1]).max())
        with np.errstate(over="ignore"):
            single = x.astype(np.float32)
        data = (single if (single == x).all() else x).tobytes()
        ends = pa.array([0, len(x)], pa.int32())
        numbers = table.column(more).chunk(0).cast(pa.int64()) if more else pa.array([], pa.int64())
        return pa.table([table.column("no").slice(0, 1), table.column("group_key").slice(0, 1), pa.array([cell], pa.int32()),
                         pa.ListArray.from_arrays(ends, table.column("id").chunk(0)), pa.array([data], pa.binary()),
                         pa.ListArray.from_arrays(ends if more else pa.array([0, 0], pa.int32()), numbers), pa.array([radius])],
                        names=["no", "group_key", "cell", "ids", "data", "more", "radius"])

    schema = f"no int, group_key {kinds['group_key']}, cell int, ids array<{kinds['id']}>, data binary, more array<long>, radius double"
    table = materialize(dealt.groupBy("no").applyInArrow(pack, schema), "blocks")
    # One row per block.
    return Blocks(table, table.select("no", "group_key", "cell", "radius").orderBy("no").collect(), pivots)


def _met(blocks: Blocks, eps: float, kernel: Callable, schema: str, reduced: Callable | None) -> DataFrame:
    table, about, pivots = blocks
    apart = _gaps(pivots, pivots)
    asks: dict[int, list[int]] = {r["no"]: [] for r in about}
    for k, a in enumerate(about):
        for b in about[k:]:
            reach = a["radius"] + b["radius"] + eps
            if a["group_key"] == b["group_key"] and (a["cell"] == b["cell"] or not apart[a["cell"], b["cell"]] > reach + 1e-6 * (1 + reach)):
                # Of two blocks now the one, now the other asks, so that the work spreads over both sides of the loop.
                one, other = (a, b) if (a["no"] + b["no"]) % 2 else (b, a)
                asks[one["no"]].append(other["no"])
    wanted = table.sparkSession.createDataFrame(list(asks.items()), "no int, asks array<int>").coalesce(1)
    columns = ["no", "cell", "ids", "data", "more", "radius"]
    left = table.join(F.broadcast(wanted), "no").select("group_key", "asks", *[F.col(c).alias(f"a_{c}") for c in columns])
    right = table.select(*[F.col(c).alias(f"b_{c}") for c in columns])
    met = left.join(right, F.array_contains("asks", F.col("b_no"))).drop("asks")

    def block(row, side: str) -> Tile:
        ids, data, numbers = row[f"{side}_ids"], row[f"{side}_data"], row[f"{side}_more"]
        kind = np.float32 if len(data) == 4 * len(ids) * pivots.shape[1] else np.float64
        x = np.frombuffer(data, kind).reshape(len(ids), -1).astype(float)
        return Tile(row["group_key"], np.asarray(ids), x, np.asarray(numbers) if len(numbers) else None)

    def reaching(rows: Tile, own: int, other: int, radius: float) -> Tile:
        """The rows that may be near a member of another cell."""
        gap = _gaps(rows.x, pivots[[own, other]])
        slack = 1e-6 * (1 + gap.max(initial=0.0))
        return rows.part(~((gap[:, 1] > radius + eps + slack) | (gap[:, 1] > gap[:, 0] + 2 * eps + slack)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                a, b, same = block(row, "a"), block(row, "b"), row["a_no"] == row["b_no"]
                if row["a_cell"] != row["b_cell"]:
                    a, b = (reaching(a, row["a_cell"], row["b_cell"], row["b_radius"]),
                            reaching(b, row["b_cell"], row["a_cell"], row["a_radius"]))
                lefts = a.tiles()
                yield from _reduced((kernel(p, q, same and i == j) for i, p in enumerate(lefts)
                                     for j, q in enumerate(lefts if same else b.tiles()) if not same or i <= j), reduced)

    return met.mapInPandas(run, schema)


def eps_join(points: DataFrame, eps: float, block_rows: int = BLOCK_ROWS, mode: str = "exact",
             recall: float = 0.95, seed: int = 42) -> DataFrame:
    """All pairs ``a < b`` of one group at distance ``<= eps``: (group_key, a, b, dist).

    ``points``: group_key, id, vector; rows without a vector have no pairs, a null ``group_key`` is a group. With
    ``mode="approximate"`` a pair is found with probability ``recall`` at least (higher, the closer it is), by
    random projections drawn from ``seed``; what is returned is measured exactly in both modes.
    """
    id_type = points.schema["id"].dataType.simpleString()
    key_type = points.schema["group_key"].dataType.simpleString()
    rows = points.where(F.col("vector").isNotNull()).select("group_key", "id", "vector")
    schema = f"group_key {key_type}, a {id_type}, b {id_type}, dist double"

    def found(key, a: np.ndarray, b: np.ndarray, same: bool, d: np.ndarray) -> pd.DataFrame:
        if same:
            once = a < b
            a, b, d = a[once], b[once], d[once]
        low, high = np.where(a < b, a, b), np.where(a < b, b, a)
        return _frame(group_key=[key] * len(a), a=low, b=high, dist=d)

    def pairs(left: Tile, right: Tile, same: bool) -> pd.DataFrame:
        i, j, d = within(left.x, right.x, eps)
        return found(left.key, left.ids[i], right.ids[j], same, d)

    def pairs_of_table(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        i, j, d = within(_matrix(left["vector"]), _matrix(right["vector"]), eps)
        if len(i):
            # A pair belongs to the first table in which its buckets agree.
            table = int(left["table"].iloc[0])
            earlier = np.stack(left["buckets"].to_numpy())[i, :table] == np.stack(right["buckets"].to_numpy())[j, :table]
            own = ~earlier.any(axis=1)
            i, j, d = i[own], j[own], d[own]
        return found(left["group_key"].iloc[0], left["id"].to_numpy()[i], right["id"].to_numpy()[j], same, d)

    if mode == "exact":
        return near_map(rows, eps, pairs, schema, block_rows=block_rows)
    if mode != "approximate":
        raise ValueError(f"unknown mode {mode}")
    rows = materialize(rows, "lsh-points")
    tables = plan_tables(rows, eps, recall, seed)
    return block_map(bucketed(rows, tables, block_rows), pairs_of_table, schema)


class Tables(NamedTuple):
    """Random projections: ``directions`` (tables, projections, dimensions), ``offsets``, and the width of a bucket."""

    directions: np.ndarray
    offsets: np.ndarray
    width: float


def same_bucket(distance: np.ndarray, width: float) -> np.ndarray:
    """Probability that two points at ``distance`` fall into one bucket of one Gaussian projection."""
    ratio = width / np.maximum(np.asarray(distance, dtype=float), 1e-12)
    tail = np.array([math.erfc(r / math.sqrt(2)) for r in ratio.ravel()]).reshape(ratio.shape)
    return np.clip(1 - tail - math.sqrt(2 / math.pi) / ratio * -np.expm1(-ratio ** 2 / 2), 0, 1)


def plan_tables(points: DataFrame, eps: float, recall: float = 0.95, seed: int = 42, sample_rows: int = 512) -> Tables:
    """The cheapest tables that find a pair at distance ``eps`` with probability ``recall``.

    The distances among ``sample_rows`` points (the lowest by hash of their id) say how often points that are not close share a
    bucket; for every width and number of projections that follows the number of tables, and with it the rows copied and the pairs
    compared.
    """
    if not 0 < recall < 1:
        raise ValueError("recall lies between 0 and 1")
    n = points.count()
    some = points.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("vector").collect()
    x = np.array([r["vector"] for r in some], dtype=float) if some else np.zeros((1, 1))
    square = (x ** 2).sum(axis=1)
    gaps = np.sqrt(np.maximum(square[:, None] + square - 2 * x @ x.T, 0))[np.triu_indices(len(x), 1)]
    best = None
    for width in (eps, 2 * eps, 4 * eps, 8 * eps, 16 * eps):
        near = float(same_bucket(np.array([eps]), width)[0])
        far = same_bucket(gaps, width)
        for count in range(1, 25):
            tables = max(1, math.ceil(math.log(1 - recall) / math.log1p(-min(near ** count, 1 - 1e-12))))
            if tables > MAX_TABLES:
                break
            cost = tables * (64 + n * (float((far ** count).mean()) if len(far) else 0.0))
            if best is None or cost < best[0]:
                best = cost, width, count, tables
    _, width, count, tables = best or (0, 16 * eps, 1, MAX_TABLES)
    rng = np.random.default_rng(seed)
    return Tables(rng.standard_normal((tables, count, x.shape[1])), rng.uniform(0, width, (tables, count)), width)


def bucketed(points: DataFrame, tables: Tables, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows copied to the block pairs of their buckets, as :func:`blocked` does for cells; adds ``table`` and ``buckets``."""
    directions, offsets, width = tables
    mixers = np.random.default_rng(7).integers(1, 1 << 62, (directions.shape[1],), dtype=np.int64) | 1

    @F.pandas_udf("array<long>")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = _matrix(batch)
            out = np.zeros((len(x), len(directions)), np.int64)
            with np.errstate(over="ignore"):
                for t in range(len(directions)):
                    cells = np.floor((x @ directions[t].T + offsets[t]) / width).astype(np.int64)
                    out[:, t] = ((cells + 1) * mixers).sum(axis=1)
            yield pd.Series(list(out))

    cells = points.withColumn("buckets", hashed("vector")).select("*", F.posexplode("buckets").alias("table", "cell"))
    # Tables are apart: the cell of a block pair names its table too.
    return triangles(cells.withColumn("cell", F.struct("table", "cell")), block_rows)


def triangles(cells: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows (group_key, id, cell, ...) copied to the block pairs ``bi <= bj`` of their own cell; lone rows have none.

    A cell has at most ``MAX_BLOCKS`` blocks, and so a row that many copies, until a block would be above ``LARGEST_BLOCK`` rows.
    """
    sizes = cells.groupBy("group_key", "cell").agg(F.count("*").alias("_rows")).where("_rows > 1").select(
        "group_key", "cell", F.greatest(F.least(F.ceil(F.col("_rows") / block_rows), F.lit(MAX_BLOCKS)),
                                        F.ceil(F.col("_rows") / LARGEST_BLOCK)).cast("int").alias("_n"))
    own = null_safe_join(cells, sizes, ["group_key", "cell"]).withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda j: F.struct(
        F.least(F.col("_b"), j).alias("bi"), F.greatest(F.col("_b"), j).alias("bj"), F.when(j < F.col("_b"), 1).otherwise(0).alias("role")))
    return own.select(*cells.columns, F.inline(pairs))


def _best(k: int):
    """The ``k`` most similar of ``others`` per row, by similarity to nine digits, then by smaller id."""
    def best(sims: np.ndarray, ids: np.ndarray, others: np.ndarray, key, floor: np.ndarray | None = None) -> pd.DataFrame:
        if not sims.size:
            return _frame(group_key=[], src=[], dst=[], sim=[])
        codes = np.unique(np.concatenate([ids, others]), return_inverse=True)[1]
        mine, theirs = codes[:len(ids)], codes[len(ids):]
        if np.isin(mine, theirs).any():
            sims = np.where(mine[:, None] == theirs, -np.inf, sims)
        if floor is None:
            # What is below the k-th best of its row by more than the rounding is not needed.
            at = max(sims.shape[1] - k, 0)
            floor = np.partition(sims, at, axis=1)[:, at] - 2e-9
        else:
            floor = floor - 2e-9
        i, j = np.nonzero((sims >= floor[:, None]) & (sims > -np.inf))
        order = np.lexsort((theirs[j], -np.round(sims[i, j], 9), i))
        i, j = i[order], j[order]
        first = np.searchsorted(i, np.arange(len(ids)))
        keep = np.arange(len(i)) - first[i] < k
        i, j = i[keep], j[keep]
        return _frame(group_key=[key] * len(i), src=ids[i], dst=others[j], sim=sims[i, j])

    return best


def _best_of(k: int):
    """The ``k`` most similar of each row among what several tiles gave."""
    def reduced(found: pd.DataFrame) -> pd.DataFrame:
        order = found.assign(_s=-np.round(found["sim"].to_numpy(dtype=float), 9)).sort_values(["src", "_s", "dst"])
        return order[order.groupby("src", sort=False).cumcount() < k].drop(columns="_s")

    return reduced


def _nearest(found: DataFrame, k: int) -> DataFrame:
    # At most k rows of each block pair that a point takes part in.
    order = W.partitionBy("group_key", "src").orderBy(F.desc(F.round("sim", 9)), "dst")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _lifted_gaps(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of unit vectors to unit pivots, ``sqrt(2 - 2 cosine)``.

    An all-zero row has no direction: it gets an axis of its own, at the distance of similarity 0 to all others.
    """
    axis, lift = np.maximum(1 - (x ** 2).sum(axis=1), 0), np.maximum(1 - (pivots ** 2).sum(axis=1), 0)
    both = x @ pivots.T + np.sqrt(axis)[:, None] * np.sqrt(lift)
    return np.sqrt(np.maximum(2 - 2 * both, 0))


def knn_placed(unit: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``unit`` with the cell of the nearest pivot and the distance to it (``cell``, ``reach``), written once."""
    @F.pandas_udf("struct<cell:int,reach:double>")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            gap = _lifted_gaps(_matrix(batch), pivots)
            yield pd.DataFrame({"cell": gap.argmin(axis=1).astype("int32"), "reach": gap.min(axis=1)})

    return materialize(unit.withColumn("_p", place("vector")).select("*", "_p.cell", "_p.reach").drop("_p"), "knn-placed")


def knn_visits(placed: DataFrame, own: DataFrame, pivots: np.ndarray, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Block pairs of points that may have one of their ``k`` nearest in another cell.

    ``own``: the nearest found inside a point's cell (group_key, src, sim, rank). The ``k``-th of them bounds what can still be
    nearer: a cell is visited only if neither the plane between its pivot and the point's own, nor the range of its members'
    distances to its pivot, rules it out. A point with fewer than ``k`` so far visits every cell. Role 0 rows ask, with
    ``floor`` as the least similarity of use; role 1 rows are the members of the cell.
    """
    # One row per pivot.
    ring = {r["cell"]: (r["low"], r["high"]) for r in placed.groupBy("cell").agg(
        F.min("reach").alias("low"), F.max("reach").alias("high")).collect()}
    low = np.array([ring.get(c, (np.inf, -np.inf))[0] for c in range(len(pivots))])
    high = np.array([ring.get(c, (np.inf, -np.inf))[1] for c in range(len(pivots))])

    @F.pandas_udf("array<int>")
    def visits(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for vector, cell, floor in batches:
            gap = _lifted_gaps(_matrix(vector), pivots)
            row, home = np.arange(len(gap)), cell.to_numpy()
            # Similarities are compared to nine digits; distances follow with slack.
            reach = np.sqrt(np.maximum(2 - 2 * floor.to_numpy(dtype=float), 0) + 4e-9) + 1e-6
            apart = np.maximum((gap - gap[row, home][:, None]) / 2, np.maximum(gap - high, low - gap))
            near = (apart <= reach[:, None]) & np.isfinite(low)
            near[row, home] = False
            yield pd.Series([np.flatnonzero(r).astype("int32") for r in near])

    kth = own.where(F.col("rank") == k).select("group_key", F.col("src").alias("id"), F.round("sim", 9).alias("floor"))
    asking = null_safe_join(placed, kth, ["group_key", "id"], "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
    # Written with the list of cells, not a copy for each.
    asking = materialize(asking.select("group_key", "id", "vector", "floor", visits("vector", "cell", "floor").alias("cells")), "knn-visits")
    asking = asking.select("group_key", "id", "vector", "floor", F.explode("cells").alias("cell"))
    members = placed.select("group_key", "id", "vector", F.lit(0.0).alias("floor"), "cell")
    sizes = null_safe_join(
        members.groupBy("group_key", "cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("n_home")),
        asking.groupBy("group_key", "cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("n_guest")), ["group_key", "cell"])

    def dealt(rows: DataFrame, role: int) -> DataFrame:
        mine, others = ("n_home", "n_guest") if role else ("n_guest", "n_home")
        block = F.pmod(F.xxhash64("id"), F.col(mine)).cast("int")
        every = null_safe_join(rows, sizes, ["group_key", "cell"]).select(
            "group_key", "id", "vector", "floor", "cell", block.alias("_mine"), F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias("_other"))
        # Blocks that ask and blocks of members are numbered apart: no block meets itself.
        return every.select("group_key", "id", "vector", "floor", "cell", F.col("_other" if role else "_mine").alias("bi"),
                            (-1 - F.col("_mine" if role else "_other")).alias("bj"), F.lit(role).alias("role"))

    return dealt(asking, 0).unionByName(dealt(members, 1))


def knn_join(points: DataFrame, k: int = 8, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` cosine-nearest other points of every point: (group_key, src, dst, sim, rank). Exact.

    Ties go to the smaller id; rows without a vector take no part, a null ``group_key`` is a group. First every point
    finds its nearest inside its own cell, then it visits the cells that their similarity does not rule out. Each block
    pair contributes at most ``k`` rows per point.
    """
    from reviewloom.functions import vectors as V

    id_type = points.schema["id"].dataType.simpleString()
    key_type = points.schema["group_key"].dataType.simpleString()
    schema = f"group_key {key_type}, src {id_type}, dst {id_type}, sim double"
    best = _best(k)

    def inside(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        sims = _matrix(left["vector"]) @ _matrix(right["vector"]).T if len(right) else np.zeros((len(left), 0))
        a, b = left["id"].to_numpy(), right["id"].to_numpy()
        key = left["group_key"].iloc[0] if len(left) else None
        one = best(sims, a, b, key)
        return one if same else pd.concat([one, best(sims.T, b, a, key)])

    def across(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        return best(_matrix(left["vector"]) @ _matrix(right["vector"]).T, left["id"].to_numpy(), right["id"].to_numpy(),
                    left["group_key"].iloc[0], left["floor"].to_numpy())

    unit = materialize(points.where(F.col("vector").isNotNull()).select(
        "group_key", "id", V.l2_normalize(F.col("vector")).alias("vector")), "knn-unit")
    n = unit.count()
    block_rows = grown(n, block_rows)
    if n < FEW_BLOCKS * block_rows:
        # Too few blocks for a cell to be worth leaving out.
        return _nearest(block_map(triangles(unit.withColumn("cell", F.lit(0)), block_rows), inside, schema, _best_of(k)), k)
    pivots = pick_pivots(unit, n, block_rows)
    placed = knn_placed(unit, pivots)
    found = materialize(_nearest(block_map(triangles(placed, block_rows), inside, schema, _best_of(k)), k), "knn-inside")
    far = block_map(knn_visits(placed, found, pivots, k, block_rows), across, schema, _best_of(k))
    return _nearest(found.drop("rank").unionByName(far), k)


def symmetric_edges(knn: DataFrame) -> DataFrame:
    """Undirected edges ``src < dst`` of a nearest-neighbour table, each once."""
    return knn.select(
        "group_key", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "sim",
    ).groupBy("group_key", "src", "dst").agg(F.max("sim").alias("sim"))


