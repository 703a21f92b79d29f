"""Operator 3: embedding near-duplicates by an inverted multi-index.

Unit vectors are halved; each half has a codebook of its own (k-means on a bounded sample), and the
product of both codebooks is a grid of cells. Grids come by vector length and by level, with 2 ** level
codes a half; a label takes the level that leaves about ``per_cell`` of its own vectors a cell, so small
labels share coarse grids and the largest label gets a fine one. Codes are bounded by a quarter of the
sample only (``fit_sample``); past that cells grow. Every distinct vector is posted in its home cell and
visits further cells by multi-sequence traversal, in order of the distance to the borders it would
have to cross, until the target recall: the border distance is calibrated on pairs made at exactly
the threshold from the sample. A pair is met if either vector visits the other's home; it is then
verified by cosine in double precision and counted once.

Exact copies are one class, so copies are never paired. A cell with many classes is cut into blocks
of ``block`` posted vectors and its visitors pass by every block, so no task holds a whole hot cell.
A task returns counts and a spanning forest of the links it met, not the pairs.

Defined results: vectors that are null, zero or hold null or non-finite components, and rows with a
null label or vec_id, link with nothing and are their own component; vectors of different length
never link; repeated rows are vectors of their own; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components
from .vectors import matrix, sample, unit, usable


@dataclass
class Grid:
    """Codebooks of both halves and the border distance up to which cells are visited."""

    books: tuple
    reach: float
    width: int

    def __post_init__(self):
        import numpy as np

        squares = [(book * book).sum(1) for book in self.books]
        self.apart = [np.sqrt(np.maximum(s[:, None] + s[None] - 2 * book @ book.T, 0)) for s, book in zip(squares, self.books, strict=True)]

    def borders(self, x):
        """For each half: [rows, codes] distances to the bisector between the nearest code and each code."""
        import numpy as np

        out = []
        for half, book, apart in zip((x[:, : self.width // 2], x[:, self.width // 2 :]), self.books, self.apart, strict=True):
            d = (half * half).sum(1)[:, None] - 2 * half @ book.T + (book * book).sum(1)
            home = d.argmin(axis=1)
            row = np.arange(len(d))
            d = (d - d[row, home][:, None]) / np.maximum(2 * apart[home], 1e-12)
            d[row, home] = 0
            out.append((home, d))
        return out

    def homes(self, x):
        (a, _), (b, _) = self.borders(x)
        return a * len(self.books[1]) + b

    def cost(self, x, cells):
        """Border distance from each row to the cell named for it."""
        import numpy as np

        (_, a), (_, b) = self.borders(x)
        n, row = len(self.books[1]), np.arange(len(x))
        return np.sqrt(a[row, cells // n] ** 2 + b[row, cells % n] ** 2)

    def traverse(self, x):
        """Multi-sequence traversal: (row, cell) of all cells within ``reach``, both sequences taken in
        ascending order and the second cut off by what the first has used."""
        import numpy as np

        (_, a), (_, b) = self.borders(x)
        order_a, order_b = a.argsort(axis=1), b.argsort(axis=1)
        a, b = np.take_along_axis(a, order_a, 1) ** 2, np.take_along_axis(b, order_b, 1) ** 2
        rows, cells = [], []
        for i in range(a.shape[1]):
            left = self.reach**2 - a[:, i]
            live = np.flatnonzero(left >= 0)
            if not len(live):
                break
            r, j = np.nonzero(b[live] <= left[live][:, None])
            rows.append(live[r])
            cells.append(order_a[live[r], i] * len(self.books[1]) + order_b[live[r], j])
        return np.concatenate(rows) if rows else np.zeros(0, int), np.concatenate(cells) if cells else np.zeros(0, int)


def _kmeans(x, k: int, rng, rounds: int = 8):
    import numpy as np

    book = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = ((book * book).sum(1) - 2 * x @ book.T).argmin(axis=1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(book)
        np.add.at(total, near, x)
        book = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], book)
    return book


def fit_grid(x, codes: int, threshold: float, recall: float, seed: int = 3) -> Grid:
    """Codebooks and reach from sample rows ``x`` (unit vectors)."""
    import numpy as np

    rng = np.random.default_rng(seed)
    width = x.shape[1]
    k = max(1, min(codes, len(x) // 4))
    grid = Grid((_kmeans(x[:, : width // 2], k, rng), _kmeans(x[:, width // 2 :], k, rng)), np.inf, width)
    u = x[rng.integers(0, len(x), 20_000)]
    noise = rng.normal(size=u.shape)
    noise = unit(noise - (noise * u).sum(1, keepdims=True) * u)
    v = threshold * u + np.sqrt(1 - threshold**2) * noise
    need = np.minimum(grid.cost(u, grid.homes(v)), grid.cost(v, grid.homes(u)))
    grid.reach = float(np.quantile(need, recall)) + 1e-9
    return grid


def _post(classes: DataFrame, grids: dict[tuple[int, int], Grid], visit: bool) -> DataFrame:
    """Classes in their home cell, or in all cells they visit. Level 0 has one cell, and nothing to visit from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            dim, level = (batch.column(i).to_numpy() for i in (3, 4))
            for d, v in {(int(d), int(v)) for d, v in zip(dim, level, strict=True)}:
                grid = grids.get((d, v))
                at = np.flatnonzero((dim == d) & (level == v))
                step = 2000 if grid is None else max(50, 1_000_000 // len(grid.books[0]))
                for s in range(0, len(at), step):
                    part = batch.take(pa.array(at[s : s + step]))
                    if grid is None:
                        rows, home = np.arange(part.num_rows), np.zeros(part.num_rows, np.int64)
                        cells = home
                    else:
                        x = unit(matrix(part.column(5), d))
                        home = grid.homes(x)
                        rows, cells = grid.traverse(x) if visit else (np.arange(len(x)), home)
                    out = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(home[rows], pa.int64()), pa.array(cells, pa.int64())], [*batch.schema.names, "home", "cell"])

    names = ["cid", "n", "label", "dim", "level", "vec"]
    return classes.select(*names).mapInArrow(run, "cid long, n long, label string, dim int, level int, vec array<double>, home long, cell long")


def _meet(grids: dict[tuple[int, int], Grid], threshold: float):
    """mapInArrow function over rows sorted by (label, dim, level, cell, part, kind): posted rows (kind 0) of a
    block first, then those that pass by. Gives edges (a, b, null) and counts (a, null, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        key, held = None, []
        ids = mass = rows = counts = comp = None
        out_a: list = []
        out_b: list = []
        out_n: list = []

        def settle() -> None:
            nonlocal ids, mass, rows, counts, comp
            if ids is None:
                ids, mass, rows = (np.concatenate([h[i] for h in held]) for i in range(3))
                counts, comp = np.zeros(len(ids), np.int64), np.arange(len(ids))

        def leave() -> None:
            if ids is not None and counts.any():
                at = np.flatnonzero(counts)
                out_a.extend(ids[at].tolist())
                out_b.extend([None] * len(at))
                out_n.extend(counts[at].tolist())

        def pass_by(grid: Grid | None, cell: int, cid, n, home, x) -> None:
            for at in range(0, len(cid), 1024):
                s = slice(at, at + 1024)
                a, b = np.nonzero(x[s] @ rows.T >= threshold)
                a += at
                keep = cid[a] != ids[b]
                a, b = a[keep], b[keep]
                if not len(a):
                    continue
                guest = home[a] != cell
                if guest.any():  # met again at the guest's home if the posted vector goes there: count it in the smaller cell
                    g = np.flatnonzero(guest)
                    twice = grid.cost(rows[b[g]], home[a[g]]) <= grid.reach
                    drop = g[twice & (home[a[g]] < cell)]
                    ok = np.ones(len(a), bool)
                    ok[drop] = False
                    a, b, guest = a[ok], b[ok], guest[ok]
                    np.add.at(counts, b[guest], n[a[guest]])
                movers, first, number = np.unique(a, return_index=True, return_counts=True)
                out_a.extend(cid[movers].tolist())
                out_b.extend([None] * len(movers))
                out_n.extend(np.add.reduceat(mass[b], first).tolist() if len(first) else [])
                for mover, f, k in zip(movers, first, number, strict=True):
                    linked = b[f : f + k]
                    trees = np.unique(comp[linked])
                    for t in trees:
                        out_a.append(int(cid[mover]))
                        out_b.append(int(ids[linked[comp[linked] == t][0]]))
                        out_n.append(None)
                    if len(trees) > 1:
                        comp[np.isin(comp, trees)] = trees[0]

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            kind, cid, n, home = (batch.column(i).to_numpy() for i in (5, 6, 7, 9))
            keys = list(zip(*columns, strict=True))
            change = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1] or kind[i] != kind[i - 1]]
            for s, e in zip(change, [*change[1:], len(keys)], strict=True):
                if keys[s] != key:
                    leave()
                    key, held, ids = keys[s], [], None
                x = unit(matrix(batch.column(8).slice(s, e - s), key[1]))
                if kind[s] == 0:
                    held.append((cid[s:e], n[s:e], x))
                elif held:
                    settle()
                    pass_by(grids.get(key[1:3]), key[3], cid[s:e], n[s:e], home[s:e], x)
            if len(out_a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (out_a, out_b, out_n)], ["a", "b", "n"])
                out_a, out_b, out_n = [], [], []
        leave()
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (out_a, out_b, out_n)], ["a", "b", "n"])

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.98, recall: float = 0.9995, fit_sample: int = 20_000, per_cell: int = 48, block: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept; one row per input row."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.withColumn("ok", usable(F.col("vec")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    classes = rows.where("ok").groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("cid"), "least", "n", "label", F.size("vec").alias("dim"), "vec"), "vec-classes")
    top = max(0, (fit_sample // 4).bit_length() - 1)
    level = F.greatest(F.lit(0), F.least(F.lit(top), F.ceil(F.log2(F.col("held") / per_cell) / 2).cast("int")))
    levels = classes.groupBy("label", "dim").agg(F.count("*").alias("held")).select("label", "dim", level.alias("level"))
    known = levels.where("level > 0").select("dim", "level").distinct().collect()
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).where(F.col("dim").isin(sorted({r["dim"] for r in known}))).collect()} if known else {}
    grids = {}
    for dim, n in sorted(sizes.items()):
        x = sample(classes.where(F.col("dim") == dim), "vec", n, fit_sample, 3)
        grids |= {(dim, r["level"]): fit_grid(x, 1 << r["level"], threshold, recall) for r in known if r["dim"] == dim}
    leveled = classes.join(levels, ["label", "dim"])
    place = ["label", "dim", "level", "cell"]
    posted = cut(_post(leveled, grids, False).drop("home"), "vec-posted")
    parts = posted.groupBy(*place).agg(F.count("*").alias("held"), F.ceil(F.count("*") / F.lit(block)).cast("int").alias("parts"))
    home = posted.join(parts, place).where("held > 1 or level > 0").select(*place, F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("kind"), "cid", "n", "vec", F.col("cell").alias("home"))
    guests = _post(leveled, grids, True).join(parts, place).where((F.col("home") != F.col("cell")) | (F.col("held") > 1))
    guests = guests.select(*place, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), "cid", "n", "vec", "home")
    where = [*place, "part"]
    met = home.unionByName(guests).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *where).sortWithinPartitions(*where, "kind")
    met = cut(met.select(*where, "kind", "cid", "n", "vec", "home").mapInArrow(_meet(grids, threshold), "a long, b long, n long"), "vec-met")
    counts = met.where("n is not null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("links"))
    roots = components(met.where("n is null").select("a", "b")).select(F.col("id").alias("cid"), F.col("component").alias("root"))
    classes = classes.join(counts, "cid", "left").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = classes.groupBy("root").agg(F.min("least").alias("component"))
    named = classes.join(least, "root").select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("links"), "component")
    good = rows.where("ok").join(named, ["label", "vec"]).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    rest = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
