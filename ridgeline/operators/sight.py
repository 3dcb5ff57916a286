"""Exposure to sources in plain sight: every candidate against every source of its region.

A line of sight is blocked by any of its samples. Candidates are dealt out in shares of small cells; a share meets a square of
terrain and the slabs of sources in one group, where stretches of its lines that pass above the ground are dropped, first long ones, then
short ones, and only what is left is sampled. No line becomes a row: a group gives back, for a candidate and a slab, the
sources that the square hides as bits of words, and words of all squares are joined by `bit_or`. What moves is the terrain once
for each share, packed, and a bit for each line.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import physics as P
from ridgeline.operators.profiles import tiles, unpacked
from ridgeline.operators.scan import with_altitude
from ridgeline.sources.fixtures import Grid
from ridgeline.sources.tables import stage

#: Sources of a pack (about), of a slab (at most), of a word; packs that a group meets.
PACK, SLAB, WORD, BUNDLE = 960, 1024, 64, 8
#: Shares of the candidates (at least), and lines of a share with a bundle (about, at most).
SHARES, SHARE_LINES = 96, 1 << 29
#: Pixels along a cell of candidates, a packed tile and a square (at most).
CELL, TILE, SQUARE = 32, 256, 4096
#: Pixels along the blocks whose ground is held as a plane and the height above it.
BLOCKS = (512, 128, 32, 8)
#: Samples at either end that are looked at first: most hidden lines are hidden there.
ENDS = 4
#: Lines that are judged at once.
LINES = 1 << 13
#: Tasks that the groups are dealt out over.
TASKS = 256
WORDS = [f"w{i}" for i in range(SLAB // WORD)]
HIDDEN = pa.schema([("region", pa.string()), *[(n, pa.int32()) for n in ("share", "pack", "part")], ("cand_id", pa.int64()), ("r", pa.int32()), ("c", pa.int32()), *[(w, pa.int64()) for w in WORDS]])
SEEN = pa.schema([("region", pa.string()), ("cand_id", pa.int64()), ("x", pa.float64())])


def planes(z: np.ndarray, r0: int, c0: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each block the slopes of a plane by row and column, and what no pixel of the block or half a block around it
    lies above: pixel (r, c) is at most top + by_r * r + by_c * c, also where r and c are up to a pixel more."""
    half, (rows, cols) = block // 2, z.shape
    nr, nc = -(-rows // block), -(-cols // block)
    wide = np.full(((2 * nr + 2) * half, (2 * nc + 2) * half), -np.inf)
    wide[half : half + rows, half : half + cols] = np.where(np.isnan(z), -np.inf, z)
    parts = wide.reshape(2 * nr + 2, half, 2 * nc + 2, half).swapaxes(1, 2)
    r = (r0 - half + np.arange(len(wide), dtype=float)).reshape(-1, 1, half, 1)
    c = (c0 - half + np.arange(wide.shape[1], dtype=float)).reshape(1, -1, 1, half)
    known = parts > -np.inf
    n, height = known.sum(axis=(2, 3)), np.where(known, parts, 0.0).sum(axis=(2, 3))
    places = (known.sum(axis=3) * r[:, :, :, 0]).sum(axis=2), (known.sum(axis=2) * c[:, :, 0, :]).sum(axis=2)

    def slope(place: np.ndarray, axis: int) -> np.ndarray:
        """From the means of the near and the far half along the axis."""
        def halves(x):
            x = np.moveaxis(x, axis, 0)
            x = sum(x[:, k : k + x.shape[1] - 2 : 2] for k in range(4))
            x = x[:-1] + x[1:]
            return x[:-2:2], x[2::2]

        with np.errstate(divide="ignore", invalid="ignore"):
            (n0, n1), (z0, z1), (p0, p1) = halves(n), halves(height), halves(place)
            return np.moveaxis(np.nan_to_num((z1 / n1 - z0 / n0) / (p1 / n1 - p0 / n0), nan=0.0, posinf=0.0, neginf=0.0), 0, axis)

    by_r, by_c = slope(places[0], 0), slope(places[1], 1)
    top = np.full((nr, nc), -np.inf)
    for i in range(4):
        for j in range(4):
            sub = parts[i : i + 2 * nr - 1 : 2, j : j + 2 * nc - 1 : 2]
            above = sub - by_r[:, :, None, None] * r[i : i + 2 * nr - 1 : 2] - by_c[:, :, None, None] * c[:, j : j + 2 * nc - 1 : 2]
            top = np.maximum(top, above.max(axis=(2, 3)))
    return by_r, by_c, top + np.maximum(-by_r, 0) + np.maximum(-by_c, 0)


class Ground:
    """A square of terrain whose first pixel is (r0, c0), with the planes of its blocks."""

    def __init__(self, z: np.ndarray, r0: int, c0: int, grid: Grid, step: float) -> None:
        self.z, self.r0, self.c0, (self.rows, self.cols), self.levels = z, r0, c0, z.shape, []
        for block in BLOCKS:
            n = int((block - 2) * min(grid.cell_y, grid.cell_x) / step)  # n samples lie at most (n + 1) / n steps apart: within half a block of their middle
            if n > 1:
                self.levels.append((n, block, *planes(z, r0, c0, block)))

    def over(self, at: np.ndarray, by: np.ndarray, first: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The shares of each line from `at` to `at + by` that lie in the square's rows (or columns); none: from > to."""
        with np.errstate(divide="ignore", invalid="ignore"):
            x, y = (first - at) / by, (first + size - at) / by
        still, inside = by == 0, (at >= first) & (at < first + size)
        return np.where(still, np.where(inside, 0.0, 2.0), np.minimum(x, y)), np.where(still, np.where(inside, 1.0, -2.0), np.maximum(x, y))

    def holds(self, r: np.ndarray, c: np.ndarray) -> bool:
        return r.min() >= self.r0 and r.max() < self.r0 + self.rows and c.min() >= self.c0 and c.max() < self.c0 + self.cols

    def beside(self, r: np.ndarray, c: np.ndarray, zr: np.ndarray, zc: np.ndarray) -> bool:
        """Whether no line from one list to the other comes near."""
        return (max(r.max(), zr.max()) < self.r0 - 1 or min(r.min(), zr.min()) > self.r0 + self.rows
                or max(c.max(), zc.max()) < self.c0 - 1 or min(c.min(), zc.min()) > self.c0 + self.cols)


def hidden(ground: Ground, r: np.ndarray, c: np.ndarray, z0: np.ndarray, zr: np.ndarray, zc: np.ndarray, zs: np.ndarray, grid: Grid, step: float, radius: float) -> np.ndarray:
    """(candidates, sources): whether the square blocks the line between them."""
    shape = (len(r), len(zr))
    blocked = np.zeros(shape[0] * shape[1], dtype=bool)
    if ground.beside(r, c, zr, zc):
        return blocked.reshape(shape)
    whole = ground.holds(r, c) and ground.holds(zr, zc)
    r, c, z0, zr, zc, zs = (np.broadcast_to(x, shape).ravel() for x in (r[:, None], c[:, None], z0[:, None], zr[None, :], zc[None, :], zs[None, :]))
    by_r, by_c, by_z = zr - r, zc - c, zs - z0
    dy, dx = by_r * grid.cell_y, by_c * grid.cell_x
    dist = np.sqrt(dy * dy + dx * dx)
    steps = np.floor(dist / step)
    if whole:
        k0, k1 = np.ones_like(steps), steps - 1
        line = np.flatnonzero((dist >= 1) & (k0 <= k1))
    else:
        rows, cols = ground.over(r, by_r, ground.r0, ground.rows), ground.over(c, by_c, ground.c0, ground.cols)
        low, high = np.maximum(np.maximum(rows[0], cols[0]), 0.0), np.minimum(np.minimum(rows[1], cols[1]), 1.0)
        k0 = np.maximum(np.floor(np.clip(low, 0, 2) * steps) - 1, 1)
        k1 = np.minimum(np.ceil(np.clip(high, -1, 1) * steps) + 1, steps - 1)
        line = np.flatnonzero((dist >= 1) & (low <= high + 1e-9) & (k0 <= k1))
    k0, k1 = k0[line], k1[line]
    flat = ground.z.ravel()

    def over_line(line: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Whether the ground under sample k lies above the line."""
        f = k / steps[line]
        tr, tc = (r[line] + by_r[line] * f).astype(np.intp) - ground.r0, (c[line] + by_c[line] * f).astype(np.intp) - ground.c0
        if not whole:
            on = (tr >= 0) & (tr < ground.rows) & (tc >= 0) & (tc < ground.cols)
            tr, tc = np.where(on, tr, 0), np.where(on, tc, 0)
        d = dist[line] * f
        over = flat[tr * ground.cols + tc] - d * d / (2 * radius) > z0[line] + by_z[line] * f
        return over if whole else over & on

    for m in range(1, ENDS + 1):
        for near in (True, False):
            k = np.full(len(line), float(m)) if near else steps[line] - m
            some = np.flatnonzero((k0 <= k) & (k <= k1))
            hit = some[over_line(line[some], k[some])]
            if len(hit):
                blocked[line[hit]] = True
                live = ~blocked[line]
                line, k0, k1 = line[live], k0[live], k1[live]
    k0, k1 = np.maximum(k0, ENDS + 1), np.minimum(k1, steps[line] - ENDS - 1)
    some = k0 <= k1
    line, k0, k1 = line[some], k0[some], k1[some]
    with np.errstate(divide="ignore"):
        share, drop = 1 / steps, dist * dist / (2 * radius)
    for n, block, slope_r, slope_c, top in ground.levels:
        count = ((k1 - k0) / n).astype(np.intp) + 1
        ends = np.cumsum(count)
        line, k1 = np.repeat(line, count), np.repeat(k1, count)
        k0 = np.repeat(k0 - n * (ends - count), count) + n * np.arange(len(line), dtype=float)
        k1 = np.minimum(k0 + (n - 1), k1)
        x, y, dr, dc, each = r[line], c[line], by_r[line], by_c[line], share[line]
        f0, f1 = k0 * each, k1 * each
        middle = (f0 + f1) * 0.5
        i, j = ((x + dr * middle - ground.r0) * (1 / block)).astype(np.intp), ((y + dc * middle - ground.c0) * (1 / block)).astype(np.intp)
        if not whole:
            i, j = np.clip(i, 0, top.shape[0] - 1), np.clip(j, 0, top.shape[1] - 1)
        at = i * top.shape[1] + j
        gr, gc = slope_r.ravel()[at], slope_c.ravel()[at]
        start, more = z0[line] - gr * x - gc * y - top.ravel()[at], by_z[line] - gr * dr - gc * dc
        some = np.flatnonzero(start + np.minimum(more * f0, more * f1) + drop[line] * f0 * f0 < 1e-6)
        line, k0, k1 = line[some], k0[some], k1[some]
    for m in range(int((k1 - k0).max(initial=-1)) + 1):
        live = (k0 + m <= k1) & ~blocked[line]
        line, k0, k1 = line[live], k0[live], k1[live]
        blocked[line[over_line(line, k0 + m)]] = True
    return blocked.reshape(shape)


def words(blocked: np.ndarray) -> np.ndarray:
    """(candidates, words): a bit for each source, the first in the lowest."""
    wide = np.zeros((len(blocked), -(-blocked.shape[1] // WORD) * WORD), dtype=bool)
    wide[:, : blocked.shape[1]] = blocked
    return np.packbits(wide, axis=1, bitorder="little").view("<i8")


def pack_tiles(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Heights of a tile as bytes, the first of all pixels, then the second, and so on, compressed."""
    for b in batches:
        z = [zlib.compress(unpacked(at.values.to_numpy(), pixels.values.to_numpy(), size).view(np.uint8).reshape(-1, 8).T.tobytes(), 1) for at, pixels in zip(b["at"], b["pixels"], strict=True)]
        yield pa.record_batch([b["region"], b["tr"], b["tc"], pa.array(z, pa.binary())], ["region", "tr", "tc", "z"])


def square(land: pa.Table, r0: int, c0: int, shape: tuple[int, int], size: int) -> np.ndarray:
    """The heights of the square whose first pixel is (r0, c0), NaN for unknown."""
    z = np.full(shape, np.nan)
    for tr, tc, packed in zip(land["tr"], land["tc"], land["z"], strict=True):
        if packed.is_valid:
            a, b = tr.as_py() * size - r0, tc.as_py() * size - c0
            tile = np.frombuffer(zlib.decompress(packed.as_buffer()), np.uint8).reshape(8, -1).T.copy().view(float).reshape(size, size)
            part = z[a : a + size, b : b + size]
            part[:] = tile[: part.shape[0], : part.shape[1]]
    return z


def rfi_exposure(candidates: DataFrame, dem: DataFrame, sources: DataFrame, grid: Grid, step: float | None = None, radius: float = P.RADIO_EARTH_RADIUS) -> DataFrame:
    """Sum of weight / distance^2 over `sources(zr, zc, weight)` in plain sight; sources off the map, over voids
    or nearer than a metre are ignored, equal sources count each. Every candidate meets every source of its region. Stages candidates
    and sources when called."""
    step = step or min(grid.cell_y, grid.cell_x)
    at = dem.where("z is not null").select("region", F.col("r").alias("zr"), F.col("c").alias("zc"), F.col("z").alias("zs"))
    known = stage(with_altitude(candidates, dem).where("z0 is not null").select("region", F.col("cand_id").cast("long").alias("cand_id"), "r", "c", "z0"), "sight-known")  # counted, then read
    total = sources.groupBy("zr", "zc").agg(F.sum("weight").alias("weight"))
    packs = max(1, -(-total.count() // PACK))
    pack = F.pmod(F.xxhash64("zr", "zc"), F.lit(packs)).cast("int").alias("pack")
    packed = total.join(at, ["zr", "zc"]).groupBy("region", pack).agg(F.sort_array(F.collect_list(F.struct("zr", "zc", "zs", "weight"))).alias("s"))  # about PACK
    part = F.expr(f"explode(sequence(0, int((size(s) - 1) div {SLAB})))")
    slabs = packed.withColumn("part", part).withColumn("s", F.expr(f"slice(s, part * {SLAB} + 1, {SLAB})"))
    slabs = stage(slabs.select("region", "pack", "part", *[F.col(f"s.{n}").cast("array<double>").alias(n) for n in ("zr", "zc", "zs", "weight")]), "sight-sources")  # read twice
    shares = max(SHARES, -(-known.count() * min(packs, BUNDLE) * PACK // SHARE_LINES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    bundles, down, across = -(-packs // BUNDLE), -(-grid.rows // SQUARE), -(-grid.cols // SQUARE)
    cell = [F.expr(f"{c} div {CELL}") for c in ("r", "c")]
    mine = known.withColumn("share", F.pmod(F.xxhash64("region", *cell), F.lit(shares)).cast("int")).withColumn("bundle", every(bundles)).withColumn("sr", every(down)).withColumn("sc", every(across))
    ground = tiles(dem, TILE).mapInArrow(lambda batches: pack_tiles(batches, TILE), "region string, tr long, tc long, z binary").withColumn("bundle", every(bundles))
    ground = ground.withColumn("sr", F.expr(f"int(tr div {SQUARE // TILE})")).withColumn("sc", F.expr(f"int(tc div {SQUARE // TILE})"))
    met = slabs.drop("weight").withColumn("bundle", F.expr(f"int(pack div {BUNDLE})")).withColumn("sr", every(down)).withColumn("sc", every(across))
    key = ("region", "share", "bundle", "sr", "sc")
    land_key = [f"land_{n}" for n in key]
    # the keys of both sides must be of one type, or equal ones lie in different partitions
    land = ground.unionByName(met, allowMissingColumns=True).withColumn("share", every(shares)).withColumnsRenamed({n: f"land_{n}" for n in key})

    def judge(own: pa.Table, land: pa.Table) -> pa.Table:
        lists = land.filter(land["pack"].is_valid()).sort_by([("pack", "ascending"), ("part", "ascending")])
        if not len(own) or not len(lists):
            return HIDDEN.empty_table()
        r0, c0 = own["sr"][0].as_py() * SQUARE, own["sc"][0].as_py() * SQUARE
        ground = Ground(square(land, r0, c0, (min(SQUARE, grid.rows - r0), min(SQUARE, grid.cols - c0)), TILE), r0, c0, grid, step)
        own = own.take(np.lexsort((own["c"].to_numpy() // CELL, own["r"].to_numpy() // CELL)))  # neighbours look at the same ground
        listed = [(p.as_py(), q.as_py(), *(x.values.to_numpy() for x in at)) for p, q, *at in zip(*(lists[n] for n in ("pack", "part", "zr", "zc", "zs")), strict=True)]
        return pa.Table.from_batches(list(found(ground, own, listed)), HIDDEN)

    def found(ground: Ground, own: pa.Table, listed: list) -> Iterator[pa.RecordBatch]:
        r, c, z0 = (own[n].to_numpy().astype(float) for n in ("r", "c", "z0"))
        home = (r >= ground.r0) & (r < ground.r0 + ground.rows) & (c >= ground.c0) & (c < ground.c0 + ground.cols)
        rows = 128
        for k in range(0, len(r), rows):
            cut = slice(k, k + rows)
            for pack, part, zr, zc, zs in listed:
                wide = LINES // rows
                blocked = [hidden(ground, r[cut], c[cut], z0[cut], zr[m : m + wide], zc[m : m + wide], zs[m : m + wide], grid, step, radius) for m in range(0, len(zr), wide)]
                bits = words(np.concatenate(blocked, axis=1))
                kept = np.flatnonzero(home[cut] | bits.any(axis=1))  # a candidate's own square speaks for it, hidden or not
                same = own.slice(k, rows).take(kept).combine_chunks()
                fill = lambda n, x: pa.array(np.full(n, x, np.int32))
                ids = [same["region"], same["share"], fill(len(kept), pack), fill(len(kept), part), same["cand_id"], same["r"], same["c"]]
                of = [pa.array(bits[kept, w]) if w < bits.shape[1] else pa.array(np.zeros(len(kept), np.int64)) for w in range(len(WORDS))]
                yield pa.record_batch([*(x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in ids), *of], schema=HIDDEN)

    def exposure(bits: pa.Table, slab: pa.Table) -> pa.Table:
        """What a slab of sources gives to the candidates of a share."""
        if not len(bits) or not len(slab):
            return SEEN.empty_table()
        zr, zc, weight = (slab[n][0].values.to_numpy() for n in ("zr", "zc", "weight"))
        r, c = (bits[n].to_numpy().astype(float) for n in ("r", "c"))
        packed = np.stack([bits[w].to_numpy() for w in WORDS], axis=1).astype("<i8", copy=False)
        x, rows = np.zeros(len(r)), max(1, LINES // len(zr))
        for k in range(0, len(r), rows):
            dy, dx = (zr[None, :] - r[k : k + rows, None]) * grid.cell_y, (zc[None, :] - c[k : k + rows, None]) * grid.cell_x
            dist = np.sqrt(dy * dy + dx * dx)
            blocked = np.unpackbits(packed[k : k + rows].view(np.uint8), axis=1, count=len(zr), bitorder="little").astype(bool)
            x[k : k + rows] = np.where(blocked | (dist < 1), 0.0, weight / np.maximum(dist * dist, 1e-300)).sum(axis=1)
        return pa.table([bits["region"], bits["cand_id"], pa.array(x)], schema=SEEN)

    mine, land = mine.repartition(TASKS, *key), land.repartition(TASKS, *land_key)  # few bytes, much work: not by size
    of = ", ".join(["region string, share int, pack int, part int, cand_id long, r int, c int", *[f"{w} long" for w in WORDS]])
    blocked = mine.groupBy(*key).cogroup(land.groupBy(*land_key)).applyInArrow(judge, of)
    slab_key = ("region", "share", "pack", "part")
    blocked = blocked.repartition(TASKS, *slab_key).groupBy(*slab_key, "cand_id", "r", "c").agg(*[F.bit_or(w).alias(w) for w in WORDS])
    lit = slabs.withColumn("share", every(shares)).select(*[F.col(n).alias(f"lit_{n}") for n in slab_key], "zr", "zc", "weight")
    lit_key = [f"lit_{n}" for n in slab_key]
    seen_of = blocked.groupBy(*slab_key).cogroup(lit.repartition(TASKS, *lit_key).groupBy(*lit_key)).applyInArrow(exposure, "region string, cand_id long, x double")
    seen_of = seen_of.groupBy("region", "cand_id").agg(F.sum("x").alias("rfi_exposure"))
    return candidates.select("region", "cand_id").join(seen_of, ["region", "cand_id"], "left").select("region", "cand_id", F.coalesce("rfi_exposure", F.lit(0.0)).alias("rfi_exposure"))
