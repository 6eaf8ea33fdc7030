"""Clusters of similar vectors by a Gaussian mixture, fitted by distributed expectation maximisation.

Vectors are standardised and reduced to their leading principal components; moments, expectation steps and counts run
over all rows. Mixtures of several sizes are fitted in the same passes, with covariances shrunk towards spheres, and
an information criterion picks the size. A component with many members is divided by a mixture of its own, fitted in a
task of its own, and so on: components grow in number with the data, not in size. A component's densest members
represent it. Linked groups then come from the components: a vector belongs to every component whose responsibility is
near its best one's; one that is similar to a representative is linked by it, the others are compared exactly with the
members of their components, in blocks of bounded size; pieces of groups that meet in a vector are joined by connected
components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.vectors import binary, hash_sample, matrix, unit_vectors
from ..operators.graph import components
from ..session import spread, written

WIDTH, REDUCED = 64, 16
#: Numbers of components that the criterion chooses from; rows that start the fit; steps on those and on all rows.
SIZES, START, START_STEPS, STEPS = (16, 32, 64, 128), 8192, 12, 3
#: Members over which a component is divided; rows that fit its division, and most parts of one division.
DIVIDE, PART_SAMPLE, PARTS = 8192, 4096, 64
#: Shrinkage of covariances towards a sphere, least variance, share of the best responsibility that makes a member.
SHRINK, FLOOR, MEMBER = 0.1, 1e-3, 0.1
#: Similarity that links, members that make a cluster, representatives of a component, typical members of a cluster.
LINK, LEAST, REPRESENTATIVES, TYPICAL = 0.8, 5, 2, 3
#: Members of a component in one block; a component that no division made smaller is cut into a grid of blocks.
BLOCK = 32_768

_UP = np.triu_indices(REDUCED)
_WIDE = len(_UP[0]) + REDUCED + 1


def terms(y: np.ndarray) -> np.ndarray:
    """Products, values and 1 of each row: log densities and statistics of all components are one product with it."""
    out = np.empty((len(y), _WIDE))
    out[:, : len(_UP[0])] = y[:, _UP[0]] * y[:, _UP[1]]
    out[:, len(_UP[0]) : -1] = y
    out[:, -1] = 1
    return out


class Mixture:
    """Weights, means and covariances, and the form in which they act on terms()."""

    def __init__(self, weight: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> None:
        self.weight, self.mean, self.cov = weight, mean, cov
        inverse = np.linalg.inv(cov)
        _, logdet = np.linalg.slogdet(cov)
        act = np.empty((len(weight), _WIDE))
        double = np.where(_UP[0] == _UP[1], 1.0, 2.0)
        act[:, : len(_UP[0])] = -0.5 * inverse[:, _UP[0], _UP[1]] * double
        im = np.einsum("kij,kj->ki", inverse, mean)
        act[:, len(_UP[0]) : -1] = im
        act[:, -1] = np.log(np.maximum(weight, 1e-300)) - 0.5 * (logdet + REDUCED * np.log(2 * np.pi) + (mean * im).sum(1))
        self.act = act

    @staticmethod
    def of(stats: np.ndarray) -> "Mixture":
        """From statistics: per component the summed terms, weighted by responsibility."""
        n = stats[:, -1]
        good = n > 1e-6
        n = np.where(good, n, 1.0)
        mean = stats[:, len(_UP[0]) : -1] / n[:, None]
        second = np.zeros((len(n), REDUCED, REDUCED))
        second[:, _UP[0], _UP[1]] = stats[:, : len(_UP[0])] / n[:, None]
        second[:, _UP[1], _UP[0]] = second[:, _UP[0], _UP[1]]
        cov = second - mean[:, :, None] * mean[:, None, :]
        sphere = np.maximum(np.trace(cov, axis1=1, axis2=2) / REDUCED, FLOOR)
        a = np.minimum(1.0, SHRINK + REDUCED / (n + REDUCED))[:, None, None]
        eye = np.eye(REDUCED)
        cov = (1 - a) * cov + a * eye * sphere[:, None, None] + FLOOR * eye
        cov[~good] = eye
        weight = np.where(good, stats[:, -1], 0) / max(stats[:, -1].sum(), 1e-9)
        return Mixture(weight, mean, cov)

    def logs(self, t: np.ndarray) -> np.ndarray:
        """Log of weight times density of each row and component."""
        return t @ self.act.T


def _step(t: np.ndarray, mix: Mixture) -> tuple[np.ndarray, float]:
    logs = mix.logs(t)
    top = logs.max(1, keepdims=True)
    r = np.exp(logs - top)
    s = r.sum(1, keepdims=True)
    return (r / s).T @ t, float((top + np.log(s)).sum())


def start(y: np.ndarray, size: int, seed: int = 5) -> Mixture:
    """A mixture fitted on the starting rows alone, from centres far from one another."""
    rng = np.random.default_rng([seed, size])
    centres = [int(rng.integers(len(y)))]
    far = ((y - y[centres[0]]) ** 2).sum(1)
    for _ in range(size - 1):
        centres.append(int(rng.choice(len(y), p=far / far.sum())) if far.sum() > 0 else int(rng.integers(len(y))))
        far = np.minimum(far, ((y - y[centres[-1]]) ** 2).sum(1))
    near = ((y[:, None, :] - y[centres][None]) ** 2).sum(2).argmin(1) if len(y) * size < 4_000_000 else np.concatenate([((y[k : k + 1024, None, :] - y[centres][None]) ** 2).sum(2).argmin(1) for k in range(0, len(y), 1024)])
    t = terms(y)
    stats = np.zeros((size, _WIDE))
    np.add.at(stats, near, t)
    mix = Mixture.of(stats)
    for _ in range(START_STEPS):
        mix = Mixture.of(_step(t, mix)[0])
    return mix


def _sum_by_key(parts: DataFrame, size: int) -> np.ndarray:
    got = parts.groupBy("key").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(size)
    out[got.column("key").to_numpy()] = got.column("value").to_numpy()
    return out


def _moments(units: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and covariance of all rows."""
    size = 1 + WIDTH + WIDTH * WIDTH

    def run(batches):  # noqa: ANN001, ANN202
        total = np.zeros(size)
        for b in batches:
            x = matrix(b.column(0), WIDTH).astype(np.float64)
            total += np.r_[len(x), x.sum(0), (x.T @ x).ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["key", "value"])

    total = _sum_by_key(units.select("v").mapInArrow(run, "key int, value double"), size)
    n = int(total[0])
    mean = total[1 : 1 + WIDTH] / max(n, 1)
    return n, mean, total[1 + WIDTH :].reshape(WIDTH, WIDTH) / max(n, 1) - np.outer(mean, mean)


class Model:
    """The reduction, the chosen mixture, the mixtures that divide its components, and the vectors that represent the
    components that are left whole (leaves). About 1.8 kB a leaf, and a leaf holds some thousand vectors."""

    def __init__(self, mean: np.ndarray, turn: np.ndarray, mix: Mixture) -> None:
        self.mean, self.turn, self.mix = mean, turn, mix
        self.below: dict[int, tuple[Mixture, int]] = {}  # of a divided component its mixture, its first part's number
        self.was: dict[int, int] = {}  # of a divided component the members it had
        self.counts = np.zeros(0, np.int64)  # of the leaves
        self.size = len(mix.weight) if mix is not None else 0
        self.hub_ids, self.hubs = np.zeros(0, np.int64), np.zeros((0, WIDTH), np.float32)

    def reduced(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.turn

    def density(self, t: np.ndarray) -> np.ndarray:
        """Log density of each row under the chosen mixture."""
        logs = self.mix.logs(t)
        top = logs.max(1)
        return top + np.log(np.exp(logs - top[:, None]).sum(1))

    def belong(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, whether it is the row's own) of all leaves that each row belongs to. A division passes a row on
        to the parts whose responsibility is near the best one's; the likeliest part of the likeliest is its own."""
        row, part, own = _near(self.mix.logs(t))
        done = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
        while len(row):
            divided = np.isin(part, self.inner)
            done.append((row[~divided], part[~divided], own[~divided]))
            row, part, own = row[divided], part[divided], own[divided]
            order = np.argsort(part, kind="stable")
            row, part, own = row[order], part[order], own[order]
            fresh = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
            edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, int)
            for lo, hi in zip(edges, np.r_[edges[1:], len(part)]):
                mix, first = self.below[int(part[lo])]
                r, k, best = _near(mix.logs(t[row[lo:hi]]))
                fresh.append((row[lo:hi][r], first + k, own[lo:hi][r] & best))
            row, part, own = (np.concatenate(z) for z in zip(*fresh))
        return tuple(np.concatenate(z) for z in zip(*done))

    @property
    def inner(self) -> np.ndarray:
        return np.fromiter(self.below, np.int64, len(self.below))


def _near(logs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and components whose responsibility is MEMBER of the row's best at least, and whether it is the best."""
    best = logs.argmax(1)
    row, part = np.nonzero(logs >= logs[np.arange(len(logs)), best][:, None] + np.log(MEMBER))
    return row, part, part == best[row]


def fit(units: DataFrame) -> Model | None:
    """The reduction and mixture of all rows of units (node_id, v); None for an empty table."""
    n, mean, cov = _moments(units)
    if not n:
        return None
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    lead = vectors[:, ::-1][:, :REDUCED] / np.sqrt(np.maximum(values[::-1][:REDUCED], 1e-9))
    model = Model(mean, lead / scale[:, None], None)  # type: ignore[arg-type]
    first = model.reduced(matrix(hash_sample(units, START, n).select("v").toArrow().column(0), WIDTH))
    sizes = [k for k in SIZES if k * 8 <= len(first)] or [1]
    mixes = [start(first, k) for k in sizes]
    spark = units.sparkSession
    bounds = np.r_[0, np.cumsum([k * _WIDE + 1 for k in sizes])]
    for _ in range(STEPS):
        shared = spark.sparkContext.broadcast((model, mixes))

        def run(batches):  # noqa: ANN001, ANN202
            model, mixes = shared.value
            total = np.zeros(bounds[-1])
            for b in batches:
                x = matrix(b.column(0), WIDTH)
                for lo in range(0, len(x), 4096):
                    t = terms(model.reduced(x[lo : lo + 4096]))
                    for k, mix in enumerate(mixes):
                        stats, log = _step(t, mix)
                        total[bounds[k] : bounds[k + 1]] += np.r_[stats.ravel(), log]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["key", "value"])

        total = _sum_by_key(units.select("v").mapInArrow(run, "key int, value double"), bounds[-1])
        logs = [total[bounds[k + 1] - 1] for k in range(len(sizes))]
        before = mixes
        mixes = [Mixture.of(total[bounds[k] : bounds[k + 1] - 1].reshape(size, _WIDE)) for k, size in enumerate(sizes)]
    free = REDUCED + REDUCED * (REDUCED + 1) // 2 + 1
    criterion = [-2 * log + (size * free - 1) * np.log(n) for log, size in zip(logs, sizes)]
    model.mix = before[int(np.argmin(criterion))]
    model.size = len(model.mix.weight)
    divide(units, model)
    return model


def _counts(units: DataFrame, model: Model) -> np.ndarray:
    """Members of each leaf, over all rows; other components have 0."""
    shared = units.sparkSession.sparkContext.broadcast(model)

    def run(batches):  # noqa: ANN001, ANN202
        model, n = shared.value, np.zeros(shared.value.size, np.int64)
        for b in batches:
            x = matrix(b.column(0), WIDTH)
            for lo in range(0, len(x), 4096):
                n += np.bincount(model.belong(terms(model.reduced(x[lo : lo + 4096])))[1], minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.float64))], names=["key", "value"])

    return _sum_by_key(units.select("v").mapInArrow(run, "key int, value double"), model.size).astype(np.int64)


def divide(units: DataFrame, model: Model) -> np.ndarray:
    """Give components of more than DIVIDE members mixtures of their own, fitted on about PART_SAMPLE rows of each in
    parallel, until no division makes a component much smaller. Returns the members of each leaf."""
    spark = units.sparkSession
    whole: set[int] = set()
    while True:
        counts = _counts(units, model)
        for k, (mix, first) in model.below.items():
            if counts[first : first + len(mix.weight)].max(initial=0) > 0.9 * model.was.get(k, np.inf):
                whole.update(range(first, first + len(mix.weight)))  # copies and the like: dividing on won't help
        large = {int(k): int(counts[k]) for k in np.flatnonzero(counts > DIVIDE) if int(k) not in whole}
        if not large:
            model.counts = counts
            return counts
        shared = spark.sparkContext.broadcast((model, large))

        def draw(batches, shared=shared):  # noqa: ANN001, ANN202
            model, large = shared.value
            for b in batches:
                ids, x = b.column(0).to_numpy(), matrix(b.column(1), WIDTH)
                for lo in range(0, len(x), 4096):
                    y = model.reduced(x[lo : lo + 4096])
                    row, part, own = model.belong(terms(y))
                    h = (ids[lo : lo + 4096].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(34)).astype(np.float64)[row] / (1 << 30)
                    rate = np.array([PART_SAMPLE / large[k] if k in large else 0.0 for k in part.tolist()])
                    at = np.flatnonzero(own & (h < rate))
                    yield pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), binary(y[row[at]].astype("<f4"))], names=["k", "y"])

        def part(key, table):  # noqa: ANN001, ANN202
            k = key[0].as_py()
            y = matrix(table.column("y"), REDUCED).astype(np.float64)
            mix = start(y, int(min(PARTS, max(2, -(-2 * large[k] // DIVIDE)), max(1, len(y) // 16))), seed=6)
            return pa.table({"k": pa.array([k], pa.int32()), "mix": pa.array([np.concatenate([mix.weight, mix.mean.ravel(), mix.cov.ravel()]).tobytes()], pa.binary())})

        got = units.select("node_id", "v").mapInArrow(draw, "k int, y binary").groupBy("k").applyInArrow(part, "k int, mix binary").toArrow()
        for k, raw in sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist())):
            v = np.frombuffer(raw)
            n = len(v) // (1 + REDUCED + REDUCED * REDUCED)
            if n > 1:
                mix = Mixture(v[:n], v[n : n + n * REDUCED].reshape(n, REDUCED), v[n + n * REDUCED :].reshape(n, REDUCED, REDUCED))
                model.below[k], model.was[k] = (mix, model.size), large[k]
                model.size += n
        whole.update(k for k in large if k not in model.below)


def _represent(units: DataFrame, model: Model) -> None:
    """Give the model its leaves' densest members, of each leaf up to REPRESENTATIVES, and the ids these go by."""
    shared = units.sparkSession.sparkContext.broadcast(model)

    def run(batches):  # noqa: ANN001, ANN202
        model, best = shared.value, {}
        for b in batches:
            ids, x = b.column(0).to_numpy(), matrix(b.column(1), WIDTH)
            for lo in range(0, len(x), 4096):
                part = x[lo : lo + 4096]
                t = terms(model.reduced(part))
                density = model.density(t)
                row, leaf, own = model.belong(t)
                row, leaf = row[own], leaf[own]
                order = np.lexsort((ids[lo + row], -density[row], leaf))
                row, leaf = row[order], leaf[order]
                first = np.arange(len(leaf)) - np.searchsorted(leaf, leaf) < REPRESENTATIVES
                for r, k in zip(row[first].tolist(), leaf[first].tolist()):
                    best.setdefault(k, []).append((float(density[r]), int(ids[lo + r]), part[r].tobytes()))
        rows = [(int(k), d, i, v) for k, found in best.items() for d, i, v in sorted(set(found), key=lambda z: (-z[0], z[1]))[:REPRESENTATIVES]]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.float64(), pa.int64(), pa.binary()))], names=["k", "d", "node_id", "v"])

    found = units.select("node_id", "v").mapInArrow(run, "k int, d double, node_id long, v binary").dropDuplicates(["k", "node_id"])
    top = found.withColumn("rn", F.row_number().over(W.partitionBy("k").orderBy(F.desc("d"), "node_id"))).where(F.col("rn") <= REPRESENTATIVES).toArrow()
    k, rn, ids, x = top.column("k").to_numpy(), top.column("rn").to_numpy(), top.column("node_id").to_numpy(), matrix(top.column("v"), WIDTH)
    model.hubs = np.zeros((model.size, REPRESENTATIVES, WIDTH), np.float32)
    model.hubs[k, rn - 1] = x
    model.hub_ids = np.full((model.size, REPRESENTATIVES), -1, np.int64)
    model.hub_ids[k, rn - 1] = _named(x, ids)


def _named(x: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The name of each representative: the least id of all that are linked with it, over any number of links, so that
    a group that several leaves share stays one. Some 64 x (2 x leaves)^2 products, in blocks, in the driver."""
    label = np.arange(len(x))
    while True:
        fresh = label.copy()
        for lo in range(0, len(x), 2048):
            near = x[lo : lo + 2048] @ x.T >= LINK - 1e-7
            fresh[lo : lo + 2048] = np.where(near, label[None, :], len(x)).min(1)
        fresh = np.minimum(fresh, fresh[fresh])
        if (fresh == label).all():
            break
        label = fresh
    least = np.full(len(x) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    return least[label]


def linked(ids: np.ndarray, x: np.ndarray, hub: np.ndarray, row: np.ndarray, column: np.ndarray, link: float = LINK) -> np.ndarray:
    """The least id of each vector's linked piece within a block. hub is the id of a representative that it is linked
    with, or -1; rows (all but those that the block's main representative links) are compared with columns, exactly."""
    n = len(ids)
    names, start_label = np.unique(np.where(hub >= 0, hub, -1), return_inverse=True)
    label = np.arange(n)
    for k in np.flatnonzero(names >= 0):
        at = np.flatnonzero(start_label == k)
        label[at] = at[0]
    parent = np.arange(n)

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    rows, cols = np.flatnonzero(row), np.flatnonzero(column)
    for lo in range(0, len(rows), 512):
        r = rows[lo : lo + 512]
        near = x[r] @ x[cols].T >= link - 1e-7
        while True:
            fresh = near & (label[cols][None, :] != label[r][:, None])
            total = int(fresh.sum())
            if not total:
                break
            if total > 50_000:  # a dense spot: join all that its busiest vector sees, at once
                k = int(fresh.sum(1).argmax())
                joined = np.unique(np.r_[label[cols[fresh[k]]], label[r[k]]])
            else:
                a, b = np.nonzero(fresh)
                pairs = np.unique(np.stack([label[r[a]], label[cols[b]]], 1), axis=0)
                for s, t in pairs.tolist():
                    s, t = find(s), find(t)
                    if s != t:
                        parent[max(s, t)] = min(s, t)
                joined = np.unique(pairs)
                root = np.array([find(j) for j in joined.tolist()])
                move = np.arange(n)
                move[joined] = root
                label = move[label]
                continue
            move = np.arange(n)
            move[joined] = joined.min()
            label = move[label]
            parent[joined] = joined.min()
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    np.minimum.at(least, label[hub >= 0], hub[hub >= 0])
    return least[label]


def _grid(units: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of rows and of columns of each leaf: its members that its main representative doesn't link, and all."""
    across = np.maximum(1, -(-model.counts // BLOCK))
    down = np.ones_like(across)
    if across.max(initial=1) > 1:
        shared = units.sparkSession.sparkContext.broadcast(model)

        def run(batches):  # noqa: ANN001, ANN202
            n = np.zeros(shared.value.size, np.int64)
            for b in batches:
                x = matrix(b.column(0), WIDTH)
                for lo in range(0, len(x), 4096):
                    row, leaf, _, hub = _linked_by(shared.value, x[lo : lo + 4096])
                    n += np.bincount(leaf[hub != shared.value.hub_ids[leaf, 0]], minlength=len(n))
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.float64))], names=["key", "value"])

        free = _sum_by_key(units.select("v").mapInArrow(run, "key int, value double"), model.size)
        down = np.where(across > 1, np.maximum(1, -(-free.astype(np.int64) // BLOCK)), 1)
    return down, across


def _linked_by(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, own, name of the leaf's representative that links the row, or -1) of all leaves of each row."""
    row, leaf, own = model.belong(terms(model.reduced(x)))
    sims = np.einsum("nd,nrd->nr", x[row], model.hubs[leaf])
    sims[model.hub_ids[leaf] < 0] = -1
    best = sims.argmax(1)
    at = np.arange(len(row))
    return row, leaf, own, np.where(sims[at, best] >= LINK - 1e-7, model.hub_ids[leaf, best], -1)


def _belong(units: DataFrame, model: Model) -> DataFrame:
    """Every vector in every block of every leaf that it is a member of."""
    shared = units.sparkSession.sparkContext.broadcast((model, *_grid(units, model)))
    schema = "k int, i int, j int, node_id long, hub long, side int, own boolean, density double, v binary"

    def run(batches):  # noqa: ANN001, ANN202
        model, down, across = shared.value
        for b in batches:
            ids_all, x_all = b.column(0).to_numpy(), matrix(b.column(1), WIDTH)
            for lo in range(0, len(ids_all), 4096):
                ids, x = ids_all[lo : lo + 4096], x_all[lo : lo + 4096]
                density = model.density(terms(model.reduced(x)))
                r, k, own, hub = _linked_by(model, x)
                place = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)[r]
                free = hub != model.hub_ids[k, 0]
                single = (down[k] == 1) & (across[k] == 1)
                # As a column in every row of the grid; as a row, if free, in every column. Both at once where the
                # leaf is one block.
                ri, rj, rr, side = [np.zeros(single.sum(), int)], [np.zeros(single.sum(), int)], [np.flatnonzero(single)], [np.where(free[single], 3, 2)]
                for s in range(int(down[k].max(initial=0))):
                    at = np.flatnonzero(~single & (down[k] > s))
                    rr, ri, rj, side = rr + [at], ri + [np.full(len(at), s)], rj + [place[at] % across[k[at]]], side + [np.full(len(at), 2)]
                for s in range(int(across[k].max(initial=0))):
                    at = np.flatnonzero(~single & free & (across[k] > s))
                    rr, ri, rj, side = rr + [at], ri + [place[at] // 7 % down[k[at]]], rj + [np.full(len(at), s)], side + [np.full(len(at), 1)]
                rr, ri, rj, side = (np.concatenate(z) for z in (rr, ri, rj, side))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k[rr].astype(np.int32)), pa.array(ri.astype(np.int32)), pa.array(rj.astype(np.int32)), pa.array(ids[r[rr]]), pa.array(hub[rr]), pa.array(side.astype(np.int32)), pa.array(own[rr]), pa.array(density[r[rr]]), binary(x[r[rr]])],
                    names=["k", "i", "j", "node_id", "hub", "side", "own", "density", "v"],
                )

    return units.select("node_id", "v").mapInArrow(run, schema)


def _pieces(key, table):  # noqa: ANN001, ANN202
    ids, side = table.column("node_id").to_numpy(), table.column("side").to_numpy()
    _, first = np.unique(np.stack([ids, side], 1), axis=0, return_index=True)  # a repeated row is one vector
    ids, side = ids[first], side[first]
    hub = table.column("hub").to_numpy()[first]
    x = matrix(table.column("v"), WIDTH)[first]
    least = linked(ids, x, hub, (side & 1) > 0, (side & 2) > 0)
    density = table.column("density").to_numpy()[first]
    name, where, n = np.unique(least, return_inverse=True, return_counts=True)
    keep = (n[where] > 1) | (hub >= 0)
    # A representative is part of every piece that it links, whatever block it lives in itself.
    hubs, at = np.unique(hub, return_index=True)
    hubs, at = hubs[hubs >= 0], at[hubs >= 0]
    return pa.Table.from_arrays(
        [pa.array(np.r_[ids[keep], hubs]), pa.array(np.r_[least[keep], least[at]]), pa.array(np.r_[density[keep], np.full(len(hubs), np.nan)], from_pandas=True)],
        names=["node_id", "piece", "density"],
    )


def members(nodes: DataFrame, least: int = LEAST) -> DataFrame:
    """node_id, cluster_id and density of every usable leaf in a cluster: two leaves are linked if their cosine is at
    least LINK, a cluster is a connected group of at least `least`, named by its least node_id.

    nodes has node_id, layer and embeddings; other columns are left aside. Only rows of layer 0 with exactly 64 finite
    numbers, not all 0, take part; rows of one node_id count once; equal vectors are linked like others. The comparison
    within components is exact; a link is missed only between vectors that share no component, i.e. whose
    responsibilities differ by more than 1 : MEMBER in either's best component. The mixture is fitted on all rows, those
    that divide its larger components on about PART_SAMPLE rows of each. An empty table gives an empty one.
    """
    spark = nodes.sparkSession
    units = written(unit_vectors(spread(nodes.where("layer = 0").select("node_id", "embeddings")), "node_id", "embeddings", WIDTH), "units")
    model = fit(units)
    if model is None:
        return spark.createDataFrame([], "node_id long, cluster_id long, density double")
    _represent(units, model)
    pieces = written(_belong(units, model).groupBy("k", "i", "j").applyInArrow(_pieces, "node_id long, piece long, density double"), "pieces")
    # Pieces that meet in a vector are one; the vector keeps the least of its pieces.
    met = pieces.groupBy("node_id").agg(F.min("piece").alias("piece"), F.collect_set("piece").alias("all"), F.first("density", True).alias("density"))
    met = written(met, "met")
    joints = met.where("size(all) > 1").select("piece", F.explode("all").alias("other")).where("piece <> other").distinct()
    names = components(joints, "piece", "other").withColumnRenamed("node", "piece")
    named = met.select("node_id", "piece", "density").join(names, "piece", "left").select("node_id", F.coalesce("component", "piece").alias("cluster_id"), "density")
    named = named.where("node_id is not null")
    big = named.groupBy("cluster_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return named.join(big.select("cluster_id"), "cluster_id", "left_semi").select("node_id", "cluster_id", "density")


def described(nodes: DataFrame, least: int = LEAST, typical: int = TYPICAL) -> DataFrame:
    """cluster_id, size, rank, node_id and text: of each cluster its most typical members, those of highest density
    under the mixture, ranked from 1; ties go to the lesser node_id. A member's text may be null."""
    all_members = written(members(nodes, least), "members")
    sizes = all_members.groupBy("cluster_id").agg(F.count("*").alias("size"))
    order = W.partitionBy("cluster_id").orderBy(F.desc("density"), "node_id")
    top = all_members.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= typical)
    texts = nodes.where("layer = 0").select("node_id", "text").join(top.select("node_id"), "node_id", "left_semi").groupBy("node_id").agg(F.first("text", True).alias("text"))
    return top.join(sizes, "cluster_id").join(texts, "node_id", "left").select("cluster_id", "size", "rank", "node_id", "text")
