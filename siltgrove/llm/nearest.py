"""The most similar vectors of every vector, by additive quantisation and exact reranking.

Centres are fitted in two levels: those of groups on the driver from a bounded sample, those of the lists within each
group by one task a group, so that both grow in number with the vectors. What a vector has beyond its part along its
list's centre is coded by beam search over full-dimensional residual codebooks; that part and the code are all that
look-up tables need to score it. A vector travels to the groups that hold the lists it probes; there the tables score
every member of those lists, and those whose score, given the error that codes leave, may beat the best so far are
reranked by exact similarities (about a seventh): the codes decide who is looked at. How many members elsewhere may be nearer than what was found is then expected from the size, mean and spread
of the lists and groups; a vector that may miss more than MISSED of its neighbours goes on to as many further groups as
that takes, in exact blocked products. Vectors that equal one another stand for one another, so a group of copies of
any size costs no more than six vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.vectors import binary, hash_sample, matrix, unit_vectors
from ..session import spread, written

WIDTH = 64
#: Vectors per list and per group that are aimed at; sampled vectors per list.
LIST, GROUP, PER_LIST = 512, 6_000, 32
#: Vectors that fit the groups' centres on the driver (64 MB); a group's centre needs 16 of them. Most lists: their
#: centres are broadcast (64 MB). Beyond 134 million vectors lists, and beyond 98 million groups, grow instead.
SAMPLE, MAX_LISTS = 262_144, 262_144
PROBES, CODEBOOKS, CODES, BEAM = 6, 32, 16, 2
#: Members of its nearest list that a query reranks first; and errors of a score (standard deviations, as the codes
#: leave them) by which a member may fall short of the best so far and still be reranked.
FIRST, MARGIN = 32, 4.5
#: Queries whose look-up tables are held at a time, and queries of one list that are scored at a time.
BLOCK, LANES = 2048, 128
#: Groups that a vector visits as a query, and nearest groups among whose lists it chooses.
VISITS, LOOKS = 2, 6
#: Base vectors of a group in one task; a larger group is salted, and its queries visit every salt.
SALT = 12_000
#: Neighbours of a vector that may be expected in groups it never meets, of K.
MISSED = 0.25
#: Base vectors, and vectors that ask them, in one task of the second search.
WIDE, ASKERS = 262_144, 262_144
K = 5


def spherical_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """k centres of unit length; an empty one restarts at a member."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        a = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        order = np.argsort(a, kind="stable")
        n = np.bincount(a, minlength=k)
        starts = np.r_[0, np.cumsum(n)[:-1]]
        full = np.flatnonzero(n)
        sums = np.zeros_like(c)
        sums[full] = np.add.reduceat(x[order], starts[full], axis=0)
        empty = n == 0
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def _means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 2) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        a = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        n = np.bincount(a, minlength=k)
        sums = np.zeros_like(c)
        full = np.flatnonzero(n)
        sums[full] = np.add.reduceat(x[np.argsort(a, kind="stable")], (np.cumsum(n) - n)[full], axis=0)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c.astype(np.float32)


class Index:
    """Centres of groups and lists, codebooks and the products between codewords. Lists are in the order of their
    groups."""

    def __init__(self, near: np.ndarray, centres: np.ndarray, group: np.ndarray, sample: np.ndarray) -> None:
        self.near, self.centres, self.group = near, centres, group.astype(np.int32)
        self.edge = np.searchsorted(self.group, np.arange(len(near) + 1))
        part = sample[: 16 * 1024]
        residual = self.parts(part, self.probes(part, 1)[:, 0])[1]
        books = []
        for m in range(CODEBOOKS):
            book = _means(residual, CODES, seed=10 + m)
            books.append(book)
            residual = residual - book[(residual @ book.T - 0.5 * (book * book).sum(1)).argmax(1)]
        self.books = np.concatenate(books)  # CODEBOOKS * CODES full-dimensional codewords
        self.gram = self.books @ self.books.T
        self.error = float(np.sqrt((residual * residual).mean()))  # that codes leave, along a direction
        self.shape = self.group_shape = np.zeros((3, 0), np.float32)

    def parts(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length along the centre of its list, and the rest, of each vector."""
        c = self.centres[own]
        along = (x * c).sum(1)
        return along, x - along[:, None] * c

    def looked(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Similarities to the centres of all groups; the LOOKS nearest groups of each vector; the similarities to
        these groups' lists (rows are vectors; a group takes as many columns as the largest has lists, -3 where it has
        fewer)."""
        to = x @ self.near.T
        most = min(LOOKS, to.shape[1])
        top = np.argpartition(-to, most - 1, axis=1)[:, :most] if most < to.shape[1] else np.tile(np.arange(most), (len(x), 1))
        s = np.full((len(x), most, int(np.diff(self.edge).max())), -3, np.float32)
        row, slot = np.nonzero(top >= 0)
        of = top[row, slot]
        order = np.argsort(of, kind="stable")
        row, slot, of = row[order], slot[order], of[order]
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        for lo, hi in zip(starts, np.r_[starts[1:], len(of)]):
            g = of[lo]
            s[row[lo:hi], slot[lo:hi], : self.edge[g + 1] - self.edge[g]] = x[row[lo:hi]] @ self.centres[self.edge[g] : self.edge[g + 1]].T
        return to, top, s

    def probes(self, x: np.ndarray, most: int, visits: int = VISITS) -> np.ndarray:
        """The nearest lists of each vector, nearest first, out of those of `visits` groups: so a vector travels at
        most so often, however many groups there are. Where these hold fewer lists, the rest is -1."""
        _, top, s = self.looked(x)
        best = s.max(2)
        if visits < best.shape[1]:
            far = best < -np.partition(-best, visits - 1, axis=1)[:, visits - 1 : visits]
            s = np.where(far[:, :, None], -3, s)
        number = (self.edge[top][:, :, None] + np.arange(s.shape[2])).reshape(len(x), -1)
        s = s.reshape(len(x), -1)
        found = np.full((len(x), most), -1, np.int64)
        n = min(most, s.shape[1])
        at = np.argpartition(-s, n - 1, axis=1)[:, :n] if n < s.shape[1] else np.tile(np.arange(n), (len(x), 1))
        at = np.take_along_axis(at, np.argsort(-np.take_along_axis(s, at, 1), axis=1, kind="stable"), 1)
        found[:, :n] = np.where(np.take_along_axis(s, at, 1) > -3, np.take_along_axis(number, at, 1), -1)
        return found

    def nearer(self, x: np.ndarray, least: np.ndarray, probed: np.ndarray) -> np.ndarray:
        """How many members of each group, outside of the lists that were probed, are expected to be more similar to
        each vector than least, taking similarities in a list as normal; of groups that are none of the nearest, by
        the group's own shape."""
        to, top, s = self.looked(x)
        e = _tail(self.group_shape, to, least)
        number = self.edge[top][:, :, None] + np.arange(s.shape[2])
        there = s > -3
        number = np.where(there, number, 0)
        inner = np.where(there, _tail(self.shape[:, number], s, least[:, None]), 0)
        for j in range(probed.shape[1]):
            inner[number == probed[:, j, None, None]] = 0
        np.put_along_axis(e, top, inner.sum(2), 1)
        return e

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of what each vector has beyond its part along its list's centre, by beam search over the codebooks;
        and the length of that part."""
        along, rest = self.parts(x, own)
        dots = rest @ self.books.T
        half = (0.5 * np.diag(self.gram)).astype(np.float32)
        n, rows = len(x), np.arange(len(x))[:, None]
        codes = np.zeros((n, 1, 0), np.int64)
        gain = np.zeros((n, 1), np.float32)
        cross = np.zeros((n, 1, dots.shape[1]), np.float32)  # of the codewords so far with those of the books to come
        for m in range(CODEBOOKS):
            at = slice(m * CODES, (m + 1) * CODES)
            score = gain[:, :, None] + (dots[:, None, at] - half[at] - cross[:, :, :CODES])
            flat = score.reshape(n, -1)
            best = np.argpartition(-flat, min(BEAM, flat.shape[1]) - 1, axis=1)[:, :BEAM]
            gain = np.take_along_axis(flat, best, 1)
            beam, word = best // CODES, best % CODES
            codes = np.concatenate([codes[rows, beam], word[:, :, None]], axis=2)
            cross = cross[:, :, CODES:][rows, beam] + self.gram[word + m * CODES, (m + 1) * CODES :]
        return codes[np.arange(n), gain.argmax(1)].astype(np.uint8), along.astype(np.float32)


def _tail(shape: np.ndarray, to: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Expected members over least, of sets of a size, a mean similarity to the centre and a spread, given the
    similarity to the centre."""
    size, lean, spread = shape
    z = np.clip((least[..., None] - to * lean) / spread, 0, 12)
    return size * np.exp(-0.5 * z * z - 0.919) / (0.661 * z + 0.339 * np.sqrt(z * z + 5.51))  # the normal tail


def fit(vectors: DataFrame, total: int) -> Index | None:
    """The index of the vectors (node_id, v), of which there are total; None if there are none. Group centres come from
    SAMPLE of them at most; each group's list centres from PER_LIST a list of its own, in a task of its own."""
    sample = matrix(hash_sample(vectors, min(SAMPLE, max(4096, PER_LIST * total // LIST)), total).select("v").toArrow().column(0), WIDTH)
    if not len(sample):
        return None
    groups = int(max(1, min(-(-total // GROUP), len(sample) // 16)))
    near = spherical_means(sample, groups)
    lists = min(max(1, -(-total // LIST)), MAX_LISTS)
    shared = vectors.sparkSession.sparkContext.broadcast(near)

    def assign(batches):  # noqa: ANN001, ANN202
        for b in batches:
            x = matrix(b.column(0), WIDTH)
            g = np.concatenate([(x[k : k + 4096] @ shared.value.T).argmax(1) for k in range(0, len(x), 4096)]) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), b.column(0)], names=["g", "v"])

    def divide(key, table):  # noqa: ANN001, ANN202
        x = matrix(table.column("v"), WIDTH)
        c = spherical_means(x, max(1, min(len(x), round(len(x) / PER_LIST))), seed=2)
        return pa.Table.from_arrays([pa.array(np.full(len(c), key[0].as_py(), np.int32)), binary(c)], names=["g", "v"])

    parts = hash_sample(vectors, PER_LIST * lists, total).select("v").mapInArrow(assign, "g int, v binary")
    got = parts.groupBy("g").applyInArrow(divide, "g int, v binary").toArrow()
    g, c = got.column(0).to_numpy(), matrix(got.column(1), WIDTH)
    order = np.lexsort((*c.T[:2], g))
    at, g = np.unique(g[order], return_inverse=True)  # a group without lists has no members either
    return Index(near[at], c[order], g, sample)


def search(ids: np.ndarray, x: np.ndarray, own: np.ndarray, probes: np.ndarray, codes: np.ndarray, along: np.ndarray, index: Index, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query positions, candidates and similarities: of each row that probes lists here, the best `keep` of them.

    own is a row's list, or -1 where it is no base vector here; probes are lists, -1 for none. Members are scored by
    look-up tables only; those whose score comes within MARGIN errors of the query's best so far are reranked."""
    base = np.flatnonzero(own >= 0)
    base = base[np.argsort(own[base], kind="stable")]
    lists, first = np.unique(own[base], return_index=True)
    last = np.r_[first[1:], len(base)]
    words = (codes.astype(np.intp) + np.arange(CODEBOOKS) * CODES).T
    asking = np.flatnonzero((probes >= 0).any(1))
    nearest_list = probes[asking, (probes[asking] >= 0).argmax(1)]
    asking = asking[np.argsort(nearest_list, kind="stable")]  # so that a block's queries share lists
    best_c, best_s = np.full((len(asking), keep), -1, np.int64), np.full((len(asking), keep), -9, np.float32)
    for start in range(0, len(asking), BLOCK):
        block = asking[start : start + BLOCK]
        tables = index.books @ x[block].T  # a column per query
        row, slot = np.nonzero(probes[block] >= 0)
        rank = (probes[block] >= 0).cumsum(1)[row, slot]
        asked = probes[block][row, slot]
        order = np.lexsort((asked, rank))  # every query's nearest list first
        row, rank, asked = row[order], rank[order], asked[order]
        edges = np.flatnonzero(np.r_[True, (asked[1:] != asked[:-1]) | (rank[1:] != rank[:-1])])
        for lo, hi in ((k, min(k + LANES, e)) for k0, e in zip(edges, np.r_[edges[1:], len(asked)]) for k in range(k0, e, LANES)):
            at = np.searchsorted(lists, asked[lo])
            if at == len(lists) or lists[at] != asked[lo]:
                continue
            members, mine, qs = base[first[at] : last[at]], start + row[lo:hi], block[row[lo:hi]]
            t, to = np.ascontiguousarray(tables[:, row[lo:hi]]), x[qs] @ index.centres[asked[lo]]
            margin = (MARGIN * index.error * np.sqrt(np.maximum(1 - to * to, 0))).astype(np.float32)
            for ms in (members[k : k + 4096] for k in range(0, len(members), 4096)):
                score = along[ms][:, None] * to
                term = np.empty((len(ms), len(qs)), np.float32)
                for m in range(CODEBOOKS):
                    score += np.take(t, words[m][ms], axis=0, out=term, mode="clip")
                opening = np.flatnonzero(best_s[mine, -1] < -2)  # queries without `keep` candidates so far
                if len(opening):
                    n = min(max(FIRST, keep), len(ms))
                    top = np.argpartition(-score[:, opening], n - 1, axis=0)[:n]
                    score[top, opening] = -9
                    _rerank(ids, x, qs, mine, ms, np.tile(opening, n), top.ravel(), best_c, best_s)
                at, r = np.divmod(np.flatnonzero(score >= best_s[mine, -1] - margin), len(qs))
                _rerank(ids, x, qs, mine, ms, r, at, best_c, best_s)
    row, slot = np.nonzero(best_c >= 0)
    q, c, s = asking[row], best_c[row, slot], best_s[row, slot]
    order = np.lexsort((ids[c], -s, q))
    return q[order], c[order], s[order]


def _rerank(ids: np.ndarray, x: np.ndarray, qs: np.ndarray, mine: np.ndarray, ms: np.ndarray, r: np.ndarray, at: np.ndarray, best_c: np.ndarray, best_s: np.ndarray) -> None:
    """Exact similarities of the candidates ms[at] of queries qs[r], merged into the best so far in rows mine[r]."""
    xq, xm = x[qs], x[ms]
    sims = [np.einsum("ij,ij->i", np.take(xq, r[k : k + 8192], axis=0), np.take(xm, at[k : k + 8192], axis=0)) for k in range(0, len(r), 8192)]
    sims = np.concatenate([np.zeros(0, np.float32), *sims])
    good = np.flatnonzero(sims > best_s[mine, -1][r])
    r, cand, sims = r[good], ms[at[good]], sims[good]
    other = ids[cand] != ids[qs[r]]
    r, cand, sims = r[other], cand[other], sims[other]
    if not len(r):
        return
    keep = best_s.shape[1]
    touched = np.unique(r)
    old = np.repeat(touched, keep)
    q, c, s = np.r_[old, r], np.r_[best_c[mine[touched]].ravel(), cand], np.r_[best_s[mine[touched]].ravel(), sims]
    order = np.lexsort((np.where(c >= 0, ids[c], np.iinfo(np.int64).max), -s, q))
    q, c, s = q[order], c[order], s[order]
    starts = np.searchsorted(q, touched)
    at = (starts[:, None] + np.arange(keep)).ravel()
    best_c[mine[touched]], best_s[mine[touched]] = c[at].reshape(-1, keep), s[at].reshape(-1, keep)


def further(ids: np.ndarray, x: np.ndarray, own: np.ndarray, wants: np.ndarray, least: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As search(), but exact: wants marks by query and group which groups a query asks, and only similarities of at
    least `least` count. Rows are base vectors if own, their group, isn't negative, and queries otherwise."""
    base, asking = np.flatnonzero(own >= 0), np.flatnonzero(own < 0)
    base = base[np.argsort(own[base], kind="stable")]
    lists, first = np.unique(own[base], return_index=True)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
    for block in (asking[k : k + BLOCK] for k in range(0, len(asking), BLOCK)):
        hits = []
        for number, lo, hi in zip(lists, first, np.r_[first[1:], len(base)]):
            qs = block[wants[block, number]]
            for ms in (base[k : min(k + 8192, hi)] for k in range(lo, hi, 8192)) if len(qs) else ():
                sims = x[qs] @ x[ms].T
                row, col = np.nonzero(sims >= least[qs][:, None])
                if len(row) > 16 * keep * len(qs) and keep + 1 < len(ms):  # a query itself may be among them
                    col = np.argpartition(-sims, keep, axis=1)[:, : keep + 1].ravel()
                    row = np.repeat(np.arange(len(qs)), keep + 1)
                other = ids[ms[col]] != ids[qs[row]]
                row, col = row[other], col[other]
                hits.append((qs[row], ms[col], sims[row, col]))
        if hits:
            q, c, s = (np.concatenate(z) for z in zip(*hits))
            order = np.lexsort((ids[c], -s, q))
            q, c, s = q[order], c[order], s[order]
            top = np.arange(len(q)) - np.searchsorted(q, q) < keep
            out.append((q[top], c[top], s[top]))
    q, c, s = (np.concatenate(z) for z in zip(*out))
    order = np.argsort(q, kind="stable")
    q, c = q[order], c[order]
    # Summed as the first search does, so that a pair that both find has one similarity to the last bit.
    return q, c, np.einsum("ij,ij->i", x[q], x[c])


def _listed(ids: np.ndarray, q: np.ndarray, c: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The queries, the start of each one's candidates, and these as lists."""
    heads, at = np.unique(q, return_index=True)
    near = pa.StructArray.from_arrays([pa.array(s.astype(np.float32)), pa.array(ids[c], pa.int64())], names=["s", "c"])
    return heads, at, pa.ListArray.from_arrays(pa.array(np.r_[at, len(q)], pa.int32()), near)


def _shapes(units: DataFrame, index) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """Size, mean similarity to the centre and spread along a direction of every list, and of every group, over all
    vectors. A vector counts for the group of its nearest list."""

    def run(batches):  # noqa: ANN001, ANN202
        ix = index.value
        sums = np.zeros((4, len(ix.centres)))
        wide = np.zeros((2, len(ix.near)))
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                x = matrix(b.column(0).slice(lo, 2048), WIDTH)
                own = ix.probes(x, 1)[:, 0]
                best = (x * ix.centres[own]).sum(1).astype(np.float64)
                to = (x * ix.near[ix.group[own]]).sum(1).astype(np.float64)
                sums[0] += np.bincount(own, minlength=len(ix.centres))
                sums[1] += np.bincount(own, best, len(ix.centres))
                sums[2] += np.bincount(own, best * best, len(ix.centres))
                wide[0] += np.bincount(ix.group[own], to, len(ix.near))
                wide[1] += np.bincount(ix.group[own], to * to, len(ix.near))
        at, up = np.flatnonzero(sums[0]), np.flatnonzero(wide[1])
        key = np.r_[at, -1 - up].astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.r_[sums[0][at], np.zeros(len(up))]), pa.array(np.r_[sums[1][at], wide[0][up]]), pa.array(np.r_[sums[2][at], wide[1][up]])], names=["list", "n", "one", "two"])

    parts = units.select("v").mapInArrow(run, "list int, n double, one double, two double")
    rows = parts.groupBy("list").agg(F.sum("n").alias("n"), F.sum("one").alias("one"), F.sum("two").alias("two")).toArrow()
    at, n, one, two = (rows.column(k).to_numpy() for k in range(4))
    ix = index.value
    shape, wide = np.zeros((3, len(ix.centres))), np.zeros((3, len(ix.near)))
    shape[2], wide[2] = 1, 1
    a, g = at >= 0, at < 0
    shape[:, at[a]] = n[a], one[a], two[a]
    wide[0] = np.bincount(ix.group, shape[0], len(ix.near))
    wide[1:, -1 - at[g]] = one[g], two[g]
    for x in (shape, wide):
        x[1:] /= np.maximum(x[0], 1)
        # What of unit length isn't along the centre is spread over the other directions.
        x[2] = np.where(x[0] > 0, np.sqrt(np.maximum(1 - x[2], 1e-6) / (WIDTH - 1)), 1)
    return shape.astype(np.float32), wide.astype(np.float32)


def _classes(units: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """node_id and rep of the vectors that equal another one's; and node_id and rn (from 1, by node_id) of the first k
    of each class. That limit is applied before the shuffle, so a class of any size costs a task only k rows."""
    keyed = units.select("node_id", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2")).distinct()
    many = keyed.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("node_id").alias("rep")).where("n > 1")
    copies = written(keyed.join(many, ["h1", "h2"]).select("node_id", "rep"), "copies")
    return copies, copies.withColumn("rn", F.row_number().over(W.partitionBy("rep").orderBy("node_id"))).where(F.col("rn") <= k)


def nearest(nodes: DataFrame, k: int = K, probes: int = PROBES, floor: float = -1.0) -> DataFrame:
    """node_id, rank (from 1), neighbour and similarity (cosine) of every usable leaf: its k most similar others. With
    a floor, only neighbours of at least that similarity are looked for beyond the first search; others that it met
    are given all the same.

    nodes has node_id, layer and embeddings; other columns are left aside. A leaf is a row of layer 0; vectors that
    are null, not 64 long, not finite or all 0 give no row and are nobody's neighbour. Rows of one node_id count once.
    Equal similarities are ranked by node_id. Fewer than k others give fewer rows; an empty table gives an empty one.

    The result is approximate: it is exact but for neighbours in the `probes` nearest lists whose score by the codes
    falls short of their similarity by more than MARGIN errors, and for those in groups that were left out because, of
    all such groups together, no more than MISSED neighbours were expected. The index is fitted on at most SAMPLE
    vectors (groups) and PER_LIST vectors per list (lists), chosen by a hash of node_id; every vector is indexed and
    every vector is a query.
    """
    spark = nodes.sparkSession
    units = written(unit_vectors(spread(nodes.where("layer = 0").select("node_id", "embeddings")), "node_id", "embeddings", WIDTH), "units")
    copies, first = _classes(units, k + 1)
    n_copies = copies.count()
    ready = units.withColumn("rn", F.lit(1))
    if n_copies:
        ready = units.join(copies, "node_id", "left").join(first.select("node_id", "rn"), "node_id", "left").where("rep is null or rn is not null").select("node_id", "v", F.coalesce("rn", F.lit(1)).alias("rn"))
        ready = written(ready, "ready")
    total = ready.count()
    found = "node_id long, near array<struct<s:float,c:long>>"
    ix = fit(ready.select("node_id", "v"), total)
    if ix is None:
        return spark.createDataFrame([], "node_id long, rank int, neighbour long, similarity double")
    ix.shape, ix.group_shape = _shapes(ready, spark.sparkContext.broadcast(ix))
    index = spark.sparkContext.broadcast(ix)  # bounded by SAMPLE, MAX_LISTS and the codebooks

    sizes = ix.group_shape[0]
    salts = np.maximum(1, np.ceil(sizes / SALT)).astype(np.int64)
    # Groups are gathered into blocks for the second search.
    wide = ((np.cumsum(sizes, dtype=np.float64) - sizes) * -(-total // WIDE) // max(total, 1)).astype(np.int32)
    narrow = "<i4"

    def assign(batches):  # noqa: ANN001, ANN202
        ix = index.value
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                ids, x, rn = part.column(0).to_numpy(), matrix(part.column(1), WIDTH), part.column(2).to_numpy()
                near = ix.probes(x, probes)
                codes, along = ix.encode(x, near[:, 0])
                groups = np.where(near >= 0, ix.group[near], -1)
                mine = groups[:, 0]
                salt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % salts[mine]
                rows, owns, keys, subs = [], [], [], []
                for j in range(groups.shape[1]):
                    fresh = np.flatnonzero((groups[:, :j] != groups[:, j : j + 1]).all(1) & (groups[:, j] >= 0))
                    for s in range(int(salts[groups[fresh, j]].max()) if len(fresh) else 0):
                        r = fresh[salts[groups[fresh, j]] > s]
                        home = (salt[r] == s) if j == 0 else np.zeros(len(r), bool)
                        r, home = r[home | (rn[r] == 1)], home[home | (rn[r] == 1)]
                        rows.append(r)
                        owns.append(np.where(home, near[r, 0], -1))
                        keys.append(groups[r, j])
                        subs.append(np.full(len(r), s))
                r, own, key, sub = (np.concatenate(z) for z in (rows, owns, keys, subs))
                ask = np.where((rn[r] == 1)[:, None], near[r], -1).astype(narrow)
                info = np.concatenate([codes[r], np.ascontiguousarray(along[r], "<f4").view(np.uint8).reshape(len(r), -1), np.ascontiguousarray(ask).view(np.uint8).reshape(len(r), -1)], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), pa.array(sub, pa.int32()), pa.array(ids[r]), pa.array(own, pa.int32()), binary(x[r]), binary(info)], names=["g", "salt", "node_id", "own", "v", "info"])

    def answer(key, table):  # noqa: ANN001, ANN202
        ids = table.column("node_id").to_numpy()
        own = table.column("own").to_numpy()
        # A repeated row is one vector: keep the first of each (id, base or not).
        _, first = np.unique(np.stack([ids, (own >= 0).astype(np.int64)], 1), axis=0, return_index=True)
        x = matrix(table.column("v"), WIDTH)[first]
        info = table.column("info").combine_chunks()
        width = len(info[0].as_py())
        raw = np.frombuffer(b"".join(info.to_pylist()), np.uint8).reshape(-1, width)[first]
        ids, own = ids[first], own[first]
        codes = raw[:, :CODEBOOKS]
        along = np.ascontiguousarray(raw[:, CODEBOOKS : CODEBOOKS + 4]).view("<f4")[:, 0]
        ix = index.value
        probed = np.ascontiguousarray(raw[:, CODEBOOKS + 4 :]).view(narrow).astype(np.int64)
        ask = np.where((probed >= 0) & (ix.group[probed] == key[0].as_py()), probed, -1)
        q, c, s = search(ids, x, own, ask, codes, along, ix, k + 1)
        heads, at, near = _listed(ids, q, c, s)
        # The vectors that may have nearer ones elsewhere, each in its own group, with the lists it probes.
        full = np.diff(np.r_[at, len(q)]) >= k
        least = np.full(len(ids), -1, np.float32)
        least[heads[full]] = s[at[full] + k - 1]
        lacks = np.zeros(len(ids), bool)
        home = np.flatnonzero((own >= 0) & (probed >= 0).any(1))
        for part in (home[j : j + BLOCK] for j in range(0, len(home), BLOCK)):
            lacks[part] = ix.nearer(x[part], np.maximum(least[part], floor), probed[part]).sum(1) > MISSED
        # One without any candidate still has to go on.
        bare = np.setdiff1d(np.flatnonzero(lacks), heads)
        near = pa.concat_arrays([near, pa.array([[]] * len(bare), near.type)])
        heads = np.r_[heads, bare]
        v = pa.array([x[h].tobytes() if lacks[h] else None for h in heads], pa.binary())
        seen = pa.array([probed[h].astype("<i4").tobytes() if lacks[h] else None for h in heads], pa.binary())
        return pa.Table.from_arrays([pa.array(ids[heads], pa.int64()), near, v, seen], names=["node_id", "near", "v", "seen"])

    def ask_on(batches):  # noqa: ANN001, ANN202
        ix = index.value
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                ids, x = part.column(0).to_numpy(), matrix(part.column(1), WIDTH)
                probed = np.frombuffer(b"".join(part.column(2).to_pylist()), "<i4").reshape(len(x), -1)
                least = part.column(3).to_numpy()
                e = ix.nearer(x, np.maximum(least, floor), probed)
                few = np.sort(e, axis=1)
                n = (np.cumsum(few, axis=1, dtype=np.float64) <= MISSED).sum(1)
                bar = np.where(n > 0, few[np.arange(len(x)), n - 1], 0).astype(np.float32)
                want = e > bar[:, None]
                sends = np.zeros((len(x), wide.max() + 1), bool)
                row, number = np.nonzero(want)
                sends[row, wide[number]] = True
                r, to = np.nonzero(sends)
                # Which of a block's groups, as bits.
                bits = np.zeros((len(r), most_bytes), np.uint8)
                for j in range(wide.max() + 1):
                    here = to == j
                    packed = np.packbits(want[r[here]][:, wide == j], axis=1)
                    bits[here, : packed.shape[1]] = packed
                info = np.concatenate([least[r].astype("<f4").view(np.uint8).reshape(len(r), 4), bits], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(ids[r] % chunks, pa.int32()), pa.array(ids[r], pa.int64()), pa.array(np.full(len(r), -1), pa.int32()), binary(x[r]), binary(info)], names=["g", "salt", "node_id", "own", "v", "info"])

    def base_of(batches):  # noqa: ANN001, ANN202
        ix = index.value
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                ids, x = part.column(0).to_numpy(), matrix(part.column(1), WIDTH)
                own = ix.group[ix.probes(x, 1)[:, 0]]
                for s in range(chunks):
                    yield pa.RecordBatch.from_arrays([pa.array(wide[own], pa.int32()), pa.array(np.full(len(x), s), pa.int32()), pa.array(ids), pa.array(own, pa.int32()), part.column(1), pa.nulls(len(x), pa.binary())], names=["g", "salt", "node_id", "own", "v", "info"])

    def answer_on(key, table):  # noqa: ANN001, ANN202
        ids, own = table.column("node_id").to_numpy(), table.column("own").to_numpy()
        _, first = np.unique(np.stack([ids, (own >= 0).astype(np.int64)], 1), axis=0, return_index=True)
        x, ids, own = matrix(table.column("v"), WIDTH)[first], ids[first], own[first]
        asks = np.flatnonzero(own < 0)
        least = np.full(len(ids), 9, np.float32)
        here = np.flatnonzero(wide == key[0].as_py())
        local = np.zeros(len(wide), np.int64)
        local[here] = np.arange(len(here))
        wants = np.zeros((len(ids), len(here)), bool)
        if len(asks):
            raw = np.frombuffer(b"".join(table.column("info").take(pa.array(first[asks])).to_pylist()), np.uint8).reshape(len(asks), -1)
            least[asks] = np.ascontiguousarray(raw[:, :4]).view("<f4")[:, 0]
            wants[asks] = np.unpackbits(raw[:, 4:], axis=1)[:, : len(here)].astype(bool)
        q, c, s = further(ids, x, np.where(own >= 0, local[own], -1), wants, least - 1e-6, k + 1)
        heads, _, near = _listed(ids, q, c, s)
        return pa.Table.from_arrays([pa.array(ids[heads], pa.int64()), near], names=["node_id", "near"])

    rows = "g int, salt int, node_id long, own int, v binary, info binary"
    parts = ready.mapInArrow(assign, rows).groupBy("g", "salt").applyInArrow(answer, f"{found}, v binary, seen binary")

    def best(of: str):  # noqa: ANN202
        return F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(of)))), 1, k + 1)

    turned = F.transform("near", lambda x: F.struct((-x["s"]).alias("d"), x["c"].alias("c")))
    merged = written(parts.withColumn("near", turned).groupBy("node_id").agg(best("near").alias("near"), F.max("v").alias("v"), F.max("seen").alias("seen")), "first")
    lacking = merged.where("v is not null")
    n_lacking = lacking.count()
    if n_lacking:
        chunks = -(-n_lacking // ASKERS)
        most_bytes = -(-int(np.bincount(wide).max()) // 8)
        least = F.coalesce(-F.try_element_at("near", F.lit(k))["d"], F.lit(-1.0)).cast("float")
        asking = lacking.select("node_id", "v", "seen", least.alias("least")).mapInArrow(ask_on, rows)
        both = ready.select("node_id", "v").mapInArrow(base_of, rows).unionByName(asking)
        more = both.groupBy("g", "salt").applyInArrow(answer_on, found).withColumn("near", turned)
        mended = lacking.select("node_id", "near").unionByName(more).groupBy("node_id").agg(best("near").alias("near"))
        merged = merged.where("v is null").select("node_id", "near").unionByName(mended)
    merged = merged.select("node_id", "near").where(F.size("near") > 0)
    if n_copies:
        # Copies: their representative's list with itself added, without themselves.
        merged = written(merged, "merged")
        own = copies.where("node_id <> rep")
        lists_ = merged.withColumnRenamed("node_id", "rep").join(own, "rep").select("node_id", F.array_sort(F.array_append(F.filter("near", lambda x: x["c"] != F.col("node_id")), F.struct(F.lit(-1.0).cast("float").alias("d"), F.col("rep").alias("c")))).alias("near"))
        merged = merged.unionByName(lists_)
    out = merged.select("node_id", F.posexplode(F.slice("near", 1, k)).alias("rank", "x"))
    return out.select("node_id", (F.col("rank") + 1).alias("rank"), F.col("x.c").alias("neighbour"), (-F.col("x.d")).cast("double").alias("similarity"))


def near_pairs(nodes: DataFrame, least: float = 0.8, k: int = K) -> DataFrame:
    """node_a < node_b of at least that similarity, of which one is among the k most similar of the other."""
    near = nearest(nodes, k, floor=least).where(F.col("similarity") >= least - 1e-7)
    return near.select(F.least("node_id", "neighbour").alias("node_a"), F.greatest("node_id", "neighbour").alias("node_b")).distinct()
