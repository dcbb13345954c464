"""Exact n-gram Jaccard join: which documents' shingle sets are at least 3/4 alike.

Jaccard distance is a metric, so a set belongs to the Voronoi region of its nearest pivot and
only sets within a triangle-inequality window of a region's border need a second copy.

* The first pivots are the single shingles. A set's distance to {s} is below 1 only if it holds
  s, so regions are the shingles' lists. All of a set's shingles are equally near pivots; the
  window that keeps a join exact is its rarest few (overlap >= 3/4 n leaves n/4 others).
  A shingle that no other set holds makes an empty region, and a set of which fewer than 3/4 are
  shared can link to nothing; both leave here, before any pair is looked at.
* Sets that such regions connect form neighbourhoods. Each is joined around pivots chosen far apart from its
  sets: each set goes to its nearest pivot and to each other that is at most 2 * 1/4 farther. A region is then
  translated by its core, the shingles that most of its sets hold: what is left of each set says which sets link for being near
  the core, and which parts of the region can still hold links. These are joined in the same way, down to nothing.
* Only components are asked for, so sets that are already connected are not compared again,
  and equal sets are one set from the start: copies cost their own row and no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm import kernels as K
from tidelog.llm import links
from tidelog.llm.runtime import batched, cut, parts

WORDS = 5
#: Link when NUM * union <= DEN * intersection.
NUM, DEN = 3, 4
#: Pivots of a region.
PIVOTS = 8
#: Bytes of shingles that one task joins at most; a larger group is parted over tasks first.
GROUP_BYTES = 48 << 20
#: Bytes of pivots that are broadcast together.
PIVOT_BYTES = 32 << 20
LOW48 = np.uint64((1 << 48) - 1)


def _sets(texts: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, node of each text, set sizes, all sets' sorted shingles, their bounds)."""
    for first, last, raw, off in K.chunks(texts):
        hashes, bounds = K.grams(*K.words(raw, off, K.SPACED), words)
        hashes = hashes >> np.uint64(16)
        each = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        size = np.array([len(x) for x in each], np.int64)
        flat = np.concatenate(each) if each else np.zeros(0, K.U)
        ends = np.concatenate([[0], np.cumsum(size)])
        sums = np.concatenate([np.zeros(1, K.U), np.cumsum(K.mix(flat))])
        node = K.mix(sums[ends[1:]] - sums[ends[:-1]] + size.astype(K.U) * np.uint64(K.BASE)).view(np.int64)
        yield first, node, size, flat, ends


def _pack(region: np.ndarray, owner: np.ndarray, node: np.ndarray, size: np.ndarray, token: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """A blob for each region: its nodes, their set sizes, how many tokens of each, the 48-bit tokens."""
    order = np.lexsort((owner, region)) if len(region) else np.zeros(0, np.int64)
    region, owner, token = region[order], owner[order], token[order]
    cuts = np.flatnonzero(np.diff(region)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(region)], strict=True):
        if a == b:
            continue
        own, count = np.unique(owner[a:b], return_counts=True)
        head = np.array([len(own)], np.int64)
        body = token[a:b].reshape(-1, 1).view(np.uint8).reshape(-1, 8)[:, :6]
        yield int(region[a]), b"".join(x.tobytes() for x in (head, node[own], size[own].astype(np.int32), count.astype(np.int32), body))


def _unpack(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """nodes, sizes, tokens and each token's index of a node, each node once."""
    nodes, sizes, counts, tokens = [], [], [], []
    for x in blobs:
        b = x.as_buffer()
        n = int(np.frombuffer(b, np.int64, 1)[0])
        nodes.append(np.frombuffer(b, np.int64, n, 8))
        sizes.append(np.frombuffer(b, np.int32, n, 8 + 8 * n))
        counts.append(np.frombuffer(b, np.int32, n, 8 + 12 * n))
        low = np.frombuffer(b, np.uint8, -1, 8 + 16 * n).reshape(-1, 6)
        wide = np.zeros((len(low), 8), np.uint8)
        wide[:, :6] = low
        tokens.append(wide.view(K.U).ravel())
    node, size, count, token = (np.concatenate(x) for x in (nodes, sizes, counts, tokens))
    owner = np.repeat(np.arange(len(node)), count)
    unique, first, inverse = np.unique(node, return_index=True, return_inverse=True)
    keep = (first[inverse] == np.arange(len(node)))[owner]
    return unique, size[first], token[keep], inverse[owner[keep]]


def _shared(table: pa.Table, buckets: int) -> pa.Table:
    """A region's tokens that two or more sets hold, each with how many hold it: by buckets of sets."""
    node, size, token, owner = _unpack(table.column("blob").combine_chunks())
    order = np.argsort(token)
    token, owner = token[order], owner[order]
    begins = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    held = np.repeat(np.diff(np.append(begins, len(token))), np.diff(np.append(begins, len(token))))
    keep = held > 1
    packed = token[keep] | (np.minimum(held[keep], 65535).astype(K.U) << np.uint64(48))
    owner = owner[keep]
    order = np.argsort(owner, kind="stable")
    owner, packed = owner[order], packed[order]
    own, first, count = np.unique(owner, return_index=True, return_counts=True)
    bucket = (node[own].view(K.U) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    own, first, count, bucket = own[order], first[order], count[order], bucket[order]
    ends = np.cumsum(count)
    packed = packed[np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(own)] if len(own) else [0]
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        low, high = ends[a] - count[a], ends[b - 1]
        rows.append((int(bucket[a]), node[own[a:b]].tobytes(), size[own[a:b]].astype(np.int64).tobytes(), count[a:b].astype(np.int64).tobytes(), packed[low:high].tobytes()))
    columns = list(zip(*rows, strict=True)) or [[], [], [], [], []]
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table({k: pa.array(c, t) for k, c, t in zip(("bucket", "nodes", "sizes", "counts", "tokens"), columns, kinds, strict=True)})


def _able(table: pa.Table) -> pa.Table:
    """The sets of a bucket of nodes of which at least 3/4 are shared, each with its shared tokens."""
    node, size, count, token = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table.column(c).combine_chunks()]) for c, t in (("nodes", np.int64), ("sizes", np.int64), ("counts", np.int64), ("tokens", K.U)))
    unique, first, inverse = np.unique(node, return_index=True, return_inverse=True)
    shared = np.zeros(len(unique), np.int64)
    np.add.at(shared, inverse, count)
    able = DEN * shared >= NUM * size[first]
    owner = np.repeat(inverse, count)
    keep = able[owner]
    owner, token = owner[keep], token[keep]
    order = np.argsort(owner, kind="stable")
    token = token[order]
    ends = np.cumsum(shared[able])
    blobs = [token[e - n : e].tobytes() for e, n in zip(ends.tolist(), shared[able].tolist(), strict=True)]
    return pa.table({"node": pa.array(unique[able], pa.int64()), "n": pa.array(size[first][able], pa.int64()), "blob": pa.array(blobs, pa.binary())})


def _prefix(node: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], regions: int) -> Iterator[tuple[int, bytes]]:
    """The rarest tokens of each set that the overlap of a link cannot do without, by region."""
    picked = []
    for n, packed in zip(sizes, sets, strict=True):
        must = -(-NUM * int(n) // DEN)
        length = len(packed) - must + 1
        picked.append(np.sort(packed)[:length] & LOW48)  # how many hold it comes first in the order
    owner = np.repeat(np.arange(len(node)), [len(x) for x in picked])
    token = np.concatenate(picked) if picked else np.zeros(0, K.U)
    yield from _pack((token % np.uint64(regions)).astype(np.int64), owner, node, sizes, token)


def _near(table: pa.Table) -> pa.Table:
    """Edges between a region's sets that a token and their sizes allow to link: a star in each run of sizes."""
    node, size, token, owner = _unpack(table.column("blob").combine_chunks())
    n = size[owner].astype(np.int64)
    order = np.lexsort((owner, n, token))
    token, owner, n = token[order], owner[order], n[order]
    same = (token[1:] == token[:-1]) & (DEN * n[:-1] >= NUM * n[1:])
    label = K.components(len(node), owner[:-1][same], owner[1:][same])
    moved = np.flatnonzero(label != np.arange(len(node)))
    return pa.table({"a": pa.array(node[moved], pa.int64()), "b": pa.array(node[label[moved]], pa.int64())})


class _Group:
    """Sets of a neighbourhood in one flat array, joined exactly around pivots.

    Two sets link when 7 * |A ^ B| <= |A| + |B|. The symmetric difference is a metric that a translation keeps: with D = A ^ core,
    |A ^ B| is |D(A) ^ D(B)|, and what all sets of a region share is gone from the D.
    """

    def __init__(self, size: np.ndarray, sets: list[np.ndarray]):
        self.size = size.astype(np.int64)
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.flat = flat
        self.bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        self.label = np.arange(len(sets))
        self.mark = np.zeros(int(flat.max()) + 1 if len(flat) else 1, bool)
        self.counts = {"pivots": 0, "regions": 0, "copies": 0, "compared": 0}

    def tokens(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of the members, and each token's index in members."""
        n = self.bounds[members + 1] - self.bounds[members]
        ends = np.cumsum(n)
        at = np.repeat(self.bounds[members] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[at], np.repeat(np.arange(len(members)), n)

    def alike(self, one: int, rest: np.ndarray) -> np.ndarray:
        """Size of the intersection of one set with each of the rest."""
        own = self.flat[self.bounds[one] : self.bounds[one + 1]]
        self.mark[own] = True
        token, owner = self.tokens(rest)
        both = np.bincount(owner[self.mark[token]], minlength=len(rest))
        self.mark[own] = False
        return both

    def unite(self, one: int, many: np.ndarray) -> None:
        old = np.unique(self.label[np.append(many, one)])
        if len(old) > 1:
            self.label[np.isin(self.label, old)] = old[0]

    def one_label(self, members: np.ndarray) -> bool:
        return bool((self.label[members] == self.label[members[0]]).all()) if len(members) else True

    def linked(self, one: int, rest: np.ndarray, both: np.ndarray) -> np.ndarray:
        return DEN * both >= NUM * (self.size[one] + self.size[rest] - both)

    def voronoi(self, members: np.ndarray) -> list[np.ndarray]:
        """Regions of pivots far from each other; the pivots' own links are found here, so the regions hold the other sets.

        A set goes to its nearest pivot and to each pivot that is at most 2 * 1/4 farther: of two sets that link, each is in the other's region.
        """
        near, far, pivots, one = np.full(len(members), np.inf), [], [], members[0]
        while len(pivots) < PIVOTS:
            both = self.alike(one, members)
            far.append(1 - both / (self.size[one] + self.size[members] - both))
            self.unite(one, members[self.linked(one, members, both)])
            pivots.append(one)
            near = np.minimum(near, far[-1])
            near[members == one] = -1
            if near.max() < 0 or self.one_label(members):
                break
            one = members[near.argmax()]
        self.counts["pivots"] += len(pivots)
        rest = ~np.isin(members, pivots)
        members, far = members[rest], np.stack(far)[:, rest]
        if len(members) < 2 or self.one_label(members):
            return []
        limit, home = far.min(0) + 2 * (1 - NUM / DEN) + 1e-9, far.argmin(0)
        regions = [members[far[j] <= limit] for j in np.unique(home)]
        if 2 * max(map(len, regions)) > len(members) or sum(map(len, regions)) > 2 * len(members):
            regions = [members]  # nearly as far from each pivot: one region, whose pivot is its core
        self.counts["regions"] += len(regions)
        self.counts["copies"] += sum(map(len, regions))
        return [r for r in regions if len(r) > 1]

    def translated(self, members: np.ndarray) -> list[np.ndarray]:
        """The parts of a region in which links can still be, after a translation by its core (the tokens of most sets).

        With f(A) = 7 |D(A)| - |A|, sets with f(A) + f(B) <= 0 link, since both are so near the core; all such pairs hang together
        over the set of least f. Any other link needs (f(A) + f(B)) / 14 common tokens of the D, so a rare one among the first of both.
        """
        token, owner = self.tokens(members)
        core = np.flatnonzero(np.bincount(token, minlength=len(self.mark)) * 2 > len(members))
        place = np.full(len(self.mark), -1)
        place[core] = np.arange(len(core))
        inside = place[token] >= 0
        held = np.zeros((len(members), len(core)), bool)
        held[owner[inside], place[token[inside]]] = True
        lacks, lacking = np.nonzero(~held)
        apart = self.size[members] + len(core) - 2 * held.sum(1)
        f = 7 * apart - self.size[members]
        least = f.argmin()
        self.unite(members[least], members[f <= -f[least]])
        token, owner = np.concatenate([token[~inside], core[lacking]]), np.concatenate([owner[~inside], lacks])
        often = np.bincount(token, minlength=len(self.mark))[token]
        token, owner, often = token[often > 1], owner[often > 1], often[often > 1]
        shared = np.bincount(owner, minlength=len(members))
        first = apart - np.maximum(1, -(-(f + f[least]) // 14)) + 1 - (apart - shared)  # tokens that no other set has come first
        order = np.lexsort((token, often, owner))
        token, owner = token[order], owner[order]
        rank = np.arange(len(owner)) - (np.cumsum(shared) - shared)[owner]
        token, owner = token[rank < first[owner]], owner[rank < first[owner]]
        order = np.lexsort((self.size[members[owner]], token))
        token, owner = token[order], owner[order]
        n = self.size[members[owner]]
        same = (token[1:] == token[:-1]) & (DEN * n[:-1] >= NUM * n[1:])
        part = K.components(len(members), owner[:-1][same], owner[1:][same])
        order = np.argsort(part, kind="stable")
        parts = [p for p in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(p) > 1]
        out = []
        for p in parts:
            if 5 * len(p) <= 4 * len(members):
                out.append(members[p])
            elif not self.one_label(members[p]):
                own = np.isin(owner, p)
                self.compared(members, token[own], owner[own], p[np.argsort(f[p], kind="stable")])
        return out

    def compared(self, members: np.ndarray, token: np.ndarray, owner: np.ndarray, order: np.ndarray) -> None:
        """Sets that share one of their first tokens and are not connected yet, compared one by one."""
        begins = np.flatnonzero(np.concatenate([np.ones(min(1, len(token)), bool), token[1:] != token[:-1]]))
        run = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(token))))
        of = np.argsort(owner, kind="stable")
        starts = np.searchsorted(owner[of], np.arange(len(members) + 1))
        ends, place = np.append(begins, len(token)), np.empty(len(members), np.int64)
        place[order] = np.arange(len(order))
        for i in order:
            runs = run[of[starts[i] : starts[i + 1]]]
            near = np.unique(np.concatenate([owner[ends[r] : ends[r + 1]] for r in runs])) if len(runs) else runs
            near = near[(place[near] < place[i]) & (self.label[members[near]] != self.label[members[i]])]
            one, rest = members[i], members[near]
            low, high = np.minimum(self.size[rest], self.size[one]), np.maximum(self.size[rest], self.size[one])
            rest = rest[DEN * low >= NUM * high]
            if len(rest):
                self.counts["compared"] += len(rest)
                self.unite(one, rest[self.linked(one, rest, self.alike(one, rest))])

    def join(self) -> np.ndarray:
        todo = [np.arange(len(self.size))]
        while todo:
            members = todo.pop()
            if not self.one_label(members):
                for region in self.voronoi(members):
                    if not self.one_label(region):
                        todo += self.translated(region)
        return self.label


def _group_of(table: pa.Table) -> tuple[np.ndarray, _Group]:
    node = table.column("node").to_numpy()
    order = np.argsort(node)
    blobs = table.column("blob")
    sets = [np.frombuffer(blobs[int(i)].as_buffer(), K.U) & LOW48 for i in order]
    return node[order], _Group(table.column("n").to_numpy()[order], sets)


def _joined(table: pa.Table) -> pa.Table:
    """(node, root) of one group of sets."""
    node, group = _group_of(table)
    return pa.table({"node": pa.array(node, pa.int64()), "root": pa.array(node[group.join()], pa.int64())})


def _counted(table: pa.Table) -> pa.Table:
    """How one group of sets was joined: sets, components, and what _Group counts."""
    node, group = _group_of(table)
    label = group.join()
    found = {"sets": len(node), "components": len(np.unique(label)), **group.counts}
    return pa.table({k: pa.array([v], pa.int64()) for k, v in found.items()})


def shingle_sets(docs: DataFrame, words: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, node, n_shingles): documents with equal sets have equal nodes; an empty set has size 0."""

    def scan(batches):
        for b in batches:
            for first, node, size, _, _ in _sets(b.column(1), words):
                yield pa.record_batch({"key": b.column(0).slice(first, len(node)), "node": pa.array(node), "n_shingles": pa.array(size)})

    kind = docs.schema[key].dataType.simpleString()
    return batched(docs.select(key, text)).mapInArrow(scan, f"key {kind}, node long, n_shingles long").withColumnRenamed("key", key)


def _pivot_tables(rows: DataFrame, ranks: DataFrame) -> Iterator[dict]:
    """Pivot sets of groups, {group: (nodes, sizes, sets, component of each)}, at most PIVOT_BYTES at a time."""
    picked = rows.join(ranks, ["g", "node"]).select("g", "node", "n", "blob").distinct().orderBy("g", "node")
    found: dict = {}
    held = 0
    for r in picked.toLocalIterator():
        if held > PIVOT_BYTES and r["g"] not in found:
            yield found
            found, held = {}, 0
        found.setdefault(r["g"], []).append((r["node"], r["n"], np.frombuffer(bytes(r["blob"]), K.U) & LOW48))
        held += len(r["blob"])
    if found:
        yield found


def _parted(rows: DataFrame) -> DataFrame:
    """One round of Voronoi regions for groups (g, node, n, blob) that are too large for one task.

    Rows with b are links (node, b) of a set to a pivot. Rows without are a region's members: parent, g, node, n,
    blob, and settled, the pivots' component that links already put the set into (-1: none).
    """
    near = Window.partitionBy("g").orderBy(F.xxhash64("node"), "node")
    ranks = rows.select("g", "node").distinct().withColumn("r", F.row_number().over(near)).where(F.col("r") <= PIVOTS).select("g", "node")
    schema = "parent long, g long, node long, n long, blob binary, settled int, b long"
    share = rows.sparkSession.sparkContext.broadcast
    out = None
    for table in _pivot_tables(rows, ranks):
        one = {}
        for g, sets in table.items():
            joined = _Group(np.array([n for _, n, _ in sets]), [x for _, _, x in sets])
            joined.join()
            one[g] = ([x[0] for x in sets], [x[1] for x in sets], [np.sort(x[2]) for x in sets], joined.label)
        shared = share(one)

        def part(batches, shared=shared):
            for b in batches:
                made = []
                for g, node, n, blob in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    if g not in shared.value:
                        continue
                    pivots, sizes, sets, label = shared.value[g]
                    own = np.frombuffer(blob, K.U) & LOW48
                    both = np.array([(x[np.minimum(np.searchsorted(x, own), len(x) - 1)] == own).sum() for x in sets])
                    union = np.array(sizes) + n - both
                    far, linked = 1 - both / union, DEN * both >= NUM * union
                    settled = int(label[linked.argmax()]) if linked.any() else -1
                    made += [(None, None, node, None, None, None, p) for p, k in zip(pivots, linked, strict=True) if k and p != node]
                    for j in np.flatnonzero(far <= far.min() + 2 * (1 - NUM / DEN) + 1e-9):
                        region = int(K.mix(np.array([g], np.int64).view(K.U) + np.uint64(j + 1)).view(np.int64)[0])
                        made.append((g, region, node, n, blob, settled, None))
                columns = list(zip(*made, strict=True)) or [[]] * 7
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["parent", "g", "node", "n", "blob", "settled", "b"])

        done = batched(rows.select("g", "node", "n", "blob")).mapInArrow(part, schema)
        out = done if out is None else out.union(done)
    return cut(out)


def _by_core(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (g, node, n, blob) that are too large for one task, translated by their cores as _Group.translated does.

    Returns the links (a, b) of the sets that are so near a core that they link for it, and the rows in new groups:
    the parts in which links can still be. Rows without such a part are left out.
    """
    regions = parts(rows.sparkSession)

    def count(batches):
        for b in batches:
            g = b.column(0).to_numpy()
            token = np.concatenate([np.frombuffer(x.as_buffer(), K.U) for x in b.column(1)]) if len(g) else np.zeros(0, K.U)
            owner = np.repeat(g, [len(x.as_buffer()) // 8 for x in b.column(1)])
            order = np.lexsort((token, owner))
            token, owner = token[order], owner[order]
            first = np.flatnonzero(np.concatenate([np.ones(min(1, len(token)), bool), (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])]))
            yield pa.record_batch({"g": pa.array(owner[first]), "token": pa.array(token[first].view(np.int64)), "held": pa.array(np.diff(np.append(first, len(token))))})

    held = batched(rows.select("g", "blob")).mapInArrow(count, "g long, token long, held long").groupBy("g", "token").agg(F.sum("held").alias("held"))
    most = held.join(rows.groupBy("g").agg(F.count("*").alias("sets")), "g").where("2 * held > sets")
    cores = most.groupBy("g").agg(F.array_sort(F.collect_list("token")).alias("core"))  # at most twice the tokens of a group's mean set

    def translate(batches):
        for b in batches:
            f, blobs, cores_of = [], [], {}
            for g, n, blob, core in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3), b.column(4), strict=True):
                if g not in cores_of:
                    cores_of[g] = core.values.to_numpy().view(K.U) if core.is_valid else np.zeros(0, K.U)
                own = np.frombuffer(blob.as_buffer(), K.U)
                left = np.setxor1d(own, cores_of[g], assume_unique=True)
                f.append(7 * (len(left) + n - len(own)) - n)
                blobs.append(left.tobytes())
            key = K.mix(b.column(1).to_numpy().view(K.U) + K.mix(b.column(0).to_numpy().view(K.U)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(key.view(np.int64)), pa.array(f, pa.int64()), pa.array(blobs, pa.binary())], ["g", "node", "n", "key", "f", "left"])

    moved = batched(rows.join(cores, "g", "left").select("g", "node", "n", "blob", "core")).mapInArrow(translate, "g long, node long, n long, key long, f long, left binary")
    moved = cut(moved)
    least = moved.groupBy("g").agg(F.min(F.struct("f", "node")).alias("least"))
    moved = moved.join(least, "g")
    star = moved.where("f <= -least.f").select(F.col("node").alias("a"), F.col("least.node").alias("b"))

    def rare(batches):
        for b in batches:
            g, key, n, f, least = (b.column(i).to_numpy() for i in (0, 1, 2, 3, 5))
            sets = [np.frombuffer(x.as_buffer(), K.U) for x in b.column(4)]
            need = np.maximum(1, -(-(f + least) // 14))
            picked = [np.sort(x)[: max(0, len(x) - int(k) + 1)] & LOW48 for x, k in zip(sets, need, strict=True)]  # how many hold a token comes first
            owner = np.repeat(np.arange(len(key)), [len(x) for x in picked])
            token = np.concatenate(picked) if picked else np.zeros(0, K.U)
            token = K.mix(token + K.mix(g.view(K.U))[owner]) >> np.uint64(16)  # each group has its own
            out = list(_pack((token % np.uint64(regions)).astype(np.int64), owner, key, n, token))
            if out:
                yield pa.record_batch({"region": pa.array([x[0] for x in out], pa.int32()), "blob": pa.array([x[1] for x in out], pa.binary())})

    listed = batched(moved.select("g", "key", "n", "f", "left", F.col("least.f").alias("least"))).mapInArrow(rare, "region int, blob binary")
    groups = links.components(listed.groupBy("region").applyInArrow(_near, "a long, b long")).toDF("key", "root")
    named = moved.select("g", "node", "key").join(groups, "key").select("g", "node", "root")
    return star, rows.join(named, ["g", "node"]).select(F.col("root").alias("g"), "node", "n", "blob")


def _in_blocks(rows: DataFrame, sizes: DataFrame, group_bytes: int) -> DataFrame:
    """Regions that pivots do not part, as pairs of blocks that each fit a task.

    Most sets of such a region are settled in one component and need not meet each other: they are dealt once over
    blocks, each of which meets the blocks of the other sets.
    """
    half = max(1, group_bytes // 2)
    rows = rows.join(sizes.select("g", "mode", F.ceil(F.col("loose") / half).cast("int").alias("nu"), F.greatest(F.lit(1), F.ceil((F.col("bytes") - F.col("loose")) / half)).cast("int").alias("nl")), "g")
    rows = rows.withColumn("loose", F.col("settled") != F.col("mode")).withColumn("at", F.pmod(F.xxhash64("node"), F.when(F.col("loose"), F.col("nu")).otherwise(F.col("nl"))).cast("int"))
    own = F.transform(F.sequence(F.lit(0), F.col("nu") - 1), lambda j: F.struct(F.lit(0).alias("kind"), F.least("at", j).alias("x"), F.greatest("at", j).alias("y")))
    with_settled = F.transform(F.sequence(F.lit(0), F.col("nl") - 1), lambda k: F.struct(F.lit(1).alias("kind"), F.col("at").alias("x"), k.alias("y")))
    settled = F.transform(F.sequence(F.lit(0), F.col("nu") - 1), lambda i: F.struct(F.lit(1).alias("kind"), i.alias("x"), F.col("at").alias("y")))
    pairs = F.explode(F.when(F.col("loose"), F.concat(own, with_settled)).otherwise(settled))
    return rows.withColumn("pair", pairs).select(F.xxhash64("g", "pair.kind", "pair.x", "pair.y").alias("g"), "node", "n", "blob")


def _large(rows: DataFrame, group_bytes: int) -> DataFrame:
    """Links (a, b) that connect the sets of large groups (g, node, n, blob) as all their links would."""
    found = None

    def keep(edges: DataFrame) -> None:
        nonlocal found
        found = edges if found is None else found.union(edges)

    def local(groups: DataFrame) -> None:
        keep(groups.select("g", "node", "n", "blob").groupBy("g").applyInArrow(_joined, "node long, root long").toDF("a", "b"))

    size = F.length("blob").cast("long")
    while True:
        star, rows = _by_core(cut(rows))
        keep(star)
        rows = cut(rows)
        parent = rows.groupBy(F.col("g").alias("parent")).agg(F.sum(size).alias("whole"))
        local(rows.join(parent.where(F.col("whole") <= group_bytes).select(F.col("parent").alias("g")), "g"))
        rows = rows.join(parent.where(F.col("whole") > group_bytes).select(F.col("parent").alias("g")), "g", "left_semi")
        if rows.isEmpty():
            return found
        done = _parted(rows)
        keep(done.where("b is not null").select(F.col("node").alias("a"), "b"))
        members = done.where("b is null").drop("b")
        sizes = members.groupBy("g", "parent").agg(F.sum(size).alias("bytes"), F.mode("settled", True).alias("mode"), F.min("settled").alias("low"), F.max("settled").alias("high"))
        # a region whose sets are all in one component already needs no look
        sizes = cut(sizes.where("low <> high or low = -1").join(parent, "parent"))
        small = sizes.where(F.col("bytes") <= group_bytes).select("g")
        local(members.join(small, "g"))
        stuck = sizes.where((F.col("bytes") > group_bytes) & (F.col("bytes") > 0.9 * F.col("whole"))).select("g", "bytes", "mode")
        loose = members.join(stuck, "g").groupBy("g").agg(F.sum(F.when(F.col("settled") != F.col("mode"), size).when(F.col("mode") == -1, size).otherwise(0)).alias("loose"))
        stuck = stuck.join(loose, "g").where("loose > 0").withColumn("mode", F.when(F.col("mode") == -1, -2).otherwise(F.col("mode")))
        local(_in_blocks(members.join(stuck.select("g"), "g", "left_semi"), stuck, group_bytes))
        going = sizes.where((F.col("bytes") > group_bytes) & (F.col("bytes") <= 0.9 * F.col("whole"))).select("g")
        if going.isEmpty():
            return found
        rows = members.join(going, "g", "left_semi").select("g", "node", "n", "blob")


def neighbourhoods(docs: DataFrame, words: int = WORDS, text: str = "text") -> DataFrame:
    """(g, node, n, bytes, blob): distinct sets that may link to another one, by the neighbourhood g in which all their links are.

    n is a set's size, blob its tokens that other sets have too, each behind how many have it, bytes the blob's length.
    """
    regions = parts(docs.sparkSession)

    def deal(batches):
        seen: set[int] = set()  # equal sets leave a task once
        for b in batches:
            for _, node, size, flat, ends in _sets(b.column(0), words):
                fresh = np.zeros(len(node), bool)
                for i, x in enumerate(node.tolist()):
                    if size[i] and x not in seen:
                        seen.add(x)
                        fresh[i] = True
                owner = np.repeat(np.arange(len(node)), size)
                keep = fresh[owner]
                token, owner = flat[keep], owner[keep]
                out = list(_pack((token % np.uint64(regions)).astype(np.int64), owner, node, size, token))
                if out:
                    yield pa.record_batch({"region": pa.array([x[0] for x in out], pa.int32()), "blob": pa.array([x[1] for x in out], pa.binary())})

    def rarest(batches):
        for b in batches:
            size = b.column(1).to_numpy()
            out = list(_prefix(b.column(0).to_numpy(), size, [np.frombuffer(x.as_buffer(), K.U) for x in b.column(2)], regions))
            if out:
                yield pa.record_batch({"region": pa.array([x[0] for x in out], pa.int32()), "blob": pa.array([x[1] for x in out], pa.binary())})

    dealt = batched(docs.select(text)).mapInArrow(deal, "region int, blob binary")
    held = dealt.groupBy("region").applyInArrow(lambda t: _shared(t, regions), "bucket int, nodes binary, sizes binary, counts binary, tokens binary")
    able = held.groupBy("bucket").applyInArrow(_able, "node long, n long, blob binary")
    able = cut(able)
    near = able.mapInArrow(rarest, "region int, blob binary").groupBy("region").applyInArrow(_near, "a long, b long")
    groups = links.components(near).select("node", F.col("root").alias("g"))
    # bytes is taken before the join, so that who asks for it alone moves no blobs; the same join at every size
    return able.withColumn("bytes", F.length("blob").cast("long")).join(groups.hint("merge"), "node").select("g", "node", "n", "bytes", "blob")


def join_counts(docs: DataFrame, words: int = WORDS, text: str = "text") -> DataFrame:
    """How each neighbourhood is joined: sets, components, pivots, regions, copies (sets in regions) and compared (pairs looked at beside the pivots')."""
    schema = "sets long, components long, pivots long, regions long, copies long, compared long"
    return neighbourhoods(docs, words, text).drop("bytes").groupBy("g").applyInArrow(_counted, schema)


def linked_sets(docs: DataFrame, words: int = WORDS, text: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(node, root) of the sets that link to another one; root is the smallest node of a component."""
    members = neighbourhoods(docs, words, text)
    weights = members.groupBy("g").agg(F.sum("bytes").alias("bytes"))
    large = cut(weights.where(F.col("bytes") > group_bytes).select("g"))
    members = members.drop("bytes")
    if large.isEmpty():
        return members.groupBy("g").applyInArrow(_joined, "node long, root long")
    small = members.join(large, "g", "left_anti").groupBy("g").applyInArrow(_joined, "node long, root long")
    return links.components(small.toDF("a", "b").union(_large(members.join(large, "g", "left_semi"), group_bytes)))


def near_duplicates(docs: DataFrame, words: int = WORDS, key: str = "doc_id", text: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row for each document: key, n_shingles, component_id (the smallest key that links reach).

    Two documents link when their sets of `words`-word shingles are at least 3/4 alike. Null and
    wordless texts have empty sets and are their own component; a text of fewer words is one
    shingle. Groups of more than group_bytes of shingles are joined by several tasks. Equal texts link at any size. Rows that repeat are kept; a null key never is a component's name
    unless it has no other. An empty table gives an empty one. Other columns are not read.
    """
    sets = cut(shingle_sets(docs, words, key, text))  # narrow, and read twice below
    root = cut(
        sets.join(linked_sets(docs, words, text, group_bytes), "node", "left").select(
            key, "n_shingles", F.coalesce("root", "node").alias("root")
        )
    )
    # written too: a join of two written tables on a root that many rows share can be split over tasks
    names = cut(root.where("n_shingles > 0").groupBy("root").agg(F.min(key).alias("name")))
    return root.join(names, "root", "left").select(
        key, "n_shingles", F.when(F.col("n_shingles") > 0, F.col("name")).otherwise(F.col(key)).alias("component_id")
    )
