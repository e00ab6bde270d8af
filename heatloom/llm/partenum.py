"""Exact Jaccard self-join of word-shingle sets by PartEnum signatures.

Sets are dealt into size bands so that similar sets lie in the same or in
neighbouring bands.  For a band with largest size u, two similar sets differ in at
most k = 2u (1 - t) / (1 + t) elements.  The element domain is cut by hash into
n1 = ceil((k + 1) / 2) partitions, and each of these into three: k differences
leave one partition with at most one, so two of its three parts are equal in both
sets.  The signatures of a set are therefore, for every partition, the three
choices of two parts (with their elements); similar sets share at least one.

With g partitions more, similar sets share at least g + 1 signatures, so each set may
drop the last g of its own in any order that both follow: those with the fewest
elements go.  They say least, and unrelated sets would meet in them (all sets without
an element in two parts share the empty signature).

What shares a signature is a candidate.  Parity sketches (one bit per hash bin)
reject candidates that differ in too many bins, without losing a similar pair: the
bins that differ are never more than the elements that differ.  The rest is
verified on whole sets, first along a spanning forest, then every pair between
different components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from heatloom.llm.common import chunks, slices, worker_store
from heatloom.llm.components import connected_components
from heatloom.llm.itq_dedup import runs_of
from heatloom.operators.rundir import n_tasks, stage

#: Words of a shingle, and the least similarity as a fraction.
WIDTH, SIMILAR, OF = 5, 80, 100
#: Signatures that one step of a task compares at a time, on average, and the least number of such groups.
GROUP_SIGNATURES, LEAST_GROUPS = 2_000_000, 32
#: Up to this many sets, all pairs that share a signature are candidates at once; beyond, see large_runs.
SMALL_RUN = 12
#: Members of a large run that meet in one task; larger runs are dealt out as pairs of blocks.
RUN_BLOCK = 4096
#: One partition more for each so many that are needed.
SPARE = 6
#: Most ids that are sent to every executor; more are joined by a shuffle.
BROADCAST_IDS = 400_000
#: Words whose hash a Python worker keeps.
KEEP_WORDS = 200_000
U = np.uint64
#: Odd multipliers of the hashes.
WORD_STEP = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]
MIX = [U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3)]


class WordHash(dict):
    """64-bit hash of a word; frequent words are looked up."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < KEEP_WORDS:
            self[word] = h
        return h


def mix(h: np.ndarray, which: int) -> np.ndarray:
    h = (h ^ (h >> U(32))) * MIX[which]
    return h ^ (h >> U(29))


def shingle_set(text: str, hashes: WordHash, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text."""
    words = text.encode().lower().split()  # bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return np.zeros(0, U)
    w = np.fromiter(map(hashes.__getitem__, words), U, len(words))
    m = min(width, len(words))
    h = np.full(len(words) - m + 1, m, U)
    for i in range(m):
        h += w[i : len(w) - m + 1 + i] * U(WORD_STEP[i % len(WORD_STEP)] + 2 * (i // len(WORD_STEP)))
    h = mix(h, 0)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def word_hashes() -> WordHash:
    return worker_store().setdefault("word hashes", WordHash())


def node_of(s: np.ndarray) -> bytes:
    """128-bit name of a set."""
    return mix(s, 1).sum(dtype=U).tobytes() + mix(s, 2).sum(dtype=U).tobytes()


def sketch_of(s: np.ndarray) -> bytes:
    """Parity of the number of elements in each of B bins, B the power of two from twice the size on."""
    bins = max(64, 2 << max(len(s) - 1, 1).bit_length())
    count = np.bincount((s & U(bins - 1)).astype(np.int64), minlength=bins)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(x: bytes, y: bytes) -> int:
    """A lower bound of the number of elements that are in one of two sets only."""
    if len(x) > len(y):
        x, y = y, x
    b, size = int.from_bytes(y, "little"), len(y) * 8
    while size > len(x) * 8:
        size //= 2
        b = (b >> size) ^ (b & ((1 << size) - 1))
    return (int.from_bytes(x, "little") ^ b).bit_count()


def most_apart(a: int, b: int, similar: int, of: int) -> int:
    """Elements that two similar sets of these sizes may have alone at most."""
    return (of - similar) * (a + b) // (of + similar)


def size_bands(largest: int, similar: int, of: int) -> list[int]:
    """Largest size of every band, up to one band above ``largest``."""
    ends = [0]
    while len(ends) < 2 or ends[-2] < largest:
        ends.append(max(ends[-1] + 1, (ends[-1] + 1) * of // similar))
    return ends


def signatures(sets: list[np.ndarray], similar: int, of: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature) of all sets, in the structures of their own band and of the next one."""
    size = np.array([len(s) for s in sets])
    ends = np.array(size_bands(int(size.max()), similar, of))
    own = np.searchsorted(ends, size)
    doc = np.repeat(np.arange(len(sets)), size)
    h = np.concatenate(sets)
    value = mix(h, 3)
    third = ((h & U(0x3FFFFFFF)) % U(3)).astype(np.int64)
    owner, out = [], []
    for band in (own, own + 1):
        k = (of - similar) * 2 * ends[band] // (of + similar)
        least = np.where(k == 0, 1, (k + 2) // 2)
        spare = least // SPARE
        n1 = least + spare
        base = np.concatenate([[0], np.cumsum(n1)])
        part = ((h >> U(34)) % n1[doc].astype(U)).astype(np.int64)
        slot = (base[doc] + part) * 3 + third
        total = np.zeros(int(base[-1]) * 3, U)
        np.add.at(total, slot, value)
        count = np.bincount(slot, minlength=len(total)).reshape(-1, 3)
        total = total.reshape(-1, 3)
        who = np.repeat(np.arange(len(sets)), n1)
        place = (np.arange(base[-1]) - base[who]).astype(U) * U(1 << 16) + band[who].astype(U)
        sigs, sizes = [], []
        for c, (x, y) in enumerate(((0, 1), (0, 2), (1, 2))):
            sigs.append(mix(mix(total[:, x], 1) * U(3) + mix(total[:, y], 2) + (place * U(3) + U(c)) * MIX[0], 3))
            sizes.append(count[:, x] + count[:, y])
        some = k[who] > 0
        # without differences the whole set is the one signature
        owner.append(who[~some])
        out.append(mix(total.sum(1, dtype=U) + place * MIX[1], 0)[~some])
        who3, sig = np.tile(who[some], 3), np.concatenate([x[some] for x in sigs])
        few = np.minimum(np.concatenate([x[some] for x in sizes]), 63).astype(U)
        order = np.argsort((who3.astype(U) << U(44)) | (few << U(38)) | (sig >> U(26)), kind="stable")
        who3, sig = who3[order], sig[order]
        first = np.searchsorted(who3, np.arange(len(sets)))
        keep = np.arange(len(who3)) - first[who3] >= spare[who3]
        owner.append(who3[keep])
        out.append(sig[keep])
    return np.concatenate(owner), np.concatenate(out)


def shingle_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, node (name of the set, equal for equal sets) and sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for b in batches:
            sets = [shingle_set(t.as_py() or "", hashes, width) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) for s in sets], pa.binary()),
                 pa.array([sketch_of(s) if len(s) else b"" for s in sets], pa.binary())],
                names=["doc_id", "n_shingles", "node", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, node binary, sketch binary")


def signature_rows(docs: DataFrame, groups: int, width: int, similar: int, of: int) -> DataFrame:
    """grp, node, n, sigs: the signatures of a set that fall into a group of the signature space, packed.

    A task names equal sets once, so copies do not multiply.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = word_hashes(), set()
        for b in slices(batches):
            for _, part in chunks(b.column(0).to_pylist()):
                sets, nodes = [], []
                for t in part:
                    s = shingle_set(t, hashes, width)
                    node = node_of(s)
                    if len(s) and node not in seen:
                        if len(seen) >= KEEP_WORDS:
                            seen.clear()
                        seen.add(node)
                        sets.append(s)
                        nodes.append(node)
                if not sets:
                    continue
                owner, sig = signatures(sets, similar, of)
                grp = ((sig >> U(40)) % U(groups)).astype(np.int64)
                key = owner * groups + grp
                order = np.argsort(key, kind="stable")
                key, sig = key[order], sig[order]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                at = key[first] // groups
                data = pa.py_buffer(sig.astype("<u8").tobytes())
                offsets = pa.py_buffer((np.append(first, len(key)) * 8).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array((key[first] % groups).astype(np.int32)), pa.array([nodes[i] for i in at], pa.binary()),
                     pa.array(np.array([len(s) for s in sets], np.int32)[at]),
                     pa.Array.from_buffers(pa.binary(), len(first), [None, offsets, data])],
                    names=["grp", "node", "n", "sigs"])

    return docs.select("text").mapInArrow(run, "grp int, node binary, n int, sigs binary")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """(nodes, sizes, signatures, their set) of one group after the other; rows arrive sorted by group."""
    at, nodes, sizes, sigs = None, [], [], []

    def done():
        order = sorted(range(len(nodes)), key=nodes.__getitem__)
        keep = [i for k, i in enumerate(order) if k == 0 or nodes[order[k - 1]] != nodes[i]]
        own = [np.frombuffer(sigs[i], "<u8") for i in keep]
        return ([nodes[i] for i in keep], np.array([sizes[i] for i in keep], np.int64), np.concatenate(own),
                np.repeat(np.arange(len(keep)), [len(x) for x in own]))

    for b in batches:
        for g, node, n, s in zip(*(b.column(i).to_pylist() for i in range(4))):
            if g != at:
                if nodes:
                    yield done()
                at, nodes, sizes, sigs = g, [], [], []
            nodes.append(node)
            sizes.append(n)
            sigs.append(s)
    if nodes:
        yield done()


def candidates(rows: DataFrame, similar: int, of: int) -> DataFrame:
    """a, b, sig: pairs of sets that share a signature (sig NULL), and the members of large runs (b NULL).

    Up to SMALL_RUN sets that share a signature give all their pairs.  A larger run
    gives the links to its first set, and its members, so that whatever the links
    leave in different components can be compared later.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, size, sig, owner in _groups(batches):
            order = np.argsort(sig, kind="stable")
            sig, owner = sig[order], owner[order]
            first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            length = np.diff(np.append(first, len(sig)))
            many = np.repeat(length, length)
            start = np.repeat(first, length)
            use = many > 1
            sig, owner, many = sig[use], owner[use], many[use]
            start = np.cumsum(np.concatenate([[0], use]))[start[use]]
            left, right = [], []
            for d in range(1, SMALL_RUN):
                at = np.flatnonzero((start[d:] == start[:-d]) & (many[d:] <= SMALL_RUN)) if len(sig) > d else np.zeros(0, np.int64)
                left.append(owner[at])
                right.append(owner[at + d])
            big = np.flatnonzero(many > SMALL_RUN)
            left.append(owner[start[big]])
            right.append(owner[big])
            x, y = np.concatenate(left), np.concatenate(right)
            fit = (x != y) & (np.minimum(size[x], size[y]) * of >= np.maximum(size[x], size[y]) * similar)
            pair = np.unique(np.minimum(x, y)[fit] * np.int64(len(nodes)) + np.maximum(x, y)[fit])
            for i in range(0, len(pair), 50_000):
                p = pair[i : i + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([nodes[k] for k in p // len(nodes)], pa.binary()), pa.array([nodes[k] for k in p % len(nodes)], pa.binary()),
                     pa.nulls(len(p), pa.int64())], names=["a", "b", "sig"])
            for i in range(0, len(big), 50_000):
                p = big[i : i + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([nodes[k] for k in owner[p]], pa.binary()), pa.nulls(len(p), pa.binary()), pa.array(sig[p].astype(np.int64))],
                    names=["a", "b", "sig"])

    return rows.repartition(n_tasks(rows), "grp").sortWithinPartitions("grp").mapInArrow(run, "a binary, b binary, sig long")


def close_enough(pairs: DataFrame, nodes: DataFrame, similar: int, of: int) -> DataFrame:
    """The pairs that their sketches do not rule out."""
    left = nodes.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    right = nodes.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))

    sized = pairs.join(left, "a").join(right, "b").where(F.least("na", "nb") * of >= F.greatest("na", "nb") * similar)
    return _by_sketch(sized, similar, of)


def _by_sketch(pairs: DataFrame, similar: int, of: int) -> DataFrame:
    """Pairs (a, b) with sizes na, nb and sketches sa, sb that may be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb, sa, sb = (b.column(i).to_pylist() for i in range(2, 6))
            ok = [sketch_distance(x, y) <= most_apart(i, j, similar, of) for x, y, i, j in zip(sa, sb, na, nb)]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    return pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a binary, b binary")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, similar: int, of: int) -> DataFrame:
    """The pairs whose whole sets are similar. Sets are made again from the texts of one document for each node."""
    ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    need = stage(nodes.join(ends, "node", "left_semi").select(F.col("first_id").alias("_need")).distinct(), "need")
    if need.count() <= BROADCAST_IDS:
        need = F.broadcast(need)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for b in slices(batches):
            sets = [shingle_set(t.as_py() or "", hashes, width) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([node_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["node", "elements"])

    texts = docs.select("doc_id", "text").join(need, F.col("doc_id").eqNullSafe(F.col("_need"))).select("text")
    sets = stage(texts.mapInArrow(run, "node binary, elements binary").dropDuplicates(["node"]), "sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(of * both >= similar * (len(x) + len(y) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("ea")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("elements").alias("eb")), "b")
    return both.select("a", "b", "ea", "eb").mapInArrow(compare, "a binary, b binary")


def _roots(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components so far."""
    left = comp.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    right = comp.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    out = pairs.join(left, "a", "left").join(right, "b", "left")
    return out.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def hub_links(members: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, similar: int, of: int) -> DataFrame:
    """Links of the members of large runs to the hub of their run: the member that lies in most large runs.

    Copies of one text that were changed at different places are often similar to the
    text they come from but not to each other; that text shares the most signatures.
    """
    degree = members.groupBy("a").agg(F.count(F.lit(1)).alias("d"))
    m = members.join(degree, "a")
    hubs = m.groupBy("sig").agg(F.max_by("a", F.struct("d", "a")).alias("hub"))
    stars = m.join(hubs, "sig").where("a <> hub").select(F.least("a", "hub").alias("a"), F.greatest("a", "hub").alias("b")).distinct()
    return verified(stage(close_enough(stars, nodes, similar, of), "stars"), docs, nodes, width, similar, of)


def large_runs(members: DataFrame, comp: DataFrame, nodes: DataFrame, similar: int, of: int, block: int = RUN_BLOCK) -> DataFrame:
    """Pairs of different components that share the signature of a large run and that sketches do not rule out.

    Only runs with several components are looked at. Their members meet in one task,
    or in one task for each pair of blocks where there are more than ``block``; sizes
    and sketches are compared there, so no pair becomes a row before it has passed.
    """
    m = members.join(comp.select(F.col("node").alias("a"), "root"), "a", "left").select("sig", "a", F.coalesce("root", "a").alias("r"))
    m = stage(m, "runs")
    split = m.groupBy("sig").agg(F.min("r").alias("lo_r"), F.max("r").alias("hi_r"), F.count(F.lit(1)).alias("n")).where(
        "lo_r <> hi_r").select("sig", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    sized = nodes.select(F.col("node").alias("a"), F.col("n_shingles").alias("n"), F.col("sketch").alias("s"))
    dealt = (
        m.join(split, "sig").join(sized, "a").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("sig", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "a", "r", "n", "s")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[bytes, bytes]] = set()
        for (_, lo, hi), b in runs_of(batches, ["sig", "lo", "hi"]):
            names = b.column("a").to_pylist()
            root = np.unique(np.array([int.from_bytes(r[:8], "little") for r in b.column("r").to_pylist()], U), return_inverse=True)[1]
            size, side = b.column("n").to_numpy(), b.column("block").to_numpy()
            bits = folded(b.column("s").to_pylist())
            out = []
            for i in range(0, len(names), 64):
                at = slice(i, min(i + 64, len(names)))
                both = size[at][:, None] + size[None, i:]
                apart = np.bitwise_count(bits[at][:, None, :] ^ bits[None, i:, :]).sum(axis=2, dtype=np.int64)
                ok = (apart <= (of - similar) * both // (of + similar)) & (root[at][:, None] != root[None, i:])
                ok &= np.minimum(size[at][:, None], size[None, i:]) * of >= np.maximum(size[at][:, None], size[None, i:]) * similar
                ok &= np.arange(i, len(names))[None, :] > np.arange(at.start, at.stop)[:, None]
                if lo != hi:
                    ok &= side[at][:, None] != side[None, i:]
                for x, y in zip(*np.nonzero(ok)):
                    pair = tuple(sorted((names[i + x], names[i + y])))
                    if pair not in seen:
                        if len(seen) >= KEEP_WORDS:
                            seen.clear()
                        seen.add(pair)
                        out.append(pair)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.binary()) for k in (0, 1)], names=["a", "b"])

    keys = ["sig", "lo", "hi"]
    return dealt.repartition(n_tasks(dealt), *keys).sortWithinPartitions(*keys).mapInArrow(run, "a binary, b binary").distinct()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, all folded to the bins of the smallest."""
    width = min(map(len, sketches))
    out = np.zeros((len(sketches), width // 8), U)
    for i, s in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(s, U).reshape(-1, width // 8), axis=0)
    return out


def similar_classes(docs: DataFrame, width: int = WIDTH, similar: int = SIMILAR, of: int = OF) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text).

    Two documents are linked when of * |intersection| >= similar * |union| of their
    shingle sets; component_id is the smallest doc_id reachable by links.  Every
    link counts, none is missed.  Documents with fewer than ``width`` words have
    their whole word sequence as the one shingle; those without words or text (NULL)
    have n_shingles 0 and are their own component.  Copies and repeated rows are one
    set.  A NULL doc_id takes part and is never the smallest.  Other columns are not
    read.  Shingles are compared by 64-bit hashes, sets named by 128 bits.
    """
    return _classes(docs, width, similar, of).select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _classes(docs: DataFrame, width: int, similar: int, of: int) -> DataFrame:
    """doc_id, n_shingles, node and, of rows with shingles, the class's smallest doc_id (component_id) and the set that has it (keep_node)."""
    rows = stage(shingle_sets(docs, width), "shingles")
    nodes = stage(
        rows.where("n_shingles > 0").groupBy("node").agg(
            F.min("doc_id").alias("first_id"), F.min("n_shingles").alias("n_shingles"), F.min("sketch").alias("sketch")), "nodes")
    total = nodes.agg(F.sum("n_shingles")).first()[0] or 0
    groups = max(LEAST_GROUPS, -(-int(total * 0.9) // GROUP_SIGNATURES))
    found = stage(candidates(signature_rows(docs, groups, width, similar, of), similar, of), "candidates")
    near = stage(close_enough(found.where("b is not null").select("a", "b").distinct(), nodes, similar, of), "near")
    hooks = near.groupBy(F.greatest("a", "b").alias("a")).agg(F.min(F.least("a", "b")).alias("b"))
    members = found.where("b is null").select("sig", "a")
    stars = hub_links(members, nodes, docs, width, similar, of)
    links = stage(verified(hooks, docs, nodes, width, similar, of).unionAll(stars), "links-1")
    comp = stage(connected_components(links), "components-1")
    rest = _roots(near, comp).unionAll(large_runs(members, comp, nodes, similar, of))
    rest = stage(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "rest")
    more = stage(verified(rest, docs, nodes, width, similar, of), "links-2")
    if more.count():
        comp = stage(connected_components(links.unionAll(more)), "components-2")
    named = nodes.join(comp, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    first = F.min(F.struct(F.col("first_id").isNull(), F.col("first_id").alias("id"), F.col("node").alias("node")))
    least = named.groupBy("root").agg(first.alias("_f")).select("root", F.col("_f.id").alias("component_id"), F.col("_f.node").alias("keep_node"))
    names = named.join(least, "root").select("node", "component_id", "keep_node")
    return rows.join(names, "node", "left").select("doc_id", "n_shingles", "node", "component_id", "keep_node")


def free_name(columns: list[str], base: str) -> str:
    """A column name that a table does not have."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def with_node(docs: DataFrame, name: str, width: int) -> DataFrame:
    """The rows with the name of their shingle set."""
    at = docs.schema.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for b in batches:
            nodes = pa.array([node_of(shingle_set(t.as_py() or "", hashes, width)) for t in b.column(at)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, nodes], names=[*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())]))


def keep_one_per_class(docs: DataFrame, width: int = WIDTH, similar: int = SIMILAR, of: int = OF) -> DataFrame:
    """One document of each class, with its columns: the one with the smallest doc_id.

    A class without any doc_id keeps one row too.  Different texts under one doc_id are
    different documents, each of its own class; repeated rows (equal id and shingles)
    are one.  Documents without words are no copies of each other: all stay, but for
    repeated rows with an id.  Any other columns may be present, whatever their names.
    """
    classes = stage(_classes(docs, width, similar, of), "classes")
    solid = F.col("n_shingles") > 0
    stays = F.coalesce(~solid | ((F.col("node") == F.col("keep_node")) & F.col("doc_id").eqNullSafe(F.col("component_id"))), F.lit(False))
    drop = stage(classes.where(~stays).select("doc_id", "node").distinct(), "drop")
    twice = stage(classes.where(stays & (solid | F.col("doc_id").isNotNull())).groupBy("doc_id", "node").count().where("count > 1").select("doc_id", "node"), "again")
    # where an id names one text alone, and every row to be dropped has one, ids decide; else the sets do
    shared = classes.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    by_id = shared.isEmpty() and drop.where("doc_id is null").isEmpty() and twice.where("doc_id is null").isEmpty()
    node = free_name(docs.columns, "_node")
    rows = docs if by_id else with_node(docs, node, width)
    keys = ["doc_id"] if by_id else ["doc_id", node]
    n_twice = twice.count()

    def beside(side: DataFrame, how: str, left: DataFrame) -> DataFrame:
        names = {"doc_id": free_name(left.columns, "_id_"), **({} if by_id else {"node": free_name(left.columns, "_set_")})}
        side = side.select(*[F.col(c).alias(n) for c, n in names.items()]).distinct()
        side = F.broadcast(side) if side.count() <= BROADCAST_IDS else side
        test = F.col("doc_id").eqNullSafe(F.col(names["doc_id"])) if not by_id else F.col("doc_id") == F.col(names["doc_id"])
        if not by_id:
            test = test & F.col(node).eqNullSafe(F.col(names["node"]))
        return left.join(side, test, how)

    kept = beside(drop, "left_anti", rows)
    if n_twice:
        kept = beside(twice, "left_anti", kept).unionAll(beside(twice, "left_semi", kept).dropDuplicates(keys))
    return kept.select([F.col(f"`{c}`") for c in docs.columns])
