"""Near-duplicate detection by chosen-path set similarity join (operator 7).

Texts become sets of word shingles; texts with equal sets are one class, joined on the set's 128-bit hash and
represented by the smallest id. Representatives carry a MinHash sketch. TREES independent trees branch them
recursively: a node is a path of chosen minwise tokens (coordinates of the sketch with their values). The path of a
node of over NODE members chooses some coordinates, others at every level, and every member goes to one child for
each, named by its own token there. Nodes of at most NODE members are compared exhaustively, by sketch; candidates are
confirmed on full sets.

A group of n near copies has n**2 links, which are not emitted. A node first gives a maximum spanning forest of its
candidates. After the links of all forests are confirmed and joined to components, nodes that have more candidates than
their forest give every other one between members of different components: so a pair of a node is either confirmed, or
refuted, or joins texts that are connected anyway, and no connection that the nodes hold is lost. Nodes are rows of ids;
sketches come to them when they are compared or branched.

Crowds: members of a large node that choices don't part (a level that leaves STALE of a parent in one child, or all
LEVELS) are similar throughout, and branching them on only multiplies them. They leave the trees and are joined with
each other exactly, by rare prefixes: with its shingles in one global order (rare first), a set shares one of its first
n - ceil(t n) + 1 with any set of similarity t, and the places of the first shared shingle bound the overlap. Before
that they are linked in pieces of their nodes, each tied to a pivot. Postings of one component have nothing to add and
go; others are compared across components, in blocks of bounded size, each pair at its first common shingle, by the same
two turns: a forest over components, then the rest of the blocks that have more, across the components of then. The order
is learned from a sample of the members; it decides how long postings are, never which pairs are found.

Recall: a pair at the threshold is in the same child of a coordinate with probability 0.8. With three children at the
first level and two at each further one, the pair's common nodes are a branching process that grows (1.6 a level), so that
a tree keeps it to any depth with probability 0.77, and all eight miss it with 1e-5, whatever the number of levels and
so the number of rows. The sketch screen loses about 3e-5. Pairs of crowds are not lost.

Scale: nothing is collected; nodes' sizes come from map-side partial counts; a node of a third of all rows is
never gathered, its rows meet the node's count in a join that adaptive execution can split and go on to the next
level. Sets are not stored: those of candidates are made again from the texts. Components converge by
alternating large and small stars, which are aggregations and joins.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, checkpointed, text_hash, without_rows

COORDINATES, TREES, NODE, BLOCK = 64, 8, 256, 512
#: Children of each member of a large node, by level; a level has as many coordinates of its own as there are trees.
BRANCHES = (3, 2, 2, 2, 2, 2)
LEVELS = len(BRANCHES) + 1
#: With two children a member, a child with half of its parent's members makes no fewer rows: it is a crowd.
STALE = 0.5
SCREEN = 0.6
#: Rows in one partition of intermediate tables of known size: small tables don't need many tasks and files.
PARTITION_ROWS = 20_000
#: Of the members of crowds, about so many give the order of shingles, of which the FREQUENT most frequent have a rank.
ORDER_SAMPLE, FREQUENT = 4096, 200_000
#: Up to so many members of crowds (of some 160 bytes each) may be broadcast.
BROADCAST_MEMBERS = 50_000
#: Of crowds' candidates, so many a component are confirmed at a time before the rest: 1, then 8, then all.
PICKS = (1, 8)
#: With up to so many candidates for each pick, all are confirmed at once: every time sets are made and moved again.
FEW = 16
#: A posting carries so many of the shingles before it; a pair that shares one of them has met there.
BEFORE = 64

_RANDOM = np.random.RandomState(20)
_MULTIPLY = _RANDOM.randint(0, 2**62, COORDINATES).astype(np.uint64) * np.uint64(4) + np.uint64(5)
_ADD = _RANDOM.randint(0, 2**62, COORDINATES).astype(np.uint64) * np.uint64(4) + np.uint64(3)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles: lower-cased (A-Z) words `[^\\x20\\x09-\\x0D]+`, `words` at a time.

    With fewer words the whole sequence is one shingle; without words, or for null, the set is empty.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    width = min(words, len(word))
    h = np.full(len(word) - width + 1, width, np.uint64)
    for k in range(width):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + word[k : len(word) - width + 1 + k])
    return np.unique(h)


def minwise(s: np.ndarray) -> np.ndarray:
    """The COORDINATES minima of a non-empty set under independent hashes."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max)
    for at in range(0, len(s), 8192):
        np.minimum(least, (s[None, at : at + 8192] * _MULTIPLY[:, None] + _ADD[:, None]).min(axis=1), out=least)
    return least


def _sketches(words: int):
    def run(batches):
        for batch in batches:
            sizes, keys, sketches, paths = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, words)
                sizes.append(len(s))
                if not len(s):
                    keys.append(None), sketches.append(None), paths.append(None)
                    continue
                least = minwise(s)
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                sketches.append((_mix(least) & np.uint64(0xFFFF)).astype(np.uint16).tobytes())
                paths.append(_mix(least[:TREES] + np.arange(1, TREES + 1, dtype=np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary()), pa.array(paths, pa.list_(pa.int64()))],
                ["doc_id", "raw", "n", "key", "sketch", "paths"],
            )

    return run


def _branched(level: int):
    """Children of members of large nodes: the path chooses BRANCHES[level - 1] coordinates among those of the level."""
    salt = np.uint64((2 * level + 1) * 0x9E3779B97F4A7C15 % 2**64)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            path = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            sketch = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint16).reshape(-1, COORDINATES)
            rows, chosen = np.arange(len(path)), _mix(path + salt) % np.uint64(TREES)
            for branch in range(BRANCHES[level - 1]):
                at = (level * TREES + (chosen + np.uint64(3 * branch)) % np.uint64(TREES)).astype(np.int64)
                out = _mix(_mix(path + np.uint64(branch + 1)) * np.uint64(0x9E3779B97F4A7C15) + sketch[rows, at].astype(np.uint64) + np.uint64(1))
                yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64)), *(batch.column(k) for k in (1, 2, 4, 5))], ["path", "id", "n", "up", "stale"])

    return run


def _forest(a: np.ndarray, b: np.ndarray, size: int) -> list[int]:
    """Which of the edges, taken in order, join two trees."""
    root = list(range(size))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    used = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[x] = y
            used.append(k)
            if len(used) == size - 1:
                break
    return used


def _met(before: list[bytes]) -> np.ndarray:
    """Which pairs of members share one of the shingles before."""
    owner = np.repeat(np.arange(len(before)), [len(x) // 4 for x in before])
    token, count = np.unique(np.frombuffer(b"".join(before), np.uint32), return_inverse=True, return_counts=True)[1:]
    use = count[token] > 1
    owner, token = owner[use], np.unique(token[use], return_inverse=True)[1]
    met = np.zeros((len(before), len(before)), bool)
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    for at in range(0, int(token[-1]) + 1 if len(token) else 0, 2048):
        part = slice(*np.searchsorted(token, [at, at + 2048]))
        has = np.zeros((len(before), 2048), np.float32)
        has[owner[part], token[part] - at] = 1
        met |= has @ has.T > 0
    return met


def node_candidates(ids: np.ndarray, sizes: np.ndarray, sketch: np.ndarray, percent: int, forest: bool, group: np.ndarray, skip: np.ndarray | None = None, place: np.ndarray | None = None, before: list[bytes] | None = None):
    """Pairs (places a and b) of one node worth confirming, across its groups, how many coordinates they share, and whether
    there are more: a spanning forest of the groups, or all but those of two members to skip.

    With the places of a shingle in the members' ordered sets, only pairs that can still overlap enough from there on,
    and with the shingles before it only pairs that share none of these.
    """
    if (group == group[0]).all():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), False
    a, b = np.triu_indices(len(ids), 1)
    fits = (100 * np.minimum(sizes[a], sizes[b]) >= percent * np.maximum(sizes[a], sizes[b])) & (group[a] != group[b])
    if skip is not None:
        fits &= ~(skip[a] & skip[b])
    if place is not None:
        rest = sizes - place
        fits &= (100 + percent) * np.minimum(rest[a], rest[b]) >= percent * (sizes[a] + sizes[b])
    if before is not None and fits.any():
        fits &= ~_met(before)[a, b]
    a, b = a[fits], b[fits]
    same, more = a, False
    if len(a):
        same = np.concatenate([(sketch[a[k : k + 16384]] == sketch[b[k : k + 16384]]).sum(axis=1) for k in range(0, len(a), 16384)])
        good = same >= SCREEN * COORDINATES
        a, b, same = a[good], b[good], same[good]
        if forest and len(a) > 1:
            order = np.argsort(-same, kind="stable")
            a, b, same = a[order], b[order], same[order]
            number, dense = np.unique(group, return_inverse=True)
            used = _forest(dense[a], dense[b], len(number))
            more = len(used) < len(a)
            a, b, same = a[used], b[used], same[used]
    turn = ids[a] > ids[b]
    return np.where(turn, b, a), np.where(turn, a, b), same, more


def _candidates(percent: int, forest: bool):
    """Candidates of whole nodes (path, id, n, sketch, component, then skip, and place and before, if there are)."""

    def run(batches):
        for rows in _whole_nodes(batches):
            path = rows.column(0).to_numpy(zero_copy_only=False)
            ids, sizes, group = (rows.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 4))
            sketch = np.frombuffer(b"".join(rows.column(3).to_pylist()), np.uint16).reshape(-1, COORDINATES)
            skip = rows.column(5).to_numpy(zero_copy_only=False) if rows.num_columns > 5 else None
            place = rows.column(6).to_numpy(zero_copy_only=False) if rows.num_columns > 6 else None
            before = rows.column(7).to_pylist() if rows.num_columns > 7 else None
            edge = np.flatnonzero(np.r_[True, path[1:] != path[:-1], True])
            found = [(ids[:0],) * 6 + (np.zeros(0, bool),)]
            for x, y in zip(edge[:-1], edge[1:], strict=True):
                if y - x > 1:
                    with_them = (None if column is None else column[x:y] for column in (skip, place, before))
                    a, b, same, more = node_candidates(ids[x:y], sizes[x:y], sketch[x:y], percent, forest, group[x:y], *with_them)
                    found.append((ids[x + a], ids[x + b], np.full(len(a), path[x]), same, group[x + a], group[x + b], np.full(len(a), more)))
            names = ["a", "b", "path", "same", "ca", "cb", "more"]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found]), pa.bool_() if k == 6 else pa.int64()) for k in range(7)], names)

    return run


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share at least percent of their union."""
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def _whole_nodes(batches):
    """Batches cut where a node ends; rows stand in the order of their nodes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        path = batch.column(0).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(path, path[-1], side="left"))
        if last:
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, last)]).combine_chunks().to_batches()[0]
            held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _confirmed(percent: int):
    """The similar pairs of whole nodes; a node's rows are its members' sets (b null), then its pairs."""

    def run(batches):
        for rows in _whole_nodes(batches):
            path, a = (rows.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            member = rows.column(2).is_null().to_numpy(zero_copy_only=False)
            b = rows.column(2).fill_null(0).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.r_[True, path[1:] != path[:-1], True])
            left, right = [], []
            for x, y in zip(edge[:-1], edge[1:], strict=True):
                sets = {int(a[k]): np.frombuffer(rows.column(3)[int(k)].as_py(), np.uint64) for k in x + np.flatnonzero(member[x:y])}
                for k in x + np.flatnonzero(~member[x:y]):
                    if _similar(sets[int(a[k])], sets[int(b[k])], percent):
                        left.append(a[k])
                        right.append(b[k])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def _sets(words: int):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(x, words).tobytes() for x in batch.column(1).to_pylist()], pa.binary())], ["id", "set"])

    return run


def sets_of(ids: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(id, set) of the ids (one column `id`, distinct), made from the texts of docs (id, text)."""
    ids = checkpointed(ids)
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return checkpointed(docs.join(wanted, "id", "left_semi").mapInArrow(_sets(words), "id long, set binary"))


def confirm(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b, path) of ids in docs (id, text) whose full sets have the wanted similarity.

    A pair is confirmed in one of its nodes (path), to which each member's set goes once, however many pairs it has there.
    """
    pairs = checkpointed(pairs.groupBy("a", "b").agg(F.min("path").alias("path")))
    members = pairs.select("path", F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = sets_of(members.select("id").distinct(), docs, words)
    rows = members.join(sets, "id").select("path", F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "set")
    rows = rows.unionByName(pairs.select("path", "a", "b", F.lit(None).cast("binary").alias("set")))
    return rows.repartition("path").sortWithinPartitions("path", F.asc_nulls_first("b")).mapInArrow(_confirmed(percent), "a long, b long")


def packed(df: DataFrame, rows: int) -> DataFrame:
    """df, checkpointed in as many partitions as at most so many rows need."""
    return checkpointed(df.coalesce(1 + rows // PARTITION_ROWS))


def _contracted(batches):
    """A partition's edges (u, v) as stars: every node but the smallest of its component there, with the smallest."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
    stars = [(x, find(x)) for x in list(root)]
    stars = [s for s in stars if s[0] != s[1]]
    yield pa.RecordBatch.from_arrays([pa.array([s[k] for s in stars], pa.int64()) for k in (0, 1)], ["u", "v"])


def components(edges: DataFrame) -> tuple[DataFrame, int]:
    """(a, b) to (node, component), the smallest node reachable; and a bound of its rows.

    Partitions of about PARTITION_ROWS edges are contracted to stars by themselves. Where there are several, large and
    small stars (aggregations and joins) and contractions go on by turns until nothing changes.
    """
    edges = checkpointed(edges.filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")))
    n = edges.count()
    parts = 1 + n // PARTITION_ROWS

    def contracted(df: DataFrame) -> DataFrame:
        return checkpointed(df.coalesce(parts).mapInArrow(_contracted, "u long, v long"))

    state, edges = None, contracted(edges)
    while parts > 1:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = packed(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), 2 * n)
        large = packed(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts).distinct(), 2 * n)
        least = packed(large.groupBy("u").agg(F.min("v").alias("m")), 2 * n)
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = contracted(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), 2 * n


def nodes_of(members: DataFrame, sketches: DataFrame, rows: int) -> tuple[DataFrame, DataFrame, int]:
    """(path, id, n) of the trees' first level, of so many rows, to nodes of 2 to NODE members; to pieces of crowds, one for
    each member but pivots; and a bound of the number of members of crowds. Sketches (id, sketch) go to what is branched."""
    light, crowds, crowded = [], [], 0
    members = members.withColumns({"up": F.lit(1 << 62), "stale": F.lit(0)})
    for level in range(1, LEVELS + 1):
        counts = packed(members.groupBy("path").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), rows)
        shared = members.join(counts, "path").withColumn("stale", F.col("stale") + (F.col("c") >= F.col("up") * STALE).cast("int"))
        shared = packed(shared.select("path", "id", "n", F.col("c").alias("up"), "stale"), rows)
        light.append(shared.filter(F.col("up") <= NODE).drop("up", "stale"))
        crowd = (F.col("stale") > 0) if level < LEVELS else F.lit(True)
        large = shared.filter(F.col("up") > NODE).groupBy(crowd.alias("crowd")).count().collect()
        found = {r["crowd"]: r["count"] for r in large}
        if found.get(True):
            crowds.append(shared.filter((F.col("up") > NODE) & crowd).drop("up", "stale"))
            crowded += found[True]
        rows = found.get(False, 0)
        if not rows:
            break
        rows *= BRANCHES[level - 1]
        large = shared.filter((F.col("up") > NODE) & ~crowd).join(sketches, "id").select("path", "id", "n", "sketch", "up", "stale")
        members = packed(large.mapInArrow(_branched(level), "path long, id long, n long, up long, stale int"), rows)
    nodes = reduce(DataFrame.unionByName, light)
    if not crowded:
        return nodes, nodes.limit(0), 0
    one = reduce(DataFrame.unionByName, crowds).groupBy("id").agg(F.min("path").alias("path"), F.first("n").alias("n"))
    one = packed(one.select("path", "id", "n"), crowded)
    whole = packed(one.groupBy("path").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("id", "n")).alias("p")), crowded)
    cut = one.join(whole.select("path", "c"), "path").withColumn("node", F.xxhash64("path", F.pmod(F.xxhash64("id"), F.ceil(F.col("c") * 2 / NODE))))
    cut = packed(cut.select("path", "node", "id", "n"), crowded)
    tied = cut.select("path", "node").distinct().join(whole, "path").select(F.col("node").alias("path"), "p.id", "p.n")
    pieces = cut.select(F.col("node").alias("path"), "id", "n").unionByName(tied).distinct()
    return nodes, packed(pieces, 2 * crowded), crowded


CANDIDATE = "a long, b long, path long, same long, ca long, cb long, more boolean"
POSTING = ["token", "id", "n", "sketch", "component", "place", "close", "before"]


def _prefixes(words: int, percent: int, ranked: np.ndarray, rank: np.ndarray):
    """From (id, text, component, n, sketch) to (token, id, n, sketch, component, place, close, before) of the first shingles
    of each set, in the order of rank (0 for those not ranked) and hash.

    close tells whether the place also is in the shorter prefix that the smaller set of a pair needs; before has up to
    BEFORE of the shingles right before it, 32 bits each.
    """

    def run(batches):
        for part in _slices(batches):
            for i, text, component, size, sketch in zip(*(part.column(k).to_pylist() for k in range(5)), strict=True):
                s = shingles(text, words)
                if not len(s):
                    continue
                often = np.zeros(len(s), np.int64)
                if len(ranked):
                    at = np.minimum(np.searchsorted(ranked, s), len(ranked) - 1)
                    often = np.where(ranked[at] == s, rank[at], 0)
                n = len(s)
                length = n + percent * n // -100 + 1
                s = s[np.lexsort((s, often))][:length]
                short = (s >> np.uint64(32)).astype(np.uint32).tobytes()
                close = np.arange(length) < n + 2 * percent * n // -(100 + percent) + 1
                before = [short[4 * max(0, k - BEFORE) : 4 * k] for k in range(length)]
                same = (pa.array([x], kind).take(pa.array(np.zeros(length, np.int32))) for x, kind in ((i, pa.int64()), (size, pa.int64()), (sketch, pa.binary()), (component, pa.int64())))
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), *same, pa.array(np.arange(length)), pa.array(close), pa.array(before, pa.binary())], POSTING)

    return run


def _slices(batches):
    """Batches cut to so few texts that what is made of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            yield batch.slice(at, 128)


def _tokens(words: int):
    def run(batches):
        for part in _slices(batches):
            found = [shingles(x, words) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], ["token"])

    return run


def prefix_blocks(crowd: DataFrame, crowded: int, known: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Nodes (path, id, n, sketch, component, skip, place, before) that hold all pairs of members of crowds across the
    components known so far that share a shingle of their prefixes."""
    members = packed(crowd.select("id").join(known, "id", "left").select("id", F.coalesce("component", "id").alias("component")), crowded)
    members = packed(members.join(classes.select("id", "n", "sketch"), "id"), crowded)
    count = members.count()
    wanted = texts.join(F.broadcast(members) if count <= BROADCAST_MEMBERS else members, "id").select("id", "text", "component", "n", "sketch")
    share = 1 + count // ORDER_SAMPLE
    sampled = wanted.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(share)) == 0).mapInArrow(_tokens(words), "token long")
    common = sampled.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").orderBy(F.desc("c"), "token").limit(FREQUENT).toArrow()
    ranked, rank = common["token"].to_numpy().view(np.uint64), common["c"].to_numpy()
    order = np.argsort(ranked)
    kinds = "token long, id long, n long, sketch binary, component long, place long, close boolean, before binary"
    postings = checkpointed(wanted.mapInArrow(_prefixes(words, percent, ranked[order], rank[order]), kinds))
    sizes = postings.groupBy("token", "component").agg(F.count(F.lit(1)).alias("m"), F.max("close").alias("close"))
    groups = sizes.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.sum("m").alias("c"), F.max(F.struct("m", "component")).alias("top"), F.max("close").alias("close"))
    # a whole posting, or blocks of its largest component by chunks of the rest, and chunks of the rest by each other
    groups = checkpointed(
        groups.filter("k > 1 AND close").select(
            "token", F.col("top.component").alias("main"), (F.col("c") <= NODE).alias("whole"), F.ceil(F.col("top.m") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("c") - F.col("top.m")) / NODE).cast("int").alias("chunks")
        )
    )
    own = F.pmod(F.xxhash64("id"), F.when(F.col("component") == F.col("main"), F.col("blocks")).otherwise(F.col("chunks"))).cast("int")
    chunks, blocks = F.sequence(F.lit(0), F.col("chunks") - 1), F.sequence(F.lit(0), F.col("blocks") - 1)

    def cell(kind: int, x, y):
        return F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))

    cells = (
        F.when(F.col("whole"), F.array(cell(0, F.lit(0), F.lit(0))))
        .when(F.col("component") == F.col("main"), F.transform(chunks, lambda k: cell(1, F.col("own"), k)))
        .otherwise(F.concat(F.transform(blocks, lambda k: cell(1, k, F.col("own"))), F.transform(chunks, lambda k: cell(2, F.least(k, F.col("own")), F.greatest(k, F.col("own"))))))
    )
    met = postings.join(groups, "token").withColumn("own", own).select(*POSTING, F.explode(cells).alias("cell"))
    return met.select(F.xxhash64("token", "cell.kind", "cell.x", "cell.y").alias("path"), "id", "n", "sketch", "component", F.lit(False).alias("skip"), "place", "before")


def candidates(nodes: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Candidates of nodes, each node's compared in one task."""
    return checkpointed(nodes.repartition("path").sortWithinPartitions("path").mapInArrow(_candidates(percent, forest), CANDIDATE))


def with_more(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """The nodes that have candidates besides the forest they gave; those of the others are all among the found."""
    paths = checkpointed(found.filter("more").select("path").distinct())
    return nodes.join(F.broadcast(paths) if paths.count() <= BROADCAST_IDS else paths, "path", "left_semi")


def across_components(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b, path, same) whose components ca and cb differ; known (id, component) has those of linked members."""
    for side in "ab":
        own = known.select(F.col("id").alias(side), F.col("component").alias(f"c{side}"))
        pairs = pairs.drop(f"c{side}").join(own, side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    return checkpointed(pairs.filter("ca <> cb"))


def likeliest(pairs: DataFrame, picks: int) -> DataFrame:
    """(a, b, path) of the pair that shares most coordinates in each of so many parts of each component's pairs."""
    part = F.pmod(F.xxhash64("a", "b"), F.lit(picks))
    best = [pairs.groupBy(side, part).agg(F.max(F.struct("same", "a", "b", "path")).alias("m")).select("m.a", "m.b", "m.path") for side in ("ca", "cb")]
    return checkpointed(best[0].unionByName(best[1]).distinct())


def _decided(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """near_dup, with the rows' text_hash (raw)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_hash(text_col).alias("raw"))
    prepared = checkpointed(rows.mapInArrow(_sketches(words), "doc_id long, raw long, n long, key binary, sketch binary, paths array<bigint>"))
    total = prepared.count()
    # ids may repeat with other texts, so inside a class goes by the hash of its first row
    classes = packed(
        prepared.filter("n > 0 AND doc_id IS NOT NULL")
        .groupBy("key")
        .agg(F.min(F.struct("doc_id", F.xxhash64("doc_id", "raw").alias("id"))).alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths"))
        .select("key", "least.id", "least.doc_id", "n", "sketch", "paths"),
        total,
    )
    sketches = classes.select("id", "sketch")
    nodes, pieces, crowded = nodes_of(classes.select(F.explode("paths").alias("path"), "id", "n"), sketches, classes.count() * TREES)
    texts = rows.filter("doc_id IS NOT NULL").select(F.xxhash64("doc_id", "raw").alias("id"), "text")

    def linked(known: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        state = known.select(F.col("id").alias("a"), F.col("component").alias("b"))
        final, bound = components(state.unionByName(confirm(more, texts, words, percent)))
        return final, packed(final.select(F.col("node").alias("id"), "component"), bound), bound

    def joined(known: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        """linked with crowds' candidates, which lie across the known components: the likeliest of each component first, so that most of the
        others lie inside of one when their turn comes. Every one is confirmed, or refuted, or inside of a component."""
        more = checkpointed(more.groupBy("a", "b").agg(F.max(F.struct("same", "path", "ca", "cb")).alias("m")).select("a", "b", "m.path", "m.same", "m.ca", "m.cb"))
        for picks in PICKS:
            best = likeliest(more, picks)
            if more.count() <= FEW * best.count():
                break
            _, known, _ = linked(known, best)
            more = across_components(more.join(best.select("a", "b"), ["a", "b"], "left_anti"), known)
        return linked(known, more.select("a", "b", "path"))

    every = nodes.unionByName(pieces) if crowded else nodes
    tried = candidates(every.join(sketches, "id").select("path", "id", "n", "sketch", F.col("id").alias("component")), percent, True)
    none = rows.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("component")).limit(0)
    final, known, bound = linked(none, tried)
    state = known.withColumn("skip", F.lit(False))
    crowd = packed(pieces.select("id").distinct(), crowded) if crowded else None
    if crowded:  # pairs of crowds are left to the prefix join
        state = packed(known.join(crowd.withColumn("crowd", F.lit(True)), "id", "full_outer").select("id", "component", F.coalesce("crowd", F.lit(False)).alias("skip")), bound + crowded)
    grouped = with_more(nodes, tried).join(state, "id", "left").join(sketches, "id")
    grouped = grouped.select("path", "id", "n", "sketch", F.coalesce("component", "id").alias("component"), F.coalesce("skip", F.lit(False)).alias("skip"))
    across = candidates(grouped, percent, False).join(tried.select("a", "b").distinct(), ["a", "b"], "left_anti")
    final, known, bound = linked(known, across)
    if crowded:  # nodes' own links first: fewer postings then have members of several components
        blocks = checkpointed(prefix_blocks(crowd, crowded, known, classes, texts, words, percent))
        tried = candidates(blocks, percent, True)
        final, known, bound = joined(known, tried)
        again = with_more(blocks, tried).withColumnRenamed("component", "was").join(known, "id", "left")
        again = again.select("path", "id", "n", "sketch", F.coalesce("component", "id").alias("component"), "skip", "place", "before")
        across = candidates(again, percent, False).join(tried.select("a", "b").distinct(), ["a", "b"], "left_anti")
        final, known, bound = joined(known, across)
    found = packed(classes.join(final, F.col("id") == F.col("node"), "left").select("key", "doc_id", F.coalesce("component", "id").alias("root")), total)
    first = found.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    labelled = packed(found.join(first, "root").select("key", F.col("first.doc_id").alias("component"), (F.col("key") == F.col("first.key")).alias("own")), total)
    return prepared.select("doc_id", "raw", "n", "key").join(labelled, "key", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.coalesce((F.col("doc_id") == F.col("component")) & F.col("own"), F.lit(True)).alias("kept"),
        "raw",
    )


def near_dup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents whose shingle sets share at least percent of their union are linked; component_id is the smallest id
    reachable, itself included, and kept tells whether it is the document's own. Documents without words, or with
    null text, are linked with nothing. Rows that repeat an id and text share a result; a null id has no links, a
    null component, and is kept. Other columns are not read; an empty table gives an empty result. Ids are integers.
    """
    return _decided(docs, id_col, text_col, words, percent).drop("raw")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that near_dup keeps (one document of each component), with all their columns."""
    decided = _decided(docs, id_col, text_col, words, percent)
    return without_rows(docs, decided.filter(~F.col("kept")).select("doc_id", "raw"), id_col, text_col)
