"""N-gram Jaccard join and its components, by a count-vector R-tree (operator 3).

The result is exact. Equal sets are one node. Two linked sets share an element among the first few of each in any common
order of elements (the prefix filter), so those elements are the tree's cells: linked sets meet in a cell. The order puts
elements that many documents share last; that is a hint, of bounded size, which only keeps cells small.

1. Cells: packed (element, node) pairs are dealt by element, and those of elements that only one node has are left there.
   Elements known to be common skip that step, as they'd meet in one task. Of cells with the same nodes one stays.
2. Collapse: each node is held against the one node that shares most cells with it and comes first in them, so that large
   groups of near copies become a few classes without pairs between all their members.
3. Join: cells in which more than one class is left get an R-tree over count vectors (CountTree); nodes outside the cell's
   largest class are searched for in it. A node's HOMES are its largest cells; nodes with a common home meet in the
   one of these and not in other cells, so a pair isn't looked at once a cell. A cell's tree is built in chunks, each
   its own group, so none outgrows a task. The first round takes, in crowded cells, a node's BEST pairs, which joins
   most of a large group; the second, over what classes are left then, takes all.
4. Pairs whose bound holds, from 2 and from 3, are bounded again by longer vectors, and those left are verified on the
   whole sets; components of the verified pairs follow.

Trees hold vectors of GROUPS counts. A set of n has a longer one, of n / 2 groups or more: with GROUPS, unlike large sets
look alike. Numbers of groups are powers of two, so a vector folds to the next smaller number.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadflow.llm.bytetext import NOT_SPACE, Words, blocks, mix
from dyadflow.llm.components import components
from dyadflow.llm.rows import BROADCAST_IDS, without
from dyadflow.llm.rtree import CountTree, smaller_sum
from dyadflow.session import cut, shared_dir, table

WIDTH, PERCENT, GROUPS, PER_GROUP, HOMES, BEST = 5, 80, 64, 2, 3, 3
#: Elements that count as common: so many times in a block of prefixes, in all, and at most.
COMMON_HERE, COMMON, MAX_COMMON = 2, 4, 1 << 20
#: Rows of a cell in one tree, pairs of a node in one task of the verification, and nodes of a cell that the first round takes.
CHUNK, MEMBERS, CROWD = 4096, 256, 32
_FLUSH, _HINT_FLUSH = 1 << 18, 1 << 20


def kept(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again: cuts the lineage, and later steps read only the columns they need."""
    path = f"{shared_dir(df.sparkSession)}/near-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """For each text its set, sorted: hashes of its runs of `width` words (words end at white space, A-Z is lowered), of the
    whole sequence where it is shorter, none without words."""
    for a, b, data, offsets in blocks(texts):
        w = Words(data, offsets, NOT_SPACE)
        runs = w.windows(width)
        short = {}
        for k, n in enumerate(w.counts().tolist()):
            at = w.first[k]
            if n >= width:
                yield np.unique(runs[at : at + n - width + 1])
            elif n:
                if n not in short:
                    short[n] = w.windows(n)
                yield short[n][at : at + 1]
            else:
                yield runs[:0]


def count_vector(s: np.ndarray) -> np.ndarray:
    groups = max(GROUPS, 1 << (-(-len(s) // PER_GROUP) - 1).bit_length())
    return np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def packed(v: np.ndarray) -> bytes:
    """A byte a group, or four where a count needs them; the first byte tells."""
    return b"\x01" + v.astype(np.uint8).tobytes() if v.max() < 256 else b"\x04" + v.astype("<u4").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8 if raw[0] == 1 else "<u4", offset=1)


def folded(v: np.ndarray, groups: int) -> np.ndarray:
    """The vector with fewer groups: a group's number loses its high bits."""
    return v.reshape(-1, groups).sum(0, dtype=np.uint32) if len(v) > groups else v


def bound(v: np.ndarray, w: np.ndarray) -> int:
    """The sum of smaller counts: no two sets with these vectors share more."""
    groups = min(len(v), len(w))
    return int(smaller_sum(folded(v, groups), folded(w, groups)))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


class Common:
    """The common elements and their ranks: rarer first."""

    def __init__(self, elements: np.ndarray, counts: np.ndarray):
        order = np.argsort(elements)
        self.elements, self.counts = elements[order], counts[order]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.elements >> np.uint64(42)] = True

    def prefix(self, s: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
        """The first p elements of a sorted set, as those that aren't common and those that are."""
        near = np.flatnonzero(self.bits[s >> np.uint64(42)])
        if len(near) and len(self.elements):
            at = np.minimum(np.searchsorted(self.elements, s[near]), len(self.elements) - 1)
            is_common = self.elements[at] == s[near]
            near, at = near[is_common], at[is_common]
        else:
            near, at = near[:0], near[:0]
        if not len(near):
            return s[:p], s[:0]
        rare = np.delete(s, near)
        if len(rare) >= p:
            return rare[:p], s[:0]
        order = np.lexsort((s[near], self.counts[at]))
        return rare, s[near][order][: p - len(rare)]


def _node(s: np.ndarray, salt: int) -> tuple[int, int]:
    """Two hashes of a set as signed longs."""
    x = mix(s + np.uint64(salt))
    a, b = mix(np.array([x.sum(dtype=np.uint64) + np.uint64(len(s)), mix(x).sum(dtype=np.uint64)], np.uint64)).view(np.int64).tolist()
    return a, b


def _common_counts(percent: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            e, n = np.unique(np.concatenate(held), return_counts=True)
            held, size = [], 0
            e, n = e[n >= COMMON_HERE], n[n >= COMMON_HERE]
            return pa.RecordBatch.from_arrays([pa.array(e.view(np.int64)), pa.array(n)], ["element", "n"])

        for batch in batches:
            for s in shingle_sets(batch["text"], width):
                if len(s):
                    held.append(s[: prefix_length(len(s), percent)].copy())  # a view would keep the whole set
                    size += len(held[-1])
                if size >= _HINT_FLUSH:
                    yield flush()
        if held:
            yield flush()

    return run


def _described(width: int, salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node, check, counts, few = [], [], [], [], []
            for s in shingle_sets(batch["text"], width):
                a, b = _node(s, salt) if len(s) else (None, None)
                n.append(len(s))
                node.append(a)
                check.append(b)
                v = count_vector(s) if len(s) else None
                counts.append(packed(v) if len(s) else None)
                few.append(packed(folded(v, GROUPS)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(counts, pa.binary()), pa.array(few, pa.binary())], ["doc_id", "n", "node", "check", "counts", "few"])

    return run


def _packed_cells(percent: int, width: int, salt: int, common, buckets: int):
    """(bucket, is_common, packed pairs): a task sends a set once, however many copies of it the task has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: dict[bool, list] = {False: [], True: []}
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            out: list[tuple[int, bool, bytes]] = []
            for is_common, parts in held.items():
                if not parts:
                    continue
                element = np.concatenate([e for e, _ in parts])
                node = np.repeat(np.array([x for _, x in parts], np.int64), [len(e) for e, _ in parts])
                bucket = ((element if not is_common else mix(node.view(np.uint64))) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                pairs = np.stack([element.view(np.int64), node], axis=1)[order]
                at = np.searchsorted(bucket[order], np.arange(buckets + 1))
                out += [(b, is_common, pairs[at[b] : at[b + 1]].tobytes()) for b in np.flatnonzero(np.diff(at)).tolist()]
                parts.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.bool_()), pa.array([x[2] for x in out], pa.binary())], ["bucket", "common", "pairs"])

        for batch in batches:
            for s in shingle_sets(batch["text"], width):
                if not len(s):
                    continue
                node, _ = _node(s, salt)
                if node in seen:
                    continue
                seen.add(node)
                for is_common, e in zip((False, True), common.value.prefix(s, prefix_length(len(s), percent)), strict=True):
                    if len(e):
                        held[is_common].append((e.copy(), node))
                        size += len(e)
                if size >= _FLUSH:
                    yield flush()
        if size:
            yield flush()

    return run


def _shared_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over packed pairs in order of bucket: (element, node), once each, of the elements that more than one node has; common
    ones pass. Those of a node are in one bucket, and together in what a task sends, so of a set that several tasks sent
    the first to come stays. No more than a bucket is held."""
    now: int | None = None
    held: list[np.ndarray] = []
    seen: set[int] = set()

    def out(pairs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["element", "node"])

    def shared() -> Iterator[pa.RecordBatch]:
        if held:
            pairs = np.concatenate(held)
            held.clear()
            pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
            new = np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(1)])
            pairs = pairs[new]
            first = np.concatenate([[True], pairs[1:, 0] != pairs[:-1, 0], [True]])
            yield out(pairs[~(first[:-1] & first[1:])])

    for batch in batches:
        for bucket, is_common, raw in zip(batch["bucket"].to_pylist(), batch["common"].to_pylist(), batch["pairs"].to_pylist(), strict=True):
            if bucket != now:
                yield from shared()
                now, seen = bucket, set()
            pairs = np.frombuffer(raw, np.int64).reshape(-1, 2)
            if is_common:
                own = np.unique(pairs[:, 1])
                fresh = own[[x not in seen for x in own.tolist()]]
                seen.update(fresh.tolist())
                yield out(pairs[np.isin(pairs[:, 1], fresh)])
            else:
                held.append(pairs)
    yield from shared()


def meets_elsewhere(element: int, homes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of the other nodes (a row of homes each, the largest first; 0 is none) meet a node with these homes in another
    cell: that of the first homes if they are one, else of the least common home, if there is one."""
    none = np.iinfo(np.int64).max
    common = np.where((others[:, :, None] == homes[None, None, :]).any(2) & (others != 0), others, none).min(1, initial=none)
    common = np.where(others[:, 0] == homes[0], homes[0], common)
    return (common != element) & (common != none)


def _search_cells(percent: int, best: bool):
    """Over (element, band, chunk, node, comp, query, homes, counts) in order of the first three: pairs of nodes in different
    classes whose bound holds, or with `best` the BEST ones of each query by bound over size. A group's
    rows are a chunk of a cell's sets in one band of sizes, and the cell's queries that can reach the band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, []

        def search() -> list[tuple[int, int]]:
            points = [g for g in group if not g[2]]
            queries = [g for g in group if g[2]]
            if not points or not queries:
                return []
            tree = CountTree(np.stack([unpacked(g[4]) for g in points]), percent)
            nodes, comps = np.array([g[0] for g in points]), np.array([g[1] for g in points])
            homes = np.array([(list(g[3]) + [0] * HOMES)[:HOMES] for g in points], np.int64)
            sizes = np.array([unpacked(g[4]).sum(dtype=np.int64) for g in points])
            out = []
            for node, comp, _, own, counts in queries:
                allowed = (comps != comp) & ~meets_elsewhere(now[0], np.array(own, np.int64), homes)
                if not allowed.any():
                    continue
                found, bounds = tree.search(unpacked(counts), allowed)
                if best and len(found) > BEST:
                    found = found[np.lexsort((nodes[found], -bounds / sizes[found]))[:BEST]]
                out += [(min(node, x), max(node, x)) for x in nodes[found].tolist()]
            return out

        def batch_of(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
            rows = sorted(pairs)
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in rows], pa.int64()), pa.array([p[1] for p in rows], pa.int64())], ["a", "b"])

        for batch in batches:
            pairs: set[tuple[int, int]] = set()
            for element, band, chunk, *row in zip(*(batch[c].to_pylist() for c in ("element", "band", "chunk", "node", "comp", "query", "homes", "counts")), strict=True):
                if (element, band, chunk) != now:
                    pairs.update(search())
                    now, group = (element, band, chunk), []
                group.append(row)
            if pairs:
                yield batch_of(pairs)
        if pairs := set(search()):
            yield batch_of(pairs)

    return run


def _bounded(pairs: DataFrame, nodes: DataFrame, percent: int, vector: str) -> DataFrame:
    """pairs(a, b) whose sizes and summed smaller counts allow a link."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col(vector).alias(f"c{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(*(batch[c].to_pylist() for c in ("ca", "cb")), (batch["na"].to_numpy() + batch["nb"].to_numpy()).tolist(), strict=True)
            good = [(100 + percent) * bound(unpacked(x), unpacked(y)) >= percent * n for x, y, n in both]
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    return joined.where((F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)).mapInArrow(run, "a long, b long")


def _verify(percent: int, width: int, salt: int):
    """Over (a, part, node, text) with a's own row first in each (a, part): the pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, centre = None, None
        for batch in batches:
            links = []
            rows = zip(*(batch[c].to_pylist() for c in ("a", "part", "node")), shingle_sets(batch["text"], width), strict=True)
            for a, part, node, s in rows:
                if _node(s, salt)[0] != node:
                    continue  # another text under the same id
                if node == a:
                    now, centre = (a, part), s
                elif now == (a, part):
                    shared = len(np.intersect1d(centre, s, assume_unique=True))
                    if shared * (100 + percent) >= percent * (len(centre) + len(s)):
                        links.append((a, node))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of docs(doc_id, text).

    Two rows link when 100 * intersection >= percent * union of their shingle sets (see shingle_sets). component_id is the
    smallest doc_id that links lead to, the row's own included. Null, empty and blank texts have no set, link with
    nothing and keep their own id. Repeated rows and equal texts are one node, so they lie in one component; null ids
    count last. Columns of other names aren't read; an empty table gives no rows. No pair of different sets that links is
    missed: see the module's text. Sets are compared by 64-bit hashes of their shingles, and told apart by 128 bits.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text")
    texts = rows.select("text")
    hint = texts.mapInArrow(_common_counts(percent, width), "element long, n long").groupBy("element").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    hint = hint.orderBy(F.desc("n"), "element").limit(MAX_COMMON).toPandas()  # MAX_COMMON rows at most
    common = sc.broadcast(Common(hint["element"].to_numpy(np.int64).view(np.uint64), hint["n"].to_numpy(np.int64)))
    for salt in range(1, 9):
        info = kept(rows.mapInArrow(_described(width, salt), f"doc_id {kind}, n long, node long, check long, counts binary, few binary"))
        by_node = info.where("n > 0").groupBy("node").agg(F.min("check").alias("lo"), F.max("check").alias("hi"))
        if not by_node.where("lo <> hi").limit(1).collect():
            break  # no two sets have one node

    buckets = 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = texts.mapInArrow(_packed_cells(percent, width, salt, common, buckets), "bucket int, common boolean, pairs binary")
    cells = kept(packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared_cells, "element long, node long"))
    same = cells.groupBy("element").agg(F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "node")).alias("y"), F.count("*").alias("k"))
    cells = kept(cells.join(same.where("k > 1").groupBy("x", "y", "k").agg(F.min("element").alias("element")).select("element"), "element"))
    members = cells.select("node").distinct()
    nodes = kept(info.where("n > 0").join(members, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("counts").alias("counts"), F.first("few").alias("few")))

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs bounded by the longer vectors, then compared: a node's set meets those of its pairs, MEMBERS or so at a time;
        texts move, as they are smaller than sets. Long vectors move for the nodes of pairs only."""
        pairs = cut(pairs)
        ends = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        own = nodes.select("node", "n", "counts").join(F.broadcast(ends) if ends.count() <= BROADCAST_IDS else ends, "node")
        pairs = cut(_bounded(pairs, own, percent, "counts"))
        parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
        centres = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("node"))
        others = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("node"))
        roles = cut(centres.unionByName(others).join(nodes.select("node", F.col("doc_id").alias("id")), "node"))
        few = roles.count() <= BROADCAST_IDS
        found = rows.join(F.broadcast(roles) if few else roles, rows["doc_id"].eqNullSafe(roles["id"])).select("a", "part", "node", F.coalesce("text", F.lit("")).alias("text"))
        met = found.withColumn("other", F.col("node") != F.col("a")).repartition("a", "part").sortWithinPartitions("a", "part", "other")
        return cut(met.select("a", "part", "node", "text").mapInArrow(_verify(percent, width, salt), "a long, b long").distinct())

    # Collapse.
    first = cells.groupBy("element").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("element", "a")
    held = cells.join(first, "element").where("node <> a").groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("k"))
    best = held.groupBy("b").agg(F.max(F.struct("k", "a")).alias("m")).select("m.a", "b")
    links = verified(_bounded(best, nodes, percent, "few"))
    classes = components(links)

    # Join.
    sizes = cells.groupBy("element").agg(F.count("*").alias("size"))
    largest = F.slice(F.sort_array(F.collect_list(F.struct("size", "element")), asc=False), 1, HOMES)
    homes = cells.join(sizes, "element").groupBy("node").agg(F.transform(largest, lambda x: x["element"]).alias("homes"))
    described = cut(nodes.select("node", "n", F.col("few").alias("counts")).join(homes, "node"))
    band = F.floor(F.log("n") / F.lit(1.001 * math.log(100 / percent))).cast("int")  # sizes that can link are one band apart at most
    for best in (True, False):
        held = cells.join(classes, "node", "left").join(described.select("node", "homes", band.alias("band")), "node")
        elsewhere = F.when(F.col("homes")[0] != F.col("element"), F.col("homes")[0])
        held = held.select("element", "node", "band", F.coalesce("comp", "node").alias("comp"), elsewhere.alias("home"))
        most = lambda key, name: held.where(F.col(key).isNotNull()).groupBy("element", key).agg(F.count("*").alias("k")).groupBy("element").agg(F.max(F.struct("k", key)).alias(name), F.count("*").alias(f"{name}s"))
        mixed = sizes.join(most("comp", "class").where("classs > 1"), "element").join(most("home", "home"), "element", "left")
        # All pairs in the largest class are in one class, and all in the largest home meet there: the larger needs no queries.
        by_home = F.coalesce(F.col("home.k") > F.col("class.k"), F.lit(False))
        mixed = mixed.where("home is null or home.k < size").where(F.col("size") >= (CROWD if best else 0))
        mixed = mixed.select("element", by_home.alias("by_home"), F.col("class.comp").alias("the_class"), F.col("home.home").alias("the_home"))
        left = cut(held.join(mixed, "element"))
        asks = F.when(F.col("by_home"), ~F.col("home").eqNullSafe(F.col("the_home"))).otherwise(F.col("comp") != F.col("the_class"))
        queries = left.where(asks).select("element", "node", "comp", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
        # Ids alone move until it is known which rows have a row of another class to meet.
        there = left.groupBy("element", "band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
        queries = cut(queries.join(there, ["element", "band"]).where("lo <> hi or lo <> comp").select("element", "band", "node", "comp", "chunks"))
        points = left.join(queries.select("element", "band", "chunks").distinct(), ["element", "band"])
        points = points.select("element", "band", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"), "node", "comp", F.lit(False).alias("query"))
        queries = queries.select("element", "band", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "node", "comp", F.lit(True).alias("query"))
        group = ("element", "band", "chunk")
        grouped = points.unionByName(queries).join(described.select("node", "homes", "counts"), "node").repartition(*group).sortWithinPartitions(*group)
        more = verified(grouped.mapInArrow(_search_cells(percent, best), "a long, b long").distinct())
        classes = components(classes.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more))

    placed = info.select("doc_id", "n", "node").join(classes, "node", "left").withColumn("comp", F.when(F.col("n") > 0, F.coalesce("comp", "node")))
    placed = cut(placed.select("doc_id", F.col("n").alias("n_shingles"), "comp"))
    least = placed.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least"))
    return placed.join(least, "comp", "left").select("doc_id", "n_shingles", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def distinct_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, that are the first of their component: one document of each group stays."""
    return without(docs, near_duplicates(docs, percent).where(~F.col("doc_id").eqNullSafe(F.col("component_id"))))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


_W = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
OP3_SQL = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_W} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + least({WIDTH}, len(w)) - 1], ' ') || '|' || least({WIDTH}, len(w)) AS s
      FROM w, unnest(range(1, greatest(1, len(w) - {WIDTH} + 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s AS a JOIN s AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= {PERCENT} * (x.n + y.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(d, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.d, e.b FROM r JOIN e ON r.c = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents AS d LEFT JOIN n USING (doc_id) JOIN (SELECT d AS doc_id, min(c) AS component_id FROM r GROUP BY d) AS c USING (doc_id)
"""
