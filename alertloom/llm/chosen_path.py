"""Near duplicates by a chosen-path set similarity join.

Documents are sets of distinct word shingles; equal sets are one class, represented by its least doc_id. A class has a
sketch of minwise values (the least shingle under each of several hash orders). Independent trees start with all
classes. A node chooses hash orders by its own hash and branches its classes by the least shingle in each: two classes
of similarity s go down together in a branch with probability s. A node of at most LEAF classes is a leaf and is compared
exhaustively. With TREES x BRANCHES branches at the roots a pair at the threshold is missed with probability
0.2^8 (under 3e-6) where these are leaves, and under 2e-5 below them.

Trees come one pass after another: nodes whose classes an earlier pass has already connected are dropped, so later
trees cost little. A larger node is first cut by set size: classes whose sizes differ by more than the threshold allows
can't be linked, so each goes into two bands of sizes and every possible pair meets in one. What is still large is dealt
into blocks of about LEAF classes in which a few hubs of the node stand each, so that a large group of near copies becomes one component by its links to hubs. If many of its classes are
still outside its main component (they only share a frequent passage) and they would fill more than a few cells, the node branches
again, DEPTH levels at most, which leaves fewer classes in a node each time. Otherwise, and at the last level, the classes
outside (strays) meet every block of the node, in cells of bounded size: every pair of the node is then compared but for pairs already connected. No task holds a whole large node.

Comparison has two steps. The sketches of a group alone tell which of its classes have a partner at all; only the
texts of these are brought to the group. Pairs whose sketches agree in under LEAST_AGREEING of SKETCH places are passed over (a pair at the threshold
does so with probability under 1e-6); every other pair not yet connected in its group is confirmed on the
full sets, made from whole texts. Texts are dealt by id and written once; no comparison shuffles those it does not need.
Confirmed links give components; copies are never expanded to pairs.

Null or empty text: an empty set, linked with nothing. Rows with equal doc_id and
different texts are judged each, by their own sets. A null doc_id counts as the least id. Other columns are ignored. No rows: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.llm.components import components, labels, stars
from alertloom.llm.encoder import blocks
from alertloom.llm.shingles import digest, overlap, shingle_sets, sketches, word_hashes
from alertloom.llm.store import bucketed, saved

SHINGLE = 4
PERCENT = 80
SKETCH = 64
TREES, BRANCHES = 4, 2
LEAF = 512
DEPTH = 6
HUBS = 4
LEAST_AGREEING = 34
#: Classes of a node that meet in a cell: half of them strays, half of them any.
CELL = 2048
#: Share of a large node that may be strays for them to meet all of it at once.
FEW_STRAYS = 8
#: Blocks and parts of a node with many strays for them to meet all of it at once; more would cost more than branching.
FEW_CELLS = 4
#: Rounds towards components between passes: equal labels mean connected, which is all that a pass needs.
ROUNDS = 2
#: Stands for a null doc_id.
NO_ID = -(1 << 63)


def sketched(docs: DataFrame, shingle: int) -> DataFrame:
    """id, n (size of the set), key (128-bit hash of the set, null if empty), sketch."""

    def run(batches):
        for batch in blocks(batches):
            sets = shingle_sets(*word_hashes(batch.column("text")), shingle)
            marks = sketches(sets, SKETCH)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([m.astype("<u4").tobytes() for m in marks], pa.binary()),
                ],
                ["id", "n", "key", "sketch"],
            )

    return docs.mapInArrow(run, "id long, n long, key binary, sketch binary")


def _value(order):
    """The sketch's value in a hash order."""
    return F.expr("sketch").substr(order * 4 + 1, F.lit(4))


def roots(classes: DataFrame, trees: range) -> DataFrame:
    """(node, id, n) below the roots of these trees."""
    orders = [F.lit(t * BRANCHES + k) for t in trees for k in range(BRANCHES)]
    below = F.array(*[F.xxhash64(F.lit("root"), o, _value(o)) for o in orders])
    return classes.select("id", "n", F.explode(below).alias("node"))


def branched(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, id) below these nodes; their hash orders, beyond those of the roots, are chosen by the node's hash."""
    used, free = TREES * BRANCHES, SKETCH - TREES * BRANCHES
    first = F.pmod(F.xxhash64("node", F.lit("order")), F.lit(free)).cast("int")
    orders = [F.lit(used) + F.pmod(first + F.lit(k * (free // BRANCHES)), F.lit(free)).cast("int") for k in range(BRANCHES)]
    below = F.array(*[F.xxhash64("node", o, _value(o)) for o in orders])
    return rows.join(classes.select("id", "sketch"), "id").select("id", F.explode(below).alias("node"))


def by_size(rows: DataFrame, percent: int) -> DataFrame:
    """(node, id) of these nodes (node, id, n) cut into bands of set sizes, each class in its own band and the next; linked classes share one."""
    band = F.floor(F.log("n") / F.log(F.lit(100 / percent)) - F.lit(1e-9))
    below = [F.struct(F.xxhash64("node", F.lit("size"), band + F.lit(k)).alias("node"), F.lit(k == 0).alias("own")) for k in range(2)]
    held = rows.select("id", F.explode(F.array(*below)).alias("b")).select("b.*", "id")
    # a band without classes of its own holds only pairs that the one before it holds, too
    return held.join(held.where("own").select("node").distinct(), "node", "left_semi").select("node", "id")


def unsettled(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """The rows (node, id and more) with label, size, n_main and main, of nodes with classes not yet connected; main is the commonest label."""
    if found is None:
        sizes = rows.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        held = rows.join(sizes, "node").withColumn("label", F.col("id"))
        return saved(held.withColumns({"n_main": F.lit(1).cast("long"), "main": F.col("id")}))
    held = rows.join(found.select(F.col("vertex").alias("id"), "component"), "id", "left")
    held = held.select(*rows.columns, F.coalesce("component", "id").alias("label"))
    counts = held.groupBy("node", "label").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("node").agg(F.sum("n").alias("size"), F.max(F.struct("n", "label")).alias("m"))
    sizes = sizes.select("node", "size", F.col("m.n").alias("n_main"), F.col("m.label").alias("main")).where("n_main < size")
    return saved(held.join(sizes, "node"))


def groups_of(rows: DataFrame) -> DataFrame:
    """(group, id): leaves whole, larger nodes in blocks."""
    return leaf_groups(rows.where(F.col("size") <= LEAF)).unionByName(block_groups(rows.where(F.col("size") > LEAF)))


def leaf_groups(leaves: DataFrame) -> DataFrame:
    """(group, id): each set of classes that is some leaf, once."""
    held = leaves.groupBy("node").agg(F.sort_array(F.collect_set("id")).alias("ids"))  # at most LEAF
    held = held.select("ids").distinct()
    return held.select(F.xxhash64("ids").alias("group"), F.explode("ids").alias("id"))


def block_groups(large: DataFrame) -> DataFrame:
    """(group, id): blocks of each large node, its hubs in every one."""
    count = F.ceil(F.col("size") / LEAF)
    block = F.pmod(F.xxhash64("id", F.lit("block")), count)
    own = large.select("node", "id", "size", block.alias("block"))
    ranked = F.struct(F.xxhash64("node", "id").alias("rank"), F.col("id"))
    hubs = large.groupBy("node", "size").agg(F.min(ranked).alias("h0"), *[_least_in_part(ranked, k) for k in range(1, HUBS)])
    hubs = hubs.select("node", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("block"), F.explode(F.array(*[f"h{k}" for k in range(HUBS)])).alias("h"))
    hubs = hubs.where("h IS NOT NULL").select("node", "block", F.col("h.id").alias("id"))
    both = own.select("node", "block", "id").unionByName(hubs).distinct()
    return both.select(F.xxhash64("node", "block").alias("group"), "id")


def _least_in_part(ranked, k: int):
    """The first in one of several parts of the node: a hub that differs from the others."""
    return F.min(F.when(F.pmod(F.xxhash64("id", F.lit("hub")), F.lit(HUBS - 1)) == k - 1, ranked)).alias(f"h{k}")


def _cells() -> tuple:
    """Into how many blocks a node's classes are dealt, and into how many parts those outside its main component."""
    size, half = F.col("size"), CELL // 2
    return F.ceil(size / half), F.ceil((size - F.col("n_main")) / half)


def stray_groups(rows: DataFrame) -> DataFrame:
    """(group, id): cells in which classes outside their node's main component meet all of the node."""
    n_blocks, n_parts = _cells()
    block = F.pmod(F.xxhash64("id", F.lit("cell")), n_blocks)
    part = F.pmod(F.xxhash64("id", F.lit("part")), n_parts)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    down = rows.select("node", "id", block.alias("block"), every(n_parts).alias("part"))
    across = rows.where("label <> main").select("node", "id", part.alias("part"), every(n_blocks).alias("block"))
    cells = down.unionByName(across.select("node", "id", "block", "part")).distinct()
    return cells.select(F.xxhash64("node", "block", "part", F.lit("stray")).alias("group"), "id")


def _alike(marks: np.ndarray) -> np.ndarray:
    """In how many places the sketches agree, of each with each."""
    return np.array([(marks == m).sum(axis=1) for m in marks])


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from products of 0/1 matrices over the shingles that two sets have."""
    names, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = times[column] > 1
    row, column = row[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, (first, first + 4096))
        part = np.zeros((len(sets), 4096), np.float32)
        part[row[a:b], column[a:b] - first] = 1
        out += part @ part.T
    return out


def _compared(ids, labels, marks: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between classes of a group that are not yet connected, enough to connect what belongs together."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    if len(ids) < 2:
        return []
    sizes = np.array([len(x) for x in sets])
    out, todo, agreeing = [], np.ones(len(ids), bool), _alike(marks)
    near = 100 * np.minimum.outer(sizes, sizes) >= percent * np.maximum.outer(sizes, sizes)
    near &= agreeing >= LEAST_AGREEING
    common = _common(sets) if near.sum() > 40 * len(ids) else None
    if common is not None:
        near &= 100 * common >= percent * (np.add.outer(sizes, sizes) - common)
    # what resembles most others first: its links spare the others' comparisons
    for i in np.argsort(-agreeing.sum(axis=1), kind="stable"):
        todo[i] = False
        for j in np.flatnonzero(todo & near[i]):
            a, b = find(labels[i]), find(labels[j])
            if a == b:
                continue
            both = common[i, j] if common is not None else overlap(sets[i], sets[j])
            if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                root[a] = b
                out.append((ids[i], ids[j]))
    return out


def _runs(batches, names: list[str]):
    """Tables of whole groups, from batches in which the rows of a group follow each other."""
    held = None
    for batch in blocks(batches, names[-1], 2 << 20):
        table = pa.Table.from_batches([batch.select(names)])
        table = pa.concat_tables([held, table]) if held else table
        group = table["group"].to_numpy()
        last = len(group) - int(np.argmin(group[::-1] == group[-1])) if (group != group[-1]).any() else 0
        held = table.slice(last).combine_chunks()
        if last:
            yield table.slice(0, last).combine_chunks()
    if held:
        yield held


def _cuts(table: pa.Table) -> list[tuple[int, int]]:
    group = table["group"].to_numpy()
    at = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(group)]))
    return list(zip(at[:-1], at[1:]))


def _marks(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint32).reshape(-1, SKETCH)


def partnered(rows: DataFrame, percent: int) -> DataFrame:
    """The rows (group, id, label, key, n, sketch) that have a possible partner of another label in their group."""
    names = ["group", "id", "label", "key", "n", "sketch"]

    def run(batches):
        for table in _runs(batches, names):
            marks, labels, n = _marks(table), table["label"].to_numpy(), table["n"].to_numpy()
            keep = np.zeros(len(n), bool)
            for a, b in _cuts(table):
                own, size = labels[a:b], n[a:b]
                for i in range(b - a):
                    alike = (marks[a:b] == marks[a + i]).sum(axis=1) >= LEAST_AGREEING
                    near = (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])) & (own != own[i])
                    keep[a + i] = (alike & near).any()
            if keep.any():
                yield from table.filter(pa.array(keep)).to_batches()

    spread = rows.repartition("group").sortWithinPartitions("group").select(*names)
    return spread.mapInArrow(run, "group long, id long, label long, key binary, n long, sketch binary")


def confirmed(groups: DataFrame, classes: DataFrame, docs: DataFrame, found: DataFrame | None, shingle: int, percent: int) -> DataFrame:
    """Links a, b; classes with one label in `found` are not compared."""
    rows = groups.join(classes, "id")
    if found is None:
        rows = rows.withColumn("label", F.col("id"))
    else:
        rows = rows.join(found.select(F.col("vertex").alias("id"), F.col("component").alias("label")), "id", "left")
        rows = rows.withColumn("label", F.coalesce("label", "id"))
    rows = saved(partnered(rows, percent)).join(docs, "id")
    names = ["group", "id", "label", "key", "sketch", "text"]

    def run(batches):
        for table in _runs(batches, names):
            sets = shingle_sets(*word_hashes(table["text"].combine_chunks()), shingle)
            keys, ids, labels, marks = table["key"].to_pylist(), table["id"].to_pylist(), table["label"].to_pylist(), _marks(table)
            links = []
            for a, b in _cuts(table):
                # rows with the class's id but another text are not the class
                at = [k for k in range(a, b) if len(sets[k]) and digest(sets[k]) == keys[k]]
                links += _compared([ids[k] for k in at], [labels[k] for k in at], marks[at], [sets[k] for k in at], percent)
            if links:
                yield _links(links)

    return rows.repartition("group").sortWithinPartitions("group").select(*names).mapInArrow(run, "a long, b long")


def _links(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*links)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text")
    marked = saved(sketched(docs, shingle))
    least = F.min(F.struct("id", "sketch")).alias("c")
    classes = saved(marked.where("key IS NOT NULL").groupBy("key").agg(least, F.first("n").alias("n")).select("key", "n", "c.id", "c.sketch"))
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.sparkSession.table(bucketed(docs, n_parts, "id"))
    links = found = large = None

    def compare(groups: DataFrame) -> None:
        nonlocal links
        more = saved(confirmed(groups, classes, texts, found, shingle, percent))
        links = more if links is None else links.unionByName(more)

    def learn() -> None:
        nonlocal links, found
        links = stars(links, ROUNDS)
        found = labels(links)

    for trees in (range(1), range(1, TREES)):
        rows = unsettled(roots(classes, trees), found)
        cut = unsettled(by_size(rows.where(F.col("size") > LEAF).select("node", "id", "n"), percent), found)
        compare(groups_of(rows.where(F.col("size") <= LEAF).drop("n").unionByName(cut)))
        own = cut.where(F.col("size") > LEAF).select("node", "id")
        large = own if large is None else large.unionByName(own)
        if found is None:
            learn()
    for depth in range(DEPTH):
        if large.isEmpty():
            break
        learn()
        rows = unsettled(large, found)
        many = F.col("size") - F.col("n_main") > F.greatest(F.lit(LEAF), F.col("size") / FEW_STRAYS)
        many = many & (sum(_cells()) > FEW_CELLS)
        if depth == DEPTH - 1:
            compare(stray_groups(rows))
        else:
            below = unsettled(branched(rows.where(many).select("node", "id"), classes), found)
            compare(stray_groups(rows.where(~many)).unionByName(groups_of(below)))
            large = below.where(F.col("size") > LEAF).select("node", "id")
    found = components(links)
    named = classes.join(found, classes["id"] == found["vertex"], "left").select("key", F.coalesce("component", "id").alias("component"))
    whole = marked.join(named, "key", "left").withColumn("component", F.coalesce("component", "id"))
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return whole.select(
        back("id").alias("doc_id"), F.col("n").alias("n_shingles"), back("component").alias("component_id"),
        (F.col("id") == F.col("component")).alias("kept"),
    )


def keep_first(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The least document of each component, with all columns; rows that repeat its doc_id stay with it."""
    first = near_duplicates(docs, shingle).where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(first, F.col("__kept").eqNullSafe(docs["doc_id"].cast("long")), "left_semi")


def op7_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
