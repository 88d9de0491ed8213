"""N-gram Jaccard join of documents: exact components of documents whose shingle sets have a similarity of at least PERCENT / 100.

Two levels of Voronoi regions of the Jaccard metric:

1. Over the corpus the pivots are the one-shingle sets.  A document's distance to the pivot {g} is below 1 exactly if it holds g, and
   alike for all it holds, so ties go by one global order of shingles.  The home region is the first; the window of the triangle inequality
   is that of prefix filtering: a document of n shingles is replicated to its first n - ceil(0.75 n) + 1 + floor(n / 12) regions,
   and two documents that link meet in a known number of them (`edges`).  (Documents as pivots can't split a corpus: nearly all distances are 1, and
   every window would hold everything.)  The order puts retired shingles last: those counted in `RETIRE` or more distinct
   sets, so that a passage in a third of all documents does not make a region.
2. A region is a star of candidate edges, never all pairs; connected stars form closed groups.  Each group of distinct sets is joined
   exactly by recursive Voronoi regions with documents as pivots: in one task (`voronoi_kernel`) up to `CHUNK_BYTES`.  Larger groups are first split by level 1
   over the group itself (`split`), and what stays beyond that is joined by shuffled rounds (`large_regions`): pivots go to
   all chunks of a region, every set's distances to them are measured, what is not connected to the main component asks on, and a region's
   asking sets meet the sets of its triangle windows in the next round.

Texts with equal sets are one class from the start.  Only classes, edges and labels are shuffled, and the sets of classes in groups of
two or more; shingle sets are made again from the texts where they are needed, which costs less than to store them.  Hashes of
shingles have 64 bits and those of sets 128.

Defined results: a null or wordless text has 0 shingles and links with nothing, not even with another such text; a text with fewer words than `width` is one
shingle; rows with repeated ids are documents each (also in `keep_one`), and the smallest id stands for all; null ids are never the smallest unless all
are null; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspark.llm import shared
from veilspark.llm.shingle_kernel import mix64, runs, shingle_sets
from veilspark.llm.voronoi_kernel import Region

WIDTH, PERCENT = 5, 75
#: Shingles of at least so many sets are last in order.  The set is sent to the tasks: `RETIRED_MOST` of the most frequent, 8 bytes each.
RETIRE, RETIRED_MOST = 48, 500_000
#: Shingles are counted in runs of about so many; of a run, those of at least COUNT_LEAST sets are added up over the corpus.
COUNT_RUN, COUNT_LEAST = 1_000_000, 4
#: The regions of the corpus are made in so many passes over the texts.
PASSES = 2
#: Bytes of shingles that a task joins at once; pivots of a larger region; rounds of regions before asking sets are dealt into blocks.
CHUNK_BYTES, CHUNK_PIVOTS, DEPTH = 16_000_000, 12, 3
#: Bytes that blocks and regions ship at once where that is more than twice the regions; windows of a round hold at most so many times the groups' bytes.
WAVE_BYTES, WINDOWS = 512_000_000, 4
BLOCK = 1000

SKETCH = "doc_id long, t1 long, t2 long, n long, d1 long, d2 long, g long, c long"
LINK = "a1 long, a2 long, b1 long, b2 long"


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    d = np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), dtype=np.int64)
    return int(d[0]), int(d[1])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches with the shingle sets of their `text`."""
    shared.lean()
    for batch in batches:
        out: list[np.ndarray] = []
        for _, data, offsets in runs(batch.column(batch.schema.get_field_index("text"))):
            out += shingle_sets(data, offsets, width)
        yield batch, out


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """A row (doc_id, t1, t2, n, d1, d2) for each document, and rows (g, c): c distinct sets of a run hold shingle g."""
    shared.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool: dict[tuple[int, int], np.ndarray] = {}
        held = 0

        def counted() -> pa.RecordBatch:
            g, c = np.unique(np.concatenate(list(pool.values())), return_counts=True)
            g, c = g[c >= COUNT_LEAST], c[c >= COUNT_LEAST]
            none = pa.nulls(len(g), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, none, none, pa.array(g.view(np.int64)), pa.array(c.astype(np.int64))], names)

        names = [f.split()[0] for f in SKETCH.split(", ")]
        for batch, sets in _sets(batches, width):
            digests = [_digest(s) for s in sets]
            n = [len(s) for s in sets]
            none = pa.nulls(len(sets), pa.int64())
            own = [batch.column(batch.schema.get_field_index(c)).cast(pa.int64()) for c in ("doc_id", "t1", "t2")]
            columns = [*own, pa.array(n, pa.int64()), pa.array([d for d, _ in digests], pa.int64()), pa.array([d for _, d in digests], pa.int64()), none, none]
            yield pa.RecordBatch.from_arrays(columns, names)
            for d, s in zip(digests, sets, strict=True):
                if len(s) and d not in pool:
                    pool[d] = s
                    held += len(s)
                if held >= COUNT_RUN:
                    yield counted()
                    pool, held = {}, 0
        if pool:
            yield counted()

    return docs.select("doc_id", "text", *shared.row_key("t1", "t2")).mapInArrow(run, SKETCH)


def _need(n):
    """Linked sets have at least so many common shingles among the regions of both, whatever the partner's size (columns or ints)."""
    return 1 + _most(n) // 12 if isinstance(n, int) else F.floor(_most(n) / 12) + 1


def _most(n):
    return -(-PERCENT * n // 100) if isinstance(n, int) else F.ceil(n * PERCENT / 100)


def edges(docs: DataFrame, retired: np.ndarray, width: int) -> DataFrame:
    """Distinct candidate edges (u, v), u > v, between classes (by d1).

    A set of n shingles enters k = n - ceil(0.75 n) + 1 + floor(n / 12) regions.  At most n - ceil(0.75 n) of its first k can be missing
    in a set it links with, so the two share `_need` regions or more, and what shares fewer drops out.  Of the rest each region is a
    star around its smallest class.  Star edges with few regions are left out, unless the regions a class loses by that
    could hide a link (half of `_need`): if none of the regions of a linked pair keeps both, one of the two has lost that many.

    Most regions have one class and go when the rows meet, so the rows are shuffled in `PASSES`, each with its share of the regions.
    """

    def run(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets in _sets(batches, width):
            regions, classes, sizes, hot = [], [], [], []
            for s in sets:
                n = len(s)
                if n == 0:
                    continue
                d = _digest(s)[0]
                if d in seen:
                    continue
                seen.add(d)
                k = n - _most(n) + 1 + n // 12
                if len(retired):
                    late = retired[np.minimum(np.searchsorted(retired, s), len(retired) - 1)] == s
                    s, late = np.concatenate((s[~late], s[late]))[:k], np.arange(k) >= (~late).sum()
                else:
                    s, late = s[:k], np.zeros(k, dtype=bool)
                own = mix64(s) % np.uint64(PASSES) == turn
                s, late = s[own], late[own]
                regions.append(s)
                classes.append(np.full(len(s), d, dtype=np.int64))
                sizes.append(np.full(len(s), n, dtype=np.int32))
                hot.append(late)
            if regions:
                columns = [np.concatenate(regions).view(np.int64), np.concatenate(classes), np.concatenate(sizes), np.concatenate(hot)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["g", "c", "n", "hot"])

    rows = [docs.select("doc_id", "text").mapInArrow(lambda batches, turn=turn: run(batches, turn), "g long, c long, n int, hot boolean") for turn in range(PASSES)]
    met = [shared.kept(_met(part).drop("first"), "regions") for part in rows]
    every = functools.reduce(DataFrame.unionByName, met)
    strong = every.groupBy("c").agg(F.count(F.lit(1)).alias("s"), F.max("n").alias("n")).where(F.col("s") >= _need(F.col("n"))).select("c")
    strong = shared.kept(strong, "strong")
    both = shared.kept(every.join(shared.if_small(strong), "c", "left_semi"), "strongregions")  # read three times
    shared.done(*met, strong)
    return _stars(both)


def _met(rows: DataFrame) -> DataFrame:
    """Rows of regions with two classes or more.  A retired shingle's region has many; it needs no meeting place."""
    region = W.partitionBy("r")
    seen = rows.withColumn("r", F.when(F.col("hot"), F.xxhash64("g", "c")).otherwise(F.col("g")))
    seen = seen.withColumn("first", F.min("c").over(region)).withColumn("last", F.max("c").over(region))
    return seen.where(F.col("hot") | (F.col("first") < F.col("last"))).drop("last", "r")


def _stars(both: DataFrame) -> DataFrame:
    """The edges of `edges` from its rows (g, c, n, hot), a kept table, which is deleted."""
    hot = both.where("hot")
    centres = shared.kept(hot.groupBy("g").agg(F.min("c").alias("first")), "centres")  # combined before the shuffle
    star = _met(both.where("NOT hot")).unionByName(hot.join(shared.if_small(centres), "g")).select("c", "n", F.col("first").alias("o"))
    star = shared.kept(star.groupBy("c", "n", "o").agg(F.count(F.lit(1)).alias("w")), "stars")
    shared.done(both, centres)
    safe = (F.col("o") == F.col("c")) | (F.col("w") * 2 >= _need(F.col("n")))
    lost = star.groupBy("c").agg(F.sum("w").alias("total"), F.sum(F.when(safe, 0).otherwise(F.col("w"))).alias("lost"))
    pairs = star.join(lost, "c").where(F.col("total") >= _need(F.col("n")))
    pairs = pairs.where((safe | (F.col("lost") * 2 >= _need(F.col("n")))) & (F.col("c") != F.col("o")))
    out = shared.kept(pairs.select(F.greatest("c", "o").alias("u"), F.least("c", "o").alias("v")).distinct(), "candidates")
    shared.done(star)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of each node of (u, v) edges; nodes of a component have one label, a node of it.

    Every node hooks to the smallest of itself and its neighbours, edges are taken over to the hooked nodes, loops and
    repeats go, until no edge is left.  The edge to the node it hooks to keeps a node's component whole.  Nodes are hashes, so chains
    of hooks are short and edges shrink by a factor each round.  Every round is written to the shared folder.
    """
    edges = shared.kept(edges.select("u", "v").where("u <> v").distinct(), "edges")
    labels = None
    while labels is None or edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = shared.kept(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("hook")), "hooks")
        at = lambda name: hooks.select(F.col("node").alias(f"{name}_"), F.col("hook").alias(f"{name}_hook"))  # noqa: B023, E731
        moved = edges.join(at("u"), F.col("u") == F.col("u_")).join(at("v"), F.col("v") == F.col("v_"))
        moved = moved.select(F.greatest("u_hook", "v_hook").alias("u"), F.least("u_hook", "v_hook").alias("v")).where("u <> v").distinct()
        moved = shared.kept(moved, "edges")
        if labels is None:
            step = hooks.select("node", F.col("hook").alias("label"))
        else:
            step = labels.join(at("l"), F.col("label") == F.col("l_"), "left").select("node", F.coalesce("l_hook", "label").alias("label"))
        step = shared.kept(step, "labels")
        shared.done(edges, hooks, *([] if labels is None else [labels]))
        edges, labels = moved, step
    shared.done(edges)
    return labels


def _members(rows: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype=np.uint64) for b in rows["shingles"]]


def _as_links(rows: pd.DataFrame, label: np.ndarray) -> pd.DataFrame:
    at = np.flatnonzero(label != np.arange(len(label)))
    d1, d2 = rows["d1"].to_numpy(), rows["d2"].to_numpy()
    return pd.DataFrame({"a1": d1[at], "a2": d2[at], "b1": d1[label[at]], "b2": d2[label[at]]})


def _join_parts(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links within each group of a bucket (`comp`)."""
    shared.lean()
    out = []
    for _, group in rows.groupby("comp", sort=True):
        group = group.sort_values(["d1", "d2"], ignore_index=True)
        out.append(_as_links(group, Region(_members(group), percent).join()))
    return pd.concat(out, ignore_index=True)


def _join_region(rows: pd.DataFrame, percent: int) -> tuple[pd.DataFrame, Region]:
    """Links that connect what `label` has not connected yet; `rows` have no repeats and the pivots first."""
    region = Region(_members(rows), percent)
    for at in rows.groupby("label").indices.values():
        for i in at[1:]:
            region.union(int(at[0]), int(i))
    before = region.roots(np.arange(len(rows))).copy()
    after = region.join()
    new = np.where((before == np.arange(len(rows))) & (after != before), after, np.arange(len(rows)))
    return _as_links(rows, new), region


def _asked(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links of a block of asking sets, and a chunk of a region, to each other."""
    shared.lean()
    rows = rows.sort_values(["asked", "d1", "d2"], ascending=[False, True, True]).drop_duplicates(["d1", "d2"], ignore_index=True)
    return _join_region(rows, percent)[0]


def _measured(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links within a chunk and its region's pivots, and each set's distances to the pivots (in the order of their digests)."""
    shared.lean()
    rows = rows.sort_values(["asked", "d1", "d2"], ascending=[False, True, True]).drop_duplicates(["d1", "d2"], ignore_index=True)
    links, region = _join_region(rows, percent)
    every, n = np.arange(len(rows)), int(rows["asked"].sum())
    common = [region.shared_with(every, p) for p in range(n)]
    near = np.stack([1 - c / np.maximum(1, region.size + region.size[p] - c) for p, c in enumerate(common)], axis=1)
    sets = pd.DataFrame({"a1": rows["d1"], "a2": rows["d2"], "home": near.argmin(axis=1).astype(np.int32), "near": list(near)})
    sets = pd.DataFrame({"a1": rows["d1"], "a2": rows["d2"], "home": near.argmin(axis=1).astype(np.int32), "near": list(near), "bytes": region.size * 8, "asks": rows["asks"]})[n:]
    out = pd.concat([links.assign(home=None, near=None, bytes=None, asks=None).astype(object), sets.assign(b1=None, b2=None).astype(object)], ignore_index=True)
    return out.assign(comp=rows["comp"].iloc[0], region=rows["region"].iloc[0])[[f.split()[0] for f in MEASURED.split(", ")]]


MEASURED = "comp long, region long, a1 long, a2 long, b1 long, b2 long, home int, near array<double>, bytes long, asks boolean"


def _waves(sizes: DataFrame, half: float) -> list[tuple[int, int]]:
    """(waves, wave) of the blocks that meet their whole regions: as many waves as keep what one ships at `WAVE_BYTES`, or at about
    twice the regions where these are larger.  At most a wave for each block of the largest region."""
    blocks, chunks = F.ceil(F.col("asking") / half), F.ceil(F.col("bytes") / half)
    ships = F.sum(F.col("bytes") * blocks + F.col("asking") * chunks)
    most, ships, total = sizes.where("flat").agg(F.max(blocks), ships, F.sum("bytes")).first()
    waves = max(1, min(int(most or 0), math.ceil(int(ships or 0) / max(WAVE_BYTES, 2 * int(total or 0)))))
    return [(waves, wave) for wave in range(waves)]


def large_regions(rows: DataFrame, percent: int) -> DataFrame:
    """LINK rows that connect exactly the linked sets of groups that are too large for a task; `rows`: (comp, d1, d2, shingles).

    A round takes pivots from the asking sets of a region, at first all of them, and measures every set's distance to them, chunk by chunk.  A
    pivot has met the whole region then.  Sets that links connect to the group's main component need not ask any more.  Asking sets that fit a task meet all chunks of
    their region, and that ends it.  More of them ask in the region of their nearest
    pivot q each, where they meet the sets y of its window: d(y, q) is at most t more than the region's radius and 2 t more than y's
    own distance.  Where the windows hold more than that (distances near 1 say nothing), and after `DEPTH` rounds, the asking sets of a region are dealt into blocks that
    fit a task, and each meets all chunks.  Sets are shuffled twice a round, by region and chunk.
    """
    t, half = 1 - percent / 100 + 1e-9, CHUNK_BYTES / 2
    node = F.xxhash64("d1", "d2")
    rows = shared.kept(rows.select("comp", F.col("comp").alias("region"), "d1", "d2", "shingles", F.lit(True).alias("asks"), node.alias("label"), F.lit(False).alias("stuck")), "large")
    found, main, whole = [], None, 0  # whole: bytes of the groups
    for depth in range(DEPTH + 1):
        weight = F.octet_length("shingles")
        sizes = rows.groupBy("region").agg(F.sum(weight).alias("bytes"), F.sum(F.when(F.col("asks"), weight).otherwise(0)).alias("asking"), F.max("stuck").alias("stuck"))
        sizes = sizes.where("asking > 0").withColumn("flat", (F.col("asking") <= half) | F.col("stuck") | F.lit(depth == DEPTH))
        sizes = shared.kept(sizes.drop("stuck"), "regionsizes")
        now = int(sizes.agg(F.sum("bytes")).first()[0] or 1)
        whole = whole or now
        pick = lambda n: F.pmod(F.xxhash64(F.lit(depth), "d1", "d2"), n)  # noqa: B023, E731
        sized = rows.join(shared.if_small(sizes), "region").withColumn("chunks", F.ceil(F.col("bytes") / half))
        sized = sized.withColumn("blocks", F.ceil(F.col("asking") / half)).withColumn("chunk", pick(F.col("chunks")))
        spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        columns = ["region", "block", "chunk", "d1", "d2", "label", "shingles", "asked"]

        for waves, wave in _waves(sizes, half):
            turn = F.pmod("block", F.lit(waves)) == wave
            flat = sized.where(F.col("flat") & (F.col("blocks") > wave))
            asking = flat.where("asks").withColumn("block", pick(F.col("blocks"))).where(turn).withColumn("chunk", spread("chunks")).withColumn("asked", F.lit(True))
            met = flat.withColumn("block", F.explode(F.sequence(F.lit(wave).cast("long"), F.col("blocks") - 1, F.lit(waves).cast("long")))).withColumn("asked", F.lit(False))
            met = asking.select(columns).unionByName(met.select(columns))
            found.append(shared.kept(met.groupBy("region", "block", "chunk").applyInPandas(lambda r: _asked(r, percent), LINK), "asked"))
        if not sizes.where("NOT flat").limit(1).count():
            shared.done(rows, sizes)
            break

        deep = shared.kept(sized.where("NOT flat").select("comp", "region", "chunks", "chunk", "d1", "d2", "label", "shingles", "asks"), "deep")
        first = [F.min(F.when(F.col("asks"), F.struct(F.xxhash64(F.lit(depth), F.lit(j), "d2", "d1").alias("h"), "d1", "d2"))).alias(f"p{j}") for j in range(CHUNK_PIVOTS)]
        pivots = deep.groupBy("region").agg(*first).select("region", F.explode(F.array(*[f"p{j}" for j in range(CHUNK_PIVOTS)])).alias("p")).select("region", "p.d1", "p.d2").distinct()
        pivots = shared.kept(pivots, "pivots")
        sets = deep.join(shared.if_small(pivots), ["region", "d1", "d2"], "left_semi").withColumn("chunk", spread("chunks")).withColumn("asked", F.lit(True))
        met = deep.withColumn("asked", F.lit(False)).unionByName(sets).drop("chunks")
        measured = shared.kept(met.groupBy("region", "chunk").applyInPandas(lambda r: _measured(r, percent), MEASURED), "measured")
        found.append(shared.kept(measured.where("home IS NULL").select("a1", "a2", "b1", "b2"), "regionlinks"))

        label = components(_edges_of(found))
        new = lambda key: F.coalesce(label["label"], key)  # noqa: B023, E731
        own = measured.where("home IS NOT NULL").select("comp", "region", F.col("a1").alias("d1"), F.col("a2").alias("d2"), "home", "near", "bytes", "asks")
        own = own.withColumn("own", node).join(label, F.col("own") == label["node"], "left").withColumn("now", new(F.col("own"))).drop("own", "node", "label")
        own = own_kept = shared.kept(own, "own")
        if main is None:  # a label of the largest component; as a set of it, it stays in the same component in later rounds
            main = shared.kept(own.groupBy("comp", "now").count().groupBy("comp").agg(F.max_by("now", F.struct("count", "now")).alias("top")), "main")
        top = main.join(label, F.col("top") == label["node"], "left").select("comp", new(F.col("top")).alias("main"))
        own = own.join(shared.if_small(top), "comp").withColumn("asks", F.col("asks") & (F.col("now") != F.col("main")))
        asking = own.where("asks").groupBy("region").agg(F.sum("bytes").alias("asking"))
        radius = own.where("asks").groupBy("region", F.col("home").alias("q")).agg(F.max(F.array_min("near")).alias("radius"))
        radius = radius.groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct("q", "radius"))).alias("radius"))  # CHUNK_PIVOTS at most
        ahead = shared.kept(asking.join(radius, "region"), "ahead")
        met = own.join(shared.if_small(ahead), "region")  # regions in which any set asks on
        least = F.array_min("near")

        def within(q: Column) -> Column:
            far, most = F.get("near", q), F.try_element_at("radius", q)
            return (F.col("asks") & (F.col("home") == q)) | (most.isNotNull() & (far <= least + 2 * t) & (far <= most + t))

        windows = F.filter(F.sequence(F.lit(0), F.size("near") - 1), within)
        met = shared.kept(met.select("region", "d1", "d2", "asks", "home", "asking", "bytes", F.col("now").alias("label"), windows.alias("windows")), "met")
        # Windows that hold more than the blocks of asking sets would meet, or than disk should, split nothing: the region stays whole and its blocks meet it next.
        weighed = met.groupBy("region").agg(F.sum(F.col("bytes") * F.size("windows")).alias("reach"), F.sum("bytes").alias("all"), F.first("asking").alias("asking"))
        weighed = weighed.select("region", (F.col("asking") <= half).alias("one"), (F.col("reach") > F.least(F.ceil(F.col("asking") / half), F.lit(max(1.0, WINDOWS * whole / now))) * F.col("all")).alias("stuck"))
        weighed = shared.kept(weighed, "weighed")
        goes = met.join(shared.if_small(weighed), "region").withColumn("whole", F.col("one") | F.col("stuck"))
        goes = goes.select("region", "d1", "d2", "asks", "home", "label", "whole", "stuck", F.explode(F.when(F.col("whole"), F.array(F.lit(-1))).otherwise(F.col("windows"))).alias("q"))
        asks = F.col("asks") & (F.col("whole") | (F.col("home") == F.col("q")))
        goes = goes.select("region", "d1", "d2", F.xxhash64("region", "q", F.lit(depth)).alias("to"), asks.alias("asks"), "label", "stuck")
        following = deep.drop("asks", "label").join(goes, ["region", "d1", "d2"]).select("comp", F.col("to").alias("region"), "d1", "d2", "shingles", "asks", "label", "stuck")
        following = shared.kept(following, "large")
        shared.done(rows, sizes, deep, pivots, measured, label, own_kept, ahead, met, weighed)
        rows = following
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _edges_of(links: list[DataFrame]) -> DataFrame:
    """(u, v) of LINK rows, by nodes."""
    out = None
    for part in links:
        rows = part.select(F.xxhash64("a1", "a2").alias("u"), F.xxhash64("b1", "b2").alias("v")).where("u <> v")
        out = rows if out is None else out.unionByName(rows)
    return out


def class_links(members: DataFrame, percent: int) -> DataFrame:
    """LINK rows that connect exactly the linked sets of `members` (comp, d1, d2, shingles); comps are closed.

    Groups that are too large for a task are split by their own counts, again while that halves their bytes; what is left is joined in shuffled rounds.
    """
    spark, found, before, own = members.sparkSession, [], None, []
    while True:
        sizes = members.groupBy("comp").agg(F.sum(F.octet_length("shingles")).alias("bytes"), F.count(F.lit(1)).alias("classes"))
        sizes = shared.kept(sizes.where("classes > 1"), "groupsizes")
        fits = F.col("bytes") <= CHUNK_BYTES
        total, over = sizes.agg(F.sum(F.when(fits, F.col("bytes"))), F.sum(F.when(~fits, F.col("bytes")))).first()
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total or 0) // (CHUNK_BYTES // 2)))
        small = members.join(shared.if_small(sizes.where(fits).select("comp")), "comp")
        small = small.withColumn("part", F.pmod(F.xxhash64("comp"), F.lit(buckets)))
        found.append(shared.kept(small.groupBy("part").applyInPandas(lambda rows: _join_parts(rows, percent), LINK), "links"))
        if not over:
            break
        big = members.join(shared.if_small(sizes.where(~fits).select("comp")), "comp")
        if before is not None and over > before / 2:
            found.append(large_regions(big, percent))
            break
        before, members = over, split(big)
        shared.done(sizes, *own)
        own = [members]
    shared.done(sizes, *own)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def split(members: DataFrame) -> DataFrame:
    """`members` (comp, d1, d2, shingles) by smaller closed groups; sets that can link with no other go.

    The regions of `edges` once more, within each group and in the order of the group's own counts, rarest first.  Over the corpus only
    retired shingles are known to be frequent, and sets of different texts that hold the same few passages or lines share the regions of all
    others; such groups grow faster than the corpus.  In a group's own order these shingles come last, and few sets' first regions reach them.
    A shingle counts by its group (`r`), shingles of a single set make no region, and work and bytes grow with the shingles of the groups; the
    sets that hold a shingle meet in one task, 20 bytes each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.lean()
        for batch in batches:
            for comp, d, b in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                g = np.frombuffer(b, dtype=np.uint64)
                r = mix64(g + mix64(np.array([comp], dtype=np.int64).view(np.uint64))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(np.full(len(r), d)), pa.array(np.full(len(r), len(r), dtype=np.int32))], ["g", "c", "n"])

    rows = members.select("comp", "d1", "shingles").mapInArrow(run, "g long, c long, n int")
    counted = rows.withColumn("k", F.count(F.lit(1)).over(W.partitionBy("g"))).where("k > 1")  # the rows are shuffled once for that, not joined to their counts
    common = counted.groupBy("c", "n").agg(F.sort_array(F.collect_list(F.struct("k", "g"))).alias("s"))
    regions = F.col("n") - _most(F.col("n")) + 1 + F.floor(F.col("n") / 12)
    common = common.withColumn("left", (regions - (F.col("n") - F.size("s"))).cast("int")).where(F.col("left") >= _need(F.col("n")))
    first = common.select("c", "n", F.explode(F.slice("s", 1, F.col("left"))).alias("x"))
    both = shared.kept(first.select("x.g", "c", "n", (F.col("x.k") >= RETIRE).alias("hot")), "groupregions")
    candidates = _stars(both)
    label = components(candidates)
    shared.done(candidates)
    groups = label.select(F.col("node").alias("d1"), F.col("label").alias("comp"))
    out = shared.kept(members.drop("comp").join(shared.if_small(groups), "d1").select("comp", "d1", "d2", "shingles"), "splitmembers")
    shared.done(label)
    return out


def _pairs_of_blocks(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """All linked pairs within a block, or between two blocks."""
    rows = rows.sort_values(["d1", "d2"], ignore_index=True)
    region, pairs = Region(_members(rows), percent), []
    low = (rows["block"] == rows["low"]).to_numpy()
    at, other = np.flatnonzero(low), np.flatnonzero(~low)
    if rows["low"].iloc[0] == rows["high"].iloc[0]:
        region.prefix_join(at, None, pairs)
    elif len(at) and len(other):
        region.prefix_join(at, other, pairs)
    i, j = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
    d1, d2 = rows["d1"].to_numpy(), rows["d2"].to_numpy()
    return pd.DataFrame({"a1": d1[i], "a2": d2[i], "b1": d1[j], "b2": d2[j]})


def linked_pairs(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """LINK rows: every pair of classes (distinct sets, by their digests) that links, once each, (a1, a2) < (b1, b2).

    `jaccard_components` needs connectivity only and leaves most of them out.  Here all pairs of a group's blocks of about `BLOCK` sets meet; the
    rows, as many as there are links, grow with the square of a group of near copies.
    """
    _, members, _ = _classes(docs, width)
    sizes = shared.kept(members.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"), "groupsizes")
    sized = members.join(shared.if_small(sizes), "comp").withColumn("block", F.pmod(F.xxhash64("d1", "d2"), F.col("blocks")))
    met = sized.select("comp", "block", "d1", "d2", "shingles", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("o"))
    met = met.select("comp", "block", F.least("block", "o").alias("low"), F.greatest("block", "o").alias("high"), "d1", "d2", "shingles")
    return met.groupBy("comp", "low", "high").applyInPandas(lambda rows: _pairs_of_blocks(rows, PERCENT), LINK)


def _classes(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Rows (doc_id, t1, t2, n_shingles, d1, d2) of `docs`, (comp, d1, d2, shingles) of the classes that could link, and the tables these are read from; comps are closed."""
    sketch = shared.kept(sketches(docs, width), "sketch")
    heavy = sketch.where(F.col("g").isNotNull()).groupBy("g").agg(F.sum("c").alias("c")).where(F.col("c") >= RETIRE)
    heavy = heavy.orderBy(F.desc("c"), "g").limit(RETIRED_MOST).select("g").toArrow()["g"]  # 8 bytes each
    retired = np.sort(np.array(heavy.to_numpy(), dtype=np.int64).view(np.uint64))
    rows = sketch.where(F.col("n").isNotNull()).select("doc_id", "t1", "t2", F.col("n").alias("n_shingles"), "d1", "d2")

    candidates = edges(docs, retired, width)
    labels = components(candidates)
    shared.done(candidates)
    groups = labels.select(F.col("node").alias("d1"), F.col("label").alias("comp"))
    classes = rows.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("t1").alias("t1"))  # a row of it; by id, all rows without one would meet
    classes = classes.join(groups, "d1")
    alone = classes.groupBy("comp").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("comp")
    asked = shared.kept(classes.join(alone, "comp", "left_semi").select("t1", "d1", "d2", "comp"), "asked")
    texts = shared.among(docs.select("text", shared.row_key("t1", "t2")[0]), asked, ["t1"], "inner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, width):
            want = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            keep = [i for i, (s, w) in enumerate(zip(sets, want, strict=True)) if len(s) and _digest(s) == w]  # 64 bits of a row's key may be another row's
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array([sets[i].tobytes() for i in keep], pa.binary())], ["comp", "d1", "d2", "shingles"])

    members = texts.select("comp", "d1", "d2", "text").mapInArrow(run, "comp long, d1 long, d2 long, shingles binary")
    members = shared.kept(members.dropDuplicates(["d1", "d2"]), "members")
    shared.done(asked, labels)
    return rows, members, [sketch, members]


def labels_of(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, t1, t2, n_shingles, label) for each row of `docs`: (t1, t2) is its `shared.row_key`, `label` its component's or null without shingles."""
    rows, members, read = _classes(docs, width)
    label = components(_edges_of([class_links(members, PERCENT)]))

    labelled = rows.withColumn("node", F.xxhash64("d1", "d2")).join(label, "node", "left")
    labelled = labelled.select("doc_id", "t1", "t2", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("label", "node")).alias("label"))
    labelled = shared.kept(labelled, "labelled")
    shared.done(label, *read)
    return labelled


def jaccard_components(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of `docs` (doc_id, text)."""
    labelled = labels_of(docs, width)
    least = labelled.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = labelled.join(least, "label", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row of each component, that with the smallest id (ties by text hash), and every row without shingles; columns as they were.

    Rows are told apart by id and text, so neither a repeated nor a null id takes other texts with it.  Of rows with the same id and the same text
    one stays, any of them.
    """
    every = labels_of(docs, width)
    labelled = every.where(F.col("label").isNotNull()).select("doc_id", "t1", "t2", "label")
    first = labelled.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "t1", "t2")).alias("first"))
    first = first.select("label", F.col("first.t1").alias("f1"), F.col("first.t2").alias("f2"))
    stays = (F.col("t1") == F.col("f1")) & (F.col("t2") == F.col("f2"))
    gone = shared.kept(labelled.join(first, "label").where(~stays).select("t1", "t2").distinct(), "gone")
    twice = shared.kept(labelled.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("t1", "t2").join(gone, ["t1", "t2"], "left_anti"), "twice")
    shared.done(every)

    key = ["_t1", "_t2"]
    gone, twice = gone.toDF(*key), twice.toDF(*key)
    out = shared.among(docs.select("*", *shared.row_key(*key)), gone, key, "left_anti")
    if twice.limit(1).count():
        repeats = shared.among(out, twice, key, "left_semi").dropDuplicates(key)
        out = shared.among(out, twice, key, "left_anti").unionByName(repeats)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(shared.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM doc
), class AS (SELECT s, min(r) AS c, min(doc_id) AS least FROM sets WHERE len(s) > 0 GROUP BY s
), g AS (SELECT c, len(s) AS n, unnest(s) AS g FROM class
), link AS (
  SELECT a.c AS u, b.c AS v FROM g a JOIN g b ON a.g = b.g AND a.c <> b.c AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.c, b.c HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), reach(u, v) AS (SELECT c, c FROM class UNION SELECT reach.u, link.v FROM reach JOIN link ON reach.v = link.u
), found AS (SELECT reach.u AS c, min(class.least) AS component_id FROM reach JOIN class ON class.c = reach.v GROUP BY reach.u)
SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(found.component_id, sets.doc_id) AS component_id
FROM sets LEFT JOIN class ON sets.s = class.s LEFT JOIN found ON found.c = class.c
"""
