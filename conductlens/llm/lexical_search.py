"""Ranked lexical search: exact inner-product search in sparse ball trees.

A document is a sparse vector of whole numbers, one for each of its terms that
some query asks for; a query is a set of terms; the score is the sum of the
document's numbers over the query's terms.  Documents are ordered by a coarse
direction and by length and cut into blocks; every block is a ball tree (a
centroid and a radius for each subtree).  A query visits subtrees best first
and leaves out those whose bound is below its k-th score so far; leaves are
scored in whole numbers.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from conductlens.functions.staging import global_index, stage

#: fixed values of the score: terms are runs of ASCII letters and digits and of all characters beyond ASCII
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
BLOCK = 2048  # documents of a tree
LEAF = 64  # documents of a leaf
CHUNK = 256  # queries that one task takes through one tree
FILTER_BITS = 22  # the filter of query terms: 2^22 bits, 512 KB, whatever the number of terms
ROWS = 500  # documents whose counted terms are held at once
SIGNS = 4  # signed sums of a vector that tell its direction
SAFE = 1e-9  # relative error allowed to bounds; sums of doubles have a far smaller one


def _words(texts: pa.Array) -> Iterator[Counter]:
    for text in texts.cast(pa.binary()):
        yield Counter(TERM.findall(text.as_py().lower())) if text.is_valid else Counter()  # lower() of bytes changes A-Z only


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, term): the distinct terms of queries."""
    for batch in batches:
        items, terms = [], []
        for item, words in zip(batch["item"].to_pylist(), _words(batch["text"]), strict=True):
            items += [item] * len(words)
            terms += words
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(terms, pa.binary()).cast(pa.string())], names=["item", "term"])


def _counted(bits) -> object:
    """(doc_id, n, terms, tfs) of documents: all terms are counted, those that the filter passes are returned."""
    mask = (1 << FILTER_BITS) - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little")
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            n, terms, tfs = [], [], []
            for words in _words(batch["text"]):
                n.append(words.total())
                kept = [t for t in words if flags[zlib.crc32(t) & mask]]
                terms.append([t.decode() for t in kept])
                tfs.append([words[t] for t in kept])
            columns = [batch["doc_id"], pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.string())), pa.array(tfs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tfs"])

    return count


def _filter(terms: DataFrame) -> bytearray:
    """A bit for the hash of each term; Spark makes it in pieces of 4 KB, of which there are at most 128."""
    slot = F.crc32(F.col("term").cast("binary")).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    # bitmap positions count from 1 within a bucket, and a bucket from 1
    made = terms.groupBy(F.bitmap_bucket_number(slot + 1).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot + 1)).alias("bits"))
    out = bytearray(1 << (FILTER_BITS - 3))
    for row in made.collect():
        out[(row.b - 1) * 4096 : row.b * 4096] = row.bits
    return out


def _vectors(documents: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vectors, terms): row, doc_id, tids, values of documents that share a term with a query; and tid, term.

    A value is the term's part of the score, its weight times its saturated count.
    """
    spark = documents.sparkSession
    bits = spark.sparkContext.broadcast(bytes(_filter(wanted)))
    read = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = stage(read.mapInArrow(_counted(bits), "doc_id long, n long, terms array<string>, tfs array<long>"))
    counted = stage(counted.withColumn("row", F.monotonically_increasing_id()))
    whole = counted.agg(F.count(F.when(F.col("n") > 0, 1)).alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_terms")).first()
    df = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * whole.n_docs + 2) / (F.lit(2.0) * F.col("df") + 1)))
    terms = stage(df.join(wanted.select("term").distinct(), "term").select("term", weight.alias("w")).where("w > 0").withColumn("tid", F.monotonically_increasing_id()))
    m = F.expr(f"50 + (50 * n * {whole.n_docs}L) div {max(whole.n_terms, 1)}L").alias("m")
    postings = counted.select("row", "doc_id", m, F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf")))).join(terms, "term")
    value = F.expr("w * ((1000000000L * tf) div (1000L * tf + 20L * m))")
    sign = [(1 - F.shiftright(F.xxhash64("tid"), k).bitwiseAND(F.lit(1)) * 2) for k in range(SIGNS)]
    gathered = postings.select("row", "doc_id", "tid", value.alias("value"), *[s.alias(f"s{k}") for k, s in enumerate(sign)]).where("value > 0").groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("tid", "value")).alias("v"), F.sum(F.col("value").cast("double") * F.col("value")).alias("length"),
        *[(F.sum(F.col("value") * F.col(f"s{k}")) > 0).cast("int").alias(f"s{k}") for k in range(SIGNS)],
    )
    direction = F.concat(*[F.col(f"s{k}").cast("string") for k in range(SIGNS)])
    return gathered.select("row", "doc_id", "length", direction.alias("direction"), F.col("v.tid").alias("tids"), F.col("v.value").alias("values")), terms


TREE = (
    "block long, docs array<long>, known array<boolean>, offsets array<long>, tids array<long>, values array<long>, "
    "low array<int>, high array<int>, left array<int>, right array<int>, radius array<double>, c_offsets array<long>, c_tids array<long>, c_values array<double>"
)


def _build(table: pa.Table) -> pa.Table:
    """The ball tree of a block's documents, in a row of arrays.

    A node holds the documents low..high of the order that the tree gives them.  It is split in halves by how much nearer its documents
    are to the one that is farthest from its centroid than to the one that is farthest from that.  A radius is rounded up.
    """
    lists, numbers = table["tids"].combine_chunks(), table["values"].combine_chunks()
    offsets = np.asarray(lists.offsets, np.int64)
    offsets = offsets - offsets[0]
    all_tids, all_values = np.asarray(lists.flatten(), np.int64), np.asarray(numbers.flatten(), np.int64)
    names, slots = np.unique(all_tids, return_inverse=True)
    order, nodes, todo = np.arange(len(offsets) - 1), [], [(0, len(offsets) - 1)]
    child: dict[int, list[int]] = {}
    parents = [-1]
    floats = all_values.astype(np.float64)
    squares = np.add.reduceat(floats * floats, offsets[:-1])

    def entries(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the documents' entries, and where each document's begin."""
        sizes = offsets[docs + 1] - offsets[docs]
        begins = np.concatenate([[0], np.cumsum(sizes)])
        return np.arange(begins[-1]) - np.repeat(begins[:-1], sizes) + np.repeat(offsets[docs], sizes), begins

    def away(docs_at: np.ndarray, begins: np.ndarray, docs: np.ndarray, point: np.ndarray) -> np.ndarray:
        """Squared distances of documents to a dense point."""
        dots = np.add.reduceat(floats[docs_at] * point[slots[docs_at]], begins[:-1])
        return np.maximum(squares[docs] - 2 * dots + point @ point, 0)

    def dense(doc: int) -> np.ndarray:
        out = np.zeros(len(names))
        out[slots[offsets[doc] : offsets[doc + 1]]] = floats[offsets[doc] : offsets[doc + 1]]
        return out

    while todo:
        low, high = todo.pop()
        at = len(nodes)
        if parents[at] >= 0:
            child.setdefault(parents[at], []).append(at)
        docs = order[low:high]
        here, begins = entries(docs)
        centre = np.bincount(slots[here], floats[here], len(names)) / len(docs)
        far = away(here, begins, docs, centre)
        used = np.flatnonzero(centre)
        # differences of squares lose digits: what they may have lost is added
        lost = SAFE * (squares[docs].max() + centre @ centre)
        nodes.append((low, high, np.sqrt(far.max() + lost) * (1 + SAFE), used, centre[used]))
        if high - low > LEAF:
            a = dense(docs[far.argmax()])
            to_a = away(here, begins, docs, a)
            to_b = away(here, begins, docs, dense(docs[to_a.argmax()]))
            order[low:high] = docs[np.argsort(to_a - to_b, kind="stable")]
            middle = (low + high) // 2
            # the stack gives the lower half first; both know their parent
            todo += [(middle, high), (low, middle)]
            parents[at + 1 : at + 1] = [at, at]
    here, begins = entries(order)
    docs = table["doc_id"].combine_chunks()
    kids = [child.get(k, [-1, -1]) for k in range(len(nodes))]
    c_sizes = np.concatenate([[0], np.cumsum([len(n[3]) for n in nodes])])
    row = {
        "block": int(table["block"][0].as_py()),
        "docs": docs.fill_null(0).to_numpy(zero_copy_only=False)[order],
        "known": docs.is_valid().to_numpy(zero_copy_only=False)[order],
        "offsets": begins,
        "tids": all_tids[here],
        "values": all_values[here],
        "low": [n[0] for n in nodes],
        "high": [n[1] for n in nodes],
        "left": [k[0] for k in kids],
        "right": [k[1] for k in kids],
        "radius": [n[2] for n in nodes],
        "c_offsets": c_sizes,
        "c_tids": names[np.concatenate([n[3] for n in nodes])],
        "c_values": np.concatenate([n[4] for n in nodes]),
    }
    kinds = {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "array<boolean>": pa.list_(pa.bool_())}
    fields = [f.strip().split(" ") for f in TREE.split(", ")]
    return pa.table([pa.array([row[name]], kinds[kind]) for name, kind in fields], names=[name for name, _ in fields])


def _descend(k: int):
    """Best-first search of one tree by the queries of one chunk: (item, doc, known, score) of each query's k best documents in it."""

    def search(key: tuple, trees: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if trees.num_rows and asked.num_rows:
            tree = {c: np.asarray(trees[c].combine_chunks().flatten()) for c in trees.column_names if c not in ("block", "chunk")}
            tree["known"] = tree["known"].astype(bool)
            for item, floor, tids in zip(asked["item"].to_pylist(), asked["floor"].to_pylist(), asked["tids"].to_pylist(), strict=True):
                hits = _best(tree, np.sort(np.asarray(tids, np.int64)), floor, k)
                found.append((np.full(len(hits[0]), item), *hits))
        columns = [np.concatenate([f[c] for f in found]) if found else [] for c in range(4)]
        return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.int64()), strict=True)], names=["item", "doc", "known", "score"])

    return search


def _best(tree: dict[str, np.ndarray], terms: np.ndarray, floor: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, known, score) of the k best documents, none below ``floor``; equal scores by ids, missing ids first."""
    asked = lambda tids: terms[np.minimum(np.searchsorted(terms, tids), len(terms) - 1)] == tids
    hit, there = np.where(asked(tree["tids"]), tree["values"], 0), asked(tree["c_tids"])
    dots = np.add.reduceat(np.where(there, tree["c_values"], 0.0), tree["c_offsets"][:-1])
    # the length of a query where it meets a subtree's documents: the root of the number of its terms that they hold
    shared = np.add.reduceat(there.astype(np.int64), tree["c_offsets"][:-1])
    bounds = np.where(shared > 0, np.ceil((dots + np.sqrt(shared) * tree["radius"]) * (1 + SAFE)) + 1, 0)
    docs, known, scores = np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)
    heap = [(-bounds[0], 0)]
    while heap and -heap[0][0] >= max(floor, 1):
        _, node = heapq.heappop(heap)
        if tree["left"][node] >= 0:
            for below in (tree["left"][node], tree["right"][node]):
                heapq.heappush(heap, (-bounds[below], below))
            continue
        low, high = tree["low"][node], tree["high"][node]
        begins = tree["offsets"][low : high + 1]
        got = np.add.reduceat(hit[begins[0] : begins[-1]], begins[:-1] - begins[0])
        good = np.flatnonzero(got >= max(floor, 1))
        docs, known, scores = (np.concatenate(x) for x in ((docs, tree["docs"][low:high][good]), (known, tree["known"][low:high][good]), (scores, got[good])))
        if len(scores) > k:
            top = np.lexsort((docs, known, -scores))[:k]
            docs, known, scores = docs[top], known[top], scores[top]
            floor = max(floor, int(scores[-1]))
    return docs, known, scores


def lexical_search(documents: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """The k best documents of each query: item_id, rank (int, from 1), doc_id, score (long).

    ``documents`` (doc_id long, text), ``queries`` (item_id, text).  With N documents that hold a term, L terms in all, n terms in a document, df
    documents that hold a term and tf of it in a document: the score sums floor(1000 ln((2N+2)/(2df+1))) * (10^9 tf div
    (1000 tf + 20 m)), m = 50 + 50 n N div L, over the query's distinct terms.  The trees hold only the terms that some query asks
    for: others cannot change an inner product.  Bounds are rounded up, so no document that belongs to the result is left out.

    Null and empty texts hold no terms: such documents are never found, such queries find nothing.  Rows are documents and queries
    of their own, also where ids repeat or are null; equal scores are ordered by ascending doc_id, null first.  Other columns are not
    read.  Without documents or queries the result is empty.

    Two searches: each query's best block gives it a floor, the k-th best score there; then the blocks whose bound reaches the floor are
    searched.  A task holds one tree (2,048 documents) and 256 queries.
    """
    items = stage(queries.select("item_id", F.col("text").cast("string").alias("text")).withColumn("item", F.monotonically_increasing_id()))
    wanted = stage(items.select("item", "text").mapInArrow(_terms_of, "item long, term string"))
    vectors, terms = _vectors(documents, wanted)
    placed = global_index(vectors, ["direction", "length", "row"], "nth").withColumn("block", F.floor(F.col("nth") / BLOCK))
    trees = stage(placed.select("block", "doc_id", "tids", "values").groupBy("block").applyInArrow(_build, TREE))
    asked = stage(wanted.join(terms, "term").select("item", "tid"))
    sizes = asked.groupBy("item").agg(F.sort_array(F.collect_list("tid")).alias("tids"))
    chunked = stage(global_index(sizes, ["item"], "nth").select("item", "tids", F.floor(F.col("nth") / CHUNK).alias("chunk")))
    # bounds of whole blocks: the root's centroid, over the terms that query and block share
    roots = trees.select("block", F.col("radius")[0].alias("radius"), F.slice("c_tids", F.lit(1), F.col("c_offsets")[1].cast("int")).alias("t"), F.slice("c_values", F.lit(1), F.col("c_offsets")[1].cast("int")).alias("c"))
    roots = roots.select("block", "radius", F.inline(F.arrays_zip(F.col("t").alias("tid"), F.col("c").alias("c"))))
    dots = roots.join(asked, "tid").groupBy("block", "item").agg(F.sum("c").alias("dot"), F.count(F.lit(1)).alias("shared"), F.first("radius").alias("radius"))
    bound = F.ceil((F.col("dot") + F.sqrt("shared") * F.col("radius")) * (1 + SAFE)) + 1
    pairs = stage(dots.join(chunked, "item").select("block", "item", "chunk", "tids", bound.alias("bound"), F.col("dot")))

    def search(todo: DataFrame) -> DataFrame:
        todo = stage(todo.select("block", "chunk", "item", "floor", "tids"))
        needed = todo.groupBy("block").agg(F.collect_set("chunk").alias("chunks")).select("block", F.explode("chunks").alias("chunk"))
        there = trees.join(needed, "block").groupBy("block", "chunk")
        return there.cogroup(todo.groupBy("block", "chunk")).applyInArrow(_descend(k), "item long, doc long, known boolean, score long")

    best = pairs.groupBy("item").agg(F.max_by("block", F.struct("dot", "block")).alias("best"))
    first = stage(search(pairs.join(best, "item").where("block = best").withColumn("floor", F.lit(1).cast("long"))))
    reached = first.withColumn("nth", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))).where(F.col("nth") == k).select("item", F.col("score").alias("floor"))
    rest = pairs.join(best, "item").where("block <> best").join(reached, "item", "left").withColumn("floor", F.coalesce("floor", F.lit(1)))
    found = first.unionByName(search(rest.where("bound >= floor")))
    doc = F.when(F.col("known"), F.col("doc"))
    by_score = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = found.withColumn("doc_id", doc).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return ranked.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
