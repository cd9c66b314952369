"""Near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import dropped, read, ship, shuffle_parts, written
from .components import components

SHINGLE, THRESHOLD = 5, 0.8
#: 1 - (1 - s^2)^8 of pairs with similarity s meet in a band: 0.9997 at 0.8, all but 1 in 10^5 at 0.87.
BANDS, ROWS = 8, 2
#: A word in fewer than one document in RARE weighs 1, a word in every document LEAST_WEIGHT, between them by logarithm.
#: So only words in more documents need to be known: at most RARE times the different words of a mean document.
RARE, LEAST_WEIGHT = 1000, 0.5
#: Members that are tested against one copy of their hub's text.
HUB_MEMBERS = 256
#: Members of a bucket that are still apart are compared in blocks of so many, with BLOCK_WORDS words at most on
#: average, and so many shingles at once.
BLOCK, BLOCK_WORDS, COLUMNS = 768, 400_000, 2048


def _gamma_quantiles(n: int = 1 << 16) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution, P(x) = 1 - (1 + x) exp(-x), by bisection."""
    u = (np.arange(n) + 0.5) / n
    lo, hi = np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        low = 1 - (1 + mid) * np.exp(-mid) < u
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return (lo + hi) / 2


_GAMMA = _gamma_quantiles()
_U64 = np.uint64
_SEEDS = W.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _U64(0x9E3779B97F4A7C15))


def _bytes(column) -> list[bytes]:
    return [x or b"" for x in column.cast("binary").to_pylist()]


#: Different words that a task holds before it hands their counts on.
HELD_WORDS = 1 << 18


def _count_words(batches: Iterator) -> Iterator:
    """(word hash, documents that hold it), partial counts; a null word counts the documents with words."""
    import pyarrow as pa

    held, some = [], 0

    def summed() -> tuple[np.ndarray, np.ndarray]:
        words, at = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
        return words, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

    def rows(words: np.ndarray, counts: np.ndarray):
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "n"])

    for batch in batches:
        texts = _bytes(batch.column("t"))
        for lo, hi in W.chunks(texts):
            h, at = W.hashed(texts[lo:hi])
            some += int((np.diff(at) > 0).sum())
            doc = np.repeat(np.arange(hi - lo), np.diff(at))
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            words, counts = np.unique(h[np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])][: len(h)]], return_counts=True)
            held.append((words, counts))
            if sum(len(w) for w, _ in held) > HELD_WORDS:
                held = [summed()]
                if len(held[0][0]) > HELD_WORDS // 2:
                    yield rows(*held.pop())
    if held:
        yield rows(*summed())
    yield pa.RecordBatch.from_arrays([pa.array([None], type=pa.int64()), pa.array([some])], names=["word", "n"])


def word_weights(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes in order, their weights) of the words that weigh less than 1; frequencies are exact, over all documents.

    A weight depends on the share of documents alone, so it is the same at every size of the same mixture.
    """
    counts = written(docs.mapInArrow(W.lean(_count_words), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    total = (counts.where("word IS NULL").first() or [None, 0])[1]
    often = counts.where(F.col("word").isNotNull() & (F.col("n") * RARE > total)).toPandas()  # bounded, see RARE
    dropped(counts)
    words = often["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    share = often["n"].to_numpy(float)[order] / max(total, 1)
    weight = LEAST_WEIGHT + (1 - LEAST_WEIGHT) * -np.log(share) / np.log(RARE)
    return words[order], np.round(weight * 4096) / 4096


def weights_of(h: np.ndarray, weights: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    words, weight = weights
    if not len(words):
        return np.ones(len(h))
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    return np.where(words[at] == h, weight[at], 1.0)


def shingles(texts: list[bytes], weights: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(different shingles, weight of one, how many, where each text's begin and end, hash of each text's words, its words).

    A shingle weighs its count times the mean weight of its words; a text of fewer words than a shingle is one.
    """
    h, at = W.hashed(texts)
    n = np.diff(at)
    sums = W.window_sums(h)
    whole = W.window(sums, at[:-1], n)
    means = np.concatenate([[0.0], np.cumsum(weights_of(h, weights))])
    found, unit, many, bounds = [], [], [], [0]
    wide = W.window(sums, np.arange(max(0, len(h) - SHINGLE + 1)), SHINGLE) if len(h) >= SHINGLE else np.empty(0, np.uint64)
    weigh = np.round((means[SHINGLE:] - means[:-SHINGLE]) / SHINGLE * 4096) / 4096 if len(h) >= SHINGLE else np.empty(0)
    for i in range(len(texts)):
        if n[i] >= SHINGLE:
            lo, hi = at[i], at[i + 1] - SHINGLE + 1
            x, first, count = np.unique(wide[lo:hi], return_index=True, return_counts=True)
            found.append(x)
            unit.append(weigh[lo:hi][first])
            many.append(count)
        elif n[i]:
            found.append(whole[i : i + 1])
            unit.append(np.ones(1))
            many.append(np.ones(1, np.int64))
        bounds.append(bounds[-1] + (len(found[-1]) if n[i] else 0))
    none = np.empty(0)
    return np.concatenate(found or [none.astype(np.uint64)]), np.concatenate(unit or [none]), np.concatenate(many or [none.astype(np.int64)]), np.array(bounds), whole, n


def signatures(x: np.ndarray, w: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Band keys (texts x BANDS) of texts that all have a shingle.

    A sample takes, for shingle x of weight w, r and c from Gamma(2, 1) and b from (0, 1), all by hash; with
    t = floor(ln w / r + b) the shingle of least ln c - r (t - b + 1) is drawn, along with t. Two texts draw the same
    with probability equal to their weighted Jaccard similarity.
    """
    log_w, sizes, first = np.log(w), np.diff(bounds), bounds[:-1]
    drawn = np.empty((len(sizes), len(_SEEDS)), np.uint64)
    low = _U64(0xFFFF)
    for j, seed in enumerate(_SEEDS):
        z = W.mix(x ^ seed)
        r = _GAMMA[(z & low).astype(np.intp)]
        b = (((z >> _U64(16)) & low).astype(float) + 0.5) / 65536
        z2 = W.mix(z + seed)
        c = -np.log(((z2 & _U64(0xFFFFFFFF)).astype(float) + 0.5) * ((z2 >> _U64(32)).astype(float) + 0.5) / 2.0**64)
        t = np.floor(log_w / r + b)
        a = np.log(c) - r * (t - b + 1)
        least = np.repeat(np.minimum.reduceat(a, first), sizes)
        hit = np.flatnonzero(a == least)
        text = np.searchsorted(bounds, hit, side="right") - 1
        hit = hit[np.r_[True, text[1:] != text[:-1]]]
        drawn[:, j] = W.mix(x[hit] ^ (t[hit].astype(np.int64).view(np.uint64) * _U64(0x9E3779B97F4A7C15)) ^ seed)
    keys = np.zeros((len(sizes), BANDS), np.uint64)
    for j in range(ROWS):
        keys = W.mix(keys * _U64(3) + drawn[:, j::ROWS])
    return keys


def _sketch(shared):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = _bytes(batch.column("t"))
            for lo, hi in W.chunks(texts):
                x, unit, many, bounds, whole, n = shingles(texts[lo:hi], shared.value)
                w = unit * many
                some = np.flatnonzero(n)
                if not len(some):
                    continue
                inner = np.r_[bounds[some], bounds[-1]]
                keys = signatures(x, w, inner).view(np.int64)
                total = np.add.reduceat(w, inner[:-1])
                ids = [batch.column(c).take(pa.array(some + lo)) for c in ("id", "k")]
                cells = [*ids, pa.array(whole[some].view(np.int64)), pa.array(n[some]), pa.array(total), pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cells, names=["id", "k", "whole", "n", "w", "bands"])

    return run


def _one(text: bytes, weights: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x, unit, many, *_ = shingles([text], weights)
    return x, unit * many


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted different shingles, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum()
    return float(least / (a[1].sum() + b[1].sum() - least)) if len(a[0]) or len(b[0]) else 0.0


def _verify(shared, threshold: float):
    """Rows sorted by hub, part and whether they are members: the hub's text comes first, its members follow."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = None
        for batch in batches:
            keep = []
            for member, text in zip(batch.column("o").to_pylist(), _bytes(batch.column("t")), strict=True):
                own = _one(text, shared.value)
                if member:
                    keep.append(similarity(held, own) >= threshold)
                else:
                    held = own
                    keep.append(False)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    return run


def similarities(texts: list[bytes], split: int, weights: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Weighted Jaccard similarity of all texts before ``split`` with all from it on.

    A shingle that occurs c times is c elements, so least weights are sums over common elements: a product of two
    0/1 matrices, a bounded number of columns at a time. Weights are multiples of 1/4096, so the sums are exact.
    """
    x, unit, many, bounds, *_ = shingles(texts, weights)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    total = np.bincount(text, unit * many, len(texts))
    at = np.repeat(np.arange(len(x)), many)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
    element, first, column = np.unique(W.mix(x[at] + nth.astype(np.uint64) * _U64(0xD6E8FEB86659FD93)), return_index=True, return_inverse=True)
    row, weight = text[at], unit[at][first]
    both = (np.bincount(column[row < split], minlength=len(element)) > 0) & (np.bincount(column[row >= split], minlength=len(element)) > 0)
    place = np.cumsum(both) - 1
    row, column, weight = row[both[column]], place[column[both[column]]], weight[both]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    least = np.zeros((split, len(texts) - split))
    for lo in range(0, len(weight), COLUMNS):
        i, j = np.searchsorted(column, (lo, lo + COLUMNS))
        dense = np.zeros((len(texts), min(COLUMNS, len(weight) - lo)))
        dense[row[i:j], column[i:j] - lo] = 1
        least += (dense[:split] * weight[lo : lo + COLUMNS]) @ dense[split:].T
    whole = total[:split, None] + total[None, split:] - least
    return np.divide(least, whole, out=np.zeros_like(least), where=whole > 0)


def _joining(i: np.ndarray, j: np.ndarray, labels: list) -> list[int]:
    """Of links i-j, the places of those that join labels not yet joined."""
    root: dict = {}

    def find(x):
        while (up := root.get(x, x)) != x:
            x = up
        return x

    out = []
    for n, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        a, b = find(labels[a]), find(labels[b])
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append(n)
    return out


def _compare(shared, threshold: float):
    """Rows sorted by (band, key, i, j), members of one block pair together: links between different labels."""

    def links(of: tuple, rows: list[tuple]) -> tuple[list, list]:
        rows.sort(key=lambda r: r[:2])
        node, label = [r[1] for r in rows], [r[2] for r in rows]
        texts = [r[3] for r in rows]
        if of[2] == of[3]:
            found, split = similarities(texts + texts, len(texts), shared.value), 0
        else:
            split = sum(r[0] == of[2] for r in rows)
            if split in (0, len(rows)):
                return [], []
            found = similarities(texts, split, shared.value)
        i, j = np.nonzero(found >= threshold)
        if not split:
            i, j = i[i < j], j[i < j]
        j = j + split
        joins = _joining(i, j, label)
        return [node[i[n]] for n in joins], [node[j[n]] for n in joins]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        of, rows = None, []

        def out(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("band", "key", "i", "j")), strict=True))
            cells = zip(*(batch.column(c).to_pylist() for c in ("block", "node", "label")), _bytes(batch.column("t")), strict=True)
            for key, row in zip(keys, cells, strict=True):
                if key != of:
                    if of:
                        yield out(*links(of, rows))
                    of, rows = key, []
                rows.append(row)
        if of:
            yield out(*links(of, rows))

    return run


def _row_hash(key: Column, text: str) -> Column:
    """A hash of a row's key and text; that of a null key is of the text alone."""
    return F.xxhash64(key, F.coalesce(text, F.lit("")))


def _bare(text: str) -> Column:
    """No text, or one without words."""
    return ~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(id, k, class_id, class_k): for every row its key, a hash of key and text, and both of the first row of its class.

    The first row is that of the smallest key, then of the smallest hash. ``class_k`` names the class: ``class_id`` alone
    does not where a key is null or has several texts.

    Classes are the connected components of the pairs whose weighted Jaccard similarity over TF-IDF shingles reaches
    ``threshold``. Texts of equal words are one node. Nodes meet in buckets of equal band keys. Each bucket first
    tests its members against one hub, so a group of copies costs as many tests as it has members. Buckets that still
    hold several components are then compared whole, in pairs of blocks of BLOCK members: pairs exist only inside a
    matrix product, and a task gives back just the links that join components, so none between components is lost.

    The weight of a shingle is its count times the mean inverse document frequency of its words (see ``word_weights``),
    held between LEAST_WEIGHT and 1: frequencies of whole shingles would make a large group of near copies frequent, and so less
    similar the larger it is. Texts without words are their own class, null keys rank last; repeated rows are each
    returned. Empty table: no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    ident = F.col(key).cast("long")
    base = docs.select(ident.alias("id"), _row_hash(ident, text).alias("k"), F.col(text).alias("t"))
    rank = [F.col("id").isNull().alias("last"), "id", "k"]
    shared = spark.sparkContext.broadcast(word_weights(base.select("t")))
    sketch = "id long, k long, whole long, n long, w double, bands array<long>"
    sketches = written(base.mapInArrow(W.lean(_sketch(shared)), sketch), "sketches")
    nodes = sketches.groupBy("whole", "n").agg(F.min(F.struct(*rank, "w", "bands")).alias("f"))
    nodes = written(nodes.select("whole", "n", "f.id", "f.k", "f.w", "f.bands"), "nodes")
    members = nodes.select(F.col("k").alias("node"), "w", F.posexplode("bands").alias("band", "key"))
    crowded = members.groupBy("band", "key").agg(F.count("*").alias("m"), F.min(F.struct("node", "w")).alias("h")).where("m > 1")
    members = written(members.join(crowded.select("band", "key", F.col("h.node").alias("hub"), F.col("h.w").alias("hub_w")), ["band", "key"]), "buckets")
    there = members.select(F.col("node").alias("k")).distinct()
    wanted = written(base.select("k", "t").join(there, "k", "left_semi").dropDuplicates(["k"]), "texts")
    ratio = lambda x, y: F.least(x, y) >= threshold * F.greatest(x, y) * (1 - 1e-9)

    pairs = members.where("node <> hub").where(ratio(F.col("w"), F.col("hub_w"))).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    pairs = written(pairs, "pairs")
    # A hub's text goes once to every HUB_MEMBERS of its members.
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_MEMBERS).alias("parts"))
    texts = wanted.select(F.col("k").alias("b"), "t")
    rest = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").alias("part"), F.lit(True).alias("o"), "b").join(texts, "b")
    heads = parts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(False).alias("o"), F.col("a").alias("b")).join(texts, "b")
    tests = rest.unionByName(heads).repartition(shuffle_parts(spark), "a", "part").sortWithinPartitions("a", "part", "o").select("a", "b", "o", "t")
    links = written(tests.mapInArrow(W.lean(_verify(shared, threshold)), "a long, b long"), "links")
    dropped(pairs)

    now = members.drop("hub", "hub_w").join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = now.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m"), F.sum("w").alias("words")).where("lo <> hi")
    now = now.join(apart.select("band", "key", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("words") / BLOCK_WORDS)).cast("int").alias("blocks")), ["band", "key"])
    now = now.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meet = ["band", "key", "i", "j"]
    now = now.select("band", "key", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "node", "label")
    now = now.join(wanted.select(F.col("k").alias("node"), "t"), "node").repartition(shuffle_parts(spark), *meet).sortWithinPartitions(*meet)
    links = links.unionByName(written(now.mapInArrow(W.lean(_compare(shared, threshold)), "a long, b long"), "links"))
    labels = components(links)
    for table in (wanted, members, links):
        dropped(table)
    named = nodes.join(labels.withColumnRenamed("node", "k"), "k", "left").select("whole", "n", "id", "k", F.coalesce("label", "k").alias("label"))
    lowest = named.groupBy("label").agg(F.min(F.struct(*rank)).alias("f"))
    named = named.join(lowest, "label").select("whole", "n", F.col("f.id").alias("class_id"), F.col("f.k").alias("class_k"))
    out = sketches.select("id", "k", "whole", "n").join(named, ["whole", "n"]).select("id", "k", "class_id", "class_k")
    bare = base.where(_bare("t")).select("id", "k", F.col("id").alias("class_id"), F.col("k").alias("class_k"))
    return out.unionByName(bare)


def op5_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """(doc_id, first_id, class_id): ``class_id`` is a hash that no other class has, ``first_id`` the smallest doc_id."""
    out = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), F.col("class_id").alias("first_id"), F.col("class_k").alias("class_id"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class the row with the smallest doc_id; documents without words all stay."""
    worded = docs.where(~_bare("text"))
    found = near_duplicates(worded.select("doc_id", "text"))
    first = found.where("id <=> class_id AND k = class_k").select(F.col("id").alias("first"), "k").distinct()
    ident = F.col("doc_id").cast("long")
    rows = worded.select(F.struct("*").alias("_row"), ident.alias("id"), _row_hash(ident, "text").alias("k"))
    kept = rows.join(first, (rows["k"] == first["k"]) & F.col("id").eqNullSafe(F.col("first")), "left_semi").dropDuplicates(["id", "k"]).select("_row.*")
    return kept.unionByName(docs.where(_bare("text")))
