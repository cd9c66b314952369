"""Substring dedup: suffix automata of reference shards and matching statistics."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import dropped, read, ship, shuffle_parts, written

WINDOW = 50
#: Words of the seeds by which windows are dealt to shards.
SEED_WORDS = 12
#: Words of one shard's reference; a shard with more is split by the words around its windows' seeds.
SHARD_WORDS = 65_536
#: Windows of one segment at most, so that a document of one repeated seed is not one piece.
RUN = 256


class Automaton:
    """A suffix automaton of several word sequences: every run of words that occurs in one of them is a path.

    Sequences are added by ascending id; ``first`` holds of every state the smallest id whose sequence has its runs.
    """

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]

    def _clone(self, p: int, q: int, w) -> int:
        new = len(self.next)
        self.next.append(self.next[q].copy())
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.first.append(self.first[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def add(self, sequence: list, ident: int = 0) -> None:
        last = 0
        for w in sequence:
            q = self.next[last].get(w)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, q, w)
                continue
            new = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            self.first.append(ident)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
            last = new

    def statistics(self, sequence: list) -> list[tuple[int, int]]:
        """At each word (length of the longest run ending there that occurs in the automaton, its state)."""
        out, v, n = [], 0, 0
        follow, link, length = self.next, self.link, self.length
        for w in sequence:
            while v and w not in follow[v]:
                v = link[v]
                n = length[v]
            to = follow[v].get(w)
            if to is None:
                n = 0
            else:
                v, n = to, n + 1
            out.append((n, v))
        return out

    def holders(self, sequence: list, window: int) -> list[tuple[int, int, int]]:
        """(first window, end, id): runs of windows that occur, each with the smallest id that holds them."""
        out: list[tuple[int, int, int]] = []
        link, length, first = self.link, self.length, self.first
        for i, (n, v) in enumerate(self.statistics(sequence)):
            if n < window:
                continue
            while length[link[v]] >= window:
                v = link[v]
            at, ident = i + 1 - window, first[v]
            if out and out[-1][1] == at and out[-1][2] == ident:
                out[-1] = (out[-1][0], at + 1, ident)
            else:
                out.append((at, at + 1, ident))
        return out


def _runs(same: np.ndarray, most: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of the runs in which ``same`` (is like the one before) holds, none longer than ``most``."""
    begin = np.flatnonzero(~same)
    size = np.diff(np.r_[begin, len(same)])
    parts = -(-size // most)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(begin, parts) + nth * most
    return first, np.minimum(first + most, np.repeat(begin + size, parts)) - 1


def _segments(texts: list[bytes], window: int, seed: int):
    """(text, seed hash, content hash, first word, words) of all segments: runs of windows with one least seed."""
    h, at = W.hashed(texts)
    if len(h) < window:
        return None
    sums = W.window_sums(h)
    low = W.sliding_min(W.window(sums, np.arange(len(h) - seed + 1), seed), window - seed + 1)
    text = np.repeat(np.arange(len(texts)), np.diff(at))
    ok = np.flatnonzero(at[text + 1][: len(low)] - np.arange(len(low)) >= window)
    if not len(ok):
        return None
    a, b = _runs(np.r_[False, (low[ok[1:]] == low[ok[:-1]]) & (ok[1:] == ok[:-1] + 1) & (text[ok[1:]] == text[ok[:-1]])])
    first, n = ok[a], ok[b] - ok[a] + window
    return text[first], low[first], W.window(sums, first, n), first - at[text[first]], n


def _split(words: bytes, window: int, seed: int, lo: int, hi: int):
    """Of a segment whose windows have ``lo`` to ``hi`` words before their seed: (low half or high, context hash,
    content hash, first window, words) of the runs of windows with the same half and context.

    The half that a window lies in is told by the words before its seed; all windows of a half hold the same stretch
    around their seeds, the context. Equal windows have equal halves and contexts.
    """
    h = W.hashed([words])[0]
    sums, many = W.window_sums(h), len(h) - window + 1
    seeds = W.window(sums, np.arange(len(h) - seed + 1), seed)
    before = np.argmin(np.lib.stride_tricks.sliding_window_view(seeds, window - seed + 1), axis=1)  # the leftmost least
    mid = (lo + hi + 1) // 2
    high = before >= mid
    low_end, high_end = np.where(high, mid, lo), np.where(high, hi, mid - 1)
    context = W.window(sums, np.arange(many) + before - low_end, low_end + window - high_end)
    a, b = _runs(np.r_[False, (high[1:] == high[:-1]) & (context[1:] == context[:-1])])
    return high[a], context[a], W.window(sums, a, b - a + window), a, b - a + window


def _bytes(column) -> list[bytes]:
    return [x or b"" for x in column.cast("binary").to_pylist()]


def _find(window: int, seed: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = _bytes(batch.column("t"))
            for lo, hi in W.chunks(texts):
                if got := _segments(texts[lo:hi], window, seed):
                    i, h, c, s, n = got
                    keys = [batch.column(x).take(pa.array(i + lo)) for x in ("k", "id")]
                    cells = [pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), *keys, pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cells, names=["h", "c", "k", "id", "s", "n"])

    return run


def _cut_out(batches: Iterator) -> Iterator:
    """The words of the segments that shards need."""
    import pyarrow as pa

    for batch in batches:
        out: dict[str, list] = {x: [] for x in ("h", "c", "n", "id", "words")}
        for text, ident, wanted in zip(_bytes(batch.column("t")), batch.column("id").to_pylist(), batch.column("want").to_pylist(), strict=True):
            words = text.split()
            for x in wanted:
                for name, v in (("h", x["h"]), ("c", x["c"]), ("n", x["n"]), ("id", ident), ("words", b" ".join(words[x["s"] : x["s"] + x["n"]]))):
                    out[name].append(v)
        kinds = {"h": pa.int64(), "c": pa.int64(), "n": pa.int32(), "id": pa.int64(), "words": pa.binary()}
        yield pa.RecordBatch.from_arrays([pa.array(out[x], type=kinds[x]) for x in kinds], names=[*kinds])


def _part(window: int, seed: int):
    """Pieces of shards that are too large, cut by context: each with the piece it came from and where it begins there."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            held = _bytes(batch.column("words"))
            lo, hi, h = (batch.column(x).to_numpy() for x in ("lo", "hi", "h"))
            rows: dict[str, list] = {x: [] for x in ("of", "h", "c", "n", "at", "words", "lo", "hi")}
            for i, words in enumerate(held):
                text, mid = words.split(), int(lo[i] + hi[i] + 1) // 2
                high, context, content, at, n = _split(words, window, seed, int(lo[i]), int(hi[i]))
                key = W.mix(W.mix(h[i : i + 1].view(np.uint64) + high.astype(np.uint64)) ^ context)
                for x, v in (("h", key.view(np.int64)), ("c", content.view(np.int64)), ("n", n), ("at", at)):
                    rows[x] += v.tolist()
                rows["of"] += [i] * len(at)
                rows["words"] += [b" ".join(text[s : s + m]) for s, m in zip(at, n, strict=True)]
                rows["lo"] += np.where(high, mid, lo[i]).tolist()
                rows["hi"] += np.where(high, hi[i], mid - 1).tolist()
            of = pa.array(rows["of"], type=pa.int64())
            kinds = {"h": pa.int64(), "c": pa.int64(), "n": pa.int32(), "at": pa.int32(), "words": pa.binary(), "lo": pa.int32(), "hi": pa.int32()}
            arrays = [batch.column(x).take(of) for x in ("h", "c", "n", "id")] + [pa.array(rows[x], type=kinds[x]) for x in kinds]
            yield pa.RecordBatch.from_arrays(arrays, names=["ph", "pc", "pn", "id", *kinds])

    return run


def _match(window: int):
    """Rows by shard and id: every piece of a shard passes through the automaton of all of them."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shard, held = None, {}

        def told() -> list[tuple]:
            automaton = Automaton()
            for i, words in held.values():
                automaton.add(words, i)
            return [(shard, c, n, [{"lo": a, "hi": b, "by": by} for a, b, by in automaton.holders(words, window)]) for (c, n), (_, words) in held.items()]

        spans = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("by", pa.int64())]))

        def out(rows: list[tuple]):
            columns = list(zip(*rows, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), spans), strict=True)], names=["h", "c", "n", "in"])

        for batch in batches:
            rows: list[tuple] = []
            for h, c, n, i, text in zip(*(batch.column(x).to_pylist() for x in ("h", "c", "n", "id", "words")), strict=True):
                if h != shard:
                    rows += told()
                    shard, held = h, {}
                held.setdefault((c, n), (i, text.split()))
            yield out(rows)
        yield out(told())

    return run


def _holders(pieces: DataFrame, of: DataFrame, window: int) -> DataFrame:
    """(h, c, n, in): of every different piece its windows as runs (lo, hi, by), ``by`` the smallest id that holds them.

    ``pieces``: h, c, n, id, words, lo, hi (how many words a window has before its seed); ``of``: the different h, c, n.
    Shards with more than SHARD_WORDS words are split by the words around the seeds, and those again, until they are
    small or all their windows are equal; what is found there is folded back into the pieces that were split.
    """
    spark = pieces.sparkSession
    size = of.groupBy("h").agg(F.sum("n").alias("words"), F.count("*").alias("m")).where((F.col("words") > SHARD_WORDS) & (F.col("m") > 1))
    large = written(size.select("h"), "large-shards")
    large = large.join(pieces.where("lo < hi").select("h").distinct(), "h", "left_semi") if large.limit(1).count() else large
    split = large.limit(1).count() > 0
    small = pieces.join(large, "h", "left_anti") if split else pieces
    sharded = small.select("h", "c", "n", "id", "words").repartition(shuffle_parts(spark), "h").sortWithinPartitions("h", "id", "c")
    matched = sharded.mapInArrow(W.lean(_match(window)), "h long, c long, n int, in array<struct<lo:int,hi:int,by:long>>")
    if not split:
        return matched
    schema = "ph long, pc long, pn int, id long, h long, c long, n int, at int, words binary, lo int, hi int"
    parts = written(pieces.join(large, "h", "left_semi").mapInArrow(W.lean(_part(window, SEED_WORDS)), schema), "parts")
    first = parts.groupBy("h", "c", "n").agg(F.min(F.struct("id", "words", "lo", "hi")).alias("f")).select("h", "c", "n", "f.*")
    first = written(first, "shards")
    back = parts.select("ph", "pc", "pn", "h", "c", "n", "at").join(_holders(first, first, window), ["h", "c", "n"])
    moved = F.transform("in", lambda x: F.struct((x["lo"] + F.col("at")).alias("lo"), (x["hi"] + F.col("at")).alias("hi"), x["by"].alias("by")))
    back = back.groupBy(F.col("ph").alias("h"), F.col("pc").alias("c"), F.col("pn").alias("n")).agg(F.flatten(F.collect_set(moved)).alias("in"))
    return matched.unionByName(back)


def _keep(with_text: bool):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            cells: list[list] = [[], [], [], []]
            for text, cut in zip(batch.column("t").to_pylist(), batch.column("cut").to_pylist(), strict=True):
                words = (text or "").encode().split()
                kept, at, merged = [], 0, []
                for x in sorted((x["lo"], x["hi"]) for x in cut or ()):
                    if merged and x[0] <= merged[-1][1]:
                        merged[-1] = (merged[-1][0], max(merged[-1][1], x[1]))
                    else:
                        merged.append(x)
                for lo, hi in merged:
                    kept += words[at:lo]
                    at = hi
                whole = b" ".join(kept + words[at:]).decode()
                cells[0].append(len(words))
                cells[1].append([{"start": lo, "end": hi} for lo, hi in merged])
                cells[2].append(hashlib.sha256(whole.encode()).hexdigest())
                cells[3].append(whole if merged else text)
            kinds = (pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string(), pa.string())
            arrays = [pa.array(x, type=k) for x, k in zip(cells, kinds, strict=True)]
            names = ["n_words", "spans", "kept_sha256", "kept_text"]
            m = 4 if with_text else 3
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *arrays[:m]], names=["_row", *names[:m]])

    return run


def substring_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """``_row`` (all columns but the text), ``n_words``, ``spans`` removed, ``kept_sha256`` and, if wanted, ``kept_text``.

    Removed is each word of a window of ``window`` words whose sequence starts in a document with a smaller key too.
    A window's least seed hash names its shard; equal windows share it, so a shard is complete by itself. Runs of
    windows with one seed are a segment; equal segments of a shard are one piece. Seeds found in a single document go
    no further. The pieces of a shard are the reference of a suffix automaton whose states know the smallest key that
    has their words; each piece streams through it, and where its matching statistics reach ``window``, the state of
    that length tells the first holder of the window. A document loses the maximal spans whose first holder is not
    itself. Shards hold SHARD_WORDS words at most, larger ones are split (see ``_holders``); nothing is dropped.

    Null text: no words. Null keys rank last and rows with equal keys never remove each other; texts below
    ``window`` words are left alone; ``kept_text`` of an untouched document is its text unchanged, else the kept
    words joined by one space. Extra columns pass through in ``_row``. Empty table: no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    carry = [c for c in docs.columns if c != text]
    ident = F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1))
    k = F.xxhash64(ident, F.coalesce(text, F.lit("")))
    base = docs.select(k.alias("k"), ident.alias("id"), F.col(text).alias("t"))
    found = base.where(F.length("t") >= 2 * window - 1).mapInArrow(W.lean(_find(window, SEED_WORDS)), "h long, c long, k long, id long, s int, n int")
    found = written(found, "segments")
    shared = found.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("h")
    again = written(found.join(shared, "h"), "repeated")
    dropped(found)
    first = again.groupBy("h", "c", "n").agg(F.min(F.struct("id", "k", "s")).alias("f"))
    first = written(first.select("h", "c", "n", "f.*"), "first")
    wanted = first.groupBy("id", "k").agg(F.collect_list(F.struct("h", "c", "n", "s")).alias("want"))
    pieces = base.join(wanted, ["id", "k"]).select("id", "t", "want").mapInArrow(W.lean(_cut_out), "h long, c long, n int, id long, words binary")
    pieces = written(pieces.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(window - SEED_WORDS)), "shards")
    told = _holders(pieces, first, window)
    own = F.filter("in", lambda x: x["by"] < F.col("id"))
    cut = F.transform(own, lambda x: F.struct((x["lo"] + F.col("s")).alias("lo"), (x["hi"] + F.col("s") + window - 1).alias("hi")))
    cuts = again.join(told, ["h", "c", "n"]).select("id", "k", cut.alias("x")).where(F.size("x") > 0)
    cuts = cuts.groupBy("id", "k").agg(F.flatten(F.collect_set("x")).alias("cut"))
    rows = docs.select(F.struct(*carry).alias("_row"), k.alias("k"), ident.alias("id"), F.col(text).alias("t")).join(cuts, ["id", "k"], "left")
    schema = f"_row {rows.schema['_row'].dataType.simpleString()}, n_words long, spans array<struct<start:int,end:int>>, kept_sha256 string" + ", kept_text string" * with_text
    return rows.select("_row", "t", "cut").mapInArrow(W.lean(_keep(with_text)), schema)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document its words, those removed and the digest of the rest; odd inputs as in ``substring_dedup``."""
    out = substring_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select("_row.doc_id", "n_words", removed.alias("n_removed"), "kept_sha256")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without the passages that an earlier one holds; n_chars follows the text.

    No row goes: null texts stay empty ones, repeated rows and rows of one doc_id leave each other alone.
    """
    out = substring_dedup(docs)
    cells = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*(cells[c].alias(c) if c in cells else F.col(f"_row.{c}") for c in docs.columns))
