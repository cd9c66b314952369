"""Best-fit packing of token sequences by linear grouping."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read, ship, written
from .words import lean

MAX_TOKENS = 1024
END_ID = 2
TOKENIZER_FILE = "byte_bpe_50k.json"
#: Pieces of up to so many tokens are small (each bound is tried, the plan with fewest sequences taken); the others
#: are rounded up within GROUPS groups of equal cardinality. Measured on 10,000 documents, sequences above the sum of
#: lengths: 48 groups 0.2 %, 128 groups 0.06 %, no rounding 0.01 %.
SMALL, GROUPS = (128, 256, 340, 400), 128
#: Documents are ranked within length and bucket; so many documents make a bucket.
BUCKET_DOCS = 20_000


# --- tokens -----------------------------------------------------------------------------------------------------

_ENCODERS: dict = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_FILE)


def _encoder(path: str):
    """A function text -> ids. The file's merges are run by the faster of two libraries that give the same ids;
    texts that hold a special token's string go to the file's own library."""
    if path not in _ENCODERS:
        import json

        import tiktoken
        from tokenizers import Tokenizer

        data = json.load(open(path, encoding="utf-8"))
        known = data["pre_tokenizer"]
        if data["normalizer"] or data["model"]["type"] != "BPE" or known["type"] != "ByteLevel" or known["add_prefix_space"] or not known["use_regex"]:
            raise ValueError(f"{path}: only byte-level merges after the regular split are known here")
        # The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        table = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        ranks = {bytes(table[c] for c in token): i for token, i in data["model"]["vocab"].items() if token not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        own = cache(lambda: Tokenizer.from_file(path))  # few texts need it

        def encode(text: str) -> list[int]:
            if any(s in text for s in special):
                return own().encode(text, add_special_tokens=False).ids
            return fast(text)

        _ENCODERS[path] = encode
    return _ENCODERS[path]


def cut(n: int, size: int = MAX_TOKENS) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else the first piece takes the remainder."""
    if n <= size:
        return [(0, n)]
    first = n % size
    return ([(0, first)] if first else []) + [(i, size) for i in range(first, n, size)]


def tokenized(docs: DataFrame, text: str, path: str, size: int, with_ids: bool) -> DataFrame:
    """A row per piece: the struct ``_row``, ``_n`` (piece), ``_start``, ``_length``, ``_crc`` and, if wanted, ``_ids``."""
    schema = f"_row {docs.schema['_row'].dataType.simpleString()}, _n int, _start long, _length int, _crc long" + ", _ids array<int>" * with_ids

    def pieces(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = _encoder(path)
        for batch in batches:
            at, cells = [], defaultdict(list)
            for i, value in enumerate(batch.column("_t")):
                ids = np.asarray([*encode(value.as_py() or ""), END_ID], dtype="<u4")
                for n, (start, length) in enumerate(cut(len(ids), size)):
                    part = ids[start : start + length]
                    at.append(i)
                    for k, v in (("_n", n), ("_start", start), ("_length", length), ("_crc", zlib.crc32(part.tobytes()))):
                        cells[k].append(v)
                    if with_ids:
                        cells["_ids"].append(part.astype("i4"))
            kinds = {"_n": pa.int32(), "_start": pa.int64(), "_length": pa.int32(), "_crc": pa.int64(), "_ids": pa.list_(pa.int32())}
            names = ["_n", "_start", "_length", "_crc"] + ["_ids"] * with_ids
            rows = batch.column("_row").take(pa.array(at, type=pa.int64()))
            yield pa.RecordBatch.from_arrays([rows, *(pa.array(cells[k], type=kinds[k]) for k in names)], names=["_row", *names])

    return docs.mapInArrow(lean(pieces), schema)


# --- the plan: bounded by the number of lengths, whatever the number of documents ----------------------------------


def group_sizes(counts: dict[int, int], groups: int) -> list[tuple[int, list[int]]]:
    """(rounded size, the lengths it stands for): lengths from large to small in groups of equal cardinality."""
    goal, out, held = max(1, -(-sum(counts.values()) // groups)), [], 0
    for s in sorted(counts, reverse=True):
        if not out or held >= goal:
            out.append((s, []))
            held = 0
        out[-1][1].append(s)
        held += counts[s]
    return out


def _best_pattern(sizes: list[int], left: dict[int, int], capacity: int) -> list[int]:
    """A filling of a sequence with rounded sizes that starts with the largest left and leaves least room.

    Subset sums over at most ``capacity`` cells; larger sizes are preferred, which keeps the small ones flexible.
    """
    first = next(s for s in sizes if left[s])
    best: list[int | None] = [None] * (capacity + 1)  # the last size put into this sum
    best[first], used = first, {first: Counter({first: 1})}
    for s in sizes:
        if not left[s]:
            continue
        for total in range(first, capacity - s + 1):
            if best[total] is not None and best[total + s] is None and used[total][s] < left[s]:
                best[total + s] = s
                used[total + s] = used[total] + Counter({s: 1})
        if best[capacity] is not None:
            break
    return list(used[max(used)].elements())


def configurations(demand: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(pattern of rounded sizes, how often) that serve the demand: each best pattern is repeated while it can be."""
    left, sizes, out = dict(demand), sorted(demand, reverse=True), []
    while any(left.values()):
        pattern = _best_pattern(sizes, left, capacity)
        need = Counter(pattern)
        times = min(left[s] // n for s, n in need.items())
        out.append((pattern, times))
        for s, n in need.items():
            left[s] -= n * times
    return out


def plan_sequences(counts: dict[int, int], capacity: int = MAX_TOKENS, small: int = SMALL[-1], groups: int = GROUPS) -> list[tuple[list[int], int]]:
    """(lengths in a sequence, how many such sequences) that hold exactly ``counts`` pieces of each length."""
    counts = {s: c for s, c in counts.items() if c}
    large = {s: c for s, c in counts.items() if small < s < capacity}
    grouped = group_sizes(large, groups) if large else []
    stock = {rounded: [[s, large[s]] for s in members] for rounded, members in grouped}
    bins: list[tuple[list[int], int]] = [([capacity], counts[capacity])] if counts.get(capacity) else []
    for pattern, times in configurations({r: sum(n for _, n in v) for r, v in stock.items()}, capacity):
        while times:  # real lengths take the places of the rounded ones, as many sequences at once as are alike
            need = Counter(pattern)
            real, run, take = [], times, []
            for r, n in need.items():
                spread, i = n, 0
                while spread:
                    s, there = stock[r][i]
                    k = min(spread, there)
                    real += [s] * k
                    take.append((r, i, k))
                    spread -= k
                    i += 1
            run = min([run, *(stock[r][i][1] // k for r, i, k in take)])
            for r, i, k in take:
                stock[r][i][1] -= k * run
            for r in need:
                stock[r] = [x for x in stock[r] if x[1]]
            bins.append((real, run))
            times -= run
    return _fill(bins, {s: c for s, c in counts.items() if s <= small}, capacity)


def _fill(bins: list[tuple[list[int], int]], items: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best fit for the small pieces, largest first: into the sequences with the least room that is enough."""
    room: dict[int, list[tuple[list[int], int]]] = defaultdict(list)
    for real, n in bins:
        room[capacity - sum(real)].append((real, n))
    open_ = sorted(room)
    for s in sorted(items, reverse=True):
        left = items[s]
        while left:
            i = bisect_left(open_, s)
            if i == len(open_):
                fresh = -(-left // (capacity // s))
                room[capacity].append(([], fresh))
                insort(open_, capacity)
                continue
            r = open_[i]
            real, n = room[r].pop()
            each = min(r // s, left)
            k = min(n, left // each)
            if n > k:
                room[r].append((real, n - k))
            if not room[r]:
                del room[r]
                open_.pop(i)
            left -= each * k
            to = r - s * each
            if to not in room:
                insort(open_, to)
            room[to].append((real + [s] * each, k))
    return [(real, n) for of in room.values() for real, n in of if real]


def places(plan: list[tuple[list[int], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """Of each length, runs (first rank, first sequence, offset, every): rank r lies in sequence first + (r - first rank) of its run."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    seen: Counter = Counter()
    base = 0
    for real, n in plan:
        offset = 0
        for s in real:
            out[s].append((seen[s], base, offset))
            seen[s] += n
            offset += s
        base += n
    return out


# --- the operator ---------------------------------------------------------------------------------------------------


def pack(docs: DataFrame, text: str = "text", path: str | None = None, size: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """A row per piece of every document: struct ``_row`` (its columns but the text), ``_n``, ``_start``, ``_length``,
    ``_crc``, ``_sequence``, ``_offset`` and, if wanted, ``_ids``.

    A document is its ids and an end id; only one longer than ``size`` is cut. There are at most ``size`` different
    lengths, so the counts of all of them are what the plan needs: lengths above SMALL are rounded up within groups
    of equal cardinality, configurations of the few rounded sizes are chosen for the whole demand, real lengths take
    their places, and small pieces go by best fit into the room left. Pieces of one length are then ranked (within
    hashed buckets, with the buckets' counts before them) and rank r takes the r-th place of its length.

    Null or empty text is the end id alone. Equal and repeated rows are pieces of their own. Empty table: no rows.
    """
    ship(docs.sparkSession)
    path = path or tokenizer_path()
    carry = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*carry).alias("_row"), F.col(text).alias("_t"))
    pieces = written(tokenized(rows, text, path, size, with_ids), "pieces")
    # Ties in the order are equal rows, whose places may be swapped without a difference.
    values = [c for c in pieces.columns if c not in ("_ids", "_row")]
    pieces = pieces.withColumn("_h", F.xxhash64("_row", *values))
    buckets = max(1, pieces.count() // BUCKET_DOCS)
    pieces = pieces.withColumn("_b", F.pmod("_h", F.lit(buckets)))
    cells = written(pieces.groupBy("_length", "_b").count(), "piece-counts")
    total = {r["_length"]: r["n"] for r in cells.groupBy("_length").agg(F.sum("count").alias("n")).collect()}  # at most ``size`` rows
    plan = places(min((plan_sequences(total, size, small) for small in SMALL), key=lambda p: sum(n for _, n in p)))
    before = F.sum("count").over(Window.partitionBy("_length").orderBy("_b")) - F.col("count")
    cells = cells.select("_length", "_b", before.alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_length", "_b").orderBy("_h", "_n")) - 1
    ranked = pieces.withColumn("_rank", rank).join(cells, ["_length", "_b"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    runs = {s: tuple(np.array(x, dtype=np.int64) for x in zip(*v, strict=True)) for s, v in plan.items()}
    shared = docs.sparkSession.sparkContext.broadcast(runs)  # the plan: bounded by ``size`` lengths and their runs

    @F.pandas_udf("struct<sequence:long,offset:long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        for s in np.unique(lengths):
            here = np.flatnonzero(lengths == s)
            first, base, offset = shared.value[int(s)]
            run = np.searchsorted(first, ranks[here], side="right") - 1
            seq[here] = base[run] + ranks[here] - first[run]
            off[here] = offset[run]
        return pd.DataFrame({"sequence": seq, "offset": off})

    out = ranked.withColumn("_p", place("_length", "_rank"))
    ids = ["_ids"] if with_ids else []
    return out.select("_row", "_n", "_start", "_length", "_crc", F.col("_p.sequence").alias("_sequence"), F.col("_p.offset").alias("_offset"), *ids)


def _digest(packed: DataFrame) -> DataFrame:
    return packed.select(
        "_row.doc_id",
        F.col("_n").alias("piece"),
        F.col("_start").alias("start"),
        F.col("_length").cast("long").alias("length"),
        F.col("_crc").alias("ids_crc32"),
        F.col("_sequence").alias("sequence_id"),
        F.col("_offset").alias("offset"),
    )


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place; null texts are the end id alone, odd inputs as in ``pack``."""
    return _digest(pack(read(spark, sf_dir, "documents").select("doc_id", "text")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all documents that are left and their places in training sequences.

    Null texts are the end id alone, repeated rows and null doc_ids pieces of their own, no rows give none.
    """
    return _digest(pack(docs.select("doc_id", "text")))
