"""Top-k, substring dedup, extraction, near-duplicates and packing: brute force and odd inputs."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from quillgraph.llm import components, html, neardups, packing, substrings, topk
from quillgraph.llm import words as W

DOCS = "doc_id long, text string, k string, id int, t string, cut string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, x, "a", 1, None, "z") for i, x in rows], DOCS)


# --- top-k


def brute_topk(rows, queries, k):
    keep = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            keep.setdefault(i, []).append([math.floor(1024 * x) for x in v])
    out = {}
    for q in queries:
        if q in keep:
            found = [(-sum(a * b for a, b in zip(keep[q][0], v)), i) for i, vs in keep.items() if i != q for v in vs if len(v) == len(keep[q][0])]
            out[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(sorted(found)[:k])]
    return out


def test_topk_matches_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) * (0.1 if i % 3 else 4) for _ in range(6)]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 6) for i in range(40)] + [(2000, [0.0] * 6), (2001, None), (2002, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2003, [float("inf")] * 6), (2004, [float("nan")] * 6), (2005, [1.0, 2.0]), (None, [1.0] * 6), (2006, []), (0, [9.0] * 6)]
    df = spark.createDataFrame([(i, v, "x", 2) for i, v in rows], "vec_id long, embedding array<double>, norm string, level int")
    scaled = topk.scaled(df, "vec_id", "embedding")
    queries = scaled.where("id % 20 = 0 and id > 0")
    got = defaultdict(list)
    for r in topk.top_k(scaled, queries).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    want = brute_topk(rows, [i for i, _ in rows if i and i % 20 == 0], 10)
    assert {q: sorted(x) for q, x in got.items()} == {q: x for q, x in want.items() if x}
    assert topk.top_k(scaled.limit(0), queries).count() == 0 and topk.top_k(scaled, queries.limit(0)).count() == 0


def test_topk_small_blocks_and_large_numbers(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "BUCKET_ROWS", 8)
    monkeypatch.setattr(topk, "SEEDS", 5)
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) * 2.0**18 for _ in range(4)]) for i in range(120)]
    df = topk.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, df.where("id % 10 = 0"), 4).collect())
    want = Counter((q, *x) for q, xs in brute_topk(rows, range(0, 120, 10), 4).items() for x in xs)
    assert got == want


# --- substrings


def brute_removed(rows, window):
    words = [(i, (x or "").encode().split()) for i, x in rows]
    first = {}
    for i, w in words:
        for s in range(len(w) - window + 1):
            g = tuple(w[s : s + window])
            first[g] = min(first.get(g, i), i)
    out = Counter()
    for i, w in words:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[(i, len(w), sum(gone), hashlib.sha256(kept).hexdigest())] += 1
    return out


def passages(rng):
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz")
    common = [[word() for _ in range(n)] for n in (55, 80, 300, 50, 49)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randint(1, 4)):
            text += [word() for _ in range(rng.randint(0, 40))]
            p = rng.choice(common)
            lo = rng.randint(0, 10)
            text += p[lo:]
        rows.append((i, " ".join(text)))
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(7, rows[7][1]), (7, rows[8][1]), (200, None), (201, ""), (202, "a \n\t b"), (203, "q " * 400), (204, "q " * 300), (205, " ".join(common[0]))]
    return rows


def test_substring_dedup_matches_brute_force(spark, monkeypatch):
    rows = passages(random.Random(8))
    for most in (65_536, 2000, 1):
        monkeypatch.setattr(substrings, "SHARD_WORDS", most)
        out = substrings.substring_dedup(docs_of(spark, rows)).collect()
        got = Counter((r["_row"]["doc_id"], r["n_words"], sum(x["end"] - x["start"] for x in r["spans"]), r["kept_sha256"]) for r in out)
        assert got == brute_removed(rows, 50)
        for r in out:
            if not r["spans"] and r["kept_text"] is not None:
                assert r["kept_text"] in {x for i, x in rows if i == r["_row"]["doc_id"]}


def test_substring_dedup_hot_passage_and_long_segments(spark, monkeypatch):
    """A passage in 1,200 documents with different surroundings, a recurring phrase as long as a document, long texts."""
    rng = random.Random(18)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(4))
    hot, phrase = [word() for _ in range(62)], [word() for _ in range(12)]
    rows = [(i, " ".join([word() for _ in range(rng.randint(0, 30))] + hot + [word() for _ in range(rng.randint(0, 30))])) for i in range(1200)]
    rows += [(2000, " ".join(phrase * 400)), (2001, " ".join(phrase * 300)), (2002, " ".join(phrase * 4 + [word()] + phrase * 5)), (2003, "z " * 3000), (2004, "z " * 700)]
    long = [word() for _ in range(30_000)]
    rows += [(3000, " ".join(long)), (3001, " ".join(long[500:20_000])), (3002, " ".join(long[::-1]))]
    want = brute_removed(rows, 50)
    for most in (65_536, 3000):
        monkeypatch.setattr(substrings, "SHARD_WORDS", most)
        out = substrings.substring_dedup(docs_of(spark, rows), with_text=False).collect()
        assert Counter((r["_row"]["doc_id"], r["n_words"], sum(x["end"] - x["start"] for x in r["spans"]), r["kept_sha256"]) for r in out) == want


def test_substring_dedup_empty(spark):
    assert substrings.substring_dedup(docs_of(spark, []).limit(0)).count() == 0
    assert substrings.substring_dedup(docs_of(spark, [(None, "a " * 60), (None, "a " * 60)])).selectExpr("max(size(spans))").first()[0] == 0


def test_automaton_statistics():
    rng = random.Random(1)
    for _ in range(60):
        known = [[rng.choice("ab") for _ in range(rng.randint(0, 12))] for _ in range(3)]
        a = substrings.Automaton()
        for x in known:
            a.add(x)
        b = substrings.Automaton()
        for i, x in enumerate(known):
            b.add(x, i)
        runs = {tuple(x[i:j]) for x in known for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
        text = [rng.choice("abc") for _ in range(15)]
        want = [max((n for n in range(i + 2) if n == 0 or tuple(text[i + 1 - n : i + 1]) in runs), default=0) for i in range(len(text))]
        assert [n for n, _ in a.statistics(text)] == want
        holds = lambda i, g: any(tuple(known[i][j : j + 3]) == g for j in range(len(known[i])))  # noqa: B023, E731
        first = [(s, next((i for i in range(3) if holds(i, tuple(text[s : s + 3]))), None)) for s in range(13)]
        got = {s: by for lo, hi, by in b.holders(text, 3) for s in range(lo, hi)}
        assert got == {s: i for s, i in first if i is not None}


def test_word_hashes_split_like_the_contract():
    texts = ["", "a", " a b \x0b c\x1fd\n", "x" * 5000, "é　é e"]
    h, at = W.hashed([t.encode() for t in texts])
    words = [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    assert np.diff(at).tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts]
    assert len(h) == len(words) and len(set(h.tolist())) == len(set(words))


# --- extraction


def test_extraction_of_table_pages(spark, sf):
    import html as std

    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()
    got = {r["page_id"]: r for r in html.op3_html_extract(spark, sf).collect()}
    assert len(got) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        blocks = [" ".join(std.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n\n".join(b for b in blocks if b)
        assert (got[p["page_id"]]["text"], got[p["page_id"]]["n_chars"]) == (want, len(want))


def test_extraction_on_held_out_pages():
    model, rng, hit, told, all_ = html.trained(), random.Random(1234), 0, 0, 0
    for _ in range(150):
        page = html.labelled_page(rng)
        *_, runs, labels = html.parse(page)
        said = (" ".join("".join(t if labels[i] == "content" else " " for i, t in run).split()) for run in runs)
        want = Counter(t for t in said if t)
        got = Counter(html.texts(model, [page.replace("data-y", "data-z")])[0].split("\n\n"))
        hit, told, all_ = hit + sum((want & got).values()), told + sum(want.values()), all_ + sum(got.values())
    assert hit / told > 0.95 and hit / all_ > 0.95


def test_messages_match_enumeration():
    rng = np.random.default_rng(2)
    parent = np.array([-1, 0, 0, 1, 1, -1])
    unary, edge = rng.normal(size=(6, 3)), rng.normal(size=(3, 3))
    total = np.zeros((6, 3))
    for y in itertools.product(range(3), repeat=6):
        w = math.exp(sum(unary[i, s] for i, s in enumerate(y)) + sum(edge[y[p], y[i]] for i, p in enumerate(parent) if p >= 0))
        for i, s in enumerate(y):
            total[i, s] += w
    assert np.allclose(html.marginals(parent, unary, edge), total / total.sum(1, keepdims=True))
    assert np.allclose(html._one_by_one(parent.tolist(), unary, edge), total / total.sum(1, keepdims=True))


def test_extraction_of_deep_and_broken_pages():
    import time

    model = html.trained(60)
    body = "<article><p>one two three four five six seven</p></article>"
    began = time.time()
    pages = ["<div>" * 100_000 + body, "<div>" * 8000 + "</p>" * 100_000 + body, "<ul>" + "<div>" * 50_000 + "<li>x" * 50_000, "<b>" * 100_000 + "</i>" * 100_000 + body, "<p>" + "long " * 400_000]
    out = html.texts(model, pages)
    assert time.time() - began < 30
    assert len(out) == len(pages) and "five six" in out[3] and len(out[4]) in (0, 5 * 400_000 - 1)


def test_extraction_keeps_formulas_and_drops_inline_adverts():
    model = html.trained()
    page = (
        "<html><body><nav class='menu'><ul><li><a href='/a'>home</a></li></ul></nav><article><h1>Title words</h1>"
        "<p>Let <math><mi>x</mi></math> be <span class='term'>a number</span> and so on for quite a while longer "
        "<span class='ad'>buy this</span> until the end.<map name='m'>kept</map></p><p>second <b>bold <i>both</b> rest</i> tail</p></article></body></html>"
    )
    assert html.texts(model, [page]) == ["Title words\n\nLet x be a number and so on for quite a while longer until the end.kept\n\nsecond bold both rest tail"]


def test_extraction_of_odd_pages(spark):
    odd = [None, "", "<", "<p", "<a href='", "<script>x", "<!-- never", "plain", "<div>" * 3000 + "deep", "</p></div>", "<article><p>A &lt;b&gt; &amp;amp; caf&eacute; &#x41;&#66;\n\t two<br>three<p>next<script>if(a<b)</script></article>"]
    pages = spark.createDataFrame([(i, x, "t", "o") for i, x in enumerate(odd * 2)], "page_id long, html string, text string, _o string")
    out = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    assert len(out) == 2 * len(odd) and all(x is not None for x in out.values())
    assert out[len(odd) - 1] == "A <b> &amp; café AB two three\n\nnext"
    assert html.extract(pages.limit(0)).count() == 0


# --- near-duplicates


def test_near_duplicates_find_copies_and_leave_the_rest(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    rows, family = [], {}
    for f in range(40):
        text = [word() for _ in range(rng.randint(120, 300))]
        for c in range(60 if f == 0 else rng.randint(1, 4)):
            near = list(text)
            if c:
                near[rng.randrange(len(near))] = word()
            rows.append((len(rows), ("  " if c % 2 else " ").join(near)))
            family[len(rows) - 1] = f
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "one two"), (5004, "one\ttwo"), (5005, "three"), (5005, "three"), (None, "lone words here")]
    out = neardups.near_duplicates(docs_of(spark, rows)).collect()
    assert len(out) == len(rows)
    got = {r["id"]: r["class_id"] for r in out}
    first = {}
    for i, f in family.items():
        first.setdefault(f, i)
        assert got[i] == first[f]
    assert [got[i] for i in (5000, 5001, 5002, 5003, 5004, 5005)] == [5000, 5001, 5002, 5003, 5003, 5005]
    assert neardups.near_duplicates(docs_of(spark, []).limit(0)).count() == 0


def brute_classes(rows, threshold=0.8):
    """Class (a set of row numbers) of every row with words, by comparing all pairs; weights from plain counts."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", x or "") for _, x in rows]
    docs = [w for w in words if w]
    df = Counter(x for w in docs for x in set(w))
    half = neardups.LEAST_WEIGHT
    weigh = {x: 1.0 if n * neardups.RARE <= len(docs) else half - (1 - half) * math.log(n / len(docs)) / math.log(neardups.RARE) for x, n in df.items()}
    bags = []
    for w in words:
        grams = Counter(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else Counter([tuple(w)] * bool(w))
        bags.append({g: n * (sum(weigh[x] for x in g) / 5 if len(w) >= 5 else 1.0) for g, n in grams.items()})
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    near = 1.0
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = bags[i], bags[j]
        if a and b:
            least = sum(min(n, b[g]) for g, n in a.items() if g in b)
            s = least / (sum(a.values()) + sum(b.values()) - least)
            near = min(near, abs(s - threshold))
            if s >= threshold:
                up[find(j)] = find(i)
    return [find(i) if words[i] else None for i in range(len(rows))], near


def test_classes_match_all_pairs(spark):
    rng = random.Random(15)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(1500)]
    word = lambda: vocabulary[int(1500 * rng.random() ** 3)]
    rows = []
    for _ in range(45):
        text = [word() for _ in range(rng.choice((6, 40, 150, 400)))]
        for _ in range(rng.randint(1, 6)):
            near = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // 30))):
                near[rng.randrange(len(near))] = word()
            rows.append((rng.choice((None, len(rows), 3)), " ".join(near)))
    rows += [(None, " ".join(["same"] * 30)), (None, " ".join(["same"] * 31)), (1, "a b c d e"), (2, "a b c d"), (4, None), (4, " ")]
    want, near = brute_classes(rows)
    assert near > 1e-4  # no pair so close to the threshold that rounded weights could decide
    out = neardups.near_duplicates(docs_of(spark, rows)).collect()
    got = defaultdict(set)
    at = {(r["id"], r["k"]): (r["class_id"], r["class_k"]) for r in out}
    keys = docs_of(spark, rows).select("doc_id", "text", neardups._row_hash(neardups.F.col("doc_id"), "text").alias("k")).collect()
    place = {(r["doc_id"], r["text"]): (r["doc_id"], r["k"]) for r in keys}
    classes = defaultdict(set)
    for i, row in enumerate(rows):
        if want[i] is not None:
            got[at[place[row]]].add(i)
            classes[want[i]].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, classes.values()))
    assert any(len(c) > 2 for c in classes.values()) and len(classes) > 45


def test_word_weights_are_exact(spark, monkeypatch):
    monkeypatch.setattr(neardups, "RARE", 20)
    docs = spark.createDataFrame([(f"all w{i % 4} x{i % 30} only{i} all",) for i in range(200)] + [(None,), (" ",)], "t string").repartition(5)
    words, weights = neardups.word_weights(docs)
    share = {"all": 1.0} | {f"w{i}": 0.25 for i in range(4)}
    h = {w: int(neardups.W.hashed([w.encode()])[0][0]) for w in share}
    assert dict(zip(words.tolist(), weights.tolist())) == {h[w]: round((0.5 - 0.5 * math.log(s) / math.log(20)) * 4096) / 4096 for w, s in share.items()}
    assert neardups.weights_of(np.array([h["all"], 5], np.uint64), (words, weights)).tolist() == [0.5, 1.0]
    assert neardups.weights_of(np.array([5], np.uint64), neardups.word_weights(docs.limit(0))).tolist() == [1.0]


def test_classes_of_null_and_repeated_keys_stay_apart(spark, tmp_path):
    rng = random.Random(12)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(80))
    lone, same, top = [text() for _ in range(5)], text(), text()
    rows = [(None, x) for x in lone] + [(7, text()) for _ in range(4)] + [(None, same), (9, same), (None, same)]
    rows += [(2**63 - 1, top), (None, top), (None, None), (None, ""), (None, ""), (7, " "), (7, " ")]
    docs = docs_of(spark, rows)
    kept = neardups.stage(spark, docs, "").select("doc_id", "text").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    want = rows[:9] + [(9, same), (2**63 - 1, top)] + rows[-5:]
    assert sorted(map(tuple, kept), key=key) == sorted(want, key=key)
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    out = neardups.op5_near_duplicates(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0) for r in out) == sorted((i or 0) for i, _ in rows)
    classes = defaultdict(list)
    for r in out:
        classes[r["class_id"]].append((r["doc_id"], r["first_id"]))
    # five null keys, four texts of key 7, two shared texts; without words: null and "" of a null key are one row, as are both " " of 7
    assert sorted(map(len, classes.values())) == [1] * 9 + [2, 2, 3, 3]
    assert [(9, 9)] == [c for v in classes.values() for c in v if c[0] == 9]
    assert all(len({first for _, first in v}) == 1 for v in classes.values())


def test_sampling_agrees_with_weighted_jaccard():
    rng = np.random.default_rng(4)
    x = rng.integers(1, 2**63, 300, dtype=np.uint64)
    hits = tries = 0
    a, wa = x[:220], rng.choice([0.5, 0.75, 1.0, 2.0], 220)
    b, wb = np.r_[x[:180], x[220:]], np.r_[wa[:180], rng.choice([0.5, 1.0], 80)]
    j = neardups.similarity((np.sort(a), wa[np.argsort(a)]), (np.sort(b), wb[np.argsort(b)]))
    for salt in rng.integers(1, 2**63, 150, dtype=np.uint64):
        keys = [neardups.signatures(W.mix(v ^ salt), w, np.array([0, len(v)]))[0] for v, w in ((a, wa), (b, wb))]
        hits, tries = hits + int((keys[0] == keys[1]).sum()), tries + neardups.BANDS
    assert abs(hits / tries - j**neardups.ROWS) < 0.06


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (100, 102), (300, 200)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100, 200: 200, 300: 200}


# --- packing


def test_plan_holds_every_piece():
    rng = random.Random(9)
    for n in (1, 50, 3000):
        counts = Counter(rng.choice((1024, rng.randint(1, 1023))) for _ in range(n))
        plan = packing.plan_sequences(dict(counts))
        got = Counter()
        for real, times in plan:
            assert sum(real) <= 1024
            for s in real:
                got[s] += times
        assert got == counts
        if n == 3000:
            assert sum(t for _, t in plan) <= 1.05 * sum(s * c for s, c in counts.items()) / 1024
    assert packing.plan_sequences({}) == []


def test_lengths_are_rounded_and_few_sequences_are_lost():
    rng = random.Random(19)
    counts = Counter(min(1024, 1 + int(rng.lognormvariate(5.6, 0.8))) for _ in range(20_000))
    grouped = packing.group_sizes({s: n for s, n in counts.items() if 400 < s < 1024}, packing.GROUPS)
    assert len(grouped) <= packing.GROUPS and sum(len(of) > 1 for _, of in grouped) > len(grouped) / 2
    assert all(rounded == max(of) for rounded, of in grouped)
    plan = min((packing.plan_sequences(dict(counts), small=s) for s in packing.SMALL), key=lambda p: sum(n for _, n in p))
    assert sum(n for _, n in plan) <= 1.003 * sum(s * n for s, n in counts.items()) / 1024 + 1


def test_fast_merges_give_the_tokenizers_ids():
    """Every code point but surrogates, alone between letters and behind a space, through both libraries."""
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    own, fast = Tokenizer.from_file(path), packing._encoder(path)
    points = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    for make in (lambda c: f"a{c}b", lambda c: f"1 {c} {c}{c}\n"):
        texts = ["".join(map(make, points[i : i + 64])) for i in range(0, len(points), 64)]
        assert [x.ids for x in own.encode_batch(texts, add_special_tokens=False)] == [fast(t) for t in texts]


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.tokenizer_path())
    texts = [None, "", "hello world", "hello world", "<|endoftext|> is special", "long words " * 2500, "é  \n\n  x\t", "\U0001F600" * 40, "a" * 3000, "it's we'll 123 ++ \r\n end"]
    rows = [(i, x) for i, x in enumerate(texts)] + [(2, "hello world"), (None, "null key")]
    out = packing.pack(docs_of(spark, rows), with_ids=True).collect()
    want = Counter()
    for i, x in rows:
        ids = [*own.encode(x or "", add_special_tokens=False).ids, 2]
        want[(i, tuple(ids))] += 1
    whole = defaultdict(lambda: defaultdict(list))
    used = defaultdict(list)
    for r in out:
        assert len(r["_ids"]) == r["_length"] <= 1024
        assert zlib.crc32(np.array(r["_ids"], "<u4").tobytes()) == r["_crc"]
        whole[r["_row"]["doc_id"]][r["_n"]].append(r)
        used[r["_sequence"]].append((r["_offset"], r["_length"]))
    for i in {i for i, _ in rows}:
        n = sum(1 for j, _ in rows if j == i)
        if n == 1:
            parts = [whole[i][k][0] for k in sorted(whole[i])]
            assert tuple(x for p in parts for x in p["_ids"]) in {ids for j, ids in want if j == i}
            assert [p["_start"] for p in parts] == [sum(q["_length"] for q in parts[:k]) for k in range(len(parts))]
            assert all(p["_length"] == 1024 for p in parts[1:])
        else:
            assert all(len(v) == n for v in whole[i].values())
    for places in used.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 1024
    assert packing.pack(docs_of(spark, []).limit(0)).count() == 0
