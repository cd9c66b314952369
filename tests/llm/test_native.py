"""Quality rules, mixing, URL filter, sharding and chat formatting: brute force and odd inputs."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillgraph.llm import chat, mixing, quality, sharding, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, key string, _row string"
ODD = [
    (1, None, None, None, None, "x", None, "r"),
    (2, "", "en", "a", 0, None, "k", None),
    (2, "", "en", "a", 0, None, "k", None),
    (None, "one two", "en", None, 7, "y", "k", "r"),
    (4, "w " * 30_000, "en", "a", 60_000, "y", "k", "r"),
    (5, "\u00a0x \u2003 y\x0bz\x1fq \U0001F600", "fr", "b", 9, "y", "k", "r"),
    (6, "a b c a b c\nline one\nline one\n \n \n# * |", "de", "b", 9, "y", "k", "r"),
]


def base_stats(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics_match_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame(ODD, DOCS).select(rows.columns)
    out = quality.quality_rules(rows.unionByName(odd), carry=["doc_id", "text"]).collect()
    assert len(out) == rows.count() + len(ODD)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in out:
        n, *_, rep = want = base_stats(r["text"])
        assert tuple(r["_q"][x] for x in names) == want
        assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n)
        assert not (r["base_failed"] and r["kept"])


def test_quality_rejects_junk_and_keeps_clean(spark):
    sf = "/root/testdata/sf0.01"
    out = quality.op10_quality_rules(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    seen = {(r["quality"], r["kept"]): r["count"] for r in out.where("not base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    assert seen[(1, True)] > 200 and seen.get((1, False), 0) <= 2
    assert seen[(0, False)] > 10 and seen.get((0, True), 0) <= 2


def brute_mcd(x, share, factor, floors, tries=300):
    """Least determinant over many random starts, each concentrated until it stays; plain matrices."""
    rng, best = np.random.default_rng(0), None
    h = int(np.ceil(share * len(x)))
    for t in range(tries):
        keep = rng.choice(len(x), 6 if t else len(x), replace=False)
        was = np.inf
        while True:
            m, c = x[keep].mean(0), factor * np.cov(x[keep].T, bias=True) + np.diag(np.square(floors))
            det = np.linalg.slogdet(c)[1]
            if len(keep) == h:
                if best is None or det < best[0]:
                    best = det, m, c
                if det > was - 1e-9:
                    break
                was = det
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            keep = np.argsort(d)[:h]
    return best


def test_mcd_reaches_the_least_determinant(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(160, 4)) @ np.array([[0.3, 0.1, 0, 0], [0, 0.2, 0.1, 0], [0, 0, 0.3, 0], [0.1, 0, 0, 0.2]])
    groups = {
        "clean": base,
        "fifth": np.r_[base[:128], rng.normal(2.5, 0.1, (32, 4))],
        "cluster": np.r_[base[:124], base[124:] * 0.05 + np.array([0, 3, 0, -3])],
        "constant": np.c_[base[:, :3], np.zeros(160)],
    }
    rows = [(k, *map(float, v)) for k, x in groups.items() for v in x]
    vectors = spark.createDataFrame(rows, "key string, x0 double, x1 double, x2 double, x3 double")
    got = {r["key"]: r for r in quality.mcd_estimates(vectors).collect()}
    for k, x in groups.items():
        det, m, c = brute_mcd(x, quality.SUBSET, quality.CONSISTENCY, quality.FLOORS)
        assert got[k]["det"] < det + 0.12, k  # whole bins may take in a row or two more than the share
        mine = np.array([got[k][f"m{i}"] for i in range(4)])
        assert np.abs(mine - m).max() < 0.08
        low = np.array([[got[k][f"l{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
        far = lambda c, m: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m) > quality.CUTOFF  # noqa: B023, E731
        assert (far(low @ low.T, mine) == far(c, m)).mean() > 0.99


def test_quality_is_the_same_with_many_groups(spark, sf, monkeypatch):
    """Beyond the bound for broadcasts, hot groups meet a broadcast and the others a shuffle, with the same verdicts."""
    key = lambda r: (r["doc_id"], r["kept"])
    few = sorted(map(key, quality.op10_quality_rules(spark, sf).collect()))
    monkeypatch.setattr(quality, "MAX_BROADCAST_GROUPS", 0)
    monkeypatch.setattr("quillgraph.llm.common.HOT_SHARE", 4)
    assert sorted(map(key, quality.op10_quality_rules(spark, sf).collect())) == few


def test_quality_step_deals_out_twice_with_few_groups(spark, sf, monkeypatch):
    key = lambda r: (r["doc_id"] is None, r["doc_id"], *r)
    dealt, write = [], quality.written

    def written(df, name):
        if "active" in df.columns:
            dealt.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return write(df, name)

    monkeypatch.setattr(quality, "written", written)
    few = sorted(map(key, quality.op10_quality_rules(spark, sf).collect()))
    assert len(dealt) > 1 and max(dealt) <= 2, dealt
    monkeypatch.setattr(quality, "MAX_GATHERED", 0)
    assert sorted(map(key, quality.op10_quality_rules(spark, sf).collect())) == few


def test_quality_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    out = quality.quality_rules(docs)
    assert out.count() == len(ODD) and set(docs.columns) <= set(out.columns)
    assert quality.quality_rules(docs.limit(0)).count() == 0


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, open_ = dict.fromkeys(order, 0.0), set(order)
    left = float(sum(sizes.values()))
    while open_ and left > 1e-9:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > cap * sizes[s]}
        if not over:
            for s in open_:
                target[s] = share * weight[s]
            break
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing_hits_targets_and_repeats(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["b", "a", "é", "Z", None, "b", "b", "b", "b"])) for i in range(1500)] + [(9001, "x", "tiny"), (9002, None, "empty"), (9003, "x y", "b"), (9003, "x y", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = [r.asDict() for r in mixing.mix(docs).selectExpr("_row.doc_id", "_row.source", "_size", "_source_size", "_target", "size(_draws) n").collect()]
    assert len(out) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in out:
        sizes[r["source"]] += r["_size"]
        taken[r["source"]] += r["_size"] * r["n"]
        assert r["n"] <= 3
    want = brute_targets(sizes)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    for r in out:
        assert r["_target"] == pytest.approx(want[r["source"]]) and r["_source_size"] == sizes[r["source"]]
    for s in want:
        assert abs(taken[s] - want[s]) <= 60
    again = mixing.mix(docs.repartition(7)).selectExpr("_row.doc_id", "size(_draws) n").collect()
    assert sorted((r["doc_id"], r["n"]) for r in again) == sorted((r["doc_id"], r["n"]) for r in out)
    assert mixing.mixed_rows(mixing.mix(docs)).count() == sum(r["n"] for r in out)


def test_mixing_empty_and_odd(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    assert mixing.mix(docs).count() == len(ODD)
    assert mixing.mixed_rows(mixing.mix(docs)).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_fills_past_a_large_document_at_the_border(spark, monkeypatch):
    """Each source is short of its target by no more than its open share or its smallest document, whatever the border holds."""
    monkeypatch.setattr(mixing, "LEAST_BLOCKS", 3)
    rng = random.Random(21)
    rows = [(i, "w " * (2000 if i % 97 == 0 else rng.randint(20, 60)), "abc"[i % 3]) for i in range(1, 600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs).selectExpr("_row.source", "_size", "_target", "size(_draws) n").collect()
    for s in "abc":
        mine = [r for r in out if r["source"] == s]
        missing = mine[0]["_target"] - sum(r["_size"] * r["n"] for r in mine)
        most = max(r["n"] for r in mine)
        free = [r["_size"] for r in mine if r["n"] < most] or [0]
        assert 0 <= missing <= max(0.001 * mine[0]["_target"], min(free))


def test_mixing_shards_follow_the_tree(spark, sf):
    out = mixing.op4_mixing(spark, sf).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(out) == len(docs)
    share = defaultdict(Counter)
    for r in out:
        assert r["taken"] == r["size"] * len(r["shards"]) and all(0 <= x < mixing.LEAST_SHARDS for x in r["shards"])
        for x in r["shards"]:
            share[x][docs[r["doc_id"]]["source"]] += r["size"]
    assert len(share) == mixing.LEAST_SHARDS
    other = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"), n_shards=5).selectExpr("explode(_draws.shard) s").distinct().collect()
    assert {r["s"] for r in other} == set(range(5))


def test_splitting_tree_is_exact(spark, monkeypatch):
    counts = [500, 3, 0, 77]
    for most in (64, 1):
        monkeypatch.setattr(mixing, "NODES_A_TASK", most)
        quotas = mixing.shard_quotas(spark.createDataFrame([(counts,)], "counts array<long>"), 7, 1).collect()
        runs = defaultdict(list)
        shards = Counter()
        for r in quotas:
            runs[r["place"]].append((r["start"], r["k"]))
            shards[r["shard"]] += r["k"]
        for place, k in enumerate(counts):
            at = 0
            for start, n in sorted(runs[place]):
                assert start == at
                at += n
            assert at == k
        assert len(shards) == 7 and max(shards.values()) - min(shards.values()) <= 3


def test_hypergeometric_distribution(spark):
    from pyspark.sql import functions as F

    long = lambda x: F.lit(x).cast("long")
    df = spark.range(4000).select(mixing.hypergeometric(long(50), long(20), long(10), (F.col("id") + 0.5) / 4000).alias("x"))
    seen = Counter(r["x"] for r in df.collect())
    from math import comb

    for x in range(11):
        assert abs(seen[x] / 4000 - comb(20, x) * comb(30, 10 - x) / comb(50, 10)) < 0.002


URLS = [
    None, "", "no scheme/x", "http://EXAMPLE.org/es/1?q#f", "https://a.b.example.org/en/12", "http://example.org/en/2", "http://example.org", "ftp://x.com/fr/#a",
    "http://x.com/de/9", "http://xcom/de/9", "http://y.net/a/b/c/d/e/f/g", "http://Ünï.ORG/ä?x", "a://b://c/d", "http://x.com/FR/1", "http://notexample.org/es/1",
]


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in urls.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "t", "v") for i, u in enumerate(URLS * 2)], "page_id long, url string, tpl string, seg string")
    out = urls.url_filter(pages).collect()
    assert len(out) == 2 * len(URLS) and {"tpl", "seg"} <= set(out[0].asDict())
    for r in out:
        host, path, rule, verdict = brute_rule(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert urls.url_filter(pages.limit(0)).count() == 0


def brute_templates(rows):
    """{(host, shape): (template, purity)} from (host, shape, labels: None, 0 or 1), by plain recursion over lists."""
    labels = [y for *_, y in rows if y is not None]
    prior, out = (sum(labels) + 1) / (len(labels) + 2), {}
    purity = lambda ys, p: (sum(ys) + urls.K * p) / (len(ys) + urls.K)

    def grow(items, d, tpl, p):  # items: (host, shape, segments, label)
        ended = [x for x in items if len(x[2]) < d]
        items = [x for x in items if len(x[2]) >= d]
        ys = [x[3] for x in items if x[3] is not None]
        if not 0 < sum(ys) < len(ys):
            ended, items = ended + items, []
        for h, s, *_ in ended:
            out[h, s] = tpl, p
        kids = defaultdict(list)
        for x in items:
            kids["/" + x[2][d] if len(x[2]) > d else ""].append(x)
        ys = {k: [x[3] for x in v if x[3] is not None] for k, v in kids.items()}
        rate = {k: sum(y) / len(y) for k, y in ys.items() if y}
        best = (0.0, None)
        for r in sorted(set(rate.values()))[:-1]:
            low = [y for k in rate if rate[k] <= r for y in ys[k]]
            high = [y for k in rate if rate[k] > r for y in ys[k]]
            share = (sum(low) + sum(high)) / (len(low) + len(high))
            z2 = (sum(low) / len(low) - sum(high) / len(high)) ** 2 / (share * (1 - share) * (1 / len(low) + 1 / len(high)))
            if z2 > best[0] + 1e-12:
                best = z2, r
        groups = defaultdict(list)
        for k in kids:
            cut = best[1] if best[0] >= urls.Z**2 else None
            groups["/?0" if k not in rate else "/?" if cut is None else "/?-" if rate[k] <= cut else "/?+"].append(k)
        for code, names in groups.items():
            below = [x for k in names for x in kids[k]]
            grow(below, d + 1, tpl + (names[0] if len(names) == 1 else code), purity([x[3] for x in below if x[3] is not None], p))

    for host in {h for h, *_ in rows}:
        mine = [(h, s, s.split("/") if s else [], y) for h, s, y in rows if h == host]
        grow(mine, 0, "", purity([y for *_, y in mine if y is not None], prior))
    return out


def test_url_templates_match_brute_force(spark):
    rng = random.Random(14)
    rows = []
    for _ in range(3000):
        host = rng.choice(["a.org", "a.org", "a.org", "b.net", "c.com"])
        path = [rng.choice(["x", "y", "z", "", "*"]) for _ in range(rng.randint(0, 9))]
        bad = 0.9 if path[:2] == ["x", "y"] else 0.7 if path[3:5] == ["z", "x"] else 0.1
        rows.append((host, "/".join(path), None if host == "c.com" or rng.random() < 0.3 else int(rng.random() < bad)))
    counts = spark.createDataFrame(rows, "host string, shape string, y int").groupBy("host", "shape").agg(*(chat.F.expr(x) for x in ("count(*) AS n", "count(y) AS l", "count_if(y = 1) AS b")))
    got = {(r["host"], r["shape"]): (r["tpl"], r["p"]) for r in urls.template_tree(counts).collect()}
    want = brute_templates(rows)
    assert set(got) == set(want) and len({t.count("/") for t, _ in want.values()}) > 5
    for k, (tpl, p) in want.items():
        assert got[k][0] == tpl and got[k][1] == pytest.approx(p), k


def test_url_templates_learn_from_labels(spark, monkeypatch):
    rows = [(f"http://s.org/{'bad' if i % 2 else 'good'}/{i}",) for i in range(400)] + [("http://s.org/bad/x9?u",)] * 3 + [("http://s.org/good/y/",)] * 3
    pages = spark.createDataFrame(rows, "url string")
    rules = (("s.org", "/bad/1", "block"), ("s.org", "/bad/3", "block"), ("s.org", "/good/2", "allow"))
    key = lambda r: tuple(r.asDict().items())
    seen = []
    for most in (50_000, 0):  # all templates broadcast, or only those of hot shapes
        monkeypatch.setattr(urls, "MAX_BROADCAST_TEMPLATES", most)
        seen.append(sorted(map(key, urls.url_filter(pages, rules=rules).collect()), key=str))
        out = {r["url"]: r for r in map(dict, seen[-1])}
        assert out["http://s.org/bad/x9?u"]["verdict"] == "block" and out["http://s.org/bad/5"]["verdict"] == "block"
        assert out["http://s.org/good/4"]["verdict"] == "allow" and out["http://s.org/good/y/"]["verdict"] == "allow"
        assert out["http://s.org/bad/5"]["template"] == "s.org/bad" and out["http://s.org/good/4"]["template"] == "s.org/good"
    assert seen[0] == seen[1]


def test_url_of_a_million_characters(spark):
    url = "http://q.org/" + "ab/" * 300_000 + "x" * 100_000
    out = urls.url_filter(spark.createDataFrame([(url,), (url,), ("http://q.org/",)], "url string"), rules=()).collect()
    assert {(r["host"], len(r["path"]), r["verdict"]) for r in out} == {("q.org", 1_000_001, "allow"), ("q.org", 1, "allow")}


def test_sharding_table_and_assignment(spark):
    table = sharding.fill_table(sharding.SHARDS)
    share = Counter(table)
    assert len(table) == sharding.TABLE_SIZE and max(share.values()) - min(share.values()) <= 1
    fewer = sharding.fill_table(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(table, fewer) if a != len(sharding.SHARDS) - 1)
    assert moved < 0.12 * len(table)
    docs = spark.createDataFrame(ODD, DOCS)
    out = sharding.assign_shards(docs.withColumnRenamed("kept", "_slot"), "doc_id", ["a", "b"], 101).collect()
    assert len(out) == len(ODD) and all(r["shard"] in ("a", "b") for r in out)
    assert len({r["shard"] for r in out if r["doc_id"] == 2}) == 1
    assert sharding.assign_shards(docs.limit(0), "doc_id", ["a"], 11).count() == 0
    with pytest.raises(ValueError):
        sharding.fill_table(["a", "a"], 11)


CHAT = [
    (1, 0, "user", "hi"), (1, 1, "user", "again \\l \\b < <|next|>"), (1, 2, "assistant", "<|end|>\n<|role|>user\nno"), (1, 3, "assistant", None),
    (2, None, None, "x"), (2, 5, "assistant", "a"), (2, 5, "assistant", "a"), (3, 1, "we<ird\nrole", ""), (None, 1, "user", "n"), (4, 0, "system", "\U0001F600" * 3),
    (5, 2, "assistant", "z"), (5, 1, "assistant", "y\\"),
]


def test_chat_round_trip(spark):
    turns = spark.createDataFrame([(*r, "c", 1) for r in CHAT * 1], "conv_id long, turn long, role string, text string, _c string, formatted int")
    out = chat.format_conversations(turns).select("conv_id", "formatted", "loss_runs", chat.let(chat.F.col("formatted"), chat.read_back).alias("t"), chat.under_mask(chat.F.col("formatted"), chat.F.col("loss_runs")).alias("masked")).collect()
    want = defaultdict(list)
    for c, n, r, x in CHAT:
        want[c].append(((n is not None, n or 0), r or "", x or ""))
    assert len(out) == len(want)
    for row in out:
        told = [(r, x) for _, r, x in sorted(want[row["conv_id"]])]
        back = [(t["role"], t["text"]) for t in row["t"]]
        assert back == told
        whole, loss = row["formatted"].encode(), []
        for run, (role, _) in zip(row["loss_runs"], told, strict=True):
            assert run["trained"] == (role == "assistant")
            if run["trained"]:
                loss.append(whole[run["start"] : run["start"] + run["bytes"]].decode().replace("\\l", "<").replace("\\b", "\\"))
        assert row["masked"] == "".join(loss)
        assert loss == [x for r, x in told if r == "assistant"]
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_chat_long_conversation(spark):
    """Thousands of turns and one of a million characters in one conversation."""
    said = [("assistant" if i % 3 else "user", f"<t> {i} é\\") for i in range(5000)] + [("assistant", "\U0001F600<" * 500_000)]
    turns = spark.createDataFrame([(1, i, r, x) for i, (r, x) in enumerate(said)], "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(turns).select(chat.under_mask(chat.F.col("formatted"), chat.F.col("loss_runs")).alias("m"), chat.let(chat.F.col("formatted"), chat.read_back).alias("t")).first()
    assert out["m"] == "".join(x for r, x in said if r == "assistant")
    assert [(t["role"], t["text"]) for t in out["t"]] == said


def test_chat_query_digests(spark, sf):
    out = {r["conv_id"]: r for r in chat.op8_chat_format(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect()
    said = "\\### Assistant: </turn> ok"
    by = defaultdict(list, {-7: [("user", said), ("assistant", said)]})
    for r in rows:
        by[r["conv_id"]].append((r["role"], r["text"] or ""))
    assert set(out) == set(by)
    for c, turns in by.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert out[c]["n_turns"] == len(turns)
        assert out[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (out[c]["loss_chars"], out[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_mixing_plans_stay_small(spark, monkeypatch):
    one = spark.createDataFrame([([64, 70, 133],)], "counts array<long>")
    size = lambda n: len(mixing.shard_quotas(one, n, 1)._jdf.queryExecution().analyzed().toString())
    assert size(128) < 1.5 * size(2)  # seven levels, one level

    names, written = [], mixing.written
    monkeypatch.setattr(mixing, "written", lambda df, name: names.append(name) or written(df, name))
    docs = spark.createDataFrame([(i, "w " * (i % 90 + 1), "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    assert mixing.mix(docs).where("size(_draws) > 0").count() > 0
    rounds = names[names.index("mix-outside") + 1 : names.index("mix-draws")]
    assert len(rounds) > 1 and set(rounds) == {"mix-cut"}  # one table a round of filling
