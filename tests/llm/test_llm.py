"""The training-data operators against brute force, round trips and edge cases."""

import base64
import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tempofeat.llm import bpe, components, decontamination, licences, ngram_join, packing, quality_classifier, quality_rules, sharding, token_counts, toxicity, url_filter
from tempofeat.llm.components import connected

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "one", "\n\n", "word " * 30_000, "tab\tand\x0bmore\x1cçà 漢字 ՘ <|endoftext|> x"]


def prose(rng, n):
    return " ".join(rng.choice("the of and tion er ing ed that thand onre heder ste blend anon".split()) + rng.choice(["", "", "s", "ing", "er"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(5, 300)) for _ in range(60)]
    texts += [texts[k] for k in (0, 0, 1)] + [texts[2] + " tail", "head " + texts[3], texts[4].replace("the", "a", 1)]
    rows = [(i, t, ("en", "de", None)[i % 3], f"s{i % 2}", 0) for i, t in enumerate(texts + ODD)]
    rows += [rows[0], (None, texts[5], "en", "s0", 0), (None, None, None, None, None)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing(corpus, empty):
    from tokenizers import Tokenizer

    rows, docs = corpus
    library = Tokenizer.from_file(bpe.resolve("byte_bpe_50k.json"))
    ids = collections.Counter()
    want = {}
    for d, t, *_ in rows:
        own = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        ids[d, len(own)] += 1
        want[d, len(own)] = own
    got = packing.pack(docs, block=4).collect()
    covered, room = collections.Counter(), collections.defaultdict(list)
    for p in got:
        own = want[p.doc_id, p.doc_tokens]
        assert zlib.crc32(own[p.start : p.start + p.length].tobytes()) == p.ids_crc32 and p.length > 0
        covered[p.doc_id, p.doc_tokens] += p.length
        room[p.sequence_id].append((p.offset, p.length))
    assert all(covered[k] == k[1] * n for k, n in ids.items())
    for parts in room.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert sum(n for parts in room.values() for _, n in parts) > 2048 * (len(room) - 3 * 1)
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("text", [" " * 1_000_000 + "a", "\n" * 1_000_000, "a" * 1_000_000, "x" + " \t" * 200_000 + "<|endoftext|> y"])
def test_long_runs(spark, text):
    docs = spark.createDataFrame([("A3", text), (None, "short")], "doc_id string, text string").withColumn("length", F.lit("own"))
    want = bpe.Tokenizer("byte_bpe_50k.json").library(text)
    counted = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs).collect()}
    assert counted["A3"] == len(want)
    packed = packing.pack(docs).where("doc_id = 'A3'").orderBy("start").collect()
    ids = np.array([*want, 1], dtype="<u4")
    assert sum(p.length for p in packed) == len(ids) and all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in packed)


def test_balanced_costs():
    packer = packing.Packer(100, 1.0, 1.0, 1000)
    for n in (60, 60, 40, 40, 30, 30, 20, 20):
        packer.add(n, np.zeros(n, dtype="<u4"))
    total = collections.Counter()
    for r in packer.close():
        total[r[5]] += r[2]
    assert dict(total) == {0: 100, 1: 100, 2: 100}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(corpus, empty, name):
    rows, docs = corpus
    t = bpe.Tokenizer(name)
    want = sorted((str(d), len((x or "").encode()), len(t.library(x or ""))) for d, x, *_ in rows)
    docs = docs.withColumns({c: F.lit("own") for c in ("n_tokens", "n_bytes", "over_limit")})
    got = token_counts.count_tokens(docs, tokenizer=name, table=50, limit=100).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert token_counts.count_tokens(empty, tokenizer=name).count() == 0


def test_misra_gries_keeps_the_frequent():
    counts = collections.Counter({f"w{i}": 1 for i in range(100)} | {"often": 50})
    assert "often" in token_counts.shrink(counts, 10) and len(token_counts.shrink(counts, 10)) <= 10


def test_permutation():
    for n in (1, 2, 3, 24, 1000, 4097):
        p = sharding.Permutation(n, 5)
        placed = p.forward(np.arange(n))
        assert sorted(placed) == list(range(n)) and (p.backward(placed) == np.arange(n)).all()
    assert sharding.row_at(*sharding.locate(77, 1000, 24), 1000, 24) == 77


def test_sharding(corpus, empty):
    rows, docs = corpus
    clash = {c: F.lit("own") for c in ("_part", "_at", "_tie", "part", "tie", "spot", "n", "size", "shard", "slot")}
    got = sharding.document_shards(docs.withColumns(clash), 5).collect()
    extra, total = sharding.number_rows(docs.withColumns(clash), [F.col("doc_id"), F.crc32(F.col("text").cast("binary"))])
    assert total == len(rows) and set(extra.columns) == {*docs.columns, *clash, "row_number"}
    # numbers are places in the sorted table
    key = lambda d, t: (d is not None, d or 0, zlib.crc32((t or "").encode()), len((t or "").encode()))
    assert [(r.doc_id, r.text_crc32, r.size - 8) for r in sorted(got, key=lambda r: r.row_number)] == [(d, zlib.crc32((t or "").encode()), len((t or "").encode())) for d, t, *_ in sorted(rows, key=lambda r: key(*r[:2]))]
    assert sorted(r.row_number for r in got) == list(range(len(rows)))
    again = sharding.document_shards(docs.repartition(7), 5).collect()
    key = lambda r: (str(r.doc_id), r.size, r.text_crc32, r.shard, r.slot)
    assert sorted(map(key, got)) == sorted(map(key, again))
    want = sorted((str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert sorted(key(r)[:3] for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert (r.shard, r.slot) == sharding.locate(r.row_number, len(rows), 5)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sharding.document_shards(empty).count() == 0


def brute_hits(texts, items, width=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = []
    for name, t in items:
        w = words(t)
        n = min(width, len(w))
        windows += [(name, tuple(w[i : i + n])) for i in range(len(w) - n + 1 if n else 0)]
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for name, win in windows:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found.add(str(name))
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_decontamination(spark, empty):
    rng = random.Random(3)
    items = [(i, prose(rng, n)) for i, n in enumerate([9, 10, 25, 40, 3])] + [(7, None), (8, "..."), (9, "Zweiundzwanzig Äpfel"), (9, "Zweiundzwanzig Äpfel")]
    texts = [prose(rng, 80) for _ in range(20)] + [f"{prose(rng, 20)} {t} {prose(rng, 5)}" for _, t in items[:5]] + [items[3][1][: len(items[3][1]) // 2], "ZWEIUNDZWANZIG, Äpfel!", *ODD]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1_000_000, 20):
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontamination.matches(docs, bench, block=block).collect()}
        assert [got[i] for i in range(len(texts))] == brute_hits(texts, items)
        clean = decontamination.decontaminated(docs.withColumns({"spans": F.lit("own"), "items": F.lit(1)}), bench, block=block, shard=4000)
        assert clean.columns == ["doc_id", "text", "spans", "items"] and {r.doc_id for r in clean.collect()} == {i for i, (_, hit, _) in got.items() if not hit}
    one, many = (sorted(map(str, decontamination.matches(docs, bench, block=block, shard=shard).select("doc_id", "spans", "longest").collect())) for block, shard in ((1_000_000, 8 << 20), (20, 1)))
    assert one == many
    assert decontamination.matches(empty, bench).count() == 0
    assert decontamination.decontaminated(docs, bench.limit(0)).count() == len(texts)


def test_longest_match(spark):
    docs = spark.createDataFrame([(1, "x a b c d e f g h i j k l y")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "item_id long, text string")
    row = decontamination.matches(docs, bench).head()
    assert (row.longest, row.spans) == (12, [[1, 13]])


def brute_links(texts, threshold=0.8, n=5):
    sets = [frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if (w := (t or "").encode().split()) else frozenset() for t in texts]
    links = {i: {j for j in range(len(sets)) if j != i and sets[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold} for i in range(len(sets))}
    return links


@pytest.fixture(scope="module")
def copies(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(6):
        base = prose(rng, rng.randint(30, 120)).split()
        for k in range(rng.randint(1, 25)):
            own = list(base)
            for _ in range(k % 4):
                own[rng.randrange(len(own))] = f"new{rng.random()}"
            texts.append(" ".join(own))
    texts += ODD[:5] + ["short text", "short text", "a b c d e", "a b c d f"]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("how", [{}, {"block": 4}, {"broadcast_rows": 0}, {"block": 2, "broadcast_rows": 0}])
def test_ngram_join(copies, how):
    texts, docs = copies
    links = brute_links(texts)
    label = list(range(len(texts)))
    for _ in texts:
        label = [min([label[i], *(label[j] for j in links[i])]) for i in range(len(texts))]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(docs, **how).collect()}
    assert got == {i: (label[i], len(links[i])) for i in range(len(texts))}


def test_a_chain_moves_each_text_a_bounded_number_of_times(spark):
    # each text shares some bands with the next, and the whole is one component
    rng = random.Random(12)
    words = [f"w{rng.random()}" for _ in range(1200 * 4 + 60)]
    texts = [" ".join(words[4 * k : 4 * k + 50]) for k in range(1200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sets = [set(ngram_join.ngrams(t, 5).tolist()) for t in texts]
    want = {k: sum(len(sets[k] & sets[j]) / len(sets[k] | sets[j]) >= 0.8 for j in (k - 2, k - 1, k + 1, k + 2) if 0 <= j < 1200) for k in range(1200)}
    got = {r.doc_id: r.n_links for r in ngram_join.near_duplicates(docs, block=50).collect()}
    assert sum(got.values()) >= 0.999 * sum(want.values()) > 1200 and all(got[k] <= want[k] for k in want)
    nodes = ngram_join.signatures(docs, 5, ngram_join.bands_for(0.8, 0.9995), "doc_id", "text").withColumnRenamed("doc_id", "node")
    ties = nodes.select("node", F.explode("bands").alias("b")).groupBy("b").agg(F.min("node").alias("v"), F.collect_list("node").alias("u")).select(F.explode("u").alias("u"), "v")
    placed = ngram_join.groups(nodes, connected(ties), 50, 10**9)
    assert placed.where("band is not null").count() > 0 and placed.groupBy("node").agg(F.sum("blocks").alias("n")).agg(F.max("n")).head()[0] <= 33


def test_deduplicated(copies, corpus, empty):
    texts, docs = copies
    docs = docs.withColumns({"digest": F.lit("own"), "node": F.lit(1), "_id": F.lit("x"), "class_id": F.lit(None).cast("long"), "first": F.lit(False), "__id": F.lit(1), "dup_id": F.lit(2), "key_hash": F.lit(3)})
    kept = ngram_join.deduplicated(docs)
    got = {r.doc_id: r.class_id for r in ngram_join.near_duplicates(docs).collect()}
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in got.items() if i == c)
    rows, repeated = corpus
    kept = ngram_join.deduplicated(repeated).collect()
    assert sum(r.text == rows[0][1] for r in kept) == 1 and sum(r.text is None for r in kept) == 2
    assert ngram_join.near_duplicates(empty).count() == 0 and ngram_join.deduplicated(empty).count() == 0


def test_components(spark):
    edges = [(1000 + i, 5000 - i % 3) for i in range(1500)] + [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (5, 5), (200, 200)] + [(300, 300 + i) for i in range(30)]
    edges += [(1_000_000, k) for k in range(2_000_000, 2_002_500)]  # a hub
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "u long, v long")).collect() if r.node < 1_000_000 or r.component != 1_000_000}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100} | {300 + i: 300 for i in range(30)} | {1000 + i: 1000 + i % 3 for i in range(1500)} | {5000 - i: 1000 + i for i in range(3)}


def test_components_are_whole_or_an_error(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long")
    with pytest.raises(RuntimeError, match="settled"):
        connected(path, rounds=2)
    assert {r.component for r in connected(path).collect()} == {0}
    assert connected(path.limit(0), rounds=0).count() == 0


def test_components_by_either_way(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1400)] + [(i, i + 1) for i in range(5000, 5200)] + [(9000, k) for k in range(9001, 12_500)] + [(7, 7), (-5, 3)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    frame = spark.createDataFrame(edges, "u long, v long").repartition(3)
    for local in (10_000, 0):
        assert sorted(map(tuple, connected(frame, local=local).collect())) == sorted(want.items()), local
    shuffled = pa.RecordBatch.from_pydict({"u": [u for u, _ in edges], "v": [v for _, v in edges]})
    few = list(components.contracted(iter([shuffled.slice(k, 50) for k in range(0, len(edges), 50)]), 400))
    assert len(few) > 1 and sorted(map(tuple, connected(spark.createDataFrame([(a, b) for x in few for a, b in zip(*x.to_pydict().values(), strict=True)], "u long, v long")).collect())) == sorted(want.items())


def test_components_of_a_small_graph_take_few_jobs(spark):
    # a job leaves its plan and its tasks' metrics with the driver, and its shuffles on disk
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long").repartition(4)
    spark.sparkContext.setJobGroup("components", "")
    try:
        assert {r.component for r in connected(edges).collect()} == {0}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("components")) <= 8


def test_bands():
    bands, rows = ngram_join.bands_for(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= 256
    with pytest.raises(ValueError, match="recall"):
        ngram_join.bands_for(0.01, 0.9999)


def brute_base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeat = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeat)


def test_quality_rules(spark, corpus, empty):
    rows, docs = corpus
    rng = random.Random(2)
    extra = ["a b c a b c a b c d", "a a a a", "x\nx\ny\n\nx", "#1 *2* <b>|& $%", "a b c " * 40]
    texts = [r[1] for r in rows] + extra + [prose(rng, 100) for _ in range(150)] + ["###".join(prose(rng, 100).split(" "))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).withColumns({c: F.lit("taken") for c in ("level", "kept", "n", "_q", "_level", "symbol_rate", "__c", "__lang", "counts", "fence", "fence_lang", "_Fence", "q", "__kept")})
    for drop in (True, False):
        judged = quality_rules.judge(docs, drop_text=drop)
        assert set(judged.columns) == {*docs.columns, "__q", "__level", "__kept"} - ({"text"} if drop else set())
        got = {r.doc_id: r for r in judged.collect()}
        for i, t in enumerate(texts):
            q = got[i]["__q"]
            assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == brute_base(t)
            assert q.base_failed == (q.n_words < 50 or 100 * q.n_repeat_words > 50 * q.n_words)
        assert all(got[i]["__kept"] for i in range(len(texts) - 151, len(texts) - 1)) and not got[len(texts) - 1]["__kept"]
    assert quality_rules.judge(empty).count() == 0


def test_fences_of_large_groups(spark):
    rng = random.Random(7)
    rows = [("en", "a", rng.gauss(5, 1)) for _ in range(20_000)] + [("en", "b", rng.gauss(6, 1)) for _ in range(40)] + [(None, None, rng.random() * 1e6) for _ in range(300)]
    rows = [(lang, source, max(x, 0.0)) for lang, source, x in rows]
    q = F.struct(F.lit(False).alias("base_failed"), *(F.col("x").alias(m) for m in quality_rules.MEASURES))
    measures = spark.createDataFrame(rows, "lang string, source string, x double").select("lang", "source", q.alias("q"))
    first = sorted(quality_rules.fences(measures.repartition(3), 100, 1.0).collect(), key=str)
    assert first == sorted(quality_rules.fences(measures.repartition(11), 100, 1.0).collect(), key=str)
    got = {(r.lang, r.source): r.fence for r in first}
    assert [got[k].level for k in (("en", "a"), ("en", "b"), (None, None))] == ["source", "lang", "source"]
    for key, within in ((("en", "a"), {("en", "a")}), (("en", "b"), {("en", "a"), ("en", "b")}), ((None, None), {(None, None)})):
        own = sorted(x for lang, source, x in rows if (lang, source) in within)
        a, b = (own[-(-len(own) * k // 4) - 1] for k in (1, 3))
        spread = got[key].high_word_length - got[key].low_word_length
        assert abs(spread - 3 * (b - a)) <= 3 * (a + b) / 64 and abs(got[key].low_word_length - (a - (b - a))) <= 3 * b / 64
    assert quality_rules.fences(measures.limit(0), 100, 1.0).count() == 0


def test_url_filter(spark):
    urls = ["http://a.COM/en/7?x", "https://example.com/en/77", "ftp://example.com/en/8", "http://x.example.net/de/8#f", "http://net/de/1", "http://org/es", "no scheme", None, "http://", "http://com", "http://notcom/en/1", "://com/en/"]
    pages = spark.createDataFrame([*enumerate(urls), (0, urls[0])], "page_id long, url string")

    def brute(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fit = [(len(h + p), h + p, a) for h, p, a in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[1:] if fit else (None, "allow")))

    for most in (100, 0):
        got = url_filter.filter_urls(pages, url_filter.rules_table(spark), broadcast_rules=most).collect()
        assert sorted((r.page_id, r.host, r.path, str(r.rule), r.verdict) for r in got) == sorted((i, *map(str, brute(u))) for i, u in [*enumerate(urls), (0, urls[0])])
    clash = pages.withColumns({c: F.lit("own") for c in ("host", "path", "Rule", "_row", "own", "r_host", "digest", "short", "k0", "label")})
    kept = url_filter.filter_urls(clash, url_filter.rules_table(spark), keep=("page_id", "host", "_row", "own", "Rule", "label"))
    assert kept.columns == ["page_id", "_row", "own", "label", "host", "path", "rule", "verdict"] and kept.where("host = 'own' or _row <> 'own'").count() == 0
    none = url_filter.filter_urls(pages, url_filter.rules_table(spark).limit(0))
    assert {r.verdict for r in none.collect()} == {"allow"} and url_filter.filter_urls(pages.limit(0), url_filter.rules_table(spark)).count() == 0


def test_licences(spark):
    mit = licences.KNOWN["MIT"]
    texts = [mit, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ;"), mit.replace("sublicense", "sub-license").replace("COPYRIGHT HOLDERS", "COPYRIGHT OWNERS"), mit + " more", None, "", "© 2020\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("licence", F.lit("own"))
    got = {r.doc_id: r.licence for r in licences.scan(docs, licences.licence_table(spark)).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: "MIT", 3: None, 4: None, 5: None, 6: None}
    both = spark.createDataFrame([("B", mit), ("A", mit), ("C", "")], "licence string, text string")
    assert [r.licence for r in licences.scan(docs.where("doc_id = 0"), both).collect()] == ["A"]
    assert licences.scan(docs.limit(0), both).count() == 0


def test_licence_files(spark):
    import duckdb

    from tempofeat.llm import queries

    whole = [k for k in licences.KNOWN if ":" not in k and "notice" not in k]
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "BSL-1.0", "MIT", "ISC", "GPL-1.0", "LGPL-2.0", "MPL-1.1", "GFDL-1.2", "GFDL-1.3", "Artistic-1.0-Perl", "Unlicense", "Zlib", "0BSD", "MIT-0", "WTFPL"} == set(whole)
    rows = [(k, "Copyright 2020 Someone\n\n" + t) for k, t in licences.KNOWN.items()] + [(k, licences.KNOWN[k].upper()) for k in whole]
    rows += [("MIT: MIT License", "MIT License\n\nCopyright (c) 2020 Someone\n\n" + licences.KNOWN["MIT"]), ("ISC: ISC License", "ISC License\n\n(c) 2020 Someone\n\n" + licences.KNOWN["ISC"]), (None, "A title of its own\n\n" + licences.KNOWN["MIT"])]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = sorted(licences.scan(docs, licences.licence_table(spark)).collect())
    assert [r.licence for r in got] == [k for k, _ in rows]
    base = duckdb.connect()
    base.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    base.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, (_, t) in enumerate(rows)])
    assert sorted(base.execute(queries.SQL["op10_licence_scan"]).fetchall()) == [tuple(r) for r in got]


def labelled(spark, bad, n=300):
    rng = random.Random(4)
    rows = [(i, prose(rng, 40) if i % 2 else bad(rng)) for i in range(n)]
    docs = spark.createDataFrame([*rows, (n, None), (n + 1, ""), (None, "text")], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(n)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")


def test_quality_classifier(spark):
    docs, labels = labelled(spark, lambda rng: " ".join(w + "###" for w in prose(rng, 40).split()))
    model = quality_classifier.fit(docs, labels, buckets=1 << 12, epochs=6)
    rows = quality_classifier.scored(docs, model).withColumn("h", quality_classifier.held_out(F.col("doc_id"), 5, 0)).collect()
    held = [r for r in rows if r.h and r.doc_id is not None and r.doc_id < 300]
    assert len(held) > 30 and all((r.score >= 0.3) == bool(r.doc_id % 2) for r in held) and all(0 <= r.score <= 1 for r in rows)
    kept = quality_classifier.kept(docs, model)
    assert kept.columns == docs.columns and len(rows) == 303
    assert quality_classifier.scored(docs.withColumn("score", F.lit("own")), model).columns == ["doc_id", "text", "score"]
    nothing = quality_classifier.fit(docs, labels.limit(0))
    assert {r.score for r in quality_classifier.scored(docs, nothing).collect()} == {0.5}
    assert quality_classifier.scored(docs.limit(0), model).count() == 0


def brute_features(text, buckets):
    """Buckets of a text's features, one Python number at a time."""
    top, odd = 1 << 64, 0x9E3779B97F4A7C15
    place = lambda h: (h % top * odd % top) >> (64 - buckets.bit_length() + 1)
    out, x = [], [ord(c) + 1 for c in text]
    for g in quality_classifier.GRAMS:
        for i in range(len(x) - g + 1):
            h = g
            for v in x[i : i + g]:
                h = (h * 1000003 + v) % top
            out.append(place(h))
    words = []
    for w in re.findall(r"[^\x20\x09-\x0D]+", text):
        h = 0
        for k, c in enumerate(w):
            weight = (2 * k + 1) * 0xD1B54A32D192ED03 % top
            weight ^= weight >> 31
            h += (ord(c) + 1) ** 2 * weight + ord(c) + 1
        words.append(h % top)
    return out + [place(h) for h in words] + [place(a ^ b) for a, b in zip(words, words[1:])]


def test_quality_scores_by_brute_force():
    import pyarrow as pa

    texts = ["abc defdef def def", "", None, "Über 漢字漢字 çà\tx\x0by  y y\n", "a", "ab ab", "the quick brown fox " * 9]
    rng = np.random.default_rng(1)
    model = quality_classifier.Model(rng.normal(0, 30, 1 << 10).astype(np.float32), 0.25)
    got = model.score(pa.array(texts))
    for t, s in zip(texts, got, strict=True):
        f = brute_features(t or "", 1 << 10)
        logit = 0.25 + sum(float(model.weight[k]) for k in f) / max(len(f), 1)
        assert abs(s - 1 / (1 + np.exp(-logit))) < 1e-6


def test_a_step_of_training_by_brute_force():
    buckets, dim, rate, move = 8, 3, 0.2, 5.0
    docs = [([0, 1], [0.5, 0.5], 1), ([1, 2, 5], [0.25, 0.5, 0.25], 0), ([3], [1.0], 0)]
    rows = [(np.array(b), (np.array(s) * 4).astype("<u1")) for b, s, _ in docs]
    got = quality_classifier.train(rows, np.array([y for *_, y in docs]), buckets, dim, 1, rate, move, 3, 9)
    rng = np.random.default_rng(9)
    vectors, soft, bias = rng.normal(0, 1 / dim, (buckets, dim)), rng.normal(0, 0.5, (dim, 2)), np.zeros(2)
    new_v, new_s, new_b = vectors.copy(), soft.copy(), bias.copy()
    for b, s, y in docs:
        mean = sum(w * vectors[k] for k, w in zip(b, s))
        p = np.exp(mean @ soft + bias)
        p /= p.sum()
        p[y] -= 1
        p *= 3 / (2 * (1 if y else 2)) / 3  # classes weigh alike, and a batch is a mean
        new_s -= rate * np.outer(mean, p)
        new_b -= rate * p
        for k, w in zip(b, s):
            new_v[k] -= move * 3 * w * (soft @ p)
    assert np.allclose(got.weight, new_v @ (new_s[:, 1] - new_s[:, 0]), atol=1e-4) and abs(got.bias - (new_b[1] - new_b[0])) < 1e-5


def test_features_do_not_cross_texts():
    one = np.frombuffer(b"abc defdef def def", dtype=np.uint8)
    bucket, owner = quality_classifier.features(one, np.array([0, 7, 18]), 1 << 12)
    first = quality_classifier.features(one[:7].copy(), np.array([0, 7]), 1 << 12)[0]
    assert sorted(bucket[owner == 0]) == sorted(first)


def test_toxicity(spark):
    def bad(rng):
        w = prose(rng, 40).split()
        w[rng.randrange(40)] = rng.choice(["grumbel", "zorkit", "plaffo"]) + rng.choice(["", "###", "!!"])
        return " ".join(w)

    docs, labels = labelled(spark, bad)
    model = toxicity.fit(docs, labels, landmarks=64)
    rows = toxicity.scored(docs, model).withColumn("h", quality_classifier.held_out(F.col("doc_id"), 4, 2)).collect()
    held = [r for r in rows if r.h and r.doc_id is not None and r.doc_id < 300]
    assert len(held) > 30 and sum((r.score >= 0.3) != (r.doc_id % 2 == 0) for r in held) <= 1
    score = toxicity.Scorer(model)(["a grum.bel here", "you g r u m b e l fool", "grummbel", "the of and", None, ""])
    assert (score[:3] >= 0.3).all() and (score[3:] < 0.3).all()
    twice = docs.unionByName(docs).withColumns({"doc_id": F.col("doc_id"), "label": F.lit("own"), "strings": F.lit("own"), "_label": F.lit(7)})
    again = toxicity.fit(twice.drop("_label"), labels.unionByName(labels), landmarks=64)
    assert np.allclose(again.values, model.values)  # one row of each id
    nothing = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.scored(docs, nothing).collect()} == {0.5}
    assert toxicity.scored(docs.limit(0), model).count() == 0


def test_spelled_out_letters_in_long_prose(spark):
    def bad(rng):
        w = prose(rng, 40).split()
        w[rng.randrange(40)] = rng.choice(["grumbel", "zorkit", "plaffo"])
        return " ".join(w)

    score = toxicity.Scorer(toxicity.fit(*labelled(spark, bad), landmarks=64))
    rng = random.Random(6)
    clean = [prose(rng, 150) for _ in range(20)]
    assert (score(clean) < 0.3).all() and (score([t + " g r u m b e l " + t for t in clean]) >= 0.3).all()
    assert toxicity.strings("A b c\nlonger d e") == ["a", "b", "c", "longer", "d", "e", "abc"]
    assert toxicity.strings("words x y z") == ["words", "x", "y", "z", "xyz"]
    assert "zyx" * 40 not in toxicity.strings("prose " + "z y x " * 40) and "zyxzyxzyxz" in toxicity.strings("prose " + "z y x " * 40)


def test_subsequences_by_hand():
    rng = random.Random(5)
    wide = ["".join(chr(rng.randrange(0x20000, 0x2FFFF)) for _ in range(9)) for _ in range(9000)]
    for words in ([], [""], ["", "a", "aa"], ["abcab", "ba!b.a", "", "abcab", "ß中_ab"], wide):
        found = {}
        for i, w in enumerate(words):
            framed = "\x02\x02" + re.sub(r"[\W_]+", "", w) + "\x03"
            for k in range(len(framed)):
                for b in range(2, toxicity.SPAN):
                    for a in range(1, b):
                        if k + b < len(framed):
                            key = ord(framed[k]) << 42 | ord(framed[k + a]) << 21 | ord(framed[k + b])
                            found[i, key] = found.get((i, key), 0.0) + toxicity.DECAY ** (b + 1)
        owner, key, weight = (x.tolist() for x in toxicity.subsequences(words))
        assert list(zip(owner, key, strict=True)) == sorted(found)
        assert weight == pytest.approx([found[k] for k in sorted(found)])


def test_toxicity_behind_the_longest_string():
    rng = random.Random(5)

    def bad():
        w = prose(rng, 40).split()
        return " ".join([*w[:20], rng.choice(["grumbel", "zorkit", "plaffo", "krambolaskivontari"]), *w[20:]])

    texts = [prose(rng, 40) if i % 2 else bad() for i in range(300)]
    score = toxicity.Scorer(toxicity.train([toxicity.strings(t) for t in texts], np.arange(300) % 2 == 0, landmarks=64))
    for glue in ("", "_", "-", "/"):
        clean = [prose(rng, 30).replace(" ", glue) for _ in range(60)]
        toxic = [t[: 70 + i] + glue + ("grumbel", "plaffo", "krambolaskivontari")[i % 3] + glue + t[70 + i :] for i, t in enumerate(clean)]
        assert (score(clean) < 0.3).mean() > 0.95 and (score(toxic) >= 0.3).mean() > 0.95
    long = "".join(map(chr, range(0x4E00, 0x4E00 + 1001)))
    assert all(any(long[k : k + 32] in p for p in toxicity.strings(long)) for k in range(1001 - 31))
    assert toxicity.strings("a" * 64) == ["a" * 64] and toxicity.strings("-" * 99 + " B") == ["-" * 99, "b"]


def test_subsequence_kernel():
    brute = brute_kernel
    words, marks = ["idiot", "idxiot", "the", "aaaa"], ["idiot", "aaa", "thee"]
    got = toxicity.kernel(words, marks)
    assert np.allclose(got, [[brute(s, t) for t in marks] for s in words], atol=1e-6)


def test_folded_scores_are_kernels_times_weights():
    words = ["idiot", "idi.ot", "xidiotx", "the", "these", "aaaa", "other", "io"]
    labels, marks = np.array([1, 1, 1, 0, 0, 0, 0, 0]), ["idiot", "the", "aaaa", "idxiot"]
    beta, bias = toxicity.solve(words, labels, np.ones(len(words)), marks, 0.01)
    machine = toxicity.folded(beta, bias, marks)
    unseen = [*words, "idddiot", "x", "zzzz", "ioidiotid"]
    want = [bias + sum(b * brute_kernel(re.sub(r"[\W_]+", "", s), m) for b, m in zip(beta, marks)) for s in unseen]
    assert np.allclose(machine.margins(unseen), want, atol=1e-5)
    machine.weights = np.array([1.0, 0.5, 0.0, 0.0, -0.2])
    top = sorted((min(3, max(-3, m)) for m in want[:8]), reverse=True)
    score = toxicity.Scorer(machine)([" ".join(words)])[0]
    assert abs(score - 1 / (1 + np.exp(-(top[0] + 0.5 * top[1] - 0.2)))) < 1e-5


def brute_kernel(s, t):
    def phi(w):
        w, out = "\x02\x02" + w + "\x03", collections.Counter()
        for i in range(len(w)):
            for b in range(2, toxicity.SPAN):
                for a in range(1, b):
                    if i + b < len(w):
                        out[w[i], w[i + a], w[i + b]] += toxicity.DECAY ** (b + 1)
        return out

    dot = lambda x, y: sum(v * y[k] for k, v in x.items())
    return dot(phi(s), phi(t)) / (dot(phi(s), phi(s)) * dot(phi(t), phi(t))) ** 0.5 if dot(phi(s), phi(s)) else 0.0


def test_pipeline_by_hand(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    good = [prose(rng, 80) for _ in range(40)]
    junk = [" ".join(w + "###" for w in prose(rng, 80).split()) for _ in range(20)]
    bench = [(0, prose(rng, 15))]
    texts = good + junk + [good[0], good[1] + " end"] + [good[2] + " " + bench[0][1]] + [None, ""]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 40), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    links = brute_links(texts)
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    hit = {i for i, (_, n, _) in enumerate(brute_hits(texts, bench)) if n}
    want = {i for i in [*range(40), 60, 61, 62] if not any(j < i for j in links[i])} - hit
    assert got == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "near_duplicates", "decontamination", "packing"]


def test_pipeline_edge_cases(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(16)
    clash = ", ".join(f"{c} string" for c in ("__q", "__kept", "score", "class", "spans", "dup_id", "length"))
    for name, n in (("none", 0), ("some", 30)):
        texts = ([prose(rng, 80) for _ in range(n)] + [None, "", "word " * 30_000] * 2) if n else []
        rows = [(None if i % 7 == 3 else i, t, None, None, None, *["own"] * 7) for i, t in enumerate(texts)]
        rows += rows[:2]
        spark.createDataFrame(rows, f"{SCHEMA}, {clash}").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([(None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == ({None if i % 7 == 3 else i for i in range(n)} if n else set())


def test_vocabulary_by_two_libraries():
    with open(bpe.resolve("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    assert bpe.Tokenizer("byte_bpe_50k.json").engine._mergeable_ranks == ranks
