"""The dealt operators against brute force on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import components, decontamination, induced_sort, language, line_dedup, mixing, sharding, simhash, suffix_dedup, topk, toxicity, url_filter
from tessera.llm.common import split_join
from tessera.llm.ftrl import Ftrl

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(n=60, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(80)]
    say = lambda k: "\n".join(" ".join(rng.choice(vocabulary) for _ in range(9)) for _ in range(k))
    base = [say(rng.randint(1, 8)) for _ in range(n // 3)]
    out = []
    for i in range(n):
        t = rng.choice(base)
        if i % 3 == 1:
            t = t[: len(t) // 2] + " x " + t[len(t) // 2 :]
        if i % 3 == 2:
            t = say(2) + "\n" + t + "\n\n" + say(1)
        out.append((i, t, "en", f"s{i % 3}", len(t)))
    out += [(n, None, None, None, None), (n + 1, "", "en", "s0", 0), (n + 2, "  \n\t ", "en", "s9", 5), (n + 3, base[0], "en", None, 1), (n + 3, base[0], "en", None, 1), (None, base[1], "en", "s1", 1), (n + 4, "one", "en", "s1", 3), (n + 5, "long " * 5000, "en", "s1", 9)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def simple_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_fingerprint():
    for t in ["", None, "A b", "É ü\x1c a\x85b c d", "a b c d " * 9, "x"]:
        assert simhash.fingerprint(None if t is None else t.encode()) == simple_fingerprint(t)


def closure(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_a_hub(spark):
    """A star of many leaves and a chain, with hubs split at any threshold."""
    edges = [(5000 + i, 17) for i in range(300)] + [(i, i + 1) for i in range(100, 140)] + [(5001, 120), (9, 9)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long"), hot=20).collect()}
    assert got == {n: 17 for n in [*range(5000, 5300), *range(100, 141)]}


@pytest.mark.parametrize("tile", [4096, 8])
def test_links(spark, tile):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:20]:
        for _ in range(6):
            for _ in range(rng.randint(1, 4)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {r.node: r.root for r in components.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), tile=tile)).collect()}
    want = closure(len(fps), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 3)
    groups, mine = defaultdict(set), defaultdict(set)
    for i, f in enumerate(signed):
        groups[want[i]].add(f)
        mine[got.get(f, f)].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_near_duplicates(docs, none):
    rows = docs.collect()
    got = simhash.near_duplicates(docs.withColumn("fp", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    fps = [simple_fingerprint(r.text) for r in rows]
    root = closure(len(rows), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 3)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[root[i]] = min(least.get(root[i], 1 << 60), r.doc_id)
    want = Counter((r.doc_id, f"{fps[i]:016x}", least.get(root[i])) for i, r in enumerate(rows))
    assert Counter(tuple(r) for r in got) == want
    assert simhash.near_duplicates(none).count() == 0


def mixed(df):
    return mixing.mix(df, F.col("doc_id"), F.col("source"), F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)))


def test_mixing(docs, none):
    rows = mixed(docs).collect()
    assert len(rows) == docs.count() and sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixed(docs).collect()), key=str)
    size, target, taken = {}, {}, defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and r.first_taken <= r.size
        size[r.source], target[r.source] = r.source_size, r.target
        taken[r.source] += r.taken
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    want, left, free = {}, 1.5 * sum(size.values()), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > 2 * size[s]}
        if not full:
            want |= {s: weight[s] * level for s in free}
            break
        want |= {s: 2.0 * size[s] for s in full}
        left -= sum(2 * size[s] for s in full)
        free -= full
    for s in names:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - target[s]) <= max(64, 0.02 * target[s])
    assert mixed(none).count() == 0


def test_language(spark):
    alphabet = {"aa": "abcd", "bb": "wxyz"}
    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choice(alphabet[k]) for _ in range(5)) for _ in range(8)), k) for i, k in enumerate(["aa", "bb"] * 60)]
    rows += [(500, None, "aa"), (501, "12 34 !", "bb"), (502, "abc dab", None), (503, "", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learn = F.col("doc_id") % 5 != 0
    got = {r.doc_id: r for r in language.identify(df, learn).collect()}
    assert all(got[i].lang_pred == k for i, t, k in rows[:120]) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (500, 501, 502, 503)] == ["und", "und", "aa", "und"]
    hidden = df.withColumn("lang", F.when(learn, F.col("lang")))
    assert {r.doc_id: tuple(r) for r in language.identify(hidden, learn).collect()} == {k: tuple(v) for k, v in got.items()}
    assert all(r.lang_pred == "und" for r in language.identify(df.withColumn("lang", F.lit(None).cast("string")), learn).collect())


def test_language_scores_by_hand(spark):
    """TF-IDF, softmax and temperature computed apart with string n-grams, of languages that share an alphabet; ties, repeats."""
    rng, stems = random.Random(8), {"aa": ["tion", "the", "ing"], "bb": ["chen", "ung", "sch"], "cc": ["ci\u00f3n", "mente", "los"]}
    rows = [(i, " ".join("".join(rng.choice(stems[k] + ["en", "ar"]) for _ in range(3)) for _ in range(12)), k) for i, k in enumerate(["aa", "bb", "cc"] * 50)]
    rows += [(3, rows[4][1], "aa"), (3, rows[4][1], "aa"), (None, "tion the", "aa"), (700, "ung " * 30_000, None), (701, "!!", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"lang_pred": F.lit("clash"), "_h": F.lit(1)})
    learn = F.col("doc_id").isNotNull() & (F.col("doc_id") % 5 != 0)
    got = language.identify(df, learn).collect()
    assert len(got) == len(rows)
    known = [t for i, t, k in rows if i is not None and k is not None and i % 5]
    grams = lambda t: Counter(t.lower()[a : a + n] for n in (1, 2, 3) for a in range(len(t) - n + 1))

    def slot(gram):
        h = len(gram) * 0x27D4EB2F & 0xFFFFFFFF
        for c, m in zip(gram, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), strict=False):
            h = (h ^ ord(c)) * m & 0xFFFFFFFF
            h ^= h >> 15
        return (h * 0x2C1B3C6D & 0xFFFFFFFF) >> 18

    for t in known[:5]:
        c = Counter()
        for g, n in grams(t).items():
            c[slot(g)] += n
        assert {int(i): int(language.counts(t)[i]) for i in np.flatnonzero(language.counts(t))} == dict(c)
    df_counts, n = language.frequencies(df.where(learn & F.col("lang").isNotNull()).select("text"))
    assert n == len(known) and (df_counts == sum((language.counts(t) > 0).astype(np.int64) for t in known)).all()
    right = [r.lang_pred == k for r, (i, t, k) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0)), sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), strict=True) if i is not None and i % 5 == 0 and k]
    assert np.mean(right) > 0.95
    assert {(r.lang_pred, r.score) for r in got if r.doc_id == 701} == {("und", 0.0)}


def test_ftrl_is_sparse():
    rng, m = np.random.default_rng(0), Ftrl(51, l1=2.0)
    for _ in range(400):
        x = np.r_[rng.choice(50, 5, replace=False), 50]  # the last feature is always there and takes the base rate
        w = m.weights(x)
        p = 1 / (1 + np.exp(-w.sum()))
        m.update(x, np.full((6, 1), p - (0 in x)), w)
    got = m.weights()[:, 0]
    assert got[0] > 1 and (got[1:50] == 0).mean() > 0.3


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)], 0) for i in range(90)]
    rows += [(100 + i, rows[3][1], 0) for i in range(20)] + [(200, None, 0), (201, [float("nan")] * 6, 0), (202, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (None, rows[1][1], 0), (203, [1e6] * 6, 0), (5, rows[5][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 10 == 0, k=5, query_bytes=300).orderBy("query_id", "rank").collect()]
    ok = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in sorted(dict((i, v) for i, v in ok if i % 10 == 0).items()):
        best = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in ok if j != q))[:5]
        want += [(q, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == want
    few = topk.top_k(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0, k=5)
    assert few.count() == 2 and topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_automaton():
    rng = random.Random(1)
    for _ in range(1500):
        items = [(str(i), [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 8))]) for i in range(4)]
        text = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randint(0, 25))]
        hit, found = set(), set()
        for name, w in items:
            m = min(4, len(w))
            for j in range(len(w) - m + 1) if w else ():
                for k in range(len(text) - m + 1):
                    if text[k : k + m] == w[j : j + m]:
                        hit |= set(range(k, k + m))
                        found.add(name)
        spans, names = decontamination.SuffixAutomaton(items, 4).scan(text)
        assert {x for a, b in spans for x in range(a, b)} == hit and names == found


def test_decontamination(docs, none, spark, monkeypatch):
    texts = [r.text for r in docs.limit(6).collect()]
    bench = spark.createDataFrame([(7, " ".join(texts[0].split()[3:20]), 1), (7, "one", 1), (9, None, 1), (10, "!!", 1), (None, "ONE", 1)], "item_id long, text string, begins int")
    one = decontamination.scan(docs, bench, carry=["doc_id", "text"][:1]).collect()
    monkeypatch.setattr(decontamination, "WORDS_PER_PASS", 5)
    more = decontamination.scan(docs, bench, carry=["doc_id"]).collect()
    assert sorted(map(str, one)) == sorted(map(str, more)) and len(one) == docs.count()
    by = {r.doc_id: r for r in one}
    assert by[64].items == ["", "7"] and by[64].begins == [0] and by[60].n_words == 0 and by[60].begins == []
    assert by[0].items or by[0].text != texts[0]
    assert decontamination.scan(none, bench, carry=["doc_id"]).count() == 0
    assert all(not r.begins for r in decontamination.scan(docs, bench.limit(0), carry=["doc_id"]).collect())
    assert decontamination.cut_text("Ab, cd! ef-gh ij.".encode(), [1, 3], [2, 4]) == b"Ab, ! ef- ij."


def test_sharding(docs, none, spark):
    for shards in (1, 3, 8):
        rows = sharding.deal(docs.withColumn("shard", F.lit("clash")), F.col("doc_id"), shards=shards, ties=[F.col("text")]).collect()
        sizes = Counter(r.shard for r in rows)
        assert len(rows) == docs.count() and max(sizes.values()) - min(sizes.values()) <= 1
        for s, n in sizes.items():
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    again = sharding.deal(docs.repartition(7), F.col("doc_id"), shards=8, ties=[F.col("text")]).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert sharding.deal(none, F.col("doc_id")).count() == 0
    # The deal recomputed: partitions and strides, the matrix, and the order within shards.
    for parts in (2, 7):
        dealt = sharding.deal(docs, F.col("doc_id"), shards=3, ties=[F.col("text")], partitions=parts).collect()
        by = defaultdict(list)
        for at, r in zip(docs.select(F.xxhash64(F.lit("deal/1"), "doc_id", "text")).collect(), docs.collect(), strict=True):
            by[at[0] % parts].append((at[0], r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
        matrix = sharding.communication_matrix([len(by[p]) for p in range(parts)], 3, "deal")
        sent = defaultdict(Counter)
        for p in range(parts):
            n = len(by[p])
            for local, (_, has, i, _, t) in enumerate(sorted(by[p])):
                x = local * sharding._stride(n) % n
                sent[next(s for s in range(3) if x < sum(matrix[p][: s + 1]))][(i if has else None, t)] += 1
        for s in range(3):
            assert Counter((r.doc_id, r.text or "") for r in dealt if r.shard == s) == sent[s]
    place = Counter()
    for seed in range(300):
        m = sharding.communication_matrix([5, 3, 2], 2, str(seed))
        assert [sum(r) for r in m] == [5, 3, 2] and [sum(c) for c in zip(*m, strict=True)] == [5, 5]
        place[m[2][0]] += 1
    # Hypergeometric: of 2 rows among 10, both in one half of 5 with 2/9, one with 5/9.
    assert abs(place[1] / 300 - 5 / 9) < 0.1 and abs(place[0] / 300 - 2 / 9) < 0.08
    plan = sharding.deal(docs, F.col("doc_id"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_line_dedup(docs, none):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    order = sorted({(i is not None, i or 0, t): None for i, t in rows if t is not None}, key=lambda x: x[:2])
    seen, kept = {}, {}

    def windows(t):
        full = [(k, x, len(re.findall(r"[^\x20\x09-\x0D]+", x))) for k, x in enumerate(t.split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]
        for n in (1, 2, 3):
            for s in range(len(full) - n + 1):
                if n == 3 or sum(w for *_, w in full[s : s + n]) > 50:
                    yield s, tuple(x for _, x, _ in full[s : s + n]), {k for k, *_ in full[s : s + n]}

    for place, (has, i, t) in enumerate(order):
        for s, body, _ in windows(t):
            seen[body] = min(seen.get(body, (place, s)), (place, s))
    for place, (has, i, t) in enumerate(order):
        gone = set().union(*(at for s, body, at in windows(t) if seen[body] < (place, s)))
        kept[(i if has else None, t)] = ("\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone), len(gone))
    want = Counter((i, *(kept[(i, t)] if t is not None else (None, 0))) for i, t in rows)
    got = line_dedup.without_repeats(docs.withColumn("start", F.lit(1)).withColumn("n_lines", F.lit(2)))
    assert Counter((r.doc_id, r.text, r.n_removed) for r in got.collect()) == want
    assert any(n for _, n in kept.values()) and line_dedup.without_repeats(none).count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_line_dedup_of_long_texts(spark):
    """Time and rows grow with the lines: two equal texts of 200,000 lines each, and a long line that occurs twice."""
    lines = [f"line {i * 7919 % 100_003} of many" for i in range(200_000)]
    long = " ".join(f"w{i}" for i in range(51))
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(["own", *lines[:150_000], "", "more"])), (3, f"a\n{long}\nb"), (4, f"c\n{long}\nd"), (5, long)], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.without_repeats(docs).collect()}
    assert got[2] == ("own\n\nmore", 150_000) and got[4] == ("c\nd", 1) and got[5] == ("", 1) and got[3][1] == 0


def test_hot_keys_are_split(spark):
    """A line that all documents share, split over tasks at any threshold, with the same result."""
    docs = spark.createDataFrame([(i, f"a\nb\nc\nown {i}") for i in range(400)], "doc_id long, text string")
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    classes = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    got = split_join(rows, classes, ["k"], ["id"], hot=10)
    assert sorted(tuple(r) for r in got.collect()) == sorted((i % 3, i, i % 3) for i in range(1000))
    assert {r.n_removed for r in line_dedup.without_repeats(docs).collect()} == {0, 3}


@pytest.mark.parametrize("block", [4, 64, 1 << 16])
def test_induced_sort(monkeypatch, block):
    """The order, the common prefixes and the repeats, from memory for two entries (recursion, disk) to plenty."""
    monkeypatch.setattr(induced_sort, "BLOCK", block)
    rng = random.Random(block)
    for it in range(150):
        depth, memory = rng.choice([7, 8, 9, 13]), rng.choice([2, 5, 30, 1000])
        parts = [bytes(rng.choice(b"ab" if it % 2 else b"abc\xff") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 6))]
        parts += [parts[0][3:], b"a" * rng.randint(0, 30)]
        text = np.array([x for p in parts for x in [*(c + 1 for c in p), 0]], np.uint16)
        want, suffix, at = defaultdict(set), {}, 0
        for p in parts:
            for i in range(len(p)):
                suffix[at + i] = p[i : i + depth]
                if i + depth <= len(p):
                    want[p[i : i + depth]].add(at + i)
            at += len(p) + 1
        order = [(int(p), int(k)) for places, shared in induced_sort.sorted_suffixes(text, depth, memory) for p, k in zip(places, shared, strict=True)]
        assert sorted(p for p, _ in order) == sorted(suffix)
        for (p, _), (q, k) in zip(order, order[1:], strict=False):
            assert suffix[p] >= suffix[q] and k == len(os.path.commonprefix([suffix[p], suffix[q]]))
        got = [frozenset(g.tolist()) for places, begins in induced_sort.repeats(text, depth, memory) for g in np.split(places, begins[1:])]
        assert sorted(map(sorted, got)) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_induced_sort_of_more_than_its_memory():
    """A text of hundreds of times the memory bound gives what one within it gives, and the process doesn't grow with it."""
    rng = np.random.default_rng(1)
    text = rng.integers(97, 123, 60_000).astype(np.uint16)
    text[40_000:41_000] = text[1000:2000]
    text[-1] = 0
    groups = lambda memory: sorted(sorted(g.tolist()) for places, begins in induced_sort.repeats(text, 50, memory) for g in np.split(places, begins[1:]))
    assert groups(200) == groups(1 << 20) == [[i, i + 39_000] for i in range(1000, 1951)]


def test_suffix_dedup(docs, none):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    seen, want = {}, Counter()
    for i, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - 49) if i is not None else ():
            s = raw[k : k + 50]
            seen[s] = min(seen.get(s, i), i)
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 49) if i is not None else ():
            if seen[raw[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        runs = sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1]))
        want[(i, len(raw), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(raw, gone, strict=True) if not g)).hexdigest())] += 1
    got = suffix_dedup.without_repeats(docs.withColumn("doc", F.lit(1)))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == want
    assert sum(k[2] for k in want) > 1000 and suffix_dedup.without_repeats(none).count() == 0


def test_suffix_dedup_of_many_texts_under_one_id(spark):
    passage, plain = "This passage of more than fifty bytes begins in the first document. ", "Nothing in here is found anywhere else in the corpus at all, {} times."
    tag = lambda t: zlib.crc32(t.encode()) & 0xFFF
    hit = passage + "an ending"
    clean = next(t for t in (plain.format(i) for i in range(100_000)) if tag(t) == tag(hit))
    docs = spark.createDataFrame([(1, passage), (5, hit), (5, clean)], "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix_dedup.without_repeats(docs).collect()}
    assert got == {(1, len(passage)): 0, (5, len(hit)): len(passage), (5, len(clean)): 0}


def test_url_filter(spark):
    urls = ["http://a.com/en/x", "https://example.com/en/70", "http://www.example.com/en/8", "http://notcom/en/", "x", None, "http://A.NET/de/?q", "http://b.example.net/de/8z#f", "HTTP://q.org/es/", "http://m.ads-track.example.com/q", "http://org", "a://b://c.com/en/"]
    rules = [url_filter.host_rule(*r) for r in (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))]
    rules.append(url_filter.Rule(None, r"\A(?:[^/]*\.)?ads-track\.", ("ads", "track"), "block", 0))
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = [(r.rule, r.verdict) for r in url_filter.judge(df, rules, id_col="page_id", url_col="url").orderBy("page_id").collect()]
    assert got == [("com/en/", "block"), ("example.com/en/7", "allow"), ("com/en/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"), (None, "block"), (None, "allow"), (None, "allow")]
    assert url_filter.judge(df.limit(0), rules, id_col="page_id", url_col="url").count() == 0
    assert url_filter.judge(df, [], id_col="page_id", url_col="url").where("verdict <> 'allow'").count() == 0


def test_url_filter_of_many_rules(spark):
    """4,000 pattern rules from a table against running all of them; a URL runs few of them."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 5)))
    rows = []
    for i in range(4000):
        a, b = word(), word()
        rows.append((f"r{i}" if i % 2 else None, rf"(?:^|[./-]){a}[./-].*{b}(?:[./?-]|$)", [a, b], rng.choice(["allow", "block"]), i % 7))
    rows += [rows[5], ("n", None, None, "block", 1), ("all", "zz+top", None, "block", 9)]
    table = spark.createDataFrame(rows, "name string, pattern string, tokens array<string>, verdict string, rank int")
    rules = list(url_filter.rules_of(table))
    assert len(rules) == 4001
    parts = [r[2] for r in rng.sample(rows[:4000], 40)]
    urls = [f"http://{a}.example/{word()}/{b}" for a, b in parts] + [f"http://{word()}.com/{word()}" for _ in range(20)] + ["http://zzztop.com/", "http://zzztop.com/", None, "x" * 100_000 + "://zztop"]
    got = [(r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules, id_col="page_id", url_col="url").orderBy("page_id").collect()]
    want, compiled = [], [(r, re.compile(r.pattern)) for r in rules]
    for u in urls:
        s = u.split("://", 1)[1] if u else ""
        hit = next((r for r, p in compiled if s and p.search(s)), None)  # rules come by falling rank
        want.append((hit.name, hit.verdict) if hit else (None, "allow"))
    assert got == want and sum(r is not None for r, _ in want) > 15
    counts = dict.fromkeys({t for r in rules for t in r.tokens}, 1)
    index, always = url_filter.index_rules(rules, counts)
    assert len(always) == 1 and max(map(len, index.values())) < 60


def test_toxicity(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
    bad = ["zzword", "yyword", "xxword"]
    rows = []
    for i in range(400):
        t = [rng.choice(words) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            t[rng.randrange(30)] = rng.choice(bad)
        if toxic and i % 8 == 0:
            t += bad
        rows.append((i, " ".join(t), int(toxic)))
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5] + [(None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.learn(df, labels)
    got = {r.doc_id: r for r in toxicity.score(df.withColumn("severity", F.lit(3)), model, carry=["doc_id"]).collect()}
    assert all(got[i].toxic == bool(y) for i, _, y in rows) and not got[900].toxic and not got[901].toxic
    assert np.mean([got[i].severity for i in range(0, 400, 8)]) > np.mean([got[i].severity for i in range(4, 400, 8)])
    assert all(np.diff(model.thresholds) >= 0)
    empty = toxicity.learn(df, labels.limit(0))
    assert all(r.severity == 0 for r in toxicity.score(df, empty, carry=["doc_id"]).collect())


def test_toxicity_scores_by_hand(spark):
    """Severity and grade of every row from the weights and thresholds, computed apart; repeated ids learn from one text."""
    rows = [(i, ("bad word " if i % 3 == 0 else "good ") + f"filler{i % 7} other") for i in range(90)] + [(0, "another text"), (0, "another text"), (95, "\u00c9t\u00e9 BAD!" * 2000), (96, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(df, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] * 2, "doc_id long, toxic int"))
    got = toxicity.score(df, model, carry=["doc_id", "text"]).collect()
    for r in got:
        found = set(re.findall(r"[0-9a-z\x80-\U0010ffff]+", (r.text or "").lower()))
        raw = {w.encode() for w in found}
        s = sum(model.weights.get(w + b" ", 0) for w in raw) + sum(model.weights.get(p, 0) for p in {w[:n] for w in raw for n in (5, 6, 7, 8) if len(w) >= n})
        below = [1 / (1 + np.exp(-(t - s))) for t in model.thresholds] + [1.0]
        assert abs(r.severity - sum(1 - x for x in below)) < 1e-9 and r.toxic == (r.severity >= toxicity.REJECT)
        assert r.grade == int(np.argmax(np.diff([0.0, *below])))
    assert len(got) == len(rows) and sum(r.toxic for r in got) >= 30


def test_ordinal_grades():
    """Four given grades come out in order."""
    rng = random.Random(6)
    bags, y = [], []
    for i in range(800):
        g = i % 4
        bags.append(b" ".join(sorted({b"w%04d" % rng.randrange(50) for _ in range(10)} | {b"grade%d" % k for k in range(g)})))
        y.append(g)
    m = toxicity.Ordinal.fit(bags, y)
    mean = [np.mean([m.judge(set(b.split()))[0] for b, t in zip(bags, y, strict=True) if t == g]) for g in range(4)]
    assert min(np.diff(mean)) > 0.3 and len(m.thresholds) == 3 and all(np.diff(m.thresholds) >= 0)


def test_no_temporary_files_left(tmp_path, monkeypatch):
    monkeypatch.setenv("TMPDIR", str(tmp_path))
    block = lambda n: (np.arange(n), np.arange(n).astype(np.uint64), np.ones(n, np.uint8), np.ones(n, np.uint8))
    q = induced_sort.DiskQueue([3])
    for n in (2, 9, 1):
        q.push(block(n))
    assert q.spilled == 9 and q.pop_last()[0].tolist() == [0]
    assert q.pop_first()[0].tolist() == [*range(2), *range(9)] and not q and not os.listdir(tmp_path)
    heap, rng = induced_sort.DiskHeap(3), random.Random(2)
    items = [(rng.randrange(9), i, i) for i in range(50)]
    for x in items:
        heap.push(x)
    assert heap.runs > 5 and [heap.pop() for _ in items] == sorted(items) and heap.least() is None and not os.listdir(tmp_path)
