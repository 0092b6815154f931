"""Each pipeline stage on a small corpus with a clashing column."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from tessera.llm.simhash import fingerprint


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [say(20) for _ in range(3)]
    rows = []
    for i in range(300):
        t = say(60)
        if i % 10 == 1:
            t = rows[-1][1]
        if i % 10 == 2:
            t += " zzvile zzvile"
        if i % 10 == 3:
            t = say(30) + " " + items[i % 3] + " " + say(30)
        if i % 10 == 4:
            t = say(400) + " " + items[i % 3] + " " + say(300)
        rows.append((i, t, "en", f"s{i % 4}", len(t), "clash"))
    rows += [(300, None, None, None, None, None), (301, "", "en", "s0", 0, "x"), (301, "", "en", "s0", 0, "x")]
    out = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, toxic string")
    docs.write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 10 == 2)) for i in range(250)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, items


def test_stages(spark, folder):
    out, items = folder
    docs = spark.read.parquet(f"{out}/documents.parquet")
    columns = docs.columns
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, out)
        docs.write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
        at[name] = (before.collect(), docs.collect())
        assert docs.columns[: len(columns)] == columns
    before, after = at["toxicity"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {i for i in range(300) if i % 10 == 2}
    before, after = at["simhash"]
    fps = [(r.doc_id, fingerprint(r.text.encode() if r.text else None)) for r in before]
    least = {i: min(j for j, g in fps if bin(f ^ g).count("1") <= 3) for i, f in fps}
    assert sorted(r.doc_id for r in after) == sorted({i for i, j in least.items() if i == j})
    before, after = at["decontamination"]
    texts = {r.doc_id: r.text for r in after}
    assert not any(x in (t or "") for t in texts.values() for x in items)
    gone = {r.doc_id for r in before} - set(texts)
    assert gone == {r.doc_id for r in before if r.doc_id % 10 == 3 and r.doc_id < 300}
    assert all(len(texts[i].split()) == 700 for i in texts if i % 10 == 4 and i < 300)
    assert all(r.text == texts[r.doc_id] for r in before if r.doc_id in texts and r.doc_id % 10 != 4)
    before, after = at["mixing"]
    had = {r.doc_id: r for r in before}
    assert max(Counter(r.doc_id for r in after).values()) <= 2
    words = sum(len((r.text or "").split()) for r in before)
    assert abs(sum(len(r.text.split()) for r in after) - 1.5 * words) < 0.02 * words
    assert all(r.text == had[r.doc_id].text or had[r.doc_id].text.split()[: len(r.text.split())] == r.text.split() for r in after)
    before, after = at["sharding"]
    sizes = Counter(r["shard"] for r in after)
    assert len(after) == len(before) and max(sizes.values()) - min(sizes.values()) <= 1


def test_empty(spark, folder):
    out, _ = folder
    docs = spark.read.parquet(f"{out}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, out)
    assert docs.count() == 0


def test_near_copies_by_five_words(spark, folder):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows, expected = [], set()
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(120)]
        rows.append((3 * i, " ".join(words)))
        near, far = list(words), list(words)
        near[i], near[119 - i // 2] = "new", "new"  # 9 of 116 shingles at most on either side: 0.8 and more
        for k in range(10, 100, 10):
            far[k] = "other"
        rows += [(3 * i + 1, " ".join(near)), (3 * i + 2, " ".join(far))]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    for i in range(60):
        assert alike(3 * i, 3 * i + 1) and not alike(3 * i, 3 * i + 2) and not alike(3 * i + 1, 3 * i + 2)
        expected |= {3 * i, 3 * i + 2}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, folder[0]).collect()) == sorted(expected)


def test_near_copies_in_tiles(spark):
    from tessera.llm import near_copies

    rng = random.Random(6)
    base = [f"w{rng.randrange(5000)}" for _ in range(100)]
    rows = []
    for i in range(120):  # a chain: each text replaces two words of the previous one, so the ends share little
        base = list(base)
        base[(2 * i) % 100] = base[(2 * i + 1) % 100] = f"n{i}"
        rows.append((i, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in near_copies.firsts(docs, tile=16).collect()] == [0]
    assert [r.doc_id for r in near_copies.firsts(docs).collect()] == [0]


def test_rows_with_null_and_repeated_ids_stay(spark, folder):
    rng = random.Random(8)
    say = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(40))
    rows = [(None, say()) for _ in range(20)] + [(7, say()) for _ in range(10)] + [(i, say()) for i in range(10, 20)]
    wanted = Counter(rows)
    rows += rows[:3] + rows[20:23]  # repeated rows
    rows += [(30, rows[1][1]), (7, rows[-1][1]), (5, rows[25][1])]  # a copy of a null id's text, a repeated row, a copy with a smaller id
    wanted += Counter({(30, rows[1][1]): 1, (5, rows[25][1]): 1})
    wanted -= Counter({rows[1]: 1, rows[25]: 1})
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, corpus_pipeline.drop_near_duplicates(spark, docs, folder[0]).collect())) == wanted


@pytest.mark.parametrize("seed", [5830, 8017, 13757, 64777])
def test_near_copies_meet_by_fingerprints(spark, folder, seed):
    """45 shingles each, 40 in common; the least values of their hashes share no band of six out of 32."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(5000)}" for _ in range(49)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:22], "new", *words[23:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, folder[0]).collect()] == [1]


def test_anchors_cover_blocks():
    import numpy as np

    from tessera.llm import near_copies
    from tessera.llm.simhash import majority

    rng = np.random.default_rng(3)
    code = near_copies.nearest(np.arange(1 << 23))
    assert np.bitwise_count(code ^ np.arange(1 << 23)).max() == 3 and (near_copies.nearest(code) == code).all()
    assert len(np.unique(code)) == len(np.unique(code >> 11)) == 4096
    for n, shared in ((9, 8), (45, 40), (270, 240)):
        left, right = [], []
        for _ in range(300):
            h = rng.integers(0, 1 << 64, 2 * n - shared, np.uint64)
            left.append(near_copies.fingerprint(h[:n]))
            right.append(near_copies.fingerprint(h[-n:]))
            assert int.from_bytes(left[-1][:8], "little") == majority(h[:n])
        left, right = (np.frombuffer(b"".join(x), np.uint8).reshape(300, -1) for x in (left, right))
        for free in (0, 2):
            assert (near_copies.anchors(left, free) == near_copies.anchors(right, free)).any(axis=1).all()
    assert [near_copies.free_bits(n) for n in (0, 1, 1 << 23, (1 << 23) + 1, 1 << 26)] == [0, 0, 0, 1, 3]


@pytest.mark.parametrize("tile", [20, 150, 4096])
def test_wide_fingerprints_at_anchors(spark, tile):
    from tessera.llm import components, simhash

    rng = random.Random(9)
    rows = []
    for g, n in enumerate([2, 5, 40, 120, 300]):  # groups below and above 64 rows
        base = [rng.getrandbits(64) for _ in range(3)]
        for _ in range(n):
            if rng.random() < 0.2:
                base = [rng.getrandbits(64) for _ in range(3)]
            words = list(base)
            for _ in range(rng.randint(0, 7)):
                words[rng.randrange(3)] ^= 1 << rng.randrange(64)
            rows.append((g, *(w - (1 << 64) if w >> 63 else w for w in words)))
    at = {}
    for r in rows:
        at.setdefault(r[0], []).append(r[1:])
    root = {r[1]: r[1] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for group in at.values():
        for a in group:
            for b in group:
                if sum(((x ^ y) & ((1 << 64) - 1)).bit_count() for x, y in zip(a, b, strict=True)) <= 10 and (u := find(a[0])) != (v := find(b[0])):
                    root[max(u, v)] = min(u, v)
    for total in (None, len(rows)):
        edges = simhash.met(spark.createDataFrame(rows, "anchor long, fp long, fp1 long, fp2 long"), 10, tile, total)
        got = {r.node: r.root for r in components.components(edges).collect()}
        assert got == {x: find(x) for x in root if find(x) != x}
