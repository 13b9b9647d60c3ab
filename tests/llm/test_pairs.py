"""Jaccard join, decontamination and shards against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from marginalia.llm import op01_jaccard as jaccard
from marginalia.llm import op02_decontaminate as decontaminate
from marginalia.llm import op03_materialise as shards

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_classes(docs, width, num, den):
    sets = {}
    for i, text in docs:
        words = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        s = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} or ({tuple(words)} if words else set())
        sets[i] = s
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def families(rng, count):
    """Base texts with copies of growing distance, a shared passage, and short ones."""
    vocabulary = ["w%d" % i for i in range(3000)]
    passage = rng.choices(vocabulary, k=50)
    out = []
    for _ in range(count):
        base = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 8, 12, 20, 40, 90, 200]))
        if rng.random() < 0.5:
            base = passage + base
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 8])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            text = " ".join(copy)
            out.append(text.upper() if rng.random() < 0.1 else text)
    return out


@pytest.mark.parametrize("width,num,den", [(4, 85, 100), (5, 80, 100), (3, 50, 100)])
def test_classes_equal_brute_force(spark, width, num, den):
    texts = families(random.Random(width), 60) + [None, "", "  ", "One", "one", "one two", "ONE  two"]
    docs = [(3 * i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, i, "x") for i, t in docs], "doc_id long, text string, component_id long, n string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(df, width, num, den).collect()}
    assert got == plain_classes(docs, width, num, den)


def test_join_of_nothing_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f")], "doc_id long, text string")
    assert {tuple(r) for r in jaccard.join(df, 4, 85, 100).collect()} == {(1, 3, 1), (2, 3, 1), (None, 3, None)}
    assert jaccard.join(df.where("false"), 4, 85, 100).count() == 0
    assert sorted(str(r["doc_id"]) for r in jaccard.one_of_each(df, 4, 85, 100).collect()) == ["1", "1", "None"]


def test_rtrees_join_to_all_pairs():
    rng = np.random.default_rng(1)
    points = rng.poisson(2, (300, 64)).astype(np.uint32)
    points[100:130] = points[0]
    sizes, klass = points.sum(1).astype(np.int64), rng.integers(0, 4, 300)
    klass[100:120] = 2

    def links(x, y):
        least, both = np.minimum(points[x], points[y]).sum(), sizes[x] + sizes[y]
        return klass[x] != klass[y] and 185 * least >= 85 * both and sizes[x] * 85 <= sizes[y] * 100 and sizes[y] * 85 <= sizes[x] * 100

    tree = lambda r: jaccard.RTree(points[r.start : r.stop], sizes[r.start : r.stop], klass[r.start : r.stop])
    every = range(300)
    i, j = tree(every).join(tree(every), 85, 100)
    assert len(i) and sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(x, y) for x in every for y in every if links(x, y)]
    one = tree(every)
    i, j = one.join(one, 85, 100)
    assert sorted((min(p), max(p)) for p in zip(i.tolist(), j.tolist(), strict=True)) == [(x, y) for x in every for y in every if x < y and links(x, y)]
    for low, high in ((range(1), every), (every, range(100, 101)), (range(20), range(17, 300))):  # trees of unlike heights
        i, j = tree(low).join(tree(high), 85, 100)
        assert sorted(zip((i + low.start).tolist(), (j + high.start).tolist(), strict=True)) == [(x, y) for x in low for y in high if links(x, y)]


def test_boxes_bound_their_leaves():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 62, rng.integers(1, 900)).astype(np.uint64)) for _ in range(40)]
    sets[7] = np.unique(np.concatenate([np.arange(3000, dtype=np.uint64), sets[7]]))  # more in a group than a byte counts
    points = [jaccard.point(x) for x in sets]
    leaf = jaccard.Leaf(np.arange(40), np.array([len(x) for x in sets]), np.arange(40) % 3, points)
    again = jaccard.Leaf.unpack(leaf.pack())
    assert again.points == points and again.klass.tolist() == leaf.klass.tolist() and again.n.tolist() == leaf.n.tolist()
    halves = [jaccard.Leaf(leaf.ids[k::2], leaf.n[k::2], leaf.klass[k::2], points[k::2]) for k in (0, 1)]
    box = np.frombuffer(jaccard._over([h.box() for h in halves]), np.uint32)
    for x, p in zip(sets, points, strict=True):
        assert jaccard.folded(p, len(x), 64).sum() == len(x)
        assert (jaccard.folded(p, len(x), len(box) - 1) <= box).all()
        for y, q in zip(sets, points, strict=True):
            groups = min(len(p), len(q))
            least = np.minimum(jaccard.folded(p, len(x), groups), jaccard.folded(q, len(y), groups)).sum()
            assert least >= len(np.intersect1d(x, y))


def test_leaves_of_blocks_join_to_all_links(spark, monkeypatch):
    """Blocks of many leaves, of one leaf and of one class: the search gives exactly the links between classes of a block."""
    monkeypatch.setattr(jaccard, "LEAF", 12)
    rng = random.Random(5)
    base, texts = [[rng.choice("abcdefghijklmnop") + str(rng.randrange(60)) for _ in range(40)] for _ in range(3)], []
    for i in range(180):
        words = list(base[min(i // 80, 2)])
        for _ in range(rng.randrange(3)):
            words[rng.randrange(40)] = "x%d" % rng.randrange(500)
        texts.append(" ".join(words))
    docs, keys = jaccard.shingles([t.encode() for t in texts], 3)
    sets = [keys[docs == i] for i in range(180)]
    block = [min(i // 80, 2) if i < 170 else 3 for i in range(180)]
    klass = [i % 4 if i < 80 else 7 if i < 160 else i % 2 for i in range(180)]
    rows = [(block[i], klass[i], i, len(sets[i]), bytearray(jaccard.point(sets[i])), len(sets[i]).bit_length()) for i in range(180)]
    found = jaccard._across(
        spark.createDataFrame(rows, "block long, klass long, id long, n long, data binary, size long"),
        spark.createDataFrame([], "a long, b long"),
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"),
        3, 80, 100, 4, jaccard.Scratch(spark, "leaves"),
    )
    got = sorted((r["a"], r["b"]) for r in found.collect())
    like = lambda x, y: 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))
    want = [(i, j) for i in range(180) for j in range(i + 1, 180) if block[i] == block[j] and klass[i] != klass[j] and like(sets[i], sets[j])]
    assert got == want and len({block[i] for i, _ in want}) == 3


def test_chained_block_of_many_documents(spark, monkeypatch):
    """More than 2,000 documents, each like the one before it and the first unlike the last, in one block over many leaves."""
    monkeypatch.setattr(jaccard, "LEAF", 40)
    rng = random.Random(12)
    words = ["w%d" % i for i in range(900)]
    texts, now = [], rng.choices(words, k=60)
    for _ in range(2100):
        now = list(now)
        if rng.random() < 0.8:
            now[rng.randrange(60)] = rng.choice(words)
        texts.append(" ".join(now))
    order = list(range(2100))
    rng.shuffle(order)
    docs = [(i, texts[k]) for i, k in enumerate(order)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), 3, 90, 100).collect()}
    assert got == plain_classes(docs, 3, 90, 100)


def test_hot_keys_are_dealt(spark, monkeypatch):
    from marginalia.llm import graph

    monkeypatch.setattr(graph, "HOT_ROWS", 10)
    big = spark.createDataFrame([(1, i) for i in range(500)] + [(k, k) for k in range(2, 60)], "k long, v long")
    small = spark.createDataFrame([(k, -k) for k in range(50)], "k long, w long")
    hot = graph.hot_keys(big, ["k"])
    assert [r["k"] for r in hot.collect()] == [1]
    assert graph.dealt(big, ["k"], hot).where("k = 1").select("_salt").distinct().count() > 20
    for how in ("inner", "left"):
        assert sorted(map(str, graph.hot_join(big, small, ["k"], how).select("k", "v", "w").collect())) == sorted(map(str, big.join(small, ["k"], how).select("k", "v", "w").collect()))


def test_unlike_documents_share_no_empty_groups():
    """Sets at the low end of a band left more groups empty than their bands spare, offered them, and so met in signatures with all others that did."""
    rng, bands = np.random.default_rng(4), jaccard.Bands(80, 100)
    n = np.full(300, 316)
    docs, keys = np.repeat(np.arange(300), 316), rng.integers(0, 1 << 63, 300 * 316).astype(np.uint64)
    _, sig = jaccard.signatures(docs, keys, n, bands)
    assert len(np.unique(sig)) == len(sig)


def test_common_line_makes_no_large_block(spark, monkeypatch):
    """Unlike documents that meet by several common lines stay in small blocks: what stars connect was one block of nearly all of them."""
    found = []
    across = jaccard._across
    monkeypatch.setattr(jaccard, "_across", lambda rows, *rest: found.extend(r["c"] for r in rows.groupBy("block").agg({"id": "count"}).toDF("block", "c").collect()) or across(rows, *rest))
    rng = random.Random(8)
    words = ["w%d" % i for i in range(5000)]
    lines = [" ".join(rng.choices(words, k=30)) for _ in range(40)]
    docs = [(i, " ".join([*rng.sample(lines, 2), *rng.choices(words, k=6)])) for i in range(600)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(spark.createDataFrame(docs, "doc_id long, text string"), 4, 85, 100).collect()}
    assert got == plain_classes(docs, 4, 85, 100) and found and max(found) < 300


def test_points_and_records_as_the_network_holds_them():
    """Points went as a byte for each group, records as pairs of eight bytes: neither compressed."""
    rng = np.random.default_rng(9)
    for n in (0, 1, 60, 700, 5000):
        p = jaccard.point(rng.integers(0, 1 << 62, n).astype(np.uint64))
        assert jaccard.counts(jaccard.planes(p)) == p and len(jaccard.planes(p)) < max(len(p) / 2, 64)
    for counted in (127, 128, 255):
        p = bytes([counted]) + bytes(63)
        assert jaccard.counts(jaccard.planes(p)) == p
    sig, ids = rng.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2), np.append(np.arange(-3, 496), 1 << 62)
    raw = jaccard._packed(sig, ids)
    again = jaccard._unpacked(raw)
    assert again["s"].tolist() == sig.tolist() and again["d"].tolist() == ids.tolist() and len(jaccard._unpacked(b"")) == 0
    assert len(zlib.compress(raw[4000:], 1)) < len(zlib.compress(np.ascontiguousarray(ids).tobytes(), 1)) and len(raw) == 8000


def test_few_pairs_are_sent_to_their_data(spark, monkeypatch):
    """All data were shuffled to few pairs, since the size of a dealt join was overrated; either way each pair is tested once."""
    data = spark.createDataFrame([(i, i, bytes([i])) for i in range(100)], "id long, n long, data binary")
    pairs = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(1, 99)]
    test = lambda a, x, b, y: [(a, b)] if x == a and y == b else []
    df = spark.createDataFrame(pairs, "a long, b long")
    for most in (1, 1000):
        monkeypatch.setattr(jaccard, "BROADCAST_IDS", most)
        got = jaccard._tested(df, data, lambda n, raw: raw[0], test, 3)
        assert sorted(map(tuple, got.collect())) == sorted(pairs)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan


def full_collections(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_join_and_shards_hand_heap_back(spark, tmp_path):
    """After their shuffles the executors' heap goes back to the system, since what runs next in Python needs the memory."""
    tokenizers = pytest.importorskip("public_tokenizers")
    tokens = tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "b c d e f g")], "doc_id long, text string")
    for step in (lambda: jaccard.join(df), lambda: shards.write(df, *tokens, f"file://{tmp_path}/out", 3)):
        before = full_collections(spark)
        step()
        assert full_collections(spark) > before


def test_bands_never_lose_a_pair():
    bands = jaccard.Bands(85, 100)
    for a in range(1, 400):
        for b in range(a, a * 100 // 85 + 1):
            roles = [{int(x) for m, band in bands.roles(np.array([n])) for x in band} for n in (a, b)]
            both = roles[0] & roles[1]
            inter = -(-85 * (a + b) // 185)
            if inter <= a:
                own = int(np.searchsorted(bands.low, a, "right")) - 1
                assert own in both
                assert a + b - 2 * inter <= bands.differ[own]


def align_plain(item, row):
    best = 0
    above = [0] * (len(row) + 1)
    for w in item:
        now = [0]
        for j, x in enumerate(row):
            now.append(max(0, above[j] + (1 if x == w else -1), above[j + 1] - 1, now[j] - 1))
        best = max(best, *now)
        above = now
    return best


def test_alignment_equals_plain():
    rng = np.random.default_rng(2)
    for _ in range(60):
        item = rng.integers(1, 6, rng.integers(1, 12)).astype(np.uint64)
        row = rng.integers(1, 6, rng.integers(1, 25)).astype(np.uint64)
        score, end = decontaminate.align(item, row[None])
        assert score[0] == align_plain(item.tolist(), row.tolist())
        assert score[0] == align_plain(item.tolist(), row[: end[0]].tolist())


def test_copies_are_found_and_clean_documents_left(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    items = [" ".join(word() for _ in range(rng.randint(12, 50))) for _ in range(20)] + ["one two", "", None]
    docs, dirty = [], set()
    for i in range(300):
        text = [word() for _ in range(rng.randint(5, 200))]
        if i % 5 == 0:
            copy = items[i // 5 % 20].split()
            if i % 10 == 0:  # edited: every eighth word changed, one left out, one put in
                copy = [word() if k % 8 == 7 else w for k, w in enumerate(copy)]
                del copy[3]
                copy.insert(9, word())
            at = rng.randrange(len(text))
            text[at:at] = copy
            dirty.add((i, i // 5 % 20))
        elif i % 7 == 0:  # a phrase of an item only
            text += items[i % 20].split()[:4]
        docs.append((i, " ".join(text).upper() if i % 3 == 0 else ", ".join(text)))
    docs += [(1000, "say one two three"), (1001, None), (1002, "")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, score string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontaminate.find(df, bench)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == dirty | {(1000, 20)}
    left = decontaminate.remove(df, bench)
    assert left.columns == df.columns
    assert {r["doc_id"] for r in left.collect()} == {i for i, _ in docs} - {i for i, _ in dirty} - {1000}
    assert decontaminate.find(df.where("false"), bench).count() == 0
    assert decontaminate.find(df, bench.where("false")).count() == 0


def test_edited_copies_in_many_documents_are_found(spark):
    """Every fifth (every sixth) word of an item replaced, the same in several hundred documents: the grams left are frequent ones."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    items = [[word() for _ in range(40)] for _ in range(2)]
    copies = [[word() if k % n == n - 1 else w for k, w in enumerate(item)] for item, n in zip(items, (5, 6), strict=True)]
    docs, dirty = [], set()
    for i in range(1200):
        text = [word() for _ in range(rng.randint(5, 60))]
        if i % 3:
            text += copies[i % 3 - 1]
            dirty.add((i, i % 3 - 1))
        elif i % 2:  # a phrase of an item, as often
            text += items[0][4:10]
        docs.append((i, " ".join(text)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(item)) for i, item in enumerate(items)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find(df, bench).collect()} == dirty
    assert {r["doc_id"] for r in decontaminate.remove(df, bench).collect()} == {i for i in range(0, 1200, 3)}


def test_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        for key in (1, 2):
            p = shards.Permutation(n, key)
            slots = p.slots(np.arange(n))
            assert sorted(slots.tolist()) == list(range(n))
            assert p.numbers(slots).tolist() == list(range(n))
    assert shards.Permutation(1000, 1).slots(np.arange(1000)).tolist() != shards.Permutation(1000, 2).slots(np.arange(1000)).tolist()


def test_shards_hold_the_ids(spark, tmp_path):
    tokenizers = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rng = random.Random(6)
    texts = [None, "", "a"] + [" ".join(rng.choices(["alpha", "beta", "日本", "x\n"], k=rng.randint(1, 60))) for _ in range(80)]
    texts.append(" ".join(rng.choices(["gamma", "delta"], k=40_000)))  # a long one
    renamed = dict(enumerate([None, -7, -1]))  # a null id and negative ones
    rows = [(renamed.get(i, i), t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot string")
    total, layout = shards.write(df, path, tokenizers.PATTERN, str(tmp_path / "out"), key=9, length=16, shard_slots=32)
    rows = shards.index(spark, str(tmp_path / "out"), layout).collect()
    assert sorted(r["slot"] for r in rows) == list(range(total))
    # slots follow the key: by number, sequences are as they were dealt to the tasks
    order = shards.Permutation(total, 9)
    by_number = sorted((int(order.numbers(np.array([r["slot"]]))[0]), r["doc_id"], r["seq"]) for r in rows)
    assert all(seq == 0 or by_number[k - 1][1:] == (i, seq - 1) for k, (_, i, seq) in enumerate(by_number))
    coder = shards.bpe(path, tokenizers.PATTERN)
    peer = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(coder.tokens)}, special_tokens={})
    want = {}
    for i, t in enumerate(texts):
        ids = [*peer.encode_ordinary(t or ""), layout.end]
        for k in range(0, len(ids), 16):
            want[renamed.get(i, i), k // 16] = hashlib.sha256(",".join(map(str, ids[k : k + 16])).encode()).hexdigest()
    assert {(r["doc_id"], r["seq"]): r["tokens_sha256"] for r in rows} == want
    # a reader finds any slot by arithmetic
    r = rows[len(rows) // 2]
    shard, offset = layout.place(r["slot"])
    file = next((tmp_path / "out" / f"shard={shard}").glob("part-*"))
    record = np.frombuffer(file.read_bytes()[offset : offset + layout.stride], layout.record)[0]
    assert (record["doc_id"], record["seq"], record["n"]) == (r["doc_id"], r["seq"], r["n_tokens"])
    assert shards.write(df.where("false"), path, tokenizers.PATTERN, str(tmp_path / "none"), key=9)[0] == 0


def test_one_of_each_sends_few_ids_to_the_texts(spark, monkeypatch):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choices("abcdefghijklmnop", k=30))) for i in range(20)]
    docs += [(i + 100, t) for i, t in docs[:7]] + [(None, docs[0][1]), (30, None), (31, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(((i, t) for i, t in docs if i is None or i < 100), key=str)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most, shuffled in ((1000, False), (6, True)):
            monkeypatch.setattr(jaccard, "BROADCAST_IDS", most)
            out = jaccard.one_of_each(df)
            assert sorted((tuple(r) for r in out.collect()), key=str) == want
            assert ("SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()) == shuffled
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_packs_of_records_are_small_and_whole(spark, tmp_path, monkeypatch):
    tokenizers = pytest.importorskip("public_tokenizers")
    rng = np.random.default_rng(4)
    for vocabulary, kind in ((50_000, "<u2"), (70_000, "<u4")):
        layout = shards.Layout(vocabulary)
        place, head = rng.permutation(900).astype("<u4"), np.zeros(900, layout.head)
        head["doc_id"], head["seq"], head["n"] = rng.integers(-5, 1 << 40, 900), rng.integers(0, 9, 900), rng.integers(1, 257, 900)
        ids = np.minimum(rng.zipf(1.3, int(head["n"].sum())), vocabulary).astype(kind)
        pack = shards._packed(place, head, ids)
        assert all((x == y).all() for x, y in zip(shards._unpacked(900, pack, layout), (place, head, ids), strict=True))
        assert len(pack) < 0.7 * (head.nbytes + ids.nbytes)
    # the shards are the same however many records a pack and a cell hold
    docs = [(i, " ".join(f"w{i * k % 97}" for k in range(i % 50))) for i in range(300)] + [(None, "x"), (7, None), (8, "long " * 900)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = []
    for name, pack, cell, records in (("a", 1 << 15, 32 << 20, 1 << 12), ("b", 5, 400, 3)):
        for what, most in (("PACK", pack), ("CELL_BYTES", cell), ("RECORDS", records)):
            monkeypatch.setattr(shards, what, most)
        total, layout = shards.write(df, tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN, str(tmp_path / name), key=5, length=16, shard_slots=64)
        found.append({f.parent.name: f.read_bytes() for f in (tmp_path / name).glob("shard=*/part-*")})
        assert sum(map(len, found[-1].values())) == total * layout.stride
    assert found[0] == found[1] and len(found[0]) > 4


def test_short_pretokens_go_side_by_side(monkeypatch):
    """They have the ids that the queue gives, which only the long ones enter."""
    tokenizers = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    queued = []
    queue = shards.Bpe.encode_all
    monkeypatch.setattr(shards.Bpe, "encode_all", lambda self, some: queued.extend(some) or queue(self, some))
    coder = shards.bpe(tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)
    coder.forget()
    rng = random.Random(8)
    texts = ["".join(rng.choices(["the", "zq", "日本", "é", "aaa", "!?", "7", " ", "\n"], k=rng.randint(0, 30))) for _ in range(500)]
    texts += ["a" * n for n in range(1, 70)] + ["x" + "é" * n for n in (15, 16)]
    peer = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(coder.tokens)}, special_tokens={})
    ids, n = coder.encode_texts([t.encode() for t in texts])
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [peer.encode_ordinary(t) for t in texts]
    assert queued and min(map(len, queued)) > shards.SHORT
    # ranks in no order, pairs of one id, a merge whose new pair ranks lower, no pair at all, nothing
    tokens = [bytes([b]) for b in range(256)] + list({"".join(rng.choices("abc", k=rng.randint(2, 6))).encode(): 0 for _ in range(150)}) + [b"\0\0"]
    rng.shuffle(tokens)
    some = ["".join(rng.choices("abcd", k=rng.randint(0, 40))).encode() for _ in range(800)] + [b"", b"\0" * 7, b"d" * 9]
    got, want = (kind(tokens, r"(?s).+").encode_all(some) for kind in (shards.Columns, shards.Bpe))
    assert [x.tolist() for x in got] == [x.tolist() for x in want]
    single = shards.Columns([bytes([b]) for b in range(256)], r"(?s).+")
    assert single.encode_all([b"ab"])[0].tolist() == [97, 98] and [len(x) for x in single.encode_all([])] == [0, 0]


def test_packs_number_ids_by_frequency():
    """Ids that are frequent take a byte each, whatever they are."""
    edge = np.array([0, 127, 128, 16_383, 16_384, (1 << 21) - 1, 1 << 21, (1 << 28) - 1])
    assert shards._long(shards._short(edge)).tolist() == edge.tolist() and len(shards._short(edge)) == 1 + 1 + 2 + 2 + 3 + 3 + 4 + 4
    assert len(shards._long(shards._short(edge[:0]))) == 0
    rng = np.random.default_rng(7)
    for vocabulary in (50_000, 300_000):
        layout = shards.Layout(vocabulary)
        of = rng.permutation(vocabulary + 1).astype(layout.kind)
        numbers = np.empty_like(of)
        numbers[of] = np.arange(len(of))
        head = np.zeros(300, layout.head)
        head["n"] = 200
        place, ids = np.arange(300, dtype="<u4"), of[np.minimum(rng.zipf(1.3, 60_000), vocabulary)]
        pack = shards._packed(place, head, ids, numbers)
        assert all((x == y).all() for x, y in zip(shards._unpacked(300, pack, layout, of), (place, head, ids), strict=True))
        planes = np.ascontiguousarray(ids.view(np.uint8).reshape(len(ids), -1).T).tobytes()
        assert len(pack) < 0.9 * len(shards.pa.compress(planes, codec="zstd", asbytes=True))
