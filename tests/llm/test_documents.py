"""Operators 3, 7, 8 and 10 against plain versions."""

import hashlib
import re
import zlib

import brute
import pytest
from pyspark.sql import functions as F

from quillscope.llm import components, decontaminate, kd_shards, queries, simhash, syncmers


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{brute.SF_SMALL}/documents.parquet")


def test_fingerprints():
    texts = [*brute.random_texts(400), "", "One", "two WORDS", "Ünï cödé Ä B c"]
    assert simhash.fingerprints([t.encode() for t in texts]).tolist() == [brute.simhash(t) for t in texts]


def test_near_duplicates_equal_all_pairs(spark, table, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 4)
    rows = queries.op3_simhash(spark, brute.SF_SMALL).collect()
    fps = {r["doc_id"]: brute.simhash(r["text"]) for r in table.collect()}
    want = brute.component_ids(list(fps), list(fps.values()))
    assert len(rows) == len(fps)
    assert all(int(r["fingerprint"], 16) == fps[r["doc_id"]] and r["component_id"] == want[r["doc_id"]] for r in rows)


def test_links_of_close_fingerprints(spark):
    """Chains of one to three changed bits, over cell and tile edges."""
    import random

    rng = random.Random(2)
    fps = {0, (1 << 64) - 1}
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(6):
            fps.add(f)
            for b in rng.sample(range(64), rng.randint(1, 4)):
                f ^= 1 << b
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = components.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()
    want = brute.component_ids(list(range(len(fps))), fps)
    root = {r["node"]: r["root"] for r in found}
    groups, named = {}, {}
    for i, f in enumerate(signed):
        groups.setdefault(want[i], set()).add(f)
        named.setdefault(root.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, named.values()))


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "u long, v long").where("u is not null")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[i] == 100 for i in range(101, 160)) and got[201] == 200
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_edge_rows(spark):
    docs = brute.edge_rows(spark)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == 10
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2)} == {1} and {r["component_id"] for r in rows if r["doc_id"] in (3, 4)} == {3}
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 5, 6, 7]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.drop_near_duplicates(docs.limit(0)).count() == 0


ITEMS = {"a": "the cat sat on the mat and the dog ran after it", "b": "The dog", "c": None, "d": "", "e": "x"}


@pytest.mark.parametrize(("items", "most"), [(ITEMS, 300_000), (ITEMS, 0), ({"a": ITEMS["a"]}, 300_000), ({"a": ITEMS["a"]}, 0), ({"c": None}, 0), ({}, 0)])
def test_decontamination_edge_rows(spark, monkeypatch, items, most):
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_BYTES", most)
    docs = brute.edge_rows(spark).withColumn("pos", F.lit(3)).withColumn("items", F.lit("taken"))
    bench = spark.createDataFrame(list(items.items()), "item_id string, text string")
    rows = decontaminate.report(docs, bench).collect()
    assert len(rows) == 10
    left = [brute.windows_hit(r["text"], items) + (r["doc_id"],) for r in docs.where("coalesce(doc_id, 0) not in (5, 6)").collect()]
    want = sorted((d or 0, n, len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()) for n, hit, found, d in left)
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in rows if r["doc_id"] not in (5, 6))
    assert got == want
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not r["contaminated"] for r in rows)
    spans = decontaminate.decontaminate(docs, bench, "spans")
    assert spans.count() == 10 and spans.columns == docs.columns


def test_spans_are_merged_and_removed(spark):
    docs = spark.createDataFrame([(1, "One two, THREE four. five"), (2, "nothing")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "two three"), (2, "three four")], "item_id long, text string")
    found = {r["doc_id"]: r for r in decontaminate.contamination(docs, bench).collect()}
    assert [tuple(s) for s in found[1]["spans"]] == [(1, 4)] and found[1]["n_hit"] == 3 and found[1]["item_ids"] == ["1", "2"]
    texts = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, bench, "spans").collect()}
    assert texts == {1: "One ,  . five", 2: "nothing"}


@pytest.mark.parametrize("most", [1 << 20, -1])
def test_hits_of_equal_hashes_are_verified(spark, monkeypatch, most):
    """Every window has the same hash: only equal words are hits, broadcast or shuffled, in reports and in both filters."""
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_BYTES", most)
    monkeypatch.setattr(decontaminate, "window_hash", lambda gram: F.when(gram.isNotNull(), F.lit(7).cast("long")))
    items = {"a": " ".join(f"w{i}" for i in range(14)), "b": "short one", "c": " ".join(f"v{i}" for i in range(10))}
    texts = ["x " + items["a"] + " y", "a short one here", items["c"][:-1], items["c"] + " " + items["b"], None, "", " ".join(f"w{i}" for i in range(9))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id string, text string")
    for r in decontaminate.contamination(docs, bench).collect():
        n, hit, found = brute.windows_hit(texts[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], set(r["item_ids"])) == (n, len(hit), found)
    kept = {r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()}
    assert kept == {2, 4, 5, 6}
    spans = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, bench, "spans").collect()}
    assert spans[1].split() == ["a", "here"] and spans[0].split() == ["x", "y"] and spans[2] == texts[2]


def plain_anchors(text):
    """(hash, position) of a text's anchors."""
    import xxhash

    h64 = lambda t: (lambda x: x - (1 << 64) if x >> 63 else x)(xxhash.xxh64_intdigest(t.encode("utf-32-be"), 42))
    s, k = syncmers.S, syncmers.K
    size, text = k + s - 1, text or ""
    h = [h64(text[i : i + s]) for i in range(len(text) - s + 1)]
    kmers = range(len(text) - size + 1)
    closed = [i for i in kmers if min(h[i : i + k]) in (h[i], h[i + k - 1])]
    if closed or (size <= len(text) < syncmers.WHOLE):
        return [(h64(text[i : i + size]) & 0xFFFFFFFF, i) for i in closed or kmers]
    if s <= len(text) < size:
        return [(x & 0xFFFFFFFF, i) for i, x in enumerate(h)]
    return [(h64(text) & 0xFFFFFFFF, 0)] if text else []


def plain_sketch(text):
    first = {}
    for x, i in plain_anchors(text):
        first.setdefault(x, i)
    return "".join(f"{x:08x}{i:08x}" for x, i in sorted(first.items())[: syncmers.SKETCH])


def plain_likeness(a, b):
    a, b = ({int(f[i : i + 8], 16): int(f[i + 8 : i + 16], 16) for i in range(0, len(f), 16)} for f in (a, b))
    union = sorted({*a, *b})[: syncmers.SKETCH]
    shifts = [a[x] - b[x] for x in union if x in a and x in b]
    return sum(d == 0 or shifts.count(d) > 1 for d in shifts) / len(union) if union else 1.0


def test_syncmers_are_closed_and_context_free(spark):
    import random

    rng = random.Random(7)
    passage = "".join(rng.choice("abcdefgh 中é😀") for _ in range(300))
    docs = spark.createDataFrame([(1, passage), (2, "other start" + passage[40:260])], "doc_id long, text string")
    found = {1: {}, 2: {}}
    for r in syncmers.anchors(docs).collect():
        found[r["doc_id"]][r["position"]] = r["hash"]
    assert found[1] == {i: x for x, i in plain_anchors(passage)}
    size = syncmers.K + syncmers.S - 1
    shared = {p - 40 + 11: x for p, x in found[1].items() if 40 <= p <= 260 - size}
    assert len(shared) > 50 and {p: x for p, x in found[2].items() if p >= 11} == shared


def test_edited_texts(spark, table):
    rows = {r["doc_id"]: r for r in queries.op8_syncmers(spark, brute.SF_SMALL).collect()}
    docs = sorted(((r["doc_id"], r["text"]) for r in table.collect()), reverse=True)
    assert len(rows) == len(docs)
    by_text = {}
    for i, (doc, text) in enumerate(docs):
        after, third = docs[(i + 1) % len(docs)][1], len(text) // 3
        r = rows[doc]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256((text[: len(text) - third] + after[:third]).encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        by_text.setdefault(text, set()).add(r["fingerprint"])
        if text == after:
            assert r["near_next"] == 1
    assert all(len(x) == 1 for x in by_text.values())
    assert sum(r["near_edited"] for r in rows.values()) / len(rows) > 0.4


def test_fingerprints_and_likeness_equal_a_plain_version(spark, monkeypatch):
    """All cases of short texts, long and repetitive ones, edited texts read from the joint only."""
    import random

    monkeypatch.setattr(syncmers, "MANY", 100)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 9)))
    texts = [*brute.random_texts(100), None, "", " \n", "a", "ab\n", "\n a\u3000b", "😀😀a😀bcd😀efg", "one  two\tthree", "a" * 5000, "ab" * 300, "long words " * 400]
    texts += [" ".join(word() for _ in range(rng.choice([5, 12, 40, 200, 800]))) for _ in range(60)]
    docs = [(i, t) for i, t in enumerate(texts)]
    rows = {r["doc_id"]: r for r in syncmers.compare_with_edited(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    docs.sort(reverse=True)
    for i, (doc, text) in enumerate(docs):
        text, after = text or "", docs[(i + 1) % len(docs)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        r = rows[doc]
        assert r["fingerprint"] == plain_sketch(text) and r["edited_fingerprint"] == plain_sketch(edited), doc
        assert r["near_edited"] == pytest.approx(plain_likeness(r["fingerprint"], r["edited_fingerprint"]))
        assert r["near_next"] == pytest.approx(plain_likeness(r["fingerprint"], plain_sketch(after)))
        assert bool(r["fingerprint"]) == bool(text)


def test_short_and_unspaced_texts_are_told_apart(spark):
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 9)))
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(5 + i % 8))) for i in range(80)], "doc_id long, text string")
    rows = syncmers.compare_with_edited(docs).collect()
    assert len(rows) == 80 and all(r["near_edited"] > r["near_next"] for r in rows)
    chars = [rng.choice([*map(chr, range(0x4E00, 0x4F00)), *"abc", "😀"]) for _ in range(1500)]
    pairs = [("".join(chars), "".join([*chars[:3], "x", *chars[3:]])), ("猫が鳴く", "犬が吠える"), ("😀", "😃")]
    texts = spark.createDataFrame(pairs, "a string, b string")
    both = syncmers.with_likeness(syncmers.with_fingerprint(syncmers.with_fingerprint(texts, "a", "fa"), "b", "fb"), "fa", "fb", "near")
    near = [r["near"] for r in both.collect()]
    assert near[0] > 0.8 and near[1:] == [0, 0]


@pytest.mark.parametrize("ids", [[1] * 300, [*range(200), 10**12], [None] * 150 + [5] * 100 + [*range(50)], [-3, 2**62, 0] * 60, [1.5, None, float(2**40)] * 50])
def test_next_rows_of_skewed_ids(spark, monkeypatch, ids):
    """Every row has one next row, by falling id, and no bucket has much more than its share."""
    monkeypatch.setattr(syncmers, "ROWS_PER_BUCKET", 10)
    kind = "double" if any(isinstance(i, float) for i in ids) else "long"
    df = spark.createDataFrame(list(zip(ids, range(len(ids)), strict=True)), f"doc_id {kind}, row long")
    rows = syncmers.with_next(df.withColumn("id", F.col("doc_id")), "doc_id", ["row", "id"]).collect()
    follows = {r["row"]: r["next_row"] for r in rows}
    assert len(rows) == len(follows) == len(set(follows.values())) == len(ids)
    high = max(range(len(ids)), key=lambda i: -1e300 if ids[i] is None else ids[i])
    at, seen = high, []
    for _ in ids:
        seen.append(-1e300 if ids[at] is None else ids[at])
        at = follows[at]
    falls = [a >= b for a, b in zip(seen, seen[1:], strict=False)]
    assert at == high and falls.count(False) <= 1  # the walk may start inside the highest id's rows
    tied = df.withColumn("__row", F.monotonically_increasing_id()).withColumn("__tie", F.pmod(F.xxhash64("__row"), F.lit(syncmers.TIES)))
    sizes = [r["count"] for r in tied.withColumn("b", syncmers._bucket(tied, "doc_id")).groupBy("b").count().collect()]
    assert max(sizes) <= 60


def test_ids_without_quantiles_are_refused(spark):
    with pytest.raises(TypeError):
        syncmers.compare_with_edited(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_edited_edge_rows(spark, monkeypatch):
    docs = brute.edge_rows(spark).withColumn("body", F.lit(2)).withColumn("fp", F.lit("taken"))
    monkeypatch.setattr(syncmers, "ROWS_PER_BUCKET", 1)
    rows = syncmers.compare_with_edited(docs).collect()
    assert len(rows) == 10 and sorted(r["doc_id"] or 0 for r in rows) == [0, 0, 1, 1, 2, 3, 4, 5, 6, 7]
    text = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"]}
    of7 = next(r for r in rows if r["doc_id"] == 7)
    assert of7["edited_sha256"] == hashlib.sha256(b"..x").hexdigest()
    of6 = next(r for r in rows if r["doc_id"] == 6)
    assert of6["edited_sha256"] == hashlib.sha256((text[6][: 20_000 - 6666] + text[5][:6666]).encode()).hexdigest()
    of1 = [r for r in rows if r["doc_id"] == 1]
    assert any(r["near_next"] == 1 for r in of1) and of1[0]["fingerprint"] == next(r for r in rows if r["doc_id"] == 2)["fingerprint"]
    assert syncmers.compare_with_edited(docs.limit(0)).count() == 0


def check_shards(rows, docs, shards=24):
    assert sorted((r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == sorted((r["doc_id"] or 0, len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs)
    slots = {}
    for r in rows:
        assert 0 <= r["shard"] < shards
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = queries.op10_kd_shards(spark, "/root/testdata/sf0.01").collect()
    check_shards(rows, docs.collect())
    sizes = {}
    for r in rows:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
    mean, largest = sum(sizes.values()) / 24, max(r["size"] for r in rows)
    assert len(sizes) == 24 and max(sizes.values()) < mean + largest and min(sizes.values()) > mean - largest
    shards_of = {}
    for r in rows:
        shards_of.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(len(x) == 1 for x in shards_of.values())


def test_a_hot_group_is_split(spark):
    docs = spark.createDataFrame([(i, "one text for all" if i % 3 else f"text {i}", "en", "s") for i in range(600)], "doc_id long, text string, lang string, source string")
    sizes = {}
    for r in kd_shards.assign(docs, 6).collect():
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
    assert max(sizes.values()) < 1.05 * sum(sizes.values()) / 6


def test_copies_take_the_least_names(spark):
    # One text has over a thousandth of the rows, others have two copies, most have one.
    rows = [(None if i % 50 == 0 else i, "hot" if i % 3 == 0 else f"text {i // 2 if i < 900 else i}", ["en", "de", None][i % 7 % 3], f"s{(i * 37) % 11}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    narrow = docs.select("doc_id", F.lit(1).alias("size"), F.lit(1).alias("text_crc32"), F.xxhash64("text").alias("text_hash"), F.coalesce("lang", F.lit("")).alias("lang"), "source")
    least = {}
    plain = [tuple(r) for r in narrow.select("doc_id", "text_hash", "lang", "source").collect()]
    for _, h, lang, source in plain:
        least[h] = (min(least[h][0], lang), min(least[h][1], source)) if h in least else (lang, source)
    components.checkpoint_folder(spark)
    found = kd_shards._least_names(narrow)
    none_first = lambda r: (r[0] is not None, *((x or 0) if i == 0 else x for i, x in enumerate(r)))
    assert sorted((tuple(r) for r in found.select("doc_id", "text_hash", "lang", "source").collect()), key=none_first) == sorted(((d, h, *least[h]) for d, h, _, _ in plain), key=none_first)


def test_shard_edge_rows(spark):
    docs = brute.edge_rows(spark).withColumn("node", F.lit("taken")).withColumn("shard", F.lit(1))
    check_shards(kd_shards.assign(docs).collect(), docs.collect())
    assert kd_shards.assign(docs.limit(0)).count() == 0
