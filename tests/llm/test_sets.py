"""Sharding, near duplicates, archives, media and the pipeline against brute force."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from atomloom.llm import media, neardup, sharding, warc
from atomloom.llm.common import join_on_key, shared_dir, table
from atomloom.llm.components import connected_components
from atomloom.llm.files import read_files
from atomloom.llm.queries import queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_sharding(spark, odd_documents, no_documents, sf):
    rows = sharding.op1_rendezvous_sharding(spark, sf).toPandas()
    for _, g in rows.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    moved = rows[rows["shard"] != rows["grown_shard"]]
    assert set(moved.grown_shard) == {8} and 0 < len(moved) < 0.25 * len(rows)
    odd = sharding.shard_rows(odd_documents, "doc_id", F.col("text"), [1.0, 2.0, 0.0]).collect()
    assert len(odd) == 11 and {r["shard"] for r in odd} <= {0, 1} and all(r["grown_shard"] is None for r in odd)
    texts = {r["doc_id"]: r["text"] or "" for r in odd_documents.collect()}
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in odd)
    assert sharding.shard_rows(no_documents, "doc_id", F.col("text"), [1.0]).count() == 0
    weights = spark.range(30000).select(sharding.rendezvous_shard(F.col("id"), [1.0, 3.0]).alias("s")).groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in weights}[1] == pytest.approx(22500, rel=0.03)
    with pytest.raises(ValueError):
        sharding.rendezvous_shard(F.col("x"), [0.0])


def brute_components(texts):
    sets = {}
    for d, t in texts.items():
        w = __import__("re").findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {d: d for d in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_near_duplicates_equal_brute_force(spark, odd_documents, no_documents):
    rng = np.random.default_rng(4)
    texts, n = {}, 0
    for _ in range(12):
        base = [f"w{k}" for k in rng.integers(0, 400, rng.integers(12, 160))]
        for _ in range(rng.integers(1, 9)):
            copy = list(base)
            for _ in range(rng.integers(0, 1 + len(base) // 14)):
                copy[rng.integers(len(copy))] = f"x{rng.integers(30)}"
            texts[n] = " ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy)
            n += 1
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).members.collect()}
    assert got == brute_components(texts)
    odd = [(r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(odd_documents).members.collect()]
    assert len(odd) == 11 and (1, 0, 1) in odd and (3, 0, 3) in odd and (6, 8, 5) in odd and odd.count((5, 8, 5)) == 2 and (None, 1, None) in odd
    assert neardup.near_duplicates(no_documents).members.count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (8, b + " end"), (3, c), (8, c), (7, "a text of its own that nobody else has")]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).members.collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(1, 1), (5, 1), (8, 1), (3, 1), (7, 7)}
    named = spark.createDataFrame([(0, 5, 20, 5), (0, 9, 20, 9)], "bucket long, rep long, n long, component long")
    sets = spark.createDataFrame([(5, list(range(20))), (5, list(range(100, 140))), (9, list(range(2, 22)))], "rep long, shingles array<long>")
    assert [tuple(r) for r in neardup.open_pairs(named, sets).collect()] == [(5, 9)]


def test_registers_are_mergeable_and_estimate():
    rng = np.random.default_rng(0)
    whole = rng.integers(0, 1 << 63, 1400, dtype=np.uint64)
    a, b = np.unique(whole[:1000]), np.unique(whole[200:1400])
    r = neardup.sketch([a, b, np.unique(whole), np.zeros(0, np.uint64)])
    assert (np.maximum(r[0], r[1]) == r[2]).all() and not r[3].any()
    j = neardup.likelihood_similarity(r[:1], r[1:2], np.array([1000.0]), np.array([1200.0]))[0]
    assert j == pytest.approx(800 / 1400, abs=0.15)


def test_components_and_hot_join(spark):
    edges = [(i, i + 1) for i in range(1, 9)] + [(20, 30), (30, 10), (7, 7)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 10)} | {10: 10, 20: 10, 30: 10}
    odd = connected_components(spark.createDataFrame([(None, 5), (6, None), (None, None), (8, 7)], "a long, b long"))
    assert {(r.id, r.component) for r in odd.collect()} == {(5, 5), (6, 6), (7, 7), (8, 7)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    left = spark.range(3000).select("id", F.when(F.col("id") < 1000, "hot").when(F.col("id") < 2990, F.col("id").cast("string")).alias("k"))
    right = left.filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    rows = join_on_key(left, right, "k", "n", 3000).toPandas()
    assert len(rows) == 3000 and (rows[rows.k == "hot"].top == 999).all() and rows[rows.k.isna()].top.isna().all()


def test_warc_round_trip(spark):
    long_page = "<p>" + "long " * 200_000
    pages = [(1, "u", "<html>a</html>"), (2, None, "<html>a</html>"), (3, "x y\n", None), (4, "u", ""), (5, "u", long_page), (None, "u", "<html>a</html>"), (7, "u", "a\r\n\r\nb"), (2, None, "<html>a</html>")]
    table = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, payload int")
    folder = shared_dir(spark, "test-warc")
    manifest = warc.write_archives(warc.classify(table).repartition(1), folder).collect()
    assert sum(r.records for r in manifest) == 8
    rows = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_pages(read_files(spark, folder, ".warc.zst")).collect())
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    kind = {2: ("revisit", 1), 4: ("revisit", 3)}
    assert rows == sorted((p[0] or 0, len((p[2] or "").encode()), digest(p[2]), *kind.get(p[0], ("response", None))) for p in pages)
    raw = read_files(spark, folder, ".warc.zst").first().content
    assert raw[:4] == b"\x5d\x2a\x4d\x18"
    with pytest.raises(ValueError):
        list(warc.read_archive(b"\x00" * 16))
    assert warc.write_archives(warc.classify(table.limit(0)), shared_dir(spark, "none")).count() == 0


def test_warc_trains_a_dictionary():
    rng = np.random.default_rng(0)
    words = [f"<li class=item{k}>" for k in range(400)]
    records = [warc.record(i, "u", "".join(rng.choice(words, 200)).encode(), "d", None) for i in range(400)]
    packed = warc.archive(records)
    assert list(warc.read_archive(packed)) == records
    alone = sum(len(zstandard.ZstdCompressor(level=6).compress(r)) for r in records)
    assert len(packed) < alone


def texture(seed, n=160):
    return media.resize(np.random.default_rng(seed).normal(128, 50, (n // 8, n // 8)).astype(np.float32), n, n)


def test_media_copies(spark, no_documents):
    big = texture(1)
    pictures = {
        100: big, 1: big, 2: big[20:140, 30:150], 3: np.rot90(big), 4: np.clip(big * 0.8 + 20, 0, 255), 5: texture(2), 6: texture(3), 200: np.full((30, 30), 7.0), 7: np.full((30, 30), 7.0), 8: np.full((30, 30), 8.0),
    }
    rows = [(k, media.encode(v)) for k, v in pictures.items()] + [(9, None), (300, None), (10, b""), (400, b"no image"), (11, b"no image"), (None, media.encode(big)), (12, b"P5 3 3 255 x")]
    images = spark.createDataFrame(rows, "id long, media binary")
    found = media.find_copies(images)
    classes = collections.defaultdict(set)
    for r in found.members.collect():
        classes[r.component_id].add(r.id)
    assert {frozenset(c) for c in classes.values() if len(c) > 1} == {frozenset({1, 2, 3, 4, 100}), frozenset({7, 200}), frozenset({11, 400})}
    assert sum(map(len, classes.values())) == 17 and classes[None] == {None}
    assert media.find_copies(images.limit(0)).members.count() == 0
    colour = b"P6 # c\n2 1\n255\n" + bytes([255, 0, 0, 0, 0, 255])
    assert media.decode(colour).round().tolist() == [[76.0, 29.0]]


def test_media_recall(spark):
    """Links of brute-force consensus over all pairs of pictures: at least nine tenths end up in one class."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 64))
    vectors = np.concatenate([b + rng.normal(scale=s, size=(8, 64)) for b, s in zip(base, np.linspace(0.02, 0.3, 30), strict=True)])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    source = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    pictures = source.mapInArrow(media.render, "id long, media binary")
    drawn = pictures.orderBy("id").collect()
    described = {r.id: media.corners(media.decode(r.media)[None])[0] for r in drawn}
    brute = [(i, j) for i in described for j in described if j < i and media.consensus(described[i], described[j])[0] >= media.MIN_INLIERS]
    component = {r.id: r.component_id for r in media.find_copies(pictures).members.collect()}
    assert len(brute) > 300
    assert sum(component[i] == component[j] for i, j in brute) >= 0.9 * len(brute)


def test_media_copies_behind_strangers(spark):
    """Two copies whose shared buckets all hold a smaller and a larger id that agrees with them in four corners only."""
    rng = np.random.default_rng(5)

    def picture(n):
        record = np.zeros(n, media.CORNER)
        record["x"], record["y"], record["scale"] = rng.uniform(0, 20, n) + 400 * np.repeat(np.arange(n // 2 + 1), 2)[:n], rng.uniform(0, 20, n), 1.0
        record["y"][1::2] = record["y"][: n - 1 : 2] + 8
        record["angle"], record["bits"] = rng.uniform(-3, 3, n), rng.integers(0, 256, (n, media.TESTS // 8))
        return record

    copy = picture(8)
    rows = [(50, copy), (60, copy)]
    for k in range(4):
        for i in (k, 100 + k):
            stranger = picture(10)
            stranger[:2] = copy[2 * k : 2 * k + 2]
            rows.append((i, stranger))
    every = spark.createDataFrame([(i, str(i).encode(), r.tobytes()) for i, r in rows], "id long, digest binary, corners binary")
    found = {r.id: (r.component_id, r.n_confirmed_links) for r in media.copy_classes(every).members.collect()}
    assert found == {i: (i, 0) for i, _ in rows} | {50: (50, 1), 60: (50, 1)}


def turned(image, angle, scale, side):
    """The middle of an image, turned and scaled (bilinear)."""
    place = np.stack(np.mgrid[0:side, 0:side]) - (side - 1) / 2
    y, x = place / scale
    x, y = np.cos(angle) * x - np.sin(angle) * y + (image.shape[1] - 1) / 2, np.sin(angle) * x + np.cos(angle) * y + (image.shape[0] - 1) / 2
    x, y = np.clip(x, 0, image.shape[1] - 1.001), np.clip(y, 0, image.shape[0] - 1.001)
    i, j = y.astype(int), x.astype(int)
    fy, fx = y - i, x - j
    return image[i, j] * (1 - fy) * (1 - fx) + image[i, j + 1] * (1 - fy) * fx + image[i + 1, j] * fy * (1 - fx) + image[i + 1, j + 1] * fy * fx


def test_media_edits(spark):
    """Crops, turns, scalings, brightness and noise of pictures of many and of few corners, against consensus of all pairs."""
    rng = np.random.default_rng(9)
    edits = [
        lambda p: p[30:110, 40:120],
        lambda p: p[90:150, 20:80],
        lambda p: np.rot90(p),
        lambda p: turned(p, 0.3, 1.0, 112),
        lambda p: turned(p, 0.0, 0.8, 128),
        lambda p: media.resize(p, 112, 112),
        lambda p: np.clip(p * 0.7 + 30, 0, 255),
        lambda p: p + rng.normal(0, 8, p.shape),
    ]
    pictures = []
    for k in range(12):
        whole = texture(60 + k) if k < 9 else media.resize(np.random.default_rng(k).normal(128, 60, (5, 5)).astype(np.float32), 160, 160)
        pictures += [np.asarray(p, np.float32) for p in (whole, *(e(whole) for e in edits))]
    media_of = [media.encode(p) for p in pictures]
    described = [media.corners(media.decode(m)[None])[0] for m in media_of]
    assert min(map(len, described)) < 24 < max(map(len, described))
    brute = [(i, j) for i in range(len(pictures)) for j in range(i) if media.consensus(described[i], described[j])[0] >= media.MIN_INLIERS]
    found = {r.id: r.component_id for r in media.find_copies(spark.createDataFrame(list(enumerate(media_of)), "id long, media binary")).members.collect()}
    size = len(edits) + 1
    assert len(brute) > 200 and sum(found[i] == found[j] for i, j in brute) >= 0.9 * len(brute)
    own = [i for i, c in found.items() if i % size and c // size == i // size and c != i]
    assert len(own) >= 0.9 * sum(any(j // size == i // size for j in range(i) if (i, j) in set(brute)) for i in found if i % size)


def test_media_query(spark):
    """Edited pictures meet their originals; rows are one a picture."""
    rows = queries()["op7_media_copies"](spark, "/root/testdata/sf0.001").toPandas()
    n = table(spark, "/root/testdata/sf0.001", "embeddings").count()
    edited = rows[rows.edited]
    assert len(rows) == n + len(edited) and rows.picture_id.is_unique and len(edited) == -(-n // media.EDITED_EACH)
    assert (edited.component_id == edited.picture_id - 1).mean() >= 0.9 and rows[~rows.edited].kept.all()
    source = spark.createDataFrame([(0, None), (1, []), (2, [1.0]), (None, [1.0, None]), (3, [float("nan")] * 64)], "vec_id long, embedding array<float>")
    drawn = {(r.id, r.media is None) for r in source.mapInArrow(media.render, "id long, media binary").collect()}
    assert drawn == {(0, True), (1, True), (2, True), (4, False), (None, False), (6, False)}


def test_media_crops(spark):
    """Crops of 9 to 25 percent of a picture: its corners there are all kept, and the crop is found."""
    rows, sides = [], (72, 96, 120)
    for k in range(6):
        whole = texture(20 + k, 240)
        rows += [(10 * k, whole)] + [(10 * k + n, whole[100 : 100 + side, 90 : 90 + side]) for n, side in enumerate(sides, 1)]
    whole = media.corners(texture(20, 240)[None])[0]
    inside = whole[(whole["scale"] == 1) & (np.abs(whole["x"] - 138) < 35) & (np.abs(whole["y"] - 148) < 35)]
    crop = media.corners(texture(20, 240)[None, 100:196, 90:186])[0]
    places = {(round(float(c["x"])) + 90, round(float(c["y"])) + 100) for c in crop[crop["scale"] == 1]}
    assert len(whole) > 100 and {(round(float(c["x"])), round(float(c["y"]))) for c in inside} <= places
    images = spark.createDataFrame([(i, media.encode(p)) for i, p in rows], "id long, media binary")
    found = {r.id: r.component_id for r in media.find_copies(images).members.collect()}
    assert [found[10 * k + n] for k in range(6) for n in (1, 2, 3)] == [10 * k for k in range(6) for _ in range(3)]


def test_pipeline_stages(spark, odd_documents, no_documents):
    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "minhash_near_dedup", "mixing", "bpe"]
    for docs, size in ((odd_documents, 11), (no_documents, 0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns and out.count() <= size, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == size
    left = corpus_pipeline.drop_near_duplicates(spark, odd_documents, sf)
    counts = collections.Counter(r.doc_id for r in left.collect())
    assert counts[5] == 1 and 6 not in counts and counts[1] == 1 and counts[None] == 1


@pytest.mark.parametrize("n", [1, 3, 20, 700])
def test_small_archives_have_trained_dictionaries(n):
    rng = random.Random(n)
    words = [f"<p class='{k}'>word{k * 7919 % 1000}</p> " for k in range(120)]
    records = [warc.record(i, "u", "".join(rng.choice(words) for _ in range(150)).encode(), "d", None) for i in range(n)]
    packed = warc.archive(records)
    assert packed[8:12] == b"\x37\xa4\x30\xec" and list(warc.read_archive(packed)) == records  # Zstandard's mark of a trained dictionary


def test_untrainable_archives_are_read_alike():
    rng = random.Random(3)
    for records in ([b"x"], [b"", b"yy"], [rng.randbytes(90)]):
        packed = warc.archive([warc.record(1, None, r, "d", None) for r in records])
        assert [warc.parse(r)[1] for r in warc.read_archive(packed)] == records


def test_samples_cover_all_records():
    records = [bytes([k]) * 30_000 for k in range(200)]
    pieces = warc.sample_pieces(records)
    assert {p[0] for p in pieces} == set(range(200)) and sum(map(len, pieces)) <= warc.SAMPLE_BYTES
