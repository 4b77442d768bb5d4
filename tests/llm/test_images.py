import math
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from fluxmesh.llm.images import EDITS, LEVELS, MIN_VOTES, MOST_APART, SCALE_BIN, SHIFT_BIN, TURN_BIN, _unpacked, decode_image, describe_stack, descriptors, edit, edited_images, embedding_images, encode_pgm, render, search_copies, whole_classes
from fluxmesh.llm.queries import op1_image_copies

from .helpers import SF


def png(px, colour, kind):
    h, w, d = px.shape
    rows, up = b"", np.zeros((w + 1) * d, int)
    for y in range(h):
        line = np.concatenate([np.zeros(d, int), px[y].astype(int).ravel()])
        if kind == 4:
            out = []
            for x in range(d, len(line)):
                a, b, c = line[x - d], up[x], up[x - d]
                p = a + b - c
                out.append((line[x] - min((a, b, c), key=lambda v: abs(p - v))) % 256)
        else:
            guess = {0: 0, 1: line[:-d], 2: up[d:], 3: (line[:-d] + up[d:]) // 2}[kind]
            out = (line[d:] - guess) % 256
        rows += bytes([kind]) + bytes(np.array(out, np.uint8))
        up = line
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_decoders():
    rng = np.random.default_rng(1)
    for colour, d in ((0, 1), (2, 3), (6, 4)):
        px = rng.integers(0, 256, (9, 7, d)).astype(np.uint8)
        want = px[..., 0] if d == 1 else px[..., :3] @ np.array([0.299, 0.587, 0.114])
        for kind in range(5):
            assert np.allclose(decode_image(png(px, colour, kind)), want, atol=0.01)
    grey = rng.integers(0, 256, (5, 6)).astype(np.uint8)
    assert (decode_image(encode_pgm(grey)) == grey).all()
    for bad in (None, b"", b"P5", b"P5\n9 9\n255\n12", b"\x89PNG\r\n\x1a\nxx", b"GIF89a", png(px, 2, 0)[:60]):
        assert decode_image(bad) is None


def table(spark, rows):
    return spark.createDataFrame([(i, None if b is None else bytearray(b), "x", 1.0) for i, b in rows], "image_id long, image binary, corner string, x double")


def pictures(n, seed=4):
    rng = np.random.default_rng(seed)
    return [render(list(rng.normal(0, 0.125, 64))) for _ in range(n)]


def brute(queries, corners):
    """All pairs of corners that differ in few tests, voting as documented: {(query, image)}."""
    by = lambda rows: {i: [r for r in rows if r.image_id == i] for i in {r.image_id for r in rows}}
    asked, there = by(queries), by(corners)
    out = set()
    for i, p in asked.items():
        for j, e in there.items():
            d = np.array([[(a.d0 ^ b.d0) % 2**64 for b in e] for a in p], np.uint64), np.array([[(a.d1 ^ b.d1) % 2**64 for b in e] for a in p], np.uint64)
            bins = {}
            for k, m in zip(*np.nonzero(np.bitwise_count(d[0]).astype(int) + np.bitwise_count(d[1]) <= MOST_APART), strict=True):
                q, x = p[k], e[m]
                turn, ratio = (q.turn - x.turn) % 360, LEVELS[q.level] / LEVELS[x.level]
                c, s = math.cos(math.radians(turn)) * ratio, math.sin(math.radians(turn)) * ratio
                sx, sy = q.x - (c * x.x - s * x.y), q.y - (s * x.x + c * x.y)
                for g in range(16):
                    half = [(g >> n & 1) / 2 for n in range(4)]
                    key = (g, math.floor(sx / SHIFT_BIN + half[0]), math.floor(sy / SHIFT_BIN + half[1]), math.floor(turn / TURN_BIN + half[2]) % 12, math.floor(math.log2(ratio) / SCALE_BIN + half[3]))
                    own = bins.setdefault(key, (set(), set()))
                    own[0].add(k)
                    own[1].add((round(x.x / 3), round(x.y / 3)))
            if max((min(map(len, b)) for b in bins.values()), default=0) >= MIN_VOTES:
                out.add((i, j))
    return out


def test_edited_copies_are_found_as_by_all_pairs(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").limit(60)
    index, queries = embedding_images(vectors).cache(), edited_images(vectors, 2).cache()
    found, members = search_copies(queries, index)
    got = {(r.query_id, r.class_id) for r in found.collect()}
    of = {r.image_id: r.class_id for r in members.collect()}
    points = [descriptors(x).select("image_id", "d0", "d1", *[v.alias(k) for k, v in _unpacked(F.col("place")).items()]).collect() for x in (queries, index)]
    want = {(i, of.get(j, j)) for i, j in brute(*points)}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.02 * len(want)
    own = [(i, of.get(i, i)) in got for i in range(0, 60, 2)]
    assert sum(own) >= 0.9 * len(own)
    by_edit = {e: [f for k, f in enumerate(own) if k % len(EDITS) == n] for n, e in enumerate(EDITS)}
    assert all(any(f) for f in by_edit.values()), by_edit


def test_near_copies_form_one_class(spark):
    rng = np.random.default_rng(3)
    base, *others = pictures(12)
    rows = [(i, encode_pgm(base + rng.normal(0, 2, base.shape))) for i in range(40)] + [(100 + i, encode_pgm(px)) for i, px in enumerate(others)]
    classes = {r.node: r.comp for r in whole_classes(descriptors(table(spark, rows))).collect()}
    assert sum(classes.get(i) == 0 for i in range(40)) >= 36 and not [i for i in classes if i >= 100]
    found, _ = search_copies(table(spark, [(7, encode_pgm(edit(base, 0)))]), table(spark, rows))
    assert 0 in {r.class_id for r in found.collect()} and not found.where("class_id >= 100").count()


def test_a_common_mark_does_not_make_a_class(spark):
    """A third of the pictures bear one mark; marked pictures are no copies of each other as a whole."""
    rows, mark = [], pictures(1, 9)[0][:40, :40]
    for i, px in enumerate(pictures(30)):
        if i % 3 == 0:
            px[8:48, 60:100] = mark
        rows.append((i, encode_pgm(px)))
    index = table(spark, rows)
    assert whole_classes(descriptors(index)).count() == 0
    asked = [(i, encode_pgm(edit(decode_image(rows[i][1]), 0))) for i in range(30)]
    found, _ = search_copies(table(spark, asked), index)
    got = {(r.query_id, r.class_id) for r in found.collect()}
    assert sum((i, i) in got for i in range(30)) >= 27
    assert all(i == j or i % 3 == j % 3 == 0 for i, j in got)


def test_hard_rows(spark):
    px = pictures(2)
    good, other = encode_pgm(px[0]), encode_pgm(px[1])
    rows = [(None, good), (1, None), (2, b""), (3, b"no image"), (4, encode_pgm(np.zeros((60, 60)))), (5, encode_pgm(px[0][:20, :20])), (6, good), (6, good), (7, other), (7, good)]
    found, members = search_copies(table(spark, [(0, good), (None, good), (9, None)]), table(spark, rows))
    assert {(r.query_id, r.class_id) for r in found.collect()} == {(0, 6)} or {(r.query_id, r.class_id) for r in found.collect()} == {(0, 6), (0, 7)}
    assert members.where("image_id in (1, 2, 3, 4, 5)").count() == 0
    empty = table(spark, rows).limit(0)
    assert search_copies(empty, table(spark, rows))[0].count() == search_copies(table(spark, rows), empty)[0].count() == 0
    none = spark.createDataFrame([(None, None), (3, None), (4, [0.0, None, 1.0, 0.5])], "vec_id long, embedding array<double>")
    assert embedding_images(none).count() == 3 and edited_images(none, 4).where("image is not null").count() == 1
    assert len(describe_stack(np.zeros((3, 30, 30), np.float32))) == 0


def test_corners_follow_the_area():
    rng = np.random.default_rng(1)
    small, large = (len(describe_stack(rng.normal(128, 45, (1, n, n)).astype(np.float32))) for n in (100, 400))
    assert large > 10 * small > 0


def test_the_query_has_a_row_for_each_row_it_asks_for(spark):
    out = op1_image_copies(spark, SF).cache()
    assert out.select("vec_id").distinct().count() == spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 20 = 0").count()
    assert out.where(F.col("is_original") & (F.col("class_id") > F.col("vec_id"))).count() == 0
