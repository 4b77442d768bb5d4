"""Search for copies of images by local descriptors.

An image column is decoded (PGM, PPM, or PNG of 8 bits), corners are found at several scales, and each corner gets an
orientation (the direction of its patch's intensity centroid) and 128 binary tests turned to that orientation.

1. Index images that are alike as a whole form a class: corners that agree in a key and lie in the same cell meet the
   smallest image there, and images of which ``WHOLE`` of the corners so meet are joined; images left over meet the
   classes in the same way. A group of any size costs a row a corner and key.
2. Four tables hold ``KEY_BITS`` tests of each descriptor as key. A class stands once under a key, so a crowded key
   holds classes, not copies. Corners of a query and of a class that share a key and differ in ``MOST_APART`` tests of
   128 at most are a match.
3. Matches of a query and a class vote for the shift, turn and scale that carry the class's picture into the query;
   ``MIN_VOTES`` corners that agree make the query a copy of the class.

Rows: a null, empty or unreadable image has no corners and matches nothing; rows that share an id are one image; a null
id is never indexed or searched; an empty table gives no rows. Only the id and image columns are read. Corners are taken
per cell of the image's grid, so their number grows with its area. Images of less than 36 pixels a side have none.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop_scratch, free_shuffles, materialize

# Bytes of a pixel of each PNG colour type.
PNG_DEPTH = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
LEVELS = (1.0, 1.26, 1.59, 2.0)
#: Side of the cells (at the level's resolution) that keep their strongest corners, and how many.
CELL, PER_CELL = 12, 1
RADIUS = 14
BITS = 128
#: Grey levels by which a test's second point must be brighter; equal areas then test alike in every copy.
MARGIN = 1.0
TURNS = 36
#: First test of each table's key, and the tests in a key.
TABLES, KEY_BITS = (0, 32, 64, 96), 18
#: Tests in which two matching corners may differ.
MOST_APART = 18
MIN_VOTES = 5
SHIFT_BIN, TURN_BIN, SCALE_BIN = 16.0, 30.0, 0.67
#: Share of the corners that images alike as a whole have in common, and the cells in which those lie.
WHOLE, PLACE = 0.3, 16


# ---- pixels -----------------------------------------------------------------------------------------------------


def decode_image(data: bytes | None) -> np.ndarray | None:
    """Grey levels (0 to 255) as a float array, or None if the bytes are no image of a known kind."""
    try:
        if not data:
            return None
        if data[:2] in (b"P5", b"P6"):
            return _decode_pnm(bytes(data))
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _decode_png(bytes(data))
    except (ValueError, IndexError, zlib.error):
        pass
    return None


def _grey(px: np.ndarray) -> np.ndarray:
    px = px.astype(np.float32)
    return px[..., 0] if px.shape[-1] < 3 else px[..., :3] @ np.array([0.299, 0.587, 0.114], np.float32)


def _decode_pnm(data: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    width, height, _ = fields
    depth = 1 if data[:2] == b"P5" else 3
    return _grey(np.frombuffer(data, np.uint8, width * height * depth, at + 1).reshape(height, width, depth))


def _decode_png(data: bytes) -> np.ndarray:
    at, packed, palette, colour = 8, b"", None, None
    while at + 8 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, bits, colour, _, _, laced = (int.from_bytes(body[a:b], "big") for a, b in ((0, 4), (4, 8), (8, 9), (9, 10), (10, 11), (11, 12), (12, 13)))
            if bits != 8 or laced:
                raise ValueError("8 bits without interlacing only")
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed += body
        at += 12 + size
    if colour not in PNG_DEPTH:
        raise ValueError("no header of a known kind")
    depth = PNG_DEPTH[colour]
    rows = np.frombuffer(zlib.decompress(packed), np.uint8, height * (1 + width * depth)).reshape(height, -1)
    out = np.zeros((height + 1, (width + 1) * depth), np.uint8)
    for y in range(height):
        kind, line, up = rows[y, 0], rows[y, 1:].astype(np.int32), out[y].astype(np.int32)
        if kind == 0:
            out[y + 1, depth:] = line
        elif kind == 2:
            out[y + 1, depth:] = line + up[depth:] & 255
        elif kind == 1:
            out[y + 1, depth:] = (np.cumsum(line.reshape(width, depth), 0) & 255).ravel()
        elif kind in (3, 4):
            own = [0] * ((width + 1) * depth)
            for x in range(depth, (width + 1) * depth):
                a, b, c = own[x - depth], int(up[x]), int(up[x - depth])
                guess = (a + b) // 2 if kind == 3 else min((a, b, c), key=lambda v, p=a + b - c: abs(p - v))
                own[x] = (int(line[x - depth]) + guess) & 255
            out[y + 1] = own
        else:
            raise ValueError("unknown filter")
    px = out[1:, depth:].reshape(height, width, depth)
    return _grey(palette[px[..., 0]] if colour == 3 else px)


def encode_pgm(px: np.ndarray) -> bytes:
    px = np.clip(np.rint(px), 0, 255).astype(np.uint8)
    return b"P5\n%d %d\n255\n" % px.shape[::-1] + px.tobytes()


# ---- corners and descriptors ------------------------------------------------------------------------------------


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of side 2r + 1 of the last two axes, edges repeated."""
    p = np.pad(a, [(0, 0)] * (a.ndim - 2) + [(r + 1, r), (r + 1, r)], "edge").astype(np.float64).cumsum(-2).cumsum(-1)
    k = 2 * r + 1
    return ((p[..., k:, k:] - p[..., :-k, k:] - p[..., k:, :-k] + p[..., :-k, :-k]) / (k * k)).astype(np.float32)


def _resize(a: np.ndarray, factor: float) -> np.ndarray:
    """The last two axes at ``1 / factor`` of their size."""
    if factor == 1.0:
        return a
    h, w = int(a.shape[-2] / factor), int(a.shape[-1] / factor)
    y, x = (np.arange(h) + 0.5) * factor - 0.5, (np.arange(w) + 0.5) * factor - 0.5
    y0, x0 = np.clip(y.astype(int), 0, a.shape[-2] - 2), np.clip(x.astype(int), 0, a.shape[-1] - 2)
    fy, fx = (y - y0).astype(np.float32)[:, None], (x - x0).astype(np.float32)[None]
    rows = a[..., y0, :] * (1 - fy) + a[..., y0 + 1, :] * fy
    return rows[..., x0] * (1 - fx) + rows[..., x0 + 1] * fx


def _tests() -> tuple[np.ndarray, np.ndarray]:
    """Offsets of both points of every test for every turn: pairs drawn once from a fixed generator.

    The patch is turned so that its bright side lies along x; points of nearly equal x are as likely one way as the other.
    """
    rng, r, pairs = np.random.default_rng(20), RADIUS - 2, []
    while len(pairs) < BITS:
        p, q = rng.uniform(-r, r, (2, 2))
        q[0] = p[0] + rng.normal(0, 3)
        if max(p @ p, q @ q) <= r * r and np.hypot(*(p - q)) >= 4:
            pairs.append((p, q))
    turn = np.arange(TURNS) * 2 * math.pi / TURNS
    c, s = np.cos(turn)[:, None], np.sin(turn)[:, None]
    return tuple(np.rint(np.stack([c * p[None, :, 0] - s * p[None, :, 1], s * p[None, :, 0] + c * p[None, :, 1]], -1)).astype(int) for p in np.array(pairs).transpose(1, 0, 2))


TESTS = _tests()
_span = np.arange(-RADIUS + 2, RADIUS - 1)
DISC = np.array([(dx, dy) for dy in _span for dx in _span if dx * dx + dy * dy <= (RADIUS - 2) ** 2])
CORNER = np.dtype([("image", "<i8"), ("corner", "<i4"), ("x", "<f4"), ("y", "<f4"), ("level", "<i4"), ("turn", "<f4"), ("d0", "<i8"), ("d1", "<i8")])


def describe_stack(stack: np.ndarray) -> np.ndarray:
    """The corners of images of one size, ``stack[image, y, x]``: positions are offsets from the image's middle."""
    out = []
    if min(stack.shape[1:]) >= 2 * RADIUS + 8:
        for level, factor in enumerate(LEVELS):
            a = _box(_resize(stack, factor), 1)
            h, w = a.shape[1:]
            if min(h, w) < 2 * RADIUS + 4:
                break
            gy, gx = np.gradient(a, axis=(1, 2))
            xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
            r = xx * yy - xy * xy - np.float32(0.05) * (xx + yy) ** 2
            edge = RADIUS + 1
            inner = r[:, edge : h - edge, edge : w - edge]
            peak = inner > 50.0
            for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1)):
                for sign in (1, -1):
                    peak &= inner >= r[:, edge + sign * dy : h - edge + sign * dy, edge + sign * dx : w - edge + sign * dx]
            img, ys, xs = np.nonzero(peak)
            strength = inner[img, ys, xs]
            # The strongest of each cell, where cells cover the area in which corners lie.
            cells = [max(1, (n - 2 * edge) // CELL) for n in (h, w)]
            cell = (img * cells[0] + ys * cells[0] // (h - 2 * edge)) * cells[1] + xs * cells[1] // (w - 2 * edge)
            order = np.lexsort((xs, ys, -strength, cell))
            start = np.concatenate([[True], np.diff(cell[order]) != 0]) if len(order) else np.zeros(0, bool)
            rank = np.arange(len(order)) - np.maximum.accumulate(np.where(start, np.arange(len(order)), 0)) if len(order) else order
            img, ys, xs = (v[order[rank < PER_CELL]] for v in (img, ys + edge, xs + edge))
            if not len(img):
                continue
            around = a[img[:, None], ys[:, None] + DISC[:, 1], xs[:, None] + DISC[:, 0]]
            turn = np.arctan2((around * DISC[:, 1]).sum(1), (around * DISC[:, 0]).sum(1))
            k = np.rint(turn * TURNS / (2 * math.pi)).astype(int) % TURNS
            soft = _box(a, 1)
            one, two = (soft[img[:, None], ys[:, None] + t[k, :, 1], xs[:, None] + t[k, :, 0]] for t in TESTS)
            words = np.packbits(one + MARGIN < two, axis=1).view(">i8")
            rows = np.zeros(len(img), CORNER)
            rows["image"], rows["level"], rows["turn"] = img, level, np.degrees(turn)
            rows["x"], rows["y"] = (xs + 0.5) * factor - stack.shape[2] / 2, (ys + 0.5) * factor - stack.shape[1] / 2
            rows["d0"], rows["d1"] = words[:, 0], words[:, 1]
            out.append(rows)
    found = np.concatenate(out) if out else np.zeros(0, CORNER)
    found = found[np.argsort(found["image"], kind="stable")]
    first = np.searchsorted(found["image"], found["image"])
    found["corner"] = np.arange(len(found)) - first
    return found


#: ``place`` packs a corner's number (19 bits), level (3), turn in degrees (9) and offset from the middle in pixels (16 each).
DESCRIPTORS = "image_id long, place long, d0 long, d1 long"


def pack_places(found: np.ndarray) -> np.ndarray:
    out = found["corner"].astype(np.int64) % (1 << 19) << 3 | found["level"]
    out = out << 9 | np.rint(found["turn"]).astype(np.int64) % 360
    for c in ("x", "y"):
        out = out << 16 | np.clip(np.rint(found[c]).astype(np.int64) + (1 << 15), 0, (1 << 16) - 1)
    return out


def _unpacked(place) -> dict:
    bits = lambda at, n: F.shiftright(place, at).bitwiseAND(F.lit((1 << n) - 1))
    return {"y": bits(0, 16) - (1 << 15), "x": bits(16, 16) - (1 << 15), "turn": bits(32, 9), "level": bits(41, 3).cast("int"), "corner": bits(44, 19)}


def descriptors(images: DataFrame) -> DataFrame:
    """The corners of ``images(image_id, image)``, a row each."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                sizes: dict[tuple, list] = {}
                for i, data in zip(batch.column(0).slice(at, 64).to_pylist(), batch.column(1).slice(at, 64).to_pylist(), strict=True):
                    px = decode_image(data) if i is not None else None
                    if px is not None and px.size:
                        sizes.setdefault(px.shape, []).append((i, px.astype(np.float32)))
                for same in sizes.values():
                    found = describe_stack(np.stack([px for _, px in same]))
                    ids = np.array([i for i, _ in same], np.int64)[found["image"]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (ids, pack_places(found), found["d0"], found["d1"])], names=["image_id", "place", "d0", "d1"])

    return images.select(F.col("image_id").cast("long"), F.col("image").cast("binary")).mapInArrow(run, DESCRIPTORS)


# ---- matches ----------------------------------------------------------------------------------------------------


def _keys() -> list:
    """The key of each table, which names the table too."""
    word = lambda t: F.col("d0") if t < 64 else F.col("d1")
    cut = lambda t: F.shiftrightunsigned(word(t), 64 - KEY_BITS - t % 64).bitwiseAND(F.lit((1 << KEY_BITS) - 1))
    return [cut(t) + F.lit(k << KEY_BITS) for k, t in enumerate(TABLES)]


def whole_classes(corners: DataFrame) -> DataFrame:
    """``node, comp``: images of ``corners`` that are alike as a whole, in the same place; the class's smallest image."""
    parts = int(corners.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = _unpacked(F.col("place"))
    cell = [at["level"], *[F.floor(at[c] / PLACE) for c in ("x", "y")]]
    # Copies that are alike as a whole have enough equal keys in two of the tables.
    met = corners.select("image_id", at["corner"].cast("int").alias("corner"), F.explode(F.array(*[F.xxhash64(k, *cell) for k in _keys()[::2]])).alias("place")).repartition(parts, "place")
    total = corners.groupBy("image_id").agg(F.count_distinct("place").alias("all"))
    hubs = met.groupBy("place").agg(F.min("image_id").alias("hub"), F.max("image_id").alias("last")).where("hub < last").select("place", "hub")
    pairs = met.join(hubs, "place").where("image_id <> hub").groupBy("image_id", "hub").agg(F.count_distinct("corner").alias("n"))
    enough = pairs.where(F.col("n") >= MIN_VOTES).join(total, "image_id").where(F.col("n") >= WHOLE * F.col("all"))
    other = total.select(F.col("image_id").alias("hub"), F.col("all").alias("hub_all"))
    edges = materialize(enough.join(other, "hub").where(F.col("n") >= WHOLE * F.col("hub_all")).select(F.col("image_id").alias("a"), F.col("hub").alias("b")), "alike")
    classes = components(edges, "alike")
    # Images that met no member in enough corners meet the keys of all members of a class together, a row a class and key.
    known = met.join(classes.withColumnRenamed("node", "image_id"), "image_id").select("place", "comp").distinct()
    late = met.join(classes.select(F.col("node").alias("image_id")), "image_id", "left_anti").join(known, "place")
    late = late.groupBy("image_id", "comp").agg(F.count_distinct("corner").alias("n")).where(F.col("n") >= MIN_VOTES)
    late = late.join(total, "image_id").join(other, F.col("comp") == F.col("hub")).where(F.col("n") >= WHOLE * F.greatest("all", "hub_all"))
    return components(edges.unionByName(late.select(F.col("image_id").alias("a"), F.col("comp").alias("b"))), "alike")


def corner_matches(queries: DataFrame, corners: DataFrame, classes: DataFrame) -> DataFrame:
    """``query_id, class_id, q, e``: corners of queries and of index classes that match."""
    point = F.struct("place", "d0", "d1")
    named = corners.join(classes, F.col("image_id") == F.col("node"), "left").withColumn("key", F.explode(F.array(*_keys())))
    # Copies are brought together before they meet others: a class stands once under a key.
    grouped = named.where("comp is not null").groupBy("key", F.col("comp").alias("class_id")).agg(F.min(F.struct("image_id", point.alias("e"))).alias("m"))
    entries = named.where("comp is null").select("key", F.col("image_id").alias("class_id"), point.alias("e")).unionByName(grouped.select("key", "class_id", "m.e"))
    asked = queries.select(F.col("image_id").alias("query_id"), point.alias("q"), F.explode(F.array(*_keys())).alias("key"))
    apart = F.bit_count(F.col("q.d0").bitwiseXOR(F.col("e.d0"))) + F.bit_count(F.col("q.d1").bitwiseXOR(F.col("e.d1")))
    met = asked.join(entries, ["key"]).where(apart <= MOST_APART)
    return met.select("query_id", "class_id", F.col("q.place").alias("q"), F.col("e.place").alias("e")).distinct()


def voted(met: DataFrame, min_votes: int = MIN_VOTES) -> DataFrame:
    """``query_id, class_id, votes, turn, scale`` of the matches that agree on a shift, turn and scale."""
    enough = met.groupBy(F.col("query_id").alias("eq"), F.col("class_id").alias("ec")).agg(F.count_distinct("q").alias("n")).where(F.col("n") >= min_votes).select("eq", "ec")
    q, e = _unpacked(F.col("q")), _unpacked(F.col("e"))
    met = met.join(enough, (F.col("query_id") == F.col("eq")) & (F.col("class_id") == F.col("ec")), "left_semi")
    size = F.array(*[F.lit(x) for x in LEVELS])
    turn = F.pmod(q["turn"] - e["turn"], F.lit(360.0))
    ratio = F.get(size, q["level"]) / F.get(size, e["level"])
    c, s = F.cos(F.radians(turn)) * ratio, F.sin(F.radians(turn)) * ratio
    shift_x = q["x"] - (c * e["x"] - s * e["y"])
    shift_y = q["y"] - (s * e["x"] + c * e["y"])
    votes = met.select("query_id", "class_id", q["corner"].alias("cq"), (F.round(e["x"] / 3) * (1 << 20) + F.round(e["y"] / 3)).cast("long").alias("ce"), turn.alias("t"), F.log2(ratio).alias("z"), shift_x.alias("sx"), shift_y.alias("sy"))
    # Each vote counts in bins of grids that lie half a bin apart, so that no true cluster is cut in all of them.
    half = F.explode(F.array(*[F.struct(*[F.lit(i >> n & 1).alias("ijkl"[n]) for n in range(4)]) for i in range(16)]))
    placed = votes.withColumn("g", half).select(
        "query_id", "class_id", "cq", "ce", "t", "z", "g",
        F.floor(F.col("sx") / SHIFT_BIN + F.col("g.i") / 2).alias("bx"), F.floor(F.col("sy") / SHIFT_BIN + F.col("g.j") / 2).alias("by"),
        F.pmod(F.floor(F.col("t") / TURN_BIN + F.col("g.k") / 2), F.lit(int(360 / TURN_BIN))).alias("bt"), F.floor(F.col("z") / SCALE_BIN + F.col("g.l") / 2).alias("bz"),
    )
    bins = placed.groupBy("query_id", "class_id", "g", "bx", "by", "bt", "bz").agg(F.least(F.count_distinct("cq"), F.count_distinct("ce")).alias("votes"), F.avg(F.pmod(F.col("t") - TURN_BIN * F.col("bt") + 180, F.lit(360.0)) - 180 + TURN_BIN * F.col("bt")).alias("turn"), F.avg("z").alias("z"))
    best = bins.where(F.col("votes") >= min_votes).groupBy("query_id", "class_id").agg(F.max(F.struct("votes", F.round(F.pmod("turn", F.lit(360.0)), 0).alias("turn"), F.round(F.pow(F.lit(2.0), "z"), 2).alias("scale"))).alias("m"))
    return best.select("query_id", "class_id", "m.votes", "m.turn", "m.scale")


def search_copies(queries: DataFrame, index: DataFrame, min_votes: int = MIN_VOTES) -> tuple[DataFrame, DataFrame]:
    """Copies of the images ``queries(image_id, image)`` among ``index(image_id, image)``.

    Returns ``query_id, class_id, votes, turn, scale``, and the members of the classes that have several,
    ``image_id, class_id``; an image that is not there is its own class.
    """
    corners = materialize(descriptors(index), "corners")
    asked = materialize(descriptors(queries), "asked")
    classes = materialize(whole_classes(corners), "alike")
    free_shuffles(index.sparkSession)
    matches = materialize(corner_matches(asked, corners, classes), "matches")
    free_shuffles(index.sparkSession)
    for used in (corners, asked):
        drop_scratch(used)
    return materialize(voted(matches, min_votes), "copies"), classes.select(F.col("node").alias("image_id"), F.col("comp").alias("class_id"))


# ---- images of a table without any ------------------------------------------------------------------------------

SIDE = 112
#: The edits that make the queries, in turn.
EDITS = ("crop", "quarter turn", "small crop", "noise", "smaller", "turn", "larger", "blur")

_patterns: dict[int, np.ndarray] = {}


def patterns(n: int) -> np.ndarray:
    """``n`` fixed textures of unit variance: smoothed noise from a fixed generator."""
    if n not in _patterns:
        rng = np.random.default_rng(7)
        fields = [_box(_box(rng.normal(size=(SIDE, SIDE)), 2), 1) for _ in range(n)]
        _patterns[n] = np.array([((f - f.mean()) / f.std()).ravel() for f in fields], np.float32)
    return _patterns[n]


def render(vector: list[float] | None) -> np.ndarray | None:
    """A picture of a vector: its sum of fixed textures, so that near vectors look alike and others do not."""
    if not vector:
        return None
    v = np.nan_to_num(np.array([0.0 if x is None else x for x in vector], np.float32))
    size = float(np.linalg.norm(v))
    field = (v / size if size > 0 else v) @ patterns(len(v))
    return 128.0 + 45.0 * field.reshape(SIDE, SIDE)


def turned(px: np.ndarray, degrees: float) -> np.ndarray:
    """A picture turned about its middle, grey where nothing was."""
    h, w = px.shape
    y, x = np.mgrid[:h, :w]
    y, x, c, s = y - (h - 1) / 2, x - (w - 1) / 2, math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    x, y = c * x + s * y + (w - 1) / 2, c * y - s * x + (h - 1) / 2
    x0, y0 = np.clip(x.astype(int), 0, w - 2), np.clip(y.astype(int), 0, h - 2)
    fx, fy = x - x0, y - y0
    out = (px[y0, x0] * (1 - fx) + px[y0, x0 + 1] * fx) * (1 - fy) + (px[y0 + 1, x0] * (1 - fx) + px[y0 + 1, x0 + 1] * fx) * fy
    return np.where((x >= 0) & (x <= w - 1) & (y >= 0) & (y <= h - 1), out, 128.0)


def edit(px: np.ndarray, key: int) -> np.ndarray:
    """An edited copy of a picture: the key names the edit and where a crop lies."""
    kind, a, b = EDITS[key % len(EDITS)], key * 7 % 11, key * 5 % 11
    h, w = px.shape
    if kind == "noise":
        return px + np.random.default_rng(key).normal(0, 8, px.shape)
    if kind == "blur":
        return _box(_box(px, 1), 1)
    if kind == "turn":
        return turned(px, key * 37 % 360)
    if kind in ("smaller", "larger"):
        return _resize(px, 1.3 if kind == "smaller" else 0.8)
    if kind == "small crop":  # two fifths of the area
        return px[2 * a : h * 5 // 8 + 2 * a, 2 * b : w * 5 // 8 + 2 * b] * 1.1 - 9
    out = px[a : h - 14 + a, b : w - 14 + b] * 0.85 + 12
    return np.rot90(out) if kind == "quarter turn" else out


def _drawn(vectors: DataFrame, change) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                ids = batch.column(0).slice(at, 64).to_pylist()
                pictures = [render(v) for v in batch.column(1).slice(at, 64).to_pylist()]
                images = [None if px is None else encode_pgm(change(px, i)) for i, px in zip(ids, pictures, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(images, pa.binary())], names=["image_id", "image"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>")).mapInArrow(run, "image_id long, image binary")


def embedding_images(vectors: DataFrame) -> DataFrame:
    """``image_id, image``: the picture of each vector."""
    return _drawn(vectors, lambda px, i: px)


def edited_images(vectors: DataFrame, every: int = 20) -> DataFrame:
    """``image_id, image``: an edited copy of the picture of each vector whose id ``every`` divides."""
    return _drawn(vectors.where(F.col("vec_id") % every == 0), lambda px, i: edit(px, i // every))
