"""Images to pixels in one plan.

Headers are folded inside each image's row, scans are cut into restart intervals, and these are decoded, dequantized and
transformed batch by batch: all of it narrow, without an exchange. A scan of all components has whole MCUs, so its pixels
are made in the decoding task. Images whose components come in separate scans have one exchange, raster assembly by
tile, a key that is spread evenly however large an image is; a block goes there as 64 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bytes as B
from ..operators import blocks, huffman, segments, validate
from ..operators import markers as M

_RESTART = "\\xFF[\\xD0-\\xD7]"
_START_OF_SCAN = "\\xFF\\xDA"


def describe(images: DataFrame) -> DataFrame:
    return validate.describe(segments.parse(images))


def _last(tables: Column, before: Column, fits) -> Column:
    """The last table before a segment that fits (Q28); null if there is none."""
    return F.try_element_at(F.filter(tables, lambda t: (t["seq"] < before) & fits(t["t"])), F.lit(-1))["t"]


def intervals(described: DataFrame) -> DataFrame:
    """The restart intervals of all scans of decodable images (S8, Q16-Q18), as huffman.decode takes them."""
    rows = described.where("error IS NULL").select("image_id", "frame", "quants", "huffmans", "segs", F.explode("scan_list").alias("s"))
    parts = F.col("frame.components")
    h_max, v_max = F.array_max(F.transform(parts, lambda c: c["h"])), F.array_max(F.transform(parts, lambda c: c["v"]))
    rows = B.once(rows, h_max=h_max, v_max=v_max, width=F.col("frame.width"), height=F.col("frame.height"), comps=F.size(parts), single=F.size("s.scan.components") == 1)

    def part(c: Column) -> Column:
        place = F.array_position(F.transform("frame.components", lambda x: x["id"]), c["id"]).cast("int") - 1
        return B.let(F.struct(place.alias("place"), F.get("frame.components", place).alias("own")), lambda f: full(c, f["place"], f["own"]))

    def full(c: Column, place: Column, own: Column) -> Column:
        dc = _last(F.col("huffmans"), F.col("s.seq"), lambda t: (t["class"] == 0) & (t["dest"] == c["td"]))
        ac = _last(F.col("huffmans"), F.col("s.seq"), lambda t: (t["class"] == 1) & (t["dest"] == c["ta"]))
        q = _last(F.col("quants"), F.col("s.seq"), lambda t: t["tq"] == own["tq"])["q"]
        each = lambda x: F.when(F.col("single"), F.lit(1)).otherwise(x)
        return F.struct(place.alias("comp"), each(own["h"]).alias("h"), each(own["v"]).alias("v"), own["h"].alias("up_h"), own["v"].alias("up_v"), q.alias("q"), dc.alias("dc"), ac.alias("ac"))

    rows = B.once(rows, parts=F.transform("s.scan.components", part), pieces=F.split(B.latin(F.col("s.data")), _RESTART))
    up = lambda a, b: F.ceil(a / b).cast("int")
    first = F.get("parts", 0)
    across = F.when(F.col("single"), up(F.col("width") * first["up_h"], 8 * F.col("h_max"))).otherwise(up(F.col("width"), 8 * F.col("h_max")))
    down = F.when(F.col("single"), up(F.col("height") * first["up_v"], 8 * F.col("v_max"))).otherwise(up(F.col("height"), 8 * F.col("v_max")))
    dri = F.try_element_at(F.filter("segs", lambda x: (x["code"] == M.DRI) & (x["seq"] < F.col("s.seq"))), F.lit(-1))["payload"]
    rows = B.once(rows, mcus_across=across, total=across * down, each=B.be16(dri, 0), last_no=F.size("pieces") - 1)
    rows = rows.withColumn("each", F.when(F.col("each") > 0, F.col("each")).otherwise(F.col("total")))
    pieces = rows.select("*", F.posexplode("pieces").alias("interval_no", "piece")).where(F.col("interval_no") * F.col("each") < F.col("total"))
    # The last interval's row asks for all that is left, so lost restart markers show as a truncated scan.
    start = F.col("interval_no") * F.col("each")
    final = F.col("interval_no") == F.col("last_no")
    count = F.when(final, F.col("total") - start).otherwise(F.least(F.col("each"), F.col("total") - start))
    return pieces.select("image_id", start.cast("int").alias("first_mcu"), count.cast("int").alias("mcus"), "mcus_across", "width", "height", "h_max", "v_max", "comps", "parts", B.destuff(F.encode("piece", B.LATIN)).alias("data"))


PIXEL = "image_id string, y int, x int, r int, g int, b int"
TILE = f"image_id string, tile_y int, tile_x int, {huffman.GEOMETRY}, comp int, up_h int, up_v int, y int, x int, px binary"
#: MCUs whose pixels are made at once.
UNITS = 2048


def _rgb(planes: list[np.ndarray]) -> list[np.ndarray]:
    if len(planes) == 1:
        return planes * 3
    y, b, r = planes[0].astype(np.float64), planes[1] - 128.0, planes[2] - 128.0
    return [np.clip(np.floor(c + 0.5), 0, 255) for c in (y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b)]


def _spread(plane: np.ndarray, height: int, width: int) -> np.ndarray:
    """A plane [..., v * 8, h * 8] of samples on height by width pixels, by repetition (Q24)."""
    tall, wide = plane.shape[-2:]
    return plane[..., (np.arange(height) * tall // height)[:, None], np.arange(width) * wide // width]


def _pixel_rows(image_id: str, y: np.ndarray, x: np.ndarray, rgb: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([image_id] * len(y), pa.string()), *(pa.array(c.astype(np.int32)) for c in (y, x, *rgb))], names=["image_id", "y", "x", "r", "g", "b"])


def _whole_mcus(row: dict, coefs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The pixels of an interval of a scan of all components."""
    single = len(row["parts"]) == 1
    height, width = (8, 8) if single else (8 * row["v_max"], 8 * row["h_max"])
    each = [p["v"] * p["h"] for p in row["parts"]]
    quants = np.concatenate([np.array([p["q"]] * n) for p, n in zip(row["parts"], each, strict=True)])
    for start in range(0, row["mcus"], UNITS):
        n = min(UNITS, row["mcus"] - start)
        own = coefs[start * len(quants) : (start + n) * len(quants)]
        px = blocks.samples(own, np.tile(quants, (n, 1))).reshape(n, len(quants), 8, 8)
        planes: list[np.ndarray] = [px[:0]] * row["comps"]
        for k, part in enumerate(row["parts"]):
            first = sum(each[:k])
            grid = px[:, first : first + each[k]].reshape(n, part["v"], part["h"], 8, 8)
            planes[part["comp"]] = _spread(grid.transpose(0, 1, 3, 2, 4).reshape(n, part["v"] * 8, part["h"] * 8), height, width)
        unit = row["first_mcu"] + start + np.arange(n)
        y = np.broadcast_to((unit // row["mcus_across"] * height)[:, None, None] + np.arange(height)[:, None], (n, height, width))
        x = np.broadcast_to((unit % row["mcus_across"] * width)[:, None, None] + np.arange(width), (n, height, width))
        inside = (y < row["height"]) & (x < row["width"])
        yield _pixel_rows(row["image_id"], y[inside], x[inside], [c[inside] for c in _rgb(planes)])


def whole_pixels(found: DataFrame) -> DataFrame:
    """PIXEL rows of intervals whose scans hold all components, without an exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, coefs in huffman.decoded(batches):
            if not isinstance(coefs, ValueError):  # else a row of image_errors
                yield from _whole_mcus(row, coefs)

    return found.select(*huffman.COLUMNS).mapInArrow(run, PIXEL)


def tiles(found: DataFrame) -> DataFrame:
    """TILE rows, one a block, of intervals whose scans hold some of the components."""
    names = [f.split()[0] for f in TILE.split(", ")]

    def rows(row: dict, coefs: np.ndarray) -> Iterator[pa.RecordBatch]:
        part, block_y, block_x = huffman.places(row)
        for start in range(0, len(coefs), UNITS):
            own = slice(start, start + UNITS)
            n = len(part[own])
            of_part = lambda key: np.array([p[key] for p in row["parts"]])[part[own]]  # noqa: B023, E731
            px = blocks.samples(coefs[own], np.array([p["q"] for p in row["parts"]])[part[own]])
            up_v, up_h = of_part("up_v"), of_part("up_h")
            made = {"tile_y": block_y[own] // up_v, "tile_x": block_x[own] // up_h, "comp": of_part("comp"), "up_h": up_h, "up_v": up_v, "y": block_y[own] % up_v, "x": block_x[own] % up_h}
            made |= {k: np.full(n, row[k]) for k in ("width", "height", "h_max", "v_max", "comps")}
            columns = {k: pa.array(v.astype(np.int32)) for k, v in made.items()} | {"image_id": pa.array([row["image_id"]] * n, pa.string()), "px": pa.array([x.tobytes() for x in px], pa.binary())}
            yield pa.RecordBatch.from_arrays([columns[k] for k in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, coefs in huffman.decoded(batches):
            if not isinstance(coefs, ValueError):
                yield from rows(row, coefs)

    return found.select(*huffman.COLUMNS).mapInArrow(run, TILE)


def assembled(blocks_of: DataFrame) -> DataFrame:
    """PIXEL rows of TILE rows (Q24, Q25): tiles are assembled, chroma is spread by repetition, edges are cropped.

    A pixel that a component has no block for is left out: its interval is a row of image_errors.
    """
    keys = ["image_id", "tile_y", "tile_x", "width", "height", "h_max", "v_max", "comps"]
    own = F.struct("comp", "up_h", "up_v", "y", "x", "px")
    tiled = blocks_of.groupBy(*keys).agg(F.collect_list(own).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                made = [m for m in map(_tile, batch.slice(start, 256).to_pylist()) if len(m)]
                if made:
                    yield pa.Table.from_batches(made).combine_chunks().to_batches()[0]

    return tiled.mapInArrow(run, PIXEL)


def _tile(t: dict) -> pa.RecordBatch:
    height, width = 8 * t["v_max"], 8 * t["h_max"]
    grids = [np.zeros((0, 0))] * t["comps"]
    for part in t["parts"]:
        c = part["comp"]
        if not grids[c].size:
            grids[c] = np.full((8 * part["up_v"], 8 * part["up_h"]), np.nan)
        grids[c][8 * part["y"] : 8 * part["y"] + 8, 8 * part["x"] : 8 * part["x"] + 8] = np.frombuffer(part["px"], np.uint8).reshape(8, 8)
    planes = [_spread(g, height, width) if g.size else np.full((height, width), np.nan) for g in grids]
    y, x = np.mgrid[0:height, 0:width]
    y, x = y + t["tile_y"] * height, x + t["tile_x"] * width
    there = (y < t["height"]) & (x < t["width"]) & ~np.isnan(planes).any(0)
    return _pixel_rows(t["image_id"], y[there], x[there], _rgb([p[there] for p in planes]))


def decode_images(images: DataFrame) -> DataFrame:
    """PIXEL rows of all images that can be decoded; the others are in `image_errors`.

    The images are read once for scans of all components and once for separate scans. The second time only those are
    parsed whose bytes hold two start-of-scan markers, as images of separate scans must; compressed images are smaller than what an exchange of their blocks would move.
    """
    whole = F.size("parts") == F.col("comps")
    several = F.regexp_count(B.latin(F.col("content")), F.lit(_START_OF_SCAN)) > 1
    described = describe(images)
    shot = whole_pixels(intervals(described).where(whole))
    # The optimizer moves the second filter below the parse.
    return shot.unionByName(assembled(tiles(intervals(described.where(several)).where(~whole))))


def image_errors(images: DataFrame) -> DataFrame:
    """image_id, stage and code of every image with a damaged header or scan."""
    described = describe(images)
    broken = huffman.errors(intervals(described)).select("image_id", F.lit("scan").alias("stage"), F.col("error").alias("code")).distinct()
    return validate.errors(described).unionByName(broken)


def grayscale(shot: DataFrame) -> DataFrame:
    """Pixels with `gray` (M8)."""
    from ..functions.pixels import rgb_to_gray

    return shot.withColumn("gray", rgb_to_gray(F.col("r"), F.col("g"), F.col("b")))
