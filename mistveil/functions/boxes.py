"""Boxes, image ids and the image cache as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
PAD, MAX_SIDE, MIN_SIDE = 0.1, 1024, 32
TTL_MS, PRUNE_MS, MAX_RECORDS = 30 * 60 * 1000, 24 * 60 * 60 * 1000, 300
FIT_STEPS = ((0.7, 1.0), (0.55, 1.0), (0.55, 0.75), (0.5, 0.5), (0.5, 0.35))
STRIDES, ANCHORS, INPUT_SIDE = (8, 16, 32), 2, 640


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def pad_box(b: Column, width: Column, height: Column) -> Column:
    """The box grown by a tenth on each side, on whole pixels, inside the image; null if nothing is left."""
    dx, dy = b["w"] * PAD, b["h"] * PAD
    x0, y0 = F.greatest(F.lit(0), F.floor(b["x"] - dx)), F.greatest(F.lit(0), F.floor(b["y"] - dy))
    x1, y1 = F.least(width, F.ceil(b["x"] + b["w"] + dx)), F.least(height, F.ceil(b["y"] + b["h"] + dy))
    sound = (b["w"] > 0) & (b["h"] > 0) & (x1 > x0) & (y1 > y0)
    return F.when(sound, box(*[c.cast("int") for c in (x0, y0, x1 - x0, y1 - y0)]))


def painted(boxes: Column, width: Column, height: Column) -> Column:
    """How many boxes leave something to paint."""
    return F.size(F.filter(boxes, lambda b: pad_box(b, width, height).isNotNull()))


def _scaled(w: Column, h: Column, scale: Column) -> Column:
    part = lambda v: F.greatest(F.lit(1), F.floor(v * scale + 0.5)).cast("int")
    return F.struct(part(w).alias("w"), part(h).alias("h"))


def fit_within(w: Column, h: Column, longest: int = MAX_SIDE) -> Column:
    """Size shrunk so that the longer side is at most longest; never enlarged."""
    small = F.struct(w.cast("int").alias("w"), h.cast("int").alias("h"))
    return F.when(F.greatest(w, h) <= longest, small).otherwise(_scaled(w, h, F.lit(float(longest)) / F.greatest(w, h)))


def letterbox(w: Column, h: Column, side: int = INPUT_SIDE) -> Column:
    scale = F.lit(float(side)) / F.greatest(w, h)
    return F.struct(scale.alias("scale"), F.floor(w * scale + 0.5).cast("int").alias("width"), F.floor(h * scale + 0.5).cast("int").alias("height"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 if the union is empty."""
    side = lambda p, s: F.greatest(F.lit(0.0), F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p]))
    inter = side("x", "w") * side("y", "h")
    union = a["w"] * a["h"] + b["w"] * b["h"] - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def union_box(boxes: Column) -> Column:
    """The smallest box around all boxes."""
    low = lambda p: F.array_min(F.transform(boxes, lambda b: b[p]))
    high = lambda p, s: F.array_max(F.transform(boxes, lambda b: b[p] + b[s]))
    return box(low("x"), low("y"), high("x", "w") - low("x"), high("y", "h") - low("y"))


def corner_box(corners: Column) -> Column:
    """Axis-parallel box around corner points (x, y)."""
    return union_box(F.transform(corners, lambda c: box(c["x"], c["y"], c["x"] * 0, c["y"] * 0)))


def nms(detections: Column, threshold: float = 0.4) -> Column:
    """Greedy suppression over an array of (score, x, y, w, h): best first, dropped if it overlaps a kept one by more."""
    ordered = F.sort_array(detections, asc=False)
    none = F.slice(ordered, F.lit(1), F.lit(0))
    return F.aggregate(ordered, none, lambda kept, d: F.when(F.exists(kept, lambda k: iou(k, d) > threshold), kept).otherwise(F.array_append(kept, d)))


def decode_level(scores: Column, offsets: Column, stride: int, scale: Column, width: Column, height: Column, min_score: float = 0.3) -> Column:
    """Face boxes of one level in pixels of the image: anchors in row order, two a cell; offsets (left, top, right, bottom) in strides from the cell.

    scale is the letterbox's. Boxes are cut to the image; those without area
    lay in the padding and go.
    """
    side = INPUT_SIDE // stride
    cell = lambda i: F.floor(i / ANCHORS)

    def decoded(o: Column, i: Column) -> Column:
        cx, cy = (cell(i) % side) * stride, F.floor(cell(i) / side) * stride
        x0, y0 = F.greatest(F.lit(0.0), (cx - o["left"] * stride) / scale), F.greatest(F.lit(0.0), (cy - o["top"] * stride) / scale)
        x1, y1 = F.least(width, (cx + o["right"] * stride) / scale), F.least(height, (cy + o["bottom"] * stride) / scale)
        return F.struct(F.get(scores, i).alias("score"), x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))

    return F.filter(F.transform(offsets, decoded), lambda d: (d["score"] >= min_score) & (d["w"] > 0) & (d["h"] > 0))


def img_id(src: Column, w: Column, h: Column) -> Column:
    return F.substring(F.sha2(F.concat(src, F.lit("|"), w.cast("string"), F.lit("x"), h.cast("string")).cast("binary"), 256), 1, 32)


def is_inline(src: Column) -> Column:
    return F.lower(F.substring(src, 1, 5)).isin("data:", "blob:")


def pixel_id(hashed: Column) -> Column:
    return F.concat(F.lit("px-"), F.substring(hashed, 1, 32))


def cache_key(image: Column, face: Column, ocr: Column, qr: Column) -> Column:
    """Key of an image for a set of detector models; null if one is missing."""
    return F.concat(image, F.lit("|"), face, F.lit(";"), ocr, F.lit(";"), qr)


def cache_decision(record: Column, now: Column) -> Column:
    """miss, fresh, conditional or rehash for a cache record (null: none)."""
    validators = (record["acquired_via"] == "fetch") & (record["etag"].isNotNull() | record["last_modified"].isNotNull())
    return F.when(record.isNull(), "miss").when(now - record["validated_at"] <= TTL_MS, "fresh").when(validators, "conditional").otherwise("rehash")


def revalidation(not_modified: Column, new_hash: Column, old_hash: Column) -> Column:
    return F.when(F.coalesce(not_modified, F.lit(False)) | F.coalesce(new_hash == old_hash, F.lit(False)), "bump").otherwise("reprocess")


def fit_choice(sizes: Column, most: Column) -> Column:
    """Position of the first size that fits (0: as it is, then the steps of FIT_STEPS); null if none does."""
    return F.nullif(F.coalesce(F.array_position(F.transform(sizes, lambda s: s <= most), True), F.lit(0)), F.lit(0)) - 1


def image_rank(image: Column, visible: Column, in_view: Column, b: Column, viewport: Column) -> Column:
    """(kind, priority, area): skip, too_small or queue; priority 0 in the viewport, 1 within one height of it, 2 beyond."""
    near = (b["y"] < 2 * viewport) & (b["y"] + b["h"] > -viewport)
    kind = F.when(image.isNull() | ~visible, "skip").when((b["w"] < MIN_SIDE) | (b["h"] < MIN_SIDE), "too_small").otherwise("queue")
    priority = F.when(kind != "queue", F.lit(None)).when(in_view, 0).when(near, 1).otherwise(2)
    return F.struct(kind.alias("kind"), priority.cast("int").alias("priority"), F.when(kind == "queue", b["w"] * b["h"]).alias("area"))
