"""Scalar functions of media rows, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration_bucket(seconds: Column) -> Column:
    """Half-open buckets; null stays null."""
    return F.when(seconds < 30, "<30s").when(seconds < 120, "30s-2m").when(seconds < 600, "2m-10m").when(seconds >= 600, "10m+")


def orientation(width: Column, height: Column) -> Column:
    """Null where a side is null or 0."""
    return F.when((width > 0) & (height > 0), F.when(width > height, "landscape").when(height > width, "portrait").otherwise("square"))


def ingest_orientation(width: Column, height: Column) -> Column:
    """At ingest unknown sizes count as landscape."""
    return F.coalesce(orientation(width, height), F.lit("landscape"))


def frame_rate(fraction: Column) -> Column:
    """30000/1001 or 25; a zero denominator gives null."""
    p = F.split(fraction, "/")
    return F.when(F.size(p) == 2, F.try_divide(F.try_element_at(p, F.lit(1)).try_cast("double"), F.try_element_at(p, F.lit(2)).try_cast("double"))).otherwise(fraction.try_cast("double"))


def rotation(degrees: Column) -> Column:
    return F.pmod(F.abs(degrees), F.lit(360))


def parent_folder(path: Column) -> Column:
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def person_from_path(path: Column) -> Column:
    """Of a relative path: the folder below library or _inbound_videos; else null."""
    p = F.split(path, "/")
    return F.when((F.size(p) >= 2) & p[0].isin("library", "_inbound_videos"), p[1])


#: Ratings of the catalog and the maps that lead to them.
RATINGS = ("unrated", "sfw", "suggestive", "nsfw")
RATING_MAP = {"general": "sfw", "sensitive": "suggestive", "questionable": "suggestive", "explicit": "nsfw"}
CLASS_MAP = {"safe": "sfw", "normal": "sfw", "drawing": "sfw", "sexy": "suggestive", "porn": "nsfw", "hentai": "nsfw"}


def mapped(value: Column, table: dict[str, str], default: str = "unrated") -> Column:
    """Looked up trimmed and lower-cased."""
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, F.lower(F.trim(value))), F.lit(default))


def rating_from_path(path: Column) -> Column:
    """The third part below library, the second below _unsorted, if it is a rating; else unrated."""
    p = F.split(path, "/")
    bucket = F.when((p[0] == "library") & (F.size(p) >= 3), F.try_element_at(p, F.lit(3))).when((p[0] == "_unsorted") & (F.size(p) >= 2), F.try_element_at(p, F.lit(2)))
    return F.when(bucket.isin(*RATINGS), bucket).otherwise("unrated")


def argmax_label(probabilities: Column, table: dict[str, str] = CLASS_MAP) -> Column:
    """Label of a map's largest value, mapped to a rating; among equals the first key."""
    best = F.array_max(F.transform(F.map_entries(probabilities), lambda e, i: F.struct(e["value"].alias("p"), (-i).alias("i"), e["key"].alias("k"))))
    return mapped(best["k"], table)


def slug(text: Column) -> Column:
    """File-system-safe: blanks become _, anything but letters, digits, _ and - goes; nothing left is unknown."""
    out = F.regexp_replace(F.replace(F.trim(text), F.lit(" "), F.lit("_")), r"(?U)[^\w\-]", "")
    return F.when(out == "", "unknown").otherwise(out)


#: File kinds by extension.
IMAGE_EXT = ("jpg", "jpeg", "png", "gif", "webp", "bmp", "heic")
VIDEO_EXT = ("mp4", "mov", "webm", "mkv", "m4v", "avi")
JUNK_NAMES = (".ds_store", "thumbs.db", "ehthumbs.db")
JUNK_EXT = ("txt",)
JUNK_FOLDER = "__macosx"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def file_kind(path: Column) -> Column:
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    ext = extension(path)
    junk = name.isin(*JUNK_NAMES) | name.startswith("._") | F.array_contains(F.split(path, "/"), JUNK_FOLDER) | ext.isin(*JUNK_EXT)
    return F.when(junk, "junk").when(ext.isin(*IMAGE_EXT), "image").when(ext.isin(*VIDEO_EXT), "video").otherwise("other")


def resolved(path: Column, root: str) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", F.lit(root.rstrip("/")), path))


def relative(path: Column, root: str) -> Column:
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).otherwise(path)


def vtt_time(seconds: Column) -> Column:
    """HH:MM:SS.mmm"""
    ms = F.round(seconds * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def midpoint(start: Column, end: Column) -> Column:
    """Of a scene; the start where it has no length."""
    return F.when(end > start, (start + end) / 2).otherwise(start)


def sprite_count(duration: Column, interval: float) -> Column:
    """Frames sampled, rounded half up; 0 for a clip shorter than half an interval, 1 where the duration isn't known."""
    return F.when(duration > 0, F.floor(duration / interval + 0.5)).otherwise(1).cast("long")


def tile_height(width: int, source_width: Column, source_height: Column) -> Column:
    """A tile's even height at this width: the source's shape, 16 to 9 where that isn't known; halves round to even, odd heights go up."""
    known = (source_width > 0) & (source_height > 0)
    h = F.when(known, F.bround(width * source_height / source_width)).otherwise(F.bround(F.lit(width * 9 / 16))).cast("long")
    return h + h % 2


def xywh_to_corners(box: Column) -> Column:
    return F.array(box[0], box[1], box[0] + box[2], box[1] + box[3])


def regions(detections: Column) -> Column:
    """label, score (4 decimals), box as corners of each detection (class, score, box as x, y, width, height)."""
    return F.transform(detections, lambda d: F.struct(d["class"].alias("label"), F.round(d["score"], 4).alias("score"), xywh_to_corners(d["box"]).alias("box")))


#: Labels of faces.
FACE_LABELS = ("face", "face_f", "face_m")


def face_regions(found: Column, labels: tuple[str, ...] = FACE_LABELS) -> Column:
    """Regions whose label is one of these in any case and whose box has an area."""
    return F.filter(found, lambda r: F.lower(r["label"]).isin(*(x.lower() for x in labels)) & (r["box"][2] > r["box"][0]) & (r["box"][3] > r["box"][1]))


def relative_path(slug: Column, filename: Column, media: Column) -> Column:
    """Where a new file goes: library/<person>/videos or _unsorted; files of nobody below _unsorted."""
    return F.concat_ws("/", F.when(slug == "_unsorted", "_unsorted").otherwise("library"), slug, F.when(media == "video", "videos").otherwise("_unsorted"), filename)


def sample_times(duration: Column, scenes: Column, n: int = 12) -> Column:
    """Times at which a thumbnail is looked for: the scenes' midpoints (of four or more without the first and the last), else n points from 8 to 92 percent; 0 for an empty clip."""
    mids = F.transform(scenes, lambda s: (s["start"] + s["end"]) / 2.0)
    inner = F.when(F.size(mids) >= 4, F.slice(mids, F.lit(2), F.greatest(F.size(mids) - 2, F.lit(0)))).otherwise(mids)
    even = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: duration * 0.08 + (duration * 0.92 - duration * 0.08) * i / (n - 1))
    return F.when(F.size(scenes) > 0, inner).when(duration <= 0, F.array(F.lit(0.0))).otherwise(even)


def sprite_cues(url: Column, count: Column, interval: float, cols: int, width: int, height: int) -> Column:
    """WebVTT text of a sprite sheet: cue i shows tile i, row by row, for one interval."""
    def cue(i):
        at = F.concat(vtt_time(i * F.lit(float(interval))), F.lit(" --> "), vtt_time((i + 1) * F.lit(float(interval))))
        box = F.concat_ws(",", (i % cols * width).cast("string"), (F.floor(i / cols) * height).cast("string"), F.lit(str(width)), F.lit(str(height)))
        return F.concat(at, F.lit("\n"), url, F.lit("#xywh="), box, F.lit("\n"))

    cues = F.when(count > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(count.cast("long") - 1, F.lit(0))), cue)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(F.lit("WEBVTT"), F.lit("")), cues), "\n")


#: The parts of a probe's JSON that a video row needs.
PROBE = "format struct<duration:string,bit_rate:string>, streams array<struct<codec_type:string,codec_name:string,duration:string,width:string,height:string,r_frame_rate:string,avg_frame_rate:string,tags:struct<rotate:string>,side_data_list:array<struct<rotation:string>>>>"


def probed(text: Column) -> Column:
    """duration, width, height (as shown), fps, codec, bitrate, has_audio of a probe's JSON; null where it doesn't parse (such videos are quarantined)."""
    p = F.from_json(text, PROBE)
    v = F.try_element_at(F.filter(p["streams"], lambda s: s["codec_type"] == "video"), F.lit(1))
    whole = lambda x: x.try_cast("int")
    w, h = whole(v["width"]), whole(v["height"])
    both = w.isNotNull() & h.isNotNull()
    turn = F.coalesce(F.try_element_at(F.filter(F.transform(v["side_data_list"], lambda d: d["rotation"].try_cast("double")), lambda r: r.isNotNull()), F.lit(-1)), v["tags"]["rotate"].try_cast("double"), F.lit(0.0)).cast("int")
    swap = rotation(turn).isin(90, 270)
    return F.when(p["streams"].isNotNull() | p["format"].isNotNull(), F.struct(
        F.coalesce(p["format"]["duration"].try_cast("double"), v["duration"].try_cast("double")).alias("duration"),
        F.when(both, F.when(swap, h).otherwise(w)).alias("width"), F.when(both, F.when(swap, w).otherwise(h)).alias("height"),
        F.coalesce(frame_rate(v["r_frame_rate"]), frame_rate(v["avg_frame_rate"])).alias("fps"), v["codec_name"].alias("codec"),
        p["format"]["bit_rate"].try_cast("int").alias("bitrate"),
        F.coalesce(F.exists(p["streams"], lambda s: s["codec_type"] == "audio"), F.lit(False)).cast("int").alias("has_audio")))


def run_key(explicit: Column, parts: list[Column], config: Column) -> Column:
    """The given key if it isn't empty, else those parts that are there, joined, else a hash of the configuration (a map) as JSON with its keys in order."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(config)))
    return F.coalesce(F.nullif(explicit, F.lit("")), F.nullif(F.concat_ws("|", *parts), F.lit("")), F.concat(F.lit("auto:"), F.substr(F.sha2(F.to_json(ordered), 256), F.lit(1), F.lit(16))))


def json_object_in(text: Column) -> Column:
    """From the first { to the last }, else null."""
    first = F.instr(text, "{")
    last = F.length(text) - F.instr(F.reverse(text), "}") + 1
    return F.when((first > 0) & (F.instr(text, "}") > 0) & (last > first), F.substr(text, first, last - first + 1))


def validated(category: Column, value: Column, enums: dict[str, list[str]], remaps: dict[str, dict[str, str]]) -> Column:
    """struct<value, note>: a category without an enum passes as it is; else exact, remapped (note REMAP) or the first allowed (note CLAMP)."""
    out, note = value, F.lit(None).cast("string")
    for name, allowed in enums.items():
        clean = F.lower(F.trim(value))
        table = remaps.get(name) or {"": ""}
        to = F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), clean)
        to = F.nullif(to, F.lit(""))
        said = F.when(clean.isin(*allowed), None).when(to.isNotNull(), F.format_string(f"REMAP {name}: '%s' → '%s'", value, to)).otherwise(F.format_string(f"CLAMP {name}: '%s' → '{allowed[0]}' (default)", value))
        fixed = F.when(clean.isin(*allowed), clean).otherwise(F.coalesce(to, F.lit(allowed[0])))
        out, note = F.when(category == name, fixed).otherwise(out), F.when(category == name, said).otherwise(note)
    return F.struct(out.alias("value"), note.alias("note"))


def corrected(value: Column, allowed: list[str], remap: dict[str, str]) -> Column:
    """Exact, else remapped, else the first allowed."""
    clean = F.lower(F.trim(value))
    table = F.create_map(*(F.lit(x) for kv in remap.items() for x in kv)) if remap else None
    to = F.try_element_at(table, clean) if remap else F.lit(None).cast("string")
    return F.coalesce(F.when(clean.isin(*allowed), clean), F.when(to.isin(*allowed), to), F.lit(allowed[0]))


def crop_rectangle(box: Column, width: Column, height: Column, padding: float = 0.6, aspect: float | None = None) -> Column:
    """Pixels [x1, y1, x2, y2] around a normalised face box [x, y, w, h]: padded on all sides, widened to aspect if given, shifted into the frame, never empty."""
    w = F.greatest(F.lit(1.0), box[2] * width) * (1 + 2 * padding)
    h = F.greatest(F.lit(1.0), box[3] * height) * (1 + 2 * padding)
    if aspect:
        w, h = F.greatest(w, h * aspect), F.greatest(h, w / aspect)
    w, h = F.least(w, width.cast("double")), F.least(h, height.cast("double"))
    x = F.least(F.greatest(F.lit(0.0), (box[0] + box[2] / 2) * width - w / 2), width - w)
    y = F.least(F.greatest(F.lit(0.0), (box[1] + box[3] / 2) * height - h / 2), height - h)
    x1, y1 = F.rint(x), F.rint(y)
    return F.array(x1, y1, F.least(width.cast("double"), F.greatest(x1 + 1, F.rint(x + w))), F.least(height.cast("double"), F.greatest(y1 + 1, F.rint(y + h))))


def sprite_rows(count: Column, cols: int) -> Column:
    return F.ceil(count / cols).cast("long")


def first_rating(tags: Column, category: str = "rating") -> Column:
    """Value of the first tag (category, value) of a category; null without one."""
    return F.try_element_at(F.filter(tags, lambda t: t["category"] == category), F.lit(1))["value"]


def answered_tags(text: Column) -> Column:
    """Map of category to values in a model's free text: its JSON object; null where there is none or it doesn't parse."""
    return F.from_json(json_object_in(text), "map<string,array<string>>")


def place(name: Column, admin1: Column, admin2: Column, cc: Column, lat: Column, lon: Column) -> Column:
    """struct of a place: texts that are missing become empty, coordinates that aren't numbers null."""
    texts = {"name": name, "admin1": admin1, "admin2": admin2, "cc": cc}
    return F.struct(*(F.coalesce(v, F.lit("")).alias(k) for k, v in texts.items()), lat.try_cast("double").alias("lat"), lon.try_cast("double").alias("lon"))


#: Weights of a frame's cues, and where two of them are full.
CUE_WEIGHTS = {"sharpness": 0.35, "colour": 0.20, "prominence": 0.25, "exposure": 0.20}
FULL_SHARPNESS, FULL_COLOUR = 1000.0, 80.0


def proxy_score(sharpness: Column, colour: Column, prominence: Column, brightness: Column) -> Column:
    """Looks of a frame in 0 to 1 from its cues: each capped, exposure best at a middle brightness of 128."""
    cues = {"sharpness": F.least(sharpness / FULL_SHARPNESS, F.lit(1.0)), "colour": F.least(colour / FULL_COLOUR, F.lit(1.0)), "prominence": prominence, "exposure": 1 - F.abs(brightness - 128) / 128}
    out = F.lit(0.0)
    for k, v in cues.items():
        out = out + CUE_WEIGHTS[k] * v
    return out
