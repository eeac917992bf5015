"""Catalog filters: AND across categories, OR within one, as semi-joins that Catalyst can order and broadcast."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_specs(specs: list[str] | None) -> dict[str, list[str]]:
    """category:value strings grouped by category; split at the first colon, trimmed, blanks and malformed ones dropped."""
    out: dict[str, list[str]] = {}
    for s in specs or []:
        category, colon, value = s.partition(":")
        category, value = category.strip(), value.strip()
        if colon and category and value and value not in out.setdefault(category, []):
            out[category].append(value)
    return {c: v for c, v in out.items() if v}


def parse_specs_strict(specs: list[str] | None) -> dict[str, list[str]]:
    """As parse_specs, but a spec without colon or category is an error."""
    for s in specs or []:
        if ":" not in s or not s.partition(":")[0].strip():
            raise ValueError(f"a filter must be category:value, not {s!r}")
    return parse_specs(specs)


@dataclass(frozen=True)
class FilterSpec:
    """What a search asks for; viewer None sees all."""

    tags: dict[str, list[str]] = field(default_factory=dict)
    labels: dict[str, list[str]] = field(default_factory=dict)
    person: str | None = None
    processed: bool | None = None
    rating: str | None = None
    viewer: int | None = None


def viewer_of(user: dict | None) -> int | None:
    """Nobody and admins are unscoped."""
    return None if user is None or user.get("role") == "admin" else user["id"]


def owned(assets: DataFrame, viewer: int | None) -> DataFrame:
    """Rows that the viewer owns or that nobody does."""
    return assets if viewer is None else assets.where((F.col("owner_id") == viewer) | F.col("owner_id").isNull())


def owned_children(children: DataFrame, assets: DataFrame, viewer: int | None, key: str = "image_id") -> DataFrame:
    """Rows of a child table whose asset the viewer sees; without scope no join is made."""
    if viewer is None:
        return children
    return children.join(owned(assets, viewer).select(F.col("id").alias(key)), key, "left_semi")


def with_tag(assets: DataFrame, tags: DataFrame, category: str, values: list[str], key: str = "image_id") -> DataFrame:
    hits = tags.where((F.col("category") == category) & F.col("value").isin(values)).select(F.col(key).alias("id"))
    return assets.join(hits, "id", "left_semi")


def with_label(assets: DataFrame, labels: DataFrame, set_name: str, values: list[str]) -> DataFrame:
    hits = labels.where((F.col("set_name") == set_name) & F.col("value").isin(values)).select(F.col("asset_id").alias("id"))
    return assets.join(hits, "id", "left_semi")


def with_rating(assets: DataFrame, tags: DataFrame, labels: DataFrame, rating: str) -> DataFrame:
    """Label of the set Rating, or machine tag rating."""
    by_label = labels.where((F.col("set_name") == "Rating") & (F.col("value") == rating)).select(F.col("asset_id").alias("id"))
    by_tag = tags.where((F.col("category") == "rating") & (F.col("value") == rating)).select(F.col("image_id").alias("id"))
    return assets.join(by_label.unionByName(by_tag), "id", "left_semi")


def candidates(assets: DataFrame, tags: DataFrame, labels: DataFrame, spec: FilterSpec) -> DataFrame:
    """assets that meet every part of spec."""
    out = owned(assets, spec.viewer)
    if spec.person is not None:
        out = out.where(F.col("person") == spec.person)
    if spec.processed is not None:
        out = out.where(F.col("processed") == spec.processed)
    for category, values in spec.tags.items():
        out = with_tag(out, tags, category, values)
    for set_name, values in spec.labels.items():
        out = with_label(out, labels, set_name, values)
    return out if spec.rating is None else with_rating(out, tags, labels, spec.rating)


def list_filter(assets: DataFrame, tags: DataFrame, specs: list[tuple[str, str]]) -> DataFrame:
    """Every spec must hold, those of one category too."""
    for category, value in specs:
        assets = with_tag(assets, tags, category, [value])
    return assets


def substring(assets: DataFrame, tags: DataFrame, q: str) -> DataFrame:
    """Assets with a tag, where q (its % and _ are wildcards) is in some tag's value or in the person; untagged assets never match."""
    t = tags.select(F.col("image_id").alias("id"), "value")
    hits = assets.select("id", "person").join(t, "id").where(F.col("value").ilike(f"%{q}%") | F.col("person").ilike(f"%{q}%")).select("id")
    return assets.join(hits, "id", "left_semi")


def not_excluded(assets: DataFrame, tags: DataFrame, rules: DataFrame) -> DataFrame:
    """Assets without a tag that an enabled rule names. Rules are few, and broadcast: by category and value, a common one's tags would all meet in a task."""
    hit = tags.join(F.broadcast(rules.where("enabled").select("category", "value")), ["category", "value"], "left_semi").select(F.col("image_id").alias("id"))
    return assets.join(hit, "id", "left_anti")


def without_child(assets: DataFrame, children: DataFrame, key: str = "image_id", where: Column | None = None) -> DataFrame:
    """Assets with no row in children (of those that where keeps)."""
    some = children if where is None else children.where(where)
    return assets.join(some.select(F.col(key).alias("id")), "id", "left_anti")


def in_collection(assets: DataFrame, items: DataFrame, collection: int) -> DataFrame:
    return assets.join(items.where(F.col("collection_id") == collection).select(F.col("image_id").alias("id")), "id", "left_semi")


def videos(rows: DataFrame, audio: bool | None = None, processed: int | None = None, bucket: tuple[float | None, float | None] | None = None, shape: str | None = None) -> DataFrame:
    """Quarantined videos (-1) are hidden unless asked for; bucket is [low, high)."""
    rows = rows.where(F.col("processed") != -1) if processed is None else rows.where(F.col("processed") == processed)
    if audio is not None:
        rows = rows.where(F.col("has_audio") == audio)
    if bucket is not None:
        low, high = bucket
        rows = rows if low is None else rows.where(F.col("duration") >= low)
        rows = rows if high is None else rows.where(F.col("duration") < high)
    if shape is not None:
        test = {"portrait": F.col("height") > F.col("width"), "landscape": F.col("width") > F.col("height"), "square": F.col("width") == F.col("height")}
        rows = rows.where(test[shape])
    return rows


_KEYS = {"recent": "id", "created": "created_at", "modified": "modified_at", "imported": "imported_at", "size": "filesize", "duration": "duration", "filename": "filename", "person": "person"}
_ASCENDING = {"filename", "person"}


def sorted_by(rows: DataFrame, key: str, seed: int = 0, strict: bool = False) -> DataFrame:
    """Sort keys with the id as tie-break in the same direction; an unknown key is recent, or an error if strict; random takes a seed."""
    if key == "random":
        return rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id")
    if key not in _KEYS:
        if strict:
            raise ValueError(f"no sort key {key!r}")
        key = "recent"
    up = key in _ASCENDING
    return rows.orderBy(*((F.col(c).asc() if up else F.col(c).desc()) for c in dict.fromkeys((_KEYS[key], "id"))))


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """Page number (from 1) of rows in a total order."""
    return rows.offset((number - 1) * size).limit(size)


def total_pages(total: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / size)).cast("long")


#: The captioner takes the most explicit ratings first.
PRIORITY = ("explicit", "questionable", "sensitive", "general")


def priority(column: Column, order: tuple[str, ...] = PRIORITY) -> Column:
    out = F.lit(len(order))
    for i, value in reversed(list(enumerate(order))):
        out = F.when(column == value, i).otherwise(out)
    return out
