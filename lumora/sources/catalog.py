"""The media catalog as DataFrames, projected from the given tables.

Each projection has the same definition in DuckDB SQL (cte()), so that queries and their oracles start
from the same rows. Only the columns that a query uses reach the scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.sources.shared import input_bytes

#: Bytes of the lines' files for a partition of their tags: some 900,000 tags.
LINES_AT_ONCE = 4 << 20


@dataclass(frozen=True)
class Catalog:
    """Lazily built tables: images, tags, labels, captions, vectors, faces, items, videos, segments, pages."""

    spark: SparkSession
    folder: str

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def images(self) -> DataFrame:
        c = F.col
        return self.raw("orders").select(
            c("o_orderkey").alias("id"),
            F.when(c("o_custkey") % 10 != 0, c("o_custkey")).alias("owner_id"),
            c("o_orderpriority").alias("person"),
            c("o_orderdate").alias("imported_at"),
            c("o_totalprice").alias("filesize"),
            F.when(c("o_orderstatus") == "F", "reject").when(c("o_orderstatus") == "O", "keep").when(c("o_orderstatus") == "P", "maybe").alias("flag_action"),
            (c("o_orderstatus") != "P").alias("processed"),
        )

    @cached_property
    def _tagged(self) -> DataFrame:
        """A row for each line with its part: both grow, so lines are dealt to hashed parts, and aren't sorted for it."""
        lines = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_discount", "l_returnflag", "l_linestatus")
        parts = self.raw("part").select("p_partkey", "p_type", "p_brand")
        return lines.join(parts.hint("shuffle_hash"), lines.l_partkey == parts.p_partkey).drop("l_partkey", "p_partkey")

    @staticmethod
    def _tags_of(lines: DataFrame) -> DataFrame:
        return lines.selectExpr(
            "l_orderkey AS image_id",
            "stack(4, 'returnflag', l_returnflag, 'linestatus', l_linestatus, 'type', p_type, 'brand', p_brand) AS (category, value)",
            "concat('s', l_linenumber) AS tag_source",
            "l_discount AS confidence",
        )

    @cached_property
    def tag_rows(self) -> DataFrame:
        """Tag rows as they come, repeated ones too: for semi-joins and distinct counts, which need no shuffle to drop them."""
        return self._tags_of(self._tagged)

    @cached_property
    def line_parts(self) -> int:
        """As many partitions as the lines' files ask for."""
        return max(self.spark.sparkContext.defaultParallelism, -(-input_bytes(self.raw("lineitem")) // LINES_AT_ONCE))

    @cached_property
    def dealt_tag_rows(self) -> DataFrame:
        """The same dealt by image, as lines, before each becomes four rows: what groups or joins them by image needs no further shuffle."""
        return self._tags_of(self._tagged.repartition(self.line_parts, "l_orderkey"))

    @cached_property
    def tags(self) -> DataFrame:
        """image_id, category, value, tag_source, confidence: one row for each of the first four."""
        return self.dealt_tag_rows.groupBy("image_id", "category", "value", "tag_source").agg(F.max("confidence").alias("confidence"))

    @cached_property
    def rules(self) -> DataFrame:
        return self.spark.createDataFrame([("brand", "Brand#4", True), ("returnflag", "R", True), ("linestatus", "O", False)], "category string, value string, enabled boolean")

    @cached_property
    def labels(self) -> DataFrame:
        """asset_id, set_name, value: the sets Quality and Toxic over documents."""
        return self.raw("labels").selectExpr("doc_id AS asset_id", "stack(2, 'Quality', if(quality = 1, 'good', 'poor'), 'Toxic', if(toxic = 1, 'yes', 'no')) AS (set_name, value)")

    @cached_property
    def captions(self) -> DataFrame:
        return self.raw("documents").selectExpr("doc_id AS image_id", "source AS model", "text AS caption", "lang")

    @cached_property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").selectExpr("vec_id AS id", "transform(embedding, x -> cast(x AS double)) AS v", "label")

    @cached_property
    def items(self) -> DataFrame:
        """Timestamped items with coordinates: id, person, ts, t (seconds), lat, lon."""
        k = F.get_json_object("props", "$.k").cast("int")
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("person"),
            "ts",
            F.col("event_type").alias("kind"),
            F.col("value").alias("size"),
            (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"),
            (F.lit(-90.0) + (k % 90) * 2).alias("lat"),
            (F.lit(-180.0) + (F.col("user_id") % 90) * 4).alias("lon"),
        )

    @cached_property
    def videos(self) -> DataFrame:
        c = F.col
        return self.raw("part").select(
            c("p_partkey").alias("id"),
            c("p_name").alias("filename"),
            c("p_brand").alias("person"),
            c("p_type").alias("rating"),
            (c("p_size") * 20.0).alias("duration"),
            c("p_size").alias("width"),
            (c("p_partkey") % 50 + 1).cast("int").alias("height"),
            (c("p_partkey") % 3 == 0).alias("has_audio"),
            F.when(c("p_partkey") % 17 == 0, -1).when(c("p_partkey") % 5 == 0, 0).otherwise(1).alias("processed"),
            c("p_retailprice").alias("filesize"),
        )

    @cached_property
    def segments(self) -> DataFrame:
        """Transcript cues: video, turn, start, end, text."""
        c = F.col
        return self.raw("conversations").select(c("conv_id").alias("video"), "turn", (c("turn") * 7).alias("start"), (c("turn") * 7 + F.length("text") % 11 + 1).alias("end"), "text")

    @cached_property
    def scenes(self) -> DataFrame:
        """15-second windows over each video's cues: video, scene, lo, hi."""
        last = self.segments.groupBy("video").agg(F.max("end").alias("last"))
        return last.select("video", F.explode(F.sequence(F.lit(0), F.floor((F.col("last") - 1) / 15).cast("int"))).alias("scene")).selectExpr("video", "cast(scene AS bigint) AS scene", "cast(scene AS bigint) * 15 AS lo", "cast(scene AS bigint) * 15 + 15 AS hi")

    @cached_property
    def paths(self) -> DataFrame:
        return self.raw("pages").selectExpr("page_id AS id", "url AS path", "html AS body")


_SQL = {
    "images": "SELECT o_orderkey AS id, CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS owner_id, o_orderpriority AS person, o_orderdate AS imported_at, o_totalprice AS filesize, CASE o_orderstatus WHEN 'F' THEN 'reject' WHEN 'O' THEN 'keep' WHEN 'P' THEN 'maybe' END AS flag_action, o_orderstatus <> 'P' AS processed FROM orders",
    "tags": "SELECT image_id, category, value, tag_source, max(confidence) AS confidence FROM (SELECT l_orderkey AS image_id, unnest(['returnflag', 'linestatus', 'type', 'brand']) AS category, unnest([l_returnflag, l_linestatus, p_type, p_brand]) AS value, 's' || l_linenumber AS tag_source, l_discount AS confidence FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY image_id, category, value, tag_source",
    "rules": "SELECT * FROM (VALUES ('brand', 'Brand#4', true), ('returnflag', 'R', true), ('linestatus', 'O', false)) AS r(category, value, enabled)",
    "labelled": "SELECT doc_id AS asset_id, unnest(['Quality', 'Toxic']) AS set_name, unnest([CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END, CASE WHEN toxic = 1 THEN 'yes' ELSE 'no' END]) AS value FROM labels",
    "captions": "SELECT doc_id AS image_id, source AS model, text AS caption, lang FROM documents",
    "vectors": "SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings",
    "items": "SELECT event_id AS id, user_id AS person, ts, event_type AS kind, value AS size, epoch_us(ts) / 1e6 AS t, -90.0::DOUBLE + (CAST(json_extract_string(props, '$.k') AS INT) % 90) * 2 AS lat, -180.0::DOUBLE + (user_id % 90) * 4 AS lon FROM events",
    "videos": "SELECT p_partkey AS id, p_name AS filename, p_brand AS person, p_type AS rating, p_size * 20.0::DOUBLE AS duration, p_size AS width, CAST(p_partkey % 50 + 1 AS INT) AS height, p_partkey % 3 = 0 AS has_audio, CASE WHEN p_partkey % 17 = 0 THEN -1 WHEN p_partkey % 5 = 0 THEN 0 ELSE 1 END AS processed, p_retailprice AS filesize FROM part",
    "segments": "SELECT conv_id AS video, turn, turn * 7 AS start_s, turn * 7 + length(text) % 11 + 1 AS end_s, text FROM conversations",
    "scenes": "SELECT video, scene, scene * 15 AS lo, scene * 15 + 15 AS hi FROM (SELECT conv_id AS video, unnest(range(0, CAST(floor((max(turn * 7 + length(text) % 11 + 1) - 1) / 15) AS BIGINT) + 1)) AS scene FROM conversations GROUP BY conv_id)",
    "paths": "SELECT page_id AS id, url AS path, html AS body FROM pages",
}


def cte(*names: str, more: str = "", recursive: bool = False) -> str:
    """WITH clause that defines the named projections (labels are called labelled there)."""
    parts = [f"{n} AS ({_SQL[n]})" for n in names] + ([more] if more else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} "
