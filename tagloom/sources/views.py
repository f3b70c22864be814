"""Views of labels as files: a listing of paths, the metadata file of each image, and the columns of a view."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tagloom.functions import boxes
from tagloom.functions.scalars import number
from tagloom.sources.files import read_metadata_text

#: Suffixes of images, and the names under which metadata has a value, the first that is there counts.
IMAGES = ("jpg", "jpeg", "png")
ALIASES = {
    "frame_timestamp": ("frame_timestamp", "timestamp", "time_ms", "time_seconds", "frame_index"),
    "confidence": ("confidence", "detector_confidence", "score"),
    "sharpness": ("sharpness", "blur_score"),
    "product_id_above_tag": ("product_id_above_tag", "product_id", "item_id"),
    "video_filename": ("video_filename", "filename", "video"),
}
#: Folders that one task lists.
FOLDERS = 64


class Folders(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class FileListing(DataSource):
    """Paths of all files under a folder, without their contents: folder (the first one below the root; null for the root's
    own files), directory, name and path. Tasks list whole folders; `path` is a local path or an address that pyarrow
    knows (file, hdfs, s3, gs)."""

    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return "folder string, directory string, name string, path string"

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options["path"], int(self.options.get("foldersPerTask", FOLDERS)))


class ListingReader(DataSourceReader):
    def __init__(self, root: str, folders: int):
        self.root, self.folders = root.rstrip("/"), folders

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, base = self._open()
        found = sorted(i.base_name for i in files.get_file_info(fs.FileSelector(base)) if i.type == fs.FileType.Directory)
        return [Folders([""])] + [Folders(found[i : i + self.folders]) for i in range(0, len(found), self.folders)]

    def read(self, partition: Folders) -> Iterator[tuple]:
        from pyarrow import fs

        files, base = self._open()
        for folder in partition.names:
            chosen = fs.FileSelector(f"{base}/{folder}" if folder else base, recursive=bool(folder))
            for i in files.get_file_info(chosen):
                if i.type == fs.FileType.File:
                    yield folder or None, i.path.rsplit("/", 1)[0], i.base_name, i.path


def list_files(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(FileListing)
    return spark.read.format("file_listing").option("path", root).load()


def grouped_images(files: DataFrame, root: str) -> DataFrame:
    """group_id, directory, name, path, view_ord of the images of a listing, in order of paths within a group.

    Each folder is a group: its own images, or those of the folders below where it has none. Only where there is no folder
    at all, the root's images are one group that has the root's name. Groups without images have no rows."""
    suffix = F.lower(F.element_at(F.split("name", r"\."), -1))
    images = files.where(suffix.isin(*IMAGES) & F.col("name").contains("."))
    base = root.rstrip("/")
    direct = F.element_at(F.split("directory", "/"), -1) == F.col("folder")
    own = F.col("directory").endswith(F.concat(F.lit(base.rsplit("/", 1)[-1] + "/"), F.col("folder"))) & direct
    folders = files.agg(F.count("folder").alias("folders"))
    placed = images.withColumn("own", F.coalesce(own, F.lit(True))).crossJoin(folders)  # a table of one row
    any_own = F.max("own").over(Window.partitionBy("folder"))
    kept = placed.withColumn("any_own", any_own).where(
        F.when(F.col("folder").isNull(), F.col("folders") == 0).otherwise(F.col("own") | ~F.col("any_own"))
    )
    named = kept.select(F.coalesce("folder", F.lit(base.rsplit("/", 1)[-1])).alias("group_id"), "directory", "name", "path")
    return named.withColumn("view_ord", F.row_number().over(Window.partitionBy("group_id").orderBy("path")))


def with_metadata_file(images: DataFrame, files: DataFrame) -> DataFrame:
    """`metadata`: the path of the JSON file that belongs to an image: data.json of its folder, else the one of its own
    stem, else the first by name; null where the folder has none. Folders are summed up before they meet images."""
    found = files.where(F.col("name").endswith(".json"))
    per_folder = found.groupBy("directory").agg(
        F.max(F.when(F.col("name") == "data.json", F.col("path"))).alias("shared"), F.min_by("path", "name").alias("first")
    )
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    same = found.select("directory", stem(F.col("name")).alias("stem"), F.col("path").alias("same"))
    met = images.withColumn("stem", stem(F.col("name"))).join(per_folder, "directory", "left").join(same, ["directory", "stem"], "left")
    return met.select(*images.columns, F.coalesce("shared", "same", "first").alias("metadata"))


def _first(meta: Column, keys: tuple[str, ...], skip: tuple[str, ...] = ()) -> Column:
    """The first of the keys that has a value, as text; values in `skip` count as none."""
    values = [F.get_json_object(meta, f"$.{k}") for k in keys]
    return F.coalesce(*(F.when(~v.isin(*skip), v) for v in values) if skip else values)


def view_columns(meta: Column) -> dict[str, Column]:
    """The columns of a view from its metadata as JSON text: time, box, width and height (given, else those of the box),
    centre (given, else the box's), confidence, sharpness, product and video. Broken or missing metadata gives nulls."""
    get = lambda path: number(F.get_json_object(meta, f"$.{path}"))
    least_zero = lambda c: F.when(c.isNotNull(), F.greatest(F.lit(0.0), c))
    box = boxes.box(meta)
    shape = boxes.geometry(box)
    width = F.coalesce(get("bbox_size.width"), get("bbox_size.w"), get("bbox_width"), least_zero(box["x_max"] - box["x_min"]))
    height = F.coalesce(get("bbox_size.height"), get("bbox_size.h"), get("bbox_height"), least_zero(box["y_max"] - box["y_min"]))
    sides = {"x": (box["x_min"], box["x_max"]), "y": (box["y_min"], box["y_max"])}
    center = {}
    for axis, (low, high) in sides.items():
        given = [get(f"{parent}.{key}") for parent in ("center", "normalized_center") for key in (axis, f"center_{axis}")]
        center[axis] = F.coalesce(*given, get(f"center_{axis}"), (low + high) / 2)
    text = {k: _first(meta, v, ("", "0", "0.0", "false")) for k, v in ALIASES.items() if k in ("product_id_above_tag", "video_filename")}
    return {
        "frame_timestamp": _first(meta, ALIASES["frame_timestamp"]), **box, **text,
        "confidence": number(_first(meta, ALIASES["confidence"])), "sharpness": number(_first(meta, ALIASES["sharpness"])),
        "bbox_width": width, "bbox_height": height, "center_x": center["x"], "center_y": center["y"],
        "area": F.coalesce(shape["area"], least_zero(width) * least_zero(height)),
    }


def read_views(spark: SparkSession, root: str) -> DataFrame:
    """One row a view: group_id, view_ord, path, metadata (its file) and the columns of view_columns."""
    files = list_files(spark, root)
    images = with_metadata_file(grouped_images(files, root), files)
    meta = read_metadata_text(spark, root).select(F.col("path").alias("metadata"), "json")
    rows = images.join(meta, "metadata", "left")
    return rows.select("group_id", "view_ord", "path", "metadata", *(c.alias(n) for n, c in view_columns(F.col("json")).items()))
