"""Captures below a folder of any file system, with what their sidecar files and the operator's table say of them.

Spark's own readers list the files, so no machine needs the folder mounted. Only names, lengths and times of captures
are read, not their bytes. Spark leaves out files and folders whose names begin with a dot or an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Endings of captures, deepest folder below the root, what a sidecar may say.
ENDINGS, DEPTH = ("dat", "bin"), 8
FIELDS = ("room", "configuration", "scenario", "subject", "activity", "facing", "distance_m")
# The operator's conditions in words.
WORDS = {
    "empty": "empty room", "small move": "small move", "large move": "large move", "still": "still (breathing)",
    "standing/walking": "standing / walking", "static fan": "static fan only", "rot fan": "rotating fan only", "vacuum": "robot vacuum only",
}
THINGS = {"static fan": "static fan", "rot fan": "rotating fan", "vacuum": "robot vacuum"}
PEOPLE = {"still": "still (breathing)", "small": "small move"}


def _below(spark: SparkSession, root: str, path: Column) -> Column:
    """A file's decoded path below the root."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    at = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().getPath().rstrip("/")
    plain = F.regexp_replace(path, "^[a-zA-Z0-9+.-]+:(//[^/]*)?", "")
    return F.substring(plain, F.lit(len(at) + 2), F.length(plain))


def list_captures(spark: SparkSession, root: str, depth: int = DEPTH) -> DataFrame:
    """filename (below the root), capture (without its ending), stem, path, size_bytes, mtime of all captures.

    Folders named after a capture beside them (its stem and an underscore first) hold its artifacts and are not
    searched, nor are folders more than ``depth`` below the root.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(ENDINGS) + "}").load(root)
    files = files.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))
    files = files.withColumn("filename", _below(spark, root, F.col("path"))).withColumn("capture", F.regexp_replace("filename", r"\.[^./]*$", ""))
    files = files.withColumn("_parts", F.split("filename", "/")).where(F.size("_parts") <= depth + 1)
    files = files.withColumn("stem", F.element_at(F.split("capture", "/"), -1))
    # a folder a_b_c belongs to a capture a or a_b beside it
    level = F.sequence(F.lit(0), F.size("_parts") - 2)
    folders = files.where(F.size("_parts") > 1).select("filename", F.explode(level).alias("_at"), "_parts")
    folders = folders.select("filename", F.concat_ws("/", F.slice("_parts", F.lit(1), F.col("_at"))).alias("_in"), F.split(F.get("_parts", F.col("_at")), "_").alias("_words"))
    owners = folders.where(F.size("_words") > 1).select("filename", "_in", F.explode(F.transform(F.sequence(F.lit(1), F.size("_words") - 1), lambda k: F.array_join(F.slice("_words", F.lit(1), k), "_"))).alias("_stem"))
    beside = files.select(F.concat_ws("/", F.slice("_parts", F.lit(1), F.size("_parts") - 1)).alias("_in"), F.col("stem").alias("_stem")).distinct()
    artifacts = owners.join(beside, ["_in", "_stem"]).select("filename").distinct()
    return files.join(artifacts, "filename", "left_anti").select("filename", "capture", "stem", "path", "size_bytes", "mtime")


def sidecars(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """capture, text of the files beside captures whose names end with ``suffix``."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*" + suffix).text(root, wholetext=True)
    # _metadata escapes a path as an address does; + is no blank there
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    below = _below(spark, root, path)
    return files.select(F.substring(below, F.lit(1), F.length(below) - len(suffix)).alias("capture"), F.col("value").alias("text"))


def in_words(condition: Column) -> Column:
    """An operator's condition as a reader says it, the person before the thing; unknown words stay."""
    word = lambda x, known: F.coalesce(F.try_element_at(F.create_map(*(F.lit(y) for kv in known.items() for y in kv)), x), x)
    thing, person = F.substring_index(condition, " + ", 1), F.substring(condition, F.locate(" + ", condition) + 3, F.length(condition))
    return F.when(F.locate(" + ", condition) > 0, F.concat_ws(" + ", word(person, PEOPLE), word(thing, THINGS))).otherwise(word(condition, WORDS))


def conditions(captures: DataFrame, meta: DataFrame, camera: DataFrame, table: DataFrame) -> DataFrame:
    """``captures`` (capture, stem, ...) with what is recorded of each: null is not recorded.

    ``meta`` and ``camera`` hold a JSON text for a capture (text that is no object says nothing), ``table`` the
    operator's rows (stem, env, session, cond, y). The operator's table comes first, then what was typed at capture
    time; the camera only stands in for a scenario nobody gave. One row a capture or stem is read from each; of
    several the least, by their text.
    """
    fields = [*FIELDS, "presence", "presence_source"]
    parsed = F.from_json("text", ", ".join(f"{f} string" for f in fields))
    said = meta.groupBy("capture").agg(F.min("text").alias("text")).select("capture", parsed.alias("_m"))
    seen = camera.groupBy("capture").agg(F.min("text").alias("text")).select("capture", F.from_json("text", "summary struct<fraction_occupied: double>")["summary"]["fraction_occupied"].alias("camera_occupancy"))
    rows = table.groupBy("stem").agg(F.min(F.struct(*(F.col(c).cast("string").alias(c) for c in ("env", "session", "cond", "y")))).alias("_g"))
    df = captures.join(said, "capture", "left").join(seen, "capture", "left").join(rows, "stem", "left")
    m = {f: F.when(F.col(f"_m.{f}") != "", F.col(f"_m.{f}")) for f in fields}
    share, listed = F.col("camera_occupancy"), F.col("_g").isNotNull()
    typed = F.trim(m["scenario"])
    typed = F.when(typed != "", typed)
    known, present = F.col("_g.y").isin("0", "1"), m["presence"].isin("occupied", "empty")
    guess = F.when(share == 0, "empty").when(share > 0.5, "occupied").when(share.isNotNull(), "partial")
    return df.withColumns({
        **{f: m[f] for f in FIELDS if f != "scenario"},
        "scenario": F.coalesce(m["scenario"], guess),
        "recorded": F.when(listed, in_words(F.col("_g.cond"))).otherwise(typed),
        "recorded_source": F.when(listed, F.concat(F.lit("GT table "), F.col("_g.env"), F.lit(", session "), F.col("_g.session"))).when(typed.isNotNull(), "operator, at capture time"),
        "gt": F.when(known, F.when(F.col("_g.y") == "1", "person").otherwise("empty")).when(present, F.when(m["presence"] == "occupied", "person").otherwise("empty")),
        "gt_source": F.when(known, F.trim(F.concat(F.lit("GT table "), F.coalesce("_g.env", F.lit(""))))).when(present, F.coalesce(m["presence_source"], F.lit("operator"))),
        "presence": F.when(present, m["presence"]),
        "presence_source": F.when(present, m["presence_source"]),
        "occupancy": F.when(m["scenario"].isNull(), share),
    }).drop("_m", "_g")
