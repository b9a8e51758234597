"""What may come in: formats, equal contents, members of archives, manifests, and which run is the newest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import base_name, suffix
from ..schemas import IMAGE_SUFFIXES
from .naming import free_files

#: fixed values: limits of an archive
MOST_MEMBERS, MOST_TOTAL = 5_000, 4 * 1024**3
MOST_BYTES, MOST_RATIO, RATIO_FROM = 150 * 1024**2, 200, 1024**2


def sort_formats(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds format ('' without suffix) and verdict: image, archive (silently left out) or unsupported."""
    s = suffix(base_name(F.col(path)))
    return files.withColumn("format", s).withColumn("verdict", F.when(s.isin(*IMAGE_SUFFIXES), "image").when(s == "zip", "archive").otherwise("unsupported"))


def first_of_equal(files: DataFrame, key: str, sha: str = "sha") -> DataFrame:
    """Adds first_key, the least key (its order is that of discovery) of the same content, and duplicate. Null contents are no duplicates.

    Partial minima come before the shuffle, and only contents that occur again are joined, so a content that very many files
    share is no burden to one task.
    """
    again = files.filter(F.col(sha).isNotNull()).groupBy(F.col(sha).alias("__sha")).agg(F.min(key).alias("first_key"), F.count("*").alias("__n")).filter("__n > 1").drop("__n")
    met = files.join(again, F.col(sha) == F.col("__sha"), "left").drop("__sha").withColumn("first_key", F.coalesce("first_key", F.col(key)))
    return met.withColumn("duplicate", F.col("first_key") != F.col(key))


def inner_path(name: Column) -> Column:
    """A member's path with slashes and without empty and '.' parts and what '..' takes back; null if it leaves its root."""
    clean = F.translate(name, "\\", "/")
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("inside"))
    step = lambda a, x: F.struct(
        F.when(x.isin("", "."), a["at"]).when(x == "..", F.slice(a["at"], 1, F.greatest(F.size(a["at"]) - 1, F.lit(0)))).otherwise(F.concat(a["at"], F.array(x))).alias("at"),
        (a["inside"] & ~((x == "..") & (F.size(a["at"]) == 0))).alias("inside"),
    )
    end = F.aggregate(F.split(clean, "/"), start, step)
    absolute = clean.startswith("/") | clean.rlike("^[A-Za-z]:")
    return F.when(end["inside"] & ~absolute, F.array_join(end["at"], "/"))


def archive_totals(members: DataFrame) -> DataFrame:
    """Per archive its members and bytes, and the verdict on the whole: ok, too many members, too large."""
    t = members.groupBy("archive").agg(F.count("*").alias("members"), F.sum(F.greatest(F.col("file_size"), F.lit(0))).alias("bytes"))
    return t.withColumn("verdict", F.when(F.col("members") > MOST_MEMBERS, "too many members").when(F.col("bytes") > MOST_TOTAL, "too large").otherwise("ok"))


def archive_cascade(members: DataFrame) -> DataFrame:
    """What becomes of each member: the first rule that applies. Adds verdict and target (its safe path, null if it isn't taken).

    members: archive, pos, name, is_dir, flag_bits, file_size, compress_size. The whole archive's verdict comes first.
    """
    whole = archive_totals(members).select("archive", F.col("verdict").alias("whole"))
    size = F.col("file_size")
    squeezed = (size >= RATIO_FROM) & (size / F.greatest(F.col("compress_size"), F.lit(1)) > MOST_RATIO)
    inner = inner_path(F.col("name"))
    x = members.join(whole, "archive").withColumn("inner", inner)
    verdict = (
        F.when(F.col("whole") != "ok", F.col("whole"))
        .when(F.col("is_dir") | (F.trim(F.coalesce("name", F.lit(""))) == ""), "skipped")
        .when(F.col("inner").isNull() | (F.col("inner") == ""), "unsafe path")
        .when(F.col("flag_bits").bitwiseAND(1) != 0, "encrypted")
        .when(size > MOST_BYTES, "file too large")
        .when(squeezed, "suspicious ratio")
        .otherwise("taken")
    )
    x = x.withColumn("verdict", verdict).withColumn("target", F.when(F.col("verdict") == "taken", F.col("inner")))
    return x.drop("whole", "inner")


def archive_targets(members: DataFrame) -> DataFrame:
    """Taken members with the name that each gets (final): one whose target is taken gets the next free of _2, _3, ..., and is renamed."""
    taken = archive_cascade(members).filter("verdict = 'taken'")
    return free_files(taken, ["archive"], "target", "pos")


def latest_run(reports: DataFrame, markers: DataFrame, root: str = "root") -> DataFrame:
    """Per root the run with the newest report among the runs (root, run, modified) without a marker (run)."""
    done = reports.join(markers.select("run").distinct(), "run", "left_anti")
    return done.groupBy(root).agg(F.max(F.struct("modified", "run")).alias("m")).select(root, F.col("m.run").alias("run"), F.col("m.modified").alias("modified"))


def manifest_verify(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Each path of a manifest (path, size, sha256) or folder with its verdict: ok, missing, size, hash, unlisted."""
    m = manifest.select("path", F.col("size").alias("m_size"), F.upper("sha256").alias("m_sha"), F.lit(True).alias("listed"))
    f = files.select("path", F.col("size").alias("f_size"), F.upper("sha256").alias("f_sha"), F.lit(True).alias("there"))
    x = m.join(f, "path", "full")
    verdict = (
        F.when(F.col("there").isNull(), "missing").when(F.col("listed").isNull(), "unlisted")
        .when(~F.col("m_size").eqNullSafe(F.col("f_size")), "size").when(~F.col("m_sha").eqNullSafe(F.col("f_sha")), "hash").otherwise("ok")
    )
    return x.select("path", verdict.alias("verdict"))


def manifest_totals(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"))


def name_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Names (column `name`) on one side only, with the side; no row if the sets are equal."""
    e, a = expected.select("name").distinct().withColumn("e", F.lit(True)), actual.select("name").distinct().withColumn("a", F.lit(True))
    return e.join(a, "name", "full").filter("e is null or a is null").select("name", F.when(F.col("a").isNull(), "missing").otherwise("unexpected").alias("side"))


def stale_archives(files: DataFrame) -> DataFrame:
    """Per run whether its archive must be built anew. files: run, kind ('zip', 'source', 'marker'), modified, size.

    Yes if a marker says so, without an archive, or if a source is newer; without sources, if the archive is empty.
    """
    at = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    t = files.groupBy("run").agg(at("zip", "modified").alias("zip"), at("zip", "size").alias("zip_size"), at("source", "modified").alias("newest"), F.count_if(F.col("kind") == "marker").alias("marks"))
    stale = (F.col("marks") > 0) | F.col("zip").isNull() | F.when(F.col("newest").isNull(), F.col("zip_size") == 0).otherwise(F.col("zip") < F.col("newest"))
    return t.select("run", stale.alias("stale"))


def archive_members(files: DataFrame, with_archives: bool = False, path: str = "path", archive: str | None = None) -> DataFrame:
    """Files of a folder that its archive takes: nothing of the correction cache, not itself, and no other archive unless told so."""
    p = F.col(path)
    keep = ~F.array_contains(F.split(p, "/"), ".correction_cache")
    if archive:
        keep = keep & (p != archive)
    return files.filter(keep if with_archives else keep & (suffix(base_name(p)) != "zip"))
