"""Numbers and names in order: item ids, duplicate tags, names that don't collide."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import numbered, safe_stem
from ..schemas import DUPLICATE_TAG, OK, REVIEW_REQUIRED
from ..tables import stored

BLOCK = 1 << 14


def running(rows: DataFrame, keys: list[str], order: str, sums: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """Adds running sums (this row included) over `keys` in order of `order`, a whole number that is unique in a key.

    A key may hold a large part of all rows: windows cover a key's rows in blocks of so many order values, and what
    blocks before add up to comes from a second window over one row per key and block. So no task gets a whole key. It goes
    ahead of its block's rows as a row of its own, so that rows are moved once and meet it in the same window.
    """
    marked = rows.withColumn("__block", F.floor(F.col(order) / block))
    for name, value in sums.items():
        marked = marked.withColumn(name, value.cast("long"))
    before = marked.groupBy(*keys, "__block").agg(*(F.sum(n).alias(n) for n in sums))
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select(*keys, "__block", *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums), F.lit(True).alias("__ahead"))
    before = before.filter(F.greatest(*(F.abs(n) for n in sums), F.lit(0)) > 0)
    met = marked.withColumn("__ahead", F.lit(False)).unionByName(before, allowMissingColumns=True)
    within = Window.partitionBy(*keys, "__block").orderBy(F.desc("__ahead"), order).rowsBetween(Window.unboundedPreceding, 0)
    met = met.select(*rows.columns, "__ahead", *(F.sum(n).over(within).alias(n) for n in sums))
    return met.filter(~F.col("__ahead")).drop("__ahead")


#: A name that another one gets when it is taken: its stem, _ and a number from 2 on.
NUMBERED = r"_([2-9]|[1-9][0-9]{1,8})$"
FAMILY = r"(_[0-9]+|[.][^./]+)+$"
ENTITY = ["__at", "__stem", "__ending"]
LONG_AGO = -(1 << 62)


def _file_ending(name: Column) -> Column:
    return F.regexp_extract(name, r"[^/](\.[^./]+)$", 1)


def _parents(claims: DataFrame) -> DataFrame:
    """(__at, __stem, __ending, k, name, first): of each claimed name, which stem would get it as its number k; as a file's name and as a folder's."""
    ending = _file_ending(F.col("name"))
    ways = F.array_distinct(F.array(F.struct(F.substr("name", F.lit(1), F.length("name") - F.length(ending)).alias("own"), ending.alias("ending")), F.struct(F.col("name").alias("own"), F.lit("").alias("ending"))))
    met = claims.filter(F.col("name").rlike("_[0-9]+([.][^./]+)?$")).withColumn("w", F.explode(ways))
    k = F.regexp_extract("w.own", NUMBERED, 1)
    met = met.select("__at", F.regexp_replace("w.own", NUMBERED, "").alias("__stem"), F.col("w.ending").alias("__ending"), k.try_cast("long").alias("k"), "name", "first")
    return met.filter(F.col("k").isNotNull() & (F.col("__stem") != ""))


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = a[keys[0]].eqNullSafe(b[keys[0]])
    for k in keys[1:]:
        out = out & a[k].eqNullSafe(b[k])
    return out


def _reached(kids: DataFrame, heads: DataFrame) -> DataFrame:
    """Of the numbers that others claim, those that a stem comes to while it names its rows (heads: __at, __stem, __ending, own, n, base, and most_base, what base may become).

    A stem of n rows gets to its i-th claimed number only if this isn't beyond n and the claims before it.
    """
    met = kids.join(heads, ENTITY).filter((F.col("n") > 1) | (F.col("most_base") > 0))
    met = running(met, ENTITY, "k", {"__i": F.lit(1)})
    over = met.filter(F.col("k") > F.col("n") + F.col("most_base") + F.col("__i") - 1).groupBy(*ENTITY).agg(F.min("k").alias("__over"))
    return met.join(over, ENTITY, "left").filter(F.col("__over").isNull() | (F.col("k") < F.col("__over"))).select(*kids.columns, "own", "base")


def _numbers(rows: DataFrame, place: list[str], stem: Column, ending: Column, order: str, taken: DataFrame | None) -> DataFrame:
    """Adds number to rows; see free_numbers. An entity is a stem with its ending in a place, and its own name is stem and ending."""
    spark = rows.sparkSession
    at = F.struct(*place) if place else F.struct(F.lit(0).alias("all"))
    x = rows.withColumn("__at", at).withColumn("__stem", stem).withColumn("__ending", ending)
    x = stored(running(x, ENTITY, order, {"__nth": F.lit(1)}))  # read several times below
    asked = x.groupBy(*ENTITY).agg(F.min(order).cast("long").alias("first"), F.count("*").alias("n")).withColumn("name", F.concat("__stem", "__ending"))
    claims = asked
    if taken is not None:
        families = asked.select("__at", F.regexp_replace("name", FAMILY, "").alias("family")).distinct()
        old = taken.select(at.alias("__at"), F.col("name"), F.regexp_replace("name", FAMILY, "").alias("family")).join(families, ["__at", "family"], "left_semi")
        claims = asked.unionByName(old.select("__at", "name", F.lit(LONG_AGO).alias("first")), allowMissingColumns=True)
    # of those that claim one name, the first gets it
    claims = claims.withColumn("least", F.min("first").over(Window.partitionBy("__at", "name")))
    entities = stored(claims.filter(F.col("n").isNotNull()).select(*ENTITY, "name", "n", "first", (F.col("least") < F.col("first")).cast("long").alias("base")))
    kids = _parents(claims.groupBy("__at", "name").agg(F.min("first").alias("first")))

    # an own name that is another stem's number may be taken by it; a claim too many here is one that a stem just doesn't come to
    won = kids.select("__at", "name").distinct().withColumn("won", F.lit(1).cast("long"))
    heads = entities.join(won, ["__at", "name"], "left").select(*ENTITY, F.col("name").alias("own"), "n", "base", F.greatest("base", F.coalesce("won", F.lit(0))).alias("most_base"))
    pairs = stored(_reached(kids, heads).withColumn("took", F.lit(False)))
    took, skips = None, None
    if not pairs.isEmpty():
        times = stored(x.join(pairs.select(*ENTITY).distinct(), ENTITY, "left_semi").select(*ENTITY, F.col("__nth").alias("j"), F.col(order).cast("long").alias("time")))
        changed = True
        while changed:
            ahead = running(pairs, ENTITY, "k", {"skips": (~F.col("took")).cast("int")})
            base = F.col("base")
            if took is not None:
                ahead = ahead.join(took.select("__at", F.col("name").alias("own"), F.lit(1).cast("long").alias("won")), ["__at", "own"], "left")
                base = F.greatest("base", F.coalesce("won", F.lit(0)))
            ahead = ahead.withColumn("j", F.col("k") - base - F.col("skips") + (~F.col("took")).cast("int"))
            told = ahead.join(times, [*ENTITY, "j"], "left")
            told = stored(told.select(*pairs.drop("took").columns, "j", F.col("took").alias("before"), F.coalesce(F.col("time") < F.col("first"), F.lit(False)).alias("took")))
            changed = not told.filter("before <> took").isEmpty()
            pairs, took = told.drop("before", "j"), told.filter("took").select("__at", "name").distinct()
        skips = told.filter("not took").groupBy(*ENTITY, "j").agg(F.count("*").alias("w"))
    moved = entities if took is None else entities.join(took.withColumn("won", F.lit(1).cast("long")), ["__at", "name"], "left").withColumn("base", F.greatest("base", F.coalesce("won", F.lit(0))))
    moved = moved.select(*ENTITY, "base")
    if skips is None:
        moved = stored(moved.filter("base > 0"))
        skips = moved.limit(0).select(*ENTITY, F.col("base").alias("j"), F.col("base").alias("w"))
    else:
        moved = stored(moved.join(skips.select(*ENTITY).distinct().withColumn("s", F.lit(1)), ENTITY, "left").filter("base > 0 or s is not null").drop("s"))
    if moved.isEmpty():
        return x.withColumn("number", F.col("__nth")).drop(*ENTITY, "__nth")
    still = x.join(moved, _same(x, moved, ENTITY), "left_anti").withColumn("number", F.col("__nth"))
    of = x.join(moved, ENTITY).withColumn("__turn", 2 * F.col("__nth") + 1).withColumn("__w", F.lit(0).cast("long"))
    marks = skips.select(*ENTITY, (2 * F.col("j")).alias("__turn"), F.col("w").alias("__w"))
    past = running(of.unionByName(marks, allowMissingColumns=True), ENTITY, "__turn", {"__past": F.col("__w")}).filter(F.col("__nth").isNotNull())
    past = past.withColumn("number", F.col("__nth") + F.col("base") + F.col("__past")).select(*still.columns)
    return still.unionByName(past).drop(*ENTITY, "__nth")


def free_numbers(rows: DataFrame, place: list[str], stem: str, order: str, taken: DataFrame | None = None) -> DataFrame:
    """Adds number: 1 if a row gets its stem itself, else the n of stem_n, the first name that is free when its turn comes.

    order is a whole number that is unique in a place. taken (the columns of place, name) has names that were there before. A stem such as a_2 may be asked for too, and is then not
    free to a, or taken by a already. Rows of a stem are counted in blocks, so one stem may hold a large part of all rows. Numbers that others claim are looked at only where a
    stem really comes to them; who is first is worked out for all of them at once, and again with what came out until nothing changes: every round settles at least the least open number of
    every stem, and mostly nearly all. No stem or family is settled in one task. Rows without a stem are numbered like those of one stem.
    """
    return _numbers(rows, place, F.col(stem), F.lit(""), order, taken)


def free_files(rows: DataFrame, place: list[str], name: str, order: str, is_directory: Column | None = None, taken: DataFrame | None = None) -> DataFrame:
    """Adds final, the first free name of a file in order (a.jpg, a_2.jpg, ...; a directory's suffix is part of its stem), and renamed.

    Files, directories and names that are taken already (taken: the columns of place, name) share one space of names. Not seen is only that a file whose very ending is numbered (a.b_2)
    and a directory may both come to one name by their numbers.
    """
    ending = _file_ending(F.col(name))
    ending = ending if is_directory is None else F.when(is_directory, "").otherwise(ending)
    x = stored(rows.withColumn("__end", ending).withColumn("__own", F.col(name).substr(F.lit(1), F.length(name) - F.length("__end"))))
    x = _numbers(x, place, F.col("__own"), F.col("__end"), order, taken)
    final = F.concat("__own", F.when(F.col("number") > 1, F.concat(F.lit("_"), F.col("number").cast("string"))).otherwise(""), "__end")
    return x.withColumn("final", final).withColumn("renamed", F.col("number") > 1).drop("__end", "__own", "number")


def given_names(spark: SparkSession, folder: str, but: int | None = None) -> DataFrame | None:
    """Names in a table that name_batch keeps, without those of one batch; None if there are none yet."""
    try:
        names = spark.read.parquet(folder)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return names.filter(F.col("batch") != but) if but is not None else names


def name_batch(rows: DataFrame, place: list[str], name: str, order: str, folder: str, batch: int, is_directory: Column | None = None) -> DataFrame:
    """free_files for rows that come in batches: names given to earlier batches, kept in a table in `folder`, are taken; those of this batch are added to it.

    Batches are named one after the other. A batch that is named again, as after a failure, replaces its own names and gets the same. Of the table only names of families that the batch asks
    for are moved.
    """
    named = stored(free_files(rows, place, name, order, is_directory, given_names(rows.sparkSession, folder, batch)))
    named.select(*place, F.col("final").alias("name")).write.mode("overwrite").parquet(f"{folder}/batch={batch}")
    return named


def path_key(path: Column) -> Column:
    """Sorts as paths do, component by component."""
    return F.split(path, "/")


def placed(rows: DataFrame, batch: str, order: list[Column], into: str) -> DataFrame:
    """Adds each row's number, from 1, in its batch by the given order.

    A batch may hold a large part of all rows: its rows are sorted over all tasks by range, counted in each range, and numbered from
    what earlier ranges hold. The ranges stay as they are, as their table is stored.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(rows.repartitionByRange(n, F.col(batch).asc_nulls_first(), *order).withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy(batch, "__range").agg(F.count("*").alias("__n"))  # one row per range and batch in it
    earlier = Window.partitionBy(batch).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(batch).alias("__batch"), F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy(batch, "__range").orderBy(*order))
    met = ranged.withColumn("__nth", within).join(sizes, F.col(batch).eqNullSafe(F.col("__batch")) & (F.col("__range") == F.col("__r")))
    return met.select(*rows.columns, (F.col("__nth") + F.col("__before")).alias(into))


def item_ids(files: DataFrame, batch: str = "batch", path: str = "path") -> DataFrame:
    """Adds item_id (item_000001, ...) by order of paths in each batch, and of equal paths by the other columns."""
    order = [path_key(F.col(path)).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in files.columns if c not in (batch, path))]
    met = placed(files, batch, order, "__number")
    return met.select(*files.columns, F.format_string("item_%06d", F.col("__number")).alias("item_id"))


def output_names(photos: DataFrame, mode: str = "white_and_transparent") -> DataFrame:
    """Statuses and names of outputs; photos: batch, item (order in the batch), filename, tag_number, status, background_ok (null: background off).

    A tag that was accepted earlier in its batch is a duplicate, even where the earlier photo waits for a decision
    about its background; names are numbered by the files that were really written, so the two counts differ. Tags are digits, so no number of one
    is another; names for review may be, and take the next free one. White and
    transparent files are numbered in their own folders. Adds status, output_folder, final_filename, transparent_filename.
    """
    accepted = F.col("status") == OK
    done = accepted & F.coalesce(F.col("background_ok"), F.lit(True))
    removed = accepted & F.coalesce(F.col("background_ok"), F.lit(False))
    white = done & ~removed if mode == "transparent_only" else done
    clear = removed & F.lit(mode in ("white_and_transparent", "transparent_only"))
    x = stored(running(photos, ["batch", "tag_number"], "item", {"nth_tag": accepted.cast("int"), "nth_white": white.cast("int"), "nth_clear": clear.cast("int")}))
    waiting = accepted & ~F.coalesce(F.col("background_ok"), F.lit(True))
    folder = F.when(waiting, "background_review").when(~accepted, "review_required").when(clear & F.lit(mode == "transparent_only"), "transparent_images").otherwise("processed_images")
    prefix = F.when(waiting, "BG_REVIEW_").otherwise("REVIEW_")
    x = x.withColumn("output_folder", folder).withColumn("stem", F.when(done, F.col("tag_number")).otherwise(safe_stem(F.concat(prefix, safe_stem(F.col("filename"))))))
    review = free_numbers(x.filter(~done), ["batch", "output_folder"], "stem", "item").withColumnRenamed("number", "nth")
    written = x.filter(done).withColumn("nth", F.when(F.col("output_folder") == "transparent_images", F.col("nth_clear")).otherwise(F.col("nth_white")))
    out = written.unionByName(review)
    final = F.when(done, F.when((F.col("nth_tag") > 1) | (F.col("nth") > 1), DUPLICATE_TAG).otherwise(OK)).when(waiting, REVIEW_REQUIRED).otherwise(F.col("status"))
    return out.select(
        "batch", "item", "filename", "tag_number", final.alias("status"), "output_folder", numbered(F.col("stem"), F.col("nth")).alias("final_filename"),
        F.when(clear, numbered(F.col("tag_number"), F.col("nth_clear"))).otherwise("").alias("transparent_filename"),
    )
