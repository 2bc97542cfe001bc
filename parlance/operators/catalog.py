"""Catalogues of blocks, their bundles and releases, and sizes of installations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.governance import closure, cycles

# --- fixed values: results depend on them ---------------------------------------
VERSION = r"^\d+\.\d+\.\d+(-[0-9A-Za-z.]+)?$"
DAY, COMMIT, DIGEST = r"^\d{4}-\d{2}-\d{2}$", r"^[0-9a-f]{40}$", r"^[0-9a-f]{64}$"
CHANNELS_PER_SEAT, CONCURRENCY = 2, 0.75
CHANNELS_PER_DEVICE = {"stt-small-gpu": 64, "stt-large-gpu": 24, "stt-small-cpu": 4, "tts-gpu": 96, "spk-gpu": 128}
PRIVATE_KEY = r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"
# -------------------------------------------------------------------------------


def _each(blocks: DataFrame, column: str) -> DataFrame:
    return blocks.select("id", F.explode(column).alias("name")).distinct()


def producers(blocks: DataFrame) -> DataFrame:
    """(topic, producers, producer): how many blocks produce a topic, and which if it is just one."""
    made = _each(blocks, "produces").groupBy(F.col("name").alias("topic")).agg(F.count("*").alias("producers"), F.min("id").alias("id"))
    return made.select("topic", "producers", F.when(F.col("producers") == 1, F.col("id")).alias("producer"))


def bundle_edges(blocks: DataFrame) -> DataFrame:
    """(src, dst, reason): what a block brings along: dependencies, the only producers of its topics, known recommendations.

    blocks has id and arrays depends_on, recommends, consumes and produces.
    """
    known = blocks.select(F.col("id").alias("name"))
    needs = _each(blocks, "depends_on").select(F.col("id").alias("src"), F.col("name").alias("dst"), F.lit("depends").alias("reason"))
    topics = _each(blocks, "consumes").join(producers(blocks).where("producers = 1"), F.col("name") == F.col("topic")).select(F.col("id").alias("src"), F.col("producer").alias("dst"), F.lit("produces").alias("reason"))
    wishes = _each(blocks, "recommends").join(known, "name", "left_semi").select(F.col("id").alias("src"), F.col("name").alias("dst"), F.lit("recommends").alias("reason"))
    return needs.unionByName(topics).unionByName(wishes).distinct()


def bundle(blocks: DataFrame, requested: DataFrame, always: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of a bundle (id) with why they are in: requested, recommended (by some block in it), else by dependency.

    Requested ids that the catalogue lacks come back as `unknown`.
    """
    asked = requested.select("id").unionByName(blocks.where(F.col("id").isin(*always)).select("id")).distinct()
    edges = bundle_edges(blocks)
    seeds = asked.join(blocks.select("id"), "id", "left_semi")
    inside = closure(edges, seeds.select(F.col("id").alias("node"))).select(F.col("node").alias("id")).distinct()
    wished = edges.where("reason = 'recommends'").join(inside.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    why = F.when(F.col("a"), "requested").when(F.col("w"), "recommended").otherwise("dependency")
    rows = inside.join(asked.withColumn("a", F.lit(True)), "id", "left").join(wished.withColumn("w", F.lit(True)), "id", "left").join(blocks.select("id", F.lit(True).alias("known")), "id", "left")
    lost = asked.join(blocks.select("id"), "id", "left_anti").select("id", F.lit("unknown").alias("reason"))
    return rows.select("id", F.when(F.col("known").isNull(), "unknown").otherwise(why).alias("reason")).unionByName(lost)


def catalogue_problems(blocks: DataFrame) -> DataFrame:
    """(id, problem, name): repeated ids, unknown dependencies, consumed topics without producer, unbillable blocks, cycles.

    Further columns: included (in the package) and capacity_unit.
    """
    known, problem = blocks.select(F.col("id").alias("name")).distinct(), lambda text: F.lit(text).alias("problem")
    twice = blocks.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", problem("repeated id"), F.col("id").alias("name"))
    unknown = _each(blocks, "depends_on").join(known, "name", "left_anti").select("id", problem("unknown dependency"), "name")
    silent = _each(blocks, "consumes").join(producers(blocks).select(F.col("topic").alias("name")), "name", "left_anti").select("id", problem("no producer"), "name")
    free = blocks.where(~F.col("included") & (F.col("capacity_unit") == "none")).select("id", problem("unbillable"), F.lit("").alias("name"))
    loops = cycles(_each(blocks, "depends_on").select(F.col("id").alias("src"), F.col("name").alias("dst"))).select(F.col("node").alias("id"), problem("cycle"), F.col("cycle").alias("name"))
    return twice.unionByName(unknown).unionByName(silent).unionByName(free).unionByName(loops)


def licensed(entries: Column) -> Column:
    """Ids of a licence's map of id to (enabled), sorted; a missing flag counts as enabled."""
    return F.array_sort(F.transform(F.filter(F.map_entries(entries), lambda e: F.coalesce(e["value"]["enabled"], F.lit(True))), lambda e: e["key"]))


def channel_limit(blocks: DataFrame) -> DataFrame:
    """The least channel limit of enabled blocks that have one, and its block (ties by id); nulls without any."""
    return blocks.where("enabled and concurrent_channels is not null").agg(F.min(F.struct("concurrent_channels", "id")).alias("m")).select(F.col("m.concurrent_channels").alias("channels"), F.col("m.id").alias("id"))


def utilisation(active: Column, limit: Column) -> Column:
    """Share of a limit in use (three decimals); null without a limit."""
    return F.when(limit > 0, F.round(active / limit, 3))


def status(checks: DataFrame) -> DataFrame:
    """Ready blocks, all blocks, and whether all are ready."""
    return checks.agg(F.count_if("ready").alias("ready"), F.count("*").alias("total"), F.coalesce(F.bool_and("ready"), F.lit(True)).alias("healthy"))


def configuration_hash(components: DataFrame, key: str = "package") -> DataFrame:
    """SHA-256 over each package's components (id, version, hash) in order of id."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("id", "version", "hash"))), lambda c: F.concat_ws(":", c["id"], c["version"], c["hash"]))
    return components.groupBy(key).agg(F.sha2(F.array_join(parts, "\n"), 256).alias("hash"))


def capacity(seats: Column, profile: Column, concurrency: float = CONCURRENCY, with_tts: bool = False, with_speakers: bool = True) -> Column:
    """Struct of channels and of devices for recognition, speakers and speech that a number of seats needs."""
    per = F.create_map(*(F.lit(x) for pair in CHANNELS_PER_DEVICE.items() for x in pair))
    channels = F.ceil(seats * CHANNELS_PER_SEAT * concurrency)
    devices = lambda n, kind: F.ceil(n / per[kind]).cast("long")
    return F.struct(
        channels.cast("long").alias("channels"), devices(channels, profile).alias("stt"), (devices(channels, F.lit("spk-gpu")) if with_speakers else F.lit(0).cast("long")).alias("speakers"),
        (devices(F.ceil(channels / 2), F.lit("tts-gpu")) if with_tts else F.lit(0).cast("long")).alias("tts"),
        (profile.endswith("-cpu") & (channels > 4 * CHANNELS_PER_DEVICE["stt-small-cpu"])).alias("too_many_for_cpu"),
    )


def _version(version: Column) -> Column:
    core = F.split(F.split(version, "-")[0], "\\.")
    return F.struct(*(core[k].cast("int").alias(f"v{k}") for k in range(3)), F.when(version.contains("-"), 0).otherwise(1).alias("v3"))


def release_faults(releases: DataFrame) -> DataFrame:
    """(line, version, problem) of a product's history: releases has product, line, version, released_at, commit and packages (map).

    Each release is held against the last one before it whose version has the right form.
    """
    good = F.col("version").rlike(VERSION)
    before = Window.partitionBy("product").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    rows = releases.withColumn("key", F.when(good, _version(F.col("version"))))
    rows = rows.withColumn("last", F.last(F.when(good, F.struct("key", "released_at")), ignorenulls=True).over(before))
    again = F.row_number().over(Window.partitionBy("product", "version").orderBy("line")) > 1
    rows = rows.withColumn("again", again)
    bad = F.exists(F.map_values("packages"), lambda d: ~d.rlike(DIGEST))
    problems = F.when(~good, F.array(F.lit("version"))).otherwise(F.array_compact(F.array(
        F.when(F.col("again"), "repeated"), F.when(~F.col("released_at").rlike(DAY), "date"), F.when(~F.col("commit").rlike(COMMIT), "commit"), F.when(F.size("packages") == 0, "no packages"), F.when(bad, "digest"),
        F.when(F.col("key") <= F.col("last.key"), "version goes back"), F.when(F.col("released_at") < F.col("last.released_at"), "date goes back"),
    )))
    return rows.select("product", "line", "version", F.explode(problems).alias("problem"))


def secrets(files: DataFrame, names: tuple[str, ...] = (".env", "license.key", "master.key", "id_rsa")) -> DataFrame:
    """(path, problem) of files (path, content) that no release may hold: private keys by their text, secrets by their names."""
    name = F.element_at(F.split("path", "/"), -1)
    found = F.when(F.decode("content", "ISO-8859-1").rlike(PRIVATE_KEY), "private key").when(name.isin(*names), "secret")
    return files.select("path", found.alias("problem")).where("problem is not null")


def effort(blocks: DataFrame) -> DataFrame:
    """Person-months and blocks per tier, with a last row (tier null) for all."""
    return blocks.groupingSets([("tier",), ()], "tier").agg(F.count("*").alias("blocks"), F.sum("effort").alias("effort"))


def shared_components(a: Column, b: Column, least: int = 2) -> Column:
    """Whether two machines' maps of component to hash are of one machine: enough equal components, or all equal."""
    shared = F.size(F.filter(F.map_keys(a), lambda k: a[k] == F.try_element_at(b, k)))
    return (F.size(a) > 0) & (shared >= F.least(F.lit(least), F.size(a), F.size(b))) & (F.size(b) > 0)
