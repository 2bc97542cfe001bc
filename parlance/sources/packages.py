"""Catalogues and packages from folders of files: manifests, hash trees, and what differs between two of them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: results depend on them ---------------------------------------
#: Files that a component's hash covers, in this order.
SOURCES = (r"^block\.yaml$", r"^pyproject\.toml$", r"^src/(.*/)?[^/]+\.py$", r"^contracts/(.*/)?[^/]+\.yaml$")
HASH_CHARS = 16
# -------------------------------------------------------------------------------

MANIFEST = (
    "directory string, id string, name string, tier string, version string, depends_on array<string>, recommends array<string>, adapters array<string>, infra array<string>, "
    "consumes array<string>, produces array<string>, capacity_unit string, effort double, included boolean, license_key string, problem string"
)


def _texts(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").load(pattern).select("path", F.decode("content", "UTF-8").alias("text"))


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """A row of MANIFEST for each <path>/*/block.yaml; problem says why a manifest can't be used, and is null otherwise."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(MANIFEST))

    def row(directory: str, text: str) -> dict:
        import yaml

        out = dict.fromkeys(schema.names) | {"directory": directory}
        try:
            raw = yaml.safe_load(text)
        except yaml.YAMLError as e:
            return out | {"problem": f"no YAML: {str(e).splitlines()[0]}"}
        if not isinstance(raw, dict):
            return out | {"problem": "no map"}
        topics, billing = raw.get("contracts") or {}, raw.get("billing") or {}
        if lost := [k for k in ("id", "name", "tier", "version") if not isinstance(raw.get(k), str)] + (["billing.capacity_unit"] if "capacity_unit" not in billing else []):
            return out | {"problem": f"lacks {', '.join(lost)}"}
        many = lambda of, k: [str(x) for x in of.get(k) or ()]
        return out | {k: raw[k] for k in ("id", "name", "tier", "version")} | {k: many(raw, k) for k in ("depends_on", "recommends", "adapters", "infra")} | {k: many(topics, k) for k in ("consumes", "produces")} | {
            "capacity_unit": str(billing["capacity_unit"]), "effort": float(billing.get("dev_effort_mm") or 0), "included": bool(billing.get("included_in_package")), "license_key": raw.get("license_key") or raw["id"],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pylist([row(p.rsplit("/", 2)[-2], t) for p, t in zip(b.column("path").to_pylist(), b.column("text").to_pylist())], schema)

    return _texts(spark, f"{path}/*/block.yaml").mapInArrow(run, MANIFEST)


def enabled(spark: SparkSession, path: str) -> DataFrame:
    """(directory) of the blocks that a file of settings (blocks: name: enabled) turns on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        for b in batches:
            blocks = [((yaml.safe_load(t) or {}).get("blocks") or {}).items() for t in b.column("text").to_pylist()]
            yield pa.record_batch([pa.array([str(n) for each in blocks for n, c in each if (c or {}).get("enabled")], pa.string())], names=["directory"])

    return _texts(spark, path).mapInArrow(run, "directory string")


def files(spark: SparkSession, path: str, sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """(component, file, digest, place) of the source files of each folder under a path; place is the pattern that takes it."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = path.split("://", 1)[-1].lstrip("file:").rstrip("/")
    whole = rows.select(F.substring_index("path", f"{root}/", -1).alias("at"), F.sha2("content", 256).alias("digest"))
    place = F.coalesce(*(F.when(F.col("file").rlike(p), F.lit(k)) for k, p in enumerate(sources)))
    named = whole.where(F.col("at").contains("/") & ~F.col("at").rlike(r"(^|/)__pycache__/")).select(F.substring_index("at", "/", 1).alias("component"), F.regexp_replace("at", "^[^/]*/", "").alias("file"), "digest")
    return named.withColumn("place", place).where("place is not null")


def component_hashes(rows: DataFrame) -> DataFrame:
    """(component, hash) over the names and contents of a component's files, pattern by pattern, in order of name."""
    each = F.transform(F.array_sort(F.collect_list(F.struct("place", "file", "digest"))), lambda f: F.concat(F.hex(f["file"]), F.lit("00"), F.upper(f["digest"])))
    return rows.groupBy("component").agg(F.substring(F.sha2(F.unhex(F.array_join(each, "")), 256), 1, HASH_CHARS).alias("hash"))


def package_hash(components: DataFrame) -> DataFrame:
    """(package, components, hash) of components (package, place, id, version, hash), in order of place."""
    part = lambda c: F.concat(*(x for k in ("id", "version", "hash") for x in (F.hex(F.coalesce(c[k], F.lit(""))), F.lit("00"))))
    each = F.transform(F.array_sort(F.collect_list(F.struct("place", "id", "version", "hash"))), part)
    return components.groupBy("package").agg(F.count("*").alias("components"), F.sha2(F.unhex(F.array_join(each, "")), 256).alias("hash"))


def frozen(package: str, blocks: DataFrame, wanted: DataFrame, hashes: DataFrame) -> DataFrame:
    """Components of a package: (package, place, id, name, version, kind, hash).

    blocks as manifests gives them, wanted (directory), hashes of their files.
    Blocks stand by directory, then the infrastructure that they need by name.
    A wanted block that the catalogue lacks is an error.
    """
    text = lambda s: F.lit(s)
    joined = wanted.distinct().join(blocks.where("problem is null"), "directory", "left").join(hashes, F.col("directory") == F.col("component"), "left")
    checked = joined.withColumn("id", F.coalesce("id", F.raise_error(F.concat(F.lit("no such block: "), "directory")).cast("string")))
    own = checked.select(text(package).alias("package"), F.struct(F.lit(0).alias("kind"), F.col("directory").alias("name")).alias("place"), "id", "name", "version", text("block").alias("kind"), "hash")
    needs = checked.select(F.explode("infra").alias("name")).distinct()
    outside = needs.select(text(package).alias("package"), F.struct(F.lit(1).alias("kind"), "name").alias("place"), F.concat(text("infra:"), "name").alias("id"), "name", text("").alias("version"), text("infra").alias("kind"), text("").alias("hash"))
    return own.unionByName(outside)


def hash_tree(rows: DataFrame) -> DataFrame:
    """(component, path, digest, is_file) of every file and folder: a folder's digest covers its children's names and digests.

    Built a level at a time from the deepest folders, so a folder is one row a
    child; the component's own folder is the empty path.
    """
    level = rows.select("component", F.col("file").alias("path"), "digest", F.size(F.split("file", "/")).alias("depth")).withColumn("is_file", F.lit(True))
    depth, out = level.agg(F.max("depth")).first()[0] or 0, level
    for d in range(depth, 0, -1):
        parent = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
        child = F.struct(F.substring_index("path", "/", -1).alias("name"), "digest")
        folders = out.where(F.col("depth") == d).groupBy("component", parent.alias("path")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda c: F.concat(c["name"], F.lit("\0"), c["digest"])), "\n"), 256).alias("digest"))
        out = out.unionByName(folders.select("component", "path", "digest", F.lit(d - 1).alias("depth"), F.lit(False).alias("is_file")))
    return out.select("component", "path", "digest", "is_file")


def tree_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(component, path, change) between two hash trees: changed files, and of what was added or removed the highest folder or file."""
    a, b = (t.select("component", "path", F.col("digest").alias(n), F.col("is_file").alias(f"{n}_file")) for t, n in ((old, "was"), (new, "now")))
    both = a.join(b, ["component", "path"], "full").where(~F.col("was").eqNullSafe(F.col("now")))
    state = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was_file") & F.col("now_file"), "changed").when(F.col("was_file") | F.col("now_file"), "replaced")
    rows = both.select("component", "path", state.alias("change"), F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path") != "", F.lit("")).alias("parent")).where("change is not null")
    above = rows.where("change in ('added', 'removed')").select("component", F.col("path").alias("parent"), "change")
    return rows.join(above, ["component", "parent", "change"], "left_anti").select("component", "path", "change")
