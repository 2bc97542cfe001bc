"""Audit chains, configuration differences, dependency graphs and baseline gates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.storage import drop_stored, fresh_path, stored

# --- fixed values: results depend on them ---------------------------------------
GENESIS = "0" * 64
TOLERANCE, LATENCY_RATIO, LATENCY_FLOOR_MS = 0.0005, 2.0, 5.0
QUALITY = ("recall_at_k", "mrr", "ndcg_at_k", "accuracy")
LATENCY = ("mean_latency_ms", "p95_latency_ms")
# -------------------------------------------------------------------------------

#: Records of all chains that go in one round.
PART = 1 << 20


def _entry(prev: str, seq_no: int, body: str) -> str:
    return hashlib.sha256(f"{prev}|{seq_no}|{body}".encode()).hexdigest()


def parted(rows: DataFrame, column: str) -> tuple[DataFrame, int]:
    """Rows with part, the range of a numeric column that they stand in, and the number of ranges, each of about PART rows; equal values share one, nulls stand in the first."""
    parts = -(-rows.count() // PART)
    if parts < 2:
        return rows.withColumn("part", F.lit(0)), 1
    bounds = sorted(set(rows.approxQuantile(column, [k / parts for k in range(1, parts)], 1 / (8 * parts))))
    above = F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(column).cast("double"))
    return rows.withColumn("part", F.size(above)), len(bounds) + 1


def numbered(rows: DataFrame, key: str, column: str) -> tuple[DataFrame, int]:
    """Rows with seq_no, their place in their key by a numeric column, and part (see parted), and the number of parts.

    A task sorts a key's rows of one part, to which the numbers of rows in the
    parts before it are added.
    """
    rows, parts = parted(rows, column)
    own = F.row_number().over(Window.partitionBy(key, "part").orderBy(column)).cast("long")
    if parts == 1:
        return rows.withColumn("seq_no", own), 1
    sizes = rows.groupBy(F.col(key).alias("k"), F.col("part").alias("p")).agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("k").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("own", own).join(sizes.select("k", "p", earlier.alias("earlier")), F.col(key).eqNullSafe(F.col("k")) & (F.col("part") == F.col("p")))
    return placed.withColumn("seq_no", F.col("own") + F.col("earlier")).drop("own", "earlier", "k", "p"), parts


def chained(records: DataFrame, parts: int | None = None) -> DataFrame:
    """Records (chain, seq_no, body) with prev_hash and entry_hash; null bodies count as empty.

    A chain starts at GENESIS and runs on through all segments (days, files) of
    its writer. Each hash needs the one before, so a chain's records go in
    order: in rounds of about PART records, in which each chain is one sorted
    stream of one task that holds only the last hash. A round's last hashes
    begin the next. Records may bring their rounds, 0 to parts - 1, as a column
    part that doesn't fall where seq_no rises in a chain.
    """
    rows = records.select("chain", F.col("seq_no").cast("long").alias("seq_no"), F.coalesce("body", F.lit("")).alias("body"), *(["part"] if parts else []))
    if not parts:
        rows, parts = parted(rows, "seq_no")
    rows = rows.withColumn("entry_hash", F.lit(None).cast("string"))
    if parts == 1:
        return _linked(rows.drop("part"), False)
    spark, came, made = rows.sparkSession, fresh_path(rows.sparkSession, "chain-parts"), fresh_path(rows.sparkSession, "chain")
    rows.repartition("part", "chain").write.option("compression", "zstd").partitionBy("part").parquet(came)
    came = spark.read.schema(rows.schema).parquet(came)
    ends, done = None, []
    for k in range(parts):
        now = came.where(F.col("part") == k).drop("part")
        done.append(f"{made}/{k}")
        linked = _linked(now if ends is None else now.unionByName(ends), k < parts - 1)
        linked.write.option("compression", "zstd").parquet(done[-1])
        ends = spark.read.schema(linked.schema).parquet(done[-1]).where("prev_hash is null").drop("prev_hash")
    drop_stored(came)
    return spark.read.schema(linked.schema).parquet(*done).where("prev_hash is not null")


def _linked(rows: DataFrame, ends: bool) -> DataFrame:
    """Records (chain, seq_no, body, entry_hash null) with their hashes; a row without body brings the hash that its chain goes on from, and with ends such a row closes each chain."""
    kind = rows.schema["chain"].dataType.simpleString()
    names = ["chain", "seq_no", "body", "prev_hash", "entry_hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closing(closed: list) -> Iterator[pa.RecordBatch]:
            if ends and closed:
                chains, hashes = zip(*closed)
                nulls = [pa.nulls(len(closed), t) for t in (pa.int64(), pa.string(), pa.string())]
                yield pa.record_batch([pa.array(chains, of), *nulls, pa.array(hashes, pa.string())], names=names)

        begun, own, last = False, None, GENESIS
        for b in batches:
            of, prev, entry, closed = b.schema.field("chain").type, [], [], []
            for chain, seq_no, body, known in zip(*(b.column(c).to_pylist() for c in ("chain", "seq_no", "body", "entry_hash"))):
                if not begun or chain != own:
                    if begun:
                        closed.append((own, last))
                    begun, own, last = True, chain, GENESIS
                if body is None:
                    last = known
                    continue
                prev.append(last)
                entry.append(last := _entry(last, seq_no, body))
            kept = b.filter(b.column("body").is_valid())
            yield pa.record_batch([*(kept.column(c) for c in names[:3]), pa.array(prev, pa.string()), pa.array(entry, pa.string())], names=names)
            yield from closing(closed)
        if begun:
            yield from closing([(own, last)])

    return rows.repartition("chain").sortWithinPartitions("chain", "seq_no", "body").mapInArrow(run, f"chain {kind}, seq_no long, body string, prev_hash string, entry_hash string")


def chain_faults(records: DataFrame) -> DataFrame:
    """Records that break their chain: a gap in numbers (or one used twice), a wrong predecessor, or a digest that doesn't fit.

    Every record meets its predecessor by its number, so a long chain is
    verified by as many tasks as there are. Numbers begin at 1, after GENESIS.
    """
    before = records.groupBy("chain", (F.col("seq_no") + 1).alias("seq_no")).agg(F.min("entry_hash").alias("expected"))
    rows = records.withColumn("again", F.count("*").over(Window.partitionBy("chain", "seq_no")) > 1).join(before, ["chain", "seq_no"], "left")
    first = F.col("seq_no") == 1
    digest = F.sha2(F.concat_ws("|", "prev_hash", F.col("seq_no").cast("string"), "body"), 256)
    fault = (
        F.when(F.col("again") | (~first & F.col("expected").isNull()), "gap")
        .when(F.col("prev_hash") != F.when(first, F.lit(GENESIS)).otherwise(F.col("expected")), "predecessor")
        .when(F.col("entry_hash") != digest, "digest")
    )
    return rows.select("chain", "seq_no", fault.alias("fault")).where("fault is not null")


def chain_status(records: DataFrame, heads: bool = True) -> DataFrame:
    """Per chain: records, whether it is intact, where and why it breaks first, and (with heads) the last good hash.

    Only numbers are added up over all records, which needs no sort.
    """
    same = lambda other: F.col("chain").eqNullSafe(F.col(other))
    faults = chain_faults(records).groupBy(F.col("chain").alias("c")).agg(F.min(F.struct("seq_no", "fault")).alias("f"))
    made = records.groupBy("chain").agg(F.count("*").alias("total")).join(faults, same("c"), "left")
    out = made.select("chain", "total", F.col("f").isNull().alias("intact"), F.col("f.seq_no").alias("broken_at"), F.col("f.fault").alias("reason"))
    if not heads:
        return out
    good = records.join(faults, same("c"), "left").where(F.col("f").isNull() | (F.col("seq_no") < F.col("f.seq_no")))
    last = good.groupBy(F.col("chain").alias("d")).agg(F.max("seq_no").alias("last"))
    head = records.join(last, same("d") & (F.col("seq_no") == F.col("last"))).select("d", F.col("entry_hash").alias("head"))
    return out.join(head, same("d"), "left").withColumn("head_hash", F.coalesce("head", F.lit(GENESIS))).drop("d", "head")


def audit_query(records: DataFrame, k: int = 2000, since=None, until=None, **equal: str) -> DataFrame:
    """The newest k records with all given values (empty ones don't count) that were recorded from since to until, both included."""
    for column, value in equal.items():
        if value:
            records = records.where(F.col(column) == value)
    if since is not None:
        records = records.where(F.col("recorded_at") >= since)
    if until is not None:
        records = records.where(F.col("recorded_at") <= until)
    return records.orderBy(F.desc("seq_no")).limit(k)


def differences(current: DataFrame, recorded: DataFrame) -> DataFrame:
    """added, removed, version or content for components (id, version, hash) that differ."""
    a = current.select("id", F.col("version").alias("v1"), F.col("hash").alias("h1"))
    b = recorded.select("id", F.col("version").alias("v2"), F.col("hash").alias("h2"))
    change = F.when(F.col("v2").isNull(), "added").when(F.col("v1").isNull(), "removed").when(F.col("v1") != F.col("v2"), "version").when(F.col("h1") != F.col("h2"), "content")
    return a.join(b, "id", "full").select("id", change.alias("change")).where("change is not null")


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """All nodes reachable from each root (root, node), itself included at depth 0, with the least number of steps.

    Each round goes one step from the nodes that the one before found, and ends
    when no new pair appears, so depth has no bound and cycles end. A round's
    rows are a table in the shared folder.
    """
    steps = edges.select("src", "dst").distinct()
    frontier = reached = stored(roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth")).distinct(), "closure")
    tables, depth = [reached], 0
    while not frontier.isEmpty():
        depth += 1
        known = F.col("r.root").eqNullSafe(F.col("s.root")) & F.col("r.node").eqNullSafe(F.col("s.node"))
        made = frontier.join(steps, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"), F.lit(depth).alias("depth")).distinct()
        frontier = stored(made.alias("s").join(reached.alias("r"), known, "left_anti"), "closure")
        reached = reached.unionByName(frontier)
        tables.append(frontier)
        if len(tables) == 16:  # one table again, or the plan would grow with the depth
            reached = stored(reached, "closure")
            for done in tables[:-1]:
                drop_stored(done)
            tables = [reached, frontier]
    return reached


def cycles(edges: DataFrame) -> DataFrame:
    """Nodes that stand on a cycle, each with the least node of its cycle's component and its shortest way back to itself.

    Edges from nodes that nothing enters, and to nodes that nothing leaves, go
    round by round; what is left holds all cycles and is closed over.
    """
    rest = stored(edges.select("src", "dst").distinct(), "edges")
    n = rest.count()
    while n:
        kept = rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        smaller = stored(kept.select("src", "dst"), "edges")
        drop_stored(rest)
        rest, before, n = smaller, n, smaller.count()
        if n == before:
            break
    reached = closure(rest, rest.select(F.col("src").alias("node")).distinct())
    back = reached.select(F.col("root").alias("a"), F.col("node").alias("b")).join(reached.select(F.col("root").alias("b"), F.col("node").alias("a")), ["a", "b"])
    component = back.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("cycle"))
    steps = rest.join(reached, (F.col("dst") == F.col("root")) & (F.col("src") == F.col("node"))).groupBy(F.col("src").alias("node")).agg((F.min("depth") + 1).alias("steps"))
    return steps.join(component, "node").select("node", "cycle", "steps")


def gate(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings (suite, metric, finding) between two tables of values (suite, metric, value).

    A suite that is gone blocks, a new one is noted. A metric counts where both
    sides have it: a quality drop over the tolerance, fewer cases and more
    misroutes block; more known limitations, and a latency over both twice
    the baseline and 5 ms, warn.
    """
    c, b = current.select("suite", "metric", F.col("value").alias("now")), baseline.select("suite", "metric", F.col("value").alias("was"))
    metric, now, was = F.col("metric"), F.col("now"), F.col("was")
    finding = (
        F.when(metric.isin(*QUALITY), F.when(now < was - TOLERANCE, "block: lower quality"))
        .when(metric == "total", F.when(now < was, "block: fewer cases"))
        .when(metric == "misroutes", F.when(now > was, "block: more misroutes"))
        .when(metric == "known_limitations", F.when(now > was, "warn: more limitations"))
        .when(metric.isin(*LATENCY), F.when((was > 0) & (now > F.greatest(LATENCY_RATIO * was, F.lit(LATENCY_FLOOR_MS))), "warn: slower"))
    )
    metrics = c.join(b, ["suite", "metric"]).select("suite", "metric", finding.alias("finding")).where("finding is not null")
    suites = c.select("suite", F.lit(1).alias("c")).distinct().join(b.select("suite", F.lit(1).alias("b")).distinct(), "suite", "full").where("c is null or b is null")
    return metrics.unionByName(suites.select("suite", F.lit("__suite__").alias("metric"), F.when(F.col("c").isNull(), "block: removed").otherwise("note: added").alias("finding")))
