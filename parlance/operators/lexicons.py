"""Lexicons and readings of many tenants in one plan: an automaton for each tenant and version, longest form first."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.speech import spoken
from parlance.functions.text import MAX_LEXICON
from parlance.storage import stored

#: Up to so many characters of forms are sent to all tasks; more are dealt out with their tenants' events.
BROADCAST_CHARS = 32_000_000
#: Events of a tenant for each part that they are dealt in.
PART_ROWS = 200_000
#: Automata that a task keeps.
_KEPT = 256
_FORMS = "array<struct<form:string,put:string>>"


def current(table: DataFrame) -> DataFrame:
    """The rows (tenant_id, version, entries) of each tenant's highest version."""
    newest = F.row_number().over(Window.partitionBy("tenant_id").orderBy(F.desc("version")))
    return table.withColumn("place", newest).where("place = 1").drop("place")


def lexicon_forms(lexicons: DataFrame, most: int = MAX_LEXICON) -> DataFrame:
    """(tenant_id, version, forms) of lexicons (tenant_id, version, entries of surface, variants, enabled).

    The first `most` enabled entries with a surface count; a form is a surface or
    a variant, which the surface replaces. Forms stand in order, the longest
    without white space first; of equal ones the first counts, and forms under
    two characters don't.
    """
    bare = lambda s: F.regexp_replace(s, r"(?U)\s+", "")
    surface = lambda e: F.regexp_replace(e["surface"], r"(?U)^\s+|\s+$", "")
    used = F.slice(F.filter("entries", lambda e: F.coalesce(e["enabled"], F.lit(True)) & (surface(e) != "")), 1, most)
    each = F.flatten(F.transform(used, lambda e: F.transform(F.concat(F.array(surface(e)), F.coalesce(e["variants"], F.expr("cast(array() as array<string>)"))), lambda v: F.struct(bare(v).alias("form"), surface(e).alias("put")))))
    rows = current(lexicons).select("tenant_id", "version", F.filter(each, lambda f: F.length(f["form"]) >= 2).alias("forms"))
    return rows.select("tenant_id", "version", _ordered(lambda f: F.length(f["form"])).alias("forms"))


def reading_forms(readings: DataFrame) -> DataFrame:
    """(tenant_id, version, forms) of readings (tenant_id, version, entries of surface, reading): the longest surface first, as it is written."""
    each = F.transform("entries", lambda e: F.struct(F.regexp_replace(e["surface"], r"(?U)\s+", "").alias("form"), e["reading"].alias("put"), F.length(e["surface"]).alias("size")))
    rows = current(readings).select("tenant_id", "version", F.filter(each, lambda f: (f["form"] != "") & f["put"].isNotNull()).alias("forms"))
    return rows.select("tenant_id", "version", F.transform(_ordered(lambda f: f["size"]), lambda f: F.struct(f["form"], f["put"])).alias("forms"))


def _ordered(size):
    """The forms by falling size, those of one size as they stood."""
    numbered = F.transform("forms", lambda f, i: F.struct((-size(f)).alias("size"), i.alias("at"), f.alias("f")))
    return F.transform(F.array_sort(numbered), lambda x: x["f"])


class Forms:
    """Replacement of forms in one pass: the leftmost, of those that start there the first; white space may stand inside.

    White space is left out of the text, an automaton finds all forms in what
    remains, and matches are put back at the places where they began and ended.
    """

    def __init__(self, forms: tuple[tuple[str, str], ...]):
        import ahocorasick

        self.automaton, known = ahocorasick.Automaton(), set()
        for rank, (form, put) in enumerate(forms):
            if form not in known:
                known.add(form)
                self.automaton.add_word(form, (len(form), rank, put))
        self.any = bool(known)
        if self.any:
            self.automaton.make_automaton()

    def replaced(self, text: str) -> str:
        if not self.any or not text:
            return text
        place = [k for k, c in enumerate(text) if not c.isspace()]
        first: dict[int, tuple[int, int, str]] = {}  # by start: rank, length, replacement
        for end, (length, rank, put) in self.automaton.iter("".join(map(text.__getitem__, place))):
            start = end - length + 1
            if start not in first or rank < first[start][0]:
                first[start] = (rank, length, put)
        out, at, free = [], 0, 0
        for start in sorted(first):
            if start >= free:
                _, length, put = first[start]
                out += (text[at : place[start]], put)
                free = start + length
                at = place[free - 1] + 1
        return "".join(out) + text[at:]


@lru_cache(maxsize=_KEPT)
def _automaton(forms: tuple[tuple[str, str], ...]) -> Forms:
    return Forms(forms)


def _with_text(batch: pa.RecordBatch, column: str, texts: list[str | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if name == column else batch.column(name) for name in batch.schema.names], names=batch.schema.names)


def _known(tables: dict[str | None, tuple[tuple[str, str], ...]], column: str):
    """Events with their tenant's forms from a table that all tasks have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if t is None or tenant not in tables else _automaton(tables[tenant]).replaced(t) for tenant, t in zip(b.column("tenant_id").to_pylist(), b.column(column).to_pylist())]
            yield _with_text(b, column, texts)

    return run


def _met(column: str):
    """Rows in order of tenant and part, the forms before the events."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tenant, forms = None, None
        for b in batches:
            texts, keep = [], []
            for own, text, is_event, held in zip(b.column("tenant_id").to_pylist(), b.column(column).to_pylist(), b.column("_event").to_pylist(), b.column("_forms")):
                if not is_event:
                    tenant, forms = own, Forms(tuple((f["form"], f["put"]) for f in held.as_py()))
                texts.append(forms.replaced(text) if text is not None and is_event and forms is not None and own == tenant else text)
                keep.append(is_event)
            made = _with_text(b, column, texts).filter(pa.array(keep))
            yield made.select([n for n in made.schema.names if n not in ("_event", "_forms", "_part")])

    return run


def with_forms(events: DataFrame, forms: DataFrame, column: str = "text", broadcast_chars: int = BROADCAST_CHARS, part_rows: int = PART_ROWS) -> DataFrame:
    """Events (tenant_id, a text column, any others) with their tenant's forms (tenant_id, forms) put in; tenants without forms keep their texts.

    Forms of all tenants together are measured first. Up to `broadcast_chars`
    they go to all tasks, and events aren't moved; streams take this way
    always. Beyond, each tenant's forms are dealt out with its events, a tenant
    with many events in several parts, and a task holds one tenant's automaton
    at a time. A null tenant has no forms.
    """
    forms = forms.where("tenant_id is not null").select("tenant_id", F.col("forms").cast(_FORMS).alias("_forms"))
    size = forms.agg(F.sum(F.aggregate("_forms", F.lit(0).cast("long"), lambda t, f: t + F.length(f["form"]) + F.length(f["put"]) + 8))).first()[0] or 0
    if events.isStreaming or size <= broadcast_chars:
        tables = {r["tenant_id"]: tuple((f["form"], f["put"]) for f in r["_forms"]) for r in forms.collect()}
        return events.mapInArrow(_known(tables, column), events.schema)
    parts = stored(events.groupBy("tenant_id").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("_parts")), "parts")
    names = events.columns
    dealt = events.join(parts, events["tenant_id"].eqNullSafe(parts["tenant_id"])).select(*(events[c] for c in names), F.pmod(F.xxhash64(*(events[c] for c in names if c != "tenant_id")), F.col("_parts")).cast("int").alias("_part"))
    dealt = dealt.select(*names, "_part", F.lit(True).alias("_event"), F.lit(None).cast(_FORMS).alias("_forms"))
    each = forms.join(parts, "tenant_id").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    each = each.select(*(F.col("tenant_id") if f.name == "tenant_id" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema.fields), "_part", F.lit(False).alias("_event"), "_forms")
    return dealt.unionByName(each).repartition("tenant_id", "_part").sortWithinPartitions("tenant_id", "_part", "_event").mapInArrow(_met(column), events.schema)


def corrected_by_tenant(events: DataFrame, lexicons: DataFrame, column: str = "text", most: int = MAX_LEXICON, **limits: int) -> DataFrame:
    """Recognised texts corrected by each tenant's newest lexicon."""
    return with_forms(events, lexicon_forms(lexicons, most), column, **limits)


def spoken_by_tenant(events: DataFrame, readings: DataFrame, column: str = "text", **limits: int) -> DataFrame:
    """Texts as a voice should read them, by each tenant's newest readings, then the rules for numbers and acronyms."""
    return with_forms(events, reading_forms(readings), column, **limits).withColumn(column, spoken(F.col(column)))


def prompts(lexicons: DataFrame, most: int = 200) -> DataFrame:
    """(tenant_id, version, prompt) of each tenant's newest lexicon: surfaces joined by commas, as many from the first on as fit."""
    used = F.filter("entries", lambda e: F.coalesce(e["enabled"], F.lit(True)) & (F.trim(e["surface"]) != ""))
    names = F.transform(F.slice(used, 1, MAX_LEXICON), lambda e: F.trim(e["surface"]))
    empty = F.struct(F.lit(0).alias("length"), F.lit(False).alias("full"), F.expr("cast(array() as array<string>)").alias("out"))

    def add(s, name):
        fits = ~s["full"] & (s["length"] + F.length(name) + 2 <= most)
        return F.struct(F.when(fits, s["length"] + F.length(name) + 2).otherwise(s["length"]).alias("length"), (~fits).alias("full"), F.when(fits, F.concat(s["out"], F.array(name))).otherwise(s["out"]).alias("out"))

    return current(lexicons).select("tenant_id", "version", F.aggregate(names, empty, add, lambda s: F.array_join(s["out"], ", ")).alias("prompt"))


__all__ = ["corrected_by_tenant", "current", "lexicon_forms", "prompts", "reading_forms", "spoken_by_tenant", "with_forms"]
