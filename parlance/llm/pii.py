"""Personal data: base patterns, further candidates and boosted trees, found in SQL functions only (operator 3)."""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.speech import let
from parlance.llm._shared import drop_stored, held_out_bucket, stored

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Possessive repeats and the look-behind find the same
#: matches as the plain forms, without a stack of backtracking on long runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High-recall generators beside them: their spans overlap the base spans and each other.
WIDE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+\x20?(?:@|[\[({]at[\])}])\x20?[a-z0-9-]{1,64}+"
    r"(?:(?:\.|\x20\.\x20|\x20?[\[({](?:dot|\.)[\])}]\x20?|\x20?\.\x20?(?=(?:com|org|net|edu|gov)\b))[a-z0-9-]{1,64}+)++",
    "ip": r"(?i)(?<![0-9.])[0-9]{1,3}(?:(?:\.|\x20\.\x20?|\.\x20|\x20?[\[({](?:dot|\.)[\])}]\x20?)[0-9]{1,3}){3}+(?![0-9])",
    "card": r"(?<![0-9])[0-9]{3,6}(?:[\x20._/-]{1,3}[0-9]{3,6}){2,4}+(?![0-9])",
    "phone": r"(?<![0-9.+])(?:[(]?\+\x20?)?[(]?[0-9]{1,4}[)]?(?:[\x20.-]{0,3}[(]?[0-9]{2,4}[)]?){1,6}+(?![0-9])",
}
CONTEXT = r"(?i)(tel|phone|call|fax|mobile|mail|e-mail|contact|card|visa|account|telefon|anruf|karte|tarjeta|carte|tél|correo)[^\n]{0,16}$"
#: Trees and their rate. Values of a feature from BINS - 1 on share a bin.
TREES, RATE, BINS = 12, 0.4, 256
#: Sums over candidates are kept in whole numbers of this part of their weight, so that they don't hang on the order of rows.
UNITS = 1 << 50
#: Scores are told apart in steps of 1 / STEPS when the threshold is sought.
STEPS = 1000
#: Among set-aside candidates, the chosen ones must be right at least so often.
PRECISION = 0.98
#: Log-odds below which a candidate is never chosen.
LEAST = 2.0
FEATURES = ("kind_no", "valid", "digits", "seps", "length", "plus", "paren", "at", "dots", "spaces", "before", "after", "cue", "groups", "covers")
#: Least characters of a page, and most of a window that may reach over its end.
PAGE, WINDOW = 4096, 64
#: Up to so many spans of a text are handled as one run.
FEW = 64
#: Characters kept to the left and right of a base span that is written in another form.
LEFT, RIGHT = 48, 16


def _named(name: str, value: str, body: str) -> str:
    """SQL for body with a value that is computed once and has a name in it."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _runs(v: str) -> str:
    """SQL for a non-empty array in pieces of the square root of its size."""
    return _named("n", f"cast(ceil(sqrt(size({v}))) as int)", f"transform(sequence(0, cast(floor((size({v}) - 1) / n) as int)), i -> slice({v}, i * n + 1, n))")


def _before(values: str, add: str) -> str:
    """SQL: for each of an array of integers, what those before it come to by `add`, a form with {0} and {1} (associative, 0 is neutral).

    An array that grows by one is copied each time, so a single fold takes the
    square of n steps. Here runs of sqrt(n) are folded alone, then their
    totals, which takes n * sqrt(n) short copies.
    """

    def fold(xs: str) -> str:
        return f"aggregate({xs}, named_struct('total', 0, 'out', cast(array() as array<int>)), (s, x) -> named_struct('total', {add.format('s.total', 'x')}, 'out', concat(s.out, array(s.total))))"

    joined = f"flatten(zip_with(runs, {fold('transform(runs, r -> r.total)')}.out, (r, b) -> transform(r.out, x -> {add.format('b', 'x')})))"
    many = _named("runs", f"transform({_runs('v')}, u -> {fold('u')})", joined)
    return _named("v", values, f"CASE WHEN size(v) <= {FEW} THEN {fold('v')}.out ELSE {many} END")


def _matches(pattern: str) -> Column:
    """array<struct<start, end, match>>, in code points, end exclusive, of all leftmost matches in the column text.

    Written as SQL, since a tree of this size takes long to build call by call.
    """
    gaps = f"zip_with(slice(split(text, r'{pattern}', -1), 1, size(found)), found, (p, m) -> named_struct('gap', length(p), 'match', m))"
    before = _before("transform(pairs, p -> p.gap + length(p.match))", "{0} + {1}")
    placed = f"zip_with(pairs, {before}, (p, b) -> named_struct('start', b + p.gap, 'end', b + p.gap + length(p.match), 'match', p.match))"
    return F.expr(_named("found", f"regexp_extract_all(text, r'{pattern}', 0)", f"CASE WHEN size(found) = 0 THEN {_NONE} ELSE {_named('pairs', gaps, placed)} END"))


def _pages() -> Column:
    """struct<step, pages> of a long text, null of others: the column text in overlapping pages of step + WINDOW characters, about as many as fit three times in one.

    A substring costs the characters before it; of a page these are few.
    """
    pages = f"named_struct('step', n, 'pages', transform(sequence(0, cast(floor(length(text) / n) as int)), i -> substring(text, i * n + 1, n + {WINDOW})))"
    return F.expr(f"CASE WHEN length(text) >= {PAGE} THEN {_named('n', f'greatest({PAGE}, cast(ceil(3 * sqrt(length(text))) as int))', pages)} END")


def _window(start: Column, length: Column) -> Column:
    """At most WINDOW characters of the text from a place on, 0 the first."""
    step = F.col("cut")["step"]
    page = F.floor(start / step).cast("int")
    long = F.coalesce(F.substring(F.get(F.col("cut")["pages"], page), start - page * step + 1, length), F.lit(""))
    return F.when(F.col("cut").isNull(), F.substring("text", start + 1, length)).otherwise(long)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether digits pass the Luhn check."""

    def value(i):
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda t, i: t + value(i)) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        d = _digits(match)
        return F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _hint(text: Column, kind: str) -> Column:
    """False only for texts that can't hold the kind; it spares most texts the search."""
    if kind == "email":
        return text.contains("@") | text.rlike(r"(?i)[\[({]at[\])}]")
    return text.rlike({"ip": r"(?i)[0-9]\x20?(?:\.|[\[({](?:dot|\.)[\])}])\x20?[0-9]", "card": "[0-9][ -]?[0-9]", "phone": "[0-9][)]?[ .-]{0,3}[(]?[0-9]"}[kind])


_NONE = "cast(array() as array<struct<start:int,end:int,match:string>>)"


def base_spans(kind: str) -> Column:
    """The spans in the column text that the base rules take."""
    return F.when(_hint(F.col("text"), kind), F.filter(_matches(BASE[kind]), lambda s: _valid(kind, s["match"]))).otherwise(F.expr(_NONE))


def _candidates() -> Column:
    """array<struct<kind_no, start, end, match>> of all generators in the column text; spans may overlap."""
    none = F.expr("cast(array() as array<struct<kind_no:int,start:int,end:int,match:string>>)")

    def of(kind: str, pattern: str) -> Column:
        spans = F.transform(_matches(pattern), lambda s: F.struct(F.lit(KINDS.index(kind)).alias("kind_no"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match")))
        return F.when(_hint(F.col("text"), kind), spans).otherwise(none)

    sorted_ = lambda a: let(F.array_sort(a), lambda s: F.filter(s, lambda x, i: (i == 0) | (x != F.get(s, i - 1))))
    # array_distinct holds every struct against all before it
    return let(F.concat(*(of(k, p) for k, p in [*WIDE.items(), *BASE.items()])), lambda a: F.when(F.size(a) <= FEW, F.array_distinct(a)).otherwise(sorted_(a)))


def _plausible(c: Column) -> Column:
    """Whether a candidate's characters, without the writing between them, can be of its kind."""
    plain = F.regexp_replace(F.regexp_replace(c["match"], r"(?i)[\[({](?:dot|\.)[\])}]", "."), r"\x20", "")
    kind = c["kind_no"]
    return (
        F.when(kind == KINDS.index("ip"), _valid("ip", plain))
        .when(kind == KINDS.index("card"), _valid("card", plain))
        .when(kind == KINDS.index("phone"), _valid("phone", plain))
        .otherwise(plain.rlike(r"[A-Za-z]{2,}$|[0-9]+(?:\.[0-9]+){3}$"))
    )


def _features(c: Column) -> dict[str, Column]:
    """Format and context of a candidate, as small integers."""
    m, start = c["match"], c["start"]
    left = _window(F.greatest(F.lit(0), start - 32), F.least(F.lit(32), start))

    def count(characters: str) -> Column:
        return F.length(F.regexp_replace(m, f"[^{characters}]", ""))

    def edge(x: Column) -> Column:
        return F.when(x == "", 0).when(x.rlike(r"\s"), 1).when(x.rlike(r"\p{L}"), 3).when(x.rlike("[0-9]"), 4).otherwise(2)

    return {
        "kind_no": c["kind_no"],
        "valid": _plausible(c).cast("int"),
        "digits": count("0-9"),
        "seps": count(r"\x20().-"),
        "length": F.length(m),
        "plus": m.startswith("+").cast("int"),
        "paren": m.contains("(").cast("int"),
        "at": m.contains("@").cast("int"),
        "dots": count("."),
        "spaces": count(r"\x20"),
        "before": edge(F.when(start > 0, _window(start - 1, F.lit(1))).otherwise("")),
        "after": edge(_window(c["end"], F.lit(1))),
        "cue": left.rlike(CONTEXT).cast("int"),
        "groups": F.size(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))),
        "covers": F.when(~_meets(c, lambda s: F.lit(True)), 0).when(_meets(c, lambda s: s["kind_no"] != c["kind_no"]), 2).otherwise(1),
    }


def _near() -> Column:
    """The spans of the column base, in order, as runs with their least start and greatest end, so that few are looked at for each candidate."""
    run = "named_struct('low', array_min(transform(r, s -> s.start)), 'high', array_max(transform(r, s -> s.`end`)), 'spans', r)"
    return F.expr(f"CASE WHEN size(base) > {FEW} THEN transform({_runs('base')}, r -> {run}) WHEN size(base) > 0 THEN transform(array(base), r -> {run}) END")


def _meets(c: Column, which) -> Column:
    """Whether a candidate overlaps a base span of some sort."""
    touching = lambda s: (s["start"] < c["end"]) & (s["end"] > c["start"]) & which(s)
    return F.coalesce(F.exists("near", lambda r: (r["low"] < c["end"]) & (r["high"] > c["start"]) & F.exists(r["spans"], touching)), F.lit(False))


def _open(c: Column) -> Column:
    """Whether a candidate touches no base span, or holds all of those that it touches and more."""
    return ~_meets(c, lambda s: ~((c["start"] <= s["start"]) & (c["end"] >= s["end"]) & (c["end"] - c["start"] > s["end"] - s["start"])))


def _rewritten(kind_no: Column, m: Column, cue: Column) -> Column:
    """array<struct<piece, y>>: a base span in forms that the base rules miss (1), and spoiled ones (0)."""
    digits = _digits(m)
    local, domain = F.regexp_extract(m, "^[^@]*", 0), F.regexp_extract(m, "@(.*)$", 1)
    short, end = F.regexp_extract(local, "[A-Za-z0-9]+", 0), F.regexp_extract(domain, r"[^.]+\.[^.]+$", 0)
    national = F.regexp_replace(m, r"^\+[0-9]{1,3}[\x20.-]+", "")

    def dotted(x: Column, by: str) -> Column:
        return F.regexp_replace(x, r"\.", by)

    def parted(by: str) -> Column:  # 1 743 555 3824
        return F.regexp_replace(digits, "(?<=[0-9])(?=(?:[0-9]{3})*[0-9]{4}$)", by)

    def fours(x: Column, by: str) -> Column:
        return F.regexp_replace(x, "(?<=[0-9])(?=(?:[0-9]{4})+$)", by)

    wrong = F.concat(F.substring(digits, F.lit(1), F.length(digits) - 1), ((F.right(digits, F.lit(1)).cast("int") + 1) % 10).cast("string"))
    away = F.regexp_replace(m, "^[0-9]+", "999")
    good = {
        "email": [
            F.concat(local, F.lit(" [at] "), dotted(domain, " [dot] ")), F.concat(local, F.lit("(at)"), dotted(domain, "(dot)")), F.concat(local, F.lit("[at]"), domain),
            F.concat(local, F.lit(" @ "), domain), F.concat(short, F.lit(" @ "), end), F.concat(short, F.lit(" [at] "), dotted(end, " [dot] ")), F.concat(local, F.lit(" @ "), dotted(domain, " . ")), F.regexp_replace(m, r"\.([^.]*)$", " [dot] $1"),
        ],
        "ip": [dotted(m, " . "), dotted(m, "[.]"), dotted(m, " [dot] "), dotted(m, "(dot)")],
        "card": [fours(digits, by) for by in (".", "  ", " - ", "_", "/")],
        "phone": [
            parted(" "), parted("-"), parted("."), F.when(m.rlike(r"[\x20().-]"), F.substring(m, F.lit(2), F.length(m))), F.regexp_replace(m, r"^\+([0-9]{1,3})(?![0-9])", "(+$1)"),
            F.regexp_replace(m, r"^\+", "+ "), F.concat(F.lit("00"), parted(" ")),
            *(F.when(national != m, F.regexp_replace(F.regexp_replace(national, "^[^0-9]+", ""), "[^0-9]+", by)) for by in (" ", "-", ".")), F.when(national != m, national),
        ],
    }
    bad = {
        "email": [F.concat(local, F.lit(" @ 7.25")), F.concat(local, F.lit(" @ 12 . 50"))],
        "ip": [dotted(away, " . "), dotted(away, "[.]"), dotted(away, " [dot] "), dotted(away, "(dot)")],
        "card": [F.concat(F.lit("a"), digits, F.lit("f")), *(fours(wrong, by) for by in (".", "  ", " - ", "_", "/"))],
        "phone": [F.concat(F.lit("f"), digits, F.lit("e")), F.when(~cue, digits), F.concat(F.substring(digits, F.lit(1), F.lit(3)), F.lit(" "), F.substring(digits, F.lit(4), F.lit(3)))],
    }
    made = None
    for i, kind in enumerate(KINDS):
        pieces = F.array(*(F.struct(piece.alias("piece"), F.lit(y).alias("y")) for y, forms in ((1, good[kind]), (0, bad[kind])) for piece in forms))
        made = F.when(kind_no == i, pieces) if made is None else made.when(kind_no == i, pieces)
    return F.filter(made, lambda v: v["piece"].isNotNull() & (v["piece"] != m))


def _examples(based: DataFrame) -> DataFrame:
    """Features and label (y) of candidates that may be added to the base spans.

    Right ones are the corpus's own base spans in other forms, each where it
    stood; wrong ones are spoiled forms, candidates of another kind on these,
    and candidates in the texts as they are that can't be of their kind or
    stand inside a token. Nothing is said of all other candidates.
    """
    c = F.col("c")

    def candidates(rows: DataFrame, *keep: str) -> DataFrame:
        # features are found before the candidates become rows, which then don't copy the text
        known = F.transform(F.filter(_candidates(), _open), lambda c: F.struct(c.alias("c"), *(v.alias(k) for k, v in _features(c).items())))
        return rows.select("doc_id", *keep, F.explode(known).alias("x")).select("doc_id", *keep, "x.*")

    plain = candidates(based)
    inside = (F.col("kind_no") != KINDS.index("email")) & ((F.col("before") > 2) | (F.col("after") > 2))
    misfits = plain.where((F.col("valid") == 0) | inside | (F.col("covers") == 2)).select("doc_id", *FEATURES, F.lit(0).alias("y"))

    def around(s: Column) -> Column:
        return F.struct(s["kind_no"].alias("k"), s["match"].alias("m"), _window(F.greatest(F.lit(0), s["start"] - LEFT), F.least(F.lit(LEFT), s["start"])).alias("left"), _window(s["end"], F.lit(RIGHT)).alias("right"))

    spans = based.where(F.size("marks") > 0).select("doc_id", F.explode(F.transform("marks", around)).alias("s")).select("doc_id", "s.*")
    forms = spans.select("doc_id", "k", "left", "right", F.explode(_rewritten(F.col("k"), F.col("m"), F.right("left", F.lit(32)).rlike(CONTEXT))).alias("v"))
    forms = forms.select("doc_id", "k", F.col("v")["y"].alias("right_form"), F.length("left").alias("from"), (F.length("left") + F.length(F.col("v")["piece"])).alias("to"), F.concat("left", F.col("v")["piece"], "right").alias("text"))
    made = candidates(_with_base(forms, "doc_id", "k", "right_form", "from", "to"), "k", "right_form", "from", "to")
    made = made.where((c["start"] < F.col("to")) & (c["end"] > F.col("from")))
    exact = (c["start"] == F.col("from")) & (c["end"] == F.col("to"))
    y = F.when((F.col("right_form") == 0) | (F.col("kind_no") != F.col("k")), 0).when(exact, 1)
    return misfits.unionByName(made.select("doc_id", *FEATURES, y.alias("y")).where("y is not null"))


def _values(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    return np.where(x[:, tree[0]] <= tree[1], _values(tree[2], x), _values(tree[3], x))


def _scores(model: tuple[float, list], x: np.ndarray) -> np.ndarray:
    """What _scored says of feature rows, as arrays."""
    return sum((_values(t, x) for t in model[1]), np.full(len(x), model[0]))


def _flat(tree, depth: int = 2) -> list[str]:
    """A tree as SQL values: its cuts (feature, greatest value of the lower side), level by level, then its leaves. A leaf that stands higher is the same below."""
    level, values = [tree], []
    for _ in range(depth):
        level = [t if isinstance(t, tuple) else (0, 0, t, t) for t in level]
        values += [str(v) for t in level for v in t[:2]]
        level = [side for t in level for side in t[2:]]
    return values + [f"{float(v)!r}D" for v in level]


def _scored(models: dict[int, tuple[float, list]]) -> Column:
    """The score of a feature row by the trees of its kind, null for kinds without: trees are an array of cuts and leaves, so the plan doesn't grow with them."""
    names = ("f", "v", "f0", "v0", "f1", "v1", "a", "b", "c", "d")

    def trees(model: tuple[float, list]) -> str:
        return f"array({', '.join('named_struct(' + ', '.join(f"'{n}', {v}" for n, v in zip(names, _flat(t))) + ')' for t in model[1])})"

    step = "s + CASE WHEN x[t.f] <= t.v THEN CASE WHEN x[t.f0] <= t.v0 THEN t.a ELSE t.b END WHEN x[t.f1] <= t.v1 THEN t.c ELSE t.d END"
    cases = (f"WHEN {k} THEN " + (f"aggregate({trees(m)}, {float(m[0])!r}D, (s, t) -> {step})" if m[1] else f"{float(m[0])!r}D") for k, m in models.items())
    return F.expr(_named("x", f"array({', '.join(f'cast(`{f}` as int)' for f in FEATURES)})", f"CASE x[{FEATURES.index('kind_no')}] {' '.join(cases)} END"))


def _sums(counted: DataFrame, models: dict, shares: dict, cuts: dict | None = None) -> dict:
    """{(kind, node): (feature, bin) sums of gradients and of curvatures}, in shares of a kind's whole weight.

    Without cuts there is one node a kind, 0; with them those of a kind's rows
    up to its cut (0) and beyond (1). Spark adds the rows up: at most two
    nodes, 15 features and BINS bins a kind come here.
    """
    kind, label, p = F.col("kind_no"), F.col("y"), F.col("p")
    rows = counted.where(kind.isin(*(models if cuts is None else cuts)))
    share = F.coalesce(*(F.when((kind == k) & (label == y), F.lit(v)) for k, both in shares.items() for y, v in enumerate(both)))
    node = F.coalesce(*(F.when((kind == k) & (F.col(FEATURES[f]) > v), 1) for k, (f, v, *_) in (cuts or {}).items()), F.lit(0))
    bins = F.array(*(F.struct(F.lit(f).alias("feature"), F.least(F.greatest(F.col(name), F.lit(0)), F.lit(BINS - 1)).cast("int").alias("bin")) for f, name in enumerate(FEATURES)))
    known = rows.select(kind.alias("kind"), node.alias("node"), label.alias("y"), bins.alias("bins"), (F.col("count") * share * UNITS).alias("w"), (1 / (1 + F.exp(-_scored(models)))).alias("p"))
    units = lambda x: F.rint(x).cast("long")
    parts = known.select("kind", "node", units(F.col("w") * (F.col("y") - p)).alias("g"), units(F.col("w") * p * (1 - p)).alias("h"), F.explode("bins").alias("at"))
    out: dict = {}
    for r in parts.groupBy("kind", "node", "at.feature", "at.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
        both = out.setdefault((r["kind"], r["node"]), np.zeros((2, len(FEATURES), BINS)))
        both[:, r["feature"], r["bin"]] = r["g"] / UNITS, r["h"] / UNITS
    return out


def _cut(g: np.ndarray, h: np.ndarray) -> tuple | None:
    """(feature, greatest value of the lower side, its sums, the upper side's sums) of the best cut, if one gains."""
    best, found = 1e-6, None
    for f in range(len(FEATURES)):
        values = np.flatnonzero(h[f])
        gs, hs = g[f, values].cumsum(), h[f, values].cumsum()
        if len(values) > 1:
            low_g, low_h = gs[:-1], hs[:-1]
            gain = low_g**2 / (low_h + 1) + (gs[-1] - low_g) ** 2 / (hs[-1] - low_h + 1) - gs[-1] ** 2 / (hs[-1] + 1)
            k = int(gain.argmax())
            if gain[k] > best:
                best, found = float(gain[k]), (f, int(values[k]), (low_g[k], low_h[k]), (gs[-1] - low_g[k], hs[-1] - low_h[k]))
    return found


def _boosted(counted: DataFrame, weights: dict[int, tuple[float, float]]) -> dict[int, tuple[float, list]]:
    """Gradient boosting of depth-2 trees on the logistic loss, for all kinds at once: (start, trees as nested tuples) each.

    counted has feature rows with label and count, weights the counts of wrong
    and right ones of a kind, which weigh the same in all. Every row counts in
    every tree: two jobs a tree add up gradients by feature and value, and
    only these sums reach the driver.
    """
    whole = {k: 2 * max(w) for k, w in weights.items()}
    shares = {k: tuple(1 / (2 * n) for n in w) for k, w in weights.items()}
    models: dict = {k: (0.0, []) for k in weights}  # both sorts weigh the same, so the start is even

    def leaf(g: float, h: float) -> float:
        return float(RATE * g / (h + 1.0))

    for _ in range(TREES):
        roots = {kind: both * whole[kind] for (kind, _), both in _sums(counted, models, shares).items()}
        cuts = {kind: cut for kind, both in roots.items() if (cut := _cut(*both))}
        below = _sums(counted, models, shares, cuts) if cuts else {}
        for kind, (g, h) in roots.items():
            if kind not in cuts:
                models[kind][1].append(leaf(g[0].sum(), h[0].sum()))
                continue
            f, value, *sides = cuts[kind]
            parts = []
            for node, side in enumerate(sides):
                cut = _cut(*(below[kind, node] * whole[kind])) if (kind, node) in below else None
                parts.append((cut[0], cut[1], leaf(*cut[2]), leaf(*cut[3])) if cut else leaf(*side))
            models[kind][1].append((f, value, *parts))
    return models


def _thresholds(aside: DataFrame, models: dict[int, tuple[float, list]]) -> dict[int, float]:
    """For each kind the least score from which set-aside rows are right with PRECISION, of those that are a multiple of 1 / STEPS; kinds that never are lack it."""

    step = F.floor(_scored(models) * STEPS).cast("long")
    rows = aside.where(F.col("kind_no").isin(*models)).select(F.col("kind_no").alias("kind"), step.alias("step"), (F.col("count") * F.col("y")).alias("right"), F.col("count").alias("n"))
    found: dict[int, float] = {}
    right, n = dict.fromkeys(models, 0), dict.fromkeys(models, 0)
    for r in rows.groupBy("kind", "step").agg(F.sum("right").alias("right"), F.sum("n").alias("n")).orderBy(F.desc("step")).collect():  # a bounded number of scores
        kind = r["kind"]
        right[kind], n[kind] = right[kind] + r["right"], n[kind] + r["n"]
        if right[kind] >= PRECISION * n[kind]:
            found[kind] = r["step"] / STEPS
    return found


def _score(model: tuple[float, list], features: dict[str, Column]) -> Column:
    def value(tree):
        if not isinstance(tree, tuple):
            return F.lit(tree)
        return F.when(features[FEATURES[tree[0]]] <= tree[1], value(tree[2])).otherwise(value(tree[3]))

    return sum((value(t) for t in model[1]), F.lit(model[0]))


def _with_base(docs: DataFrame, *keep: str) -> DataFrame:
    rows = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def of(kind_no: int) -> Column:
        return F.transform(base_spans(KINDS[kind_no]), lambda s: F.struct(s["start"].alias("start"), F.lit(kind_no).alias("kind_no"), s["end"].alias("end"), s["match"].alias("match")))

    marked = rows.withColumns({"marks": F.array_sort(F.concat(*(of(i) for i in range(len(KINDS))))), "cut": _pages()})
    based = marked.withColumn("base", F.transform("marks", lambda s: F.struct(s["start"], s["kind_no"], s["end"])))
    return based.withColumn("near", _near())


def fit_pii(docs: DataFrame) -> dict[int, tuple[tuple[float, list], float]] | None:
    """For each kind with examples of both sorts, boosted trees and a calibrated threshold (as a log-odds); None without any.

    No table labels personal data, so the examples are the base spans in forms
    that the base rules miss, and clear misfits (see _examples). The trees see
    format and context only; both sorts weigh the same. Rows with equal
    features are counted first, and all of them are fitted on, in Spark. The
    threshold is the least score at which set-aside rows (those of a fifth of
    the documents) are right with PRECISION.
    """
    rows = _examples(_with_base(docs.where("text is not null"), "doc_id"))
    aside = held_out_bucket(F.col("doc_id"), 5) == 0
    counted = stored(rows.groupBy(*FEATURES, "y", aside.cast("int").alias("aside")).count(), "pii-features")
    model = fit_counted(counted)
    drop_stored(counted)
    return model


def fit_counted(counted: DataFrame) -> dict[int, tuple[tuple[float, list], float]] | None:
    """The same from feature rows with label (y), whether they are set aside, and count."""
    counts = {(r["kind_no"], r["y"], r["aside"]): r["n"] for r in counted.groupBy("kind_no", "y", "aside").agg(F.sum("count").alias("n")).collect()}  # at most sixteen
    both = {k: (counts[k, 0, 0], counts[k, 1, 0]) for k in range(len(KINDS)) if {(k, 0, 0), (k, 1, 0)} <= counts.keys() and {(k, 0, 1), (k, 1, 1)} & counts.keys()}
    if not both:
        return None
    models = _boosted(counted.where("aside = 0"), both)
    least = _thresholds(counted.where("aside = 1"), models)
    return {k: (models[k], max(LEAST, least[k] - 1e-9)) for k in models if k in least} or None


def find_pii(docs: DataFrame, model: dict | None, *keep: str) -> DataFrame:
    """Columns keep, text, base and spans (arrays of start, kind_no, end) of every row.

    base holds what the base rules take; spans holds these and the candidates
    beside and around them that the trees choose. Null texts count as empty. Repeated rows
    and null ids stay rows of their own; whole texts are searched, in time that
    grows with the matches of a text n as n * sqrt(n). Further columns of docs
    don't matter; keep may not name text, base, spans, marks, cut or near.
    """
    return _found(docs, model, *keep).drop("cut")


def _found(docs: DataFrame, model: dict | None, *keep: str) -> DataFrame:
    if taken := {"text", "base", "spans", "marks", "cut", "near"} & set(keep):
        raise ValueError(f"columns {sorted(taken)} are of the result's own")
    rows = _with_base(docs, *keep)
    if model is None:
        return rows.withColumn("spans", F.col("base")).drop("marks", "near")
    loose = F.transform(F.filter(_candidates(), _open), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), *(v.alias(k) for k, v in _features(c).items())))
    chosen = F.filter(loose, lambda c: reduce(or_, ((c["kind_no"] == k) & (_score(trees, {f: c[f] for f in FEATURES}) >= least) for k, (trees, least) in model.items())))
    added = F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), c["kind_no"].alias("kind_no"), c["end"].alias("end")))
    return rows.withColumn("spans", F.array_sort(F.concat("base", added))).drop("marks", "near")  # a candidate is no base span, nor twice there


def redact(docs: DataFrame, model: dict | None, *keep: str) -> DataFrame:
    """Columns keep and text, every span replaced by its kind's name, as [EMAIL]; nested spans by the outermost."""
    found = _found(docs, model, *keep)
    piece = lambda start, end, tag: F.struct(start.alias("start"), end.alias("end"), tag.alias("tag"))

    def pieces(s: Column) -> Column:
        """What is left of the text, each piece up to the span that follows it; spans that begin inside an earlier one are gone."""
        seen = F.expr(_before("transform(spans, x -> x.`end`)", "greatest({0}, {1})"))
        kept = F.filter(F.zip_with(s, seen, lambda x, b: piece(b, x["start"], _tag(x["kind_no"]))), lambda p: p["end"] >= p["start"])
        return F.concat(kept, F.array(piece(F.array_max(F.transform(s, lambda x: x["end"])), F.length("text"), F.lit(""))))

    whole = F.coalesce("cut", F.struct((F.length("text") + 1).alias("step"), F.array("text").alias("pages")))

    def page(all_: Column, text: Column, i: Column) -> Column:
        step = F.coalesce(F.col("cut")["step"], F.length("text") + 1)
        first, last = i * step, (i + 1) * step

        def part(p: Column) -> Column:
            start, end = F.greatest(p["start"], first), F.least(p["end"], last)
            return F.concat(F.when(end > start, F.substring(text, start - first + 1, end - start)).otherwise(""), F.when((p["end"] >= first) & (p["end"] < last), p["tag"]).otherwise(""))

        return F.array_join(F.transform(F.filter(all_, lambda p: (p["end"] >= first) & (p["start"] < last)), part), "")

    made = let(pieces(F.col("spans")), lambda p: F.array_join(F.transform(whole["pages"], lambda text, i: page(p, text, i)), ""))
    return found.withColumn("text", F.when(F.size("spans") > 0, made).otherwise(F.col("text"))).select(*keep, "text")


def _tag(kind_no: Column) -> Column:
    return F.concat(F.lit("["), F.upper(_kind(kind_no)), F.lit("]"))


def _kind(kind_no: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), kind_no + 1)


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", _kind(s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_pii(docs, fit_pii(docs), "doc_id")
    counts = [F.size(F.filter(F.col("base")["kind_no"], lambda k: k == KINDS.index(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))
