"""Secret scans: pattern spans plus sliding-window entropy per character class, in SQL functions only.

Base spans, leftmost and non-overlapping per kind, over the whole text: ``assign``
(a credential name, ``=`` or ``:``, and a value of 6+ characters; the span is the
whole match), ``access`` (AKIA keys of 20+ characters) and ``hex`` (24+ lower-case
hex digits).

Entropy spans: a candidate is a maximal run of ``[A-Za-z0-9+/_=-]`` of at least
``MIN_CANDIDATE`` characters that holds a digit. For each character class (hex,
base62, base64) a window of ``WINDOW`` characters slides over the candidate. The window's
counts are kept incrementally: one count goes up, one goes down, and with them the sum
of c*log2(c), from which the entropy log2(W) - sum/W follows. Characters outside
the class empty the window. A candidate whose best window reaches a class's
threshold is a span of kind ``entropy`` unless the allow-list suppresses it
(UUIDs, documented sample keys, runs of one repeated character, dates and plain numbers) or a
base span covers it.

Positions are code points, ends exclusive. Defined results: a null or empty text
has no spans (the hash is that of the empty string); repeated rows get equal
results; a null doc_id passes through; an empty table gives no rows. Columns
besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
MIN_CANDIDATE = 20
WINDOW = 20
#: class name, its characters, least entropy in bits of one window
CLASSES = (
    ("hex", "0123456789abcdefABCDEF", 3.0),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 3.75),
    ("base64", "+/0123456789=ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz-", 3.85),
)
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"EXAMPLE|example|sample|placeholder|changeme|your[_-]",
    r"^[0-9+/_=-]+$",
    r"(.)\1{7,}",
)
KINDS = ("assign", "access", "hex", "entropy")


#: entries that one stretch of a running figure takes; stretches of this size keep the copies it makes short
STRETCH = 256


def _running(values: str, add: str, none: str) -> str:
    """SQL for the array of running figures of ``values``, each entry included; ``add`` combines {0} and {1}, ``none`` leaves any figure as it is.

    Stretches run on their own first; the figures that the stretches before have reached are added then.
    """
    step = f"(a, x) -> named_struct('at', {add.format('a.at', 'x')}, 'out', array_append(a.out, {add.format('a.at', 'x')}))"
    run = lambda of: f"aggregate({of}, named_struct('at', {none}, 'out', CAST(array() AS array<int>)), {step})"
    return f"""transform(array({values}), v -> IF(size(v) = 0, CAST(array() AS array<int>),
      transform(array(transform(sequence(0, (size(v) - 1) DIV {STRETCH}), k -> {run(f"slice(v, CAST(k * {STRETCH} + 1 AS INT), {STRETCH})")})), parts ->
        transform(array({run("transform(parts, p -> p.at)")}.out), upto ->
          flatten(transform(parts, (p, i) -> transform(p.out, e -> {add.format("IF(i = 0, " + none + ", upto[i - 1])", "e")}))))[0])[0]))[0]"""


def _spans(kind: str, pattern: str, keep: str = "true") -> str:
    """Array of structs (start, kind_no, end, hit) for the matches of ``pattern`` in ``text``.

    Matches and the gaps between them alternate, so running lengths give positions.
    """
    lengths = f"zip_with(slice(split(text, '{pattern}', -1), 1, size(m_{kind})), m_{kind}, (g, m) -> length(g) + length(m))"
    found = f"transform({_running(lengths, '{0} + {1}', '0')}, (e, i) -> named_struct('start', e - length(m_{kind}[i]), 'kind_no', {KINDS.index(kind)}, 'end', e, 'hit', m_{kind}[i]))"
    none = "CAST(array() AS array<struct<start:int,kind_no:int,end:int,hit:string>>)"
    return f"CASE WHEN size(m_{kind}) = 0 THEN {none} ELSE filter({found}, x -> {keep}) END"


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


#: counts of a window that share one long, five bits each
PACKED = 12


def _best_entropy(alphabet: str) -> str:
    """SQL for the highest entropy of a full window of ``c.hit``'s characters that lie in ``alphabet``; -1 without one.

    The candidate is cut into its characters once. State: counts (five bits for each character of the class), s = sum of n*log2(n),
    run = length of the current run inside the class, best = the least s so far.
    """
    term = "IF({0} <= 1, 0D, {0} * log2({0}))"
    place = lambda ch: f"instr('{alphabet}', {ch}) - 1"
    zero = f"array_repeat(0L, {-(-len(alphabet) // PACKED)})"
    count = lambda n, k: f"CAST(shiftright({n}[CAST({k} DIV {PACKED} AS INT)], 5 * ({k} % {PACKED})) & 31 AS INT)"
    moved = lambda n, k, sign: f"transform({n}, (v, j) -> IF(j = {k} DIV {PACKED}, v {sign} shiftleft(1L, 5 * ({k} % {PACKED})), v))"
    return f"""
      transform(array(split(c.hit, '')), h -> aggregate(
        transform(h, (ch, i) -> named_struct('new', {place("ch")}, 'old', IF(i >= {WINDOW}, {place(f"h[i - {WINDOW}]")}, 0))),
        named_struct('n', {zero}, 's', 0D, 'run', 0, 'best', 1e9D),
        (a, x) -> IF(x.new < 0, named_struct('n', {zero}, 's', 0D, 'run', 0, 'best', a.best),
          transform(array(
            IF(a.run < {WINDOW}, named_struct('n', a.n, 's', a.s),
               transform(array({count("a.n", "x.old")}), q -> named_struct('n', {moved("a.n", "x.old", "-")}, 's', a.s - {term.format("q")} + {term.format("(q - 1)")}))[0])),
            w -> transform(array({count("w.n", "x.new")}), q -> transform(array(w.s - {term.format("q")} + {term.format("(q + 1)")}), t -> named_struct(
              'n', {moved("w.n", "x.new", "+")}, 's', t, 'run', LEAST(a.run + 1, {WINDOW}),
              'best', IF(a.run + 1 >= {WINDOW}, LEAST(a.best, t), a.best)))[0])[0])[0]),
        a -> IF(a.best > 1e8D, -1D, {math.log2(WINDOW)!r}D - a.best / {WINDOW})))[0]"""


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` plus ``spans``: an array of structs (start, kind, end), by start, then kind as listed.

    ``base`` has the spans of the three patterns alone.
    """
    row = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    found = row.select(
        "*",
        F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(0)).alias("m_assign"),
        F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)).alias("m_access"),
        F.regexp_extract_all("text", F.lit(HEX), F.lit(0)).alias("m_hex"),
        F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("m_entropy"),
    )
    value = f"length(regexp_extract(x.hit, '{_quoted(ASSIGN)}', 2)) >= 6"
    # a candidate worth sliding over: it holds a digit and no allow-list pattern
    worth = " AND ".join(["x.hit RLIKE '[0-9]'", *(f"NOT x.hit RLIKE '{_quoted(p)}'" for p in ALLOWED)])
    located = found.select(
        "row",
        F.expr(_spans("assign", _quoted(ASSIGN), value)).alias("s_assign"),
        F.expr(_spans("access", _quoted(ACCESS))).alias("s_access"),
        F.expr(_spans("hex", _quoted(HEX))).alias("s_hex"),
        F.expr(f"CASE WHEN exists(m_entropy, x -> x RLIKE '[0-9]') THEN ({_spans('entropy', _quoted(CANDIDATE), worth)}) ELSE array() END").alias("s_candidate"),
    ).withColumn("base", F.array_sort(F.concat("s_assign", "s_access", "s_hex")))
    # in the order of starts, base spans first, a candidate is covered if a base span so far ends as late
    marks = "array_sort(concat(transform(base, b -> named_struct('start', b.start, 'candidate', -1, 'end', b.end)), transform(s_candidate, (c, i) -> named_struct('start', c.start, 'candidate', i, 'end', c.end))))"
    latest = _running("transform(marks, x -> IF(x.candidate < 0, x.end, -1))", "greatest({0}, {1})", "-1")
    open_ = "transform(filter(transform(marks, (x, i) -> named_struct('candidate', x.candidate, 'open', x.candidate >= 0 AND latest[i] < x.end)), x -> x.open), x -> s_candidate[x.candidate])"
    strong = " OR ".join(f"{_best_entropy(chars)} >= {least}D" for _, chars, least in CLASSES)
    named = "transform({0}, s -> named_struct('start', s.start, 'kind', element_at(array('assign','access','hex','entropy'), s.kind_no + 1), 'end', s.end))"
    return (
        located.withColumn("marks", F.expr(f"CASE WHEN size(s_candidate) = 0 THEN array() ELSE {marks} END"))
        .withColumn("latest", F.expr(latest))
        .withColumn("s_entropy", F.expr(f"filter({open_}, c -> {strong})"))
        .withColumn("all", F.array_sort(F.concat("base", "s_entropy")))
        .select(
            *[F.col("row")[c].alias(c) for c in docs.columns],
            F.expr(named.format("base")).alias("base"),
            F.expr(named.format("all")).alias("spans"),
        )
    )


def digest(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
