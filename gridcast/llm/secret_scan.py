"""Secret scans: three fixed patterns, and windows of high entropy.

Candidate strings are runs of the characters of a class (hexadecimal, base 64). A window of fixed
width slides over a candidate; its Shannon entropy follows from the sum of c log c over the counts c
of its characters, which changes by two terms per step: one for the character that leaves, one for
the one that comes in. Windows at or above the class's entropy are merged into spans. Candidates on
the allow list (plain words, identifiers with a known layout, placeholders) are left out; the spans
of the fixed patterns always stay.

All of it is SQL functions on one row at a time: one scan, no shuffle. Positions count code points.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.llm.registry import register, table

# The patterns of the base kinds. Group 2 is what was found, group 3 the value of an assignment.
ASSIGN = r"""((?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"(AKIA[A-Z0-9]{12,})"
HEX = r"([0-9a-f]{32,})"
ASSIGN_HINT = r"(?i)(?:passw(?:or)?d|secret|token|api_?key)"
MIN_VALUE = 8

#: Order of the kinds in listings.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

#: c log2 c and the limits in these units, so that sums are exact.
UNITS = 1 << 20


@dataclass(frozen=True)
class CharacterClass:
    """A class of characters, the width of its window and the least entropy, in bits, that is reported."""

    kind: str
    characters: str
    width: int
    bits: float

    @property
    def terms(self) -> list[int]:
        """c log2 c for each count c."""
        return [0, *(round(c * log2(c) * UNITS) for c in range(1, self.width + 1))]

    @property
    def most(self) -> int:
        """The largest sum of terms of a window with enough entropy."""
        return int(self.width * (log2(self.width) - self.bits) * UNITS)


CLASSES = (
    CharacterClass("entropy_hex", "0-9A-Fa-f", 24, 3.0),
    CharacterClass("entropy_base64", "A-Za-z0-9+/_-", 24, 3.9),
)

#: A candidate that one of these matches as a whole is no secret.
ALLOWED = (
    r"[A-Za-z]?[a-z]+(?:[-_/][A-Za-z]?[a-z]+)*",
    r"[A-Z]+(?:[-_/][A-Z]+)*",
    r"[0-9]+(?:[-_/][0-9]+)*",
    r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
    r"(?i).*(?:example|placeholder|changeme|dummy|sample|xxxx|0123456789|123456789|abcdefgh).*",
)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _located(text: str, pattern: str, hint: str, value_group: int = 2) -> str:
    """SQL for all non-overlapping matches as structs (start, end, value).

    Every match is extended to the left up to the match before it (`\\G`), so the lengths of the
    extended matches add up to positions, and nothing is scanned twice.
    """
    extended = _quoted(r"(?s)\G(.*?)" + pattern)
    parts = f"""arrays_zip(
        transform(regexp_extract_all({text}, {extended}, 0), x -> length(x)),
        transform(regexp_extract_all({text}, {extended}, 1), x -> length(x)),
        regexp_extract_all({text}, {extended}, {value_group}))"""
    step = """(at, x) -> struct(
        at.end + int(x['0']) AS end,
        concat(at.found, array(struct(at.end + int(x['1']) AS start, at.end + int(x['0']) AS end, x['2'] AS value))) AS found)"""
    empty = "struct(0 AS end, cast(array() AS array<struct<start: int, end: int, value: string>>) AS found)"
    return f"""CASE WHEN {text} RLIKE {_quoted(hint)} THEN aggregate({parts}, {empty}, {step}, at -> at.found)
        ELSE {empty}.found END"""


def _kind(kind: str, spans: str, keep: str = "true") -> str:
    """SQL for the spans that are kept, with rank and kind."""
    return f"""transform(filter({spans}, x -> {keep}),
        x -> struct(x.start AS start, {KINDS.index(kind)} AS rank, x.end AS end, '{kind}' AS kind))"""


def _windows(own: CharacterClass) -> str:
    """SQL for the merged windows of one candidate x (start, end, value), as spans (start, end) in the text."""
    w, terms = own.width, f"array({', '.join(f'{t}L' for t in own.terms)})"
    count = "size(filter(slice(s.chars, {at}, {n}), c -> c = s.chars[{i}]))"
    leaves = count.format(at=f"i - {w}", n=w, i=f"i - {w + 1}")
    comes = count.format(at=f"greatest(i - {w - 1}, 1)", n=f"least(i - 1, {w - 1})", i="i - 1")
    gone = f"CASE WHEN i > {w} THEN s.terms[{leaves}] - s.terms[{leaves} - 1] ELSE 0L END"
    come = f"s.terms[{comes} + 1] - s.terms[{comes}]"
    state = "struct<chars: array<string>, terms: array<bigint>, sum: bigint, start: int, end: int, found: array<struct<start: int, end: int>>>"
    first = f"cast(struct(split(x.value, ''), {terms}, 0L, -1, -1, array()) AS {state})"
    # first the sums, then what they mean for the spans: a hit goes on with the open span or opens one
    summed = f"struct(s.chars, s.terms, s.sum - ({gone}) + ({come}) AS sum, s.start, s.end, s.found)"
    hit = f"i >= {w} AND t.sum <= {own.most}L"
    spans = f"""cast(struct(t.chars, t.terms, t.sum,
        CASE WHEN NOT ({hit}) THEN t.start WHEN t.start >= 0 AND i - {w} <= t.end THEN t.start ELSE i - {w} END,
        CASE WHEN {hit} THEN i ELSE t.end END,
        CASE WHEN {hit} AND t.start >= 0 AND i - {w} > t.end THEN concat(t.found, array(struct(t.start, t.end))) ELSE t.found END
        ) AS {state})"""
    step = f"(s, i) -> transform(array({summed}), t -> {spans})[0]"
    last = "s -> CASE WHEN s.start < 0 THEN s.found ELSE concat(s.found, array(struct(s.start AS start, s.end AS end))) END"
    folded = f"aggregate(sequence(1, length(x.value)), {first}, {step}, {last})"
    return f"transform({folded}, p -> struct(x.start + p.start AS start, x.start + p.end AS end))"


def secrets(text: str = "text") -> Column:
    """Array of (start, rank, end, kind) of all secrets of a text, by start and then kind."""
    body = f"coalesce({text}, '')"
    found = [
        _kind("assign", _located(body, "(?i)" + ASSIGN, ASSIGN_HINT, 3), f"length(x.value) >= {MIN_VALUE}"),
        _kind("access", _located(body, ACCESS, ACCESS)),
        _kind("hex", _located(body, HEX, HEX)),
    ]
    allowed = _quoted("^(?:" + "|".join(ALLOWED) + ")$")
    for own in CLASSES:
        run = f"([{own.characters}]{{{own.width},}})"
        candidates = f"filter({_located(body, run, run)}, x -> NOT x.value RLIKE {allowed})"
        found.append(_kind(own.kind, f"flatten(transform({candidates}, x -> {_windows(own)}))"))
    return F.array_sort(F.concat(*map(F.expr, found)))


def scan(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """`docs` with `out`: array of (start, rank, end, kind), in code points with the end exclusive.

    A null or empty text has none. Rows are independent; repeated rows give repeated results, no
    rows give none. A column named `out` is replaced. The time for one text is linear in its length,
    but for its number of secrets, in which it is quadratic with a small factor.
    """
    return docs.withColumn(out, secrets(text))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


@register("op4_secret_scan")
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda x: x["rank"] < 3)
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in KINDS[:3]),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
    )
