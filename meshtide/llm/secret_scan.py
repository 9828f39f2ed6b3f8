"""Secret scanning with DataFrame functions only: patterns, and sliding-window entropy of candidates.

Three patterns give the base spans: assignments to names like password or token, access key
ids, and long runs of hexadecimal digits. Beyond them, candidate strings of 20 and more
characters are sorted into character classes (hexadecimal, letters and digits, base64), each
with an alphabet and a threshold. A window slides over a candidate with an array of counts, a
number for each letter of its class: a step adds one to the count of the character that comes
in and takes one from that of the character that goes out, and the sum that the Shannon
entropy needs changes by these two terms alone. Nothing in the window is counted again. The part
of a candidate whose windows reach the threshold is a span of kind ``entropy``, unless an
allow-list pattern matches it or a base span holds it. Every row is scanned where it is read;
nothing is shuffled.

Places of matches are running sums of the lengths of matches and gaps. They are made in blocks, as
many as a block has elements, so that a text with n matches takes n to the power of one and a half
copies of a number at most, not n squared.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
_DIGITS, _SMALL = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: (class, pattern, alphabet, bits a character that a window must reach): the first class whose pattern matches a whole candidate.
CLASSES = (
    ("hexadecimal", r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]+$", _DIGITS + "abcdefABCDEF", 3.0),
    ("alphanumeric", r"^(?=.*[0-9])(?=.*[A-Za-z])[0-9A-Za-z]+$", _DIGITS + _SMALL + _SMALL.upper(), 3.5),
    ("base64", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z]).+$", _DIGITS + _SMALL + _SMALL.upper() + "+/_=-", 3.8),
)
#: Candidates matched by one of these are no secrets.
ALLOW = (r"(?i)example|sample|dummy|placeholder|changeme|redacted", r"(.)\1{7}", r"(?i)0123456789|abcdefgh", r"^(/[A-Za-z_-]+)+/?$")


def _plus(a: str, b: str) -> str:
    return f"{a} + {b}"


def _largest(a: str, b: str) -> str:
    return f"greatest({a}, {b})"


def running(numbers: str, join: Callable[[str, str], str] = _plus) -> str:
    """SQL: for each element of an array of integers, those up to and with it joined by an associative operation.

    Blocks of about the square root of the array's size are joined within themselves, then with the
    blocks before them.
    """
    none = "cast(array() as array<int>)"
    joined = lambda before, x: f"transform(array(named_struct('a', {before}, 'b', {x})), z -> if(z.a is null, z.b, {join('z.a', 'z.b')}))[0]"
    grown = lambda x: f"concat(acc, array({joined('try_element_at(acc, -1)', x)}))"
    size = "int(ceil(sqrt(size(v) + 1)))"
    blocks = f"transform(array({numbers}), v -> transform(sequence(0, int(size(v) / {size})), k -> slice(v, k * {size} + 1, {size})))[0]"
    within = f"transform({blocks}, x -> aggregate(x, {none}, (acc, y) -> {grown('y')}))"
    outer = f"aggregate(filter(w, x -> size(x) > 0), {none}, (acc, x) -> {grown('element_at(x, -1)')})"
    whole = f"flatten(transform(w, (x, k) -> transform(x, y -> {joined('if(k = 0, null, o[greatest(k - 1, 0)])', 'y')})))"
    return f"transform(array({within}), w -> transform(array({outer}), o -> {whole})[0])[0]"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(pattern: str, group: int) -> str:
    """SQL: each match of a pattern in text, leftmost and without overlaps: array of (start, end, size of the group), in code points."""
    p = _quoted(pattern)
    # each match ends where all gaps and matches up to it end
    parts = f"transform(sequence(0, size(m) - 1), i -> length(g[i]) + length(m[i]))"
    ends = f"transform(array({running(parts)}), e -> transform(e, (x, i) -> named_struct('start', x - length(m[i]), 'end', x, 'size', length(s[i]), 'text', m[i])))[0]"
    bound = f"transform(array(regexp_extract_all(text, {p}, 0)), m -> transform(array(split(text, {p}, -1)), g -> transform(array(regexp_extract_all(text, {p}, {group})), s -> {ends})[0])[0])[0]"
    return f"if(text rlike {p}, {bound}, cast(array() as array<struct<start:int,end:int,size:int,text:string>>))"


def _kind(matches: str, kind: str, least: int) -> str:
    return f"transform(filter({matches}, x -> x.size >= {least}), x -> named_struct('start', x.start, 'order', {KINDS.index(kind)}, 'end', x.end))"


def hot_part(text: str, alphabet: str, threshold: float, window: int = WINDOW) -> str:
    """SQL: (first, last) of a string over an alphabet: start of the first and end of the last window whose entropy reaches the threshold; first is -1 if none does."""
    letters = _quoted(alphabet)
    # n * log2(n) of every count that there may be
    weights = "array(" + ", ".join(f"{n * math.log2(n) if n else 0.0!r}D" for n in range(window + 1)) + ")"
    least = window * (math.log2(window) - threshold) + 1e-9
    coming = f"instr({letters}, c) - 1"
    going = f"if(i >= {window}, instr({letters}, substr({text}, i - {window - 1}, 1)) - 1, -1)"
    size = len(alphabet)
    put = lambda n, k, by: f"concat(slice({n}, 1, {k}), array({n}[{k}] {by}), slice({n}, {k} + 2, {size}))"
    counted = f"if(x.out < 0, {put('acc.n', 'x.in', '+ 1')}, transform(array({put('acc.n', 'x.in', '+ 1')}), n -> {put('n', 'x.out', '- 1')})[0])"
    # a character that comes as it goes changes nothing
    change = "if(x.in = x.out, 0D, w[acc.n[x.in] + 1] - w[acc.n[x.in]] + if(x.out < 0, 0D, w[acc.n[greatest(x.out, 0)] - 1] - w[acc.n[greatest(x.out, 0)]]))"
    moved = f"transform(array(named_struct('in', {coming}, 'out', {going})), x -> named_struct('n', if(x.in = x.out, acc.n, {counted}), 'sum', acc.sum + {change}))[0]"
    marked = f"transform(array({moved}), y -> named_struct('n', y.n, 'sum', y.sum, 'first', if(i + 1 >= {window} and y.sum <= {least!r}D and acc.first < 0, i + 1 - {window}, acc.first), 'last', if(i + 1 >= {window} and y.sum <= {least!r}D, i + 1, acc.last)))[0]"
    begin = f"named_struct('n', array_repeat(0, {len(alphabet)}), 'sum', 0D, 'first', -1, 'last', -1)"
    step = f"transform(array(substr({text}, i + 1, 1)), c -> {marked})[0]"
    return f"transform(array({weights}), w -> aggregate(sequence(0, length({text}) - 1), {begin}, (acc, i) -> {step}, a -> named_struct('first', a.first, 'last', a.last)))[0]"


def _candidates(allow: tuple[str, ...]) -> str:
    """SQL: entropy spans of text, those of candidates that belong to a class and that nothing allows."""
    wanted = " and ".join(["(" + " or ".join(f"x.text rlike {_quoted(p)}" for _, p, _, _ in CLASSES) + ")", *(f"not x.text rlike {_quoted(p)}" for p in allow)])
    by_class = "case " + " ".join(f"when x.text rlike {_quoted(p)} then {hot_part('x.text', letters, bits)}" for _, p, letters, bits in CLASSES) + " end"
    hot = f"transform(filter({_matches(CANDIDATE, 0)}, x -> {wanted}), x -> named_struct('start', x.start, 'hot', {by_class}))"
    return f"transform(filter({hot}, x -> x.hot.first >= 0), x -> named_struct('start', x.start + x.hot.first, 'order', {KINDS.index('entropy')}, 'end', x.start + x.hot.last))"


def _held(spans: str, base: str) -> str:
    """SQL: the spans that no base span holds. All are sorted by start, longest first; one is held if a base span before it ends no sooner."""
    sorted_ = f"array_sort(concat(transform({base}, x -> named_struct('start', x.start, 'late', -x.end, 'added', 0, 'order', x.order)), transform({spans}, x -> named_struct('start', x.start, 'late', -x.end, 'added', 1, 'order', x.order))))"
    reach = running("transform(q, x -> if(x.added = 0, -x.late, -1))", _largest)
    kept = f"filter(transform(q, (x, i) -> named_struct('x', x, 'reach', r[i])), y -> y.x.added = 1 and y.reach < -y.x.late)"
    return f"if(size({spans}) = 0, {spans}, transform(array({sorted_}), q -> transform(array({reach}), r -> transform({kept}, y -> named_struct('start', y.x.start, 'order', y.x.order, 'end', -y.x.late)))[0])[0])"


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["order"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """(doc_id, found array<(kind, start, end)>, n_assign, n_access, n_hex, base_sha256, spans), one row per input row.

    Offsets are code points, ends exclusive. Matches of a pattern are leftmost and do not overlap; of
    assignments those stay whose value has six characters. found and spans are ordered by start,
    then by kind. A window that reaches its threshold exactly counts. A null or empty text has no spans. A text of
    any length is scanned whole; it is held by one task. Repeated rows get the same result each, null ids pass
    through, an empty table gives an empty result, columns besides the two named are not read, so theirs
    may clash with those added.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    each = base.select(
        "doc_id",
        F.expr(_kind(_matches(ASSIGN, 2), "assign", 6)).alias("assign"),
        F.expr(_kind(_matches(ACCESS, 0), "access", 0)).alias("access"),
        F.expr(_kind(_matches(HEX, 0), "hex", 0)).alias("hex"),
        F.expr(_candidates(allow)).alias("entropy"),
    )
    each = each.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    each = each.withColumn("all", F.array_sort(F.concat(F.col("base"), F.expr(_held("entropy", "base")))))
    names = F.array(*map(F.lit, KINDS))
    return each.select(
        "doc_id",
        F.transform("all", lambda x: F.struct(names[x["order"]].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("found"),
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("all")).alias("spans"),
    )
