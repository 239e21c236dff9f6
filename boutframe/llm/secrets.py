"""Secret scans: three base patterns, and a randomness test battery for other tokens. DataFrame functions only.

Base spans are the leftmost non-overlapping matches of each kind (whole matches, code points, end exclusive): assignments
of a value of 8 or more characters, access keys of 16 or more, hex strings of 32 or more.

The battery looks at every other maximal run of 20 or more characters of the base-64 alphabets. An inner '=' ends a run, so a
value is looked at apart from its name; '=' at the end is padding and belongs to the span. A run that holds characters of both
base-64 alphabets ('+' or '/' as well as '-' or '_') is split twice, into the runs of 20 or more of the one and of the other,
and all these parts are looked at; their spans may overlap. A token's encoding is inferred
from the characters present (hex, letters of one case, base 32, base 36, base 62, base 64; base 32 and 36 in either case), the smallest alphabet that has them all, and its characters become numbers; three tests then ask whether they could be uniform draws:
chi-squared uniformity over the alphabet, the runs test about the alphabet's middle, and lag-one serial correlation. Their
smallest p-value times three is the token's; below ``UNIFORM`` the token is not random, whatever else speaks for it.

A token that passes is a secret of kind ``random`` when that is a *discovery* against text as people write it: names, words,
paths, dates. Under such text (letters by their usual frequency, and steps between lower case, upper case, digits and marks as
in identifiers) the ratio of the token's probability as uniform draws to its probability as text is over ``1 / p`` with a
chance of at most p, so one over the ratio is a p-value. It falls with every character that text would hardly have, so the
control is aware of length: the same oddness that says nothing over 20 characters is a discovery over 60. The
Benjamini-Hochberg step over the tokens of all documents keeps the share of false discoveries at ``FDR``. The step works on a
histogram of at most ``BINS`` log-scaled p-values, so nothing that grows with the input meets in one task.

Cases: a null text counts as empty and has no spans; a null doc_id passes through; repeated rows are scanned each; equal
starts are ordered by kind; empty tables and empty partitions give no rows; columns of any other name are kept by
:func:`redact` and not read by :func:`scan`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutframe.llm.idfilter import spare
from boutframe.session import materialize

KINDS = ("assign", "access", "hex", "random")
#: Fixed patterns. The kinds access and hex have their least length in the pattern, which changes no match.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
ASSIGN_LEAST = 8
PADDING = r"(?:=+(?![A-Za-z0-9+/_=-]))?"
TOKEN = r"[A-Za-z0-9+/_-]{20,}" + PADDING
PARTS = (r"[A-Za-z0-9+/]{20,}" + PADDING, r"[A-Za-z0-9_-]{20,}" + PADDING)
TOKEN_LEAST = 20
FDR = 0.01
UNIFORM = 0.001
BINS = 600
#: Percentages of the letters a to z in English text (a tenth of the weight is spread evenly, for other languages).
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
#: Shares of the marks in names and paths.
MARKS = {"/": 0.38, "-": 0.30, "_": 0.30, "+": 0.02}
#: How often each kind of character (lower case, upper case, digit, mark) begins an identifier, follows a kind that has just begun, and follows one that has lasted.
FIRST = {"l": 0.5, "u": 0.3, "d": 0.15, "s": 0.05}
BEGUN = {"l": {"l": 0.90, "u": 0.03, "d": 0.03, "s": 0.04}, "u": {"l": 0.80, "u": 0.12, "d": 0.04, "s": 0.04}, "d": {"l": 0.14, "u": 0.10, "d": 0.60, "s": 0.16}, "s": {"l": 0.50, "u": 0.20, "d": 0.25, "s": 0.05}}
LASTED = {"l": {"l": 0.79, "u": 0.11, "d": 0.04, "s": 0.06}, "u": {"l": 0.33, "u": 0.55, "d": 0.06, "s": 0.06}, "d": {"l": 0.09, "u": 0.07, "d": 0.72, "s": 0.12}, "s": {"l": 0.35, "u": 0.13, "d": 0.12, "s": 0.40}}
ALPHABETS = {
    16: "0123456789abcdef", 26: "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 36: "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 62: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
NO_SPANS = "array<struct<start:int,end:int,kind:int,hit:string>>"


def _positions(text: Column, pattern: str, kind: int) -> Column:
    """All matches with their code point positions: the lengths of what lies between them and of themselves add up."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.zip_with(hits, F.slice(between, 1, F.size(hits)), lambda h, b: F.struct(h.alias("hit"), F.char_length(b).alias("gap")))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["gap"]
        end = start + F.char_length(pair["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), pair["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast(NO_SPANS).alias("spans"))
    return F.aggregate(pairs, first, step, lambda state: state["spans"])


def _where(text: Column, test: str, spans: Column) -> Column:
    """``spans`` where the text passes a cheap test that every wanted match passes."""
    return F.when(text.rlike(test), spans).otherwise(F.array().cast(NO_SPANS))


def _assignments(text: Column) -> Column:
    value = F.regexp_extract
    found = F.filter(_positions(text, ASSIGN, 0), lambda s: F.char_length(value(s["hit"], ASSIGN, 2)) >= ASSIGN_LEAST)
    return _where(text, ASSIGN.removesuffix("+)") + "{" + str(ASSIGN_LEAST) + "})", found)


def _tokens(text: Column) -> Column:
    """Runs of the base-64 alphabets, with the parts of each alphabet in place of a run that mixes them."""

    def parts(run: Column) -> Column:
        found = F.concat(*[_positions(run["hit"], x, 3) for x in PARTS])
        moved = F.transform(found, lambda s: F.struct((s["start"] + run["start"]).alias("start"), (s["end"] + run["start"]).alias("end"), s["kind"].alias("kind"), s["hit"].alias("hit")))
        return F.when(run["hit"].rlike("[_-]") & run["hit"].rlike("[+/]"), F.array_distinct(moved)).otherwise(F.array(run))

    return _where(text, TOKEN, F.flatten(F.transform(_positions(text, TOKEN, 3), parts)))


def _tail(z: Column) -> Column:
    """The two-sided normal tail of z by a rational approximation of the error function (absolute error below 2e-7)."""
    x = F.least(F.abs(z), F.lit(36.0)) / F.lit(2.0**0.5)
    t = 1 / (1 + 0.3275911 * x)
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return series * F.exp(-x * x)


def _total(numbers: Column, of) -> Column:
    return F.aggregate(numbers, F.lit(0.0), lambda a, x: a + of(x).cast("double"))


def _with(rows: Column, keep: tuple[str, ...], **made) -> Column:
    """Each struct of an array with only the fields in ``keep`` and new ones; a step of its own, so nothing is computed twice."""
    return F.transform(rows, lambda t: F.struct(*[t[k].alias(k) for k in keep], *[f(t).alias(k) for k, f in made.items()]))


def _encoding(core: Column) -> Column:
    """Size of the alphabet that a token's characters point to; null where it has no structure to test."""
    digit, lower, upper = (core.rlike(x) for x in ("[0-9]", "[a-z]", "[A-Z]"))
    return (
        F.when(F.char_length(core) < TOKEN_LEAST, F.lit(None).cast("int"))
        .when(core.rlike("^([0-9a-f]+|[0-9A-F]+)$") & digit & (lower | upper), F.lit(16))
        .when(core.rlike("^([a-z]+|[A-Z]+)$"), F.lit(26))
        .when(core.rlike("^([A-Z2-7]+|[a-z2-7]+)$") & digit & (lower | upper), F.lit(32))
        .when(core.rlike("^([A-Z0-9]+|[a-z0-9]+)$") & digit & (lower | upper), F.lit(36))
        .when(core.rlike("^[A-Za-z0-9]+$") & lower & upper, F.lit(62))
        .when(core.rlike("^([A-Za-z0-9+/]+|[A-Za-z0-9_-]+)$") & ((digit & lower) | (digit & upper) | (lower & upper)), F.lit(64))
    )


def _encodes_prose(core: Column) -> Column:
    """Whether base 64 hides plain prose: the bytes are words of printable characters between single spaces or line ends."""
    plain = F.translate(core, "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.char_length(plain) / 4) * 4).cast("int"), "=")
    word = "(?:2[1-9A-F]|3[0-9A-F]|[46][1-9A-F]|[57][0-9A-E]){1,24}"
    return F.coalesce(F.hex(F.try_to_binary(padded, F.lit("base64"))).rlike(f"^(?:{word}(?:20|0A|0D0A)){{2,}}(?:{word})?$"), F.lit(False))


def _numbers(t: Column) -> Column:
    plain = F.when(t["size"] == 16, F.lower(t["core"])).when(t["size"] <= 36, F.upper(t["core"])).otherwise(F.translate(t["core"], "-_", "+/"))
    letters = F.filter(F.split(plain, ""), lambda c: c != "")
    alphabet = F.try_element_at(F.create_map(*[F.lit(x) for pair in ALPHABETS.items() for x in pair]), t["size"])
    return F.transform(letters, lambda c: F.instr(alphabet, c) - 1)


def text_bits() -> tuple[dict[str, float], dict[str, float], dict[str, float]]:
    """Minus log2 of the probabilities of each character within its kind, of the first kind, and of each kind after the one or two before it."""
    total = sum(LETTERS)
    own = {chr(97 + k): -math.log2(0.9 * x / total + 0.1 / 26) for k, x in enumerate(LETTERS)} | {c: math.log2(10) for c in "0123456789"} | {c: -math.log2(x) for c, x in MARKS.items()}
    steps = {b + c: -math.log2(x) for b, row in BEGUN.items() for c, x in row.items()}
    steps |= {a + b + c: -math.log2((LASTED if a == b else BEGUN)[b][c]) for a in "luds" for b in "luds" for c in "luds"}
    return own, {k: -math.log2(x) for k, x in FIRST.items()}, steps


def _bits(t: Column) -> Column:
    """log2 of how much likelier a token is as uniform draws than as text; a token of capitals only is read as lower case."""
    own, first, steps = (F.create_map(*[F.lit(x) for pair in m.items() for x in pair]) for m in text_bits())
    core = F.when(t["core"].rlike("[a-z]"), t["core"]).otherwise(F.lower(t["core"]))
    letters = F.filter(F.split(F.lower(core), ""), lambda c: c != "")
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    kinds = F.translate(core, lower + lower.upper() + digits + "+/-_", "l" * 26 + "u" * 26 + "d" * 10 + "s" * 4)
    later = F.transform(F.sequence(F.lit(1), F.char_length(kinds) - 2), lambda k: F.substring(kinds, k, F.lit(3)))
    as_text = _total(letters, lambda c: F.try_element_at(own, c)) + F.try_element_at(first, F.left(kinds, F.lit(1))) + F.try_element_at(steps, F.left(kinds, F.lit(2))) + _total(later, lambda m: F.try_element_at(steps, m))
    return as_text - F.char_length(core) * F.log2(t["size"].cast("double"))


def _judged(spans: Column) -> Column:
    """Tokens that have an encoding, with length, p-value (three times the smallest of the battery's three) and bits of evidence against text."""
    at = ("start", "end")
    rows = _with(spans, at, core=lambda t: F.regexp_replace(t["hit"], "=+$", ""))
    rows = F.filter(_with(rows, (*at, "core"), size=lambda t: _encoding(t["core"])), lambda t: t["size"].isNotNull())
    rows = F.filter(rows, lambda t: ~((t["size"] >= 62) & _encodes_prose(t["core"])))
    rows = _with(rows, (*at, "size"), x=_numbers, bits=_bits)
    at = (*at, "bits")
    rows = _with(
        rows, (*at, "size", "x"), n=lambda t: F.size(t["x"]), mean=lambda t: _total(t["x"], lambda x: x) / F.size(t["x"]),
        high=lambda t: _total(t["x"], lambda x: (x * 2 >= t["size"]).cast("int")), heads=lambda t: F.slice(t["x"], 1, F.size(t["x"]) - 1), tails=lambda t: F.slice(t["x"], 2, F.size(t["x"]) - 1),
    )
    rows = _with(
        rows, (*at, "size", "n", "high"),
        squares=lambda t: _total(F.transform(F.array_distinct(t["x"]), lambda d: F.size(F.filter(t["x"], lambda y: y == d))), lambda c: c.cast("double") * c),
        runs=lambda t: 1 + _total(F.zip_with(t["heads"], t["tails"], lambda a, b: (a * 2 >= t["size"]) != (b * 2 >= t["size"])), lambda x: x.cast("int")),
        spread=lambda t: _total(t["x"], lambda x: (x - t["mean"]) * (x - t["mean"])),
        cross=lambda t: _total(F.zip_with(t["heads"], t["tails"], lambda a, b: (a - t["mean"]) * (b - t["mean"])), lambda x: x),
    )
    rows = _with(
        rows, (*at, "n"),
        chi=lambda t: (t["squares"] * t["size"] / t["n"] - t["n"] - (t["size"] - 1)) / F.sqrt(2.0 * (t["size"] - 1) * (t["n"] - 1) / t["n"]),
        runs=lambda t: _runs_z(t["runs"], t["high"], t["n"].cast("double")),
        serial=lambda t: F.when(t["spread"] == 0, F.lit(36.0)).otherwise((t["cross"] / t["spread"] + F.lit(1.0) / t["n"]) * F.sqrt(t["n"])),
    )
    return _with(rows, (*at, "n"), p=lambda t: F.least(F.lit(1.0), 3 * F.least(_tail(t["chi"]), _tail(t["runs"]), _tail(t["serial"]))))


def _runs_z(runs: Column, high: Column, n: Column) -> Column:
    expected = 2 * high * (n - high) / n + 1
    spread = F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9))
    return F.when((high == 0) | (high == n), F.lit(36.0)).otherwise((runs - expected) / F.sqrt(spread))


def _found(text: Column) -> tuple[Column, Column]:
    """Base spans and judged tokens of a text (which must not be null)."""
    base = F.array_sort(F.concat(_assignments(text), _where(text, ACCESS, _positions(text, ACCESS, 1)), _where(text, HEX, _positions(text, HEX, 2))))
    return base, _with(_judged(_tokens(text)), ("start", "end", "n", "p", "bits"), kind=lambda t: F.lit(3))


def _edge(token: Column) -> Column:
    """The number of the bin of a token's p-value as text: log10 from -300 up to 0, rounded up, so that no p-value counts as smaller than it is."""
    return F.ceil(F.greatest(F.lit(-300.0), F.least(F.lit(0.0), -token["bits"] * math.log10(2))) * (BINS / 300))


def cut_off(found: DataFrame, fdr: float = FDR) -> int:
    """The bin of p-values up to which tokens are discoveries; from ``found.tokens``."""
    bins = found.select(F.explode("tokens").alias("token")).groupBy(_edge(F.col("token")).alias("edge")).agg(F.count(F.lit(1)).alias("n")).collect()
    rows = sorted((r["edge"], r["n"]) for r in bins)
    total, seen, cut = sum(n for _, n in rows), 0, -BINS - 1
    for edge, n in rows:
        seen += n
        if 10 ** (edge * 300 / BINS) <= fdr * seen / total:
            cut = edge
    return cut


def _random(base: Column, tokens: Column, cut: int) -> Column:
    """Tokens that are discoveries, look uniform, and touch no base span."""
    return F.filter(tokens, lambda t: (_edge(t) <= cut) & (t["p"] >= UNIFORM) & ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def _slim(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of each row."""
    base, tokens = _found(F.coalesce(F.col(text_col), F.lit("")))
    found = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), _slim(base).alias("base"), tokens.alias("tokens")), "secrets")
    cut = cut_off(found, fdr)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    every = F.array_sort(F.concat("base", _slim(_random(F.col("base"), F.col("tokens"), cut))))
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(every).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", fdr: float = FDR) -> DataFrame:
    """All rows and columns, with every secret in the text replaced by ``mark``; overlapping spans become one mark.

    Spans and judged tokens are written beside the rows once, so patterns go over each text one time.
    """
    text, names = F.coalesce(F.col(text_col), F.lit("")), [spare(docs.columns, x) for x in ("base", "tokens")]
    base, tokens = _found(text)
    found = materialize(docs.withColumns({names[0]: _slim(base), names[1]: tokens}), "secrets")
    cut = cut_off(found.select(F.col(names[1]).alias("tokens")), fdr)

    def cut_out(state: Column, span: Column) -> Column:
        clear = span["start"] >= state["at"]
        gap = F.concat(state["out"], F.when(clear, F.concat(F.substring(text, state["at"] + 1, span["start"] - state["at"]), F.lit(mark))).otherwise(F.lit("")))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), gap.alias("out"))

    every = F.array_sort(F.concat(names[0], _slim(_random(F.col(names[0]), F.col(names[1]), cut))))
    clean = F.aggregate(every, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), cut_out, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text))))
    worth = (F.size(names[0]) > 0) | (F.size(names[1]) > 0)
    return found.withColumn(text_col, F.when(worth, clean).otherwise(F.col(text_col))).drop(*names)
