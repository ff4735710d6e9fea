"""Personal data in whole texts: expressions propose, checksums confirm, context adjusts a score.

DataFrame functions only. A kind is a pattern, a check on the matched text, a base score, a bonus
for context words close by, and the score it needs. Matches are found leftmost and without
overlap per kind; a match that fails its check is dropped and not tried again from within.

Defined results: a null text is read as empty and has no spans. Positions count code points, the
end is exclusive. Spans of different kinds may overlap. Rows are treated one by one, so repeated
rows give equal results. An empty table gives an empty result with the same columns; columns other
than id and text are not looked at. Work grows in proportion to text length and matches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEAR = 40
#: Sizes of the pieces in which long lists of matches and long texts are worked on.
CHUNK, BLOCK = 128, 1024


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Doubling every second digit from the right, the digit sum ends in 0."""
    chars = F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0))
    doubled = F.transform(chars, lambda c, i: F.when(i % 2 == 0, c).otherwise(
        F.translate(c, "0123456789", "0246813579")).cast("int"))
    return F.aggregate(doubled, F.lit(0), lambda acc, d: acc + d) % 10 == 0


def mod97(text: Column) -> Column:
    """Account numbers: the first four signs moved to the end, letters as 10..35, remainder 1."""
    plain = F.regexp_replace(text, " ", "")
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    chars = F.regexp_extract_all(moved, F.lit("."), F.lit(0))

    def step(acc: Column, c: Column) -> Column:
        v = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (acc * F.when(v < 10, 10).otherwise(100) + v) % 97

    return F.aggregate(chars, F.lit(0), step) == 1


def _ip_parts(m: Column) -> Column:
    parts = F.split(m, "\\.")
    # Leading zeros do not change a part's value; a part with more than three other digits is too big.
    short = F.transform(parts, lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(short, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))


def _count(low: int, high: int) -> Callable[[Column], Column]:
    return lambda m: F.length(digits_of(m)).between(low, high)


def _card(m: Column) -> Column:
    digits = digits_of(m)
    return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)


@dataclass(frozen=True)
class Kind:
    """``maybe`` is a cheap expression that every text with a match fulfils."""

    name: str
    pattern: str
    maybe: str
    check: Callable[[Column], Column]
    base: bool = False
    score: float = 0.6
    bonus: float = 0.3
    needs: float = 0.5
    context: Sequence[str] = field(default_factory=tuple)


# \G (the end of the match before) or no such character ahead: a match can only begin where a run
# of its first class begins, so long runs are walked once. Possessive repeats give the same matches
# here (what follows them is never in the repeated class) and need no stack for long runs.
KINDS: tuple[Kind, ...] = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         r"@[A-Za-z0-9-]+\.[A-Za-z0-9-]", lambda m: F.lit(True), True,
         context=("mail", "email", "contact", "write")),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", _ip_parts, True,
         context=("ip", "host", "server", "address", "login")),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", r"[0-9](?:[ -]?[0-9]){12}", _card, True,
         context=("card", "visa", "credit", "payment", "mastercard")),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9][ ().0-9-]", _count(9, 15), True,
         context=("phone", "call", "tel", "mobile", "fax")),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
         r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", mod97, score=0.8,
         context=("iban", "account", "bank", "konto", "compte", "cuenta")),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
         r"[0-9]{3}-[0-9]{2}-[0-9]{4}", lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), score=0.3,
         context=("ssn", "social", "security", "insurance")),
)
KIND_ORDER = [k.name for k in KINDS]
BASE_KINDS = [k.name for k in KINDS if k.base]

SPAN = "struct<kind:string,start:bigint,end:bigint,text:string,score:double>"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, not once per element of an array inside."""
    return F.transform(F.array(value), use)[0]


def _running(items: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """One output of SQL type ``kind`` per item, with a position carried along.

    ``step(at, item)`` gives the next position and the output. Outputs are gathered in chunks, as
    adding them one by one to a single array would copy it every time.
    """
    def in_chunk(acc: Column, chunk: Column) -> Column:
        def one(a: Column, x: Column) -> Column:
            at, value = step(a["at"], x)
            return F.struct(at.alias("at"), F.concat(a["out"], F.array(value)).alias("out"))

        none = F.array().cast(f"array<{kind}>")
        return F.aggregate(
            chunk, F.struct(acc["at"].alias("at"), none.alias("out")), one,
            lambda a: F.struct(a["at"].alias("at"), F.concat(acc["out"], F.array(a["out"])).alias("out")))

    def whole(rows: Column) -> Column:
        last = F.greatest(F.size(rows) - 1, F.lit(0))
        chunks = F.transform(F.sequence(F.lit(0), last, F.lit(CHUNK)), lambda i: F.slice(rows, i + 1, CHUNK))
        none = F.array().cast(f"array<array<{kind}>>")
        zero = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))
        return F.flatten(F.aggregate(chunks, zero, in_chunk)["out"])

    return _bound(items, whole)


def _blocks(text: Column) -> Column:
    """The text in pieces of ``BLOCK`` code points, so that a place far inside is found at once."""
    cut = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))
    return F.when(F.char_length(text) <= BLOCK, F.array(text)).otherwise(cut)


def _part(blocks: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` (from 0) to ``end``, reading only the blocks it lies in."""
    first = F.floor(start / BLOCK).cast("int")
    held = F.array_join(F.slice(blocks, first + 1, F.floor(end / BLOCK).cast("int") - first + 1), "")
    return F.substring(held, (start - first * BLOCK + 1).cast("int"), (end - start).cast("int"))


def _matches(text: Column, kind: Kind) -> Column:
    """array<struct<start,end,text>> of every match, checked or not.

    ``split`` gives the gaps between matches: the k-th match begins after all gaps and matches
    ahead of it.
    """
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.transform(F.split(text, kind.pattern, -1), lambda g: F.char_length(g).cast("long"))
    both = _bound(found, lambda f: F.zip_with(F.slice(gaps, 1, F.size(f)), f,
                                              lambda g, m: F.struct(g.alias("gap"), m.alias("text"))))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["gap"]
        end = start + F.char_length(x["text"])
        return end, F.struct(start.alias("start"), end.alias("end"), x["text"].alias("text"))

    return _running(both, step, "struct<start:bigint,end:bigint,text:string>")


def kind_spans(text: Column, kind: Kind, near: int = NEAR) -> Column:
    """Confirmed spans of one kind, in order."""
    words = "(?i)(?<![a-z])(?:" + "|".join(kind.context) + ")(?![a-z])"

    def scored(m: Column, blocks: Column) -> Column:
        ahead = F.greatest(m["start"] - near, F.lit(0))
        around = F.concat_ws("\n", _part(blocks, ahead, m["start"]), _part(blocks, m["end"], m["end"] + near))
        bonus = F.when(around.rlike(words), kind.bonus).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), m["start"].alias("start"),
                        m["end"].alias("end"), m["text"].alias("text"),
                        F.round(F.lit(kind.score) + bonus, 3).alias("score"))

    confirmed = F.filter(_matches(text, kind), lambda m: kind.check(m["text"]))
    spans = _bound(_blocks(text), lambda b: F.transform(confirmed, lambda m: scored(m, b)))
    if not kind.base:  # a base kind stays whatever its score is
        spans = F.filter(spans, lambda s: s["score"] >= kind.needs)
    none = F.array().cast(f"array<{SPAN}>")
    return F.when(text.rlike(kind.maybe), spans.cast(f"array<{SPAN}>")).otherwise(none)


def spans_of(text: Column, kinds: Sequence[Kind] = KINDS) -> Column:
    """All confirmed spans, by kind as listed and then by start."""
    whole = F.coalesce(text, F.lit(""))
    return F.concat(*[kind_spans(whole, k) for k in kinds])


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
         kinds: Sequence[Kind] = KINDS) -> DataFrame:
    """(id, spans) with spans array<struct<kind,start,end,text,score>>."""
    return docs.select(F.col(id_column), spans_of(F.col(text_column), kinds).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one,
    named after the one that begins first."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def pieces(blocks: Column) -> Column:
        def step(at: Column, s: Column) -> tuple[Column, Column]:
            end = -s["back"]
            named = F.concat(_part(blocks, at, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
            piece = F.when(s["start"] < at, F.lit("")).otherwise(named)
            return F.greatest(at, end), piece

        return _running(ordered, step, "string")

    rest = _part(_blocks(text), F.array_max(F.transform(spans, lambda s: s["end"])), F.char_length(text).cast("long"))
    done = F.concat(F.array_join(_bound(_blocks(text), pieces), ""), rest)
    return F.when(F.size(spans) > 0, done).otherwise(text)
