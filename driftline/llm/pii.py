"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Base kinds (email, ip, card, phone) always stay. Further kinds (iban, ssn, national phone) stay if
pattern, checksum (mod-97) and context words together reach KEEP_AT. An account number that runs on into other
capitals ends at the last blank where its checksum holds. All of it is Spark SQL; positions are
code points, end exclusive. Possessive quantifiers and look-behinds keep matching linear in the text.

Defined cases: null and empty texts have no spans; repeated rows and null ids each give their own row; spans
of different kinds may overlap; equal starts order by kind as listed, then end; an empty table gives an
empty result; very long texts are read whole; other columns, whatever their names, are kept or ignored, but for
one named like the output of `with_spans`, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL = r"[A-Za-z0-9._%+-]"

#: kind -> pattern, score of pattern and checksum alone. The order is the order of kinds.
PATTERNS = {
    "email": (rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.7),
    "card": (r"[0-9](?:[\x20-]?[0-9]){11,}+", 0.8),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", 0.6),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", 0.9),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.4),
    "national_phone": (r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", 0.3),
}
BASE = ("email", "ip", "card", "phone")
KEEP_AT, CONTEXT_BONUS, CONTEXT_CHARS = 0.6, 0.35, 40
#: Words near a span that speak for its kind. Their edges are spelt out, because \b means other things to other JVMs.
CONTEXT = {
    "email": r"(?i)(?<![\p{L}\p{N}_])(?:e-?mail|contact|write)(?![\p{L}\p{N}_])",
    "ip": r"(?i)(?<![\p{L}\p{N}_])(?:ip|host|server|address)(?![\p{L}\p{N}_])",
    "card": r"(?i)(?<![\p{L}\p{N}_])(?:card|visa|credit|payment)(?![\p{L}\p{N}_])",
    "phone": r"(?i)(?<![\p{L}\p{N}_])(?:tel|phone|call|mobile|fax)(?![\p{L}\p{N}_])",
    "iban": r"(?i)(?<![\p{L}\p{N}_])(?:iban|bank|account)(?![\p{L}\p{N}_])",
    "ssn": r"(?i)(?<![\p{L}\p{N}_])(?:ssn|social|security)(?![\p{L}\p{N}_])",
    "national_phone": r"(?i)(?<![\p{L}\p{N}_])(?:tel|phone|call|mobile|fax)(?![\p{L}\p{N}_])",
}
#: A character that every span of the kind needs: texts without it skip the pattern.
NEEDS = {"email": "@", "phone": "+"}
MARK, STAND_IN = "\x01", "\x02"
BLOCK = 64


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, whatever number of times the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def before(lengths: Column) -> Column:
    """Sum of the earlier elements, for each element; in blocks, so that long arrays stay cheap."""

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def with_blocks(sums: Column, n: Column) -> Column:
        heads = F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b)))
        return let(heads, lambda h: F.transform(n, lambda _, i: F.element_at(h, F.floor(i / BLOCK).cast("int") + 1) + total(F.slice(n, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))))

    return let(lengths, lambda n: F.when(F.size(n) == 0, F.array().cast("array<int>")).otherwise(
        let(F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(n, b * BLOCK + 1, F.lit(BLOCK)))), lambda sums: with_blocks(sums, n))))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, r"[^0-9]", "")


def luhn(d: Column) -> Column:
    value = lambda i: F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
    doubled = lambda v: F.when(v * 2 > 9, v * 2 - 9).otherwise(v * 2)
    total = F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, doubled(value(i))).otherwise(value(i)))
    return total % 10 == 0


def mod97(s: Column) -> Column:
    """An account number's remainder: first four characters last, letters as 10 to 35."""
    turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))

    def step(a: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: F.substring(turned, i, F.lit(1))), F.lit(0), step)


def confirmed(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})$"))
    if kind == "card":
        return let(digits(hit), lambda d: F.length(d).between(12, 19) & luhn(F.substring(d, 1, 19)))
    if kind == "phone":
        return F.length(digits(hit)).between(9, 15)
    return F.lit(True)


def confirmed_part(kind: str, hit: Column) -> Column:
    """The match if it is confirmed, else null; of an account number the longest confirmed part that ends at a blank."""
    if kind != "iban":
        return F.when(confirmed(kind, hit), hit)

    def longest(tokens: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.size(tokens)), lambda i: F.array_join(F.slice(tokens, F.lit(1), i), " "))
        plain = lambda x: F.regexp_replace(x, " ", "")
        return F.try_element_at(F.filter(parts, lambda x: F.when(F.length(plain(x)).between(15, 34), mod97(plain(x)) == 1).otherwise(False)), F.lit(-1))

    return let(F.split(hit, " "), longest)


SPAN = "array<struct<start:int,kind:int,end:int,score:double>>"


def spans_of(kind: str, text: Column) -> Column:
    """Confirmed spans of one kind, in order. The pattern runs once: matches are set between marks (which
    stand in for no character of any pattern) and the text is cut at them, so odd pieces are matches."""
    number, (pattern, score) = list(PATTERNS).index(kind), PATTERNS[kind]
    pieces = F.split(F.regexp_replace(F.translate(text, MARK, STAND_IN), pattern, f"{MARK}$0{MARK}"), MARK, -1)

    def built(p: Column) -> Column:
        def all_of(at: Column) -> Column:
            def one(piece: Column, i: Column) -> Column:
                start = F.element_at(at, i + 1)
                near = F.concat_ws(" ", F.substring(F.element_at(p, i), F.greatest(F.lit(1), F.length(F.element_at(p, i)) - CONTEXT_CHARS + 1), F.lit(CONTEXT_CHARS)), F.substring(F.element_at(p, i + 2), F.lit(1), F.lit(CONTEXT_CHARS)))
                scored = F.round(F.lit(score) + F.when(near.rlike(CONTEXT[kind]), CONTEXT_BONUS).otherwise(0.0), 2)
                return let(confirmed_part(kind, piece), lambda x: F.when(x.isNotNull(), F.struct(start.alias("start"), F.lit(number).alias("kind"), (start + F.length(x)).alias("end"), scored.alias("score"))))

            found = F.filter(F.transform(p, lambda x, i: F.when(i % 2 == 1, one(x, i))), lambda s: s.isNotNull())
            return found if kind in BASE else F.filter(found, lambda s: s["score"] >= KEEP_AT)

        return let(before(F.transform(p, F.length)), all_of)

    some = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike(pattern)
    return F.when(some, let(pieces, lambda p: F.when(F.size(p) > 1, built(p)))).cast(SPAN)


def with_spans(docs: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """`docs` with an array of (start, kind, end, score) in the order of start, kind, end."""
    none = F.array().cast(SPAN)
    each = {f"__pii_{k}": F.coalesce(spans_of(k, F.col(text_col)), none) for k in PATTERNS}
    return docs.withColumns(each).withColumn(out, F.array_sort(F.concat(*each))).drop(*each)


def joined(spans: Column) -> Column:
    names = F.lit(list(PATTERNS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) per row."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = with_spans(slim, "text", "all").select("id", "all")
    count = lambda k: F.size(F.filter("all", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("all", lambda s: s["kind"] < len(BASE))
    return found.select(F.col("id").alias(id_col), *(count(i).alias(f"n_{k}") for i, k in enumerate(BASE)), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))


CHARS = 1024


def before_max(values: Column) -> Column:
    """Largest of the earlier elements (0 at first), for each element; in blocks, so that long arrays stay cheap."""
    top = lambda a: F.coalesce(F.array_max(a), F.lit(0))

    def with_blocks(tops: Column, n: Column) -> Column:
        heads = F.transform(tops, lambda _, b: top(F.slice(tops, F.lit(1), b)))
        own = lambda i: top(F.slice(n, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))
        return let(heads, lambda h: F.transform(n, lambda _, i: F.greatest(F.element_at(h, F.floor(i / BLOCK).cast("int") + 1), own(i))))

    tops = lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / BLOCK).cast("int")), lambda b: top(F.slice(n, b * BLOCK + 1, F.lit(BLOCK))))
    return let(values, lambda n: let(tops(n), lambda t: with_blocks(t, n)))


def between(parts: Column, first: Column, end: Column) -> Column:
    """Characters first to end of a text cut in parts of CHARS: only the parts around are read."""
    part = lambda at: F.floor(at / CHARS).cast("int")
    some = F.slice(parts, part(first) + 1, F.greatest(F.lit(0), part(end) - part(first) + 1))
    return F.when(first >= end, "").otherwise(F.substring(F.array_join(some, ""), first % CHARS + 1, end - first))


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with every span replaced by [KIND]; overlapping spans give the first one's mark."""
    tags = F.lit([f"[{k.upper()}]" for k in PATTERNS])

    def rebuilt(s: Column, parts: Column) -> Column:
        def with_done(done: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                at = F.element_at(done, i + 1)
                return F.when(x["start"] >= at, F.concat(between(parts, at, x["start"]), F.element_at(tags, x["kind"] + 1))).otherwise("")

            last = F.array_max(F.transform(s, lambda y: y["end"]))
            return F.concat(F.array_join(F.transform(s, one), ""), between(parts, last, F.length(text_col)))

        return let(before_max(F.transform(s, lambda y: y["end"])), with_done)

    found = with_spans(docs, text_col, "__pii_all")
    cut = F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{CHARS}}}"), F.lit(0))
    new = let(F.col("__pii_all"), lambda s: let(cut, lambda parts: rebuilt(s, parts)))
    return found.withColumn(text_col, F.when(F.size("__pii_all") > 0, new).otherwise(F.col(text_col))).drop("__pii_all")
