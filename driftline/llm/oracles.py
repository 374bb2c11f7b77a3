"""DuckDB SQL for the corpus queries that SQL can express.

None of it is built from the operators' own patterns or steps, except op10's model. Rows are told apart by
number, so that repeated and null ids keep their own rows.
"""

from . import urls

#: The five primes of XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
LOW = 2**64 - 1


def _low(x: str) -> str:
    return f"(({x}) & {LOW}::UHUGEINT)::UBIGINT"


def _times(x: str, by: int) -> str:
    return _low(f"({x})::UHUGEINT * {by}::UHUGEINT")


def _plus(x: str, y) -> str:
    return _low(f"({x})::UHUGEINT + ({y})::UHUGEINT")


def _turned(x: str, bits: int) -> str:
    return f"({_times(x, 2**bits)} | (({x}) >> {64 - bits}))"


def xxh64_steps(source: str, seed: int) -> str:
    """CTEs that end in hashed(s, h): XXH64 of the strings s of `source`, a step each."""
    number = lambda first, n: "+".join(f"('0x' || substr(x, 2 * ({first} + {k}) + 1, 2))::UBIGINT * {256**k}::UBIGINT" for k in range(n))
    starts = [(seed + P1 + P2) & LOW, (seed + P2) & LOW, seed, (seed - P1) & LOW]
    column = lambda j: f"list_transform(list_filter(range(0, n // 32 * 4), lambda k: k % 4 = {j}), lambda k: mixed[k + 1])"
    lane = ", ".join(f"list_reduce(list_prepend({v}::UBIGINT, {column(j)}), lambda a, y: {_times(_turned(_plus('a', 'y'), 31), P1)}) AS v{j}" for j, v in enumerate(starts))
    folded = "h0"
    layers = []
    for j in range(4):
        layers.append(f"f{j} AS (SELECT * EXCLUDE ({folded}), {_plus(_times(f'xor({folded}, ' + _times(_turned(_times(f'v{j}', P2), 31), P1) + ')', P1), P4)} AS {folded} FROM {f'f{j - 1}' if j else 'began'})")
    sums = _low(" + ".join(f"({_turned(f'v{j}', b)})::UHUGEINT" for j, b in enumerate((1, 7, 12, 18))))
    return f"""texts AS (SELECT DISTINCT s, hex(encode(s)) AS x, strlen(s) AS n FROM {source}),
lanes AS (SELECT s, x, n, list_transform(list_transform(range(0, n // 8), lambda k: {number("8 * k", 8)}), lambda y: {_times("y", P2)}) AS mixed FROM texts),
striped AS (SELECT *, {lane} FROM lanes),
began AS (SELECT *, {sums} AS h0 FROM striped),
{", ".join(layers)},
eights AS (SELECT s, x, n, list_reduce(list_prepend({_plus(f"CASE WHEN n >= 32 THEN h0 ELSE {(seed + P5) & LOW}::UBIGINT END", "n")},
    list_transform(mixed[n // 32 * 4 + 1:], lambda y: {_times(_turned("y", 31), P1)})), lambda a, y: {_plus(_times(_turned("xor(a, y)", 27), P1), P4)}) AS h FROM f3),
four AS (SELECT s, x, n, CASE WHEN n % 8 >= 4 THEN xor(h, {_times(number("n // 8 * 8", 4), P1)}) ELSE h END AS h FROM eights),
fours AS (SELECT s, x, n, CASE WHEN n % 8 >= 4 THEN {_plus(_times(_turned("h", 23), P2), P3)} ELSE h END AS h FROM four),
ones AS (SELECT s, list_reduce(list_prepend(h, list_transform(range(n // 4 * 4, n), lambda k: {_times(number("k", 1), P5)})), lambda a, y: {_times(_turned("xor(a, y)", 11), P1)}) AS h FROM fours),
spread AS (SELECT s, {_times("xor(h, h >> 33)", P2)} AS h FROM ones),
spread2 AS (SELECT s, {_times("xor(h, h >> 29)", P3)} AS h FROM spread),
hashed AS MATERIALIZED (SELECT s, xor(h, h >> 32) AS h FROM spread2)"""


#: Fingerprints are compared each with each: this is brute force, for small tables.
SIMHASH = rf"""WITH RECURSIVE docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (SELECT r, array_to_string(list_slice(w, i, i + 2), ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM docs WHERE len(w) > 0)),
{xxh64_steps("shingles", 42)},
bits AS (SELECT r, b, 2 * sum((h >> b::UBIGINT) & 1) > count(*) AS one FROM shingles JOIN hashed USING (s), range(64) AS t(b) GROUP BY r, b),
prints AS (SELECT r, sum(CASE WHEN one THEN 1::HUGEINT << b::HUGEINT ELSE 0::HUGEINT END)::UBIGINT AS f FROM bits GROUP BY r),
named AS MATERIALIZED (SELECT doc_id, coalesce(f, 0::UBIGINT) AS f FROM docs LEFT JOIN prints USING (r)),
links AS MATERIALIZED (SELECT x.f AS a, y.f AS b FROM (SELECT DISTINCT f FROM named) x, (SELECT DISTINCT f FROM named) y WHERE x.f <> y.f AND bit_count(xor(x.f, y.f)) <= 2),
reach AS (SELECT DISTINCT f, f AS g FROM named UNION SELECT reach.f, links.b FROM reach JOIN links ON links.a = reach.g),
least AS (SELECT reach.f, min(doc_id) AS component_id FROM reach JOIN named ON named.f = reach.g GROUP BY reach.f)
SELECT doc_id, lpad(lower(hex(f)), 16, '0') AS fingerprint, component_id FROM named JOIN least USING (f)"""

#: Windows are equal if their MD5 sums are.
SUFFIX_DEDUP = """WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
windows AS MATERIALIZED (SELECT r, p, md5(array_slice(b, p, p + 399)) AS h FROM (SELECT r, b, unnest(range(1, octet_length(b) - 398)) AS p FROM docs)),
often AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
starts AS (SELECT r, p, p > coalesce(lag(p) OVER (PARTITION BY r ORDER BY p), -1000) + 400 AS fresh FROM windows SEMI JOIN often USING (h)),
numbered AS (SELECT r, p, sum(fresh::INT) OVER (PARTITION BY r ORDER BY p) AS k FROM starts),
runs AS MATERIALIZED (SELECT r, k, min(p) AS first, max(p) + 399 AS last FROM numbered GROUP BY r, k),
edges AS (SELECT r, coalesce(lag(last) OVER (PARTITION BY r ORDER BY first), 0) + 1 AS first, first - 1 AS last FROM (
    SELECT r, first, last FROM runs UNION ALL SELECT r, octet_length(b) + 1, NULL FROM docs)),
kept AS (SELECT r, sha256(unhex(string_agg(CASE WHEN e.first <= e.last THEN hex(array_slice(b, e.first, e.last)) ELSE '' END, '' ORDER BY e.first))) AS kept_sha256
    FROM docs JOIN edges e USING (r) GROUP BY r),
removed AS (SELECT r, sum(last - first + 1)::BIGINT AS n, count(*) AS spans FROM runs GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(spans, 0) AS n_spans, kept_sha256
FROM docs JOIN kept USING (r) LEFT JOIN removed USING (r)"""

DECONTAMINATE = r"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS item,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
searched AS MATERIALIZED (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + 12), ' ') AS words
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 11, 2))) AS i FROM items WHERE len(w) > 0)),
places AS (SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS words
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM searched))),
found AS MATERIALIZED (SELECT r, i, n, item FROM places JOIN searched USING (n, words)),
covered AS (SELECT r, count(DISTINCT k) AS hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS k, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(hit, 0) AS n_hit, coalesce(k, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
    coalesce(hit, 0) > 0 AND 20 * coalesce(hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN named USING (r)"""

#: DuckDB's patterns have no look-around. For the kinds that need it a copy of the text, character for character, is
#: searched in which just the characters that may not stand beside a match are letters or digits, so that \b
#: and \B tell the edges. A national number may end before a dot or plus, which then belongs to its match as T or P.
PII = r"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
kinds(kind, name, searched, pattern, context) AS (VALUES
    (0, 'email', 'as is', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', ''),
    (1, 'ip', 'as is', '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)', ''),
    (2, 'card', 'as is', '[0-9](?:[\x20-]?[0-9])+', ''),
    (3, 'phone', 'as is', '\+[0-9][\x20().0-9-]+[0-9]', ''),
    (4, 'iban', 'no underscores', '\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b', ''),
    (5, 'ssn', 'dashes as letters', '\b[0-9]{3}D[0-9]{2}D[0-9]{4}\b', '(?i)(?:^|[^\p{L}\p{N}_])(?:ssn|social|security)(?:$|[^\p{L}\p{N}_])'),
    (6, 'national_phone', 'signs as letters', '(?:\b|\B\()[0-9]{3}\)?[\x20TD][0-9]{3}[\x20TD][0-9]{4}(?:\b|[PT])', '(?i)(?:^|[^\p{L}\p{N}_])(?:tel|phone|call|mobile|fax)(?:$|[^\p{L}\p{N}_])')),
copies AS (SELECT r, 'as is' AS searched, t AS copy FROM docs UNION ALL
    SELECT r, 'no underscores', translate(t, '_', '!') FROM docs UNION ALL
    SELECT r, 'dashes as letters', translate(regexp_replace(t, '[A-Za-z_]', '!', 'g'), '-', 'D') FROM docs UNION ALL
    SELECT r, 'signs as letters', translate(regexp_replace(t, '[A-Za-z_]', '!', 'g'), '+.-', 'PTD') FROM docs),
cut AS (SELECT r, kind, regexp_extract_all(copy, pattern) AS hits, regexp_split_to_array(copy, pattern) AS gaps FROM copies JOIN kinds USING (searched)),
matches AS (SELECT r, kind, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS hit, unnest(gaps[:-2]) AS gap FROM cut WHERE len(hits) > 0),
placed AS (SELECT r, kind, i, (sum(length(gap) + length(hit)) OVER w - length(hit))::BIGINT AS first,
    length(CASE WHEN kind = 6 THEN rtrim(hit, 'PT') ELSE hit END) AS n FROM matches WINDOW w AS (PARTITION BY r, kind ORDER BY i)),
read AS (SELECT r, kind, first, first + n AS last, substr(t, first + 1, n) AS hit,
    right(substr(t, coalesce(lag(first + n) OVER w, 0) + 1, first - coalesce(lag(first + n) OVER w, 0)), 40) || ' ' ||
    left(substr(t, first + n + 1, coalesce(lead(first) OVER w, length(t)) - first - n), 40) AS near
    FROM placed JOIN docs USING (r) WINDOW w AS (PARTITION BY r, kind ORDER BY i)),
parts AS (SELECT *, regexp_replace(hit, '[^0-9]', '', 'g') AS digits, string_split(hit, ' ') AS tokens FROM read),
accounts AS (SELECT *, list_transform(range(1, len(tokens) + 1), lambda k: array_to_string(tokens[1:k], ' ')) AS starts FROM parts),
judged AS (SELECT r, kind, first, CASE kind
    WHEN 0 THEN last
    WHEN 1 THEN CASE WHEN len(list_filter(string_split(hit, '.'), lambda p: length(ltrim(p, '0')) > 3 OR lpad(right(p, 3), 3, '0') > '255')) = 0 THEN last END
    WHEN 2 THEN CASE WHEN length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(0, length(digits)), lambda k:
        CASE WHEN k % 2 = 0 THEN substr(digits, length(digits) - k, 1)::INT ELSE ([0, 2, 4, 6, 8, 1, 3, 5, 7, 9])[substr(digits, length(digits) - k, 1)::INT + 1] END)) % 10 = 0 THEN last END
    WHEN 3 THEN CASE WHEN length(digits) BETWEEN 9 AND 15 THEN last END
    WHEN 4 THEN first + list_max(list_transform(list_filter(starts, lambda s: length(replace(s, ' ', '')) BETWEEN 15 AND 34 AND
        list_reduce(list_prepend(0, list_transform(string_split(substr(replace(s, ' ', ''), 5) || left(s, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE ascii(c) - 55 END)),
            lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1), lambda s: length(s)))
    ELSE CASE WHEN regexp_matches(near, context) THEN last END END AS last, name
    FROM accounts JOIN kinds USING (kind)),
spans AS (SELECT r, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card, count(*) FILTER (kind = 3) AS n_phone,
    string_agg(name || ':' || first || ':' || last, ',' ORDER BY first, kind, last) FILTER (kind < 4) AS base,
    string_agg(name || ':' || first || ':' || last, ',' ORDER BY first, kind, last) AS every FROM judged WHERE last IS NOT NULL GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM docs LEFT JOIN spans USING (r)"""

ORACLES: dict[str, str] = {
    "op2_simhash": SIMHASH,
    "op3_suffix_dedup": SUFFIX_DEDUP,
    "op5_decontaminate": DECONTAMINATE,
    "op6_pii": PII,
    "op10_url_filter": urls.oracle(),
}
