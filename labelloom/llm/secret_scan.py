"""Secret scans: plain rules, and a battery of randomness tests with false-discovery control, in DataFrame functions only.

Plain rules find assignments, access keys and hexadecimal strings. Every other run of token characters is a candidate. Its
encoding is inferred from its characters, and three tests ask how far from ordinary text of its length it is: chi-squared
uniformity over the encoding's alphabet, runs of one character class, and serial correlation of neighbours. Each gives a standard
normal number, low where the token looks random; Stouffer's sum combines them, so that a test that finds it ordinary weighs
against the others. The p-value is the probability that ordinary text looks at least as random.

Candidates are judged against all of the corpus by the Benjamini-Hochberg rule, once per distinct token and apart for every
encoding and length class, so that many short names do not hide the long keys, nor let chance hits among themselves pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm.common import stored

KINDS = ("assign", "access", "hex", "random")
# Fixed patterns of the plain rules; letters of the key words in either case.
_KEYS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = rf"""(?:{_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = 16
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{LEAST},}}"

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"
# Encodings in the order they are tried: characters, size of the alphabet, and how often two characters of ordinary text are equal
# (also three of them). Ordinary text repeats letters as prose does, digits as numbers do.
ENCODINGS = (
    ("decimal", "^[0-9]+$", 10, 0.12, 0.018),
    ("hex", "^(?:[0-9a-f]+|[0-9A-F]+)$", 16, 0.12, 0.018),
    ("base32", "^[A-Z2-7]+$", 32, 0.065, 0.0056),
    ("letters", "^(?:[a-z_-]+|[A-Z_-]+)$", 28, 0.065, 0.0056),
    ("base62", "^[A-Za-z0-9]+$", 62, 0.06, 0.005),
    ("base64", "", 64, 0.06, 0.005),
)
# Encodings whose random strings can not be told from ordinary ones: numbers, and words in one case.
PLAIN = ("decimal", "letters")
# Share of neighbours of ordinary text where a run of one class ends, and the correlation of their places in the alphabet.
RUN_ENDS, CORRELATION = 0.2, 0.35
# Share of false discoveries, and the step in which -ln p is rounded down.
RATE, STEP = 0.05, 0.05
_TOP = 2000
# Steps that a running sum keeps in one piece.
_PIECE = 64


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def scan(items: Column, state: Column, out: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Array of what ``step(state, item)`` hands out next to the new state; ``out`` is the type of one entry.

    Entries are appended to short pieces: copying one long array at every step would be quadratic.
    """
    zero = F.struct(state.alias("state"), F.array().cast(f"array<{out}>").alias("now"), F.array().cast(f"array<array<{out}>>").alias("done"))

    def add(acc: Column, x: Column) -> Column:
        new, entries = step(acc["state"], x)
        full = F.size(acc["now"]) >= _PIECE
        return F.struct(new.alias("state"), F.when(full, entries).otherwise(F.concat(acc["now"], entries)).alias("now"),
                        F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"))

    return F.aggregate(items, zero, add, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["now"]))))


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as an array of (start, end, token), in code points, end exclusive.

    The text between matches and the matches themselves alternate, so their lengths add up to the places.
    """
    steps = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1),
                       lambda m, gap: F.struct(F.length(gap).cast("long").alias("gap"), m.alias("token")))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        end = at + x["gap"] + F.length(x["token"])
        return end, F.array(F.struct((at + x["gap"]).alias("start"), end.alias("end"), x["token"].alias("token")))

    # The text after the last match has no token.
    matches = F.filter(steps, lambda x: x["token"].isNotNull())
    return scan(matches, F.lit(0).cast("long"), "struct<start: bigint, end: bigint, token: string>", step)


def clear_of(spans: Column, base: Column) -> Column:
    """``base`` and those of ``spans`` that meet none of it, by start, then kind: two sweeps, so linear in their number."""
    out = "struct<start: bigint, kind: int, end: bigint>"
    extra = KINDS.index("random")

    def onward(reach: Column, x: Column) -> tuple[Column, Column]:
        plain = x["kind"] < extra
        return F.when(plain, F.greatest(reach, x["end"])).otherwise(reach), F.when(plain | (x["start"] >= reach), F.array(x)).otherwise(F.array().cast(f"array<{out}>"))

    def back(reach: Column, x: Column) -> tuple[Column, Column]:
        plain = x["kind"] < extra
        return F.when(plain, F.least(reach, x["start"])).otherwise(reach), F.when(plain | (x["end"] <= reach), F.array(x)).otherwise(F.array().cast(f"array<{out}>"))

    swept = scan(F.array_sort(F.concat(base, spans)), F.lit(0).cast("long"), out, onward)
    return F.reverse(scan(F.reverse(swept), F.lit(2**62).cast("long"), out, back))


def base_spans(text: Column) -> Column:
    """Spans of the plain rules as an array of (start, end, kind), by start, then kind."""
    kept = (
        ("assign", F.filter(located(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["token"], ASSIGN, 1)) >= 6)),
        ("access", F.filter(located(text, ACCESS), lambda x: F.length(x["token"]) >= 20)),
        # A run that is too short is dropped whole, so only long ones need be found.
        ("hex", located(text, HEX.replace("+", "{24,}"))),
    )
    return F.array_sort(F.concat(*[tagged(found, kind) for kind, found in kept]))


def tagged(found: Column, kind: str) -> Column:
    """Matches as (start, kind, end)."""
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))


def below(z: Column) -> Column:
    """Probability of a standard normal number below z, to about 1e-4 by a logistic curve."""
    return 1 / (1 + F.exp(-(F.lit(1.5976) * z + F.lit(0.070566) * z * z * z)))


def encoding(token: Column) -> Column:
    """Number of the first encoding whose characters the token keeps to."""
    out = F.lit(len(ENCODINGS) - 1)
    for i, (_, pattern, *_) in reversed(list(enumerate(ENCODINGS[:-1]))):
        out = F.when(token.rlike(pattern), F.lit(i)).otherwise(out)
    return out


def _of(code: Column, place: int) -> Column:
    return F.element_at(F.array(*[F.lit(float(e[place])) for e in ENCODINGS]), code + 1)


def char_class(c: Column) -> Column:
    """0 upper, 1 lower, 2 digit, 3 sign, from the place in the alphabet."""
    return F.when(c <= 26, 0).when(c <= 52, 1).when(c <= 62, 2).otherwise(3)


def z_uniform(token: Column, code: Column) -> Column:
    """Chi-squared over the alphabet, against ordinary text of this length; low: spread more evenly.

    The statistic grows with the number of equal pairs of characters, whose mean and variance in ordinary text follow from how often two and three
    characters are equal there.
    """
    n, size, two, three = F.length(token).cast("double"), _of(code, 2), _of(code, 3), _of(code, 4)
    counts = F.transform(F.array(*map(F.lit, ALPHABET)), lambda c: F.length(token) - F.length(F.replace(token, c, F.lit(""))))
    squares = F.aggregate(counts, F.lit(0).cast("long"), lambda a, o: a + o.cast("long") * o)
    chi = size / n * squares - n
    pairs = n * (n - 1) / 2
    variance = pairs * (two - two * two) + n * (n - 1) * (n - 2) * (three - two * two)
    return let(chi, lambda x: ((x + n) * n / size - n + 1 - 2 * pairs * two) / (2 * F.sqrt(variance)))


def z_runs_and_serial(token: Column) -> Column:
    """Against ordinary text of this length: low where the character class changes more often, and low where neighbours correlate less."""
    n = F.length(token).cast("double")
    places = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    zero = F.struct(*[F.lit(0).cast("long").alias(x) for x in ("first", "last", "ends", "sum", "square", "next")])

    def add(a: Column, x: Column) -> Column:
        # A capital before small letters begins a word and does not end a run; signs join words.
        ends = (a["last"] > 0) & (char_class(a["last"]) != char_class(x)) & ~((a["last"] <= 26) & (x <= 52)) & (char_class(x) < 3) & (a["last"] <= 62)
        return F.struct(F.when(a["first"] == 0, x).otherwise(a["first"]).cast("long").alias("first"), x.cast("long").alias("last"),
                        (a["ends"] + ends.cast("long")).alias("ends"), (a["sum"] + x).alias("sum"), (a["square"] + x * x).alias("square"), (a["next"] + a["last"] * x).alias("next"))

    def finish(a: Column) -> Column:
        top = n * (a["next"] + a["last"] * a["first"]) - a["sum"] * a["sum"]
        bottom = n * a["square"] - a["sum"] * a["sum"]
        # The neighbours of a token of one character are as alike as can be.
        serial = F.when(bottom > 0, F.least(F.greatest(top / bottom, F.lit(-0.999)), F.lit(0.999))).otherwise(0.999)
        runs = ((n - 1) * RUN_ENDS - a["ends"] + 0.5) / F.sqrt((n - 1) * (RUN_ENDS * (1 - RUN_ENDS)))
        # Vowels and consonants take turns, so ordinary neighbours may correlate either way.
        apart = F.abs(F.log((1 + serial) / (1 - serial)) / 2) - F.log(F.lit((1 + CORRELATION) / (1 - CORRELATION))) / 2
        return F.struct(runs.alias("runs"), (apart * F.sqrt(n - 3)).alias("serial"))

    return F.aggregate(places, zero, add, finish)


def surprise(token: Column, code: Column) -> Column:
    """-ln of the combined p-value in units of STEP, rounded down: 0 is ordinary, large is random. Numbers and words of one case are ordinary."""
    def steps(z: Column) -> Column:
        return F.floor(-F.log(F.greatest(below(z / F.sqrt(F.lit(3.0))), F.lit(1e-300))) / STEP).cast("int")

    plain = F.array(*[F.lit(i) for i, e in enumerate(ENCODINGS) if e[0] in PLAIN])
    tested = let(z_runs_and_serial(token), lambda r: let(r["runs"] + r["serial"] + z_uniform(token, code), steps))
    return F.when(F.array_contains(plain, code), F.lit(0)).otherwise(F.least(F.greatest(tested, F.lit(0)), F.lit(_TOP)))


def length_class(token: Column) -> Column:
    """Whole powers of two: 16 to 31 characters, 32 to 63 and so on."""
    return F.floor(F.log2(F.length(token) + F.lit(0.5))).cast("int")


def candidates(text: Column) -> Column:
    """Every candidate as (start, end, token, family, surprise); family is encoding and length class in one number."""
    def judge(x: Column) -> Column:
        return let(encoding(x["token"]), lambda code: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), x["token"].alias("token"),
            (code * 64 + length_class(x["token"])).alias("family"), surprise(x["token"], code).alias("surprise")))

    return F.transform(located(text, CANDIDATE), judge)


def thresholds(found: DataFrame, rate: float = RATE) -> DataFrame:
    """Per family the least surprise that is a discovery (Benjamini-Hochberg at ``rate`` over distinct tokens); none where nothing is.

    p-values are rounded up to steps, so the ranks come from counts per step: mergeable, and at most _TOP + 1 rows per family.
    """
    tokens = found.select(F.explode("found").alias("x")).select(F.sha2("x.token", 256).alias("token"), "x.family", "x.surprise").distinct()
    steps = tokens.groupBy("family", "surprise").agg(F.count("*").alias("n"))
    from_above = F.sum("n").over(Window.partitionBy("family").orderBy(F.desc("surprise")).rowsBetween(Window.unboundedPreceding, 0))
    ranked = steps.select("family", "surprise", from_above.alias("rank"), F.sum("n").over(Window.partitionBy("family")).alias("tests"))
    passing = ranked.where(F.exp(-STEP * F.col("surprise")) * F.col("tests") <= rate * F.col("rank"))
    return passing.groupBy("family").agg(F.min("surprise").alias("least"))


def secret_spans(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, base and spans: arrays of (start, kind, end) in code points of the whole text, by start, then kind (its number in KINDS).

    ``base`` has the plain rules' spans; ``spans`` also the candidates found random, unless a plain span covers or meets them. A null or
    empty text has none. Repeated rows come out each, but a token counts once in the tests; other columns are ignored; an empty
    table gives no rows. The families are at most 6 encodings times 40 length classes, so their thresholds are one small row.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = stored(docs.select(F.col("doc_id").cast("long"), base_spans(text).alias("base"), candidates(text).alias("found")), "secrets")
    limits = thresholds(rows, rate).agg(F.map_from_entries(F.collect_list(F.struct("family", "least"))).alias("limits"))
    joined = rows.crossJoin(F.broadcast(limits))
    random = F.filter("found", lambda x: F.coalesce(x["surprise"] >= F.try_element_at("limits", x["family"]), F.lit(False)))
    return joined.select("doc_id", "base", clear_of(tagged(random, "random"), F.col("base")).alias("spans"))


def span_line(spans: str) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))))


def secret_table(docs: DataFrame) -> DataFrame:
    """doc_id, number of plain spans of each kind, digest of the plain spans, and all spans."""
    got = secret_spans(docs)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return got.select("doc_id", *map(count, KINDS[:3]), F.sha2(F.encode(span_line("base"), "UTF-8"), 256).alias("base_sha256"), span_line("spans").alias("spans"))


def _located_sql(kind: int, pattern: str, keep: str) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT rid, {kind} AS kind, token, till - length(token) AS start, till AS stop FROM (
        SELECT rid, token, sum(length(gap) + length(token)) OVER (PARTITION BY rid ORDER BY i) AS till FROM (
            SELECT rid, unnest(string_split_regex(t, '{p}')) AS gap, unnest(regexp_extract_all(t, '{p}')) AS token,
                   unnest(range(len(regexp_extract_all(t, '{p}')) + 1)) AS i FROM d) WHERE token IS NOT NULL)
        WHERE {keep.replace("PATTERN", p)}"""


def _case_sql(place: int) -> str:
    return "CASE code " + " ".join(f"WHEN {i} THEN {float(e[place])}::DOUBLE" for i, e in enumerate(ENCODINGS)) + " END"


def _below_sql(z: str) -> str:
    return f"(1 / (1 + exp(-(1.5976::DOUBLE * {z} + 0.070566::DOUBLE * {z} * {z} * {z}))))"


_CLASS_SQL = "CASE WHEN {0} <= 26 THEN 0 WHEN {0} <= 52 THEN 1 WHEN {0} <= 62 THEN 2 ELSE 3 END"
_ENDS_SQL = f"""len(list_filter(range(1, len(places)), lambda i: ({_CLASS_SQL.format("places[i]")}) <> ({_CLASS_SQL.format("places[i + 1]")})
    AND NOT (places[i] <= 26 AND places[i + 1] <= 52) AND places[i + 1] <= 62 AND places[i] <= 62))"""
_CODE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(token, '{e[1]}') THEN {i}" for i, e in enumerate(ENCODINGS[:-1])) + f" ELSE {len(ENCODINGS) - 1} END"
ORACLE = rf"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), b AS (
    {_located_sql(0, ASSIGN, "length(regexp_extract(token, 'PATTERN', 1)) >= 6")} UNION ALL {_located_sql(1, ACCESS, "length(token) >= 20")}
    UNION ALL {_located_sql(2, HEX, "length(token) >= 24")}
), c AS (
    {_located_sql(3, CANDIDATE, "true")}
), k AS (
    SELECT DISTINCT token, {_CODE_SQL} AS code, list_transform(string_split(token, ''), lambda x: instr('{ALPHABET}', x)) AS places FROM c
), u AS (
    SELECT token, code, length(token)::DOUBLE AS n, {_case_sql(2)} AS size, {_case_sql(3)} AS two, {_case_sql(4)} AS three, {_ENDS_SQL} AS ends,
           list_sum(list_transform(string_split('{ALPHABET}', ''), lambda x: (length(token) - length(replace(token, x, ''))) ** 2)) AS squares,
           list_sum(places) AS total, list_sum(list_transform(places, lambda x: x * x)) AS square,
           list_sum(list_transform(range(1, len(places) + 1), lambda i: places[i] * places[i % len(places) + 1])) AS next FROM k
), v AS (
    SELECT *, size / n * squares - n AS chi, n * (n - 1) / 2 AS pairs,
           CASE WHEN n * square - total * total > 0 THEN least(greatest((n * next - total * total) / (n * square - total * total), -0.999::DOUBLE), 0.999::DOUBLE) ELSE 0.999::DOUBLE END AS serial FROM u
), w AS (
    SELECT *, ((chi + n) * n / size - n + 1 - 2 * pairs * two) / (2 * sqrt(pairs * (two - two * two) + n * (n - 1) * (n - 2) * (three - two * two))) AS z1,
           ((n - 1) * {RUN_ENDS}::DOUBLE - ends + 0.5::DOUBLE) / sqrt((n - 1) * ({RUN_ENDS}::DOUBLE * (1 - {RUN_ENDS}::DOUBLE))) AS z2,
           (abs(ln((1 + serial) / (1 - serial)) / 2) - ln({(1 + CORRELATION) / (1 - CORRELATION)}::DOUBLE) / 2) * sqrt(n - 3) AS z3 FROM v
), x AS (
    SELECT token, code, n, (z2 + z3 + z1) / sqrt(3.0::DOUBLE) AS x FROM w
), y AS (
    SELECT token, code * 64 + floor(log2(n + 0.5::DOUBLE))::INT AS family,
           CASE WHEN code IN ({", ".join(str(i) for i, e in enumerate(ENCODINGS) if e[0] in PLAIN)}) THEN 0
           ELSE least(greatest(floor(-ln(greatest({_below_sql('x')}, 1e-300::DOUBLE)) / {STEP}::DOUBLE)::INT, 0), {_TOP}) END AS surprise FROM x
), h AS (
    SELECT family, surprise, sum(count(*)) OVER (PARTITION BY family ORDER BY surprise DESC) AS rank, sum(count(*)) OVER (PARTITION BY family) AS tests FROM y GROUP BY family, surprise
), l AS (
    SELECT family, min(surprise) AS least FROM h WHERE exp(-{STEP}::DOUBLE * surprise) * tests <= {RATE}::DOUBLE * rank GROUP BY family
), f AS (
    SELECT c.rid, c.kind, c.start, c.stop FROM c JOIN y ON c.token = y.token JOIN l ON y.family = l.family AND surprise >= least
    WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.rid = c.rid AND b.start < c.stop AND c.start < b.stop)
), g AS (
    SELECT rid, kind, start, ['assign', 'access', 'hex', 'random'][kind + 1] || ':' || start || ':' || stop AS line FROM (
        SELECT rid, kind, start::BIGINT AS start, stop::BIGINT AS stop FROM b UNION ALL SELECT rid, kind, start::BIGINT, stop::BIGINT FROM f)
), r AS (
    SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
           string_agg(line, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(line, ',' ORDER BY start, kind) AS spans FROM g GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN r ON d.rid = r.rid
"""
