r"""Secret scans with DataFrame functions only.

Three fixed patterns give the base spans. Candidate strings besides them are judged by the Shannon entropy of
a window slid along them: counts per character of the candidate's class, packed into whole numbers, are kept up
to date by the character that enters and the one that leaves, and so is the sum of c*log2(c) from which the
entropy follows. An allow-list suppresses candidates that are no secrets whatever their entropy.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

VALUE = r"[A-Za-z0-9+/_.=-]"
# The base patterns.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

#: Candidates: runs of the characters that keys are written in. Hexadecimal ones form a class of their own.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
HEX_ONLY = r"^[0-9A-Fa-f]+$"
HEX_ALPHABET = "0123456789abcdef"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Least entropy in bits of the best window. No window of 20 characters has an entropy within 0.001 of these.
LEAST_HEX = 2.95
LEAST_OTHER = 3.75
#: Allow-list: no digit or no letter at all, UUIDs, paths of words, dates and serial numbers, placeholders.
ALLOWED = (
    r"^[^0-9]+$",
    r"^[^A-Za-z]+$",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^[a-z]+([/_-][a-z]+)+([/_-][0-9]+)?$",
    r"^[A-Za-z]+[0-9]{1,4}$",
    r"([Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Xx][Xx][Xx][Xx]|[Cc][Hh][Aa][Nn][Gg][Ee][Mm][Ee]|00000000)",
)


SPAN = "struct<start:int,rank:int,end:int,kind:string,hit:string,first:int>"
#: Matches that are gathered in one array before the next is begun: appending copies an array, so a long one would cost its square.
PART = 512


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is computed once however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def in_parts(items: Column, start: Column, gather: Callable[[Column, Column], Column], kind: str, finish: Callable[[Column, Column], Column] | None = None) -> Column:
    """Folds ``items`` from ``start`` by ``gather``, whose state has an array ``out`` of ``kind``; gives all that was put there.

    The state's array is put aside after every PART items. ``finish`` makes the result of the last state and the items.
    """
    fields = [f for f in start if f != "out"]
    state = lambda s, out: F.struct(*[s[f].alias(f) for f in fields], out.alias("out"))
    none, none_of = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def part(s: Column, p: Column) -> Column:
        own = F.aggregate(F.slice(items, p * PART + 1, F.lit(PART)), state(s, none), gather)
        return let(own, lambda r: state(r, F.concat(s["out"], F.array(r["out"]))))

    first = F.struct(*[v.alias(f) for f, v in start.items()], none_of.alias("out"))
    numbers = F.sequence(F.lit(0), F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / PART).cast("int"))
    return F.aggregate(numbers, first, part, lambda s: finish(s, F.flatten(s["out"])) if finish else F.flatten(s["out"]))


def spans(text: Column, pattern: str, kind: str) -> Column:
    """array<struct<start, rank, end, kind, hit, first>> of the leftmost non-overlapping matches, in code points; first: in bytes.

    The pieces between the matches and the matches themselves give the places by their lengths.
    """
    rank = KINDS.index(kind)

    def gather(state: Column, pair: Column) -> Column:
        begin, first = state["at"] + F.length(pair["before"]), state["byte"] + F.octet_length(pair["before"])
        end = begin + F.length(pair["hit"])
        one = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), pair["hit"].alias("hit"), first.alias("first"))
        return F.struct(end.alias("at"), (first + F.octet_length(pair["hit"])).alias("byte"), F.concat(state["out"], F.array(one)).alias("out"))

    pairs = lambda b, h: F.zip_with(F.slice(b, F.lit(1), F.size(h)), h, lambda x, y: F.struct(x.alias("before"), y.alias("hit")))
    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda h: let(pairs(F.split(text, pattern, -1), h), lambda p: in_parts(p, {"at": F.lit(0), "byte": F.lit(0)}, gather, SPAN)))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{SPAN}>"))


#: A count takes CELL bits, a bigint holds CELLS of them; c * log2(c) is kept in whole numbers of 1 / UNIT, so no sum drifts.
CELL, CELLS, UNIT = 5, 12, 1 << 44


def best_entropy(word: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The largest entropy in bits of ``window`` (31 at most) neighbouring characters of ``word``, by incremental counts.

    Each character is looked up once. From one window to the next a count goes up, another goes down, and the
    sum of c * log2(c) follows, at the same cost wherever the window is.
    """
    weight = lambda c: round(c * math.log2(c) * UNIT) if c > 1 else 0
    gain = F.array(*[F.lit(weight(c + 1) - weight(c)).cast("bigint") for c in range(window + 1)])
    places = F.array(*[F.struct(F.lit(k // CELLS).alias("part"), F.lit(k % CELLS * CELL).alias("shift"), F.lit(1 << k % CELLS * CELL).cast("bigint").alias("one")) for k in range(len(alphabet) + 1)])
    counted = lambda counts, s: F.call_function("shiftright", F.get(counts, s["part"]), s["shift"]).bitwiseAND(F.lit((1 << CELL) - 1).cast("bigint")).cast("int")
    zero = F.lit(0).cast("bigint")

    def step(state: Column, move: Column) -> Column:
        enters, leaves, counts = move["enters"], move["leaves"], state["counts"]
        same = leaves.isNotNull() & (enters == leaves)
        up = F.get(gain, counted(counts, enters))
        down = F.when(leaves.isNull(), zero).otherwise(F.get(gain, counted(counts, leaves) - 1))
        changed = F.transform(counts, lambda v, k: v + F.when(k == enters["part"], enters["one"]).otherwise(zero) - F.when(leaves.isNotNull() & (k == leaves["part"]), leaves["one"]).otherwise(zero))
        # The sum before this step; the last one is looked at in the end.
        least = F.when((state["seen"] >= window) & (state["total"] < state["least"]), state["total"]).otherwise(state["least"])
        return F.struct(F.when(same, counts).otherwise(changed).alias("counts"), F.when(same, state["total"]).otherwise(state["total"] + up - down).alias("total"), least.alias("least"), (state["seen"] + 1).alias("seen"))

    def scan(symbols: Column) -> Column:
        behind = F.slice(F.concat(F.array_repeat(F.lit(None).cast("struct<part:int,shift:int,one:bigint>"), window), symbols), F.lit(1), F.size(symbols))
        moves = F.zip_with(symbols, behind, lambda e, v: F.struct(e.alias("enters"), v.alias("leaves")))
        start = F.struct(F.array_repeat(zero, len(alphabet) // CELLS + 1).alias("counts"), zero.alias("total"), F.lit(1 << 60).cast("bigint").alias("least"), F.lit(0).alias("seen"))
        least = lambda s: F.when((s["seen"] >= window) & (s["total"] < s["least"]), s["total"]).otherwise(s["least"])
        return F.aggregate(moves, start, step, lambda s: F.log2(F.lit(float(window))) - least(s).cast("double") / (float(UNIT) * window))

    return let(F.transform(F.split(word, ""), lambda c: F.get(places, F.instr(F.lit(alphabet), c))), scan)


def allowed(word: Column) -> Column:
    out = F.lit(False)
    for pattern in ALLOWED:
        out = out | word.rlike(pattern)
    return out


def high_entropy(word: Column) -> Column:
    hexadecimal = best_entropy(F.lower(word), HEX_ALPHABET) >= LEAST_HEX
    return F.when(word.rlike(HEX_ONLY), hexadecimal).otherwise(best_entropy(word, ALPHABET) >= LEAST_OTHER)


def before(items: Column, field: str, place: Column, inclusive: bool) -> Column:
    """How many of ``items``, in ascending order of ``field``, are less than ``place`` there (or equal): a binary search."""

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        one = F.get(items, mid)[field]
        return let(F.struct(mid.alias("mid"), (one <= place if inclusive else one < place).alias("less")), lambda m: F.when(s["low"] >= s["high"], s).otherwise(F.struct(F.when(m["less"], m["mid"] + 1).otherwise(s["low"]).alias("low"), F.when(m["less"], s["high"]).otherwise(m["mid"]).alias("high"))))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(items) + 1.0)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(items).alias("high")), step, lambda s: s["low"])


def untouched(candidate: Column, assigns: Column) -> Column:
    """No base span touches the candidate. Access and hex spans lie within one candidate whole, so its own text tells."""
    last = before(assigns, "start", candidate["end"], False)
    assign = F.when(F.size(assigns) == 0, F.lit(False)).otherwise(let(last, lambda n: (n > 0) & (F.get(assigns, F.greatest(n - 1, F.lit(0)))["end"] > candidate["start"])))
    return ~candidate["hit"].rlike(ACCESS) & ~candidate["hit"].rlike(HEX) & ~assign


def touching(candidate: Column, assigns: Column) -> Column:
    """The base spans that touch a candidate, by start."""
    place = lambda x, by: F.struct((x["start"] + by).alias("start"), (x["end"] + by).alias("end"))
    own = [F.transform(spans(candidate["hit"], p, k), lambda x: place(x, candidate["start"])) for p, k in ((ACCESS, "access"), (HEX, "hex"))]
    some = let(F.struct(before(assigns, "end", candidate["start"], True).alias("low"), before(assigns, "start", candidate["end"], False).alias("high")), lambda r: F.slice(assigns, r["low"] + 1, F.greatest(r["high"] - r["low"], F.lit(0))))
    assign = F.when(F.size(assigns) == 0, F.array().cast("array<struct<start:int,end:int>>")).otherwise(F.transform(some, lambda x: place(x, F.lit(0))))
    return F.sort_array(F.concat(assign, *own))


def pieces(candidate: Column, assigns: Column) -> Column:
    """What base spans leave of a candidate, in pieces of at least WINDOW characters; the whole of one that none touches.

    Base spans of different kinds may overlap, so the cut goes on from the furthest end so far.
    """
    ends = F.struct(candidate["end"].alias("start"), candidate["end"].alias("end"))

    def gather(s: Column, b: Column) -> Column:
        skipped = s["at"] - candidate["start"]
        hit = F.substring(candidate["hit"], skipped + 1, F.greatest(b["start"] - s["at"], F.lit(0)))
        one = F.struct(s["at"].alias("start"), candidate["rank"].alias("rank"), b["start"].alias("end"), candidate["kind"].alias("kind"), hit.alias("hit"), (candidate["first"] + skipped).alias("first"))
        return F.struct(F.greatest(s["at"], b["end"]).alias("at"), F.when(b["start"] - s["at"] >= WINDOW, F.concat(s["out"], F.array(one))).otherwise(s["out"]).alias("out"))

    return let(F.concat(touching(candidate, assigns), F.array(ends)), lambda cuts: in_parts(cuts, {"at": candidate["start"]}, gather, SPAN))


def secret_spans(text: Column, rest: bool) -> Column:
    """All spans of a text with their hits and places in bytes, by start and then kind."""
    value_length = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2))
    judged = lambda c: ~allowed(c["hit"]) & high_entropy(c["hit"])
    if rest:
        more = lambda assigns: F.filter(F.flatten(F.transform(spans(text, CANDIDATE, "entropy"), lambda c: pieces(c, assigns))), judged)
    else:
        more = lambda assigns: F.filter(spans(text, CANDIDATE, "entropy"), lambda c: ~allowed(c["hit"]) & untouched(c, assigns) & high_entropy(c["hit"]))
    base = F.filter(spans(text, ASSIGN, "assign"), lambda s: value_length(s["hit"]) >= ASSIGN_LEAST)
    return let(base, lambda assigns: F.sort_array(F.concat(assigns, spans(text, ACCESS, "access"), spans(text, HEX, "hex"), more(assigns))))


def scan_secrets(docs: DataFrame, *, text: str = "text", out: str = "secrets", rest: bool = False) -> DataFrame:
    """``docs`` with ``out``: array<struct<start, rank, end, kind>>, by start and then kind; an existing column of that name is replaced.

    Base spans come from the fixed patterns, 'entropy' spans from the window; the latter never touch a
    base span. With ``rest``, what base spans leave of a candidate is measured too, piece by piece; without it (as in
    ``SQL``) such a candidate is passed over. Null and empty texts have none. Rows are scanned one by one without a shuffle, so repeated
    rows, null keys and empty tables need no rule; offsets count code points, the end is exclusive. The cost
    follows the text's length and the number of hits, however long a candidate is or however many there are.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    plain = F.transform(secret_spans(body, rest), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return docs.withColumn(out, plain)


def redact_secrets(docs: DataFrame, *, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span of ``scan_secrets``, rests of candidates included, replaced by ``mask``; overlapping spans become one. Texts without any stay as they are."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))

    def clean(found: Column) -> Column:
        data = F.col(text).cast("string").cast("binary")
        cut = lambda begin, end: F.substring(data, begin + 1, F.greatest(end - begin, F.lit(0))).cast("string")

        def gather(s: Column, x: Column) -> Column:
            piece = F.concat(cut(s["at"], x["first"]), F.lit(mask))
            kept = F.when(x["first"] >= s["at"], F.concat(s["out"], F.array(piece))).otherwise(s["out"])
            return F.struct(F.greatest(s["at"], x["first"] + F.octet_length(x["hit"])).alias("at"), kept.alias("out"))

        whole = in_parts(found, {"at": F.lit(0)}, gather, "string", lambda s, out: F.concat(F.array_join(out, ""), cut(s["at"], F.octet_length(data))))
        return F.when(F.size(found) > 0, whole).otherwise(F.col(text))

    return docs.withColumn(text, let(secret_spans(body, True), clean))


def secret_digests(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_assign, n_access, n_hex, base_sha256, spans, n_entropy`` per row; see ``scan_secrets`` for special cases."""
    found = scan_secrets(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    joined = lambda s: F.concat_ws(",", F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("secrets", lambda s: s["rank"] < KINDS.index("entropy"))
    return found.select(F.col("key").alias(key), count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"), count("entropy").alias("n_entropy"))


def _sql_spans(name: str, rank: int, pattern: str, keep: str = "true") -> str:
    """DuckDB: the same spans, one row each."""
    return f"""
{name}_raw AS (SELECT row, string_split_regex(text, '{pattern}') AS between, regexp_extract_all(text, '{pattern}') AS hits FROM body WHERE regexp_matches(text, '{pattern}')),
{name}_each AS (SELECT row, i, len(between[i]) AS before, hits[i] AS hit FROM (SELECT row, between, hits, unnest(range(1, len(hits) + 1)) AS i FROM {name}_raw)),
{name} AS (SELECT row, {rank} AS rank, '{KINDS[rank]}' AS kind, hit, CAST(before + coalesce(sum(before + len(hit)) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM {name}_each),
{name}_kept AS (SELECT row, rank, kind, hit, start, start + len(hit) AS stop FROM {name} WHERE {keep})"""


def _sql_allowed() -> str:
    return " OR ".join(f"regexp_matches(hit, '{p}')" for p in ALLOWED)


SQL = f"""
WITH body AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
{_sql_spans("assign", 0, ASSIGN, f"len(regexp_extract(hit, '{ASSIGN}', 2)) >= {ASSIGN_LEAST}")},
{_sql_spans("access", 1, ACCESS)},
{_sql_spans("hexes", 2, HEX)},
{_sql_spans("cand", 3, CANDIDATE, f"NOT ({_sql_allowed()})")},
base AS (SELECT * FROM assign_kept UNION ALL SELECT * FROM access_kept UNION ALL SELECT * FROM hexes_kept),
clear AS (SELECT * FROM cand_kept c WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.row = c.row AND b.start < c.stop AND c.start < b.stop)),
windows AS (SELECT row, rank, kind, start, stop, hit, regexp_matches(hit, '{HEX_ONLY}') AS is_hex, unnest(range(1, len(hit) - {WINDOW} + 2)) AS w FROM clear),
scored AS (SELECT row, rank, kind, start, stop, is_hex, max(list_aggregate(string_split(CASE WHEN is_hex THEN lower(hit[w:w + {WINDOW} - 1]) ELSE hit[w:w + {WINDOW} - 1] END, ''), 'entropy')) AS h FROM windows GROUP BY ALL),
every AS (SELECT row, rank, kind, start, stop FROM base UNION ALL SELECT row, rank, kind, start, stop FROM scored WHERE h >= CASE WHEN is_hex THEN {LEAST_HEX} ELSE {LEAST_OTHER} END),
listed AS (SELECT row, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, count(*) FILTER (rank = 3) AS n_entropy,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base_spans, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM every GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy
FROM body LEFT JOIN listed USING (row)
"""
