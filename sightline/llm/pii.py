"""Personal data by patterns and bootstrapped contextual extraction, in DataFrame operations only.

*Base.* E-mail addresses, IP addresses, card and phone numbers are found by regular expressions over the whole text, and checked
(parts of an address at most 255, card numbers of 16 to 19 digits by Luhn, phone numbers of 8 to 15 digits). They are the seeds.

*Bootstrapping.* Candidates are all tokens with a digit or an at sign. Each occurrence has two lexical patterns: the word before with the
shape of the token, and the shape with the word after (within ``CONTEXT`` characters; letters in the shape collapse, digits
keep their number, also in the words). Patterns and tokens form a graph. In each of ``ROUNDS`` rounds a pattern's confidence for a kind is the share of its
distinct tokens that are known to be of the kind, given at least ``SUPPORT`` of them; a token is learned for a kind if its confident patterns
together (noisy or) reach ``LEARN``. Occurrences outside base spans in a pattern of at least ``CONFIDENCE`` become spans of its kind.
The graph is aggregated per (pattern, token) before it is joined, and only scores are joined in a round.

Positions are code points, ends exclusive. Defined results: null texts count as empty; a token learned for several kinds takes the one
with the best confidence, then the first as listed; repeated rows get equal results; an empty table gives no rows; other
columns are not read. The patterns cannot backtrack beyond the character runs they start at, so very long texts take linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.text import let
from sightline.llm.common import columns_of
from sightline.session import cut

KINDS = ["email", "ip", "card", "phone"]
ROUNDS = 3
SUPPORT = 5
CONFIDENCE = 0.9
LEARN = 0.95
CONTEXT = 60
#: Learned tokens of a kind with at most so many characters between them are one span.
JOIN = 2
#: Matches whose lengths are added up together.
BLOCK = 64
#: Leftmost matches as the plain expressions have them; possessive, and begun only where a run of characters begins
#: or the last match ended.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_TOKEN = r"(?<![A-Za-z0-9@._%+-])[A-Za-z._%+-]*+[0-9@][A-Za-z0-9@._%+-]*+"
_GUARDS = {_EMAIL: r"@[A-Za-z0-9-]++\.", _IP: r"[0-9]\.[0-9]++\.", _CARD: _CARD, _PHONE: r"\+[0-9]", _TOKEN: "[0-9@]"}


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda acc, x: acc + x)


def _sums_before(values: Column) -> Column:
    """For each number the sum of those before it, by blocks of BLOCK: the sums of whole blocks, then the rest of its own."""

    def blocks(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda j: _total(F.slice(x, j * BLOCK + 1, F.lit(BLOCK))))

    def before(b: Column) -> Column:
        return F.transform(b, lambda _, j: _total(F.slice(b, F.lit(1), j)))

    def each(x: Column, sums: Column) -> Column:
        return F.transform(x, lambda _, i: F.get(sums, F.floor(i / BLOCK).cast("int")) + _total(F.slice(x, i - i % BLOCK + 1, i % BLOCK)))

    some = let(values, lambda x: let(let(blocks(x), before), lambda sums: each(x, sums)))
    return F.when(F.size(values) > 0, some).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of all matches, and the text on either side of each: before, after."""
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"), F.split(text, pattern, -1).alias("gaps"))

    def placed(m: Column) -> Column:
        values, gaps = m["values"], m["gaps"]
        steps = F.zip_with(values, F.slice(gaps, F.lit(1), F.size(values)), lambda value, gap: F.length(gap) + F.length(value))
        return let(steps, lambda x: let(_sums_before(x), lambda at: F.transform(values, lambda value, i: match(value, F.get(gaps, i), F.get(gaps, i + 1), F.get(at, i)))))

    def match(value: Column, before: Column, after: Column, at: Column) -> Column:
        start = at + F.length(before)
        return F.struct(
            start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"),
            F.substring(before, -CONTEXT, CONTEXT).alias("before"), F.substring(after, 1, CONTEXT).alias("after"),
        )

    return F.when(text.rlike(_GUARDS[pattern]), let(found, placed))


def _plain(found: Column, good) -> Column:
    """(start, end) of the matches that pass the check."""
    kept = F.transform(F.filter(found, lambda x: good(x["value"])), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return F.coalesce(kept, F.array().cast("array<struct<start:int,end:int>>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _octets(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike(r"^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


CHECKS = {
    "email": (_EMAIL, lambda v: F.lit(True)),
    "ip": (_IP, _octets),
    "card": (_CARD, lambda v: F.call_function("luhn_check", _digits(v))),
    "phone": (_PHONE, lambda v: F.length(_digits(v)).between(8, 15)),
}


def base_spans(docs: DataFrame) -> DataFrame:
    """row, doc_id, an array of (start, end) per kind, and the candidate tokens; a written table."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        *(_plain(matches(F.col("text"), pattern), good).alias(kind) for kind, (pattern, good) in CHECKS.items()),
        matches(F.col("text"), _TOKEN).alias("tokens"),
    )
    return cut(rows, "base")


def _digits_alike(text: Column) -> Column:
    return F.translate(text, "0123456789", "9999999999")


def _shape(token: Column) -> Column:
    return _digits_alike(F.regexp_replace(token, "[A-Za-z]+", "a"))


def occurrences(base: DataFrame) -> DataFrame:
    """row, start, end, token, its two patterns, and the kind of the base span it overlaps; a written table."""
    rows = base.where(F.size("tokens") > 0).select("row", *KINDS, F.explode("tokens").alias("t"))
    token = F.rtrim(F.col("t.value"), F.lit(".-%+_"))
    start, end = F.col("t.start"), F.col("t.start") + F.length(token)
    kind = F.coalesce(*(F.when(F.exists(k, lambda s: (s["start"] < end) & (s["end"] > start)), F.lit(k)) for k in KINDS))
    before = _digits_alike(F.lower(F.regexp_extract("t.before", r"(\S{1,40})\s*$", 1)))
    after = _digits_alike(F.lower(F.regexp_extract("t.after", r"^[^\s\w]*\s*(\S{1,40})", 1)))
    return cut(
        rows.where(F.length(token) > 0).select(
            "row", start.alias("start"), end.alias("end"), F.lower(token).alias("token"), kind.alias("kind"),
            F.array(
                F.when(before != "", F.concat(before, F.lit(" <"), _shape(token))), F.when(after != "", F.concat(_shape(token), F.lit("> "), after))
            ).alias("patterns"),
        ),
        "tokens",
    )


def confident(edges: DataFrame, known: DataFrame, support: int, least: float) -> DataFrame:
    """(pattern, kind, confidence) of the patterns whose tokens are mostly of one kind."""
    rows = edges.join(known, "token", "left")
    counted = rows.groupBy("pattern").agg(F.count("*").alias("n"), *(F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in KINDS))
    best = F.greatest(*KINDS)
    kind = F.coalesce(*(F.when(F.col(k) == best, F.lit(k)) for k in KINDS))
    return counted.select("pattern", kind.alias("kind"), best.alias("of"), "n").where(
        (F.col("of") >= support) & (F.col("of") >= F.col("n") * least)
    ).select("pattern", "kind", ((F.col("of") + 0.5) / (F.col("n") + 1)).alias("confidence"))


def discovered(seen: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, least: float = CONFIDENCE, learn: float = LEARN) -> DataFrame:
    """(row, kind, start, end) of occurrences that only their context gives away."""
    edges = seen.select("token", F.explode("patterns").alias("pattern")).where("pattern is not null").groupBy("pattern", "token").agg(F.count("*").alias("times"))
    edges = cut(edges.select("pattern", "token"), "edges")
    counted = seen.where("kind is not null").groupBy("token").agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in KINDS))
    kind = F.coalesce(*(F.when(F.col(k) == F.greatest(*KINDS), F.lit(k)) for k in KINDS))
    known = cut(counted.select("token", kind.alias("kind")), "known")
    for turn in range(rounds):
        good = cut(confident(edges, known, support, least), "patterns")
        if turn == rounds - 1 or good.isEmpty():
            break
        doubt = edges.join(good, "pattern").groupBy("token", "kind").agg(F.sum(F.log1p(-F.col("confidence"))).alias("doubt"))
        fresh = doubt.where(1 - F.exp("doubt") >= learn).join(known, "token", "left_anti")
        first = fresh.groupBy("token").agg(F.min_by("kind", "doubt").alias("kind"))
        more = cut(known.unionByName(first), "known")
        if more.count() == known.count():
            break
        known = more
    found = seen.where("kind is null").select("row", "start", "end", F.explode("patterns").alias("pattern")).join(good, "pattern")
    order = F.struct(F.col("confidence"), F.lit(len(KINDS)) - F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")))
    found = found.groupBy("row", "start", "end").agg(F.max_by("kind", order).alias("kind"))
    near = Window.partitionBy("row", "kind").orderBy("start")
    found = found.withColumn("opens", F.when(F.col("start") - F.lag("end").over(near) <= JOIN, 0).otherwise(1))
    found = found.withColumn("part", F.sum("opens").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    return found.groupBy("row", "kind", "part").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("part")


def _listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat(F.lit(kind + ":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_<kind> of base spans, base_sha256, spans (all, as kind:start:end), n_added."""
    base = base_spans(columns_of(docs, doc_id=id_col, text=text_col))
    added = discovered(occurrences(base))
    added = added.groupBy("row").agg(*(F.collect_list(F.when(F.col("kind") == k, F.struct("start", "end"))).alias(f"more_{k}") for k in KINDS))
    rows = base.drop("tokens").join(added, "row", "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    every = [F.array_sort(F.concat(F.col(k), F.coalesce(F.col(f"more_{k}"), none))) for k in KINDS]
    total = [F.size(F.coalesce(F.col(f"more_{k}"), none)) for k in KINDS]
    return rows.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.concat_ws(",", *(_listed(k, F.col(k)) for k in KINDS)), 256).alias("base_sha256"),
        F.concat_ws(",", *(_listed(k, x) for k, x in zip(KINDS, every, strict=True))).alias("spans"),
        (total[0] + total[1] + total[2] + total[3]).cast("long").alias("n_added"),
    )
