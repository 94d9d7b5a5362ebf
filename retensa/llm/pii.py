"""Personal data by weak supervision, in DataFrame operations only.

Four exact patterns (email, ip, card, phone) give the base spans.  Looser patterns give
candidates of further kinds; regex, gazetteer and context labelers vote on each.
Expectation-maximisation over the counts of vote patterns (a bounded table) estimates how
reliable every labeler is and how likely each pattern is personal.  Those posteriors train
a span classifier (weighted feature counts as log odds), which decides on the candidates.

Patterns are written so that Java's matcher neither recurses nor scans a run twice:
possessive parts, and a start only where a run begins or the last match ended.

Defined cases: a null text is empty and has no spans; repeated rows have the same spans;
null ids are carried; candidates over a base span are dropped; of accepted candidates that
overlap the earlier kind stays; without candidates nothing is added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import same, stored

LOCAL = "[A-Za-z0-9._%+-]"
HOST = "[A-Za-z0-9-]"
#: base kinds in the order of the result
BASE = {
    "email": rf"{LOCAL}(?:(?<!{LOCAL}{LOCAL})|(?<=\G{LOCAL})){LOCAL}*+@{HOST}++(?:\.{HOST}++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: candidate kinds: pattern of the whole, and of the part in front that is not the span
CANDIDATES = {
    "secret": (r"(?i)(?<![A-Z0-9_])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|"
               r"private[_-]?key|auth)[ ]?[=:][ ]?[\"']?[A-Z0-9+/_.=-]{6,}+",
               r"(?i)^[a-z_-]+[ ]?[=:][ ]?[\"']?"),
    "api_id": (r"[A-Za-z0-9_-](?<![A-Za-z0-9_-]{2})(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{15,}+",
               None),
    "national_id": (r"[0-9](?<![0-9][0-9])(?<!-[0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])", None),
    "iban": (r"[A-Z](?<![A-Z0-9][A-Z])[A-Z][0-9]{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?"
             r"(?![A-Z0-9])", None),
    "local_phone": (r"[(0-9](?<![0-9+(.-][(0-9])(?<![0-9][ ][(0-9])[0-9]{2,3}\)?[ .-][0-9]{3}[ .-]"
                    r"[0-9]{4}(?![0-9])", None),
}
ORDER = [*BASE, *CANDIDATES]
#: fixed values: words before personal data, by kind
CUES = {
    "secret": ["password", "passwd", "pwd", "secret", "token", "key", "auth"],
    "api_id": ["key", "token", "secret", "bearer", "id"],
    "national_id": ["ssn", "social", "security", "id", "number"],
    "iban": ["iban", "account", "bank", "konto", "cuenta", "compte"],
    "local_phone": ["phone", "tel", "call", "fax", "mobile", "contact"],
}
#: fixed values: beginnings of well-known identifiers, and countries of account numbers
PREFIXES = ["AKIA", "ASIA", "ghp_", "gho_", "glpat-", "xoxb-", "xoxp-", "sk-", "sk_live_", "AIza",
            "eyJ"]
COUNTRIES = ["AT", "BE", "CH", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO",
             "PL", "PT", "SE"]
LABELERS = ["regex", "gazetteer", "context", "shape"]
CONTEXT = 24
#: characters that keys are written in
ALPHABET = 64
PENALTY = 1.0


def _found(text: Column, pattern: str) -> Column:
    """Matches in order: (gap since the last match, hit, text before), lengths in code points."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(
        F.length(g).cast("long").alias("gap"), h.alias("hit"),
        F.right(g, F.lit(CONTEXT)).alias("before")))
    return F.when(text.rlike(pattern), found)


def matches(docs: DataFrame) -> DataFrame:
    """One row per document: row, doc_id, digest, and an array of matches per kind (null: none)."""
    text = F.coalesce("text", F.lit(""))
    columns = []
    for kind in ORDER:
        found = _found(text, BASE[kind] if kind in BASE else CANDIDATES[kind][0])
        columns.append((F.when(text.contains("@"), found) if kind == "email" else found).alias(kind))
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id",
                       F.xxhash64("text").alias("digest"), *columns)


def _placed(found: DataFrame) -> DataFrame:
    """row, kind, start, end, hit, before of every match."""
    parts = [found.where(F.col(k).isNotNull()).select(
        "row", F.lit(k).alias("kind"), F.posexplode(k).alias("i", "m")) for k in ORDER]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    every = every.select("row", "kind", "i", "m.gap", "m.hit", "m.before").withColumn(
        "size", F.length("hit").cast("long"))
    upto = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(upto)
    return every.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(hit: Column) -> Column:
    digits = F.reverse(_digits(hit))
    doubled = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.when(
        i % 2 == 1, F.substr(digits, i, F.lit(1)).cast("int")).otherwise(
        F.substr(digits, i, F.lit(1)).cast("int") * 2 - F.when(
            F.substr(digits, i, F.lit(1)) >= "5", 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


def _base_holds() -> Column:
    def small(p):
        value = F.regexp_replace(p, "^0+", "")
        return (F.length(value) < 3) | ((F.length(value) == 3) & (value <= "255"))
    kind, n = F.col("kind"), F.length(_digits(F.col("hit")))
    return F.when(kind == "email", True).when(kind == "ip", F.forall(F.split("hit", r"\."), small)) \
        .when(kind == "card", _luhn(F.col("hit"))).when(
        kind == "phone", (n >= 8) & (n <= 15)).otherwise(False)


def _variety(value: Column) -> Column:
    """Distinct characters to length; long values are not blamed for a bounded alphabet."""
    return F.size(F.array_distinct(F.split(value, ""))) / F.least(F.length(value), F.lit(ALPHABET))


def _votes() -> dict[str, Column]:
    """-1, 0 (no opinion) or 1 of every labeler on a candidate."""
    kind, value, before = F.col("kind"), F.col("value"), F.lower(F.col("before"))
    letters, digits = value.rlike("[A-Za-z]"), value.rlike("[0-9]")
    strict = F.when(kind == "secret", F.when(letters & digits & (F.length(value) >= 8), 1).otherwise(-1)) \
        .when(kind == "api_id", F.when(value.rlike("^[0-9a-f]{32,64}$|^[0-9A-F-]{36}$"), 1)
              .when(~digits | value.rlike("^[a-z-]+[0-9]{0,4}$"), -1).otherwise(0)) \
        .when(kind == "national_id", F.when(value.rlike("^(?:000|666|9)|-00-|0000$"), -1).otherwise(1)) \
        .when(kind == "iban", F.when(F.length(F.regexp_replace(value, " ", "")).between(15, 34), 1)
              .otherwise(-1)) \
        .otherwise(F.when(value.rlike(r"^\(?[2-9]"), 1).otherwise(-1))
    known = F.substring(value, 1, 2).isin(*COUNTRIES)
    prefixed = value.rlike("^(?:" + "|".join(PREFIXES) + ")")
    gazetteer = F.when(kind == "iban", F.when(known, 1).otherwise(-1)).when(
        kind.isin("secret", "api_id"), F.when(prefixed, 1).otherwise(0)).otherwise(0)
    cue = F.lit(False)
    for k, words in CUES.items():
        cue = cue | ((kind == k) & before.rlike(r"\b(?:" + "|".join(words) + r")\b\W*$|^(?:"
                                                + "|".join(words) + r")\W+$"))
    context = F.when(kind == "secret", 1).when(cue, 1).when(kind == "api_id", -1).otherwise(0)
    variety = _variety(value)
    shape = F.when(variety < 0.15, -1).when((variety > 0.3) & digits, 1).otherwise(0)
    return dict(zip(LABELERS, (strict, gazetteer, context, shape)))


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[
        list[list[dict[int, float]]], list[float]]:
    """EM over (votes, count): per class and labeler the odds of each vote; the posteriors.

    Class 1 begins as the side that most votes favour.
    """
    belief = [1 / (1 + math.exp(-sum(v))) for v, _ in patterns]
    odds: list[list[dict[int, float]]] = []
    for _ in range(rounds):
        weights = [[(1 - b) * n for b, (_, n) in zip(belief, patterns)],
                   [b * n for b, (_, n) in zip(belief, patterns)]]
        total = [sum(w) + PENALTY for w in weights]
        odds = [[{x: (sum(w for w, (v, _) in zip(weights[c], patterns) if v[j] == x) + PENALTY / 3)
                  / total[c] for x in (-1, 0, 1)} for j in range(len(LABELERS))] for c in (0, 1)]
        prior = total[1] / (total[0] + total[1])
        new = []
        for v, _ in patterns:
            logit = math.log(prior / (1 - prior)) + sum(
                math.log(odds[1][j][x] / odds[0][j][x]) for j, x in enumerate(v))
            new.append(1 / (1 + math.exp(-max(-30.0, min(30.0, logit)))))
        if max((abs(a - b) for a, b in zip(belief, new)), default=0) < 1e-9:
            break
        belief = new
    return odds, belief


def _features() -> dict[str, Column]:
    """Span features for the classifier; few values each."""
    value, size = F.col("value"), F.length("value")
    return {
        "kind": F.col("kind"),
        "size": F.least(F.floor(F.log2(size.cast("double"))), F.lit(8)).cast("string"),
        "digits": F.floor(4 * F.length(_digits(value)) / size).cast("string"),
        "letters": F.concat(value.rlike("[a-z]").cast("string"), value.rlike("[A-Z]").cast("string")),
        "variety": F.floor(5 * _variety(value)).cast("string"),
        "votes": F.concat_ws(",", *[F.col(f"v_{n}").cast("string") for n in LABELERS]),
    }


def _accepted(candidates: DataFrame) -> DataFrame:
    """Candidates that the span classifier takes for personal data."""
    voted = stored(candidates.withColumns({f"v_{n}": c for n, c in _votes().items()}), "pii-votes")
    names = [f"v_{n}" for n in LABELERS]
    # at most 3 ** 4 patterns
    rows = voted.groupBy(*names).count().collect()
    patterns = [(tuple(r[n] for n in names), r["count"]) for r in rows]
    if not patterns:
        return candidates
    _, belief = estimate(patterns)
    spark = candidates.sparkSession
    posterior = spark.createDataFrame([(*v, b) for (v, _), b in zip(patterns, belief)],
                                      ", ".join(f"{n} int" for n in names) + ", belief double")
    features = _features()
    soft = voted.join(F.broadcast(posterior), names).withColumns(
        {f"f_{n}": c for n, c in features.items()})
    long = soft.select("belief", F.explode(F.array(*[F.concat(F.lit(f"{n}="), F.col(f"f_{n}"))
                                                     for n in features])).alias("feature"))
    # a few hundred feature values at most
    counts = long.groupBy("feature").agg(F.sum("belief").alias("yes"),
                                         F.sum(1 - F.col("belief")).alias("no")).collect()
    yes, no = sum(b * n for (_, n), b in zip(patterns, belief)), sum(
        (1 - b) * n for (_, n), b in zip(patterns, belief))
    weight = {r["feature"]: math.log((r["yes"] + PENALTY) / (yes + 2 * PENALTY))
              - math.log((r["no"] + PENALTY) / (no + 2 * PENALTY)) for r in counts}
    prior = math.log((yes + PENALTY) / (no + PENALTY))
    table = F.create_map(*[F.lit(x) for f, w in sorted(weight.items()) for x in (f, w)])
    score = F.lit(prior)
    for n in features:
        score = score + F.coalesce(table[F.concat(F.lit(f"{n}="), F.col(f"f_{n}"))], F.lit(0.0))
    return soft.where(score > 0)


def _overlapped(mine: Column, others: Column) -> Column:
    """Whether a row of ``mine`` overlaps one of ``others`` in the same text.

    Others come by their starts and ours by their ends, before an equal start: so the greatest
    end up to a row of ours tells.
    """
    upto = Window.partitionBy("row").orderBy(
        F.when(mine, F.col("end")).otherwise(F.col("start")), F.when(mine, 0).otherwise(1)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(others, F.col("end"))).over(upto)
    return mine & F.coalesce(reach > F.col("start"), F.lit(False))


def _settled(accepted: DataFrame) -> DataFrame:
    """Accepted candidates, kind by kind, without those that overlap a kept one of an earlier kind."""
    kinds = list(CANDIDATES)
    out = accepted.withColumn("gone", F.lit(False))
    for i, kind in enumerate(kinds[1:], 1):
        mine = F.col("kind") == kind
        out = out.withColumn("gone", F.col("gone") | _overlapped(
            mine, F.col("kind").isin(kinds[:i]) & ~F.col("gone")))
    return out.where(~F.col("gone")).drop("gone")


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, digest and spans (array of kind, start, end, base; in the order of kinds, then
    start) for every row of ``docs``."""
    found = stored(matches(docs), "pii-matches")
    placed = stored(_placed(found), "pii-places")
    base = placed.where(_base_holds()).select("row", "kind", "start", "end")

    lead = F.lit("")
    for kind, (_, front) in CANDIDATES.items():
        if front:
            lead = F.when(F.col("kind") == kind, F.regexp_extract("hit", front, 0)).otherwise(lead)
    loose = placed.where(F.col("kind").isin(*CANDIDATES)).withColumn("lead", lead).select(
        "row", "kind", (F.col("start") + F.length("lead")).alias("start"), "end",
        F.expr("substring(hit, length(lead) + 1)").alias("value"),
        F.concat("before", "lead").alias("before"))
    # a base span wins over a candidate, and an earlier kind over a later one once both are accepted
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(ORDER) for x in (k, i)])
    both = loose.withColumn("loose", F.lit(True)).unionByName(
        base.withColumn("loose", F.lit(False)), allowMissingColumns=True)
    free = both.withColumn("over", _overlapped(F.col("loose"), ~F.col("loose"))).where(
        F.col("loose") & ~F.col("over")).drop("loose", "over")
    added = _settled(_accepted(free).select("row", "kind", "start", "end"))
    spans = base.withColumn("base", F.lit(True)).union(added.withColumn("base", F.lit(False)))
    span = F.struct(rank[F.col("kind")].alias("rank"), "start", "end", "kind", "base")
    whole = spans.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    none = F.array().cast("array<struct<rank:int,start:bigint,end:bigint,kind:string,base:boolean>>")
    return found.select("row", "doc_id", "digest").join(whole, "row", "left").select(
        "doc_id", "digest", F.coalesce("spans", none).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def span_digests(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of base spans, base_sha256 and spans for every row of ``docs``."""
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")

    counts = [count(k).alias(f"n_{k}") for k in BASE]
    return find_spans(docs).select("doc_id", *counts,
                                   F.sha2(_joined(base), 256).alias("base_sha256"),
                                   _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with every span replaced by its kind, as in ``<EMAIL>``."""
    found = find_spans(docs).where(F.size("spans") > 0).groupBy(
        F.col("doc_id").alias("_pii_id"), F.col("digest").alias("_pii_digest")).agg(
        F.first("spans").alias("_spans"))
    ordered = F.array_sort(F.transform("_spans", lambda s: F.struct(s.start, s.end, s.kind)))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        inside = s.start < acc.at
        return F.struct(
            F.greatest(acc.at, s.end).alias("at"),
            F.when(inside, acc.out).otherwise(F.concat(
                acc.out, F.substr(F.col("text"), (acc.at + 1).cast("int"),
                                  (s.start - acc.at).cast("int")),
                F.lit("<"), F.upper(s.kind), F.lit(">"))).alias("out"))

    new = F.aggregate(ordered, start, step, lambda a: F.concat(
        a.out, F.substr(F.col("text"), (a.at + 1).cast("int"), F.lit((1 << 31) - 1))))
    joined = docs.join(found, same(docs["doc_id"], F.col("_pii_id"))
                       & (F.xxhash64(docs["text"]) == F.col("_pii_digest")), "left")
    changed = {"text": F.when(F.col("_spans").isNotNull(), new).otherwise(F.col("text"))}
    out = joined.withColumns(changed)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("_spans").isNotNull(), F.length("text").cast(kind))
                             .otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
