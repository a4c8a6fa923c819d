"""Secret scans: single patterns, and credentials linked from their parts.

Patterns give the lengths of matches and of the gaps between them inside the
row, and only those lengths leave it; running sums per document turn them into
positions.  Parts that mean nothing alone are weak: a bare key, a login, an
endpoint.  They are interval-joined with the other parts of a credential within
a scope of SCOPE characters to either side, by bins of the text, so that no pair
of parts is made twice and a document full of parts stays linear; semi-joins
make no pairs at all.  A bare key needs an identifier, a login needs a secret,
an endpoint needs both.

Defined results: a null text has no spans; a document's spans depend on its own
text alone, so repeated rows and ties get equal results; extra columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanledger.llm.common import stage, text_or_empty

#: Characters to either side of a weak part in which the others must lie.
SCOPE = 200
BIN = 512


def either_case(pattern: str) -> str:
    """The pattern with each ASCII letter in either case, and no other letter that folds to it."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in pattern)


@dataclass(frozen=True)
class Part:
    """A kind of span: its pattern, and what a match must have (a least length of a group, characters)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    holds: tuple[str, ...] = ()


NAME = either_case("(password|passwd|secret|token|api_?key)")
LOGIN = either_case("(access_?key_?id|client_?id|user_?name|user_?id|login)")
SCHEME = either_case("(https|http|ftp|postgresql|postgres|mysql|mongodb|redis|amqp|jdbc|s3)")
IS = r"""["']?\x20*[:=]\x20*["']?"""

#: In order of kind.  The base kinds hold by themselves; of runs that a least length is asked of, a
#: shorter run holds no longer match, so the length is part of the pattern.
BASE = (
    Part("assign", NAME + IS + "([A-Za-z0-9+/_.=-]+)", 2, 6),
    Part("access", "AKIA[A-Z0-9]{16,}"),
    Part("hex", "[0-9a-f]{24,}"),
)
WEAK = (
    Part("key", "[A-Za-z0-9+/]{40,}", holds=("[A-Z]", "[a-z]", "[0-9]")),
    Part("login", LOGIN + IS + "([A-Za-z0-9._@+-]+)", 2, 4),
    Part("endpoint", SCHEME + r"""://[^\x20\x09-\x0D"'<>]+"""),
)
PARTS = BASE + WEAK
IDENTIFIERS, SECRETS = ("access", "login"), ("assign", "hex", "key")


def lengths(text: Column, part: Part) -> Column:
    """For each gap of the text the lengths of it and of the match that follows, null if there is none."""
    found = F.regexp_extract_all(text, F.lit(part.pattern), F.lit(0))
    good = F.transform(found, lambda m: F.lit(True))
    if part.least:
        held = F.regexp_extract_all(text, F.lit(part.pattern), F.lit(part.group))
        good = F.transform(held, lambda m: F.length(m) >= part.least)
    if part.holds:
        good = F.transform(found, lambda m: reduce(and_, [m.rlike(p) for p in part.holds]))
    zipped = F.arrays_zip(
        F.transform(F.split(text, part.pattern, -1), F.length).alias("gap"),
        F.transform(found, F.length).alias("size"),
        good.alias("good"),
    )
    return F.when(text.rlike(part.pattern), zipped)


def spans(rows: DataFrame) -> DataFrame:
    """(row, kind, start, end) of ``rows`` (row and a column of lengths for each kind), what fails dropped."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(p.kind).alias("found")) for k, p in enumerate(PARTS)]))
    some = rows.where(" or ".join(f"{p.kind} is not null" for p in PARTS))
    pieces = (
        some.select("row", each.alias("of"))
        .where("of.found is not null")
        .select("row", F.col("of.kind").alias("kind"), F.posexplode("of.found").alias("n", "piece"))
        .select("row", "kind", "n", "piece.*")
    )
    upto = Window.partitionBy("row", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(upto)
    return (
        pieces.withColumn("end", end)
        .where("good")
        .select("row", "kind", (F.col("end") - F.col("size")).alias("start"), "end")
    )


def _binned(parts: DataFrame, reach: int) -> DataFrame:
    bins = F.sequence(
        F.floor(F.greatest(F.col("start") - reach, F.lit(0)) / BIN), F.floor((F.col("end") + reach) / BIN)
    )
    return parts.withColumn("bin", F.explode(bins))


def _kinds(*names: str) -> list[int]:
    return [k for k, p in enumerate(PARTS) if p.kind in names]


def _near(weak: DataFrame, others: DataFrame) -> DataFrame:
    """Those of ``weak`` that have one of ``others`` within their scope."""
    a, b = _binned(weak, SCOPE).alias("a"), _binned(others, 0).alias("b")
    meet = (
        (F.col("a.row") == F.col("b.row"))
        & (F.col("a.bin") == F.col("b.bin"))
        & (F.col("b.start") < F.col("a.end") + SCOPE)
        & (F.col("b.end") > F.col("a.start") - SCOPE)
    )
    return a.join(b, meet, "left_semi").select("row", "kind", "start", "end").distinct()


def linked(parts: DataFrame) -> DataFrame:
    """Weak parts of the staged ``parts`` whose complements co-occur and that no base span covers."""
    base = parts.where(F.col("kind") < len(BASE))
    a, b = parts.where(F.col("kind") >= len(BASE)).alias("a"), _binned(base, 0).alias("b")
    inside = (
        (F.col("a.row") == F.col("b.row"))
        & (F.floor(F.col("a.start") / BIN) == F.col("b.bin"))
        & (F.col("b.start") <= F.col("a.start"))
        & (F.col("b.end") >= F.col("a.end"))
    )
    weak = stage(a.join(b, inside, "left_anti"), "weak")
    every = base.unionByName(weak)
    identifiers = every.where(F.col("kind").isin(_kinds(*IDENTIFIERS)))
    secrets = every.where(F.col("kind").isin(_kinds(*SECRETS)))

    def of(kind: str) -> DataFrame:
        return weak.where(F.col("kind").isin(_kinds(kind)))

    return (
        _near(of("key"), identifiers)
        .union(_near(of("login"), secrets))
        .union(_near(_near(of("endpoint"), identifiers), secrets))
    )


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document."""
    text = text_or_empty()
    rows = stage(
        docs.select(
            "doc_id", F.monotonically_increasing_id().alias("row"), *[lengths(text, p).alias(p.kind) for p in PARTS]
        ),
        "matches",
    )
    parts = stage(spans(rows), "parts")
    base = F.col("kind") < len(BASE)
    names = F.array(*[F.lit(p.kind) for p in PARTS])
    shown = F.struct("start", "kind", F.concat_ws(":", F.get(names, F.col("kind")), "start", "end").alias("span"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(spans), lambda s: s["span"]), ",")

    found = (
        parts.where(base)
        .union(linked(parts))
        .groupBy(F.col("row").alias("of"))
        .agg(
            *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{p.kind}") for k, p in enumerate(BASE)],
            joined(F.collect_list(F.when(base, shown))).alias("base"),
            joined(F.collect_list(shown)).alias("spans"),
        )
    )
    return rows.select("doc_id", "row").join(found, F.col("row") == F.col("of"), "left").select(
        "doc_id",
        *[F.coalesce(f"n_{p.kind}", F.lit(0)).cast("long").alias(f"n_{p.kind}") for p in BASE],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def oracle() -> str:
    """The same in DuckDB: every pair of a document's parts is looked at."""
    def match(part: Part) -> str:
        pattern = part.pattern.replace("'", "''")
        return f"""
          select row, {PARTS.index(part)} as kind,
                 unnest(range(len(regexp_extract_all(text, '{pattern}')))) as n,
                 len(unnest(string_split_regex(text, '{pattern}')[:-2])) as gap,
                 unnest(regexp_extract_all(text, '{pattern}')) as m,
                 unnest(regexp_extract_all(text, '{pattern}', {part.group})) as g
          from docs where regexp_matches(text, '{pattern}')"""

    cases = " ".join(
        f"when {k} then " + (" and ".join(
            ([f"len(g) >= {p.least}"] if p.least else []) + [f"regexp_matches(m, '{h}')" for h in p.holds]
        ) or "true")
        for k, p in enumerate(PARTS)
    )
    names = ", ".join(f"'{p.kind}'" for p in PARTS)

    def near(kinds: tuple[str, ...]) -> str:
        return f"""exists (from weakened b where b.row = a.row and b.kind in {tuple(_kinds(*kinds))}
                           and b."start" < a."end" + {SCOPE} and b."end" > a."start" - {SCOPE})"""

    key, login, endpoint = (_kinds(p.kind)[0] for p in WEAK)
    return f"""
      with docs as (
        select row_number() over () as row, doc_id, coalesce(text, '') as text from documents
      ), matches as ({" union all ".join(map(match, PARTS))}
      ), placed as (
        select *, sum(gap + len(m)) over (partition by row, kind order by n)::bigint as "end" from matches
      ), parts as (
        select row, kind, "end" - len(m) as "start", "end" from placed
        where case kind {cases} end
      ), weakened as (
        from parts a where kind < {len(BASE)} or not exists (
          from parts b where b.row = a.row and b.kind < {len(BASE)}
            and b."start" <= a."start" and b."end" >= a."end")
      ), reported as (
        select *, ([{names}])[kind + 1] || ':' || "start" || ':' || "end" as span from weakened a
        where kind < {len(BASE)}
           or kind = {key} and {near(IDENTIFIERS)}
           or kind = {login} and {near(SECRETS)}
           or kind = {endpoint} and {near(IDENTIFIERS)} and {near(SECRETS)}
      )
      select doc_id,
             count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access,
             count(*) filter (kind = 2) as n_hex,
             sha256(coalesce(string_agg(span, ',' order by "start", kind) filter (kind < {len(BASE)}), '')) as base_sha256,
             coalesce(string_agg(span, ',' order by "start", kind), '') as spans
      from docs left join reported using (row) group by row, doc_id
    """
