"""Secret scans with corpus-wide ownership frequency, in column functions only.

Patterns find candidate spans in whole texts. Values of all kinds are hashed and counted over the corpus by
distinct owners and repositories: a value that several owners have is a copied example, one that a single
owner has looks live. Opaque tokens that no base pattern covers are reported only when they look live.

Positions come from the pieces between matches: a match starts after all pieces and matches before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlens.llm.scratch import stored
from hazardlens.operators.keys import with_lookup

#: Base kinds in their order: pattern, the group whose length counts, and its least length.
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # the runs of `[0-9a-f]+` that are long enough
]
#: A run that may be a credential without a name: long, with a digit and letters of both cases.
OPAQUE = ("opaque", r"[A-Za-z0-9_-]{24,}", 0, 24)
#: Values that so many owners have are copied examples.
EXAMPLE_OWNERS = 3
#: Sums are kept for every so many matches, so that texts with very many matches stay linear.
STEP = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _ends(sizes: Column) -> Column:
    """Running totals of an array of sizes."""
    zero = F.lit(0)
    total = lambda part: F.aggregate(part, zero, lambda a, x: a + x)
    blocks = F.transform(F.sequence(zero, F.floor((F.size(sizes) - 1) / STEP).cast("int")),
                         lambda b: total(F.slice(sizes, b * STEP + 1, F.lit(STEP))))
    sums = F.aggregate(blocks, F.array(zero), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
    return let(sums, lambda s: F.transform(sizes, lambda x, i: F.get(s, F.floor(i / STEP).cast("int")) + total(
        F.slice(sizes, F.floor(i / STEP).cast("int") * STEP + 1, i % STEP + 1))))


def spans(text: Column, kind: str, order: int, pattern: str, group: int, least: int) -> Column:
    """Leftmost matches, one after another, whose group is long enough: start, order, kind, end, value; code points."""
    kinds = "array<struct<start:int,order:int,kind:string,end:int,value:string>>"
    regex = F.lit(pattern)

    def of_matches(found: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        values = found if group == 0 else F.regexp_extract_all(text, regex, F.lit(group))
        return let(F.transform(F.arrays_zip(F.slice(pieces, F.lit(1), F.size(found)).alias("p"), found.alias("m")),
                               lambda x: F.length(x["p"]) + F.length(x["m"])),
                   lambda sizes: let(_ends(sizes), lambda ends: F.filter(F.transform(
                       F.arrays_zip(ends.alias("e"), found.alias("m"), values.alias("v")),
                       lambda x: F.struct((x["e"] - F.length(x["m"])).alias("start"), F.lit(order).alias("order"),
                                          F.lit(kind).alias("kind"), x["e"].alias("end"), x["v"].alias("value"))),
                       lambda x: F.length(x["value"]) >= least)))

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, regex, F.lit(0)), of_matches)).otherwise(
        F.array().cast(kinds)).cast(kinds)


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"),
                                                                 x["end"].cast("string"))), ",")


def candidates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", owner_column: str = "source",
               repository_columns: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """(id, text_key, owner, repository, base, opaque): the spans of every row. A null text is empty."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = documents.select(
        F.col(id_column).alias("id"), F.xxhash64(text).alias("text_key"), F.coalesce(owner_column, F.lit("")).alias("owner"),
        F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repository_columns)).alias("repository"),
        text.alias("text"))
    base = F.sort_array(F.concat(*(spans(F.col("text"), kind, k, pattern, group, least)
                                   for k, (kind, pattern, group, least) in enumerate(BASE))))
    opaque = F.filter(spans(F.col("text"), OPAQUE[0], len(BASE), *OPAQUE[1:]), lambda x: x["value"].rlike("[0-9]")
                      & x["value"].rlike("[a-z]") & x["value"].rlike("[A-Z]"))
    found = rows.select("id", "text_key", "owner", "repository", base.alias("base"), opaque.alias("loose"))
    outside = F.filter("loose", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return found.select("id", "text_key", "owner", "repository", "base", outside.alias("opaque"))


def ownership(found: DataFrame) -> DataFrame:
    """(value_hash, n_owners, n_repositories) of every candidate value; groups shrink before each shuffle."""
    values = found.select("owner", "repository", F.explode(F.concat("base", "opaque")).alias("s"))
    by_owner = (values.groupBy(F.sha2("s.value", 256).alias("value_hash"), "owner", "repository").agg(F.count("*").alias("n"))
                .groupBy("value_hash", "owner").agg(F.count("*").alias("repositories")))
    return by_owner.groupBy("value_hash").agg(F.count("*").alias("n_owners"),
                                              F.sum("repositories").alias("n_repositories"))


def secret_scan(documents: DataFrame, example_owners: int = EXAMPLE_OWNERS, **options) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_examples) of every row.

    ``spans`` holds the base spans and, as kind ``opaque``, the loose tokens that one owner alone has.
    ``n_live`` counts spans of values with one owner, ``n_examples`` those with ``example_owners`` or more. Rows
    that repeat id, text and owner are alike. Null owners and repositories are one, the empty one.
    """
    found = stored(candidates(documents, **options), "secret-candidates")
    some = (found.where((F.size("base") > 0) | (F.size("opaque") > 0))
            .select("id", "text_key", "base", "opaque").distinct())
    each = some.select("id", "text_key", F.explode(F.concat("base", "opaque")).alias("s")).withColumn(
        "value_hash", F.sha2("s.value", 256))
    owners = stored(ownership(found), "secret-owners")
    owned = with_lookup(each, owners, "value_hash").groupBy("id", "text_key").agg(
        F.count(F.when(F.col("n_owners") == 1, 1)).alias("n_live"),
        F.count(F.when(F.col("n_owners") >= example_owners, 1)).alias("n_examples"),
        F.collect_list(F.when((F.col("s.kind") == OPAQUE[0]) & (F.col("n_owners") == 1), F.col("s"))).alias("added"))
    owned = owned.select(F.col("id").alias("owned_id"), F.col("text_key").alias("owned_key"), "n_live", "n_examples", "added")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.join(owned, F.col("id").eqNullSafe(F.col("owned_id")) & (F.col("text_key") == F.col("owned_key")), "left").select(
        "id", *(count(kind) for kind, *_ in BASE), F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.sort_array(F.concat("base", F.coalesce("added", F.array().cast(found.schema["base"].dataType))))).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_examples", F.lit(0)).alias("n_examples"))
