"""Secrets in texts, told from widely copied examples by how many owners hold the same value.

Built-in functions only. Positions come from splitting a text at the matches of the same pattern: the pieces and the
matches alternate, so their lengths add up to the places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.storage import materialize

# Kinds in the order of ties, pattern, group of the value, least length of that group. A pattern for
# runs of one class may ask for the least length itself, as shorter runs hold no match.
KINDS = [
    (
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        1,
        12,
    ),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
#: What ownership adds: long tokens of letters and digits, reported only where few owners hold the value.
GENERIC = ("generic", r"[A-Za-z0-9+/_=-]{20,}", 0, 20)
#: A value held by more owners than this is a copied example, not a live credential.
MAX_OWNERS = 3
_BLOCK = 128


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(text: str, rank: int, kind: str, pattern: str, group: int, least: int) -> tuple[list[str], str]:
    """SQL for the pieces and matches of one pattern, then for its spans made from them.

    Places are sums over blocks of matches, then inside a block, so a text with very many matches costs each a block.
    """
    p, m, v, s, b = (f"hw_{x}_{kind}" for x in "pmvsb")
    pat = _quoted(pattern)
    hit = f"{text} rlike {pat}"
    first = [
        f"if({hit}, split({text}, {pat}, -1), array()) {p}",
        f"if({hit}, regexp_extract_all({text}, {pat}, 0), array()) {m}",
        f"if({hit}, regexp_extract_all({text}, {pat}, {group}), array()) {v}",
    ]
    steps = f"transform({m}, (x, i) -> length(x) + length({p}[i]))"
    sums = (
        f"transform(sequence(0, (size({m}) - 1) div {_BLOCK}), "
        f"k -> aggregate(slice({s}, {_BLOCK} * k + 1, {_BLOCK}), 0L, (a, x) -> a + x))"
    )
    before = (
        f"aggregate(slice({b}, 1, i div {_BLOCK}), 0L, (a, x) -> a + x) + "
        f"aggregate(slice({s}, {_BLOCK} * (i div {_BLOCK}) + 1, i % {_BLOCK}), 0L, (a, x) -> a + x) + length({p}[i])"
    )
    made = (
        f"filter(transform({m}, (x, i) -> named_struct('start', {before}, 'rank', {rank}, "
        f"'end', {before} + length(x), 'kind', '{kind}', 'value', {v}[i])), x -> length(x.value) >= {least})"
    )
    return [*first, f"{steps} {s}", f"if(size({m}) > 0, {sums}, array()) {b}"], made


def found_spans(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``base`` and ``extra``: arrays of ``(start, rank, end, kind, value)``, in code points, end exclusive.

    ``extra`` holds the generic tokens that have a letter and a digit and touch no base span.
    """
    made = {}
    for rank, (kind, pattern, group, least) in enumerate([*KINDS, GENERIC]):
        first, made[kind] = _spans(text, rank, kind, pattern, group, least)
        docs = docs.selectExpr("*", *first[:3])
        docs = docs.selectExpr("*", first[3])
        docs = docs.selectExpr("*", first[4])
    base = "concat(" + ", ".join(made[k] for k, *_ in KINDS) + ")"
    docs = docs.selectExpr("*", f"array_sort({base}) base", f"{made['generic']} generic")
    return docs.selectExpr(
        "*",
        """filter(generic, g -> g.value rlike '[0-9]' and g.value rlike '[A-Za-z]'
        and not exists(base, b -> b.start < g.end and g.start < b.end)) extra""",
    )


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"


def scan_secrets(
    docs: DataFrame, doc_id: Column, text: Column, repository: Column, owner: Column, max_owners: int = MAX_OWNERS
) -> DataFrame:
    """One row per document: its spans, and how many of them look live.

    ``n_assign``, ``n_access``, ``n_hex`` and ``base_sha256`` cover the base kinds, which always stay. ``spans`` adds generic
    tokens whose value at most ``max_owners`` owners hold. ``n_live`` counts the spans in ``spans`` whose value so few
    owners hold, ``n_example`` the others; ``most_repositories`` is the widest spread of a value in the text.

    Values are compared by SHA-256 digest. Counting is reduced on the map side first by (value, repository, owner), so a
    value copied into a third of all texts is a few rows per task. A null owner or repository counts as one of its own.
    Null and empty texts have no spans; repeated rows each get their row.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), doc_id.alias("doc_id"), text.alias("text"),
        F.coalesce(repository.cast("string"), F.lit("")).alias("repository"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
    )
    slim = (
        "transform({0}, x -> named_struct('start', x.start, 'rank', x.rank, 'end', x.end, 'kind', x.kind, "
        "'digest', sha2(x.value, 256)))"
    )
    found = found_spans(rows, "text").selectExpr(
        "row", "doc_id", "repository", "owner", f"{slim.format('base')} base", f"{slim.format('extra')} extra"
    )
    found = materialize(found, "secrets")  # also fixes the row numbers
    spans = found.select("row", "repository", "owner", F.explode(F.concat("base", "extra")).alias("span"))
    spans = spans.select("row", "repository", "owner", "span.*")
    holders = spans.groupBy("digest", "repository", "owner").agg(F.count(F.lit(1)).alias("n_spans"))
    spread = holders.groupBy("digest").agg(
        F.countDistinct("owner").alias("owners"), F.countDistinct("repository").alias("repositories")
    )
    judged = spans.join(spread, "digest").where((F.col("rank") < len(KINDS)) | (F.col("owners") <= max_owners))
    per_row = judged.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind"))).alias("kept"),
        F.count_if(F.col("owners") <= max_owners).alias("n_live"),
        F.count_if(F.col("owners") > max_owners).alias("n_example"),
        F.max("repositories").alias("most_repositories"),
    )
    counts = [f"bigint(size(filter(base, x -> x.kind = '{k}'))) n_{k}" for k, *_ in KINDS]
    return found.join(per_row, "row", "left").selectExpr(
        "doc_id",
        *counts,
        f"sha2({_joined('base')}, 256) base_sha256",
        f"coalesce({_joined('kept')}, '') spans",
        "coalesce(n_live, 0L) n_live",
        "coalesce(n_example, 0L) n_example",
        "coalesce(most_repositories, 0L) most_repositories",
    )
