"""Merkle manifest of a dataset: a tree per source, a tree over sources, and a proof for every row.

H is the lowercase hex SHA-256 of its inputs joined.  A leaf is H of a row's fields, each ``-`` if null and otherwise its
UTF-8 byte count, ``:`` and the value.  ``ARITY`` consecutive nodes (the last run may have fewer, even one) become their H
until one node is left; a lone leaf is the root of its tree.

Checkpoint and recompute.  Of each tree only the leaves and every ``STEP``-th level are written.  A written node stands
for an aligned subtree of ``ARITY ** STEP`` written descendants.  Building reads them and writes the next kept level;
proof extraction reads them again, works out the levels between within one row, emits each descendant's siblings,
and keeps none of those nodes.  The path from a kept node to the root is found once per node, from the top down, and
shared by all leaves below it.

Order without a sort in one task.  Leaves (no texts) are dealt by range of group, order and leaf; a leaf's place is its
number within its part plus the counts of its group in the parts before.  A source with a third of all rows is spread over
parts; group keys of subtrees hold at most ``ARITY ** STEP`` rows.  What is broadcast or collected: one number, the
largest tree's size.

Awkward input.  Null ids come first in their source, equal ids are ordered by their leaf, repeated rows are leaves of
their own (with equal results if all their nodes are equal), null is a source of its own and comes first, an empty table
has no trees.  A row with null id is never tampered with.  Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertlift.sources.staging import stage

ARITY, STEP = 3, 4
SPAN = ARITY**STEP
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Powers of ARITY that a long can hold.
_POWERS = [ARITY**k for k in range(40) if ARITY**k < 1 << 63]


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """Leaf of a row of documents; ``changed`` names columns that differ from those of the table."""
    return digest(*[field(changed.get(f, F.col(f))) for f in FIELDS])


def height(n: Column) -> Column:
    """Levels above ``n`` leaves."""
    return sum(((n > p).cast("int") for p in _POWERS), F.lit(0))


def placed(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``idx``, the place of a row in its group, from 0, and ``n``, the size of its group; nulls come first.

    ``rows`` must be cheap to read twice (staged): dealing by range samples it.
    """
    if not group:
        rows = rows.withColumn("__all", F.lit(0))
    keys = list(group) or ["__all"]
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = [F.col(c).asc_nulls_first() for c in [*keys, *order]]
    dealt = stage(rows.repartitionByRange(parts, *by).withColumn("__part", F.spark_partition_id()))
    within = Window.partitionBy("__part", *keys).orderBy(*by)
    numbered = dealt.withColumn("__at", F.row_number().over(within).cast("long") - 1)
    counts = dealt.groupBy("__part", *keys).agg(F.count(F.lit(1)).alias("__n"))
    by_group = Window.partitionBy(*keys)
    before = by_group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("__part").alias("__p"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), F.sum("__n").over(by_group).alias("n"),
    )
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = numbered.join(starts, same).withColumn("idx", F.col("__at") + F.col("__start"))
    return joined.select(*[c for c in rows.columns if c != "__all"], "idx", "n")


def _climb(nodes: Column) -> Column:
    """The level above ``nodes``."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * ARITY + 1, F.lit(ARITY)), ""), 256))


def _subtrees(nodes: DataFrame, group: Sequence[str], done: int, *carried: str) -> DataFrame:
    """One row per aligned subtree over ``nodes`` (``group``, idx, n, h): its levels ``l0`` .. ``l{STEP}``, and ``up``,
    how many of them exist.  Nodes of trees that are complete at level ``done`` are left out."""
    left = height(F.col("n")) - done
    member = F.struct("idx", "h", *carried)
    found = (
        nodes.where(left > 0)
        .withColumns({"sub": F.floor(F.col("idx") / SPAN), "up": F.least(left, F.lit(STEP))})
        .groupBy(*group, "sub", "n", "up")
        .agg(F.array_sort(F.collect_list(member)).alias("members"))
        .withColumn("l0", F.transform("members", lambda m: m["h"]))
    )
    for k in range(STEP):
        found = found.withColumn(f"l{k + 1}", _climb(F.col(f"l{k}")))
    return found


@dataclass
class Tree:
    """Kept levels (``group``, idx, n, h), the leaves first, and the roots (``group``, n, h)."""

    group: list[str]
    kept: list[DataFrame]
    roots: DataFrame


def build(leaves: DataFrame, group: Sequence[str]) -> Tree:
    """Trees over placed leaves (``group``, idx, n, h and more)."""
    largest = leaves.agg(F.max("n")).first()[0] or 0
    deepest = sum(largest > p for p in _POWERS)
    kept = [leaves]
    for done in range(0, deepest, STEP):
        below = kept[-1].select(*group, "idx", "n", "h")
        top = F.element_at(F.array(*[F.col(f"l{k}") for k in range(1, STEP + 1)]), F.col("up"))
        above = _subtrees(below, group, done).select(*group, F.col("sub").alias("idx"), "n", F.get(top, F.lit(0)).alias("h"))
        kept.append(stage(above))
    # A tree of a given height is complete at the first kept level at or above it.
    ends = [
        level.where(F.ceil(height(F.col("n")) / STEP) == i).select(*group, "n", "h") for i, level in enumerate(kept)
    ]
    roots = ends[0]
    for end in ends[1:]:
        roots = roots.unionByName(end)
    return Tree(list(group), kept, stage(roots))


def _siblings() -> Column:
    """Per level of a subtree, the digests left and right of the way up from member ``j``."""
    steps = []
    for k in range(STEP):
        at = F.floor(F.col("j") / ARITY**k).cast("int")
        first = (F.floor(at / ARITY) * ARITY).cast("int")
        level = F.col(f"l{k}")
        steps.append(
            F.struct(
                F.array_join(F.slice(level, first + 1, at - first), "").alias("before"),
                F.array_join(F.slice(level, at + 2, first + ARITY - 1 - at), "").alias("after"),
            )
        )
    return F.slice(F.array(*steps), F.lit(1), F.col("up"))


_PATH = "array<struct<before:string,after:string>>"


def paths(tree: Tree, above: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Every leaf with ``carried``, ``h``, what ``above`` brings, and ``path``: its siblings from the leaf to the root.

    ``above``: ``group``, ``rest`` (the path from each tree's root onwards) and further columns.
    """
    extra = [c for c in above.columns if c not in (*tree.group, "rest")]
    keys = [F.col(g).alias(f"__g{i}") for i, g in enumerate(tree.group)]
    same_group = F.lit(True)
    for i, g in enumerate(tree.group):
        same_group = same_group & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    tops = above.select(*keys, "rest", *extra)
    known = None
    for i in reversed(range(len(tree.kept))):
        level, own = tree.kept[i], list(carried) if i == 0 else []
        # Roots at this level have no node above them in the tree.
        found = [
            level.where(F.ceil(height(F.col("n")) / STEP) == i)
            .join(tops, same_group)
            .select(*tree.group, "idx", "h", *own, *extra, F.col("rest").alias("path"))
        ]
        if known is not None:
            up = known.select(*keys, F.col("idx").alias("__sub"), *extra, F.col("path").alias("rest"))
            subs = _subtrees(level, tree.group, i * STEP, *own).join(up, same_group & (F.col("sub") == F.col("__sub")))
            each = subs.select(
                *tree.group, *[f"l{k}" for k in range(STEP)], "up", "rest", *extra, F.posexplode("members").alias("j", "m")
            )
            found.append(
                each.select(
                    *tree.group, F.col("m.idx").alias("idx"), F.col("m.h").alias("h"), *[F.col(f"m.{c}").alias(c) for c in own],
                    *extra, F.concat(_siblings(), "rest").alias("path"),
                )
            )
        known = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        if i:
            known = stage(known)
    return known


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda a, p: F.sha2(F.concat(p["before"], a, p["after"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), ""), 256)


def manifest(docs: DataFrame, **seen: Column) -> DataFrame:
    """Per row: doc_id, ``leaf``, ``subroot`` of its source, ``root``, ``path``, and the columns ``seen``, computed from
    the row while its text is read (a leaf of a copy to be verified, for example)."""
    columns = docs.select("doc_id", "source", leaf().alias("h"), *[c.alias(name) for name, c in seen.items()])
    leaves = stage(placed(stage(columns), ["source"], ["doc_id", "h"]))
    sources = build(leaves, ["source"])
    tops = stage(placed(stage(sources.roots.select("source", F.col("h"))), [], ["source"]))
    world = build(tops, [])
    root = world.roots.select(F.lit([]).cast(_PATH).alias("rest"), F.col("h").alias("root"))
    above = stage(paths(world, root, ["source"]).select("source", F.col("h").alias("subroot"), "root", F.col("path").alias("rest")))
    return paths(sources, above, ["doc_id", *seen]).withColumnRenamed("h", "leaf")


def tampered_leaf() -> Column:
    """Leaf of a row as a careless copy holds it: for even CRC-32 of the id, the text has lost its line feeds."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    return leaf(text=F.when(hit, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text")))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = manifest(docs, tampered=tampered_leaf()).withColumn("folded_root", fold(F.col("tampered"), F.col("path")))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _sql_levels(name: str, depth: int) -> str:
    """Levels and siblings of trees over the table ``name``0 (s, idx, n, h), as far as ``depth`` levels."""
    out = []
    for k in range(depth):
        lag = lambda f, i: f"coalesce({f}(h, {i}) over w, '')"
        out.append(
            f"{name}b{k} as materialized (select s, idx, {lag('lag', 2)} || {lag('lag', 1)} as l, {lag('lead', 1)} || {lag('lead', 2)} as r "
            f"from {name}{k} where n > {ARITY**k} window w as (partition by s, idx // {ARITY} order by idx)),\n"
            f"{name}{k + 1} as materialized (select s, idx // {ARITY} as idx, n, sha256(string_agg(h, '' order by idx)) as h "
            f"from {name}{k} where n > {ARITY**k} group by s, idx // {ARITY}, n)"
        )
    # The root of a tree is its only node at the level where it is complete.
    done = [f"select s, h from {name}{k} where n <= {ARITY**k}" + (f" and n > {ARITY ** (k - 1)}" if k else "") for k in range(depth + 1)]
    out.append(f"{name}top as materialized ({' union all '.join(done)})")
    return ",\n".join(out)


def _sql_paths(name: str, depth: int, keep: str) -> str:
    """``name``p{depth}: the rows of ``name``p0 (keep, s, idx, proof, folded) led to their roots."""
    out = []
    for k in range(depth):
        out.append(
            f"{name}p{k + 1} as materialized (select {keep}, p.s, p.idx // {ARITY} as idx, proof || coalesce(l || r, '') as proof, "
            f"case when b.s is null then folded else sha256(l || folded || r) end as folded "
            f"from {name}p{k} p left join {name}b{k} b on p.s = b.s and p.idx = b.idx)"
        )
    return ",\n".join(out)


def _sql_leaf(text: str) -> str:
    field_of = lambda v: f"coalesce(strlen(cast({v} as varchar)) || ':' || cast({v} as varchar), '-')"
    return "sha256(" + " || ".join(field_of(text if f == "text" else f) for f in FIELDS) + ")"


def oracle(leaf_levels: int = 13, source_levels: int = 8) -> str:
    """SQL for trees of at most so many levels.  The ids' CRC-32 is worked out bit by bit."""
    crc = (
        "list_reduce(list_prepend(4294967295, list_transform(range(strlen(cast(doc_id as varchar))), lambda i: "
        "cast(ascii(substr(cast(doc_id as varchar), cast(i as int) + 1, 1)) as bigint))), lambda c, b: "
        "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x // 2, (x % 2) * 3988292384)))"
    )
    return f"""
with leaves as materialized (select doc_id, source, {_sql_leaf("text")} as leaf,
  case when xor({crc}, 4294967295) % 2 = 0 then {_sql_leaf("replace(text, chr(10), '')")} else {_sql_leaf("text")} end as tampered
  from documents),
numbered as materialized (select *, coalesce('=' || source, '-') as s, leaf as h, count(*) over (partition by source) as n,
  row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as idx from leaves),
d0 as materialized (select s, idx, n, h from numbered),
{_sql_levels("d", leaf_levels)},
s0 as materialized (select 0 as s, source, row_number() over (order by source nulls first) - 1 as idx,
  count(*) over () as n, h from (select distinct source, s from numbered) join dtop using (s)),
{_sql_levels("s", source_levels)},
dp0 as materialized (select doc_id, source, leaf, s, idx, '' as proof, tampered as folded from numbered),
{_sql_paths("d", leaf_levels, "doc_id, source, leaf")},
sp0 as materialized (select doc_id, leaf, dtop.h as subroot, 0 as s, s0.idx, proof, folded
  from dp{leaf_levels} p join dtop on p.s = dtop.s join s0 on p.source is not distinct from s0.source),
{_sql_paths("s", source_levels, "doc_id, leaf, subroot")}
select doc_id, leaf, subroot, stop.h as root, sha256(proof) as proof_sha256, folded as folded_root, folded = stop.h as verified
from sp{source_levels} cross join stop
"""


ORACLE = oracle()
