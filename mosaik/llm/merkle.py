r"""A Merkle manifest of a table: every row is a leaf, every group of rows a tree, the groups' roots a tree in turn.

H is the SHA-256 of its inputs one after the other, as lowercase hex; digests enter as hex text. A leaf is H of the
columns of a row, each `-` if null, else its UTF-8 byte count, `:` and the value. In a group leaves ascend by the order
column; while a tree has several nodes, each run of ARITY = 16 consecutive ones (the last may be shorter, even one node)
becomes their H. A proof of a leaf is the other nodes of the runs on its way to the root.

Fractal traversal. A group is cut into aligned blocks of 16 ** HEIGHT leaves. For each level of a block one existing
subtree, the run that the current leaf is under, and one desired subtree, the run after it, are kept. Each leaf passed
gives the authentication path from the existing ones, and each desired one takes one leaf more by a stack of partly
filled runs; when an existing subtree is passed, the desired one takes its place. So no more than 2 * HEIGHT runs and
their stacks are held, whatever the number of leaves, and the work for each leaf is the same. Above the blocks
there is one node for 4,096 leaves: those levels are aggregations of 16 rows each, their proofs are built from the top
down by joins, and each block gets its one upper proof by a join before it is traversed.

Leaves are dealt by ranges of (group, order, leaf, number of the row), so a group of a third of all rows and rows that
repeat any number of times spread over all tasks.

Defined results: rows of one group and order value are ordered by their leaves; a null order value comes first. A null
group is one group, the first; an empty name another. Groups of one leaf have that leaf as root and nothing to prove
below it. A proof without siblings is H of nothing. Extra columns are ignored. No rows: an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import joined
from .storage import dropped, written

ARITY = 16
#: Levels of a block, which has ARITY ** HEIGHT leaves.
HEIGHT = 3
BLOCK = ARITY**HEIGHT
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


# --- one block ----------------------------------------------------------------------------------------


def combined(run: Sequence[bytes]) -> bytes:
    """H of a run of digests, all as hex text."""
    return hashlib.sha256(b"".join(run)).hexdigest().encode()


class Subtree:
    """A run of nodes at some level above the leaves, grown leaf by leaf with a stack of partly filled runs."""

    def __init__(self, level: int):
        self.stack: list[list[bytes]] = [[] for _ in range(level + 1)]

    def take(self, node: bytes) -> None:
        for run in self.stack[:-1]:
            run.append(node)
            if len(run) < ARITY:
                return
            node = combined(run)
            run.clear()
        self.stack[-1].append(node)

    def closed(self) -> list[bytes]:
        """The run, after the last leaf under it."""
        for low, high in zip(self.stack, self.stack[1:], strict=False):
            if low:
                high.append(combined(low))
                low.clear()
        return self.stack[-1]


def height(leaves: int, block: int) -> int:
    """Levels within a block: those after the first belong to a larger tree and have all HEIGHT."""
    return HEIGHT if block else next(h for h in range(HEIGHT + 1) if ARITY**h >= leaves)


def root(leaves: Sequence[bytes], levels: int) -> bytes:
    tree = Subtree(levels)
    for leaf in leaves:
        tree.take(leaf)
    return tree.closed()[0]


def traversal(leaves: Sequence[bytes], levels: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """For each leaf in turn, level by level, its place in its run and the run."""
    spans = [ARITY ** (level + 1) for level in range(levels)]
    desired = [Subtree(level) for level in range(levels)]
    for tree, span in zip(desired, spans, strict=True):
        for leaf in leaves[:span]:
            tree.take(leaf)
    existing = [tree.closed() for tree in desired]
    desired = [Subtree(level) for level in range(levels)]
    for i in range(len(leaves)):
        yield [(i * ARITY // span % ARITY, run) for span, run in zip(spans, existing, strict=True)]
        for level, span in enumerate(spans):
            if i + span < len(leaves):
                desired[level].take(leaves[i + span])
            if (i + 1) % span == 0:
                existing[level] = desired[level].closed()
                desired[level] = Subtree(level)


# --- tables -------------------------------------------------------------------------------------------


def leaf_of(columns: Sequence[Column]) -> Column:
    """H of the values of columns."""
    parts = []
    for c in columns:
        value = c.cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _numbered(df: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """df with i, gapless from 0 within each group (not null), and n, the rows of the group; no two rows are alike in group and order.

    The ranges are written, since a second evaluation may cut them elsewhere."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    placed = written(ranged.withColumn("place", F.monotonically_increasing_id()), name)  # partition * 2 ** 33 + row in it
    part = F.shiftright("place", 33)
    sums = placed.groupBy(F.col(group).alias("of"), part.alias("part")).agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy("of")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("of", "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(whole).alias("n"))
    met = placed.join(offsets, (F.col(group) == F.col("of")) & (part == F.col("part")))
    return met.select(*[c for c in placed.columns if c != "place"], (F.col("place") + F.col("shift")).alias("i"), "n")


def _climbed(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trees of nodes (k, i, n: nodes of k, d: digest), a written table: (k, top) and (k, i, path), the path an array of
    (place in the run, run) from a node up to the root of its tree; nodes that are their tree have no path."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels = next(h for h in range(64) if ARITY**h >= most)
    tops, runs, now = nodes.filter("n = 1").select("k", F.col("d").alias("top")), [], nodes.filter("n > 1")
    for level in range(levels):
        ordered = F.array_sort(F.collect_list(F.struct("i", "d")))  # ARITY entries
        run = now.groupBy("k", "n", F.expr(f"i div {ARITY}").alias("up")).agg(F.transform(ordered, lambda x: x["d"]).alias("run"))
        run = written(run.withColumn("d", F.sha2(F.concat_ws("", "run").cast("binary"), 256)), "runs")
        runs.append(run)
        done = F.col("n") <= ARITY ** (level + 1)
        tops = tops.unionAll(run.filter(done).select("k", F.col("d").alias("top")))
        now = run.filter(~done).select("k", F.col("up").alias("i"), "n", "d")
    paths = None
    for run in reversed(runs):
        each = run.select("k", "up", "run", F.posexplode("run").alias("at", "d")).select("k", "up", (F.col("up") * ARITY + F.col("at")).alias("i"), F.struct("at", "run").alias("step"))
        if paths is None:
            paths = each.select("k", "i", F.array("step").alias("path"))
            continue
        above = paths.select(F.col("k").alias("ak"), F.col("i").alias("ai"), F.col("path").alias("rest"))
        met = each.join(above, (F.col("k") == F.col("ak")) & (F.col("up") == F.col("ai")), "left")
        paths = met.select("k", "i", F.when(F.col("rest").isNull(), F.array("step")).otherwise(F.concat(F.array("step"), "rest")).alias("path"))
    if paths is None:
        paths = nodes.filter("false").select("k", "i", F.array(F.struct(F.lit(0).alias("at"), F.array("d").alias("run"))).alias("path"))
    return tops, paths


def _roots(batches):
    """The root of each block."""
    for b in batches:
        found = []
        for block, leaves in zip(b.column("block").to_pylist(), b.column("leaves"), strict=True):
            hexed = [x.hex().encode() for x in leaves.values.field("leaf").to_pylist()]
            found.append(root(hexed, height(len(hexed), block)).decode())
        yield pa.RecordBatch.from_arrays([b.column("k"), b.column("block"), b.column("blocks"), pa.array(found, pa.string())], ["k", "i", "n", "d"])


_PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proved(batches):
    """Blocks and their upper proofs to a row for each leaf."""
    kind = pa.schema([("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())])
    for b in batches:
        for j in range(b.num_rows):
            entries = b.column("leaves")[j].values
            leaves = [x.hex().encode() for x in entries.field("leaf").to_pylist()]
            seen = [x and x.hex().encode() for x in entries.field("other").to_pylist()]
            subroot, top = b.column("subroot")[j].as_py(), b.column("root")[j].as_py()
            upper = []
            for step in b.column("path")[j].as_py():
                run = [x.encode() for x in step["run"]]
                upper.append((b"".join(run[: step["at"]]), b"".join(run[step["at"] + 1 :])))
            above = b"".join(x + y for x, y in upper)
            proofs, folded = [], []
            steps = traversal(leaves, height(len(leaves), b.column("block")[j].as_py()))
            for leaf, other, path in zip(leaves, seen, steps, strict=True):
                proof, node = hashlib.sha256(), other or leaf
                for at, run in path:
                    low, high = b"".join(run[:at]), b"".join(run[at + 1 :])
                    proof.update(low + high)
                    node = hashlib.sha256(low + node + high).hexdigest().encode()
                proof.update(above)
                for low, high in upper:
                    node = hashlib.sha256(low + node + high).hexdigest().encode()
                proofs.append(proof.hexdigest())
                folded.append(node.decode())
            n = len(leaves)
            yield pa.RecordBatch.from_arrays(
                [entries.field("doc_id"), pa.array([x.decode() for x in leaves]), pa.array([subroot] * n), pa.array([top] * n), pa.array(proofs), pa.array(folded), pa.array([x == top for x in folded])], schema=kind
            )


def audited(docs: DataFrame, changed: Column | None = None, seen: dict[str, Column] | None = None, columns: Sequence[str] = COLUMNS, group: str = "source", order: str = "doc_id") -> DataFrame:
    """The manifest of docs with a row for each of its rows: doc_id (the order column, long), leaf, root of the group, root, H of the
    siblings of its proof, and the root that the proof leads to from the row as it is seen.

    Rows where changed holds are seen with the columns of seen in place of their own; all others as they are."""
    own = [docs[c] for c in columns]
    other = [(seen or {}).get(c, docs[c]) for c in columns]
    key = F.when(docs[group].isNull(), "").otherwise(F.concat(F.lit("="), docs[group].cast("string")))
    differs = F.coalesce(changed, F.lit(False)) if changed is not None else F.lit(False)
    leaves = docs.select(
        key.alias("k"),
        docs[order].cast("long").alias("doc_id"),
        F.unhex(leaf_of(own)).alias("leaf"),
        F.when(differs, F.unhex(leaf_of(other))).alias("other"),
        F.monotonically_increasing_id().alias("row"),
    )
    leaves = written(leaves, "leaves")
    numbered = _numbered(leaves, "k", ["doc_id", "leaf", "row"], "placed")
    entry = F.array_sort(F.collect_list(F.struct("i", "doc_id", "leaf", "other")))  # BLOCK entries
    whole = F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks")
    blocks = written(numbered.groupBy("k", whole, F.expr(f"i div {BLOCK}").alias("block")).agg(entry.alias("leaves")), "blocks")
    dropped(leaves)
    nodes = written(blocks.mapInArrow(_roots, "k string, i long, n long, d string"), "nodes")
    tops, paths = _climbed(nodes)
    groups = written(_numbered(tops.withColumn("all", F.lit("")), "all", ["k"], "groups").select(F.col("all").alias("k"), "i", "n", F.col("top").alias("d"), F.col("k").alias("name")), "groups")
    last, upper = _climbed(groups.drop("name"))
    upper = upper.select(F.col("i").alias("ui"), F.col("path").alias("up"))
    named = groups.join(upper, F.col("i") == F.col("ui"), "left").select(F.col("name").alias("gk"), F.col("d").alias("subroot"), "up")
    ends = joined(nodes.select("k", "i"), named, "k", "gk", F.col("i"))
    own_path = paths.select(F.col("k").alias("pk"), F.col("i").alias("pi"), "path")
    none = F.expr("cast(array() as array<struct<at: int, run: array<string>>>)")
    proofs = ends.join(own_path, (F.col("k") == F.col("pk")) & (F.col("i") == F.col("pi")), "left")
    proofs = proofs.select(F.col("k").alias("bk"), F.col("i").alias("bi"), "subroot", F.concat(F.coalesce("path", none), F.coalesce("up", none)).alias("path"))
    met = blocks.join(proofs, (F.col("k") == F.col("bk")) & (F.col("block") == F.col("bi")))
    top = last.first()  # one digest
    return met.select("block", "leaves", "subroot", "path", F.lit(top and top["top"]).alias("root")).mapInArrow(_proved, _PROVED)


_UP = "".join(map(chr, range(65, 91)))


def lower_cased(docs: DataFrame) -> DataFrame:
    """audited(docs), where the texts of rows whose CRC-32 of the decimal doc_id divides by five are seen with A-Z in lower case."""
    hit = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0
    return audited(docs, hit & docs["text"].isNotNull(), {"text": F.translate(docs["text"].cast("string"), _UP, _UP.lower())})


# --- the same in SQL --------------------------------------------------------------------------------------


def _leaf_sql(text: str = "text") -> str:
    columns = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
    return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in columns) + ")"


def _crc32_sql(text: str) -> str:
    """The CRC-32 of an ASCII text, bit by bit; 3988292384 is the polynomial."""
    byte = "list_reduce(list_prepend(xor(a, x), range(8)), lambda c, b: xor(c >> 1, 3988292384 * (c & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, x: {byte}), 4294967295)"


def _tree_sql(name: str, leaves: str) -> str:
    """CTEs of the trees over leaves (k, i, d): nodes by level, tops with heights, and what stands before and after each node in its run."""
    return f"""{name}_n AS (SELECT k, 0 AS lv, i, d FROM {leaves} UNION ALL
SELECT k, lv + 1, i // 16, sha256(string_agg(d, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM {name}_n) WHERE n > 1 GROUP BY k, lv, i // 16),
{name}_t AS (SELECT k, max(lv) AS h, arg_max(d, lv) AS top FROM {name}_n GROUP BY k),
{name}_s AS (SELECT a.k, a.lv, a.i, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS lo, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS hi
FROM {name}_n a JOIN {name}_t t ON a.k = t.k AND a.lv < h JOIN {name}_n b ON a.k = b.k AND a.lv = b.lv AND a.i // 16 = b.i // 16 GROUP BY ALL)"""


_LOWER = f"translate(text, '{_UP}', '{_UP.lower()}')"
SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || source, '') AS k, {_leaf_sql()} AS d,
CASE WHEN {_crc32_sql('CAST(doc_id AS VARCHAR)')} % 5 = 0 AND text IS NOT NULL THEN {_leaf_sql(_LOWER)} ELSE {_leaf_sql()} END AS e FROM documents),
a AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, d) - 1 AS i FROM d),
{_tree_sql('l', 'a')},
g AS (SELECT '' AS k, k AS name, top AS d, row_number() OVER (ORDER BY k) - 1 AS i FROM l_t),
{_tree_sql('u', 'g')},
w AS (SELECT a.i, a.k, s.lv, s.lo, s.hi FROM a JOIN l_s s ON s.k = a.k AND s.i = a.i // (16 ** s.lv)::BIGINT UNION ALL
SELECT a.i, a.k, t.h + s.lv, s.lo, s.hi FROM a JOIN l_t t USING (k) JOIN g ON g.name = a.k JOIN u_s s ON s.i = g.i // (16 ** s.lv)::BIGINT),
p AS (SELECT k, i, list([lo, hi] ORDER BY lv) AS steps FROM w GROUP BY ALL),
f AS (SELECT doc_id, a.d AS leaf, l_t.top AS subroot, (SELECT top FROM u_t) AS root, coalesce(steps, []) AS steps, e FROM a JOIN l_t USING (k) LEFT JOIN p USING (k, i)),
o AS (SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(flatten(steps), ''), '')) AS proof_sha256,
list_reduce(list_prepend([e], steps), lambda x, s: [sha256(s[1] || x[1] || s[2])])[1] AS folded_root FROM f)
SELECT *, folded_root = root AS verified FROM o"""
