r"""Mixing sources to target weights, with DataFrame functions only.

Targets. Sources in code point order, null last, weigh 5, 2, 1 and so on again, and share all words; a
target stops at CAP times its source's words and the excess is shared again by weight. That is
min(CAP * size, level * weight) with one level for all, which is found from running sums over sources.

Blocks. The words of a source, document after document in the order of a hash of doc_id, are packed into
blocks of BLOCK words; the last one is shorter. The quota of a source is the number of blocks that comes
nearest to its target: whole rounds over its blocks, and a part of one more.

Shards. The mix has as many slots as all quotas together, SHARD_BLOCKS to an output shard. Each slot draws
a source by itself, with the quotas as weights, from a hash of its number; so the counts of sources in
a shard are a multinomial draw, and shards are independent. The draws of a source are numbered. Over all slots
a source is drawn a few times more or less than its quota (a standard deviation, some square root of
it): the draws beyond quotas, which are scattered over all shards, go to the sources that are short, one
by one. So each total meets its target, no block is drawn more than CAP times, and of a shard with n slots
only some n / sqrt(all slots) are not as they were drawn.

Blocks of slots. Draw number i of a source belongs to round i div blocks, and takes the block at the place of
i mod blocks in a pseudorandom permutation that source, round and seed choose: ROUNDS steps of swap-or-not
(Hoang, Morris and Rogaway, 2012), each a bijection of any number of blocks. Slots and blocks meet by
(source, block index), so a source with a third of all words is dealt to as many tasks as its blocks are.

Defined results: a null text has no words; a source without words gets the target 0; null is a source,
apart from the empty string. Reruns draw the same blocks, for the same seed. Rows alike in doc_id and size
are taken in any order. taken() ignores extra columns; packed() and mixed() keep what they say. An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import running_sum, sums_before
from .quality import SPACES
from .storage import dropped, written

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK = 64
SHARD_BLOCKS = 1024
#: Steps of a permutation of blocks.
ROUNDS = 24
#: Rows of the table of sources up to which it is broadcast and put in order by one task; beyond, it is joined by a shuffle and cut into ranges.
MOST_SOURCES_SENT = 10_000
#: Cells of slots' draws, each with the sources that it may be.
CELLS = 4096


def n_words(text: Column) -> Column:
    r"""Number of [^\x20\x09-\x0D]+ in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _few(sizes: DataFrame) -> bool:
    return sizes.count() <= MOST_SOURCES_SENT


def targets(sizes: DataFrame, small: bool) -> DataFrame:
    """sizes (source, source_size) with target (double). One row for each source; small: there are few."""
    ranked = sums_before(sizes, _by_source(), {"rank": F.lit(1)}, small)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    w = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(CAP)))
    if not small:
        w = written(w, "weights")
    size, weights = (x or 0 for x in w.agg(F.sum("source_size"), F.sum("weight")).first())
    # Sources reach their caps in the order of cap / weight; the level is set by the first that stays below.
    turn = F.col("cap") / F.col("weight")
    full = sums_before(w, [turn, F.col("rank")], {"caps": F.col("cap"), "gone": F.col("weight")}, small)
    level = (F.lit(size) - F.col("caps")) / (F.lit(weights) - F.col("gone"))
    below = full.filter(level * F.col("weight") <= F.col("cap")).agg(F.min_by(level, F.struct(turn, "rank"))).first()[0]
    share = F.col("cap") if below is None else F.lit(below) * F.col("weight")
    return w.select("source", "source_size", F.least(F.col("cap"), share).alias("target"))


def quotas(sizes: DataFrame, small: bool) -> DataFrame:
    """targets() with blocks, quota (blocks that the mix takes) and first, the quotas of the sources before."""
    t = targets(sizes, small).withColumn("blocks", F.ceil(F.col("source_size") / F.lit(BLOCK)))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    t = t.withColumn("rounds", F.least(rounds, F.lit(CAP)).cast("long"))
    rest = F.greatest(F.lit(0.0), F.col("target") - F.col("rounds") * F.col("source_size"))
    part = F.when((F.col("rounds") < CAP) & (F.col("source_size") > 0), F.least(F.col("blocks"), F.round(rest / F.col("source_size") * F.col("blocks")).cast("long"))).otherwise(F.lit(0))
    t = t.withColumn("quota", (F.col("rounds") * F.col("blocks") + part).cast("long")).drop("rounds")
    return sums_before(t, _by_source(), {"first": F.col("quota")}, small)


def _by_source() -> list[Column]:
    return [F.col("source").asc_nulls_last()]


def _sent(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df.hint("merge")


def drawn(plan: DataFrame, slots: int, small: bool, seed: int) -> DataFrame:
    """(slot, source, i): the source that each slot draws by itself, and the number of the draw among those of its source."""
    spark = plan.sparkSession
    cells = max(CELLS, 0 if small else plan.count())
    width = -(-slots // cells)
    # By cell: the sources whose part of the line of quotas reaches into it.
    spans = plan.filter("quota > 0").select("source", "first", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor((F.col("first") + F.col("quota") - 1) / width))).alias("cell"))
    lines = spans.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("first", "source"))).alias("line"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-slots // (1 << 22)))
    each = spark.range(0, slots, 1, parts).select(F.col("id").alias("slot"), F.pmod(F.xxhash64(F.lit("draw"), F.lit(seed), "id"), F.lit(slots)).alias("u"))
    met = each.withColumn("cell", F.floor(F.col("u") / width)).join(_sent(lines, small), "cell")
    of = F.when(F.size("line") == 1, F.get("line", F.lit(0))).otherwise(F.element_at(F.filter("line", lambda x: x["first"] <= F.col("u")), -1))
    return running_sum(met.select("slot", of["source"].alias("source")), ["source"], ["slot"], F.lit(1), "i")


def _within_quotas(draws: DataFrame, plan: DataFrame, small: bool) -> DataFrame:
    """draws with those beyond the quota of their source dealt to the sources that are short, and with blocks, of the source."""
    n = draws.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("n"))
    had = plan.select("source", "blocks", "quota").join(n, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("n", F.coalesce("n", F.lit(0))).drop("s")
    amounts = {"over": F.greatest(F.col("n") - F.col("quota"), F.lit(0)), "short": F.greatest(F.col("quota") - F.col("n"), F.lit(0))}
    short = sums_before(had.withColumns(amounts), _by_source(), {"first_over": F.col("over"), "first_short": F.col("short")}, small)
    d, o = draws.alias("d"), _sent(short.alias("o"), small)
    own = d.join(o, F.col("d.source").eqNullSafe(F.col("o.source"))).select("slot", "d.source", "i", "blocks", "quota", "first_over")
    stay = own.filter("i < quota").select("slot", "source", "i", "blocks")
    spare = own.filter("i >= quota").select("slot", (F.col("i") - F.col("quota") + F.col("first_over")).alias("place"))
    gaps = short.filter("short > 0").select("source", "n", "blocks", "first_short", F.explode(F.sequence(F.col("first_short"), F.col("first_short") + F.col("short") - 1)).alias("place"))
    moved = spare.join(gaps.hint("merge"), "place").select("slot", "source", (F.col("n") + F.col("place") - F.col("first_short")).alias("i"), "blocks")
    return stay.unionAll(moved)


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """The place of x in a pseudorandom permutation of 0 .. n - 1 that the key chooses.

    A step pairs each place with its mirror about a point and swaps the two or not, by a hash of the greater."""

    def step(seed: Column, x: Column, k: Column) -> Column:
        other = F.pmod(F.xxhash64(seed, k) - x, n)
        return F.when(F.xxhash64(F.greatest(x, other), k, seed).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    steps = F.array(*[F.lit(k) for k in range(ROUNDS)])
    # transform over a one-element array binds the hash of the key once.
    return F.transform(F.array(F.xxhash64(*key)), lambda seed: F.aggregate(steps, x, lambda x, k: step(seed, x, k)))[0]


def slots(sizes: DataFrame, seed: int = 0) -> DataFrame:
    """The mix: (shard, slot, source, block), one row for each block of each output shard."""
    small = _few(sizes)
    plan = quotas(sizes, small)
    total = plan.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    if not total:
        return sizes.sparkSession.createDataFrame([], "shard long, slot int, source string, block long")
    draws = written(drawn(plan, total, small, seed), "draws")
    met = _within_quotas(draws, plan, small)
    block = permuted(F.col("i") % F.col("blocks"), F.col("blocks"), F.lit("block"), F.lit(seed), F.col("source"), F.floor(F.col("i") / F.col("blocks")))
    return met.select(F.floor(F.col("slot") / SHARD_BLOCKS).alias("shard"), (F.col("slot") % SHARD_BLOCKS).cast("int").alias("slot"), "source", block.alias("block"))


def _keyed(docs: DataFrame) -> DataFrame:
    """(row: the struct of a row of docs, doc_id, source, size, key: a hash of the text, id: 0) of each row."""
    text = F.col("text").cast("string")
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id"),
        F.col("source").cast("string").alias("source"),
        n_words(text).alias("size"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"),
        F.lit(0).cast("long").alias("id"),
    )


def _light(keyed: DataFrame) -> DataFrame:
    return written(keyed.drop("row"), "sizes")


def _told_apart(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of _keyed(), and the same without row, written; rows alike in doc_id, source and text have ids of their own."""
    full = _keyed(docs)
    rows = _light(full)
    if not rows.groupBy("doc_id", "source", "key").count().filter("count > 1").isEmpty():
        dropped(rows)
        full = written(full.withColumn("id", F.monotonically_increasing_id()), "rows")
        rows = _light(full)
    return full, rows


def _sources(rows: DataFrame) -> DataFrame:
    return written(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")


def _placed(rows: DataFrame) -> DataFrame:
    """rows with begin, the index of its first word in its source."""
    return running_sum(rows, ["source"], ["doc_id", "size", "key"], F.col("size"), "begin", tie=["id"])


def _parts(placed: DataFrame) -> DataFrame:
    """The rows with words, once for each block that they reach into: block, and words, how many of them lie there."""
    first, last = F.floor(F.col("begin") / BLOCK), F.floor((F.col("begin") + F.col("size") - 1) / BLOCK)
    words = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * BLOCK) - F.greatest(F.col("begin"), F.col("block") * BLOCK)
    return placed.filter("size > 0").select("*", F.explode(F.sequence(first, last)).alias("block")).withColumn("words", words)


def _by_block(parts: DataFrame, of_mix: DataFrame) -> DataFrame:
    # Spark cannot tell how many draws the few rows of sources become, so it must not choose to broadcast them.
    p, t = parts.alias("p"), of_mix.hint("merge").alias("t")
    return p.join(t, F.col("p.source").eqNullSafe(F.col("t.source")) & (F.col("p.block") == F.col("t.block")))


def _met(placed: DataFrame, sizes: DataFrame, seed: int) -> DataFrame:
    """The parts of rows that lie in blocks of the mix, with times."""
    times = slots(sizes, seed).groupBy("source", "block").agg(F.count("*").alias("times"))
    return _by_block(_parts(placed), times).select("p.*", "times")


def _same(a: str, b: str, *columns: str) -> Column:
    out = F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    for c in columns:
        out &= F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def taken(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target and taken, the words that the mix takes of the document, of each row."""
    rows = _light(_keyed(docs.select("doc_id", "source", "text")))
    sizes = _sources(rows)
    placed = _placed(rows)
    sums = _met(placed, sizes, seed).groupBy("source", "begin", "size").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    small = _few(sizes)
    own = _sent(targets(sizes, small), small)
    d, s, o = placed.alias("d"), sums.alias("s"), own.alias("o")
    return (
        d.join(s, _same("d", "s", "begin", "size"), "left")
        .join(o, _same("d", "o"))
        .select("d.doc_id", "d.size", "o.source_size", "o.target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


_ROW = ("doc_id", "key", "id")


def _spelled(full: DataFrame, plans: DataFrame, needed: Column) -> DataFrame:
    """The rows with their plans, and w: the words of the text, split once, where they are needed."""
    text = F.col("row.text").cast("string")
    w = F.when(needed, F.split(F.btrim(text, F.lit(SPACES)), r"[\x20\x09-\x0D]+"))
    return full.alias("d").join(plans.alias("p"), _same("d", "p", *_ROW)).select("d.row", "p.*", w.alias("w"))


def _cut(words: Column, part: Column) -> Column:
    """The words of a part; its first one is word number at of the text."""
    at = F.greatest(F.lit(0).cast("long"), part["block"] * BLOCK - F.col("begin"))
    return F.slice(words, (at + 1).cast("int"), part["words"].cast("int"))


def packed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix as packed blocks, for training: (shard, slot, source, block, text), text being the words of the block joined by spaces.

    A block has BLOCK parts at most, so has a row of the result. Other columns of docs are ignored."""
    full, rows = _told_apart(docs.select("doc_id", "source", "text"))
    sizes = _sources(rows)
    plans = _parts(_placed(rows)).groupBy("source", *_ROW, "begin").agg(F.sort_array(F.collect_list(F.struct("block", "words"))).alias("parts"))
    pieces = _spelled(full, plans, F.lit(True)).select("source", "begin", "w", F.explode("parts").alias("part"))
    pieces = pieces.select("source", "begin", "part.block", F.array_join(_cut(F.col("w"), F.col("part")), " ").alias("text"))
    blocks = pieces.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("begin", "text"))).alias("of"))
    spelled = blocks.select("source", "block", F.array_join(F.transform("of", lambda x: x["text"]), " ").alias("text"))
    return _by_block(spelled, slots(sizes, seed)).select("t.shard", "t.slot", "t.source", "t.block", "p.text")


def mixed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix as documents, with the columns of docs: copy c of a row has the words of its parts that are drawn
    at least c times (its own text where those are all of it); rows without any such part are absent.

    Texts move once, to the plan of their row, and are split once, where some copy lacks a part."""
    full, rows = _told_apart(docs)
    parts = F.sort_array(F.collect_list(F.struct("block", "words", "times")))
    least = F.when(F.sum("words") == F.col("size"), F.min("times")).otherwise(F.lit(0))
    plans = _met(_placed(rows), _sources(rows), seed).groupBy("source", *_ROW, "begin", "size").agg(parts.alias("parts"), F.max("times").alias("most"), least.alias("least"))
    each = _spelled(full, plans, F.col("least") < F.col("most")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "most")))
    held = F.filter("parts", lambda x: x["times"] >= F.col("copy"))
    some = F.array_join(F.flatten(F.transform(held, lambda x: _cut(F.col("w"), x))), " ")
    text = F.when(F.col("copy") <= F.col("least"), F.col("row.text").cast("string")).otherwise(some)
    cut = each.select("row", text.alias("text"))
    of = {"text": F.col("text"), "n_chars": F.length("text").cast("long").alias("n_chars")}
    return cut.select(*[of.get(c, F.col("row").getField(c).alias(c)) for c in docs.columns])
