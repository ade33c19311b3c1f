"""Mixing sources to target weights by pivotal rounding, in DataFrame functions alone.

A source's target is its share, by weight, of all words, stopped at three times its own
words; what it cannot take is shared among the others again. A document is then owed
``target / source_size`` copies: the whole part is certain, the fraction is rounded so that
the source's total in words stays where it is. Two documents with a fraction left are paired
and mass is moved at random from one to the other, as much as makes one fraction 0 or 1 and
keeps the words they are owed together; the other goes on to the next pair. Chunks of
``CHUNK`` documents each leave one such document, these are chunked again, and so on up a
tree. Documents are paired with others of their size (to a power of two), so a tree ends with
one document of each size class, which is rounded to the nearest. What that misses is owed to
the shorter documents of the source before they are rounded in their turn:

* Where a source's longest classes could miss more than a few short documents can make good,
  these classes go first, and the fraction of all shorter documents is raised or lowered by
  the error. This repeats until the rest is small or can be evened out.
* ``HELD`` documents of each class that is left (all of a source of up to ``FOLD``) stay out of
  the tree. One row per source rounds them last, class by class from the longest, together
  with what the tree left of each class; every class takes on the error of the ones before.

So a source's words miss the target by about half a document of its shortest classes, unless
its documents cannot be put together nearer. Apart from the evening out, every document is
expected to get exactly what it is owed.

Random numbers are hashes of what documents hold (and of the rank among equal rows), so
reruns agree, whatever the partitions.

Defined results: null texts have size 0; documents of size 0 have nothing to round and get
the whole part of their source's copies. Null is a source of its own, the last one. Repeated
rows are documents of their own. An empty table, or one without words, gives targets of 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import free_name, named, stored, uniform

MOST_COPIES = 3
CHUNK = 64
# Documents of a source that one row may finish alone, and of a class that are held back.
FOLD = 1024
HELD = 128
# Documents of one source and size class that one task orders.
_BUCKET = 16_384
_WORD = "[^\\x20\\x09-\\x0D]+"


def sizes(docs: DataFrame, text: str, key: str, source: str) -> DataFrame:
    """The narrow table that mixing works on: who, from where, how long."""
    content = named(docs, text)
    return docs.select(
        named(docs, key).alias("doc_id"),
        named(docs, source).alias("source"),
        F.coalesce(F.regexp_count(content, F.lit(_WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(content).alias("digest"),
        F.monotonically_increasing_id().alias("uid"),
    )


def targets(sized: DataFrame) -> DataFrame:
    """``source``, ``source_size`` and ``target``: one row per source.

    With sources ordered by what they hold for their weight, the ones that stop early come
    first, and the level that all others reach follows from sums over the order.
    """
    found = stored(
        sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-source-sizes"
    )
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = found.withColumn("weight", F.pmod(turn - 1, F.lit(3)) + 1).withColumn(
        "most", F.lit(MOST_COPIES) * F.col("source_size")
    )
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(rest)
    reached = weighed.withColumn("level", level).withColumn(
        "fits", F.col("level") <= F.col("most") / F.col("weight")
    )
    shared = F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(everything)
    target = F.least(
        F.col("most").cast("double"), F.coalesce(shared, F.lit(0.0)) * F.col("weight")
    )
    return stored(
        reached.withColumn("target", target).select("source", "source_size", "target"),
        "mix-targets",
    )


_CARRY = "struct<turn:bigint,uid:bigint,p:double,size:double>"
_DONE = "array<struct<uid:bigint,extra:int>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


def _within(low: float, value: Column, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def _pivot(carry: Column, item: Column) -> Column:
    """Two documents meet: ``carry`` goes on, ``done`` is settled."""
    p, q = carry["p"], item["p"]
    ratio = item["size"] / carry["size"]
    up = F.least(1 - q, p / ratio)
    down = F.least(q, (1 - p) / ratio)
    luck = uniform(F.lit("pivot"), carry["turn"], item["turn"])

    # 1: the item becomes whole, 2: the carried one none, 3: the item none, 4: the carried whole.
    def settle(case: Column) -> Column:
        item_done = case.isin(1, 3)
        left = (
            F.when(case == 1, p - (1 - q) * ratio)
            .when(case == 2, q + p / ratio)
            .when(case == 3, p + q * ratio)
            .otherwise(q - (1 - p) / ratio)
        )
        remaining = F.when(item_done, carry).otherwise(item)
        kept = F.struct(
            remaining["turn"].alias("turn"), remaining["uid"].alias("uid"),
            _within(0.0, left, 1.0).alias("p"), remaining["size"].alias("size"),
        )
        done = F.struct(
            F.when(item_done, item["uid"]).otherwise(carry["uid"]).alias("uid"),
            case.isin(1, 4).cast("int").alias("extra"),
        )
        return F.struct(kept.cast(_CARRY).alias("carry"), done.alias("done"))

    case = F.when(
        luck * (up + down) < down, F.when(1 - q <= p / ratio, 1).otherwise(2)
    ).otherwise(F.when(q <= (1 - p) / ratio, 3).otherwise(4))
    return _let(case, settle)


def _chunk_step(state: Column, item: Column) -> Column:
    return _let(
        _pivot(state["carry"], item),
        lambda met: F.struct(
            met["carry"].alias("carry"),
            F.concat(state["done"], F.array(met["done"])).alias("done"),
        ),
    )


def _level(items: DataFrame) -> DataFrame:
    """Every chunk of the level: what it settles and the one document it carries on.

    Only a source's size class that one task cannot order is dealt into buckets, fewer than
    it has documents, so every level settles some of each class that still holds several.
    """
    large = (
        items.groupBy("source", "octave")
        .agg(F.floor(F.count("*") / _BUCKET).alias("buckets"))
        .filter("buckets > 1")
        .select(F.col("source").alias("of"), F.col("octave").alias("class"), "buckets")
    )
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("octave") == F.col("class"))
    items = items.join(large, same, "left").withColumn("buckets", F.coalesce("buckets", F.lit(1)))
    turn = Window.partitionBy("source", "octave", "bucket").orderBy("turn", "uid")
    chunked = items.withColumn("bucket", F.pmod("turn", "buckets")).withColumn(
        "chunk", F.floor((F.row_number().over(turn) - 1) / CHUNK)
    )
    gathered = chunked.groupBy("source", "octave", "bucket", "chunk").agg(
        F.sort_array(F.collect_list(F.struct("turn", "uid", "p", "size"))).alias("items")
    )
    first = F.col("items")[0].cast(_CARRY)
    start = F.struct(first.alias("carry"), F.array().cast(_DONE).alias("done"))
    rest = F.slice("items", 2, CHUNK)
    return gathered.select(
        "source", "octave", F.aggregate(rest, start, _chunk_step).alias("state")
    ).select("source", "octave", "state.*")


def _tree(items: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """What chunks settle, level by level, and the one document left of each class."""
    level, settled = items, []
    count = level.count()
    while count > level.select("source", "octave").distinct().count():
        done = stored(_level(level), "mix-level")
        settled.append(done.select(F.explode("done").alias("d")).select("d.*"))
        level = done.select("source", "octave", "carry.*")
        count = level.count()
    return settled, level


def _rounded(carry: Column, error: Column) -> Column:
    """Whether a document is taken, counting the error of the ones before it."""
    return (carry["p"] * carry["size"] + error >= carry["size"] / 2).cast("int")


_STATE = (
    "struct<carry:struct<down:int,turn:bigint,uid:bigint,p:double,size:double>,"
    f"error:double,level:double,left:double,done:{_DONE}>"
)


def _fold_step(state: Column, item: Column) -> Column:
    """One more document of a source, longest classes first.

    ``level`` is the fraction owed of each held document, ``left`` the words of those to come.
    """
    carry = state["carry"]
    new_class = carry.isNotNull() & (carry["down"] != item["down"])

    def after_class(closed: Column) -> Column:
        error, left = closed["error"], state["left"]
        level = F.when(
            closed["extra"].isNotNull() & (left > 0),
            _within(0.0, state["level"] + error / left, 1.0),
        ).otherwise(state["level"])
        return _let(level, lambda x: with_item(closed, x, error - (x - state["level"]) * left))

    def with_item(closed: Column, level: Column, error: Column) -> Column:
        own = F.struct(
            item["down"].alias("down"), item["turn"].alias("turn"), item["uid"].alias("uid"),
            F.when(item["held"], level).otherwise(item["p"]).alias("p"),
            item["size"].alias("size"),
        )
        left = state["left"] - F.when(item["held"], item["size"]).otherwise(0.0)
        return _let(own, lambda own: met_item(closed, own, level, error, left))

    def met_item(closed, own, level, error, left) -> Column:
        entry = F.struct(carry["uid"].alias("uid"), closed["extra"].alias("extra"))
        met = F.when(
            carry.isNull() | new_class,
            F.struct(
                own.alias("carry"),
                F.when(new_class, F.array(entry)).otherwise(F.array()).cast(_DONE).alias("done"),
            ),
        ).otherwise(
            _let(
                _pivot(carry, own),
                lambda m: F.struct(
                    F.struct(item["down"].alias("down"), m["carry"]["turn"].alias("turn"),
                             m["carry"]["uid"].alias("uid"), m["carry"]["p"].alias("p"),
                             m["carry"]["size"].alias("size")).alias("carry"),
                    F.array(m["done"]).cast(_DONE).alias("done"),
                ),
            )
        )
        return _let(
            met,
            lambda m: F.struct(
                m["carry"].alias("carry"), error.alias("error"), level.alias("level"),
                left.alias("left"), F.concat(state["done"], m["done"]).alias("done"),
            ).cast(_STATE),
        )

    extra = F.when(new_class, _rounded(carry, state["error"]))
    closed = F.struct(
        extra.alias("extra"),
        F.when(new_class, carry["p"] * carry["size"] + state["error"] - extra * carry["size"])
        .otherwise(state["error"])
        .alias("error"),
    )
    return _let(closed, after_class)


def _folded(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``source``, the ``error`` that stays, and ``done`` of a source's last documents.

    ``rows``: ``source``, ``octave``, ``held``, ``turn``, ``uid``, ``p``, ``size``;
    ``sources``: ``source``, ``p`` and ``error``.
    """
    item = F.struct((-F.col("octave")).alias("down"), "held", "turn", "uid", "p", "size")
    gathered = rows.groupBy(F.col("source").alias("of")).agg(
        F.sort_array(F.collect_list(item)).alias("items"),
        F.sum(F.when(F.col("held"), F.col("size")).otherwise(0.0)).alias("left"),
    )
    start = F.struct(
        F.lit(None).cast("struct<down:int,turn:bigint,uid:bigint,p:double,size:double>")
        .alias("carry"),
        F.col("error"), F.col("p").alias("level"), F.col("left"),
        F.array().cast(_DONE).alias("done"),
    ).cast(_STATE)
    state = gathered.join(sources, F.col("of").eqNullSafe(F.col("source"))).select(
        "source", F.aggregate("items", start, _fold_step).alias("state")
    )
    carry, error = F.col("state.carry"), F.col("state.error")
    return (
        state.withColumn("extra", _rounded(carry, error))
        .withColumn("error", carry["p"] * carry["size"] + error - F.col("extra") * carry["size"])
        .select(
            "source", "error",
            F.concat("state.done", F.array(F.struct(carry["uid"].alias("uid"), "extra"))).alias(
                "done"
            ),
        )
    )


def _plan(classes: DataFrame, sources: DataFrame) -> DataFrame:
    """What happens to each source next: ``last`` (the rest goes to one tree and one row) or the
    classes above ``low`` first; ``rest`` are the words of the others."""
    left = classes.join(sources, F.col("of").eqNullSafe(F.col("source"))).filter(
        F.col("octave") <= F.col("top")
    )
    same = Window.partitionBy("source")
    upward = same.orderBy("octave").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    highest = F.max("octave").over(same)
    spare = F.least("p", 1 - F.col("p"))
    left = left.withColumn("highest", highest).withColumn("below", F.sum("words").over(upward))
    largest_miss = F.pow(F.lit(2.0), F.col("highest"))
    lower = F.col("octave") < F.col("highest")
    holds = F.least(F.col("docs"), F.lit(HELD)) * F.pow(F.lit(2.0), F.col("octave")) * spare
    enough = lower & (F.col("below") * spare >= largest_miss)
    planned = left.groupBy("source", "p", "error").agg(
        F.max("highest").alias("top"),
        F.sum("docs").alias("docs"),
        F.sum(F.when(lower, holds).otherwise(0.0)).alias("holds"),
        F.coalesce(
            F.min(F.when(enough, F.col("octave"))), F.max(F.when(lower, F.col("octave")))
        ).alias("low"),
        F.collect_list(F.struct("octave", "below")).alias("sums"),
    )
    rest = F.get(F.filter("sums", lambda x: x["octave"] == F.col("low")), 0)["below"]
    last = (
        F.col("low").isNull()
        | (F.col("docs") <= FOLD)
        | (spare <= 1e-9)
        | (F.col("holds") >= F.pow(F.lit(2.0), F.col("top")))
    )
    return planned.select(
        "source", "p", "error", "top", "docs", "low", rest.alias("rest"), last.alias("last")
    )


def extra_copies(items: DataFrame) -> DataFrame:
    """``uid`` and ``extra`` (0 or 1) of each item: ``source``, ``turn``, ``uid``, ``p``, ``size``.

    All documents of a source are owed the same fraction ``p``.
    """
    octave = F.floor(F.log2("size")).cast("int")
    items = stored(items.withColumn("octave", octave), "mix-classed")
    classes = stored(
        items.groupBy(F.col("source").alias("of"), "octave").agg(
            F.count("*").alias("docs"), F.sum("size").alias("words")
        ),
        "mix-classes",
    )
    sources = items.groupBy("source").agg(
        F.max("p").alias("p"), F.lit(0.0).alias("error"), F.max("octave").alias("top")
    )
    chosen = items.select(F.col("source").alias("of"), "octave", "turn", "uid", "size")
    settled: list[DataFrame] = []
    ready: DataFrame | None = None
    while True:
        plan = stored(_plan(classes, sources), "mix-plan")
        ready = plan.filter("last") if ready is None else ready.unionByName(plan.filter("last"))
        first = plan.filter(~F.col("last"))
        if first.isEmpty():
            break
        long = chosen.join(first, F.col("of").eqNullSafe(F.col("source"))).filter(
            (F.col("octave") > F.col("low")) & (F.col("octave") <= F.col("top"))
        )
        done, level = _tree(long.select("source", "octave", "turn", "uid", "p", "size"))
        ends = stored(
            _folded(level.withColumn("held", F.lit(False)), first), "mix-ends"
        )
        settled += [*done, ends.select(F.explode("done").alias("d")).select("d.*")]
        missed = ends.select(F.col("source").alias("of"), F.col("error").alias("missed"))
        moved = first.join(missed, F.col("source").eqNullSafe(F.col("of"))).withColumn(
            "level", _within(0.0, F.col("p") + F.col("missed") / F.col("rest"), 1.0)
        )
        sources = moved.select(
            "source",
            F.col("level").alias("p"),
            (F.col("missed") - (F.col("level") - F.col("p")) * F.col("rest")).alias("error"),
            F.col("low").alias("top"),
        )
    share = F.when(F.col("plan.docs") <= FOLD, 1.0).otherwise(HELD / F.col("c.docs"))
    held = (
        classes.alias("c")
        .join(ready.alias("plan"), F.col("c.of").eqNullSafe(F.col("plan.source")))
        .filter(F.col("c.octave") <= F.col("plan.top"))
        .select("plan.source", "p", F.col("c.octave").alias("class"), share.alias("share"))
    )
    same = F.col("of").eqNullSafe(F.col("source")) & (F.col("octave") == F.col("class"))
    rest = stored(
        chosen.join(held, same).select(
            "source", "octave", "turn", "uid", "p", "size",
            (uniform(F.lit("held"), F.col("turn")) < F.col("share")).alias("held"),
        ),
        "mix-rest",
    )
    done, level = _tree(rest.filter(~F.col("held")).drop("held"))
    last = rest.filter("held").unionByName(level.withColumn("held", F.lit(False)))
    result = _folded(last, ready).select(F.explode("done").alias("d")).select("d.*")
    for part in [*settled, *done]:
        result = result.unionByName(part)
    return result


def _ranked(sized: DataFrame) -> DataFrame:
    """The rows with their ``rank`` among equal ones, 0 for most.

    Only repeated rows are sorted, over all partitions: one text may be most of them.
    """
    again = (
        sized.groupBy(F.col("doc_id").alias("of"), F.col("digest").alias("print"))
        .agg(F.count("*").alias("rows"))
        .filter("rows > 1")
        .drop("rows")
    )
    again = stored(again, "mix-again")
    if again.isEmpty():
        return sized.withColumn("rank", F.lit(0).cast("long"))
    equal = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("print"))
    order = ["doc_id", "digest", "uid"]
    placed = stored(
        sized.join(again, equal, "left_semi")
        .select(*order)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "mix-repeated",
    )
    # One row per partition, and their running sum.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("part").agg(F.count("*").alias("rows"))
    starts = starts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    numbered = placed.join(starts, "part").withColumn("number", F.col("start") + F.col("place"))
    first = numbered.groupBy(F.col("doc_id").alias("of"), F.col("digest").alias("print")).agg(
        F.min("number").alias("first")
    )
    ranks = numbered.join(first, equal).select(
        F.col("uid").alias("ranked"), (F.col("number") - F.col("first")).alias("rank")
    )
    return (
        sized.join(ranks, F.col("uid") == F.col("ranked"), "left")
        .withColumn("rank", F.coalesce("rank", F.lit(0)))
        .drop("ranked")
    )


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source"):
    """One row per row of ``docs``: ``doc_id``, ``source``, ``digest``, ``size``,
    ``source_size``, ``target`` and ``copies``."""
    sized = stored(sizes(docs, text, key, source), "mix-sizes")
    goals = targets(sized)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    owed = (
        _ranked(sized)
        .withColumnRenamed("source", "of")
        .join(goals, F.col("of").eqNullSafe(F.col("source")))
        .drop("of")
        .withColumn("whole", F.floor(rate))
        .withColumn("p", rate - F.floor(rate))
    )
    drawn = owed.filter((F.col("size") > 0) & (F.col("p") > 0)).select(
        "source", F.xxhash64("doc_id", "digest", "rank").alias("turn"), "uid", "p",
        F.col("size").cast("double").alias("size"),
    )
    extra = extra_copies(drawn)
    return owed.join(extra, "uid", "left").select(
        "doc_id", "source", "digest", "size", "source_size", "target",
        (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("long").alias("copies"),
    )


def mixed_documents(
    docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source"
) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    copies = (
        mix(docs, text, key, source)
        .groupBy(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"))
        .agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows"))
    )
    copies = stored(copies, "mix-copies")
    mark = free_name(docs, "__mark")
    rows = docs.withColumn(mark, F.xxhash64(named(docs, text)))
    joined = rows.join(
        copies, (rows[mark] == copies["__digest"]) & named(rows, key).eqNullSafe(copies["__id"])
    )
    # Equal rows share their copies: one stands for all of them.
    single = joined.filter("__rows = 1").drop("__id", "__digest", "__rows")
    equal = joined.filter("__rows > 1").dropDuplicates([key, mark])
    each = single.unionByName(equal.drop("__id", "__digest", "__rows"))
    return each.withColumn(
        "__copies", F.explode(F.array_repeat(F.lit(1), F.col("__copies").cast("int")))
    ).drop("__copies", mark)
