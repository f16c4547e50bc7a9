"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is the number of copies each of its documents should have.
The whole part is given outright. The fractional part of a document, counted in words, is its
mass, between none and all of its words. Two documents with fractions meet, and one takes mass
from the other until one of them has none or all: which of the two ways it goes is drawn so that
the expected mass of both stays as it was, and the sum stays exactly. What is left over meets the
next document. So a source's words come out as targeted, but for the one fraction left at the end;
it is rounded, and smaller documents of the last group make up for the words that this moves.

A source is dealt into groups of about ``GROUP`` documents that a fold works through; each leaves
one residual, and the residuals are dealt into groups again. The tree has as many levels as the
largest source needs; a source with a third of all rows is many groups and never one task. One
group of documents waits for the root, so that there are small ones to settle the end with.

Draws come from md5 of seed, level and document, so reruns agree whatever the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillspark.llm.tables import digest_fraction, digest_number, packed, told_apart
from rillspark.operators.numbering import numbered
from rillspark.session import durable

GROUP = 256
MOST_COPIES = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """Add weight and target to a table of source and source_size.

    Weights are 1, 2, 3, 1, ... by code point, null last. Targets share all words by weight, but
    none is above ``most`` times its source; the excess goes to the others by weight, again and
    again until none is above. Each round is one aggregate over the table of sources.
    """
    ranked = numbered(sources, [F.col("source").asc_nulls_last()], "_rank")
    ranked = durable(ranked.withColumn("weight", (F.col("_rank") % 3 + 1).cast("int")).drop("_rank"))
    top = (F.col("source_size") * most).cast("double")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("weight") * F.lit(level) > top
        n, fixed, weights = ranked.agg(
            F.count_if(full),
            F.sum(F.when(full, top).otherwise(0.0)),
            F.sum(F.when(~full, F.col("weight"))),
        ).first()
        if n == capped or not weights:
            break
        level, capped = (total - fixed) / weights, n
    return ranked.withColumn("target", F.least(top, F.col("weight") * F.lit(level or 0.0)))


def _pair(a: Column, x: Column) -> tuple[Column, Column]:
    """Masses of a and x after they met; at least one of them has then none or all."""
    room_a, room_x = a["size"] - a["mass"], x["size"] - x["mass"]
    up, down = F.least(room_a, x["mass"]), F.least(a["mass"], room_x)
    rises = x["draw"] * (up + down) < down
    mass_a = F.when(
        rises, F.when(room_a <= x["mass"], a["size"]).otherwise(a["mass"] + x["mass"])
    ).otherwise(F.when(a["mass"] <= room_x, 0.0).otherwise(a["mass"] - room_x))
    mass_x = F.when(
        rises, F.when(x["mass"] <= room_a, 0.0).otherwise(x["mass"] - room_a)
    ).otherwise(F.when(room_x <= a["mass"], x["size"]).otherwise(x["mass"] + a["mass"]))
    return mass_a, mass_x


def _fold(items: Column) -> Column:
    """Work through a group; ``done`` gets every document but the residual ``open``."""

    def meet(state, x):
        a = state["open"]
        mass_a, mass_x = _pair(a, x)
        both = F.struct(mass_a.alias("a"), mass_x.alias("x"))
        met = F.transform(F.array(both), lambda m: _next(state, a, x, m))
        return F.element_at(met, 1)

    def _next(state, a, x, m):
        whole = (m["a"] == 0) | (m["a"] == a["size"])
        a_now, x_now = a.withField("mass", m["a"]), x.withField("mass", m["x"])
        return F.struct(
            F.when(whole, x_now).otherwise(a_now).alias("open"),
            F.concat(
                state["done"], F.array(F.when(whole, a_now).otherwise(x_now))
            ).alias("done"),
        )

    start = F.struct(F.element_at(items, 1).alias("open"), F.slice(items, 1, 0).alias("done"))
    return F.aggregate(F.slice(items, F.lit(2), F.size(items)), start, meet)


def _settled(done: Column, last: Column) -> Column:
    """The root's group with its residual rounded to the nearer end.

    What that adds to or takes from the source is made up by documents of the group that are no
    larger: each is turned over, largest first, if it fits into what is still missing.
    """
    all_of_it = F.when(last["mass"] * 2 >= last["size"], last["size"]).otherwise(F.lit(0.0))

    def turn(state, x):
        owed = state["owed"]
        add = (x["mass"] == 0) & (x["size"] <= owed)
        cut = (x["mass"] > 0) & (x["size"] <= -owed)
        now = F.when(add, x["size"]).when(cut, F.lit(0.0)).otherwise(x["mass"])
        return F.struct(
            (owed - now + x["mass"]).alias("owed"),
            F.concat(state["done"], F.array(x.withField("mass", now))).alias("done"),
        )

    start = F.struct(
        (last["mass"] - all_of_it).alias("owed"),
        F.array(last.withField("mass", all_of_it)).alias("done"),
    )
    return F.aggregate(done, start, turn)["done"]


def dealt_copies(docs: DataFrame, seed: int = 7, most: int = MOST_COPIES) -> DataFrame:
    """How often the mix takes each document.

    Returns doc_id, source, size (words), text_crc32, source_size, target and copies, one row per
    row of ``docs``. A null or empty text has no words and the whole part of its source's rate; a
    null source is a source of its own. Equal rows are separate documents. An empty table gives no
    rows. Other columns are ignored, whatever their names.
    """
    text = F.col("text")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(text).alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).alias("text_crc32"),
    )
    record = ["doc_id", "source", "size", "text_crc32"]
    apart = durable(told_apart(rows, record, "_copy"))
    sources = durable(
        source_targets(
            apart.groupBy("source").agg(
                F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows")
            ),
            most,
        )
    )
    largest = sources.agg(F.max("_rows")).first()[0] or 0

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = sources.withColumnRenamed("source", "_source")
    rows = (
        apart.join(known, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_rate", rate)
        .withColumn("_whole", F.floor("_rate").cast("long"))
        .withColumn("mass", (F.col("_rate") - F.col("_whole")) * F.col("size"))
        .withColumn("_key", digest_number(F.lit(seed), *[F.col(c) for c in [*record, "_copy"]]))
    )
    kept = [*record, "source_size", "target", "_whole"]
    open_rows = (F.col("mass") > 0) & (F.col("size") > 0)
    parts = [rows.filter(~open_rows).select(*kept, F.lit(0).cast("long").alias("_extra"))]
    rows = rows.filter(open_rows).select(
        *kept, "mass", "_key", F.ceil(F.col("_rows") / GROUP).cast("long").alias("_groups")
    )
    level, groups = 0, -(-largest // GROUP)
    while largest:
        salt = F.lit(f"{seed}/{level}")
        item = F.struct(
            F.col("size").cast("double").alias("size"),
            "mass",
            digest_fraction(salt, F.lit("draw"), F.col("_key")).alias("draw"),
            "_key",
            *[F.col(c) for c in ("doc_id", "text_crc32", "_whole")],
        )
        group = digest_number(salt, F.col("_key"), digits=12) % F.col("_groups")
        rows = rows.withColumn("_group", group)
        if level == 0:
            spare = (F.col("_group") == 0) & (F.col("_groups") > 1)
            rows, reserve = rows.filter(~spare), rows.filter(spare).drop("_group")
        by = ["source", "source_size", "target", "_groups", "_group"]
        folded = (
            rows.groupBy(*by)
            .agg(F.array_sort(F.collect_list(item)).alias("_items"))
            # Largest first: a small document is the more likely residual.
            .select(*by, _fold(F.reverse("_items")).alias("_state"))
        )
        folded = durable(folded)
        last = groups <= 1
        root = _settled(F.col("_state.done"), F.col("_state.open"))
        whole = F.when(F.col("_groups") > 1, F.col("_state.done")).otherwise(root)
        done = folded.select(*by, F.explode(whole).alias("d"))
        parts.append(
            done.select(
                F.col("d.doc_id").alias("doc_id"),
                "source",
                F.col("d.size").cast("long").alias("size"),
                F.col("d.text_crc32").alias("text_crc32"),
                "source_size",
                "target",
                F.col("d._whole").alias("_whole"),
                (F.col("d.mass") > 0).cast("long").alias("_extra"),
            )
        )
        if last:
            break
        rows = folded.filter("_groups > 1").select(
            F.col("_state.open.doc_id").alias("doc_id"),
            "source",
            F.col("_state.open.size").cast("long").alias("size"),
            F.col("_state.open.text_crc32").alias("text_crc32"),
            "source_size",
            "target",
            F.col("_state.open._whole").alias("_whole"),
            F.col("_state.open.mass").alias("mass"),
            F.col("_state.open._key").alias("_key"),
            F.ceil(F.col("_groups") / GROUP).cast("long").alias("_groups"),
        )
        fewer = F.ceil(F.col("_groups") / GROUP).cast("long")
        reserve = reserve.withColumn("_groups", fewer)
        rows = rows.unionByName(reserve.filter("_groups = 1"))
        reserve = reserve.filter("_groups > 1")
        level, groups = level + 1, -(-groups // GROUP)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.select(
        *record, "source_size", "target", (F.col("_whole") + F.col("_extra")).alias("copies")
    )


def _numbered_equals(rows: DataFrame, same: list[str]) -> DataFrame:
    """Add ``_number``: from 0 among rows that agree in ``same``.

    Rows are numbered within the task that wrote them, after those of the tasks before, so rows that
    agree without end are never one task's work.
    """
    written = durable(rows.withColumn("_serial", F.monotonically_increasing_id()))
    written = written.withColumn("_task", F.shiftright("_serial", 33))
    by_task = written.groupBy(*same, "_task").agg(F.count(F.lit(1)).alias("_here"))
    before = Window.partitionBy(*same).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select(
        *[F.col(c).alias(f"{c}_") for c in same],
        F.col("_task").alias("_task_"),
        F.coalesce(F.sum("_here").over(before), F.lit(0)).alias("_offset"),
    )
    within = F.row_number().over(Window.partitionBy(*same, "_task").orderBy("_serial"))
    met = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in [*same, "_task"]]
    placed = written.withColumn("_within", within).join(offsets, met)
    return placed.withColumn("_number", F.col("_offset") + F.col("_within") - 1)


def mixed(docs: DataFrame, seed: int = 7, most: int = MOST_COPIES) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with their columns.

    What was dealt to rows that agree in doc_id, source and text goes to them one by one, as dealt: none comes more
    than ``most`` times. Documents without words are taken by the whole part of the rate.
    """
    record = ["doc_id", "source", "size", "text_crc32"]
    names = [f"_{c}" for c in record]
    dealt = durable(
        dealt_copies(docs, seed, most)
        .groupBy(*record)
        # Equal rows differ by one copy at most.
        .agg(F.min("copies").alias("_each"), F.sum("copies").alias("_all"), F.count(F.lit(1)).alias("_same"))
        .select(
            *[F.col(c).alias(n) for c, n in zip(record, names, strict=True)],
            F.col("_each").cast("int").alias("_each"),
            (F.col("_all") - F.col("_each") * F.col("_same")).alias("_more"),
            "_same",
        )
    )
    text = F.col("_doc.text")
    mine = [
        F.col("_doc.doc_id").cast("long"),
        F.col("_doc.source").cast("string"),
        word_count(text),
        F.coalesce(F.crc32(text), F.lit(0)),
    ]

    def of(taken: DataFrame) -> DataFrame:
        same = [m.eqNullSafe(F.col(n)) for m, n in zip(mine, names, strict=True)]
        return packed(docs).join(taken, same)

    def repeated(found: DataFrame, more: Column) -> DataFrame:
        times = F.col("_each") + more.cast("int")
        each = F.explode(F.array_repeat(F.lit(0), times))
        return found.select("_doc", each.alias("_")).select("_doc.*")

    out = repeated(of(dealt.filter("_same = 1 and _each + _more > 0")), F.col("_more"))
    equal = dealt.filter("_same > 1 and _each + _more > 0")
    if not equal.isEmpty():
        numbered_rows = _numbered_equals(of(equal), names)
        out = out.unionByName(repeated(numbered_rows, F.col("_number") < F.col("_more")))
    return out
